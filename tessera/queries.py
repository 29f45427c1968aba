"""One query per operator family over the fixture views, each with its SQL.

Names start with the kind of operator; a docstring names what a query covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from . import schema
from .functions import bits, payload, text
from .operators import diff, graph, kb, match, order, refine, repair, report, scan, score, search, validate, views
from .plans import apply, pipeline
from .plans.lineage import settle
from .plans.ranks import places
from .sources import files
from .sources.fixtures import ctes, view
from .streaming import audit

CONFIG = settings.load()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def base_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The call graph with all its annotations, and its edges."""
    functions, xrefs = view(spark, d, "functions"), view(spark, d, "xrefs")
    calls = settle(scan.edges(xrefs, functions), "edges")
    noted = scan.annotations(xrefs, functions, view(spark, d, "imports"), view(spark, d, "strings"), view(spark, d, "operands"), CONFIG)
    nodes = settle(scan.degrees(noted, calls), "nodes")
    inputs = graph.reachable(calls, nodes.where(F.size("input_calls") > 0)).withColumn("input_reachable", F.lit(True))
    full = nodes.join(inputs, "address", "left").withColumn("input_reachable", F.coalesce("input_reachable", F.lit(False)))
    return settle(full, "nodes"), calls


def scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, calls = base_nodes(spark, d)
    return nodes, calls, settle(score.scored(nodes, graph.depth_from_leaves(nodes, calls), CONFIG), "scores")


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


SINKS, INPUTS = quoted(CONFIG["graph"]["dangerous_sinks"]), quoted(CONFIG["graph"]["input_sink_apis"])
NODES = ctes("edges", "imports", "strings", "operands", "kb") + f""",
apis AS (SELECT x.caller, x.item, coalesce(i.name, 'ord_' || i.ordinal) AS api FROM xrefs x JOIN imports i ON x.target = i.address),
texts AS (SELECT x.caller, x.item, s.value FROM xrefs x JOIN strings s ON x.target = s.address WHERE length(trim(s.value)) >= 2),
consts AS (SELECT caller, CASE WHEN value >= 9223372036854775808 THEN CAST(CAST(value AS HUGEINT) - 18446744073709551616 AS BIGINT)
  ELSE CAST(value AS BIGINT) END AS c FROM operands WHERE NOT is_offset),
reach(address) AS (SELECT caller FROM apis WHERE api IN ({INPUTS}) UNION SELECT e.callee FROM reach r JOIN edges e ON e.caller = r.address),
walk(address, hop) AS (SELECT address, 0 FROM functions WHERE address NOT IN (SELECT caller FROM edges)
  UNION SELECT e.caller, w.hop + 1 FROM walk w JOIN edges e ON e.callee = w.address WHERE w.hop < 40),
depths AS (SELECT address, min(hop) AS depth FROM walk GROUP BY address),
api20 AS (SELECT caller, api, min(item) AS item FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY item, api) AS rn FROM apis) WHERE rn <= 20 GROUP BY ALL),
text20 AS (SELECT caller, value, min(item) AS item FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY item, value) AS rn FROM texts) WHERE rn <= 20 GROUP BY ALL),
sinks AS (SELECT caller, api, min(item) AS item FROM apis WHERE api IN ({SINKS}) GROUP BY ALL),
firsts AS (SELECT x.caller, x.target AS callee, min(x.item) AS item FROM xrefs x JOIN functions f ON x.target = f.address WHERE x.caller <> x.target AND x.is_code GROUP BY ALL),
nodes AS (SELECT f.*, coalesce(n.n, 0) AS caller_count,
  coalesce((SELECT list(api ORDER BY item, api) FROM api20 a WHERE a.caller = f.address), []) AS import_refs,
  coalesce((SELECT list(value ORDER BY item, value) FROM text20 a WHERE a.caller = f.address), []) AS string_refs,
  coalesce((SELECT list(api ORDER BY item, api) FROM sinks a WHERE a.caller = f.address), []) AS sinks,
  coalesce((SELECT list(callee ORDER BY item, callee) FROM firsts a WHERE a.caller = f.address), []) AS callee_addresses,
  coalesce((SELECT list_sort(list(DISTINCT c))[1:64] FROM consts a WHERE a.caller = f.address AND abs(c) > 16), []) AS constant_operands,
  f.address IN (SELECT address FROM reach) AS input_reachable, coalesce(d.depth, 0) AS depth
  FROM functions f LEFT JOIN (SELECT callee, count(*) AS n FROM edges GROUP BY callee) n ON n.callee = f.address
  LEFT JOIN depths d ON d.address = f.address),
scored AS (SELECT *, CAST(CASE WHEN len(sinks) > 0 THEN 3 ELSE 0 END + CASE WHEN input_reachable THEN 5 ELSE 0 END
  + CASE WHEN greatest(basic_block_count - 1, 0) <= 5 THEN 2
      WHEN greatest(basic_block_count - 1, 0) >= 20 AND caller_count <= 3 THEN 3 ELSE 0 END
  + CASE WHEN caller_count <= 3 THEN 4 WHEN caller_count <= 10 THEN 1 WHEN caller_count <= 50 THEN 0
      WHEN caller_count <= 200 THEN -2 ELSE -5 END AS DOUBLE) AS score, depth,
  score + depth AS total FROM nodes)
"""


@query(NODES + "SELECT address, name, caller_count, callee_addresses, import_refs, string_refs, sinks AS dangerous_sink_calls, constant_operands, input_reachable FROM nodes")
def scan_annotated_graph(spark: SparkSession, d: str) -> DataFrame:
    """References joined to functions, imports and strings, in scan order; degrees; input reachability."""
    nodes, _ = base_nodes(spark, d)
    return nodes.select(
        "address", "name", "caller_count", "callee_addresses", "import_refs", "string_refs", "dangerous_sink_calls", "constant_operands", "input_reachable"
    )


@query(ctes("edges") + "SELECT caller, callee FROM edges")
def scan_edges(spark: SparkSession, d: str) -> DataFrame:
    return scan.edges(view(spark, d, "xrefs"), view(spark, d, "functions")).select("caller", "callee")


@query(NODES + "SELECT address, constant_operands AS constants FROM nodes")
def scan_constants(spark: SparkSession, d: str) -> DataFrame:
    """Signed 64-bit immediates above a magnitude, distinct, sorted, capped."""
    noted = scan.annotations(view(spark, d, "xrefs"), view(spark, d, "functions"), view(spark, d, "imports"), view(spark, d, "strings"), view(spark, d, "operands"), CONFIG)
    return noted.select("address", F.col("constant_operands").alias("constants"))


@query(NODES + "SELECT address, coalesce((SELECT list(api ORDER BY item, api) FROM (SELECT api, min(a.item) AS item FROM apis a WHERE a.caller = f.address GROUP BY api)), []) AS imported_apis FROM functions f")
def scan_imports(spark: SparkSession, d: str) -> DataFrame:
    """All imports of each function, uncapped, in scan order."""
    f = view(spark, d, "functions")
    found = scan.imports_of(view(spark, d, "xrefs"), f, view(spark, d, "imports"))
    return f.select("address").join(found, "address", "left").select("address", F.coalesce("imported_apis", F.array().cast("array<string>")).alias("imported_apis"))


@query(ctes("functions", "edges") + """
SELECT f.address, coalesce((SELECT string_agg(concat('0x', hex(e.callee), '=', g.name), ' ' ORDER BY concat('0x', hex(e.callee), '=', g.name)) FROM edges e JOIN functions g ON g.address = e.callee WHERE e.caller = f.address), '') AS callees,
  coalesce((SELECT string_agg(concat('0x', hex(e.caller), '=', g.name), ' ' ORDER BY concat('0x', hex(e.caller), '=', g.name)) FROM edges e JOIN functions g ON g.address = e.caller WHERE e.callee = f.address), '') AS callers FROM functions f""")
def scan_call_names(spark: SparkSession, d: str) -> DataFrame:
    """Maps of callees and callers, hexadecimal address to name, uncapped."""
    f = view(spark, d, "functions")
    named = scan.call_names(view(spark, d, "edges"), f.select("address", F.col("name").alias("shown")))
    flat = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ")
    return named.select("address", flat("callee_names").alias("callees"), flat("caller_names").alias("callers"))


@query(ctes("imports", "strings") + "SELECT address, coalesce(name, 'ord_' || ordinal) AS value FROM imports UNION ALL SELECT address, value FROM strings WHERE length(trim(value)) >= 2")
def scan_dimensions(spark: SparkSession, d: str) -> DataFrame:
    a = scan.import_names(view(spark, d, "imports")).select("address", F.col("name").alias("value"))
    return a.union(scan.long_strings(view(spark, d, "strings")))


@query(NODES + "SELECT address, depth FROM nodes")
def graph_depth_from_leaves(spark: SparkSession, d: str) -> DataFrame:
    nodes, calls = view(spark, d, "functions"), settle(view(spark, d, "edges"), "edges")
    return graph.depth_from_leaves(nodes, calls)


@query(NODES + """, top50 AS (SELECT * FROM scored ORDER BY total DESC, address LIMIT 50)
SELECT t.address, coalesce(nullif(k.new_name, ''), k.old_name, t.name) AS shown_name, t.score, t.depth, t.total
FROM top50 t LEFT JOIN kb k ON k.address = concat('0x', hex(t.address))""")
def flagship_top_scored(spark: SparkSession, d: str) -> DataFrame:
    """The best-scored functions under the names that the knowledge base has for them."""
    _, _, s = scores(spark, d)
    rows = view(spark, d, "kb")
    return kb.overlay(score.top(s, 50), rows).select("address", "shown_name", F.col("score"), "depth", "total")


@query(NODES + "SELECT address, score, total FROM scored")
def score_all(spark: SparkSession, d: str) -> DataFrame:
    _, _, s = scores(spark, d)
    return s.select("address", "score", "total")


@query(NODES + """, pool AS (SELECT * FROM scored ORDER BY total DESC, address LIMIT 60)
SELECT address, name, total FROM pool WHERE starts_with(name, 'sub_') ORDER BY total DESC, address LIMIT 20""")
def score_suspicious(spark: SparkSession, d: str) -> DataFrame:
    _, _, s = scores(spark, d)
    return score.suspicious(s, 20, CONFIG).select("address", "name", "total")


@query(ctes("functions", "edges") + """, w(address, hop) AS (SELECT address, 0 FROM functions WHERE starts_with(name, 'main_')
  UNION SELECT e.callee, w.hop + 1 FROM w JOIN edges e ON e.caller = w.address WHERE w.hop < 2)
SELECT address, min(hop) AS hop FROM w GROUP BY address""")
def graph_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Bounded breadth-first walk from several seeds."""
    seeds = view(spark, d, "functions").where("startswith(name, 'main_')")
    return graph.distances(settle(view(spark, d, "edges"), "edges"), seeds, depth=2)


@query(ctes("functions", "edges") + """, w(address) AS (SELECT address FROM functions WHERE starts_with(name, 'j_')
  UNION SELECT e.callee FROM w JOIN edges e ON e.caller = w.address) SELECT address FROM w""")
def graph_full_subtree(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(settle(view(spark, d, "edges"), "edges"), view(spark, d, "functions").where("startswith(name, 'j_')"))


ENTRY = "(" + "|".join(graph.ENTRY_NAMES) + ")"
ENTRIES = f""", e AS (SELECT address, name, size_bytes,
  regexp_matches(regexp_replace(lower(name), '^_+', ''), '^{ENTRY}') AS named, caller_count FROM nodes),
entries AS (SELECT address, name, CASE WHEN named THEN 0 ELSE 1 END AS segment, row_number() OVER (ORDER BY
  CASE WHEN named THEN 0 ELSE 1 END, CASE WHEN named THEN name END NULLS LAST, CASE WHEN named THEN 0 ELSE -size_bytes END, address) AS place
  FROM e WHERE named OR caller_count = 0)
"""


@query(NODES + ENTRIES + "SELECT address, name, segment, place FROM entries")
def graph_entry_points(spark: SparkSession, d: str) -> DataFrame:
    return graph.entry_points(base_nodes(spark, d)[0])


# Of several shortest paths, the one found first: that whose calls come first, from the start on.
PATHS = NODES + ENTRIES + """, starts AS (SELECT address AS source, place FROM entries WHERE place <= 12),
w2(source, address, hop) AS (SELECT source, source, 0 FROM starts
  UNION SELECT w2.source, e.callee, w2.hop + 1 FROM w2 JOIN edges e ON e.caller = w2.address WHERE w2.hop < 24),
p AS (SELECT source, address, min(hop) AS hop FROM w2 GROUP BY ALL),
ways(source, address, hop, calls, path) AS (SELECT source, source, 0, CAST([] AS BIGINT[]), [source] FROM starts
  UNION ALL SELECT w.source, c.callee, w.hop + 1, list_append(w.calls, c.item), list_append(w.path, c.callee)
  FROM ways w JOIN firsts c ON c.caller = w.address JOIN p ON p.source = w.source AND p.address = c.callee AND p.hop = w.hop + 1),
best AS (SELECT source, address, min(hop) AS hop, arg_min(path, calls) AS path FROM ways GROUP BY ALL)
"""


@query(PATHS + "SELECT source, address, hop, path FROM best")
def graph_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths from the first entry points to all that they reach."""
    nodes, calls = base_nodes(spark, d)
    sources = graph.entry_points(nodes).where(F.col("place") <= 12).select(F.col("address").alias("source"))
    return graph.shortest_paths(calls, sources)


@query(PATHS + """, r AS (SELECT best.*, s.total, row_number() OVER (PARTITION BY best.address ORDER BY st.place) AS k FROM best
  JOIN starts st USING (source) JOIN scored s ON s.address = best.address WHERE len(s.sinks) > 0 AND hop > 0)
SELECT address, source, hop, path, total FROM r WHERE k = 1 ORDER BY total DESC, address LIMIT 15""")
def graph_paths_to_sinks(spark: SparkSession, d: str) -> DataFrame:
    nodes, calls, s = scores(spark, d)
    return graph.paths_to_sinks(nodes, calls, s).select("address", "source", "hop", "path", "total")


@query(PATHS + """, r AS (SELECT best.*, s.total, row_number() OVER (PARTITION BY best.address ORDER BY st.place) AS k FROM best
  JOIN starts st USING (source) JOIN scored s ON s.address = best.address WHERE len(s.sinks) > 0 AND hop > 0),
t AS (SELECT address AS path_no, path FROM r WHERE k = 1 ORDER BY total DESC, address LIMIT 15),
u AS (SELECT path_no, unnest(path) AS address, generate_subscripts(path, 1) - 1 AS step FROM t)
SELECT path_no, string_agg(concat('    ', repeat('  ', step), CASE WHEN step > 0 THEN '└─ ' ELSE '' END, '0x', hex(u.address), '  ', n.name,
  CASE WHEN len(sinks) > 0 THEN concat('   [', array_to_string(sinks[1:2], ','), ']') ELSE '' END), chr(10) ORDER BY step) AS text,
  (SELECT count(DISTINCT address) FROM u) AS functions FROM u JOIN nodes n ON n.address = u.address GROUP BY path_no""")
def view_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths as indented lines, and how many functions are on them."""
    nodes, calls, s = scores(spark, d)
    paths = settle(graph.paths_to_sinks(nodes, calls, s).select(F.col("address").alias("path_no"), "path"), "paths")
    return views.describe_paths(paths, nodes).join(F.broadcast(views.distinct_on_paths(paths).select("functions")))



@query(NODES + """, hits AS (SELECT address, name, CASE WHEN contains(lower(name), 'ing') THEN 'name'
  WHEN len(list_filter(string_refs, lambda s: contains(lower(s), 'ing'))) > 0 THEN 'string'
  WHEN len(list_filter(import_refs, lambda s: contains(lower(s), 'ing'))) > 0 THEN 'import' END AS kind FROM nodes),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY address) AS k FROM hits WHERE kind IS NOT NULL)
SELECT kind, address, name FROM r WHERE k <= 40""")
def graph_find(spark: SparkSession, d: str) -> DataFrame:
    return graph.find(base_nodes(spark, d)[0], "ing")


@query(ctes("functions", "kb") + """, q AS (SELECT name AS query FROM functions WHERE address % 200 = 5 UNION SELECT '0x' || hex(address) FROM functions WHERE address % 300 = 9
  UNION SELECT new_name FROM kb WHERE doc_id % 100 = 8 UNION SELECT 'main_'),
m AS (SELECT query, CAST(from_hex_address AS BIGINT) AS address, 0 AS rank FROM (SELECT query, ('0x' || substr(query, 3))::BIGINT AS from_hex_address FROM q WHERE regexp_matches(query, '^0[xX][0-9A-Fa-f]+$'))
  UNION ALL SELECT query, min(f.address), 1 FROM q JOIN functions f ON f.name = q.query GROUP BY query
  UNION ALL SELECT query, CASE WHEN count(*) = 1 THEN min(f.address) END, 2 FROM q JOIN functions f ON contains(lower(f.name), lower(q.query)) GROUP BY query
  UNION ALL SELECT query, ('0x' || substr(min(k.address), 3))::BIGINT, 3 FROM q JOIN kb k ON k.new_name = q.query GROUP BY query HAVING count(*) = 1),
b AS (SELECT query, arg_min_null(address, rank) AS address, min(rank) AS rank FROM m GROUP BY query)
SELECT query, address, CASE WHEN address IS NULL THEN 'ambiguous' ELSE ['address', 'exact', 'partial', 'knowledge base'][rank + 1] END AS how FROM b""")
def graph_resolve(spark: SparkSession, d: str) -> DataFrame:
    f, k = view(spark, d, "functions"), view(spark, d, "kb")
    names = (
        f.where("address % 200 = 5").select(F.col("name").alias("query"))
        .union(f.where("address % 300 = 9").select(text.hex_address(F.col("address"))))
        .union(k.where("doc_id % 100 = 8").select("new_name"))
        .union(spark.range(1).select(F.lit("main_")))
        .where("query IS NOT NULL")
    )
    return graph.resolve(f, k, names)


@query(ctes("functions", "edges") + """, it AS (SELECT address, name FROM functions WHERE NOT starts_with(name, 'sub_'))
SELECT e.caller AS address, e.callee AS other, b.name AS other_name, 'calls' AS relation FROM edges e JOIN it a ON a.address = e.caller JOIN it b ON b.address = e.callee
UNION ALL SELECT e.callee, e.caller, a.name, 'called_by' FROM edges e JOIN it a ON a.address = e.caller JOIN it b ON b.address = e.callee""")
def graph_relatedness(spark: SparkSession, d: str) -> DataFrame:
    return graph.relatedness(view(spark, d, "edges"), view(spark, d, "functions").where("NOT startswith(name, 'sub_')"))


@query(ctes("functions", "edges") + """, it AS (SELECT address, name FROM functions WHERE NOT starts_with(name, 'sub_')),
c AS (SELECT it.address, it.name, (SELECT count(*) FROM edges e WHERE e.caller = it.address AND e.callee IN (SELECT address FROM it)) AS calls_within FROM it)
SELECT address, name, calls_within, row_number() OVER (ORDER BY calls_within, address) AS place FROM c""")
def graph_leaves_first(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "functions").where("NOT startswith(name, 'sub_')")
    return graph.leaves_first(items, graph.relatedness(view(spark, d, "edges"), items))


@query(NODES + """SELECT address, name, callee_addresses AS callees,
  coalesce((SELECT list_sort(list(DISTINCT caller)) FROM edges e WHERE e.callee = f.address), []) AS callers FROM nodes f""")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    f = view(spark, d, "functions")
    return graph.neighbours(f, scan.edges(view(spark, d, "xrefs"), f))


@query(NODES + f"""SELECT count(*) AS functions, count_if(regexp_matches(name, '^(sub_|j_|nullsub_|locret_|loc_)')) AS auto_named,
  count_if(regexp_matches(regexp_replace(lower(name), '^_+', ''), '^{ENTRY}') OR caller_count = 0) AS entry_points,
  count_if(len(sinks) > 0) AS sink_callers, count_if(input_reachable) AS input_reachable, count_if(len(import_refs) > 0) AS with_imports,
  (SELECT count_if(analyzed) FROM kb) AS analyzed,
  count_if(len(sinks) > 0) = 0 AND count_if(input_reachable) = 0 AND count_if(len(import_refs) > 0) = 0 AS statically_linked FROM nodes""")
def graph_overview(spark: SparkSession, d: str) -> DataFrame:
    return graph.overview(base_nodes(spark, d)[0], view(spark, d, "kb"), CONFIG["policy"]["auto_generated_prefixes"])


@query(NODES + "SELECT api, count(*) AS n FROM (SELECT unnest(import_refs) AS api FROM nodes) GROUP BY api ORDER BY n DESC, api LIMIT 12")
def graph_top_imports(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_imports(base_nodes(spark, d)[0])


@query(ctes("functions", "edges") + """, w(a, b) AS (SELECT caller, callee FROM edges UNION SELECT w.a, e.callee FROM w JOIN edges e ON e.caller = w.b)
SELECT f.address, least(f.address, coalesce(min(x.b), f.address)) AS component FROM functions f
LEFT JOIN w x ON x.a = f.address AND EXISTS (SELECT 1 FROM w y WHERE y.a = x.b AND y.b = f.address) GROUP BY f.address""")
def order_components(spark: SparkSession, d: str) -> DataFrame:
    """Strongly connected components."""
    return order.components(view(spark, d, "functions"), view(spark, d, "edges"))


CYCLIC = """, cw(a, b) AS (SELECT caller, callee FROM edges UNION SELECT cw.a, e.callee FROM cw JOIN edges e ON e.caller = cw.b),
bad AS (SELECT DISTINCT f.address FROM functions f WHERE f.address IN (SELECT a FROM cw WHERE a = b)
  OR f.address IN (SELECT a FROM cw WHERE b IN (SELECT a FROM cw WHERE a = b))),
lv(address, level) AS (SELECT address, 0 FROM functions WHERE address NOT IN (SELECT caller FROM edges)
  UNION SELECT e.caller, l.level + 1 FROM lv l JOIN edges e ON e.callee = l.address WHERE e.caller NOT IN (SELECT address FROM bad))
"""


@query(ctes("functions", "edges") + CYCLIC + """SELECT f.address, CASE WHEN f.address NOT IN (SELECT address FROM bad) THEN max(lv.level) END AS level
FROM functions f LEFT JOIN lv ON lv.address = f.address GROUP BY f.address""")
def order_levels(spark: SparkSession, d: str) -> DataFrame:
    """Bottom-up levels; null in or above cycles."""
    return order.levels(view(spark, d, "functions"), view(spark, d, "edges"))


@query(NODES + CYCLIC + """,
lev AS (SELECT f.address, CASE WHEN f.address NOT IN (SELECT address FROM bad) THEN max(lv.level) END AS level FROM functions f LEFT JOIN lv ON lv.address = f.address GROUP BY f.address),
com AS (SELECT b.address, least(b.address, coalesce(min(x.b), b.address)) AS component FROM bad b LEFT JOIN cw x ON x.a = b.address AND EXISTS (SELECT 1 FROM cw y WHERE y.a = x.b AND y.b = b.address) GROUP BY b.address),
bet AS (SELECT DISTINCT p.component AS a, q.component AS b FROM edges e JOIN com p ON p.address = e.caller JOIN com q ON q.address = e.callee WHERE p.component <> q.component),
up(component, upper) AS (SELECT DISTINCT component, 0 FROM com WHERE component NOT IN (SELECT a FROM bet) UNION SELECT bet.a, up.upper + 1 FROM up JOIN bet ON bet.b = up.component),
ups AS (SELECT component, max(upper) AS upper FROM up GROUP BY component)
SELECT s.address, lev.level, com.component, s.total, row_number() OVER (ORDER BY lev.level NULLS LAST, ups.upper NULLS FIRST, com.component NULLS FIRST, s.total DESC, s.address) AS place
FROM scored s JOIN lev ON lev.address = s.address LEFT JOIN com ON com.address = s.address LEFT JOIN ups ON ups.component = com.component""")
def order_worklist(spark: SparkSession, d: str) -> DataFrame:
    """Levels, then components of what is cyclic, best score first."""
    nodes, calls, s = scores(spark, d)
    return order.worklist(nodes, calls, s)


@query(ctes("kb") + """SELECT count_if(analyzed) AS analyzed, count_if(status = 'approved') AS approved, count_if(status = 'rejected') AS rejected,
  count_if(applied) AS applied, count_if(status = 'approved' AND NOT coalesce(applied, false) AND coalesce(new_name, '') <> '') AS pending_apply,
  count_if(refined) AS refined, count_if(security_relevant) AS security, count_if(coalesce(summary, '') <> '') AS with_summary,
  count_if(pseudocode_truncated) AS pseudocode_truncated FROM kb""")
def kb_stats(spark: SparkSession, d: str) -> DataFrame:
    return kb.stats(view(spark, d, "kb"))


@query(ctes("kb") + """SELECT address, new_name, confidence FROM kb WHERE status = 'approved' AND NOT coalesce(applied, false)
  AND coalesce(new_name, '') <> '' AND coalesce(confidence, 0) >= 0.5""")
def kb_approved_unapplied(spark: SparkSession, d: str) -> DataFrame:
    return kb.approved_unapplied(view(spark, d, "kb"), 0.5).select("address", "new_name", "confidence")


@query(ctes("kb") + r"""SELECT address, new_name, confidence FROM kb WHERE analyzed AND NOT refined AND status = 'approved'
  AND (confidence IS NULL OR confidence < 0.7 OR starts_with(new_name, 'wrapper_'))""")
def kb_unrefined(spark: SparkSession, d: str) -> DataFrame:
    return kb.unrefined(view(spark, d, "kb"), CONFIG["kb"]["refinement_confidence_skip"]).select("address", "new_name", "confidence")


@query(ctes("kb") + "SELECT address, row_number() OVER (ORDER BY address) AS place FROM kb WHERE pseudocode_truncated")
def kb_truncated(spark: SparkSession, d: str) -> DataFrame:
    return places(kb.truncated(view(spark, d, "kb")), "address").select("address", "place")


@query(ctes("kb") + "SELECT address, summary FROM kb WHERE coalesce(summary, '') <> ''")
def kb_for_embedding(spark: SparkSession, d: str) -> DataFrame:
    return kb.for_embedding(view(spark, d, "kb")).select("address", "summary")


@query(ctes("kb") + "SELECT address, confidence, risk FROM kb WHERE security_relevant AND analyzed")
def kb_security(spark: SparkSession, d: str) -> DataFrame:
    return kb.security(view(spark, d, "kb")).select("address", "confidence", "risk")


@query(ctes("kb") + "SELECT address, old_name, new_name, status FROM kb WHERE address IN ('0x1F', '0xA', '0x12C')")
def kb_point_get(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.createDataFrame([("1f",), ("0xa",), (" 12C",)], "typed string").select(text.canonical_address(F.col("typed")).alias("address"))
    return view(spark, d, "kb").join(F.broadcast(keys), "address", "left_semi").select("address", "old_name", "new_name", "status")


@query(ctes("kb", "edges") + """, p AS (SELECT concat('0x', hex(caller)) AS address, concat('0x', hex(callee)) AS other FROM edges)
SELECT p.address, p.other, k.summary, row_number() OVER (PARTITION BY p.address ORDER BY k.security_relevant DESC, k.confidence DESC NULLS LAST, p.other) AS place
FROM p JOIN kb k ON k.address = p.other WHERE k.analyzed AND k.summary IS NOT NULL""")
def kb_neighbour_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of callees, in the order they are shown; one join instead of a lookup a function."""
    e = view(spark, d, "edges").select(text.hex_address(F.col("caller")).alias("address"), text.hex_address(F.col("callee")).alias("other"))
    return kb.neighbour_rows(view(spark, d, "kb"), e).select("address", "other", "summary", "place")


@query(ctes("kb") + """, h AS (SELECT * FROM kb WHERE coalesce(body_hash, '') <> ''),
m AS (SELECT a.address, b.address AS other, row_number() OVER (PARTITION BY a.address ORDER BY coalesce(b.status = 'approved', false) DESC, b.confidence DESC NULLS LAST, b.address) AS r
  FROM h a JOIN h b ON a.body_hash = b.body_hash AND a.address <> b.address AND b.analyzed),
n AS (SELECT body_hash, count(*) AS size FROM h WHERE analyzed GROUP BY body_hash)
SELECT h.address, h.body_hash, n.size - CASE WHEN h.analyzed THEN 1 ELSE 0 END AS family_size,
  coalesce((SELECT list(other ORDER BY r) FROM m WHERE m.address = h.address AND r <= 6), []) AS members FROM h JOIN n USING (body_hash)""")
def kb_families(spark: SparkSession, d: str) -> DataFrame:
    return kb.families(view(spark, d, "kb"))


@query(ctes("kb") + """SELECT address, coalesce(old_name, '') AS old_name, coalesce(new_name, '') AS new_name, coalesce(confidence, 0) AS confidence, coalesce(summary, '') AS summary,
  coalesce(risk, '') AS risk, coalesce(status, '') AS status, coalesce(security_relevant, false) AS security_relevant, coalesce(applied, false) AS applied FROM kb WHERE analyzed""")
def kb_review(spark: SparkSession, d: str) -> DataFrame:
    return kb.review(view(spark, d, "kb"))


DECISIONS = """, dec AS (SELECT address, doc_id AS seq, concat('renamed_', CAST(doc_id % 7 AS VARCHAR)) AS new_name,
  CAST(doc_id * 53 % 101 AS DOUBLE) / 100 AS confidence, CASE WHEN doc_id % 5 = 0 THEN 'rejected' ELSE 'approved' END AS status FROM kb WHERE doc_id % 3 = 0
  UNION ALL SELECT address, doc_id + 1000000, concat('second_', CAST(doc_id % 7 AS VARCHAR)), CAST(doc_id * 11 % 101 AS DOUBLE) / 100, 'approved' FROM kb WHERE doc_id % 6 = 0)"""


def decisions(rows: DataFrame) -> DataFrame:
    one = rows.where("doc_id % 3 = 0").selectExpr(
        "address", "doc_id AS seq", "concat('renamed_', doc_id % 7) AS new_name", "CAST(doc_id * 53 % 101 AS DOUBLE) / 100 AS confidence",
        "CASE WHEN doc_id % 5 = 0 THEN 'rejected' ELSE 'approved' END AS status",
    )
    two = rows.where("doc_id % 6 = 0").selectExpr(
        "address", "doc_id + 1000000 AS seq", "concat('second_', doc_id % 7) AS new_name", "CAST(doc_id * 11 % 101 AS DOUBLE) / 100 AS confidence", "'approved' AS status"
    )
    return one.union(two)


@query(ctes("kb") + DECISIONS + """, s AS (SELECT address, -1 AS seq, CAST(NULL AS VARCHAR) AS status, coalesce(confidence, 0) AS confidence FROM kb UNION ALL SELECT address, seq, status, confidence FROM dec),
b AS (SELECT *, coalesce(lag(confidence) OVER (PARTITION BY address ORDER BY seq), 0) AS before FROM s),
r AS (SELECT address, coalesce(bool_or(status = 'approved' AND confidence > before AND seq >= 0), false) AS better FROM b GROUP BY address),
l AS (SELECT address, arg_max(new_name, seq) AS new_name, arg_max(confidence, seq) AS confidence, arg_max(status, seq) AS status FROM dec GROUP BY address)
SELECT k.address, CASE WHEN l.address IS NOT NULL THEN l.new_name ELSE k.new_name END AS new_name, CASE WHEN l.address IS NOT NULL THEN l.confidence ELSE k.confidence END AS confidence,
  CASE WHEN l.address IS NOT NULL THEN l.status ELSE k.status END AS status, k.applied_name,
  CASE WHEN l.address IS NOT NULL AND coalesce(k.applied, false) AND r.better THEN false ELSE k.applied END AS applied
FROM kb k LEFT JOIN l USING (address) LEFT JOIN r USING (address)""")
def kb_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Latest decision wins; a strictly more confident approval makes an applied row pending again."""
    rows = view(spark, d, "kb")
    return kb.upsert(rows, decisions(rows)).select("address", "new_name", "confidence", "status", "applied_name", "applied")


@query(ctes("kb") + DECISIONS + "SELECT address, arg_max(new_name, seq) AS new_name, max(seq) AS seq FROM dec GROUP BY address")
def kb_latest(spark: SparkSession, d: str) -> DataFrame:
    return kb.latest(decisions(view(spark, d, "kb"))).select("address", "new_name", "seq")


@query(ctes("kb") + """SELECT address, CASE WHEN doc_id % 4 = 1 THEN 'better' ELSE new_name END AS new_name,
  CASE WHEN doc_id % 4 = 1 THEN 0.9 ELSE confidence END AS confidence, CASE WHEN doc_id % 4 = 1 THEN true ELSE refined END AS refined,
  CASE WHEN doc_id % 4 = 1 THEN false ELSE applied END AS applied, applied_name FROM kb""")
def kb_refinement_update(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "kb")
    new = rows.where("doc_id % 4 = 1").select("address", F.lit("better").alias("new_name"), F.lit(0.9).alias("confidence"))
    return kb.after_refinement(rows, new).select("address", "new_name", "confidence", "refined", "applied", "applied_name")


@query(ctes("kb") + "SELECT address, CASE WHEN doc_id % 5 = 2 THEN true ELSE applied END AS applied, CASE WHEN doc_id % 5 = 2 THEN new_name ELSE applied_name END AS applied_name FROM kb")
def kb_mark_applied(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "kb")
    keys = rows.where("doc_id % 5 = 2").select("address", "new_name")
    return kb.mark(rows, keys, applied=F.lit(True), applied_name=F.col("__new_name")).select("address", "applied", "applied_name")


@query(ctes("kb") + """SELECT address, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN analyzed THEN CASE WHEN coalesce(new_name, '') <> '' THEN 'approved' ELSE 'rejected' END END ELSE status END AS status,
  CAST(NULL AS INTEGER) AS num_ctx_used FROM kb""")
def kb_evolve(spark: SparkSession, d: str) -> DataFrame:
    """Missing columns are added and an older form's status is filled in."""
    rows = view(spark, d, "kb").withColumn("status", F.when(F.col("doc_id") % 2 == 0, None).otherwise(F.col("status")))
    return kb.evolve(rows, schema.KB).select("address", "status", "num_ctx_used")


@query("""WITH r AS (SELECT user_id AS workspace, event_id AS seq, event_id % 4 AS calls, value AS elapsed FROM events),
s AS (SELECT workspace, row_number() OVER (PARTITION BY workspace ORDER BY seq) AS k, elapsed / calls AS v FROM r WHERE calls > 0 AND elapsed > 0)
SELECT workspace, list_reduce(list(CASE WHEN k = 1 THEN round(v, 4) ELSE v END ORDER BY k), lambda a, x: round(a * 0.6 + x * 0.4, 4)) AS seconds_per_call FROM s GROUP BY workspace""")
def kb_timing(spark: SparkSession, d: str) -> DataFrame:
    """Each workspace's running average, folded in the order of its runs."""
    runs = view(spark, d, "events").selectExpr("user_id AS workspace", "event_id AS seq", "event_id % 4 AS calls", "value AS elapsed")
    return kb.timing(runs, "workspace")


@query(ctes("kb") + """, m AS (SELECT address AS key, status AS value FROM kb), c AS (SELECT address AS key, 'changed' AS value FROM kb WHERE risk = 'high')
SELECT key, value FROM m WHERE key NOT IN (SELECT key FROM c) UNION ALL SELECT key, value FROM c""")
def kb_meta(spark: SparkSession, d: str) -> DataFrame:
    """Settings by key: changed ones replaced, new ones added."""
    rows = view(spark, d, "kb")
    meta = rows.select(F.col("address").alias("key"), F.col("status").alias("value"))
    return files.set_meta(meta, rows.where("risk = 'high'").select(F.col("address").alias("key"), F.lit("changed").alias("value")))


@query(ctes("functions", "kb") + """SELECT f.address, coalesce(nullif(k.new_name, ''), k.old_name, f.name) AS shown_name, k.status FROM functions f LEFT JOIN kb k ON k.address = concat('0x', hex(f.address))""")
def kb_overlay(spark: SparkSession, d: str) -> DataFrame:
    return kb.overlay(view(spark, d, "functions"), view(spark, d, "kb")).select("address", "shown_name", "status")


MATCH = ctes("old_nodes", "new_nodes", "old_calls", "new_calls") + """,
oc AS (SELECT c.caller, list_sort(list(DISTINCT n.name)) AS cs FROM old_calls c JOIN old_nodes n ON n.address = c.callee WHERE NOT regexp_matches(n.name, '^(sub_|nullsub_|j_|locret_|loc_|unknown_libname)') GROUP BY c.caller),
nc AS (SELECT c.caller, list_sort(list(DISTINCT n.name)) AS cs FROM new_calls c JOIN new_nodes n ON n.address = c.callee WHERE NOT regexp_matches(n.name, '^(sub_|nullsub_|j_|locret_|loc_|unknown_libname)') GROUP BY c.caller),
o AS (SELECT n.*, coalesce(oc.cs, []) AS cs FROM old_nodes n LEFT JOIN oc ON oc.caller = n.address),
p AS (SELECT n.*, coalesce(nc.cs, []) AS cs FROM new_nodes n LEFT JOIN nc ON nc.caller = n.address),
pairs AS (SELECT o.name, o.address AS oa, p.address AS pa, o.name = p.name AND NOT starts_with(o.name, 'sub_') AS by_name,
  0.35 * (1 - abs(o.size_bytes - p.size_bytes) / greatest(o.size_bytes, p.size_bytes, 1)) + 0.25 * (1 - abs(o.basic_block_count - p.basic_block_count) / greatest(o.basic_block_count, p.basic_block_count, 1))
  + 0.30 * CASE WHEN len(o.cs) = 0 AND len(p.cs) = 0 THEN 1 WHEN len(o.cs) = 0 OR len(p.cs) = 0 THEN 0 ELSE len(list_intersect(o.cs, p.cs)) / len(list_distinct(list_concat(o.cs, p.cs))) END
  + 0.10 * (1 - abs(o.caller_count - p.caller_count) / greatest(o.caller_count, p.caller_count, 1)) AS s
  FROM o JOIN p ON o.name = p.name OR (starts_with(o.name, 'sub_') AND starts_with(p.name, 'sub_')))"""


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    out = []
    for side in ("old", "new"):
        n = view(spark, d, f"{side}_nodes").withColumn("constants", F.array("operand"))
        out.append(settle(match.named_callees(n, view(spark, d, f"{side}_calls")), side))
    return out[0], out[1]


@query(MATCH + """, u AS (SELECT oa, pa, s, row_number() OVER (ORDER BY s DESC, oa DESC, pa DESC) AS k FROM pairs WHERE NOT by_name AND s > 0.5),
g(k, so, sp) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL
  SELECT u.k, CASE WHEN list_contains(so, oa) OR list_contains(sp, pa) THEN so ELSE list_append(so, oa) END, CASE WHEN list_contains(so, oa) OR list_contains(sp, pa) THEN sp ELSE list_append(sp, pa) END
  FROM g JOIN u ON u.k = g.k + 1),
last AS (SELECT so, sp FROM g ORDER BY k DESC LIMIT 1), w AS (SELECT unnest(so) AS oa, unnest(sp) AS pa FROM last)
SELECT w.oa AS old_address, w.pa AS new_address, 'structural' AS method, round(u.s, 6) AS confidence FROM w JOIN u USING (oa, pa)""")
def match_structural(spark: SparkSession, d: str) -> DataFrame:
    """Greedy one-to-one pairing of unnamed functions by structure."""
    old, new = versions(spark, d)
    return match.pair_by_structure(old, new).select("old_address", "new_address", "method", F.round("confidence", 6).alias("confidence"))


@query(MATCH + """, n AS (SELECT name, count(DISTINCT oa) AS a, count(DISTINCT pa) AS b FROM pairs WHERE by_name GROUP BY name)
SELECT oa AS old_address, pa AS new_address, 'name' AS method, 1.0 AS confidence FROM pairs JOIN n USING (name) WHERE by_name AND a = 1 AND b = 1""")
def match_unique_names(spark: SparkSession, d: str) -> DataFrame:
    old, new = versions(spark, d)
    once = old.groupBy("name").count().where("count = 1").join(new.groupBy("name").count().where("count = 1").select("name"), "name").select("name")
    return match.pair_by_name(old.join(once, "name", "left_semi"), new.join(once, "name", "left_semi"))


@query()
def match_full(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by name (duplicates by structure) and by structure, with their category."""
    old, new = versions(spark, d)
    return match.classify(old, new, match.pair(old, new))


@query(MATCH + """, n AS (SELECT name, count(DISTINCT oa) AS a, count(DISTINCT pa) AS b FROM pairs WHERE by_name GROUP BY name),
m AS (SELECT o.*, p.address AS pa, p.size_bytes AS ps, p.basic_block_count AS pb, p.operand AS po FROM o JOIN n USING (name) JOIN p USING (name) WHERE a = 1 AND b = 1)
SELECT CASE WHEN size_bytes = ps AND basic_block_count = pb AND operand <> po THEN 'candidate' WHEN size_bytes = ps AND basic_block_count = pb THEN 'unchanged'
  WHEN starts_with(name, 'wil_details_') THEN 'noise' ELSE 'candidate' END AS category, count(*) AS n, count_if(size_bytes = ps AND basic_block_count = pb AND operand <> po) AS promoted FROM m GROUP BY ALL""")
def match_categories(spark: SparkSession, d: str) -> DataFrame:
    """What changed among functions whose name is unique on both sides."""
    old, new = versions(spark, d)
    once = old.groupBy("name").count().where("count = 1").join(new.groupBy("name").count().where("count = 1").select("name"), "name").select("name")
    o, n = old.join(once, "name", "left_semi"), new.join(once, "name", "left_semi")
    return match.pairing_report(match.classify(o, n, match.pair_by_name(o, n)))


@query(MATCH + """, c AS (SELECT name, (SELECT count(*) FROM o x WHERE x.name = y.name) AS a, (SELECT count(*) FROM p x WHERE x.name = y.name) AS b FROM (SELECT name FROM o UNION SELECT name FROM p) y WHERE NOT starts_with(name, 'sub_'))
SELECT CASE WHEN b > a THEN 'new' ELSE 'removed' END AS situation, starts_with(name, 'wil_details_') AS noise, sum(abs(a - b)) AS n FROM c WHERE a <> b GROUP BY ALL""")
def match_new_and_removed(spark: SparkSession, d: str) -> DataFrame:
    old, new = versions(spark, d)
    found = match.new_and_removed(old, new, settle(match.pair_by_name(old, new), "pairs"))
    return found.groupBy("situation", "noise").agg(F.count("*").alias("n"))


QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in view(spark, d, "embeddings").where("vec_id = 7").first()["embedding"]]


@query(f"""SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])), 6) AS sim FROM embeddings
ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])) DESC, vec_id LIMIT 40""")
def search_top_k(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(view(spark, d, "embeddings"), query_vector(spark, d), 40, "vec_id").select("vec_id", F.round("sim", 6).alias("sim"))


@query(ctes("kb") + f""", pool AS (SELECT concat('0x', hex(vec_id)) AS address, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({QUERY_VECTOR} AS DOUBLE[])) AS sim FROM embeddings ORDER BY sim DESC, address LIMIT 80),
m AS (SELECT unnest([false, true]) AS security_only),
h AS (SELECT m.security_only, p.*, k.new_name, k.old_name, sim + CASE k.risk WHEN 'medium' THEN 0.03 WHEN 'high' THEN 0.07 ELSE 0 END + CASE WHEN security_relevant THEN 0.02 ELSE 0 END AS adjusted,
  coalesce(nullif(body_hash, ''), regexp_replace(coalesce(nullif(new_name, ''), nullif(old_name, ''), '?'), '_[0-9]+$', '')) AS family FROM m, pool p JOIN kb k USING (address) WHERE sim >= 0.1 AND (security_relevant OR NOT security_only)),
r AS (SELECT *, row_number() OVER (PARTITION BY security_only, family ORDER BY adjusted DESC, address) AS k, count(*) OVER (PARTITION BY security_only, family) - 1 AS similar_count FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY security_only ORDER BY adjusted DESC, address) AS place FROM r WHERE k = 1)
SELECT security_only, address, family, round(sim, 6) AS sim, round(adjusted, 6) AS adjusted, similar_count FROM b WHERE place <= 20""")
def search_semantic(spark: SparkSession, d: str) -> DataFrame:
    """Pool, floor, security filter or not, boosts, one result a family, top k."""
    c = settings.merged(CONFIG, {"search": {"min_similarity": 0.1}})
    vectors = view(spark, d, "embeddings").select(text.hex_address(F.col("vec_id")).alias("address"), "embedding")
    rows, q = view(spark, d, "kb"), query_vector(spark, d)
    both = [search.semantic(vectors, rows, q, 20, c, only).withColumn("security_only", F.lit(only)) for only in (False, True)]
    return both[0].unionByName(both[1]).select("security_only", "address", "family", F.round("sim", 6).alias("sim"), F.round("adjusted", 6).alias("adjusted"), "similar_count")


@query(ctes("kb") + "SELECT address, confidence FROM kb WHERE analyzed ORDER BY coalesce(confidence, 0) DESC, address LIMIT 30")
def search_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    return search.by_confidence(view(spark, d, "kb"), 30).select("address", "confidence")


@query(ctes("kb") + r""", t AS (SELECT sha1(address || chr(0) || concat_ws(' | ', 'Function: ' || coalesce(nullif(new_name, ''), nullif(old_name, '')), 'Summary: ' || nullif(summary, '')) || chr(1)) AS h FROM kb WHERE coalesce(summary, '') <> ''),
r AS (SELECT h[1:3] AS r, sha1(string_agg(h, '' ORDER BY h)) AS h FROM t GROUP BY ALL) SELECT sha1(string_agg(h, '' ORDER BY r)) AS signature FROM r""")
def search_signature(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "kb").withColumn("interesting_behaviors", F.array().cast("array<string>"))
    return search.signature(rows)


REPLIES = r""", rp AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '{"suggested_name": "x", "confidence": 0.9}' ELSE
  concat('{"should_rename": ', CASE WHEN doc_id % 7 = 0 THEN 'false' WHEN doc_id % 29 = 0 THEN '"yes"' ELSE 'true' END,
  ', "suggested_name": "', CASE doc_id % 6 WHEN 0 THEN 'ParseHTTPHeader' WHEN 1 THEN 'helper' WHEN 2 THEN '9lives' WHEN 3 THEN 'abc' WHEN 4 THEN concat('Open-File ', source) ELSE '' END,
  '", "confidence": ', CAST(doc_id % 100 AS STRING), 'e-2, "risk": "', CASE WHEN doc_id % 5 = 0 THEN 'HIGH' ELSE 'low' END,
  '", "reason": "', CASE WHEN doc_id % 11 = 0 THEN 'short' ELSE 'reads the header of a file' END, '"}') END AS reply FROM {documents})"""
VALIDATED = r""", f AS (SELECT doc_id, json_extract_string(reply, '$.should_rename') AS sr, json_type(reply, '$.should_rename') AS st, TRY_CAST(json_extract_string(reply, '$.confidence') AS DOUBLE) AS c,
  lower(trim(coalesce(json_extract_string(reply, '$.risk'), ''))) AS risk, trim(coalesce(json_extract_string(reply, '$.reason'), '')) AS reason, trim(coalesce(json_extract_string(reply, '$.suggested_name'), '')) AS g, reply FROM rp),
n AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(g, '[\s\-.]+', '_', 'g'), '[^a-zA-Z0-9_]', '', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z\d])([A-Z])', '\1_\2', 'g')), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM f),
w AS (SELECT *, CASE WHEN st IS NULL THEN 'Missing required fields: reason, should_rename' WHEN st <> 'BOOLEAN' THEN 'should_rename must be a boolean' WHEN sr = 'false' THEN 'no rename needed'
  WHEN c IS NULL THEN 'confidence must be a number' WHEN c < 0.6 THEN 'confidence below threshold' WHEN risk = 'high' AND c < 0.7 THEN 'high risk below override' WHEN length(reason) < 8 THEN 'reason too short or missing'
  WHEN g = '' THEN 'suggested_name is empty' WHEN name = '' THEN 'name empty after sanitization' WHEN NOT regexp_matches(name, '^[a-z]') THEN 'name does not start with a letter'
  WHEN NOT regexp_matches(name, '^[a-z][a-z0-9_]{3,63}$') THEN 'name fails validation' WHEN name IN (VAGUE) THEN 'name too vague' END AS why FROM n)
SELECT doc_id, why IS NULL AS ok, coalesce(why, '') AS why, CASE WHEN why IS NULL THEN CASE WHEN c < 0.7 THEN 'maybe_' || name ELSE name END END AS name FROM w""".replace(
    "VAGUE", quoted(CONFIG["policy"]["vague_names"])
)


@query("WITH " + REPLIES[2:].replace("{documents}", "documents").replace(" AS STRING)", " AS VARCHAR)") + VALIDATED)
def decide_validate(spark: SparkSession, d: str) -> DataFrame:
    """The ladder of gates that a reply passes, with name normalisation."""
    view(spark, d, "documents").createOrReplaceTempView("tessera_documents")
    replies = spark.sql("WITH " + REPLIES[2:].replace("{documents}", "tessera_documents") + " SELECT * FROM rp")
    return validate.validate(replies, CONFIG).select("doc_id", "ok", "why", "name")


@query(ctes("functions", "kb") + """, pend AS (SELECT doc_id AS address, concat('fn_', CAST(doc_id % 60 AS VARCHAR), '_x') AS new_name, applied_name, doc_id AS seq FROM kb WHERE doc_id % 2 = 0),
a AS (SELECT p.*, f.name AS current, CASE WHEN f.name IS NULL THEN 'error' WHEN f.name = p.new_name THEN 'same'
  WHEN NOT (regexp_matches(f.name, '^(sub_|j_|nullsub_|locret_|loc_|maybe_|unknown_libname)') OR coalesce(applied_name = f.name, false)) THEN 'skip' ELSE 'apply' END AS action FROM pend p LEFT JOIN functions f USING (address)),
r AS (SELECT *, row_number() OVER (PARTITION BY new_name, action ORDER BY seq, address) AS k FROM a)
SELECT address, current, new_name, action, CASE WHEN action = 'same' THEN current WHEN action = 'apply' THEN CASE WHEN k = 1 THEN new_name WHEN k <= 10 THEN concat(new_name, '_', CAST(k AS VARCHAR)) ELSE concat(new_name, '_', lower(hex(address))) END END AS final_name FROM r""")
def decide_apply(spark: SparkSession, d: str) -> DataFrame:
    """Same name, policy, conflict, apply; suffixes for names that several rows propose."""
    rows = view(spark, d, "kb").where("doc_id % 2 = 0")
    pending = rows.selectExpr("doc_id AS address", "concat('fn_', doc_id % 60, '_x') AS new_name", "applied_name", "doc_id AS seq")
    return validate.apply_actions(pending, view(spark, d, "functions"), CONFIG)


@query(ctes("functions") + "SELECT address, name, regexp_matches(name, '^(sub_|j_|nullsub_|locret_|loc_)') AS auto, starts_with(name, 'sub_') AS candidate FROM functions")
def decide_name_predicates(spark: SparkSession, d: str) -> DataFrame:
    n = view(spark, d, "functions")
    return n.select("address", "name", validate.is_auto_named(F.col("name"), CONFIG).alias("auto"), validate.is_candidate(F.col("name"), CONFIG).alias("candidate"))


@query(ctes("kb", "edges") + r""", sp AS (SELECT * FROM kb WHERE status = 'approved' AND trim(coalesce(new_name, '')) <> '' AND (NOT starts_with(new_name, 'wrapper_') OR regexp_matches(new_name, '_\d+$'))),
b AS (SELECT new_name, body_hash, count(*) AS same FROM sp GROUP BY ALL), n AS (SELECT new_name, count(*) AS total FROM sp GROUP BY ALL)
SELECT sp.address, sp.new_name, total - same AS others FROM sp JOIN b ON b.new_name = sp.new_name AND b.body_hash IS NOT DISTINCT FROM sp.body_hash JOIN n ON n.new_name = sp.new_name WHERE total - same BETWEEN 1 AND 3""")
def repair_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return repair.duplicates(view(spark, d, "kb"))


@query(ctes("kb", "edges") + r""", sp AS (SELECT * FROM kb WHERE status = 'approved' AND trim(coalesce(new_name, '')) <> '' AND (NOT starts_with(new_name, 'wrapper_') OR regexp_matches(new_name, '_\d+$'))),
e AS (SELECT concat('0x', hex(caller)) AS caller, concat('0x', hex(caller + 300)) AS callee FROM edges)
SELECT DISTINCT sp.address, sp.new_name, 'collision' AS defect FROM sp JOIN e ON e.caller = sp.address JOIN kb c ON c.address = e.callee WHERE trim(coalesce(nullif(c.new_name, ''), c.old_name)) = sp.new_name""")
def repair_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Names that equal a callee's, or that describe themselves."""
    e = view(spark, d, "edges")
    keyed = e.select(text.hex_address(F.col("caller")).alias("caller"), text.hex_address(F.col("caller") + 300).alias("callee"))
    return repair.conflicts(view(spark, d, "kb"), keyed)


@query(ctes("kb", "functions", "edges") + """, s AS (SELECT k.*, CASE lower(coalesce(risk, '')) WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS rank,
  coalesce(nullif(new_name, ''), nullif(old_name, ''), k.address) AS shown, f.address IS NOT NULL AND f.address NOT IN (SELECT callee FROM edges) AS entry
  FROM kb k LEFT JOIN functions f ON k.address = concat('0x', hex(f.address)) WHERE analyzed AND status = 'approved')
SELECT count_if(entry AND security_relevant) AS n_entries, count_if(security_relevant) AS n_security, count_if(NOT security_relevant) AS n_other,
  md5(string_agg(concat('- ', shown, ' [risk=', coalesce(nullif(risk, ''), '?'), ']: ', coalesce(summary, '')), chr(10) ORDER BY rank, address) FILTER (WHERE security_relevant)) AS security_md5 FROM s""")
def report_capabilities(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "kb")
    nodes = scan.degrees(view(spark, d, "functions"), view(spark, d, "edges"))
    c = report.capability_context(rows, nodes)
    block = F.regexp_extract("context", r"(?s)=== SECURITY-RELEVANT FUNCTIONS \(\d+\) ===\n(.*)\n\n=== OTHER", 1)
    return c.select("n_entries", "n_security", "n_other", F.md5(block).alias("security_md5"))


@query(NODES + r"""SELECT address, concat_ws(chr(10), CASE WHEN len(sinks) > 0 THEN '  Calls memory/allocation primitive(s): ' || array_to_string(sinks, ', ') END,
  CASE WHEN input_reachable THEN '  Reachable from an external input source' END,
  CASE WHEN caller_count = 0 THEN '  No callers and not referenced as data' ELSE concat('  Called from ', caller_count, ' direct call site(s)',
    CASE WHEN caller_count <= 3 THEN ' (few — likely a distinct code path, not shared utility)' WHEN caller_count >= 20 THEN ' (many — likely shared utility/glue)' ELSE '' END, '.') END) AS signals FROM nodes""")
def report_signals(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = base_nodes(spark, d)
    return report.signal_lines(nodes)


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '//[^\n]*', '', 'g') AS x FROM documents),
b AS (SELECT doc_id, CASE WHEN contains(x, '{') THEN regexp_replace(x, '^[^{]*\{[^\n]*\n?', '') ELSE x END AS x FROM t),
p AS (SELECT doc_id, regexp_extract_all(x, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|[^"'']+|["'']') AS parts FROM b),
n AS (SELECT doc_id, array_to_string(list_transform(parts, lambda s: CASE WHEN length(s) > 1 AND s[1] IN ('"', chr(39)) THEN s ELSE
  regexp_replace(regexp_replace(regexp_replace(s, '\b(?:sub|loc|locret|off|byte|word|dword|qword|unk)_[0-9A-Fa-f]+\b', 'ADDR', 'g'), '\b0[xX][0-9A-Fa-f]+\b', 'NUM', 'g'),
    '(^|[^0-9A-Za-z_.])[0-9]+[uUlL]{0,3}\b', '\1NUM', 'g') END), '') AS x FROM p)
SELECT doc_id, sha256(x)[1:16] AS body_hash, len(list_filter(string_split(x, chr(10)), lambda l: trim(l, ' ') NOT IN ('', '{', '}'))) >= 8 AS hashable FROM n""")
def text_body_hash(spark: SparkSession, d: str) -> DataFrame:
    """Normalisation and hash of bodies."""
    normal = text.normalize_code(F.col("text"))
    return view(spark, d, "documents").select("doc_id", text.body_hash(normal).alias("body_hash"), text.is_hashable(normal).alias("hashable"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_type || p_brand || ' ' || p_name, '[\s\-.]+', '_', 'g'), '[^a-zA-Z0-9_]', '', 'g'), '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z\d])([A-Z])', '\1_\2', 'g')), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS snake,
  regexp_replace(p_name || '_' || p_size, '_\d+$', '') AS dedup_key, format('{} (confidence score: {:.2f})', p_name, p_size / 100.0) AS comment FROM part""")
def text_names(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "part")
    return p.select(
        "p_partkey", text.snake_case(F.concat("p_type", "p_brand", F.lit(" "), "p_name")).alias("snake"),
        text.dedup_key(F.concat_ws("_", "p_name", F.col("p_size").cast("string"))).alias("dedup_key"),
        text.score_comment(F.col("p_name"), F.col("p_size") / 100.0).alias("comment"),
    )


@query("""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents)
SELECT doc_id, CASE WHEN len(ls) > 5 THEN concat(array_to_string(ls[1:5], chr(10)), chr(10), '// ... [', len(ls) - 5, ' more lines truncated]') ELSE text END AS text, len(ls) > 5 AS truncated FROM t""")
def text_trim_lines(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "documents").select("doc_id", text.trim_lines(F.col("text"), 5).alias("t")).select("doc_id", "t.*")


@query("""SELECT event_id, CASE WHEN floor(event_id * 100 / 2.86) + 2048 <= 8192 THEN 8192 WHEN floor(event_id * 100 / 2.86) + 2048 <= 16384 THEN 16384 WHEN floor(event_id * 100 / 2.86) + 2048 <= 32768 THEN 32768
  WHEN floor(event_id * 100 / 2.86) + 2048 <= 65536 THEN 65536 ELSE 131072 END AS num_ctx, CASE WHEN value < 90 THEN concat(CAST(floor(value) AS BIGINT), 's') WHEN value < 5400 THEN format('{:.0f} min', value / 60) ELSE format('{:.1f} hours', value / 3600) END AS took FROM events""")
def bits_context_size(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "events")
    return e.select("event_id", bits.context_size(F.col("event_id") * 100).alias("num_ctx"), text.duration(F.col("value")).alias("took"))


@query("""WITH v AS (SELECT o_orderkey, (3221225472 + o_orderkey * 4099) % 4294967296 AS v FROM orders)
SELECT o_orderkey, CASE WHEN v >> 30 IN (2, 3) AND (v >> 16) & 4095 BETWEEN 1 AND 255 AND v & 65535 <> 0 THEN printf('NTSTATUS %s (facility 0x%X, code 0x%04X)', CASE WHEN v >> 30 = 3 THEN 'error' ELSE 'warning' END, (v >> 16) & 4095, v & 65535) END AS status
FROM v WHERE (v >> 16) & 4095 > 0""")
def bits_status(spark: SparkSession, d: str) -> DataFrame:
    v = view(spark, d, "orders").select("o_orderkey", ((F.lit(3221225472) + F.col("o_orderkey") * 4099) % 4294967296).alias("v"))
    return v.where(F.shiftright("v", 16).bitwiseAND(F.lit(4095)) > 0).select("o_orderkey", bits.decode_status(F.col("v")).alias("status"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN props WHEN event_id % 5 = 1 THEN concat('```json', chr(10), props, chr(10), '```') WHEN event_id % 5 = 2 THEN '{broken' ELSE props END AS c, props FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 5 = 2 THEN 'LLM response is not valid JSON' END AS error FROM r""")
def payload_parse(spark: SparkSession, d: str) -> DataFrame:
    """JSON replies with and without fences; broken ones give an error."""
    e = view(spark, d, "events")
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    c = F.when(F.col("event_id") % 5 == 1, fenced).when(F.col("event_id") % 5 == 2, "{broken").otherwise(F.col("props"))
    return e.select("event_id", payload.parse_reply(c).alias("p")).select("event_id", F.try_variant_get("p.value", "$.k", "long").alias("k"), "p.error")


@query("""SELECT l_orderkey, bool_or(l_tax > 0.04) AS meaningful_diff_found, bool_or(l_returnflag = 'R') AS security_relevant, CASE max(CASE l_linenumber % 3 WHEN 2 THEN 2 WHEN 1 THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk FROM lineitem GROUP BY l_orderkey""")
def payload_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Any, any, highest risk over a list of differences."""
    l = view(spark, d, "lineitem")  # noqa: E741
    risk = F.when(F.col("l_linenumber") % 3 == 2, "high").when(F.col("l_linenumber") % 3 == 1, "medium").otherwise("low")
    one = F.struct((F.col("l_tax") > 0.04).alias("meaningful"), F.lit("s").alias("summary"), (F.col("l_returnflag") == "R").alias("security_relevant"), risk.alias("risk"), F.lit("").alias("explanation"))
    lists = l.groupBy("l_orderkey").agg(F.collect_list(one).alias("d"))
    return lists.select("l_orderkey", payload.rolled_up(F.col("d")).alias("r")).select("l_orderkey", "r.meaningful_diff_found", "r.security_relevant", "r.risk")


@query("""WITH b AS (SELECT o_orderkey // 200 AS b, min(CASE WHEN o_orderkey // 200 % 10 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END) AS first_seen FROM orders GROUP BY ALL)
SELECT 'sha' || b AS sha256, concat('10.0.', CASE WHEN b % 2 = 0 THEN '26100' ELSE '19041' END, '.', b) AS version, first_seen, row_number() OVER (ORDER BY first_seen NULLS LAST, 'sha' || b) AS place FROM b WHERE b % 3 <> 1 AND b % 2 = 0""")
def source_build_index(spark: SparkSession, d: str) -> DataFrame:
    """Two-level maps of builds, one JSON text a file, flattened, filtered, earliest release first, undated last."""
    out = files.list_builds(build_files(spark, d), 34404, "26100")
    return places(out, F.asc_nulls_last("first_seen"), "sha256").select("sha256", "version", "first_seen", "place")


def build_files(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "orders").withColumn("b", F.expr("o_orderkey div 200"))
    kbs = F.map_from_entries(
        F.collect_list(F.struct(F.col("o_orderkey").cast("string"), F.struct(F.struct(F.when(F.col("b") % 10 != 3, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("releaseDate")).alias("updateInfo"))))
    )
    entry = o.groupBy("b").agg(kbs.alias("k")).select(
        F.expr("b div 20").alias("file"),
        F.concat(F.lit("sha"), "b").alias("sha"),
        F.struct(
            F.struct(
                F.when(F.col("b") % 3 == 1, 332).otherwise(34404).alias("machineType"),
                F.concat(F.lit("10.0."), F.when(F.col("b") % 2 == 0, "26100").otherwise("19041"), F.lit("."), "b").alias("version"),
                F.col("b").alias("timestamp"), (F.col("b") * 4096).alias("virtualSize"), F.col("b").alias("size"),
            ).alias("fileInfo"),
            F.map_from_arrays(F.array(F.lit("w")), F.array("k")).alias("windowsVersions"),
        ).alias("e"),
    )
    texts = entry.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("sha", "e")))).alias("j"))
    return texts.select("file", F.from_json("j", schema.BUILD_INDEX).alias("entries"))


@query("""WITH b AS (SELECT o_orderkey // 200 AS b, min(CASE WHEN o_orderkey // 200 % 10 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END) AS first_seen FROM orders GROUP BY ALL),
r AS (SELECT 'sha' || b AS sha256, first_seen, row_number() OVER (ORDER BY first_seen DESC, 'sha' || b DESC) AS k FROM b WHERE b % 3 <> 1 AND first_seen IS NOT NULL)
SELECT sha256, first_seen, CASE k WHEN 1 THEN 'new' ELSE 'old' END AS side FROM r WHERE k <= 2""")
def source_newest_pair(spark: SparkSession, d: str) -> DataFrame:
    """The two newest dated builds."""
    return files.newest_pair(files.list_builds(build_files(spark, d), 34404)).select("sha256", "first_seen", "side")


@query("""WITH b AS (SELECT DISTINCT o_orderkey // 200 AS b FROM orders), v AS (SELECT 'sha' || b AS sha256, concat('10.0.', CASE WHEN b % 2 = 0 THEN '26100' ELSE '19041' END, '.', b) AS version FROM b WHERE b % 3 <> 1),
a AS (SELECT unnest(['26100.2', '19041.5', '10.0.19041.11', 'none']) AS text)
SELECT text, count(sha256) AS matches, CASE WHEN count(sha256) = 1 THEN min(sha256) END AS sha256 FROM a LEFT JOIN v ON contains(version, text) GROUP BY text""")
def source_by_version(spark: SparkSession, d: str) -> DataFrame:
    """Builds by part of their version, where only one has it."""
    asked = spark.createDataFrame([("26100.2",), ("19041.5",), ("10.0.19041.11",), ("none",)], "text string")
    return files.by_version(files.list_builds(build_files(spark, d), 34404), asked)


@query(ctes("functions", "kb", "edges") + """, c AS (SELECT f.address, f.name FROM functions f WHERE starts_with(name, 'sub_') AND concat('0x', hex(f.address)) NOT IN (SELECT address FROM kb WHERE analyzed))
SELECT address, name, row_number() OVER (ORDER BY address) AS place FROM c ORDER BY address LIMIT 25""")
def plan_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that are not analysed yet, in a given order, up to a limit."""
    f = view(spark, d, "functions")
    ordered = f.select("address", F.col("address").alias("place"))
    return pipeline.build_plan(f, ordered, view(spark, d, "kb"), CONFIG, limit=25)


@query("""WITH r AS (SELECT doc_id AS place, CASE WHEN length(text) < 200 THEN 'body too short' END AS rejection FROM documents),
c AS (SELECT *, sum(CASE WHEN rejection IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY place) AS calls FROM r)
SELECT place, rejection, calls FROM c WHERE calls < 100 OR (calls = 100 AND rejection IS NULL)""")
def plan_budget(spark: SparkSession, d: str) -> DataFrame:
    """A limit that counts calls, not cheap rejections."""
    docs = view(spark, d, "documents").select(F.col("doc_id").alias("place"), F.when(F.length("text") < 200, "body too short").alias("rejection"))
    return pipeline.budgeted(docs, 100)


@query("""SELECT date_trunc('hour', ts) AS hour, event_type AS status, count(*) AS n FROM events GROUP BY ALL""")
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """The stream operator, run over the log as a whole."""
    log = view(spark, d, "events").select("ts", F.col("event_type").alias("status"))
    return audit.windowed_counts(log).select(F.col("window.start").alias("hour"), "status", "n")


@query(NODES + """, t AS (SELECT *, row_number() OVER (ORDER BY total DESC, address) AS place FROM scored), f AS (SELECT * FROM t WHERE place <= 40)
SELECT place, f.address, concat('  0x', rpad(hex(f.address), 12, ' '), ' ', rpad(coalesce(nullif(k.new_name, ''), k.old_name, f.name)[1:34], 34, ' '), ' ', printf('%5.1f', total), '  callers=',
  rpad(CAST(caller_count AS VARCHAR), 5, ' '), ' bb=', rpad(CAST(basic_block_count AS VARCHAR), 4, ' '), ' ', concat_ws(' ', CASE WHEN input_reachable THEN 'INPUT' END, CASE WHEN len(sinks) > 0 THEN concat('SINK:', array_to_string(sinks[1:3], ',')) END),
  CASE WHEN k.security_relevant THEN ' [SEC]' ELSE '' END, CASE WHEN trim(coalesce(k.summary, '')) <> '' THEN concat(chr(10), repeat(' ', 17), trim(k.summary)) ELSE '' END) AS line
FROM f LEFT JOIN kb k ON k.address = concat('0x', hex(f.address))""")
def view_list(spark: SparkSession, d: str) -> DataFrame:
    """The best-scored functions as lines, under the knowledge base's names."""
    nodes, _, s = scores(spark, d)
    best = places(score.top(s, 60).select("address", "total"), F.desc("total"), "address")
    return views.listed(nodes, view(spark, d, "kb"), s, best)


@query(NODES + """, hits AS (SELECT address, name, CASE WHEN contains(lower(name), 'ing') THEN 'name'
  WHEN len(list_filter(string_refs, lambda s: contains(lower(s), 'ing'))) > 0 THEN 'string'
  WHEN len(list_filter(import_refs, lambda s: contains(lower(s), 'ing'))) > 0 THEN 'import' END AS kind FROM nodes),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY address) AS k FROM hits WHERE kind IS NOT NULL)
SELECT kind, address, name, count(*) OVER () AS total FROM r WHERE k <= 40""")
def view_find(spark: SparkSession, d: str) -> DataFrame:
    """Matches by kind with their number."""
    return views.found(base_nodes(spark, d)[0], "ing")


@query(NODES + """, c AS (SELECT * FROM nodes WHERE starts_with(name, 'main_')), sh AS (SELECT f.address, coalesce(nullif(k.new_name, ''), k.old_name, f.name) AS shown FROM functions f LEFT JOIN kb k ON k.address = concat('0x', hex(f.address)))
SELECT c.address, sh.shown AS shown_name, c.size_bytes, c.basic_block_count, c.caller_count, c.input_reachable, c.sinks AS dangerous_sink_calls, c.import_refs[1:10] AS imports,
  list_transform(c.string_refs[1:8], lambda s: s[1:70]) AS strings, k.status, k.summary, coalesce(k.security_relevant, false) AS security_relevant,
  (SELECT count(*) FROM edges e WHERE e.callee = c.address) AS n_callers,
  coalesce((SELECT list(s.shown ORDER BY e.caller)[1:15] FROM edges e JOIN sh s ON s.address = e.caller WHERE e.callee = c.address), []) AS callers,
  (SELECT count(*) FROM edges e WHERE e.caller = c.address) AS n_callees,
  coalesce((SELECT list(s.shown ORDER BY e.callee)[1:15] FROM edges e JOIN sh s ON s.address = e.callee WHERE e.caller = c.address), []) AS callees
FROM c JOIN sh USING (address) LEFT JOIN kb k ON k.address = concat('0x', hex(c.address))""")
def view_explore(spark: SparkSession, d: str) -> DataFrame:
    """A function with its neighbours and what is known of it."""
    nodes, calls = base_nodes(spark, d)
    chosen = nodes.where("startswith(name, 'main_')").select("address")
    return views.explore(nodes, calls, view(spark, d, "kb"), chosen)


@query(ctes("kb") + """, r AS (SELECT *, row_number() OVER (ORDER BY coalesce(confidence, 0) DESC, address) AS k FROM kb WHERE analyzed)
SELECT address, concat('  #', lpad(CAST(k AS VARCHAR), 3, ' '), '  ', rpad(address, 14, ' '), ' ', rpad(coalesce(nullif(new_name, ''), nullif(old_name, ''), '?'), 40, ' '), ' conf=', printf('%.2f', coalesce(confidence, 0)),
  CASE WHEN security_relevant THEN ' [SECURITY]' ELSE '' END, CASE WHEN coalesce(summary, '') <> '' THEN concat(chr(10), repeat(' ', 9), summary) ELSE '' END) AS line FROM r WHERE k <= 30""")
def view_hits(spark: SparkSession, d: str) -> DataFrame:
    """Search results as they are shown."""
    ranked = places(search.by_confidence(view(spark, d, "kb"), 30), F.desc(F.coalesce("confidence", F.lit(0.0))), "address")
    return ranked.select("address", views.hit_line(F.col("place")).alias("line"))


@query(ctes("functions", "kb") + """, pend AS (SELECT *, doc_id AS a FROM kb WHERE status = 'approved' AND NOT coalesce(applied, false) AND coalesce(new_name, '') <> '' AND coalesce(confidence, 0) >= 0.6),
t AS (SELECT p.*, f.name AS current, CASE WHEN f.name IS NULL THEN 'error' WHEN f.name = p.new_name THEN 'same'
  WHEN NOT (regexp_matches(f.name, '^(sub_|j_|nullsub_|locret_|loc_|maybe_|unknown_libname)') OR coalesce(applied_name = f.name, false)) THEN 'skip' ELSE 'apply' END AS action FROM pend p LEFT JOIN functions f ON f.address = p.a)
SELECT count_if(action IN ('apply', 'same')) AS applied, count_if(action = 'skip') AS skipped, count_if(action = 'error') AS errors, 0 AS renamed_in_dry_run FROM t""")
def decide_apply_all(spark: SparkSession, d: str) -> DataFrame:
    """Approved names against those shown now: counts, and a dry run that changes nothing."""
    rows, live = view(spark, d, "kb"), view(spark, d, "functions").select("address", "name")
    wet, dry = apply.apply(rows, live, CONFIG), apply.apply(rows, live, CONFIG, dry_run=True)
    changed = dry["names"].join(live.withColumnRenamed("name", "was"), "address").agg(F.count_if(F.col("name") != F.col("was")).cast("int").alias("renamed_in_dry_run"))
    return wet["counts"].join(F.broadcast(changed))


@query(ctes("kb", "edges") + """, e AS (SELECT concat('0x', hex(caller)) AS caller, concat('0x', hex(callee)) AS callee FROM edges),
c AS (SELECT * FROM kb WHERE analyzed AND NOT refined AND status = 'approved' AND (confidence IS NULL OR confidence < 0.7 OR starts_with(new_name, 'wrapper_'))),
o AS (SELECT c.address, CASE WHEN NOT EXISTS (SELECT 1 FROM e JOIN kb k ON k.address = e.caller WHERE e.callee = c.address AND k.analyzed AND k.summary IS NOT NULL) THEN 'no analyzed caller'
  WHEN length(c.address) % 3 = 0 THEN 'error' WHEN risk = 'high' THEN 'updated' ELSE 'no change' END AS outcome FROM c)
SELECT k.address, o.outcome, CASE WHEN o.outcome = 'updated' THEN 'better_name' ELSE k.new_name END AS new_name, CASE WHEN o.outcome IS NULL OR o.outcome = 'error' THEN k.refined ELSE true END AS refined,
  CASE WHEN o.outcome = 'updated' THEN 0.95 ELSE k.confidence END AS confidence FROM kb k LEFT JOIN o USING (address)""")
def refine_pass(spark: SparkSession, d: str) -> DataFrame:
    """A pass over uncertain rows with a stand-in for the model: some calls fail, some change nothing."""
    rows, e = view(spark, d, "kb"), view(spark, d, "edges")
    keyed = e.select(text.hex_address(F.col("caller")).alias("caller"), text.hex_address(F.col("callee")).alias("callee"))
    facts = rows.select("address").limit(0).selectExpr(
        "address", "'' AS live_name", "false AS trivial", "false AS return_blind", "CAST(array() AS array<string>) AS dangerous_sink_calls", "false AS input_reachable", "CAST(map() AS map<string,string>) AS call_sites"
    )
    high = rows.where("risk = 'high'").select("address", F.lit(True).alias("high"))

    def ask(requests: DataFrame) -> DataFrame:
        better = F.lit('{"changed": true, "suggested_name": "better_name", "confidence": 0.95}')
        reply = F.when(F.length("address") % 3 == 0, None).when(F.col("high"), better).otherwise('{"changed": false}')
        return requests.join(high, "address", "left").select("address", reply.alias("reply"))

    after, outcomes = refine.refine(rows, keyed, facts, ask, CONFIG)
    return after.join(outcomes, "address", "left").select("address", "outcome", "new_name", "refined", "confidence")


@query("""WITH p AS (SELECT doc_id AS id, length(text) >= 3000 AS big, doc_id % 5 AS k FROM documents WHERE text IS NOT NULL)
SELECT id, CASE WHEN k = 4 THEN 0 WHEN NOT big OR k = 3 THEN 1 WHEN k = 2 THEN 3 ELSE 2 END AS samples, big AND k NOT IN (3, 4) AS checked, CASE WHEN big AND k NOT IN (3, 4) THEN k <> 2 END AS agreed,
  big AND k = 2 AS flagged, CASE WHEN k = 4 THEN NULL WHEN big AND k = 2 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN k = 4 OR (k = 3 AND big) THEN 'network' END AS error FROM p""")
def diff_samples(spark: SparkSession, d: str) -> DataFrame:
    """Large prompts are asked twice; drafts that disagree are reconciled; failures leave what there is."""
    docs = view(spark, d, "documents").where("text IS NOT NULL")
    empty = F.array().cast("array<struct<name:string,relation:string,summary:string>>")
    chars = F.length(F.concat(F.lit("Function: "), F.lit("f"), F.lit("\n"), F.lit("\n=== OLD (pre-patch) ===\n"), F.lit("\n\n=== PATCHED (post-patch) ===\n"), F.lit("\n\nWhat differs in logic, if anything?\n")))
    fixed = spark.range(1).select(chars).first()[0]
    c = settings.merged(CONFIG, {"diff": {"self_consistency_min_prompt_chars": 3000 + fixed}})
    pairs = docs.select(F.col("doc_id").alias("id"), F.lit("f").alias("name"), F.col("text").alias("old_code"), F.lit("").alias("new_code"), empty.alias("related"))
    low, high = '{"differences": [{"summary": "s", "risk": "low"}]}', '{"differences": [{"summary": "s", "risk": "high"}]}'

    def ask(r: DataFrame) -> DataFrame:
        k = F.col("id") % 5
        bad = (k == 4) | ((k == 3) & (F.col("sample") == 2))
        reply = F.when(bad, None).when((k == 2) & (F.col("sample") == 2), high).otherwise(low)
        return r.select("id", reply.alias("reply"), F.when(bad, "network").alias("error"))

    third = lambda r: r.select("id", F.lit('{"differences": [{"summary": "s", "risk": "medium"}]}').alias("reply"), F.lit(None).cast("string").alias("error"))
    out = diff.compare(pairs, ask, third, c)
    return out.select("id", "samples", "checked", "agreed", "flagged", F.col("verdict.risk").alias("risk"), "error")


@query("""WITH b AS (SELECT doc_id AS id, length(coalesce(text, '')) AS n FROM documents),
c AS (SELECT *, CASE WHEN floor(n / 2.86) + 2048 <= 8192 THEN 8192 WHEN floor(n / 2.86) + 2048 <= 16384 THEN 16384 WHEN floor(n / 2.86) + 2048 <= 32768 THEN 32768 WHEN floor(n / 2.86) + 2048 <= 65536 THEN 65536 ELSE 131072 END AS ctx FROM b)
SELECT id, CASE WHEN id % 3 = 1 OR (id % 3 = 0 AND n > 50000) THEN NULL ELSE '{}' END AS reply, CASE WHEN id % 3 = 1 THEN 'network' WHEN id % 3 = 0 AND n > 50000 THEN 'LLM response is not valid JSON' END AS error,
  CASE WHEN id % 3 = 0 AND (ctx = 8192 OR n > 50000) THEN least(ctx * 2, 131072) ELSE ctx END AS num_ctx, n AS prompt_chars FROM c""")
def payload_call_sized(spark: SparkSession, d: str) -> DataFrame:
    """Replies that are cut off are asked for again at the next context size."""

    def call(q: DataFrame) -> DataFrame:
        cut = (F.col("id") % 3 == 0) & ((F.col("num_ctx") == 8192) | (F.length("prompt") > 50000))
        content = F.when(F.col("id") % 3 == 1, None).when(cut, "{").otherwise("{}")
        return q.select("id", content.alias("content"), F.when(F.col("id") % 3 == 1, "network").alias("error"))

    return payload.call_sized(view(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("prompt")), call)


@query("""SELECT p_name AS name, true AS changed FROM part ORDER BY CASE WHEN p_partkey % 2 = 0 THEN p_size / 1000 ELSE p_size END DESC, p_name DESC LIMIT 1""")
def payload_resolve_model(spark: SparkSession, d: str) -> DataFrame:
    """The largest model there is, where the wanted one is not."""
    size = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "M").otherwise("b"))
    models = view(spark, d, "part").select(F.col("p_name").alias("name"), size.alias("parameter_size"), F.lit(0).alias("size"))
    return payload.resolve_model(models, "\u0001none")
