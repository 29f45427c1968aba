"""Prompts, refinement inputs, stored tables, lookups: against plain versions on small cases."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera import config as settings
from tessera import schema
from tessera.functions import bits, payload, text
from tessera.operators import context, diff, graph, kb, match, order, prompts, repair, report, scan, search, validate
from tessera.plans import apply, lineage, pipeline, ranks
from tessera.sources import files
from tessera.streaming import audit

CONFIG = settings.load()
ROW = "address string, new_name string, old_name string, applied_name string, summary string, confidence double, security_relevant boolean, analyzed boolean, body_hash string, status string"


def test_ranks(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(20) or None, r.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a int, v long").repartition(5)
    want = sorted(rows, key=lambda x: (x[1] is None, x[1] or 0, x[0]))
    got = ranks.places(df, F.asc_nulls_last("a"), "id").collect()
    assert {x.id: x.place for x in got} == {x[0]: k + 1 for k, x in enumerate(want)}
    sums, total = {}, 0
    for x in want:
        total += x[2]
        sums[x[0]] = total
    assert {x.id: x.total for x in ranks.running(df, F.col("v"), F.asc_nulls_last("a"), "id").collect()} == sums
    assert ranks.places(df.limit(0), "id").count() == 0


def test_shared_folder_is_deleted_with_the_application(spark):
    assert lineage.own_folder(spark).startswith(lineage.shared_folder(spark))
    assert lineage.settle(spark.range(3)).count() == 3


def test_substitutions_and_labels(spark):
    rows = [
        ("0x1", "open_file", "sub_1", None, "s", 0.9, True, True, "h", "approved"),
        ("0x2", "get_record", "sub_2", "get_record_4", "s", 0.9, False, True, "h", "approved"),
        ("0x3", "parse_it", "sub_3", "maybe_parse", None, 0.2, False, True, "h", "approved"),
        ("0x4", None, "sub_4", None, "s", 0.9, False, True, "h", "rejected"),
    ]
    df = spark.createDataFrame(rows, ROW).agg(F.sort_array(F.collect_list(F.struct("address", "new_name", "old_name", "applied_name", "summary", "confidence", "security_relevant"))).alias("r"))
    live = F.create_map(F.lit("0x1"), F.lit("sub_1"), F.lit("0x2"), F.lit("get_record_4"), F.lit("0x4"), F.lit("sub_4"))
    got = df.select(text.live_substitutions(F.col("r"), live).alias("m"), live.alias("live"), "r")
    row = got.select("m", F.transform("r", lambda x: text.display_label(x, F.col("live"), F.col("m"))).alias("l")).first()
    # An applied descriptive name stays; without a live name, all earlier provisional ones count.
    assert row.m == {"sub_1": "open_file", "sub_3": "parse_it", "maybe_parse": "parse_it"}
    assert row.l == ["open_file", "get_record_4", "parse_it", "sub_4"]
    lines = df.select(prompts.neighbour_lines(F.col("r"), F.array(F.lit("sub_1"), F.lit("x"), F.lit("y")), live, 0.6, 1).alias("l")).first().l
    assert lines == [
        "open_file [security-relevant] — s", "get_record_4 — s", "parse_it  [LOW CONFIDENCE 0.20] (no summary)", "sub_4 — s", "x  (not yet analyzed)",
    ]


def test_context_and_prompt(spark):
    functions = spark.createDataFrame([(1, "sub_1"), (2, "sub_2"), (3, "main")], "address long, name string")
    code = "int sub_1(int a)\n{\n  sub_2(a, 0x73666C43);\n  return 0;\n}\n// does x (confidence score: 0.90)"
    sources = {
        "bodies": spark.createDataFrame([(1, code)], "address long, code string"),
        "types": spark.createDataFrame([(1, "NTSTATUS f(PIRP)")], "address long, signature string"),
        "comments": spark.createDataFrame([(1, "by hand"), (1, "does x (confidence score: 0.90)")], "address long, comment string"),
        "xrefs": spark.createDataFrame([(1, 10, 2, True), (3, 5, 1, True), (1, 12, 100, True), (1, 11, 200, False), (1, 13, 201, False)], "caller long, item long, target long, is_code boolean"),
        "imports": spark.createDataFrame([(100, "m", None, 7)], "address long, module string, name string, ordinal long"),
        "strings": spark.createDataFrame([(200, "plain"), (201, "CLog::Read")], "address long, value string"),
        "data_refs": spark.createDataFrame([(1, ".rdata", "init"), (2, ".pdata", "x")], "target long, section string, referrer string"),
    }
    got = context.extracted(functions, sources, CONFIG)
    assert got.columns == context.FIELDS and got.count() == 3
    one = got.where("address = '0x1'").first()
    assert one.strings == ["CLog::Read", "plain"] and one.imported_apis == ["ord_7"] and one.callee_addr_names == {"0x2": "sub_2"}
    assert one.callers == ["main"] and one.indirectly_referenced and one.comments == ["by hand"] and "confidence score" not in one.pseudocode
    rows = spark.createDataFrame([("0x2", "open_file", "sub_2", None, "opens", 0.9, True, True, "h", "approved"), ("0x1", None, "sub_1", None, None, None, False, False, "h", None)], ROW)
    edges = spark.createDataFrame([("0x1", "0x2"), ("0x3", "0x1")], "caller string, callee string")
    signals = spark.createDataFrame([("0x1", "  Called from 1 direct call site(s).")], "address string, signals string")
    prompt = prompts.user_prompt(context.contexts(got, rows, edges, signals), CONFIG).where("address = '0x1'").first().prompt
    order_of = ["Current name     : sub_1", "Prototype", "IDA type", "CLog::Read", "'plain'", "ord_7", "Called from 1", "Structural family", "open_file [security-relevant] — opens", "main  (not yet analyzed)", "by hand", "open_file(a, 0x73666C43 /* 'Clfs' */);", "JSON only"]
    at = [prompt.index(x) for x in order_of]
    assert at == sorted(at)


def test_refine_prompt(spark):
    ddl = (
        "address string, new_name string, old_name string, live_name string, summary string, confidence double, dangerous_sink_calls array<string>, input_reachable boolean,"
        " family_members array<struct<address:string,new_name:string,old_name:string,summary:string>>, family_size int,"
        " callers array<struct<name:string,confidence:double,summary:string,call_site:string>>, callees array<struct<name:string,summary:string>>, trivial boolean, return_blind boolean"
    )
    callers = [(f"c{i}", 0.5, "s", f"x = wrapper_x_8({i});") for i in range(5)]
    rows = [("0x1", "wrapper_x", "sub_1", "wrapper_x_8", None, 0.4, ["memcpy"], True, [], 0, callers, [("inner", "does it")], True, False)]
    rows.append(("0x2", "parse", "sub_2", "parse", "s", 0.4, [], False, [], 0, callers, [], False, False))
    got = {r.address: r.prompt for r in prompts.refine_prompt(spark.createDataFrame(rows, ddl)).collect()}
    assert got["0x1"].startswith("Function : wrapper_x_8") and got["0x1"].count("Call site of wrapper_x_8") == 3 and "Calls memory/allocation primitive(s): memcpy" in got["0x1"]
    assert "'wrapper_x_8', 'wrapper_x'" in got["0x1"] and "inner: does it" in got["0x1"]
    assert "Call site" not in got["0x2"].split("summary is background")[1] and got["0x2"].startswith("Function : parse")


def test_return_blind(spark):
    f = spark.createDataFrame([(1, "get_hash", "int get_hash(int)"), (2, "put", "void put(int)"), (3, "id", "int id(int)")], "address long, name string, prototype string")
    bodies = spark.createDataFrame([(9, "a\nif ( get_hash(x) == 3 )\n  id(x);\nif ( put(x) == 1 )")], "address long, code string")
    edges = spark.createDataFrame([(9, 1), (9, 2), (9, 3)], "caller long, callee long")
    assert [r.address for r in context.return_blind(f, bodies, edges).collect()] == [1]
    many = spark.createDataFrame([(i, 1) for i in range(9)], "caller long, callee long")
    assert sorted(r.caller for r in context.first_callers(many).collect()) == [0, 1, 2, 3, 4]


def test_versions_meta_index(spark, tmp_path):
    p = f"file://{tmp_path}"
    assert files.read_version(spark, f"{p}/t") is None and files.index_size(spark, f"{p}/i") == 0 and files.stored_signature(spark, f"{p}/i") is None
    assert files.write_version(spark.range(2), f"{p}/t") == 1 and files.write_version(spark.range(5), f"{p}/t") == 2
    (tmp_path / "t" / "v=3").mkdir()  # a writer that died
    assert files.read_version(spark, f"{p}/t").count() == 5 and files.read_version(spark, f"{p}/t", 1).count() == 2
    meta = spark.createDataFrame([("a", "1")], files.META)
    meta = files.set_meta(meta, spark.createDataFrame([("a", "2"), ("seconds_per_call", "1.5")], files.META))
    assert files.get_meta(meta, "a") == "2" and files.get_meta(meta, "b", "d") == "d" and files.seconds_per_call(meta) == 1.5
    assert files.seconds_per_call(meta.where("key = 'a'")) is None
    rows = spark.createDataFrame([("0x1", "n", "o", "s", ["b"]), ("0x2", "n", "o", "", [])], "address string, new_name string, old_name string, summary string, interesting_behaviors array<string>")
    index = search.build_index(rows, lambda ts: [[1.0, float(len(t))] for t in ts])
    now = search.signature(rows)
    files.save_index(index, now, f"{p}/i")
    assert files.index_size(spark, f"{p}/i") == 1 and not search.stale(now, files.stored_signature(spark, f"{p}/i"))
    changed = search.signature(rows.withColumn("summary", F.concat("summary", F.lit("x"))))
    assert search.stale(changed, files.stored_signature(spark, f"{p}/i")) and search.stale(now, None)
    nodes, edges = spark.createDataFrame([(1, "a")], "address long, name string"), spark.createDataFrame([(1, 1)], "caller long, callee long")
    files.save_graph(nodes, edges, f"{p}/g")
    assert [x.count() for x in files.load_graph(spark, f"{p}/g")] == [1, 1] and files.load_graph(spark, f"{p}/none") is None


def test_files(spark, tmp_path):
    p = f"file://{tmp_path}"
    node = dict(name="f", size_bytes=1, basic_block_count=2, caller_count=0, callee_addresses=[5], dangerous_sink_calls=[], input_reachable=False, string_refs=["x"], import_refs=[], constant_operands=[1])
    (tmp_path / "g.json").write_text(json.dumps({"nodes": {"3": node, "5": node}, "edges": [[3, 5]]}))
    nodes, edges = files.load_graph_json(spark, f"{p}/g.json")
    assert sorted(r.address for r in nodes.collect()) == [3, 5] and [tuple(r) for r in edges.collect()] == [(3, 5)] and nodes.where("name = 'f'").count() == 2
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for rebuild, n in ((False, 1), (False, 1), (True, 2)):
        assert files.load_or_build(spark, f"{p}/built", build, rebuild).count() == 3 and len(calls) == n
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"address": "0x1", "phase": "p"}\nnot json\n{"address": "0x2"}\n')
    assert sorted(r.address for r in files.load_log(spark, f"{p}/log").collect()) == ["0x1", "0x2"]
    assert files.load_log(spark, f"{p}/nothing").count() == 0
    files.append_log(spark.createDataFrame([("0x3",)], "address string"), f"{p}/log")
    assert files.load_log(spark, f"{p}/log").count() == 3
    files.write_text(spark.createDataFrame([("# a\nb",)], "t string"), "t", f"{p}/report")
    assert spark.read.text(f"{p}/report").count() == 2
    named = files.rename_cached(spark.createDataFrame([(1, "a"), (2, "b")], "address long, name string"), spark.createDataFrame([(2, "c")], "address long, new_name string"))
    assert {r.address: r.name for r in named.collect()} == {1: "a", 2: "c"}
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "x.bin").write_bytes(b"abc")
    good = spark.createDataFrame([("x.bin", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")], "name string, sha256 string")
    assert files.verified(spark, f"{p}/bin", good).count() == 1 and files.verified(spark, f"{p}/bin", good.withColumn("sha256", F.lit("0"))).count() == 0
    names = spark.createDataFrame([("b.exe",), ("a.sys",), ("b.i64",), ("c.i64",), ("a.sys.i64",), ("readme.txt",)], "name string")
    assert [(r.part, r.name) for r in files.batch_targets(names).collect()] == [(0, "a.sys"), (0, "b.exe"), (1, "c.i64")]
    index = {"ab": {"fileInfo": {"machineType": 34404, "version": "10.0.1", "timestamp": 1, "virtualSize": 2, "size": 3}, "windowsVersions": {}}}
    import gzip

    (tmp_path / "i.json.gz").write_bytes(gzip.compress(json.dumps(index).encode()))
    assert [r.sha256 for r in files.list_builds(files.read_build_index(spark, f"{p}/i.json.gz"), 34404).collect()] == ["ab"]
    with pytest.raises(FileNotFoundError):
        prompts.load_prompt(str(tmp_path), "none.md")
    (tmp_path / "p.md").write_text("ask")
    assert prompts.load_prompt(str(tmp_path), "p.md") == "ask"
    got = spark.createDataFrame([("a",), ("z",), (None,)], "p string").select(prompts.prompt_of_profile(F.col("p"), {"a": "A", "b": "B"}, "b").alias("x")).collect()
    assert [r.x for r in got] == ["A", "B", "B"]
    (tmp_path / "c.json").write_text('{"kb": {"repair_max_rounds": 9}}')
    assert settings.load(str(tmp_path / "c.json"))["kb"]["repair_max_rounds"] == 9 and settings.load("/none") == settings.load()
    assert settings.load(str(tmp_path / "c.json"))["kb"]["duplicate_name_max_group_size"] == 3


def test_scope_lookup_and_plan(spark):
    nodes = spark.createDataFrame([(16, "sub_10", 8), (64, "main", 4), (70000, "sub_far", 100)], "address long, name string, size_bytes int")
    asked = spark.createDataFrame([(1, "0x12"), (2, "main"), (3, "0x40"), (4, "0x30"), (5, "none"), (6, "0x11184"), (7, "0x5")], "place int, target string")
    found, missed = apply.functions_by_name(nodes, asked)
    assert sorted((r.place, r.address) for r in found.collect()) == [(1, 16), (2, 64), (6, 70000)]
    assert sorted(r.target for r in missed.collect()) == ["0x30", "0x5", "none"]
    edges = spark.createDataFrame([(64, 16)], "caller long, callee long")
    scored = nodes.withColumn("total", F.lit(1.0))
    for kw, want, forced in (({"names": ["main"]}, [16, 64], True), ({"top": 1}, [16], False), ({}, [16, 70000], False)):
        addresses, must, label = apply.resolve_scope(nodes, edges, scored, CONFIG, **kw)
        assert sorted(r.address for r in addresses.collect()) == want and (must is not None) == forced and label
    rows = spark.createDataFrame([("0x10", True), ("0x40", True)], "address string, analyzed boolean")
    place = nodes.select("address", F.col("address").alias("place"))
    assert [r.address for r in pipeline.build_plan(nodes, place, rows, CONFIG).orderBy("place").collect()] == [70000]
    plan = pipeline.build_plan(nodes, place, rows, CONFIG, forced=nodes.where("name = 'main'").select("address"))
    assert [r.address for r in plan.orderBy("place").collect()] == [64, 70000]
    assert pipeline.estimate(plan, 100.0).first().text == "3 min"


def test_resolve_graph(spark, tmp_path):
    p, build = f"file://{tmp_path}/g", lambda: spark.range(3)
    assert apply.resolve_graph(spark, p, build, targeted=True)[0] is None
    nodes, note = apply.resolve_graph(spark, p, build, live=3)
    assert nodes.count() == 3 and note == ""
    assert "stale" in apply.resolve_graph(spark, p, build, live=4, targeted=True)[1]


def test_related_and_single(spark):
    related = spark.createDataFrame([(1, 2, "b", "calls"), (1, 2, "b", "calls"), (1, 3, "c", "called_by")], "address long, other long, other_name string, relation string")
    said = spark.createDataFrame([(2, "opens " + "x" * 200)], "address long, summary string")
    got = diff.with_summaries(related, said).select(diff.note_of(F.col("related"), CONFIG).alias("n")).first().n
    assert got.count("\n  - ") == 2 and "Calls b (also changed in this patch): opens" in got and "..." in got and "Is called by c (also changed in this patch).\n" in got
    f = spark.createDataFrame([(1, "new", "f", "code", []), (2, "moved", "g", "code", []), (3, "removed", "h", "code", [])], "id int, situation string, name string, code string, related array<struct<name:string,relation:string,summary:string>>")
    ask = lambda r: r.select("id", F.when(F.col("id") == 1, '{"summary": "s", "risk": "high"}').alias("reply"), F.when(F.col("id") == 3, "network").alias("error"))
    out = {r.id: r for r in diff.summarize(f, ask, CONFIG).collect()}
    assert (out[1].summary, out[1].risk, out[1].security_relevant) == ("s", "high", False) and out[2].error and out[3].error == "network" and out[3].summary is None


def test_progress_is_saved_once_a_batch(spark, tmp_path):
    for _ in range(2):
        diff.save_progress(spark.range(3), f"file://{tmp_path}/d", 0)
    diff.save_progress(spark.range(2), f"file://{tmp_path}/d", 1)
    assert spark.read.parquet(f"file://{tmp_path}/d").count() == 5


def test_payload_pieces(spark):
    raw = spark.createDataFrame([("a", '["x", " "]', 1), ("b", "broken", None)], "address string, interesting_behaviors string, analyzed int")
    got = {r.address: (r.interesting_behaviors, r.analyzed) for r in payload.decoded(raw).collect()}
    assert got == {"a": (["x", " "], True), "b": ([], False)}
    b = spark.createDataFrame([(["a ", "", " ", "b", "c", "d", "e", "f"],)], "x array<string>").select(payload.behaviors(F.col("x")).alias("y")).first().y
    assert b == ["a", "b", "c", "d", "e"]
    reply = "struct<suggested_name:string,summary:string,confidence:string,security_relevant:string,changed:string,no_change:string>"
    cases = [('{"changed": true}', True), ('{"changed": false}', False), ('{"no_change": false}', True), ('{"no_change": true}', False), ('{"suggested_name": "new", "no_change": true}', True), ('{"suggested_name": "cur"}', False), ("{}", False)]
    df = spark.createDataFrame([(c, w) for c, w in cases], "r string, w boolean")
    assert df.select(F.coalesce(payload.response_changed(F.from_json("r", reply), F.lit("cur")), F.lit(False)).alias("g"), "w").where("g <> w").count() == 0
    merged = spark.createDataFrame([('{"suggested_name": " ", "confidence": "0.9"}',)], "r string").select(
        payload.refined(F.from_json("r", reply), F.struct(F.lit("n").alias("new_name"), F.lit("s").alias("summary"), F.lit(0.5).alias("confidence"), F.lit(True).alias("security_relevant"))).alias("m")
    ).first().m
    assert (merged.new_name, merged.summary, merged.confidence, merged.security_relevant) == ("n", "s", 0.9, True)
    truncated = spark.createDataFrame([("LLM response is not valid JSON",), ("network",), ("Model returned only reasoning",)], "e string").select(payload.is_truncation(F.col("e")).alias("t"))
    assert [r.t for r in truncated.collect()] == [True, False, True]
    v = lambda m, s, r: F.struct(F.lit(m).alias("meaningful_diff_found"), F.lit(s).alias("security_relevant"), F.lit(r).alias("risk"))
    got = spark.range(1).select(payload.drafts_agree(v(True, False, "low"), v(True, False, "low")).alias("a"), payload.drafts_agree(v(True, False, "low"), v(True, False, "high")).alias("b")).first()
    assert got.a and not got.b


def test_text_pieces(spark):
    one = lambda c: spark.range(1).select(c.alias("y")).first().y
    assert one(text.display_name(F.lit("?f@@"), F.lit("Cls::f(int)"))) == "Cls::f" and one(text.display_name(F.lit("r"), F.lit("a::operator()(int)"))) == "a::operator()"
    assert one(text.display_name(F.lit("raw"), F.lit(None).cast("string"))) == "raw"
    assert one(text.method_names(F.array(*map(F.lit, ("A::b", "x", " A::b ", "1::c"))))) == ["A::b"]
    assert one(text.methods_first(F.array(*map(F.lit, ("x", "A::b", "y"))))) == ["A::b", "x", "y"]
    assert one(text.first_word(F.lit("10.0.1 (x)"))) == "10.0.1" and one(text.symbol_path(F.lit("a.sys"), F.lit(0x1F), F.lit(0xAB00))) == "a.sys/0000001Fab00/a.sys"
    assert one(text.billions(F.lit("25.8B"), F.lit(0))) == 25.8 and one(text.billions(F.lit("671M"), F.lit(0))) == 0.671 and one(text.billions(F.lit(""), F.lit(2e9))) == 2.0
    assert one(text.is_trivial(F.lit("a\n{\n// c\nb\n}"))) and not one(text.is_trivial(F.lit("\n".join(f"l{i}" for i in range(9)))))
    assert one(text.is_own_comment(F.lit("does x (confidence score: 0.90) "))) and not one(text.is_own_comment(F.lit("plain")))
    assert one(text.duration(F.lit(89.9))) == "89s" and one(text.duration(F.lit(600))) == "10 min" and one(text.duration(F.lit(7200))) == "2.0 hours"
    assert one(bits.annotate(F.lit("x = 0XC0000022u; y = 0x123; z = 12345678LL; w = 0x00000001"))) == "x = 0XC0000022u /* STATUS_ACCESS_DENIED */; y = 0x123; z = 12345678LL; w = 0x00000001"


def test_reports(spark):
    ddl = "ordinal int, error string, situation string, meaningful_diff_found boolean, security_relevant boolean, risk string, old_name string, new_name string, summary string"
    rows = [(0, None, None, True, False, "low", "f", "f", "s"), (1, "e", None, True, True, "low", "x", "x", ""), (2, None, "new", False, False, None, None, "g", ""), (3, None, None, False, False, "low", "h", "h", ""), (4, None, None, False, True, "high", "a", "b", "")]
    got = report.diff_context(spark.createDataFrame(rows, ddl)).first()
    assert got.n == 3 and got.context == "=== REPORTABLE CHANGES (3) ===\n- [DIFF risk=low] f\n    summary: s\n- [NEW risk=?] (NEW) g\n- [SECURITY risk=high] a / b\n"
    known = spark.createDataFrame([("0x1", 2, "b", 0.9, True, "s"), ("0x1", 1, "a", None, False, "")], "address string, place int, shown string, confidence double, security_relevant boolean, summary string")
    assert report.neighbour_lines(known, 0.6).first().lines == "  a  [LOW CONFIDENCE 0.00] (no summary)\n  b [security-relevant] — s"
    args = spark.createDataFrame([(1, "memcpy", 3, "n"), (1, "memcpy", 1, "n"), (1, "memcpy", 2, "k")], "function int, sink string, arg_no int, variable string")
    params = spark.createDataFrame([(1, "n")], "function int, variable string")
    assert [tuple(r) for r in scan.tainted_arguments(args, params).collect()] == [(1, "memcpy", [1, 3])]
    refs = spark.createDataFrame([(1, ".pdata", "x"), (2, ".rdata", "y"), (2, ".data", "y"), (2, ".data", None)], "target int, section string, referrer string")
    assert [(r.target, r.code_referrers) for r in scan.indirect(refs).collect()] == [(2, ["y"])]
    e = spark.createDataFrame([(1, 2)], "caller long, callee long")
    assert kb.add_edges(e, e.union(spark.createDataFrame([(2, 3)], "caller long, callee long"))).count() == 2
    assert [r.address for r in kb.all_rows(spark.createDataFrame([("0x2",), ("0x10",)], "address string")).collect()] == ["0x10", "0x2"]


def test_cheap_rejection(spark):
    got = spark.createDataFrame([(None,), (" ",), ("a\nb",), ("a\nb\nc",)], "c string").select(validate.cheap_rejection(F.col("c"), CONFIG).alias("r")).collect()
    assert [r.r for r in got] == ["no pseudocode", "no pseudocode", "body too short", None]
    assert repair.DELEGATES and schema.KB


def test_stream_windows_drop_late_rows(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    ddl = "ts timestamp, status string"
    src = spark.createDataFrame([(at(1), "a"), (at(1, 30), "a"), (at(9), "b")], ddl)
    src.coalesce(1).write.json(f"file://{tmp_path}/in/1")
    query = lambda: audit.windowed_counts(spark.readStream.schema(ddl).option("recursiveFileLookup", "true").json(f"file://{tmp_path}/in")).writeStream.outputMode("append").option(
        "checkpointLocation", f"file://{tmp_path}/cp"
    ).trigger(availableNow=True).format("parquet").option("path", f"file://{tmp_path}/out").start()
    query().awaitTermination()
    late = spark.createDataFrame([(at(1, 45), "a"), (at(12), "c"), (at(20), "d")], ddl)
    late.coalesce(1).write.json(f"file://{tmp_path}/in/2")
    query().awaitTermination()
    got = sorted((r.window.start.hour, r.status, r.n) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [(1, "a", 2), (9, "b", 1), (12, "c", 1)]


def brute_pairs(old, new):
    """Names first, in the old side's order, then the most alike of the rest."""
    named = lambda x: not x[1].startswith("sub_")
    close = lambda a, b: 1 - abs(a - b) / max(a, b, 1)

    def score(x, y):
        a, b = set(x[5]), set(y[5])
        j = 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / len(a | b)
        return 0.35 * close(x[2], y[2]) + 0.25 * close(x[3], y[3]) + 0.30 * j + 0.10 * close(x[4], y[4])

    out, taken = {}, set()
    for x in sorted(old):
        free = [y for y in sorted(new) if named(x) and y[1] == x[1] and y[0] not in taken]
        if free:
            y = max(free, key=lambda y: score(x, y))
            alone = len(free) == 1
            out[x[0]] = (y[0], "name" if alone else "name+structural-disambig", 1.0 if alone else 0.9)
            taken.add(y[0])
    rest = sorted(((score(x, y), x[0], y[0]) for x in old for y in new if not named(x) and not named(y)), reverse=True)
    for s, x, y in rest:
        if s > 0.5 and x not in out and y not in taken:
            out[x] = (y, "structural", s)
            taken.add(y)
    return out


def test_pairs_of_two_versions(spark):
    r = random.Random(8)

    def side(base):
        return [
            (base + i, r.choice([f"sub_{base + i}", f"name_{i}", f"dup_{i % 4}"]), r.randrange(40, 90), r.randrange(3, 9), r.randrange(4), sorted(r.sample(["a", "b", "c"], r.randrange(3))), [r.randrange(3)])
            for i in range(40)
        ]

    ddl = "address long, name string, size_bytes int, basic_block_count int, caller_count int, named_callees array<string>, constants array<int>"
    old, new = side(0), side(1000)
    want = brute_pairs(old, new)
    a, b = spark.createDataFrame(old, ddl), spark.createDataFrame(new, ddl)
    pairs = match.pair(a, b)
    got = {x.old_address: (x.new_address, x.method, x.confidence) for x in pairs.collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(abs(got[k][2] - want[k][2]) < 1e-9 for k in want)
    alone = {(x.situation, x.address) for x in match.new_and_removed(a, b, pairs).collect()}
    taken = {v[0] for v in want.values()}
    assert alone == {("removed", x[0]) for x in old if not x[1].startswith("sub_") and x[0] not in want} | {("new", y[0]) for y in new if not y[1].startswith("sub_") and y[0] not in taken}
    calls = spark.createDataFrame([(0, 1), (1, 2), (1000, 1001)], "caller long, callee long")
    whole = diff.pair_all(a.drop("named_callees"), b.drop("named_callees"), calls, calls)
    assert whole["pairs"].count() == whole["pairs"].select("old_address").distinct().count() and set(whole) == {"pairs", "new", "removed", "noise", "old_related", "new_related"}


def test_worklist_order(spark):
    r = random.Random(4)
    edges = sorted({(a, b) for a, b in ((r.randrange(24), r.randrange(24)) for _ in range(30)) if a != b})
    score = {i: float(r.randrange(6)) for i in range(24)}
    nodes = spark.createDataFrame([(i,) for i in range(24)], "address long")
    totals = spark.createDataFrame(list(score.items()), "address long, total double")
    callees = {i: {b for a, b in edges if a == i} for i in range(24)}
    level = {}
    while True:
        ready = {i: 1 + max((level[c] for c in callees[i]), default=-1) for i in range(24) if i not in level and callees[i] <= set(level)}
        if not ready:
            break
        level.update(ready)
    got = order.worklist(nodes, spark.createDataFrame(edges, "caller long, callee long"), totals).orderBy("place").collect()
    assert {x.address: x.level for x in got if x.level is not None} == level
    first = sorted(level, key=lambda i: (level[i], -score[i], i))
    assert [x.address for x in got][: len(first)] == first
    rest = [x.address for x in got][len(first) :]
    reach = {i: {i} for i in range(24)}
    for _ in range(24):
        for a, b in edges:
            reach[a] |= reach[b]
    same = lambda a, b: b in reach[a] and a in reach[b]
    assert all(rest.index(b) < rest.index(a) for a, b in edges if a in rest and b in rest and not same(a, b))
    for i, x in enumerate(rest[:-1]):
        if same(x, rest[i + 1]):
            assert (-score[x], x) < (-score[rest[i + 1]], rest[i + 1])
    assert graph.reachable(spark.createDataFrame(edges, "caller long, callee long"), nodes.limit(1)).count() >= 1
