"""Graph, order, matching, repair and stream operators against plain versions."""

import heapq
import random

from pyspark.sql import functions as F

from tessera import config as settings
from tessera.operators import graph, kb, match, order, repair
from tessera.plans import pipeline
from tessera.streaming import audit


def random_graph(n, m, seed):
    r = random.Random(seed)
    return sorted({(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b})


def frames(spark, n, edges):
    nodes = spark.createDataFrame([(i, f"f{i}") for i in range(n)], "address long, name string")
    return nodes, spark.createDataFrame(edges, "caller long, callee long")


def test_components_and_levels(spark):
    n, edges = 30, random_graph(30, 40, 1)
    nodes, e = frames(spark, n, edges)
    reach = {i: {i} for i in range(n)}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    want = {i: min(j for j in reach[i] if i in reach[j]) for i in range(n)}
    assert {r.address: r.component for r in order.components(nodes, e).collect()} == want
    place = {r.address: r.place for r in order.worklist(nodes, e, nodes.withColumn("total", F.lit(0.0))).collect()}
    assert sorted(place.values()) == list(range(1, n + 1))
    assert all(place[b] < place[a] for a, b in edges if want[a] != want[b])


def test_exact_worklist(spark):
    edges = [(a, b) for a, b in random_graph(25, 30, 2) if a > b]
    nodes, e = frames(spark, 25, edges)
    score = {i: (i * 7) % 5 for i in range(25)}
    waits = {i: sum(a == i for a, _ in edges) for i in range(25)}
    ready = [(-score[i], i) for i in range(25) if not waits[i]]
    heapq.heapify(ready)
    want = []
    while ready:
        _, x = heapq.heappop(ready)
        want.append(x)
        for a, b in edges:
            if b == x:
                waits[a] -= 1
                if not waits[a]:
                    heapq.heappush(ready, (-score[a], a))
    p = F.lit(1).alias("program")
    s = nodes.select(p, "address", ((F.col("address") * 7) % 5).cast("double").alias("total"))
    got = order.exact_worklist(nodes.select(p, "address"), e.select(p, "caller", "callee"), s).orderBy("place").collect()
    assert [r.address for r in got] == want


def test_depths(spark):
    nodes, e = frames(spark, 5, [(0, 1), (1, 2), (3, 4), (4, 3)])
    assert {r.address: r.depth for r in graph.depth_from_leaves(nodes, e).collect()} == {0: 2, 1: 1, 2: 0, 3: 0, 4: 0}


def test_structural_pairs_are_greedy(spark):
    r = random.Random(3)
    make = lambda base: [(base + i, f"sub_{i}", r.randrange(50, 90), r.randrange(3, 9), r.randrange(3), [], [1]) for i in range(12)]
    ddl = "address long, name string, size_bytes int, basic_block_count int, caller_count int, named_callees array<string>, constants array<int>"
    a, b = make(0), make(100)
    close = lambda x, y: 1 - abs(x - y) / max(x, y, 1)
    scored = sorted(((0.35 * close(x[2], y[2]) + 0.25 * close(x[3], y[3]) + 0.30 * 1.0 + 0.10 * close(x[4], y[4]), x[0], y[0]) for x in a for y in b), reverse=True)
    want, used = set(), set()
    for s, x, y in scored:
        if s > 0.5 and x not in used and y not in used:
            want.add((x, y))
            used |= {x, y}
    got = match.pair_by_structure(spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl))
    assert {(r.old_address, r.new_address) for r in got.collect()} == want


def test_repair_stops(spark):
    rows = spark.createDataFrame(
        [("0x1", "a", "a", "", "", "approved", "h1"), ("0x2", "a", "a", "", "", "approved", "h2")],
        "address string, new_name string, old_name string, summary string, reason string, status string, body_hash string",
    )
    edges = spark.createDataFrame([], "caller string, callee string")
    fix = lambda d: d.where("address = '0x2'").select("address", F.lit("b").alias("new_name"))
    out, n = repair.repair(rows, edges, fix)
    assert n == 1 and {r.address: r.new_name for r in out.collect()} == {"0x1": "a", "0x2": "b"}
    same, n = repair.repair(rows, edges, lambda d: d.select("address", "new_name"))
    assert n == 0


def test_self_reference(spark):
    rows = spark.createDataFrame(
        [("0x1", "copy_x", "o", "it forwards to copy_x.", "", "approved"), ("0x2", "wrapper_y", "o", "forwards to wrapper_y", "", "approved")],
        "address string, new_name string, old_name string, summary string, reason string, status string",
    )
    got = repair.conflicts(rows, spark.createDataFrame([], "caller string, callee string")).collect()
    assert [(r.address, r.defect) for r in got] == [("0x1", "self-reference")]


def test_upsert_resets_applied(spark):
    ddl = "address string, new_name string, confidence double, status string, applied boolean, applied_name string"
    now = spark.createDataFrame([("0x1", "a", 0.5, "approved", True, "a"), ("0x2", "b", 0.5, "approved", True, "b")], ddl)
    log = spark.createDataFrame([("0x1", "c", 0.6, "approved", 1), ("0x2", "d", 0.5, "approved", 1), ("0x3", "e", 0.1, "approved", 1)], "address string, new_name string, confidence double, status string, seq long")
    got = {r.address: (r.new_name, r.applied, r.applied_name) for r in kb.upsert(now, log).collect()}
    assert got == {"0x1": ("c", False, "a"), "0x2": ("d", True, "b"), "0x3": ("e", None, None)}


def test_error_leaves_row_eligible(spark):
    rows = spark.createDataFrame([], "address string, old_name string, new_name string, confidence double, summary string, status string, rejection_reason string, analyzed boolean, applied boolean, applied_name string")
    ctx = spark.createDataFrame([("0x1", "sub_1", "a\nb\nc\nd"), ("0x2", "sub_2", "a\nb\nc\nd"), ("0x3", "sub_3", "")], "address string, old_name string, code string")
    good = '{"should_rename": true, "suggested_name": "read_file_header", "confidence": 0.9, "reason": "reads the header"}'
    analyze = lambda d: d.select("address", F.when(F.col("address") == "0x1", good).alias("reply"))
    got = {r.address: (r.status, r.new_name) for r in pipeline.run_level(ctx, rows, analyze, settings.load(), 1).collect()}
    assert got == {"0x1": ("approved", "read_file_header"), "0x3": ("rejected", None)}


def test_stream(spark, tmp_path):
    log, target = tmp_path / "log", tmp_path / "kb"
    ddl = "address string, new_name string, confidence double, status string, seq long"
    base = spark.createDataFrame([("0x1", "a", 0.1, "approved", True, "a")], "address string, new_name string, confidence double, status string, applied boolean, applied_name string")
    base.write.parquet(f"{target}/v=0")
    spark.createDataFrame([("0x1", "b", 0.9, "approved", 5)], ddl).coalesce(1).write.mode("append").json(str(log))
    audit.maintain(audit.decisions(spark, str(log), ddl), str(target), str(tmp_path / "cp")).awaitTermination()
    assert [(r.new_name, r.applied) for r in audit.current(spark, str(target), 1).collect()] == [("b", False)]
