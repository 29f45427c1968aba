"""Callees before callers: levels, strongly connected components, and the exact order
of a priority queue for one program."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import counted, settle
from ..plans.ranks import places
from .graph import SENT_ROWS


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(address, level): 0 for leaves, else one more than the highest callee; null for
    nodes in or above a cycle. Each round places nodes all of whose callees are placed."""
    known = nodes.select("address")
    calls = settle(edges.join(known.withColumnRenamed("address", "callee"), "callee", "left_semi").select("caller", "callee"), "calls")
    waits = calls.groupBy(F.col("caller").alias("address")).agg(F.count("*").alias("open"))
    ready = F.col("open") == 0
    # Rows that wait, with how many calls are open, and those that have just become ready.
    state, n = counted(known.join(waits, "address", "left").select("address", F.coalesce("open", F.lit(0)).alias("open")), "state", ready)
    done, level = state.where(ready).select("address", F.lit(0).alias("level")), 0
    while n:
        level += 1
        now = state.where(ready).select(F.col("address").alias("callee"))
        closed = calls.join(F.broadcast(now) if n <= SENT_ROWS else now, "callee").groupBy(F.col("caller").alias("address")).agg(F.count("*").alias("closed"))
        left = state.where(~ready).join(closed, "address", "left")
        state, n = counted(left.select("address", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open")), "state", ready)
        done = done.union(state.where(ready).select("address", F.lit(level).alias("level")))
        if level % 8 == 0:
            done = settle(done, "done")
    return done.union(state.where(~ready).select("address", F.lit(None).cast("int").alias("level")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Strongly connected components (address, component = its smallest member).

    Rounds of colouring: each node takes the smallest node that reaches it; within a
    colour, what reaches the colour's own node back is a component and leaves."""
    left = settle(nodes.select("address").distinct(), "left")
    calls = settle(edges.where("caller <> callee").select("caller", "callee").distinct(), "calls")
    out = None
    while not left.isEmpty():
        ends = left.select("address")
        calls = settle(
            calls.join(ends.withColumnRenamed("address", "caller"), "caller", "left_semi").join(
                ends.withColumnRenamed("address", "callee"), "callee", "left_semi"
            ),
            "calls",
        )
        colour = settle(left.select("address", F.col("address").alias("colour")), "colour")
        while True:
            pushed = calls.join(colour.withColumnRenamed("address", "caller"), "caller").groupBy(F.col("callee").alias("address")).agg(F.min("colour").alias("c"))
            moved = F.coalesce(F.col("c") < F.col("colour"), F.lit(False)).alias("moved")
            new = colour.join(pushed, "address", "left").select("address", F.least("colour", F.coalesce("c", "colour")).alias("colour"), moved)
            new, n = counted(new, "colour", F.col("moved"))
            colour = new.drop("moved")
            if not n:
                break
        same = (
            calls.join(colour.toDF("caller", "c1"), "caller")
            .join(colour.toDF("callee", "c2"), "callee")
            .where("c1 = c2")
            .select(F.col("callee").alias("from"), F.col("caller").alias("to"))
        )
        same = settle(same, "same")
        member = settle(colour.where("address = colour"), "member")
        frontier = member
        while True:
            step = frontier.join(same, frontier["address"] == same["from"]).select(F.col("to").alias("address"), "colour").distinct()
            frontier, n = counted(step.join(member.select("address"), "address", "left_anti"), "frontier")
            if not n:
                break
            member = settle(member.union(frontier.select("address", "colour")), "member")
        found = member.select("address", F.col("colour").alias("component"))
        out = found if out is None else out.union(found)
        left = settle(left.join(found.select("address"), "address", "left_anti"), "left")
    return out if out is not None else nodes.select("address", F.col("address").alias("component"))


def worklist(nodes: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(address, level, component, place): by level, then best score first. Nodes in or
    above cycles follow, by the level of their component among those."""
    placed = settle(levels(nodes, edges), "levels")
    cyclic = placed.where("level IS NULL").select("address")
    inner = edges.join(cyclic.withColumnRenamed("address", "caller"), "caller", "left_semi").join(
        cyclic.withColumnRenamed("address", "callee"), "callee", "left_semi"
    )
    comp = settle(components(cyclic, inner), "components")
    between = (
        inner.join(comp.toDF("caller", "a"), "caller")
        .join(comp.toDF("callee", "b"), "callee")
        .where("a <> b")
        .select(F.col("a").alias("caller"), F.col("b").alias("callee"))
        .distinct()
    )
    upper = levels(comp.select(F.col("component").alias("address")).distinct(), between).toDF("component", "upper")
    rows = (
        placed.join(comp, "address", "left")
        .join(upper, "component", "left")
        .join(scores.select("address", "total"), "address")
        .select("address", "level", "component", "upper", "total")
    )
    order = (F.asc_nulls_last("level"), F.asc_nulls_first("upper"), F.asc_nulls_first("component"), F.desc("total"), F.asc("address"))
    return places(rows, *order).select("address", "level", "component", "total", "place")


def exact_worklist(nodes: DataFrame, edges: DataFrame, scores: DataFrame, program: str = "program") -> DataFrame:
    """The order of a queue that always takes the best-scored ready function, for each
    program on its own; functions in or above cycles get no place. All three tables have
    the column program; a program's graph fits in one task."""
    rows = nodes.select(program, "address").join(scores.select(program, "address", "total"), [program, "address"])
    calls = edges.groupBy(program, F.col("caller").alias("address")).agg(F.collect_set("callee").alias("callees"))
    packed = rows.join(calls, [program, "address"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = set(pdf["address"])
        total = dict(zip(pdf["address"], pdf["total"]))
        waits: dict[int, int] = {}
        callers: dict[int, list[int]] = defaultdict(list)
        for a, cs in zip(pdf["address"], pdf["callees"]):
            inside = [c for c in (cs if cs is not None else ()) if c in known]
            waits[a] = len(inside)
            for c in inside:
                callers[c].append(a)
        ready = [(-total[a], a) for a, n in waits.items() if not n]
        heapq.heapify(ready)
        order = []
        while ready:
            _, a = heapq.heappop(ready)
            order.append(a)
            for c in callers[a]:
                waits[c] -= 1
                if not waits[c]:
                    heapq.heappush(ready, (-total[c], c))
        return pd.DataFrame({program: pdf[program].iloc[0], "address": order, "place": range(1, len(order) + 1)})

    kind = dict(nodes.dtypes)[program]
    return packed.groupBy(program).applyInPandas(run, f"{program} {kind}, address long, place long")
