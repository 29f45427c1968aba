"""The engine's entities as views over the test tables, in SQL that Spark and DuckDB share.

nodes: customers; xrefs: what orders and lineitems point at; kb: documents with their
labels; old/new versions of a build: parts; log: events. {name} stands for a table or
another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

VIEWS = {
    "functions": """
SELECT c_custkey AS address,
  CASE WHEN c_custkey % 5 IN (0, 1) THEN concat('sub_', CAST(c_custkey AS STRING))
    WHEN c_custkey % 97 = 2 THEN concat('main_', lower(c_mktsegment))
    WHEN c_custkey % 31 = 3 THEN concat('j_', lower(c_mktsegment))
    ELSE concat(lower(c_mktsegment), '_', CAST(c_custkey AS STRING)) END AS name,
  CAST(c_custkey * 37 % 900 + 16 AS INT) AS size_bytes,
  CAST(c_custkey * 31 % 45 AS INT) AS basic_block_count
FROM {customer}""",
    "imports": """
SELECT 1000000000 + s_suppkey AS address,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('mod', CAST(s_nationkey AS STRING)) END AS module,
  CASE s_suppkey % 13 WHEN 0 THEN 'memcpy' WHEN 1 THEN 'recv' WHEN 2 THEN 'fread' WHEN 3 THEN 'malloc'
    WHEN 4 THEN CAST(NULL AS STRING) ELSE concat('Api', CAST(s_suppkey % 40 AS STRING)) END AS name,
  s_suppkey AS ordinal
FROM {supplier}""",
    "strings": """
SELECT 2000000000 + p_partkey AS address,
  CASE WHEN p_partkey % 11 = 0 THEN concat('C', p_brand, '::', p_type) WHEN p_partkey % 50 = 0 THEN ' x '
    ELSE p_name END AS value
FROM {part}""",
    "xrefs": """
SELECT o_custkey AS caller, o_orderkey * 10 AS item,
  (o_orderkey * 7919 + 13) % (SELECT count(*) FROM {customer}) AS target, true AS is_code
FROM {orders} WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
UNION ALL
SELECT o.o_custkey, l.l_orderkey * 10 + l.l_linenumber, 1000000000 + l.l_suppkey, true
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE l.l_linenumber = 1 AND l.l_quantity < 20
UNION ALL
SELECT o.o_custkey, l.l_orderkey * 10 + l.l_linenumber, 2000000000 + l.l_partkey, false
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE l.l_linenumber = 2""",
    "operands": """
SELECT o.o_custkey AS caller, l.l_orderkey * 10 + l.l_linenumber AS item,
  CASE WHEN l.l_partkey % 7 = 0 THEN CAST(18446744073709551616 AS DECIMAL(20, 0)) - CAST(l.l_partkey AS DECIMAL(20, 0))
    ELSE CAST(l.l_partkey % 400 AS DECIMAL(20, 0)) END AS value,
  l.l_suppkey % 10 = 0 AS is_offset
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey WHERE l.l_linenumber = 3""",
    "edges": """
SELECT DISTINCT x.caller, x.target AS callee FROM {xrefs} x JOIN {functions} f ON x.target = f.address
WHERE x.caller <> x.target AND x.is_code""",
    "kb": """
SELECT concat('0x', hex(d.doc_id)) AS address, concat('sub_', hex(d.doc_id)) AS old_name,
  CASE WHEN d.doc_id % 9 = 0 THEN CAST(NULL AS STRING)
    WHEN d.doc_id % 9 = 1 THEN concat('wrapper_', d.lang)
    WHEN d.doc_id % 9 = 2 THEN concat('parse_', d.lang, '_', CAST(d.doc_id % 5 AS STRING))
    ELSE concat(d.source, '_fn_', CAST(d.doc_id % 300 AS STRING)) END AS new_name,
  CASE WHEN d.doc_id % 23 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(d.doc_id * 37 % 101 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN d.doc_id % 17 = 0 THEN '' WHEN d.doc_id % 19 = 0 THEN CAST(NULL AS STRING)
    ELSE concat('Document of ', CAST(length(d.text) AS STRING), ' characters') END AS summary,
  coalesce(l.toxic = 1, d.doc_id % 12 = 0) AS security_relevant,
  d.doc_id % 10 <> 4 AS analyzed, d.doc_id % 6 = 5 AS refined,
  CASE WHEN d.doc_id % 10 = 4 THEN CAST(NULL AS STRING) WHEN coalesce(l.quality, 1) = 1 THEN 'approved'
    ELSE 'rejected' END AS status,
  CASE d.doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE CAST(NULL AS STRING) END AS risk,
  CASE WHEN d.doc_id % 8 = 0 THEN CAST(NULL AS BOOLEAN) ELSE d.doc_id % 8 = 3 END AS applied,
  CASE WHEN d.doc_id % 8 = 3 THEN concat(d.source, '_fn_', CAST(d.doc_id % 300 AS STRING)) END AS applied_name,
  length(d.text) > 4000 AS pseudocode_truncated,
  substring(md5(coalesce(d.text, '')), 1, 16) AS body_hash,
  concat('reason ', CAST(d.doc_id AS STRING)) AS reason, d.doc_id AS doc_id
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "old_nodes": """
SELECT p_partkey AS address,
  CASE WHEN p_partkey % 40 = 0 THEN concat('sub_', CAST(p_partkey AS STRING))
    WHEN p_partkey % 33 = 1 THEN concat('dup_', p_brand)
    WHEN p_partkey % 61 = 2 THEN concat('wil_details_', CAST(p_partkey AS STRING))
    ELSE concat(p_type, '_', CAST(p_partkey AS STRING)) END AS name,
  CAST(p_size * 16 + p_partkey % 7 AS INT) AS size_bytes, CAST(p_size AS INT) AS basic_block_count,
  p_partkey % 9 AS caller_count, p_partkey % 5 + 20 AS operand
FROM {part} WHERE p_partkey % 29 <> 5""",
    "new_nodes": """
SELECT p_partkey + 500000 AS address,
  CASE WHEN p_partkey % 40 = 0 THEN concat('sub_', CAST(p_partkey + 500000 AS STRING))
    WHEN p_partkey % 33 = 1 THEN concat('dup_', p_brand)
    WHEN p_partkey % 61 = 2 THEN concat('wil_details_', CAST(p_partkey AS STRING))
    ELSE concat(p_type, '_', CAST(p_partkey AS STRING)) END AS name,
  CAST(p_size * 16 + p_partkey % 7 + CASE WHEN p_partkey % 3 = 0 THEN 8 ELSE 0 END AS INT) AS size_bytes,
  CAST(p_size + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS INT) AS basic_block_count,
  p_partkey % 9 AS caller_count, p_partkey % 5 + 20 + CASE WHEN p_partkey % 14 = 1 THEN 1 ELSE 0 END AS operand
FROM {part} WHERE p_partkey % 37 <> 6""",
    "old_calls": """
SELECT p_partkey AS caller, (p_partkey * 31 + 7) % (SELECT count(*) FROM {part}) AS callee FROM {part}
UNION SELECT p_partkey, (p_partkey * 17 + 3) % (SELECT count(*) FROM {part}) FROM {part}""",
    "new_calls": """
SELECT caller + 500000 AS caller, callee + 500000 AS callee FROM {old_calls} WHERE caller % 13 <> 4""",
}


def parts(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{x: view(spark, sf_dir, x) for x in dict.fromkeys(parts(text))})


def ctes(*names: str, body: str = "") -> str:
    """DuckDB SQL: WITH the views (and those they need), then body."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in TABLES or name in order:
            return
        for x in parts(VIEWS[name]):
            need(x)
        order.append(name)

    for n in names:
        need(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n].strip().format_map(Plain())})" for n in order) + body


class Plain(dict):
    def __missing__(self, key: str) -> str:
        return key
