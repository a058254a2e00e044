"""The property graph of the driver's tables, and graph JSON.

Nodes: regions and nations are files, suppliers, customers and parts classes, orders functions; a node's path is its
parent's id. Edges go from the dependent to what it depends on. ``ord`` is a node's or edge's place in its list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.adjacency import Adjacency, opened
from ..scratch import dealt

NAMES = ["save_order", "get_order", "validate", "main", "teardown", "process_all", "test_get", "authenticate", "misc"]
ORD = 1_000_000_000_000

NODE_SCHEMA = "id string, type string, name string, path string, content string, docstring string, lines array<int>"
EDGE_SCHEMA = "source string, target string, type string, line int"
GRAPH_SCHEMA = f"version string, generated_at string, sha string, repository struct<path: string, name: string, user_id: string>, nodes array<struct<{', '.join(x.replace(' ', ': ', 1) for x in NODE_SCHEMA.split(', '))}>>, edges array<struct<{', '.join(x.replace(' ', ': ', 1) for x in EDGE_SCHEMA.split(', '))}>>"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, name, path, ord, start_line, end_line, repo_id."""
    name = F.concat(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("o_orderkey") % len(NAMES) + 1).cast("int")), F.lit("_"), F.col("o_orderkey").cast("string"))
    none = F.lit(None).cast("int")
    parts = [
        ("region", "r", "r_regionkey", "file", F.col("r_name"), _id("r", "r_regionkey"), none, none),
        ("nation", "n", "n_nationkey", "file", F.col("n_name"), _id("r", "n_regionkey"), none, none),
        ("supplier", "s", "s_suppkey", "class", F.col("s_name"), _id("n", "s_nationkey"), (F.col("s_suppkey") % 50 + 1).cast("int"), (F.col("s_suppkey") % 50 + 20).cast("int")),
        ("customer", "c", "c_custkey", "class", F.col("c_name"), _id("n", "c_nationkey"), (F.col("c_custkey") % 300 + 1).cast("int"), (F.col("c_custkey") % 300 + 1 + F.col("c_custkey") % 17).cast("int")),
        ("part", "p", "p_partkey", "class", F.col("p_name"), F.concat(F.lit("b:"), F.col("p_brand")), (F.col("p_partkey") % 90 + 1).cast("int"), (F.col("p_partkey") % 90 + 1 + F.col("p_size")).cast("int")),
        ("orders", "o", "o_orderkey", "function", name, _id("c", "o_custkey"), (F.col("o_orderkey") % 1000 + 1).cast("int"), (F.col("o_orderkey") % 1000 + 1 + F.col("o_orderkey") % 37).cast("int")),
    ]
    out = None
    for k, (table, prefix, key, kind, label, path, a, b) in enumerate(parts):
        one = _t(spark, sf_dir, table).select(_id(prefix, key).alias("id"), F.lit(kind).alias("type"), label.alias("name"), path.alias("path"), (F.lit(k).cast("long") * ORD + F.col(key)).alias("ord"), a.alias("start_line"), b.alias("end_line"), F.concat(F.lit("repo"), (F.col(key) % 3).cast("string")).alias("repo_id"))
        out = one if out is None else out.union(one)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, type, line, ord: a multigraph, an order calls a part once for each of its lines."""
    lines = _t(spark, sf_dir, "lineitem")
    pairs = dealt(lines.select("l_partkey", "l_suppkey"), lines.count(), "l_partkey", "l_suppkey").distinct()
    parts = [
        (_t(spark, sf_dir, "nation"), _id("n", "n_nationkey"), _id("r", "n_regionkey"), "EXTENDS", F.lit(1), F.col("n_nationkey").cast("long")),
        (_t(spark, sf_dir, "supplier"), _id("s", "s_suppkey"), _id("n", "s_nationkey"), "IMPORTS", F.lit(1), F.col("s_suppkey")),
        (_t(spark, sf_dir, "customer"), _id("c", "c_custkey"), _id("n", "c_nationkey"), "IMPORTS", F.lit(1), F.col("c_custkey")),
        (_t(spark, sf_dir, "orders"), _id("o", "o_orderkey"), _id("c", "o_custkey"), "CALLS", F.lit(1), F.col("o_orderkey")),
        (_t(spark, sf_dir, "lineitem"), _id("o", "l_orderkey"), _id("p", "l_partkey"), "CALLS", F.col("l_linenumber"), F.col("l_orderkey") * 10 + F.col("l_linenumber")),
        (pairs, _id("p", "l_partkey"), _id("s", "l_suppkey"), "IMPORTS", F.lit(1), F.col("l_partkey") * 100_000 + F.col("l_suppkey")),
    ]
    out = None
    for k, (table, source, target, kind, line, place) in enumerate(parts):
        one = table.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), line.cast("int").alias("line"), (F.lit(k).cast("long") * ORD * 10 + place.cast("long")).alias("ord"))
        out = one if out is None else out.union(one)
    return out


def n_rows(spark: SparkSession, sf_dir: str) -> int:
    """Nodes and edges, at most: the tables' rows, which their files' footers tell."""
    ends = ("region", "nation", "nation", "supplier", "supplier", "customer", "customer", "part", "orders", "orders", "lineitem", "lineitem")
    return reduce(DataFrame.union, [_t(spark, sf_dir, t).select(F.lit(1)) for t in ends]).count()


def adjacency(spark: SparkSession, sf_dir: str) -> Adjacency:
    """The same graph as stored adjacency, written when it is first asked for."""
    tables = [f"{sf_dir}/{t}.parquet" for t in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")]
    return opened(spark, "tables", tables, lambda: nodes(spark, sf_dir), lambda: edges(spark, sf_dir))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cyclic graph of event types: each user's event to the next one by time; source, target, n."""
    e = _t(spark, sf_dir, "events")
    step = e.selectExpr("event_type AS source", "lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target")
    return step.where("target IS NOT NULL").groupBy("source", "target").agg(F.count("*").alias("n"))


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graphs, nodes and edges of the graph JSON files under ``path``; ``ord`` is the place in its list."""
    g = spark.read.schema(GRAPH_SCHEMA).json(path, multiLine=True).withColumn("graph_id", F.sha2(F.concat_ws("\n", "version", "generated_at", "repository.path", "sha"), 256))
    n = g.select("graph_id", F.posexplode("nodes").alias("ord", "x")).select("graph_id", "ord", "x.*")
    e = g.select("graph_id", F.posexplode("edges").alias("ord", "x")).select("graph_id", "ord", "x.*")
    return g.drop("nodes", "edges"), n, e


def load(spark: SparkSession, path: str, graph_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One of the graphs under ``path``, as ``read_json`` gives it; only its own lists are exploded."""
    found = [x.where(F.col("graph_id") == graph_id) for x in read_json(spark, path)]
    if found[0].isEmpty():
        raise LookupError(f"no graph {graph_id}")
    return tuple(found)


def write_json(nodes_: DataFrame, edges_: DataFrame, path: str, version: str, repo: str) -> None:
    """One JSON object a graph, nodes and edges in the order of ``ord``; both frames have ``graph_id``."""
    cols = [c for c in ("id", "type", "name", "path", "content", "docstring", "lines") if c in nodes_.columns]
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    n = nodes_.groupBy("graph_id").agg(ordered(F.struct("ord", F.struct(*cols).alias("v"))).alias("nodes"))
    e = edges_.groupBy("graph_id").agg(ordered(F.struct("ord", F.struct("source", "target", "type", "line").alias("v"))).alias("edges"))
    head = [F.lit(version).alias("version"), F.struct(F.lit(repo).alias("path"), F.lit(repo).alias("name")).alias("repository")]
    n.join(e, "graph_id", "left").select(*head, "nodes", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)).alias("edges")).write.json(path)


#: The same graph for the oracles: start a query with ``WITH {G}``.
G = """nodes AS (
  SELECT 'r:' || r_regionkey AS id, 'file' AS type, r_name AS name, 'r:' || r_regionkey AS path, r_regionkey::BIGINT AS ord, NULL::INT AS start_line, NULL::INT AS end_line, 'repo' || (r_regionkey % 3) AS repo_id FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'file', n_name, 'r:' || n_regionkey, 1000000000000 + n_nationkey, NULL, NULL, 'repo' || (n_nationkey % 3) FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'class', s_name, 'n:' || s_nationkey, 2000000000000 + s_suppkey, s_suppkey % 50 + 1, s_suppkey % 50 + 20, 'repo' || (s_suppkey % 3) FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'class', c_name, 'n:' || c_nationkey, 3000000000000 + c_custkey, c_custkey % 300 + 1, c_custkey % 300 + 1 + c_custkey % 17, 'repo' || (c_custkey % 3) FROM customer
  UNION ALL SELECT 'p:' || p_partkey, 'class', p_name, 'b:' || p_brand, 4000000000000 + p_partkey, p_partkey % 90 + 1, p_partkey % 90 + 1 + p_size, 'repo' || (p_partkey % 3) FROM part
  UNION ALL SELECT 'o:' || o_orderkey, 'function', (['save_order', 'get_order', 'validate', 'main', 'teardown', 'process_all', 'test_get', 'authenticate', 'misc'])[o_orderkey % 9 + 1] || '_' || o_orderkey, 'c:' || o_custkey, 5000000000000 + o_orderkey, o_orderkey % 1000 + 1, o_orderkey % 1000 + 1 + o_orderkey % 37, 'repo' || (o_orderkey % 3) FROM orders
), edges AS (
  SELECT 'n:' || n_nationkey AS source, 'r:' || n_regionkey AS target, 'EXTENDS' AS type, 1 AS line, n_nationkey::BIGINT AS ord FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'IMPORTS', 1, 10000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'IMPORTS', 1, 20000000000000 + c_custkey FROM customer
  UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'CALLS', 1, 30000000000000 + o_orderkey FROM orders
  UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, 'CALLS', l_linenumber, 40000000000000 + l_orderkey * 10 + l_linenumber FROM lineitem
  UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'IMPORTS', 1, 50000000000000 + l_partkey * 100000 + l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
), steps AS (
  SELECT source, target, count(*) AS n FROM (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL GROUP BY ALL
)"""
