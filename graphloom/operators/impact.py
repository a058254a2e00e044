"""Impact of changed files: closures over the file graph, affected tests, risk classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CRITICAL_PATHS
from ..functions.scalars import basename, dirname, join_path, stem
from ..scratch import cut
from .adjacency import Adjacency, Picked, few
from .lookup import file_graph
from .traverse import reach


def _users(graph: DataFrame | Adjacency, nodes: DataFrame | None, leave_out: list[str] | None, whole: bool = False) -> Picked | DataFrame:
    """Steps from a file to those that use it; of an adjacency, or of edges and nodes."""
    if isinstance(graph, Adjacency):
        return graph.file_steps(leave_out, whole)
    steps = file_graph(graph, nodes).withColumnsRenamed({"path": "a", "by_path": "b"})
    return steps.where(~F.col("b").isin(leave_out)) if leave_out else steps


def direct(graph: DataFrame | Adjacency, nodes: DataFrame | None, changed: list[str]) -> DataFrame:
    """path, edge_types: files outside ``changed`` that use a changed file; types of the edges to the first node by which a file was found."""
    steps = _users(graph, nodes, changed, whole=True)
    if isinstance(steps, DataFrame):
        g = steps.where(F.col("a").isin(changed))
    else:
        g = cut(steps.of(graph.spark.createDataFrame([(c,) for c in dict.fromkeys(changed)], "a string"), len(changed)).select("a", "b", "edge_type", "node_ord", "edge_ord"), "impact")
    rank = F.array_position(F.array(*map(F.lit, changed)), F.col("a"))
    first = g.groupBy("b").agg(F.min(F.struct(rank.alias("r"), "node_ord", "edge_ord")).alias("f"))
    own = g.join(first, "b").where(F.col("node_ord") == F.col("f.node_ord"))
    return own.groupBy(F.col("b").alias("path")).agg(F.array_sort(F.collect_set("edge_type")).alias("edge_types"))


def closure(graph: DataFrame | Adjacency, nodes: DataFrame | None, changed: list[str], rounds: int | None = 3) -> DataFrame:
    """path, distance: 1 for direct impact, 2 and more for up to ``rounds`` further steps; changed files themselves are left out."""
    spark = graph.spark if isinstance(graph, Adjacency) else graph.sparkSession
    steps = _users(graph, nodes, changed)
    if isinstance(steps, DataFrame):
        steps = steps.select("a", "b").distinct()
    found = reach(steps, spark.createDataFrame([(c,) for c in changed], "id string"), None if rounds is None else rounds + 1)
    return found.where("depth > 0").select(F.col("id").alias("path"), F.col("depth").alias("distance"))


def within_two(direct: DataFrame) -> DataFrame:
    """changed, by_path: each pair within two steps of ``direct`` (changed, by_path; distinct), a file and itself left out.

    Files between that use the same files are as one: what uses any of them is made distinct before it meets what they
    use, so that many hubs with the same users don't multiply. Equal sets go by their size and two 64-bit sums of hashes."""
    h = F.xxhash64("changed")
    ways = direct.groupBy(F.col("by_path").alias("mid")).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(h, "changed")).alias("x"))
    kinds = cut(ways.join(ways.groupBy("n", "s", "x").agg(F.min("mid").alias("kind")), ["n", "s", "x"]).select("mid", "kind"), "kinds")
    after = direct.select(F.col("changed").alias("mid"), F.col("by_path").alias("to")).join(kinds, "mid").select("kind", "to").distinct()
    met = after.select("kind").distinct()
    before = cut(direct.withColumnRenamed("by_path", "kind").join(met, "kind", "left_semi"), "before")
    further = after.join(few(before, before.count()), "kind").where("to <> changed").select("changed", F.col("to").alias("by_path"))
    return direct.select("changed", "by_path").union(further).distinct()


def tests_of(affected: DataFrame, files: DataFrame) -> DataFrame:
    """path, test: the first of five candidate paths that is a file (path)."""
    p = F.col("path")
    candidates = [join_path(dirname(p), F.concat(F.lit("test_"), basename(p))), join_path(dirname(p), F.concat(F.lit("test_"), stem(p), F.lit(".py"))), F.concat(F.lit("tests/"), basename(p)), F.concat(F.lit("tests/test_"), basename(p)), F.concat(F.lit("tests/test_"), stem(p), F.lit(".py"))]
    c = affected.select("path", F.posexplode(F.array(*candidates)).alias("k", "test"))
    return c.join(files.select(F.col("path").alias("test")).distinct(), "test", "left_semi").groupBy("path").agg(F.min_by("test", "k").alias("test"))


def critical(path: Column) -> Column:
    return F.lit(False) if not CRITICAL_PATHS else F.array_max(F.array(*[path.contains(x) for x in CRITICAL_PATHS]))


def pr_risk(n_impacted: Column, n_changed: Column, has_critical: Column) -> Column:
    base = F.when(n_impacted == 0, 0).when((n_impacted <= 5) & (n_changed <= 3), 0).when((n_impacted <= 15) | (n_changed <= 5), 1).otherwise(2)
    return F.element_at(F.array(*map(F.lit, ["low", "medium", "high"])), F.least(F.lit(2), base + F.when(has_critical, 1).otherwise(0)) + 1)


def plugin_risk(n: Column) -> Column:
    return F.when(n <= 1, "low").when(n <= 5, "medium").otherwise("high")


def ci_risk(percent: Column) -> Column:
    return F.when(percent > 50, "critical").when(percent > 20, "high").when(percent > 10, "medium").when(percent > 5, "low").otherwise("minimal")
