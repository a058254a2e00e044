"""Traversals as frontier joins. Each round joins only the frontier with the edges, and is written to the shared
folder, so plans stay short and lost executors don't restart a walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DECAY, EDGE_WEIGHTS, WEIGHT_THRESHOLD
from ..scratch import cut
from .adjacency import Adjacency, Picked, Stored, Whole, few

DIRECTIONS = ("outgoing", "incoming", "both")


def arcs(edges: DataFrame, direction: str = "outgoing", types: list[str] | None = None) -> DataFrame:
    """a, b: one step goes from a to b."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    e = edges.where(F.col("type").isin(types)) if types else edges
    out, back = e.select(F.col("source").alias("a"), F.col("target").alias("b")), e.select(F.col("target").alias("a"), F.col("source").alias("b"))
    return {"outgoing": out, "incoming": back, "both": out.union(back)}[direction]


Steps = DataFrame | Whole | Stored | Picked


def _steps(steps: Steps, *columns: str) -> Whole | Stored | Picked:
    """Steps to join a frontier with; those that aren't stored are worked out once, not in each round."""
    return Whole(cut(steps.select(*columns), "steps")) if isinstance(steps, DataFrame) else steps


def _edges(graph: DataFrame | Adjacency, direction: str, types: list[str] | None) -> Steps:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    return graph.steps(direction, types) if isinstance(graph, Adjacency) else arcs(graph, direction, types)


def reach(steps: Steps, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """id, depth: the least number of steps (a, b) from any ``start`` (id); up to ``max_depth``, or until nothing is new.

    Steps may repeat: each round is made distinct anyway, so all steps need not be. A small frontier meets them by a
    broadcast, and the steps are not shuffled at all; of stored ones only the frontier's buckets are read."""
    steps = _steps(steps, "a", "b")
    seen = cut(start.select("id").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier, depth, n = seen, 0, seen.count()
    n_seen = n
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        met = steps.of(frontier.select(F.col("id").alias("a")), n).select(F.col("b").alias("id")).distinct()
        frontier = cut(met.join(few(seen.select("id"), n_seen), "id", "left_anti").withColumn("depth", F.lit(depth)), "reach")
        n = frontier.count()
        n_seen += n
        if n:
            seen = seen.union(frontier)
    return seen


def khop(graph: DataFrame | Adjacency, start: str, max_depth: int, direction: str = "outgoing", types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) within ``max_depth``, and the distinct edges of all nodes that were expanded. ``graph``: edges, or
    a stored adjacency."""
    if not 1 <= max_depth <= 5:
        raise ValueError("depth is 1 to 5")
    s = (graph.spark if isinstance(graph, Adjacency) else graph.sparkSession).createDataFrame([(start,)], "id string")
    found = reach(_edges(graph, direction, types), s, max_depth)
    return found, _expanded(graph, found.where(F.col("depth") < max_depth).select("id"), direction, types)


def _expanded(graph: DataFrame | Adjacency, expanded: DataFrame, direction: str, types: list[str] | None) -> DataFrame:
    n, out = expanded.count(), None
    for way, ends in (("outgoing", ("source", "target")), ("incoming", ("target", "source"))):
        if direction in (way, "both"):
            if isinstance(graph, Adjacency):
                e = graph.steps(way, types).of(expanded.withColumnRenamed("id", "a"), n).withColumnsRenamed({"a": ends[0], "b": ends[1]})
            else:
                e = (graph.where(F.col("type").isin(types)) if types else graph).join(few(expanded.withColumnRenamed("id", ends[0]), n), ends[0], "left_semi")
            e = e.select("source", "target", "type")
            out = e if out is None else out.unionByName(e)
    return out.distinct()


def decayed(found: DataFrame, rate: float = DECAY) -> DataFrame:
    return found.withColumn("score", F.pow(F.lit(rate), F.col("depth")))


def weighted(graph: DataFrame | Adjacency, start: str, threshold: float = WEIGHT_THRESHOLD, weights: dict[str, float] | None = None) -> DataFrame:
    """id, weight: the greatest product of edge weights (1 at most) on a path from ``start``, while at least ``threshold``."""
    w = F.create_map(*[F.lit(x) for kv in (weights or EDGE_WEIGHTS).items() for x in kv])
    stored = isinstance(graph, Adjacency)
    steps = graph.steps() if stored else _steps(graph.select(F.col("source").alias("a"), F.col("target").alias("b"), "type"), "a", "b", "type")
    best = cut((graph.spark if stored else graph.sparkSession).createDataFrame([(start, 1.0)], "id string, weight double"), "weighted")
    frontier, n = best, 1
    while n:
        met = steps.of(frontier.withColumnRenamed("id", "a"), n).withColumn("w", w[F.col("type")]).where("w IS NOT NULL")
        new = met.groupBy(F.col("b").alias("id")).agg(F.max(F.col("weight") * F.col("w")).alias("weight")).where(F.col("weight") >= threshold)
        old = best.withColumnRenamed("weight", "old")
        frontier = cut(new.join(old, "id", "left").where("old IS NULL OR weight > old + 1e-12").select("id", "weight"), "weighted")
        n = frontier.count()
        if n:
            best = cut(best.union(frontier).groupBy("id").agg(F.max("weight").alias("weight")), "weighted")
    return best


def shortest_path(graph: DataFrame | Adjacency, source: str, target: str) -> list[str] | None:
    """Nodes of a shortest undirected path, the smallest parent at each step; None if there is none."""
    if source == target:
        return [source]
    steps = _edges(graph, "both", None)
    steps = _steps(steps, "a", "b")
    seen = cut((graph.spark if isinstance(graph, Adjacency) else graph.sparkSession).createDataFrame([(source, None)], "id string, parent string"), "path")
    frontier, levels, n, n_seen = seen, [seen], 1, 1
    while True:
        new = steps.of(frontier.select(F.col("id").alias("a")), n).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        frontier = cut(new.join(few(seen.select("id"), n_seen), "id", "left_anti"), "path")
        n = frontier.count()
        if not n:
            return None
        n_seen += n
        levels.append(frontier)
        if not frontier.where(F.col("id") == target).isEmpty():
            break
        seen = seen.union(frontier)
    path = [target]
    for level in levels[:0:-1]:
        path.append(level.where(F.col("id") == path[-1]).first().parent)
    return path[::-1]


def hop_score(depth: Column) -> Column:
    """1 at the entry point, 1 / (1 + d), 0.1 where there is no way."""
    return F.when(depth.isNull(), 0.1).otherwise(1.0 / (1.0 + depth))
