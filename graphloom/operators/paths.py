"""Lengths of paths without a repeated edge, by dynamic programming over (node, length) with representative edge sets.

Of all paths of one length to a node only the sets of edges that they used matter, and of these only so many that whatever
the remaining steps avoid, some set in store avoids it too. A set is kept if some ``q`` edges outside it meet all sets
kept before, with ``q`` the steps that remain; by Bollobás' inequality no more than C(length + q, q) sets are ever kept, 10 at
depth 5, however many paths there are. Representing is transitive, so sets are thinned out before the shuffle as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .adjacency import Adjacency, Whole

#: Nodes whose sets a task holds before it passes them on.
HELD = 50_000


def _meets_all(sets: list[frozenset[int]], outside: frozenset[int], q: int) -> bool:
    """Whether ``q`` elements that aren't in ``outside`` meet every one of ``sets``."""
    if not sets:
        return True
    if q == 0:
        return False
    return any(_meets_all([s for s in sets[1:] if e not in s], outside, q - 1) for e in sets[0] - outside)


def representative(sets: Iterable[frozenset[int]], q: int) -> list[frozenset[int]]:
    """Some of ``sets``: for any ``q`` elements that one of all avoids, one of these avoids them."""
    kept: list[frozenset[int]] = []
    for s in sets:
        if _meets_all(kept, s, q):
            kept.append(s)
    return kept


def _thinned(rows: DataFrame, q: int) -> DataFrame:
    """``rows`` (id, used) with representative sets of each id only."""

    def batch(held: dict[str, list[frozenset[int]]]) -> pa.RecordBatch:
        out = [(k, sorted(s)) for k, sets in held.items() for s in sets]
        return pa.RecordBatch.from_pydict({"id": pa.array([k for k, _ in out], pa.string()), "used": pa.array([s for _, s in out], pa.list_(pa.int64()))})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[frozenset[int]]] = {}
        for b in batches:
            for k, used in zip(b.column("id").to_pylist(), b.column("used").to_pylist(), strict=True):
                own = held.setdefault(k, [])
                if _meets_all(own, s := frozenset(used), q):
                    own.append(s)
            if len(held) > HELD:
                yield batch(held)
                held = {}
        yield batch(held)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch({k: representative(map(frozenset, sets), q) for k, sets in zip(b.column("id").to_pylist(), b.column("used").to_pylist(), strict=True)})

    some = rows.mapInArrow(first, "id string, used array<long>")
    return some.groupBy("id").agg(F.collect_list("used").alias("used")).mapInArrow(last, "id string, used array<long>")


def path_lengths(graph: DataFrame | Adjacency, start: str, max_depth: int, types: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """id, distance: each length at which a path without a repeated edge ends in a node; a node has a row for each."""
    if isinstance(graph, Adjacency):
        spark, steps = graph.spark, graph.steps("incoming" if reverse else "outgoing", types)
    else:
        spark, e = graph.sparkSession, graph.where(F.col("type").isin(types)) if types else graph
        ends = ("target", "source") if reverse else ("source", "target")
        steps = Whole(cut(e.select(F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b"), "ord"), "steps"))
    level, n, out = spark.createDataFrame([(start, [])], "id string, used array<long>"), 1, None
    for k in range(1, max_depth + 1):
        met = steps.of(level.withColumnRenamed("id", "a"), n).where(~F.array_contains("used", F.col("ord")))
        rows = met.select(F.col("b").alias("id"), F.array_append("used", F.col("ord")).alias("used"))
        q = max_depth - k
        level = cut(_thinned(rows, q) if q else rows.select("id").distinct(), "paths")
        n = level.count()
        found = level.select("id").distinct().withColumn("distance", F.lit(k))
        out = found if out is None else out.union(found)
        if not n:
            break
    return out if out is not None else level.select("id", F.lit(0).alias("distance")).limit(0)
