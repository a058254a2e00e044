"""Embedding clusters: k-means, density clusters, labels and silhouettes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .density import density as density
from .density import density_labels as density_labels
from .density import euclidean


def kmeans(vectors: DataFrame, k: int, seed: int = 42, starts: int = 10) -> DataFrame:
    """``vectors`` with ``cluster``: the cheapest of ``starts`` seeded runs; k is at most the number of rows."""
    v = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))).cache()
    k = max(1, min(k, v.count()))
    if k < 2:
        return vectors.withColumn("cluster", F.lit(0))
    models = [KMeans(k=k, seed=seed + i, predictionCol="cluster").fit(v) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(v).drop("features")


def centroids(vectors: DataFrame, cluster: str) -> DataFrame:
    """cluster, centroid: means by component. Sums are combined before the shuffle."""
    e = vectors.select(cluster, F.posexplode("embedding").alias("i", "x")).groupBy(cluster, "i").agg(F.avg("x").alias("m"))
    return e.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def labels(nodes: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, dominant_type, common_path: the most frequent type (ties: first by name) and the folders that all paths share."""
    t = nodes.groupBy(cluster, "type").agg(F.count("*").alias("n")).groupBy(cluster).agg(F.min(F.struct((-F.col("n")).alias("n"), "type"))["type"].alias("dominant_type"))
    parts = F.split("path", "/")
    heads = nodes.select(cluster, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("head")).groupBy(cluster, "head").agg(F.count("*").alias("n"))
    size = nodes.groupBy(cluster).agg(F.count("*").alias("size"))
    common = heads.join(size, cluster).where("n = size").groupBy(cluster).agg(F.max_by("head", F.length("head")).alias("common_path"))
    return t.join(common, cluster, "left").select(cluster, "dominant_type", F.coalesce("common_path", F.lit("")).alias("common_path"))


#: Vectors of a block: two blocks' distances are a matrix of 8 MB. Values of a block's sums, at most, and blocks of a side of a tile.
BLOCK, SUMS, SIDE = 1000, 1_000_000, 16


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """block, own (the rows' clusters as numbers, ascending), x (their vectors, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                c = np.array(part.column("c").to_pylist(), dtype=np.int32)
                order = np.argsort(c, kind="stable")
                x = np.array(part.column("x").to_pylist(), dtype="<f8").reshape(len(c), -1)[order]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "own": pa.array([c[order].tolist()], pa.list_(pa.int32())), "x": pa.array([x.tobytes()], pa.binary())})
                block += 1

    return rows.mapInArrow(run, "block long, own array<int>, x binary")


def _add_sums(to: np.ndarray, far: np.ndarray, clusters: np.ndarray) -> None:
    """Add to ``to`` (rows by clusters) the sums of ``far`` over the columns of each of ``clusters`` (ascending)."""
    at = np.flatnonzero(np.r_[True, clusters[1:] != clusters[:-1]])
    to[:, clusters[at]] += np.add.reduceat(far, at, axis=1)


def _tile(pieces: pa.Table, k: int) -> pa.Table:
    """block, sums (rows by clusters, packed) of all pairs of a block of side 0 and one of side 1, each pair once; a tile of the
    diagonal has its blocks on side 0 only."""
    sides: tuple[list, list] = ([], [])
    for r in zip(*[pieces.column(c) for c in ("block", "side", "own", "x")], strict=True):
        own = np.asarray(r[2].values)
        sides[r[1].as_py()].append((r[0].as_py(), own, np.frombuffer(r[3].as_py(), "<f8").reshape(len(own), -1), np.zeros((len(own), k))))
    left, right = (sorted(s, key=lambda b: b[0]) for s in sides)
    for i, (_, own, x, sums) in enumerate(left):
        for j, (_, other, y, back) in enumerate(right or left):
            if right or i <= j:
                far = euclidean(x, y)
                _add_sums(sums, far, other)
                if right or i < j:
                    _add_sums(back, np.ascontiguousarray(far.T), own)
    out = left + right
    return pa.table({"block": pa.array([b[0] for b in out], pa.int64()), "own": pa.array([b[1].tolist() for b in out], pa.list_(pa.int32())), "sums": pa.array([b[3].tobytes() for b in out], pa.binary())})


def silhouette(vectors: DataFrame, cluster: str = "cluster") -> float:
    """Mean silhouette by euclidean distance; 0 for fewer than two clusters. Rows without cluster or vector don't count.

    Exact: each pair of blocks of rows meets once, in a tile of ``SIDE`` by ``SIDE`` blocks, and only sums by row and cluster
    leave a tile. The work grows with the square of the rows, a task's memory is a tile's."""
    rows = vectors.where(F.col(cluster).isNotNull() & F.col("embedding").isNotNull())
    sizes = rows.groupBy(cluster).count().orderBy(cluster).collect()  # as many as clusters
    if len(sizes) < 2:
        return 0.0
    names = rows.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(sizes)], rows.select(F.col(cluster).alias("name")).schema.add("c", "integer"))
    numbered = rows.join(F.broadcast(names), F.col(cluster) == F.col("name")).select("c", F.col("embedding").cast("array<double>").alias("x"))
    k, n = len(sizes), np.array([r["count"] for r in sizes], dtype=float)
    blocks = cut(_blocks(numbered, max(1, min(BLOCK, SUMS // k))), "silhouette-blocks")
    ids = sorted(r.block for r in blocks.select("block").collect())
    band = rows.sparkSession.createDataFrame([(b, i // SIDE) for i, b in enumerate(ids)], "block long, band int")
    bands = F.array(*map(F.lit, range(-(-len(ids) // SIDE))))
    meets = blocks.join(F.broadcast(band), "block").withColumn("to", F.explode(bands))
    meets = meets.select(F.least("band", "to").alias("a"), F.greatest("band", "to").alias("b"), (F.col("band") > F.col("to")).cast("int").alias("side"), "block", "own", "x")
    tiles = -(-len(ids) // SIDE) * (-(-len(ids) // SIDE) + 1) // 2
    sums = meets.repartition(tiles, "a", "b").groupBy("a", "b").applyInArrow(lambda t: _tile(t, k), "block long, own array<int>, sums binary")

    def rated(t: pa.Table) -> pa.Table:
        own = np.asarray(t.column("own")[0].values)
        s = sum(np.frombuffer(x.as_py(), "<f8").reshape(len(own), k) for x in t.column("sums"))
        mine, each = n[own], np.arange(len(own))
        a, mean = s[each, own] / np.maximum(mine - 1, 1), s / n
        mean[each, own] = np.inf
        b = mean.min(axis=1)
        most = np.maximum(a, b)
        rate = np.where((mine < 2) | (most == 0), 0.0, (b - a) / np.where(most == 0, 1.0, most))
        return pa.table({"rate": pa.array([float(rate.sum())]), "n": pa.array([len(own)], pa.int64())})

    total = sums.groupBy("block").applyInArrow(rated, "rate double, n long").agg(F.sum("rate"), F.sum("n")).first()
    return total[0] / total[1]
