"""A vector index: inverted lists by coarse centroids, as a table in partitions, for cosine similarity.

Vectors are scaled to length 1 and go to their nearest centroid's list; a list is a folder of blocks of vectors with their
distances to the centroid. A search reads the folders of the lists it probes only, scores blocks by matrix products, and each block
returns its best for each query. The exact way goes on from there by bounds: a vector at distance r from its
centroid, which is at distance s from the query, is no nearer to it than |s - r|, so blocks beyond the distance of the
query's k-th best so far are left out, and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, discard, plain_reads, shared_root
from .adjacency import exists, version_of

#: Rows that centroids are fitted on (at most), rounds of fitting, vectors of a block, queries scored at once, and the most lists.
FIT_ROWS, FIT_ROUNDS, BLOCK, QUERIES, MOST = 20_000, 10, 1000, 256, 4096
#: Blocks of queries that are broadcast.
BROADCAST_QUERIES = 1_000
#: Rounding of distances on the unit sphere, and digits of a similarity: equal vectors have equal ones wherever they are stored.
EPS, DIGITS = 1e-9, 12


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fitted(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """``k`` centroids of length 1 by spherical k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(FIT_ROUNDS):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        full = np.bincount(at, minlength=k) > 0
        c[full] = unit(sums[full])
    return c


def _usable(vectors: DataFrame, key: str) -> DataFrame:
    """id, x of rows with an id and a finite vector other than zero."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & fine)


def _rows(column: pa.Array) -> np.ndarray:
    return unit(np.array(column.to_pylist(), dtype=float)) if len(column) else np.zeros((0, 0))


def _sampled(rows: DataFrame, n: int) -> DataFrame:
    """The first ``FIT_ROWS`` of ``n`` rows by a hash of the id. Only rows below a bound of the hash, about a quarter too many, go to
    the top: else each partition would send ``FIT_ROWS`` rows of its own."""
    first, share = rows, 1.25 * FIT_ROWS / max(n, 1)
    while share < 1:
        below = rows.where(F.xxhash64("id") < int(-(2**63) + share * 2**64))
        if below.count() >= FIT_ROWS:
            first = below
            break
        share *= 2
    return first.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)


class VectorIndex:
    """Lists under ``path``: blocks (list, ids, x, low, high), written by ``build``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def ready(self) -> bool:
        return exists(self.spark, f"{self.path}/centroids/_SUCCESS")

    def build(self, vectors: DataFrame, key: str, lists: int | None = None) -> VectorIndex:
        """Centroids are fitted on ``FIT_ROWS`` rows at most, chosen by a hash of the id; every row is indexed."""
        rows = cut(_usable(vectors, key), "index-rows")  # vectors may come from an embedder, which is called once for each text
        n = rows.count()
        sample = _sampled(rows, n).select("x").collect()
        x = unit(np.array([r.x for r in sample])) if sample else np.zeros((0, 1))
        k = min(len(x), lists or max(1, min(MOST, int(np.sqrt(n)))))
        c = fitted(x, k) if k else x
        data = f"{self.path}/lists-{uuid.uuid4().hex}"
        self._packed(rows, c).write.partitionBy("list").parquet(data)
        marks = [(i, v.tolist(), data.rpartition("/")[2]) for i, v in enumerate(c)]
        self.spark.createDataFrame(marks, "list int, x array<double>, data string").coalesce(1).write.parquet(f"{self.path}/centroids")
        discard(rows)
        return self

    @staticmethod
    def _packed(rows: DataFrame, c: np.ndarray) -> DataFrame:
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = (_rows(b.column("x")) @ c.T).argmax(axis=1) if b.num_rows else []
                yield pa.RecordBatch.from_pydict({"list": pa.array(at, pa.int32()), "id": b.column("id"), "x": b.column("x")})

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = np.asarray(b.column("list"))
                for first in np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]) if b.num_rows else []:
                    n = int(np.searchsorted(lists[first:], lists[first], side="right"))
                    for at in range(first, first + n, BLOCK):
                        part = b.slice(at, min(BLOCK, first + n - at))
                        x = _rows(part.column("x"))
                        far = np.linalg.norm(x - c[lists[first]], axis=1)
                        own = {"list": pa.array([lists[first]], pa.int32()), "ids": pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), "x": pa.array([x.tobytes()], pa.binary())}
                        yield pa.RecordBatch.from_pydict(own | {"low": pa.array([far.min()]), "high": pa.array([far.max()])})

        listed = rows.mapInArrow(assign, "list int, id long, x array<double>").withColumn("far", F.lit(0))
        listed = listed.drop("far").hint("rebalance", "list").sortWithinPartitions("list", "id")  # a hot list goes to several tasks
        return listed.mapInArrow(pack, "list int, ids array<long>, x binary, low double, high double")

    def _open(self) -> tuple[np.ndarray, DataFrame | None]:
        plain_reads(self.spark)
        marks = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
        if not marks:
            return np.zeros((0, 1)), None
        return np.array([m.x for m in marks]), self.spark.read.parquet(f"{self.path}/{marks[0].data}")

    def _scored(self, blocks: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
        """qid, best (score, id): the best of each block for each query of ``wanted`` (qid, x, list, reach, gone)."""
        wanted = cut(wanted, "index-wanted")
        sizes = wanted.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("salts"))  # MOST rows at most
        salted = wanted.join(F.broadcast(sizes), "list").withColumn("salt", F.pmod(F.xxhash64("qid"), "salts"))
        own = salted.groupBy("list", "salt").agg(F.collect_list(F.struct("qid", "x", "s", "reach")).alias("q"))
        own = cut(own.select("list", *[F.transform("q", lambda s: s[c]).alias(c) for c in ("qid", "s", "reach")], F.flatten(F.transform("q", lambda s: s["x"])).alias("qx")), "index-queries")  # noqa: B023
        lists = [r["list"] for r in own.select("list").distinct().collect()]
        near = F.exists(F.arrays_zip("s", "reach"), lambda p: (p["s"] - F.col("high") <= p["reach"] + EPS) & (F.col("low") - p["s"] <= p["reach"] + EPS))
        met = blocks.where(F.col("list").isin(lists)).join(F.broadcast(own) if own.count() <= BROADCAST_QUERIES else own, "list").where(near)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for ids, x, low, high, qid, s, reach, qx in zip(*[b.column(c) for c in ("ids", "x", "low", "high", "qid", "s", "reach", "qx")], strict=True):
                    ids, qid, s, reach = (np.asarray(v.values) for v in (ids, qid, s, reach))
                    need = np.flatnonzero((s - high.as_py() <= reach + EPS) & (low.as_py() - s <= reach + EPS))
                    if not len(need):
                        continue
                    score = np.round(np.asarray(qx.values).reshape(len(qid), -1)[need] @ np.frombuffer(x.as_py()).reshape(len(ids), -1).T, DIGITS)
                    for q, row in zip(qid[need].tolist(), score, strict=True):
                        top = np.lexsort((ids, -row))[:k]
                        out.append({"qid": q, "best": [{"score": float(row[t]), "id": int(ids[t])} for t in top]})
                kind = pa.schema([("qid", pa.int64()), ("best", pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())])))])
                yield pa.RecordBatch.from_pylist(out, schema=kind)

        return met.select("ids", "low", "high", blocks["x"], "qid", "s", "reach", "qx").mapInArrow(run, "qid long, best array<struct<score: double, id: long>>")

    def search(self, queries: DataFrame, key: str, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
        """qid, rank (from 1), id, score: the ``k`` most similar vectors of each query (ties: the smaller id). ``exact``: over all
        lists that can hold one, else over the ``probes`` nearest lists."""
        c, blocks = self._open()
        q = _usable(queries, key).withColumnRenamed("id", "qid")
        if blocks is None:
            return q.selectExpr("qid", "1 AS rank", "qid AS id", "0D AS score").limit(0)
        found = self._top(self._scored(blocks, _lists(q.withColumn("known", F.lit(4.0)), c, 0, probes, wide=True), k), k)
        if exact:
            first = cut(found, "index-first")
            kth = first.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            # of vectors of length 1: distance^2 = 2 - 2 * similarity
            far = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least")) + 4 * 10.0**-DIGITS)).otherwise(4.0)
            rest = _lists(q.join(kth, "qid", "left").select("qid", "x", F.coalesce(far, F.lit(4.0)).alias("known")), c, probes, len(c), wide=False)
            more = self._scored(blocks, rest, k)
            again = first.groupBy("qid").agg(F.collect_list(F.struct("score", "id")).alias("best"))
            found = self._top(more.unionByName(again), k)
        return found

    @staticmethod
    def _top(parts: DataFrame, k: int) -> DataFrame:
        """The best of all parts: each part has ``k`` at most."""
        order = F.array_sort(F.transform(F.flatten(F.collect_list("best")), lambda s: F.struct((-s["score"]).alias("minus"), s["id"].alias("id"))))
        top = parts.groupBy("qid").agg(F.slice(order, 1, k).alias("top"))
        return top.select("qid", F.posexplode("top").alias("rank", "t")).select("qid", (F.col("rank") + 1).alias("rank"), F.col("t.id").alias("id"), (-F.col("t.minus")).alias("score"))


def _lists(queries: DataFrame, c: np.ndarray, first: int, last: int, wide: bool) -> DataFrame:
    """qid, x (length 1), list, s (distance of its centroid), reach: the ``first``-th to ``last``-th nearest lists of each query
    (qid, x, known), and how far a vector may be to count: anywhere, or within ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column("x"))
            out = []
            for qid, row, known in zip(b.column("qid").to_pylist(), x, b.column("known").to_pylist(), strict=True):
                far = np.linalg.norm(c - row, axis=1)
                for at in np.argsort(far, kind="stable")[first:last]:
                    if wide or far[at] - 2 <= known:
                        out.append({"qid": qid, "x": row.tolist(), "list": int(at), "s": float(far[at]), "reach": 4.0 if wide else known})
            kind = pa.schema([("qid", pa.int64()), ("x", pa.list_(pa.float64())), ("list", pa.int32()), ("s", pa.float64()), ("reach", pa.float64())])
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return queries.select("qid", "x", "known").mapInArrow(run, "qid long, x array<double>, list int, s double, reach double")


def opened(vectors: DataFrame, key: str, name: str, sources: list[str]) -> VectorIndex:
    """The index of ``vectors``, which come from the files in ``sources``; built when it is first asked for."""
    spark = vectors.sparkSession
    index = VectorIndex(spark, f"{shared_root(spark)}/index-{name}-{version_of(spark, sources)}")
    return index if index.ready() else index.build(vectors, key)
