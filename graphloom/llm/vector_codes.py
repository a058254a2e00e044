"""Compression of vectors to short codes by product quantisation (op 11).

Components become integers, ``floor(1024 * x)``; a vector is cut into ``PARTS`` equal consecutive parts, and each part is
replaced by the index of its nearest entry in that part's codebook. Codebooks are learnt in ``ROUNDS`` rounds over all
vectors, in whole numbers throughout, so results don't depend on the order of summation.

Vectors lie in blocks: a row of the written table holds up to ``BLOCK`` vectors as one array for each dimension. A round is
one ``treeAggregate`` over these: each block's squared distances to all entries accumulate dimension by dimension,
``np.add.at`` adds its parts into int64 tensors of sums and counts, and the tensors merge through a reduction tree. Only
tensors travel, of PARTS x 256 x length of a part: their size depends on the codebook and the dimension, not on the rows.

Defined cases: vectors that are null or hold a null or non-finite component are dropped; vectors of other lengths than the
longest, and lengths that PARTS doesn't divide, are filled up with zeros; integers are kept within 2^26 either way, so that
distances stay exact; entries start by ascending vec_id, null ids last, equal ids by their components (as does the order of rows with
equal ids); with fewer than 256 vectors codebooks are that much shorter; null labels are one label; repeated rows count
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import cut, importable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block; with 64 dimensions of 8 bytes a block has 1 MB.
BLOCK = 2048
#: Vectors whose distances are held at once: 256 entries of 8 bytes each.
STEP = 256
#: Integers beyond this are cut to it.
MOST = 1 << 26
#: Labels whose sums are broadcast, at most.
BROADCAST_LABELS = 100_000


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))


def integers(vector: Column, length: Column) -> Column:
    """``floor(SCALE * x)`` of each component, filled up with zeros to ``length``."""
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * SCALE).cast("long"))))
    return F.concat(whole, F.array_repeat(F.lit(0).cast("long"), length - F.size(vector)))


def _blocks(vectors: DataFrame) -> DataFrame:
    """ids, labels (arrays), columns (an array of the vectors' components for each dimension, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                whole = np.asarray(part.column("whole").flatten()).reshape(part.num_rows, -1)
                columns = np.ascontiguousarray(whole.T, dtype="<i8")
                own = {
                    "ids": pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                    "labels": pa.array([part.column("label").to_pylist()], pa.list_(pa.string())),
                    "columns": pa.array([[c.tobytes() for c in columns]], pa.list_(pa.binary())),
                }
                yield pa.RecordBatch.from_pydict(own)

    return vectors.mapInArrow(run, "ids array<long>, labels array<string>, columns array<binary>")


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties: the lower) and its squared distance, for each vector of ``part`` (dimension, vector)."""
    index, least = np.empty(part.shape[1], dtype=np.int64), np.empty(part.shape[1], dtype=np.int64)
    for at in range(0, part.shape[1], STEP):
        own = part[:, at : at + STEP]
        distance = np.zeros((own.shape[1], len(entries)), dtype=np.int64)
        for d in range(len(own)):
            gap = own[d][:, None] - entries[:, d]
            distance += gap * gap
        index[at : at + STEP] = distance.argmin(axis=1)
        least[at : at + STEP] = np.take_along_axis(distance, index[at : at + STEP, None], axis=1)[:, 0]
    return index, least


def parts(columns: list[bytes]) -> np.ndarray:
    """(part, dimension, vector) of a block."""
    return np.stack([np.frombuffer(c, dtype="<i8") for c in columns]).reshape(PARTS, len(columns) // PARTS, -1)


def added(total: tuple[np.ndarray, np.ndarray], block: Row, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``total`` (sums, counts by part and entry) with a block's parts added to their nearest entries."""
    sums, counts = total
    for k, part in enumerate(parts(block["columns"])):
        index, _ = nearest(part, books[k])
        np.add.at(counts[k], index, 1)
        np.add.at(sums[k], index, part.T)
    return sums, counts


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def learn(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, dimension) after ``rounds`` rounds; entries that no part is nearest to stay."""
    sc, rows = blocks.sparkSession.sparkContext, blocks.select("columns").rdd
    for _ in range(rounds):
        shared = sc.broadcast(books)
        zero = (np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64))
        sums, counts = rows.treeAggregate(zero, lambda t, b, shared=shared: added(t, b, shared.value), merged, depth=3)
        shared.destroy()
        books = np.where(counts[..., None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[..., None]), books)
    return books


def _coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, labels, columns in zip(*[b.column(c) for c in ("ids", "labels", "columns")], strict=True):
                found = [nearest(part, books[k]) for k, part in enumerate(parts(columns.as_py()))]
                codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
                own = {"vec_id": ids.values, "label": labels.values, "code": pa.array([c.tobytes().hex() for c in codes]), "error": pa.array(sum(least for _, least in found))}
                yield pa.RecordBatch.from_pydict(own)

    return blocks.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label (as string), code, error for each usable vector, and the codebooks (part, entry, dimension)."""
    importable(vectors.sparkSession)
    kept = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").alias("vector")).where(usable(F.col("vector")))
    length = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    length = max(PARTS, -(-length // PARTS) * PARTS)
    kept = kept.select("vec_id", "label", integers(F.col("vector"), F.lit(length)).alias("whole"))
    first = kept.select("vec_id", "whole").orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(ENTRIES).collect()  # a codebook's entries, not more
    books = np.array([r["whole"] for r in first], dtype=np.int64).reshape(len(first), PARTS, length // PARTS).transpose(1, 0, 2)
    if not first:
        return kept.selectExpr("vec_id", "label", "'' AS code", "0L AS error").limit(0), books
    blocks = cut(_blocks(kept), "vector-blocks")
    books = learn(blocks, np.ascontiguousarray(books), rounds)
    return _coded(blocks, books), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def code_table(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (the sum over equal labels), codebooks_sha256."""
    coded, books = compress(vectors, rounds)
    coded = cut(coded, "vector-codes")
    sums = coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    out = coded.join(sums, coded["label"].eqNullSafe(sums["own"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
