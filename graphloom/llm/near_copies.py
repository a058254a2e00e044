"""The wide side of op 1: near copies by exact Jaccard similarity of five-word shingles, as the pipeline's stage needs them.

Two texts are near copies if the sets of their ``width``-word shingles have Jaccard similarity ``UP / DOWN`` or more;
groups are the connected components of that relation. Every link is verified on the shingle sets.

Links come in two steps. First covering SimHash (``simhash_dedup.links``): fingerprints of the five-word shingles
within two bits, each pair verified on the sets. At similarity 0.8 two fingerprints differ in about 10 of 64 bits, and a radius
that covers nearly all such pairs (19) would take a million masks, so SimHash alone can't give this relation. The second step is therefore
MinHash, ``BANDS`` bands of ``ROWS`` minima of the same shingle hashes, each cut to its low byte. Two texts at similarity
s share no band with probability (1 - s^8)^64 at most: 8e-6 at 0.8, less above. Texts of a band go to a pivot, and from there by the join of
``jaccard_join``, exactly and without listing the pairs of a group of near copies. (Its own regions lose no pair at all, but at 0.8 a text
has about 300 of them, and texts that share a passage meet there: on 0.1 GB that took over 0.7 GB of disk.)

Defined cases: letters A to Z are lower-cased, words are cut at ASCII white space; texts under ``width`` words are one shingle;
null and empty texts are copies of each other; rows without id stay and are no one's copy; repeated rows of one id all
stay or all go; among ties the smallest id stays; very long texts are hashed in lots of a few MB, one text at least; other columns,
whatever their names, are kept; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard_join
from .common import cut, fresh, importable, keyed, lots, on_key
from .simhash_dedup import contract, links, majority

WIDTH, UP, DOWN, BANDS, ROWS = 5, 4, 5, 64, 8
#: Of 32 bits: products of 64 take ten times as long.
_FACTORS = np.random.default_rng(5).integers(0, 1 << 31, (2, BANDS * ROWS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(grams: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of BANDS * ROWS hashes, of 32 bits."""
    least, short = np.full(BANDS * ROWS, (1 << 32) - 1, dtype=np.uint32), grams.astype(np.uint32)
    for at in range(0, len(short), 256):
        least = np.minimum(least, ((short[at : at + 256, None] ^ _FACTORS[0]) * _FACTORS[1]).min(axis=0))
    return least


def bands(least: np.ndarray) -> list[int]:
    """A signed 64-bit value for each band of ``minima``: of its low bytes, so that these tell which bands two texts share."""
    import xxhash

    rows = least.astype(np.uint8).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node (a hash of the shingle set), n (its size), fp (its SimHash), regions (a value for each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for b in lots(batch, jaccard_join.LOT):
                sets = [jaccard_join.ngrams(t, WIDTH) for t in b.column("text").to_pylist()]
                signed = lambda values: pa.array(np.array(values, dtype=np.uint64).view(np.int64))
                own = {
                    "fp": signed([majority(s) for s in sets]),
                    "node": signed([xxhash.xxh64_intdigest(s.tobytes()) for s in sets]),
                    "n": pa.array(map(len, sets), pa.int64()),
                    "regions": pa.array([bands(minima(s)) for s in sets], pa.list_(pa.int64())),
                }
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_key": b.column("text_key")} | own)

    d = docs.select(F.col("doc_id").cast("long"), "text_key", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return d.mapInArrow(run, "doc_id long, text_key long, fp long, node long, n long, regions array<long>")


def _within_radius(nodes: DataFrame) -> DataFrame:
    """a, b: shingle sets whose fingerprints are equal or within the radius; connected wherever all such pairs are."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    of = lambda fp, node: first.select(F.col("fp").alias(fp), F.col("first").alias(node))
    pairs = links(nodes.select("fp")).withColumnsRenamed({"a": "fa", "b": "fb"}).join(of("fa", "x"), "fa").join(of("fb", "y"), "fb")
    return same.union(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the pairs that are near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                keep.append(jaccard_join.similar(len(x), len(y), len(np.setxor1d(x, y, assume_unique=True)), UP, DOWN))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda node, value: sets.select(F.col("node").alias(node), F.col("d").alias(value))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and node, root for each shingle set that isn't the root of its component."""
    importable(docs.sparkSession)
    d = keyed(docs.where("doc_id IS NOT NULL"))
    signed = cut(_signatures(d), "near-signatures")
    one = signed.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("fp").alias("fp"), F.first("regions").alias("regions"))
    nodes = cut(one.select("node", "fp", "regions", "at.*"), "near-nodes")
    close = cut(_within_radius(nodes), "near-close")
    pairs = cut(jaccard_join.pivots(nodes), "near-regions")
    ends = [pairs.select("region"), pairs.select("node"), close.select("a"), close.select("b")]
    wanted = ends[0].union(ends[1]).union(ends[2]).union(ends[3]).distinct().withColumnRenamed("region", "node")
    sets = cut(jaccard_join.sets_of(d, nodes, wanted, WIDTH), "near-sets")
    given = cut(_alike(close, sets), "near-given")
    return signed, contract(jaccard_join.links(pairs, sets, UP, DOWN, given))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without rows that are near copies of one with a smaller id, directly or by way of others."""
    signed, root = roots(docs)
    placed = cut(signed.select("doc_id", "text_key", "node").join(root, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root")), "near-roots")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("least"))
    gone = placed.join(least, "root").where("doc_id <> least").select("doc_id", "text_key").distinct()
    key = fresh(docs, "text_key")
    d = docs.withColumn(key, F.xxhash64("text"))
    return d.join(gone, d["doc_id"].eqNullSafe(gone["doc_id"]) & (d[key] == gone["text_key"]), "left_anti").select(*docs.columns)
