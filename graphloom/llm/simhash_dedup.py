"""SimHash near-dedup with covering locality-sensitive hashing (op 1).

Each text gets a 64-bit SimHash of its word shingles. Fingerprints link at ``radius`` or fewer differing
bits. Covering LSH: every bit position gets a nonzero vector of radius + 1 bits; mask v keeps the
positions whose vector has odd inner product with v. Any ``radius`` differing positions leave a v
orthogonal to all of them, so each pair within the radius agrees under some of the 2^(radius+1) - 1 masks:
no pair is missed.

A bucket (mask, masked value) is never expanded into its pairs. Up to ``small`` distinct fingerprints are
compared in one bounded array. In larger ones each fingerprint meets others at hubs: for radius 2, two
fingerprints are within two bits exactly if some value is within one bit of both, and a hub holds at
most 65 fingerprints. Links feed star contraction, each round written to the shared folder.

Equal texts collapse to one fingerprint before any link is sought, so groups of copies cost a group-by.

Defined cases: a null text counts as empty and has fingerprint zero; zero links like any other; repeated
rows and ties share a fingerprint; a null id is never the smallest of a component unless all are null; very long texts
are hashed in bounded steps; other columns are ignored by ``components`` and kept by both dedups; an empty table gives
no rows. ``dedup``, the pipeline's stage, has a wider relation with exact similarity: see ``near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, importable

RADIUS = 2


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit word of the bits that are 1 in over half of ``hashes``, taken in bounded steps."""
    votes, step = np.zeros(64, dtype=np.int64), 1 << 16
    for at in range(0, len(hashes), step):
        part = np.ascontiguousarray(hashes[at : at + step], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of UTF-8 ``text``: a bit is 1 if set in over half of the shingles' XXH64."""
    import xxhash

    w = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    if len(w) < width:
        return xxhash.xxh64_intdigest(b" ".join(w), 42)
    runs = map(b" ".join, zip(*[w[i:] for i in range(width)], strict=False))
    return majority(np.fromiter((xxhash.xxh64_intdigest(r, 42) for r in runs), dtype="<u8", count=len(w) - width + 1))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as signed long, one row for each row of ``docs``."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fp": pa.array(fps)})

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """Signed 64-bit masks; any two words within ``radius`` bits are equal under one of them."""
    vector = [1 + i % ((1 << radius + 1) - 1) for i in range(64)]
    found = [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, 1 << radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(fps: DataFrame, small: int = 32) -> DataFrame:
    """a, b (a < b): distinct values of ``fp`` within RADIUS bits; not all pairs, but connected wherever pairs are."""
    all_masks = masks()
    values = F.array(*[F.struct(F.lit(k).alias("v"), F.lit(m).alias("mask")) for k, m in enumerate(all_masks)])
    keyed = fps.select("fp").distinct().select("fp", F.explode(values).alias("m")).select("fp", "m.v", F.col("m.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    keyed = cut(keyed, "simhash-tables")
    sizes = keyed.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    own = keyed.join(sizes, ["v", "key"])

    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= RADIUS
    bucket = own.where(F.col("n") <= small).groupBy("v", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    direct = bucket.select(F.explode(pairs).alias("p")).select("p.a", "p.b")

    # hubs: the value itself and each flip of one bit that the mask leaves free
    bits = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    flips = F.filter(bits, lambda bit: bit.bitwiseAND(F.col("mask")) == 0)
    hubs = own.where(F.col("n") > small).select("v", "fp", F.explode(flips).alias("bit")).select("v", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("hub"))
    stars = hubs.groupBy("v", "hub").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    via = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return direct.union(via).distinct()


def contract(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component, for every node of ``edges`` (a, b) that isn't a root.

    Large-star and small-star alternate (Kiveris et al., 2014) until nothing changes.
    """
    edges = cut(edges.select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node")).where("root < node").distinct(), "star")

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("root", "node").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    was = state(edges)
    while was[0]:
        both = edges.select(F.col("node").alias("u"), F.col("root").alias("w")).union(edges.select(F.col("root").alias("u"), F.col("node").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("w > u").select(F.col("m").alias("root"), F.col("w").alias("node")).distinct()
        large = cut(large, "star")
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        joined = large.join(least, "node")
        new = joined.select(F.col("m").alias("root"), "node").union(joined.where("root > m").select(F.col("m").alias("root"), F.col("root").alias("node")))
        edges = cut(new.distinct(), "star")
        now = state(edges)
        if now == was:
            break
        was = now
    return edges.select("node", "root")


def components(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fps = cut(fingerprints(docs, width), "simhash-fps")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = contract(links(fps))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = cut(placed, "simhash-roots")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(ids, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` without documents linked by fingerprints to one with a smaller id; rows without id stay."""
    c = components(docs.where("doc_id IS NOT NULL"), width).where("doc_id <> component_id").select(F.col("doc_id").alias(fresh(docs, "copy_id"))).distinct()
    return docs.join(c, docs["doc_id"] == c[c.columns[0]], "left_anti")


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without documents that, by links of five-word similarity 0.8 or more, hang together with one of a smaller id."""
    from . import near_copies

    return near_copies.dedup(docs)
