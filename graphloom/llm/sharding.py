"""Sharding into byte-balanced shards by Karmarkar-Karp differencing (op 7).

Indivisible groups (rows of equal text) become partial partitions: ``k`` bins, the group in the first.
Repeatedly the two with the largest spread are combined, the largest bins of one with the smallest of the
other, until one is left. Here that runs as a tree: groups are dealt to buckets by hash, each bucket's
differencing leaves one partial partition, and those are differenced again, until one bucket is left.
Only group hashes and sizes move, never texts; a bucket holds about ``per_bucket`` items at any input
size, so neither a task nor the driver sees more.

Defined cases: a null text counts as empty (size 1) and goes with the empty ones; repeated rows get a slot
each; rows with null ids are placed like others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, importable


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions, one row of ``vectors`` each with its k bins' bytes.

    Returns bin_of (same shape: the final bin of each row's bin) and the final bins' bytes.
    """
    n, k = vectors.shape
    order = np.argsort(-vectors, axis=1, kind="stable")
    sums = np.take_along_axis(vectors, order, axis=1)
    # node: bins from largest to smallest; its children's bins that make up each of these
    bins: list[list[int]] = sums.tolist()
    made: list[tuple[int, int, list[int], list[int]]] = []
    heap = [(b[-1] - b[0], i) for i, b in enumerate(bins)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = bins[a], bins[b]
        both = [x[j] + y[k - 1 - j] for j in range(k)]
        rank = sorted(range(k), key=lambda j: (-both[j], j))
        bins[a] = bins[b] = []
        bins.append([both[j] for j in rank])
        # place[j]: the combined node's bin that bin j of a went to; b's bin j went with a's k-1-j
        place = [0] * k
        for to, j in enumerate(rank):
            place[j] = to
        made.append((a, b, place, place[::-1]))
        heapq.heappush(heap, (bins[-1][-1] - bins[-1][0], len(bins) - 1))
    final = np.empty((n + len(made), k), dtype=np.int64)
    if n:
        final[-1] = np.arange(k)
    for i in range(len(made) - 1, -1, -1):
        a, b, pa, pb = made[i]
        own = final[n + i]
        final[a] = own[pa]
        final[b] = own[pb]
    bin_of = np.empty((n, k), dtype=np.int64)
    np.put_along_axis(bin_of, order, final[:n], axis=1)
    total = np.array(bins[-1], dtype=np.int64) if n else np.zeros(k, dtype=np.int64)
    return bin_of, total


def _level(items: DataFrame, k: int, n_buckets: int) -> DataFrame:
    """items (id, id2, bins) -> bucket, id, id2, place (array of k), and per bucket its own bins."""
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("id2", "id"), F.lit(n_buckets)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "id2"], ignore_index=True)
        place, bins = difference(np.array(pdf["bins"].tolist(), dtype=np.int64).reshape(len(pdf), k))
        return pd.DataFrame({"bucket": pdf["bucket"], "id": pdf["id"], "id2": pdf["id2"], "place": place.tolist(), "bins": [bins.tolist()] * len(pdf)})

    return dealt.groupBy("bucket").applyInPandas(run, "bucket int, id long, id2 long, place array<int>, bins array<long>")


def assign(groups: DataFrame, k: int, per_bucket: int = 50_000) -> DataFrame:
    """groups (id, id2, bytes) -> id, id2, shard."""
    importable(groups.sparkSession)
    zeros = F.array_repeat(F.lit(0).cast("long"), k - 1)
    items, maps = groups.select("id", "id2", F.concat(F.array(F.col("bytes").cast("long")), zeros).alias("bins")), []
    n = groups.count()
    while True:
        n_buckets = max(1, -(-n // per_bucket))
        done = cut(_level(items, k, n_buckets), "shard-level")
        maps.append(done.select("bucket", "id", "id2", "place"))
        if n_buckets == 1:
            break
        items = done.groupBy("bucket").agg(F.first("bins").alias("bins")).select(F.col("bucket").cast("long").alias("id"), F.lit(0).cast("long").alias("id2"), "bins")
        n = n_buckets
    # from the top down: which shard each bin of a level's items is
    top = maps.pop().select(F.col("id"), F.col("id2"), F.col("place").alias("bins_shard"))
    while maps:
        up = top.select(F.col("id").cast("int").alias("bucket"), "bins_shard")
        top = maps.pop().join(up, "bucket").select("id", "id2", F.transform("place", lambda p: F.col("bins_shard")[p]).alias("bins_shard"))
    return top.select("id", "id2", F.col("bins_shard")[0].cast("int").alias("shard"))


def shard(docs: DataFrame, k: int = 8, per_bucket: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless in each shard), grown_shard (null)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("id"),
        F.xxhash64(F.lit(1), text).alias("id2"),
    )
    rows = cut(rows, "shard-rows")
    groups = rows.groupBy("id", "id2").agg(F.sum("size").alias("bytes"))
    placed = rows.join(assign(groups, k, per_bucket), ["id", "id2"])
    # Slots without one task per shard: rows are dealt to cells by hash, cells are numbered by prefix sums.
    n_cells = max(1, -(-rows.count() // per_bucket))
    placed = cut(placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "id"), F.lit(n_cells)).cast("int")).drop("id", "id2"), "shard-placed")
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select("shard", "cell", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY cell) - n").alias("before"))
    numbered = placed.withColumn("k", F.expr("row_number() OVER (PARTITION BY shard, cell ORDER BY doc_id, text_crc32)") - 1)
    out = numbered.join(before, ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("k") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
