"""Benchmark decontamination by item-sized windows (op 2), with DataFrame functions only.

A document is contaminated by an item if some window of as many words as the item has at least
``similarity`` weighted-shingle similarity with it: over ``width``-word shingles, the sum of the smaller counts by the
sum of the larger counts. Texts are lower-cased (A to Z) and cut at white space.

Windows: a similar window has a least number of places whose shingle is one of the item's; every window with so many
is looked at, and no others are generated. Verification: the exact similarity of each of them. The 64-bit SimHash
distance of window and item is reported and drops nothing: no radius is both narrow and complete at similarity 0.8.

Scale: documents' shingles stream past the benchmark's in one map when those are broadcast, which happens only
below ``BROADCAST_SHINGLES`` rows (counted first); beyond, both sides are shuffled by shingle. Windows of hit documents
alone are built. A passage in a third of all documents adds rows in proportion to those documents.

Defined cases: null and empty texts match nothing; items without a word are ignored, items under ``width`` words are
one shingle; documents shorter than an item are compared whole; repeated rows, of documents or of items, give one result; texts of
one item_id, or of none, are one item, and its best window counts; null ids are kept; a very long text is cut into words
in one row, its windows are rows of their own without the text, and of equal windows only the first is looked at (told apart by 96 bits of hashes); other columns are ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few, fresh, keyed, let, lower_ascii, on_key, words

#: About 40 bytes each: 40 MB on an executor at most.
BROADCAST_SHINGLES = 1_000_000


def _tokens(text: Column) -> Column:
    return words(lower_ascii(text))


def _shingle_rows(df: DataFrame, keep: list[str], width: int) -> DataFrame:
    """``keep``, pos, h (a hash of the ``width`` words from pos on); ``df`` has ``w``, the words."""
    zipped = F.slice(F.arrays_zip(F.col("w"), *[F.slice("w", k + 1, F.size("w")) for k in range(1, width)]), 1, F.size("w") - (width - 1))
    rows = df.where(F.size("w") >= width).select(*keep, F.posexplode(zipped).alias("pos", "s"))
    parts = [F.col("s").getField(n) for n in rows.schema["s"].dataType.names]
    return rows.select(*keep, "pos", F.xxhash64(F.lit(width), *parts).alias("h"))


def _simhash(w: Column) -> Column:
    """64-bit majority of the words' XXH64, as long."""

    def bit(hs: Column, b: int) -> Column:
        ones = F.size(F.filter(hs, lambda h: F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1).cast("long")) == 1))
        return F.when(2 * ones > F.size(hs), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))

    def all_bits(hs: Column) -> Column:
        out = bit(hs, 0)
        for b in range(1, 64):
            out = out.bitwiseOR(bit(hs, b))
        return out

    return let(F.transform(w, lambda x: F.xxhash64(x)), all_bits)


def _blocks(fp: Column, n: int) -> Column:
    """(block, value) structs: the 64 bits cut into ``n`` runs of nearly equal length."""
    cuts = [64 * k // n for k in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(k).alias("block"), fp.bitwiseAND(F.lit(m).cast("long")).alias("value")) for k, m in enumerate(signed)])


def _shingles(w: Column, width: Column) -> Column:
    """All runs of ``width`` words, joined by a space (which no word has)."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, width), " "))


def _similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller counts by sum of the larger ones."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return let(common, lambda n: n / (F.size(a) + F.size(b) - n))


def _starts(at: Column, n: Column, size: Column, k: int, similarity: float) -> Column:
    """Starts of all windows that can be similar: ``at`` has the places, in order, of the document's shingles that the item has."""
    own, item = F.least(n, size) - (k - 1), size - (k - 1)
    need = F.greatest(F.lit(1), F.ceil(F.lit(similarity) * (own + item) / (1 + similarity) - 1e-9).cast("int"))
    last = n - F.least(n, size)
    first = F.slice(at, 1, F.greatest(F.lit(0), F.size(at) - need + 1))

    def run(p: Column, i: Column) -> Column:
        """Windows that begin after the place before ``p`` and hold ``p`` and the next ``need`` - 1 places."""
        low = F.greatest(F.lit(0), F.element_at(at, i + need) - own + 1, F.when(i > 0, F.element_at(at, F.greatest(i, F.lit(1))) + 1).otherwise(0))
        high = F.least(p, last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(first, run))


def matches(docs: DataFrame, items: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, text_key, item_id, start (word), n_words, distance (bits), similarity: each pair's best window, the first among equals."""
    d = keyed(docs)
    it = items.select("item_id", _tokens(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    it = cut(it.select(F.monotonically_increasing_id().alias("item"), "item_id", "w", F.size("w").alias("size"), F.least(F.size("w"), F.lit(width)).alias("k"), _simhash(F.col("w")).alias("item_fp")), "bench-items")

    tokens = d.select("doc_id", "text_key", _tokens(F.col("text")).alias("w"))
    found = None
    for (k,) in sorted(it.select("k").distinct().collect()):  # at most ``width`` values; one unless there are tiny items
        own = _shingle_rows(it.where(F.col("k") == k), ["item", "size"], k).select("h", "item", "size").distinct()
        if own.count() <= BROADCAST_SHINGLES:
            own = F.broadcast(own)
        rows = _shingle_rows(tokens.withColumn("n", F.size("w")), ["doc_id", "text_key", "n"], k)
        part = rows.join(own, "h").groupBy("doc_id", "text_key", "n", "item", "size").agg(F.array_sort(F.collect_set("pos")).alias("at"))
        starts = F.explode(_starts(F.col("at"), F.col("n"), F.col("size"), k, similarity))
        part = part.select("doc_id", "text_key", "item", "size", starts.alias("start"))
        found = part if found is None else found.union(part)
    if found is None:
        found = tokens.select("doc_id", "text_key", F.lit(0).cast("long").alias("item"), F.size("w").alias("size"), F.lit(0).alias("start")).limit(0)
    hits = cut(found.distinct(), "bench-hits")

    # texts without a hit are not shuffled
    hit = few(hits.select("doc_id", "text_key").distinct())
    texts = cut(d.join(hit, on_key(d, hit), "left_semi").select("doc_id", "text_key", _tokens(F.col("text")).alias("w")).distinct(), "bench-texts")

    def of_windows(found: DataFrame, value: Callable[[Column], Column]) -> DataFrame:
        """doc_id, text_key, item, size, start, value of a window's words. Words are sliced inside the text's row, so no window carries the text."""
        at = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item", "size", "start")).alias("at")).withColumnsRenamed({"doc_id": "id_", "text_key": "key_"})
        both = texts.join(at, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_"))).select("doc_id", "text_key", "w", "at")
        own = F.transform("at", lambda a: F.struct(a["item"].alias("item"), a["size"].alias("size"), a["start"].alias("start"), value(F.slice("w", a["start"] + 1, a["size"])).alias("value")))
        return both.select("doc_id", "text_key", F.explode(own).alias("a")).select("doc_id", "text_key", "a.*")

    # of windows with the same words the first is enough: a repetitive text has few different ones
    first = of_windows(hits, lambda w: F.struct(F.xxhash64(w).alias("h"), F.hash(w).alias("h2"))).groupBy("doc_id", "text_key", "item", "size", "value").agg(F.min("start").alias("start"))
    windows = of_windows(first, lambda w: w).withColumnRenamed("value", "w")
    windows = cut(windows.withColumn("fp", _simhash(F.col("w"))), "bench-windows")

    pairs = windows.select("doc_id", "text_key", "item", "start", "w", "fp")
    both = pairs.join(it.select("item", "item_id", F.col("w").alias("own"), "k", "item_fp"), "item").withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    value = let(_shingles(F.col("w"), F.col("k")), lambda a: let(_shingles(F.col("own"), F.col("k")), lambda b: _similarity(a, b)))
    judged = both.select("doc_id", "text_key", "item_id", "start", F.size("w").alias("n_words"), "distance", value.alias("similarity")).where(F.col("similarity") >= similarity)
    best = judged.groupBy("doc_id", "text_key", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words", "distance")).alias("best"))
    return best.select("doc_id", "text_key", "item_id", F.col("best.start").cast("long").alias("start"), F.col("best.n_words").cast("long").alias("n_words"), F.col("best.distance").cast("long").alias("distance"), (-F.col("best.s")).alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    m = few(cut(matches(docs, items, similarity, width).select("doc_id", "text_key").distinct(), "bench-found"))
    key = fresh(docs, "text_key")
    d = docs.withColumn(key, F.xxhash64("text"))
    return d.join(m, d["doc_id"].eqNullSafe(m["doc_id"]) & (d[key] == m["text_key"]), "left_anti").select(*docs.columns)
