"""Katz backoff language model and document scores (op 6).

Counts of 1- to ``order``-grams of the training tokens are discounted by Good-Turing up to count ``K``, and what
the discounts free goes to unseen continuations through backoff weights that normalise exactly: for each history,
the probabilities of all V known tokens and of the one unknown sum to 1. Each order's table is
written to the shared folder; scoring joins tokens with the highest order and sends on only those
that it hasn't seen, with their history's weight, to the next lower one.

A token's n-gram of order k is known by the 64-bit hash of its k tokens; its history is the n-gram of order
k - 1 before it. One start mark precedes each text, and is history only.

Where Good-Turing gives no discount strictly between 0 and 1 (small or gappy counts of counts), half a count
is discounted instead. A history none of whose counts is discounted gets one more in its denominator.

Scale: counts are partially aggregated before each shuffle, joins have one side with unique keys, and adaptive
execution splits a hot n-gram's partition on the other. Nothing but the counts of counts (``K`` + 1
numbers an order) and two totals reaches the driver.

Defined cases: a null or empty text is its end token alone; repeated rows each count and get the same score; null
ids are training rows; without training tokens every token is unknown and ``score`` is null, as is ``base_score``;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, words

K = 5
#: Neither can be a word.
START, END = " ", "\n"


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """crc32 of the id's digits leaves ``fold``; false for null."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def grams(docs: DataFrame, order: int) -> DataFrame:
    """row, held_out, k1..k<order>, n: each token's n-grams, counted by row. Short histories stop at the start mark."""
    toks = F.concat(F.array_repeat(F.lit(START), order - 1), words(lower_ascii(F.coalesce("text", F.lit("")))), F.array(F.lit(END)))
    rows = docs.select("row", "held_out", toks.alias("t"))
    zipped = F.slice(F.arrays_zip(*[F.slice("t", k + 1, F.size("t")) if k else F.col("t") for k in range(order)]), 1, F.size("t") - (order - 1))
    rows = rows.select("row", "held_out", F.explode(zipped).alias("g"))
    parts = [F.col("g").getField(n) for n in rows.schema["g"].dataType.names]
    return rows.select("row", "held_out", *[F.xxhash64(*parts[order - k :]).alias(f"k{k}") for k in range(1, order + 1)], *[F.xxhash64(*parts[order - k : -1]).alias(f"h{k}") for k in range(2, order + 1)])


def discounts(counts: DataFrame) -> dict[int, float]:
    of = {r.c: r.n for r in counts.where(F.col("c") <= K + 1).groupBy("c").agg(F.count("*").alias("n")).collect()}
    return good_turing([of.get(r, 0) for r in range(1, K + 2)])


def good_turing(counts_of_counts: list[int]) -> dict[int, float]:
    """r -> what a count of r is multiplied by, for r up to K, from how many n-grams have counts 1 to K + 1."""
    n = [0, *counts_of_counts]
    out = {}
    for r in range(1, K + 1):
        d = -1.0
        if n[1] and n[r]:
            rest = (K + 1) * n[K + 1] / n[1]
            if rest < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _discounted(c: Column, d: dict[int, float]) -> Column:
    out = c.cast("double")
    for r, x in d.items():
        out = F.when(c == r, F.lit(r * x)).otherwise(out)
    return out


class Model:
    """tables[k - 1]: order k's n-grams (key, p); weights[k - 1]: its histories (key, alpha); unknown: P of the unknown token."""

    def __init__(self, tables: list[DataFrame], weights: list[DataFrame | None], counts: DataFrame, total: int, known: int, unknown: float):
        self.tables, self.weights, self.counts, self.total, self.known, self.unknown = tables, weights, counts, total, known, unknown


def train(tokens: DataFrame, order: int) -> Model:
    """``tokens`` as ``grams`` gives them, training rows only."""
    uni = cut(tokens.groupBy(F.col("k1").alias("key")).agg(F.count("*").alias("c")), "lm-1")
    total, known = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    d = discounts(uni)
    freed = uni.agg(F.sum(F.col("c") - _discounted(F.col("c"), d))).first()[0] or 0.0
    bottom = total if freed > 0 else total + 1
    tables: list[DataFrame] = [uni.select("key", (_discounted(F.col("c"), d) / F.lit(float(bottom or 1))).alias("p"))]
    weights: list[DataFrame | None] = [None]
    for k in range(2, order + 1):
        counts = cut(tokens.groupBy(F.col(f"k{k}").alias("key"), F.col(f"h{k}").alias("h"), F.col(f"k{k - 1}").alias("low")).agg(F.count("*").alias("c")), f"lm-{k}-counts")
        d = discounts(counts)
        mass = counts.withColumn("m", _discounted(F.col("c"), d)).join(tables[-1].withColumnRenamed("key", "low").withColumnRenamed("p", "p_low"), "low")
        hist = mass.groupBy("h").agg(F.sum("c").alias("n"), F.sum("m").alias("kept"), F.sum("p_low").alias("low"))
        bottom = F.when(F.col("kept") < F.col("n"), F.col("n")).otherwise(F.col("n") + 1)
        hist = cut(hist.select("h", bottom.cast("double").alias("bottom"), ((1 - F.col("kept") / bottom) / (1 - F.col("low"))).alias("alpha")), f"lm-{k}-weights")
        tables.append(cut(counts.join(hist, "h").select("key", (_discounted(F.col("c"), d) / F.col("bottom")).alias("p")), f"lm-{k}"))
        weights.append(hist.select(F.col("h").alias("key"), "alpha"))
    return Model(tables, weights, uni, total, known, freed / total if freed > 0 else 1 / (total + 1))


def log_probabilities(tokens: DataFrame, m: Model, order: int) -> DataFrame:
    """row, lp: sums of log10 P of the tokens, a part for each order at which tokens were found."""
    left, parts = tokens.withColumn("lw", F.lit(0.0)), []
    for k in range(order, 0, -1):
        found = left.join(m.tables[k - 1].withColumnRenamed("key", f"k{k}"), f"k{k}", "left")
        rest = F.lit(m.unknown) if k == 1 else None
        if k == 1:
            parts.append(found.groupBy("row").agg(F.sum(F.col("lw") + F.log10(F.coalesce("p", rest))).alias("lp")))
            break
        parts.append(found.where("p IS NOT NULL").groupBy("row").agg(F.sum(F.col("lw") + F.log10("p")).alias("lp")))
        lower = [f"k{j}" for j in range(1, k)] + [f"h{j}" for j in range(2, k)]
        unseen = found.where("p IS NULL").select("row", "lw", f"h{k}", *lower)
        backed = unseen.join(m.weights[k - 1].withColumnRenamed("key", f"h{k}"), f"h{k}", "left")
        left = backed.select("row", (F.col("lw") + F.log10(F.coalesce("alpha", F.lit(1.0)))).alias("lw"), *lower)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def score_table(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Bigram models go by blocks."""
    if order == 2:
        from .katz_bigrams import score_bigrams

        return score_bigrams(docs)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), held_out(F.col("doc_id")).alias("held_out"))
    tokens = grams(rows, order)
    m = train(tokens.where("NOT held_out"), order)
    # rows of equal id and text are one row in what follows; each still counted in training
    once = grams(rows.dropDuplicates(["row"]), order) if rows.count() > rows.select("row").distinct().count() else tokens
    lp = log_probabilities(once.drop("held_out"), m, order).groupBy("row").agg(F.sum("lp").alias("score"))
    per_word = once.groupBy("row", F.col("k1").alias("key")).agg(F.count("*").alias("n")).join(m.counts, "key", "left")
    c = F.coalesce("c", F.lit(0))
    base = per_word.groupBy("row").agg(
        F.sum("n").alias("n_tokens"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("n") * F.log10((c + 0.5) / F.lit(m.total + 0.5 * (m.known + 1)))).alias("base_score"),
    )
    some = F.lit(m.total > 0)
    return (
        rows.select("doc_id", "held_out", "row")
        .join(base.join(lp, "row"), "row")
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m.total).cast("long").alias("train_tokens"), F.when(some, F.col("base_score")).alias("base_score"), F.when(some, F.col("score")).alias("score"))
    )
