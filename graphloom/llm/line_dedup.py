"""Line dedup by overlapping three-line windows (op 4), with DataFrame functions only.

Each three consecutive lines of a text (``\\n``-split) are hashed to 128 bits. A window found at more
than one place is kept at its first place, by (doc_id, line), and every later occurrence covers its three
lines; covered lines merge into runs and are removed. Repetition inside one document counts too.
Windows without a word are not looked at.

Scale: the windows' first places are found by a partially aggregated group-by, so a line that a third of all
rows share costs one row per map task. The join back has a unique side, and adaptive execution splits
the other side's hot partitions. Only positions travel; the texts are shuffled once, for the last join.

Defined cases: a null text stays null; texts under three lines and empty ones stay as they are; repeated rows
(same id, same text) are one document; null ids sort before all others; other columns are ignored
by ``removals`` and kept by ``dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keyed, let, on_key

BLANK = r"^[\x20\x09-\x0D]*$"


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, pos, h1, h2: one row for each three consecutive lines."""
    lines = let(F.split("text", "\n"), lambda a: F.slice(F.arrays_zip(a, F.slice(a, 2, F.size(a)), F.slice(a, 3, F.size(a))), 1, F.greatest(F.size(a) - 2, F.lit(0))))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text_key", F.posexplode(lines).alias("pos", "w"))
    a, b, c = (F.col("w").getField(k) for k in rows.schema["w"].dataType.names)
    rows = rows.where(~F.concat(a, b, c).rlike(BLANK))
    return rows.select("doc_id", "text_key", "pos", F.xxhash64(a, b, c).alias("h1"), F.xxhash64(F.lit(1), c, b, a).alias("h2"))


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, starts: the sorted first lines of all windows that occur earlier."""
    w = _windows(keyed(docs))
    first = w.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_key", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = w.join(first, ["h1", "h2"]).where(~F.struct("doc_id", "text_key", "pos").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def _cleaned(text: Column, starts: Column) -> Column:
    """struct(n_lines, n_removed, n_spans, text)."""

    def out(lines: Column, covered: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        inner = F.size(F.array_intersect(covered, F.transform(covered, lambda p: p + 1)))
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            F.size(covered).cast("long").alias("n_removed"),
            (F.size(covered) - inner).cast("long").alias("n_spans"),
            F.when(F.size(covered) == 0, text).otherwise(F.array_join(F.transform(kept, lambda i: lines[i]), "\n")).alias("text"),
        )

    covered = F.array_distinct(F.flatten(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda s: F.array(s, s + 1, s + 2))))
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n_lines", "n_removed", "n_spans")], F.lit(None).cast("string").alias("text"))
    return F.when(text.isNull(), none).otherwise(let(F.split(text, "\n"), lambda lines: let(covered, lambda c: out(lines, c))))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans (maximal runs of removed lines), text (what is left)."""
    d, r = keyed(docs), removals(docs)
    both = d.join(r, on_key(d, r), "left").select(d["doc_id"], _cleaned(d["text"], r["starts"]).alias("c"))
    return both.select("doc_id", "c.*")


def dedup(docs: DataFrame, length_column: str | None = None) -> DataFrame:
    """``docs`` with the lines removed from ``text``, all other columns as they were; ``length_column``,
    where given, gets the new text's length."""
    key, r = fresh(docs, "text_key"), removals(docs)
    d = docs.withColumn(key, F.xxhash64("text"))
    new = fresh(d, "new_text")
    joined = d.join(r, d["doc_id"].eqNullSafe(r["doc_id"]) & (d[key] == r["text_key"]), "left").select(*[d[c] for c in docs.columns], _cleaned(d["text"], r["starts"])["text"].alias(new))
    out = [F.col(new).alias(c) if c == "text" else F.length(new).cast(docs.schema[c].dataType).alias(c) if c == length_column else F.col(c) for c in docs.columns]
    return joined.select(*out)
