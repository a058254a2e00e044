"""Renames among deleted and added files, by the similarity of their contents, as git finds them.

A file is a bag of spans (lines, cut after 64 bytes). The similarity of two files is the bytes of the spans they share by the
larger of their sizes. Pairs at 0.5 or more share a span among the first of each file, in one order from rare to frequent, whose
bytes aren't outweighed by the rest; only such pairs are compared. Of these the most similar is taken first, and each file
once: in rounds, as every pair is taken that is the best of both its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut

LEAST = 0.5
#: Bytes of a span at most.
SPAN = 64


def spans(files: DataFrame) -> DataFrame:
    """path, h, size: the bytes of each distinct span of ``files`` (path, content). Carriage returns before line ends don't count."""
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n")  # a character is a byte
    each = files.select("path", F.explode(F.regexp_extract_all(text, F.lit(rf"[^\n]{{0,{SPAN - 1}}}\n|[^\n]{{1,{SPAN}}}"), F.lit(0))).alias("span"))
    return each.groupBy("path", F.xxhash64("span").alias("h")).agg(F.sum(F.length("span")).alias("size"))


def candidates(deleted: DataFrame, added: DataFrame, least: float = LEAST) -> DataFrame:
    """old, new, score: all pairs of files at ``least`` or more, empty ones left out."""
    both = cut(spans(deleted).withColumn("side", F.lit(0)).unionByName(spans(added).withColumn("side", F.lit(1))), "spans")
    often = both.groupBy("h").agg(F.count("*").alias("files"))
    total = both.groupBy("side", "path").agg(F.sum("size").alias("total"))
    order = Window.partitionBy("side", "path").orderBy("files", "h").rowsBetween(0, Window.unboundedFollowing)
    # a span counts while it and what follows have enough bytes for a partner
    first = both.join(often, "h").withColumn("rest", F.sum("size").over(order)).join(total, ["side", "path"]).where(F.col("rest") >= least * F.col("total"))
    side = lambda df, k, name: df.where(F.col("side") == k).withColumnRenamed("path", name)
    sized = (side(first, 0, "old").select("h", "old", F.col("total").alias("a"))).join(side(first, 1, "new").select("h", "new", F.col("total").alias("b")), "h")
    pairs = sized.where(F.least("a", "b") >= least * F.greatest("a", "b")).select("old", "new", "a", "b").distinct()
    x, y = side(both, 0, "old").select("old", "h", F.col("size").alias("x")), side(both, 1, "new").select("new", "h", F.col("size").alias("y"))
    common = pairs.join(x, "old").join(y, ["new", "h"]).groupBy("old", "new", "a", "b").agg(F.sum(F.least("x", "y")).alias("common"))
    return common.select("old", "new", (F.col("common") / F.greatest("a", "b")).alias("score")).where(F.col("score") >= least)


def renames(deleted: DataFrame, added: DataFrame, least: float = LEAST) -> DataFrame:
    """old, new, score: each file in one pair at most. Equal contents come first, then by score; ties go to pairs of one file
    name, then by path."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    whole = lambda df, name: df.where(F.length("content") > 0).select(F.sha2("content", 256).alias("hash"), F.col("path").alias(name))
    same = whole(deleted, "old").join(whole(added, "new"), "hash").select("old", "new", F.lit(2.0).alias("score"))
    left = cut(same.unionByName(candidates(deleted, added, least)).groupBy("old", "new").agg(F.max("score").alias("score")).withColumn("named", base("old") == base("new")), "rename-pairs")
    out = None
    place = F.struct((-F.col("score")).alias("s"), (~F.col("named")).alias("n"), "old", "new")
    while not left.isEmpty():
        best = [left.groupBy(c).agg(F.min(place).alias("p")).select(F.col("p.old").alias("old"), F.col("p.new").alias("new")) for c in ("old", "new")]
        taken = cut(best[0].join(best[1], ["old", "new"]).join(left, ["old", "new"]).select("old", "new", "score"), "renames")
        out = taken if out is None else out.union(taken)
        left = cut(left.join(taken.select("old"), "old", "left_anti").join(taken.select("new"), "new", "left_anti").select(*left.columns), "rename-pairs")
    return left.select("old", "new", "score") if out is None else out.select("old", "new", F.least("score", F.lit(1.0)).alias("score"))


def with_renames(changes: DataFrame, deleted: DataFrame, added: DataFrame, least: float = LEAST) -> DataFrame:
    """``changes`` (path, change_type, old_path) in which a deleted and an added file of one pair are one renamed file.
    ``deleted`` and ``added``: path and content of such files."""
    found = cut(renames(deleted, added, least).select("old", "new"), "renames-found")
    gone = found.select(F.col("old").alias("path"), F.lit("deleted").alias("change_type")).union(found.select("new", F.lit("added")))
    rest = changes.join(gone, ["path", "change_type"], "left_anti").select("path", "change_type", "old_path")
    return rest.union(found.select(F.col("new"), F.lit("renamed"), F.col("old")))
