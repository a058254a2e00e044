"""Differences of two snapshots, keyed merges and path replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import dealt


def node_changes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """key, change: added, removed or changed (any other shared column differs, null-safe)."""
    shared = [c for c in old.columns if c in new.columns and c != key]
    a, b = old.select(key, F.struct(*shared).alias("a")), new.select(key, F.struct(*shared).alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full").select(key, kind.alias("change")).where("change IS NOT NULL")


def edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """source, target, type, change, as sets: lines and repetitions don't count; ``ord`` is the first of an edge."""
    key = ["source", "target", "type"]
    sides = old.select(*key, "ord").withColumn("side", F.lit(1)).unionByName(new.select(*key, "ord").withColumn("side", F.lit(2)))
    seen = dealt(sides, sides.count(), *key).groupBy(*key).agg(F.bit_or("side").alias("s"), F.min("ord").alias("ord"))
    return seen.where("s < 3").select(*key, F.when(F.col("s") == 1, "removed").otherwise("added").alias("change"), "ord")


def content_hash(df: DataFrame, key: str = "id") -> DataFrame:
    """key, hash: SHA-256 of the JSON of all other columns in name order, nulls included."""
    cols = sorted(c for c in df.columns if c != key)
    return df.select(key, F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias("hash"))


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces rows of ``base`` with its keys; among equal keys of ``new`` the last by ``ord`` counts."""
    if "ord" in new.columns:
        rest = [c for c in new.columns if c not in (*keys, "ord")]
        new = new.groupBy(*keys).agg(F.max(F.struct("ord", *rest)).alias("n")).select(*keys, "n.*")
        new = new if "ord" in base.columns else new.drop("ord")
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(new.dropDuplicates(keys).join(base.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def replace_paths(nodes: DataFrame, new: DataFrame, paths: list[str]) -> DataFrame:
    """All nodes of ``paths`` go, ``new`` comes."""
    return nodes.where(~F.col("path").isin(paths)).unionByName(new)
