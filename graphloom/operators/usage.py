"""Usage, budget and history analytics over event tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERIODS = {"day": 1, "week": 7, "month": 30}
KINDS = {"click": "context_request", "view": "semantic_search", "signup": "sync_event"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as usage events: user_id, event_type, tokens, ts."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.coalesce(kind[F.col("event_type")], "event_type").alias("event_type"), F.floor("value").cast("long").alias("tokens"), "ts")


def aggregate(e: DataFrame, keys: list[str]) -> DataFrame:
    """requests, tokens and the three counted kinds; without keys one row of zeros for no events."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return e.groupBy(*keys).agg(F.count("*").alias("requests"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), n("context_request").alias("context_requests"), n("semantic_search").alias("semantic_searches"), n("sync_event").alias("sync_events"))


def budget(b: DataFrame, keys: list[str]) -> DataFrame:
    """Means and savings against three times the tokens used; zeros for no events."""
    used = F.coalesce(F.sum("used"), F.lit(0)).cast("long")
    return b.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("used"), F.lit(0.0)), 6).alias("mean_used"), (3 * used).alias("naive"), (2 * used).alias("saved"), F.when(used > 0, F.round(F.lit(200.0) / 3, 4)).otherwise(0.0).alias("saved_percent"))


def periods(e: DataFrame, now: datetime.datetime) -> DataFrame:
    """period, user_id, n, tokens; an event counts in each period that reaches back to it."""
    hits = F.array_compact(F.array(*[F.when(F.col("ts") >= F.lit(now - datetime.timedelta(days=k)), p) for p, k in PERIODS.items()]))
    return e.select("user_id", "tokens", F.explode(hits).alias("period")).groupBy("period", "user_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def blame(lines: DataFrame) -> DataFrame:
    """file, primary_author, contributors, author_distribution from (file, author, ord); ties go to the first seen."""
    c = lines.groupBy("file", "author").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "author", "n")))
    return c.groupBy("file").agg(F.max_by("author", F.struct("n", -F.col("first"))).alias("primary_author"), F.transform(ordered, lambda x: x["author"]).alias("contributors"), F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["author"], x["n"]))).alias("author_distribution"))


def change_frequency(commits: DataFrame, now: datetime.datetime, days: int = 90, hot: int = 10) -> DataFrame:
    """file, commits, hot from (file, at)."""
    return commits.where(F.col("at") >= F.lit(now - datetime.timedelta(days=days))).groupBy("file").agg(F.count("*").alias("commits")).withColumn("hot", F.col("commits") > hot)


def trend(runs: DataFrame) -> DataFrame:
    """run, n, change against the run before. The runs are few: one row for each day or build."""
    return runs.selectExpr("run", "n", "n - lag(n) OVER (ORDER BY run) AS change")
