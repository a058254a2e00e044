"""Counters, gauges and histograms from a table of samples, in one partially aggregated pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Each metric's kind and labels.
METRICS = {
    "requests_total": ("counter", ["endpoint", "method", "status"]),
    "request_duration_seconds": ("histogram", ["endpoint", "method"]),
    "graph_nodes_total": ("gauge", ["graph_id"]),
    "graphs_created_total": ("counter", []),
    "analysis_duration_seconds": ("histogram", ["repo_name"]),
    "analysis_files_total": ("counter", ["repo_name"]),
    "context_requests_total": ("counter", []),
    "context_nodes_returned": ("histogram", ["truncated"]),
    "storage_operations_total": ("counter", ["operation", "status"]),
    "health_checks_total": ("counter", ["endpoint", "status"]),
}
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def exposition(samples: DataFrame) -> DataFrame:
    """metric, labels, series, value from ``samples`` (metric, labels map<string, string>, value, ts, ord).

    A counter is the sum of its increments, a gauge its last value by (ts, ord), a histogram a series for each bound
    (``le=...``, cumulative, up to ``le=+Inf``), its sum and its count. Labels that a metric doesn't have are left out,
    missing ones are empty; samples of unknown metrics, and null values, count nothing."""
    text = None
    for name, (_, labels) in METRICS.items():
        own = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.coalesce(F.col("labels")[x], F.lit("")), F.lit('"')) for x in labels])
        text = F.when(F.col("metric") == name, own) if text is None else text.when(F.col("metric") == name, own)
    kinds = F.create_map(*[F.lit(x) for k, (kind, _) in METRICS.items() for x in (k, kind)])
    known = samples.where(F.col("metric").isin(*METRICS) & F.col("value").isNotNull()).select("metric", text.alias("labels"), F.col("value").cast("double").alias("value"), F.struct("ts", "ord").alias("at"))
    counts = [F.count_if(F.col("value") <= b).cast("double").alias(f"b{i}") for i, b in enumerate(BUCKETS)]
    a = known.groupBy("metric", "labels").agg(F.sum("value").alias("total"), F.count("*").cast("double").alias("n"), F.max_by("value", "at").alias("last"), *counts)
    one = lambda series, value: F.struct(F.lit(series).alias("series"), value.alias("value"))
    histogram = F.array(*[one(f"le={b}", F.col(f"b{i}")) for i, b in enumerate(BUCKETS)], one("le=+Inf", F.col("n")), one("sum", F.col("total")), one("count", F.col("n")))
    kind = kinds[F.col("metric")]
    series = F.when(kind == "histogram", histogram).when(kind == "gauge", F.array(one("value", F.col("last")))).otherwise(F.array(one("value", F.col("total"))))
    return a.select("metric", "labels", F.explode(series).alias("s")).select("metric", "labels", "s.*")
