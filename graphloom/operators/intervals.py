"""Points in intervals by key, without the product of a key's points and intervals.

Lines are cut into bins of several widths. An interval lies in the bins of the least width at which it touches
``BINS`` at most; a point looks into one bin of each width in use. So a path with any number of nodes and queries is dealt
out by bins, and rows meet only within one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least width, the ratio of one width to the next, their number, and the most bins of an interval.
WIDTH, RATIO, LEVELS, BINS = 64, 8, 8, 4


def _bin(at: Column, level: int) -> Column:
    return F.floor(at / F.lit(WIDTH * RATIO**level)).cast("long")


def _binned(intervals: DataFrame, low: str, high: str) -> DataFrame:
    """``intervals`` with level_ and bin_, a row for each bin; intervals without a bound or that end before they start have none."""
    a, b = F.col(low), F.col(high)
    level, bins = None, None
    for k in range(LEVELS):  # the widest takes all that is left
        fits = (_bin(b, k) - _bin(a, k) < BINS) if k < LEVELS - 1 else F.lit(True)
        level = F.when(fits, k) if level is None else level.when(fits, k)
        span = F.sequence(_bin(a, k), _bin(b, k))
        bins = F.when(fits, span) if bins is None else bins.when(fits, span)
    return intervals.where(a <= b).withColumns({"level_": level, "bin_": F.explode(bins)})


def _pointed(points: DataFrame, at: str, levels: list[int]) -> DataFrame:
    bins = F.array(*[F.struct(F.lit(k).alias("level_"), _bin(F.col(at), k).alias("bin_")) for k in levels])
    return points.withColumn("b_", F.explode(bins)).select(*points.columns, "b_.level_", "b_.bin_")


def _levels(binned: DataFrame) -> list[int]:
    return sorted(r.level_ for r in binned.select("level_").distinct().collect()) or [0]  # LEVELS at most


def containing(points: DataFrame, intervals: DataFrame, key: str, at: str, low: str, high: str) -> DataFrame:
    """``points`` (with ``key`` and ``at``) beside each interval of the key that contains them, bounds included. Other columns have names of their own."""
    binned = _binned(intervals, low, high)
    hit = _pointed(points, at, _levels(binned)).join(binned, [key, "level_", "bin_"])
    return hit.where(F.col(at).between(F.col(low), F.col(high))).drop("level_", "bin_")


def hit_by(intervals: DataFrame, points: DataFrame, key: str, at: str, low: str, high: str) -> DataFrame:
    """``intervals`` that contain a point; a row of ``intervals`` is told by all its columns, equal rows come once."""
    binned = _binned(intervals, low, high)
    p = _pointed(points.select(F.col(key).alias("key_"), F.col(at).alias("at_")), "at_", _levels(binned)).withColumnsRenamed({"level_": "l_", "bin_": "n_"})
    on = (binned[key] == p["key_"]) & (binned["level_"] == p["l_"]) & (binned["bin_"] == p["n_"]) & p["at_"].between(binned[low], binned[high])
    return binned.join(p, on, "left_semi").select(*intervals.columns).distinct()
