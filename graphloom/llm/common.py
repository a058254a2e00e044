"""What the operators of this subpackage share: table reads, lineage cuts, joins, let-bindings."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut as cut
from ..scratch import discard as discard
from ..scratch import plain_reads as plain_reads
from ..scratch import scratch as scratch

#: White space as all contracts here have it: space and the five controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_reads(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, and hand them texts in batches of
    fewer rows than Spark's default of 10,000, unless the session has a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once a row, however often ``f`` uses it or inside which lambda."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: together they tell rows apart that share an id or have none."""
    return docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))


def on_key(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


#: Rows of an id and a hash or two that ``few`` broadcasts, at most: about 30 bytes each.
BROADCAST_KEYS = 1_000_000


def few(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast if it has ``BROADCAST_KEYS`` rows at most."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of its variants that ``df`` has no column of (case-insensitive)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def lots(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with about ``most`` bytes of column ``text`` each; a longer text is a slice of its own."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column("text"))).astype(np.int64))
    first = 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(first, last - first)
        first = last
