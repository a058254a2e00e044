"""The shared folder for intermediate tables, and lineage cuts through it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a fresh folder only for local sessions that set none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    was = spark.sparkContext._jsc.sc().getCheckpointDir()
    if was.isDefined():
        return was.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(root)
    return root


def plain_reads(spark: SparkSession) -> None:
    """Read Parquet's column chunks through Spark's own buffers for the rest of the session.

    Vectored reads of local files go through direct buffers that each reading thread keeps, one for each size of chunk
    it has met: memory outside the heap that grows with the number of files read."""
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


#: Lets a query's shuffle files go when it ends; nothing can need them once its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, lost executors cost nothing, and
    the shuffles behind it are deleted. ``codec``: Parquet's, where the session's won't do."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    plain_reads(spark)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)
    written = spark.read.schema(df.schema).parquet(path)
    written.cut_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once their last reader is done."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows that a task aggregates by key, about, where few of them are equal: some 100 MB.
KEYED_ROWS = 500_000


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` (``n`` rows, about) by ``keys``, in as many partitions as a group-by's tasks have memory for. The number of
    partitions grows with the rows, and no task aggregates before the shuffle, where its share is a file's split."""
    return df.repartition(max(1, -(-n // KEYED_ROWS)), *keys)
