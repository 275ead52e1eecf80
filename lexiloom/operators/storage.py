"""Tables between the steps of one operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, as in tests, a local one, which only a local master can share."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", have)
    return have


#: Has a query's shuffle files removed when it ends; else they lie on the executors' disks until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share, and read from it: computed once, and safe from lost executors.

    The folder is the session's spark.checkpoint.dir; only where that is unset, as in tests, is it a local one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)


def scratch(spark: SparkSession) -> str | None:
    """A new folder in the shared one, for files that tasks write and read by path; None where that is no file system with paths."""
    have = shared_folder(spark)
    if not have.startswith("file:") and not (have.startswith("/") and spark.sparkContext.master.startswith("local")):
        return None
    path = f"/{have.removeprefix('file:').lstrip('/')}/scratch-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


#: Rows of a table that is broadcast; larger ones are joined by shuffle.
MOST_SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, settled, with a broadcast hint where a count shows that it has few rows."""
    df = settled(df)
    return F.broadcast(df) if df.count() <= MOST_SMALL else df


def spread(df: DataFrame) -> DataFrame:
    """df for work that costs far more than sending its rows: dealt out to all cores where it comes in fewer partitions than there are cores (a few
    small files, or files of one row group), as it is where there are more."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and partitions(df) < cores else df


def partitions(df: DataFrame) -> int:
    """Partitions of df. Of rows that were dealt out to a given number it is that number: asking the physical plan would run their shuffle."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if plan.nodeName() == "RepartitionByExpression" and plan.optNumPartitions().isDefined():
        return plan.numPartitions()
    return df._jdf.queryExecution().toRdd().getNumPartitions()


#: Bytes of a table's files whose rows, or what is counted in them, one task behind a shuffle takes.
PART = 8 << 20


def parted(df: DataFrame, *by: str) -> DataFrame:
    """df by columns in so many partitions that their size, and so a task's memory, doesn't follow the size of the files that df comes from; left as many
    as the session says where these are small or not known. Partitions of a given number aren't put together again by their compressed size."""
    n = parts_of(df)
    return df.repartition(n, *by) if n else df.repartition(*by)


def ranged(df: DataFrame, by: str) -> DataFrame:
    """parted(), in sampled ranges of a column."""
    n = parts_of(df)
    return df.repartitionByRange(n, by) if n else df.repartitionByRange(by)


def parts_of(df: DataFrame) -> int | None:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    n = -(-size // PART)
    return n if df.sparkSession.sparkContext.defaultParallelism < n < MOST_PARTS else None


#: Partitions of a shuffle, beyond which a size is taken for unknown.
MOST_PARTS = 20_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by a key, for rows that lie in few of their table's partitions, as those of a range of ids do; its texts are shuffled once."""
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, parts), key)
