"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's own setting, else a local one (tests)."""
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lexiloom-"))
        have = context._jsc.sc().getCheckpointDir()
    return have.get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it from there: cuts lineage, survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but as a compressed table, for results of some size."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound an Arrow batch by rows and bytes, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII take the quick path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 2 by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def words_of(text: str) -> list[str]:
    """Words by the contract's six white-space characters (str.split() knows more of them)."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]
