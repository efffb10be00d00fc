"""What the operators share: tables, word counts, row keys and stored intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``materialize`` that also gives back the disk of the job's shuffles as soon as the table is written."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return materialize(df)
    finally:
        conf.set(CLEANUP, before)


def word_count(text: str = "text") -> Column:
    """Number of words of a text (missing: 0)."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def remainder(key: str, divisor: int) -> Column:
    """crc32 of a key written as text, modulo a divisor (missing key: as the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def blocks(df: DataFrame, size: Column, per_block: int) -> int:
    """Number of blocks of about ``per_block`` units that the summed ``size`` of all rows fills, at least one."""
    total = df.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-int(total) // per_block))
