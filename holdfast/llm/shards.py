"""Shuffle all rows into shards, in two passes over data larger than memory.

The first pass scatters the rows uniformly into buckets that fit in a task's memory, by seeded hashes. The
second pass shuffles each bucket by Fisher and Yates and writes it. The buckets, one behind the other, are one
random order of all rows; shard s of S takes the places from floor(s * N / S) on, so the numbers of rows of two
shards differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CLEANUP, stored

BUCKET = 8 << 20  # bytes of a bucket
OVERHEAD = 64  # bytes a row takes besides its text
RUN = 1024  # buckets whose totals are added up together


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text (missing: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _scattered(df: DataFrame, seed: int, buckets: int) -> DataFrame:
    """The buckets of every row of (``row_key``, ``n``, ...): one copy by its hash; several go round from there, ``times`` to a bucket."""
    start = F.pmod(F.xxhash64(F.lit(seed), "row_key"), F.lit(buckets))
    single = F.array(F.struct(start.alias("bucket"), F.lit(1).cast("long").alias("times")))
    more, rest = F.floor(F.col("n") / buckets), F.col("n") % buckets
    turns = F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(buckets)) - 1)
    several = F.transform(turns, lambda j: F.struct(((start + j) % buckets).alias("bucket"), (more + (j < rest).cast("long")).alias("times")))
    return df.select("*", F.inline(F.when(F.col("n") == 1, single).otherwise(several)))


def _starts(counts: DataFrame) -> DataFrame:
    """Place of each bucket's first row and the number of all rows. Sums run inside a run of buckets and over the runs' totals."""
    runs = counts.withColumn("run", F.floor(F.col("bucket") / RUN))
    before = W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    totals = runs.groupBy("run").agg(F.sum("n").alias("of_run")).withColumns(
        {"before": F.coalesce(F.sum("of_run").over(before), F.lit(0)), "total": F.sum("of_run").over(W.partitionBy())}
    )
    inside = W.partitionBy("run").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    own = runs.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return own.join(totals, "run").select("bucket", (F.col("before") + F.col("inside")).alias("start"), "total")


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A seeded random order of 0 to n - 1: from the last place down, each changes with a random one up to it."""
    order = list(range(n))
    draws = np.random.default_rng(seed).integers(0, np.arange(n, 0, -1)) if n else []
    for last, j in zip(range(n - 1, -1, -1), draws, strict=True):
        order[last], order[j] = order[j], order[last]
    return np.array(order, np.int64)


def _clear(columns: list[str]) -> dict[str, str]:
    """Names of the columns beside ``shard`` and ``slot``."""
    names, taken = {}, {c.lower() for c in columns} | {"shard", "slot"}
    for c in columns:
        name = c
        while name.lower() in ("shard", "slot") or name != c and name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        names[c] = name
    return names


def write_shards(docs: DataFrame, path: str, shards: int, seed: int, text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Write all rows to ``path`` in ``shards`` folders (Parquet), each file in the order of its ``slot``; returns them read back.

    Adds ``shard`` and ``slot`` (0, 1, ... without gaps in each shard); columns of docs with these names become
    ``shard_in`` and ``slot_in``. The order depends on the seed and the rows alone, not on files or tasks, so a
    repeated task writes the same. Rows equal in all columns are counted first and dealt over the buckets, so they
    may be a third of the table. A missing text is kept and has size 1; a text above the bucket's size makes a
    bucket longer; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if docs.columns else F.struct(F.lit(0))
    keyed = docs.select(record.alias("record"), (text_size(text) + OVERHEAD).alias("weight"))
    keyed = keyed.withColumn("row_key", F.md5(F.to_json("record").cast("binary")))
    keys = stored(keyed.groupBy("row_key").agg(F.count(F.lit(1)).alias("n"), F.any_value("weight").alias("weight")))
    weight = keys.agg(F.sum(F.col("n") * F.col("weight"))).first()[0] or 0
    buckets = max(1, -(-int(weight) // bucket))
    starts = stored(_starts(_scattered(keys, seed, buckets).groupBy("bucket").agg(F.sum("times").alias("n"))))

    repeated = keys.where(F.col("n") > 1).select("row_key", "n")
    rows = keyed.select("row_key", "record", F.lit(1).cast("long").alias("n"))
    if not repeated.isEmpty():
        repeated = stored(repeated)
        once = keyed.select("row_key", "record").join(repeated, "row_key", "left_semi")
        once = once.groupBy("row_key").agg(F.any_value("record").alias("record"), F.count(F.lit(1)).alias("n"))
        rows = rows.join(repeated, "row_key", "left_anti").unionByName(once)
    scattered = _scattered(rows, seed, buckets).select("bucket", "row_key", "times", "record")

    def shuffled(rows: pa.Table, place: pa.Table) -> pa.Table:
        rows = rows.sort_by("row_key")
        each = np.repeat(np.arange(len(rows)), rows["times"].to_numpy())
        if not len(each):
            return pa.table({"shard": pa.array([], pa.int32()), "slot": pa.array([], pa.int64()), "record": rows["record"].slice(0, 0)})
        order = each[fisher_yates(len(each), [seed, rows["bucket"][0].as_py()])]
        start, total = place["start"][0].as_py(), place["total"][0].as_py()
        at = start + np.arange(len(order))
        shard = ((at + 1) * shards - 1) // total
        slot = at - shard * total // shards
        return pa.table({"shard": pa.array(shard.astype(np.int32)), "slot": pa.array(slot), "record": rows["record"].combine_chunks().take(pa.array(order))})

    of_record = keyed.schema["record"].dataType.simpleString()
    out = scattered.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(shuffled, f"shard int, slot long, record {of_record}")
    flat = out.select("shard", "slot", *[F.col(f"record.`{c}`").alias(n) for c, n in _clear(docs.columns).items()])
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        flat.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(flat.schema).parquet(path)
