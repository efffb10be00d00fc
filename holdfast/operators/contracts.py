"""Contract checks. Each returns rows (check, violations); ``enforce`` turns them into a failure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from ..functions.seeding import seeded_key


class ContractError(ValueError):
    """Raised by :func:`enforce` with the failed checks."""


def _report(df: DataFrame, check: str) -> DataFrame:
    """One row from a one-column count aggregate."""
    return df.select(F.lit(check).alias("check"), F.coalesce(F.col("violations"), F.lit(0)).cast("bigint").alias("violations"))


def check_unique(df: DataFrame, keys: Sequence[str], check: str = "unique") -> DataFrame:
    """Rows beyond the first of each key."""
    counts = df.groupBy(*keys).count()
    return _report(counts.agg(F.sum(F.col("count") - 1).alias("violations")), check)


def check_function(df: DataFrame, key: str | Sequence[str], value: str, check: str = "function", count_null: bool = False) -> DataFrame:
    """Keys with more than one distinct value; a missing value counts as a value on request."""
    keys = [key] if isinstance(key, str) else list(key)
    pairs = df.select(*keys, value).distinct()
    if not count_null:
        pairs = pairs.where(F.col(value).isNotNull())
    return _report(pairs.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("violations")), check)


def check_covered(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str | None = None, check: str = "covered") -> DataFrame:
    """Distinct keys without a row in the lookup."""
    names = lookup.select(F.col(lookup_key or key).alias(key))
    missing = df.where(F.col(key).isNotNull()).select(key).distinct().join(names, key, "left_anti")
    return _report(missing.agg(F.count(F.lit(1)).alias("violations")), check)


def check_finite(df: DataFrame, columns: Sequence[str], check: str = "finite") -> DataFrame:
    """Cells that are missing, NaN or infinite."""
    bad = [F.count_if(~is_finite(c)) for c in columns]
    return _report(df.agg(reduce(lambda a, b: a + b, bad).alias("violations")), check)


def check_domain(df: DataFrame, columns: Sequence[str], values: Sequence, check: str = "domain") -> DataFrame:
    """Cells that are missing or outside the allowed values."""
    bad = [F.count_if(F.coalesce(~F.col(c).isin(list(values)), F.lit(True))) for c in columns]
    return _report(df.agg(reduce(lambda a, b: a + b, bad).alias("violations")), check)


def check_constant(df: DataFrame, by: Sequence[str], column: str, check: str = "constant") -> DataFrame:
    """Groups in which the column does not have exactly one value."""
    counts = df.groupBy(*by).agg(F.countDistinct(column).alias("values"))
    return _report(counts.agg(F.count_if(F.col("values") != 1).alias("violations")), check)


def check_counts(df: DataFrame, expected: Mapping[str, tuple[object, object]]) -> DataFrame:
    """One row per expectation name -> (aggregate column, expected value)."""
    one = df.agg(*[agg.cast("bigint").alias(name) for name, (agg, _) in expected.items()])
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.col(name).alias("observed"), F.lit(int(value)).cast("bigint").alias("expected"))
            for name, (_, value) in expected.items()
        ]
    )
    return one.select(F.inline(rows)).withColumn("violations", (F.col("observed") != F.col("expected")).cast("bigint"))


def check_replay(new: DataFrame, old: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float) -> DataFrame:
    """One row per column: unmatched keys, largest absolute difference, and whether the replay passes."""
    a = new.select(*keys, F.lit(1).alias("in_new"), *[F.col(c).alias(f"{c}_new") for c in columns])
    b = old.select(*keys, F.lit(1).alias("in_old"), *[F.col(c).alias(f"{c}_old") for c in columns])
    joined = a.join(b, list(keys), "full")
    unmatched = F.count_if(F.col("in_new").isNull() | F.col("in_old").isNull())
    aggs = [unmatched.alias("unmatched")]
    for c in columns:
        gap = F.abs(F.col(f"{c}_new") - F.col(f"{c}_old"))
        aggs += [F.max(gap).alias(f"{c}_gap"), F.count_if(~is_finite(gap)).alias(f"{c}_bad")]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col("unmatched"),
                F.col(f"{c}_gap").alias("max_difference"),
                ((F.col("unmatched") == 0) & (F.col(f"{c}_bad") == 0) & (F.col(f"{c}_gap") <= tolerance)).alias("passed"),
            )
            for c in columns
        ]
    )
    return joined.agg(*aggs).select(F.inline(rows))


def check_aligned(prepared: DataFrame, predicted: DataFrame, keys: Sequence[str], check: str = "aligned") -> DataFrame:
    """Keys whose row counts differ between the prepared and the predicted table."""
    a = prepared.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_prepared"))
    b = predicted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_predicted"))
    differs = F.coalesce("n_prepared", F.lit(0)) != F.coalesce("n_predicted", F.lit(0))
    return _report(a.join(b, list(keys), "full").agg(F.count_if(differs).alias("violations")), check)


def fingerprint(df: DataFrame, key: str, split: str, by: str) -> DataFrame:
    """Order-independent fingerprint of an assignment per ``by``: row count and summed row hashes.

    Row hashes are added, so the work is combined on the map side and no group is collected.
    """
    digits = seeded_key(F.col(key), F.col(split))
    words = [F.conv(F.substring(digits, start, 8), 16, 10).cast("decimal(20,0)") for start in (1, 9, 17, 25)]
    sums = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(w).alias(f"word_{i}") for i, w in enumerate(words)]
    )
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"word_{i}").cast("string") for i in range(4)])
    return sums.select(by, "rows", F.sha2(text, 256).alias("fingerprint"))


def enforce(report: DataFrame) -> None:
    """Fail if any check of the (small) report has violations."""
    failed = report.where(F.col("violations") > 0).collect()
    if failed:
        raise ContractError("; ".join(f"{r['check']}: {r['violations']}" for r in failed))
