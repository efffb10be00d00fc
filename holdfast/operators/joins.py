"""Joins with a stated contract. Physical join choice is left to the size checks of the optimizer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contracts import check_unique, enforce


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "n:1") -> DataFrame:
    """Equi-join that fails when a side declared as "one" repeats a key."""
    on = [on] if isinstance(on, str) else list(on)
    many_left, many_right = validate.split(":")
    if many_left == "1":
        enforce(check_unique(left.select(*on), on, "left key repeats"))
    if many_right == "1":
        enforce(check_unique(right.select(*on), on, "right key repeats"))
    return left.join(right, on, how)


def map_column(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str, value: str, out: str, fallback: str | None = None) -> DataFrame:
    """Dictionary lookup; a key without an entry is missing, or keeps the fallback column."""
    pairs = lookup.select(F.col(lookup_key).alias("map_key"), F.col(value).alias("map_value"))
    joined = df.join(pairs, df[key] == F.col("map_key"), "left")
    mapped = F.col("map_value") if fallback is None else F.coalesce(F.col("map_value"), F.col(fallback))
    return joined.withColumn(out, mapped).drop("map_key", "map_value")


def flag_membership(df: DataFrame, key: str, corpus: DataFrame, corpus_key: str, out: str) -> DataFrame:
    """True where the key occurs in the corpus."""
    known = corpus.select(F.col(corpus_key).alias("member_key")).where(F.col("member_key").isNotNull()).distinct()
    joined = df.join(known, df[key] == F.col("member_key"), "left")
    return joined.withColumn(out, F.col("member_key").isNotNull()).drop("member_key")


def restrict(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return df.join(keys, on, "left_semi")


def exclude(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return df.join(keys, on, "left_anti")


def join_all_matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Left join together with the check that every left row found its partner."""
    marked = right.withColumn("partner_found", F.lit(True))
    joined = left.join(marked, list(on), "left")
    check = joined.agg(F.count_if(F.col("partner_found").isNull()).alias("violations")).select(
        F.lit("unmatched rows").alias("check"), F.col("violations")
    )
    return joined.drop("partner_found"), check


def attach_flags(df: DataFrame, flags: DataFrame, on: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Attach entity-level flags; a row without an entry gets False."""
    joined = df.join(flags.select(*on, *names), list(on), "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in names})


def crosswalk(labels: DataFrame, mapping: DataFrame, counts: DataFrame, label: str, context: str, fill: Mapping[str, object], rules: Sequence[tuple[Column, str]], default: str, out: str) -> DataFrame:
    """Map external labels to contexts, add the counts of each context (0 if absent) and classify the result."""
    joined = labels.join(mapping, label, "left").join(counts, context, "left")
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
    status = F.lit(default)
    for condition, name in reversed(list(rules)):
        status = F.when(condition, F.lit(name)).otherwise(status)
    return filled.withColumn(out, status)


def complete_grid(dimension: DataFrame, level: str, levels: Sequence[str], facts: DataFrame, on: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Every dimension row at every level, joined to the facts, missing counts set to 0."""
    grid = dimension.withColumn(level, F.explode(F.array(*[F.lit(v) for v in levels])))
    joined = grid.join(facts, [level, *on], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in fill})


def pair_models(df: DataFrame, keys: Sequence[str], model: str, candidate: str, reference: str, columns: Sequence[str]) -> DataFrame:
    """Candidate and reference rows of the same key side by side, keys having both only; one shuffle, no self-join."""
    tags = {"candidate": candidate, "reference": reference}
    picked = df.where(F.col(model).isin(candidate, reference))
    aggs = [F.max(F.when(F.col(model) == m, F.col(c))).alias(f"{c}_{tag}") for tag, m in tags.items() for c in columns]
    wide = picked.groupBy(*keys).agg(F.countDistinct(model).alias("models"), *aggs)
    return wide.where(F.col("models") == 2).drop("models").withColumns(
        {f"delta_{c}": F.col(f"{c}_candidate") - F.col(f"{c}_reference") for c in columns}
    )
