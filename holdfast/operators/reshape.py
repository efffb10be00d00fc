"""Unions, pivots and ordered presentation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, matched by column name; a column a frame lacks is missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def order_by_list(df: DataFrame, column: str, values: Sequence[str], out: str = "display_order") -> DataFrame:
    """Position of the value in a fixed list; values outside the list are left out."""
    table = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])
    return df.where(F.col(column).isin(list(values))).withColumn(out, table[F.col(column)])


def largest(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(column).desc(), F.col(tie).asc()).limit(n)


def task_columns(contexts: Sequence[str]) -> dict[str, str]:
    """Generated column of each context, by sorted name."""
    return {c: f"target_{i:03d}" for i, c in enumerate(sorted(contexts))}


def to_wide(pairs: DataFrame, entity: str, context: str, value: str, tasks: Mapping[str, str], also: Sequence[str] = ()) -> DataFrame:
    """One row per entity, one column per context; the fixed column list saves the pass that looks for it."""
    wide = pairs.groupBy(entity, *also).pivot(context, list(tasks)).agg(F.max(value))
    return wide.withColumnsRenamed(dict(tasks))


def to_long(wide: DataFrame, keys: Sequence[str], tasks: Mapping[str, str], context: str, value: str) -> DataFrame:
    """Observed cells of a wide table."""
    cells = F.array(*[F.struct(F.lit(c).alias(context), F.col(t).alias(value)) for c, t in tasks.items()])
    return wide.select(*keys, F.inline(cells)).where(F.col(value).isNotNull())


def task_weights(wide: DataFrame, tasks: Mapping[str, str], split: str, train: str = "train") -> DataFrame:
    """Training labels per task and inverse-count weights with mean 1, from one aggregate row."""
    counts = wide.where(F.col(split) == train).agg(*[F.count(t).alias(t) for t in tasks.values()])
    cells = F.array(*[F.struct(F.lit(c).alias("context"), F.lit(t).alias("task"), F.col(t).alias("train_labels")) for c, t in tasks.items()])
    inverse = [F.try_divide(F.lit(1.0), F.col(t).cast("double")) for t in tasks.values()]
    mean = reduce(lambda a, b: a + b, inverse) / F.lit(float(len(inverse)))
    rows = counts.withColumn("mean_inverse", mean).select("mean_inverse", F.inline(cells))
    weight = F.try_divide(F.lit(1.0), F.col("train_labels").cast("double")) / F.col("mean_inverse")
    return rows.select("context", "task", "train_labels", weight.alias("task_weight"))


def pivot_delta(df: DataFrame, index: Sequence[str], column: str, value: str, a: str, b: str) -> DataFrame:
    """Values of two column levels side by side with their difference."""
    pick = lambda level: F.max(F.when(F.col(column) == level, F.col(value)))
    wide = df.groupBy(*index).agg(pick(a).alias("value_a"), pick(b).alias("value_b"))
    return wide.withColumn("delta", F.col("value_a") - F.col("value_b"))


def score_matrix(scores: DataFrame, ids: DataFrame, key: str, parts: Sequence[str], score: str, columns: Mapping[str, str]) -> DataFrame:
    """Scores pivoted on the joined level name, one row per id of the list. ``columns`` maps level name to column."""
    named = scores.withColumn("level", F.concat_ws(":", *parts))
    wide = named.groupBy(key).agg(*[F.max(F.when(F.col("level") == l, F.col(score))).alias(c) for l, c in columns.items()])
    return ids.select(key).join(wide, key, "left")


def catalogue(composition: DataFrame, context: str, sides: Sequence[DataFrame]) -> DataFrame:
    """Context composition with the columns of further context-level tables."""
    return reduce(lambda a, b: a.join(b, context), sides, composition)


def conditional_columns(df: DataFrame, keys: Sequence[str], model: str, wanted: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Per key: out -> average of an expression over the rows of one model."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(F.col(model) == m, e)).alias(out) for out, (m, e) in wanted.items()])
