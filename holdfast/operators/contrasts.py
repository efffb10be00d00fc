"""Summaries over seeds and contexts, paired contrasts and their t intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import EPSILON
from ..functions.student import t_975
from .joins import pair_models
from .ordered import spearman

# Metrics for which a smaller value is better.
LOWER_IS_BETTER = ["mae", "rmse", "width", "width_context"]


def seed_summary(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str], seed: str = "seed") -> DataFrame:
    """Mean and sample deviation of each metric over seeds."""
    return metrics.groupBy(*keys).agg(
        F.countDistinct(seed).alias("seeds"),
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_samp(c).alias(f"{c}_sd") for c in columns],
    )


def melt(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keep, F.inline(cells))


def t_interval(df: DataFrame, keys: Sequence[str], value: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Count, mean, sample deviation and two-sided 95 % t limits; no limits below two values."""
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), *extra
    )
    half = F.when(F.col("n") > 1, t_975(F.col("n") - 1) * F.col("sd") / F.sqrt(F.col("n").cast("double")))
    return sums.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def favourable(metric: Column, difference: Column) -> Column:
    """Whether a difference (candidate minus reference) is an improvement of that metric, beyond rounding noise."""
    return F.when(metric.isin(LOWER_IS_BETTER), difference < -EPSILON).otherwise(difference > EPSILON)


def paired_contrast(metrics: DataFrame, contrasts: Sequence[tuple[str, str]], unit: Sequence[str], columns: Sequence[str], by: Sequence[str] = (), model: str = "model") -> DataFrame:
    """Per contrast and metric: mean paired difference over units, t limits, favourable units.

    All contrasts come from one shuffle: each row is copied to the contrasts its model takes part in.
    """
    pairs = F.filter(
        F.array(
            *[
                F.when(F.col(model) == F.lit(m), F.struct(F.lit(a).alias("candidate"), F.lit(b).alias("reference"), F.lit(s).alias("sign")))
                for a, b in contrasts
                for m, s in ((a, 1), (b, -1))
            ]
        ),
        lambda x: x.isNotNull(),
    )
    long = melt(metrics, [*by, *unit, model], columns).withColumn("side", F.explode(pairs)).select(
        *by, *unit, "side.*", "metric", "value"
    )
    diffs = long.groupBy(*by, *unit, "candidate", "reference", "metric").agg(
        F.sum(F.col("sign") * F.col("value")).alias("difference"), F.count("value").alias("sides")
    ).where(F.col("sides") == 2)
    return t_interval(
        diffs,
        [*by, "candidate", "reference", "metric"],
        "difference",
        [F.count_if(favourable(F.col("metric"), F.col("difference"))).alias("favourable")],
    )


def interaction(metrics: DataFrame, cells: Mapping[str, tuple[str, str]], first: str, second: str, unit: str, column: str, model: str = "model") -> DataFrame:
    """Difference between two effects, each itself a paired difference: (a1 - b1) - (a2 - b2) per unit, then t limits.

    ``cells`` maps an effect name to (candidate, reference). Only units that have a value of every model count.
    """
    signs = {}
    for name, sign in ((first, 1), (second, -1)):
        for m, s in zip(cells[name], (1, -1)):
            signs[m] = signs.get(m, 0) + sign * s
    weight = F.create_map(*[F.lit(x) for pair in signs.items() for x in pair])
    values = metrics.where(F.col(model).isin(list(signs))).groupBy(unit).agg(
        F.sum(weight[F.col(model)] * F.col(column)).alias("difference"),
        F.countDistinct(F.when(F.col(column).isNotNull(), F.col(model))).alias("cells"),
    ).where(F.col("cells") == len(signs)).drop("cells")
    out = t_interval(values.withColumn("interaction", F.lit(f"{first} minus {second}")), ["interaction"], "difference",
                     [F.count_if(F.col("difference") > 0).alias("positive_units")])
    return out


def delta_summary(deltas: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Equal-context mean, median, deviation, t limits and sign counts of paired deltas.

    One row per context and delta goes in, hence the plain median aggregate.
    """
    long = melt(deltas, keys, columns, "contrast", "delta")
    return t_interval(
        long,
        [*keys, "contrast"],
        "delta",
        [
            F.percentile("delta", F.lit(0.5)).alias("median"),
            F.count_if(F.col("delta") < 0).alias("below_zero"),
            F.count_if(F.col("delta") > 0).alias("above_zero"),
        ],
    )


def context_deltas(metrics: DataFrame, context: str, candidate: str, reference: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per context: metrics averaged over seeds, then candidate minus reference."""
    means = metrics.groupBy(*by, context, "model").agg(*[F.avg(c).alias(c) for c in columns])
    return pair_models(means, [*by, context], "model", candidate, reference, columns)


def improving_share(deltas: DataFrame, delta: str) -> DataFrame:
    return deltas.agg(
        F.count(delta).alias("contexts"),
        F.count_if(F.col(delta) < 0).alias("improving"),
        F.avg((F.col(delta) < 0).cast("double")).alias("improving_share"),
        F.avg(delta).alias("macro_delta"),
    )


def support_sensitivity(metrics: DataFrame, keys: Sequence[str], count: str, thresholds: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """Macro metrics over the contexts with at least t test rows, for each t."""
    reached = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col(count))
    long = metrics.withColumn("least_support", F.explode(reached))
    return long.groupBy("least_support", *keys).agg(
        F.count(F.lit(1)).alias("contexts"), *[F.avg(c).alias(f"{c}_macro") for c in columns]
    )


def association_grid(df: DataFrame, predictors: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Rank correlation of every predictor with every outcome, missing pairs left out."""
    left = melt(df, [*outcomes], predictors, "predictor", "x")
    cells = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes])
    long = left.select("predictor", "x", F.inline(cells)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    counts = long.groupBy("predictor", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(spearman(long, ["predictor", "outcome"], "x", "y"), ["predictor", "outcome"], "left")


def overwrite_from(table: DataFrame, canonical: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replace columns by the canonical table's values where it has a row."""
    right = canonical.select(*keys, *[F.col(c).alias(f"{c}_canonical") for c in columns])
    joined = table.join(right, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(f"{c}_canonical"), F.col(c)) for c in columns}).drop(
        *[f"{c}_canonical" for c in columns]
    )


def group_error_contrast(errors: DataFrame, keys: Sequence[str], flag: str, entity: str, value: str, seed: str = "seed") -> DataFrame:
    """Mean error of flagged and unflagged entities per seed, then its stability over seeds."""
    per_seed = errors.groupBy(*keys, seed).agg(
        F.count_if(F.col(flag)).alias("n_flagged"),
        F.count_if(~F.col(flag)).alias("n_other"),
        F.avg(F.when(F.col(flag), F.col(value))).alias("flagged"),
        F.avg(F.when(~F.col(flag), F.col(value))).alias("other"),
        F.avg(value).alias("overall"),
    ).withColumns({"delta": F.col("flagged") - F.col("other"), "shift": F.col("overall") - F.col("other")})
    union = errors.where(F.col(flag)).groupBy(*keys).agg(F.countDistinct(entity).alias("flagged_union"))
    base = per_seed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seeds"),
        F.min("n_flagged").alias("n_flagged_min"), F.max("n_flagged").alias("n_flagged_max"), F.avg("n_flagged").alias("n_flagged_mean"),
        F.min("n_other").alias("n_other_min"), F.max("n_other").alias("n_other_max"), F.avg("n_other").alias("n_other_mean"),
        F.avg("flagged").alias("flagged_mean"), F.avg("other").alias("other_mean"), F.avg("overall").alias("overall_mean"),
    )
    out = base.join(union, list(keys), "left").withColumn("flagged_union", F.coalesce("flagged_union", F.lit(0)))
    for name in ("delta", "shift"):
        stats = t_interval(per_seed, keys, name).select(
            *keys, F.col("mean").alias(f"{name}_mean"), F.col("sd").alias(f"{name}_sd"),
            F.col("ci_low").alias(f"{name}_low"), F.col("ci_high").alias(f"{name}_high"),
        )
        out = out.join(stats, list(keys), "left")
    return out
