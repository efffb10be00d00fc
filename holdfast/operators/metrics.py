"""Baselines, calibrated intervals, point metrics and coverage audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import COVERAGE
from ..functions.scalar import covered, error_columns
from .ordered import Hot, find_hot, group_quantiles, kth_smallest, level_kth_smallest, spearman

POINT_METRICS = ["mae", "rmse", "spearman", "within_one", "within_two"]


def median_baseline(train: DataFrame, keys: Sequence[str], target: str, out: str = "y_pred", hot: Hot | None = None) -> DataFrame:
    """Median target of the training rows per key."""
    return group_quantiles(train, keys, target, {out: 0.5}, hot=hot)


def balanced_weights(df: DataFrame, by: str, out: str = "weight") -> DataFrame:
    """Inverse-frequency weights with mean 1: rows / (groups * rows of the group)."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("group_n"))
    total = counts.agg((F.sum("group_n") / F.count(F.lit(1))).alias("v")).scalar()
    return df.join(counts.withColumn(out, total / F.col("group_n")).drop("group_n"), by)


def group_weights(df: DataFrame, by: str, within: Sequence[str] = (), out: str = "weight") -> DataFrame:
    """The weights of :func:`balanced_weights` as a table of the groups, separately for every value of the ``within`` columns."""
    counts = df.groupBy(*within, by).agg(F.count(F.lit(1)).alias("group_n"))
    scope = W.partitionBy(*(within or [F.lit(0)]))
    total = F.sum("group_n").over(scope) / F.count(F.lit(1)).over(scope)
    return counts.select(*within, by, (total / F.col("group_n")).alias(out))


def conformal_rank(n: Column, coverage: float = COVERAGE) -> Column:
    """Rank of the calibration residual that gives the finite-sample coverage."""
    return F.least(n, F.ceil((n + 1).cast("double") * F.lit(float(coverage))))


def conformal_quantile(df: DataFrame, by: Sequence[str], residual: str, coverage: float = COVERAGE, out: str = "q", hot: Hot | None = None) -> DataFrame:
    """Finite-sample quantile of the calibration residuals of each group."""
    return kth_smallest(df, by, residual, lambda n: conformal_rank(n, coverage), out, hot).drop(f"{out}_n")


def conformal_quantiles(df: DataFrame, levels: Mapping[str, Sequence[str]], residual: str, cuts: int, coverage: float = COVERAGE) -> dict[str, DataFrame]:
    """The same under several groupings of large tables, as ``q``."""
    found = level_kth_smallest(df, levels, residual, lambda n: conformal_rank(n, coverage), cuts)
    return {name: found[name].drop(f"{name}_n").withColumnRenamed(name, "q") for name in levels}


def apply_intervals(test: DataFrame, pooled: DataFrame, by_context: DataFrame, run: Sequence[str], context: str) -> DataFrame:
    """Pooled and context-wise interval ends; a context without calibration rows has no context-wise interval."""
    out = test.join(pooled.withColumnRenamed("q", "q_pooled"), list(run)).join(
        by_context.withColumnRenamed("q", "q_context"), [*run, context], "left"
    )
    p = F.col("y_pred")
    return out.withColumns(
        {
            "lower": p - F.col("q_pooled"),
            "upper": p + F.col("q_pooled"),
            "lower_context": p - F.col("q_context"),
            "upper_context": p + F.col("q_context"),
        }
    )


def regression_metrics(df: DataFrame, keys: Sequence[str], truth: str = "y_true", guess: str = "y_pred", extra: Sequence[Column] = (), hot: Hot | None = None) -> DataFrame:
    """Row count, MAE, RMSE, rank correlation and within-one / within-two shares per key."""
    scored = error_columns(df, truth, guess)
    points = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("absolute_error").alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg("within_one").alias("within_one"),
        F.avg("within_two").alias("within_two"),
        *extra,
    )
    return points.join(spearman(df, keys, truth, guess, hot=hot), list(keys), "left")


def interval_aggregates() -> list[Column]:
    """Coverage and width aggregates of both calibration methods, for :func:`regression_metrics`."""
    return [
        F.avg(covered("y_true", "lower", "upper")).alias("coverage"),
        F.avg(F.col("upper") - F.col("lower")).alias("width"),
        F.avg(covered("y_true", "lower_context", "upper_context")).alias("coverage_context"),
        F.avg(F.col("upper_context") - F.col("lower_context")).alias("width_context"),
    ]


def macro_mean(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str], count: str = "n") -> DataFrame:
    """Unweighted mean of context metrics; missing ones are skipped metric by metric."""
    return metrics.groupBy(*keys).agg(F.sum(count).alias(count), *[F.avg(c).alias(c) for c in columns])


def scoped_metrics(pred: DataFrame, run: Sequence[str], context: str) -> DataFrame:
    """Context rows, the pooled row and the macro row of every run in one table."""
    columns = [*POINT_METRICS, "coverage", "width", "coverage_context", "width_context"]
    hot = find_hot(pred, run)
    own = regression_metrics(pred, [*run, context], extra=interval_aggregates(), hot=hot.within()).withColumn("scope", F.lit("context"))
    pooled = regression_metrics(pred, run, extra=interval_aggregates(), hot=hot).withColumns(
        {context: F.lit("__pooled__"), "scope": F.lit("pooled")}
    )
    macro = macro_mean(own, run, columns).withColumns({context: F.lit("__macro__"), "scope": F.lit("macro")})
    order = [*run, "scope", context, "n", *columns]
    return own.select(*order).unionByName(pooled.select(*order)).unionByName(macro.select(*order))


def coverage_by_context(pred: DataFrame, run: Sequence[str], context: str, lower: str = "lower", upper: str = "upper") -> DataFrame:
    return pred.groupBy(*run, context).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(covered("y_true", lower, upper)).alias("coverage"),
        F.avg(F.col(upper) - F.col(lower)).alias("width"),
        F.sum(covered("y_true", lower, upper)).alias("hits"),
        F.sum(F.col(upper) - F.col(lower)).alias("width_sum"),
        F.count(F.col(upper) - F.col(lower)).alias("width_n"),
    )


def coverage_audit(pred: DataFrame, run: Sequence[str], context: str, nominal: float = COVERAGE, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Pooled and equal-context coverage of each run with its spread over contexts.

    Pooled values come from the sums of the context rows, so predictions are aggregated once.
    The second level has one row per context, hence the plain quantile aggregate.
    """
    own = coverage_by_context(pred, run, context, lower, upper)
    return own.groupBy(*run).agg(
        (F.sum("hits") / F.sum("n")).alias("pooled_coverage"),
        F.avg("coverage").alias("macro_coverage"),
        F.percentile("coverage", F.lit(0.5)).alias("coverage_median"),
        F.percentile("coverage", F.lit(0.25)).alias("coverage_q25"),
        F.percentile("coverage", F.lit(0.75)).alias("coverage_q75"),
        F.min("coverage").alias("coverage_min"),
        F.max("coverage").alias("coverage_max"),
        F.count_if(F.col("coverage") >= nominal).alias("contexts_at_nominal"),
        F.count(F.lit(1)).alias("contexts"),
        F.try_divide(F.sum("width_sum"), F.sum("width_n")).alias("mean_width"),
        F.avg("width").alias("macro_width"),
    )


def coverage_weighting(pred: DataFrame, run: Sequence[str], entity: str) -> DataFrame:
    """Coverage with pairs weighted equally and with entities weighted equally."""
    own = pred.groupBy(*run, entity).agg(
        F.count(F.lit(1)).alias("n"), F.sum(covered("y_true", "lower", "upper")).alias("hits")
    )
    return own.groupBy(*run).agg(
        F.sum("n").alias("pairs"),
        F.count(F.lit(1)).alias("entities"),
        (F.sum("hits") / F.sum("n")).alias("pair_weighted_coverage"),
        F.avg(F.col("hits") / F.col("n")).alias("equal_entity_coverage"),
    )


def compare_intervals(pred: DataFrame, run: Sequence[str], context: str) -> DataFrame:
    """Coverage audit of both calibration methods; the rows are read once, each giving one row per method."""
    ends = F.array(
        F.struct(F.lit("pooled").alias("method"), F.col("lower").alias("lo"), F.col("upper").alias("hi")),
        F.struct(F.lit("context_wise").alias("method"), F.col("lower_context").alias("lo"), F.col("upper_context").alias("hi")),
    )
    long = pred.select(*run, context, "y_true", F.inline(ends))
    return coverage_audit(long, [*run, "method"], context, lower="lo", upper="hi")


def replicate_audit(pairs: DataFrame, count: str = "n_records", spread: str = "target_iqr") -> DataFrame:
    """How many pairs rest on repeated records and how far these spread."""
    base = pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col(count) >= 2).alias("repeated_pairs"),
        F.avg((F.col(count) >= 2).cast("double")).alias("repeated_fraction"),
        F.max(F.when(F.col(count) >= 2, F.col(spread))).alias("repeated_spread_max"),
    )
    one = pairs.withColumn("whole", F.lit(1))
    counts = group_quantiles(one, ["whole"], count, {"records_median": 0.5, "records_p90": 0.9})
    spreads = group_quantiles(
        one.where(F.col(count) >= 2), ["whole"], spread, {"repeated_spread_median": 0.5, "repeated_spread_q75": 0.75}
    )
    return base.withColumn("whole", F.lit(1)).join(counts, "whole").join(spreads, "whole").drop("whole")


def quality_group(count: str = "n_records", spread: str = "target_iqr") -> Column:
    return (
        F.when(F.col(count) == 1, "single_record").when(F.col(spread) == 0, "repeated_zero_spread").otherwise("repeated_nonzero_spread")
    )


def error_by_quality(pred: DataFrame, run: Sequence[str], count: str = "n_records", spread: str = "target_iqr") -> DataFrame:
    """Errors of each run by record-quality group, with the group's median record count and spread."""
    keys = [*run, "quality"]
    scored = error_columns(pred).withColumn("quality", quality_group(count, spread))
    points = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("absolute_error").alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg("within_two").alias("within_two"),
    )
    hot = find_hot(scored, keys)
    return points.join(group_quantiles(scored, keys, count, {"median_records": 0.5}, hot=hot), keys).join(
        group_quantiles(scored, keys, spread, {"median_spread": 0.5}, hot=hot), keys
    )


def spread_error_correlation(pred: DataFrame, run: Sequence[str], count: str = "n_records", spread: str = "target_iqr") -> DataFrame:
    """Rank correlation of spread and absolute error over the pairs with repeated records."""
    repeated = error_columns(pred.where(F.col(count) >= 2))
    sizes = repeated.groupBy(*run).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(spearman(repeated, run, spread, "absolute_error"), list(run), "left")


def ensemble_scores(scores: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Mean and population deviation of a score over seeds."""
    return scores.groupBy(*keys).agg(F.avg(score).alias("score"), F.stddev_pop(score).alias("score_sd"))


def support_range(metrics: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Smallest, mean and largest test support over seeds."""
    return metrics.groupBy(*keys).agg(F.min(count).alias("n_min"), F.avg(count).alias("n_mean"), F.max(count).alias("n_max"))


def label_contract(df: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Distinct label values, missing cells, repeated ids, positive cells and positive rows of a label table."""
    def total(columns: list[Column]) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = out + c
        return out

    cells = df.select(F.explode(F.array(*[F.col(c).cast("int") for c in labels])).alias("v"))
    values = cells.where(F.col("v").isNotNull()).agg(F.countDistinct("v").alias("v")).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.countDistinct(key)).alias("repeated_ids"),
        total([F.count_if(F.col(c).isNull()) for c in labels]).alias("missing_cells"),
        total([F.count_if(F.col(c) == 1) for c in labels]).alias("positive_cells"),
        F.count_if(F.greatest(*labels) == 1).alias("positive_rows"),
    ).withColumn("distinct_values", values)


def cost_summary(runs: DataFrame, keys: Sequence[str], mean: Sequence[str], total: Sequence[str], largest: Sequence[str], first: Mapping[str, str]) -> DataFrame:
    """Mean, sum, maximum and first value of run-log columns per key."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.avg(c).alias(f"{c}_mean") for c in mean],
        *[F.sum(c).alias(f"{c}_sum") for c in total],
        *[F.max(c).alias(f"{c}_max") for c in largest],
        *[F.min_by(c, o).alias(f"{c}_first") for c, o in first.items()],
    )
