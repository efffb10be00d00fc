"""Baseline predictions, intervals, metrics, contrasts and audits of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import SUPPORT_THRESHOLDS
from ..functions.scalar import error_columns
from ..operators import contrasts, diversity, joins, metrics, reshape
from ..operators.ordered import spearman as grouped_spearman
from ..session import materialize
from ..sources.io import table
from .bindings import MODELS, RUN, calibrate, entities, guesses, labelled, predictions, records, targets
from .curation_queries import PAIR_KEYS, cohort_pairs
from .registry import query
from .sql import CTES, spearman, t_stats
from .split_queries import LOO_SQL, loo_metrics, loo_predictions

POINTS = ["mae", "rmse", "spearman", "within_one", "within_two"]
QUALITY = ("n_records", "target_iqr")
ALL_METRICS = [*POINTS, "coverage", "width", "coverage_context", "width_context"]


def context_metrics(spark, d, wanted=tuple(MODELS)):
    return metrics.regression_metrics(predictions(spark, d, wanted=wanted), [*RUN, "context"], extra=metrics.interval_aggregates())


def macro_metrics(spark, d, wanted=tuple(MODELS)):
    return metrics.macro_mean(context_metrics(spark, d, wanted), RUN, ALL_METRICS)


_MELT = ", ".join(f"'{m}'" for m in ALL_METRICS)
CTES["tall_macro"] = f"SELECT model, seed, unnest([{_MELT}]) AS metric, unnest([{', '.join(ALL_METRICS)}]) AS value FROM macro_metrics"


@query(
    "macro_baseline_report",
    "SELECT seed, n, mae, rmse, within_one, within_two, coverage, width, coverage_context, width_context FROM macro_metrics WHERE model = 'context_median'",
    ["mae", "rmse", "within_one", "within_two", "coverage", "width", "coverage_context", "width_context"],
)
def macro_baseline_report(spark, d):
    """Flagship: equal-context errors and coverage of the context-median baseline under every partition."""
    return macro_metrics(spark, d, ["context_median"]).drop("model", "spearman")


@query("context_median_predictions", "SELECT model, seed, entity, context, split, y_pred, target AS y_true FROM guesses", ["y_pred", "y_true"])
def context_median_predictions(spark, d):
    """Median baselines for the calibration and test rows."""
    return guesses(labelled(spark, d)).select("model", "seed", "entity", "context", "split", "y_pred", "y_true")


@query(
    "error_columns",
    "SELECT model, seed, sum(y_pred - y_true) AS error, sum(absolute_error) AS absolute_error, count(*) FILTER (absolute_error <= 1) AS within_one, count(*) FILTER (absolute_error <= 2) AS within_two FROM predictions GROUP BY ALL",
    ["error", "absolute_error"],
)
def error_sums(spark, d):
    """Signed and absolute errors and within-k indicators, summed per run."""
    return error_columns(predictions(spark, d)).groupBy(*RUN).agg(
        F.sum("error").alias("error"), F.sum("absolute_error").alias("absolute_error"),
        F.sum("within_one").cast("bigint").alias("within_one"), F.sum("within_two").cast("bigint").alias("within_two"),
    )


@query("pooled_conformal_quantile", "SELECT model, seed, q_pooled AS q FROM q_pooled", ["q"])
def pooled_conformal_quantile(spark, d):
    """Finite-sample residual quantile of each run."""
    rows = guesses(labelled(spark, d)).where("split = 'valid'")
    return metrics.conformal_quantile(rows.withColumn("residual", F.abs(F.col("y_true") - F.col("y_pred"))), RUN, "residual")


@query("context_conformal_quantile", "SELECT model, seed, context, q_context AS q FROM q_context", ["q"])
def context_conformal_quantile(spark, d):
    """The same per context."""
    rows = guesses(labelled(spark, d)).where("split = 'valid'")
    residuals = rows.withColumn("residual", F.abs(F.col("y_true") - F.col("y_pred")))
    return metrics.conformal_quantile(residuals, [*RUN, "context"], "residual")


_PRED = ["model", "seed", "entity", "context", "y_true", "y_pred", "lower", "upper", "lower_context", "upper_context"]


@query("interval_predictions", f"SELECT {', '.join(_PRED)} FROM predictions", _PRED[4:])
def interval_predictions(spark, d):
    """Test predictions with pooled and context-wise intervals."""
    return calibrate(guesses(labelled(spark, d))).select(*_PRED)


@query("context_metrics", "SELECT * FROM context_metrics", ALL_METRICS)
def context_metric_table(spark, d):
    """Errors, rank correlation and coverage per run and context."""
    return context_metrics(spark, d)


@query(
    "scoped_metrics",
    f"""
SELECT model, seed, 'context' AS scope, context, n, {', '.join(ALL_METRICS)} FROM context_metrics
UNION ALL SELECT model, seed, 'pooled', '__pooled__', n, {', '.join(ALL_METRICS)} FROM pooled_metrics
UNION ALL SELECT model, seed, 'macro', '__macro__', n, {', '.join(ALL_METRICS)} FROM macro_metrics""",
    ALL_METRICS,
)
def scoped_metrics(spark, d):
    """Context, pooled and macro rows in one table."""
    return metrics.scoped_metrics(predictions(spark, d), RUN, "context")


@query(
    "seed_summary",
    f"SELECT model, count(DISTINCT seed) AS seeds, {', '.join(f'avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_sd' for m in POINTS)} FROM macro_metrics GROUP BY model",
    [f"{m}_{s}" for m in POINTS for s in ("mean", "sd")],
)
def seed_summary(spark, d):
    """Mean and deviation of the macro metrics over seeds."""
    return contrasts.seed_summary(macro_metrics(spark, d), ["model"], POINTS)


@query("seed_t_intervals", t_stats("tall_macro", "model, metric", "value"), ["mean", "sd", "ci_low", "ci_high"])
def seed_t_intervals(spark, d):
    """Mean and t limits of every macro metric over seeds."""
    return contrasts.t_interval(contrasts.melt(macro_metrics(spark, d), ["model"], ALL_METRICS), ["model", "metric"], "value")


_COVER = ["pooled_coverage", "macro_coverage", "coverage_median", "coverage_q25", "coverage_q75", "coverage_min", "coverage_max", "mean_width", "macro_width"]


def _coverage_sql(hit: str, width: str, keys: str = "model, seed", source: str = "predictions") -> str:
    return f"""SELECT {keys}, sum(h) / sum(n) AS pooled_coverage, avg(c) AS macro_coverage, quantile_cont(c, 0.5::DOUBLE) AS coverage_median,
 quantile_cont(c, 0.25::DOUBLE) AS coverage_q25, quantile_cont(c, 0.75::DOUBLE) AS coverage_q75, min(c) AS coverage_min, max(c) AS coverage_max,
 count(*) FILTER (c >= 0.9) AS contexts_at_nominal, count(*) AS contexts, sum(ws) / sum(wn) AS mean_width, avg(w) AS macro_width
 FROM (SELECT {keys}, context, count(*) AS n, sum({hit}) AS h, avg({hit}) AS c, avg({width}) AS w, sum({width}) AS ws, count({width}) AS wn FROM {source} GROUP BY {keys}, context) GROUP BY {keys}"""


@query("coverage_audit", _coverage_sql("hit", "upper - lower"), _COVER)
def coverage_audit(spark, d):
    """Pooled and equal-context coverage of every run."""
    return metrics.coverage_audit(predictions(spark, d), RUN, "context")


@query(
    "coverage_weighting",
    """SELECT model, seed, sum(n)::BIGINT AS pairs, count(*) AS entities, sum(h) / sum(n) AS pair_weighted_coverage, avg(h / n) AS equal_entity_coverage
FROM (SELECT model, seed, entity, count(*) AS n, sum(hit) AS h FROM predictions GROUP BY ALL) GROUP BY model, seed""",
    ["pair_weighted_coverage", "equal_entity_coverage"],
)
def coverage_weighting(spark, d):
    """Pair-weighted against equal-entity coverage."""
    return metrics.coverage_weighting(predictions(spark, d), RUN, "entity")


@query(
    "interval_method_comparison",
    f"""SELECT * FROM ({_coverage_sql("hit", "upper - lower")}) , (SELECT 'pooled' AS method)
UNION ALL SELECT * FROM ({_coverage_sql("hit_context", "upper_context - lower_context")}), (SELECT 'context_wise' AS method)""",
    _COVER,
)
def interval_method_comparison(spark, d):
    """Coverage audit of both calibration methods."""
    return metrics.compare_intervals(predictions(spark, d), RUN, "context")


_QUALITY = "CASE WHEN n_records = 1 THEN 'single_record' WHEN target_iqr = 0 THEN 'repeated_zero_spread' ELSE 'repeated_nonzero_spread' END"
CTES["quality_errors"] = f"""
SELECT model, seed, {_QUALITY} AS quality, count(*) AS n, avg(absolute_error) AS mae, sqrt(avg(absolute_error * absolute_error)) AS rmse,
 avg((absolute_error <= 2)::INT::DOUBLE) AS within_two, quantile_cont(n_records, 0.5::DOUBLE) AS median_records, quantile_cont(target_iqr, 0.5::DOUBLE) AS median_spread
FROM predictions GROUP BY ALL"""


@query("error_by_quality", "SELECT * FROM quality_errors", ["mae", "rmse", "within_two", "median_records", "median_spread"])
def error_by_quality(spark, d):
    """Errors by record-quality group."""
    return metrics.error_by_quality(predictions(spark, d, keep=QUALITY), RUN)


@query(
    "spread_error_correlation",
    f"""SELECT a.*, b.spearman FROM (SELECT model, seed, count(*) AS n FROM predictions WHERE n_records >= 2 GROUP BY ALL) a
LEFT JOIN {spearman("(SELECT * FROM predictions WHERE n_records >= 2)", "model, seed", "target_iqr", "absolute_error")} b USING (model, seed)""",
    ["spearman"],
)
def spread_error_correlation(spark, d):
    """Rank correlation of record spread and error."""
    return metrics.spread_error_correlation(predictions(spark, d, keep=QUALITY), RUN)


@query(
    "grouped_spearman",
    f"SELECT a.*, b.spearman FROM (SELECT context, count(*) AS n FROM records GROUP BY context) a LEFT JOIN {spearman('records', 'context', 'quantity', 'value')} b USING (context)",
    ["spearman"],
)
def grouped_rank_correlation(spark, d):
    """Rank correlation of quantity and value per context, over all records."""
    r = records(spark, d)
    sizes = r.groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(grouped_spearman(r, ["context"], "quantity", "value"), "context", "left")


@query("group_diversity", "SELECT * FROM diversity", ["group_fraction", "entropy", "normalised_entropy", "top_share"])
def group_diversity(spark, d):
    """Group-key diversity of every context in both modes."""
    p = records(spark, d).select("entity", "context").distinct().join(entities(spark, d).select("entity", "group_key"), "entity")
    return diversity.group_diversity(p, "context", "entity", "group_key")


_DIV = ["group_fraction", "entropy", "normalised_entropy", "top_share"]


@query(
    "fallback_sensitivity",
    f"""SELECT a.context, {', '.join(f'a.{c} AS {c}_with_fallback, b.{c} AS {c}_grouped_only, a.{c} - b.{c} AS delta_{c}' for c in _DIV)}
FROM diversity a JOIN diversity b ON a.context = b.context AND a.mode = 'with_fallback' AND b.mode = 'grouped_only'""",
    [f"{c}_{m}" for c in _DIV for m in ("with_fallback", "grouped_only")] + [f"delta_{c}" for c in _DIV],
)
def fallback_sensitivity(spark, d):
    """What the per-entity fallback keys change."""
    return diversity.fallback_sensitivity(group_diversity(spark, d), "context")


@query(
    "balanced_weights",
    """SELECT context, count(*) AS rows, sum(w) AS weight_sum, max(w) AS weight FROM (SELECT context, (SELECT count(*) FROM labelled WHERE seed = 42 AND split = 'train')::DOUBLE
 / ((SELECT count(DISTINCT context) FROM labelled WHERE seed = 42 AND split = 'train') * count(*) OVER (PARTITION BY context)) AS w FROM labelled WHERE seed = 42 AND split = 'train') GROUP BY context""",
    ["weight_sum", "weight"],
)
def balanced_weights(spark, d):
    """Inverse-frequency weights of the training rows, summed per context."""
    train = labelled(spark, d, [42]).where("split = 'train'")
    return metrics.balanced_weights(train, "context").groupBy("context").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("weight_sum"), F.max("weight").alias("weight")
    )


@query(
    "support_range",
    "SELECT model, context, min(n) AS n_min, avg(n) AS n_mean, max(n) AS n_max FROM context_metrics GROUP BY ALL",
    ["n_mean"],
)
def support_range(spark, d):
    """Test support of each context over seeds."""
    own = predictions(spark, d).groupBy(*RUN, "context").agg(F.count(F.lit(1)).alias("n"))
    return metrics.support_range(own, ["model", "context"])


@query(
    "support_sensitivity",
    f"""SELECT t.least_support, model, count(*) AS contexts, {', '.join(f'avg({m}) AS {m}_macro' for m in POINTS)} FROM context_metrics
JOIN (SELECT unnest({SUPPORT_THRESHOLDS}) AS least_support) t ON n >= t.least_support GROUP BY ALL""",
    [f"{m}_macro" for m in POINTS],
)
def support_sensitivity(spark, d):
    """Macro metrics over contexts with at least t test rows."""
    return contrasts.support_sensitivity(context_metrics(spark, d), ["model"], "n", SUPPORT_THRESHOLDS, POINTS)


@query(
    "paired_models",
    """SELECT a.seed, a.mae AS mae_candidate, b.mae AS mae_reference, a.rmse AS rmse_candidate, b.rmse AS rmse_reference, a.mae - b.mae AS delta_mae, a.rmse - b.rmse AS delta_rmse
FROM macro_metrics a JOIN macro_metrics b ON a.seed = b.seed AND a.model = 'kind_median' AND b.model = 'context_median'""",
    ["mae_candidate", "mae_reference", "rmse_candidate", "rmse_reference", "delta_mae", "delta_rmse"],
)
def paired_models(spark, d):
    """Candidate and reference side by side per seed."""
    return joins.pair_models(macro_metrics(spark, d, ["kind_median", "context_median"]), ["seed"], "model", "kind_median", "context_median", ["mae", "rmse"])


CONTRASTS = [("kind_median", "context_median"), ("kind_median", "kind_entity_only"), ("context_median", "overall_entity_only")]
_CON = " UNION ALL ".join(f"SELECT '{a}' AS candidate, '{b}' AS reference" for a, b in CONTRASTS)
_FAV = "sum((CASE WHEN metric IN ('mae', 'rmse', 'width', 'width_context') THEN difference < -1e-12 ELSE difference > 1e-12 END)::INT)::BIGINT AS favourable"


@query(
    "paired_seed_contrast",
    t_stats(
        f"""(SELECT c.candidate, c.reference, a.metric, a.value - b.value AS difference FROM ({_CON}) c JOIN tall_macro a ON a.model = c.candidate
 JOIN tall_macro b ON b.model = c.reference AND a.seed = b.seed AND a.metric = b.metric)""",
        "candidate, reference, metric", "difference", f", {_FAV}",
    ),
    ["mean", "sd", "ci_low", "ci_high"],
)
def paired_seed_contrast(spark, d):
    """Paired differences over seeds with t limits and favourable counts."""
    return contrasts.paired_contrast(macro_metrics(spark, d), CONTRASTS, ["seed"], ALL_METRICS)


@query(
    "effect_interaction",
    t_stats(
        """(SELECT 'with_context minus without_context' AS interaction, seed, sum(CASE model WHEN 'kind_median' THEN mae WHEN 'context_median' THEN -mae WHEN 'kind_entity_only' THEN -mae ELSE mae END) AS difference FROM macro_metrics GROUP BY seed)""",
        "interaction", "difference", ", sum((difference > 0)::INT)::BIGINT AS positive_units",
    ),
    ["mean", "sd", "ci_low", "ci_high"],
)
def effect_interaction(spark, d):
    """Whether the kind effect differs with and without context."""
    cells = {"with_context": ("kind_median", "context_median"), "without_context": ("kind_entity_only", "overall_entity_only")}
    return contrasts.interaction(macro_metrics(spark, d), cells, "with_context", "without_context", "seed", "mae")


@query(
    "contrast_by_quality",
    t_stats(
        """(SELECT a.quality, 'kind_median' AS candidate, 'context_median' AS reference, m AS metric, CASE m WHEN 'mae' THEN a.mae - b.mae ELSE a.rmse - b.rmse END AS difference
 FROM quality_errors a JOIN quality_errors b ON a.seed = b.seed AND a.quality = b.quality AND a.model = 'kind_median' AND b.model = 'context_median', (SELECT unnest(['mae', 'rmse']) AS m))""",
        "quality, candidate, reference, metric", "difference", f", {_FAV}",
    ),
    ["mean", "sd", "ci_low", "ci_high"],
)
def contrast_by_quality(spark, d):
    """The paired contrast within record-quality groups."""
    by_group = metrics.error_by_quality(predictions(spark, d, keep=QUALITY), RUN)
    return contrasts.paired_contrast(by_group, CONTRASTS[:1], ["seed"], ["mae", "rmse"], ["quality"])


CTES["context_means"] = f"SELECT model, context, {', '.join(f'avg({m}) AS {m}' for m in ALL_METRICS)} FROM context_metrics GROUP BY ALL"
CTES["delta_table"] = """SELECT a.context, a.mae AS mae_candidate, b.mae AS mae_reference, a.rmse AS rmse_candidate, b.rmse AS rmse_reference, a.mae - b.mae AS delta_mae, a.rmse - b.rmse AS delta_rmse
FROM context_means a JOIN context_means b ON a.context = b.context AND a.model = 'kind_median' AND b.model = 'context_median'"""


def _deltas(spark, d):
    return contrasts.context_deltas(context_metrics(spark, d, ["kind_median", "context_median"]), "context", "kind_median", "context_median", ["mae", "rmse"])


@query("context_deltas", "SELECT * FROM delta_table", ["mae_candidate", "mae_reference", "rmse_candidate", "rmse_reference", "delta_mae", "delta_rmse"])
def context_deltas(spark, d):
    """Seed-averaged metrics of two models per context with their difference."""
    return _deltas(spark, d)


@query(
    "improving_share",
    "SELECT count(delta_mae) AS contexts, count(*) FILTER (delta_mae < 0) AS improving, avg((delta_mae < 0)::INT::DOUBLE) AS improving_share, avg(delta_mae) AS macro_delta FROM delta_table",
    ["improving_share", "macro_delta"],
)
def improving_share(spark, d):
    """Share of contexts in which the candidate is better."""
    return contrasts.improving_share(_deltas(spark, d), "delta_mae")


@query(
    "delta_summary",
    t_stats(
        "(SELECT 'all' AS scope, unnest(['delta_mae', 'delta_rmse']) AS contrast, unnest([delta_mae, delta_rmse]) AS delta FROM delta_table)",
        "scope, contrast", "delta",
        ", quantile_cont(delta, 0.5::DOUBLE) AS median, count(*) FILTER (delta < 0) AS below_zero, count(*) FILTER (delta > 0) AS above_zero",
    ),
    ["mean", "sd", "median", "ci_low", "ci_high"],
)
def delta_summary(spark, d):
    """Equal-context summary of paired deltas."""
    return contrasts.delta_summary(_deltas(spark, d).withColumn("scope", F.lit("all")), ["scope"], ["delta_mae", "delta_rmse"])


@query(
    "conditioning_summary",
    """SELECT model, avg(mae) AS mae, avg(within_two) AS within_two, count(seed) AS seeds, NOT ends_with(model, '_entity_only') AS uses_context,
 CASE model WHEN 'context_median' THEN 0 WHEN 'overall_entity_only' THEN 1 WHEN 'kind_median' THEN 2 ELSE 3 END::INT AS display_order FROM macro_metrics GROUP BY model""",
    ["mae", "within_two"],
)
def conditioning_summary(spark, d):
    """Context-aware and entity-only models in their fixed order."""
    means = macro_metrics(spark, d).groupBy("model").agg(
        F.avg("mae").alias("mae"), F.avg("within_two").alias("within_two"), F.count("seed").alias("seeds")
    )
    flagged = means.withColumn("uses_context", ~F.col("model").endswith("_entity_only"))
    return reshape.order_by_list(flagged, "model", ["context_median", "overall_entity_only", "kind_median", "kind_entity_only"])


@query(
    "model_metric_pivot",
    """SELECT a.seed, a.metric, a.value AS value_a, b.value AS value_b, a.value - b.value AS delta FROM tall_macro a JOIN tall_macro b
ON a.seed = b.seed AND a.metric = b.metric AND a.model = 'kind_median' AND b.model = 'kind_entity_only' WHERE a.metric IN ('mae', 'rmse', 'coverage')""",
    ["value_a", "value_b", "delta"],
)
def model_metric_pivot(spark, d):
    """Metrics of two models side by side with their difference."""
    tall = contrasts.melt(macro_metrics(spark, d), RUN, ["mae", "rmse", "coverage"])
    return reshape.pivot_delta(tall, ["seed", "metric"], "model", "value", "kind_median", "kind_entity_only")


_CAT = ["context_mae", "kind_mae", "kind_rmse", "kind_coverage", "delta_mae"]
CTES["catalogue_rows"] = """SELECT k.*, s.context_mae, s.kind_mae, s.kind_rmse, s.kind_coverage, s.kind_mae - s.context_mae AS delta_mae
FROM (SELECT context, context_id, class, count(*) AS pairs, count(DISTINCT entity) AS entities FROM pairs GROUP BY ALL) k JOIN (
 SELECT context, avg(mae) FILTER (model = 'context_median') AS context_mae, avg(mae) FILTER (model = 'kind_median') AS kind_mae, avg(rmse) FILTER (model = 'kind_median') AS kind_rmse,
  avg(coverage) FILTER (model = 'kind_median') AS kind_coverage FROM context_metrics GROUP BY context) s ON k.context = s.context"""


def _catalogue(spark, d):
    composition = records(spark, d).select(*PAIR_KEYS).distinct().groupBy("context", "context_id", "class").agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("entity").alias("entities")
    )
    scores = reshape.conditional_columns(
        context_metrics(spark, d), ["context"], "model",
        {
            "context_mae": ("context_median", F.col("mae")), "kind_mae": ("kind_median", F.col("mae")),
            "kind_rmse": ("kind_median", F.col("rmse")), "kind_coverage": ("kind_median", F.col("coverage")),
        },
    ).withColumn("delta_mae", F.col("kind_mae") - F.col("context_mae"))
    return reshape.catalogue(composition, "context", [scores])


@query("context_catalogue", "SELECT * FROM catalogue_rows", _CAT)
def context_catalogue(spark, d):
    """Composition and performance of every context, ordered by class and name."""
    return _catalogue(spark, d).orderBy("class", "context")


@query("class_summary", "SELECT class, count(DISTINCT context) AS contexts, sum(pairs)::BIGINT AS pairs FROM catalogue_rows GROUP BY class")
def class_summary(spark, d):
    """Contexts and pairs of every class."""
    p = records(spark, d).select("class", "context", "entity").distinct()
    return p.groupBy("class").agg(F.countDistinct("context").alias("contexts"), F.count(F.lit(1)).alias("pairs"))


@query(
    "interval_by_context",
    """SELECT m.model, m.context, class, avg(coverage) AS coverage, avg(width) AS width, avg(coverage_context) AS coverage_context, avg(width_context) AS width_context
FROM context_metrics m JOIN (SELECT DISTINCT context, class FROM records) c ON m.context = c.context GROUP BY ALL""",
    ["coverage", "width", "coverage_context", "width_context"],
)
def interval_by_context(spark, d):
    """Interval quality of every context over seeds, both methods."""
    means = context_metrics(spark, d).groupBy("model", "context").agg(
        *[F.avg(c).alias(c) for c in ("coverage", "width", "coverage_context", "width_context")]
    )
    return means.join(records(spark, d).select("context", "class").distinct(), "context")


CTES["assoc"] = """SELECT orders_n, spend, urgent, c_acctbal AS balance, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey::DOUBLE END AS lag_value FROM customer LEFT JOIN (
 SELECT o_custkey, count(*)::DOUBLE AS orders_n, sum(floor(o_totalprice))::DOUBLE AS spend, (count(*) FILTER (o_orderpriority LIKE '1%'))::DOUBLE AS urgent FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"""


@query(
    "association_grid",
    " UNION ALL ".join(
        f"""SELECT '{p}' AS predictor, '{o}' AS outcome, count(*) AS n, CASE WHEN count(DISTINCT {p}) > 1 AND count(DISTINCT {o}) > 1 THEN corr(rx, ry) END AS spearman FROM (
 SELECT *, rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY {o}) + (count(*) OVER (PARTITION BY {o}) - 1) / 2.0::DOUBLE AS ry FROM assoc WHERE {p} IS NOT NULL AND {o} IS NOT NULL)"""
        for p in ("orders_n", "spend", "urgent") for o in ("balance", "lag_value")
    ),
    ["spearman"],
)
def association_grid(spark, d):
    """Rank correlation of customer aggregates with outcomes, missing pairs left out."""
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("orders_n"), F.sum(F.floor("o_totalprice")).cast("double").alias("spend"),
        F.count_if(F.col("o_orderpriority").startswith("1")).cast("double").alias("urgent"),
    )
    base = table(spark, d, "customer").join(per, "c_custkey", "left").select(
        "orders_n", "spend", "urgent", F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey").cast("double")).alias("lag_value"),
    )
    return contrasts.association_grid(base, ["orders_n", "spend", "urgent"], ["balance", "lag_value"])


@query(
    "run_cost_summary",
    """SELECT event_type, rows AS runs, seconds AS value_mean, total AS value_sum, largest AS value_max, first_user AS user_id_first, spread FROM (
 SELECT event_type, count(*) AS rows, avg(value) AS seconds, sum(value) AS total, max(value) AS largest, arg_min(user_id, event_id) AS first_user FROM events GROUP BY event_type)
JOIN (SELECT event_type, stddev_samp(value) AS spread FROM events GROUP BY event_type) USING (event_type)""",
    ["value_mean", "value_sum", "value_max", "spread"],
    6,
)
def run_cost_summary(spark, d):
    """Cost columns of a run log per key, joined one-to-one to a second summary."""
    log = table(spark, d, "events")
    cost = metrics.cost_summary(log, ["event_type"], ["value"], ["value"], ["value"], {"user_id": "event_id"})
    spread = log.groupBy("event_type").agg(F.stddev_samp("value").alias("spread"))
    return joins.validated_join(cost, spread, ["event_type"], "inner", "1:1")


@query(
    "label_contract",
    """SELECT count(*) AS rows, count(*) - count(DISTINCT doc_id) AS repeated_ids, (count(*) FILTER (q IS NULL) + count(*) FILTER (toxic IS NULL))::BIGINT AS missing_cells,
 (count(*) FILTER (q = 1) + count(*) FILTER (toxic = 1))::BIGINT AS positive_cells, count(*) FILTER (greatest(q, toxic) = 1) AS positive_rows, (SELECT count(DISTINCT v) FROM (SELECT quality AS v FROM labels UNION ALL SELECT toxic FROM labels)) AS distinct_values
FROM (SELECT doc_id, toxic, CASE WHEN doc_id > 50 THEN quality END AS q FROM labels)""",
)
def label_contract(spark, d):
    """What the label table holds: values, missing cells, repeated ids, positives."""
    base = table(spark, d, "labels").withColumn("quality", F.when(F.col("doc_id") > 50, F.col("quality")))
    return metrics.label_contract(base, "doc_id", ["quality", "toxic"])


# --- temporal and leave-one-out evaluation without a learner ---------------------------------------


@query(
    "temporal_baseline_report",
    """
WITH med AS (SELECT context, quantile_cont(target, 0.5::DOUBLE) AS y_pred FROM cohort_pairs WHERE cohort = 'train' GROUP BY context),
 p AS (SELECT cohort, entity, c.context, target AS y_true, y_pred, abs(target - y_pred) AS e FROM cohort_pairs c JOIN med ON c.context = med.context WHERE cohort <> 'train'),
 q AS (SELECT e AS q FROM (SELECT e, row_number() OVER (ORDER BY e) AS rn, count(*) OVER () AS n FROM p WHERE cohort = 'valid') WHERE rn = least(n, ceil((n + 1)::DOUBLE * 0.9::DOUBLE)))
SELECT context, count(*) AS n, avg(e) AS mae, sqrt(avg(e * e)) AS rmse, avg((e <= 1)::INT::DOUBLE) AS within_one, avg((y_true BETWEEN y_pred - q AND y_pred + q)::INT::DOUBLE) AS coverage, avg((y_pred + q) - (y_pred - q)) AS width
FROM p, q WHERE cohort = 'test' GROUP BY context""",
    ["mae", "rmse", "within_one", "coverage", "width"],
)
def temporal_baseline_report(spark, d):
    """Median of the train era, calibrated on the valid era, judged on the test era."""
    p = materialize(cohort_pairs(spark, d)).withColumns({"model": F.lit("context_median"), "seed": F.lit(0)})
    medians = metrics.median_baseline(p.where("cohort = 'train'"), ["context"], "target")
    rows = p.where("cohort <> 'train'").join(medians, "context").withColumnRenamed("target", "y_true")
    out = calibrate(rows.withColumn("split", F.col("cohort")))
    result = metrics.regression_metrics(out, ["context"], extra=metrics.interval_aggregates())
    return result.select("context", "n", "mae", "rmse", "within_one", "coverage", "width")


@query(
    "leave_one_out_summary",
    t_stats(
        f"(SELECT cohort, unnest(['mae', 'rmse', 'within_one']) AS contrast, unnest([mae, rmse, within_one]) AS delta FROM ({LOO_SQL}) WHERE n > 0)",
        "cohort, contrast", "delta",
        ", quantile_cont(delta, 0.5::DOUBLE) AS median, count(*) FILTER (delta < 0) AS below_zero, count(*) FILTER (delta > 0) AS above_zero",
    ),
    ["mean", "sd", "median", "ci_low", "ci_high"],
)
def leave_one_out_summary(spark, d):
    """Equal-context summary of the leave-one-context-out errors per cohort."""
    m = loo_metrics(loo_predictions(spark, d)).where("n > 0")
    return contrasts.delta_summary(m, ["cohort"], ["mae", "rmse", "within_one"])


# --- wide tables ------------------------------------------------------------------------------


EVENT_TASKS = reshape.task_columns(["click", "error", "purchase", "signup", "view"])
_WIDE = ", ".join(f"max(v) FILTER (event_type = '{c}') AS {t}" for c, t in EVENT_TASKS.items())
CTES["wide_rows"] = f"SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, {_WIDE} FROM (SELECT user_id, event_type, CASE WHEN (user_id + length(event_type)) % 4 <> 0 THEN max(value) END AS v FROM events GROUP BY user_id, event_type) GROUP BY user_id"


def _wide(spark, d):
    # All events count. A quarter of the cells, by this rule, is left empty; every entity keeps some.
    best = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    best = best.withColumn("v", F.when((F.col("user_id") + F.length("event_type")) % 4 != 0, F.col("v")))
    wide = reshape.to_wide(best, "user_id", "event_type", "v", EVENT_TASKS)
    return wide.withColumn("split", F.when(F.col("user_id") % 5 == 0, "test").otherwise("train"))


@query("wide_targets", "SELECT * FROM wide_rows", list(EVENT_TASKS.values()))
def wide_targets(spark, d):
    """One row per entity and one column per context."""
    return _wide(spark, d)


@query(
    "observed_cells",
    "SELECT user_id, split, event_type, value FROM (SELECT user_id, split, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type, unnest([target_000, target_001, target_002, target_003, target_004]) AS value FROM wide_rows) WHERE value IS NOT NULL AND split = 'test'",
    ["value"],
)
def observed_cells(spark, d):
    """Observed test cells of the wide table in long form."""
    return reshape.to_long(_wide(spark, d).where("split = 'test'"), ["user_id", "split"], EVENT_TASKS, "event_type", "value")


@query(
    "task_weights",
    """SELECT context, task, train_labels, (1.0::DOUBLE / train_labels) / avg(1.0::DOUBLE / train_labels) OVER () AS task_weight FROM (
 SELECT event_type AS context, 'target_00' || (rank() OVER (ORDER BY event_type) - 1) AS task, count(*) AS train_labels FROM (
  SELECT user_id, split, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type, unnest([target_000, target_001, target_002, target_003, target_004]) AS value FROM wide_rows) WHERE value IS NOT NULL AND split = 'train' GROUP BY event_type)""",
    ["task_weight"],
)
def task_weights(spark, d):
    """Training labels and normalised inverse-count weight of every task."""
    return reshape.task_weights(_wide(spark, d), EVENT_TASKS, "split")
