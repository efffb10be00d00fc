"""Ranking quality on the labelled documents, with bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import SEEDS, TOP_K
from ..functions.scalar import any_active
from ..functions.seeding import hash_unit, seeded_key
from ..operators import contrasts, joins, metrics, ranking, reshape
from ..operators.bootstrap import PRIME, poisson_steps
from ..session import materialize
from ..sources.io import table
from .bindings import screen
from .metric_queries import CONTRASTS, macro_metrics
from .registry import query
from .similarity_queries import screen_nearest
from .split_queries import explode_screen, screen_flags
from .sql import CTES, hash_int, hash_long, ranking_select, t_stats

SCORES = {"length": "score_length", "hash": "score_hash"}
# Replicates with Poisson weights, and of resamples of the cohort's size, which shuffle rows x replicates.
DRAWS, COHORT_DRAWS = 5000, 2000
REPLICATES, PAIRED_REPLICATES = 100, 80
SPARE = 60  # further resamples of the SQL twins, which cannot draw in rounds
# Further draws of the SQL twins for cohorts whose smaller class is below FEW and may be missing from a replicate:
# with one row each the chance is 0.6, so that two and a half times the draws and some more do.
FEW, SPARE_DRAWS = 20, 9000
BOOT_SEED = 4711

CTES["cohort_rows"] = """
SELECT 'primary' AS cohort, * FROM screen_flags WHERE NOT exact_overlap
UNION ALL SELECT 'parent_nonidentity', * FROM screen_flags WHERE NOT exact_overlap AND NOT parent_identity
UNION ALL SELECT 'overlap', * FROM screen_flags WHERE exact_overlap"""
CTES["scored_rows"] = """
SELECT cohort, doc_id, lang, endpoint, label, unnest(['length', 'hash']) AS model, unnest([score_length, score_hash]) AS score FROM (
 SELECT cohort, doc_id, lang, score_length, score_hash, unnest(['quality', 'toxic', 'any']) AS endpoint, unnest([quality, toxic, greatest(quality, toxic)]) AS label FROM cohort_rows)"""

RANKED = ["prevalence", "auroc", "average_precision"]
RANK_COLUMNS = "n, positives, prevalence, auroc, average_precision, status"


def endpoints():
    return {"quality": F.col("quality"), "toxic": F.col("toxic"), "any": any_active(["quality", "toxic"])}


def scored(df, keep):
    labels = ranking.melt_labels(df, [*keep, *SCORES.values()], endpoints())
    return ranking.melt_scores(labels, [*keep, "endpoint", "label"], SCORES)


def cohort_rows(spark, d):
    return explode_screen(screen_flags(spark, d))


@query(
    "classification_table",
    f"SELECT cohort, model, endpoint, {RANK_COLUMNS} FROM ({ranking_select('scored_rows', 'cohort, model, endpoint', 'label', 'score')})",
    RANKED,
)
def classification_table(spark, d):
    """AUROC and average precision per cohort, model and endpoint."""
    return ranking.ranking_metrics(scored(cohort_rows(spark, d), ["cohort"]), ["cohort", "model", "endpoint"], "label", "score")


@query(
    "auroc_by_language",
    f"SELECT lang, model, n, positives, auroc, status FROM ({ranking_select('''(SELECT * FROM scored_rows WHERE cohort = 'primary' AND endpoint = 'toxic')''', 'lang, model', 'label', 'score')})",
    ["auroc"],
)
def auroc_by_language(spark, d):
    """Tie-correct AUROC, missing for a language with one class."""
    rows = screen_flags(spark, d).where(~F.col("exact_overlap"))
    long = ranking.melt_scores(rows, ["lang", "toxic"], SCORES)
    return ranking.ranking_metrics(long, ["lang", "model"], "toxic", "score").select("lang", "model", "n", "positives", "auroc", "status")


@query(
    "average_precision_with_ties",
    f"SELECT lang, n, average_precision FROM ({ranking_select('''(SELECT lang, quality AS label, floor(n_chars / 500.0)::DOUBLE AS score FROM screen)''', 'lang', 'label', 'score')})",
    ["average_precision"],
)
def average_precision_with_ties(spark, d):
    """Average precision of a coarse score, ties taken as one step."""
    rows = screen(spark, d).select("lang", "quality", F.floor(F.col("n_chars") / 500.0).cast("double").alias("score"))
    return ranking.ranking_metrics(rows, ["lang"], "quality", "score").select("lang", "n", "average_precision")


@query(
    "endpoint_table",
    f"SELECT model, endpoint, {RANK_COLUMNS} FROM ({ranking_select('''(SELECT * FROM scored_rows WHERE cohort <> 'parent_nonidentity')''', 'model, endpoint', 'label', 'score')})",
    RANKED,
)
def endpoint_table(spark, d):
    """Every endpoint and the pooled one over the whole screen."""
    return ranking.ranking_metrics(scored(screen(spark, d), []), ["model", "endpoint"], "label", "score")


@query(
    "table_by_similarity_bin",
    f"""SELECT bin, model, {RANK_COLUMNS} FROM ({ranking_select('''(SELECT CASE WHEN similarity < 0.3 THEN '<0.30' WHEN similarity < 0.5 THEN '0.30-0.50' WHEN similarity < 0.7 THEN '0.50-0.70' ELSE '>=0.70' END AS bin,
 model, label, score FROM scored_rows s JOIN screen_nearest n ON s.doc_id = n.doc_id WHERE cohort = 'primary' AND endpoint = 'quality')''', 'bin, model', 'label', 'score')})""",
    RANKED,
)
def table_by_similarity_bin(spark, d):
    """Ranking quality within bins of similarity to the corpus."""
    from ..functions.scalar import bin_left

    near = screen_nearest(spark, d).select(
        "doc_id", bin_left("similarity", [0.30, 0.50, 0.70], ["<0.30", "0.30-0.50", "0.50-0.70", ">=0.70"]).alias("bin")
    )
    rows = screen_flags(spark, d).where(~F.col("exact_overlap")).join(near, "doc_id")
    return ranking.ranking_metrics(ranking.melt_scores(rows, ["bin", "quality"], SCORES), ["bin", "model"], "quality", "score")


CTES["seeded_scores"] = f"""
SELECT doc_id, quality AS label, seed, {hash_int("seed || ':' || doc_id")} / 4294967296.0::DOUBLE AS score FROM screen, (SELECT unnest({SEEDS}) AS seed)"""


def seeded_scores(spark, d):
    rows = screen(spark, d).select("doc_id", F.col("quality").alias("label"), F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed"))
    return rows.withColumn("score", hash_unit(seeded_key(F.col("seed"), F.col("doc_id"))))


@query("metrics_by_seed", f"SELECT seed, {RANK_COLUMNS} FROM ({ranking_select('seeded_scores', 'seed', 'label', 'score')})", RANKED)
def metrics_by_seed(spark, d):
    """Ranking quality of each seed's score."""
    return ranking.ranking_metrics(seeded_scores(spark, d), ["seed"], "label", "score")


@query("ensemble_scores", "SELECT doc_id, avg(score) AS score, stddev_pop(score) AS score_sd FROM seeded_scores GROUP BY doc_id", ["score", "score_sd"])
def ensemble_scores(spark, d):
    """Mean and population deviation of a score over seeds."""
    return metrics.ensemble_scores(seeded_scores(spark, d), ["doc_id"], "score")


@query(
    "score_matrix",
    """SELECT d.doc_id, avg(score) FILTER (seed = 42) AS hash_42, avg(score) FILTER (seed = 2026) AS hash_2026 FROM documents d LEFT JOIN seeded_scores s ON d.doc_id = s.doc_id GROUP BY d.doc_id""",
    ["hash_42", "hash_2026"],
)
def score_matrix(spark, d):
    """Scores pivoted by family and seed, aligned to the full id list."""
    scores = seeded_scores(spark, d).withColumn("family", F.lit("hash"))
    return reshape.score_matrix(
        scores, table(spark, d, "documents"), "doc_id", ["family", "seed"], "score", {"hash:42": "hash_42", "hash:2026": "hash_2026"}
    )


def _topk_sql(divisor: str) -> str:
    return f"""
SELECT k.cohort, k.model, k.k, taken, hits, hits / {divisor}::DOUBLE AS precision, (hits / {divisor}::DOUBLE) / nullif(prevalence, 0) AS enrichment FROM (
 SELECT cohort, model, k, count(*) AS taken, sum(label)::BIGINT AS hits FROM (
  SELECT *, row_number() OVER (PARTITION BY cohort, model ORDER BY score DESC, doc_id) AS rn FROM scored_rows WHERE endpoint = 'toxic') JOIN (SELECT unnest({TOP_K}) AS k) t ON rn <= t.k GROUP BY ALL) k
JOIN (SELECT cohort, model, avg(label::DOUBLE) AS prevalence FROM scored_rows WHERE endpoint = 'toxic' GROUP BY ALL) p ON k.cohort = p.cohort AND k.model = p.model"""


def _topk(spark, d, divide_by_k):
    long = ranking.melt_scores(cohort_rows(spark, d), ["cohort", "doc_id", "toxic"], SCORES)
    return ranking.topk_enrichment(long, ["cohort", "model"], "doc_id", "toxic", "score", TOP_K, divide_by_k)


@query("topk_enrichment", _topk_sql("taken"), ["precision", "enrichment"])
def topk_enrichment(spark, d):
    """Hits, precision and enrichment at each depth, over the rows taken."""
    return _topk(spark, d, False)


@query("topk_enrichment_over_k", _topk_sql("k.k"), ["precision", "enrichment"])
def topk_enrichment_over_k(spark, d):
    """The same divided by the depth itself."""
    return _topk(spark, d, True)


# --- bootstrap -----------------------------------------------------------------------------


def _drawn_sql(label: str, scores: dict[str, str], replicates: int, seed: int, spare: int = 0) -> str:
    models = ", ".join(f"'{m}'" for m in scores)
    values = ", ".join(scores.values())
    return f"""
base AS (SELECT cohort, doc_id, {label} AS label, {values} FROM cohort_rows),
numbered AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY md5('{seed}:' || doc_id)) - 1 AS row_index, count(*) OVER (PARTITION BY cohort) AS n FROM base),
draws AS (SELECT cohort, replicate, {hash_long(f"'{seed}:' || replicate || ':' || row_index")} % n AS pick FROM numbered, (SELECT unnest(range(0, {replicates})) AS replicate)),
drawn AS (SELECT d.cohort, replicate, label, {values} FROM draws d JOIN numbered b ON d.cohort = b.cohort AND d.pick = b.row_index),
drawn_long AS (SELECT cohort, replicate, label, unnest([{models}]) AS model, unnest([{values}]) AS score FROM drawn),
base_long AS (SELECT cohort, label, unnest([{models}]) AS model, unnest([{values}]) AS score FROM base),
rm AS ({ranking_select('drawn_long', 'cohort, model, replicate', 'label', 'score')}),
pm AS ({ranking_select('base_long', 'cohort, model', 'label', 'score')})"""


@query(
    "bootstrap_intervals",
    f"""
WITH {_drawn_sql('quality', SCORES, REPLICATES, BOOT_SEED)},
tall AS (SELECT cohort, model, unnest(['auroc', 'average_precision']) AS metric, unnest([auroc, average_precision]) AS value FROM rm WHERE auroc IS NOT NULL),
point AS (SELECT cohort, model, unnest(['auroc', 'average_precision']) AS metric, unnest([auroc, average_precision]) AS estimate FROM pm)
SELECT p.cohort, p.model, p.metric, estimate, count(value) AS replicates, quantile_cont(value, 0.025::DOUBLE) AS ci_low, quantile_cont(value, 0.975::DOUBLE) AS ci_high
FROM point p LEFT JOIN tall t ON p.cohort = t.cohort AND p.model = t.model AND p.metric = t.metric GROUP BY ALL""",
    ["estimate", "ci_low", "ci_high"],
)
def bootstrap_intervals(spark, d):
    """Percentile intervals of each model's metrics."""
    rows = materialize(
        cohort_rows(spark, d).select("cohort", "doc_id", "quality", *SCORES.values())
    )
    return ranking.bootstrap_metric(rows, ["cohort"], "doc_id", "quality", SCORES, REPLICATES, BOOT_SEED)


def _weighted_sql(label: str, scores: dict[str, str], replicates: int, seed: int, spare: int = 0, source: str = "cohort_rows") -> str:
    """Poisson weights from a random cubic of the row's hash, and the metrics of every replicate; as rm and pm."""
    models = ", ".join(f"'{m}'" for m in scores)
    values = ", ".join(scores.values())
    part = lambda at: f"(('0x' || substr(md5('{seed}:' || doc_id), {at}, 8))::BIGINT % {PRIME})"
    cubic = f"(((((c3 * h1 + c2) % {PRIME}) * h1 + c1) % {PRIME}) * h1 + c0) % {PRIME}"
    drawn = ", ".join(f"""{hash_int(f"'{seed}:' || replicate || ':{k}'")} % {PRIME} AS c{k}""" for k in range(5))
    return f"""
base AS (SELECT cohort, doc_id, {label} AS label, {values}, {part(1)} AS h1, {part(9)} AS h2 FROM {source}),
replicates AS (SELECT replicate, {drawn} FROM (SELECT unnest(range(0, {replicates})) AS replicate)),
weighted AS (SELECT cohort, replicate, label, {values}, len(list_filter({poisson_steps()}::DOUBLE[], lambda s: s <= u)) AS w FROM (
 SELECT *, (({cubic}) + (c4 * h2) % {PRIME}) % {PRIME} / {PRIME}::DOUBLE AS u
 FROM (SELECT *, sum(label) OVER of_cohort AS n_pos, count(*) OVER of_cohort AS n_all FROM base WINDOW of_cohort AS (PARTITION BY cohort))
 JOIN replicates ON replicate < {replicates - spare} OR least(n_pos, n_all - n_pos) < {FEW})),
by_score AS (SELECT cohort, replicate, model, score, sum(w * label)::DOUBLE AS p, sum(w)::DOUBLE AS c FROM (
 SELECT cohort, replicate, label, w, unnest([{models}]) AS model, unnest([{values}]) AS score FROM weighted WHERE w > 0) GROUP BY ALL),
rm AS (SELECT cohort, replicate, model, CASE WHEN sum(p) > 0 AND sum(p) < sum(c) THEN sum(p * (below + (c - p) / 2)) / (sum(p) * (sum(c) - sum(p))) END AS auroc,
 CASE WHEN sum(p) > 0 AND sum(p) < sum(c) THEN sum(CASE WHEN p > 0 THEN p * hits / seen ELSE 0 END) / sum(p) END AS average_precision FROM (
 SELECT *, sum(c - p) OVER up - (c - p) AS below, sum(p) OVER down AS hits, sum(c) OVER down AS seen FROM by_score
 WINDOW up AS (PARTITION BY cohort, replicate, model ORDER BY score), down AS (PARTITION BY cohort, replicate, model ORDER BY score DESC)) GROUP BY ALL),
base_long AS (SELECT cohort, label, unnest([{models}]) AS model, unnest([{values}]) AS score FROM base),
pm AS ({ranking_select('base_long', 'cohort, model', 'label', 'score')})"""


def _paired_sql(label: str, a: str, b: str, replicates: int, spare: int, seed: int, drawn=_weighted_sql) -> str:
    return f"""
WITH {drawn(label, {'a': a, 'b': b}, replicates + spare, seed, spare)},
gap AS (SELECT x.cohort, x.replicate, x.auroc - y.auroc AS auroc, x.average_precision - y.average_precision AS average_precision FROM rm x JOIN rm y
 ON x.cohort = y.cohort AND x.replicate = y.replicate AND x.model = 'a' AND y.model = 'b'),
used AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY replicate) AS place FROM gap WHERE auroc IS NOT NULL) WHERE place <= {replicates}),
tall AS (SELECT cohort, unnest(['auroc', 'average_precision']) AS metric, unnest([auroc, average_precision]) AS value FROM used),
point AS (SELECT x.cohort, unnest(['auroc', 'average_precision']) AS metric, unnest([x.auroc - y.auroc, x.average_precision - y.average_precision]) AS difference FROM pm x JOIN pm y ON x.cohort = y.cohort AND x.model = 'a' AND y.model = 'b'),
rej AS (SELECT g.cohort, count(*) FILTER (g.auroc IS NULL AND g.replicate < last) AS rejected FROM gap g JOIN (SELECT cohort, max(replicate) AS last FROM used GROUP BY cohort) u ON g.cohort = u.cohort GROUP BY g.cohort)
SELECT p.cohort, p.metric, difference, count(value) AS replicates, quantile_cont(value, 0.025::DOUBLE) AS ci_low, quantile_cont(value, 0.975::DOUBLE) AS ci_high,
 coalesce(rejected, 0) AS rejected, CASE WHEN difference IS NULL THEN 'one_class' ELSE 'estimable' END AS status
FROM point p LEFT JOIN tall t ON p.cohort = t.cohort AND p.metric = t.metric LEFT JOIN rej r ON p.cohort = r.cohort GROUP BY ALL"""


_PAIRED = ["difference", "ci_low", "ci_high"]


def _paired(spark, d, label, a, b, replicates, seed, method="poisson"):
    rows = materialize(cohort_rows(spark, d).select("cohort", "doc_id", label, *SCORES.values()))
    return ranking.paired_bootstrap(rows, ["cohort"], "doc_id", label, a, b, replicates, seed, method=method)


@query("paired_bootstrap", _paired_sql("quality", "score_length", "score_hash", DRAWS, SPARE_DRAWS, BOOT_SEED), _PAIRED)
def paired_bootstrap(spark, d):
    """Difference of two scores on common replicates of Poisson weights."""
    return _paired(spark, d, "quality", "score_length", "score_hash", DRAWS, BOOT_SEED)


@query("paired_bootstrap_resampled", _paired_sql("quality", "score_length", "score_hash", PAIRED_REPLICATES, SPARE, BOOT_SEED, _drawn_sql), _PAIRED)
def paired_bootstrap_resampled(spark, d):
    """The same on resamples of the cohort's size."""
    return _paired(spark, d, "quality", "score_length", "score_hash", PAIRED_REPLICATES, BOOT_SEED, "multinomial")


@query("bootstrap_vs_control", _paired_sql("toxic", "score_hash", "score_length", DRAWS, SPARE_DRAWS, 7), _PAIRED)
def bootstrap_vs_control(spark, d):
    """A score against the control score, with the rejected one-class replicates counted."""
    return _paired(spark, d, "toxic", "score_hash", "score_length", DRAWS, 7)


@query(
    "poisson_bootstrap_intervals",
    f"""
WITH {_weighted_sql('quality', SCORES, DRAWS, BOOT_SEED, source="(SELECT 'all' AS cohort, * FROM screen)")},
 tall AS (SELECT model, unnest(['auroc', 'average_precision']) AS metric, unnest([auroc, average_precision]) AS value FROM rm WHERE auroc IS NOT NULL),
 point AS (SELECT model, unnest(['auroc', 'average_precision']) AS metric, unnest([auroc, average_precision]) AS estimate FROM pm)
SELECT 'all' AS cohort, p.model, p.metric, estimate, count(value) AS replicates, quantile_cont(value, 0.025::DOUBLE) AS ci_low, quantile_cont(value, 0.975::DOUBLE) AS ci_high
FROM point p LEFT JOIN tall t ON p.model = t.model AND p.metric = t.metric GROUP BY ALL""",
    ["estimate", "ci_low", "ci_high"],
)
def poisson_bootstrap_intervals(spark, d):
    """Large-sample form of the bootstrap: every row draws its own weights."""
    rows = screen(spark, d).select(F.lit("all").alias("cohort"), "doc_id", "quality", *SCORES.values())
    return ranking.bootstrap_metric(rows, ["cohort"], "doc_id", "quality", SCORES, DRAWS, BOOT_SEED, "poisson")


CTES["cohort_bootstrap"] = _paired_sql("quality", "score_length", "score_hash", COHORT_DRAWS, SPARE_DRAWS, BOOT_SEED)
CTES["canonical_bootstrap"] = _paired_sql("quality", "score_length", "score_hash", DRAWS, SPARE_DRAWS, BOOT_SEED)


@query(
    "cohort_summary",
    f"""
SELECT r.cohort, n, positives, auroc_length, auroc_hash, average_precision_length, average_precision_hash, delta_auroc, delta_auroc_low, delta_auroc_high, delta_ap FROM (
 SELECT cohort, max(n) AS n, max(positives) AS positives, max(auroc) FILTER (model = 'length') AS auroc_length, max(auroc) FILTER (model = 'hash') AS auroc_hash,
  max(average_precision) FILTER (model = 'length') AS average_precision_length, max(average_precision) FILTER (model = 'hash') AS average_precision_hash FROM (
  {ranking_select('''(SELECT * FROM scored_rows WHERE endpoint = 'quality')''', 'cohort, model', 'label', 'score')}) GROUP BY cohort) r
JOIN (SELECT cohort, max(difference) FILTER (metric = 'auroc') AS delta_auroc, max(ci_low) FILTER (metric = 'auroc') AS delta_auroc_low, max(ci_high) FILTER (metric = 'auroc') AS delta_auroc_high,
 max(difference) FILTER (metric = 'average_precision') AS delta_ap FROM cohort_bootstrap GROUP BY cohort) b ON r.cohort = b.cohort""",
    ["auroc_length", "auroc_hash", "average_precision_length", "average_precision_hash", "delta_auroc", "delta_auroc_low", "delta_auroc_high", "delta_ap"],
)
def cohort_summary(spark, d):
    """One row per cohort: both models and their difference with its interval."""
    rows = materialize(cohort_rows(spark, d).select("cohort", "doc_id", "quality", *SCORES.values()))
    own = ranking.ranking_metrics(ranking.melt_scores(rows, ["cohort", "quality"], SCORES), ["cohort", "model"], "quality", "score")
    pick = lambda c, m: F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{c}_{m}")
    wide = own.groupBy("cohort").agg(
        F.max("n").alias("n"), F.max("positives").alias("positives"),
        *[pick(c, m) for c in ("auroc", "average_precision") for m in SCORES],
    )
    paired = ranking.paired_bootstrap(rows, ["cohort"], "doc_id", "quality", "score_length", "score_hash", COHORT_DRAWS, BOOT_SEED)
    at = lambda c, m, out: F.max(F.when(F.col("metric") == m, F.col(c))).alias(out)
    delta = paired.groupBy("cohort").agg(
        at("difference", "auroc", "delta_auroc"), at("ci_low", "auroc", "delta_auroc_low"),
        at("ci_high", "auroc", "delta_auroc_high"), at("difference", "average_precision", "delta_ap"),
    )
    return wide.join(delta, "cohort")


@query(
    "ablation_table",
    f"""
SELECT source, comparison, metric, mean AS difference, ci_low, ci_high FROM (
 SELECT 'internal' AS source, candidate || '_minus_' || reference AS comparison, metric, mean, ci_low, ci_high FROM (
 {t_stats(f'''(SELECT c.candidate, c.reference, a.metric, a.value - b.value AS difference FROM (SELECT '{CONTRASTS[0][0]}' AS candidate, '{CONTRASTS[0][1]}' AS reference) c JOIN tall_macro a ON a.model = c.candidate
  JOIN tall_macro b ON b.model = c.reference AND a.seed = b.seed AND a.metric = b.metric WHERE a.metric IN ('mae', 'rmse'))''', 'candidate, reference, metric', 'difference')})
 UNION ALL SELECT 'external', 'length_minus_hash_' || b.cohort, b.metric, b.difference, CASE WHEN b.cohort = 'primary' AND p.ci_low IS NOT NULL THEN p.ci_low ELSE b.ci_low END,
  CASE WHEN b.cohort = 'primary' AND p.ci_high IS NOT NULL THEN p.ci_high ELSE b.ci_high END
 FROM cohort_bootstrap b LEFT JOIN canonical_bootstrap p ON b.cohort = p.cohort AND b.metric = p.metric)""",
    ["difference", "ci_low", "ci_high"],
)
def ablation_table(spark, d):
    """Internal t contrasts and external bootstrap contrasts in one table; canonical limits overwrite where given."""
    inner = contrasts.paired_contrast(macro_metrics(spark, d, CONTRASTS[0]), CONTRASTS[:1], ["seed"], ["mae", "rmse"]).select(
        F.lit("internal").alias("source"), F.concat_ws("_minus_", "candidate", "reference").alias("comparison"), "metric",
        F.col("mean").alias("difference"), "ci_low", "ci_high",
    )
    rows = materialize(cohort_rows(spark, d).select("cohort", "doc_id", "quality", *SCORES.values()))

    def drawn(part, replicates):
        return ranking.paired_bootstrap(part, ["cohort"], "doc_id", "quality", "score_length", "score_hash", replicates, BOOT_SEED)

    outer = drawn(rows, COHORT_DRAWS).select(
        F.lit("external").alias("source"), F.concat(F.lit("length_minus_hash_"), "cohort").alias("comparison"), "metric",
        "difference", "ci_low", "ci_high",
    )
    both = reshape.union_all([inner, outer])
    # The primary cohort's limits come from the run with the canonical number of replicates.
    canonical = drawn(rows.where("cohort = 'primary'"), DRAWS).select(
        F.lit("external").alias("source"), F.concat(F.lit("length_minus_hash_"), "cohort").alias("comparison"), "metric", "ci_low", "ci_high"
    )
    return contrasts.overwrite_from(both, canonical, ["source", "comparison", "metric"], ["ci_low", "ci_high"])
