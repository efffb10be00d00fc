"""Ranking quality of scores: AUROC, average precision, top-k enrichment and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import TOP_K
from ..functions.scalar import ratio
from ..functions.seeding import hash_long, seeded_key
from ..session import materialize
from .bootstrap import poisson_metrics
from .ordered import Hot, find_hot, number_rows, ordered_sums


def ranking_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str, weight: str | None = None, hot: Hot | None = None) -> DataFrame:
    """Rows, positives, prevalence, AUROC and average precision per key; the last two are missing with one class.

    Rows are first added up per distinct score, so ties cost nothing and the
    ordered sums run over distinct scores only.
    """
    keys = list(keys)
    w = F.lit(1) if weight is None else F.col(weight)
    per_score = df.groupBy(*keys, score).agg(
        F.sum(w * F.col(label)).cast("bigint").alias("pos"), F.sum(w).cast("bigint").alias("all")
    )
    o = ordered_sums(per_score, keys, score, {"npos": F.col("pos"), "nall": F.col("all")}, hot=hot or find_hot(df, keys))
    pos, count = F.col("pos").cast("double"), F.col("all").cast("double")
    below = (F.col("nall_upto") - F.col("npos_upto")).cast("double") - (count - pos)
    hits = (F.col("npos_total") - F.col("npos_upto")).cast("double") + pos
    seen = (F.col("nall_total") - F.col("nall_upto")).cast("double") + count
    sums = o.groupBy(*keys).agg(
        F.max("nall_total").alias("n"),
        F.max("npos_total").alias("positives"),
        F.sum(pos * (below + (count - pos) / 2)).alias("wins"),
        F.sum(pos * hits / seen).alias("precision_sum"),
    )
    p, n = F.col("positives").cast("double"), (F.col("n") - F.col("positives")).cast("double")
    both = (p > 0) & (n > 0)
    return sums.select(
        *keys,
        "n",
        "positives",
        ratio("positives", "n").alias("prevalence"),
        F.when(both, F.col("wins") / (p * n)).alias("auroc"),
        F.when(both, F.col("precision_sum") / p).alias("average_precision"),
        F.when(both, "estimable").otherwise("one_class").alias("status"),
    )


def melt_scores(df: DataFrame, keep: Sequence[str], scores: Mapping[str, str], model: str = "model") -> DataFrame:
    """One row per score column, named by model; no shuffle."""
    cells = F.array(*[F.struct(F.lit(m).alias(model), F.col(c).cast("double").alias("score")) for m, c in scores.items()])
    return df.select(*keep, F.inline(cells))


def melt_labels(df: DataFrame, keep: Sequence[str], labels: Mapping[str, Column]) -> DataFrame:
    """One row per endpoint with its 0/1 label."""
    cells = F.array(*[F.struct(F.lit(e).alias("endpoint"), c.cast("int").alias("label")) for e, c in labels.items()])
    return df.select(*keep, F.inline(cells))


def topk_enrichment(df: DataFrame, keys: Sequence[str], key: str, label: str, score: str, ks: Sequence[int] = tuple(TOP_K), divide_by_k: bool = False) -> DataFrame:
    """Hits, precision and enrichment among the k best scores, ties by id.

    Each task keeps its own best rows before the shuffle, so only the largest k travels.
    With fewer than k rows the precision divides by the rows taken, or by k on request.
    """
    keys = list(keys)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("prevalence"))
    order = W.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(key).asc())
    best = df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(ks))
    at = best.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("place"))))
    hits = at.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("taken"), F.sum(label).alias("hits"))
    divisor = F.col("k") if divide_by_k else F.col("taken")
    joined = hits.join(totals, keys).withColumn("precision", ratio(F.col("hits"), divisor))
    return joined.select(*keys, "k", "taken", "hits", "precision", F.try_divide("precision", "prevalence").alias("enrichment"))


# --- bootstrap -----------------------------------------------------------------------


def resample(df: DataFrame, keys: Sequence[str], row_key: str, replicates: int, seed: int, first: int = 0) -> DataFrame:
    """Rows with their ``times`` in each ``replicate`` (from ``first``) of a with-replacement resample of the group.

    Draw j of replicate b takes row hash(seed, b, j) mod n. Draws are counted
    per row before they meet the rows, so a row travels once per replicate.
    """
    keys = list(keys)
    keyed = df.withColumn("shuffle_key", seeded_key(F.lit(seed), F.col(row_key)))
    rows = number_rows(keyed, keys, "shuffle_key").drop("shuffle_key")
    draws = rows.select(*keys, "row_index", "group_rows").withColumn(
        "replicate", F.explode(F.sequence(F.lit(first), F.lit(first + replicates - 1)))
    )
    pick = hash_long(seeded_key(F.lit(seed), F.col("replicate"), F.col("row_index"))) % F.col("group_rows")
    times = draws.select(*keys, "replicate", pick.alias("row_index")).groupBy(*keys, "replicate", "row_index").agg(
        F.count(F.lit(1)).alias("times")
    )
    # The optimizer does not see that draws are rows x replicates and would collect them on the driver for a broadcast.
    return rows.join(times.hint("merge"), [*keys, "row_index"]).drop("row_index", "group_rows")


def replicate_metrics(drawn: DataFrame, keys: Sequence[str], label: str, scores: Mapping[str, str], hot: Hot | None = None) -> DataFrame:
    """AUROC and average precision of every model on every replicate; one resample serves all models.

    The result has one row per model and replicate and is written: the summaries read it more than once.
    """
    long = melt_scores(drawn, [*keys, "replicate", label, "times"], scores)
    return materialize(ranking_metrics(long, [*keys, "model", "replicate"], label, "score", "times", hot))


def _tall(df: DataFrame, keep: Sequence[str], suffix: str = "") -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m + suffix).alias("value")) for m in ("auroc", "average_precision")]
    )
    return df.select(*keep, F.inline(cells))


def _limits(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """95 % percentile limits over replicates: one row per replicate, hence the plain aggregate."""
    return values.groupBy(*keys).agg(
        F.count("value").alias("replicates"),
        F.percentile("value", F.lit(0.025)).alias("ci_low"),
        F.percentile("value", F.lit(0.975)).alias("ci_high"),
    )


def _draw(df: DataFrame, keys: Sequence[str], row_key: str, label: str, scores: Mapping[str, str], replicates: int, seed: int, first: int, method: str, hot: Hot | None) -> DataFrame:
    """Metrics per model and replicate: with Poisson weights, or on resamples of the cohort's size."""
    if method == "poisson":
        return poisson_metrics(df, keys, row_key, label, scores, replicates, seed, first)
    return replicate_metrics(resample(df, keys, row_key, replicates, seed, first), keys, label, scores, hot)


def bootstrap_metric(df: DataFrame, keys: Sequence[str], row_key: str, label: str, scores: Mapping[str, str], replicates: int, seed: int, method: str = "multinomial") -> DataFrame:
    """Estimate and percentile interval of each model's metrics; one-class replicates are left out.

    ``method`` is "multinomial" (resamples of the cohort's size, rows x replicates shuffled) or "poisson"
    (weight vectors, see :mod:`.bootstrap`). A one-class cohort stays, with a missing estimate and limits and no replicates.
    """
    keys = list(keys)
    hot = find_hot(df, keys).within()  # a replicate never holds more rows than its cohort
    point = _tall(ranking_metrics(melt_scores(df, [*keys, label], scores), [*keys, "model"], label, "score", hot=hot), [*keys, "model"])
    drawn = _draw(df, keys, row_key, label, scores, replicates, seed, 0, method, hot)
    values = _tall(drawn.where(F.col("auroc").isNotNull()), [*keys, "model"])
    at = [*keys, "model", "metric"]
    out = point.withColumnRenamed("value", "estimate").join(_limits(values, at), at, "left")
    return out.withColumn("replicates", F.coalesce("replicates", F.lit(0)))


def paired_bootstrap(df: DataFrame, keys: Sequence[str], row_key: str, label: str, a: str, b: str, replicates: int = 5000, seed: int = 0, rounds: int = 50, method: str = "poisson") -> DataFrame:
    """Difference of two scores' metrics on common resamples, with the rejected one-class replicates counted.

    Replicates are drawn in rounds of ``replicates`` for the cohorts that still lack valid ones, and the
    first ``replicates`` valid ones are used. After ``rounds`` rounds a cohort keeps what it has, with the
    status "incomplete". A one-class cohort stays, with its status and missing figures. ``method`` as in
    :func:`bootstrap_metric`.
    """
    keys = list(keys)
    scores = {"a": a, "b": b}

    def difference(metrics: DataFrame, extra: Sequence[str]) -> DataFrame:
        wide = metrics.groupBy(*keys, *extra).agg(
            *[
                F.sum(F.when(F.col("model") == "a", F.col(m)).otherwise(-F.col(m))).alias(m)
                for m in ("auroc", "average_precision")
            ]
        )
        return wide

    hot = find_hot(df, keys).within()  # a replicate never holds more rows than its cohort
    points = materialize(difference(ranking_metrics(melt_scores(df, [*keys, label], scores), [*keys, "model"], label, "score", hot=hot), []))
    status = F.when(F.col("auroc").isNull(), "one_class").otherwise("estimable").alias("status")
    estimate = _tall(points.withColumn("status", status), [*keys, "status"]).withColumnRenamed("value", "difference")
    lacking, gaps = points.where(F.col("auroc").isNotNull()).select(*keys), None
    for turn in range(rounds):
        drawn = _draw(df.join(lacking, keys, "left_semi"), keys, row_key, label, scores, replicates, seed, turn * replicates, method, hot)
        found = difference(drawn, ["replicate"])
        gaps = found if gaps is None else gaps.unionByName(found)
        valid = gaps.groupBy(*keys).agg(F.count("auroc").alias("valid")).where(F.col("valid") < replicates)
        lacking = materialize(valid.select(*keys))
        if lacking.isEmpty():
            break
    order = W.partitionBy(*keys, F.col("auroc").isNotNull()).orderBy("replicate")
    placed = gaps.withColumn("place", F.row_number().over(order))
    used = placed.where(F.col("auroc").isNotNull() & (F.col("place") <= replicates))
    limits = _limits(_tall(used, keys), [*keys, "metric"])
    last = used.groupBy(*keys).agg(F.max("replicate").alias("last_used"))
    rejected = gaps.join(last, keys).groupBy(*keys).agg(
        F.count_if(F.col("auroc").isNull() & (F.col("replicate") < F.col("last_used"))).alias("rejected")
    )
    out = estimate.join(limits, [*keys, "metric"], "left").join(rejected, keys, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("replicates", "rejected")})
    lacks = (F.col("status") == "estimable") & (F.col("replicates") < replicates)
    return out.withColumn("status", F.when(lacks, "incomplete").otherwise(F.col("status")))
