"""From measurement records to one row per (entity, context), with every exclusion on record."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import is_close, normal_unit
from ..session import materialize
from .ordered import Hot, group_quantiles

RETAINED = "retained"


def extract_measurements(facts: DataFrame, assays: DataFrame, structures: DataFrame, assay_key: str, structure_key: str, predicate: Column, documents: DataFrame | None = None, document_key: str | None = None) -> DataFrame:
    """Inner joins to assay and structure under one predicate; documents, if given, join from the left."""
    joined = facts.join(assays, assay_key).join(structures, structure_key).where(predicate)
    return joined if documents is None else joined.join(documents, document_key, "left")


def extract_lineage(facts: DataFrame, sides: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Left joins that keep unmatched facts; ``sides`` maps a marker column to (table, key)."""
    out = facts
    for marker, (side, key) in sides.items():
        out = out.join(side.withColumn(marker, F.lit(True)), key, "left")
        out = out.withColumn(marker, F.coalesce(F.col(marker), F.lit(False)))
    return out


# --- exclusions -----------------------------------------------------------------


def tag_exclusion(df: DataFrame, criteria: Sequence[tuple[str, Column]], out: str = "reason") -> DataFrame:
    """First criterion each row fails, in order; a missing outcome counts as a failure."""
    checks = [F.when(~F.coalesce(keep, F.lit(False)), F.lit(reason)) for reason, keep in criteria]
    return df.withColumn(out, F.coalesce(*checks, F.lit(RETAINED)))


def waterfall(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows retained and excluded at each ordered step, from a single pass over the records."""
    counts = tag_exclusion(df, steps, "step").groupBy("step").agg(F.count(F.lit(1)).alias("rows_excluded"))
    return _ladder(counts, [name for name, _ in steps])


def _ladder(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Retained and excluded rows at each step from the rows excluded per step."""
    counts = df
    ladder = df.sparkSession.createDataFrame(list(enumerate(["input", *names])), "step_order int, step string")
    final = df.sparkSession.createDataFrame([(len(names) + 1, RETAINED)], "step_order int, step string")
    rows = ladder.unionByName(final).join(counts, "step", "left").fillna(0, ["rows_excluded"])
    later = W.partitionBy(F.lit(0)).orderBy(F.col("step_order").desc()).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("rows_retained", F.coalesce(F.sum("rows_excluded").over(later), F.lit(0)))
    return out.where(F.col("step") != RETAINED).select("step_order", "step", "rows_retained", "rows_excluded")


def curate(df: DataFrame, steps: Sequence[tuple[str, Column]], gates: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the retained rows and count while writing: (the rows read back, their waterfall, their gates).

    The counts are observed on the write itself, so neither the waterfall nor the gates read the records again.
    ``gates`` maps a check to the condition that a retained row violates it by; a missing outcome is a violation.
    A stage that runs again for lost output may be observed twice: if the retained rows observed are not those
    written, which the footers tell, everything is counted anew from the records. Gates report (check, violations),
    as the contract checks do.
    """
    names, gates = [name for name, _ in steps], dict(gates or {})
    kept = F.col("exclusion_reason") == RETAINED
    seen = Observation()
    tagged = tag_exclusion(df, steps, "exclusion_reason")
    excluded = [F.count_if(F.col("exclusion_reason") == n).alias(f"step_{i}") for i, n in enumerate([*names, RETAINED])]
    violated = [F.count_if(kept & F.coalesce(bad, F.lit(True))).alias(f"gate_{i}") for i, bad in enumerate(gates.values())]
    rows = materialize(tagged.observe(seen, *excluded, *violated).where(kept).drop("exclusion_reason"))
    found, spark = seen.get, df.sparkSession
    if found[f"step_{len(names)}"] != rows.count():
        found = tagged.agg(*excluded, *violated).first().asDict()
    counts = spark.createDataFrame([(n, found[f"step_{i}"]) for i, n in enumerate([*names, RETAINED])], "step string, rows_excluded long")
    report = spark.createDataFrame([(n, found[f"gate_{i}"]) for i, n in enumerate(gates)], "check string, violations long")
    return rows, _ladder(counts, names), report


def split_missing(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the column known, and the side output where it is missing."""
    return df.where(F.col(column).isNotNull()), df.where(F.col(column).isNull())


# --- aggregation of repeated records ---------------------------------------------


def aggregate_pairs(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    log_value: str,
    distinct: Mapping[str, str],
    first: Mapping[str, tuple[str, str]] | None = None,
    extra: Sequence[Column] = (),
    log: Callable[[Column], Column] = F.log2,
    hot: Hot | None = None,
) -> DataFrame:
    """One row per key: medians of the value and of its log2, quartiles and IQR of the log2,
    record count, distinct counts (missing values are not counted) and first values.

    ``distinct`` maps output to column, ``first`` maps output to (column, order column).
    ``log`` is the transform of a record's value, :func:`log2_grid` for targets that are summed later.
    ``hot`` is the outcome of ``find_hot`` when the caller has it already.
    """
    keys = list(keys)
    wanted = {f"median_{value}": 0.5, log_value: (0.5, log), f"{log_value}_q25": (0.25, log), f"{log_value}_q75": (0.75, log)}
    quantiles = group_quantiles(df, keys, value, wanted, count="n_records", hot=hot).withColumn(
        f"{log_value}_iqr", F.col(f"{log_value}_q75") - F.col(f"{log_value}_q25")
    )
    aggs = [
        *[F.countDistinct(c).alias(out) for out, c in distinct.items()],
        *[F.min_by(c, order).alias(out) for out, (c, order) in (first or {}).items()],
        *extra,
    ]
    return quantiles.join(df.groupBy(*keys).agg(*aggs), keys) if aggs else quantiles


def context_support(pairs: DataFrame, context: str, entity: str, also: Sequence[str] = ()) -> DataFrame:
    """Pairs and distinct entities per context."""
    return pairs.groupBy(context, *also).agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct(entity).alias("entities")
    )


def eligible_contexts(support: DataFrame, context: str, least: int) -> DataFrame:
    """Names of the contexts with enough distinct entities in one of their rows."""
    return support.where(F.col("entities") >= least).select(context).distinct()


def distinct_labels(df: DataFrame, keys: Sequence[str], column: str, out: str, separator: str = "; ") -> DataFrame:
    """Sorted distinct values as one text; duplicates go before anything is gathered.

    Meant for label columns: the result holds each label of the group once.
    """
    values = df.select(*keys, F.col(column).cast("string").alias("label")).where(F.col("label").isNotNull()).distinct()
    return values.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("label")), separator).alias(out))


def value_counts(df: DataFrame, *columns: str, out: str = "rows") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(out))


def field_distributions(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows per value of several fields in one table, missing values as ``<missing>``, with the denominator."""
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("<missing>")).alias("value"))
            for f in fields
        ]
    )
    rows = df.select(F.inline(cells))
    sets = rows.groupingSets([["field", "value"], ["field"]], "field", "value").agg(F.grouping("value").alias("whole"), F.count(F.lit(1)).alias("records"))
    sets = materialize(sets)
    totals = sets.where("whole = 1").select("field", F.col("records").alias("denominator"))
    return sets.where("whole = 0").drop("whole").join(totals, "field").select("field", "value", "records", "denominator")


def relation_profile(df: DataFrame, keys: Sequence[str], relation: str, exact: Sequence[str], censored: Sequence[str]) -> DataFrame:
    """Exact, censored and other relations per key with the censored fraction; a missing relation is "other"."""
    r = F.col(relation)
    is_exact, is_censored = (F.coalesce(r.isin(list(v)), F.lit(False)) for v in (exact, censored))
    counts = df.groupBy(*keys).agg(
        F.count_if(is_exact).alias("exact"),
        F.count_if(is_censored).alias("censored"),
        F.count_if(~is_exact & ~is_censored).alias("other"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.withColumn("censored_fraction", F.col("censored") / F.col("total"))


def source_support(df: DataFrame, keys: Sequence[str], distinct: Mapping[str, str], missing: Mapping[str, str]) -> DataFrame:
    """Records, distinct sources and missing sources per key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        *[F.countDistinct(c).alias(out) for out, c in distinct.items()],
        *[F.count_if(F.col(c).isNull()).alias(out) for out, c in missing.items()],
    )


def dispersion_audit(pairs: DataFrame, records: DataFrame, keys: Sequence[str], spread: str, threshold: float, evidence: Sequence[Column]) -> DataFrame:
    """Evidence about the records behind pairs whose spread reaches the threshold."""
    wide = pairs.where(F.col(spread) >= threshold).select(*keys, spread)
    return records.join(wide, list(keys)).groupBy(*keys, spread).agg(F.count(F.lit(1)).alias("records"), *evidence)


def audit_units(df: DataFrame, value: str, unit: str, standard: str, factors: Mapping[str, float]) -> DataFrame:
    """Convert by unit factor and flag values that disagree with the stored standard value."""
    table = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    out = df.withColumn("normal_unit", normal_unit(unit))
    out = out.withColumn("converted", F.col(value) * F.try_element_at(table, F.col("normal_unit")))
    return out.withColumns(
        {
            "convertible": F.col("converted").isNotNull(),
            "mismatch": F.coalesce(~is_close("converted", standard), F.lit(False)),
        }
    )


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key in a total order; a max-by style aggregate, so copies combine before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order_struct = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order_struct).alias("kept"))
    return picked.select(*keys, "kept.*").select(*df.columns)


def dedup_qc(df: DataFrame, keys: Sequence[str], valid: Column) -> DataFrame:
    """Input, invalid, valid, kept and dropped row counts of a de-duplication, in one pass over key counts."""
    per_key = df.withColumn("is_valid", F.coalesce(valid, F.lit(False))).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_valid")).alias("v")
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"),
        F.coalesce(F.sum(F.col("n") - F.col("v")), F.lit(0)).alias("invalid_rows"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("valid_rows"),
        F.count_if(F.col("v") > 0).alias("deduplicated_rows"),
        F.coalesce(F.sum(F.greatest(F.col("v") - 1, F.lit(0))), F.lit(0)).alias("dropped_duplicates"),
    )


def dedup_kept_counts(df: DataFrame, keys: Sequence[str], valid: Column, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows that a de-duplication keeps, by value of each of ``columns`` (labels, sources): field, value, kept_rows."""
    kept = dedup_first(df.where(F.coalesce(valid, F.lit(False))).select(*keys, *order, *columns), keys, order)
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return kept.select(F.inline(cells)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("kept_rows"))


# --- temporal cohorts ---------------------------------------------------------------


def first_seen(df: DataFrame, entity: str, time: str, out: str = "first_year") -> DataFrame:
    return df.groupBy(entity).agg(F.min(time).alias(out))


def cohort_of(year: Column, windows: Mapping[str, tuple[int | None, int | None]], outside: str = "outside_window") -> Column:
    """Name of the closed year window; an open end is None."""
    out = F.lit(outside)
    for name, (low, high) in reversed(list(windows.items())):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (year >= low)
        if high is not None:
            inside = inside & (year <= high)
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def temporal_cohorts(df: DataFrame, entity: str, time: str, windows: Mapping[str, tuple[int | None, int | None]]) -> DataFrame:
    """Attach the cohort of the entity's first year, and whether the record lies in that cohort's own window."""
    firsts = first_seen(df, entity, time).withColumn("cohort", cohort_of(F.col("first_year"), windows))
    joined = df.join(firsts, entity)
    own = (F.col("cohort") == cohort_of(F.col(time), windows)) & F.col("cohort").isin(list(windows))
    return joined.withColumn("in_own_window", own)


def excluded_missing(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isNull()).select(*keep)
