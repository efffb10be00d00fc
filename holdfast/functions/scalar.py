"""Row-level expressions of the curation and evaluation reports."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import MARGIN_FACTOR, SOLO_PREFIX

_OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True for a number that is neither missing, NaN nor infinite."""
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def to_number(c: Column | str) -> Column:
    """Text to double; what does not parse is missing."""
    return col(c).try_cast("double")


def coerce_positive(df: DataFrame, name: str) -> DataFrame:
    """Make ``name`` a double and keep the rows where it is finite and above zero."""
    return df.withColumn(name, to_number(name)).where(is_finite(name) & (F.col(name) > 0))


def with_log2(df: DataFrame, name: str, out: str) -> DataFrame:
    return df.withColumn(out, F.log2(F.col(name)))


def log2_grid(c: Column | str, bits: int = 20) -> Column:
    """log2 rounded to a multiple of 2**-bits.

    Sums and medians of such targets are exact in doubles, so a report does not
    depend on the order in which partitions are added.
    """
    steps = float(1 << bits)
    return F.round(F.log2(col(c)) * F.lit(steps)) / F.lit(steps)


def is_binomial(c: Column | str) -> Column:
    """Two-word name: no rank marker, no slash, both leading words start with a letter."""
    name = F.trim(col(c))
    words = F.split(name, r"\s+")
    lowered = F.lower(name)
    return F.coalesce(
        name.contains(" ")
        & ~lowered.contains(" sp.")
        & ~lowered.contains(" spp.")
        & ~name.contains("/")
        & F.get(words, F.lit(0)).rlike(r"^\p{L}")
        & F.get(words, F.lit(1)).rlike(r"^\p{L}"),
        F.lit(False),
    )


def classify(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Label of the first rule that holds."""
    head, *rest = rules
    out = F.when(head[0], F.lit(head[1]))
    for condition, label in rest:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default))


def bin_left(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins closed on the left: label i covers edges[i-1] <= x < edges[i]; the last label is open above."""
    x = col(c)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(x < F.lit(float(edge)), F.lit(label))
    return out.otherwise(F.lit(labels[len(edges)]))


def bin_right(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins closed on the right: label i covers edges[i] < x <= edges[i+1], the first also its lower edge."""
    x = col(c)
    out = F.when(x < F.lit(float(edges[0])), F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels):
        out = out.when(x <= F.lit(float(edge)), F.lit(label))
    return out


def any_active(columns: Sequence[str]) -> Column:
    """Largest of several 0/1 labels; missing ones are skipped."""
    return F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])


def pooled_label(columns: Sequence[str], threshold: float) -> Column:
    """1 if an observed p-value is at most the threshold, 0 if all are observed and none is, else missing."""
    hit = reduce(operator.or_, [F.coalesce(F.col(c) <= threshold, F.lit(False)) for c in columns])
    complete = reduce(operator.and_, [F.col(c).isNotNull() for c in columns])
    return F.when(hit, F.lit(1)).when(complete, F.lit(0))


def margin_score(mass: Column | str, prediction: Column | str | None = None, factor: float = MARGIN_FACTOR) -> Column:
    """log2(factor * mass) minus the prediction; without a prediction it is the control score."""
    base = F.log2(F.lit(factor) * col(mass))
    return base if prediction is None else base - col(prediction)


def normal_unit(c: Column | str) -> Column:
    """Unit text without case, blanks and dots."""
    return F.regexp_replace(F.lower(F.trim(col(c))), r"[\s.]", "")


def is_close(a: Column | str, b: Column | str, rtol: float = 1e-6, atol: float = 0.0) -> Column:
    return F.abs(col(a) - col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(col(b))


def rule_flag(rules: Sequence[tuple[str, str, float]]) -> Column:
    """1 if every (column, comparison, value) holds, 0 if one fails, missing if a column is missing."""
    present = reduce(operator.and_, [F.col(c).isNotNull() for c, _, _ in rules])
    holds = reduce(operator.and_, [_OPS[op](F.col(c), F.lit(v)) for c, op, v in rules])
    return F.when(present, holds.cast("int"))


def clean_feature(c: Column | str) -> Column:
    """NaN, infinite and missing feature values become 0."""
    x = col(c).cast("double")
    return F.when(is_finite(x), x).otherwise(F.lit(0.0))


def error_columns(df: DataFrame, truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Signed and absolute error with the within-one and within-two indicators."""
    error = F.col(guess) - F.col(truth)
    return df.withColumns(
        {
            "error": error,
            "absolute_error": F.abs(error),
            "within_one": (F.abs(error) <= 1.0).cast("double"),
            "within_two": (F.abs(error) <= 2.0).cast("double"),
        }
    )


def covered(truth: Column | str, lower: Column | str, upper: Column | str) -> Column:
    """1.0 inside the closed interval, 0.0 outside it or without an interval."""
    return F.coalesce(col(truth).between(col(lower), col(upper)), F.lit(False)).cast("double")


def group_or_solo(group: Column | str, entity: Column | str) -> Column:
    """Group key, or a key of its own for an entity whose group key is empty."""
    return F.when(is_solo(group), F.concat(F.lit(SOLO_PREFIX), col(entity).cast("string"))).otherwise(col(group))


def is_solo(group: Column | str) -> Column:
    return F.coalesce(col(group), F.lit("")) == ""


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, missing when b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))
