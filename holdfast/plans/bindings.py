"""The given tables in the roles the operators expect.

records: line items with their supplier's nation (context) and region (class);
entities: parts, grouped by brand and type, parts of size 1 having no group;
screen: labelled documents, to be judged against the unlabelled ones (corpus).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import SEEDS
from ..functions.scalar import group_or_solo, is_solo, log2_grid
from ..functions.seeding import hash_unit
from ..operators.curation import aggregate_pairs
from ..operators.ordered import Hot, find_hot, group_quantiles, level_quantiles
from ..operators.metrics import apply_intervals, conformal_quantile, conformal_quantiles
from ..operators.splits import grouped_partition, join_partition
from ..session import materialize
from ..sources.io import table

PAIR_KEYS = ["entity", "context", "class", "context_id"]
RUN = ["model", "seed"]
MODELS = ["context_median", "kind_median", "kind_entity_only", "overall_entity_only"]


def records(spark: SparkSession, d: str) -> DataFrame:
    places = (
        table(spark, d, "supplier")
        .join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("n_name").alias("context"), F.col("r_name").alias("class"), F.col("n_nationkey").alias("context_id"))
    )
    lines = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("entity"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_returnflag").alias("unit"),
        F.col("l_linestatus").alias("relation"),
        F.col("l_orderkey").alias("document"),
        F.col("l_suppkey").alias("strain"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.year("l_shipdate").cast("bigint").alias("year"),
    )
    return lines.join(places, F.col("strain") == F.col("s_suppkey")).drop("s_suppkey")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d)
    hot = find_hot(rows, PAIR_KEYS, within=table(spark, d, "lineitem"), inside=["l_partkey"])
    return aggregate_pairs(
        rows, PAIR_KEYS, "value", "target",
        {"n_documents": "document", "n_strains": "strain", "n_units": "unit"}, log=log2_grid, hot=hot,
    )


def targets(spark: SparkSession, d: str, spread: bool = True) -> DataFrame:
    """Pairs with their median target and record count, and on request the spread of their records."""
    wanted = {"target": (0.5, log2_grid)}
    if spread:
        wanted |= {"q25": (0.25, log2_grid), "q75": (0.75, log2_grid)}
    rows = records(spark, d)
    hot = find_hot(rows, PAIR_KEYS, within=table(spark, d, "lineitem"), inside=["l_partkey"])
    q = group_quantiles(rows, PAIR_KEYS, "value", wanted, count="n_records", hot=hot, many=True)
    extra = [(F.col("q75") - F.col("q25")).alias("target_iqr")] if spread else []
    return q.select(*PAIR_KEYS, "target", "n_records", *extra)


def entities(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    group = F.when(F.col("p_size") == 1, F.lit("")).otherwise(F.concat_ws("|", "p_brand", "p_type"))
    base = part.select(
        F.col("p_partkey").alias("entity"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), group.alias("group_key"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("words"),
    )
    return base.withColumns({"assigned": group_or_solo("group_key", "entity"), "is_solo": is_solo("group_key")})


def parted(spark: SparkSession, d: str, seeds: Sequence[int] = tuple(SEEDS)) -> DataFrame:
    return grouped_partition(entities(spark, d), "assigned", seeds)


def labelled(spark: SparkSession, d: str, seeds: Sequence[int] = tuple(SEEDS), keep: Sequence[str] = ("kind",)) -> DataFrame:
    """Pairs under every partition. Written once, with the columns the report needs: the baselines read it several times."""
    pair_columns = [c for c in ("class", "context_id", "n_records", "target_iqr") if c in keep]
    entity_columns = [c for c in ("kind", "group_key", "assigned", "is_solo") if c in keep]
    own = targets(spark, d, "target_iqr" in keep).select("entity", "context", "target", *pair_columns)
    return materialize(join_partition(parted(spark, d, seeds).select("seed", "split", "entity", *entity_columns), own, "entity"))


# What each model looks up, in this order, until there is a median.
LOOKUPS = {
    "context_median": ["by_context"],
    "kind_median": ["by_kind", "by_context"],
    "kind_entity_only": ["kind_only", "overall"],
    "overall_entity_only": ["overall"],
}
LEVELS = {"by_context": ["seed", "context"], "by_kind": ["seed", "context", "kind"], "kind_only": ["seed", "kind"], "overall": ["seed"]}


def _medians(train: DataFrame, levels: dict[str, list[str]], hot: Hot) -> dict[str, DataFrame]:
    """Median target per level. Without a large group all levels are found in one pass, as grouping sets; else in one count."""
    if hot.within() is None:
        return level_quantiles(train, levels, "target", 0.5, hot.buckets)
    finest = [c for c in ("seed", "context", "kind") if any(c in keys for keys in levels.values())]
    sets = train.groupingSets(list(levels.values()), *finest).agg(F.grouping_id().alias("level"), F.percentile("target", F.lit(0.5)).alias("median"))
    sets = materialize(sets)

    def of(out: str, keys: list[str]) -> DataFrame:
        # Bit i from the right is set where the i-th column from the right is not part of the set.
        level = sum(1 << i for i, c in enumerate(reversed(finest)) if c not in keys)
        return sets.where(F.col("level") == level).select(*keys, F.col("median").alias(out))

    return {out: of(out, keys) for out, keys in levels.items()}


def guesses(rows: DataFrame, wanted: Sequence[str] = tuple(MODELS)) -> DataFrame:
    """Median baselines of the training rows for the other rows, one row per wanted model.

    All medians are first put together per (seed, context, kind) and written:
    a table as small as these dimensions, whose known size decides how it is
    joined to the rows. The rows themselves are joined once.
    """
    train = rows.where("split = 'train'")
    hot = find_hot(train, ["seed"], within=rows)
    levels = {out: LEVELS[out] for m in wanted for out in LOOKUPS[m]}
    cells = rows.select("seed", "context", "kind").distinct()
    for out, medians in _medians(train, levels, hot).items():
        cells = cells.join(medians, levels[out], "left")
    guess = F.array(*[F.struct(F.lit(m).alias("model"), F.coalesce(*LOOKUPS[m]).alias("y_pred")) for m in wanted])
    medians = materialize(cells.select("seed", "context", "kind", guess.alias("guess")))
    joined = rows.where("split <> 'train'").join(medians, ["seed", "context", "kind"])
    return joined.select(*rows.columns, F.inline("guess")).withColumnRenamed("target", "y_true")


def calibrate(rows: DataFrame) -> DataFrame:
    """Test rows with both intervals. The quantiles are written first, so that their known size decides the joins."""
    residuals = rows.where("split = 'valid'").select(*RUN, "context", F.abs(F.col("y_true") - F.col("y_pred")).alias("residual"))
    hot = find_hot(residuals, RUN)
    levels = {"pooled": RUN, "own": [*RUN, "context"]}
    if hot.within() is None:
        found = conformal_quantiles(residuals, levels, "residual", hot.cuts)
    else:
        found = {name: materialize(conformal_quantile(residuals, keys, "residual", hot=hot)) for name, keys in levels.items()}
    return apply_intervals(rows.where("split = 'test'"), found["pooled"], found["own"], RUN, "context")


def predictions(spark: SparkSession, d: str, seeds: Sequence[int] = tuple(SEEDS), keep: Sequence[str] = (), wanted: Sequence[str] = tuple(MODELS)) -> DataFrame:
    """Calibrated test predictions of the wanted baselines, written once because the reports read them twice."""
    rows = labelled(spark, d, seeds, ("kind", *keep))
    return materialize(calibrate(guesses(rows, wanted)).drop("split", "kind"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "text")


def screen(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    joined = docs.join(table(spark, d, "labels"), "doc_id")
    return joined.withColumns(
        {
            "quality": F.col("quality").cast("int"),
            "toxic": F.col("toxic").cast("int"),
            "score_length": F.col("n_chars").cast("double"),
            "score_hash": hash_unit(F.md5(F.concat(F.lit("score:"), F.col("doc_id").cast("string")))),
        }
    )


def normal_text(c: str):
    return F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", " ")
