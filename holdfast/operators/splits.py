"""Partitions that keep groups whole, samples, folds and the audits of all of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import SEEDS, TRAIN_FRACTION, VALID_FRACTION
from ..functions.scalar import is_solo, ratio
from ..functions.seeding import key_bucket, seeded_key
from ..session import materialize
from .ordered import number_rows, ordered_sums


PLACES = 1024  # places of a sorted column in one bucket


def _with_seeds(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def _shuffled_groups(entities: DataFrame, group: str, seeds: Sequence[int]) -> DataFrame:
    """Groups per seed in shuffled order, with the entities before each group and in total."""
    sizes = entities.groupBy(group).agg(F.count(F.lit(1)).alias("n_size"))
    keyed = _with_seeds(sizes, seeds).withColumn("shuffle_key", seeded_key(F.col("seed"), F.col(group)))
    summed = ordered_sums(keyed, ["seed"], "shuffle_key", {"n": F.col("n_size")}, key_bucket(F.col("shuffle_key")))
    return summed.withColumn("prior", F.col("n_upto") - F.col("n_size"))


def _spread(entities: DataFrame, group: str, group_splits: DataFrame) -> DataFrame:
    """Give every entity its group's split under every seed. Groups carry all seeds in one row, so
    entities are shuffled once, not once per seed, and a hot group is split by the skew-join rule."""
    packed = group_splits.groupBy(group).agg(F.collect_list(F.struct("seed", "split")).alias("by_seed"))
    joined = entities.join(packed.hint("merge"), group)
    return joined.select(*entities.columns, F.inline("by_seed"))


def join_partition(partition: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the entities under every partition.

    A partition has a row per entity and seed, but the optimizer takes it to be as small as the compressed columns it
    was read from. The hint keeps it off the driver, where a broadcast would collect it.
    """
    return partition.hint("merge").join(rows, key)


def grouped_partition(entities: DataFrame, group: str, seeds: Sequence[int] = tuple(SEEDS), train: float = TRAIN_FRACTION, valid: float = VALID_FRACTION) -> DataFrame:
    """Train / valid / test per seed with whole groups only.

    Groups come in seeded order. A group goes to train while fewer than
    round(train * n) entities were placed before it, then to valid while fewer
    than round(valid * n) were placed there, else to test. Rounding is half-even.
    """
    groups = _shuffled_groups(entities, group, seeds).withColumn(
        "in_train", F.col("prior") < F.bround(F.lit(train) * F.col("n_total"))
    )
    train_size = groups.where("in_train").groupBy("seed").agg(F.sum("n_size").alias("train_size"))
    split = (
        F.when(F.col("in_train"), "train")
        .when(F.col("prior") - F.coalesce("train_size", F.lit(0)) < F.bround(F.lit(valid) * F.col("n_total")), "valid")
        .otherwise("test")
    )
    placed = groups.join(train_size, "seed", "left").select(group, "seed", split.alias("split"))
    return _spread(entities, group, placed)


def grouped_train_test(entities: DataFrame, group: str, seed: int, test_size: float) -> DataFrame:
    """Two-way split with whole groups: groups in seeded order fill the test side first. An empty side is an error."""
    groups = _shuffled_groups(entities, group, [seed])
    goal = F.bround(F.lit(test_size) * F.col("n_total"))
    placed = materialize(groups.select(group, "seed", F.when(F.col("prior") < goal, "test").otherwise("train").alias("split")))
    if placed.select("split").distinct().count() < 2:
        raise ValueError("the split leaves the train or the test side empty")
    return _spread(entities, group, placed)


def stratified_split(df: DataFrame, key: str, label: str, seed: int, test_size: float) -> DataFrame:
    """Random split that keeps the label shares: within a label the first round(n * size) rows are test."""
    keyed = df.withColumn("shuffle_key", seeded_key(F.lit(seed), F.col(key)))
    numbered = number_rows(keyed, [label], "shuffle_key", "place")
    goal = F.bround(F.lit(test_size) * F.col("group_rows"))
    return numbered.withColumn("split", F.when(F.col("place") < goal, "test").otherwise("train")).drop(
        "shuffle_key", "place", "group_rows"
    )


def split_report(partition: DataFrame, entity: str, group: str) -> DataFrame:
    """Entities and distinct groups per seed and split."""
    return partition.groupBy("seed", "split").agg(
        F.countDistinct(entity).alias("entities"), F.countDistinct(group).alias("groups")
    )


def split_label_counts(partition: DataFrame, label: str) -> DataFrame:
    """Rows of each label on each side, per seed."""
    return partition.groupBy("seed", "split", label).agg(F.count(F.lit(1)).alias("rows"))


def split_group_report(partition: DataFrame, group: str) -> DataFrame:
    """Per seed: distinct groups on both sides, the share of test groups seen in train, and test entities in such groups."""
    sides = partition.groupBy("seed", group).agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )
    both = (F.col("n_train") > 0) & (F.col("n_test") > 0)
    return sides.groupBy("seed").agg(
        F.count_if(F.col("n_train") > 0).alias("train_groups"),
        F.count_if(F.col("n_test") > 0).alias("test_groups"),
        F.count_if(both).alias("overlap_groups"),
        ratio(F.sum(F.when(both, F.col("n_test")).otherwise(0)), F.sum("n_test")).alias("overlap_fraction_of_test"),
    )


def partition_overlap(df: DataFrame, part: str, parts: Sequence[str], units: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Values shared by each pair of parts, per unit column. Only (value, part) presence flags are shuffled."""
    cells = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("string").alias("unit_value")) for u in units])
    long = df.select(*by, part, F.inline(cells)).where(F.col("unit_value").isNotNull())
    present = long.groupBy(*by, "unit", "unit_value").agg(
        *[F.max((F.col(part) == p).cast("int")).alias(f"in_{p}") for p in parts]
    )
    pairs = [(a, b) for i, a in enumerate(parts) for b in parts[i + 1 :]]
    counts = present.groupBy(*by, "unit").agg(
        *[F.sum(F.col(f"in_{a}") * F.col(f"in_{b}")).alias(f"{a}|{b}") for a, b in pairs]
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("part_a"), F.lit(b).alias("part_b"), F.col(f"{a}|{b}").alias("shared"))
            for a, b in pairs
        ]
    )
    return counts.select(*by, "unit", F.inline(rows))


def set_difference_audit(expected: DataFrame, observed: DataFrame, by: Sequence[str], entity: str, context: str) -> DataFrame:
    """Missing and unexpected entities and (entity, context) pairs of each run, with a match flag.

    Both tables carry the run columns ``by``.
    """
    by = list(by)
    a = expected.select(*by, entity, context).distinct().withColumn("e", F.lit(1))
    b = observed.select(*by, entity, context).distinct().withColumn("o", F.lit(1))
    pairs = a.join(b, [*by, entity, context], "full")
    per_entity = pairs.groupBy(*by, entity).agg(
        F.max("e").alias("e"),
        F.max("o").alias("o"),
        F.count("e").alias("e_pairs"),
        F.count("o").alias("o_pairs"),
        F.count_if(F.col("e").isNotNull() & F.col("o").isNull()).alias("m_pairs"),
        F.count_if(F.col("e").isNull() & F.col("o").isNotNull()).alias("u_pairs"),
    )
    out = per_entity.groupBy(*by).agg(
        F.count("e").alias("expected_entities"),
        F.count("o").alias("observed_entities"),
        F.count_if(F.col("e").isNotNull() & F.col("o").isNull()).alias("missing_entities"),
        F.count_if(F.col("e").isNull() & F.col("o").isNotNull()).alias("unexpected_entities"),
        F.sum("e_pairs").alias("expected_pairs"),
        F.sum("o_pairs").alias("observed_pairs"),
        F.sum("m_pairs").alias("missing_pairs"),
        F.sum("u_pairs").alias("unexpected_pairs"),
    )
    clean = F.col("missing_entities") + F.col("unexpected_entities") + F.col("missing_pairs") + F.col("unexpected_pairs") == 0
    return out.withColumn("split_match", clean)


# --- samples ----------------------------------------------------------------------


def limit_entities(df: DataFrame, entity: str, n: int) -> DataFrame:
    """Rows of the first n entities in key order."""
    return df.join(df.select(entity).distinct().orderBy(entity).limit(n), entity, "left_semi")


def sample_per_group(df: DataFrame, by: Sequence[str], key: Sequence[str], n: int, seed: int) -> DataFrame:
    """At most n rows per group in seeded order; each task keeps its own first n before the shuffle."""
    keyed = df.withColumn("shuffle_key", seeded_key(F.lit(seed), *[F.col(k) for k in key]))
    order = W.partitionBy(*by).orderBy("shuffle_key")
    return keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place", "shuffle_key")


def stratified_subsample(df: DataFrame, key: str, label: str, n: int, seed: int) -> DataFrame:
    """About n rows with every label kept: round(n * share), at least one, per label, then trimmed to n."""
    keyed = df.withColumn("shuffle_key", seeded_key(F.lit(seed), F.col(key)))
    numbered = number_rows(keyed, [label], "shuffle_key", "place")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.bround(F.lit(float(n)) * F.col("group_rows") / total)
    drawn = numbered.where(F.col("place") < F.greatest(share, F.lit(1.0))).drop("place", "group_rows")
    return drawn.orderBy("shuffle_key").limit(n).drop("shuffle_key")


def quota_sample(partition: DataFrame, entity: str, n: int, seed: int, shares: Mapping[str, float]) -> DataFrame:
    """round(share * n) entities of each split in seeded order; the last split takes what is left of n."""
    names = list(shares)
    quotas = {s: round(n * shares[s]) for s in names[:-1]}
    quotas[names[-1]] = n - sum(quotas.values())
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    keyed = partition.withColumn("shuffle_key", seeded_key(F.lit(seed), F.col(entity)))
    order = W.partitionBy("split").orderBy("shuffle_key")
    placed = keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(quotas.values()))
    return placed.where(F.col("place") <= quota[F.col("split")]).drop("place", "shuffle_key")


# --- temporal contract --------------------------------------------------------------


def temporal_contract(pairs: DataFrame, units: Mapping[str, str], context: str, windows: Mapping[str, tuple[int | None, int | None]]) -> DataFrame:
    """One row per check of the temporal split: shared units, years inside their window, contexts unseen in train.

    ``pairs`` has cohort, context, first_year, year_min, year_max and the columns of ``units`` (entity,
    group key, parent key), each given with its plural for the name of the check. ``all_passed`` is the
    verdict over all checks.
    """
    names = list(windows)
    base = names[0]
    inside = {}
    for name, (low, high) in windows.items():
        mine = F.col("cohort") == name
        bad_first = F.lit(False)
        bad_year = F.lit(False)
        if low is not None:
            bad_first, bad_year = bad_first | (F.col("first_year") < low), bad_year | (F.col("year_min") < low)
        if high is not None:
            bad_first, bad_year = bad_first | (F.col("first_year") > high), bad_year | (F.col("year_max") > high)
        inside[f"{name}_first_year_outside_window"] = F.count_if(mine & bad_first)
        inside[f"{name}_records_outside_window"] = F.count_if(mine & bad_year)
    years = pairs.agg(*[c.alias(k) for k, c in inside.items()])
    plural = F.create_map(*[F.lit(v) for pair in units.items() for v in pair])
    shared = partition_overlap(pairs, "cohort", names, list(units)).select(
        F.concat(plural[F.col("unit")], F.lit("_shared_"), F.col("part_a"), F.lit("_"), F.col("part_b")).alias("check"),
        F.col("shared").alias("violations"),
    )
    seen = pairs.groupBy(context).agg(*[F.max((F.col("cohort") == n).cast("int")).alias(n) for n in names])
    absent = seen.agg(
        *[F.count_if((F.col(n) == 1) & (F.col(base) == 0)).alias(f"{n}_contexts_absent_from_{base}") for n in names[1:]]
    )

    def tall(row: DataFrame) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in row.columns])
        return row.select(F.inline(cells))

    checks = shared.unionByName(tall(years)).unionByName(tall(absent))
    checks = checks.withColumn("passed", F.col("violations") == 0)
    return checks.withColumn("all_passed", F.min("passed").over(W.partitionBy(F.lit(0))))  # one row per check


def cohort_context_sets(pairs: DataFrame, context: str, names: Sequence[str]) -> DataFrame:
    """Which cohorts support each context, as flags."""
    return pairs.groupBy(context).agg(
        *[F.max((F.col("cohort") == n).cast("int")).alias(f"in_{n}") for n in names],
        *[F.count_if(F.col("cohort") == n).alias(f"{n}_pairs") for n in names],
    )


# --- leave one context out --------------------------------------------------------------


def flag_seen_elsewhere(pairs: DataFrame, entity: str, context: str) -> DataFrame:
    """Whether the pair's entity has a pair in another context. One count per entity replaces the folds."""
    spread = pairs.groupBy(entity).agg(F.countDistinct(context).alias("n_contexts"))
    return pairs.join(spread, entity).withColumn("seen_elsewhere", F.col("n_contexts") > 1).drop("n_contexts")


def held_out_medians(pairs: DataFrame, context: str, target: str, out: str = "y_pred") -> DataFrame:
    """Median target of all other contexts, for each context, without copying the table once per fold.

    The place p of the median among the others is turned into a place in the
    whole table: p plus the own rows that come before it. Own rows of a value v
    come before it if at most p other rows have a value up to v.
    """
    counts = pairs.groupBy(context, target).agg(F.count(F.lit(1)).alias("own"))
    whole = ordered_sums(counts.groupBy(target).agg(F.sum("own").alias("rows")), [], target, {"all": F.col("rows")})
    own = ordered_sums(counts, [context], target, {"own": F.col("own")})
    others = F.col("all_upto") - F.col("own_upto")
    middle = (F.col("all_total") - F.col("own_total") - 1) / F.lit(2.0)
    shift = lambda p: F.coalesce(F.max(F.when(others <= p, F.col("own_upto"))), F.lit(0))
    places = own.join(whole, target).groupBy(context).agg(
        (F.max(F.floor(middle)) + shift(F.floor(middle))).alias("low"), (F.max(F.ceil(middle)) + shift(F.ceil(middle))).alias("high")
    )
    # A place lies in the one distinct target that covers it: both meet by the place's bucket of PLACES,
    # in which a target stands once for every bucket it covers.
    first, last = F.col("all_upto") - F.col("rows"), F.col("all_upto") - 1
    bucket = lambda place: F.floor(place / PLACES)
    covers = whole.select(target, first.alias("first"), last.alias("last")).withColumn("bucket", F.explode(F.sequence(bucket(F.col("first")), bucket(F.col("last")))))
    wanted = places.select(context, F.explode(F.array("low", "high")).alias("place")).withColumn("bucket", bucket(F.col("place")))
    hits = wanted.join(covers, "bucket").where(F.col("place").between(F.col("first"), F.col("last")))
    return hits.groupBy(context).agg(F.avg(target).alias(out))


def leave_one_out_audit(pairs: DataFrame, entity: str, context: str, klass: str) -> DataFrame:
    """Train and test sizes of each held-out context: totals minus own group, so nothing is replicated per fold."""
    flagged = flag_seen_elsewhere(pairs, entity, context)
    own = flagged.groupBy(context, klass).agg(
        F.count(F.lit(1)).alias("test_pairs"),
        F.countDistinct(entity).alias("test_entities"),
        F.count_if(F.col("seen_elsewhere")).alias("seen_in_other_contexts"),
        F.count_if(~F.col("seen_elsewhere")).alias("not_seen_elsewhere"),
        F.countDistinct(F.when(~F.col("seen_elsewhere"), F.col(entity))).alias("own_entities"),
    )
    all_pairs = pairs.agg(F.count(F.lit(1)).alias("v")).scalar()
    all_entities = pairs.agg(F.countDistinct(entity).alias("v")).scalar()
    classes = W.partitionBy(klass)
    return own.select(
        context,
        klass,
        (all_pairs - F.col("test_pairs")).alias("train_pairs"),
        "test_pairs",
        (all_entities - F.col("own_entities")).alias("train_entities"),
        "test_entities",
        "seen_in_other_contexts",
        "not_seen_elsewhere",
        (F.count(F.lit(1)).over(classes) > 1).alias("class_known_from_train"),
    )


def unknown_class_folds(pairs: DataFrame, context: str, klass: str) -> DataFrame:
    """Held-out contexts whose class no other context has."""
    members = pairs.select(context, klass).distinct()
    lone = members.groupBy(klass).agg(F.count(F.lit(1)).alias("n"), F.min(context).alias(context))
    return lone.where(F.col("n") == 1).select(context, klass)


# --- cohorts -----------------------------------------------------------------------


def explode_cohorts(df: DataFrame, cohorts: Mapping[str, Column], out: str = "cohort") -> DataFrame:
    """Long form: one row per cohort the row belongs to."""
    names = F.filter(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in cohorts.items()]), lambda x: x.isNotNull()
    )
    return df.withColumn(out, F.explode(names))


def cohort_counts(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Size of every cohort in one row."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def overlap_status(query: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Query size, reference size, shared keys and what follows from them."""
    marks = query.select(key).distinct().withColumn("q", F.lit(1)).join(
        reference.select(key).distinct().withColumn("r", F.lit(1)), key, "full"
    )
    out = marks.agg(
        F.count("q").alias("query_keys"),
        F.count("r").alias("reference_keys"),
        F.count_if(F.col("q").isNotNull() & F.col("r").isNotNull()).alias("shared_keys"),
    )
    return out.withColumn("status", F.when(F.col("shared_keys") == 0, "clean").otherwise("requires_exclusion"))


def cohort_flow(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows, positives and prevalence per key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"), F.avg(F.col(label).cast("double")).alias("prevalence")
    )


def fallback_audit(entities: DataFrame, group: str) -> DataFrame:
    """Entities without a group key and their share."""
    return entities.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(is_solo(group)).alias("without_group"),
        ratio(F.count_if(is_solo(group)), F.count(F.lit(1))).alias("fraction_without_group"),
    )
