"""Ordered sums, ranks, row numbers and exact quantiles that never put one large group into one task.

Groups of up to ``HOT_ROWS`` rows take a plain window or aggregate: one
shuffle. A larger group is cut into order-preserving buckets of about equally
many rows, at splitters from a quantile sketch of the group: sums run inside a
bucket, and the totals of the group's earlier buckets are added. Where only
the values at some places are asked for, rows are counted per bucket and those
next to a wanted place alone are shuffled and sorted. A count per group,
combined on the map side, tells which groups are large; the list of them and
their splitters are written, and the optimizer chooses the joins by their size.

Order values that are no plain numbers have one place on either path, that of
a Spark sort: missing first, then minus infinity, the numbers, infinity, NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seeding import key_bucket
from ..session import materialize

BUCKET = "order_bucket"

# Rows of a group that one task sorts or holds with ease.
HOT_ROWS = 1_000_000

# Least buckets of a large group; more where it is more than so many parts of HOT_ROWS.
BUCKETS = 64

# Counts of many groups together, when no large one is expected.
SHARED = 1 << 16


class Hot:
    """Large groups of a table: none, some (a written list of keys), or the whole table."""

    def __init__(self, keys: Sequence[str], groups: DataFrame | None = None, everything: bool = False, buckets: int = BUCKETS, cuts: int = BUCKETS):
        """``buckets`` are for the rows of the largest group, ``cuts`` for those of all large groups together."""
        self.keys, self.groups, self.everything, self.buckets, self.cuts = list(keys), groups, everything, buckets, cuts

    def usual(self, df: DataFrame) -> DataFrame | None:
        if self.everything:
            return None
        return df if self.groups is None else df.join(self.groups, self.keys, "left_anti")

    def large(self, df: DataFrame) -> DataFrame | None:
        if self.everything:
            return df
        return None if self.groups is None else df.join(self.groups, self.keys, "left_semi")

    def split(self, df: DataFrame, plain: Callable[[DataFrame], DataFrame], bucketed: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Each part of the table by its own method."""
        usual, large = self.usual(df), self.large(df)
        if usual is None or large is None:
            return plain(usual) if large is None else bucketed(large)
        return plain(usual).unionByName(bucketed(large))

    def within(self) -> Hot | None:
        """What this outcome says about any finer grouping: without a large group there is none; else it must be looked for."""
        return self if self.groups is None and not self.everything else None


def find_hot(df: DataFrame, keys: Sequence[str], hot_above: int = HOT_ROWS, within: DataFrame | None = None, inside: Sequence[str] = ()) -> Hot:
    """Look for groups above ``hot_above`` rows. Runs one count over the rows; only its outcome reaches the driver.

    ``within`` is a stored table with at least as many rows as df: if it has too few for any large group, which
    its footers tell, df is not computed for the count. Nor is it if the groups of ``inside``, columns of that table
    whose groups contain those of df, are all small: they are counted together by hash, which shuffles no key.
    """
    keys = list(keys)
    if within is not None and within.count() <= hot_above:
        return Hot(keys)
    if within is not None and inside:
        together = within.groupBy(F.pmod(F.hash(*inside), F.lit(SHARED)).alias("share")).agg(F.count(F.lit(1)).alias("n"))
        if together.agg(F.max("n")).first()[0] <= hot_above:
            return Hot(keys)

    def cut(rows: int) -> int:
        return max(BUCKETS, -(-4 * rows // hot_above))

    if not keys:
        rows = df.count()
        return Hot(keys, everything=rows > hot_above, buckets=cut(rows), cuts=cut(rows))
    groups = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_n")).where(F.col("group_n") > hot_above))
    most, together = groups.agg(F.max("group_n"), F.sum("group_n")).first()
    return Hot(keys) if most is None else Hot(keys, groups.select(*keys), buckets=cut(most), cuts=cut(together))


def balanced_buckets(df: DataFrame, keys: Sequence[str], order: str, buckets: int) -> DataFrame:
    """Add the order-preserving ``order_bucket`` of a number: about as many rows of a group in each.

    The splitters come from one quantile sketch per group, put together from the tasks' sketches; equal values
    share a bucket. Missing, infinite and NaN values have a bucket each, where a sort puts them.
    """
    keys = list(keys)
    if not keys:
        return balanced_buckets(df.withColumn("whole_table", F.lit(0)), ["whole_table"], order, buckets).drop("whole_table")
    x = F.col(order).cast("double")
    least, most = F.lit(float("-inf")), F.lit(float("inf"))
    plain = x.isNotNull() & ~F.isnan(x) & (x != least) & (x != most)
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    sketched = df.where(plain).groupBy(*keys).agg(F.percentile_approx(x, shares, F.lit(max(10_000, 50 * buckets))).alias("splitters"))
    # Two steps of comparisons instead of one over all splitters: first with every n-th of them.
    step = math.isqrt(buckets) + 1
    coarse = F.transform(F.sequence(F.lit(0), F.size("splitters") - 1, F.lit(step)), lambda i: F.get("splitters", i))
    splitters = materialize(sketched.select(*keys, "splitters", coarse.alias("coarse")))
    joined = df.join(splitters, keys, "left")

    def up_to(values: Column) -> Column:
        return F.size(F.filter(values, lambda s: s <= x))

    ahead = up_to(F.col("coarse"))
    start = F.greatest(ahead - 1, F.lit(0)) * step
    number = F.when(ahead == 0, F.lit(0)).otherwise(start + up_to(F.slice("splitters", start + 1, F.lit(step)))) + 1
    end = F.lit(buckets + 1)
    bucket = F.when(x.isNull(), -1).when(F.isnan(x), end + 1).when(x == least, 0).when(x == most, end).otherwise(number)
    return joined.select(*df.columns, bucket.alias(BUCKET))


def ordered_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    bucket: Column | None = None,
    hot: Hot | None = None,
) -> DataFrame:
    """Add, per name in ``sums``, ``<name>_upto`` (sum over all rows of the group with an order
    value at most this row's, ties included) and ``<name>_total`` (sum over the group).

    ``bucket`` must not decrease with ``order``; by default it comes from :func:`balanced_buckets`.
    Pre-aggregate to one row per (keys, order) where ties may be many. ``hot`` is the outcome of
    :func:`find_hot` when the caller has it already.
    """
    keys = list(keys)
    hot = hot or find_hot(df, keys)
    return hot.split(df, lambda x: _windowed(x, keys, order, sums), lambda x: _bucketed(x, keys, order, sums, bucket, hot.buckets))


def _windowed(df: DataFrame, keys: list[str], order: str, sums: Mapping[str, Column]) -> DataFrame:
    group = W.partitionBy(*keys)
    upto = group.orderBy(order)
    return df.select(
        "*",
        *[F.sum(e).over(upto).alias(f"{n}_upto") for n, e in sums.items()],
        *[F.sum(e).over(group).alias(f"{n}_total") for n, e in sums.items()],
    )


def _bucketed(df: DataFrame, keys: list[str], order: str, sums: Mapping[str, Column], bucket: Column | None, buckets: int) -> DataFrame:
    cut = balanced_buckets(df, keys, order, buckets) if bucket is None else df.withColumn(BUCKET, bucket)
    scoped = cut.select("*", *[e.alias(f"{n}_w") for n, e in sums.items()])
    if not keys:
        keys, scoped = ["whole_table"], scoped.withColumn("whole_table", F.lit(0))
    cell = [*keys, BUCKET]
    earlier = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy(*keys)
    totals = scoped.groupBy(*cell).agg(*[F.sum(f"{n}_w").alias(f"{n}_cell") for n in sums])
    totals = totals.select(
        *cell,
        *[F.coalesce(F.sum(f"{n}_cell").over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums],
        *[F.sum(f"{n}_cell").over(group).alias(f"{n}_total") for n in sums],
    )
    inside = W.partitionBy(*cell).orderBy(order)
    out = scoped.select("*", *[F.sum(f"{n}_w").over(inside).alias(f"{n}_inside") for n in sums]).join(totals, cell)
    return out.select(
        *df.columns,
        *[(F.col(f"{n}_inside") + F.col(f"{n}_before")).alias(f"{n}_upto") for n in sums],
        *[F.col(f"{n}_total") for n in sums],
    )


def number_rows(df: DataFrame, keys: Sequence[str], hex_key: str, out: str = "row_index") -> DataFrame:
    """Number the rows of each group 0, 1, ... in the order of a unique hex key; also ``group_rows``."""
    numbered = ordered_sums(df, keys, hex_key, {"n_rows": F.lit(1)}, key_bucket(F.col(hex_key)))
    return numbered.select(
        *df.columns, (F.col("n_rows_upto") - 1).alias(out), F.col("n_rows_total").alias("group_rows")
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str, hot: Hot | None = None) -> DataFrame:
    """Average rank of ``value`` in its group, each row counting ``weight`` times; also ``<out>_n``.

    Rows are counted per distinct value first and ranks are found over the values, so however many
    rows are tied, no task has to hold them.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.sum(weight).alias("nt"))
    placed = ordered_sums(counts, keys, value, {"nr": F.col("nt")}, hot=hot)
    rank = F.col("nr_upto") - (F.col("nt") - 1) / F.lit(2.0)
    ranks = placed.select(*keys, value, rank.alias(out), F.col("nr_total").alias(f"{out}_n"))
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "spearman", hot: Hot | None = None, count: str | None = None) -> DataFrame:
    """Rank correlation per group with average ranks; missing below two rows or for a constant side. With ``count`` a row stands for so many."""
    keys = list(keys)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y, *([count] if count else []))
    hot = hot or find_hot(rows, keys)
    cells = rows.groupBy(*keys, x, y).agg((F.sum(count) if count else F.count(F.lit(1))).alias("cell_n"))
    ranked = average_rank(average_rank(cells, keys, x, "cell_n", "rank_x", hot), keys, y, "cell_n", "rank_y", hot)
    middle = (F.col("rank_x_n") + 1) / F.lit(2.0)
    dx, dy, w = F.col("rank_x") - middle, F.col("rank_y") - middle, F.col("cell_n")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w * dx * dy).alias("sxy"), F.sum(w * dx * dx).alias("sxx"), F.sum(w * dy * dy).alias("syy")
    )
    rho = F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    return sums.select(*keys, rho.alias(out))


Wanted = Mapping[str, float | tuple[float, Callable[[Column], Column]]]


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Wanted, count: str | None = None, hot_above: int = HOT_ROWS, hot: Hot | None = None, many: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles per group.

    ``wanted`` maps an output name to a probability, or to (probability,
    increasing function), the function being applied before interpolation.
    ``count`` names an optional column with the group's row count. ``many`` tells that usual groups are many and have
    few rows each: these are sorted, as an aggregate would carry a buffer per row.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    specs = {n: s if isinstance(s, tuple) else (s, _same) for n, s in wanted.items()}
    hot = hot or find_hot(rows, keys, hot_above)
    plain = _sorted_quantiles if many else _plain_quantiles
    out = hot.split(rows, lambda x: plain(x, keys, value, specs), lambda x: _bucketed_quantiles(x, keys, value, specs, hot.cuts))
    return out.withColumnRenamed("n_group", count) if count else out.drop("n_group")


def _same(c: Column) -> Column:
    return c


def _plain_quantiles(rows: DataFrame, keys: list[str], value: str, specs: Mapping[str, tuple[float, Callable]]) -> DataFrame:
    """One exact quantile aggregate per function; its buffer holds the group's distinct values."""
    by_function: dict[Callable, list[str]] = {}
    for name, (_, fn) in specs.items():
        by_function.setdefault(fn, []).append(name)
    aggs, picks = [], {}
    for i, (fn, names) in enumerate(by_function.items()):
        probabilities = F.array(*[F.lit(float(specs[n][0])) for n in names])
        aggs.append(F.percentile(fn(F.col(value)), probabilities).alias(f"quantiles_{i}"))
        picks.update({n: F.col(f"quantiles_{i}")[at].alias(n) for at, n in enumerate(names)})
    found = rows.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_group"))
    return found.select(*keys, *[picks[n] for n in specs], "n_group")


def _sorted_quantiles(rows: DataFrame, keys: list[str], value: str, specs: Mapping[str, tuple[float, Callable]]) -> DataFrame:
    """The same from the rows at the wanted places of each group, in one shuffle."""
    group = W.partitionBy(*keys)
    placed = rows.withColumns({"place": F.row_number().over(group.orderBy(value)) - 1, "n_group": F.count(F.lit(1)).over(group)})
    ends, parts = [], []
    for name, (p, fn) in specs.items():
        end = _quantile_place(p)(F.col("n_group"))
        ends += [F.max(F.when(F.col("place") == side(end), F.col(value))).alias(f"{name}_{at}") for at, side in (("low", F.floor), ("high", F.ceil))]
        low, high = (fn(F.col(f"{name}_{at}")).cast("double") for at in ("low", "high"))
        between = (F.ceil(end) - end) * low + (end - F.floor(end)) * high
        parts.append(F.when(low == high, low).otherwise(between).alias(name))
    return placed.groupBy(*keys, "n_group").agg(*ends).select(*keys, *parts, "n_group")


def _bucketed_quantiles(rows: DataFrame, keys: list[str], value: str, specs: Mapping[str, tuple[float, Callable]], cuts: int) -> DataFrame:
    """Quantiles from the distinct values next to each wanted place."""
    places = {name: _quantile_place(p) for name, (p, _) in specs.items()}
    found = _at_places(rows, {"whole": keys}, value, places, cuts)["whole"]
    return found.select(*keys, *[_interpolated(name, places[name], fn).alias(name) for name, (_, fn) in specs.items()], "n_group")


Place = Callable[[Column], Column]


def _quantile_place(p: float) -> Place:
    return lambda n: F.lit(float(p)) * (n - 1).cast("double")


def _interpolated(name: str, place: Place, fn: Callable[[Column], Column] = _same) -> Column:
    end = place(F.col("n_group"))
    low, high = (fn(F.col(f"{name}_{side}")).cast("double") for side in ("low", "high"))
    return low + F.when(low == high, 0.0).otherwise((high - low) * (end - F.floor(end)))


def level_quantiles(df: DataFrame, levels: Mapping[str, Sequence[str]], value: str, p: float, cuts: int = BUCKETS) -> dict[str, DataFrame]:
    """Exact quantile under several groupings of the same rows, which may all be large: keys and a column of the level's name for each."""
    place = _quantile_place(p)
    found = _at_places(df.where(F.col(value).isNotNull()), levels, value, {"q": place}, cuts)
    return {out: found[out].select(*keys, _interpolated("q", place).alias(out)) for out, keys in levels.items()}


def level_kth_smallest(df: DataFrame, levels: Mapping[str, Sequence[str]], value: str, k: Place, cuts: int = BUCKETS) -> dict[str, DataFrame]:
    """k-th smallest value under several groupings of the same rows, which may all be large; also ``<level>_n``."""
    found = _at_places(df.where(F.col(value).isNotNull()), levels, value, {"q": lambda n: k(n) - 1}, cuts)
    return {out: found[out].select(*keys, F.col("q_low").alias(out), F.col("n_group").alias(f"{out}_n")) for out, keys in levels.items()}


def _cut(rows: DataFrame, value: str, cuts: int) -> DataFrame:
    """Add an order-preserving bucket number, the same for all groups: about equally many of all rows, or one value, in each."""
    x = F.col(value).cast("double")
    plain = ~F.isnan(x) & (F.abs(x) != float("inf"))
    shares = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    splitters = rows.where(plain).agg(F.percentile_approx(x, shares, F.lit(max(10_000, 10 * cuts)))).first()[0]  # one number per bucket
    ends = [float("-inf"), *sorted(set(splitters or [0.0])), float("inf")]
    numbered = Bucketizer(splits=ends, inputCol="bucketed", outputCol=BUCKET, handleInvalid="keep").transform(rows.withColumn("bucketed", x))
    return numbered.drop("bucketed").withColumn(BUCKET, F.col(BUCKET).cast("int"))


def _at_places(df: DataFrame, levels: Mapping[str, Sequence[str]], value: str, places: Mapping[str, Place], cuts: int) -> dict[str, DataFrame]:
    """Values on both sides of wanted places, for several groupings of the same rows: keys, ``n_group`` and per place
    ``<name>_low`` and ``<name>_high``.

    ``places`` give a place in a group's order, counted from 0, by its number of rows. Rows are counted per finest
    key and bucket; the sums tell which bucket of a group holds a wanted place, and only its rows are looked at again.
    """
    finest = list(dict.fromkeys(k for keys in levels.values() for k in keys)) or ["whole_table"]
    rows = df if any(levels.values()) else df.withColumn("whole_table", F.lit(0))
    cut = _cut(rows.select(*finest, value), value, cuts)
    counts = materialize(cut.groupBy(*finest, BUCKET).agg(F.count(F.lit(1)).alias("n")))

    def at(name: str, side: Callable[[Column], Column]) -> Column:
        return side(places[name](F.col("n_group"))).between(F.col("n_before"), F.col("n_before") + F.col("n") - 1)

    covers = reduce(Column.__or__, [at(name, side) for name in places for side in (F.floor, F.ceil)])
    met = []
    for level, keys in levels.items():
        group = W.partitionBy(*(keys or [F.lit(0)]))
        earlier = group.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
        totals = counts.groupBy(*keys, BUCKET).agg(F.sum("n").alias("n")).select(
            *keys, BUCKET, "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.sum("n").over(group).alias("n_group")
        )
        wanted = totals.where(covers).select(*[F.col(k).alias(f"at_{k}") for k in (*keys, BUCKET)], "n_before", "n_group")
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"at_{k}")) for k in (*keys, BUCKET)])
        masked = [(F.col(k) if k in keys else F.lit(None).cast(counts.schema[k].dataType)).alias(f"of_{k}") for k in finest]
        met.append(counts.join(wanted, same).select(
            *[F.col(k).alias(f"at_{k}") for k in (*finest, BUCKET)], F.lit(level).alias("level"), *masked, "n_before", "n_group"
        ))
    met = materialize(reduce(DataFrame.unionByName, met))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"at_{k}")) for k in (*finest, BUCKET)])
    cell = ["level", *[f"of_{k}" for k in finest], "n_group"]
    near = cut.join(met, same).select(*cell, BUCKET, "n_before", value)
    distinct = near.groupBy(*cell, BUCKET, "n_before", value).agg(F.count(F.lit(1)).alias("n"))
    below = W.partitionBy(*cell, BUCKET).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = distinct.withColumn("n_before", F.col("n_before") + F.coalesce(F.sum("n").over(below), F.lit(0)))
    ends = [F.max(F.when(at(name, side), F.col(value))).alias(f"{name}_{end}") for name in places for end, side in (("low", F.floor), ("high", F.ceil))]
    found = materialize(placed.where(covers).groupBy(*cell).agg(*ends))
    shown = ["n_group", *[f"{name}_{end}" for name in places for end in ("low", "high")]]
    return {level: found.where(F.col("level") == level).select(*[F.col(f"of_{k}").alias(k) for k in keys], *shown) for level, keys in levels.items()}


def kth_smallest(df: DataFrame, keys: Sequence[str], value: str, k: Place, out: str, hot: Hot | None = None) -> DataFrame:
    """k-th smallest value of each group, k given as a function of the group's row count."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    hot = hot or find_hot(rows, keys)

    def plain(usual: DataFrame) -> DataFrame:
        counts = usual.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
        placed = _windowed(counts, keys, value, {"n": F.col("n")})
        wanted = k(F.col("n_total"))
        hit = (F.col("n_upto") >= wanted) & (F.col("n_upto") - F.col("n") < wanted)
        return placed.where(hit).select(*keys, F.col(value).alias(out), F.col("n_total").alias(f"{out}_n"))

    return hot.split(rows, plain, lambda large: level_kth_smallest(large, {out: keys}, value, k, hot.cuts)[out])
