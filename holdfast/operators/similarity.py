"""Set features and exact Tanimoto joins built on an inverted index."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seeding import hash_int
from ..session import materialize


def tokens(text: Column, unit: str = "word") -> Column:
    """Lower-case words of the whole text, or its single characters."""
    if unit == "char":
        return F.filter(F.split(F.lower(text), ""), lambda t: t != "")
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def shingles(words: Column, k: int) -> Column:
    """All runs of k neighbouring tokens; a text with fewer than k tokens has none."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
    return F.coalesce(runs, F.array().cast("array<string>"))


def shingle_bits(df: DataFrame, text: str, k: int, n_bits: int, out: str = "bits", unit: str = "word") -> DataFrame:
    """Sorted distinct hash positions of the shingles of a text."""
    words = df.withColumn("shingle_words", tokens(F.col(text), unit))
    hashed = F.transform(shingles(F.col("shingle_words"), k), lambda s: hash_int(F.md5(s)) % n_bits)
    return words.withColumn(out, F.array_sort(F.array_distinct(hashed))).drop("shingle_words")


def minhash(df: DataFrame, key: str, bits: str, families: Sequence[tuple[int, int]], prime: int, out: str = "signature") -> DataFrame:
    """Min-hash signature: per (a, b) the smallest ((a*h + b) mod prime) over the positions h of a row.

    Row-local array work, no shuffle. a, b and h below 2**31 keep the product inside a long.
    """

    def smallest(a: int, b: int) -> Column:
        hashed = lambda h: (h * F.lit(a).cast("bigint") + F.lit(b)) % F.lit(prime).cast("bigint")
        return F.array_min(F.transform(bits, hashed))

    return df.select(key, F.array(*[smallest(a, b) for a, b in families]).alias(out))


def count_features(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Summary counts of a text: words, distinct words, longest word, letters, digits and line breaks."""
    words = df.withColumn("feature_words", tokens(F.col(text)))
    return words.select(
        *keep,
        F.length(text).alias("n_chars_text"),
        F.size("feature_words").alias("n_words"),
        F.size(F.array_distinct("feature_words")).alias("n_distinct_words"),
        F.coalesce(F.array_max(F.transform("feature_words", lambda w: F.length(w))), F.lit(0)).alias("longest_word"),
        F.regexp_count(text, F.lit("[0-9]")).alias("n_digits"),
        F.regexp_count(text, F.lit("\n")).alias("n_breaks"),
    )


def truncation_audit(df: DataFrame, text: str, limits: Sequence[int]) -> DataFrame:
    """Rows whose token count is above each limit, in one pass."""
    n = F.size(tokens(F.col(text)))
    cells = F.array(*[F.struct(F.lit(v).alias("token_limit"), (F.col("n_tokens") > v).cast("int").alias("over")) for v in limits])
    long = df.select(n.alias("n_tokens")).select("n_tokens", F.inline(cells))
    return long.groupBy("token_limit").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("over").alias("rows_over"), F.max("n_tokens").alias("longest")
    )


def tanimoto(a: Column, b: Column) -> Column:
    """Shared positions over all positions; 0 if both sets are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")), F.lit(0.0))


def set_key(bits: Column) -> Column:
    """Key under which equal sets meet."""
    return F.md5(F.array_join(bits.cast("array<string>"), ","))


# Reference sets that hold a position above which it is hot, and rows of a hot position that one task joins.
HOT_POSITION = 256
SPLIT = 20_000
# Longs of a position map, sketches per set, positions per sketch, sets that stand for a bucket of equal sketches.
MAP_LONGS, SKETCHES, DRAWN, STAND_INS = 4, 8, 3, 16
ROUNDING = 1e-12
# Mean positions of a set from which sets are met in blocks; most and least positions of a block; blocks of one round.
LONG_SETS = 64
BLOCK, LEAST_BLOCK, ROUND = 1 << 24, 1 << 20, 4


def position_map(bits: Column, longs: int = MAP_LONGS) -> list[Column]:
    """Bit map of hashed positions: whatever is set in one map and not in the other stands for a position that is not shared."""

    def long(i: int) -> Column:
        def add(seen: Column, bit: Column) -> Column:
            slot = F.pmod(F.xxhash64(bit), F.lit(64 * longs))
            mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int"))
            return F.when(F.floor(slot / 64) == i, seen.bitwiseOR(mark)).otherwise(seen)

        return F.aggregate(bits, F.lit(0).cast("bigint"), add)

    return [long(i) for i in range(longs)]


def _map_names(side: str) -> list[str]:
    return [f"{side}_map{i}" for i in range(MAP_LONGS)]


def _maps(bits: Column, side: str) -> list[Column]:
    return [m.alias(n) for m, n in zip(position_map(bits), _map_names(side), strict=True)]


def most_shared(a: str, b: str, size_a: Column, size_b: Column) -> Column:
    """Upper bound of the shared positions from the maps of both sides."""

    def missing(x: str, y: str) -> Column:
        return reduce(Column.__add__, [F.bit_count(F.col(m).bitwiseAND(F.bitwise_not(n))) for m, n in zip(_map_names(x), _map_names(y), strict=True)])

    return F.least(size_a - missing(a, b), size_b - missing(b, a))


def _of_shared(shared: Column, a: Column, b: Column) -> Column:
    return shared.cast("double") / (a + b - shared).cast("double")


def nearest_by_tanimoto(query: DataFrame, reference: DataFrame, query_id: str, reference_id: str, bits: str = "bits", by: Sequence[str] = (), hot_above: int = HOT_POSITION, long_sets: int = LONG_SETS, block: int = BLOCK) -> DataFrame:
    """Exact nearest reference row of every query row, ties to the smallest reference id.

    Equal sets are merged on both sides first, so groups of copies cost one row, and equal sets meet by their
    key. Long reference sets (``long_sets`` positions on average) share some position with most queries, so a row
    per meeting would be quadratic on disk: they are counted in memory, see :func:`_in_blocks`. Shorter ones meet
    the other queries in one join over the positions that few reference sets hold
    (at most ``hot_above``); counting the meetings gives the similarity. Hot positions take no part in that:
    :func:`_over_hot` reads them only for queries and sets that a bound leaves open. A query sharing no position
    with any reference row gets similarity 0 and the smallest reference id.
    """
    by = list(by)
    q_rows = query.select(*by, query_id, bits).withColumn("q_set", set_key(F.col(bits)))
    r = materialize(
        reference.select(*by, reference_id, bits)
        .withColumn("r_set", set_key(F.col(bits)))
        .groupBy(*by, "r_set")
        .agg(F.any_value(bits).alias("r_bits"), F.min(reference_id).alias("r_id"))
        .withColumn("r_size", F.size("r_bits"))
    )
    twins = r.select(*by, F.col("r_set").alias("q_set"), F.col("r_id").alias("twin"))
    q = q_rows.groupBy(*by, "q_set").agg(F.any_value(bits).alias("q_bits")).withColumn("q_size", F.size("q_bits"))
    q = materialize(q.where("q_size > 0").join(twins, [*by, "q_set"], "left"))
    open_ = q.where("twin IS NULL").drop("twin")

    if (r.agg(F.avg("r_size")).first()[0] or 0) >= long_sets:
        scored = _in_blocks(open_, r, by, block)
    else:
        scored = _by_positions(open_, r, by, hot_above)
    top = scored.groupBy(*by, "q_set").agg(F.min(F.struct((-F.col("sim")).alias("minus"), F.col("r_id").alias("id"))).alias("c"))
    found = top.select(*by, "q_set", (-F.col("c.minus")).alias("sim"), F.col("c.id").alias("near"))
    found = found.unionByName(q.where("twin IS NOT NULL").select(*by, "q_set", F.lit(1.0).alias("sim"), F.col("twin").alias("near")))

    out = q_rows.select(*by, query_id, "q_set").join(found, [*by, "q_set"], "left")
    if by:
        out = out.join(r.groupBy(*by).agg(F.min("r_id").alias("lowest_id")), by, "left")
        fallback = F.col("lowest_id")
    else:
        fallback = r.agg(F.min("r_id").alias("v")).scalar()
    return out.select(
        *by,
        query_id,
        F.coalesce("near", fallback).alias("nearest_id"),
        F.coalesce("sim", F.lit(0.0)).alias("similarity"),
    )


def _by_positions(open_: DataFrame, r: DataFrame, by: list[str], hot_above: int) -> DataFrame:
    """Pairs (by, q_set, r_set) that can be nearest, with their similarity, from a join over positions."""
    on = [*by, "bit"]
    index = r.select(*by, "r_set", "r_size", "r_id", F.explode("r_bits").alias("bit"))
    held = index.groupBy(*on).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > hot_above)
    hot = materialize(held)
    any_hot = not hot.isEmpty()
    if any_hot:
        index = index.join(hot, on, "left_anti")
    asked = open_.select(*by, "q_set", "q_size", F.explode("q_bits").alias("bit"))
    met = asked.join(index, on).groupBy(*by, "q_set", "r_set").agg(
        F.count(F.lit(1)).alias("shared"), F.max("q_size").alias("q_size"), F.max("r_size").alias("r_size"), F.min("r_id").alias("r_id")
    )
    met = met.withColumn("sim", _of_shared(F.col("shared"), F.col("q_size"), F.col("r_size")))
    return _over_hot(open_, r, materialize(met), hot, by) if any_hot else met


def _in_blocks(q: DataFrame, r: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """Nearest reference set of every query set within each block of reference sets.

    Sets are dealt by hash into blocks of about ``block`` positions, a quarter of the side if that is less. Every
    block of queries meets every block of references in one task, where an index of the positions is counted with
    numpy; a row per query and block comes out. Blocks are copied for ``ROUND`` blocks of references at a time, so
    what lies on disk at once grows with the input, not with its square.
    """
    spark = q.sparkSession

    def dealt(sets: DataFrame, side: str) -> tuple[DataFrame, int]:
        bits = f"{side}_bits"
        own = sets.groupBy(*by).agg(F.sum(F.size(bits)).alias("n"), F.max(F.array_max(bits)).alias("last"), F.min(F.array_min(bits)).alias("first"))
        most, last, first = own.agg(F.max("n"), F.max("last"), F.min("first")).first()
        most = most or 1
        number = -(-most // min(block, max(LEAST_BLOCK, -(-most // 4))))
        if last is not None and -(1 << 31) <= first and last < 1 << 31:
            sets = sets.withColumn(bits, F.col(bits).cast("array<int>"))
        return sets.withColumn(f"{side}_block", F.pmod(F.xxhash64(f"{side}_set"), F.lit(number)).cast("int")), number

    mine, n_mine = dealt(q.select(*by, "q_set", "q_bits"), "q")
    theirs, n_theirs = dealt(r.select(*by, "r_set", "r_id", "r_bits"), "r")
    theirs = theirs.drop("r_set")
    types = dict(theirs.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "q_set string", "sim double", f"r_id {types['r_id']}"])
    key = [*by, "q_block", "r_block"]

    def numbers(first: int, stop: int) -> Column:
        return F.explode(F.sequence(F.lit(first), F.lit(stop - 1)))

    def met(first: int) -> DataFrame:
        stop = min(first + ROUND, n_theirs)
        tasks = 8 * n_mine * (stop - first)  # so many that two pairs of blocks rarely share one
        a = mine.withColumn("r_block", numbers(first, stop)).repartition(tasks, *key)
        b = theirs.where(F.col("r_block").between(first, stop - 1)).withColumn("q_block", numbers(0, n_mine)).repartition(tasks, *key)
        return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(_nearest_of_block(by), schema)

    if n_theirs <= ROUND:
        return met(0)
    rounds = []
    for first in range(0, n_theirs, ROUND):
        rounds.append(materialize(met(first)))
        spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of the round
    return reduce(DataFrame.unionByName, rounds)


def _nearest_of_block(by: list[str]):
    """Counts shared positions of all query sets with all reference sets of a block; ties go to the smallest id."""

    def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        whole = lists.combine_chunks()
        whole = whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole
        return whole.flatten().to_numpy(zero_copy_only=False), whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def nearest(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.select(["r_id", "r_bits"]).sort_by("r_id")
        at, sims, ids = [], [], []
        if mine.num_rows and theirs.num_rows:
            bits, r_size = flat(theirs["r_bits"])
            order = np.argsort(bits, kind="stable")
            owner = np.repeat(np.arange(len(r_size), dtype=np.int32), r_size)[order]
            known, start = np.unique(bits[order], return_index=True)
            held = np.diff(np.append(start, len(bits)))
            asked, q_size = flat(mine["q_bits"])
            place = np.minimum(np.searchsorted(known, asked), len(known) - 1) if len(known) else np.zeros(len(asked), np.int64)
            shared = known[place] == asked if len(known) else np.zeros(len(asked), bool)
            ends = np.cumsum(q_size)
            for i, (stop, size) in enumerate(zip(ends, q_size)):
                span = slice(stop - size, stop)
                own = place[span][shared[span]]
                if not len(own):
                    continue
                n = held[own]
                lists = np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                counts = np.bincount(owner[lists], minlength=len(r_size))
                sim = counts / (size + r_size - counts)
                best = int(np.argmax(sim))
                at.append(i)
                sims.append(sim[best])
                ids.append(best)
        rows = mine.select([*by, "q_set"]).take(pa.array(at, pa.int64()))
        return rows.append_column("sim", pa.array(sims, pa.float64())).append_column("r_id", theirs["r_id"].take(pa.array(ids, pa.int64())))

    return nearest


def _over_hot(q: DataFrame, r: DataFrame, met: DataFrame, hot: DataFrame, by: list[str]) -> DataFrame:
    """Every pair (by, q_set, r_set) that can be nearest, with its similarity, where some positions are hot.

    ``met`` has the pairs that share other positions, with their number: a first lower bound of each query's
    best. Sketches of the hot positions find further candidates for it. Then a pair of ``met`` is looked at only
    if all hot positions could lift it to the bound, and hot lists are read only at the places of a query from
    which the bound can still be reached (see :func:`_hot_candidates`).
    """
    key = [*by, "q_set"]

    def hot_part(sets: DataFrame, owner: str, bits: str) -> DataFrame:
        index = sets.select(*by, owner, F.explode(bits).alias("bit")).join(hot, [*by, "bit"])
        return index.groupBy(*by, owner).agg(F.sort_array(F.collect_list(F.struct("held", "bit"))).alias("hot"))

    def looked_at(pairs: DataFrame) -> DataFrame:
        both = pairs.join(q.select(*key, "q_bits"), key).join(r.select(*by, "r_set", "r_bits", "r_id"), [*by, "r_set"])
        return both.select(*key, "r_set", "r_id", tanimoto(F.col("q_bits"), F.col("r_bits")).alias("sim"))

    q_hot = materialize(q.select(*key, "q_size").join(hot_part(q, "q_set", "q_bits"), key))
    r_hot = materialize(r.select(*by, "r_set", "r_size", "r_id").join(hot_part(r, "r_set", "r_bits"), [*by, "r_set"]))
    # Of the sets with the same hot positions the smallest is the nearest to a query that shares no other position with them.
    first = F.min(F.struct("r_size", "r_id", "r_set")).alias("first")
    classes = materialize(r_hot.groupBy(*by, "hot").agg(first).select(*by, "hot", "first.*"))

    drawn = materialize(looked_at(_same_sketch(q_hot, classes, by)))
    bound = met.select(*key, "sim").unionByName(drawn.select(*key, "sim")).groupBy(*key).agg(F.max("sim").alias("bound"))
    bound = materialize(bound)
    asked = q_hot.join(bound, key, "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))

    q_count = q_hot.select(*key, F.size("hot").alias("q_hot"))
    r_count = r_hot.select(*by, "r_set", F.size("hot").alias("r_hot"))
    lifted = met.join(bound, key).join(q_count, key, "left").join(r_count, [*by, "r_set"], "left")
    reach = F.col("shared") + F.least(F.coalesce("q_hot", F.lit(0)), F.coalesce("r_hot", F.lit(0)))
    lifted = lifted.where(_of_shared(reach, F.col("q_size"), F.col("r_size")) + ROUNDING >= F.col("bound"))
    pairs = lifted.select(*key, "r_set").unionByName(_hot_candidates(asked, classes, by)).distinct()
    return looked_at(pairs)


def _same_sketch(q_hot: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """Pairs that share a sketch: the positions that a seeded hash puts first. A bucket lends at most ``STAND_INS`` sets, as this is for a bound only."""
    at = [*by, "sketch_no", "sketch"]

    def sketched(sets: DataFrame) -> DataFrame:
        def first(i: int) -> Column:
            order = F.array_sort(F.transform("hot", lambda h: F.struct(F.xxhash64(F.lit(i), h["bit"]).alias("h"))))
            return F.struct(F.lit(i).alias("sketch_no"), F.xxhash64(F.slice(order, 1, DRAWN)).alias("sketch"))

        return sets.select(*[c for c in sets.columns if c != "hot"], F.inline(F.array(*[first(i) for i in range(SKETCHES)])))

    place = F.row_number().over(W.partitionBy(*at).orderBy("r_size", "r_id", "r_set"))
    few = sketched(classes).withColumn("place", place).where(F.col("place") <= STAND_INS)
    return sketched(q_hot).join(few, at).select(*by, "q_set", "r_set").distinct()


def _hot_candidates(asked: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """Pairs that share hot positions only and may reach the query's ``bound``.

    Hot positions are numbered from the rarest. If place p of a query is the first that a set shares, no more than
    the places from p on are shared: this bounds the places to read and the sizes of the sets to meet there.
    Lists are parted by position and doubling of the set size, long ones by salt too; a meeting is kept
    if the places left on both sides and the position maps allow the bound.
    """
    longest = classes.agg(F.max("r_size")).first()[0] or 1

    def doubling(size: Column) -> Column:
        return F.floor(F.log2(size.cast("double")))

    def opened(sets: DataFrame, side: str, keep: Sequence[str]) -> DataFrame:
        bits = F.transform("hot", lambda h: h["bit"])
        held = sets.select(*keep, F.size("hot").alias(f"{side}_hot"), *_maps(bits, side), "hot")
        kept = [c for c in held.columns if c != "hot"]
        out = held.select(*kept, F.posexplode("hot").alias(f"{side}_place", "entry"))
        return out.select(*kept, f"{side}_place", "entry.bit", F.ceil(F.col("entry.held") / SPLIT).alias("salts"))

    left = F.col("q_hot") - F.col("q_place")
    largest = F.when(F.col("bound") > 0, left * (1 + 1 / F.col("bound")) - F.col("q_size") + 1e-6).otherwise(F.lit(float(longest)))
    low = doubling(F.greatest(F.ceil(F.col("bound") * F.col("q_size") - 1e-6), F.lit(1)))
    high = doubling(F.least(largest, F.lit(float(longest))))
    mine = opened(asked, "q", [*by, "q_set", "q_size", "bound"])
    mine = mine.where((left / F.col("q_size") + ROUNDING >= F.col("bound")) & (largest >= 1)).where(low <= high)
    mine = mine.withColumn("doubling", F.explode(F.sequence(low, high))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    theirs = opened(classes, "r", [*by, "r_set", "r_size"])
    theirs = theirs.withColumn("doubling", doubling(F.col("r_size"))).withColumn("salt", F.pmod(F.xxhash64("r_set"), F.col("salts"))).drop("salts")
    places = F.least(F.col("q_hot") - F.col("q_place"), F.col("r_hot") - F.col("r_place"))
    shared = F.least(places, most_shared("q", "r", F.col("q_hot"), F.col("r_hot")))
    close = _of_shared(shared, F.col("q_size"), F.col("r_size")) + ROUNDING >= F.col("bound")
    return mine.drop("salts").join(theirs, [*by, "bit", "doubling", "salt"]).where((shared > 0) & close).select(*by, "q_set", "r_set").distinct()


def rare_first(df: DataFrame, keys: Sequence[str], owner: str, bits: str) -> DataFrame:
    """Positions of each set numbered from the rarest in its group: (keys, owner, size, bit, place, held), and its maps."""
    wide = df.select(*keys, owner, F.size(bits).alias("size"), *_maps(F.col(bits), "own"), bits)
    index = wide.select(*[c for c in wide.columns if c != bits], F.explode(bits).alias("bit"))
    held = index.groupBy(*keys, "bit").agg(F.count(F.lit(1)).alias("held"))
    order = W.partitionBy(*keys, owner).orderBy("held", "bit")
    return index.join(held, [*keys, "bit"]).withColumn("place", F.row_number().over(order))


def similar_candidates(sets: DataFrame, keys: Sequence[str], owner: str, bits: str, least: float, slack: float = 0.0) -> DataFrame:
    """Pairs owner_a < owner_b of one group that may reach a Tanimoto of ``least``.

    Two sets that similar share one of the first size - ceil(least * size) + 1 positions of a common order,
    so only those, rarest first, are joined. A meeting is kept if both sizes, the positions left on both sides
    and the position maps still allow ``least``. Positions that many sets lead with are salted.
    """
    keys = list(keys)
    floor = least - slack
    lead = rare_first(sets, keys, owner, bits).where(
        F.col("place") <= F.col("size") - F.ceil(F.lit(floor) * F.col("size") - F.lit(1e-9)) + 1
    )
    salts = F.ceil(F.col("held") / SPLIT)

    def side(x: str) -> list[Column]:
        own = [F.col(n).alias(m) for n, m in zip(_map_names("own"), _map_names(x), strict=True)]
        return [*keys, "bit", F.col(owner).alias(f"owner_{x}"), F.col("size").alias(f"size_{x}"), F.col("place").alias(f"place_{x}"), *own]

    a = lead.select(*side("a"), F.pmod(F.xxhash64(owner), salts).alias("salt"))
    b = lead.select(*side("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
    size_a, size_b = F.col("size_a"), F.col("size_b")
    needed = F.lit(floor / (1 + floor)) * (size_a + size_b) - F.lit(1e-9)
    near_size = (F.least(size_a, size_b) + F.lit(1e-9)) >= F.lit(floor) * F.greatest(size_a, size_b)
    # The first shared position is in the lead of both; from there on no more than the places left can be shared.
    left = F.least(size_a - F.col("place_a"), size_b - F.col("place_b")) + 1
    first = near_size & (left >= needed)
    close = most_shared("a", "b", size_a, size_b) >= needed
    pairs = a.join(b, [*keys, "bit", "salt"]).where((F.col("owner_a") < F.col("owner_b")) & first & close)
    return pairs.select(*keys, "owner_a", "owner_b").distinct()


def similar_sets(sets: DataFrame, keys: Sequence[str], owner: str, bits: str, least: float, slack: float = 0.0) -> DataFrame:
    """All pairs owner_a < owner_b of one group with Tanimoto at least ``least`` (less ``slack``): candidates, then verified."""
    keys = list(keys)
    pairs = similar_candidates(sets, keys, owner, bits, least, slack)
    left = sets.select(*keys, F.col(owner).alias("owner_a"), F.col(bits).alias("bits_a"))
    right = sets.select(*keys, F.col(owner).alias("owner_b"), F.col(bits).alias("bits_b"))
    joined = pairs.join(left, [*keys, "owner_a"]).join(right, [*keys, "owner_b"])
    out = joined.withColumn("similarity", tanimoto(F.col("bits_a"), F.col("bits_b")))
    return out.where(F.col("similarity") >= least - slack).select(*keys, "owner_a", "owner_b", "similarity")


def identity_flags(query: DataFrame, reference: DataFrame, keys: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each named key pair (query expression, reference expression): does the reference hold the key?"""
    out = query
    for name, (mine, theirs) in keys.items():
        known = reference.select(theirs.alias("identity_key")).where(F.col("identity_key").isNotNull()).distinct()
        out = out.withColumn("own_key", mine).join(known, F.col("own_key") == F.col("identity_key"), "left")
        out = out.withColumn(name, F.col("identity_key").isNotNull()).drop("own_key", "identity_key")
    return out
