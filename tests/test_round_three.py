"""Cliffs without edges, nearest sets with hot positions, balanced buckets, vector bootstrap."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions.constants import CLIFF_CONFIGS
from holdfast.operators import bootstrap, cliffs, curation, ranking, similarity
from holdfast.operators.similarity import nearest_by_tanimoto


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


# --- cliffs by counting ------------------------------------------------------------------------


def cliff_case(spark, seed, n=60):
    r = random.Random(seed)
    kinds = [sorted(r.sample(range(14), r.choice([0, 4, 9, 10, 10, 11]))) for _ in range(9)]
    base = sorted(range(10))
    kinds += [base, base[:-1], base[1:], [*base, 11]]
    sets = [(i, f"g{i % 3}", r.choice(kinds)) for i in range(n)]
    pairs = [(i, c, r.randint(0, 12) / 2) for i in range(n) for c in ("a", "b") if r.random() < 0.8]
    return spark.createDataFrame(pairs, "entity long, context string, target double"), spark.createDataFrame(sets, "entity long, grp string, bits array<long>")


def test_counts_agree_with_edges(spark):
    """Ties, gaps right at the threshold, empty and equal sets; on the plain and on the bucketed path."""
    for seed, hot_above in ((1, 10**6), (2, 10**6), (3, 4)):
        pairs, sets = cliff_case(spark, seed)
        edges = cliffs.cliff_edges(pairs, sets, "entity", "context", "grp", "target")
        members = pairs.join(sets.select("entity", "grp"), "entity")
        counts = cliffs.CliffCounts(pairs, sets, "entity", "context", "grp", "target", hot_above=hot_above)
        want = cliffs.cliff_group_summary(edges, members, "context", "grp", "entity")
        got = counts.group_summary()
        assert got.columns == want.columns and rows_of(got) == rows_of(want)
        assert want.agg(F.sum("edges")).first()[0] > 20
        ends = cliffs.edge_participants(cliffs.edge_configurations(edges), ["configuration", "context", "grp"])
        assert rows_of(counts.participants()) == rows_of(ends)


def test_a_billion_edges_are_counted_without_being_made(spark):
    n = 80_000
    pairs = spark.range(n).select(F.col("id").alias("entity"), F.lit("c").alias("context"), ((F.col("id") % 2) * 5 + (F.col("id") % 7) / 10).alias("target"))
    bits = F.array(*[F.lit(i) for i in range(10)])
    sets = spark.range(n).select(F.col("id").alias("entity"), F.lit("g").alias("grp"), bits.alias("bits"))
    start = time.monotonic()
    got = {r.configuration: r for r in cliffs.CliffCounts(pairs, sets, "entity", "context", "grp", "target").group_summary().collect()}
    assert set(got) == set(CLIFF_CONFIGS) and time.monotonic() - start < 120
    for r in got.values():
        assert (r.edges, r.participants, r.entities) == ((n // 2) ** 2, n, n) and r.edges > 10**9


# --- nearest sets and similar sets -------------------------------------------------------------


def brute_nearest(q, ref):
    out = {}
    for i, mine in q:
        mine = set(mine)
        best = min((-(len(mine & set(b)) / len(mine | set(b))) if mine else 0.0, j) for j, b in ref)
        out[i] = (best[1], -best[0])
    return out


def near(spark, q, ref, **more):
    q, ref = spark.createDataFrame(q, "qid long, bits array<long>"), spark.createDataFrame(ref, "rid long, bits array<long>")
    return {g.qid: (g.nearest_id, g.similarity) for g in nearest_by_tanimoto(q, ref, "qid", "rid", **more).collect()}


def test_nearest_where_every_position_is_hot(spark):
    r = random.Random(4)
    for vocabulary, most in ((12, 6), (40, 12)):
        draw = lambda: sorted(r.sample(range(vocabulary), r.randint(1, most)))  # noqa: B023, E731
        q, ref = [(i, draw()) for i in range(60)] + [(99, []), (98, [500])], [(i, draw()) for i in range(150)] + [(900, [])]
        want = brute_nearest(q, ref)
        assert near(spark, q, ref, hot_above=0) == want
        assert near(spark, q, ref, hot_above=20) == want
        assert near(spark, q, ref, hot_above=10**6) == want


def test_nearest_with_some_hot_positions(spark):
    """Every set holds boilerplate positions; many share nothing else, and rare matches may be worse or better than those."""
    r = random.Random(6)

    def draw():
        return sorted(set(r.sample(range(6), r.randint(0, 6))) | set(r.sample(range(10, 400), r.choice([0, 1, 4, 12]))))

    q, ref = [(i, draw()) for i in range(80)], [(i, draw()) for i in range(200)]
    assert near(spark, q, ref, hot_above=30) == brute_nearest(q, ref)


def test_hot_lists_are_not_met_by_queries_with_a_better_match(spark):
    """A third of the references share one position with every query: no meeting is made for those, as each query has a near match."""
    n = 300
    ref = [(i, [0, *range(10 + 20 * i, 28 + 20 * i)]) for i in range(n)]
    q = [(i, [0, *range(11 + 20 * i, 28 + 20 * i)]) for i in range(n)]
    frames = [spark.createDataFrame(rows, "o long, bits array<long>") for rows in (q, ref)]
    part = F.array(F.struct(F.lit(n).cast("bigint").alias("held"), F.lit(0).cast("bigint").alias("bit"))).alias("hot")
    asked = frames[0].select(F.col("o").alias("q_set"), F.size("bits").alias("q_size"), F.lit(17 / 19).alias("bound"), part)
    classes = frames[1].select(F.col("o").alias("r_set"), F.size("bits").alias("r_size"), F.col("o").alias("r_id"), part)
    assert similarity._hot_candidates(asked, classes, []).count() == 0
    assert near(spark, q, ref, hot_above=50) == brute_nearest(q, ref)


def test_candidates_of_a_hot_vocabulary_are_few(spark):
    r = random.Random(9)
    base = [sorted(r.sample(range(60), 20)) for _ in range(40)]
    sets = []
    for i in range(400):
        b = set(r.choice(base))
        for _ in range(r.randint(0, 3)):
            b ^= {r.randrange(60)}
        sets.append((i, "g", sorted(b)))
    sets = list({tuple(b): (i, g, b) for i, g, b in sets}.values())
    df = spark.createDataFrame(sets, "owner long, grp string, bits array<long>")
    want = {
        (a[0], b[0])
        for a, b in itertools.combinations(sorted(sets), 2)
        if len(set(a[2]) & set(b[2])) >= 0.7 * len(set(a[2]) | set(b[2])) - 1e-9
    }
    got = {(p.owner_a, p.owner_b) for p in similarity.similar_sets(df, ["grp"], "owner", "bits", 0.7, 1e-12).collect()}
    candidates = similarity.similar_candidates(df, ["grp"], "owner", "bits", 0.7, 1e-12).count()
    assert got == want and len(want) > 500 and len(want) <= candidates <= 10 * len(want)


# --- bootstrap by weight vectors ---------------------------------------------------------------


def brute_metrics(rows, weights):
    """AUROC and average precision of (label, score) rows counted ``weights`` times."""
    pos, neg = ([(s, w) for (y, s), w in zip(rows, weights, strict=True) if y == k and w] for k in (1, 0))
    p, n = sum(w for _, w in pos), sum(w for _, w in neg)
    if not p or not n:
        return None, None
    wins = sum(w * v * ((s > t) + 0.5 * (s == t)) for s, w in pos for t, v in neg)
    ap = 0.0
    for s, w in pos:
        hits, seen = sum(v for t, v in pos if t >= s), sum(v for t, v in pos + neg if t >= s)
        ap += w * hits / seen
    return wins / (p * n), ap / p


def scored_rows(n=90):
    r = random.Random(11)
    rows = [(i, "a" if i % 3 else "b", int(r.random() < 0.3), r.choice([None, 1.0, 2.0, r.random() * 3, float("inf")]), r.random()) for i in range(n)]
    return rows + [(1000, "one", 0, 0.5, 0.5)]


def test_weighted_replicates_against_brute_force(spark):
    """One cell and many cells, several chunks, ties, missing and infinite scores, a cohort with one class."""
    rows = scored_rows()
    df = spark.createDataFrame(rows, "id long, cohort string, label int, x double, y double")
    hashed = {r.id: (r.hash_a, r.hash_b) for r in bootstrap._with_hashes(df, "id", 3).collect()}
    wanted = {}
    for cohort in ("a", "b", "one"):
        own = [r for r in rows if r[1] == cohort]
        h = np.array([hashed[r[0]] for r in own], np.int64)
        weights = bootstrap.poisson_weights(h[:, 0], h[:, 1], 3, range(2, 302))
        for model, at in (("x", 3), ("y", 4)):
            for b in range(300):
                cells = [(r[2], float("-inf") if r[at] is None else r[at]) for r in own]
                wanted[cohort, model, b + 2] = brute_metrics(cells, weights[:, b])
    for cell_rows in (10**6, 9):
        got = bootstrap.poisson_metrics(df, ["cohort"], "id", "label", {"x": "x", "y": "y"}, 300, 3, 2, cell_rows).collect()
        assert len(got) == len(wanted)
        for g in got:
            auroc, ap = wanted[g.cohort, g.model, g.replicate]
            assert g.auroc == (None if auroc is None else pytest.approx(auroc)) and g.average_precision == (None if ap is None else pytest.approx(ap))


def test_weights_are_poisson_and_independent():
    r = np.random.default_rng(1)
    first, second = r.integers(0, bootstrap.PRIME, (2, 3_000))
    w = bootstrap.poisson_weights(first, second, 8, range(1_000))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01
    assert abs((w == 0).mean() - math.exp(-1)) < 0.002 and w.max() >= 6
    rows, columns = np.corrcoef(w[:150]), np.corrcoef(w[:, :150].T)
    for c in (rows, columns):
        off = c[~np.eye(150, dtype=bool)]
        assert abs(off.mean()) < 0.005 and abs(off).max() < 0.2
    assert abs(w.sum(0).std() / math.sqrt(3_000) - 1) < 0.1


def test_paired_weights_count_rejections_and_tell_what_lacks(spark):
    rows = [(i, "rare", int(i == 0), i / 10, (7 * i) % 10 / 10) for i in range(10)] + [(50 + i, "good", i % 2, i / 40, (3 * i) % 40 / 40) for i in range(40)]
    rows += [(200 + i, "one", 1, 0.5, 0.5) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, cohort string, label int, x double, y double")
    run = lambda rounds: {(r.cohort, r.metric): r for r in ranking.paired_bootstrap(df, ["cohort"], "id", "label", "x", "y", 400, 5, rounds).collect()}
    short, full = run(1), run(10)
    assert short["rare", "auroc"].status == "incomplete" and short["rare", "auroc"].replicates < 400
    assert full["rare", "auroc"].status == "estimable" and full["rare", "auroc"].replicates == 400
    assert 150 < full["rare", "auroc"].rejected < 350 and full["good", "auroc"].rejected == 0
    assert full["one", "auroc"].status == "one_class" and full["one", "auroc"].difference is None and full["one", "auroc"].replicates == 0
    assert full["good", "auroc"].ci_low < full["good", "auroc"].difference < full["good", "auroc"].ci_high


def test_poisson_and_resampled_limits_agree(spark):
    r = random.Random(12)
    rows = [(i, "c", int(r.random() < 0.4), r.gauss(0, 1), r.gauss(0, 1)) for i in range(300)]
    rows = [(i, c, y, x + y, z) for i, c, y, x, z in rows]
    df = spark.createDataFrame(rows, "id long, cohort string, label int, x double, y double")
    limits = []
    for method, draws in (("poisson", 2_000), ("multinomial", 400)):
        got = {g.metric: g for g in ranking.paired_bootstrap(df, ["cohort"], "id", "label", "x", "y", draws, 5, method=method).collect()}
        limits.append((got["auroc"].ci_low, got["auroc"].ci_high))
    assert limits[0] == pytest.approx(limits[1], abs=0.03)


# --- counts of a write ---------------------------------------------------------------------------


def test_waterfall_and_gates_are_counted_by_the_write(spark):
    rows = [(i, i % 5 if i % 7 else None, "ab"[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, v long, unit string").repartition(5)
    steps = [("no value", F.col("v").isNotNull()), ("small", F.col("v") > 1)]
    kept, ladder, gates = curation.curate(df, steps, {"three": F.col("v") == 3, "unit": F.col("unit") != "a", "unknown": F.lit(None).cast("boolean")})
    want = [r for r in rows if r[1] is not None and r[1] > 1]
    assert sorted(map(tuple, kept.collect())) == want
    assert rows_of(ladder) == rows_of(curation.waterfall(df, steps))
    assert {g["check"]: g.violations for g in gates.collect()} == {"three": sum(r[1] == 3 for r in want), "unit": sum(r[2] == "b" for r in want), "unknown": len(want)}
    none, ladder, _ = curation.curate(df.limit(0), steps)
    assert none.count() == 0 and {r.rows_retained for r in ladder.collect()} == {0}


def test_a_write_observed_twice_is_counted_anew(spark, monkeypatch):
    class Twice(curation.Observation):
        get = property(lambda self: {k: 2 * v for k, v in super(Twice, self).get.items()})

    monkeypatch.setattr(curation, "Observation", Twice)
    df = spark.range(30).withColumn("v", F.col("id") % 3)
    steps = [("zero", F.col("v") > 0)]
    _, ladder, gates = curation.curate(df, steps, {"one": F.col("v") == 1})
    assert rows_of(ladder) == rows_of(curation.waterfall(df, steps)) and gates.first().violations == 10
