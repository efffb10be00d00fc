"""Faults found by review: one answer at every group size, bootstraps to the end, columns by name, and others."""

import itertools
import math
import random

import pytest

from holdfast.operators import cliffs, contrasts, ordered, ranking, splits
from holdfast.operators.similarity import nearest_by_tanimoto
from holdfast.sources.io import read_table

INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize("odd", [[None, None], [INF], [-INF, NAN], [NAN, NAN, None, INF]])
def test_large_groups_rank_odd_scores_like_small_ones(spark, odd, monkeypatch):
    rows = [("g", i % 2, s) for i, s in enumerate([0.1, 0.5, 0.4, 0.9, *odd])]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    small = ranking.ranking_metrics(df, ["g"], "label", "score").first()
    large = ranking.ranking_metrics(df, ["g"], "label", "score", hot=ordered.Hot(["g"], everything=True)).first()
    assert small == large


def test_rank_correlation_with_many_ties(spark):
    r = random.Random(1)
    rows = [(k, float(r.randint(0, 50)), 1.0 if r.random() < 0.9 or k == 1 else float(r.randint(2, 9))) for k in (0, 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, x double, y double")

    def ranks(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    x, y = (ranks([row[i] for row in rows if row[0] == 0]) for i in (1, 2))
    mx, my = sum(x) / len(x), sum(y) / len(y)
    rho = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    for hot in (None, ordered.Hot(["k"], everything=True)):
        got = {g.k: g.spearman for g in ordered.spearman(df, ["k"], "x", "y", hot=hot).collect()}
        assert math.isclose(got[0], rho, rel_tol=1e-9) and got[1] is None
    plan = ordered.spearman(df, ["k"], "x", "y")._jdf.queryExecution().toString()
    assert "windowspecdefinition(k#0, x" not in plan and "windowspecdefinition(k#0, y" not in plan


def test_bootstrap_goes_on_until_enough_and_keeps_one_class(spark):
    rows = [("rare", i, int(i == 0), i / 8, (i * 3 % 8) / 8) for i in range(8)] + [("one", i, 1, i / 8, i / 9) for i in range(5)]
    df = spark.createDataFrame(rows, "cohort string, id long, label int, a double, b double")
    got = {r.cohort: r for r in ranking.paired_bootstrap(df, ["cohort"], "id", "label", "a", "b", 80, 3).where("metric = 'auroc'").collect()}
    assert got["rare"].replicates == 80 and got["rare"].rejected > 10 and got["rare"].status == "estimable"
    assert got["one"].status == "one_class" and got["one"].replicates == 0 and got["one"].ci_low is None
    single = ranking.bootstrap_metric(df, ["cohort"], "id", "label", {"a": "a"}, 20, 3)
    assert {r.cohort for r in single.collect()} == {"rare", "one"}


def test_delimited_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("b,a,c\nx,1,9\ny,2,8\n")
    assert [tuple(r) for r in read_table(spark, str(path), "a int, b string").collect()] == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="missing"):
        read_table(spark, str(path), "a int, z string")
    path.write_text("b,a\nx,one\n")
    with pytest.raises(Exception, match="(?i)malformed|cannot"):
        read_table(spark, str(path), "a int, b string").collect()


def test_interaction_needs_all_four_cells(spark):
    rows = [(s, m, v) for s in (1, 2) for m, v in zip("abcd", (4.0, 1.0, 2.0, 1.0))][:-1]
    df = spark.createDataFrame(rows, "seed int, model string, mae double")
    got = contrasts.interaction(df, {"x": ("a", "b"), "y": ("c", "d")}, "x", "y", "seed", "mae").first()
    assert got.n == 1 and got["mean"] == 2.0


def test_far_target_does_not_multiply_rows(spark):
    n = 40
    pairs = spark.createDataFrame([(i, "c", 1e6 if i == 0 else float(i % 3)) for i in range(n)], "entity long, context string, target double")
    sets = spark.createDataFrame([(i, "g", [1, 2, 3]) for i in range(n)], "entity long, grp string, bits array<long>")
    edges = cliffs.cliff_edges(pairs, sets, "entity", "context", "grp", "target")
    values = [1e6 if i == 0 else i % 3 for i in range(n)]
    assert edges.count() == sum(abs(a - b) >= 2 for a, b in itertools.combinations(values, 2))


def test_nearest_over_a_small_vocabulary(spark):
    r = random.Random(2)
    draw = lambda: sorted(r.sample(range(12), r.randint(1, 6)))
    q, ref = [(i, draw()) for i in range(60)] + [(99, [])], [(i, draw()) for i in range(80)]
    got = nearest_by_tanimoto(spark.createDataFrame(q, "qid long, bits array<long>"), spark.createDataFrame(ref, "rid long, bits array<long>"), "qid", "rid")
    for g in got.collect():
        mine = set(dict(q)[g.qid])
        best = min((-(len(mine & set(b)) / len(mine | set(b))) if mine else 0.0, i) for i, b in ref)
        assert (g.nearest_id, g.similarity) == (best[1], -best[0])


def test_empty_side_is_refused(spark):
    df = spark.createDataFrame([(1, "g"), (2, "g")], "entity long, grp string")
    with pytest.raises(ValueError, match="empty"):
        splits.grouped_train_test(df, "grp", 1, 0.2)


def test_held_out_medians_against_brute_force(spark):
    r = random.Random(5)
    rows = [(r.choice("abc"), float(r.randint(0, 9))) for _ in range(200)] + [("z", 1.5)]
    got = {g.context: g.y_pred for g in splits.held_out_medians(spark.createDataFrame(rows, "context string, y double"), "context", "y").collect()}
    for c in "abcz":
        others = sorted(v for k, v in rows if k != c)
        n = len(others)
        assert got[c] == (others[(n - 1) // 2] + others[n // 2]) / 2
