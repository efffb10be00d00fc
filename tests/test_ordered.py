"""Ordered operators against brute force, on the plain and on the bucketed path."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast.functions.constants import T_975
from holdfast.functions.student import t_975
from holdfast.operators import ordered, ranking, splits
from holdfast.operators.ordered import Hot


def table(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.choice("aab")  # one group holds two thirds of the rows
        x = rng.choice([rng.uniform(-5, 5), float(rng.randint(-2, 2)), rng.uniform(0, 1e6)])
        rows.append((i, g, x, float(rng.randint(0, 6)), rng.randint(0, 1)))
    return pd.DataFrame(rows, columns=["id", "g", "x", "y", "label"])


PATHS = {"plain": None, "bucketed": Hot(["g"], everything=True)}


def some_hot(spark):
    return Hot(["g"], groups=spark.createDataFrame([("a",)], "g string"))


@pytest.fixture(params=["plain", "bucketed", "mixed"])
def hot(request, spark):
    return some_hot(spark) if request.param == "mixed" else PATHS[request.param]


def test_quantiles(spark, hot):
    p = table()
    out = ordered.group_quantiles(spark.createDataFrame(p), ["g"], "x", {"m": 0.5, "q": 0.9, "lo": 0.0}, count="n", hot=hot)
    for r in out.collect():
        own = p[p.g == r["g"]].x
        assert r["n"] == len(own)
        for c, q in (("m", 0.5), ("q", 0.9), ("lo", 0.0)):
            assert r[c] == pytest.approx(own.quantile(q))


def test_spearman(spark, hot):
    p = table()
    out = {r["g"]: r["spearman"] for r in ordered.spearman(spark.createDataFrame(p), ["g"], "x", "y", hot=hot).collect()}
    for g, own in p.groupby("g"):
        assert out[g] == pytest.approx(own.x.rank().corr(own.y.rank()))


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("b", 1.0, 1.0)], "g string, x double, y double")
    assert [r["spearman"] for r in ordered.spearman(df, ["g"], "x", "y").collect()] == [None, None]


def test_auroc_and_average_precision(spark, hot):
    p = table()
    got = {r["g"]: r for r in ranking.ranking_metrics(spark.createDataFrame(p), ["g"], "label", "y", hot=hot).collect()}
    for g, own in p.groupby("g"):
        pos, neg = own[own.label == 1].y, own[own.label == 0].y
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert got[g]["auroc"] == pytest.approx(wins / (len(pos) * len(neg)))
        ap, seen, hits = 0.0, 0, 0
        for _, tie in sorted(own.groupby("y"), key=lambda kv: -kv[0]):
            seen, hits = seen + len(tie), hits + tie.label.sum()
            ap += tie.label.sum() / len(pos) * hits / seen
        assert got[g]["average_precision"] == pytest.approx(ap)


def test_kth_smallest(spark, hot):
    p = table()
    out = ordered.kth_smallest(spark.createDataFrame(p), ["g"], "x", lambda n: F.ceil(n * F.lit(0.3)), "v", hot)
    for r in out.collect():
        own = sorted(p[p.g == r["g"]].x)
        assert r["v"] == own[math.ceil(len(own) * 0.3) - 1]


def test_ordered_sums_paths_agree(spark):
    df = spark.createDataFrame(table()).groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    plain = ordered.ordered_sums(df, ["g"], "x", {"n": F.col("n")}, hot=Hot(["g"]))
    cut = ordered.ordered_sums(df, ["g"], "x", {"n": F.col("n")}, hot=Hot(["g"], everything=True))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))


def test_bucket_keeps_order(spark):
    values = sorted([0.0, -0.0, 1e-300, -1e-300] + [s * m * 2.0**e for s in (1, -1) for e in range(-60, 60) for m in (1.0, 1.0000001, 1.5, 1.9999999)])
    values += [None, float("-inf"), float("inf"), float("nan")]
    df = ordered.balanced_buckets(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", 40)
    buckets = [r["order_bucket"] for r in df.orderBy("v").collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) > 30
    assert [buckets.count(b) for b in (buckets[0], buckets[1], buckets[-2], buckets[-1])] == [1, 1, 1, 1]


def test_buckets_are_balanced(spark):
    """Scores all in [0.5, 1), most of them in a narrow range; a group of another size beside."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), (1 - F.pow(F.rand(3), 6) / 2 - 1e-9).alias("v"), "id"
    )
    for buckets in (64, 150):
        sizes = ordered.balanced_buckets(df, ["g"], "v", buckets).groupBy("g", "order_bucket").count().collect()
        for g, rows in (("a", 36_000), ("b", 4_000)):
            own = [r["count"] for r in sizes if r["g"] == g]
            assert sum(own) == rows and len(own) == buckets and max(own) < 2 * rows / buckets


def test_find_hot(spark):
    df = spark.createDataFrame(table())
    assert ordered.find_hot(df, ["g"]).groups is None
    assert [r["g"] for r in ordered.find_hot(df, ["g"], 200).groups.collect()] == ["a"]


def test_grouped_partition_contract(spark):
    rng = random.Random(3)
    entities = spark.createDataFrame([(i, f"g{min(rng.randint(0, 60), 45)}") for i in range(300)], "entity int, g string")
    out = splits.grouped_partition(entities, "g", [42, 7]).toPandas()
    assert len(out) == 600
    for _, own in out.groupby("seed"):
        assert own.groupby("g").split.nunique().max() == 1
        sizes = own.split.value_counts()
        assert sizes["train"] >= round(0.7 * 300) and sizes.sum() == 300


def test_grouped_partition_bucketed_path(spark, monkeypatch):
    entities = spark.createDataFrame([(i, f"g{i % 40}") for i in range(300)], "entity int, g string")
    plain = splits.grouped_partition(entities, "g", [42]).toPandas()
    monkeypatch.setattr(ordered, "find_hot", lambda df, keys, hot_above=0: Hot(keys, everything=True))
    cut = splits.grouped_partition(entities, "g", [42]).toPandas()
    assert plain.sort_values("entity").values.tolist() == cut.sort_values("entity").values.tolist()


def test_held_out_medians(spark):
    rng = random.Random(5)
    p = pd.DataFrame([(rng.choice("AAABCD"), float(rng.randint(0, 12))) for _ in range(201)], columns=["context", "y"])
    got = {r["context"]: r["y_pred"] for r in splits.held_out_medians(spark.createDataFrame(p), "context", "y").collect()}
    assert got == {c: p[p.context != c].y.median() for c in p.context.unique()}


def t_cdf(t, df, steps=20000):
    """Student t distribution by Simpson's rule."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h = t / steps
    f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
    return 0.5 + h / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * f(i * h) for i in range(steps + 1))


@pytest.mark.parametrize("df", range(1, 31))
def test_t_table(df):
    assert t_cdf(T_975[df - 1], df) == pytest.approx(0.975, abs=1e-9)


def test_t_tail(spark):
    rows = spark.createDataFrame([(31,), (47,), (200,), (0,)], "n long").select("n", t_975(F.col("n")).alias("t")).collect()
    for r in rows:
        if r["n"] == 0:
            assert r["t"] is None
        else:
            assert t_cdf(r["t"], r["n"]) == pytest.approx(0.975, abs=1e-6)
