"""Values at places under several groupings at once, and of many small groups, against brute force and the aggregate."""

import math

import pytest
from pyspark.sql import functions as F

from holdfast.operators import ordered
from holdfast.operators.ordered import Hot
from holdfast.plans import bindings
from test_ordered import table

LEVELS = {"fine": ["g", "y"], "own": ["g"], "all": []}


def groups(p, keys):
    return p.groupby(keys, dropna=False) if keys else [((), p)]


@pytest.mark.parametrize("cuts", [2, 7, 64])
def test_level_quantiles(spark, cuts):
    p = table()
    p.loc[p.index % 11 == 0, "g"] = None  # a missing key is a group
    found = ordered.level_quantiles(spark.createDataFrame(p), LEVELS, "x", 0.3, cuts)
    for level, keys in LEVELS.items():
        got = {tuple(r[k] for k in keys): r[level] for r in found[level].collect()}
        want = {tuple(None if k != k else k for k in (key if isinstance(key, tuple) else (key,))): own.x.quantile(0.3) for key, own in groups(p, keys)}
        assert got == pytest.approx(want)


def test_level_kth_smallest_of_odd_values(spark):
    values = [None, float("-inf"), -0.0, 0.0, 3.0, 3.0, 3.0, float("inf"), float("nan"), float("nan")]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "g string, x double")
    order = values[1:]
    for k in range(1, len(order) + 1):
        found = ordered.level_kth_smallest(df, {"v": ["g"]}, "x", lambda n, k=k: F.least(n, F.lit(k)), 3)["v"]
        got = {r["g"]: (r["v"], r["v_n"]) for r in found.collect()}
        assert got["b"] == (1.0, 1) and got["a"][1] == len(order)
        assert got["a"][0] == order[k - 1] or (math.isnan(got["a"][0]) and math.isnan(order[k - 1]))


def test_large_tables_give_the_same_baselines(spark, sf_dir, monkeypatch):
    """All levels of the medians and of the calibration, on the plain path and on that of large groups."""
    rows = bindings.labelled(spark, sf_dir)
    small = bindings.calibrate(bindings.guesses(rows))
    monkeypatch.setattr(bindings, "find_hot", lambda df, keys, within=None: Hot(keys, everything=True))
    monkeypatch.setattr(ordered, "find_hot", lambda *_, **__: pytest.fail("levels are counted together"))
    large = bindings.calibrate(bindings.guesses(rows))
    assert small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_sorted_quantiles_are_those_of_the_aggregate(spark, p):
    df = spark.createDataFrame(table()).withColumn("k", F.col("id") % 90)
    specs = {"q": (p, lambda c: c * 2), "m": 0.5}
    plain, many = (ordered.group_quantiles(df, ["g", "k"], "x", specs, count="n", many=m) for m in (False, True))
    assert plain.exceptAll(many).isEmpty() and many.exceptAll(plain).isEmpty()


def test_small_groups_are_told_without_their_keys(spark):
    stored = spark.createDataFrame([(i % 50, i) for i in range(100)], "a int, b int")
    never = stored.withColumn("b", F.raise_error(F.lit("the rows were computed")))
    assert ordered.find_hot(never, ["b"], 10, within=stored, inside=["a"]).within() is not None
    assert ordered.find_hot(stored, ["a"], 1, within=stored, inside=["a"]).within() is None
