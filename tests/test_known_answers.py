"""Hand-made inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from holdfast.functions import scalar
from holdfast.operators import cliffs, contracts, contrasts, curation, diversity, joins, metrics, ranking, reshape, splits


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_point_metrics(spark):
    df = spark.createDataFrame([("m", 0.0, 1.0), ("m", 2.0, 2.0), ("m", 4.0, 2.0)], "model string, y_true double, y_pred double")
    row = one(metrics.regression_metrics(df, ["model"]))
    assert row["mae"] == pytest.approx(1.0)
    assert row["within_one"] == pytest.approx(2 / 3)
    assert row["within_two"] == 1.0


def test_conformal_quantile(spark):
    df = spark.createDataFrame([("m", float(i)) for i in range(1, 11)], "model string, r double")
    assert one(metrics.conformal_quantile(df, ["model"], "r", 0.80))["q"] == 9.0
    assert one(metrics.conformal_quantile(df.where("r <= 3"), ["model"], "r", 0.90))["q"] == 3.0


def test_coverage_weighting(spark):
    rows = [("m", s, e, 0.0, 0.0, 0.0, y) for s in range(5) for e, y in (("A", 0.0), ("A", 0.0), ("B", 1.0))]
    df = spark.createDataFrame(rows, "model string, seed int, entity string, y_pred double, lower double, upper double, y_true double")
    for row in metrics.coverage_weighting(df, ["model", "seed"], "entity").collect():
        assert row["pair_weighted_coverage"] == pytest.approx(2 / 3)
        assert row["equal_entity_coverage"] == pytest.approx(1 / 2)


def test_paired_contrast_ignores_row_order(spark):
    deltas = [-0.01, 0.01, -0.005, 0.005, 0.0]
    rows = [("b", s, 1.0) for s in range(5)] + [("a", s, 1.0 + deltas[s]) for s in reversed(range(5))]
    df = spark.createDataFrame(rows, "model string, seed int, mae double")
    row = one(contrasts.paired_contrast(df, [("a", "b")], ["seed"], ["mae"]))
    assert row["mean"] == pytest.approx(0.0, abs=1e-12)
    assert row["ci_low"] < 0 < row["ci_high"]
    assert row["favourable"] == 2


def test_primary_cohort(spark):
    df = spark.createDataFrame([(1, False, False), (2, False, True), (3, True, False)], "id int, exact boolean, corpus boolean")
    kept = splits.explode_cohorts(df, {"primary": ~F.col("exact") & ~F.col("corpus")})
    assert [r["id"] for r in kept.collect()] == [1]


def test_replay_gate(spark):
    schema = "k string, v double"
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], schema)
    turned = spark.createDataFrame([("b", 2.0), ("a", 1.0)], schema)
    changed = spark.createDataFrame([("a", 1.1), ("b", 2.0)], schema)
    assert one(contracts.check_replay(turned, base, ["k"], ["v"], 1e-9)) == {
        "column": "v", "unmatched": 0, "max_difference": 0.0, "passed": True,
    }
    assert not one(contracts.check_replay(changed, base, ["k"], ["v"], 1e-9))["passed"]
    assert not one(contracts.check_replay(base.where("k = 'a'"), base, ["k"], ["v"], 1e-9))["passed"]


def test_one_class_has_no_ranking_metric(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.9)], "y int, s double").withColumn("g", F.lit("all"))
    row = one(ranking.ranking_metrics(df, ["g"], "y", "s"))
    assert row["auroc"] is None and row["average_precision"] is None and row["status"] == "one_class"
    both = spark.createDataFrame([(0, 0.1), (1, 0.9)], "y int, s double").withColumn("g", F.lit("all"))
    row = one(ranking.ranking_metrics(both, ["g"], "y", "s"))
    assert row["auroc"] == 1.0 and row["average_precision"] == 1.0


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(1, "B", "train"), (1, "A", "test"), (1, "C", "valid")]
    schema = "seed int, entity string, split string"
    print_of = lambda r: one(contracts.fingerprint(spark.createDataFrame(r, schema), "entity", "split", "seed"))["fingerprint"]
    assert print_of(rows) == print_of(rows[::-1])
    assert print_of(rows) != print_of([(1, "B", "test"), (1, "A", "train"), (1, "C", "valid")])


def test_temporal_cohorts_drop_rows_outside_own_window(spark):
    rows = [("T", 2017, 1.0), ("T", 2019, 8.0), ("V", 2019, 2.0), ("V", 2022, 4.0), ("S", 2021, 1.0), ("L", 2024, 1.0)]
    df = spark.createDataFrame(rows, "entity string, year long, value double")
    windows = {"train": (None, 2018), "valid": (2019, 2020), "test": (2021, 2023)}
    out = {(r["entity"], r["year"]): (r["cohort"], r["in_own_window"]) for r in curation.temporal_cohorts(df, "entity", "year", windows).collect()}
    assert out[("T", 2017)] == ("train", True)
    assert out[("T", 2019)] == ("train", False)
    assert out[("V", 2019)] == ("valid", True)
    assert out[("V", 2022)] == ("valid", False)
    assert out[("L", 2024)] == ("outside_window", False)


def test_eligibility_threshold(spark):
    rows = [("X", i) for i in range(500)] + [("Y", i) for i in range(499)]
    df = spark.createDataFrame(rows, "context string, entity int")
    support = curation.context_support(df, "context", "entity")
    assert [r["context"] for r in curation.eligible_contexts(support, "context", 500).collect()] == ["X"]


def test_cardinality_violation_is_refused(spark):
    left = spark.createDataFrame([(1,), (1,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(contracts.ContractError):
        joins.validated_join(left, right, ["k"], "left", "n:1")


def test_leave_one_out_flags(spark):
    rows = [(f"s{i}", c, "K1" if c in "AB" else "K2") for c in "ABCD" for i in range(2)]
    rows += [(f"own{c}{i}", c, "K1" if c in "AB" else "K2") for c in "ABCD" for i in range(2)]
    df = spark.createDataFrame(rows, "entity string, context string, class string")
    for r in splits.leave_one_out_audit(df, "entity", "context", "class").collect():
        assert (r["test_pairs"], r["train_pairs"]) == (4, 12)
        assert (r["seen_in_other_contexts"], r["not_seen_elsewhere"]) == (2, 2)
        assert r["class_known_from_train"]
    lone = splits.unknown_class_folds(df.where("context <> 'D'"), "context", "class").collect()
    assert [(r["context"], r["class"]) for r in lone] == [("C", "K2")]


def test_wide_table_and_task_weights(spark):
    rows = [(e, c, float(e)) for e in range(30) for i, c in enumerate("ABC") if (e + i) % 4]
    df = spark.createDataFrame(rows, "entity int, context string, y double")
    tasks = reshape.task_columns(["C", "A", "B"])
    assert tasks == {"A": "target_000", "B": "target_001", "C": "target_002"}
    wide = reshape.to_wide(df, "entity", "context", "y", tasks).withColumn("split", F.lit("train"))
    assert wide.count() == 30
    weights = [r["task_weight"] for r in reshape.task_weights(wide, tasks, "split").collect()]
    assert sum(weights) / 3 == pytest.approx(1.0)
    assert reshape.to_long(wide, ["entity"], tasks, "context", "y").count() == len(rows)


def test_non_finite_prediction_is_found(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,)], "p double")
    assert one(contracts.check_finite(df, ["p"]))["violations"] == 3


def small_cliff(spark, gap=3.0):
    pairs = spark.createDataFrame([("RA", "X", 0.0), ("RB", "X", gap), ("CH", "X", 4.0)], "entity string, context string, target double")
    sets = spark.createDataFrame([("RA", "ring", [1, 2, 3]), ("RB", "ring", [1, 2, 3])], "entity string, group_key string, bits array<long>")
    return pairs, sets


def test_diversity_and_cliff_edge(spark):
    pairs, sets = small_cliff(spark)
    keyed = pairs.join(sets.select("entity", "group_key"), "entity", "left")
    by_mode = {r["mode"]: r for r in diversity.group_diversity(keyed, "context", "entity", "group_key").collect()}
    assert by_mode["with_fallback"]["group_fraction"] == pytest.approx(2 / 3)
    assert by_mode["grouped_only"]["group_fraction"] == pytest.approx(1 / 2)
    assert by_mode["with_fallback"]["top_share"] == pytest.approx(2 / 3)
    edge = one(cliffs.cliff_edges(pairs, sets, "entity", "context", "group_key", "target"))
    assert (edge["entity_a"], edge["entity_b"], edge["similarity"], edge["gap"]) == ("RA", "RB", 1.0, 3.0)
    assert edge["primary_sim0.8_delta2"] and edge["sensitivity_sim0.8_delta3"]


@pytest.mark.parametrize("start", [0.0, 0.3, -5.1, 7.9999])
def test_gap_threshold_is_inclusive(spark, start):
    pairs = spark.createDataFrame([("RA", "X", start), ("RB", "X", start + 1.9999999999999996)], "entity string, context string, target double")
    _, sets = small_cliff(spark)
    edge = one(cliffs.cliff_edges(pairs, sets, "entity", "context", "group_key", "target"))
    assert edge["primary_sim0.8_delta2"] and not edge["sensitivity_sim0.8_delta3"]


def test_cliff_error_summary(spark):
    flags = ["primary_sim0.8_delta2", "sensitivity_sim0.7_delta2", "sensitivity_sim0.9_delta2", "sensitivity_sim0.8_delta3"]
    edges = spark.createDataFrame([("A", "a1", "a2"), ("A", "a2", "a3"), ("C", "c1", "c2")], "context string, entity_a string, entity_b string")
    edges = edges.withColumns({n: F.lit(i < 1) for i, n in enumerate(flags)})
    rows = []
    for seed, (part, other) in {42: (2.0, 1.0), 100: (3.0, 0.5)}.items():
        rows += [("m", seed, "A", e, 0.0, part) for e in ("a1", "a2", "a3")] + [("m", seed, "A", "a4", 0.0, other)]
        rows += [("m", seed, "C", e, 0.0, 1.0) for e in ("c1", "c2")]
    pred = spark.createDataFrame(rows, "model string, seed int, context string, entity string, y_true double, y_pred double")
    own = cliffs.cliff_error(pred, edges, "context", "entity")
    got = {r["seed"]: r for r in own.collect()}
    assert set(got) == {42, 100} and {r["context"] for r in got.values()} == {"A"}
    assert (got[42]["n_participants"], got[42]["n_others"], got[42]["delta_mae"]) == (3, 1, 1.0)
    total = one(cliffs.cliff_error_stability(cliffs.cliff_error_by_seed(own)))
    assert total["mean"] == pytest.approx(1.75)
    assert total["sd"] == pytest.approx(0.75 * 2**0.5)


def test_set_difference_finds_one_missing_pair(spark):
    schema = "seed int, entity string, context string"
    expected = spark.createDataFrame([(1, "e1", "A"), (1, "e1", "B"), (1, "e2", "A")], schema)
    row = one(splits.set_difference_audit(expected, expected.where("NOT (entity = 'e1' AND context = 'B')"), ["seed"], "entity", "context"))
    assert (row["missing_entities"], row["missing_pairs"], row["split_match"]) == (0, 1, False)


def test_three_valued_label(spark):
    df = spark.createDataFrame([(0.01, None), (0.2, 0.9), (0.2, None)], "a double, b double")
    assert [r[0] for r in df.select(scalar.pooled_label(["a", "b"], 0.05)).collect()] == [1, 0, None]


def test_binomial_names(spark):
    names = ["Escherichia coli", "Bacillus sp. 3", "Vibrio", "A/B virus", "9x coli", " Candida albicans ", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(scalar.is_binomial("n")).collect()] == [True, False, False, False, False, True, False]


def test_waterfall_sums_to_input(spark):
    df = spark.createDataFrame([(1,), (5,), (None,), (9,), (12,)], "v int")
    steps = [("known", F.col("v").isNotNull()), ("large", F.col("v") > 2), ("odd", F.col("v") % 2 == 1)]
    got = [(r["step"], r["rows_retained"], r["rows_excluded"]) for r in curation.waterfall(df, steps).orderBy("step_order").collect()]
    assert got == [("input", 5, 0), ("known", 4, 1), ("large", 3, 1), ("odd", 2, 1)]
