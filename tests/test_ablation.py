"""The ablation table draws what it shows."""

from holdfast.plans import ranking_queries


def test_cohorts_are_found_once_and_canonical_draws_are_of_the_primary_cohort(spark, sf_dir, monkeypatch):
    made, drawn = [], []
    cohort_rows = ranking_queries.cohort_rows
    monkeypatch.setattr(ranking_queries, "cohort_rows", lambda *a: made.append(a) or cohort_rows(*a))
    real = ranking_queries.ranking.paired_bootstrap

    def few(rows, keys, row_key, label, a, b, replicates, seed, **kind):
        drawn.append((replicates, {r.cohort for r in rows.select("cohort").distinct().collect()}))
        return real(rows, keys, row_key, label, a, b, 20, seed, **kind)

    monkeypatch.setattr(ranking_queries.ranking, "paired_bootstrap", few)
    monkeypatch.setattr(ranking_queries, "macro_metrics", lambda *_: spark.createDataFrame([(m, s, 1.0, 1.0) for m in ranking_queries.CONTRASTS[0] for s in (1, 2)], "model string, seed int, mae double, rmse double"))
    table = ranking_queries.ablation_table(spark, sf_dir)
    assert len(made) == 1 and [n for n, _ in drawn] == [ranking_queries.COHORT_DRAWS, ranking_queries.DRAWS]
    assert "primary" in drawn[0][1] and len(drawn[0][1]) > 1 and drawn[1][1] == {"primary"}
    assert table.where("source = 'external'").count() == 2 * len(drawn[0][1])
