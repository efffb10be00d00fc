"""Tables that are larger than the optimizer takes them to be are not collected for a broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from holdfast.operators import ranking
from holdfast.plans import bindings, model_queries, similarity_queries
from holdfast.session import materialize


def broadcast_keys(df):
    """First key of every broadcast join."""
    return re.findall(r"BroadcastHashJoin \[(\w+)#", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("keep", [("kind",), ("n_records",), ("kind", "group_key", "assigned", "is_solo", "target_iqr")])
def test_partitions_of_the_pairs_are_not_broadcast(spark, sf_dir, monkeypatch, keep):
    monkeypatch.setattr(bindings, "materialize", lambda df: df)
    found = broadcast_keys(bindings.labelled(spark, sf_dir, keep=keep))
    assert "entity" not in found and "assigned" not in found


def test_partitions_of_the_vectors_are_not_broadcast(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(model_queries, "materialize", lambda df: df)
    monkeypatch.setattr(model_queries, "vector_views", lambda spark, d: bindings.entities(spark, d).select("entity").hint("merge"))
    assert "entity" not in broadcast_keys(model_queries.labelled_vectors(spark, sf_dir, [42, 100]))


def test_views_of_the_entities_are_not_broadcast(spark, sf_dir):
    views = model_queries.vector_views(spark, sf_dir)
    assert "entity" not in broadcast_keys(views) and "entity" not in broadcast_keys(bindings.entities(spark, sf_dir).select("entity").join(views, "entity"))


def test_partitions_of_the_sets_are_not_broadcast(spark, sf_dir, monkeypatch):
    written = []
    monkeypatch.setattr(similarity_queries, "materialize", lambda df: written.append(df) or df)
    monkeypatch.setattr(similarity_queries.similarity, "nearest_by_tanimoto", lambda q, *_, **__: q.select("seed", "entity"))
    similarity_queries.nearest_train(spark, sf_dir)
    assert "entity" not in broadcast_keys(written[0]) and "assigned" not in broadcast_keys(written[0])


def test_draws_of_a_resample_are_not_broadcast(spark):
    rows = materialize(spark.range(1000).select(F.lit("all").alias("cohort"), F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label")))
    drawn = ranking.resample(rows, ["cohort"], "doc_id", 100, 1)
    assert "cohort" not in broadcast_keys(drawn)
    assert drawn.agg(F.sum("times")).first()[0] == 100 * 1000
