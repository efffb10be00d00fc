"""Similarity joins against brute force, with hot positions forced."""

import random

import pytest
from pyspark.sql import functions as F

from holdfast.operators import similarity


def sets(n, seed, width=30):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        own = set(rng.sample(range(3, width), rng.randint(0, 6)))
        if rng.random() < 0.7:
            own.add(rng.randint(0, 2))  # positions most sets hold
        out.append((i, sorted(own)))
    return out + [(n + i, out[0][1]) for i in range(5)]  # copies


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("hot_above", [0, 5, 256])
def test_nearest_is_exact(spark, hot_above):
    q, r = sets(60, 1), sets(80, 2)
    got = similarity.nearest_by_tanimoto(
        spark.createDataFrame(q, "qid long, bits array<long>"), spark.createDataFrame(r, "rid long, bits array<long>"), "qid", "rid", hot_above=hot_above
    ).collect()
    assert len(got) == len(q)
    for row in got:
        bits = dict(q)[row["qid"]]
        best = max(((jaccard(bits, b), -i) for i, b in r if set(bits) & set(b)), default=(0.0, 0))
        assert row["similarity"] == pytest.approx(best[0])
        assert row["nearest_id"] == -best[1]


def test_nearest_within_keys(spark):
    q = [(s, i, b) for s in (1, 2) for i, b in sets(20, 3)]
    r = [(s, i, b) for s in (1, 2) for i, b in sets(30, 4 + s)]
    schema = "seed int, {} long, bits array<long>"
    got = similarity.nearest_by_tanimoto(
        spark.createDataFrame(q, schema.format("qid")), spark.createDataFrame(r, schema.format("rid")), "qid", "rid", by=["seed"]
    ).collect()
    assert len(got) == len(q)
    for row in got:
        bits = next(b for s, i, b in q if (s, i) == (row["seed"], row["qid"]))
        best = max(((jaccard(bits, b), -i) for s, i, b in r if s == row["seed"] and set(bits) & set(b)), default=(0.0, 0))
        assert (row["similarity"], row["nearest_id"]) == (pytest.approx(best[0]), -best[1])


@pytest.mark.parametrize("least", [0.2, 0.5, 0.7, 1.0])
def test_similar_sets_is_exact(spark, least):
    rows = [(i % 3, i, b) for i, b in sets(80, 9, 14) if b]
    df = spark.createDataFrame(rows, "g int, owner long, bits array<long>")
    got = {(r["g"], r["owner_a"], r["owner_b"]) for r in similarity.similar_sets(df, ["g"], "owner", "bits", least, 1e-12).collect()}
    want = {(g, i, j) for g, i, a in rows for h, j, b in rows if g == h and i < j and jaccard(a, b) >= least - 1e-12}
    assert got == want


def test_shingles(spark):
    df = spark.createDataFrame([("a b c d",), ("A, b!",), ("",)], "t string")
    runs = [r[0] for r in df.select(similarity.shingles(similarity.tokens(F.col("t")), 3)).collect()]
    assert runs == [["a b c", "b c d"], [], []]


def test_empty_sets_have_similarity_zero(spark):
    df = spark.createDataFrame([([], [])], "a array<long>, b array<long>")
    assert df.select(similarity.tanimoto(F.col("a"), F.col("b"))).first()[0] == 0.0


@pytest.mark.parametrize("block", [25, 1 << 24])
def test_nearest_in_blocks_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "LEAST_BLOCK", 20)
    q, r = sets(60, 1), sets(80, 2)
    q.append((900, [1 << 40]))  # shares nothing; too large for an int
    written = []
    monkeypatch.setattr(similarity, "materialize", lambda df, keep=similarity.materialize: written.append(df.columns) or keep(df))
    got = similarity.nearest_by_tanimoto(
        spark.createDataFrame(q, "qid long, bits array<long>"), spark.createDataFrame(r, "rid long, bits array<long>"), "qid", "rid", long_sets=0, block=block
    ).collect()
    assert len(got) == len(q)
    for row in got:
        bits = dict(q)[row["qid"]]
        best = max(((jaccard(bits, b), -i) for i, b in r if set(bits) & set(b)), default=(0.0, 0))
        assert (row["similarity"], row["nearest_id"]) == (pytest.approx(best[0]), -best[1])
    assert (["q_set", "sim", "r_id"] in written) == (block == 25)  # many small blocks take rounds


def test_long_sets_write_no_row_per_meeting(spark, monkeypatch):
    """Texts that all share positions: what is written on the way grows with the texts, not with the pairs."""
    rng = random.Random(5)
    q, r = ([(i, sorted(rng.sample(range(2000), 100))) for i in range(150)] for _ in "qr")
    monkeypatch.setattr(similarity, "_over_hot", lambda *_: pytest.fail("a row per pair was made"))
    got = similarity.nearest_by_tanimoto(
        spark.createDataFrame(q, "qid long, bits array<long>"), spark.createDataFrame(r, "rid long, bits array<long>"), "qid", "rid", hot_above=1
    ).collect()
    for row in got:
        best = max((jaccard(dict(q)[row["qid"]], b), -i) for i, b in r)
        assert (row["similarity"], row["nearest_id"]) == (pytest.approx(best[0]), -best[1])


def test_nearest_in_blocks_within_keys(spark):
    q = [(s, i, b) for s in (1, 2) for i, b in sets(20, 3)]
    r = [(s, i, b) for s in (1, 2) for i, b in sets(30, 4 + s)]
    schema = "seed int, {} long, bits array<long>"
    of = lambda n: similarity.nearest_by_tanimoto(
        spark.createDataFrame(q, schema.format("qid")), spark.createDataFrame(r, schema.format("rid")), "qid", "rid", by=["seed"], long_sets=n
    )
    assert sorted(map(tuple, of(0).collect())) == sorted(map(tuple, of(10_000).collect()))
