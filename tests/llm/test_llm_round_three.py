"""Sharding, centroid clustering and spelling variants: brute force, nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import centroids, lines, queries, shards, spelling, toxicity, url_rules

DOCS = "doc_id long, text string, shard string, slot long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# --- sharding -----------------------------------------------------------------------------------


def sharded(spark, tmp_path, rows, schema=DOCS, name="a", **more):
    return shards.write_shards(frame(spark, rows, schema), str(tmp_path / name), **{"shards": 3, "seed": 5, **more})


def doc_rows(n=200):
    rows = [(i, "x" * random.Random(i).randint(0, 80), None, i) for i in range(n)]
    rows += [(None, None, None, None), (None, "", "s", None), (7, "é" * 50_000, None, 1)]
    return rows + [(1, "again", "s", 1)] * 150 + [(None, None, None, None)] * 3


def test_every_row_once_and_even_gapless_shards(spark, tmp_path):
    rows = doc_rows()
    got = sharded(spark, tmp_path, rows, bucket=2_000).collect()
    assert Counter((r.doc_id, r.text, r.shard_in, r.slot_in) for r in got) == Counter(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == {0, 1, 2} and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))


def test_the_order_is_that_of_scattering_and_fisher_yates(spark, tmp_path):
    rows = doc_rows(60)
    docs = frame(spark, rows)
    got = sharded(spark, tmp_path, rows, bucket=3_000).collect()
    key = F.md5(F.to_json(F.struct(*docs.columns)).cast("binary"))
    weight = sum(len((t or "").encode()) + 1 + 64 for _, t, _, _ in rows)
    buckets = -(-weight // 3_000)
    keyed = docs.select("*", key.alias("k")).withColumn("b", F.pmod(F.xxhash64(F.lit(5), "k"), F.lit(buckets))).collect()
    times, filled = Counter(r.k for r in keyed), [[] for _ in range(buckets)]
    for r in {r.k: r for r in keyed}.values():
        for j in range(times[r.k]):
            filled[(r.b + j) % buckets].append((r.k, (r.doc_id, r.text, r.shard, r.slot)))
    want = []
    for b, members in enumerate(filled):
        members.sort(key=lambda m: m[0])
        draws = np.random.default_rng([5, b]).integers(0, np.arange(len(members), 0, -1)) if members else []
        for last, j in zip(range(len(members) - 1, -1, -1), draws, strict=True):
            members[last], members[j] = members[j], members[last]
        want += [m[1] for m in members]
    in_order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id, r.text, r.shard_in, r.slot_in) for r in in_order] == want


def test_partitions_do_not_matter_and_files_are_in_order(spark, tmp_path):
    rows = doc_rows()
    a = sharded(spark, tmp_path, rows, bucket=2_000).collect()
    b = shards.write_shards(frame(spark, rows).repartition(7), str(tmp_path / "b"), 3, 5, bucket=2_000)
    assert Counter(map(tuple, a)) == Counter(map(tuple, b.collect()))
    other = sharded(spark, tmp_path, rows, name="c", seed=6, bucket=2_000).collect()
    assert Counter(map(tuple, a)) != Counter(map(tuple, other))
    files = spark.read.parquet(str(tmp_path / "b")).select("slot", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect()
    for _, of_file in itertools.groupby(sorted(files, key=lambda r: (r.f, r.i)), key=lambda r: r.f):
        slots = [r.slot for r in of_file]
        assert slots == sorted(slots)


def test_repeated_rows_are_spread_over_the_buckets(spark, tmp_path):
    """A third of all rows equal: no bucket holds more than its share of them."""
    rows = [(i, "t" * 20, None, i) for i in range(2_000)] + [(-1, "copy", None, 0)] * 1_000
    got = sharded(spark, tmp_path, rows, shards=20, bucket=6_000).collect()
    copies = Counter(r.shard for r in got if r.doc_id == -1)
    assert len(copies) == 20 and max(copies.values()) < 2 * 1_000 / 20


def test_fisher_yates_gives_every_order_alike():
    seen = Counter(tuple(shards.fisher_yates(4, [1, s])) for s in range(4_800))
    assert len(seen) == 24 and all(120 < n < 290 for n in seen.values())
    assert shards.fisher_yates(0, [1, 1]).size == 0


def test_sharding_of_nothing_and_fewer_rows_than_shards(spark, tmp_path):
    assert sharded(spark, tmp_path, []).count() == 0
    few = sharded(spark, tmp_path, [(1, None, None, None), (2, "b", None, None)], name="few", shards=5).collect()
    assert len(few) == 2 and all(r.slot == 0 for r in few) and len({r.shard for r in few}) == 2


def test_sharding_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.queries()["op11_sharding"](spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs.items()}
    sizes = Counter(r.shard for r in got)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert len({(r.shard, r.slot) for r in got}) == len(docs) and all(0 <= r.slot < sizes[r.shard] for r in got)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


# --- centroid clustering ------------------------------------------------------------------------

VECTORS = "vec_id long, v array<double>, cluster string"


def brute_clusters(rows, components, number, rounds, seed, scale=1024):
    kept = []
    for i, v, _ in rows:
        if v is not None and len(v) == components and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * x)) for x in v]))
    order = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in order[:number]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centres)]
    return [(i, nearest(v)[1], nearest(v)[0], tuple(centres[nearest(v)[1]])) for i, v in kept]


def clustered(spark, rows, components=4, number=3, rounds=6, leading=2):
    vectors = frame(spark, rows, VECTORS).select("vec_id", "cluster", centroids.integer_vector("v", 1024, components).alias("vector"))
    return centroids.centroid_clusters(vectors, "vec_id", components, number, rounds, 3, leading)


@pytest.mark.parametrize("leading", [1, 2, 4])
def test_clusters_against_brute_force(spark, leading):
    r = random.Random(leading)
    rows = [(i, [r.gauss(i % 3, 0.6) for _ in range(4)], "x") for i in range(120)]
    rows += [(500, [0.25, -0.5, 0.0, 1.0], None)] * 40 + [(None, [1.0, 1.0, 1.0, 1.0], None)] * 2
    rows += [(600, None, None), (601, [], None), (602, [1.0, None, 1.0, 1.0], None), (603, [float("nan")] * 4, None), (604, [float("inf")] * 4, None), (605, [1.0] * 5, None)]
    want = brute_clusters(rows, 4, 3, 6, 3)
    got = clustered(spark, rows, leading=leading).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, tuple(r.centroid)) for r in got) == Counter(want)
    assert {r.inertia for r in got} == {sum(d for _, _, d, _ in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, k, d, _ in want if k == r.cluster)


def test_ties_go_to_the_smaller_centroid_and_grid_points_are_exact(spark):
    """Whole-number grids have many equal distances, where rounding of a rotation would show."""
    rows = [(i, [float(x), float(y), 0.0, 0.0], None) for i, (x, y) in enumerate(itertools.product(range(-4, 5), repeat=2))]
    want = brute_clusters(rows, 4, 5, 4, 3)
    got = clustered(spark, rows, number=5, rounds=4).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(w[:3] for w in want)


def test_few_or_no_vectors(spark):
    assert clustered(spark, []).count() == 0
    one = clustered(spark, [(1, [0.1, 0.2, 0.3, -0.4], None)]).first()
    assert (one.cluster, one.distance, one.inertia, one.centroid) == (0, 0, 0, [102, 204, 307, -410])
    same = clustered(spark, [(i, [0.5] * 4, None) for i in range(9)]).collect()
    assert {(r.cluster, r.distance) for r in same} == {(0, 0)}


def test_the_filter_spares_measuring_and_never_loses_the_nearest():
    r = np.random.default_rng(4)
    centres = r.integers(-1_000, 1_000, (8, 64))
    vectors = centres[r.integers(0, 8, 3_000)] + r.integers(-60, 60, (3_000, 64))
    moved = vectors - vectors.mean(0)
    axes = np.linalg.svd(moved, full_matrices=False)[2][:16].T
    rotation = centroids.Rotation(vectors.mean(0), axes)
    cluster, distance, measured = centroids.nearest_centroids(vectors, *rotation.turn(vectors.astype(float)), centres, rotation)
    every = ((vectors[:, None] - centres) ** 2).sum(2)
    assert (distance == every.min(1)).all() and (cluster == every.argmin(1)).all()
    assert measured.mean() < 1.5


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        frame(spark, [(1, [1e12] * 4, None)], VECTORS).select(centroids.integer_vector("v", 1024, 4)).collect()


# --- spelling variants --------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(vocabulary, times=2):
    out, form = {}, {}
    for w, n in vocabulary.items():
        met = [v for v in vocabulary if near(w, v)]
        best = min(met, key=lambda v: (-vocabulary[v], v)) if met else None
        form[w] = best if met and vocabulary[best] >= times * n else None
        out[w] = len(met)
    rows = []
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, n, out[w], form[w], vocabulary.get(form[w]), root))
    return sorted(rows, key=str)


def variants(spark, vocabulary, **more):
    df = frame(spark, [(w, n, "x") for w, n in vocabulary.items()], "word string, n int, root string")
    got = spelling.spelling_variants(df, **more)
    return sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()), key=str)


def test_acceptor_is_minimal_and_pairs_are_those_of_the_composition():
    r = random.Random(2)
    for letters, longest in (("ab", 6), ("abcé", 4), ("a", 9)):
        for _ in range(40):
            words = sorted({"".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(r.randint(1, 30))})
            machine = spelling.Acceptor()
            start = machine.add(words)
            assert machine.size[start] == len(words)
            right_languages = {tuple(v[len(p) :] for v in words if v.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
            assert len(machine.arcs) == len(right_languages)
            got = [tuple(sorted(p)) for p in spelling.one_edit_pairs(machine, start, longest + 1)]
            assert sorted(got) == sorted(tuple(sorted(p)) for p in itertools.combinations(words, 2) if near(*p))


@pytest.mark.parametrize("group, task", [(10**9, 10**9), (60, 300)])
def test_variants_against_brute_force(spark, group, task):
    """Also with groups cut down to ranges of one place."""
    r = random.Random(3)
    vocabulary = {"".join(r.choice("abcdé") for _ in range(r.randint(1, 6))): r.randint(1, 40) for _ in range(400)}
    vocabulary |= {w + w[-1]: r.randint(1, 40) for w in list(vocabulary)[:60]}
    assert variants(spark, vocabulary, group=group, task=task) == brute_variants(vocabulary)


def test_chains_ties_and_long_words(spark):
    chain = {"abcde": 1, "abcdef": 2, "abcdefg": 4, "abcdefgh": 8, "abcdefghi": 16, "abcdefghij": 32}
    long = {"x" * 30_000: 3, "x" * 29_999 + "y": 9, "x" * 30_001: 6}
    ties = {"stone": 1, "stane": 5, "stine": 5, "storne": 5}
    vocabulary = chain | long | ties
    got = {r[0]: r for r in variants(spark, vocabulary)}
    assert got["abcde"][5] == "abcdefghij" and got["stone"][3] == "stane"
    assert got["x" * 30_000][2:5] == (2, "x" * 29_999 + "y", 9) and got["x" * 30_001][2] == 1


def test_no_words(spark):
    assert variants(spark, {}) == []
    empty = frame(spark, [(None,), ("ab",), ("ab",)], "word string")
    assert spelling.word_counts(empty, 5, 1).count() == 0 and spelling.word_counts(empty, 2, 2).collect()[0].n == 2


def test_words_of_documents_against_a_plain_loop(spark):
    r = random.Random(8)
    rows = [(i if i % 9 else None, " ".join(r.choice(["Straße", "naïve", "river9bank", "ÉCLAIR", "stone's", "ab"]) for _ in range(60)), None, None) for i in range(80)]
    rows += [(5, None, None, None), (6, "", None, None)] + rows[:3]
    want = Counter()
    upper = dict(zip(map(ord, queries.UPPER), queries.LOWER, strict=True))
    for i, t, _, _ in rows:
        run = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                word = run.translate(upper)
                h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
                if h % 97 == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
                if len(word) >= 5:
                    want[word] += 1
                run = ""
    got = queries.spelled_words(frame(spark, rows)).where(F.length("word") >= 5)
    assert Counter(r.word for r in got.collect()) == want and len(want) > 5


# --- mended operators -----------------------------------------------------------------------------


def test_of_equal_rules_the_first_wins_in_any_number_of_passes(spark, monkeypatch):
    rules = [("a.com", "/x", "allow"), ("b.com", "/", "block"), ("a.com", "/x", "block"), ("com", "/", "block")]
    pages = frame(spark, [(1, "http://a.com/x1"), (2, "http://q.a.com/y")], "page_id long, url string")
    for at_once in (10, 2, 1):
        monkeypatch.setattr(url_rules, "RULES_AT_ONCE", at_once)
        got = {r.page_id: (r.rule, r.verdict) for r in url_rules.url_verdicts(pages, rules).collect()}
        assert got == {1: ("a.com/x", "allow"), 2: ("com/", "block")}


def test_short_lines_need_more_sites(spark):
    long = "a passage of many words that only few of all the sites have"
    rows = [(i, f"{long}\nshort line\nown {i}", f"s{i % 6}", i) for i in range(12)]
    docs = frame(spark, rows, "doc_id long, text string, source string, n_chars long")
    got = {g.doc_id: g.text for g in lines.dedup_lines(docs, 5, short_sites=10).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"short line\nown {i}" for i in range(1, 12))
    got = {g.doc_id: g.text for g in lines.dedup_lines(docs, 5).collect()}
    assert all(got[i] == f"own {i}" for i in range(1, 12))


def test_toxic_sentences_keep_their_places_where_lowering_lengthens(spark):
    texts = [f"a zonk sits here number {i}" if i % 2 else f"a good day number {i}" for i in range(200)]
    weights = toxicity.fit(texts, np.array([float(i % 2) for i in range(200)]), np.ones(200))
    text = "İİİİ is fine. a zonk sits."
    row = toxicity.score_toxicity(frame(spark, [(1, text)], "doc_id long, text string"), weights).first()
    assert [text[s.start : s.end].strip() for s in row.toxic_sentences] == ["a zonk sits"]
