"""The operators on small made tables: known answers, nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import chat, decontaminate, lines, lm, mixing, near_dup, pii, topk, toxicity, url_rules, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_word_hashes_depend_on_the_word_alone():
    a, n = words.split(["The cat".encode(), b"", "tHE \x0b\x1c dog".encode()])
    assert n.tolist() == [2, 0, 3] and a[0] == a[2] and len(set(a.tolist())) == 4
    long = ("x" * 100_000).encode()
    assert words.split([long + b" y"])[0].size == 2


# --- language model ---------------------------------------------------------------------------


def brute_lm(rows, mass):
    tok = [[w for w in (t or "").split()] + [None] for _, t, _ in rows]
    counts = [Counter() for _ in range(3)]
    for (_, _, held), t in zip(rows, tok, strict=True):
        if not held:
            for n in range(3):
                counts[n].update(tuple(t[i - n : i + 1]) for i in range(n, len(t)))
    total, kinds = sum(counts[0].values()), len(counts[0])
    once, twice = (sum(1 for c in counts[0].values() if c == k) for k in (1, 2))
    discount = min(0.9, once / (once + 2 * twice)) if once else 0.5
    out = []
    for t in tok:
        s = 0.0
        for i in range(len(t)):
            c = counts[0][(t[i],)]
            p = 1.0 if not total else (c - discount) / total if c else discount * kinds / total
            for n in (1, 2):
                if i >= n and total:
                    context = counts[n - 1][tuple(t[i - n : i])]
                    p = (counts[n][tuple(t[i - n : i + 1])] + mass[n + 1] * p) / (context + mass[n + 1])
            s += math.log10(p)
        out.append(s)
    return total, out


def test_lm_against_brute_force(spark):
    rows = [(i, " ".join(random.Random(i).choices("a b c dd e".split(), k=random.Random(i).randint(0, 30))), i % 5 == 1) for i in range(40)]
    rows += [(50, None, False), (51, "", True), (None, "a b", None), (3, rows[3][1], False), (60, "a " * 5_000, False)]
    # Rare words that only one training text and one held-out copy of it have, in different shards.
    rows += [(100 + 2 * i + held, f"rare{i} u{i} v{i} w{i} x{i}", bool(held)) for i in range(20) for held in (0, 1)]
    got = lm.lm_scores(frame(spark, rows, "doc_id long, text string, held boolean"), "held", shard=300).collect()
    total, want = brute_lm([(i, t, bool(h)) for i, t, h in rows], lm.MASS)
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {total}
    assert sorted(round(r.score, 6) for r in got) == sorted(round(x, 6) for x in want)
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (50, 51))


def test_lm_weights_of_a_state_add_up_to_one():
    known, context = (10, 3, 1, 1), np.array([4])
    d = 1 / 3
    unigram = [(c - d) / 10 for c in (5, 3, 2)] + [d * 3 / 10]
    assert math.isclose(sum(unigram), 1)
    m = lm.MASS[2]
    assert math.isclose(sum((c + m * p) / (context[0] + m) for c, p in zip((3, 1, 0, 0), unigram, strict=True)), 1)
    assert known[0] == 10


def test_lm_without_training_or_rows(spark):
    one = lm.lm_scores(frame(spark, [(1, "a b", True)], "doc_id long, text string, held boolean"), "held").first()
    assert one.score == 0 and one.n_known == 0
    assert lm.lm_scores(frame(spark, [], "doc_id long, text string, held boolean"), "held").count() == 0


# --- top-k --------------------------------------------------------------------------------------


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 50)
    monkeypatch.setattr(topk, "QUERIES", 4)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 6) / 8]) for i in range(200)]
    rows += [(7, rows[7][1]), (10, rows[10][1]), (300, None), (301, [1.0, None]), (310, [float("nan")]), (None, [1.0]), (320, [9.0])]
    vectors = frame(spark, rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantised("embedding").alias("vector"), F.lit(1).alias("score"))
    got = topk.top_k(vectors, F.col("vec_id") % 10 == 0, k=3).collect()
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and not math.isnan(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(fine):
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for k, (j, w) in enumerate(fine) if k != n)[:3]
            want += [(q, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_few_and_none(spark):
    few = frame(spark, [(0, [1]), (1, [2])], "vec_id long, vector array<long>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2)]
    assert topk.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0


# --- decontamination ------------------------------------------------------------------------------

QUESTION = "On Monday a farmer named Alice sells 12 apples at 3 dollars and then Alice counts 12 boxes while Bob waits 40 minutes near the old market gate"


def test_templates_find_new_figures_and_refuse_mixed_ones(spark):
    bench = frame(spark, [(1, QUESTION), (2, QUESTION), (3, None), (4, "two words"), (None, prose(9))], "item_id long, text string")
    other = QUESTION.replace("12", "75").replace("Alice", "Wanda").replace("40", "9")
    mixed = QUESTION.replace("12 apples", "75 apples").replace("named Alice", "named Wanda")
    docs = [(1, prose(1) + "\n" + QUESTION), (2, prose(2) + ". " + other + ". " + prose(3)), (3, mixed), (4, prose(4)), (5, None), (6, ""), (1, prose(1) + "\n" + QUESTION), (None, other)]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in docs])
    got = {(r.doc_id, r.item_id): r.changed_slots for r in decontaminate.contaminated(docs, bench.withColumn("digest", F.lit(1))).collect()}
    assert set(got) == {(d, i) for d in (1, 2, None) for i in (1, 2)}
    assert got[1, 1] == 0 and got[2, 1] >= 4
    kept = decontaminate.decontaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == docs.columns
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    bench = frame(spark, [(i, prose(i)) for i in range(6)], "item_id long, text string")
    docs = frame(spark, [(i, prose(100 + i) + " " + prose(i), "en", "s", 0) for i in range(6)])
    monkeypatch.setattr(decontaminate, "HASHES_AT_ONCE", 40)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(i, i) for i in range(6)]


def test_items_of_numbers_and_short_items_are_found_as_they_are(spark):
    items = [(1, "Find the next number: 2, 4, 8, 16, 32"), (2, "What is 12 + 34 * 56 - 78 + 90?"), (3, "Solve 17 * 23"), (4, "")]
    bench = frame(spark, items, "item_id long, text string")
    docs = [(i, f"{prose(i, 20)}. {t} {prose(50 + i, 20)}") for i, t in items]
    docs += [(5, f"{prose(5, 20)} What is 12 + 34 * 56 - 78 + 91? {prose(6, 9)}"), (6, "Solve 17 * 24"), (7, None)]
    got = [(r.doc_id, r.item_id, r.coverage, r.changed_slots) for r in decontaminate.contaminated(frame(spark, docs, "doc_id long, text string"), bench).collect()]
    assert sorted(got) == [(i, i, 1.0, 0) for i in (1, 2, 3)]


def test_short_item_is_found_whole(spark):
    bench = frame(spark, [(1, "green ideas sleep very furiously")], "item_id long, text string")
    docs = frame(spark, [(1, "they say Green ideas sleep very furiously today", "en", "s", 0), (2, "green ideas sleep", "en", "s", 0)])
    assert [r.doc_id for r in decontaminate.contaminated(docs, bench).collect()] == [1]


# --- mixing -----------------------------------------------------------------------------------------


def water(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    want, fixed = {}, {}
    whole = total * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = whole - sum(fixed.values())
        want = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if want[s] > most * sizes[s]]
        if not above:
            return want | fixed
        fixed |= {s: most * sizes[s] for s in above}


def test_mixing_targets_limits_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_BLOCK", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    r = random.Random(3)
    rows = [(i, "w " * r.randint(0, 40), "en", r.choice(["a", "a", "a", "b", "é", None, "Z"]), 0) for i in range(600)]
    rows += [(1, rows[1][1], "en", rows[1][3], 0), (None, "w w", "en", "b", 0), (700, None, "en", "b", 0), (701, "", "en", "empty", 0)]
    docs = frame(spark, rows).withColumn("size", F.lit("clash"))
    got = mixing.mixed_copies(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    taken = defaultdict(int)
    for g in got:
        assert math.isclose(g.target, want[g.source], abs_tol=1e-6) and g.source_size == sizes[g.source]
        assert 0 <= g.taken <= 2 * g.size
        taken[g.source] += g.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 20
    key = lambda g: (g.doc_id is None, g.doc_id or 0, g.source or "", g.taken)
    again = mixing.mixed_copies(docs.repartition(7)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = mixing.mixed_documents(docs)
    assert set(out.columns) == {*docs.columns, "source_size", "target", "copies"}
    assert sorted((r.doc_id or 0, r.copies) for r in out.collect()) == sorted((g.doc_id or 0, g.copies) for g in got if g.copies)
    assert mixing.mixed_copies(docs.limit(0)).count() == 0


def test_pivotal_rounding_keeps_words_and_expectation():
    r = np.random.default_rng(2)
    sizes, share = r.integers(1, 30, 50), np.full(50, 0.3)
    runs = []
    for _ in range(400):
        p, held = mixing.pivoted(sizes, share, r.random(50))
        assert math.isclose((p * sizes).sum(), (share * sizes).sum(), rel_tol=1e-9)
        assert all(x in (0, 1) for i, x in enumerate(p) if i != held)
        runs.append(p)
    assert np.abs(np.mean(runs, 0) - 0.3).max() < 0.12


# --- toxicity --------------------------------------------------------------------------------------


def test_toxicity_learns_sentences_from_document_labels(spark):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        sentences = [prose(1000 * i + k, 8) for k in range(r.randint(1, 6))]
        if bad := i % 4 == 0:
            sentences[r.randrange(len(sentences))] += " " + r.choice(["zonkface", "zonkbrain", "zonkish"])
        rows.append((i, ". ".join(sentences), "en", "s", 0))
        labels.append((i, int(bad)))
    held = [(1000, "a fine day. you zonkfaces all", "en", "s", 0), (1001, prose(77, 500), "en", "s", 0), (1002, None, "en", "s", 0), (1003, "", "en", "s", 0), (1004, "12 !!", "en", "s", 0), (1000, "a fine day. you zonkfaces all", "en", "s", 0)]
    docs = frame(spark, rows + held)
    model = toxicity.fit_toxicity(docs, frame(spark, labels + [(0, None), (None, 1), (5, 0)], "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs.withColumn("toxicity", F.lit("clash")), model).collect()
    by = {g.doc_id: g for g in got}
    assert len(got) == 306 and all(0 <= g.toxicity <= 1 for g in got)
    assert sum((by[i].toxicity >= 0.3) == bool(y) for i, y in labels) >= 295
    assert by[1000].toxicity >= 0.3 and [(s.start, s.end) for s in by[1000].toxic_sentences] == [(11, 29)]
    assert all(by[i].toxicity < 0.3 for i in (1001, 1002, 1003, 1004)) and by[1002].toxicity == by[1003].toxicity == 0
    none = toxicity.fit_toxicity(docs, frame(spark, [], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0
    assert toxicity.score_toxicity(docs, none).agg(F.max("toxicity")).first()[0] < 0.3


def test_toxicity_reads_runs_of_letters_to_their_end(spark):
    for n in (1, 63, 64, 65, 115, 119, 120, 121, 122, 123, 124, 125, 126, 300):
        run = "".join(random.Random(n).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        w = f"<{run}>"
        whole = sorted(w[i : i + k] for k in (4, 5) for i in range(len(w) - k + 1))
        seen = [g for p in toxicity.parts(run) for k in (4, 5) for g in {p[i : i + k] for i in range(len(p) - (k if p[-1] == ">" else 5) + 1)}]
        assert set(seen) == set(whole) and len(seen) <= len(whole)
    texts = [f"{prose(i, 30)} {'zonkface' if i % 3 == 0 else 'plain'} {prose(i + 900, 5)}" for i in range(300)]
    labels = np.array([int(i % 3 == 0) for i in range(300)])
    model = toxicity.fit(texts, labels, np.ones(300))
    glued = [prose(i, 30).replace(" ", "") for i in range(8)]
    rows = [(1, glued[0] + "zonkface" + glued[1]), (2, glued[2] + glued[3]), (3, f"{glued[4]}\u3002zonkface{glued[5]}\uff01{glued[6]}")]
    got = {g.doc_id: g for g in toxicity.score_toxicity(frame(spark, rows, "doc_id long, text string"), model).collect()}
    assert got[1].toxicity >= 0.3 and got[2].toxicity < 0.3 and got[3].toxicity >= 0.3
    begin = len(glued[4]) + 1
    assert [(s.start, s.end) for s in got[3].toxic_sentences] == [(begin, begin + 8 + len(glued[5]))]
    late = [t.replace(" ", "") for t in texts]
    assert toxicity.fit(late, labels, np.ones(300))[:-1].max() > 0


# --- lines -----------------------------------------------------------------------------------------


def test_lines_on_many_sites_stay_once(spark):
    rows = [(i, f"own {i}\n  Share this page  \n\nseen by few {i % 2}", "en", f"s{i % 6}", 9) for i in range(12)]
    rows += [(20, "Share this page", "en", None, 9), (21, None, "en", "s0", None), (22, "", "en", "s0", 0), (0, rows[0][1], "en", "s0", 9), (None, "tail\nShare this page", "en", "s1", 9)]
    rows += [(30, "\n".join(["Share this page"] * 3_000), "en", "s2", 0)]
    docs = frame(spark, rows).withColumn("n_removed", F.lit("clash"))
    got = lines.dedup_lines(docs, min_sites=5).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for g in got:
        by[g.doc_id].append(g)
    assert sum("Share" in (g.text or "") for g in got) == 1 and "Share" in by[None][0].text
    assert by[3][0].text == "own 3\n\nseen by few 1" and by[3][0].n_removed == 1 and by[3][0].n_chars == 20
    assert by[20][0].text == "" and by[21][0].text is None and by[22][0].text == "" and by[30][0].text == ""
    assert [g.text for g in by[0]] == ["own 0\n\nseen by few 0"] * 2
    assert lines.dedup_lines(docs.limit(0), 5).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(1000 * n + i, f"line {n}", "en", f"site{i}", 0) for n in range(190, 211) for i in range(n)]
    found = lines.line_sites(frame(spark, rows))
    assert sorted(r.sites for r in lines.spread_lines(found, 200).collect()) == list(range(200, 211))


# --- urls ------------------------------------------------------------------------------------------


def test_url_rules_against_brute_force(spark):
    rules = [("org", "/", "allow"), ("a.org", "/es/", "block"), ("a.org", "/es/deep", "allow"), ("com", "/fr/", "block"), ("x.a.org", "", "block"), ("com", "", "keep"), ("org", "/", "late")]
    hosts = ["a.org", "A.org", "www.a.org", "ba.org", "x.a.org", "y.x.a.org", "org", "com", "b.com", "", "a.org.com", "xorg"]
    paths = ["", "/", "/es/", "/es/deep/er", "/es", "/fr/1", "/en?x=/es/", "/#/es/", "?q"]
    urls = [f"http://{h}{p}" for h, p in itertools.product(hosts, paths)] + [None, "", "no scheme/es/", "ftp://a.org/es/" + "z" * 50_000, "x://y://a.org/es/"] + ["http://a.org/es/"] * 3
    got = url_rules.url_verdicts(frame(spark, [(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string"), rules).collect()
    for g in got:
        u = urls[g.page_id] or ""
        rest = u.partition("://")[2] if "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        fits = [(len(h) + len(p), len(h), -i, h + p, v) for i, (h, p, v) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[3:] if fits else (None, "allow")
        assert (g.host, g.path, g.rule, g.verdict) == (host, path, *want)
    assert len(got) == len(urls)


def test_many_rules_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "RULES_AT_ONCE", 2)
    rules = [("a.com", "/", "block"), ("com", "/", "allow"), ("com", "/x/", "block"), ("a.com", "/x/y", "allow"), ("net", "/", "block")]
    pages = frame(spark, [(1, "h://a.com/x/y"), (2, "h://a.com/x/"), (3, "h://b.net/"), (4, "h://b.de/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.url_verdicts(pages, rules, default="ask").collect()}
    assert got == {1: ("a.com/x/y", "allow"), 2: ("a.com/", "block"), 3: ("net/", "block"), 4: (None, "ask")}
    assert url_rules.url_verdicts(pages.limit(0), rules).count() == 0


# --- mixing with long documents -----------------------------------------------------------------------


def test_a_long_document_does_not_move_a_source_from_its_target(spark):
    r = random.Random(8)
    rows = [(0, "w " * 5_000, "en", "s3", 0)] + [(i, "w " * r.randint(50, 500), "en", f"s{i % 6}", 0) for i in range(1, 240)]
    for x in mixing.mixed_copies(frame(spark, rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.min("size").alias("least"), F.max("copies").alias("most")).collect():
        assert abs(x.taken - x.target) <= 100 and x.most <= 2


def test_settling_against_the_pool_keeps_words_and_expectation():
    r = np.random.default_rng(5)
    sizes = np.array([900, 300, 200, 150, 150, 100, 90, 80, 60, 50, 40, 30])
    runs = [mixing.pooled(sizes, np.full(12, 0.4), r.random(12)) for _ in range(4_000)]
    assert all(abs(p @ sizes - 0.4 * sizes.sum()) < 1e-6 and ((p >= 0) & (p <= 1)).all() for p in runs)
    assert all(((p > 0) & (p < 1)).sum() <= 4 for p in runs)
    # The first one outweighs what the others can give up, so it goes to 0; the share of words stays.
    assert all(p[0] == 0 for p in runs)
    fair = [mixing.pooled(sizes[1:], np.full(11, 0.4), r.random(11)) for _ in range(4_000)]
    assert abs(np.mean([p[0] for p in fair]) - 0.4) < 0.03
    assert mixing.pooled(sizes[:1], np.array([0.4]), r.random(1)).tolist() == [0.4] and mixing.pooled(sizes[:0], np.empty(0), r.random(0)).size == 0


# --- near duplicates -----------------------------------------------------------------------------------


def chained(a, b):
    """Longest common subsequence of words."""
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return last[-1]


def alike(a, b):
    n = chained(a, b)
    return a == b if min(len(a), len(b)) < near_dup.SHORT + 4 else n >= 0.8 * (len(a) + len(b) - n)


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    r = random.Random(4)
    rows = []
    for g in range(6):
        base = prose(g, 80).split()
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice("uvwxyz") * 3
            rows.append(" ".join(w))
    rows += [rows[0].upper(), rows[0].replace(" ", "  "), None, "", "  ", "one two", "one two", "two one", prose(50, 6), prose(50, 5), prose(60, 20_000), "a a a a a a a a a a", "a a a a a a a a a a a"]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(rows)] + [(3, rows[3], "en", "s", 0), (None, prose(70), "en", "s", 0)])
    got = near_dup.near_duplicates(docs).collect()
    held = [(t or "").lower().split() for t in rows]
    root = list(range(len(rows)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, j in itertools.combinations(range(len(rows)), 2):
        if min(len(held[i]), len(held[j])) < 0.8 * max(len(held[i]), len(held[j])) or top(i) == top(j):
            continue
        if alike(held[i], held[j]):
            root[max(top(i), top(j))] = min(top(i), top(j))
    assert {(g.doc_id, g.class_id) for g in got} == {(i, top(i)) for i in range(len(rows))} | {(None, None)}
    assert len(got) == len(rows) + 2
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id is None, x.doc_id) for x in kept.collect()) == sorted((False, i) for i in {top(i) for i in range(len(rows))}) + [(True, None)]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def edited(words, n, r):
    w = list(words)
    for _ in range(n):
        at, how = r.randrange(len(w)), r.random()
        w[at : at + 1] = [] if how < 0.3 else [w[at], "added"] if how < 0.6 else [r.choice("uvwxyz") * 3]
    return w


def test_near_copies_with_scattered_edits_meet(spark):
    """Pairs only, so no third text helps: at least nine in ten of those with a word similarity of 0.8, all copies with few edits, and nothing else."""
    r = random.Random(12)
    pairs = []
    for g in range(150):
        base = prose(g, r.choice([40, 150, 600])).split()
        pairs.append((base, edited(base, max(1, int(len(base) * r.choice([0.02, 0.05, 0.08, 0.1, 0.3]))), r)))
    docs = frame(spark, [(2 * g + k, " ".join(w), "en", "s", 0) for g, pair in enumerate(pairs) for k, w in enumerate(pair)])
    of = {x.doc_id: x.class_id for x in near_dup.near_duplicates(docs).collect()}
    same = [of[2 * g] == of[2 * g + 1] for g in range(len(pairs))]
    truth = [alike(a, b) for a, b in pairs]
    assert not any(s and not t for s, t in zip(same, truth))
    assert sum(same) >= 0.9 * sum(truth) and 50 < sum(truth) < 140
    assert len(set(of.values())) == 2 * len(pairs) - sum(same)


def test_many_links_to_one_centre_go_through_stand_ins(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 10)
    base, r = prose(5, 120).split(), random.Random(2)
    docs = frame(spark, [(i, " ".join(edited(base, 2, r)), "en", "s", 0) for i in range(200)])
    got = near_dup.near_duplicates(docs.repartition(4)).collect()
    assert len(got) == 200 and {(x.class_id, x.class_size) for x in got} == {(0, 200)}


def test_one_of_each_goes_by_class_not_by_doc_id(spark):
    def near(seed):
        return prose(seed, 80) + " end"

    rows = [(1, prose(1, 80)), (1, prose(2, 80)), (7, near(2)), (None, prose(3, 80)), (None, near(3)), (None, prose(4, 80)), (None, ""), (9, None)]
    kept = near_dup.one_of_each(frame(spark, rows, "doc_id long, text string")).collect()
    assert sum(r.doc_id == 1 for r in kept) == 2 and {r.text for r in kept if r.doc_id == 1} == {prose(1, 80), prose(2, 80)}
    nameless = [r.text for r in kept if r.doc_id is None]
    assert len(nameless) == 2 and prose(4, 80) in nameless and set(nameless) & {prose(3, 80), near(3)}
    assert [r.text for r in kept if r.doc_id in (7, 9)] == [None]


def test_alignment_minds_the_order():
    a = np.arange(1, 101, dtype=np.uint64)
    assert near_dup.aligned(a, a) == 1 and near_dup.aligned(a, a[::-1].copy()) < 0.1
    assert near_dup.aligned(a, a[10:]) == 0.9 and near_dup.aligned(a, np.concatenate((a[:5], a[10:]))) == 0.95
    assert near_dup.aligned(a, np.concatenate((a[50:], a[:50]))) < 0.8
    assert near_dup.aligned(a[:0], a[:0]) == 1 and near_dup.aligned(a[:0], a) == 0


def test_alignment_against_the_full_table():
    r = random.Random(6)
    for n in [*range(1, 60), 3_000]:  # the last takes several stretches
        a = [r.randint(0, r.choice([3, 300])) for _ in range(n)]
        b = [int(x) if str(x).isdigit() else 999 for x in edited(a[:-1] + [1], n // 15, r)] or [1]
        both = chained(a, b)
        share, got = both / (len(a) + len(b) - both), near_dup.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == share if share >= 0.8 else got <= share


# --- chat -----------------------------------------------------------------------------------------------


def test_chat_windows_round_trip(spark):
    r = random.Random(8)
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind " * (c % 2)))
        for t in range(1, r.randint(2, 30)):
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "tool: x"]), r.choice(["### User: hi</turn>", "\\h \\ \\b", "a\nb " * r.randint(0, 60), None, ""])))
    rows += [(99, None, None, None), (None, 1, "assistant", "nobody's"), (50, 1, "assistant", "w " * 3_000), (51, 1, "user", "same"), (51, 1, "user", "same")]
    turns = frame(spark, rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = chat.chat_windows(turns, budget=120, history=30)
    for w in windows.collect():
        assert w.n_tokens <= 120 or w.n_turns - w.n_context <= 1
    got = {g.conv_id: g for g in chat.conversation_digest(windows).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, said in by.items():
        said.sort()
        assert got[c].n_turns == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in said).encode()).hexdigest()
        loss = "".join(x[3] for x in said if x[2] == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    first = [w for w in windows.where("conv_id = 3").orderBy("window").collect()]
    assert all(w.formatted.startswith("### system: ") for w in first)
    assert chat.conversation_digest(chat.chat_windows(turns.limit(0))).count() == 0


# --- personal data -----------------------------------------------------------------------------------------


def test_patterns_keep_their_rules():
    text = "a@b.c@d.e 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 4111111111111112 +1 (200) 555-0100 +1-2"
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in pii.patterns(text)] == [("email", "a@b.c"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111 1111 1111 4111111111111112")][:3] + [("phone", "+1 (200) 555-0100")]
    assert pii.patterns("4111-1111-1111-1111") == [(2, 0, 19)] and pii.patterns("1" * 100_000) == [] and pii.patterns("@" * 1_000) == []


def test_field_carries_labels_to_repeats(spark):
    r = random.Random(6)
    rows = []
    for i in range(200):
        phone = f"+1 ({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"
        rows.append((i, f"{prose(i, 10)} call {phone} or write to a{i}.b@mail.example.com {prose(i + 500, 10)} in {r.randint(1000, 2000)} items", "en", "s", 0))
    more = [(300, None), (301, ""), (302, prose(5, 30)), (303, "4111111111111111 and then 4111111111111111. again"), (304, "x " * 50_000)]
    docs = frame(spark, rows + [(i, t, "en", "s", 0) for i, t in more]).withColumn("pii", F.lit("clash"))
    model = pii.fit_pii(docs)
    got = {g.doc_id: g.pii for g in pii.find_pii(docs, model).collect()}
    assert all([s.kind for s in got[i] if s.base] == ["email", "phone"] for i in range(200))
    assert got[300] == got[301] == got[302] == got[304] == []
    assert pii.find_pii(docs.limit(0), pii.fit_pii(docs.limit(0))).count() == 0


def test_skip_links_outvote_a_word_alone():
    words_ = pii.Words(["4111111111111111 noted " + "and " * 50 + "x1111111 later"])
    model = np.zeros((pii.Words.WIDTH + pii.LABELS + 1, pii.LABELS))
    model[-1, 0] = 4.0
    p = pii.posteriors(words_, model)
    assert words_.skip == [(0, 1)] and p[1].argmax() == 3 and p[1].max() > 0.9
    model[-1, 0] = 0.0
    assert pii.posteriors(words_, model)[1].max() < 0.3


def test_one_match_reaches_fifty_repeats():
    neutral = np.zeros((pii.Words.WIDTH + pii.LABELS + 1, pii.LABELS))
    neutral[-1, 0] = 4.0
    p = pii.posteriors(pii.Words(["4111111111111111 noted " + "and x1111111 later " * 50]), neutral)
    assert (p[1:, 3] > pii.SURE).all() and np.ptp(p[1:, 3]) < 0.01
    short = pii.Words(["room 12 and room 12 again, 12"])
    assert len(short.skip) == 2
    usual = [f"{prose(i, 10)} write to a{i}.b@mail.example.com {prose(i + 500, 10)} or a{i}.b@mail.example.com in {1000 + i} items" for i in range(200)]
    long = pii.Words([f"bob@host.org {prose(1, 5)} " + " ".join(f"bob@host {prose(i, 5)}" for i in range(50))])
    assert [k for k, _, _ in pii.added_spans(long, pii.fit(usual))[0]] == [0] * 50


@pytest.mark.parametrize("name", ["op6_line_dedup", "op9_chat"])
def test_native_queries_run_no_python(spark, sf_dir, name):
    from holdfast.llm import queries

    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
