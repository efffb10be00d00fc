"""Toxicity by multiple-instance learning: only documents have labels, sentences are what is learned.

A sentence is toxic with probability p_s = sigmoid(bias + sum of the scores of its words); a document is
toxic if any sentence is: P = 1 - prod(1 - p_s), the noisy-or. The likelihood of the document labels
alone trains the word scores, and the sentences with a large p_s are the offending ones. A word's score
is the sum of the weights of its hashed letter n-grams, so unseen forms of a word are recognised.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

BITS = 18  # hashed features
SAMPLE = 4_000  # the most labelled documents of each class that a fit reads
ROUNDS = 200
EVIDENCE = 15.0  # least likelihood ratio (chi-squared with one degree of freedom) of a trained feature
PENALTY = 1e-6
CACHED = 200_000  # word scores that a task keeps
LONG = 64  # runs of letters over this are glued words or a script without blanks
SENTENCE = re.compile("[^.!?\n\u203c\u2047-\u2049\u3002\uff01\uff0e\uff1f\uff61\u0589\u061f\u06d4\u0964\u0965\u104b\u1362\u1367\u17d4\u17d5]+")  # with the full stops of other scripts
LETTERS = re.compile(r"[^\W\d_]+")


def parts(word: str) -> list[str]:
    """A lower-case word with both ends marked; a run of over ``LONG`` letters in pieces, each letter n-gram of the run in one of them."""
    w = f"<{word}>"
    if len(word) <= LONG:
        return [w]
    step = LONG - 4
    return [w[i : i + LONG] for i in range(0, len(w) - 4, step)]


def features(part: str) -> list[int]:
    """Hashed features of one of a word's ``parts``: its letter n-grams of 4 and 5, and a whole word itself."""
    last = part[-1] == ">"  # the next piece has the n-grams that begin behind a piece's last 5-gram
    grams = {part[i : i + n] for n in (4, 5) for i in range(len(part) - (n if last else 5) + 1)}
    if last and part[0] == "<":
        grams.add(part)
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for g in grams]


def _rows(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(counts.size), counts)


def telling(word_doc: np.ndarray, word: np.ndarray, grams: list[list[int]], labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Features found in toxic documents far more often than in others: log-odds above 1 and a likelihood ratio above ``EVIDENCE``."""
    size = 1 << BITS
    lengths = np.array([len(g) for g in grams])
    flat, at = np.concatenate([np.array(g, np.int64) for g in grams]), np.cumsum(lengths) - lengths
    hit = np.zeros((2, size))
    raw = np.zeros((2, size))
    edges = np.searchsorted(word_doc, np.arange(0, labels.size + 200, 200))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):  # 200 documents at a time bound the memory
        pair = np.unique(word_doc[lo:hi].astype(np.int64) * len(grams) + word[lo:hi])
        doc, kind = pair // len(grams), pair % len(grams)
        n = lengths[kind]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        seen = np.unique(np.repeat(doc, n) * size + flat[np.repeat(at[kind], n) + inner])
        doc, gram = seen // size, seen % size
        for y in (0, 1):
            of = labels[doc] == y
            hit[y] += np.bincount(gram[of], weights[doc[of]], size)
            raw[y] += np.bincount(gram[of], None, size)
    docs = np.array([weights[labels == y].sum() for y in (0, 1)])
    rate = (hit + 0.5) / (docs[:, None] + 1)
    both = (raw.sum(0) + 1) / (labels.size + 2)
    counts = np.array([(labels == y).sum() for y in (0, 1)])
    expected = counts[:, None] * both
    ratio = 2 * (raw * np.log((raw + 1e-9) / expected)).sum(0)
    return np.flatnonzero((np.log(rate[1] / rate[0]) > 1) & (ratio > EVIDENCE) & (raw[1] / counts[1] > raw[0] / counts[0]))


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Feature weights and, last, the bias: full-batch Adam on the weighted noisy-or likelihood.

    Only telling features are trained, with weights of at least 0 and an L1 penalty: words add evidence
    for toxicity, none against it.
    """
    types: dict[str, int] = {}
    words, per_sentence, per_doc = [], [], []
    for text in texts:
        n = 0
        for sentence in SENTENCE.findall(text.lower()):
            found = [p for w in LETTERS.findall(sentence) for p in parts(w)]
            if found:
                words.extend(types.setdefault(w, len(types)) for w in found)
                per_sentence.append(len(found))
                n += 1
        per_doc.append(n)
    out = np.zeros((1 << BITS) + 1, np.float32)
    out[-1] = -8.0
    if not words or not (0 < labels.sum() < labels.size):
        return out
    word, doc_of = np.array(words, np.int64), _rows(np.array(per_doc))
    word_sentence = _rows(np.array(per_sentence))
    grams = [features(w) for w in types]
    chosen = telling(doc_of[word_sentence], word, grams, labels, weights)
    if not chosen.size:
        return out
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(chosen.size)
    kind = _rows(np.array([len(g) for g in grams]))
    gram = place[np.concatenate([np.array(g, np.int64) for g in grams])]
    kind, gram = kind[gram >= 0], gram[gram >= 0]
    any_ = np.bincount(kind, None, len(grams))[word] > 0
    word, word_sentence = word[any_], word_sentence[any_]
    w, m, v = np.full(chosen.size + 1, 0.5), np.zeros(chosen.size + 1), np.zeros(chosen.size + 1)
    w[-1] = -8.0
    total = weights.sum()
    for step in range(1, ROUNDS + 1):
        score = np.bincount(kind, w[gram], len(grams))
        z = np.clip(w[-1] + np.bincount(word_sentence, score[word], len(per_sentence)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        a = np.bincount(doc_of, np.logaddexp(0, z), len(per_doc))  # -log of the chance that no sentence is toxic
        pull = np.where(labels > 0, 1 / np.expm1(np.clip(a, 1e-3, 50)), -1.0) * weights / total
        g_z = -pull[doc_of] * p
        g_type = np.bincount(word, g_z[word_sentence], len(grams))
        g = np.append(np.bincount(gram, g_type[kind], chosen.size) + PENALTY, g_z.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w[:-1] = np.maximum(w[:-1], 0)
        w[-1] = min(w[-1], -3.0)
    out[chosen] = w[:-1]
    out[-1] = w[-1]
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> np.ndarray:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id and 0/1 in ``label``).

    At most ``sample`` documents of each class are read, chosen by the hash of their doc_id and weighted
    back to the shares of all labels, so the fit is one bounded task at every size. Of several labels of
    a document the largest counts; missing labels and doc_ids do not. Without both classes the model
    scores everything near 0.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = stored(known.select("doc_id", (F.col("y") > 0).cast("int").alias("y")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = known.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionByName(known.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    scale = {y: n / min(n, sample) for y, n in counts.items()}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 x sample rows
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def learned(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        y = pdf["y"].to_numpy()
        model = fit(pdf["text"].tolist(), y, np.array([scale[int(k)] for k in y]))
        return pd.DataFrame({"model": [model.tobytes()]})

    found = rows.groupBy(F.lit(0).alias("fit")).applyInPandas(learned, "model binary").first()
    return np.frombuffer(found["model"], np.float32) if found else fit([], np.zeros(0), np.zeros(0))


class _Scores(dict):
    """Word scores, computed when first asked for and forgotten together when there are too many."""

    def __init__(self, model: np.ndarray) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        score = sum(float(self.model[features(p)].sum()) for p in parts(word))
        if len(word) <= LONG:
            if len(self) >= CACHED:
                self.clear()
            self[word] = score
        return score


FOUND = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("sentences", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
    ]
)


def score_toxicity(docs: DataFrame, model: np.ndarray, flag: float = 0.3) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic_sentences`` (start, end, score of those of at least ``flag``); columns of these names are replaced.

    Only the text counts. A missing, empty or wordless text scores 0. Every text is read whole; equal
    texts score alike. Offsets are code points.
    """
    state = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers

    @F.pandas_udf(FOUND)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = state.value
        word, bias = _Scores(weights[:-1]).__getitem__, float(weights[-1])
        for texts in batches:
            scores, places = [], []
            for text in texts:
                a, found = 0.0, []
                if text:
                    low = text.lower()
                    if len(low) != len(text):  # some letters grow when lowered: those stay, so that places are the text's
                        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                    for part in SENTENCE.finditer(low):
                        words = LETTERS.findall(part[0])
                        if words:
                            z = min(30.0, max(-30.0, bias + sum(map(word, words))))
                            if z > -20:
                                a += math.log1p(math.exp(z))
                                if (p := 1 / (1 + math.exp(-z))) >= flag:
                                    found.append((part.start(), part.end(), p))
                scores.append(-math.expm1(-a))
                places.append(found)
            yield pd.DataFrame({"score": scores, "sentences": places})

    out = docs.withColumn("_found", scored("text"))
    return out.withColumns({"toxicity": F.col("_found.score"), "toxic_sentences": F.col("_found.sentences")}).drop("_found")
