"""Language-model scores from a weighted backoff automaton that never has to fit into one place.

The model is a smoothed n-gram model of up to ``ORDER`` words. A context that occurs in training is a
state. From a state h, a word w that followed h in training has an arc of weight
log10((c(hw) + m p(w|h')) / (c(h) + m)); any other word takes the failure arc, of weight
log10(m / (c(h) + m)), to the state h' without its first word, and is looked up there. At the root,
known words have their discounted share and all unknown words share the discounts. The weights of a
state add up to 1. A text is scored from left to right: the state after a word is the longest known
context that ends there.

Texts are dealt into shards by hash. A shard sends its distinct n-grams with its training counts to
buckets by hash range, sorted and packed; a bucket adds up what all shards sent and answers each with
the totals of the n-grams it asked for, and whether another shard did. So every shard gets just the part of the automaton that its
texts can reach. An n-gram occurs once in what a shard sends, however frequent it is. Words and pairs
go first. A longer n-gram is asked for only if both n-grams it is made of, one word shorter, occur in
other shards too; else its own count is the total already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, stored
from .words import chunks, joined, mixed, split

ORDER = 3
MASS = (0.0, 0.0, 2000.0, 2.0)  # m by order: how many occurrences the shorter context's estimate counts for
SHARD = 8_000_000  # characters of text in a shard

_END = mixed(np.array([0x5EED], np.uint64))


def packed(x: np.ndarray) -> bytes:
    """Bytes of an int64 array: by significance, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(b: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.int64).ravel()


def tokens(texts: Iterator[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words and, behind each text, its end; tokens per text)."""
    found, counts = [], []
    for _, run in chunks(texts):
        words, per_text = split(run)
        out = np.empty(words.size + per_text.size, np.uint64)
        ends = np.cumsum(per_text + 1) - 1
        word = np.ones(out.size, bool)
        word[ends] = False
        out[ends], out[word] = _END, words
        found.append(out)
        counts.append(per_text + 1)
    return (np.concatenate(found), np.concatenate(counts)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))


def ngrams(words: np.ndarray, counts: np.ndarray, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``order``: (hash of the n-gram that ends at each token, whether the text reaches back that far)."""
    place = np.arange(words.size) - np.repeat(np.cumsum(counts) - counts, counts)
    back, out = words, words
    for n in range(1, order + 1):
        if n > 1:
            # The n-gram that ends here: the one of n - 1 words that ends at the token before, and this word.
            out = np.empty_like(words)
            out[:1] = 0
            out[1:] = joined(back[:-1], words[1:]) + np.uint64(n)
            back = out
        yield out, place >= n - 1


def traced(words: np.ndarray, counts: np.ndarray, train: np.ndarray, got: pd.DataFrame | None, most: int) -> tuple[list[np.ndarray], list[tuple[int, np.ndarray, np.ndarray]]]:
    """(training total of the n-gram that ends at each token, what a shard asks for), both for n = 1 to ``most``.

    What is asked for are sorted hashes and the shard's own training counts. Totals come from the answers
    in ``got``; for an n without answers they are the own counts.
    """
    totals, asked, spread = [], [], None
    for n, (grams, whole) in enumerate(ngrams(words, counts, most), 1):
        distinct, of = np.unique(grams[whole], return_inverse=True)
        total = np.bincount(of[train[whole]], minlength=distinct.size)
        wanted = np.ones(distinct.size, bool)
        if n > 2:  # both parts must occur in other shards
            both = np.zeros(words.size, bool)
            both[1:] = spread[1:] & spread[:-1]
            wanted[of] = both[whole]
        asked.append((n, distinct[wanted], total[wanted]))
        shared = np.zeros(distinct.size, bool)
        if got is not None and len(part := got[got["n"] == n]):
            part = part.sort_values("bucket")
            answer = np.concatenate([unpacked(c, s) for c, s in zip(part["counts"], part["size"], strict=True)])
            total[wanted], shared[wanted] = answer >> 1, answer & 1
        spread, at = np.zeros(words.size, bool), np.zeros(words.size, np.int64)
        spread[whole], at[whole] = shared[of], total[of]
        totals.append(at)
    return totals, asked


def _edges(buckets: int) -> np.ndarray:
    return np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)


def log_probabilities(totals: list[np.ndarray], known: tuple[int, int, int, int], first: np.ndarray, mass: tuple[float, ...] = MASS) -> np.ndarray:
    """log10 probability of every token: one pass over the tokens, each met in the state left by the one before.

    ``totals[n]``: training count of the (n+1)-gram that ends at each token, 0 where unknown. ``known``:
    training tokens, distinct words, and words seen once and twice. ``first``: where a text begins; the
    state there is the root.
    """
    n, v, once, twice = known
    discount = min(0.9, once / (once + 2 * twice)) if once else 0.5
    if n == 0:
        return np.zeros(totals[0].size)
    c = totals[0]
    p = np.where(c > 0, (c - discount) / n, discount * v / n)
    for k in range(1, len(totals)):
        context = np.concatenate(([0], totals[k - 1][:-1]))  # the state: how often its context occurred
        context[first] = 0
        m = mass[k + 1]
        failing = m / (context + m)
        arc = totals[k]
        p = np.where(arc > 0, arc / (context + m), 0.0) + failing * p
    return np.log10(p)


def lm_scores(docs: DataFrame, held_out: str, order: int = ORDER, mass: tuple[float, ...] = MASS, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ``held_out``): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (A-Z lower-cased) and an end behind each text. The model learns from rows whose
    ``held_out`` is not true. ``n_known`` counts tokens that occur in training; ``base_score`` is the
    log10 probability under single words with half a count added, ``score`` under the automaton. A
    missing or empty text is an end alone. Without training texts every score is 0. Repeated rows count
    as often as they occur. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    shards = blocks(docs, F.length("text") + 20, shard)
    dealt = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"))
    edges = _edges(shards)

    columns = ["n", "bucket", "shard", "size", "grams", "counts"]

    def sent(batch: pd.DataFrame, got: pd.DataFrame, least: int, most: int) -> pd.DataFrame:
        out = []
        if len(batch):
            words, counts = tokens(batch["text"])
            train = np.repeat(~batch["held_out"].to_numpy(bool), counts)
            _, asked = traced(words, counts, train, got, most)
            for n, grams, total in asked[least - 1 :]:
                cut = np.concatenate(([0], np.searchsorted(grams, edges), [grams.size]))
                for b, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    if hi > lo:
                        steps = np.diff(grams[lo:hi], prepend=np.uint64(0)).view(np.int64)
                        out.append((n, b, int(batch["shard"].iloc[0]), hi - lo, packed(steps), packed(total[lo:hi])))
        return pd.DataFrame(out, columns=columns)

    def added(batch: pd.DataFrame) -> pd.DataFrame:
        sizes = batch["size"].tolist()
        grams = np.concatenate([np.cumsum(unpacked(g, s).view(np.uint64), dtype=np.uint64) for g, s in zip(batch["grams"], sizes, strict=True)])
        counts = np.concatenate([unpacked(c, s) for c, s in zip(batch["counts"], sizes, strict=True)])
        order_ = np.argsort(grams, kind="stable")
        new = np.concatenate(([True], np.diff(grams[order_]) > 0))
        total = np.add.reduceat(counts[order_], np.flatnonzero(new))
        answer = np.empty_like(counts)
        senders = np.diff(np.append(np.flatnonzero(new), grams.size))  # a shard sends an n-gram once
        answer[order_] = np.repeat(2 * total + (senders > 1), senders)
        out = pd.DataFrame({"shard": batch["shard"], "n": batch["n"], "bucket": batch["bucket"], "size": sizes})
        out["counts"] = [packed(a) for a in np.split(answer, np.cumsum(sizes)[:-1])]
        for k in ("tokens", "words", "once", "twice"):
            out[k] = 0
        if batch["n"].iloc[0] == 1:
            out.loc[out.index[0], ["tokens", "words", "once", "twice"]] = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
        return out

    def only(n: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
        return lambda batch, got: sent(batch, got, n, n)

    request = "n int, bucket int, shard int, size int, grams binary, counts binary"
    reply = "shard int, n int, bucket int, size int, counts binary, tokens long, words long, once long, twice long"
    early = min(2, order)
    asked = dealt.groupBy("shard").applyInPandas(lambda batch: sent(batch, None, 1, early), request)
    answers = stored(asked.groupBy("n", "bucket").applyInPandas(added, reply))
    for n in range(early + 1, order + 1):
        asked = dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(only(n), request)
        answers = answers.unionByName(stored(asked.groupBy("n", "bucket").applyInPandas(added, reply)))
    row = answers.agg(F.sum("tokens"), F.sum("words"), F.sum("once"), F.sum("twice")).first()
    known = tuple(int(x or 0) for x in row)

    def scored(batch: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        words, counts = tokens(batch["text"])
        totals, _ = traced(words, counts, np.repeat(~batch["held_out"].to_numpy(bool), counts), got, order)
        begin = np.cumsum(counts) - counts
        base = np.log10((totals[0] + 0.5) / (known[0] + 0.5 * (known[1] + 1)))
        score = log_probabilities(totals, known, begin, mass)
        return pd.DataFrame(
            {
                "doc_id": batch["doc_id"].to_numpy(),
                "held_out": batch["held_out"].to_numpy(bool),
                "n_tokens": counts,
                "n_known": np.add.reduceat((totals[0] > 0).astype(np.int64), begin),
                "train_tokens": known[0],
                "base_score": np.add.reduceat(base, begin),
                "score": np.add.reduceat(score, begin),
            }
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(scored, result)
