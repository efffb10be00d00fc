"""Personal data: fixed patterns, extended by a skip-chain conditional random field.

The nodes of the field are the words of a document that hold a digit or ``@``; their labels are the
kinds of personal data or none. Neighbouring words are linked in a chain. Words that repeat each
other or are alike (the same last digits, the same mailbox), however far apart, are linked to one
hub, so that any two of them are two steps apart: they share a potential for having the same label.
Loopy belief propagation makes the labels of each document agree. Words inside a pattern match are fixed to its kind, so they lend it to others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
SAMPLE = 6_000  # the most documents that a fit reads
ROUNDS = 2_000  # of belief propagation at most; it ends for a text when no message changes by more than SETTLED
SETTLED = 1e-4
SURE = 0.9  # least posterior of an added word

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches, by kind and start."""
    out = []
    at, upto = text.find("@"), 0
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            upto = m.end()
        at = text.find("@", max(upto, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 60 else ""
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdecimal() for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


_SIZES = (1, 2, 3, 4, 5, 8, 11, 13, 16, 20)


def _size(n: int) -> int:
    return sum(n >= s for s in _SIZES)


class Words:
    """The field's nodes in a run of documents: place, features, fixed label (0: open), chain and skip links."""

    WIDTH = 64

    def __init__(self, texts: list[str]) -> None:
        self.found = [patterns(t) for t in texts]
        self.text, self.span, keys, features, fixed, self.chain = [], [], {}, [], [], []
        for d, (t, base) in enumerate(zip(texts, self.found, strict=True)):
            if not base and "@" not in t and not _DIGIT.search(t):
                continue
            spans = sorted((s, e, k) for k, s, e in base)
            at, before, sizes = 0, None, []
            begin = len(self.text)
            for m in _WORD.finditer(t):
                raw = m[0]
                start, end = m.start() + len(raw) - len(raw.lstrip("\"'([{<")), m.end() - len(raw) + len(raw.rstrip("\"')]}>.,;:!?"))
                if start >= end:
                    continue
                w = t[start:end]
                while at < len(spans) and spans[at][1] <= start:
                    at += 1
                label = next((1 + k for s, e, k in spans[at : at + 4] if s < end and e > start), 0)
                node = len(self.text)
                digits = "".join(_DIGIT.findall(w))
                if before is not None and m.start() - before <= 1:
                    self.chain.append((node - 1, node))
                before = m.end()
                letters = sum(c.isalpha() for c in w[:100])
                features.append(
                    [0, 1 + _size(len(digits)), 12 + min(w.count("."), 4), 17 + min(w.count("-"), 3), 21 + min(w.count("@"), 1), 23 + (w[0] == "+"), 25 + (raw[0] == "("),
                     27 + min(letters, 1) + (letters > 4), 30 + ("=" in w), 32 + (":" in w), 34 + _size(len(w)), 45 + (len(digits) == len(w))]
                )
                sizes.append((node, len(digits)))
                self.text.append(d)
                self.span.append((start, end))
                fixed.append(label)
                if "@" in w:
                    keys.setdefault((d, w.split("@")[0].lower()), []).append(node)
                elif len(digits) >= 7:
                    keys.setdefault((d, digits[-7:]), []).append(node)
                    if 1 <= w.count("."):
                        keys.setdefault((d, digits), []).append(node)
                else:
                    keys.setdefault((d, w.lower()), []).append(node)
            for node, n in sizes:
                features[node] += [47 + _size(sizes[node - begin - 1][1]) if (node - 1, node) in self.chain[-1:] else 47]
        self.fixed = np.array(fixed, np.int64)
        self.features = features
        groups = [g for g in (list(dict.fromkeys(nodes)) for nodes in keys.values()) if len(g) > 1]
        # A fit counts repeats from one to the next; inference links each to the hub of its key. Both grow with the occurrences, not their pairs.
        self.skip = [(a, b) for g in groups for a, b in zip(g[:-1], g[1:], strict=True)]
        self.hubs = groups

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.features), self.WIDTH), np.float64)
        for row, used in zip(out, self.features, strict=True):
            row[used] = 1
        return out


def fit(texts: list[str]) -> np.ndarray:
    """Weights learned from the pattern matches of ``texts``: features x labels, then transitions, then one row with the skip potential."""
    words = Words(texts)
    x, y = words.matrix(), words.fixed
    out = np.zeros((Words.WIDTH + LABELS + 1, LABELS))
    out[0, 0] = 2.0
    out[-1, 0] = 2.0
    if not y.size:
        return out
    w, target = np.zeros((Words.WIDTH, LABELS)), np.eye(LABELS)[y]
    for _ in range(400):  # gradient ascent of the multinomial logistic likelihood
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w += 2.0 * (x.T @ (target - p) / len(y) - 1e-4 * w)
    out[: Words.WIDTH] = w
    pair = np.ones((LABELS, LABELS))
    for a, b in words.chain:
        pair[y[a], y[b]] += 1
    share = np.bincount(y, minlength=LABELS) + 1.0
    share /= share.sum()
    out[Words.WIDTH : -1] = np.clip(np.log(pair / pair.sum(1, keepdims=True)) - np.log(share), -2, 2)
    same = sum(y[a] == y[b] for a, b in words.skip)
    out[-1, 0] = np.clip(np.log((same + 1) / (len(words.skip) - same + 1)), 1.0, 4.0)
    return out


def posteriors(words: Words, model: np.ndarray) -> np.ndarray:
    """Label probabilities of every node after damped loopy belief propagation, run for each text until its messages settle.

    A key's hub adds up what matched words say and the mean of what open ones say: the same word said
    again is no new evidence against a match, however often it stands there.
    """
    n = len(words.features)
    unary = words.matrix() @ model[: Words.WIDTH]
    held = words.fixed > 0
    unary[held] = -30.0
    unary[np.flatnonzero(held), words.fixed[held]] = 0.0
    spokes = [(node, n + h) for h, group in enumerate(words.hubs) for node in group]
    edges = np.array(words.chain + spokes, np.int64).reshape(-1, 2)
    if len(edges):
        unary = np.concatenate((unary, np.zeros((len(words.hubs), LABELS))))
        a, b = edges[:, 0], edges[:, 1]
        # Two steps through a hub are worth one skip potential: (x^2 + 4) / (2 x + 3) = ratio for x = exp(step).
        ratio = np.exp(max(model[-1, 0], 0.0))
        step = np.log(ratio + np.sqrt(ratio * ratio + (LABELS - 2) * ratio - (LABELS - 1)))
        move = np.broadcast_to(model[Words.WIDTH : -1], (len(words.chain), LABELS, LABELS))
        potential = np.concatenate((move, np.broadcast_to(step * np.eye(LABELS), (len(spokes), LABELS, LABELS))))
        open_ = np.array([max(1, sum(words.fixed[g] == 0)) for g in words.hubs])
        weight = np.ones(2 * len(a))
        if spokes:
            weight[len(words.chain) : len(a)] = np.where(held[a[len(words.chain) :]], 1.0, 1 / open_[b[len(words.chain) :] - n])
        source, goal = np.concatenate((a, b)), np.concatenate((b, a))
        both = np.concatenate((potential, potential.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
        text = np.tile(np.array(words.text)[a], 2)
        message = np.zeros((len(source), LABELS))

        def gathered(e: np.ndarray) -> np.ndarray:
            return unary + np.stack([np.bincount(goal[e], weight[e] * message[e, k], len(unary)) for k in range(LABELS)], 1)

        live = np.arange(len(source))
        for _ in range(ROUNDS):
            out = (gathered(live)[source[live]] - (weight[:, None] * message)[back[live]])[:, :, None] + both[live]
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new = 0.5 * message[live] + 0.5 * (new - new.max(1, keepdims=True))
            change = np.zeros(text.max() + 1)
            np.maximum.at(change, text[live], np.abs(new - message[live]).max(1))
            message[live] = new
            live = live[change[text[live]] > SETTLED]
            if not live.size:
                break
        unary = gathered(np.arange(len(source)))[:n]
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(words: Words, model: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """(kind, start, end) of runs of neighbouring words that the field is sure of, outside pattern matches, by text."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not words.features:
        return out
    p = posteriors(words, model)
    best = np.where(p.max(1) >= SURE, p.argmax(1), 0)
    linked = {b for _, b in words.chain}
    last = None
    for node in np.flatnonzero((best > 0) & (words.fixed == 0)).tolist():
        d, (start, end), kind = words.text[node], words.span[node], int(best[node]) - 1
        runs = out.setdefault(d, [])
        if runs and last == node - 1 and node in linked and runs[-1][0] == kind:
            runs[-1] = (kind, runs[-1][1], end)
        else:
            runs.append((kind, start, end))
        last = node
    return out


def fit_pii(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Learn the field's weights from the pattern matches in at most ``sample`` documents that hold a digit or ``@``, chosen by hash."""
    # Only hashes are ordered; texts follow for the chosen ones. Equal rows have one hash and count once.
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("hash"), "text").where(F.col("text").rlike("[0-9@]"))
    chosen = hashed.select("hash").distinct().orderBy("hash").limit(sample)
    rows = hashed.join(F.broadcast(chosen), "hash").groupBy("hash").agg(F.min("text").alias("text"))  # at most ``sample`` rows

    def learned(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [fit(sorted(pdf["text"])).tobytes()]})

    found = rows.groupBy(F.lit(0).alias("fit")).applyInPandas(learned, "model binary").first()
    return (np.frombuffer(found["model"]) if found else fit([]).ravel()).reshape(-1, LABELS)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])


def find_pii(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``docs`` with ``pii``: an array of (kind, start, end, base), by kind as in ``KINDS`` and start; a column of this name is replaced.

    ``base`` tells pattern matches, which always stay, from spans that the field added; those do not
    overlap a match. Offsets are code points, end exclusive. Texts are read whole, each by itself, so
    equal texts give equal spans. A missing or empty text has none.
    """

    @F.pandas_udf(T.ArrayType(SPAN))
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list = []
            texts = [t if isinstance(t, str) else "" for t in batch]
            for lo in range(0, len(texts), 2_000):
                words = Words(texts[lo : lo + 2_000])
                more = added_spans(words, model)
                for d, base in enumerate(words.found):
                    every = [(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in more.get(d, ())]
                    out.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in sorted(every)])
            yield pd.Series(out, dtype=object)

    return docs.withColumn("pii", spans("text"))

