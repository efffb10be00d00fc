"""Spelling variants: words one edit apart, found by composing finite-state machines.

The pairs of a vocabulary V that differ by one inserted, deleted or replaced code point are what the
composition V o T o V accepts, V being the minimal acceptor of the words and T the one-edit transducer. The
composition is cut by its initial states: a group holds the words that agree before and behind a range of
places, and its composition starts in the state that the common beginning leads to and allows the edit in
that range only. Every pair has one place of its edit (its first difference), hence one group.

A group has its words' lengths m and m + 1, a range of places, and their common beginning and end. Words start
in the groups of their two halves; a group with too many letters is cut again at the middle of its range. A
range of one place leaves one or two free code points, so no group grows with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

GROUP = 100_000  # letters of a group above which its range of places is cut
TASK = 1_000_000  # letters of the groups that share one acceptor
ROW = 16  # letters that a word counts besides its own


def word_counts(words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """Words (column ``word``, one row per occurrence) of enough code points and occurrences, with their count ``n``.

    Missing words are left out. Frequent words are added up before the shuffle.
    """
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


# --- machines -------------------------------------------------------------------------------------


class Acceptor:
    """Minimal acyclic acceptor of several sets of strings: equal right languages are one state.

    Per state its arcs, whether it is final, and how many strings lead from it to a final state.
    """

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self.register: dict[tuple, int] = {}
        self.met: dict[tuple[int, int], list[str]] = {}

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        at = self.register.get(key)
        if at is None:
            at = self.register[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.size.append(final + sum(self.size[t] for t in arcs.values()))
        return at

    def add(self, strings: Sequence[str]) -> int:
        """Add a set of distinct strings, given in order; returns its initial state."""
        path: list[tuple[dict[str, int], bool]] = [({}, False)]  # states on the way of the last string, still open
        last = ""
        for s in strings:
            same = 0
            for a, b in zip(last, s):  # noqa: B905
                if a != b:
                    break
                same += 1
            self._close(path, last, same)
            path.extend(({}, False) for _ in range(len(s) - same))
            path[-1] = (path[-1][0], True)
            last = s
        self._close(path, last, 0)
        return self._state(*path[0])

    def _close(self, path: list, last: str, depth: int) -> None:
        while len(path) > depth + 1:
            arcs, final = path.pop()
            path[-1][0][last[len(path) - 1]] = self._state(arcs, final)

    def common(self, a: int, b: int) -> list[str]:
        """Strings that lead from both states to a final state: behind the edit the transducer only copies."""
        key = (a, b) if a < b else (b, a)
        found = self.met.get(key)
        if found is None:
            found = self.met[key] = list(self._walk(a, b))
        return found

    def _walk(self, a: int, b: int) -> Iterator[str]:
        arcs, final = self.arcs, self.final
        stack = [(a, b, "")]
        while stack:
            a, b, done = stack.pop()
            tail: list[str] = []
            while True:
                if final[a] and final[b]:
                    yield done + "".join(tail)
                mine, other = arcs[a], arcs[b]
                if len(other) < len(mine):
                    mine, other = other, mine
                shared = [(y, t, other[y]) for y, t in mine.items() if y in other]
                if len(shared) != 1:
                    break
                y, a, b = shared[0]
                tail.append(y)
            if shared:
                done += "".join(tail)
                stack.extend((t, u, done + y) for y, t, u in shared)


def one_edit_pairs(machine: Acceptor, start: int, places: int) -> Iterator[tuple[str, str]]:
    """Accepted pairs of the composition from (``start``, nothing edited, ``start``), the edit in the first ``places`` places.

    The first string is the shorter one, if lengths differ. A pair comes once: it is edited where the strings
    first differ, so behind an inserted code point the shorter string does not go on with the same one.
    """
    path: list[str] = []
    stack = [(start, 0, "")]
    while stack:
        state, depth, symbol = stack.pop()
        if depth:
            del path[depth - 1 :]
            path.append(symbol)
        arcs = list(machine.arcs[state].items())
        if len(arcs) > 1 or machine.final[state]:
            prefix = "".join(path)
            for i, (x, a) in enumerate(arcs):
                for y, b in arcs[:i]:
                    for s in machine.common(a, b):
                        yield f"{prefix}{y}{s}", f"{prefix}{x}{s}"
                if machine.final[state] and machine.final[a]:
                    yield prefix, prefix + x
                after = machine.arcs[a]
                for y, b in arcs:
                    if y != x and y in after:
                        for s in machine.common(b, after[y]):
                            yield f"{prefix}{y}{s}", f"{prefix}{x}{y}{s}"
        if depth + 1 < places:
            # One string has no pair, so only states with several are gone on with.
            stack.extend((a, depth + 1, x) for x, a in arcs if machine.size[a] > 1)


# --- groups ---------------------------------------------------------------------------------------


def _shared(length: int, low: int, high: int) -> tuple[int, int]:
    """Code points that words of ``length`` or one more share at their beginning and end if edited at ``low`` to ``high`` - 1."""
    return low, max(length - high, 0)


def _near_in_groups(groups: pa.Table) -> pa.Table:
    """Near words counted, and the best of them, per word and group of one task."""
    words, counts = groups["word"].to_pylist(), groups["n"].to_pylist()
    spans = list(zip(*(groups[c].to_pylist() for c in ("m", "low", "high")), strict=True))
    members: dict[tuple, list[int]] = {}
    for i, (w, (m, low, high)) in enumerate(zip(words, spans, strict=True)):
        begin, end = _shared(m, low, high)
        members.setdefault((m, low, high, w[:begin], w[len(w) - end :]), []).append(i)
    machine = Acceptor()
    near, best = [0] * len(words), [-1] * len(words)

    def meet(i: int, j: int) -> None:
        near[i] += 1
        b = best[i]
        if b < 0 or counts[j] > counts[b] or counts[j] == counts[b] and words[j] < words[b]:
            best[i] = j

    for (m, low, high, _, _), rows in members.items():
        if len(rows) < 2 or not any(len(words[i]) == m for i in rows):
            continue
        begin, end = _shared(m, low, high)
        inner = {words[i][begin : len(words[i]) - end]: i for i in rows}
        length = m - begin - end
        for p, q in one_edit_pairs(machine, machine.add(sorted(inner)), high - low):
            if len(p) == length:  # two words of m + 1 meet in another group
                meet(inner[p], inner[q])
                meet(inner[q], inner[p])
    hit = [i for i, k in enumerate(near) if k]
    return pa.table(
        {
            "word": pa.array([words[i] for i in hit], pa.string()),
            "n_near": pa.array([near[i] for i in hit], pa.int64()),
            "best_n": pa.array([counts[best[i]] for i in hit], pa.int64()),
            "best": pa.array([words[best[i]] for i in hit], pa.string()),
        }
    )


def _ranges(*pairs: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(a.cast("int").alias("low"), b.cast("int").alias("high")) for a, b in pairs])


def _grouped(vocabulary: DataFrame, group: int) -> DataFrame:
    """Every word once per group: (word, n, m, low, high, group)."""
    m, half = F.col("m"), F.floor(F.col("m") / 2)
    lengths = F.array(F.length("word"), F.length("word") - 1)  # alone or as the longer of two
    words = vocabulary.select("word", "n", F.explode(lengths).alias("m"))
    open_ = words.select("word", "n", "m", F.inline(_ranges((F.lit(0), half), (half, m + 1)))).where("low < high")
    key = ["m", "low", "high", "group"]

    def named(df: DataFrame) -> DataFrame:
        begin, end = F.col("low"), F.greatest(F.col("m") - F.col("high"), F.lit(0))
        length = F.length("word")
        kept = F.concat(F.substring("word", F.lit(1), begin), F.lit("\n"), F.substring("word", length - end + 1, end))
        return df.withColumn("group", F.md5(kept))

    open_, done = named(open_), []
    while True:
        letters = open_.where("high - low > 1").groupBy(*key).agg(F.sum(F.length("word") + ROW).alias("letters"))
        large = stored(letters.where(F.col("letters") > group).select(*key))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, open_])
        done.append(open_.join(large, key, "left_anti"))
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        cut = open_.join(large, key, "left_semi").withColumn("range", F.explode(_ranges((F.col("low"), middle), (middle, F.col("high")))))
        open_ = named(cut.select("word", "n", "m", "range.*"))


def near_words(vocabulary: DataFrame, group: int = GROUP, task: int = TASK) -> DataFrame:
    """Per word with a near word: their number ``n_near`` and the one of largest n, ties to the smallest (``best``, ``best_n``)."""
    groups = _grouped(vocabulary, group)
    letters = vocabulary.agg(F.sum(4 * (F.length("word") + ROW))).first()[0] or 0
    tasks = max(1, -(-int(letters) // task))
    at = F.pmod(F.xxhash64("m", "low", "high", "group"), F.lit(tasks)).alias("task")
    found = groups.select("word", "n", "m", "low", "high", at).groupBy("task").applyInArrow(
        _near_in_groups, "word string, n_near long, best_n long, best string"
    )
    top = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", (-F.col("top.minus")).alias("best_n"), F.col("top.best").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """Follow ``form`` from word to word to the last one (``root``), by doubling the length of the jumps.

    ``forms`` has one row per word with a form and no circle: n at least doubles at every step.
    """
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if further.where("moved").isEmpty():
            return further.drop("moved")
        at = further.drop("moved")


def spelling_variants(vocabulary: DataFrame, times: int = 2, group: int = GROUP, task: int = TASK) -> DataFrame:
    """Every word with its number of near words, its form and its root.

    ``vocabulary`` has distinct, non-missing words in ``word`` and their counts in ``n``; other columns are left
    out. The form is the near word of largest n (ties: the smallest in code-point order), if it is at least
    ``times`` as frequent; else missing. The root is where the forms lead to, the word itself without one. An
    empty vocabulary gives an empty result. Words of any length are taken whole.
    """
    vocabulary = stored(vocabulary.select("word", F.col("n").cast("long").alias("n")))
    good = F.col("best_n") >= times * F.col("n")
    known = vocabulary.join(near_words(vocabulary, group, task), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"),
    )
    known = stored(known)
    ends = roots(known.where(F.col("form").isNotNull()))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
