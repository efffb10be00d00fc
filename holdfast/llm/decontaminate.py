"""Benchmark decontamination by templates: re-parameterised questions are found, not only copies.

Numbers, names and units become typed placeholders, so a question with other figures keeps its
template. Windows of template words are hashed; a document's windows meet the benchmark's in a hash
join. Windows of one pair of texts on one diagonal belong to one copy, whose slots are then compared:
each value of the item must stand for one value in the document throughout. Literal windows, numbers
as they are, find exact copies of items that are mostly numbers or too short for a template.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import chunks, joined, mixed, run_hashes

WINDOW = 10  # template words in a window
LEAST = 5  # items with fewer words are looked for literally only; at least half of a template window's words must be plain
HASHES_AT_ONCE = 1_000_000  # window hashes that go to the executors in one pass: 8 MB

#: Units of measure, money and time (fixed values).
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years "
    "cent cents dollar dollars euro euros pound pounds usd eur gbp percent degree degrees mph kmh w kw v hz"
).split()

PLAIN, NUMBER, NAME, UNIT = range(4)
_MARKS = mixed(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

_LETTER, _DIGIT, _CAPITAL, _STOP, _JOINT = (np.zeros(256, bool) for _ in range(5))
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT[48:58] = True
_CAPITAL[65:91] = True
_STOP[list(b".!?:\n")] = True
_JOINT[list(b".,:/")] = True


_LITERAL = np.uint64(0x5851F42D4C957F2D)


class Templates:
    """Words of a run of texts: hash of the word or its placeholder, kind, text it is in, and bytes it spans."""

    def __init__(self, run: Sequence[bytes]) -> None:
        raw = np.frombuffer(b" ".join(run), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1) - 1
        self.raw, empty = raw, np.empty(0, np.int64)
        self.word, self.kind, self.text, self.start, self.stop = empty.astype(np.uint64), empty.astype(np.int8), empty, empty, empty
        if not raw.size:
            return
        group = _LETTER[raw] + 2 * _DIGIT[raw].astype(np.int8)
        before = np.concatenate((np.zeros(1, np.int8), group[:-1]))
        start = np.flatnonzero((group > 0) & (group != before))
        if not start.size:
            return
        stop = np.flatnonzero((group > 0) & (group != np.concatenate((group[1:], np.zeros(1, np.int8))))) + 1
        digits = group[start] == 2
        text = np.searchsorted(ends, start, "right")
        # 3.14, 1,000 and 12:30 are one number: a number right behind a joint behind a number belongs to it.
        part = np.zeros(start.size, bool)
        part[1:] = digits[1:] & digits[:-1] & (start[1:] == stop[:-1] + 1) & _JOINT[raw[stop[:-1]]]
        if part.any():
            keep = ~part
            last = np.append(np.flatnonzero(keep)[1:] - 1, start.size - 1)
            start, stop, digits, text = start[keep], stop[last], digits[keep], text[keep]
        lower = raw.copy()
        capital = _CAPITAL[raw]
        lower[capital] += 32
        accent = np.zeros(raw.size, bool)  # the two-byte capitals of Latin-1
        accent[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        lower[accent] += 32
        self.lower = lower
        word = run_hashes(lower, start, stop)
        # A sentence begins with a text and behind a stop; a capital elsewhere is a name, unless all is in capitals.
        stops = np.concatenate(([0], np.cumsum(_STOP[raw])))
        first = np.ones(start.size, bool)
        first[1:] = (text[1:] != text[:-1]) | (stops[start[1:]] > stops[stop[:-1]])
        upper = capital[start] | (accent[np.minimum(start + 1, raw.size - 1)] & (raw[start] == 0xC3))
        loud = np.concatenate(([0], np.cumsum(capital)))
        shouted = (loud[stop] - loud[start] > 1) | (stop - start < 2)
        kind = np.where(digits, NUMBER, np.where(upper & ~first & ~shouted, NAME, PLAIN)).astype(np.int8)
        after = np.zeros(start.size, bool)
        after[1:] = digits[:-1] & (text[1:] == text[:-1])
        kind[after & (kind != NUMBER) & np.isin(word, _UNIT_HASHES)] = UNIT
        self.word, self.kind, self.text, self.start, self.stop = word, kind, text, start, stop

    def windows(self, width: int, names: bool) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every window inside one text of which at least half is plain.

        With ``names`` as placeholders, or as the words they are: a copy that begins in the middle of a
        sentence has a capital that the item has not. The second way gives only windows that hold a name.
        """
        n = self.word.size - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        kind = self.kind if names else np.where(self.kind == NAME, PLAIN, self.kind)
        mark = np.where(kind == PLAIN, self.word, _MARKS[kind])
        plain = np.concatenate(([0], np.cumsum(kind == PLAIN)))
        fit = (self.text[:n] == self.text[width - 1 :]) & (2 * (plain[width:] - plain[:n]) >= width)
        if not names:
            named = np.concatenate(([0], np.cumsum(self.kind == NAME)))
            fit &= named[width:] > named[:n]
        at = np.flatnonzero(fit)
        out = mark[at]
        for i in range(1, width):
            out = joined(out, mark[at + i])
        return at, joined(out, np.uint64(width))

    def literal(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash of the words as they are, numbers too) of every window inside one text."""
        n = self.word.size - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.text[:n] == self.text[width - 1 :])
        out = self.word[at]
        for i in range(1, width):
            out = joined(out, self.word[at + i])
        return at, joined(out, _LITERAL + np.uint64(width))

    def value(self, i: int) -> str:
        return self.lower[self.start[i] : self.stop[i]].tobytes().decode("utf-8", "replace")


def _hashes_of(words: Sequence[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    sizes = np.array([len(w) for w in words])
    start = np.cumsum(sizes + 1) - sizes - 1
    return run_hashes(raw, start, start + sizes)


_UNIT_HASHES = np.sort(_hashes_of(UNITS))


def template_windows(texts: DataFrame, keys: Sequence[str], widths: Sequence[int] | None = None, wanted: np.ndarray | None = None) -> DataFrame:
    """Windows of ``texts`` (keys and text): keys, words, place, width, hash, slots (typed values by place in the text), literal.

    ``widths``: every text's windows of these widths; without, of ``WINDOW`` words or, in a shorter
    text, of all its words; under ``LEAST`` words only literally. ``wanted``: only windows with these hashes.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*keys).schema.fields)
    schema += ", words int, place int, width int, hash bigint, slots array<struct<at:int,value:string>>, literal boolean"
    context = texts.sparkSession.sparkContext
    held = context.broadcast(np.sort(wanted.astype(np.uint64))) if wanted is not None else None  # at most HASHES_AT_ONCE

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value if held else None
        for batch in batches:
            for first, run in chunks(batch["text"]):
                t = Templates(run)
                counts = np.bincount(t.text, None, len(run))
                begin = np.cumsum(counts) - counts
                parts = []
                for width, names in product(widths or range(1, WINDOW + 1), (True, False, None)):  # None: literal
                    if names is not None and width < LEAST:
                        continue
                    at, h = t.literal(width) if names is None else t.windows(width, names)
                    if names is None and widths is None and width >= LEAST:  # only what has no template
                        bare = ~np.isin(at, t.windows(width, True)[0])
                        at, h = at[bare], h[bare]
                    if widths is None and width < WINDOW:
                        short = counts[t.text[at]] == width
                        at, h = at[short], h[short]
                    if known is not None and at.size:
                        near = np.minimum(np.searchsorted(known, h), known.size - 1)
                        hit = known[near] == h
                        at, h = at[hit], h[hit]
                    parts.append((at, h, np.full(at.size, width), np.full(at.size, names is True), np.full(at.size, names is None)))
                at, h, width, named, literal = (np.concatenate(x) for x in zip(*parts, strict=True))
                if at.size:
                    of = t.text[at]
                    out = batch.iloc[first + of][list(keys)].reset_index(drop=True)
                    slots = [
                        [{"at": int(k - begin[d]), "value": t.value(k)} for k in range(i, i + w) if t.kind[k] and (t.kind[k] == NUMBER or not as_is and (with_names or t.kind[k] != NAME))]
                        for i, w, d, with_names, as_is in zip(at.tolist(), width.tolist(), of.tolist(), named.tolist(), literal.tolist(), strict=True)
                    ]
                    yield out.assign(words=counts[of].astype(np.int32), place=(at - begin[of]).astype(np.int32), width=width.astype(np.int32), hash=h.view(np.int64), slots=slots, literal=literal)

    return texts.select(*keys, F.coalesce("text", F.lit("")).alias("text")).mapInPandas(found, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_cover: float = 0.5) -> DataFrame:
    """Documents that hold benchmark items: doc_id, digest (xxhash64 of the text), item_id, coverage, slots, changed_slots.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored. A pair is
    given if windows on diagonals with consistent slots cover at least ``min_cover`` of the item's
    words. Slots are consistent if the item's equal values (of a type) stand for equal values in the
    document; ``changed_slots`` counts those with another value. An item's copies under other ids are
    given too. Items with fewer than ``LEAST`` words are found where these words stand as they are; items
    without words are not looked for, and a missing text of a document holds nothing. Rows equal in doc_id and text give one answer. Empty
    tables give an empty result.

    Documents are read once per ``HASHES_AT_ONCE`` distinct hashes of the benchmark and not shuffled;
    only windows with one of these hashes leave the scan.
    """
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    # Items with the same text are looked for once, under the least id.
    named = items.groupBy("text").agg(F.min("item_id").alias("item"), F.collect_set("item_id").alias("ids"))
    named = stored(named.where("item is not null"))
    grams = stored(template_windows(named, ["item"]))
    hashes = grams.select("hash", "width").distinct()
    passes = max(1, -(-hashes.count() // HASHES_AT_ONCE))
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    hits = None
    for k in range(passes):
        block = hashes.where(F.pmod("hash", F.lit(passes)) == k).toPandas()
        if block.empty:
            continue
        widths = sorted(int(w) for w in block["width"].unique())
        part = template_windows(texts, ["doc_id", "digest"], widths, block["hash"].to_numpy(np.int64).view(np.uint64))
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = template_windows(texts.limit(0), ["doc_id", "digest"])
    theirs = grams.select("hash", "literal", "item", F.col("words").alias("item_words"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    met = hits.drop("words").join(theirs, ["hash", "literal"]).withColumn("diagonal", F.col("place") - F.col("item_place"))
    pairs = F.zip_with("item_slots", "slots", lambda i, d: F.struct(i["at"].alias("at"), i["value"].alias("item"), d["value"].alias("doc")))
    covers = F.sequence("item_place", F.col("item_place") + F.col("width") - 1)
    copies = met.groupBy("doc_id", "digest", "item", "item_words", "diagonal", "literal").agg(
        F.array_distinct(F.flatten(F.collect_set(covers))).alias("covered"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    meanings = F.array_distinct(F.transform("pairs", lambda p: F.struct(p["item"], p["doc"])))
    values = F.array_distinct(F.transform("pairs", lambda p: p["item"]))
    copies = copies.where(F.size(meanings) == F.size(values))
    whole = copies.groupBy("doc_id", "digest", "item", "item_words").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("covered")))) / F.col("item_words")).alias("coverage"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
    )
    whole = whole.where(F.col("coverage") >= min_cover)
    slots = F.size(F.array_distinct(F.transform("pairs", lambda p: p["at"])))
    changed = F.size(F.array_distinct(F.transform(F.filter("pairs", lambda p: p["item"] != p["doc"]), lambda p: p["at"])))
    return whole.join(named.select("item", F.explode("ids").alias("item_id")), "item").select(
        "doc_id", "digest", "item_id", "coverage", slots.alias("slots"), changed.alias("changed_slots")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_cover: float = 0.5) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item (see ``contaminated``)."""
    bad = stored(contaminated(docs, benchmark, min_cover).select(F.col("doc_id").alias("_bad_id"), "digest").distinct())
    rows = docs.withColumn("_digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["_bad_id"]) & (rows["_digest"] == bad["digest"]), "left_anti").drop("_digest")
