"""Near-duplicate classes by order MinHash and banded alignment.

Order MinHash: of a text's occurrence-labelled five-word shingles, the ``PICKED`` least under a hash
function are taken and put back into text order; the hash of that short sequence is one sketch.
Texts whose shingles are alike and stand in the same order share sketches. Texts that share sketches
with a common centre are aligned word by word: words that match within a band of diagonals are
chained in order, and similarity is chained / (all words of both - chained). Two texts of the same
length reach 0.8 with up to a ninth of their words replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .words import chunks, joined, mixed, split

SHINGLE = 5
SIMILAR = 0.8
SKETCHES = 32
PICKED = 2  # a pair of similarity 0.8 has about 0.4 of its shingles in common, and a sketch with a chance of about 0.15
TOGETHER = 2  # sketches that a text shares with a centre to meet the centre's other texts
BLOCK = 512  # texts that one task holds at once
WORDS = 2_000_000  # words that one task holds at once, as far as single texts are shorter
SHORT = 4  # texts with fewer shingles are alike only if they are equal

_SEEDS = np.random.default_rng(811).integers(1, 2**63, (SKETCHES, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = np.uint64(0x9E3779B97F4A7C15)
_FULL = np.uint64(2**64 - 1)


def shingles(words: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labelled shingles of all texts one after the other, shingles per text). A text of 1 to 4 words is one shingle."""
    counts = np.where(per_text >= SHINGLE, per_text - SHINGLE + 1, (per_text > 0).astype(np.int64))
    first = np.cumsum(per_text) - per_text
    begin = np.cumsum(counts) - counts
    total = int(counts.sum())
    text = np.repeat(np.arange(per_text.size), counts)
    at = first[text] + np.arange(total) - begin[text]
    padded = np.concatenate((words, np.zeros(SHINGLE, np.uint64)))
    out = padded[at]
    end = (first + per_text)[text]
    for i in range(1, SHINGLE):
        out = np.where(at + i < end, joined(out, padded[at + i]), out)
    return labelled(out, text), counts


def labelled(found: np.ndarray, text: np.ndarray) -> np.ndarray:
    """``found`` with repeats within a text told apart: the n-th occurrence is one of its own. ``text`` is the text of each."""
    total = found.size
    order = np.lexsort((np.arange(total), found, text))
    same = np.zeros(total, bool)
    same[1:] = (found[order][1:] == found[order][:-1]) & (text[order][1:] == text[order][:-1])
    if not same.any():
        return found
    run = np.arange(total)
    start = np.maximum.accumulate(np.where(same, 0, run))
    label = np.empty(total, np.uint64)
    label[order] = (run - start).astype(np.uint64)
    return np.where(label > 0, mixed(found + label * _ORDER), found)


def sketches(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sketches (texts x ``SKETCHES``) of texts that all have at least ``SHORT`` shingles."""
    begin = np.cumsum(counts) - counts
    out = np.empty((counts.size, SKETCHES), np.uint64)
    for b, (flip, factor) in enumerate(_SEEDS):
        keys = (found ^ flip) * factor  # a bijection: least keys are unique within a text
        picks = []
        for _ in range(PICKED):
            least = np.minimum.reduceat(keys, begin)
            at = np.flatnonzero(keys == np.repeat(least, counts))
            picks.append(at)
            keys[at] = _FULL
        sequence = found[np.sort(np.stack(picks), axis=0)]
        h = sequence[0] ^ factor
        for row in sequence[1:]:
            h = joined(h, row)
        out[:, b] = h
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Similarity of two sequences of words; exact where it is at least ``least``, else that figure or a lower one.

    A pair of that similarity has at most ``band`` words outside the chain, so matches further off the
    diagonal cannot be chained. The longest chain is found a row at a time: bit i of ``flat`` is 0
    where the chain of the row grows at column i (bit-parallel longest common subsequence). Only the
    columns that a stretch of rows reaches within the band are held; what leaves is counted.
    """
    if not a.size or not b.size:
        return float(a.size == b.size)
    both = a.size + b.size
    band = int(both * (1 - least) / (1 + least) + 1e-9)
    if abs(a.size - b.size) > band:
        return 0.0
    stretch = max(band, 1_024)
    columns, flat, low, high, n = a.tolist(), 0, 0, 0, 0
    for first in range(0, b.size, stretch):
        start, end = max(0, first - band), min(a.size, first + stretch + band)
        if start > low:  # columns that the band has passed
            gone = start - low
            n += gone - (flat & ((1 << gone) - 1)).bit_count()
            flat, low = flat >> gone, start
        flat |= ((1 << (end - high)) - 1) << (high - low)
        high = end
        where: dict[int, int] = {}
        for i, word in enumerate(columns[low:high]):
            where[word] = where.get(word, 0) | 1 << i
        held = (1 << (high - low)) - 1
        for word in b[first : first + stretch].tolist():
            match = flat & where.get(word, 0)
            if match:
                flat = ((flat + match) | (flat - match)) & held
    n += (high - low) - flat.bit_count()
    return n / (both - n)


def sketched(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest (of the text), node (16 bytes, the word sequence), words, sketches (none in short texts)."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest bigint, node binary, words int, sketches array<bigint>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, texts in chunks(batch["text"]):
                words, per_text = split(texts)
                begin = np.cumsum(per_text) - per_text
                place = (np.arange(words.size) - np.repeat(begin, per_text)).astype(np.uint64)
                whole = np.zeros((len(texts), 2), np.uint64)
                some = per_text > 0
                for k in (0, 1):
                    if words.size:
                        whole[some, k] = np.add.reduceat(mixed(words + (place * np.uint64(2) + np.uint64(k + 1)) * _ORDER), begin[some])
                whole = mixed(whole + per_text.astype(np.uint64)[:, None])
                found, counts = shingles(words, per_text)
                long_ = counts >= SHORT
                made = sketches(found[np.repeat(long_, counts)], counts[long_]).view(np.int64) if long_.any() else np.empty((0, SKETCHES), np.int64)
                held: list = [None] * len(texts)
                for row, i in enumerate(np.flatnonzero(long_)):
                    held[i] = made[row]
                part = batch.iloc[first : first + len(texts)]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "digest": part["digest"].to_numpy(),
                        "node": [x.tobytes() for x in whole],
                        "words": per_text.astype(np.int32),
                        "sketches": held,
                    }
                )

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("digest"), text.alias("text")).mapInPandas(run, schema)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, component (its least node). Labels spread along links and are shortened by jumping."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "near").alias("new"))
        target = labels.select(F.col("node").alias("new"), F.col("component").alias("jump"))
        after = stored(spread.join(target, "new").select("node", F.least("new", "jump").alias("component"), (F.least("new", "jump") != F.col("component")).alias("moved")))
        labels = after.select("node", "component")
        if after.where("moved").isEmpty():
            return labels


def _texts(batch: pd.DataFrame) -> list[np.ndarray]:
    out = []
    for _, run in chunks(batch["text"]):
        words, per_text = split(run)
        out += np.split(words, np.cumsum(per_text)[:-1])
    return out


def _star(batch: pd.DataFrame) -> pd.DataFrame:
    """Align every text of a block with the centre. Blocks after the first link to a stand-in of the centre, so that no node has more links than a block has texts."""
    found = _texts(batch)
    nodes, centre, block = batch["node"].tolist(), batch["centre"].iloc[0], int(batch["block"].iloc[0])
    at = nodes.index(centre)
    hub = centre + block.to_bytes(4, "big") if block else centre
    near = [n for n, s in zip(nodes, found, strict=True) if n != centre and aligned(found[at], s) >= SIMILAR]
    links = [(hub, n) for n in near] + ([(hub, centre)] if block and near else [])
    return pd.DataFrame(links, columns=["a", "b"])


def _meet(batch: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of one or two blocks: as many as join what belongs together, no pair within a component."""
    batch = batch.drop_duplicates("node")
    found, nodes = _texts(batch), batch["node"].tolist()
    side, parts = batch["side"].to_numpy(), batch["component"].tolist()
    sizes = np.array([s.size for s in found])
    text = np.repeat(np.arange(len(found)), sizes)
    value = labelled(np.concatenate(found), text)
    order = np.argsort(value, kind="stable")
    _, column, uses = np.unique(value[order], return_inverse=True, return_counts=True)
    text, common = text[order], uses[column] > 1
    text, column = text[common], np.unique(column[common], return_inverse=True)[1]
    shared = np.zeros((len(found), len(found)), np.float32)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] if column.size else -1) + 1 + width, width))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        used = np.zeros((len(found), width), np.float32)
        used[text[lo:hi], column[lo:hi] - k * width] = 1
        shared += used @ used.T
    bound = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1)  # alignment cannot give more
    one, other = np.nonzero(np.triu(bound >= SIMILAR - 1e-6, 1))
    root = {p: p for p in parts}

    def top(p: bytes) -> bytes:
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    two = len(set(side)) > 1
    links = []
    for i, j in zip(one.tolist(), other.tolist(), strict=True):
        if two and side[i] == side[j]:
            continue
        p, q = top(parts[i]), top(parts[j])
        if p != q and aligned(found[i], found[j]) >= SIMILAR:
            root[p] = q
            links.append((nodes[i], nodes[j]))
    return pd.DataFrame(links, columns=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, digest, class_id (least doc_id of the class), class_size (rows), component (of the class, unlike a class_id, alone).

    A class is a connected component of the texts with a similarity of at least ``SIMILAR``, word by word. Texts with
    the same words are one node from the start, however many copies there are. Texts with fewer than
    ``SHORT`` shingles are alike only if their words are the same; missing, empty and blank texts are
    one class. A class of rows without doc_id has no class_id. An empty table gives an empty result.

    No text is compared with all of a group: each meets the centre of its bucket first. Only groups that
    are then still of several components are compared further, in blocks, and only across components.
    """
    rows = stored(sketched(docs))
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("words").alias("words"), F.first("sketches").alias("sketches"), F.min(F.struct("doc_id", "digest")).alias("row")))
    # Buckets: the text with the least hash is the centre; it is the same in most buckets of a group.
    buckets = nodes.where("sketches is not null").select(F.explode("sketches").alias("bucket"), F.struct(F.xxhash64("node").alias("rank"), "node", "words").alias("text"))
    buckets = stored(buckets)
    centres = buckets.groupBy("bucket").agg(F.min("text").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = buckets.join(centres, "bucket").groupBy(F.col("text.node").alias("node"), F.col("centre.node").alias("centre"), F.col("text.words").alias("words"), F.col("centre.words").alias("centre_words")).agg(F.count("*").alias("sketches"))
    shared = stored(shared)
    key = F.xxhash64("node")
    fits = F.least("words", "centre_words") >= SIMILAR * F.greatest("words", "centre_words")
    best = shared.where((F.col("node") != F.col("centre")) & fits).groupBy("node").agg(F.max(F.struct("sketches", "centre", "words")).alias("best")).select("node", "best.centre", "best.words")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("words") / WORDS))
    sized = best.groupBy("centre").agg(blocks.alias("blocks"))
    members = best.join(sized, "centre").select("node", "centre", F.pmod(key, F.col("blocks")).alias("block"))
    hosts = sized.select(F.col("centre").alias("node"), "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    wanted = stored(members.unionByName(hosts))
    texts = nodes.select("node", "row").join(shared.select("node").distinct(), "node")
    given = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("node", F.col("row.doc_id").alias("_id"), F.col("row.digest").alias("_digest"))
    texts = given.join(texts, given["doc_id"].eqNullSafe(texts["_id"]) & (given["digest"] == texts["_digest"])).select("node", "text")
    texts = stored(texts.groupBy("node").agg(F.first("text").alias("text")))
    links = "a binary, b binary"
    first = stored(wanted.join(texts, "node").groupBy("centre", "block").applyInPandas(_star, links))
    parts = components(first)
    # Groups around a centre that the first links left in several components.
    group = shared.where((F.col("sketches") >= TOGETHER) | (F.col("node") == F.col("centre"))).select("node", "centre", "words")
    group = group.join(parts, "node", "left").select("node", "centre", "words", F.coalesce("component", "node").alias("component"))
    open_ = group.groupBy("centre").agg(blocks.alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    open_ = stored(group.join(open_.select("centre", "blocks"), "centre"))
    own = F.pmod(key, F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("low"), F.greatest(own, k).alias("high")))
    open_ = open_.select("node", "centre", "component", own.alias("side"), F.explode(pairs).alias("pair"))
    second = stored(open_.join(texts, "node").groupBy("centre", "pair").applyInPandas(_meet, links))
    parts = components(first.unionByName(second))
    named = nodes.join(parts, "node", "left").select("node", "least", "copies", F.coalesce("component", "node").alias("component"))
    named = stored(named)
    classes = named.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    of = stored(named.join(classes, "component").select("node", "component", "class_id", "class_size"))
    return rows.join(of, "node").select("doc_id", "digest", "class_id", "class_size", "component")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the least doc_id's; of rows without any doc_id in the class, or with the same, one. Classes that share a doc_id stay apart."""
    found = near_duplicates(docs)
    kept = stored(found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("row")).select(F.col("row.doc_id").alias("_id"), F.col("row.digest").alias("_digest")))
    rows = docs.withColumn("_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["_text"] == kept["_digest"]))
    place = F.row_number().over(Window.partitionBy("_id", "_digest").orderBy(F.lit(1)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_id", "_digest", "_text", "_place")
