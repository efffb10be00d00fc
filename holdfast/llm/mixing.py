"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

PER_BLOCK = 4_000  # documents that one task rounds in one go
FAN_IN = 1_000  # block remainders that one task joins


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets per source: source, source_size, docs, target. ``sizes`` has source and size.

    Sources by code point, missing last, take ``weights`` in turn and share ``total`` times all sizes
    by weight. A target stops at ``most`` times its source's size; what it leaves is shared again by
    weight among the others until none is above. That end is a water level: every target is the lesser
    of its limit and level times weight. It is found by ordering the sources by limit over weight.
    One row per source is ordered in one task, so the number of sources must be moderate.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("full", most * F.col("source_size")).withColumn("ratio", F.col("full") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / rest
    per = per.withColumn("level", level)
    # The first source in this order that its level does not fill sets the level of all after it.
    final = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("final", F.coalesce(final, F.lit(float("inf")))).select(
        "source", "source_size", "docs", F.least(F.col("full"), F.col("final") * F.col("weight")).alias("target")
    )


def pivoted(sizes: np.ndarray, share: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of one block in the given order: (shares, of which all but one are 0 or 1; index of that one or -1).

    Two fractional shares meet; mass moves from one to the other, in words, until one of them is 0 or
    1. Which way it moves is drawn so that every share keeps its expectation. The words the block takes
    are the same before and after every step.
    """
    p = share.astype(np.float64).tolist()
    z = np.maximum(sizes, 1).astype(np.float64).tolist()
    u = draws.tolist()
    held = -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1.0 - p[a]) * z[a], p[b] * z[b])  # words that can go from b to a
        down = min(p[a] * z[a], (1.0 - p[b]) * z[b])
        if u[i] * (up + down) < down:
            p[a], p[b] = p[a] + up / z[a], p[b] - up / z[b]
        else:
            p[a], p[b] = p[a] - down / z[a], p[b] + down / z[b]
        for k in (a, b):
            if p[k] < 1e-12:
                p[k] = 0.0
            elif p[k] > 1.0 - 1e-12:
                p[k] = 1.0
        open_ = [k for k in (a, b) if 0.0 < p[k] < 1.0]
        held = open_[0] if open_ else -1
    return np.array(p), held


def pooled(sizes: np.ndarray, share: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Shares after the largest documents, which come first, were settled against the pool of all smaller ones.

    A fractional share becomes 1 with a chance of that share, else 0, and the fractional shares after
    it give or take the words in proportion to what they hold or have room for. Pairing it with one
    small document at a time would fill up the small ones and leave the large one open. If the pool
    can make up for one end only, it goes there; if for neither, it stays open. The words of all are
    the same before and after.
    """
    p, z = share.astype(np.float64).copy(), np.maximum(sizes, 1).astype(np.float64)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    p, z, u, out = p[open_], z[open_], draws[open_], p
    for i in range(p.size - 1):
        rest, words = p[i + 1 :], z[i + 1 :]
        held = float(rest @ words)
        room = float(words.sum()) - held
        up, down = (1.0 - p[i]) * z[i], p[i] * z[i]
        one, none = up < held, down < room
        if not (one or none):
            continue
        if one and (not none or u[i] < p[i]):
            rest *= 1.0 - up / held
            p[i] = 1.0
        else:
            rest += (1.0 - rest) * (down / room)
            p[i] = 0.0
    out[open_] = p
    return out


def _round_block(pdf: pd.DataFrame) -> pd.DataFrame:
    # Large documents first: the one left over at the end is small, and so is its rounding error.
    pdf = pdf.sort_values(["size", "draw", "row"], ascending=[False, True, True], kind="stable")
    sizes, draws = pdf["size"].to_numpy(), pdf["draw"].to_numpy()
    p, held = pivoted(sizes, pooled(sizes, pdf["share"].to_numpy(), draws), draws)
    out = pdf.assign(share=p, open=False)
    if held >= 0:
        out.iloc[held, out.columns.get_loc("open")] = True
    return out


def mixed_copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """How often the mix takes each document: doc_id, source, row, size, source_size, target, copies, taken (= size x copies).

    ``docs`` has doc_id, text and source; other columns are ignored. The size is the text's words
    (missing: none). A document is wanted target / source size times. Its whole part is taken as it
    is. The fractions of a source are rounded to 0 or 1 in blocks of about ``PER_BLOCK`` documents:
    from the largest on, each against the pool of the smaller ones (``pooled``), what is left by
    pairing (``pivoted``). The one remaining fraction of each block goes up a tree with ``FAN_IN``
    branches until a source has one left, which goes to the nearer end. A source's words thus differ
    from its target by at most half of that last document, one of the smallest, unless one document
    outweighs all others.

    Draws are hashes of the seed and the row, so reruns agree. Rows equal in doc_id, source and text
    are interchangeable and may get different copies. Documents without words are taken 0 times. A
    missing source is a source of its own. An empty table gives an empty result.
    """
    base = docs.select(
        "doc_id", "source", word_count().alias("size"), F.xxhash64("doc_id", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).alias("row")
    )
    base = stored(base)
    targets = stored(source_targets(base, weights, total, most))
    per = targets.withColumn("blocks", F.ceil(F.col("docs") / PER_BLOCK)).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    most_blocks = per.agg(F.max("blocks")).first()[0] or 1
    rows = base.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).join(per.drop("source"), "key")
    wanted = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    # A draw per row; equal rows have one draw and are told apart by their places, which are interchangeable.
    draw = F.pmod(F.xxhash64(F.lit(seed), "row", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("wanted", F.when(F.col("size") > 0, wanted).otherwise(0.0)).select(
        "doc_id", "source", "key", "row", "size", "source_size", "target",
        F.floor("wanted").alias("whole"),
        (F.col("wanted") - F.floor("wanted")).alias("share"),
        draw.alias("draw"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "row", "doc_id"), F.col("blocks")).alias("block"),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", open boolean"
    parts = []
    left = rows
    while True:
        level = stored(left.groupBy("key", "block").applyInPandas(_round_block, schema))
        parts.append(level.where(~F.col("open")))
        left = level.where("open").drop("open").withColumn("block", F.floor(F.col("block") / FAN_IN))
        if most_blocks <= 1:
            break
        most_blocks = -(-most_blocks // FAN_IN)
    parts.append(left.withColumn("share", F.when(F.col("share") >= 0.5, 1.0).otherwise(0.0)).withColumn("open", F.lit(True)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    copies = (F.col("whole") + F.round("share")).cast("long")
    return out.select("doc_id", "source", "row", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, each once with ``size``, ``source_size``, ``target`` and ``copies`` (1 or 2).

    Columns of these names are replaced. Rows equal in doc_id, source and text share their copies by rank.
    """
    key = F.xxhash64("doc_id", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    equal = Window.partitionBy("_row").orderBy(F.lit(1))
    chosen = mixed_copies(docs, **how).where("copies > 0")
    chosen = chosen.select(F.col("row").alias("_row"), "size", "source_size", "target", "copies")
    chosen = chosen.withColumn("_place", F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("copies"))))
    kept = docs.drop("size", "source_size", "target", "copies").withColumn("_row", key)
    return kept.withColumn("_place", F.row_number().over(equal)).join(chosen, ["_row", "_place"]).drop("_row", "_place")
