"""Bootstrap of ranking metrics with Poisson weights, all replicates of a row at once.

A row's weights are a vector with one Poisson(1) count per replicate, computed from its hash and the
replicate's number wherever the row is, so they are never shuffled. Rows are cut into cells by the order of
their score; a cell meets a chunk of replicates, adds its weights up per distinct score, one replicate after
the other, so that what is worked on stays in the processor's cache, and returns one row per replicate. A cohort above the size of a cell is read twice: the cells' totals first, then
the metrics with the totals of the cells below. What is shuffled are the rows, once per chunk of replicates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import BUCKET, balanced_buckets

PRIME = 2**31 - 1
CELL_ROWS = 20_000  # rows of a cell
CHUNK = 250  # replicates of a chunk


def poisson_steps(terms: int = 12) -> list[float]:
    """Cumulated probabilities of Poisson(1) counts from 0."""
    out, total, term = [], 0.0, math.exp(-1)
    for k in range(terms):
        total += term
        out.append(total)
        term /= k + 1
    return out


def coefficients(seed: int, replicate: int) -> list[int]:
    """Five random numbers of a replicate below PRIME."""
    return [int(hashlib.md5(f"{seed}:{replicate}:{k}".encode()).hexdigest()[:8], 16) % PRIME for k in range(5)]


def _least_draw(step: float) -> int:
    """Least y with y / PRIME >= step, as doubles are divided."""
    y = math.ceil(step * PRIME) - 2
    while y / PRIME < step:
        y += 1
    return y


DRAW_STEPS = [y for y in map(_least_draw, poisson_steps()) if y < PRIME]


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same remainder: PRIME is 2^31 - 1, so that no division is needed."""
    return (x & PRIME) + (x >> 31)


def replicate_weights(first: np.ndarray, second: np.ndarray, seed: int, replicate: int) -> np.ndarray:
    """Weights of rows (by two hashes below PRIME) in a replicate: a random cubic of the first hash, shifted by the second.

    For any four rows with different hashes these are independent draws.
    """
    c = coefficients(seed, replicate)
    y = _folded(_folded(c[3] * first + c[2]))
    y = _folded(_folded(y * first + c[1]))
    y = _folded(_folded(y * first + c[0]))
    y = _folded(_folded(y + _folded(c[4] * second)))
    y = np.where(y == PRIME, 0, y).astype(np.int32)
    out = (y >= DRAW_STEPS[0]).astype(np.int8)
    for step in DRAW_STEPS[1:]:
        out += y >= step
    return out.astype(np.int64)


def poisson_weights(first: np.ndarray, second: np.ndarray, seed: int, replicates: Sequence[int]) -> np.ndarray:
    """The same in several replicates, one column each."""
    return np.stack([replicate_weights(first, second, seed, b) for b in replicates], axis=1)


def _with_hashes(df: DataFrame, row_key: str, seed: int) -> DataFrame:
    """Two hashes of the row's key below PRIME."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_key).cast("string")))
    part = lambda at: F.conv(F.substring(key, at, 8), 16, 10).cast("bigint") % PRIME
    return df.withColumns({"hash_a": part(1), "hash_b": part(9)})


def _weights_by_score(cell: pa.Table, seed: int, replicates: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Weights of positives and of all rows per distinct score (ascending), for each replicate."""
    score = cell["score"].to_numpy()
    order = np.argsort(score, kind="stable")
    _, starts = np.unique(score[order], return_index=True)
    first, second, label = (cell[c].to_numpy()[order] for c in ("hash_a", "hash_b", "label"))
    for replicate in replicates:
        weights = replicate_weights(first, second, seed, replicate)
        pos = weights * label
        yield (pos, weights) if len(starts) == len(order) else (np.add.reduceat(pos, starts), np.add.reduceat(weights, starts))


def poisson_metrics(df: DataFrame, keys: Sequence[str], row_key: str, label: str, scores: Mapping[str, str], replicates: int, seed: int, first: int = 0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """AUROC and average precision per key, model and replicate (from ``first``); missing where a replicate has one class.

    A missing score counts as the least one, a missing label as 0. The result is written: summaries read it more than once.
    """
    keys = list(keys)
    group = [*keys, "model"]
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias("score")) for m, c in scores.items()])
    zero_one = F.coalesce(F.col(label).cast("bigint"), F.lit(0)).alias("label")
    rows = _with_hashes(df, row_key, seed).select(*keys, "hash_a", "hash_b", zero_one, F.inline(cells))
    most = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // cell_rows))
    cut = rows.withColumn(BUCKET, F.lit(0)) if parts == 1 else balanced_buckets(rows, group, "score", parts)
    chunks = max(1, -(-replicates // CHUNK))
    cut = cut.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    of_key = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    shown = ", ".join([*of_key, "model string", f"{BUCKET} int", "replicate int"])

    def part_of(chunk: int) -> range:
        return range(first + chunk * CHUNK, first + min(replicates, (chunk + 1) * CHUNK))

    def labelled(cell: pa.Table, over: range, columns: dict[str, np.ndarray]) -> pa.Table:
        zeros = pa.array(np.zeros(len(over), np.int64))
        fixed = {k: cell[k].combine_chunks().take(zeros) for k in (*group, BUCKET)}
        return pa.table(fixed | {"replicate": pa.array(np.array(over, np.int32))} | {n: pa.array(v) for n, v in columns.items()})

    def totals(cell: pa.Table) -> pa.Table:
        over = part_of(cell["chunk"][0].as_py())
        first, second, label = (cell[c].to_numpy() for c in ("hash_a", "hash_b", "label"))
        weights = (replicate_weights(first, second, seed, replicate) for replicate in over)
        pos, every = np.array([(int(w @ label), int(w.sum())) for w in weights], np.int64).T
        return labelled(cell, over, {"pos": pos, "n": every})

    def sums(cell: pa.Table, around: pa.Table | None = None) -> pa.Table:
        over = part_of(cell["chunk"][0].as_py())
        if around is not None:
            around = around.sort_by("replicate")
            known = np.stack([around[c].to_numpy() for c in ("pos_before", "n_before", "pos_total", "n_total")], axis=1)
        found = []
        for i, (pos, every) in enumerate(_weights_by_score(cell, seed, over)):
            pos_sum, n_sum = pos.sum(), every.sum()
            pos_before, before, pos_total, total = (0, 0, pos_sum, n_sum) if around is None else known[i]
            pos_below, below = pos_before + pos.cumsum() - pos, before + every.cumsum() - every
            drawn = np.flatnonzero(pos)  # only scores with positives add anything
            p, pos_below, below, negative = pos[drawn], pos_below[drawn], below[drawn], (every - pos)[drawn]
            seen = np.maximum(total - below, 1)
            found.append((pos_sum, n_sum, (p * (below - pos_below + negative / 2)).sum(), (p * (pos_total - pos_below) / seen).sum()))
        pos, n, wins, precision_sum = (np.array(v) for v in zip(*found))
        return labelled(cell, over, {"pos": pos, "n": n, "wins": wins, "precision_sum": precision_sum})

    summed = f"{shown}, pos bigint, n bigint, wins double, precision_sum double"
    by_cell = cut.groupBy(*group, BUCKET, "chunk")
    if parts == 1:
        found = by_cell.applyInArrow(lambda cell: sums(cell), summed)
    else:
        cut = materialize(cut)
        at = W.partitionBy(*group, "replicate")
        before = at.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
        around = cut.groupBy(*group, BUCKET, "chunk").applyInArrow(totals, f"{shown}, pos bigint, n bigint").select(
            *group, BUCKET, "replicate", F.floor((F.col("replicate") - first) / CHUNK).cast("int").alias("chunk"),
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("pos", "n")],
            *[F.sum(c).over(at).alias(f"{c}_total") for c in ("pos", "n")],
        )
        around = materialize(around)
        cell = [*group, BUCKET, "chunk"]
        found = cut.groupBy(*cell).cogroup(around.groupBy(*cell)).applyInArrow(sums, summed)
    whole = found.groupBy(*group, "replicate").agg(*[F.sum(c).alias(c) for c in ("pos", "n", "wins", "precision_sum")])
    p, n = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    both = (p > 0) & (n > 0)
    return materialize(
        whole.select(*group, "replicate", F.when(both, F.col("wins") / (p * n)).alias("auroc"), F.when(both, F.col("precision_sum") / p).alias("average_precision"))
    )
