"""Exact top-k inner products by ball-tree branch and bound.

Candidates are dealt into shards; each shard is one ball tree. Queries come in blocks. A node with
centre c and radius r cannot hold an inner product with q above q.c + |q| r, so nodes are opened in
the order of that bound, and only for the queries whose kth score so far it can still reach. The kth
scores are shared: every block searches one shard first, and all
other shards start from the kth scores found there.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD = 4_096  # distinct vectors in a tree
LEAF = 64
QUERIES = 1_024  # distinct query vectors in a block
EXACT = 2**53


def quantised(vector: str | Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component as whole numbers; missing if the vector or a component is missing or not finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(v.isNotNull() & fine, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(vectors: list) -> np.ndarray:
    """Rows padded with zeros to one width."""
    width = max([1, *map(len, vectors)])
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


class BallTree:
    """Median splits along the component of largest spread; nodes in an array, the root first."""

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # begin, end, left child, right child (0: leaf)
        centres, radii = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            own = points[self.order[lo:hi]].astype(np.float64)
            centre = own.mean(0)
            centres.append(centre)
            radii.append(np.sqrt(((own - centre) ** 2).sum(1).max()))
            at = len(self.nodes)
            self.nodes.append((lo, hi, 0, 0))
            if parent >= 0:
                b, e, left, right = self.nodes[parent]
                self.nodes[parent] = (b, e, at if side == 0 else left, at if side == 1 else right)
            spread = own.max(0) - own.min(0)
            if hi - lo > LEAF and spread.max() > 0:
                axis = int(spread.argmax())
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, axis], mid)]
                todo += [(lo, lo + mid, at, 0), (lo + mid, hi, at, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)


def search(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, copies: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> list[list[tuple[int, int]]]:
    """Best k (score, id) of each query; ``floor``: scores below it are of no use. ``own``: id that counts once less (the query's row)."""
    width = max(queries.shape[1], points.shape[1])
    q = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    x = np.pad(points, ((0, 0), (0, width - points.shape[1])))
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width
    if largest >= 2**63:
        raise ValueError("inner products beyond 64 bits: scale the vectors down")
    kind = np.float64 if largest < EXACT else np.int64
    qs, xs = q.astype(kind), x.astype(kind)
    tree = BallTree(x)
    length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    bound = q.astype(np.float64) @ tree.centres.T + length[:, None] * tree.radii[None, :]
    bound += 1e-9 * np.abs(bound) + 1e-6 + (0 if kind is np.float64 else 1e-12 * largest)
    best: list[list[tuple[int, int]]] = [[] for _ in q]
    kth = floor.astype(np.float64).copy()
    heap = [(-float(bound[:, 0].max()), 0, np.arange(len(q)))]
    while heap:
        _, node, active = heapq.heappop(heap)
        active = active[bound[active, node] >= kth[active]]  # equal scores count: a smaller id may come
        if not active.size:
            continue
        lo, hi, left, right = tree.nodes[node]
        if left:
            for child in (left, right):
                heapq.heappush(heap, (-float(bound[active, child].max()), child, active))
            continue
        rows = tree.order[lo:hi]
        scores = qs[active] @ xs[rows].T
        for i, line in zip(active.tolist(), scores, strict=True):
            for c in np.flatnonzero(line >= kth[i]).tolist():
                r = rows[c]
                n = int(copies[r]) - int(ids[r] == own[i] and np.array_equal(x[r], q[i]))
                best[i] += [(-int(line[c]), int(ids[r]))] * min(n, k)
            if len(best[i]) >= k:
                best[i] = sorted(best[i])[:k]
                kth[i] = max(kth[i], -best[i][-1][0])
    return [[(-s, j) for s, j in sorted(b)[:k]] for b in best]


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """The ``k`` largest inner products of every query row with all other rows: query_id, rank (from 1), vec_id, score.

    ``vectors`` has ids and vectors of whole numbers (see ``quantised``); ``queries`` is a condition on
    its rows. Candidates are all rows but the query's own. Equal scores go to the smaller id. A query
    with fewer than k candidates gets all of them. Rows without id or vector take no part; missing
    components at the end of a shorter vector count as 0. Rows equal in id and vector are candidates of
    each other; as queries they give equal results. An empty table gives an empty result.

    The work is queries times candidates in the worst case, in tasks of one block of queries and one
    shard; both are bounded, and nothing is collected. Every row is a query of at most one block.
    """
    base = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull())
    distinct = base.groupBy(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).agg(F.count("*").alias("copies"), F.max(F.coalesce(queries, F.lit(False))).alias("asks"))
    distinct = stored(distinct.withColumn("spot", F.xxhash64("id", "vector")))
    counts = distinct.agg(F.count("*"), F.sum(F.col("asks").cast("long"))).first()
    shards = max(1, -(-int(counts[0]) // SHARD))
    groups = max(1, -(-int(counts[1] or 0) // QUERIES))
    candidates = distinct.select("id", "vector", "copies", F.pmod("spot", F.lit(shards)).alias("shard"))
    # Names of their own: candidates and queries come from the same rows.
    asked = distinct.where("asks").select(*[F.col(c).alias(c) for c in ("id", "vector", "copies")], F.pmod(F.xxhash64(F.lit(1), "id", "vector"), F.lit(groups)).alias("block"))
    asked = asked.withColumn("home", F.pmod("block", F.lit(shards)))
    schema = "query_id long, query_vector array<bigint>, times long, block bigint, id long, score long"

    def visit(asks: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(shard):
            return pd.DataFrame(columns=["query_id", "query_vector", "times", "block", "id", "score"])
        found = search(
            _matrix(asks["vector"].tolist()), _matrix(shard["vector"].tolist()), shard["id"].to_numpy(), shard["copies"].to_numpy(),
            asks["id"].to_numpy(), k, asks["floor"].to_numpy(np.float64),
        )
        rows = [(a, v, n, b, j, s) for a, v, n, b, hits in zip(asks["id"], asks["vector"], asks["copies"], asks["block"], found, strict=True) for s, j in hits]
        return pd.DataFrame(rows, columns=["query_id", "query_vector", "times", "block", "id", "score"])

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    low = F.lit(float("-inf"))
    first = asked.withColumn("floor", low).withColumn("shard", F.col("home"))
    homes = candidates.join(asked.select(F.col("home").alias("shard"), F.col("block").alias("block")).distinct(), "shard")
    near = stored(first.groupBy("shard", "block").cogroup(homes.groupBy("shard", "block")).applyInPandas(visit, schema))
    kth = near.groupBy("query_id", "query_vector").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
    rest = asked.join(kth, (asked["id"] == kth["query_id"]) & (asked["vector"] == kth["query_vector"]), "left").withColumn("floor", F.coalesce("kth", low))
    rest = rest.select(*[F.col(c).alias(c) for c in ("id", "vector", "copies", "block", "floor")], F.explode(F.expr(f"filter(sequence(0L, {shards - 1}L), s -> s != home)")).alias("shard"))
    others = candidates.withColumn("block", every)
    far = rest.groupBy("shard", "block").cogroup(others.groupBy("shard", "block")).applyInPandas(visit, schema)
    order = Window.partitionBy("query_id", "query_vector").orderBy(F.desc("score"), "id")
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked = ranked.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
