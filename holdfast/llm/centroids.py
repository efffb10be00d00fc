"""Centroid clustering of integer vectors, exact, with distances filtered in a rotated space.

Every vector is stored with its leading coordinates on the principal axes and the norm of what they leave out.
For a vector and a centroid, the squared distance of the leading coordinates plus the squared difference of the
two norms is at most their squared distance. The centroid of the least bound is measured first; another one is
measured only if its bound does not exceed that distance. Measuring is done in integers, so the rotation and
its rounding decide what is measured, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LEADING = 16  # principal coordinates that are stored
LARGEST = 2**27  # component above which a squared distance of 64 of them may not fit in 63 bits
SLACK = 1e-9  # rounding allowed for in a bound, relative to the squared norms

Centroids = list[list[int]]


def integer_vector(vector: str, scale: int, components: int) -> Column:
    """floor(scale * x) of every component; missing unless there are exactly ``components``, all of them finite.

    A component beyond 2^27 after scaling is an error: its squared distance would not fit in a long.
    """
    x = F.transform(vector, lambda c: c.cast("double"))
    good = F.col(vector).isNotNull() & (F.size(vector) == components)
    good = good & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    floors = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    fits = F.forall(x, lambda c: F.abs(c * F.lit(float(scale))) <= LARGEST)
    return F.when(good, F.when(fits, F.transform(floors, lambda c: c.cast("int"))).otherwise(F.raise_error(F.lit("component too large for exact distances"))))


class Rotation:
    """Centre and principal axes."""

    def __init__(self, centre: np.ndarray, axes: np.ndarray):
        self.centre, self.axes = centre, axes

    def turn(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the norm of the rest."""
        moved = vectors - self.centre
        lead = moved @ self.axes
        rest = np.einsum("ij,ij->i", moved, moved) - np.einsum("ij,ij->i", lead, lead)
        return lead, np.sqrt(np.maximum(rest, 0))


def fit_rotation(vectors: DataFrame, components: int, leading: int = LEADING) -> Rotation:
    """Principal axes of all vectors (column ``vector``), from a covariance added up over the tasks. With fewer than two vectors, the first axes as they are."""
    leading = min(leading, components)
    if vectors.count() < 2:
        return Rotation(np.zeros(components), np.eye(components)[:, :leading])
    features = vectors.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    centre = features.agg(Summarizer.mean(F.col("features")).alias("centre")).first()["centre"]
    axes = PCA(k=leading, inputCol="features", outputCol="turned").fit(features).pc.toArray()
    return Rotation(centre.toArray(), np.linalg.qr(axes)[0])


def nearest_centroids(vectors: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (ties: the smaller number), its squared distance, and how many were measured."""
    c_lead, c_rest = rotation.turn(centroids.astype(np.float64))
    bound = (rest[:, None] - c_rest) ** 2
    for axis in range(lead.shape[1]):
        bound += (lead[:, axis, None] - c_lead[:, axis]) ** 2
    norms = (lead**2).sum(1) + rest**2
    bound -= SLACK * (norms[:, None] + (c_lead**2).sum(1) + c_rest**2 + 1)

    def measure(rows: np.ndarray, number: np.ndarray | int) -> np.ndarray:
        gap = vectors[rows] - centroids[number]
        return np.einsum("ij,ij->i", gap, gap)

    every = np.arange(len(vectors))
    cluster = bound.argmin(1)
    distance = measure(every, cluster)
    first, measured = cluster.copy(), np.ones(len(vectors), np.int64)
    for number in np.arange(len(centroids)):
        rows = np.flatnonzero((bound[:, number] <= distance) & (first != number))
        found = measure(rows, number)
        better = (found < distance[rows]) | ((found == distance[rows]) & (number < cluster[rows]))
        cluster[rows[better]], distance[rows[better]] = number, found[better]
        measured[rows] += 1
    return cluster, distance, measured


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), flat.size // max(1, len(column)))


Assigned = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _assigner(centroids: Centroids, rotation: Rotation) -> Callable[[pa.RecordBatch], Assigned]:
    fixed = np.array(centroids, np.int64)

    def assign(batch: pa.RecordBatch) -> Assigned:
        vectors = _matrix(batch.column("vector"), np.int64)
        lead, rest = _matrix(batch.column("lead"), np.float64), batch.column("rest").to_numpy()
        return vectors, *nearest_centroids(vectors, lead, rest, fixed, rotation)

    return assign


def first_centroids(vectors: DataFrame, key: str, number: int, seed: int) -> Centroids:
    """The vectors with the ``number`` smallest hashes of ``<seed>:<key>`` in ascending order; equal hashes go by vector. A missing key counts as empty."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(order.alias("order"), "vector").orderBy("order", "vector").limit(number)
    return [list(r["vector"]) for r in rows.collect()]


def moved_centroids(filtered: DataFrame, centroids: Centroids, rotation: Rotation) -> Centroids:
    """Exact floor of each centroid's mean vector; one without vectors stays. Tasks add their vectors up, so a few rows per task are shuffled."""
    assign, components = _assigner(centroids, rotation), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), components), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            vectors, cluster, _, _ = assign(batch)
            for number in range(len(centroids)):
                own = vectors[cluster == number]
                total[number] += own.sum(0)
                count[number] += len(own)
        used = np.flatnonzero(count)
        if len(used):
            columns = [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "total"])

    parts = filtered.mapInArrow(sums, "cluster int, n long, total array<long>")
    exact = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(components)]
    moved = [list(c) for c in centroids]
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # one row per centroid
        moved[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(components)]
    return moved


def centroid_clusters(vectors: DataFrame, key: str, components: int, number: int, rounds: int, seed: int, leading: int = LEADING) -> DataFrame:
    """Cluster all vectors: ``rounds`` times assign and move the centroids, then assign once more.

    ``vectors`` has ``key`` and an integer array ``vector`` of ``components``; rows without a vector take no part,
    other columns are left out. Repeated rows and keys stay, each counted. With fewer vectors than ``number`` there
    are as many centroids as vectors; an empty table gives an empty result. Rounds end early where no centroid
    moves, as all further ones would repeat. Adds ``cluster``, its squared ``distance``, ``measured`` (centroids
    measured in integers by the last assignment), ``cluster_inertia``, ``inertia`` and the final ``centroid``.
    """
    kept = stored(vectors.where(F.col("vector").isNotNull()).select(key, F.col("vector").cast("array<int>").alias("vector")))
    rotation = fit_rotation(kept, components, leading)
    centroids = first_centroids(kept, key, number, seed)
    of_key = kept.schema[key].dataType.simpleString()

    def rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotation.turn(_matrix(batch.column("vector"), np.float64))
            spread = pa.ListArray.from_arrays(np.arange(len(lead) + 1, dtype=np.int32) * lead.shape[1], lead.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, spread, pa.array(rest)], [key, "vector", "lead", "rest"])

    schema = f"`{key}` {of_key}, vector array<int>, lead array<double>, rest double"
    filtered = stored(kept.mapInArrow(rotated, schema))
    for _ in range(rounds if centroids else 0):
        moved = moved_centroids(filtered, centroids, rotation)
        if moved == centroids:
            break
        centroids = moved
    assign = _assigner(centroids, rotation)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance, measured = assign(batch)
            columns = [batch.column(key), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(measured)]
            yield pa.RecordBatch.from_arrays(columns, [key, "cluster", "distance", "measured"])

    found = stored(filtered.mapInArrow(final, f"`{key}` {of_key}, cluster int, distance long, measured long"))
    sums = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    whole = sum(sums.values())
    cells = [
        F.when(F.col("cluster") == i, F.struct(F.lit(sums.get(i, 0)).cast("long").alias("inertia"), F.array(*map(F.lit, c)).alias("centroid")))
        for i, c in enumerate(centroids)
    ]
    own = F.coalesce(*cells) if cells else F.lit(None).cast("struct<inertia:bigint,centroid:array<int>>")
    return found.withColumn("own", own).select(
        *found.columns, F.col("own.inertia").alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), F.col("own.centroid").alias("centroid")
    )
