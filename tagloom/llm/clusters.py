"""Centroid clustering in exact integers, each vector assigned by a tournament of bisectors.

The points as near to centroid i as to centroid j lie on a plane. For i < j the integer normal ``2 (c_j - c_i)`` and
the threshold ``|c_j|^2 - |c_i|^2`` are computed once for a set of centroids; x is nearer to j exactly if its product with
the normal exceeds the threshold. A vector goes through k - 1 such tests in ascending order, the winner so far against
the next; at zero the smaller number stays. Only the distance to the final winner is computed.

Spark computes sums per cluster and component; the driver holds centroids only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CENTROIDS = 40
DIMENSIONS = 64
ROUNDS = 5
SCALE = 256
SEED = 2
FIELDS = ("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
# Rows of one numpy step; bounds the gathered normals of a task.
BLOCK = 2048
# Vectors up to this size are computed in 64-bit integers without overflow, any others in Python's integers.
SMALL = 1 << 24
_LIMB = 32
_MOST = (1 << 63) - 1


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), also where the product leaves the range of floating point."""
    return math.floor(scale * x) if abs(x) < 1 << 53 else scale * int(x)


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite components, as 64-bit integers if all are small, else as Python's integers."""
    values = values.astype(np.float64)
    if np.abs(values).max(initial=0) * scale < SMALL:
        return np.floor(scale * values).astype(np.int64)
    whole = np.empty(values.shape, object)
    whole.ravel()[:] = [_whole(x, scale) for x in values.ravel().tolist()]
    return whole


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        small = max((abs(x) for c in centroids for x in c), default=0) < SMALL
        self.centroids = np.array(centroids, np.int64 if small else object)
        norm = (self.centroids**2).sum(1)
        self.normals = 2 * (self.centroids[None, :] - self.centroids[:, None])
        self.thresholds = norm[None, :] - norm[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of every row, and the squared distance to it."""
        if x.dtype != self.centroids.dtype:
            x = x.astype(object)
        winner = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = (x * self.normals[winner, j]).sum(1) - self.thresholds[winner, j]
            winner[side > 0] = j
        return winner, ((x - self.centroids[winner]) ** 2).sum(1)


def kept(rows: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """Rows whose vector has exactly so many components, none of them null or non-finite."""
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))  # noqa: E731 - NaN is above infinity
    return rows.where((F.size(f"`{vector}`") == dimensions) & F.forall(f"`{vector}`", finite))


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors of bounded blocks of the columns ``id`` and ``vector``."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            values = piece["vector"].flatten().to_numpy(zero_copy_only=False)
            yield piece["id"], integers(values.reshape(-1, dimensions), scale)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number as 32-bit digits with its sign, whose sums over many tasks fit 64 bits."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value or not place:
        yield place, sign * (value & (1 << _LIMB) - 1)
        value >>= _LIMB
        place += 1


def _sums(bisectors: Bisectors, dimensions: int, scale: int) -> Callable:
    """The task: exact sums per cluster of the components, of the vectors (component -1) and of the distances (-2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for _, x in _blocks(batches, dimensions, scale):
            cluster, distance = bisectors.nearest(x)
            for c in np.unique(cluster).tolist():
                own = cluster == c
                sums = [*enumerate(x[own].sum(0).tolist()), (-1, int(own.sum())), (-2, int(distance[own].sum()))]
                for d, s in sums:
                    total[c, d] = total.get((c, d), 0) + int(s)
        rows = [(c, d, place, digit) for (c, d), s in total.items() for place, digit in _limbs(s)]
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["c", "d", "place", "digit"])

    return run


def _totals(vectors: DataFrame, bisectors: Bisectors, dimensions: int, scale: int) -> dict[tuple[int, int], int]:
    """Sums over all vectors; the driver gets a few digits per cluster and component."""
    parts = vectors.mapInArrow(_sums(bisectors, dimensions, scale), "c int, d int, place int, digit bigint")
    digits = parts.groupBy("c", "d", "place").agg(F.sum("digit").alias("digit")).collect()
    total: dict[tuple[int, int], int] = {}
    for r in digits:
        total[r.c, r.d] = total.get((r.c, r.d), 0) + (r.digit << _LIMB * r.place)
    return total


def _moved(centroids: list[list[int]], total: dict[tuple[int, int], int]) -> list[list[int]]:
    """Floors of the mean components; a centroid without vectors stays."""
    return [
        [total[c, d] // total[c, -1] for d in range(len(old))] if total.get((c, -1)) else old
        for c, old in enumerate(centroids)
    ]


def first_centroids(vectors: DataFrame, count: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of seed and id, in that order; of rows that repeat an id, the smaller vector first."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(name.cast("binary"), 256), F.col("vector")).limit(count).select("vector").collect()
    return [[_whole(x, scale) for x in r.vector] for r in rows]


def cluster(
    rows: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    count: int = CENTROIDS,
    dimensions: int = DIMENSIONS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector.

    Rows whose vector is null, has another number of components, or holds null or non-finite ones take no part. Fewer kept
    vectors than ``count`` give so many centroids; none give no result. Repeated rows are vectors of their own, a null
    id counts as empty text in the hash and stays null. Distances and sums are exact; in the result those beyond 64
    bits are cut to the largest number. Only the two named columns are read, so others may have any name.
    """
    named = kept(rows.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("vector")), "vector", dimensions)
    vectors = named.select("id", F.col("vector").cast("array<double>").alias("vector"))
    centroids = first_centroids(vectors, count, seed, scale)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(centroids, _totals(vectors, Bisectors(centroids), dimensions, scale))
    bisectors = Bisectors(centroids or [[0] * dimensions])
    total = _totals(vectors, bisectors, dimensions, scale) if centroids else {}
    cut = lambda n: min(n, _MOST)
    inertia = [total.get((c, -2), 0) for c in range(len(centroids))]
    whole, own = cut(sum(inertia)), np.array([cut(n) for n in inertia], np.int64)
    names = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dimensions, scale):
            at, distance = bisectors.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(at.astype(np.int32)),
                    pa.array([cut(n) for n in distance.tolist()], pa.int64()),
                    pa.array(own[at]),
                    pa.array(np.full(len(at), whole)),
                    pa.array(names[at].tolist(), pa.string()),
                ],
                list(FIELDS),
            )

    kind = named.schema["id"].dataType.simpleString()
    schema = f"id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return vectors.mapInArrow(assign, schema).withColumnRenamed("id", id)

