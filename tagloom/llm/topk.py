"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments. With the mean m and the deviation s (root of the centred sum of squares) of each
segment of length w, the squared distance of two vectors is at least the sum over segments of
``w (m_q - m_x)^2 + (s_q - s_x)^2``. As ``2 <q,x> = |q|^2 + |x|^2 - |q - x|^2``, such a lower bound on the distance is
an upper bound on the inner product. Bounds are computed with few segments first; pairs that can still reach the query's
current k-th score get finer bounds, and only the survivors an exact integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

K = 5
SCALE = 256
LEVELS = (1, 4, 16)
QUERY_BLOCK = 4096
ROW_BLOCK = 256
PAIR_BLOCK = 1 << 16  # bounds the temporary arrays of survivors
SPARSE = 16  # with more than one pair in so many left, bounds are computed for all pairs of a block at once
_LIMIT = float(1 << 53)


def matrix(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part (not null, all components present and finite), and their vectors floor(scale * x).

    Shorter vectors are filled up with zeros, so missing components count as zero.
    """
    lists = vectors.to_pylist() if pa.types.is_fixed_size_list(vectors.type) else None
    if lists is not None:
        vectors = pa.array(lists, pa.list_(pa.float64()))
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    offsets = vectors.offsets.to_numpy()
    sizes = np.diff(offsets)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    fit = (bad[offsets[1:]] == bad[offsets[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fit)
    out = np.zeros((len(rows), int(sizes[rows].max()) if len(rows) else 0))
    owner = np.repeat(np.arange(len(rows)), sizes[rows])
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[rows]) - sizes[rows], sizes[rows])
    found = values[offsets[rows][owner] + place]
    with np.errstate(over="ignore"):
        whole = np.floor(scale * found)
    # A product beyond the range of doubles is cut to its end.
    out[owner, place] = np.clip(whole, -np.finfo(float).max, np.finfo(float).max)
    return rows, out


class Statistics:
    """Segment means and deviations of vectors at every level."""

    def __init__(self, vectors: np.ndarray):
        self.norm = (vectors**2).sum(1)
        self.levels = []
        for n in LEVELS:
            cuts = np.array_split(np.arange(vectors.shape[1]), min(n, max(1, vectors.shape[1])))
            means = np.stack([vectors[:, c].mean(1) if len(c) else np.zeros(len(vectors)) for c in cuts], 1)
            spread = np.stack([np.sqrt(((vectors[:, c] - m[:, None]) ** 2).sum(1)) for c, m in zip(cuts, means.T)], 1)
            width = np.sqrt([len(c) for c in cuts])
            self.levels.append(np.concatenate([means * width, spread], 1))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows as 64-bit integers; beyond that range they are cut to its ends."""
    with np.errstate(all="ignore"):
        small = q.shape[1] * np.abs(q).max(1, initial=0) * np.abs(x).max(1, initial=0) < _LIMIT
        out = np.zeros(len(q), np.int64)
        out[small] = np.einsum("ij,ij->i", q[small], x[small]).astype(np.int64)
    least, most = -(1 << 63), (1 << 63) - 1
    for k in np.flatnonzero(~small):
        total = sum(int(a) * int(b) for a, b in zip(q[k].tolist(), x[k].tolist()))
        out[k] = min(max(total, least), most)
    return out


class Search:
    """The best k rows seen so far for every query of a block.

    ``ruled_out`` counts the pairs of each level whose bound was below the query's k-th score, and ``pairs`` all pairs.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.by_id = np.argsort(ids, kind="stable")
        with np.errstate(all="ignore"):
            self.stats = Statistics(vectors)
        self.query = np.empty(0, np.int64)  # place of the query, of each kept pair
        self.row = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.floor = np.full(len(ids), -np.inf)  # k-th score, once there are k
        self.pairs, self.ruled_out = 0, np.zeros(len(LEVELS), np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        width = max(vectors.shape[1], self.vectors.shape[1])
        fill = lambda v: np.pad(v, ((0, 0), (0, width - v.shape[1])))
        vectors = fill(vectors)
        # Components so large that sums leave the range of doubles give bounds that are no number; such pairs are kept.
        with np.errstate(all="ignore"):
            if self.vectors.shape[1] < width:
                self.vectors = fill(self.vectors)
                self.stats = Statistics(self.vectors)
            live = self._live(ids, Statistics(vectors))
            q, x = self._survivors(live, vectors)
        if len(q):
            self._keep(q, ids[x], _exact_pairs(self.vectors, vectors, q, x))

    def _live(self, ids: np.ndarray, stats: Statistics) -> np.ndarray:
        """Which pairs can still reach the query's k-th score: bounds of all levels, coarse to fine."""
        # Rounding may lower a bound by a few units in the last place of the norms; the slack covers that.
        slack = 1e-9 * (self.stats.norm[:, None] + stats.norm[None, :]) + 1e-6
        need = 2 * self.floor[:, None] - slack
        live = np.ones(need.shape, bool)
        # A row is no answer to the query of its own id.
        at = np.minimum(np.searchsorted(self.ids, ids, sorter=self.by_id), len(self.ids) - 1)
        same = self.ids[self.by_id[at]] == ids
        live[self.by_id[at[same]], np.flatnonzero(same)] = False
        self.pairs += int(live.sum())
        for level, (a, b) in enumerate(zip(self.stats.levels, stats.levels)):
            before = int(live.sum())
            if before * SPARSE > live.size:
                # |q|^2 + |x|^2 - |a - b|^2, as one product of the statistics.
                own, other = self.stats.norm - (a**2).sum(1), stats.norm - (b**2).sum(1)
                live &= ~(own[:, None] + other[None, :] + 2 * (a @ b.T) < need)
            else:
                q, x = np.nonzero(live)
                for cut in range(0, len(q), PAIR_BLOCK):
                    i, j = q[cut : cut + PAIR_BLOCK], x[cut : cut + PAIR_BLOCK]
                    gap = ((a[i] - b[j]) ** 2).sum(1)
                    live[i, j] = ~(self.stats.norm[i] + stats.norm[j] - gap < need[i, j])
            self.ruled_out[level] += before - int(live.sum())
        return live

    def _survivors(self, live: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that reach the k-th score or whose score has to be computed in whole numbers of any size."""
        if live.sum() * SPARSE > live.size:
            size = lambda v: np.abs(v).max(1, initial=0)
            bound = vectors.shape[1] * size(self.vectors)[:, None] * size(vectors)[None, :]
            # Sums below 2^53 are exact in doubles, in whatever order they are added.
            live &= ~((bound < _LIMIT) & (self.vectors @ vectors.T < self.floor[:, None]))
        return np.nonzero(live)

    def _keep(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        row, score = np.concatenate([self.row, row]), np.concatenate([self.score, score])
        order = np.lexsort((row, ~score, query))  # ~score sorts downward over the whole 64-bit range
        query, row, score = query[order], row[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = place < self.k
        self.query, self.row, self.score = query[top], row[top], score[top]
        full = place[top] == self.k - 1
        # The next number below, as a 64-bit integer need not be a double.
        self.floor[self.query[full]] = np.nextafter(self.score[full].astype(float), -np.inf)


def _exact_pairs(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    parts = [slice(cut, cut + PAIR_BLOCK) for cut in range(0, len(q), PAIR_BLOCK)]
    return np.concatenate([_exact(queries[q[p]], rows[x[p]]) for p in parts])


def _scan(ids: np.ndarray, vectors: np.ndarray, k: int, scale: int, counts: bool = False):
    """The task: the best k rows of its partition for every query of a block, or how many pairs each level ruled out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(ids, vectors, k)
        for batch in batches:
            rows, found = matrix(batch["vector"], scale)
            # Long vectors first: their scores rule out more of the others.
            with np.errstate(all="ignore"):
                order = np.argsort(-(found**2).sum(1), kind="stable")
            names, found = batch["id"].to_numpy(zero_copy_only=False)[rows][order], found[order]
            at = 0
            while at < len(names):
                # The first few rows give every query a k-th score that prunes the rest.
                size = ROW_BLOCK if len(search.row) else 8 * k
                search.add(names[at : at + size], found[at : at + size])
                at += size
        if counts:
            levels = [-1, *range(len(LEVELS))]
            numbers = [search.pairs, *search.ruled_out.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(levels, pa.int32()), pa.array(numbers, pa.int64())], ["level", "n"])
            return
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[search.query], pa.int64()), pa.array(search.row), pa.array(search.score)],
            ["query_id", "row_id", "score"],
        )

    return run


def _blocks(queries: DataFrame, size: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct queries in blocks of bounded size; the driver holds one block at a time."""
    rows: list = []

    def pack() -> tuple[np.ndarray, np.ndarray]:
        fit, found = matrix(pa.array([r[1] for r in rows], pa.list_(pa.float64())), scale)
        return np.array([r[0] for r in rows], np.int64)[fit], found

    for row in queries.toLocalIterator():
        rows.append(row)
        if len(rows) == size:
            yield pack()
            rows = []
    if rows:
        yield pack()


def _sides(queries: DataFrame, rows: DataFrame, id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    plain = lambda df: df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    known = plain(rows).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    asked = plain(queries).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    return asked.groupBy("id").agg(F.min(F.col("vector").cast("array<double>")).alias("vector")), known


def ruled_out(
    queries: DataFrame, rows: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE
) -> dict[int, float]:
    """By number of segments, the share of all pairs whose bound at that level ruled them out. No pairs give 0."""
    asked, known = _sides(queries, rows, id, vector)
    total = dict.fromkeys([-1, *range(len(LEVELS))], 0)
    for ids, vectors in _blocks(asked, QUERY_BLOCK, scale):
        parts = known.mapInArrow(_scan(ids, vectors, k, scale, counts=True), "level int, n bigint")
        for row in parts.groupBy("level").agg(F.sum("n").alias("n")).collect():
            total[row.level] += row.n
    return {segments: total[level] / max(1, total[-1]) for level, segments in enumerate(LEVELS)}


def top_k(
    queries: DataFrame,
    rows: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, row_id, score): the k highest inner products of floor(scale * x) for every query.

    Candidates are all rows with another id; fewer than k give fewer ranks, ties go to the smaller id. Rows whose id or
    vector is null, or whose vector holds null or non-finite components, take no part; shorter vectors count as filled
    up with zeros. A query id that repeats is answered once, for its smallest vector; repeated candidate rows take a
    rank each. Scores beyond 64 bits are cut to that range and rank as such. No rows give no result. Only the two named columns are
    read, so others may have any name.

    Queries are taken in blocks. Each block goes to every partition of the rows, which sends back k rows per query at
    most, so a pass shuffles k rows per query and partition and no more.
    """
    asked, known = _sides(queries, rows, id, vector)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    parts = []
    for ids, vectors in _blocks(asked, block, scale):
        best = known.mapInArrow(_scan(ids, vectors, k, scale), "query_id bigint, row_id bigint, score bigint")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(written(best, "topk"))
    if not parts:
        spark = rows.sparkSession
        return spark.createDataFrame([], "query_id bigint, rank int, row_id bigint, score bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "row_id", "score")
