"""Packing into length buckets that minimise padding, and token-budget batches inside each bucket.

The histogram of sequence lengths has at most ``max_len`` entries whatever the number of documents, as longer documents
are cut into sequences of ``max_len``. Dynamic programming over it finds the bucket boundaries with the least padding.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.paging import with_position
from ..sources.shared import emptied, written
from .text import words_of

MAX_LEN = 2048
BUCKETS = 8
BUDGET = 16_384
SCHEMA = "doc_id bigint, chunk int, length int, bucket_len int, batch bigint, slot int"


def boundaries(histogram: Sequence[tuple[int, int]], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets over (length, count) with the least total padding.

    Of equally good choices each bucket, from the last down, begins as low as possible.
    """
    rows = sorted((n, c) for n, c in histogram if c > 0)
    if not rows:
        return []
    length = np.array([n for n, _ in rows], np.int64)
    count = np.concatenate(([0], np.cumsum([c for _, c in rows]))).astype(np.int64)
    tokens = np.concatenate(([0], np.cumsum([n * c for n, c in rows]))).astype(np.int64)
    m = len(rows)
    # best[j]: least padding of the first j lengths in k buckets; cut[k][j]: where the last of them begins.
    best = length[np.maximum(np.arange(m + 1) - 1, 0)] * count - tokens
    best[0] = 0
    cuts = [np.zeros(m + 1, np.int64)]
    for k in range(2, min(buckets, m) + 1):
        new, cut = best.copy(), np.zeros(m + 1, np.int64)
        for j in range(k, m + 1):
            i = np.arange(k - 1, j)
            cost = best[i] + length[j - 1] * (count[j] - count[i]) - (tokens[j] - tokens[i])
            at = int(cost.argmin())
            new[j], cut[j] = cost[at], i[at]
        best = new
        cuts.append(cut)
    ends, j = [], m
    for cut in reversed(cuts):
        ends.append(int(length[j - 1]))
        j = int(cut[j])
    return ends[::-1]


def word_lengths(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, length): words of every whole text and one end token; a null or empty text has the end only."""
    return docs.select(F.col(f"`{id}`").alias("doc_id"), (F.size(words_of(F.col(f"`{text}`"))) + 1).alias("length"))


def _chosen(key: Column, pairs: Sequence[tuple[int, int]]) -> Column:
    """The value of the first pair whose key is not below ``key``."""
    out = F.lit(pairs[-1][1])
    for bound, value in reversed(pairs[:-1]):
        out = F.when(key <= bound, F.lit(value)).otherwise(out)
    return out


def pack(lengths: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Place every sequence: (doc_id, chunk, length, bucket_len, batch, slot).

    ``lengths`` has ``doc_id`` and ``length``; a row longer than ``max_len`` becomes several chunks, none is cut off. A
    sequence is padded to ``bucket_len``, the end of its bucket. Sequences of a bucket, by doc_id and chunk, fill batches of
    ``budget // bucket_len`` of them, at least one; batches are numbered from 0 in each bucket. Rows without tokens (length
    null or below 1) have no sequence; repeated rows are packed each; other columns are not read.

    Places come from a range partitioning by bucket and id, so a bucket of any size is spread over many tasks.
    """
    used: list[str] = []
    count = F.ceil(F.col("length") / max_len).cast("int")
    rows = written(
        lengths.where("length >= 1")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("length").cast("bigint").alias("length"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
        .select("doc_id", "chunk", F.least(F.lit(max_len), F.col("length") - F.col("chunk") * max_len).cast("int").alias("length")),
        "packing-lengths",
        used,
    )
    histogram = [(r["length"], r["count"]) for r in rows.groupBy("length").count().collect()]  # max_len rows at most
    ends = boundaries(histogram, buckets)
    if not ends:
        return lengths.sparkSession.createDataFrame([], SCHEMA)
    before = [(end, sum(c for n, c in histogram if n <= low)) for low, end in zip([0, *ends], ends)]
    capacity = [(end, max(1, budget // end)) for end in ends]
    placed = with_position(
        rows.withColumn("bucket_len", _chosen(F.col("length"), [(e, e) for e in ends])).withColumn(
            "__copy", F.monotonically_increasing_id()
        ),
        *(F.col(c) for c in ("bucket_len", "doc_id", "chunk", "__copy")),
    )
    for path in used:
        emptied(lengths.sparkSession, path)
    rank = F.col("position") - 1 - _chosen(F.col("bucket_len"), before)
    per_batch = _chosen(F.col("bucket_len"), capacity)
    return placed.select(
        "doc_id",
        "chunk",
        "length",
        "bucket_len",
        F.floor(rank / per_batch).cast("bigint").alias("batch"),
        F.pmod(rank, per_batch).cast("int").alias("slot"),
    )
