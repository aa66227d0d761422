"""Helpers on whole texts: byte-level words and hashes for tasks, and small column helpers for plans.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0d``, which is exactly what ``bytes.split()``
takes; ``bytes.lower()`` lower-cases A-Z only. Both leave the other bytes of UTF-8 alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = " \t\n\x0b\f\r"
# Temporary arrays of a task are a few times this many bytes of text (one longer document goes alone).
SLICE_BYTES = 6 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc(column: str = "doc_id") -> Column:
    """crc32 of a number as decimal text."""
    return F.crc32(F.col(column).cast("string"))


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none.

    White space becomes blanks first, as splitting at one character needs no regular expression.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(plain, " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas in the body use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into consecutive pieces of about ``size`` bytes of the text column."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def add_columns(
    df: DataFrame, task: Callable[[pa.RecordBatch], list[pa.Array]], new: str, text: str = "text", size: int = SLICE_BYTES
) -> DataFrame:
    """Add columns that ``task`` computes from the column ``text`` of Arrow pieces of about ``size`` bytes of text.

    ``new`` is their schema as text; a new column replaces one of the same name, and all others stay.
    """
    fields = df.sparkSession.createDataFrame([], new).schema.fields
    names = {f.name.lower() for f in fields}
    old = [f for f in df.schema.fields if f.name.lower() not in names]
    place = {f"__{i}": f for i, f in enumerate(old)}
    source = df.select(
        *(F.col(f"`{f.name}`").alias(a) for a, f in place.items()), F.col(f"`{text}`").cast("string").alias("text")
    )
    schema = T.StructType(
        [T.StructField(a, f.dataType, True) for a, f in place.items()] + [T.StructField(f.name, f.dataType) for f in fields]
    )
    kept, added = list(place), [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, size=size):
            yield pa.RecordBatch.from_arrays([piece[a] for a in kept] + task(piece), kept + added)
        # Workers outlive their tasks, so what the last batches took goes back.
        piece = None
        pa.default_memory_pool().release_unused()

    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(a).alias(f.name) for a, f in place.items()), *added)


def split_words(texts: list[bytes | None], lower: bool = True) -> tuple[list[list[bytes]], np.ndarray]:
    """The words of every text, and how many there are."""
    parts = [(t.lower() if lower else t).split() if t else [] for t in texts]
    return parts, np.fromiter(map(len, parts), np.int64, len(parts))


def word_hashes(parts: list[list[bytes]], total: int) -> np.ndarray:
    """64-bit hashes of all words, text after text."""
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(parts)), np.uint64, total)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: an avalanche over 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, sizes: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of every text, and the text each belongs to.

    A text of fewer words than ``width`` has one shingle, its whole sequence; one without words has none.
    """
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    counts = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    length = np.minimum(sizes[owner], width)
    out = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        inside = k < length
        word = hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] if len(hashes) else first.astype(np.uint64)
        out = np.where(inside, mix(out ^ word) + np.uint64(0x9E3779B97F4A7C15), out)
    return out, owner


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed integers of Spark's bigint."""
    return x.astype(np.uint64).view(np.int64)
