"""Token ids as Arrow stream files of fixed-size-list batches.

A part file holds the documents of one range of ids in ascending order, cut into sequences of equal length. Its
record batches have the columns ``ids`` (fixed-size list of uint16, or uint32 for large vocabularies), ``mask`` and
``last`` (fixed-size lists of booleans: a token rather than padding; the last token of a document) and ``doc_ids`` (the
documents that end in the sequence, in order). Only the last sequence of a part is padded. As every sequence has
the same length, sequence n of a memory-mapped file is a slice of its batch without a copy. The stream format has no
footer; a file ``<part>.idx`` beside it holds the offset and row count of every batch as 64-bit integers, which
lets a reader jump to a batch.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .text import slices

LENGTH = 2048
BATCH = 256  # sequences
END = 0
CACHE_UNITS = 800_000

# Letters, numbers and white space below U+0250, and the units a byte-level pre-tokenizer cuts texts into.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = " \\t\\n\\r\\f\\v\x85\xa0"
_UNIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_BEYOND = re.compile("[^\0-\u024f]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class _Units(dict):
    """Ids, as bytes, of units met before; a bounded memory of the tokenizer's model.

    The pre-tokenizer cuts a text into units by a fixed pattern, and the model encodes each by itself, so a text is the
    joined ids of its units. Texts that are not cut here for sure are given to the tokenizer whole: those with
    characters from U+0250 on, whose classes depend on the Unicode version, those that hold an added token, and all texts if the
    tokenizer is no plain byte-level one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.type = np.dtype("<u4" if self.wide else "<u2")
        self.letters = _byte_letters()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        form = json.loads(self.tokenizer.to_str())
        before = form["pre_tokenizer"] or {}
        self.plain = (
            before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and form["normalizer"] is None
            and form["model"]["type"] == "BPE"
            and not form["model"].get("dropout")
        )

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def __missing__(self, unit: str) -> bytes:
        shown = unit.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(shown)], self.type).tobytes()
        if len(self) < CACHE_UNITS:
            self[unit] = ids
        return ids


@lru_cache(maxsize=1)
def _units(path: str) -> _Units:
    """One per worker process and tokenizer file."""
    return _Units(path)


def encode(text: str, units: _Units) -> bytes:
    """Ids of a whole text, as the tokenizer gives them without special tokens of its own."""
    if not text:
        return b""
    if not units.plain or _BEYOND.search(text) or any(t in text for t in units.added):
        return units.whole(text)
    return b"".join(map(units.__getitem__, _UNIT.findall(text)))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark itself resolves it: without one it belongs to the default file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def _filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path; ``file:/folder`` is how Spark writes a local one."""
    return pafs.FileSystem.from_uri(url) if "://" in url else (pafs.LocalFileSystem(), url.removeprefix("file:"))


class Writer:
    """Appends documents to a part file; a failed attempt leaves at most a file that nothing refers to."""

    def __init__(self, url: str, type: np.dtype, length: int):
        fs, path = _filesystem(url)
        fs.create_dir(str(PurePosixPath(path).parent))
        self.length, self.type = length, type
        fixed = lambda t: pa.list_(t, length)
        self.schema = pa.schema(
            [
                ("ids", fixed(pa.from_numpy_dtype(type))),
                ("mask", fixed(pa.bool_())),
                ("last", fixed(pa.bool_())),
                ("doc_ids", pa.list_(pa.int64())),
            ]
        )
        self.file, self.index = fs.open_output_stream(path), fs.open_output_stream(path + ".idx")
        self.stream = pa.ipc.new_stream(self.file, self.schema)
        self.ids: list[np.ndarray] = []
        self.size = 0
        self.ends: list[int] = []  # places of last tokens that are not yet written
        self.docs: list[int | None] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.size += len(ids)
        self.ends.append(self.size - 1)
        self.docs.append(doc_id)
        if self.size >= BATCH * self.length:
            self._flush(self.size // self.length)

    def _flush(self, rows: int) -> None:
        if not rows:
            return
        ids = np.concatenate(self.ids)
        cut = rows * self.length
        whole = np.zeros(cut, self.type)
        whole[: min(cut, len(ids))] = ids[:cut]
        mask, last = np.arange(cut) < len(ids), np.zeros(cut, bool)
        ends = np.array(self.ends)
        done = int(np.searchsorted(ends, cut))
        last[ends[:done]] = True
        starts = np.searchsorted(ends[:done], np.arange(rows + 1) * self.length)
        fixed = lambda values: pa.FixedSizeListArray.from_arrays(pa.array(values), self.length)
        docs = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(self.docs[:done], pa.int64()))
        batch = pa.RecordBatch.from_arrays([fixed(whole), fixed(mask), fixed(last), docs], schema=self.schema)
        self.index.write(np.array([self.file.tell(), rows], "<i8").tobytes())
        self.stream.write_batch(batch)
        self.ids, self.size = ([ids[cut:]], len(ids) - cut) if len(ids) > cut else ([], 0)
        self.ends, self.docs = [e - cut for e in self.ends[done:]], self.docs[done:]

    def close(self) -> None:
        while self.size:
            self._flush(min(BATCH, -(-self.size // self.length)))
        self.stream.close()
        self.file.close()
        self.index.close()


class Reader:
    """Sequences of a part file; those of a local file are views of the mapped file."""

    def __init__(self, url: str):
        fs, path = _filesystem(url)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.file = pa.memory_map(path) if local else fs.open_input_file(path)
        with fs.open_input_stream(path + ".idx") as f:
            index = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
        self.offsets, rows = index[:, 0], index[:, 1]
        self.first = np.concatenate(([0], np.cumsum(rows)))
        self.schema = pa.ipc.open_stream(self.file).schema

    def __len__(self) -> int:
        return int(self.first[-1])

    def batch(self, k: int) -> pa.RecordBatch:
        self.file.seek(int(self.offsets[k]))
        message = pa.ipc.read_message(self.file)
        if message.type == "schema":  # written together with the first batch
            message = pa.ipc.read_message(self.file)
        return pa.ipc.read_record_batch(message, self.schema)

    def __getitem__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``n``; the ids share the file's memory."""
        if not 0 <= n < len(self):
            raise IndexError(n)
        k = int(np.searchsorted(self.first, n, "right")) - 1
        row = self.batch(k).slice(n - int(self.first[k]), 1)
        return row["ids"].flatten().to_numpy(), row["mask"].flatten().to_numpy(zero_copy_only=False)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids with the end id) in order, put together again from the sequences."""
        rest: list[np.ndarray] = []
        for k in range(len(self.offsets)):
            batch = self.batch(k)
            ids = batch["ids"].flatten().to_numpy()
            ends = np.flatnonzero(batch["last"].flatten().to_numpy(zero_copy_only=False)) + 1
            start = 0
            for end, doc_id in zip(ends.tolist(), batch["doc_ids"].flatten().to_pylist()):
                yield doc_id, np.concatenate([*rest, ids[start:end]])
                rest, start = [], end
            tail = ids[start:][batch["mask"].flatten().to_numpy(zero_copy_only=False)[start:]]
            if len(tail):
                rest.append(tail.copy())


def write_sequences(
    docs: DataFrame, tokenizer: str, folder: str | None = None, id: str = "doc_id", text: str = "text", length: int = LENGTH
) -> list[tuple[str, int]]:
    """Write the ids of every whole text, each with the end id, in ascending ``id`` order; (url, tokens) of every part.

    Null and empty texts have the end id only; rows without an id come first, with a null in ``doc_ids``; rows of one id
    follow each other by a hash of their texts; an empty table gives no part. Only the two named columns are read. The
    texts are dealt out by ranges of ids and hashes, so that every task writes one part, and an id with many texts is
    spread over several.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder or f"{shared_folder(spark)}/sequences-{uuid.uuid4().hex}")
    source = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    order = ("id", "hash")
    ranged = source.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, writer, first, total = _units(tokenizer), None, None, 0
        for piece in slices(batches):
            for doc_id, place, body in zip(*(piece[c].to_pylist() for c in ("id", "hash", "text"))):
                if writer is None:
                    first, url = (doc_id, place), f"{folder}/part-{uuid.uuid4().hex}.arrows"
                    writer = Writer(url, units.type, length)
                ids = np.append(np.frombuffer(encode(body or "", units), units.type), units.type.type(END))
                writer.add(doc_id, ids)
                total += len(ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((url, *first, total), (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                ["url", "first", "hash", "tokens"],
            )

    # One row per part. Attempts that were repeated left files of other names, which no row refers to.
    parts = ranged.mapInArrow(run, "url string, first bigint, hash bigint, tokens bigint").collect()
    return [(p.url, p.tokens) for p in sorted(parts, key=lambda p: (p.first is not None, p.first or 0, p.hash))]


def read_documents(spark: SparkSession, parts: list[tuple[str, int]]) -> DataFrame:
    """Read part files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ``ids_crc32`` is the unsigned crc32 of the document's ids as little-endian 32-bit integers.
    """
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not parts:
        return spark.createDataFrame([], schema)
    starts = np.concatenate(([0], np.cumsum([n for _, n in parts])))[:-1].tolist()
    rows = [(url, start) for (url, _), start in zip(parts, starts)]
    files = spark.createDataFrame(rows, "url string, start bigint").repartition(len(rows), "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, at in zip(batch["url"].to_pylist(), batch["start"].to_pylist()):
                out: list[tuple[int, int, int, int]] = []
                for doc_id, ids in Reader(url).documents():
                    out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], pa.int64()) for k in range(4)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(run, schema)
