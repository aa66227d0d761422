"""Language identification by unigram piece models, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word (with the
blank before it) is the sum over all ways to cut it into pieces, computed by the forward algorithm; a text's
is the product over its words. Piece probabilities are trained by expectation-maximisation with the forward-backward
algorithm. A text is split into its distinct words per Arrow piece, so the forward algorithm runs once per word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import emptied, written
from .text import add_columns, slices, split_words, word_hashes

VOCABULARY = "piece_bpe_32k.model"
TRAIN_PER_LANG = 4_000  # documents, the bound of the training sample
LANGUAGES = 256  # the most frequent labels are learned; a model has a column of piece probabilities for each
ROUNDS = 4
UNDETERMINED = "und"
SHORT = 8  # bytes of pieces that fit into a 64-bit key
SLICE_BYTES = 2 << 20
LATTICE_BYTES = 256 << 10  # of distinct words whose lattices are in memory at once; one longer word goes alone
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@lru_cache(maxsize=2)
def pieces(path: str) -> list[np.ndarray]:
    """The vocabulary's pieces by length in bytes, from 1 to the longest: sorted 64-bit keys up to ``SHORT``, then sorted bytes.

    All single bytes are pieces too, so every text can be segmented. The mark of a word's start is a blank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            found.add(model.id_to_piece(k).replace("▁", " ").encode())
    out = []
    for n in range(1, max(map(len, found)) + 1):
        own = [p for p in found if len(p) == n]
        if n <= SHORT:
            out.append(np.array(sorted(int.from_bytes(p, "little") for p in own), np.uint64))
        else:
            out.append(np.array(sorted(own), f"S{n}"))
    return out


def piece_bytes(keys: list[np.ndarray]) -> list[bytes]:
    """All pieces in the order of their numbers."""
    short = [int(k).to_bytes(n + 1, "little") for n, own in enumerate(keys[:SHORT]) for k in own]
    return short + [bytes(p) for own in keys[SHORT:] for p in own]


def _tail(piece: bytes) -> int:
    """The key of the last ``SHORT`` bytes, as the lattice computes it."""
    return int.from_bytes(piece[-SHORT:], "little")


class Lattice:
    """All pieces inside a list of words: for every end position and length the piece's number, or none.

    Pieces of up to ``SHORT`` bytes are looked for everywhere, longer ones only where their last bytes are found.
    """

    def __init__(self, words: list[bytes], keys: list[np.ndarray]):
        order = np.argsort([-len(w) for w in words], kind="stable")
        self.order = order
        self.sizes = np.array([len(words[k]) for k in order], np.int64)
        text = np.frombuffer(b"".join(words[k] for k in order), np.uint8)
        wide = text.astype(np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(words)), self.sizes)
        self.total = sum(map(len, keys))
        place = np.arange(len(text)) - self.starts[self.row]  # of a piece's last byte in its word
        self.ids = np.full((SHORT, len(text)), self.total, np.int32)
        key = np.zeros(len(text), np.uint64)
        base = 0
        for n, known in enumerate(keys[:SHORT], 1):
            # The key of the last n bytes before each end: earlier bytes go below.
            here = np.flatnonzero(place >= n - 1)
            key[here] = (key[here] << np.uint64(8)) | wide[here - (n - 1)]
            if len(known) and len(here):
                at = np.minimum(np.searchsorted(known, key[here]), len(known) - 1)
                self.ids[n - 1, here] = np.where(known[at] == key[here], base + at, self.total)
            base += len(known)
        tails = np.array(sorted({_tail(bytes(p)) for own in keys[SHORT:] for p in own}), np.uint64)
        some = np.flatnonzero(place >= SHORT)
        if len(tails) and len(some):
            at = np.minimum(np.searchsorted(tails, key[some]), len(tails) - 1)
            some = some[tails[at] == key[some]]
        ends, lengths, ids = [], [], []
        for n, known in enumerate(keys[SHORT:], SHORT + 1):
            here = some[place[some] >= n - 1]
            if len(known) and len(here):
                body = np.ascontiguousarray(text[here[:, None] + np.arange(1 - n, 1)]).view(f"S{n}").ravel()
                at = np.minimum(np.searchsorted(known, body), len(known) - 1)
                hit = known[at] == body
                ends.append(here[hit])
                lengths.append(np.full(hit.sum(), n))
                ids.append(base + at[hit])
            base += len(known)
        empty = [np.empty(0, np.int64)]
        end, length, piece = (np.concatenate(x or empty) for x in (ends, lengths, ids))
        # Long pieces as arcs, by the place of their last byte.
        by_place = np.argsort(place[end], kind="stable")
        self.end, self.length, self.piece = end[by_place], length[by_place], piece[by_place]
        self.cuts = np.searchsorted(place[self.end], np.arange(int(self.sizes.max(initial=0)) + 1))

    def _long(self, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, lengths and numbers of the long pieces that end at place j of their words."""
        own = slice(self.cuts[j], self.cuts[j + 1])
        return self.row[self.end[own]], self.length[own], self.piece[own]

    def _first(self) -> np.ndarray:
        """Where the positions of every word begin, one before each byte and one behind the last."""
        return self.starts + np.arange(len(self.sizes))

    def prefixes(self, probability: np.ndarray) -> np.ndarray:
        """Natural log of the probability of every prefix of every word, by language (columns)."""
        langs = probability.shape[1]
        p = np.concatenate([probability, np.zeros((1, langs))])
        first = self._first()
        logs = np.zeros((len(self.row) + len(first), langs))
        ring = [np.zeros((len(self.sizes), langs)) for _ in range(SHORT)]  # of the last positions, newest first
        ring[0][:] = 1.0
        scale = np.zeros((len(self.sizes), langs))
        for j in range(int(self.sizes.max(initial=0))):
            active = int(np.searchsorted(-self.sizes, -j, "left"))  # words longer than j come first
            at = self.starts[:active] + j
            new = np.zeros((active, langs))
            for n in range(min(SHORT, j + 1)):
                new += ring[n][:active] * p[self.ids[n, at]]
            row, length, piece = self._long(j)
            if len(row):
                np.add.at(new, row, np.exp(logs[first[row] + j + 1 - length] - scale[row]) * p[piece])
            top = np.maximum(new, 1e-300)
            scale[:active] += np.log(top)
            logs[first[:active] + j + 1] = scale[:active]
            ring = [new / top] + [r[:active] / top for r in ring[: SHORT - 1]]
        return logs

    def suffixes(self, probability: np.ndarray) -> np.ndarray:
        """Natural log of the probability of every suffix of every word, in one language."""
        p = np.append(probability, 0.0)
        first = self._first()
        logs = np.zeros(len(self.row) + len(first))
        width = max(SHORT, int(self.length.max(initial=0)))
        # Sums for the positions j, j - 1, ...; words join when j comes to their last byte.
        open_ = np.zeros((width + 1, len(self.sizes)))
        scale = np.zeros(len(self.sizes))
        now, before = np.ones(len(self.sizes)), 0
        for j in range(int(self.sizes.max(initial=0)) - 1, -1, -1):
            active = int(np.searchsorted(-self.sizes, -j, "left"))
            now[before:active] = 1.0
            before = active
            top = np.maximum(now[:active], 1e-300)
            scale[:active] += np.log(top)
            open_[:, :active] /= top
            logs[first[:active] + j + 1] = scale[:active]
            at = self.starts[:active] + j
            for n in range(min(SHORT, j + 1)):
                open_[n, :active] += p[self.ids[n, at]]
            row, length, piece = self._long(j)
            if len(row):
                np.add.at(open_, (length - 1, row), p[piece])
            now[:active] = open_[0, :active]
            open_[:-1] = open_[1:]
            open_[-1] = 0.0
        return logs

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """Natural log of every word's probability (rows, in the order given) by language (columns)."""
        whole = self.prefixes(probability)[self._first() + self.sizes]
        out = np.empty_like(whole)
        out[self.order] = whole
        return out

    def expected(self, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in all segmentations of the words, each counted ``weight`` times."""
        first, p = self._first(), np.append(probability, 0.0)
        before, behind = self.prefixes(probability[:, None])[:, 0], self.suffixes(probability)
        whole, weight = before[first + self.sizes], weight[self.order]
        out = np.zeros(len(p))
        here = np.arange(len(self.row))
        arcs = [(here[ids != self.total], n + 1, ids[ids != self.total]) for n, ids in enumerate(self.ids)]
        for end, length, piece in [*arcs, (self.end, self.length, self.piece)]:
            row = self.row[end]
            behind_end = end + row + 1  # the position after the last byte
            share = np.exp(before[behind_end - length] + behind[behind_end] - whole[row])
            out += np.bincount(piece, share * p[piece] * weight[row], len(p))
        return out[:-1]


def blocks(words: list[bytes], size: int = LATTICE_BYTES) -> Iterator[slice]:
    """Consecutive parts of a list of words, of about ``size`` bytes each."""
    at = total = 0
    for k, word in enumerate(words):
        if total and total + len(word) > size:
            yield slice(at, k)
            at, total = k, 0
        total += len(word)
    if words:
        yield slice(at, len(words))


def marked(words: list[bytes]) -> list[bytes]:
    """Words as the models see them: lower case, with a blank before."""
    return [b" " + w.decode("utf-8", "replace").lower().encode() for w in words]


@dataclass(frozen=True)
class Model:
    """Piece probabilities by language (columns) and log shares of the languages in the training rows."""

    langs: tuple[str, ...]
    prior: np.ndarray
    probability: np.ndarray


def _sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """About ``per_lang`` rows of each language, chosen by a hash of the text."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(float(per_lang)) / F.col("n")
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    # One row per language: as small as the list of languages.
    return known.join(F.broadcast(counts), "lang").where(place < share).select("lang", "text")


def fit(
    docs: DataFrame, vocabulary: str, lang: str = "lang", text: str = "text", per_lang: int = TRAIN_PER_LANG, rounds: int = ROUNDS
) -> Model:
    """Train on a sample of about ``per_lang`` labelled rows of each language; rows with a null label or text are left out.

    The ``LANGUAGES`` most frequent labels are learned. The sample's words are counted and written once; every round is a job over these counts, and the driver holds the
    piece probabilities only (languages x vocabulary). Without labelled rows the model has no language.
    """
    keys = pieces(vocabulary)
    plain = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    known = plain.where("lang is not null and text is not null")
    shares = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()
    total = sum(r["count"] for r in shares)
    langs = tuple(sorted(r.lang for r in shares))
    size = sum(map(len, keys))
    if not langs:
        return Model((), np.zeros(0), np.zeros((size, 0)))
    prior = np.log([next(r["count"] for r in shares if r.lang == x) / total for x in langs])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, size=SLICE_BYTES):
            seen: Counter = Counter()
            for name, body in zip(piece["lang"].to_pylist(), piece["text"].cast(pa.binary()).to_pylist()):
                seen.update((name, w) for w in marked(body.split()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in seen], pa.string()),
                    pa.array([k[1] for k in seen], pa.binary()),
                    pa.array(list(seen.values()), pa.int64()),
                ],
                ["lang", "word", "n"],
            )

    used: list[str] = []
    counted = _sample(plain.where(F.col("lang").isin(*langs)), per_lang).mapInArrow(count, "lang string, word binary, n bigint")
    words = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words", used)
    floor = np.concatenate([np.full(len(k), 0.05 ** (n > 0)) for n, k in enumerate(keys)])
    probability = np.tile((floor / floor.sum())[:, None], (1, len(langs)))
    for _ in range(rounds):
        now = dict(zip(langs, probability.T))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {name: np.zeros(size) for name in now}
            for batch in batches:
                names = np.array(batch["lang"].to_pylist())
                body, n = batch["word"].to_pylist(), batch["n"].to_numpy().astype(float)
                for name in set(names.tolist()):
                    rows = np.flatnonzero(names == name)
                    own = [body[k] for k in rows]
                    for part in blocks(own):
                        sums[name] += Lattice(own[part], keys).expected(now[name], n[rows[part]])
            for name, s in sums.items():
                used_pieces = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(used_pieces)), pa.array(used_pieces), pa.array(s[used_pieces])],
                    ["lang", "piece", "n"],
                )

        sums = words.mapInArrow(expect, "lang string, piece bigint, n double")
        found = sums.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        new = np.full((size, len(langs)), 0.01)
        column = np.searchsorted(np.array(langs), np.array(found["lang"].to_pylist()))
        new[found["piece"].to_numpy(), column] += found["n"].to_numpy()
        probability = new / new.sum(0)
    for path in used:
        emptied(docs.sparkSession, path)
    return Model(langs, prior, probability)


def _has_letter(body: bytes) -> bool:
    return _ASCII_LETTER.search(body) is not None or any(c.isalpha() for c in body.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: Model, vocabulary: str, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the posterior probability of that language, from the text alone.

    A text that is null or has no letter, or any text under a model without languages, is ``und`` with score 0; ties go
    to the language that sorts first. Whole texts are read; a column of the same name is replaced; repeated rows are
    treated alike.
    """
    langs, keys = list(model.langs), pieces(vocabulary)
    prior, probability = model.prior, model.probability

    def task(piece: pa.RecordBatch) -> list[pa.Array]:
        texts = piece["text"].cast(pa.binary()).to_pylist()
        parts, sizes = split_words(texts, lower=False)
        letters = np.array([bool(b) and _has_letter(b) for b in texts], bool)
        names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total = int(sizes.sum())
        if langs and total:
            _, first, number = np.unique(word_hashes(parts, total), return_index=True, return_inverse=True)
            flat = [w for p in parts for w in p]
            # The distinct words, the longest first, so that those of one lattice are about equally long.
            distinct = marked([flat[k] for k in first])
            order = np.argsort([-len(w) for w in distinct], kind="stable")
            distinct = [distinct[k] for k in order]
            logs = np.empty((len(distinct), len(langs)))
            for part in blocks(distinct):
                logs[order[part]] = Lattice(distinct[part], keys).forward(probability)
            owner = np.repeat(np.arange(len(texts)), sizes)
            sums = np.stack([np.bincount(owner, logs[number, k], len(texts)) for k in range(len(langs))], 1) + prior
            best = sums.argmax(1)
            share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            for k in np.flatnonzero(letters):
                names[k], score[k] = langs[best[k]], share[k]
        return [pa.array(names, pa.string()), pa.array(score)]

    return add_columns(docs, task, "lang_pred string, score double", text, SLICE_BYTES)
