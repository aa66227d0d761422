"""Language-model scores by a probabilistic suffix tree over words.

A text is a sequence of words and one end. The tree's root holds the smoothed distribution of single tokens. A longer
context, up to ``DEPTH`` words before a token or back to the start of the text, is a candidate if it occurs ``EVIDENCE``
times or more in the training texts, and becomes a state if its next-token distribution diverges from that of the
context without its oldest word, or if a longer state needs it. Candidates are counted length by length, as a longer one is
a shorter one and a next token, so what cannot reach the count is not shuffled. For the same end a pass before each count
adds up the next tokens by hashed places: one that is counted often has a place whose sum is as large. A state keeps the next tokens that follow it ``LEAST`` times or more;
all others have the shorter context's distribution, scaled to the remaining probability. A token is scored in the state
of the longest suffix before it.

Both numbers are counts, not shares, so a context that was seen often enough stays a state however large the corpus is, and
the tree grows with it. It is therefore a pair of tables. As a next token of a context also follows the context's suffix, a
token's logarithm is the root's plus one term for each state before it: what the state adds where it keeps the
token, and the logarithm of its remaining share where it does not. Terms are looked up one by one: those of the most frequent states and next tokens
go to every task, ``HELD`` rows of each at most, and all others are found by a join. Words are looked up likewise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import emptied, written
from .text import mix, signed, slices, split_words, word_hashes

DEPTH = 3
EVIDENCE = 500  # occurrences of a context from which it is a candidate
LEAST = 25  # occurrences of a next token below which it tells nothing; at most EVIDENCE
GAIN = 10.0  # bits that a state saves at least over all its occurrences
DISCOUNT = 0.5
SMOOTH = 0.1
SLICE_TOKENS = 1 << 18  # words of one numpy step of a task (one longer text goes alone)
SPLIT_BYTES = 1 << 20  # the same of texts that are split, whose words are objects
SCORE_TOKENS = 1 << 17  # the same while scoring, which keeps more arrays
HELD = 1 << 20  # words, states and next tokens of which each task holds at most so many
BITS = 26  # a filter of keys has two to the power of this many bits
PART = 16  # places are added up in parts of two to the power of this many
GATHERED = 1 << 21  # places of which a task adds up so many at a time
PLACES = 29  # a filter of places has two to the power of at most so many, one for about four tokens
_GOLD = np.uint64(0x9E3779B97F4A7C15)
# White space is no word, so these hashes stand for the two ends of a text.
_END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
_START = np.uint64(xxhash.xxh64_intdigest(b" "))
# Of tokens and their places: contexts and next tokens, one each for every occurrence.
Following = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def tokens(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and the place of each in its text."""
    whole = sizes + 1
    out = np.full(int(whole.sum()), _END, np.uint64)
    place = np.arange(len(out)) - np.repeat(np.cumsum(whole) - whole, whole)
    out[place < np.repeat(sizes, whole)] = words
    return out, place


def context_keys(token: np.ndarray, place: np.ndarray, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``depth`` words of context: which tokens have that many before them, and the contexts' keys.

    The start of the text counts as a word. The key of a context is made from that of its suffix.
    """
    out = []
    here, key = np.arange(len(token)), np.zeros(len(token), np.uint64)
    for d in range(1, depth + 1):
        here, key = _longer(token, place, here, key, d)
        out.append((here, key))
    return out


def _longer(token: np.ndarray, place: np.ndarray, here: np.ndarray, key: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the tokens ``here`` have d words before them, and the keys of these, given those of one word less."""
    whole = place[here] >= d - 1
    here, key = here[whole], key[whole]
    before = token[here - d]  # of another text, or none, where the start comes instead
    return here, mix(key + _GOLD ^ np.where(place[here] == d - 1, _START, before))


def pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The key of a next token of a context; both are hashes already."""
    return context ^ token


class Bits:
    """A filter of keys in a fixed number of bits: one that is there is always found, some others are too."""

    def __init__(self, rows: DataFrame, key: str):
        place = F.pmod(F.col(key), F.lit(1 << BITS)) + 1
        parts = rows.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
        )
        found = parts.collect()
        self.bits = np.zeros((1 << BITS) // 8 if found else 0, np.uint8)
        for part, bits in found:
            at = (part - 1) * len(bits)
            own = np.frombuffer(bits, np.uint8)[: len(self.bits) - at]
            self.bits[at : at + len(own)] = own

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.bits):
            return np.zeros(len(keys), bool)
        place = keys & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Often(Bits):
    """A filter of next tokens of contexts: one that follows its context ``LEAST`` times or more is always found."""

    def __init__(self, source: DataFrame, following: Following, total: int):
        """``following`` gives contexts and next tokens for (tokens, places); ``total`` is the number of tokens."""
        width = min(PLACES, max(PART, (total // 4).bit_length()))
        # Sums are compared with the count only, so larger ones need no room.
        most = min(LEAST, 255)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gathered, size = [], 0
            for _, _, token, place in _pieces(batches):
                at = pair(*following(token, place)) & np.uint64((1 << width) - 1)
                gathered.append(at.astype(np.uint32))
                size += len(at)
                if size >= GATHERED:
                    yield packed(gathered)
                    gathered, size = [], 0
            yield packed(gathered)

        def packed(gathered: list[np.ndarray]) -> pa.RecordBatch:
            at, n = np.unique(np.concatenate([np.empty(0, np.uint32), *gathered]), return_counts=True)
            part, first = np.unique(at >> np.uint32(PART), return_index=True)
            gap = np.diff(at, prepend=np.uint32(0))
            gap[first] = at[first] & np.uint32((1 << PART) - 1)
            # A gap is as many bytes of 255 as it holds, and one of what is left.
            ends = np.cumsum(gap // 255 + 1)
            gaps = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
            gaps[ends - 1] = gap % 255
            bounds = np.append(first, len(at))
            columns = ((gaps, np.append(0, ends)[bounds]), (np.minimum(n, most).astype(np.uint8), bounds))
            binary = [
                pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(c)])
                for c, at in columns
            ]
            return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *binary], ["part", "gaps", "n"])

        def summed(group: pa.Table) -> pa.Table:
            sums = np.zeros(1 << PART)
            for gaps, n in zip(group["gaps"].to_pylist(), group["n"].to_pylist()):
                steps = np.frombuffer(gaps, np.uint8)
                at = np.cumsum(steps, dtype=np.int64)[steps < 255]
                sums[at] += np.frombuffer(n, np.uint8)  # a row has every place once
            bits = np.packbits(sums >= most, bitorder="little").tobytes()
            return pa.table({"part": group["part"].slice(0, 1), "bits": pa.array([bits], pa.binary())})

        rows = source.select("tokens").mapInArrow(places, "part int, gaps binary, n binary")
        self.bits = np.zeros((1 << width) // 8, np.uint8)
        size = (1 << PART) // 8
        for part, bits in rows.groupBy("part").applyInArrow(summed, "part int, bits binary").collect():
            self.bits[part * size : (part + 1) * size] = np.frombuffer(bits, np.uint8)


class Held:
    """Values by key as sorted arrays, found by the first bits of the keys, which are hashes."""

    def __init__(self, rows: pa.Table, key: str):
        keys = _unsigned(rows, key)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], rows["value"].to_numpy()[order].astype(np.float64)
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of keys, 0 where they are not held, and which are."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        last = len(self.keys) - 1
        at = np.minimum(self.starts[keys >> self.shift], last)
        below = np.flatnonzero(self.keys[at] < keys)
        while len(below):
            at[below] += 1
            below = below[at[below] <= last]
            below = below[self.keys[at[below]] < keys[below]]
        at = np.minimum(at, last)
        known = self.keys[at] == keys
        return np.where(known, self.values[at], 0.0), known


def hold(rows: DataFrame, key: str, value: Column) -> tuple[Held, DataFrame | None]:
    """The values of the rows of the highest counts ``n``, at most ``HELD``, and a table of all others, if any.

    Counts are cut at a power of the fourth root of two, which a histogram of few rows finds.
    """
    level = F.floor(4 * F.log2("n"))
    cut, room = 0, HELD
    for at, n in sorted(rows.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= n
        if room < 0:
            cut = at + 1
            break
    named = rows.withColumn("level", level).select(key, value.alias("value"), "level")
    held = Held(named.where(F.col("level") >= cut).select(key, "value").toArrow(), key)
    return held, named.where(F.col("level") < cut).drop("level") if room < 0 else None


def _walk(
    token: np.ndarray, place: np.ndarray, states: Held, entries: Held, more_states: Bits | None, more_entries: Bits | None
) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """What the states before each token add to its logarithm, and (tokens, state, next token's key, rest) to look up.

    A rest of NaN is to be looked up, too. A state's suffix is a state, and a next token of a state is one of its suffix,
    so what is not found for a context is not looked for in longer ones.
    """
    gathered, open_ = np.zeros(len(token)), []
    here, key = np.arange(len(token)), np.zeros(len(token), np.uint64)
    likely = np.ones(len(token), bool)  # whether the shorter context keeps the token, or may
    for d in range(1, DEPTH + 1):
        here, key = _longer(token, place, here, key, d)
        rest, known = states.find(key)
        state = known if more_states is None else known | more_states.has(key)
        here, key, rest, known = here[state], key[state], rest[state], known[state]
        both = pair(key, token[here])
        asked = likely[here]
        adds, kept, far = np.zeros(len(here)), np.zeros(len(here), bool), np.zeros(len(here), bool)
        adds[asked], kept[asked] = entries.find(both[asked])
        if more_entries is not None:
            far[asked] = more_entries.has(both[asked])
        likely[here] = kept | far
        unsure = (~known | far) & ~kept
        gathered[here] += np.where(unsure, 0.0, np.where(kept, adds, rest))
        if unsure.any():
            open_.append((here[unsure], key[unsure], both[unsure], np.where(known, rest, np.nan)[unsure]))
    return gathered, open_


def _tokenised(source: DataFrame) -> DataFrame:
    """(doc_id, train, tokens) with the hashes of the words of every text; the ends are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, size=SPLIT_BYTES):
            parts, sizes = split_words(piece["text"].cast(pa.binary()).to_pylist())
            flat = pa.array(signed(word_hashes(parts, int(sizes.sum()))))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
            yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["train"], lists], ["doc_id", "train", "tokens"])

    return source.mapInArrow(run, "doc_id bigint, train boolean, tokens array<bigint>")


def _pieces(
    batches: Iterator[pa.RecordBatch], size: int = SLICE_TOKENS
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Arrow batches in slices of about ``size`` tokens: the rows, how many words each has, and ``tokens`` of them."""
    for batch in batches:
        sizes = np.diff(batch["tokens"].offsets.to_numpy()).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            piece = batch.slice(at, stop - at)
            words = piece["tokens"].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            yield piece, sizes[at:stop], *tokens(words, sizes[at:stop])
            at = stop


def _counted(source: DataFrame, keys) -> DataFrame:
    """Sums over all texts of what ``keys`` gives for (tokens, places): one row per array of names and key columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, token, place in _pieces(batches):
            for depth, key, following in keys(token, place):
                both = key if following is None else pair(key, following)
                _, first, number = np.unique(both, return_index=True, return_inverse=True)
                zero = np.zeros(len(first), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(first), depth, np.int32)),
                        pa.array(signed(key[first])),
                        pa.array(zero if following is None else signed(following[first])),
                        pa.array(np.bincount(number, minlength=len(first))),
                    ],
                    ["depth", "key", "next", "n"],
                )

    rows = source.select("tokens").mapInArrow(run, "depth int, key bigint, next bigint, n bigint")
    return rows.groupBy("depth", "key", "next").agg(F.sum("n").alias("n"))


def _unsigned(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(np.int64).view(np.uint64)


def _contexts(token: np.ndarray, place: np.ndarray, depth: int, longer: Bits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of one length that may have the evidence: the tokens after them, their keys, and their suffixes.

    A context of enough evidence is a shorter one and its next token of as much evidence, in ``longer``; for single words it
    holds words.
    """
    keys = context_keys(token, place, depth)
    here, key = keys[-1]
    shorter = np.zeros(len(token), np.uint64)
    if depth > 1:
        shorter[keys[-2][0]] = keys[-2][1]
        good = longer.has(pair(shorter[here - 1], token[here - 1]))
    else:
        good = longer.has(token[here - 1]) | (place[here] == 0)
    return token[here[good]], key[good], shorter[here[good]]


def _following(depth: int, longer: Bits, likely: Bits) -> Following:
    """Contexts of one length and their next tokens; these are next tokens of the context's suffix, too, in ``likely``."""

    def rows(token: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after, key, suffix = _contexts(token, place, depth, longer)
        good = likely.has(pair(suffix, after))
        return key[good], after[good]

    return rows


def _level(depth: int, longer: Bits, likely: Bits, often: Bits):
    """Keys to count for contexts of one length: the contexts (depth negative) with their suffixes, and their next tokens.

    Next tokens are those of ``_following`` that are in ``often``.
    """

    def rows(token: np.ndarray, place: np.ndarray):
        after, key, suffix = _contexts(token, place, depth, longer)
        yield -depth, key, suffix
        good = likely.has(pair(suffix, after))
        key, after = key[good], after[good]
        good = often.has(pair(key, after))
        yield depth, key[good], after[good]

    return rows


def train_tree(source: DataFrame, vocabulary: DataFrame, total: int, distinct: int, used: list[str]) -> tuple[DataFrame, DataFrame]:
    """The tree of the column ``tokens``, given its vocabulary (hash, n) and the numbers of tokens and distinct tokens.

    States are (key, n, rest), next tokens (pair, n, adds); ``rest`` and ``adds`` are logarithms to base 10. Their files
    are added to ``used``.
    """
    own: list[str] = []
    # Filters may let more through, which the counts sort out.
    longer = Bits(vocabulary.where(F.col("n") >= EVIDENCE), "hash")
    likely = Bits(vocabulary.where(F.col("n") >= LEAST), "hash")
    candidates, pairs = [], []
    for depth in range(1, DEPTH + 1):
        often = Often(source, _following(depth, longer, likely), total)
        level = _counted(source, _level(depth, longer, likely, often)).where(F.col("n") >= F.when(F.col("depth") < 0, EVIDENCE).otherwise(LEAST))
        level = written(level, "lm-level", own)
        some = level.where("depth < 0").select(
            F.lit(depth).alias("depth"), "key", F.col("next").alias("suffix"), F.col("n").alias("times")
        )
        candidates.append(some)
        p = (F.col("n") - DISCOUNT) / F.col("times")
        found = level.where("depth > 0").select("key", "next", "n").join(some, "key").withColumn("p", p)
        pairs.append(written(found.withColumn("pair", F.col("key").bitwiseXOR(F.col("next"))), "lm-pairs", own))
        longer, likely = Bits(pairs[-1].where(F.col("n") >= EVIDENCE), "pair"), Bits(pairs[-1], "pair")
    candidates, pairs = reduce(DataFrame.unionByName, candidates), reduce(DataFrame.unionByName, pairs)
    # A next token of a context follows the context's suffix at least as often, so its shorter form is there.
    suffixes = pairs.where(F.col("depth") < DEPTH).select(F.col("key").alias("suffix"), "next", F.col("p").alias("before"))
    alone = vocabulary.select(
        F.col("hash").alias("next"), ((F.col("n") + SMOOTH) / (total + SMOOTH * (distinct + 1))).alias("before")
    )
    long_, short = pairs.where("depth > 1").join(suffixes, ["suffix", "next"]), pairs.where("depth = 1").join(alone, "next")
    pairs = written(long_.unionByName(short).select("key", "pair", "n", "p", "before"), "lm-next", own)
    sums = pairs.groupBy("key").agg(
        F.sum("p").alias("p"),
        F.sum("before").alias("before"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.log2(F.col("p") / F.col("before"))).alias("saved"),
    )
    rest = (1 - F.col("p")) / F.greatest(1 - F.col("before"), F.lit(1e-9))
    gain = F.col("saved") + (F.col("times") - F.col("n")) * F.log2(F.greatest("rest", F.lit(1e-9)))
    grown = candidates.join(sums, "key").withColumn("rest", rest).withColumn("gain", gain)
    grown = written(grown.select("depth", "key", "suffix", "times", "rest", "gain"), "lm-grown", own)
    kept = None
    for depth in range(DEPTH, 0, -1):
        level = grown.where(F.col("depth") == depth)
        if kept is not None:
            needed = kept.where(F.col("depth") == depth + 1).select(F.col("suffix").alias("key"), F.lit(True).alias("needed")).distinct()
            level = level.join(needed, "key", "left").where((F.col("gain") >= GAIN) | F.col("needed")).drop("needed")
        else:
            level = level.where(F.col("gain") >= GAIN)
        kept = level if kept is None else kept.unionByName(level)
    log = F.log10(F.greatest("rest", F.lit(1e-9)))
    states = written(kept.select("key", F.col("times").alias("n"), log.alias("rest")), "lm-states", used)
    entries = pairs.join(states.select("key"), "key", "left_semi").select(
        "pair", "n", F.log10(F.col("p") / F.col("before")).alias("adds")
    )
    entries = written(entries, "lm-entries", used)
    for path in own:
        emptied(source.sparkSession, path)
    return states, entries


def _vocabulary(source: DataFrame) -> DataFrame:
    def each(token: np.ndarray, place: np.ndarray):
        yield 0, token, None

    return _counted(source, each).select(F.col("key").alias("hash"), "n")


def _by_text(texts: int, owner: np.ndarray, hashes: np.ndarray, more: dict[str, pa.Array]) -> pa.ListArray:
    """For every text its distinct hashes, how often each occurs, and what ``more`` says of them."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    items = {"hash": pa.array(signed(hashes[first])), "times": pa.array(np.diff(np.append(first, len(hashes))).astype(np.int32))}
    items |= {name: values.take(pa.array(order[first])) for name, values in more.items()}
    offsets = np.searchsorted(owner[first], np.arange(texts + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(items.values()), list(items)))


def score(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``train`` says which rows to learn from (null: not). Tokens are the words, with A-Z lower-cased, and one end; ``n_known``
    counts those that occur in training rows, ``train_tokens`` all of these rows. ``base_score`` is the log10 probability
    under single tokens with 0.1 added to every count, ``score`` the tree's. Null and empty texts have the end only; without
    training rows no token is known and the tree is its root; repeated rows are scored each. Words are told apart by
    64-bit hashes. Whole texts are read.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(f"`{id}`").cast("bigint").alias("doc_id"),
        F.col(f"`{text}`").cast("string").alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    # Texts are split and hashed once; all later passes read the hashes.
    used: list[str] = []
    source = written(_tokenised(source), "lm-tokens", used)
    learn = source.where("train")
    vocabulary = written(_vocabulary(learn), "lm-vocabulary")
    sums = vocabulary.agg(F.sum("n"), F.count("n")).first()
    total, distinct = sums[0] or 0, sums[1]
    states, entries = train_tree(learn, vocabulary, total, distinct, used)
    below = float(np.log10(total + SMOOTH * (distinct + 1)))
    alone, _ = hold(vocabulary, "hash", F.log10(F.col("n") + SMOOTH) - below)
    states, other_states = hold(states, "key", F.col("rest"))
    entries, other_entries = hold(entries, "pair", F.col("adds"))
    more_states = None if other_states is None else Bits(other_states, "key")
    more_entries = None if other_entries is None else Bits(other_entries, "pair")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for piece, sizes, token, place in _pieces(batches, SCORE_TOKENS):
            texts = len(sizes)
            owner = np.repeat(np.arange(texts), sizes + 1)
            add = lambda values: np.bincount(owner, values, texts)
            gathered, open_ = _walk(token, place, states, entries, more_states, more_entries)
            base, known = alone.find(token)
            rare = _by_text(texts, owner[~known], token[~known], {})
            columns = [np.concatenate(c) for c in zip(*open_)] or [np.empty(0, np.int64), *[np.empty(0, np.uint64)] * 2, np.empty(0)]
            at, key, both, rest = columns
            far = _by_text(texts, owner[at], both, {"key": pa.array(signed(key)), "rest": pa.array(rest, from_pandas=True)})
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(texts)),
                    piece["doc_id"],
                    piece["train"],
                    pa.array(sizes + 1),
                    pa.array(add(known).astype(np.int64)),
                    pa.array(add(base)),
                    pa.array(add(gathered)),
                    rare,
                    far,
                ],
                ["row", "doc_id", "train", "n_tokens", "n_known", "base_score", "gathered", "rare", "far"],
            )
            row += texts

    schema = (
        "row bigint, doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, gathered double, "
        "rare array<struct<hash:bigint,times:int>>, far array<struct<hash:bigint,times:int,key:bigint,rest:double>>"
    )
    partial = written(source.mapInArrow(look_up, schema), "lm-partial")
    each = lambda name: partial.select("row", F.explode(name).alias("r")).select("row", "r.*")
    log = F.log10(F.coalesce("n", F.lit(0)) + SMOOTH) - below
    found = each("rare").join(vocabulary, "hash", "left").select(
        "row",
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("k"),
        (F.col("times") * log).alias("b"),
        F.lit(0.0).alias("s"),
    )
    if more_states is not None or more_entries is not None:
        far = each("far")
        if other_states is not None:
            # Rows whose state was held bring its rest along.
            left = other_states.withColumnRenamed("value", "left")
            asked = far.where(F.col("rest").isNull()).join(left, "key", "left").withColumn("rest", F.col("left")).drop("left")
            far = far.where(F.col("rest").isNotNull()).unionByName(asked)
        if other_entries is not None:
            far = far.join(other_entries.withColumnsRenamed({"pair": "hash", "value": "adds"}), "hash", "left")
        else:
            far = far.withColumn("adds", F.lit(None).cast("double"))
        value = F.coalesce("adds", "rest", F.lit(0.0))
        far = far.select("row", F.lit(0).alias("k"), F.lit(0.0).alias("b"), (F.col("times") * value).alias("s"))
        found = found.unionByName(far)
    rest = found.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    more = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    emptied(spark, used[0])  # the hashes, the largest of all
    return partial.join(rest, "row", "left").withColumn("base_score", more("base_score", "b", 0.0)).select(
        "doc_id",
        "train",
        "n_tokens",
        more("n_known", "k", 0).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        "base_score",
        (F.col("base_score") + more("gathered", "s", 0.0)).alias("score"),
    )
