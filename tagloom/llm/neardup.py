"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and connected components.

SuperMinHash gives every element one random slot per level from a permutation of its own, with the values of level j
between j and j + 1; a signature slot is the least value it gets. Within a level the slots of an element differ, which
lowers the variance against independent hashes, and a document is finished at the first level that
leaves no slot empty: longer ones after one or two levels.

Documents with the same shingle set form one class, and only one member of a class goes on. Bands of the signature put
classes into buckets. Within a bucket not all pairs are compared: all members are verified against one leader per
round, linked ones join a component, and only pairs between different components remain. These are compared as well, so no
link that could join two components is lost. Every link is verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import emptied, written
from .text import mix, shingle_hashes, signed, slices, split_words, word_hashes

WIDTH = 5  # words of a shingle
SIMILAR = 75  # percent of the union that the intersection has at least
# Two sets of similarity 0.75 share no bucket with probability (1 - 0.75^7)^60 = 0.0002; two that share a passage and have
# a similarity of 0.3 share one with 0.013.
ROWS = 7
BANDS = 60
STAR_ROUNDS = 3
BLOCK = 256  # documents of a block, and the size from which a component is compared in blocks
_SWAPS = 24  # levels up to which the swaps of a permutation are kept rather than the whole of it
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def signatures(elements: np.ndarray, owner: np.ndarray, n: int, slots: int) -> np.ndarray:
    """SuperMinHash signatures of ``n`` sets; a value holds the level in its upper and the random part in its lower half."""
    out = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    state = elements.copy()
    # The permutation of every element is a Fisher-Yates shuffle of which only the swaps so far are kept: at level t
    # places t and k_t were swapped, and place t held c_t before.
    swaps: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(slots):
        if not len(state):
            break
        if level == _SWAPS:
            # Only small sets get this far; their permutations are kept in full from here on.
            rows = np.arange(len(state))
            order = np.tile(np.arange(slots, dtype=np.int16), (len(state), 1))
            for t, (k, content) in enumerate(swaps):
                order[rows, t], order[rows, k] = order[rows, k], content
            swaps = []
        state = state + _GOLD
        random = mix(state)
        k = level + (((random & _LOW) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int16)
        if level < _SWAPS:
            slot, held = k, np.full(len(k), level, np.int16)
            for before, content in swaps:
                slot = np.where(before == k, content, slot)
                held = np.where(before == level, content, held)
            swaps.append((k, held))
        else:
            slot = order[rows, k]
            order[rows, k] = order[:, level]
        value = (random >> np.uint64(32)) | np.uint64(level << 32)
        np.minimum.at(out, owner * slots + slot, value)
        # Later levels have greater values, so a set whose slots are all filled is finished.
        open_sets = out.reshape(n, slots).max(1) >= np.uint64((level + 1) << 32)
        left = open_sets[owner]
        if not left.all():
            state, owner = state[left], owner[left]
            swaps = [(a[left], b[left]) for a, b in swaps]
            if level >= _SWAPS:
                order, rows = order[left], np.arange(len(state))
    return out.reshape(n, slots)


def band_hashes(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One hash per set and band, different for every band."""
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64) * _GOLD
        for k in range(b * rows, (b + 1) * rows):
            h = mix(h ^ signature[:, k]) + _GOLD
        out[:, b] = h
    return out


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of every text as sorted 64-bit hashes."""
    parts, sizes = split_words(texts)
    shingles, owner = shingle_hashes(word_hashes(parts, int(sizes.sum())), sizes, width)
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1] if len(texts) else []
    return [np.unique(s) for s in np.split(shingles, ends)][: len(texts)]


def _describe(width: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            sets = shingle_sets(piece["text"].cast(pa.binary()).to_pylist(), width)
            sizes = np.array([len(s) for s in sets], np.int64)
            elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            owner = np.repeat(np.arange(len(sets)), sizes)
            bucket = signed(band_hashes(signatures(elements, owner, len(sets), rows * bands), rows, bands))
            # A set is known by two sums over its elements, 128 bits together.
            sums = []
            for salt in (_GOLD, _GOLD << np.uint64(1)):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(elements + salt), dtype=np.uint64)))
                ends = np.cumsum(sizes)
                sums.append(signed(total[ends] - total[ends - sizes]))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(bucket.reshape(-1))
            )
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"], pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), lists],
                ["doc_id", "n_shingles", "f1", "f2", "bands"],
            )

    return run


def _compare(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.empty(0, np.uint64)
        for piece in slices(batches):
            leads, texts = piece["a"].to_pylist(), piece["a_text"].cast(pa.binary())
            sets = shingle_sets(piece["text"].cast(pa.binary()).to_pylist(), width)
            both = np.empty(len(sets), np.int64)
            either = np.empty(len(sets), np.int64)
            for k, own in enumerate(sets):
                key = (leads[k], texts[k])
                if key != last:  # rows of a leader follow each other
                    last, known = key, shingle_sets([texts[k].as_py()], width)[0]
                both[k] = len(np.intersect1d(known, own, assume_unique=True))
                either[k] = len(known) + len(own) - both[k]
            yield pa.RecordBatch.from_arrays(
                [piece["a"], piece["b"], pa.array(both), pa.array(either)], ["a", "b", "n_both", "n_either"]
            )

    return run


def _shingles(width: int):
    """All shingles of every text, with the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            sets = shingle_sets(piece["text"].cast(pa.binary()).to_pylist(), width)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(piece["b"].to_numpy(), sizes)),
                    pa.array(np.repeat(sizes, sizes)),
                    pa.array(signed(np.concatenate(sets))),
                ],
                ["rep", "n", "shingle"],
            )

    return run


def _links_in_block(similar: int):
    """Linked pairs between two blocks of documents, each with its size and the shingles it has in common with others."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = right["shared"].to_pylist()
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        flat = np.array([h for x in sets for h in x], np.int64)
        order = np.argsort(flat)
        flat, owner = flat[order], owner[order]
        sizes, names = right["n"].to_numpy(), right["rep"].to_numpy()
        out = []
        for rep, n, own in zip(left["rep"].to_pylist(), left["n"].to_pylist(), left["shared"].to_pylist()):
            own = np.array(own, np.int64)
            low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            times = high - low
            at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            both = np.bincount(owner[at], minlength=len(sets))
            either = n + sizes - both
            for k in np.flatnonzero(100 * both >= similar * either).tolist():
                out.append((rep, int(names[k]), int(both[k]), int(either[k])))
        columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(4)]
        return pa.Table.from_arrays(columns, ["a", "b", "n_both", "n_either"])

    return run


class _Scratch:
    """Written tables of one call; all but the result are emptied at the end."""

    def __init__(self, spark):
        self.spark, self.tables = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        paths: list[str] = []
        table = written(df, f"neardup-{name}", paths)
        self.tables.append((table, paths[0]))
        return table

    def close(self, *but: DataFrame) -> None:
        for table, path in self.tables:
            if not any(table is x for x in but):
                emptied(self.spark, path)


def components(edges: DataFrame, scratch: _Scratch) -> DataFrame:
    """(node, component): the smallest node each node of ``edges`` (a, b) is connected with.

    Alternates two star operations, which only need the minimum of a node's neighbours (combined before the shuffle)
    and end after a number of rounds logarithmic in the longest chain.
    """
    sign = lambda df: df.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (state := sign(now)) != before:
        before = state
        # Large star: every greater neighbour of a node is linked to the least in the node's neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its lesser neighbours are linked to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch.keep(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rows: int = ROWS, bands: int = BANDS, similar: int = SIMILAR
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: its set size, the smallest id it is linked with, and
    whether that is its own.

    Two texts are linked if their sets of distinct word shingles (A-Z lower-cased) share ``similar`` percent of the union
    or more. A text of fewer words than a shingle is one shingle; one that is null or has no word has none and is linked
    with nothing. Rows of the same text are in one group, repeated rows included; of repeated rows all or none are kept.
    Rows that share an id but not the text are judged by their own texts, unless that id leads both groups. A row whose id
    is null never leads and is not kept if it has copies. Only the two named columns are read.
    """
    spark = docs.sparkSession
    scratch = _Scratch(spark)
    source = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    described = source.mapInArrow(
        _describe(WIDTH, rows, bands), "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>"
    )
    described = scratch.keep(described, "described")
    sets = described.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(
        sets.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes"
    )
    exploded = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("rep").alias("members")).where("members > 1").select("bucket")
    members = scratch.keep(exploded.join(shared, "bucket"), "members")
    texts = scratch.keep(
        source.withColumnRenamed("doc_id", "b").join(members.select(F.col("rep").alias("b")).distinct(), "b", "left_semi"),
        "texts",
    )

    def verified(pairs: DataFrame) -> DataFrame:
        """Sizes of intersection and union for pairs (a, b); a leader's text is joined last and so never multiplied on disk."""
        found = pairs.join(texts, "b").join(texts.select(F.col("b").alias("a"), F.col("text").alias("a_text")), "a")
        return found.mapInArrow(_compare(WIDTH), "a bigint, b bigint, n_both bigint, n_either bigint")

    linked = f"100 * n_both >= {similar} * n_either"
    tested: DataFrame | None = None
    labels: DataFrame | None = None

    def labelled() -> DataFrame:
        if labels is None:
            return members.withColumn("component", F.col("rep"))
        named = labels.withColumnRenamed("node", "rep")
        return members.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    for turn in range(STAR_ROUNDS):
        now = scratch.keep(labelled(), "labelled")
        # Per bucket its largest component, and a random member of that as the leader of this round.
        parts = now.groupBy("bucket", "component").agg(
            F.count("rep").alias("k"), F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep")).alias("lead")
        )
        buckets = parts.groupBy("bucket").agg(
            F.count("k").alias("n_parts"),
            F.max(F.struct("k", "component")).getField("component").alias("largest"),
            F.max(F.struct("k", "component", "lead")).getField("lead").getField("rep").alias("lead"),
        )
        mixed = scratch.keep(buckets.where("n_parts > 1"), "mixed")
        if mixed.isEmpty():
            break
        pairs = (
            now.join(mixed.select("bucket", "lead", "largest"), "bucket")
            .where("rep <> lead and component <> largest")
            .select(F.col("lead").alias("a"), F.col("rep").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        new = scratch.keep(verified(pairs), "verified")
        tested = new if tested is None else tested.unionByName(new)
        if new.isEmpty():
            break
        labels = components(tested.where(linked), scratch)

    if tested is not None:
        # Documents of buckets that still hold several components. Of a similar pair, each has most of its shingles in
        # other documents too, and they share one of the rarest of these: only such pairs are left. Passages that many
        # documents have in common make none.
        now = labelled()
        mixed = now.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
        left = now.join(mixed.select("bucket"), "bucket", "left_semi").select("rep", "component").distinct()
        left = scratch.keep(left, "left")
        bodies = texts.join(left.select(F.col("rep").alias("b")), "b", "left_semi")
        own = scratch.keep(bodies.mapInArrow(_shingles(WIDTH), "rep bigint, n bigint, shingle bigint"), "shingles")
        often = own.groupBy("shingle").agg(F.count("rep").alias("times")).where("times > 1")
        sets = (
            own.join(often, "shingle")
            .groupBy("rep", "n")
            .agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("shared"))
            .withColumn("s", F.size("shared"))
            .withColumn("need", F.ceil(F.col("n") * similar / 100).cast("int"))
            .where("s >= need")
            .select("rep", "n", "s", "need", F.col("shared.shingle").alias("shared"))
            .join(left, "rep")
        )
        sets = scratch.keep(sets, "sets")
        rare = sets.select("rep", "n", "s", "component", F.explode(F.expr("slice(shared, 1, s - need + 1)")).alias("shingle"))
        rare = scratch.keep(rare, "rare")
        parts = rare.groupBy("shingle", "component").agg(F.count("rep").alias("k"))
        several = parts.groupBy("shingle").agg(
            F.max(F.struct("k", "component")).getField("component").alias("largest"), F.count("k").alias("n_parts")
        )
        large = scratch.keep(
            left.groupBy(F.col("component").alias("largest")).agg(F.count("rep").alias("size")).where(F.col("size") >= BLOCK), "large"
        )
        several = several.where("n_parts > 1").join(large.withColumn("big", F.lit(True)), "largest", "left")
        both = scratch.keep(rare.join(several.select("shingle", "largest", "big"), "shingle"), "both")
        other = both.where("component <> largest").select(
            "shingle",
            F.col("rep").alias("a"),
            F.col("n").alias("a_n"),
            F.col("s").alias("a_s"),
            F.col("component").alias("a_part"),
        )
        # A document outside a large component is compared with all of it, block by block; rows of this are only the
        # documents repeated for every block of the other side.
        against = both.where("big and component <> largest").select("rep", "largest").distinct()
        asked = against.groupBy("largest").agg(F.count("rep").alias("asks")).join(large, "largest")
        blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        of = lambda n: F.pmod(F.xxhash64("rep"), blocks(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
        data = ("largest", "x", "y", "rep", "n", "shared")
        one = against.join(asked, "largest").join(sets.drop("component"), "rep").withColumn("x", of("asks"))
        two = sets.withColumnRenamed("component", "largest").join(asked, "largest").withColumn("y", of("size"))
        grouped = [
            df.select(*(F.col(c).alias(c) for c in data)).groupBy("largest", "x", "y")
            for df in (one.withColumn("y", every("size")), two.withColumn("x", every("asks")))
        ]
        blocked = grouped[0].cogroup(grouped[1]).applyInArrow(
            _links_in_block(similar), "a bigint, b bigint, n_both bigint, n_either bigint"
        )
        blocked = scratch.keep(blocked, "blocked")
        # Pairs at shingles without a large component, and pairs that touch neither it nor each other's component, each
        # once, whose sizes and shared shingles allow the similarity.
        rest = (
            other.join(both, "shingle")
            .where("a_part <> component and ((component = largest and big is null) or (component <> largest and a < rep))")
            .where(f"{100 + similar} * least(a_s, s) >= {similar} * (a_n + n)")
            .select("a", F.col("rep").alias("b"))
            .distinct()
        )
        known = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        new = scratch.keep(verified(rest.join(known, ["a", "b"], "left_anti")), "verified")
        labels = components(tested.unionByName(new).unionByName(blocked).where(linked), scratch)
    leads = classes.select("f1", "f2", "rep")
    if labels is not None:
        named = labels.withColumnRenamed("node", "rep")
        leads = leads.join(named, "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    else:
        leads = leads.withColumnRenamed("rep", "component_id")
    leads = scratch.keep(leads, "leads")
    rows_ = described.select("doc_id", "n_shingles", "f1", "f2")
    found = rows_.join(leads, ["f1", "f2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    scratch.close(described, leads)
    alone = F.col("doc_id").isNull() & F.col("component_id").isNull()
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), alone))
