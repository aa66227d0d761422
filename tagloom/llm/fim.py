"""Fill-in-the-middle: texts cut at two line ranks found in an indexable skip list, and their parts put in another order.

The lines of a text are the nodes of a skip list. A link of a lane carries how many lines and how many code points
it passes. To reach a rank, the search goes right while the accumulated lines do not exceed the rank, else one lane down;
at the end the accumulated code points are the place of the cut. Heights come from a hash of the line's number, so a
list is the same wherever it is built.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import add_columns, mix

SEED = 7
# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE = 100  # percent of the texts that are rearranged
SPM = 50  # percent of those that begin with the suffix
# On average one node in 2 ** SHIFT of a lane is also on the next one.
SHIFT = 2
FIELDS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class SkipList:
    """Widths (in code points) of consecutive units, searched by unit rank.

    Lane 0 has every unit, each lane above a part of the one below. ``lanes[k]`` holds the units a link passes, the code
    points it passes, and for each link the number of the link of lane ``k - 1`` that starts at the same place.
    """

    def __init__(self, widths: np.ndarray):
        self.size = n = len(widths)
        ends = np.concatenate(([0], np.cumsum(widths)))
        stops = np.arange(n + 1)  # boundaries that a lane can stop at; 0 is the head
        random = mix(np.arange(n + 1, dtype=np.uint64))
        self.lanes: list[tuple[list[int], list[int], list[int]]] = []
        below = np.arange(n + 1)
        level = 0
        while True:
            self.lanes.append((np.diff(stops).tolist(), np.diff(ends[stops]).tolist(), below.tolist()))
            level += 1
            higher = (random[stops] & np.uint64((1 << SHIFT * level) - 1)) == 0
            higher[0] = True
            below = np.flatnonzero(higher)
            if len(below) == 1 or SHIFT * level >= 60:
                return
            stops = stops[below]

    def find(self, rank: int) -> int:
        """The code points of the first ``rank`` units."""
        at = units = chars = 0
        for k in range(len(self.lanes) - 1, -1, -1):
            unit_widths, char_widths, below = self.lanes[k]
            while at < len(unit_widths) and units + unit_widths[at] <= rank:
                units += unit_widths[at]
                chars += char_widths[at]
                at += 1
            at = below[at] if k else at
        return chars


def unit_widths(text: str) -> np.ndarray:
    """Code points of every line, its line feed included; text after the last one is a line of its own."""
    widths = np.fromiter(map(len, text.split("\n")), np.int64)
    widths[:-1] += 1
    return widths if widths[-1] else widths[:-1]


def draws(id: str | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the sha256 of seed and id."""
    hexes = hashlib.sha256(f"{seed}:{id or ''}".encode()).hexdigest()
    return tuple(int(hexes[8 * k : 8 * k + 8], 16) for k in range(4))


def rearranged(text: str, id: str | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple:
    """(lines, form, code points of prefix and middle, output) of one text."""
    widths = unit_widths(text)
    n = len(widths)
    h1, h2, h3, h4 = draws(id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    units = SkipList(widths)
    a, b = (units.find(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    first, mid, last = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, SUFFIX + last + PREFIX + first + MIDDLE + mid
    return n, "psm", a, b - a, PREFIX + first + SUFFIX + last + MIDDLE + mid


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM
) -> DataFrame:
    """Add ``n, form, prefix_chars, middle_chars, output`` to every row; columns of these names are replaced, all others stay.

    A null text counts as empty. Empty texts and texts that hold a mark are ``plain``: their output is the text itself, and
    they have no prefix and middle. Cuts depend on the id and the number of lines alone, so rows that repeat are cut
    alike; a null id counts as empty text. No rows give no result. One task holds one slice of whole texts at a
    time, and a very long text alone.
    """
    # The id as text travels beside the other columns, under a name none of them has.
    id_name = "__fim_id"
    while id_name in (c.lower() for c in docs.columns):
        id_name += "_"
    named = docs.withColumn(id_name, F.col(f"`{key}`").cast("string"))
    at = [c for c in named.columns if c.lower() not in ("n", "form", "prefix_chars", "middle_chars", "output")].index(id_name)

    def task(piece: pa.RecordBatch) -> list[pa.Array]:
        ids, texts = piece[f"__{at}"].to_pylist(), piece["text"].to_pylist()
        rows = [rearranged(t or "", i, seed, rate, spm) for i, t in zip(ids, texts)]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

    return add_columns(named, task, FIELDS, text).drop(id_name)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.

    Marks are unique in an output that is not plain, as the text holds none and no mark can begin inside another.
    """
    part = lambda whole, mark, k: F.split_part(whole, F.lit(mark), F.lit(k))
    # Behind the first mark stand the parts, in one order or the other.
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    end = part(body, MIDDLE, 2)
    begin = part(body, MIDDLE, 1)
    psm = F.concat(part(begin, SUFFIX, 1), end, part(begin, SUFFIX, 2))
    spm = F.concat(part(begin, PREFIX, 2), end, part(begin, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
