"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A template of n words is searched in windows of ``n + step`` words that begin every ``step`` words, so every stretch of n
words lies inside a window. Word shingles of a window are reduced to MinHash values; bands of them are looked up among the
bands of the templates. A window that holds ``CONTAINED`` percent of a template's shingles has a similarity to it of at least
``least_similarity``, and the bands are set so that such a window is retrieved with a probability of
``RETRIEVED``. Whether a retrieved stretch really holds the template is decided on its exact shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix, shingle_hashes, slices, split_words, word_hashes

WIDTH = 5
CONTAINED = 75
ROWS = 2
RETRIEVED = 0.9999
_GOLD = np.uint64(0x9E3779B97F4A7C15)

# Fixed texts: notices by which files and pages declare public licenses.
TEMPLATES: Mapping[str, str] = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "Apache-2.0-text": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at"
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "GPL-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def step_of(words: int) -> int:
    """How far windows for a template of so many words are apart."""
    return max(1, math.ceil(words / 4))


def least_similarity(words: int) -> float:
    """The least similarity to the template of a window with ``CONTAINED`` percent of its shingles."""
    shingles = max(1, words - WIDTH + 1)
    needed = math.ceil(shingles * CONTAINED / 100)
    window = max(1, words + step_of(words) - WIDTH + 1)
    return needed / (shingles + window - needed)


def bands_of(words: int, rows: int = ROWS) -> int:
    """Bands that retrieve such a window with probability ``RETRIEVED``."""
    return math.ceil(math.log(1 - RETRIEVED) / math.log(1 - least_similarity(words) ** rows))


def minhash_bands(shingles: np.ndarray, starts: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Band hashes of consecutive stretches of ``shingles`` that begin at ``starts``; one row per stretch."""
    out = np.zeros((len(starts), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(starts), b + 1, np.uint64)
        for k in range(rows):
            salt = np.uint64((b * rows + k + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF)
            h = mix(h ^ np.minimum.reduceat(mix(shingles ^ salt), starts)) + _GOLD
        out[:, b] = h
    return out


class _Template:
    def __init__(self, name: str, text: str):
        parts, sizes = split_words([text.encode()])
        self.name, self.words = name, int(sizes[0])
        shingles, _ = shingle_hashes(word_hashes(parts, self.words), sizes, WIDTH)
        self.shingles = np.unique(shingles)
        self.width = min(self.words, WIDTH)
        self.step = step_of(self.words)
        self.bands = bands_of(self.words)
        self.keys = minhash_bands(self.shingles, np.array([0]), ROWS, self.bands)[0]


@lru_cache(maxsize=4)
def _templates(items: tuple[tuple[str, str], ...]) -> list[_Template]:
    return [_Template(name, text) for name, text in items]


def _retrieve(shingles: np.ndarray, template: _Template) -> np.ndarray:
    """First shingles of the windows of a text that share a band with the template.

    A window without any shingle of the template has no minimum in common with it, so only windows around shared
    shingles are hashed.
    """
    near = np.flatnonzero(np.isin(shingles, template.shingles))
    if not len(near):
        return near
    step, size = template.step, template.words + template.step - template.width + 1
    first = np.maximum(0, -(-(near - size + 1) // step))
    last = near // step
    windows = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist())])) * step
    ends = np.minimum(windows + size, len(shingles))
    sizes = ends - windows
    flat = np.repeat(windows - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    keys = minhash_bands(shingles[flat], np.cumsum(sizes) - sizes, ROWS, template.bands)
    return windows[(keys == template.keys).any(1)]


def matches(shingles: np.ndarray, template: _Template) -> list[tuple[int, int, int]]:
    """(first word, words, shared shingles) of the verified places of a template in a text, without overlaps.

    In every retrieved window the stretch of the template's length with the most shared shingles counts, the first of
    equals; of overlapping places the one with more shared shingles stays, then the first.
    """
    needed = math.ceil(len(template.shingles) * CONTAINED / 100)
    length = template.words - template.width + 1
    found = set()
    for start in _retrieve(shingles, template).tolist():
        window = shingles[start : start + length + template.step]
        best = (0, 0)
        for at in range(max(1, len(window) - length + 1)):
            n = len(np.intersect1d(window[at : at + length], template.shingles))
            if n > best[0]:
                best = (n, start + at)
        if best[0] >= needed:
            found.add((-best[0], best[1]))
    out: list[tuple[int, int, int]] = []
    for n, at in sorted(found):
        if all(at + template.words <= a or a + w <= at for a, w, _ in out):
            out.append((at, template.words, -n))
    return sorted(out)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and place: (doc_id, license, first_word, n_words, n_shared, containment).

    ``first_word`` counts words from 0; ``containment`` is the share of the template's distinct shingles found there. Whole
    texts are searched, with A-Z lower-cased; a null or empty text has no place; a template of fewer than five words is one
    shingle. Rows that repeat are searched each. Only the two named columns are read. The templates are a fixed list
    that goes to every task.
    """
    items = tuple((name, body) for name, body in templates.items() if body.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _templates(items)
        for piece in slices(batches):
            ids = piece["doc_id"].to_pylist()
            parts, sizes = split_words(piece["text"].cast(pa.binary()).to_pylist())
            words = word_hashes(parts, int(sizes.sum()))
            rows = []
            for width in {t.width for t in known}:
                shingles, owner = shingle_hashes(words, sizes, width)
                whole = np.unique(np.concatenate([t.shingles for t in known if t.width == width]))
                # Documents that share no shingle with any template need no windows.
                ends = np.cumsum(np.bincount(owner, minlength=len(ids)))
                for doc in np.unique(owner[np.isin(shingles, whole)]).tolist():
                    own = shingles[ends[doc - 1] if doc else 0 : ends[doc]]
                    for t in known:
                        if t.width == width and sizes[doc] >= width:
                            rows += [(ids[doc], t.name, *place, place[2] / len(t.shingles)) for place in matches(own, t)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                ["doc_id", "license", "first_word", "n_words", "n_shared", "containment"],
            )

    source = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(
        run, "doc_id bigint, license string, first_word bigint, n_words bigint, n_shared bigint, containment double"
    )
