"""Small documents for the operators."""

from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make_docs(spark):
    """A table of documents from texts, numbered from 0 (or from (id, text) pairs)."""

    def make(texts, lang="en"):
        pairs = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        rows = [(k, t, lang, "s", len(t) if t is not None else None) for k, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make
