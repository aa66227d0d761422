"""Staging queries: built at first use, once per run, and shared by the items that name them."""

from __future__ import annotations

from collections.abc import Iterable

from ..spec import Item, SpecError, Staging
from .catalog import Catalog
from .shared import emptied, written


class StagingViews:
    """Adds staging queries to a catalog on demand.

    A query that one item reads stays a plain view, which the optimizer merges into that item. A query that
    several items read is written once to the shared folder.
    """

    def __init__(self, catalog: Catalog, queries: Iterable[Staging], items: Iterable[Item]):
        self._catalog = catalog
        self._queries = {q.name.lower(): q for q in queries}
        self._built: set[str] = set()
        self._readers: dict[str, int] = {}
        self._paths: list[str] = []
        for item in items:
            for name in {s.lower() for s in item.staging}:
                self._readers[name] = self._readers.get(name, 0) + 1

    def ensure(self, names: Iterable[str]) -> None:
        for name in (n.lower() for n in names):
            if name in self._built:
                continue
            if name not in self._queries:
                raise SpecError(f"unknown staging query {name}")
            query = self._queries[name]
            frame = self._catalog.sql(query.sql, query.params)
            if self._readers.get(name, 0) > 1:
                frame = written(frame, f"staging-{name}", self._paths)
            self._catalog.add(name, frame)
            self._built.add(name)

    def release(self) -> None:
        """Free what was written; frames that read it must have been used up."""
        while self._paths:
            emptied(self._catalog.spark, self._paths.pop())
