"""Declarative description of tags: what a user writes, before any Spark plan exists."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

# The vocabularies of the specification.
ITEM_KINDS = ("key", "basic", "sql", "method", "formula")
KEY_KINDS = ("basic", "sql")
EXTRACTS = ("full", "incremental", "reload")
ACCESSES = ("variable", "constant", "tagitem")
POST_KINDS = ("none", "weight", "number")
STORAGES = ("table", "cell")
DUPLICATE_RULES = ("max", "latest", "error", "count", "sum")
VALUE_MODES = ("strict", "compat")

# Fixed value: suffix of the column that keeps the value before post-processing.
RAW_SUFFIX = "_ctr"


class SpecError(ValueError):
    """The specification itself is wrong (reported before any Spark job runs)."""


@dataclass(frozen=True)
class Param:
    """Parameter of an SQL, method or formula item.

    ``access`` ``tagitem`` binds a column of the result, the others bind ``value`` itself.
    ``type`` None leaves the type open (SQL: a number if the text is one and it stands unquoted).
    """

    name: str
    value: Any = None
    type: str | None = None
    access: str = "constant"


@dataclass(frozen=True)
class PostProcess:
    """``weight``: standardise and weight; ``number``: clamp between ``min`` and ``max``."""

    kind: str = "none"
    standard: float | None = None
    weight: float | None = None
    min: float | None = None
    max: float | None = None

    @classmethod
    def from_json(cls, kind: str | None, text: str | None) -> PostProcess | None:
        """None when the kind or the JSON is blank or the kind is ``none``; blank entries are unset."""
        kind = (kind or "").strip().lower()
        if kind not in POST_KINDS or kind == "none" or not (text or "").strip():
            return None
        values = {k: v for k, v in json.loads(text).items() if v is not None and str(v).strip() != ""}
        return cls(kind, **{k: float(values[k]) for k in ("standard", "weight", "min", "max") if k in values})


@dataclass(frozen=True)
class Item:
    """One column of a tag. ``content`` is a column, SQL text, method name or formula by ``kind``.

    ``duplicates`` says what becomes of several values of a key: the largest, the latest by the increment column, an
    error, or (``count``, ``sum``) their number or total. A key without values has no value under any rule.
    """

    name: str
    kind: str = "basic"
    content: str | Callable = ""
    table: str | None = None
    filter: str | None = None
    key_column: str | None = None
    increment_column: str | None = None
    extract: str = "full"
    type: str | None = None
    default: Any = None
    lower_is_better: bool = False
    post: PostProcess | None = None
    staging: tuple[str, ...] = ()
    params: tuple[Param, ...] = ()
    key_kind: str = "basic"
    duplicates: str = "max"

    @property
    def system_type(self) -> str:
        return self.type or "string"

    @property
    def is_post_processed(self) -> bool:
        return self.post is not None and self.post.kind != "none"

    @property
    def raw_name(self) -> str:
        return self.name + RAW_SUFFIX

    @property
    def value_type(self) -> str:
        """System type of the published column (post-processing yields whole or floating numbers)."""
        if not self.is_post_processed:
            return self.system_type
        return "int" if self.system_type == "int" else "double"

    @property
    def columns(self) -> dict[str, str]:
        """Result columns of the item and their system types."""
        if self.is_post_processed:
            return {self.raw_name: self.system_type, self.name: self.value_type}
        return {self.name: self.system_type}


@dataclass(frozen=True)
class Staging:
    """A parameterised query that items of the tag may read by name."""

    name: str
    sql: str
    params: tuple[Param, ...] = ()


@dataclass(frozen=True)
class Tag:
    """One wide result table: a key item that gives the rows, and an item per column.

    ``storage`` ``table`` gives every column a typed default; ``cell`` leaves cells without a declared default
    empty and back-fills blank cells of the keys of the run. ``values`` picks the strict or the lenient
    invalid-value and text-coercion rules. ``source`` names the data source, where a model has several.
    """

    name: str
    items: tuple[Item, ...]
    staging: tuple[Staging, ...] = ()
    storage: str = "table"
    values: str = "strict"
    source: str | None = None

    @property
    def key(self) -> Item:
        for item in self.items:
            if item.kind == "key":
                return item
        raise SpecError(f"tag {self.name}: no key item")

    @property
    def value_items(self) -> tuple[Item, ...]:
        return tuple(item for item in self.items if item is not self.key)

    def validate(self) -> Tag:
        """Raise ``SpecError`` for mistakes that would spoil the whole tag."""
        key = self.key
        seen = {key.name.lower()}
        for item in self.value_items:
            for column in item.columns:
                if column.lower() in seen:
                    raise SpecError(f"tag {self.name}: column {column} is declared twice")
                seen.add(column.lower())
        for item in self.items:
            for value, allowed, what in (
                (item.kind, ITEM_KINDS, "kind"),
                (item.key_kind, KEY_KINDS, "key kind"),
                (item.extract, EXTRACTS, "extract"),
                (item.duplicates, DUPLICATE_RULES, "duplicate rule"),
            ):
                if value not in allowed:
                    raise SpecError(f"tag {self.name}, item {item.name}: {what} {value!r} is not one of {allowed}")
        if self.storage not in STORAGES or self.values not in VALUE_MODES:
            raise SpecError(f"tag {self.name}: storage {self.storage!r} or values {self.values!r} unknown")
        formula_levels(self.value_items)
        return self


@dataclass(frozen=True)
class Model:
    """Tags that run together and share one run log entry."""

    name: str
    tags: tuple[Tag, ...] = ()
    problems: tuple[str, ...] = ()
    config: Mapping[str, str] = field(default_factory=dict)


def dependencies(items: tuple[Item, ...]) -> dict[str, tuple[str, ...]]:
    """Item name -> names of the items its parameters refer to; unknown names are ignored."""
    known = {column.lower(): item.name for item in items for column in item.columns}
    return {
        item.name: tuple(
            dict.fromkeys(
                known[str(p.value).lower()]
                for p in item.params
                if p.access == "tagitem" and str(p.value).lower() in known
            )
        )
        for item in items
    }


def formula_levels(items: tuple[Item, ...]) -> list[list[Item]]:
    """Formula items in levels: every item comes after all the formulas it refers to."""
    formulas = {item.name: item for item in items if item.kind == "formula"}
    needs = {name: [d for d in deps if d in formulas] for name, deps in dependencies(items).items() if name in formulas}
    depth: dict[str, int] = {}

    def visit(name: str, trail: tuple[str, ...]) -> int:
        if name in trail:
            raise SpecError("formula cycle: " + " -> ".join((*trail[trail.index(name):], name)))
        if name not in depth:
            depth[name] = max((visit(d, (*trail, name)) + 1 for d in needs[name]), default=0)
        return depth[name]

    for name in formulas:
        visit(name, ())
    levels: list[list[Item]] = [[] for _ in range(max(depth.values(), default=-1) + 1)]
    for name, item in formulas.items():
        levels[depth[name]].append(item)
    return levels
