"""One tag as one lazy plan: spine, item frames, joins, formulas."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Collection
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.formula import evaluate
from ..operators.items import (
    basic_frame,
    declared_pairs,
    key_spine,
    one_per_key,
    shared_scan,
    sql_pairs,
)
from ..operators.methods import method_result
from ..operators.postprocess import post_value
from ..operators.result import base_result, column_defaults, default_problems, default_value
from ..operators.values import is_valid
from ..sources import Catalog, StagingViews
from ..spec import Item, SpecError, Tag, formula_levels
from ..types import spark_type

_FLAG = "__in_spine"

# Takes the frames of all items and the spine; gives the prior rows to work on and the keys that belong to them.
Narrow = Callable[[list[DataFrame], DataFrame], tuple[DataFrame, Column]]


@dataclass
class Part:
    """Items that were read together, their one-row-per-key frame, and how to build one of them alone."""

    items: list[Item]
    frame: DataFrame
    alone: Callable[[Item], DataFrame]


@dataclass
class TagResult:
    """The lazy result of a tag, the items that could not be planned, and the parts it is made of.

    ``release`` frees the staging queries that were written for it, once the frame has been used. ``mark`` tells which
    formulas made it, for stores that keep it; a frame that is not ``whole`` lacks prior rows, which stay as they are.
    """

    frame: DataFrame
    messages: list[str] = field(default_factory=list)
    failed: set[str] = field(default_factory=set)
    parts: list[Part] = field(default_factory=list)
    formulas: list[list[Item]] = field(default_factory=list)
    release: Callable[[], None] = lambda: None
    mark: str | None = None
    whole: bool = True
    observed: Observation | None = None

    def counts(self) -> dict[str, int]:
        """Rows that each item wrote a value into, once the frame has been published; '' is the number of rows."""
        return dict(self.observed.get) if self.observed is not None else {}


def item_message(tag: Tag, item: Item, error: BaseException) -> str:
    return f"tag {tag.name}, item {item.name}: {type(error).__name__}: {error}"


class _Builder:
    """Builds the item frames of one run and records the items that cannot be planned."""

    def __init__(self, catalog: Catalog, tag: Tag, watermark: dt.datetime | None, exclude: Collection[str]):
        self.tag, self.key, self.watermark = tag, tag.key, watermark
        self.catalog = catalog.scoped()
        self.staging = StagingViews(self.catalog, tag.staging, tag.items)
        self.items = [i for i in tag.value_items if i.name not in exclude]
        self.messages: list[str] = []
        self.failed: set[str] = set()

    def fail(self, item: Item, error: BaseException) -> None:
        self.failed.add(item.name)
        self.messages.append(item_message(self.tag, item, error))

    def spine(self) -> DataFrame:
        self.staging.ensure(self.key.staging)
        return key_spine(self.catalog, self.key, self.watermark, self.tag.values)

    def single(self, item: Item) -> DataFrame:
        """One-row-per-key frame of one non-formula item."""
        self.staging.ensure(item.staging)
        mode = self.tag.values
        if item.kind == "basic":
            return basic_frame(self.catalog, self.key, [item], self.watermark, mode)
        if item.kind == "sql":
            pairs = sql_pairs(self.catalog, self.key, item, self.watermark, mode)
        else:
            pairs = declared_pairs(method_result(self.catalog, item, self.watermark), self.key, item, mode)
        return one_per_key(pairs, self.key, item)

    def group(self, items: list[Item], flag: str | None = None) -> Part | None:
        """Basic items of one table and key column; members that cannot be planned are left out."""

        def build(members: list[Item]) -> DataFrame:
            for item in members:
                self.staging.ensure(item.staging)
            return basic_frame(self.catalog, self.key, members, self.watermark, self.tag.values, flag)

        try:
            return Part(items, build(items), self.single)
        except Exception:
            good = []
            for item in items:
                try:
                    self.single(item)
                    good.append(item)
                except Exception as error:
                    self.fail(item, error)
            return Part(good, build(good), self.single) if good else None

    def shares_key_scan(self, items: list[Item]) -> bool:
        """True if the key item reads the table and key column that these basic items read."""
        key = self.key
        return (
            key.key_kind == "basic"
            and (key.table or "").lower() == (items[0].table or "").lower()
            and str(key.content).lower() == (items[0].key_column or "").lower()
        )


def compute_tag(
    catalog: Catalog,
    tag: Tag,
    prior: DataFrame | None = None,
    watermark: dt.datetime | None = None,
    exclude: Collection[str] = (),
    narrow: Narrow | None = None,
    observed: Observation | None = None,
) -> TagResult:
    """Plan the new result of a tag from its sources and its prior result.

    Items that cannot be planned, and those in ``exclude``, keep their prior value or default. Apart from
    staging queries that several items read, nothing runs until the frame is used. ``narrow`` limits a run over a prior
    result to some of its rows, once the frames of the items are known. With ``observed`` the result counts what its items
    write; columns that are not used are then computed all the same.
    """
    tag.validate()
    # An item with a bad default fails like one that cannot be planned, and its column takes the default of its type.
    bad = default_problems(tag.value_items, tag.storage)
    if bad:
        tag = replace(tag, items=tuple(replace(i, default=None) if i.name in bad else i for i in tag.items))
    exclude = {*exclude, *bad}
    build = _Builder(catalog, tag, watermark, exclude)
    for item in tag.value_items:
        if item.name in bad:
            build.fail(item, bad[item.name])
    key = tag.key
    fresh = prior is None or key.extract == "reload"
    everything = tag.value_items

    parts: list[Part] = []
    base: DataFrame | None = None
    base_part: Part | None = None
    for items in shared_scan([i for i in build.items if i.kind == "basic"]):
        answers_key = fresh and base is None and build.shares_key_scan(items)
        part = build.group(items, _FLAG if answers_key else None)
        if part is None:
            continue
        parts.append(part)
        if answers_key:
            base_part = part
            base = _as_new(part.frame.where(F.col(_FLAG)), part).drop(_FLAG)
            part.frame = part.frame.drop(_FLAG)
    for item in build.items:
        if item.kind == "key":
            build.fail(item, SpecError("a tag has one key item"))
        elif item.kind in ("sql", "method"):
            try:
                parts.append(Part([item], build.single(item), build.single))
            except Exception as error:
                build.fail(item, error)

    if base is None:
        spine = build.spine()
        if not fresh and narrow is not None:
            prior, inside = narrow([part.frame for part in parts], spine)
            spine = spine.where(inside)
        base = spine if fresh else base_result(prior, spine, everything, tag.storage)

    wide = base
    for part in parts:
        if part is not base_part:
            wide = wide.join(_as_new(part.frame, part), key.name, "left")

    defaults = column_defaults(everything, tag.storage)
    columns: dict[str, Column] = {}
    joined = {i.name: i for p in parts for i in p.items}
    for item in everything:
        built = item.name in joined or (item.kind == "formula" and item.name not in exclude)
        for column in item.columns:
            old = defaults[column] if fresh else F.col(f"`{column}`")
            if column == item.name and item.extract == "reload" and built:
                old = default_value(item, None, tag.storage)
            columns[column] = old
        if item.name in joined:
            raw = F.col(f"`__new_{item.name}`")
            value = post_value(raw, spark_type(item.system_type), item)
            columns[item.name] = F.when(raw.isNotNull(), value).otherwise(columns[item.name])
            if item.is_post_processed:
                columns[item.raw_name] = F.coalesce(raw, columns[item.raw_name])
    if observed is not None:
        written = [F.count(F.col(f"`__new_{name}`")).alias(name) for name in joined]
        wide = wide.observe(observed, F.count(F.lit(1)).alias(""), *written)
    kept = [] if fresh else [c for c in prior.columns if c.lower() not in {x.lower() for x in (key.name, *columns)}]
    result = wide.select(
        F.col(f"`{key.name}`"),
        *[column.alias(name) for name, column in columns.items()],
        *[F.col(f"`{c}`") for c in kept],
    )

    levels = []
    for level in formula_levels(tuple(everything)):
        result, done = _apply_level(result, [i for i in level if i.name not in exclude], build)
        levels.append(done)
    return TagResult(result, build.messages, build.failed, parts, levels, build.staging.release, observed=observed)


def _as_new(frame: DataFrame, part: Part) -> DataFrame:
    return frame.withColumnsRenamed({i.name: f"__new_{i.name}" for i in part.items})


def _apply_level(result: DataFrame, items: list[Item], build: _Builder) -> tuple[DataFrame, list[Item]]:
    """Evaluate formulas of one level over all result rows; rows without a valid value keep the old one."""
    mode, storage = build.tag.values, build.tag.storage
    if not items:
        return result, items
    good = items
    try:
        evaluated = evaluate(result, good, mode, storage)
    except Exception:
        good = []
        for item in items:
            try:
                evaluate(result, [item], mode, storage)
                good.append(item)
            except Exception as error:
                build.fail(item, error)
        if not good:
            return result, good
        evaluated = evaluate(result, good, mode, storage)
    columns: dict[str, Column] = {}
    for item in good:
        raw, dtype = F.col(f"`__f_{item.name}`"), spark_type(item.system_type)
        valid = is_valid(raw, dtype, mode)
        columns[item.name] = F.when(valid, post_value(raw, dtype, item)).otherwise(F.col(f"`{item.name}`"))
        if item.is_post_processed:
            columns[item.raw_name] = F.when(valid, raw).otherwise(F.col(f"`{item.raw_name}`"))
    return evaluated.withColumns(columns).drop(*[f"__f_{i.name}" for i in good]), good


def require_all(result: TagResult, tag: Tag) -> TagResult:
    """The result itself, or an error if any item failed; for callers that want all columns or none."""
    if result.messages:
        raise SpecError(f"tag {tag.name}: " + "; ".join(result.messages))
    return result
