"""Models kept in metadata tables instead of Python code.

The tables describe columns, not data: their size is that of the specification, so the rows of one model are
read to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blank
from ..operators.category import category_preorder
from ..operators.lookup import lookup_join
from ..sources import Catalog
from ..spec import (
    ACCESSES,
    ITEM_KINDS,
    KEY_KINDS,
    POST_KINDS,
    STORAGES,
    Item,
    Model,
    Param,
    PostProcess,
    SpecError,
    Staging,
    Tag,
)
from ..types import SYSTEM_TYPES

# The column names of metadata tables, read below by their names, and the codes in them.
# Extraction codes of the metadata tables.
EXTRACT_CODES = {1: "full", 2: "incremental", 3: "reload"}
# Storage codes of the run configuration and the storage behaviour they stand for.
SAVE_CODES = {"mysql": "table", "hbase": "cell"}

Row = Mapping[str, Any]


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [{k.lower(): v for k, v in row.asDict().items()} for row in df.collect()]


def _text(row: Row, field: str) -> str | None:
    value = row.get(field)
    return None if value is None or str(value).strip() == "" else str(value)


def _one_of(row: Row, field: str, allowed: Iterable[str], otherwise: str) -> str:
    value = (_text(row, field) or "").lower()
    return value if value in allowed else otherwise


def param_from_row(row: Row) -> Param:
    kind = (_text(row, "paramtype") or "").lower()
    return Param(
        name=str(row["paramname"]),
        value=row.get("paramvalue"),
        type=kind if kind in SYSTEM_TYPES else None,
        access=_one_of(row, "accesstype", ACCESSES, "constant"),
    )


def item_from_row(row: Row, params: Iterable[Row] = (), staging_names: Mapping[str, str] | None = None) -> Item:
    """Item of a metadata row; unknown kinds are basic, unknown types text, unknown post-processing none."""
    kind = _one_of(row, "itemtype", ITEM_KINDS, "basic")
    returntype = (_text(row, "returntype") or "").lower()
    post_kind = _one_of(row, "postprocessingtype", POST_KINDS, "none")
    wanted = (_text(row, "stagingtableguids") or "").split(",")
    return Item(
        name=str(row["itemanothername"]),
        kind=kind,
        content=_text(row, "itemcontent") or "",
        table=_text(row, "tablename"),
        filter=_text(row, "filtercondition"),
        key_column=_text(row, "associatedstructname"),
        increment_column=_text(row, "incrementstructname"),
        extract=EXTRACT_CODES.get(int(row.get("extracttype") or 0), "full"),
        type=returntype if returntype in SYSTEM_TYPES else (None if kind == "key" else "string"),
        default=row.get("defaultvalue"),
        lower_is_better=_text(row, "itemattribute") == "-",
        post=PostProcess.from_json(post_kind, _text(row, "postprocessing")),
        staging=tuple(staging_names[w] for w in wanted if staging_names and w in staging_names),
        params=tuple(param_from_row(p) for p in params),
        key_kind=_one_of(row, "keytype", KEY_KINDS, "basic"),
    )


def ordered_items(
    items: DataFrame, categories: DataFrame, names: Iterable[str] | None = None, only_enabled: bool = True
) -> DataFrame:
    """Items by the pre-order of their categories, then by falling order number; the rank is in two columns."""
    order = category_preorder(categories, "itemcategoryguid", "parentguid", "orderno")
    if only_enabled:
        items = items.where(F.col("isenabled") == 1)
    if names is not None:
        items = items.where(F.col("itemanothername").isin(*names))
    place = order.select(F.col("id").alias("itemcategoryguid"), F.col("pos").alias("category_pos"))
    return lookup_join(items, "itemcategoryguid", place, "inner").orderBy("category_pos", F.col("orderno").desc(), "itemanothername")


def _in_order(items: list[dict[str, Any]], categories: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """``ordered_items`` for the few rows of one tag, which are on the driver anyway."""
    falling = lambda row: (row["orderno"] is not None, -float(row["orderno"] or 0))
    below: dict[str, list[dict[str, Any]]] = {}
    for row in categories:
        below.setdefault(_text(row, "parentguid") or "", []).append(row)
    place: dict[Any, int] = {}
    todo = [""]
    while todo:
        at = todo.pop()
        if at:
            if at in place:
                raise SpecError(f"category {at} lies below itself")
            place[at] = len(place)
        children = sorted(below.get(at, ()), key=lambda r: (*falling(r), str(r["itemcategoryguid"])))
        todo += [str(r["itemcategoryguid"]) for r in reversed(children)]
    held = [r for r in items if str(r["itemcategoryguid"]) in place]
    return sorted(
        held,
        key=lambda r: (
            place[str(r["itemcategoryguid"])], r["orderno"] is None, -float(r["orderno"] or 0), str(r["itemanothername"])
        ),
    )


def load_model(metadata: Catalog, model_id: str) -> Model:
    """Read the specification of a model.

    The catalog holds the tables ``model``, ``model_tag``, ``tag``, ``runconfig``, ``stagingtable``,
    ``stagingtable_param``, ``tag_item_category``, ``tag_item`` and ``tag_item_param``. Tags that cannot be used
    are listed in ``Model.problems``; the others stay.
    """
    of_model = metadata.table("model").where(F.col("modelguid") == model_id).select("configguid")
    config = _rows(metadata.table("runconfig").join(of_model, "configguid", "left_semi"))
    if not config:
        raise SpecError(f"model {model_id}: no run configuration")
    storage = SAVE_CODES.get(str(config[0].get("savetype") or "").lower(), "cell")
    tags, problems = [], []
    links = metadata.table("model_tag").where(F.col("modelguid") == model_id).orderBy(F.col("orderno").desc())
    for link in _rows(links):
        try:
            tags.append(load_tag(metadata, link["tagguid"], storage))
        except Exception as error:
            problems.append(f"tag {link['tagguid']}: {error}")
    return Model(model_id, tuple(tags), tuple(problems), {k: str(v) for k, v in config[0].items() if v is not None})


def load_tag(metadata: Catalog, tag_id: str, storage: str = STORAGES[0], only_enabled: bool = True) -> Tag:
    """Read one tag with its items, parameters and staging queries."""
    of_tag = F.col("tagguid") == tag_id
    found = _rows(metadata.table("tag").where(of_tag))
    if not found:
        raise SpecError("not found")
    staging_rows = _rows(metadata.table("stagingtable").where(of_tag))
    staging_ids = [r["stagingtableguid"] for r in staging_rows]
    of_staging = F.col("stagingtableguid").isin(*staging_ids)
    staging_params = (
        _rows(metadata.table("stagingtable_param").where(of_staging).orderBy(F.col("orderno").desc()))
        if staging_ids
        else []
    )
    categories = metadata.table("tag_item_category").where(of_tag & ~blank(F.col("itemcategoryguid")))
    items = lookup_join(metadata.table("tag_item"), "itemcategoryguid", categories.select("itemcategoryguid").distinct(), "left_semi")
    item_rows = _in_order(_rows(items.where(F.col("isenabled") == 1) if only_enabled else items), _rows(categories))
    if not item_rows:
        raise SpecError("no items")
    params = _rows(
        metadata.table("tag_item_param").where(F.col("itemguid").isin(*[r["itemguid"] for r in item_rows]))
    )
    names = {r["stagingtableguid"]: str(r["stagingtableanothername"]) for r in staging_rows}
    return Tag(
        name=str(found[0]["taganothername"]),
        items=tuple(item_from_row(r, [p for p in params if p["itemguid"] == r["itemguid"]], names) for r in item_rows),
        staging=tuple(
            Staging(
                names[r["stagingtableguid"]],
                str(r["sqlcontent"]),
                tuple(param_from_row(p) for p in staging_params if p["stagingtableguid"] == r["stagingtableguid"]),
            )
            for r in staging_rows
        ),
        storage=storage,
        source=_text(found[0], "datasourceguid"),
    ).validate()
