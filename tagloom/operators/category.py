"""Category trees kept as an adjacency list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blank
from ..sources.shared import emptied, written
from ..spec import SpecError
from .lookup import POINT_KEYS, lookup_join, multi_get
from .paging import with_position


def category_paths(
    categories: DataFrame, id: str, parent: str, order: str, label: str, paths: list[str] | None = None
) -> DataFrame:
    """Every category that hangs on a root, with its depth, its sort path and the labels from the root down.

    Every round doubles the number of ancestors a category knows, so a tree of any depth takes as many joins as its
    depth has binary digits. A round is written to the shared folder and replaces the one before; the
    last one, which the result reads, is added to ``paths``, if given. Categories whose parents never reach a root (a missing parent
    or a cycle) are left out; an id that occurs again below itself is an error.
    """
    step = F.struct((-F.col(order).cast("double")).alias("o"), F.col(id).cast("string").alias("i"))
    known = categories.select(
        F.col(id).alias("id"),
        F.when(~blank(F.col(parent)), F.col(parent)).alias("up"),  # the nearest ancestor that is not in the path yet
        F.array(step).alias("path"),
        F.array(F.col(label)).alias("labels"),
    )
    ids = F.transform("path", lambda s: s["i"])
    spark = categories.sparkSession
    used: list[str] = []
    known = written(known, "tree", used)
    while True:
        # A path that meets itself goes no further: it is on a cycle, or its id is there twice.
        ended = F.col("up").isNull() | F.array_contains(ids, F.col("up").cast("string"))
        open_ = known.where(~ended)
        if open_.isEmpty():
            break
        above = known.select(
            F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("p"), F.col("labels").alias("n")
        )
        # A category may have very many children, so each finds its ancestor as in a lookup.
        longer = lookup_join(open_, "up", above, "inner").select(
            "id", F.col("next").alias("up"), F.concat("p", "path").alias("path"), F.concat("n", "labels").alias("labels")
        )
        known = written(known.where(ended).unionByName(longer), "tree", used)
        emptied(spark, used.pop(0))
    found = known.where(F.col("up").isNull())
    # An id that meets itself and also hangs on a root lies below itself; one on a mere cycle is not found.
    met = known.where(F.col("up").isNotNull()).select(F.col("up").alias("id")).distinct()
    twice = met.join(found.select("id"), "id", "left_semi").orderBy("id").first()
    if twice is not None:
        raise SpecError(f"category {twice.id} lies below itself")
    if paths is not None:
        paths += used
    return found.select("id", (F.size("path") - 1).alias("depth"), "path", "labels")


def category_preorder(categories: DataFrame, id: str, parent: str, order: str) -> DataFrame:
    """Position of every category: parents before children, higher order numbers first on each level."""
    used: list[str] = []
    found = category_paths(categories, id, parent, order, id, used).select("id", "depth", "path")
    placed = with_position(found, F.col("path"), name="pos").select("id", "depth", "pos")
    for path in used:
        emptied(categories.sparkSession, path)
    return placed


def category_ancestors(
    categories: DataFrame, id: str, parent: str, order: str, label: str, sep: str = "/", paths: list[str] | None = None
) -> DataFrame:
    """Labels from the root down to each category, as one text; what was written for it is added to ``paths``, if given."""
    found = category_paths(categories, id, parent, order, label, paths)
    return found.select("id", F.array_join("labels", sep).alias("path"))


def category_ancestors_of(
    categories: DataFrame,
    ids: DataFrame,
    id: str,
    parent: str,
    order: str,
    label: str,
    sep: str = "/",
    paths: list[str] | None = None,
) -> DataFrame:
    """Labels from the root down to each of the categories in the first column of ``ids``, as one text.

    Walks upward: every round reads the categories that the last one names as parents and none met before, and the
    walk ends when there are none, also on a cycle. Only what was met is joined into paths. Ids that are no category or hang on
    no root are left out, repeated ids count once. The rounds are freed; the rows that the result reads are
    added to ``paths``, if given.
    """
    spark = categories.sparkSession
    rounds: list[str] = []
    kind = categories.schema[id].dataType
    wanted = ids.select(F.col(f"`{ids.columns[0]}`").cast("string").try_cast(kind).alias(id))
    wanted = wanted.where(F.col(id).isNotNull()).distinct()
    columns = list(dict.fromkeys((id, parent, order, label)))
    frontier, met, mine = wanted, None, []
    try:
        while True:
            # A short frontier becomes a filter of the scan, a long one a semi-join.
            some = [row[0] for row in frontier.limit(POINT_KEYS + 1).collect()]
            if not some:
                break
            keys = some if len(some) <= POINT_KEYS else frontier
            mine.append(written(multi_get(categories, id, keys, columns).select(*columns), "ancestors", rounds))
            met = reduce(DataFrame.unionByName, mine)
            up = F.col(f"`{parent}`")
            above = mine[-1].where(~blank(up)).select(up.cast("string").try_cast(kind).alias(id)).distinct()
            frontier = above.join(met.select(id), id, "left_anti")
        if met is None:
            met = categories.select(*columns).where(F.lit(False))
        found = category_ancestors(met, id, parent, order, label, sep, paths)
    finally:
        for path in rounds:
            emptied(spark, path)
    return lookup_join(found, "id", wanted.withColumnRenamed(id, "id"), "left_semi")
