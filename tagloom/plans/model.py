"""Running a model: all its tags, with failures kept apart and one write per tag."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import Catalog
from ..spec import Model, SpecError, Tag
from ..streaming.runlog import FAILED, SUCCESS, RunLog
from .delta import DeltaStore, compute_delta
from .store import ResultStore
from .tag import TagResult, compute_tag, item_message


@dataclass
class RunReport:
    """Outcome of a model run: messages, and by tag how many rows each item wrote into and how many seconds the tag took.

    The item '' stands for all rows of the tag that were computed.
    """

    run_id: str
    messages: list[str] = field(default_factory=list)
    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    @property
    def status(self) -> str:
        return FAILED if self.messages else SUCCESS


def _runs(frames: Sequence[DataFrame]) -> Exception | None:
    """Compute all cells of several frames in one job without keeping them; the error if there is one."""
    cells = [f.select(F.xxhash64(*(F.col(f"`{c}`") for c in f.columns))) for f in frames]
    try:
        reduce(DataFrame.union, cells).write.format("noop").mode("overwrite").save()
    except Exception as error:
        return error
    return None


def _one_fault(parts: list[Any], frame: Callable[[Any], DataFrame], error: Exception | None) -> tuple[Any, Exception | None, list[Any]]:
    """One part that fails and its error, if any, and the parts that were seen to run.

    ``error`` is that of a run of all the parts, if there was one; then the half that need not be run is known to fail.
    """
    good: list[Any] = []
    while len(parts) > 1:
        half, rest = parts[: len(parts) // 2], parts[len(parts) // 2 :]
        failure = _runs([frame(p) for p in half])
        if failure is None:
            good, parts = good + half, rest
        else:
            parts, error = half, failure
    if error is None:
        error = _runs([frame(p) for p in parts])
    return (parts[0], error, good) if error is not None else (None, None, good + parts)


def faults(parts: Sequence[Any], frame: Callable[[Any], DataFrame]) -> list[tuple[Any, Exception]]:
    """The parts whose frames fail when they run, with their errors.

    Halves are run as one job each: n parts with f faults take at most f (log2 n + 1) + 1 jobs.
    """
    found: list[tuple[Any, Exception]] = []
    rest, error = list(parts), None
    while rest:
        part, error, good = _one_fault(rest, frame, error)
        if part is None:
            break
        found.append((part, error))
        rest = [p for p in rest if p is not part and not any(p is g for g in good)]
        error = _runs([frame(p) for p in rest]) if rest else None
        if error is None:
            break
    return found


def failing_items(result: TagResult, tag: Tag) -> dict[str, str]:
    """Find the items whose data fails at run time: item name -> message.

    Reached only after a publish has failed. Parts are tried first, then the items of parts that fail; formulas are tried
    level by level once all parts run.
    """
    bad: dict[str, str] = {}
    for part, error in faults(result.parts, lambda p: p.frame):
        own = [(part.items[0], error)] if len(part.items) == 1 else faults(part.items, part.alone)
        bad |= {item.name: item_message(tag, item, e) for item, e in own}
    for level in result.formulas:
        if bad:
            break
        own = faults(level, lambda i: result.frame.select(*[f"`{c}`" for c in i.columns]))
        bad = {item.name: item_message(tag, item, e) for item, e in own}
    return bad


def run_tag(catalog: Catalog, tag: Tag, store: ResultStore, watermark: dt.datetime | None = None) -> list[str]:
    """Compute and publish one tag; the messages of the items that had to be left out.

    The whole tag is one write. If it fails, the offending items are searched for, excluded, and the rest is
    published. An error that no item explains is raised.
    """
    return _run_tag(catalog, tag, store, watermark)[0]


def _run_tag(
    catalog: Catalog, tag: Tag, store: ResultStore, watermark: dt.datetime | None = None
) -> tuple[list[str], dict[str, int]]:
    """The messages of one tag and the rows its items wrote into."""
    excluded: dict[str, str] = {}
    while True:
        observed = Observation()
        if isinstance(store, DeltaStore):
            result = compute_delta(catalog, tag, store, watermark, excluded, observed)
            publish = lambda r=result: store.publish(r.frame, r.mark, r.whole)
        else:
            result = compute_tag(catalog, tag, store.read(), watermark, excluded, observed=observed)
            publish = lambda r=result: store.publish(r.frame)
        try:
            publish()
            return [*result.messages, *excluded.values()], result.counts()
        except Exception:
            found = failing_items(result, tag)
            if not found:
                raise
            excluded |= found
        finally:
            result.release()


@contextmanager
def model_settings(spark: SparkSession, model: Model) -> Iterator[None]:
    """Apply the Spark settings of a model's run configuration for one run.

    Settings that are fixed once a session exists (memory, cores) belong to the submitting command and are left
    alone here.
    """
    wanted = json.loads(model.config.get("configcontent") or "{}")
    before = {name: spark.conf.get(name, None) for name in wanted if spark.conf.isModifiable(name)}
    try:
        for name in before:
            spark.conf.set(name, str(wanted[name]))
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _catalog_of(tag: Tag, catalogs: Catalog | Mapping[str, Catalog]) -> Catalog:
    if isinstance(catalogs, Catalog):
        return catalogs
    if tag.source not in catalogs:
        raise SpecError(f"data source {tag.source} not found")
    return catalogs[tag.source]


def run_model(
    catalogs: Catalog | Mapping[str, Catalog],
    model: Model,
    store_for: Callable[[Tag], ResultStore],
    log: RunLog,
    operated_at: dt.datetime | None = None,
) -> RunReport:
    """Run all tags of a model; a failed tag is reported and the next one still runs.

    With several ``catalogs``, by name of the data source, every tag reads its own. Messages are logged tag by tag.
    """
    operated_at = operated_at or log.now()
    watermark = log.last_success(model.name)
    report = RunReport(log.start(model.name, operated_at), list(model.problems))
    with model_settings(log.spark, model):
        log.append(report.run_id, model.name, operated_at, report.messages)
        for tag in model.tags:
            began = time.perf_counter()
            try:
                new, report.counts[tag.name] = _run_tag(_catalog_of(tag, catalogs), tag, store_for(tag), watermark)
            except Exception as error:
                new = [f"tag {tag.name}: {type(error).__name__}: {error}"]
            report.seconds[tag.name] = time.perf_counter() - began
            log.append(report.run_id, model.name, operated_at, new)
            report.messages += new
    log.finish(report.run_id, model.name, operated_at)
    return report
