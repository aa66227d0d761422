"""Mixing to target weights with soft memberships, in DataFrame operations only.

A naive Bayes classifier trained on a labelled table gives every document a probability for each domain. A document of n
tokens, taken at rate r, adds ``r n p_k`` expected tokens to domain k. Projected gradient descent on the weighted squares
of (expected total - target total) finds nonnegative rates: every round is one aggregation of a few sums over a compact
table of (id, tokens, probabilities), and a document's rate is a column expression over the rounds' residuals.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .text import let

TRAIN_ROWS = 20_000  # labelled documents, the bound of the training sample
WORDS = 96  # words taken as features, those that tell the domains apart best
ROUNDS = 80  # of descent; what is still off then is left to Newton's method
STRETCH = 20  # rounds of descent between rewriting the rates
TRIALS = 60  # of Newton's method; what is off target after them is reported
PENALTY = 1e8
CLOSE = 1e-3  # of each domain's own target
SHAPES = ("size", "symbols", "capitals", "marks", "lines")
TARGETS = {"clean": 0.92, "low": 0.07, "toxic": 0.01}


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxicity labels; rows with a null are left out, repeated ids taken once."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("low")
    return known.groupBy("doc_id").agg(F.min(name).alias("domain"))


def features(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, shape, words): tokens with one end, five coarse shares of the text, and its distinct words."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), body.alias("__text"))
    size = F.length("__text")
    lines = F.split("__text", "\n")

    def share(chars: str) -> Column:
        found = F.regexp_count("__text", F.lit(f"[{chars}]"))
        return F.least(F.lit(9), F.ceil(20 * found / F.greatest(size, F.lit(1)))).cast("int")

    bins = (
        F.least(F.lit(9), F.floor(F.log2(size + 1) / 2)).cast("int"),
        share("#*$%&|<>"),
        share("A-Z"),
        share("!?"),
        F.ceil(9 * (F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines)).cast("int"),
    )
    return rows.withColumn("__words", F.array_remove(F.split(F.lower("__text"), "[\\x20\\x09-\\x0D]+"), "")).select(
        "doc_id",
        (F.size("__words") + 1).cast("bigint").alias("n_tokens"),
        F.array(*(F.concat_ws("=", F.lit(n), b.cast("string")) for n, b in zip(SHAPES, bins))).alias("shape"),
        F.array_distinct("__words").alias("words"),
    )


@dataclass(frozen=True)
class Model:
    """Log weights of the features for every domain."""

    domains: tuple[str, ...]
    bias: tuple[float, ...]
    words: Mapping[str, tuple[float, ...]]
    shapes: Mapping[str, tuple[float, ...]]


def fit(docs: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS, words: int = WORDS) -> Model:
    """Naive Bayes on about ``train_rows`` labelled documents, chosen by a hash of the id.

    ``labelled`` has unique ``doc_id`` and ``domain``. Ids without a document take no part; without any labelled document
    the model has no domain. The driver gets counts of ``words`` words and the shapes' bins.
    """
    total = labelled.count()
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < math.ceil(1_000_003 * train_rows / max(total, 1)))
    # The sample has a bounded number of rows of two short columns, so it may be broadcast.
    rows = features(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    train = written(rows.join(F.broadcast(chosen), "doc_id").select("domain", "words", "shape"), "mixing-train")
    sizes = {r.domain: r["count"] for r in train.groupBy("domain").count().collect()}
    names = tuple(sorted(sizes))
    if not names:
        return Model((), (), {}, {})
    all_rows = sum(sizes.values())

    def counts(feature: str) -> DataFrame:
        each = train.select("domain", F.explode(feature).alias("f"))
        return each.groupBy("f").agg(*(F.count(F.when(F.col("domain") == n, 1)).alias(f"n{k}") for k, n in enumerate(names)))

    # How much knowing whether a document has the word tells about its domain (mutual information).
    seen = sum((F.col(f"n{k}") for k in range(len(names))), F.lit(0))
    gain = F.lit(0.0)
    for k, n in enumerate(names):
        for have, whole in ((F.col(f"n{k}"), seen), (sizes[n] - F.col(f"n{k}"), all_rows - seen)):
            gain = gain + F.when(have > 0, have * F.log(have * all_rows / (whole * sizes[n]))).otherwise(0.0)
    best = counts("words").withColumn("gain", gain).orderBy(F.desc("gain"), "f").limit(words).collect()
    bias = [math.log(sizes[n] / all_rows) for n in names]
    by_word = {}
    for r in best:
        p = [(r[f"n{k}"] + 0.5) / (sizes[n] + 1) for k, n in enumerate(names)]
        bias = [b + math.log(1 - q) for b, q in zip(bias, p)]
        by_word[r.f] = tuple(math.log(q / (1 - q)) for q in p)
    by_shape = {
        r.f: tuple(math.log((r[f"n{k}"] + 0.5) / (sizes[n] + 5)) for k, n in enumerate(names))
        for r in counts("shape").collect()
    }
    return Model(names, tuple(bias), by_word, by_shape)


def posteriors(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, p) for rows of ``features``: p holds the probability of every domain of the model, in order."""
    if not model.domains:
        return rows.select("doc_id", "n_tokens", F.array().cast("array<double>").alias("p"))
    literal = lambda m: F.create_map(
        *(x for name, w in m.items() for x in (F.lit(name), F.array(*map(F.lit, w))))
    )
    none = F.array(*(F.lit(0.0) for _ in model.domains))
    weight = lambda m, f: F.coalesce(F.try_element_at(literal(m), f), none)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = F.array(*map(F.lit, model.bias))
    if model.words:
        known = F.array_intersect("words", F.array(*map(F.lit, model.words)))
        total = F.aggregate(known, total, lambda t, f: add(t, weight(model.words, f)))
    total = F.aggregate("shape", total, lambda t, f: add(t, weight(model.shapes, f)))
    likely = let(total, lambda t: F.transform(t, lambda x: F.exp(x - F.array_max(t))))
    whole = lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", "n_tokens", let(likely, lambda e: F.transform(e, lambda x: x / whole(e))).alias("p"))


def with_known(members: DataFrame, labelled: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The memberships with those of labelled documents replaced by their label; ``labelled`` has unique ids."""
    known = F.array(*(F.when(F.col("domain") == n, 1.0).otherwise(0.0) for n in names))
    p = F.when(F.col("domain").isin(*names), known).otherwise(F.col("p")) if names else F.col("p")
    return members.join(labelled, "doc_id", "left").select("doc_id", "n_tokens", p.alias("p"))


def _largest(gram: list[list[float]]) -> float:
    """An upper estimate of the largest eigenvalue of a small nonnegative matrix: its largest row sum."""
    return max(sum(row) for row in gram)


@dataclass(frozen=True)
class Fit:
    """Rates as a column over ``p``, and the expected totals by domain that they give."""

    rate: Column
    reached: dict[str, float]
    rounds: int
    missed: dict[str, float]  # reached minus wanted of the domains that are off target


def fit_rates(members: DataFrame, names: tuple[str, ...], targets: Mapping[str, float], rounds: int = ROUNDS) -> Fit:
    """Nonnegative rates whose expected domain totals are closest to ``targets`` (tokens by domain).

    ``members`` has ``n_tokens`` and ``p``. Starts from rate 1 and goes on until every domain is within ``CLOSE`` of its own
    target (a target of 0: of nothing), by Newton's method where ``rounds`` of descent do not suffice; what is still
    missed, as where no nonnegative rates reach it, is warned of and returned. Domains without expected tokens cannot be reached and only count as missed;
    targets for unknown domains are left out; a domain without a target gets 0.
    """
    if not names:
        return Fit(F.lit(1.0), {}, 0, {})
    n, p = F.col("n_tokens"), [F.get("p", F.lit(k)) for k in range(len(names))]
    size = range(len(names))
    grams = [F.sum(n * p[i] * p[j]).alias(f"g{i}_{j}") for i in size for j in size if i <= j]
    first = members.agg(*grams, *(F.sum(n * p[k]).alias(f"n{k}") for k in size)).first()
    gram = [[first[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in size] for i in size]
    want = [float(targets.get(name, 0.0)) for name in names]
    scale = [1 / gram[k][k] if gram[k][k] > 0 else 0.0 for k in size]
    step = 1 / max(_largest([[math.sqrt(scale[i] * scale[j]) * gram[i][j] for j in size] for i in size]), 1e-300)
    floor = CLOSE * CLOSE * sum(first[f"n{k}"] or 0.0 for k in size)
    close = [max(CLOSE * w, floor if w == 0 else 0.0) for w in want]
    now, rate = members, F.lit(1.0)
    moves: list[list[float]] = []
    while True:
        sums = now.agg(*(F.sum(n * rate * p[k]).alias(f"e{k}") for k in size)).first()
        reached = [x or 0.0 for x in sums]
        gap = [reached[k] - want[k] for k in size]
        met = all(abs(gap[k]) <= close[k] for k in size if scale[k])
        if len(moves) == rounds or met:
            break
        if moves and len(moves) % STRETCH == 0:
            # The rates so far become a column, so that expressions stay short.
            now, rate = written(now.select("n_tokens", "p", rate.alias("__rate")), "mixing-rates"), F.col("__rate")
        moves.append([step * scale[k] * gap[k] for k in size])
        rate = F.greatest(F.lit(0.0), rate - sum((p[k] * moves[-1][k] for k in size), F.lit(0.0)))
    rate = F.lit(1.0)
    if moves:
        each = F.array(*(F.array(*map(F.lit, m)) for m in moves))
        step_of = lambda r, m: F.greatest(F.lit(0.0), r - sum((p[k] * F.get(m, F.lit(k)) for k in size), F.lit(0.0)))
        rate = F.aggregate(each, rate, step_of)
    if not met:
        nearest = sum(scale[k] * gap[k] ** 2 for k in size)
        other, found = _newton(members, want, close, scale)
        if sum(scale[k] * (found[k] - want[k]) ** 2 for k in size) < nearest:
            rate, reached, gap = other, found, [found[k] - want[k] for k in size]
    missed = {names[k]: gap[k] for k in size if abs(gap[k]) > close[k]}
    if missed:
        warnings.warn(f"mixing misses its targets, in tokens: {missed}", stacklevel=2)
    return Fit(rate, dict(zip(names, reached)), len(moves), missed)


def _newton(members: DataFrame, want: list[float], close: list[float], scale: list[float]) -> tuple[Column, list[float]]:
    """Rates ``max(0, 1 - l p)`` that meet the targets with the least change from 1, and the totals they give.

    Newton's method on the dual, with step halving; a trial is one aggregation. A large penalty in place of equality gives
    the nearest totals where the targets cannot be met.
    """
    use = [k for k in range(len(want)) if scale[k] > 0]
    n, p = F.col("n_tokens"), [F.get("p", F.lit(k)) for k in range(len(want))]

    def rate_of(dual: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - sum((p[k] * float(x) for k, x in zip(use, dual)), F.lit(0.0)))

    def trial(dual: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, list[float]]:
        rate = F.col("__rate")
        rows = members.select("n_tokens", "p", rate_of(dual).alias("__rate"))
        active = F.when(rate > 0, n).otherwise(0)
        pairs = [(i, j) for i in use for j in use if i <= j]
        row = rows.agg(
            F.sum(n * rate * rate),
            *(F.sum(n * rate * x) for x in p),
            *(F.sum(active * p[i] * p[j]) for i, j in pairs),
        ).first()
        values = [x or 0.0 for x in row]
        totals = values[1 : 1 + len(p)]
        gram = np.zeros((len(want), len(want)))
        for (i, j), x in zip(pairs, values[1 + len(p) :]):
            gram[i, j] = gram[j, i] = x
        soft = np.array([1 / (PENALTY * scale[k]) for k in use])
        aim = np.array([want[k] for k in use])
        value = values[0] / 2 + float(dual @ aim + (soft * dual * dual).sum() / 2)
        slope = aim - np.array([totals[k] for k in use]) + soft * dual
        return value, slope, gram[np.ix_(use, use)] + np.diag(soft), totals

    dual = np.zeros(len(use))
    value, slope, bend, totals = trial(dual)
    trials = 1
    while trials < TRIALS and any(abs(totals[k] - want[k]) > close[k] for k in use):
        size = np.sqrt(np.diag(bend))
        move = -np.linalg.lstsq(bend / np.outer(size, size), slope / size, rcond=None)[0] / size
        part = 1.0
        while trials < TRIALS:
            new = trial(dual + part * move)
            trials += 1
            if new[0] <= value + 1e-4 * part * float(slope @ move):
                break
            part /= 2
        else:
            break
        if value - new[0] <= 1e-15 * abs(value):
            dual, totals = dual + part * move, new[3]
            break
        dual, (value, slope, bend, totals) = dual + part * move, new
    return rate_of(dual), totals


def mix(docs: DataFrame, labels: DataFrame, shares: Mapping[str, float] = TARGETS, total: float = 0.8) -> DataFrame:
    """(doc_id, n_tokens, p_<domain> ..., rate) for every document.

    ``shares`` are the wanted shares of the domains in a mix of ``total`` times all tokens. A null or empty text has one
    token. Repeated rows have a rate each; without labelled documents there is no domain and every rate is 1.
    """
    model = fit(docs, domains(labels))
    members = written(posteriors(features(docs), model), "mixing-members")
    tokens = members.agg(F.sum("n_tokens")).first()[0] or 0
    found = fit_rates(members, model.domains, {name: tokens * total * share for name, share in shares.items()})
    each = [F.get("p", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(model.domains)]
    return members.select("doc_id", "n_tokens", *each, found.rate.alias("rate"))
