"""Line dedup, fill-in-the-middle and clustering against brute force, and their defined results on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import clusters, fim, linededup

from .test_operators import ODD, clashing, lower

WHITE = " \t\n\x0b\f\r"


# line dedup


def brute_lines(pairs, min_chars=10, min_docs=2):
    """(id, lines, dropped, kept text) of every row."""
    key = lambda line: lower(line.strip(WHITE))
    holders = defaultdict(set)
    for id, text in pairs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(id)
    out = []
    for id, text in pairs:
        lines = (text or "").split("\n")
        gone = lambda line: (
            len(holders[key(line)]) >= min_docs and id != min(holders[key(line)], key=lambda h: (h is None, h))
        )
        kept = [line for line in lines if not gone(line)]
        out.append((id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_equal_brute_force(spark, make_docs, min_docs):
    rng = random.Random(11)
    pool = ["The Same Long Line", " the same long line\r", "ÉCOLE normale supérieure", "école normale supérieure", "short",
            "exactly10c", "exactly 9", "", "  \t ", "😀😀😀😀😀😀😀😀😀😀", "another line of text"]
    pairs = [(k % 37, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for k in range(60)]
    pairs += [(100 + k, text) for k, text in enumerate(ODD)]
    pairs += [(None, "another line of text\nonly here, without a name"), (None, "only here, without a name\n"), (5, None)]
    pairs += [(200, "twice in one text\ntwice in one text"), (201, "x\n" * 50_000 + "The same long line")]
    rows = linededup.drop_lines(clashing(make_docs(pairs)), min_docs=min_docs).collect()
    assert order(rows) == order(brute_lines(pairs, 10, min_docs))


def test_lines_of_empty_tables_and_wrong_thresholds(spark, make_docs):
    docs = make_docs([])
    assert linededup.drop_lines(docs).collect() == []
    with pytest.raises(ValueError, match="at least 2"):
        linededup.drop_lines(docs, min_docs=1)


def test_frequent_lines_are_salted(spark, make_docs):
    common = "a line that every document holds"
    pairs = [(k, f"{common}\nown line number {k}\n{common}") for k in range(400)]
    docs = make_docs(pairs)
    found = linededup.drop_lines(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan and "CartesianProduct" not in plan
    assert order(found.collect()) == order(brute_lines(pairs))
    # One hash over the threshold, held by 400 documents.
    rows = docs.selectExpr("doc_id AS id", "xxhash64(text) AS h", "text")
    assert [(r.first, r.n) for r in linededup.shared_lines(rows).collect()] == [(0, 800)]


def test_lines_run_without_python(spark, make_docs):
    plan = linededup.drop_lines(make_docs(["one line of text\nand one more"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


# fill in the middle


def brute_cut(text, id):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexes = hashlib.sha256(f"7:{'' if id is None else id}".encode()).hexdigest()
    h = [int(hexes[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_cuts_equal_brute_force_and_come_back(spark, make_docs):
    rng = random.Random(12)
    texts = [*ODD, "a <P> b", "<", "<P\n>", "S>x\n<M", "\n", "\n\n\n", "no feed", "é\n😀😀\nz", "line\n" * 3000, "<\n<S\n<M\n"]
    texts += ["".join(rng.choice("ab<P>é😀\n") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    pairs = [*enumerate(texts), (None, "no id\nat all\n"), (3, "repeated\nid\n"), (3, "repeated\nid\n"), (-5, "x\ny\nz")]
    docs = clashing(make_docs(pairs)).withColumns({"n": F.lit("old"), "form": F.lit(1), "__fim_id": F.lit(2)})
    found = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert found.where("__fim_id != 2 or id != 1").count() == 0
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found.collect()]
    want = [(id, *brute_cut(text, id), text or "") for id, text in pairs]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(make_docs([])).collect() == []


def test_rates_of_forms():
    forms = [fim.rearranged("a\nb\n", str(k), rate=60, spm=25)[1] for k in range(4000)]
    assert abs(forms.count("plain") / 4000 - 0.4) < 0.03 and abs(forms.count("spm") / 4000 - 0.15) < 0.03


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 40_000])
def test_skip_list_finds_every_rank(n):
    rng = np.random.default_rng(n)
    widths = rng.integers(0, 50, n)
    units = fim.SkipList(widths)
    ends = np.concatenate(([0], np.cumsum(widths)))
    for rank in {0, n, *rng.integers(0, n + 1, 200).tolist()}:
        assert units.find(rank) == ends[rank]
    # Each lane covers a part of the one below and passes the same units and code points on the way.
    for (u, c, _), (upper_u, upper_c, below) in zip(units.lanes, units.lanes[1:]):
        assert len(upper_u) <= len(u)
        for j in range(len(upper_u)):
            assert sum(u[below[j] : below[j + 1]]) == upper_u[j] and sum(c[below[j] : below[j + 1]]) == upper_c[j]
    assert len(units.lanes) <= 3 + math.log2(n + 1) and sum(len(u) for u, _, _ in units.lanes) <= 2 * n + 10


# clusters


def brute_clusters(rows, count, dimensions, rounds):
    whole = lambda x: math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x)
    fit = [(i, v) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    vectors = [(i, [whole(x) for x in v]) for i, v in fit]
    centroids = [[whole(x) for x in v] for _, v in sorted(fit, key=name)[:count]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in vectors:
            members[near(v)[1]].append(v)
        centroids = [
            [sum(x) // len(members[k]) for x in zip(*members[k])] if members[k] else c for k, c in enumerate(centroids)
        ]
    found = [(i, *near(v)) for i, v in vectors]
    cut = lambda n: min(n, (1 << 63) - 1)
    inertia = defaultdict(int)
    for _, d, k in found:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, k, cut(d), cut(inertia[k]), cut(sum(inertia.values())), digest[k]) for i, d, k in found]


def vectors_of(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}").repartition(3).withColumn("cluster", F.lit("x"))


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e30, 1.6e308])
def test_clusters_equal_brute_force(spark, scale):
    rng = np.random.default_rng(13)
    rows = [(k, [float(f"{x:.6g}") for x in rng.normal(size=4) * (scale / 8)]) for k in range(120)]
    # Ties, repeated rows, a repeated id, a null id, and vectors that take no part.
    rows += [(200 + k, [0.5 * scale / 2, 0.0, 0.0, -0.5]) for k in range(30)] + [(7, [1.0] * 4), (7, [1.0] * 4), (None, [0.25] * 4)]
    rows += [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0, None, 1.0, 1.0]), (304, [math.nan] * 4), (305, [math.inf] * 4)]
    found = clusters.cluster(vectors_of(spark, rows), count=9, dimensions=4, rounds=3).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_clusters(rows, 9, 4, 3), key=repr)


def test_ties_favour_the_smaller_centroid():
    bisectors = clusters.Bisectors([[0, 0], [4, 0], [4, 0], [0, 4]])
    at, distance = bisectors.nearest(np.array([[2, 0], [4, 0], [2, 2], [3, 0], [0, 2]]))
    assert at.tolist() == [0, 1, 0, 1, 0] and distance.tolist() == [4, 0, 8, 1, 4]


def test_few_vectors_give_few_clusters(spark):
    rows = [(k, [float(k), 0.0]) for k in range(3)]
    assert len({r.cluster for r in clusters.cluster(vectors_of(spark, rows), dimensions=2).collect()}) == 3
    assert clusters.cluster(vectors_of(spark, rows), dimensions=5).collect() == []
    assert clusters.cluster(vectors_of(spark, [])).collect() == []
