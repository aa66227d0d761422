"""Small operators on hand-made rows: invalid values, post-processing, scalars, types."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tagloom import Catalog, Tag, compute_tag
from tagloom.functions import blank, lenient_date, lenient_double, lenient_int, round_half_up, trim_token, trim_token_end
from tagloom.operators.items import basic_frame, basic_pairs, one_per_key
from tagloom.operators.postprocess import post_process
from tagloom.operators.values import INVALID_TEXTS, exclude_invalid, single_value
from tagloom.spec import Item, PostProcess
from tagloom.types import normalize_types, system_type_of_name, to_system


def values(df, column):
    return [r[column] for r in df.collect()]


def test_strict_mode_drops_every_invalid_text(spark):
    df = spark.createDataFrame([(1, "ok"), (2, None), *[(3, t) for t in INVALID_TEXTS]], "k long, v string")
    assert values(exclude_invalid(df, "v"), "v") == ["ok"]
    assert len(values(exclude_invalid(df, "v", "compat"), "v")) == 1 + len(INVALID_TEXTS)


def test_strict_mode_on_numbers(spark):
    df = spark.createDataFrame([(1.0,), (None,), (math.nan,), (math.inf,), (-math.inf,)], "v double")
    assert values(exclude_invalid(df, "v"), "v") == [1.0, -math.inf]
    assert len(values(exclude_invalid(df, "v", "compat"), "v")) == 4


@pytest.mark.parametrize(
    "value, post, lower, expected",
    [
        (50.0, {"standard": 200.0, "weight": 0.5}, False, 12.5),
        (50.0, {"standard": 200.0, "weight": 0.5}, True, 200.0),
        (0.0, {"standard": 200.0}, True, 0.0),
        (50.0, {"standard": 0.0}, False, 0.0),
        (0.25, {}, False, 25.0),
    ],
)
def test_weight(spark, value, post, lower, expected):
    item = Item("v", type="double", post=PostProcess("weight", **post), lower_is_better=lower)
    row = post_process(spark.createDataFrame([(1, value)], "k long, v double"), item).first()
    assert (row["v_ctr"], row["v"]) == (value, expected)


@pytest.mark.parametrize(
    "value, low, high, expected",
    [(-5.0, 0.0, 10.0, 0.0), (15.0, 0.0, 10.0, 10.0), (5.0, 8.0, 3.0, 3.0), (math.nan, 0.0, None, 0.0), (math.nan, None, 10.0, 10.0)],
)
def test_clamp(spark, value, low, high, expected):
    item = Item("v", type="double", post=PostProcess("number", min=low, max=high))
    assert post_process(spark.createDataFrame([(1, value)], "k long, v double"), item).first()["v"] == expected


def test_post_process_input_types(spark):
    post = PostProcess("weight")
    text = spark.createDataFrame([(1, "2.5"), (2, "bad")], "k long, v string")
    assert values(post_process(text, Item("v", post=post)), "v") == [250.0, 0.0]
    day = spark.createDataFrame([(1, dt.date(1970, 1, 2))], "k long, v date")
    assert values(post_process(day, Item("v", type="date", post=post)), "v") == [8_640_000_000.0]
    whole = spark.createDataFrame([(1, 3)], "k long, v long")
    out = post_process(whole, Item("v", type="int", post=PostProcess("weight", standard=7.0)))
    assert out.first()["v"] == 43 and out.schema["v"].dataType.typeName() == "long"


def test_post_process_is_skipped_without_kind_or_json():
    assert PostProcess.from_json("none", '{"min": 1}') is None
    assert PostProcess.from_json("weight", " ") is None
    assert PostProcess.from_json(None, '{"min": 1}') is None
    assert PostProcess.from_json("NUMBER", '{"min": "1", "max": "", "weight": null}') == PostProcess("number", min=1.0)


def test_round_half_up(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (math.nan,), (-0.4,)], "v double")
    assert values(df.select(round_half_up(F.col("v")).alias("v")), "v") == [3, -2, 0, 0]


def test_trims(spark):
    df = spark.createDataFrame([("a,,,",), ("abab",), (None,), ("ab.ab",)], "s string")
    assert values(df.select(trim_token_end(F.col("s"), ",").alias("s")), "s") == ["a", "abab", "", "ab.ab"]
    assert values(df.select(trim_token_end(F.col("s"), "ab").alias("s")), "s") == ["a,,,", "", "", "ab."]
    assert values(df.select(trim_token(F.col("s"), "ab").alias("s")), "s") == ["a,,,", "", "", "."]


def test_lenient_parsing(spark):
    df = spark.createDataFrame([("12",), (" 7 ",), ("x",), ("",), (None,)], "s string")
    assert values(df.select(lenient_int(F.col("s")).alias("v")), "v") == [12, 7, 0, 0, 0]
    assert values(df.select(lenient_double(F.col("s")).alias("v")), "v") == [12.0, 7.0, 0.0, 0.0, 0.0]
    assert values(df.select(blank(F.col("s")).alias("v")), "v") == [False, False, False, True, True]


def test_lenient_dates(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02", "1704067200000", "soon"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    shown = df.select(lenient_date(F.col("s")).cast("string").alias("v"))
    assert values(shown, "v") == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", "2024-01-01 00:00:00", None]


@pytest.mark.parametrize(
    "name, system",
    [("VARCHAR", "string"), ("mediumint", "int"), ("year", "double"), ("datetime", "date"), ("bit", "byte"), ("json", "string"), (None, "string")],
)
def test_database_type_names(name, system):
    assert system_type_of_name(name) == system


def test_normalize_types(spark):
    df = spark.sql(
        "SELECT 1 AS i, cast(2 AS decimal(9, 2)) AS d, true AS b, timestamp'2024-01-02 03:04:05' AS t, array(1) AS a, X'00' AS y"
    )
    out = normalize_types(df)
    assert [f.dataType.typeName() for f in out.schema.fields] == ["long", "double", "string", "date", "string", "binary"]
    assert out.first()[:5] == (1, 2.0, "true", dt.date(2024, 1, 2), "[1]")


def test_casts_never_fail_the_job(spark):
    df = spark.createDataFrame([("12", 1.5), ("x", 2.0)], "s string, d double")
    for system in ("int", "double", "date", "byte", "string"):
        for field in df.schema.fields:
            df.select(to_system(F.col(field.name), field.dataType, system)).collect()
    assert values(df.select(to_system(F.col("s"), df.schema["s"].dataType, "int").alias("v")), "v") == [12, None]


def test_duplicate_rules(spark):
    df = spark.createDataFrame([(1, 5.0, 2), (1, 8.0, 1), (2, 3.0, 1), (2, None, 9)], "k long, v double, t long")

    def by(rule):
        return {r["k"]: r["v"] for r in df.groupBy("k").agg(single_value(rule, F.col("v"), F.col("t")).alias("v")).collect()}

    assert by("max") == {1: 8.0, 2: 3.0}
    assert by("latest") == {1: 5.0, 2: 3.0}
    with pytest.raises(Exception, match="several values"):
        by("error")
    assert df.where("k = 2").groupBy("k").agg(single_value("error", F.col("v")).alias("v")).first()["v"] == 3.0


def test_counts_and_totals_of_a_shared_scan(spark):
    facts = spark.createDataFrame(
        [(1, 5, "a"), (1, 7, None), (1, 7, ""), (2, None, "b"), (3, 2**62, "c"), (3, 2**62, "d"), (None, 1, "e")], "k long, v long, s string"
    )
    catalog = Catalog(spark).add("facts", facts)
    of = lambda name, content, rule, **more: Item(name, "basic", content, table="facts", key_column="k", duplicates=rule, **more)
    tag = Tag(
        "t",
        (
            Item("k", "key", "k", table="facts", type="int"),
            of("n", "1", "count", type="int"),
            of("texts", "s", "count", type="int"),  # null and blank texts are no values
            of("as_text", "v", "count", default="none"),
            of("total", "v", "sum", type="int", default="-1"),
            of("part", "v", "sum", type="double", filter="v > 5"),
            of("words", "s", "sum", default="bad"),
            of("top", "v", "max", type="int"),
        ),
    )
    result = compute_tag(catalog, tag)
    assert result.failed == {"words"} and "only numbers" in result.messages[0]
    rows = sorted(tuple(r) for r in result.frame.collect())
    assert rows == [
        (1, 3, 1, "3", 19, 14.0, "bad", 7),
        (2, 1, 1, "none", -1, 0.0, "bad", 0),
        (3, 2, 2, "2", -1, 2.0**63, "bad", 2**62),
    ]
    # Read alone, an item gives the same.
    alone = basic_frame(catalog, tag.key, [tag.items[1]]).union(
        one_per_key(basic_pairs(catalog, tag.key, tag.items[1]), tag.key, tag.items[1])
    )
    assert sorted(tuple(r) for r in alone.collect()) == [(1, 3), (1, 3), (2, 1), (2, 1), (3, 2), (3, 2)]
