"""The pipeline's stages one by one against plain Python."""

from __future__ import annotations

import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from tagloom.llm import packing

from .test_operators import brute_components

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 5), (9003, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    tables = [docs]
    for _, stage in pipeline.STAGES:
        found = stage(spark, tables[-1], FOLDER)
        tables.append(spark.createDataFrame(found.collect(), found.schema))
    for table in tables[1:-1]:
        assert table.columns == list(pipeline.COLUMNS)
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert ids[0] - ids[1] == {9001, 9002, 9003}

    rows = sorted((r.doc_id, r.text) for r in tables[1].collect())
    kept = {rows[k][0] for k, _, _, lead in brute_components([t for _, t in rows]) if lead}
    assert ids[2] == kept

    for r in tables[3].collect():
        assert r.n_chars == len(r.text)
        assert not re.search(r"[a-z0-9.]+@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}", r.text)

    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    dropped = ids[3] - ids[4]
    clean = {k for k, r in labels.items() if r.quality == 1 and r.toxic == 0}
    toxic = {k for k, r in labels.items() if r.toxic == 1} & ids[3]
    assert not dropped & clean and len(dropped & toxic) >= 0.6 * len(toxic)

    lengths = {r.doc_id: len(WORD.findall(r.text)) + 1 for r in tables[4].collect()}
    packed = {r.doc_id: r.n for r in tables[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert packed == lengths
    assert tables[5].where(F.col("length") > F.least(F.lit(packing.MAX_LEN), "bucket_len")).count() == 0


def test_pipeline_of_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_without_a_unique_id_are_decided_one_by_one(spark):
    """Unlike texts of one id are documents of their own; so are rows without an id, near copies of which leave one."""
    long = lambda word: " ".join(f"{word}{k}" for k in range(60))
    rows = [
        (1, long("a")), (1, long("b")), (1, long("b")), (None, long("c")), (None, long("c") + " end"), (None, long("d")),
        (2, long("a") + " end"), (3, long("e")), (0, long("d") + " tail"), (None, None), (4, None), (4, ""),
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], pipeline.table(spark, FOLDER, "documents").schema)
    found = pipeline.near_duplicates(spark, docs, FOLDER)
    assert found.columns == list(pipeline.COLUMNS)
    kept = sorted(((r.doc_id, r.text) for r in found.collect()), key=repr)
    one_c = [t for k, t in kept if t and t.startswith("c0")]
    assert len(one_c) == 1
    rest = [(1, long("a")), (1, long("b")), (3, long("e")), (0, long("d") + " tail"), (None, None), (4, None), (4, "")]
    assert sorted([r for r in kept if r[1] not in one_c], key=repr) == sorted(rest, key=repr)

    mixed = pipeline.mixed(spark, found, FOLDER)
    assert mixed.columns == list(pipeline.COLUMNS)
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= set(kept)
    assert pipeline.row_keys(docs.where("doc_id in (0, 2, 3)")) is None


def test_texts_are_not_sorted_to_drop_rows(spark):
    """Rows are kept by their ids: tasks hold a table of these, not the sorted texts of a partition."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(40)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (pipeline.near_duplicates, pipeline.mixed):
            plan = stage(spark, docs, FOLDER)._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" in plan and not re.search(r"Sort \[doc_id", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
