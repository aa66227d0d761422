"""Documents to packed training sequences: language, near copies, personal data, mix, packing.

Each stage takes (spark, docs, folder of the tables) and works on all rows its predecessor kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import langid, mixing, neardup, packing, pii
from tagloom.llm.queries import tokenizer_file
from tagloom.llm.text import table
from tagloom.operators.paging import with_position
from tagloom.sources.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Scores below this are a guess among several languages.
MIN_SCORE = 0.5
# Expected tokens to keep of each domain; toxic documents should all but vanish.
KEEP = {"clean": 1.0, "low": 0.7, "toxic": 0.05}


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is determined. ``lang`` becomes the predicted one."""
    vocabulary = tokenizer_file(langid.VOCABULARY)
    model = langid.fit(docs, vocabulary)
    found = langid.predict(docs, model, vocabulary)
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)
    return found.where(sure).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def row_keys(docs: DataFrame) -> DataFrame | None:
    """The rows with a key of their own each, ``row_key``, written once; None if doc_id is such a key.

    Keys rise with doc_id, rows without an id come last. Rows that agree in id and text are one.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return None
    named = docs.withColumn("row_hash", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()))
    order = (F.col("id").asc_nulls_last(), F.col("hash"))
    narrow = named.select(F.col("doc_id").alias("id"), F.col("row_hash").alias("hash")).distinct()
    keys = with_position(narrow, *order, name="row_key")
    one = named.dropDuplicates(["doc_id", "row_hash"])
    same = one.doc_id.eqNullSafe(keys.id) & (one.row_hash == keys.hash)
    return written(one.join(keys, same).drop("id", "hash", "row_hash"), "pipeline-rows")


def only(docs: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """The rows whose id is among distinct ``ids``. Tasks hold a table of ids and pass texts on, which a merge join would sort."""
    return docs.join(ids.hint("shuffle_hash"), id, "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of rows that agree in id and text, one.

    Unlike texts with one id, and rows without an id, are documents of their own.
    """
    keyed = row_keys(docs)
    rows = docs if keyed is None else keyed.drop("doc_id").withColumnRenamed("row_key", "doc_id")
    lead = neardup.near_duplicates(rows).where("kept").select("doc_id").distinct()
    if keyed is None:
        return only(docs, lead, "doc_id").select(*COLUMNS)
    return only(keyed, lead.withColumnRenamed("doc_id", "row_key"), "row_key").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents with personal data masked."""
    return pii.masked(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents kept at their mixing rate.

    A document stays with its rate as probability, decided by a hash of its id. One that is most probably of a domain kept in
    full always stays, whatever small share of other domains the classifier sees in it. Labelled documents are of the
    domain of their label.
    """
    labelled = mixing.domains(table(spark, folder, "labels"))
    keyed = row_keys(docs)
    if keyed is not None:
        # Rows are decided by keys of their own; a label is of every row that has its id.
        ids = keyed.select("doc_id", "row_key")
        labelled = labelled.join(ids, "doc_id").drop("doc_id").withColumnRenamed("row_key", "doc_id")
        docs = keyed.withColumnRenamed("doc_id", "own_id").withColumnRenamed("row_key", "doc_id")
    model = mixing.fit(docs, labelled)
    names = model.domains
    members = mixing.posteriors(mixing.features(docs), model)
    members = written(mixing.with_known(members, labelled, names), "pipeline-members")
    sums = [F.sum(F.col("n_tokens") * F.get("p", F.lit(k))).alias(n) for k, n in enumerate(names)]
    totals = members.agg(*sums).first().asDict() if names else {}
    fit = mixing.fit_rates(members, names, {n: KEEP.get(n, 1.0) * (totals[n] or 0.0) for n in names})
    full = [n for n in names if KEEP.get(n, 1.0) >= 1]
    top = F.array_max("p")
    whole = F.lit(not names)
    for k, n in enumerate(names):
        if n in full:
            whole = whole | (F.get("p", F.lit(k)) == top)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    kept = members.where(whole | (chance < fit.rate)).select("doc_id").distinct()
    rows = only(docs, kept, "doc_id")
    if keyed is not None:
        rows = rows.drop("doc_id").withColumnRenamed("own_id", "doc_id")
    return rows.select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Padded sequences in token-budget batches."""
    return packing.pack(packing.word_lengths(docs))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixed),
    ("packing", packed),
]
# The stages hold trained models, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read back by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
