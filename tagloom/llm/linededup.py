"""Lines that many documents share, dropped everywhere but where they first occur; SQL functions only.

Lines are exploded with their place, normalised and hashed. One partial aggregation tells for every hash how many
documents hold it and which has the smallest id; hashes over the threshold meet the lines again, and each document is put
together anew from the places that stay. Texts are shuffled once, by their id, when the places are known.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .text import WHITE

MIN_CHARS = 10
MIN_DOCS = 2
# A hash with at least this share of all lines is salted, so there are at most as many as its inverse.
HOT_SHARE = 1 / 1000
SALTS = 64


def line_key(line: Column) -> Column:
    """A line without white space at both ends, A-Z lower-cased."""
    bare = F.trim(line, F.lit(WHITE))
    plain = F.octet_length(bare) == F.length(bare)  # lower() leaves other letters alone only in plain ASCII
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _places(docs: DataFrame, min_chars: int) -> DataFrame:
    """Every line whose key is long enough: its document, its place, and 128 bits of hash of its key."""
    lines = docs.select("id", "h", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("id", "h", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("id", "h", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(a, b, first, n)``: hashes of line keys that at least ``min_docs`` documents of ``(id, h, text)`` hold, the smallest
    id among them and the number of lines."""
    places = _places(docs, min_chars)
    # Rows without an id are together one document, after all others.
    nameless = F.max(F.when(F.col("id").isNull(), 1).otherwise(0))
    if min_docs <= 2:
        # Two different documents show in the least and the greatest id, without a shuffle of all (hash, id) pairs.
        several = F.when(F.min("id") < F.max("id"), 2).when(F.min("id").isNotNull(), 1).otherwise(0)
    else:
        several = F.count_distinct("id")
    found = places.groupBy("a", "b").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), (several + nameless).alias("n_docs")
    )
    return found.where(F.col("n_docs") >= min_docs).drop("n_docs")


def drop_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    paths: list[str] | None = None,
) -> DataFrame:
    """``(key, n_lines, n_dropped, kept)`` for every row: its lines, how many went, and the text of those that stay.

    A line goes if its key has at least ``min_chars`` code points, at least ``min_docs`` documents (2 or more) hold it, and
    this document is not the one with the smallest id among them; there all its occurrences stay. Rows with the same id are
    one document, each row is put together by itself, and repeated rows stay repeated. Rows without an id are together one
    document behind all others. A null or empty text is one empty line. No rows give no result. Only the two
    named columns are read, so others may have any name. Keys are told apart by 128 bits of hash. The hashes over the
    threshold are written to the shared folder; their path is added to ``paths``, if given.
    """
    if min_docs < 2:
        raise ValueError("a line is shared by at least 2 documents")
    named = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    # Rows of one id and text have the same places to drop, so these two name a row.
    rows = named.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    shared = written(shared_lines(rows, min_chars, min_docs), "shared-lines", paths)
    total = shared.agg(F.sum("n")).first()[0] or 0
    # Lines of a hash that is in very many documents are spread over salts, and the hash is repeated for each.
    often = F.col("n") >= F.lit(max(SALTS, HOT_SHARE * total))
    # At most 1 / HOT_SHARE hashes are broadcast, as each has that share of all lines.
    hot = F.broadcast(shared.where(often).select("a", "b", F.lit(SALTS).alias("salts")))
    spread = F.pmod(F.xxhash64("id", "h"), F.coalesce("salts", F.lit(1))).cast("int")
    places = _places(rows, min_chars).join(hot, ["a", "b"], "left").withColumn("salt", spread).drop("salts")
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(often, SALTS - 1).otherwise(0))))
    met = places.join(salted.select("a", "b", "salt", "first"), ["a", "b", "salt"])
    gone = met.where(~F.col("id").eqNullSafe(F.col("first")))
    lost = gone.groupBy(F.col("id").alias("lost_id"), F.col("h").alias("lost_h")).agg(F.collect_set("pos").alias("lost"))
    joined = rows.join(lost, rows.id.eqNullSafe(lost.lost_id) & (rows.h == lost.lost_h), "left")
    lines = lines_of(F.col("text"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    stay = F.transform(F.array_except(every, "lost"), lambda p: F.get("lines", p))
    none = F.col("lost").isNull()
    return joined.withColumn("lines", lines).select(
        F.col("id").alias(key),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("lost")).cast("bigint").alias("n_dropped"),
        F.when(none, F.coalesce("text", F.lit(""))).otherwise(F.array_join(stay, "\n")).alias("kept"),
    )
