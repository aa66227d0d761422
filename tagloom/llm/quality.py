"""Quality rules as a ledger of failure bits, so that policies and ablations never read the texts again.

``ledger`` evaluates every rule once per document with SQL functions only and stores the measurements together with
one bit per failed rule. A policy is a named, versioned set of rules, that is a mask; applying it, or leaving rules
out of it, is a bitwise test on the stored bits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WHITE, let, words_of

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A named condition over the measurements under which a document fails."""

    name: str
    fails: Callable[[], Column]


@dataclass(frozen=True)
class Policy:
    """A version of the rules that a document has to pass."""

    version: str
    rules: tuple[str, ...]


BASE = ("few_words", "repeated_words")
RULES = (
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule("symbols", lambda: F.col("n_symbols") > 2 * F.col("n_words")),
    Rule("repeated_lines", lambda: (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 25 * F.col("n_words")),
)
POLICIES = (Policy("base", BASE), Policy("2", tuple(r.name for r in RULES)))


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs at least twice in the array."""

    def covered(grams: Column) -> Column:
        # Neighbours in sorted order tell which windows repeat; a covered word is counted at the last window start
        # at or before it, so the starts alone suffice.
        order = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(x, i + 1) | ((i > 0) & same(x, i - 1)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        steps = let(
            let(order, starts),
            lambda at: F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
        )
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, n: total + n)

    def repeats(s: Column) -> Column:
        return F.exists(F.transform(s, lambda g, i: g == F.get(s, i + 1)), lambda same: same)

    def of(w: Column) -> Column:
        grams = F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
            lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)),
        )
        return let(
            grams,
            lambda g: F.when(let(F.sort_array(g), repeats), covered(g)).otherwise(F.lit(0).cast("bigint")),
        )

    return let(words, of)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of every whole text; a null text counts as empty.

    ``n_lines`` and ``n_dup_lines`` count lines with a word, the latter those equal to an earlier one. Windows are
    told apart by a 64-bit hash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.length(F.translate(body, chars, ""))
    long = lambda c: c.cast("bigint")
    lines = F.filter(F.split(body, "\n"), lambda line: F.trim(line, F.lit(WHITE)) != "")
    measured = docs.withColumn("__words", words_of(body)).withColumn("__lines", lines)
    return measured.withColumns(
        {
            "n_words": long(F.size("__words")),
            "word_chars": long(without(WHITE)),
            "n_symbols": long(F.length(body) - without(SYMBOLS)),
            "n_lines": long(F.size("__lines")),
            "n_dup_lines": long(F.size("__lines") - F.size(F.array_distinct("__lines"))),
            "n_repeat_words": _repeat_words(F.col("__words")),
        }
    ).drop("__words", "__lines")


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: the key, the measurements and ``failed``, the bits of the failed rules.

    Reads the key and the text only, so other columns may have any name. Null and empty texts have no words; repeated
    rows stay repeated; an empty table gives an empty ledger. At most 63 rules fit.
    """
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    rows = measure(docs.select(F.col(key), F.col(text).alias("__text")), "__text").drop("__text")
    bits = F.lit(0).cast("bigint")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return rows.withColumn("failed", bits)


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    at = {rule.name: k for k, rule in enumerate(rules)}
    return sum(1 << at[name] for name in names)


def apply_policy(rows: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES, name: str = "kept") -> DataFrame:
    """Add whether a ledger row passes a policy."""
    return rows.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask(policy.rules, rules))) == 0)


def ablations(rows: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: rows it fails, rows it alone fails, and rows kept without it.

    Rows are first counted per bit pattern, of which there are at most 2^rules, so only patterns are shuffled.
    """
    whole = mask(policy.rules, rules)
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask([r], rules)).cast("bigint").alias("bit"))
                               for r in policy.rules)))
    part = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    bits, bit = F.col("bits"), F.col("r.bit")
    return (
        patterns.withColumn("r", each)
        .groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule"))
        .agg(
            part(bits.bitwiseAND(bit) != 0).alias("n_failed"),
            part(bits == bit).alias("n_failed_alone"),
            part(bits.bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
        )
    )
