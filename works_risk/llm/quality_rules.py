"""Rule bitmask ledger: every rule runs once per document, policies and ablations only read the stored bits.

``ledger`` writes, per document, the measurements and one long whose bit *k* is set when rule *k* failed.
A policy is a named, versioned mask over those bits, so a changed policy never touches a text again:
``apply_policy`` is one bitwise AND, and ``ablation`` folds the ledger to one row per distinct bit pattern before
it asks, for each rule, how many documents only that rule rejects.

Everything is column expressions: no Python runs on the executors and no row moves before ``ablation``.

Defined results: a null or blank text has no words, all measurements 0, and fails ``too_few_words``. Repeated rows are
judged alike, one row out per row in. A text of any length is read whole. Columns named like an output column
are replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GAP = r"[\x20\x09-\x0D]+"
_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A named test over the measurements; true means the document fails. Its place in the list is its bit."""

    name: str
    fails: Callable[[], Column]


def _m(name: str) -> Column:
    return F.col(name)


RULES: tuple[Rule, ...] = (
    Rule("too_few_words", lambda: _m("n_words") < 50),
    Rule("repeated_words", lambda: 100 * _m("n_repeat_words") > 50 * _m("n_words")),
    Rule("symbols", lambda: 100 * _m("n_symbols") > 10 * _m("n_words")),
    Rule("repeated_lines", lambda: 100 * _m("n_dup_lines") > 30 * _m("n_lines")),
    Rule("short_words", lambda: _m("word_chars") < 2 * _m("n_words")),
    Rule("long_words", lambda: _m("word_chars") > 15 * _m("n_words")),
)


def mask_of(*names: str, rules: tuple[Rule, ...] = RULES) -> int:
    """The mask of the named rules."""
    bits = {rule.name: 1 << k for k, rule in enumerate(rules)}
    return sum(bits[n] for n in names)


#: Versioned policies. A version is never edited; a changed policy gets a new one.
POLICIES: Mapping[str, int] = {
    "base-1": mask_of("too_few_words", "repeated_words"),
    "prose-1": mask_of(*(rule.name for rule in RULES)),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also when a lambda refers to it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(starts: Column) -> Column:
    """Positions covered by windows at the ascending ``starts``, each position once."""
    step = F.transform(
        starts,
        lambda at, i: F.least(F.coalesce(F.get(starts, i + 1) - at, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"),
    )
    return F.aggregate(step, F.lit(0).cast("long"), lambda total, x: total + x)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    Windows are sorted by hash, so equal ones are neighbours and a text of n words costs n log n.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("at")),
    )

    def starts(ordered: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            h = x.getField("h")
            near = (F.get(ordered, i - 1).getField("h") == h) | (F.get(ordered, i + 1).getField("h") == h)
            return F.when(near, x.getField("at"))

        return F.sort_array(F.filter(F.transform(ordered, again), lambda at: at.isNotNull()))

    found = _let(F.sort_array(windows), lambda ordered: _let(starts(ordered), _covered))
    return F.when(F.size(words) >= WINDOW, found).otherwise(F.lit(0).cast("long"))


def _dup_lines(text: Column) -> Column:
    """(lines with a word, those among them that equal an earlier line)"""
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_replace(line, _GAP, "") != "")
    return _let(
        lines,
        lambda ls: F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        ),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurement columns, each as long."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, _GAP), lambda w: w != "")
    by_word = _let(
        words,
        lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), _repeat_words(ws).alias("n_repeat_words")),
    )
    kept = [c for c in docs.columns if c.lower() not in {*MEASURES, "_w", "_l"}]
    raw = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        by_word.alias("_w"),
        _dup_lines(body).alias("_l"),
        F.length(F.regexp_replace(body, _GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, _SYMBOL, "")).cast("long").alias("n_symbols"),
    )
    return raw.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("_w.n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.n_lines"),
        F.col("_l.n_dup_lines"),
        F.col("_w.n_repeat_words"),
    )


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with measurements and ``failed_bits``."""
    return measure(docs, text).withColumn("failed_bits", failure_bits(rules))


def apply_policy(book: DataFrame, mask: int, name: str = "kept") -> DataFrame:
    """Add ``name``: true where no rule of the mask failed."""
    return book.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablation(book: DataFrame, policies: Mapping[str, int] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: documents the rule fails, documents that only this rule rejects, and what the policy keeps.

    The ledger folds to one row per bit pattern first (at most 2**rules), so the shuffle does not grow with the rows.
    """
    folded = book.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    tests = [
        F.struct(
            F.lit(policy).alias("policy"),
            F.lit(rule.name).alias("rule"),
            F.lit(mask).cast("long").alias("mask"),
            F.lit(1 << k).cast("long").alias("bit"),
        )
        for policy, mask in policies.items()
        for k, rule in enumerate(rules)
        if mask >> k & 1
    ]
    hit = F.col("failed_bits").bitwiseAND(F.col("t.mask"))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    return (
        folded.withColumn("t", F.explode(F.array(*tests)))
        .groupBy(F.col("t.policy").alias("policy"), F.col("t.rule").alias("rule"))
        .agg(
            F.sum("n").cast("long").alias("n_docs"),
            count(hit == 0).alias("n_kept"),
            count(F.col("failed_bits").bitwiseAND(F.col("t.bit")) != 0).alias("n_failed"),
            count(hit == F.col("t.bit")).alias("n_only_this_rule"),
        )
    )
