"""Quality rules and line dedup: odd rows, hand-made cases, brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from works_risk.llm import line_dedup, quality_rules
from works_risk.operators import lookup


def _docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def _measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.sub(r"[\x20\x09-\x0D]+", "", x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None,
    "",
    " \t\n\v\f\r ",
    "a",
    "a b c a b c",
    "x x x x x",
    "# a* <b>\nrow\nrow\n \nrow",
    "Ünï cødé 日本 " * 30,
    "one two three " * 7000,
    "nbsp is no gap",
]


def test_measures_match_plain_python(spark):
    rows = list(enumerate(TEXTS))
    rng = random.Random(4)
    rows += [(100 + k, " ".join(rng.choices("ab", k=rng.randrange(12))) + rng.choice(["", "\n", "\na b"])) for k in range(60)]
    book = quality_rules.ledger(_docs(spark, rows)).collect()
    for row in book:
        text = dict(rows)[row.doc_id]
        assert tuple(row[m] for m in quality_rules.MEASURES) == _measures(text), row


def test_bits_policies_and_ablation(spark):
    rows = [(1, None), (2, "word " * 60), (3, " ".join(f"w{i}" for i in range(60))), (4, " ".join(f"w{i}##" for i in range(60))), (4, "a # b")]
    book = quality_rules.ledger(_docs(spark, rows))
    bits = {(r.doc_id, r.n_words): r.failed_bits for r in book.collect()}
    mask = quality_rules.mask_of
    assert bits == {(1, 0): mask("too_few_words"), (2, 60): mask("repeated_words"), (3, 60): 0, (4, 60): mask("symbols"), (4, 3): mask("too_few_words", "symbols", "short_words")}
    kept = quality_rules.apply_policy(book, quality_rules.POLICIES["base-1"]).filter("kept").count()
    assert kept == 2
    found = {(r.policy, r.rule): (r.n_docs, r.n_kept, r.n_failed, r.n_only_this_rule) for r in quality_rules.ablation(book).collect()}
    assert found["prose-1", "symbols"] == (5, 1, 2, 1)
    assert found["base-1", "too_few_words"] == (5, 2, 2, 2)


def test_rules_replace_clashing_columns_and_take_an_empty_table(spark):
    docs = _docs(spark, [(1, "a b", "mine", 9)], ", n_words string, other int")
    row = quality_rules.ledger(docs).collect()[0]
    assert (row.n_words, row.other) == (2, 9)
    assert quality_rules.ledger(docs.limit(0)).count() == 0
    assert quality_rules.ablation(quality_rules.ledger(docs.limit(0))).count() == 0


def _dedup_plain(rows):
    docs = sorted(rows, key=lambda r: r[0])
    seen, out = set(), {}
    for doc_id, text in docs:
        lines = text.split("\n")
        solid = [i for i, line in enumerate(lines) if line.strip(" \t\r")]
        gone = set()
        for k in range(len(solid) - 2):
            key = tuple(lines[i].strip(" \t\r") for i in solid[k : k + 3])
            if key in seen:
                gone |= set(solid[k : k + 3])
            seen.add(key)
        out[doc_id] = ("\n".join(line for i, line in enumerate(lines) if i not in gone), len(gone))
    return out


def test_line_dedup_matches_plain_python(spark):
    rng = random.Random(8)
    rows = [(k, "\n".join(rng.choice(["a", "b", " b ", "", "c"]) for _ in range(rng.randrange(1, 9)))) for k in range(60)]
    found = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(_docs(spark, rows)).collect()}
    assert found == _dedup_plain(rows)


def test_line_dedup_odd_rows(spark):
    three = "first line\nsecond line\nthird line"
    rows = [(None, three, 1), (2, three + "\nown", 2), (2, three + "\nown", 2), (3, None, 3), (4, "", 4), (5, "one", 5), (6, f"\n{three}\n", 6)]
    docs = _docs(spark, rows, ", n_removed int")
    found = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup(docs).collect()]
    assert sorted(found, key=str) == sorted(
        [(None, three, 0), (2, "own", 3), (2, "own", 3), (3, None, 0), (4, "", 0), (5, "one", 0), (6, "\n", 3)], key=str
    )
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_line_dedup_long_repetition(spark):
    text = "\n".join(["x", "y", "z"] * 3000)
    row = line_dedup.dedup(_docs(spark, [(1, text)])).collect()[0]
    assert (row.n_lines, row.n_removed) == (9000, 8997) and row.text == "x\ny\nz"


@pytest.mark.parametrize("hot", [0, 5000])
def test_attach_finds_hot_cold_and_missing_keys(spark, hot):
    rows = spark.range(3000 + hot).select(F.when(F.col("id") < hot, -1).otherwise(F.col("id") - hot).alias("k"), "id")
    rows = rows.union(spark.sql("SELECT CAST(NULL AS BIGINT), -5L"))
    facts = rows.filter("k % 2 <> 0").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    found = lookup.attach(rows, facts, "k", F.col("id"))
    assert found.count() == 3001 + hot
    assert found.filter("last IS NOT NULL").count() == 1500 + hot
    assert found.filter("k = -1 AND last <> %d" % (hot - 1)).count() == 0
