"""What the findings of round 4 asked for: less moved and less kept on disk, the same rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from works_risk import Params
from works_risk.functions.cleaning import WORK_ID
from works_risk.functions.vectors import hashed_bigrams, hashed_trigrams
from works_risk.operators import dossier, duplicates
from works_risk.operators.texts import distinct_texts, text_key

PARAMS = Params(ref_date=dt.date(2025, 6, 1))
WORDS = ["construction of a drain in ward one", "construction of a drain in ward two", "hand pump near the school", "  ", None]


@pytest.fixture
def described(spark):
    """Works in blocks of three, so that each text stands in many blocks and most blocks hold copies."""
    rows = [(f"MP{k % 4}/{k}", str(k % 4), f"fy{k % 3}", 1000 * (k // 12), WORDS[k // 8 % 5]) for k in range(96)]
    return spark.createDataFrame(rows, "work_id string, mp_no string, fy string, recommended_amount int, work_desc string")


def keyed(rows):
    named = rows.withColumn("work_desc", F.nullif(F.trim("work_desc"), F.lit("")))
    texts = distinct_texts(named.select("work_desc"))
    return named.withColumn("text_id", F.coalesce(text_key(F.col("work_desc")), F.lit(""))).drop("work_desc"), texts


def test_a_text_of_many_blocks_is_embedded_once(spark, described):
    asked = spark.sparkContext.accumulator(0)

    def counted(texts):
        asked.add(len(texts))
        return hashed_trigrams(texts)

    rows, texts = keyed(described)
    found = duplicates.duplicate_signals(rows, PARAMS, counted, texts, once=True)
    plain = duplicates.duplicate_signals(described, PARAMS)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    assert plain.filter("dup_partner_count > 0").count() > 20
    assert asked.value == 3


def test_links_of_a_sweep_name_texts_by_numbers(described, monkeypatch):
    monkeypatch.setattr(duplicates, "TOGETHER", 3)  # the vectors of texts that stand in more blocks are broadcast
    rows, texts = keyed(described)
    models = {"tuned": hashed_trigrams, "frozen": hashed_bigrams}
    status = described.select("work_id", F.col("fy").alias("work_status"), F.col("mp_no").alias("mp_name"))
    results = []
    for master, known in ((rows, texts), (described, None)):
        found = duplicates.sweep_texts(master, models, PARAMS, texts=known)
        assert dict(found.links.dtypes)["item_a"] == "bigint"
        results.append(sorted(map(tuple, duplicates.work_pairs(found, status).collect())))
        counts = {r["model"]: r["pairs"] for r in duplicates.link_counts(found).collect()}
        assert counts == {m: sum(r[0] == m for r in results[-1]) for m in models}
    assert results[0] == results[1] and len(results[0]) > 20
    assert all(r[2] < r[3] and (r[4], r[5]) == (f"fy{int(r[2].split('/')[1]) % 3}", f"fy{int(r[3].split('/')[1]) % 3}") for r in results[0])
    # Every pair of a block that either has one text or is near enough.
    wanted = duplicates.pair_table(described, Params(ref_date=dt.date(2025, 6, 1), amount_grain=0)).count()
    assert sum(r[0] == "tuned" for r in results[0]) == wanted


def test_raw_rows_of_other_works_are_not_moved_for_a_few(spark):
    wid = lambda k: f"MP1/2024-2025/{k}"
    raw = spark.createDataFrame([(f"WS/{wid(k % 40)}-work", f"place {k}", k) for k in range(120)], "Work string, State string, _ordinal long")
    works = spark.createDataFrame([(wid(3),), (wid(7),), (wid(99),)], "work_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
        few = dossier.with_evidence(works, {"sanctioned": raw}, "_ordinal", WORK_ID, few=True)
        semi = [line for line in few._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftSemi" in line]
        found = few.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert semi and all("BroadcastHashJoin" in line for line in semi)
    assert sorted(map(str, found)) == sorted(map(str, dossier.with_evidence(works, {"sanctioned": raw}, "_ordinal", WORK_ID).collect()))
    assert {r["work_id"]: "place 3" in r["raw_sanctioned"] for r in found} == {wid(3): True, wid(7): False, wid(99): False}
