"""between the steps of the job works carry the key of their description, and each text is moved and kept once."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from works_risk import Params
from works_risk.operators import dossier, texts
from works_risk.operators.search import anchor_table
from works_risk.plans import job
from works_risk.sources import extracts

PARAMS = Params(ref_date=dt.date(2025, 6, 1))
HEADER = "WORK,Work category,Work description,State,Hon'ble Members of Parliament,Constituency,Recommended date,RECOMMENDED AMOUNT   ( ₹ )"


def test_a_run_holds_a_description_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "TOGETHER", 40)  # the copies of one text go to several tasks
    rng = np.random.default_rng(5)
    words = [" ".join(f"{w:x}" for w in rng.integers(0, 2**60, 1_500)) for _ in range(3)]
    said = lambda k: [f"  {words[k % 3]} ", f"{words[k % 3]}\t ", words[k % 3]][k // 3 % 3] if k % 50 else ["  ", ""][k // 50 % 2]
    wid = lambda k: f"MP{k % 5}/{2020 + k % 7}-{2021 + k % 7}/{k}"
    lines = [f'WS/{wid(k)}-W,c,"{said(k)}",Goa,M{k % 5},S,01-Jan-2020,{1000 * (k % 4)}' for k in range(300)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / extracts.FILES["recommended"]).write_text("\n".join([HEADER, *lines]) + "\n")
    result = job.run_extracts(spark, str(folder), str(tmp_path / "out"), PARAMS)

    known = {wid(k): said(k).strip(" \t ") for k in range(300)}
    for table in (result.flags, result.table("master")):
        assert {r["work_id"]: r["work_desc"] for r in table.select("work_id", "work_desc").collect()} == known
    assert {r["work_desc"] for r in result.table("texts").collect()} == set(words)
    # The same as without keys.
    raw = job.raw_tables(extracts.read_extracts(spark, str(folder)))
    plain = dossier.build_dossiers(result.flags, raw, extracts.ORDINAL)
    assert plain.count() > 200 and sorted(map(str, result.table("dossiers").collect())) == sorted(map(str, plain.collect()))
    assert sorted(map(str, result.anchors.collect())) == sorted(map(str, anchor_table(result.flags).collect()))
    once = sum(map(len, words))
    for name in ("master", "flags", "dossiers"):
        size = sum(p.stat().st_size for p in (tmp_path / result.path / name).rglob("part-*"))
        assert size < 8 * once < sum(map(len, known.values())) / 10, name


def test_texts_come_back_beside_each_other(spark, monkeypatch):
    monkeypatch.setattr(texts, "TOGETHER", 10)
    rows = spark.range(100).select(F.col("id").cast("string").alias("work_id"), F.when(F.col("id") < 70, "a").when(F.col("id") < 75, "b").otherwise("").alias("text_id"))
    facts = spark.createDataFrame([("a", "long", 70), ("b", "short", 5)], "text_id string, work_desc string, n long")
    laid = texts.beside(rows, facts, F.col("work_id"))
    got = laid.withColumn("task", F.spark_partition_id()).collect()
    assert {(int(r["work_id"]), r["work_desc"]) for r in got} == {(k, "long" if k < 70 else "short" if k < 75 else None) for k in range(100)}
    assert len({r["task"] for r in got if r["text_id"] == "a"}) > 1
    ordered = [(r["task"], r["text_id"]) for r in got]
    assert sum(a != b for a, b in zip(ordered, ordered[1:])) == len(set(ordered)) - 1
