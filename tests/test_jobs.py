import datetime as dt

import pytest
from pyspark.sql import functions as F

from test_extracts import COM, CONSENT, EXP, REC, ROSTER, SAN
from works_risk.functions.vectors import hashed_trigrams
from works_risk.operators.rate import rolling_counts
from works_risk.params import Params
from works_risk.plans import job
from works_risk.plans.detect import detect_live
from works_risk.sources import sinks, tables
from works_risk.sources.extracts import FILES
from works_risk.schema import MASTER
from works_risk.streaming.recompute import recompute_on_arrival
from works_risk.streaming.windows import latest_counts, windowed_counts, write_updates

PARAMS = Params(ref_date=dt.date(2025, 6, 1), trees=10, tree_sample=16)


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for role, text in zip(FILES, (REC, SAN, COM, EXP, ROSTER, CONSENT)):
        (folder / FILES[role]).write_bytes(text.encode())
    return folder


def test_whole_job_and_reload(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    loaded, result = job.load_or_run(spark, str(raw), out, PARAMS)
    assert loaded.first()["source"] == "built" and loaded.first()["works"] == 6
    assert result.summary.first()["total_works"] == 6
    assert sum(r["works"] for r in result.mps.collect()) == 6
    assert result.offenders.count() == result.mps.count()
    written = result.table("dossiers")
    assert written.count() == loaded.first()["flagged"] == result.flags.filter("is_flagged").count() > 0
    again, _ = job.load_or_run(spark, str(raw), out, PARAMS)
    assert again.first()["source"] == "precomputed"
    risks = [r["risk_score"] for r in job.stored(spark, out).flags.collect()]
    assert risks == sorted(risks, reverse=True)
    sinks.write_dossier_files(written, f"{out}/files")
    one = written.first()
    assert (tmp_path / "out/files/works" / one["file_name"]).read_text() == one["dossier_md"]
    index = [r["value"] for r in spark.read.text(f"{out}/files/index").collect()]
    assert index[0] == f"# Flagged-work dossiers ({written.count()})"
    master = tables.read_master(spark, f"{result.path}/master")
    assert master.columns == MASTER.fieldNames()
    master.write.option("header", True).csv(f"{out}/master.csv")
    again = tables.read_master(spark, f"{out}/master.csv")
    assert again.schema == MASTER and again.count() == 6
    none = detect_live(master, PARAMS, None).first()
    assert none["dup_source"] == "none"
    def broken(texts):
        raise RuntimeError("no model")

    assert detect_live(master, PARAMS, hashed_trigrams).first()["dup_source"] == "live"
    assert detect_live(master, PARAMS, broken).first()["dup_source"] == "partial"
    listed = spark.createDataFrame([("tuned", 0.9, "MP9/2023-2024/5", "MP9/2023-2024/6")], "model string, similarity double, work_a string, work_b string")
    sinks.write_sweep(listed, f"{out}/sweep")
    done = job.run_master(master, tables.read_sweep(spark, f"{out}/sweep"), "tuned", f"{out}/second", PARAMS)
    assert done.flags.filter("dup_partner_count = 1").count() == 2
    tables.write_vectors_json(result.anchors, f"{out}/anchors.json")
    assert tables.read_vectors_json(spark, f"{out}/anchors.json").count() == result.anchors.count()


def test_recompute_on_arrival(spark, raw, tmp_path):
    seen = []
    start = lambda: recompute_on_arrival(
        spark, str(raw), str(tmp_path / "out"), str(tmp_path / "progress"), PARAMS, hashed_trigrams, 5, lambda flags, n: seen.append((n, flags.count()))
    ).awaitTermination()
    start()
    again = raw / "delivery=2"
    again.mkdir()
    (again / FILES["completed"]).write_text(COM + "WS/MP9/2023-2024/8-New,New,Goa,Vik Sen,South,10-Jan-2024,40\n")
    start()
    start()
    assert seen == [(0, 6), (1, 7)]


def test_late_requests_are_dropped(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    at = lambda s: dt.datetime(2024, 1, 1, 12, 0, 0) + dt.timedelta(seconds=s)

    def drop(name, *rows):
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(str(source / name))

    def run():
        stream = spark.readStream.schema("key string, ts timestamp").option("recursiveFileLookup", True).parquet(str(source))
        write_updates(windowed_counts(stream, "60 seconds", "60 seconds", "2 minutes"), out, str(tmp_path / "progress")).start().awaitTermination()

    drop("a", ("u", at(1)), ("u", at(2)), ("u", at(3600)))
    run()
    drop("b", ("u", at(3)), ("u", at(3601)))
    run()
    got = {r["window_start"].replace(tzinfo=None): r["requests"] for r in latest_counts(spark, out).collect()}
    assert got[at(0)] == 2 and got[at(3600)] == 2


def test_rolling_counts(spark):
    base = dt.datetime(2024, 1, 1)
    times = [0, 0, 1, 59.999999, 60, 61, 119, 119.5, 120, 500]
    rows = [("u", base + dt.timedelta(seconds=t), i) for i, t in enumerate(times)] + [("v", base, 99)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq int")
    got = {r["seq"]: (r["recent"], r["allowed"]) for r in rolling_counts(df, 60, 3).collect()}
    for i, t in enumerate(times):
        n = sum(1 for j, u in enumerate(times) if j <= i and t - u < 60)
        assert got[i] == (n, n <= 3)
    assert got[99] == (1, True)
