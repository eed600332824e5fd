"""Quoted line breaks read in splits, losses, published runs and both houses."""

import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from test_extracts import COM, CONSENT, EXP, REC, ROSTER, SAN
from test_jobs import PARAMS
from works_risk.functions.vectors import hashed_trigrams
from works_risk.plans import driver_tables, job
from works_risk.sources import extracts, quoted_csv, runs, sinks, tables

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    before, cost = spark.conf.get(SPLIT), spark.conf.get("spark.sql.files.openCostInBytes")
    yield lambda n: (spark.conf.set(SPLIT, n), spark.conf.set("spark.sql.files.openCostInBytes", 0))
    spark.conf.set(SPLIT, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def _odd_rows(n, seed=1):
    rng = random.Random(seed)
    pieces = ['"', '""', ",", "\n", "\r\n", "a", "long words here ", "é漢", '"\n"', "\n\n", "x" * 40]
    return [[f"r{k}", "".join(rng.choice(pieces) for _ in range(rng.randrange(12))), rng.choice(["", "5", "1,000"])] for k in range(n)]


def _text(rows, quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, quoting=quoting, lineterminator="\n").writerows([["id", "what it is", "amount"], *rows])
    return out.getvalue()


def test_state_after_a_line():
    for line, outside, inside in [
        ("", False, True), ("a,b", False, True), ('"a', True, False), ('a,"b', True, False), ('a"b', False, False), ('a""b', False, True),
        ('"a"",b', True, False), ('"a","b', True, True), ('"a"",""', True, False), ('a,"', True, False), ('x","y', True, True), ('x",y', False, False),
    ]:
        assert (quoted_csv.ends_inside(line, False), quoted_csv.ends_inside(line, True)) == (outside, inside), line


@pytest.mark.parametrize("size", [64, 700, 5000])
def test_records_of_many_splits_equal_one_reading(spark, tmp_path, small_splits, size):
    rows = _odd_rows(400)
    rows[100][1] = "very long\n" * 60 + '"' + "\n" * 30  # over several splits
    for name, part in (("a.csv", rows[:250]), ("b.csv", rows[250:])):
        (tmp_path / name).write_text(_text(part), newline="")
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    expected = sorted(map(str, whole.collect()))
    small_splits(size)
    found = quoted_csv.read_quoted(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
    ordered = found.orderBy("file", "block", "at")
    got = ordered.drop("file", "block", "at", quoted_csv.CORRUPT)
    assert got.columns == whole.columns and sorted(map(str, got.collect())) == expected
    assert [r["id"] for r in got.collect()] == [r[0] for r in rows]
    assert {r["id"]: r["what it is"] or "" for r in got.collect()} == {r[0]: r[1] for r in rows}


def test_batches_may_end_anywhere():
    rows = _odd_rows(60, 5)
    lines = _text(rows).split("\n")[:-1]
    expected = None
    for step in (1000, 7, 1):
        batches = [
            pa.RecordBatch.from_pydict({"file": ["f"] * len(part), "block": pa.array([0] * len(part), pa.int64()), "value": part, "begins_inside": [False] * len(part)})
            for part in (lines[k : k + step] for k in range(0, len(lines), step))
        ]
        got = [r["record"] for b in quoted_csv._cut(iter(batches)) for r in b.to_pylist()]
        expected = expected or got
        assert got == expected and len(got) == 61


def test_losses_are_counted(spark, tmp_path, small_splits):
    bad = REC + 'too,few\n"WS/MP1/2024-2025/9-x",c,"two\nlines",Goa,N,C,01-Jan-2024,unknown\n' + "a,b,c,d,e,f,g,h,too many\n"
    files = dict(zip(extracts.FILES, (bad, SAN, COM, EXP, ROSTER, CONSENT)))
    for role, text in files.items():
        (tmp_path / extracts.FILES[role]).write_bytes(text.encode())
    for multi_line, size in ((True, 50), (True, 1 << 20)):
        small_splits(size)
        raw = extracts.read_extracts(spark, str(tmp_path), multi_line=multi_line, tolerant=True, landing=f"{tmp_path}/landed{size}")
        lost = {r["role"]: tuple(r)[1:] for r in extracts.losses(raw).collect()}
        assert lost["recommended"] == (8, 2, 1) and lost["sanctioned"] == (2, 0, 0) and lost["roster"] == (4, 0, 0)
        assert raw.get("recommended").count() == 6 and extracts.CORRUPT not in raw.get("recommended").columns
    kept = extracts.read_extracts(spark, str(tmp_path), multi_line=True)
    assert kept.get("recommended").count() == 8
    single = extracts.read_extracts(spark, str(tmp_path), tolerant=True)
    assert extracts.losses(single).filter("role = 'recommended'").first()["malformed"] == 4  # the broken line counts twice


def _extracts(folder, upper=False):
    folder.mkdir()
    for role, text in zip(extracts.FILES, (REC, SAN, COM, EXP, ROSTER, CONSENT)):
        name = (extracts.UPPER_HOUSE_FILES if upper else {}).get(role, extracts.FILES[role])
        (folder / name).write_bytes(text.encode())
    return str(folder)


def test_a_broken_run_leaves_the_one_before(spark, tmp_path, monkeypatch):
    folder, out = _extracts(tmp_path / "raw"), str(tmp_path / "out")
    first = job.run_extracts(spark, folder, out, PARAMS, multi_line=True, dossier_files=True)
    assert first.table("losses").count() == 6 and (tmp_path / first.path / "files" / "works").is_dir()

    def broken(*_):
        raise OSError("disk full")

    for place in ("write_mps", "write_dossiers"):
        with monkeypatch.context() as patch:
            patch.setattr(sinks, place, broken)
            with pytest.raises(OSError):
                job.run_extracts(spark, folder, out, PARAMS)
        assert job.stored(spark, out).path == first.path
        loaded, result = job.load_or_run(spark, folder, out, PARAMS)
        assert loaded.first()["source"] == "precomputed" and result.flags.count() == 6
    second = job.run_extracts(spark, folder, out, PARAMS)
    assert job.stored(spark, out).path == second.path != first.path and first.flags.count() == 6
    with pytest.raises(FileNotFoundError):
        job.stored(spark, str(tmp_path / "nothing"))


def test_commits_are_never_overwritten_and_half_ones_do_not_count(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    assert runs.newest(spark, out) is None
    runs.commit(spark, out, f"{out}/runs/a", ["flags"])
    stale = runs._commits(spark, out)
    runs.commit(spark, out, f"{out}/runs/b", ["flags", "mps"])
    with monkeypatch.context() as patch:  # another run read the list before b was committed
        patch.setattr(runs, "_commits", lambda *_: stale)
        runs.commit(spark, out, f"{out}/runs/c", ["flags"])
    assert len(runs._commits(spark, out)) == 3
    assert runs.newest(spark, out) == f"{out}/runs/c" and runs.newest(spark, out, ("mps",)) == f"{out}/runs/b"
    (tmp_path / "commits" / "000000000009.json").write_text('{"run": "x", "tab')
    assert runs.newest(spark, out) == f"{out}/runs/c"
    with pytest.raises(Py4JJavaError):
        runs.write_bytes(spark, f"{out}/commits/000000000009.json", b"", overwrite=False)


def test_both_houses_in_one_run(spark, tmp_path):
    folders = {"ls": _extracts(tmp_path / "ls"), "rs": _extracts(tmp_path / "rs", upper=True)}
    out = str(tmp_path / "out")
    flags, mps = job.run_chambers(spark, folders, out, PARAMS)
    alone = job.run_extracts(spark, folders["ls"], str(tmp_path / "alone"), PARAMS)
    shared = [c for c in alone.flags.columns if c != "chamber"]
    rows = sorted(map(str, alone.flags.select(shared).collect()))
    for chamber in ("ls", "rs"):
        assert sorted(map(str, flags.filter(f"chamber = '{chamber}'").select(shared).collect())) == rows
    assert mps.groupBy("chamber").count().count() == 2
    # One house again, with one work more: only its partitions change.
    (tmp_path / "rs" / extracts.FILES["completed"]).write_text(COM + "WS/MP9/2023-2024/8-New,New,Goa,Vik Sen,South,10-Jan-2024,40\n")
    job.run_chambers(spark, {"rs": folders["rs"]}, out, PARAMS, hashed_trigrams)
    counts = {r["chamber"]: r["count"] for r in spark.read.parquet(f"{out}/flags").groupBy("chamber").count().collect()}
    assert counts == {"ls": 6, "rs": 7}


def test_a_delivery_recomputes_the_blocks_it_touches(spark, tmp_path, monkeypatch):
    from works_risk.functions import vectors

    def works(n, changed=()):
        lines = ["WORK,Work category,Work description,State,Hon'ble Members of Parliament,Constituency,Recommended date,RECOMMENDED AMOUNT   ( ₹ )"]
        for k in range(n):
            text = "Something else entirely, a bridge" if k in changed else f"Construction of hall number {k % 7 // 2}"
            lines.append(f"WS/MP{k % 5}/20{20 + k % 3}-20{21 + k % 3}/{k}-W,c,\"{text}\",Goa,M{k % 5},S,01-Jan-2024,{1000 * (k % 4)}")
        return "\n".join(lines) + "\n"

    embedded = spark.sparkContext.accumulator(0)

    def counting(texts):
        embedded.add(len(texts))
        return vectors.hashed_trigrams(texts)

    folder = tmp_path / "in"
    (folder / "delivery=1").mkdir(parents=True)
    (folder / "delivery=1" / extracts.FILES["recommended"]).write_text(works(120))
    out = str(tmp_path / "out")
    first = job.run_extracts(spark, str(folder), out, PARAMS, counting)
    assert first.table("compared").count() == 120
    # One text changed, ten works more of two blocks, one work gone.
    (folder / "delivery=2").mkdir()
    rows = works(130, changed=(42,)).split("\n")
    (folder / "delivery=2" / extracts.FILES["recommended"]).write_text("\n".join(r for r in rows if "/17-W" not in r))
    whole = embedded.value
    second = job.run_extracts(spark, str(folder), out, PARAMS, counting, since=first.path)
    step = embedded.value - whole
    full = job.run_extracts(spark, str(folder), str(tmp_path / "full"), PARAMS, counting)
    assert embedded.value - whole - step > 1.3 * step > 0
    touched = {(k % 5, k % 4) for k in (42, 17, *range(120, 130))}
    compared = {r["work_id"] for r in second.table("compared").collect()}
    assert {int(w.rsplit("/", 1)[1]) for w in compared} == {k for k in range(130) if (k % 5, k % 4) in touched and k != 17}
    assert len(compared) < 129
    for name in ("flags", "mps"):
        a, b = getattr(second, name), getattr(full, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    # Nothing changed, and other settings.
    third = job.run_extracts(spark, str(folder), out, PARAMS, counting, since=second.path)
    assert third.table("compared").count() == 0 and sorted(map(str, third.flags.collect())) == sorted(map(str, full.flags.collect()))
    import dataclasses

    other = job.run_extracts(spark, str(folder), out, dataclasses.replace(PARAMS, amount_grain=5000), counting, since=second.path)
    assert other.table("compared").count() == 129


def test_written_extracts_hold_copies_of_a_description_once(spark, tmp_path):
    """a description named by many works costs about one copy in the written files and in what lands of them."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f'{w:x}"\n' for w in rng.integers(0, 2**60, 500)).strip() for _ in range(4)]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    works = spark.range(400).select(F.col("id").cast("string").alias("work_no"), F.md5(F.col("id").cast("string")).alias("x"))
    laid = driver_tables.with_text(spark, sf, works, together=True)
    assert {(r["work_no"], r["work_desc"]) for r in laid.collect()} == {(str(k), texts[k % 4]) for k in range(400)}
    line = F.to_csv(F.struct("work_no", "work_desc"), {"escape": '"', "quoteAll": "true"})
    tables.write_lines(laid.select(line.alias("value")), '"work_no","work_desc"', str(tmp_path / "csv"), "gzip")
    read = extracts.land(extracts.read_marked(spark, str(tmp_path / "csv"), multi_line=True), str(tmp_path / "landed"))
    assert read.filter(F.col(quoted_csv.CORRUPT).isNotNull()).count() == 0
    assert {(r["work_no"], r["work_desc"]) for r in read.collect()} == {(str(k), texts[k % 4]) for k in range(400)}
    size = lambda folder: sum(p.stat().st_size for p in (tmp_path / folder).rglob("part-*"))
    once, every = sum(map(len, texts)), sum(len(texts[k % 4]) for k in range(400))
    assert size("csv") < 3 * once < every / 20 and size("landed") < 3 * once
