"""Exact searches in written cells, pages from written files, and the limiter stream."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from works_risk.operators import cells, search
from works_risk.operators.rate import rolling_counts
from works_risk.sources import pages
from works_risk.streaming import limiter


def _frame(spark, v, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], f"{name} long, vec array<double>").repartition(4)


def _clusters(rng, groups, each, dim, spread):
    centres = rng.normal(size=(groups, dim))
    return np.concatenate([c + spread * rng.normal(size=(each, dim)) for c in centres])


def _truth(v, q, k):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1) > 0, np.linalg.norm(m, axis=1), 1)[:, None]
    scores = np.round(unit(q) @ unit(v).T, 9)
    return {j: [(i, round(s[i], 4)) for i in sorted(range(len(v)), key=lambda i: (-s[i], i))[:k]] for j, s in enumerate(scores)}


@pytest.mark.parametrize(("block", "spread"), [(16_384, 0.05), (40, 0.05), (16_384, 3.0)])
def test_searches_in_cells_equal_a_full_search(spark, tmp_path, monkeypatch, block, spread):
    monkeypatch.setattr(cells, "ANCHOR_BLOCK", block)
    monkeypatch.setattr(cells, "QUERY_BLOCK", 9)
    rng = np.random.default_rng(1)
    v = _clusters(rng, 12, 40, 8, spread)
    v[100:130] = v[7]  # one cell of many copies
    v[5] = v[300] = 0
    q = np.concatenate([v[::25] + 0.01 * rng.normal(size=v[::25].shape), rng.normal(size=(6, 8)), np.zeros((1, 8))])
    built = cells.build(_frame(spark, v), str(tmp_path / "cells"))
    found = search.nearest(cells.load(spark, str(tmp_path / "cells")), _frame(spark, q, "query"), 5).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query"], r["place"])):
        got.setdefault(r["query"], []).append((r["id"], r["score"]))
    truth = _truth(v, q, 5)
    for j, hits in truth.items():
        assert [s for _, s in got[j]] == pytest.approx([s for _, s in hits], abs=2e-4)
    assert got[len(q) - 1] == [(i, 0.0) for i in range(5)]  # a zero query: lowest ids
    assert built.layout.size.sum() == len(v) and cells.ZEROS in built.layout.cell


def test_cells_that_cannot_hold_a_hit_are_left_out(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = _clusters(rng, 40, 50, 16, 0.02)
    built = cells.build(_frame(spark, v), str(tmp_path / "cells"))
    queries = _frame(spark, v[::50], "query")
    size = built.layout.size
    first = cells._asked(built.layout, queries, lambda _, at, __: cells.first_cells(at, size, 3))
    found = cells.top_of(cells._visit(built, first, 3, "bigint"), 3)
    more = cells.further_cells(built, queries, found, 3)
    visited = first.count() + more.count()
    assert visited < 0.25 * 40 * len(size)
    assert search.nearest(built, queries, 3).filter("place = 1 AND score < 0.9999").count() == 0


def test_small_and_empty_tables_of_anchors(spark, tmp_path):
    few = cells.build(_frame(spark, np.eye(3)), str(tmp_path / "few"))
    assert search.nearest(few, [(0, [1.0, 0.0, 0.0])], 5).count() == 3
    none = cells.build(_frame(spark, np.eye(3)).limit(0), str(tmp_path / "none"))
    assert search.nearest(none, [(0, [1.0, 0.0, 0.0])], 5).count() == 0
    zeros = cells.build(_frame(spark, np.zeros((4, 3))), str(tmp_path / "zeros"))
    assert [(r["id"], r["score"]) for r in search.nearest(zeros, [(0, [1.0, 0.0, 0.0])], 2).orderBy("place").collect()] == [(0, 0.0), (1, 0.0)]


def test_a_deep_page_reads_the_files_it_lies_in(spark, tmp_path):
    rows = spark.range(12_345).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("risk_score"), F.concat(F.lit("w"), F.col("id")).alias("work_id"))
    order = search.risk_order()
    written = pages.write(rows.repartition(7), order, str(tmp_path / "p"), rows_per_file=500)
    expected = [tuple(r) for r in rows.orderBy(*order).collect()]
    assert written.total == 12_345
    for number, size in ((1, 50), (10, 50), (11, 50), (123, 100), (124, 100), (200, 50), (25, 500)):
        part = expected[(number - 1) * size : number * size]
        assert [tuple(r) for r in pages.load(spark, str(tmp_path / "p")).page(number, size, order).collect()] == part
        assert len(written.files(number, size)) <= 3
    assert written.page(1000, 50, order).count() == 0
    with pytest.raises(ValueError):
        written.page(1, 501, order)
    assert pages.write(rows.limit(0), order, str(tmp_path / "none")).total == 0


def _requests(seed, n):
    rng = np.random.default_rng(seed)
    base = dt.datetime(2024, 1, 1)
    times = np.sort(rng.integers(0, 400, n))
    return [("ab"[int(rng.integers(2))] if k % 3 else "hot", base + dt.timedelta(seconds=int(t)), k) for k, t in enumerate(times)]


@pytest.mark.parametrize("parts", [1, 3])
def test_the_limiter_stream_equals_the_batch_window(spark, tmp_path, parts):
    rows = _requests(3, 240)
    schema = "key string, ts timestamp, seq long"
    limiter.use_state_store(spark)
    try:
        for part in range(parts):
            cut = rows[part * len(rows) // parts : (part + 1) * len(rows) // parts]
            spark.createDataFrame(cut, schema).write.parquet(str(tmp_path / "in" / str(part)))
            source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
            answers = limiter.limited(source, 60, 10, "1 minute")
            limiter.write_answers(answers, str(tmp_path / "out"), str(tmp_path / "progress")).start().awaitTermination()
    finally:
        spark.conf.unset(limiter.PROVIDER)
    cols = ["seq", "key", "recent", "allowed"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(cols).collect()))
    expected = sorted(map(tuple, rolling_counts(spark.createDataFrame(rows, schema), 60, 10).select(cols).collect()))
    assert got == expected and {a for *_, a in got} == {True, False}


def test_late_requests_of_the_limiter(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "key string, ts timestamp, seq long"
    batches = [[("u", at(0), 1), ("u", at(100), 2)], [("u", at(90), 3), ("u", at(101), 4)], [("u", at(4000), 5)], [("u", at(102), 6), ("u", at(4001), 7)]]
    limiter.use_state_store(spark)
    try:
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / str(n)))
            source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
            limiter.write_answers(limiter.limited(source, 60, 2, "1 minute"), str(tmp_path / "out"), str(tmp_path / "progress")).start().awaitTermination()
    finally:
        spark.conf.unset(limiter.PROVIDER)
    got = {r["seq"]: (r["recent"], r["allowed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # 3 came after 2 but within the watermark; 6 is later than it.
    assert got == {1: (1, True), 2: (1, True), 3: (1, True), 4: (3, False), 5: (1, True), 7: (2, True)}


def test_a_busy_instant_is_folded(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("u", base, k) for k in range(50)] + [("u", base + dt.timedelta(seconds=59), 50), (None, base, 51), ("u", None, 52)]
    got = {r["seq"]: r["recent"] for r in rolling_counts(spark.createDataFrame(rows, "key string, ts timestamp, seq int"), 60, 3).collect()}
    assert [got[k] for k in range(51)] == [*range(1, 51), 51] and got[51] == 1 and len(got) == 53
