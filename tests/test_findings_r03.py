"""What the findings of round 3 asked for: bounded batches, texts only where they are needed, products for small blocks of vectors."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from works_risk.operators import blocking, duplicates, training_pairs
from works_risk.plans import driver_tables as D
from works_risk.session import BATCH_ROWS

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SF = "/root/testdata/sf0.001"


def test_python_is_handed_few_rows_at_a_time(spark):
    def sizes(batches):
        yield pd.DataFrame({"n": [max(len(b) for b in batches)]})

    points = spark.createDataFrame([("b", "x", "some text")], "block string, item string, text string")
    before = spark.conf.get(ROWS)
    try:
        spark.conf.set(ROWS, "10000")
        duplicates.embedded(points)
        assert spark.range(0, 3000, 1, 1).mapInPandas(sizes, "n long").first()["n"] <= BATCH_ROWS
        spark.conf.set(ROWS, "1500")  # a session's own choice stays
        duplicates.embedded(points)
        assert spark.conf.get(ROWS) == "1500"
    finally:
        spark.conf.set(ROWS, before)


def test_usable_texts_without_the_texts(spark, tmp_path):
    sf = str(tmp_path)
    texts = ["a text", None, "  ", "another"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    rows = spark.range(8).select(F.col("id").cast("string").alias("work_no"))
    found = D.with_usable_text(spark, sf, rows)
    assert found.columns == ["work_no"] and sorted(r["work_no"] for r in found.collect()) == ["0", "3", "4", "7"]


def test_pairs_of_claimants_are_all_pairs(spark):
    claimed, every = D.claimed_supplies(spark, SF), D.supplies(spark, SF)
    assert 0 < claimed.count() < every.count()
    assert claimed.exceptAll(every).isEmpty()
    bands = lambda rows: {tuple(r) for r in training_pairs.banded_pairs(training_pairs.text_points(rows, D.PARAMS)).collect()}
    assert bands(claimed) == bands(every)


def test_small_blocks_of_vectors_meet_in_products(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    points = spark.createDataFrame([("b", i, list(map(float, r))) for i, r in enumerate(v)], "block string, item long, vec array<double>")
    assert blocking.SMALL_VECTOR_ROWS < 40 < blocking.SMALL_ROWS
    here = {tuple(r) for r in blocking.similar_items(points, 0.5).collect()}
    joined = {tuple(r) for r in blocking.similar_items(points, 0.5, small_rows=64).collect()}
    assert here == joined and {(a, b) for _, a, b, _ in here} == {(i, j) for i in range(40) for j in range(i + 1, 40) if v[i] @ v[j] >= 0.5}
