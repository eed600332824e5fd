import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from works_risk.functions.vectors import EMBED_DIM, embedding, hashed_trigrams, one_by_one
from works_risk.operators import blocking, duplicates
from works_risk.params import Params

PARAMS = Params()


def cosines(texts):
    v = hashed_trigrams(texts)
    return v @ v.T


@pytest.fixture
def claims(work):
    words = ["road", "drain", "tank", "school", "hall", "lamp"]
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        text = f"Construction of {words[rng.integers(6)]} at ward {rng.integers(4)} village {rng.integers(3)}"
        rows.append({
            "mp_no": str(rng.integers(2)), "recommended_amount": 1000 * int(rng.integers(2)) + int(rng.integers(400)),
            "work_desc": text if i % 9 else "  ", "fy": f"{2020 + i % 3}-{2021 + i % 3}", "work_id": f"MP1/2020-2021/{i:03d}",
        })
    return rows, work(*rows)


def brute(rows, threshold=0.8):
    usable = [r for r in rows if r["work_desc"].strip()]
    sim = cosines([r["work_desc"].strip() for r in usable])
    pairs = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(usable), 2):
        same = a["mp_no"] == b["mp_no"] and round(a["recommended_amount"] / 1000) == round(b["recommended_amount"] / 1000)
        if same and sim[i, j] >= threshold:
            pairs[tuple(sorted((a["work_id"], b["work_id"])))] = sim[i, j]
    return pairs


def test_pairs_and_signals_match_brute_force(claims):
    rows, df = claims
    pairs = brute(rows)
    got = {(r["work_a"], r["work_b"]): r["similarity"] for r in duplicates.pair_table(df, PARAMS).collect()}
    assert set(got) == set(pairs) and len(pairs) > 50
    assert max(abs(got[k] - pairs[k]) for k in pairs) < 1e-6
    fy = {r["work_id"]: r["fy"] for r in rows}
    count, cross, best = Counter(), Counter(), {}
    for (a, b), s in pairs.items():
        for w in (a, b):
            count[w] += 1
            cross[w] += fy[a] != fy[b]
            best[w] = max(best.get(w, 0), s)
    live = duplicates.duplicate_signals(df, PARAMS).collect()
    listed = duplicates.signals_from_pairs(duplicates.pair_table(df, PARAMS), df, PARAMS).collect()
    for signals in (live, listed):
        assert len(signals) == len(rows)
        for r in signals:
            w = r["work_id"]
            assert (r["dup_partner_count"], r["dup_partner_cross_fy"]) == (count[w], cross[w])
            assert r["dup_partner_sim_max"] == pytest.approx(best.get(w, 0), abs=1e-6)
            assert r["has_duplicate_lead"] == (cross[w] > 0)


def test_cap_grain_and_category(claims, work):
    _, df = claims
    capped = duplicates.claims(df, Params(max_texts=10, amount_grain=0))
    assert capped.count() == 10
    two = work(*[{"work_desc": "Same text here", "work_category": c} for c in "ab"])
    assert duplicates.folded(duplicates.claims(two, PARAMS)).first()["works"] == 2
    assert duplicates.folded(duplicates.claims(two, Params(block_on_category=True))).count() == 0


def test_tiles_give_the_same_pairs_as_small_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([("hot" if i % 3 else "b", i, [float(x) for x in r]) for i, r in enumerate(v)], "block string, item long, vec array<double>")
    expected = {
        (i, j) for i, j in itertools.combinations(range(300), 2) if bool(i % 3) == bool(j % 3) and v[i] @ v[j] >= 0.7
    }
    for small, tile in ((1000, 50), (2, 50), (2, 7), (150, 64)):
        got = [(r["item_a"], r["item_b"]) for r in blocking.similar_items(df, 0.7, small, tile).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    with pytest.raises(ValueError):
        blocking.similar_items(df, 0.0)


def test_a_hot_group_of_copies_stays_linear(work):
    n = 3000
    rows = [{"work_desc": "Construction of community hall", "fy": f"{2000 + i % 2}-x", "work_id": f"MP1/2020-2021/{i}"} for i in range(n)]
    df = work(*rows)
    members = duplicates.claims(df, PARAMS)
    assert duplicates.folded(members).count() == 1
    r = duplicates.duplicate_signals(df, PARAMS).first()
    assert (r["dup_partner_count"], r["dup_partner_cross_fy"], r["dup_partner_sim_max"]) == (n - 1, n // 2, 1.0)


def test_blocks_split_by_size(spark):
    rows = [("big", f"t{i}", 1) for i in range(70)] + [("two", "a", 1), ("two", "b", 1), ("copies", "c", 3), ("lone", "d", 1)]
    df = spark.createDataFrame(rows, "block string, item string, works int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        small, big = blocking.split_blocks(df)
        assert {r["block"] for r in small.collect()} == {"two", "copies", "lone"}
        assert big.count() == 70 and {r["block_rows"] for r in big.collect()} == {70}
        assert Counter(r["block"] for r in blocking.shared_points(df).collect()) == {"big": 70, "two": 2, "copies": 1}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pair_table_helpers(spark, work):
    pairs = spark.createDataFrame([("b", "a", 0.9), ("a", "b", 0.95), ("a", "zz", 0.8)], "work_a string, work_b string, similarity double")
    canonical = {tuple(r) for r in duplicates.canonical_pairs(pairs).collect()}
    assert canonical == {("a", "b", 0.95), ("a", "zz", 0.8)}
    assert duplicates.mirrored_pairs(pairs).count() == 6
    master = work({"work_id": "a", "fy": "x"}, {"work_id": "b", "fy": "x"})
    cross = {(r["work_a"], r["work_b"]): r["cross_fy"] for r in duplicates.with_years(pairs, master).collect()}
    assert cross == {("b", "a"): False, ("a", "b"): False, ("a", "zz"): True}
    sweep = pairs.withColumn("model", F.lit("m1")).unionByName(
        spark.createDataFrame([("b", "a", 0.9, "m2")], "work_a string, work_b string, similarity double, model string")
    )
    only = duplicates.exclusive_pairs(sweep, "m1", "m2").collect()
    assert [(r["work_a"], r["work_b"]) for r in only] == [("a", "zz")]
    assert duplicates.signals_from_sweep(sweep, "m2", master, PARAMS).filter("dup_partner_count = 1").count() == 2
    assert [r["work_b"] for r in duplicates.top_pairs(duplicates.canonical_pairs(pairs), 1).collect()] == ["b"]


def test_sweep_of_two_models(claims):
    _, df = claims
    exact = df.withColumn("recommended_amount", F.lit(5).cast("decimal(18,2)"))

    def blind(texts):
        return np.zeros((len(texts), EMBED_DIM))

    swept = duplicates.sweep(exact, {"tuned": hashed_trigrams, "frozen": blind}, PARAMS)
    counts = {r["model"]: r["pairs"] for r in duplicates.pairs_per_model(swept).collect()}
    assert set(counts) == {"tuned"} and counts["tuned"] > 0
    assert {"work_status_a", "work_status_b", "mp_name"} <= set(swept.columns)


def test_embedders_that_fail_give_zero_vectors(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "i int, t string").coalesce(1)

    def failing(texts):
        raise RuntimeError("down")

    def short(texts):
        return np.ones((len(texts), 3))

    def wide(texts):
        return np.ones((len(texts), EMBED_DIM + 5))

    def picky(text):
        if text == "text 2":
            raise RuntimeError("bad text")
        return [1.0] * EMBED_DIM

    def total(model):
        rows = df.select(embedding(F.col("t"), model, batch=2).alias("v")).collect()
        assert all(len(r["v"]) == EMBED_DIM for r in rows)
        return [sum(r["v"]) for r in rows]

    assert total(failing) == total(short) == [0.0] * 5
    assert total(wide) == [float(EMBED_DIM)] * 5
    assert total(one_by_one(picky)) == [384.0, 384.0, 0.0, 384.0, 384.0]


def test_a_stored_sweep_is_linear_in_copies(spark, tmp_path):
    from works_risk.sources import sinks, tables

    n = 100_000
    rows = spark.range(n).selectExpr(
        "concat('MP1/2020-2021/', id) AS work_id", "'1' AS mp_no", "'A' AS mp_name", "'F' AS work_status",
        "if(id % 4 = 0, '2020-2021', '2021-2022') AS fy", "CAST(5 AS decimal(18,2)) AS recommended_amount",
        "if(id < 10, 'Construction of community halls', 'Construction of community hall') AS work_desc",
    )
    models = {"tuned": hashed_trigrams, "frozen": lambda texts: np.zeros((len(texts), EMBED_DIM))}
    sinks.write_links(duplicates.sweep_texts(rows, models, PARAMS), f"{tmp_path}/sweep")
    found = tables.read_links(spark, f"{tmp_path}/sweep")
    assert found.links.count() == 3 and found.works.count() == n
    counted = {r["model"]: (r["pairs"], r["texts"]) for r in duplicates.link_counts(found).collect()}
    assert counted == {"tuned": (n * (n - 1) // 2, 1)}
    signals = duplicates.signals_from_links(found, "tuned", rows, PARAMS).groupBy("dup_partner_count", "dup_partner_cross_fy").count().collect()
    assert {tuple(r) for r in signals} == {(n - 1, n * 3 // 4, n // 4), (n - 1, n // 4, n * 3 // 4)}
    none = duplicates.signals_from_links(found, "frozen", rows, PARAMS)
    assert none.filter("dup_partner_count > 0").count() == 0 and none.count() == n


def test_signals_from_links_equal_those_from_pairs(claims):
    _, df = claims
    found = duplicates.sweep_texts(df, {"tuned": hashed_trigrams}, PARAMS, exact=False)
    pairs = duplicates.with_copies(found.works, duplicates.both_ways(found.of("tuned")))
    cols = ["work_id", "dup_partner_count", "dup_partner_cross_fy", "has_duplicate_lead"]
    a = sorted(map(tuple, duplicates.signals_from_links(found, "tuned", df, PARAMS).select(cols).collect()))
    assert a == sorted(map(tuple, duplicates.signals_from_pairs(pairs, df, PARAMS).select(cols).collect()))
    assert any(r[1] for r in a) and duplicates.link_counts(found).first()["pairs"] == pairs.count()
