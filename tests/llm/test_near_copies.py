"""Components, MinHash and embedding dedup against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from works_risk.llm import embedding_dedup, minhash_dedup, tiles
from works_risk.llm.components import components


def _find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def _union(pairs, nodes):
    parent = {n: n for n in nodes}
    for a, b in pairs:
        a, b = _find(parent, a), _find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: _find(parent, n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(7)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    pairs += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == _union([p for p in pairs if p[0] != p[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_bring_every_pair_of_a_group_together_once_or_in_one_chunk(spark):
    rows = spark.range(23).selectExpr("id AS node", "1L AS key")
    from pyspark.sql import functions as F

    cut = tiles.tiled(rows, F.lit(23), 5).collect()
    met = collections.Counter()
    by_tile = collections.defaultdict(list)
    for r in cut:
        by_tile[r.i, r.j].append(r)
    for members in by_tile.values():
        for x in members:
            for y in members:
                if x.node < y.node and (x.side == 2 or x.side != y.side):
                    met[x.node, y.node] += 1
    assert len(met) == 23 * 22 // 2 and set(met.values()) == {1}


def _bag(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def _similarity(a, b):
    common = sum((a & b).values())
    union = sum(a.values()) + sum(b.values()) - common
    return common / union if union else 0.0


def test_signatures_are_unbiased_for_weighted_similarity():
    rng = random.Random(9)
    off = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        other = [w if rng.random() > 0.02 else "z" for w in base]
        pair = [" ".join(base + base[:50] * rng.randrange(5)), " ".join(other + other[:50] * rng.randrange(5))]
        doc, h, count = minhash_dedup.shingles(pa.array(pair), 5)
        sig = minhash_dedup.signatures(doc, h, count, 2, 2048)
        exact = _similarity(_bag(pair[0]), _bag(pair[1]))
        both = [(h[doc == k], count[doc == k]) for k in (0, 1)]
        assert minhash_dedup.weighted_jaccard(*both) == pytest.approx(exact)
        off.append(((sig[0] == sig[1]).mean() - exact) / max(np.sqrt(exact * (1 - exact) / 2048), 1e-9))
    assert abs(np.mean(off)) < 1 and np.std(off) < 2


def _near_rows():
    rng = random.Random(10)
    vocabulary = [f"v{k}" for k in range(5000)]
    rows, n = [], 0
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(rng.choice([1, 2, 6])):
            text = list(base)
            for _ in range(rng.randrange(7)):
                text[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((n, " ".join(text)))
            n += 1
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(40):  # each near the last, the ends far apart
        chain = list(chain)
        chain[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append((n, " ".join(chain)))
        n += 1
    rows += [(n + k, t) for k, t in enumerate([None, "", "  ", "one two", "ONE  two", "one two three four five", rows[0][1].upper(), "w " * 30_000])]
    return rows


@pytest.mark.parametrize("tile", [1024, 6])
def test_minhash_classes_match_brute_force(spark, tile):
    rows = _near_rows()
    bags = {k: _bag(t) for k, t in rows}
    ids = [k for k, _ in rows]
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if bags[a] and bags[b] and _similarity(bags[a], bags[b]) >= 0.8]
    expected = _union(pairs, ids)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, kept string").repartition(5)
    found = minhash_dedup.classes(docs, minhash_dedup.Params(tile=tile))
    assert found.columns == ["doc_id", "text", "class_id", "class_size", "kept"]
    got = found.collect()
    assert {r.doc_id: r.class_id for r in got} == expected
    sizes = collections.Counter(expected.values())
    for r in got:
        assert r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id)


def test_minhash_repeated_null_ids_and_empty(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (None, "other words in this text here"), (9, None), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.class_id, r.class_size, r.kept) for r in minhash_dedup.classes(docs).collect()), key=str)
    assert got == sorted(
        [(3, text, 3, 3, True)] * 2 + [(None, text, 3, 3, False), (None, "other words in this text here", None, 1, True)] + [(9, None, 9, 1, True)] * 2, key=str
    )
    assert minhash_dedup.classes(docs.limit(0)).count() == 0


def _vectors():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(120, 32))
    rows = [base[k] for k in range(120)]
    for k in range(0, 40, 4):
        for noise in (0.0, 0.05, 0.3, 0.45, 0.5):
            rows.append(base[k] + noise * rng.normal(size=32))
    rows += [3 * base[1], -base[2]]
    made = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]
    n = len(made)
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [float("inf")] + [1.0] * 31, [1.0, 0.0], [1.0, 0.01]]
    return made, [(n + k, v) for k, v in enumerate(odd)]


@pytest.mark.parametrize(("kind", "tile"), [("float", 1024), ("double", 4)])
def test_embedding_links_match_brute_force(spark, kind, tile):
    made, odd = _vectors()
    rows = made + odd
    sound = {k: np.array(v) for k, v in made + odd[-2:]}
    links = collections.defaultdict(set)
    for a, x in sound.items():
        for b, y in sound.items():
            if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a].add(b)
                links[b].add(a)
    expected = _union([(a, b) for a, others in links.items() for b in others], [k for k, _ in rows])
    frame = spark.createDataFrame([(k, v, "l") for k, v in rows], f"vec_id long, embedding array<{kind}>, component_id string").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.links(frame, embedding_dedup.Params(tile=tile)).collect()}
    assert len(got) == len(rows)
    for k, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (len(links[k]), expected[k], expected[k] == k)


def test_embedding_copies_null_ids_and_empty(spark):
    v, w = [1.0, 2.0], [2.0, -1.0]
    frame = spark.createDataFrame([(5, v), (5, v), (None, v), (None, w), (7, None)], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.links(frame).collect()), key=str)
    assert got == sorted([(5, 2, 5, True)] * 2 + [(None, 2, 5, False), (None, 0, None, False), (7, 0, 7, True)], key=str)
    assert embedding_dedup.links(frame.limit(0)).count() == 0


def test_sign_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(12)
    off, outside = [], 0
    x = rng.normal(size=64)
    x /= np.linalg.norm(x)
    for seed in range(300):
        z = rng.normal(size=64)
        z -= (z @ x) * x
        y = 0.6 * x + 0.8 * z / np.linalg.norm(z)
        coded = embedding_dedup.Coded(np.stack([x, y]), embedding_dedup.Params(seed=seed))
        estimate = coded.turned[1] @ coded.signs[0] / coded.factor[0]
        off.append(estimate - 0.6)
        outside += abs(estimate - 0.6) > coded.slack[0]
    assert abs(np.mean(off)) < 4 * np.std(off) / np.sqrt(300) and outside == 0


def test_enough_tables_for_the_stated_miss():
    params = embedding_dedup.Params()
    for n in (500, 10**6):
        hashes, tables = embedding_dedup.layout(64, n, params)
        hit = embedding_dedup.share_rate(64, 0.9, params.seed) ** hashes
        assert (1 - hit) ** tables <= params.miss and 128**hashes >= 8 * n
