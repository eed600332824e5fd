"""Toxicity and language identification: held-out accuracy on planted rows, odd rows, bounds."""

import collections
import dataclasses
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from works_risk.llm import language_id, toxicity, words

STEMS = {"aa": ["kura", "milo", "teva"], "bb": ["schwi", "grofen", "pluht"]}


def _text(rng, stems, n=40):
    return " ".join(rng.choice(stems) + rng.choice(["n", "ti", "ra", "wes", ""]) for _ in range(n))


def test_bag_and_ngrams():
    bag = words.bag_of(pa.array(["Ab c", "", "  x  y ", None, "c1d c"]))
    assert [bag.words[k] for k in bag.at] == ["ab", "c", "x", "y", "c1d", "c"]
    assert bag.offsets.tolist() == [0, 2, 2, 4, 4, 6]
    buckets, owner = words.ngrams(["ab", "c1d"], 1, 3, 20, True)
    assert np.bincount(owner).tolist() == [7, 8]  # a b _a ab b_ _ab ab_, and c d with edges of their own
    assert len(set(buckets[owner == 0])) == 7
    assert len(words.ngrams([], 1, 3, 20, True)[0]) == 0


def test_slices_cover_all_rows_and_isolate_long_texts():
    batch = pa.RecordBatch.from_pydict({"text": ["a", None, "b" * 50, "", "cc", "d"]})
    parts = [p.column("text").to_pylist() for p in words.text_slices(batch, "text", 4)]
    assert [t for p in parts for t in p] == batch.column("text").to_pylist()
    assert ["b" * 50] in [[t for t in p if t] for p in parts]


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(1)
    rows = [(k, _text(rng, STEMS[lang]), lang) for k, lang in enumerate(["aa", "bb"] * 40)]
    return spark.createDataFrame(rows + [(500, None, "aa"), (501, "milo", None), (None, "milo", "aa")], "doc_id long, text string, lang string")


def test_language_id_on_unseen_words_and_odd_rows(spark, languages):
    model = language_id.fit(languages)
    assert model.languages == ["aa", "bb"]
    rng = random.Random(2)
    rows = [(k, _text(rng, [s + "xo" for s in STEMS[lang]], 6), lang) for k, lang in enumerate(["aa", "bb"] * 20)]
    odd = [(100, None, "?"), (101, "", "?"), (102, "12 34 --", "?"), (103, "milo " * 50_000, "aa"), (104, "m", "aa"), (104, "m", "aa")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    found = language_id.predict(docs, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score"]
    got = found.collect()
    right = {k: lang for k, _, lang in rows + odd}
    for row in got:
        assert 0 <= row.score <= 1
        if right[row.doc_id] == "?":
            assert (row.lang_pred, row.score) == ("und", 0.0)
        elif row.doc_id != 104:
            assert row.lang_pred == right[row.doc_id]
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 104}) == 1
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_language_id_without_labels_and_with_a_bound(spark, languages):
    nothing = language_id.fit(languages.limit(0))
    assert {r.lang_pred for r in language_id.predict(languages.select("doc_id", "text"), nothing).collect()} == {"und"}
    few = {r.doc_id for r in language_id.bounded_sample(languages, 10).collect()}
    assert len(few) == 10 and few == {r.doc_id for r in language_id.bounded_sample(languages.repartition(7), 10).collect()}


def test_language_scores_match_a_plain_sum(languages):
    params = language_id.Params(low=1, high=2, bits=10)
    model = language_id.fit(languages, params)
    text = "kuran grofen"
    buckets, _ = words.ngrams(text.split(), 1, 2, 10, True)
    logs = model.table[buckets].astype(float).sum(axis=0)
    langs, score = language_id.score_texts(model, pa.array([text]))
    assert langs == [model.languages[int(logs.argmax())]]
    assert score[0] == pytest.approx(1 / np.exp(logs - logs.max()).sum(), rel=1e-3)


def _plain_grams(word, low, high, bits):
    """Buckets of a word's n-grams by a loop over characters; other characters than letters are edges."""
    codes = [ord(c) if c.isalpha() else 0x20 for c in f" {word} "]
    found = []
    for n in range(low, high + 1):
        for at in range(len(codes) - n + 1):
            part = codes[at : at + n]
            if all(c == 0x20 for c in part) or 0x20 in part[1:-1]:
                continue
            h = 0
            for c in part:
                h = (h * 0x9E3779B97F4A7C15 + c + 1) % 2**64
            x = (h ^ (h >> 29)) * (0xBF58476D1CE4E5B9 + 2 * n) % 2**64
            found.append(x >> (64 - bits))
    return found


def test_language_id_equals_plain_counting(spark):
    rng = random.Random(8)
    pool = {"aa": ["kura", "milo,", "te3ra", "ö"], "bb": ["schwi", "pluht", "milo", "12"], "cc": ["aeio", "ou-ae", "éé"]}
    rows = [(k, " ".join(rng.choice(pool[lang]) for _ in range(12)), lang) for k, lang in enumerate(rng.choices(sorted(pool), k=60))]
    params = language_id.Params(low=1, high=4, bits=12)
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), params)
    counts = {lang: collections.Counter() for lang in pool}
    for _, text, lang in rows:
        for word in text.split():
            counts[lang].update(_plain_grams(word, 1, 4, 12))
    log = {lang: [math.log((c[b] + params.alpha) / (sum(c.values()) + params.alpha * 2**12)) for b in range(2**12)] for lang, c in counts.items()}
    texts = ["kura milo", "schwi 12 ou-ae", "zzz é", "... 12", "", "Milo MILO te3ra"]
    langs, score = language_id.score_texts(model, pa.array(texts))
    for text, lang, s in zip(texts, langs, score):
        grams = [g for word in text.lower().split() for g in _plain_grams(word, 1, 4, 12)]
        if not grams:
            assert (lang, s) == ("und", 0.0)
            continue
        sums = {k: sum(v[g] for g in grams) for k, v in log.items()}
        best = max(sorted(sums), key=lambda k: sums[k])
        assert lang == best and s == pytest.approx(1 / sum(math.exp(v - sums[best]) for v in sums.values()), rel=1e-3)


def test_five_hundred_languages_take_as_many_scans_as_two(spark):
    def scans(n):
        rows = spark.range(n * 3).selectExpr("id AS doc_id", "'kura milo' AS text", f"concat('l', id % {n}) AS lang")
        sample = language_id.sample_by_language(rows, 4000)
        assert sample.count() == n * 3 and sample.select("lang").distinct().count() == n
        return sample._jdf.queryExecution().optimizedPlan().toString().count("Range (")

    assert scans(500) == scans(2) == 2
    rows = spark.range(600).selectExpr("id AS doc_id", "'kura' AS text", "if(id < 500, concat('l', id % 5), concat('rare', id)) AS lang")
    few = language_id.sample_by_language(rows, 50, most_languages=5)
    assert {r["lang"]: r["count"] for r in few.groupBy("lang").count().collect()} == {f"l{k}": 10 for k in range(5)}


def _toxic_rows(rng, n):
    clean = [f"{a}{b}{c}" for a in ("ko", "mi", "te", "ra") for b in ("lu", "na", "so") for c in ("", "n", "ti", "wes")]
    rows = []
    for k in range(n):
        text = [rng.choice(clean) for _ in range(60)]
        bad = k % 3 == 0
        if bad:
            for _ in range(2):
                text[rng.randrange(60)] = rng.choice(["zgrompf", "quvix"]) + rng.choice(["en", "er", "o", "ling", ""])
        rows.append((" ".join(text), int(bad)))
    return rows


SMALL = toxicity.Params(bits=14, max_docs=200, min_docs=4)


def test_toxicity_finds_unseen_forms():
    rng = random.Random(3)
    rows = _toxic_rows(rng, 400)
    model = toxicity.train([t for t, _ in rows], np.array([y for _, y in rows]), SMALL)
    clean = [t for t, y in _toxic_rows(rng, 60) if not y]
    bad = [t.replace(t.split()[5], "zgrompfish", 1) for t in clean]
    long = [" ".join(clean) + " " + w for w in ("quvixes", "tekolun")]
    score = toxicity.score_texts(model, pa.array(clean + bad + long))
    assert (score[: len(clean)] < 0.5).all()
    assert (score[len(clean) : -2] > 0.5).mean() > 0.95
    assert score[-2] > 0.5 > score[-1]


def test_toxicity_odd_rows(spark):
    rng = random.Random(5)
    rows = [(k, t, y) for k, (t, y) in enumerate(_toxic_rows(rng, 120))]
    labelled = spark.createDataFrame([*rows, (900, None, 1), (901, "x", None), (None, "y", 1)], "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled, SMALL)
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "kolu " * 40_000, "q"), (4, rows[0][1], "q"), (4, rows[0][1], "q")], "doc_id long, text string, score string")
    found = toxicity.predict(docs, model)
    assert found.columns == ["doc_id", "text", "score", "predicted"]
    got = {}
    for row in found.collect():
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
        got.setdefault(row.doc_id, set()).add(row.score)
    assert got[1] == got[2] and all(len(s) == 1 for s in got.values())
    assert max(got[4]) > 0.7 > max(got[3])
    assert toxicity.predict(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("labels", [[], [1, 1], [0, 0]])
def test_toxicity_without_both_classes_scores_zero(labels):
    model = toxicity.train(["some words"] * len(labels), np.array(labels), SMALL)
    assert toxicity.score_texts(model, pa.array(["some words", None]))[0] < 1e-6


def test_toxicity_gradient_falls(monkeypatch):
    rng = random.Random(6)
    rows = _toxic_rows(rng, 90)
    texts, labels = [t for t, _ in rows], np.array([y for _, y in rows])
    loss = []
    for steps in (1, 60):
        model = toxicity.train(texts, labels, dataclasses.replace(SMALL, steps=steps, warm_steps=min(steps, 20)))
        p = np.clip(toxicity.score_texts(model, pa.array(texts)), 1e-6, 1 - 1e-6)
        loss.append(-np.log(np.where(labels == 1, p, 1 - p)).mean())
    assert loss[1] < 0.5 * loss[0]


def test_toxicity_learns_from_few_labels_and_its_production_params(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    held_out = language_id.id_remainder(F.col("doc_id"), 3) == 1
    rows = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id")
    model = toxicity.fit(rows.filter(~held_out))
    got = toxicity.predict(rows.filter(held_out), model).toPandas()
    right = (got.toxic == 1) & (got.predicted == 1)
    assert (got.toxic == 1).sum() == 18
    assert right.sum() >= 14 and ((got.toxic == 0) & (got.predicted == 1)).sum() <= 2


def test_a_rare_language_is_in_the_bounded_sample(spark):
    rows = [(k, "kura milo", "aa") for k in range(300)] + [(1000, "schwi pluht", "bb")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit(labelled, language_id.Params(max_docs=4)).languages == ["aa", "bb"]
    assert language_id.sample_by_language(labelled, 4).count() == 3


def test_repeated_ids_do_not_widen_the_sample(spark):
    rows = [(k % 3, f"text {k}", 1) for k in range(90)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = language_id.bounded_sample(labelled, 2).collect()
    assert len(got) == 2 and sorted(got) == sorted(language_id.bounded_sample(labelled.repartition(7), 2).collect())


def _plain_toxicity(texts, labels, params):
    """Training by loops over documents, bags, words and n-grams. Returns scores for texts."""

    def grams(word):
        return toxicity._word_grams([word], params)[0].tolist()

    docs = [(t or "").lower().split() for t in texts]
    held = [[{g for w in doc for g in grams(w)} for doc, y in zip(docs, labels) if y == k] for k in (0, 1)]
    share = [labels.count(k) / len(labels) for k in (0, 1)]
    side = {}
    for g in sorted(set().union(*held[0], *held[1])):
        n = [sum(g in doc for doc in held[k]) for k in (0, 1)]
        ratio = sum(2 * n[k] * math.log(n[k] / (sum(n) * share[k])) for k in (0, 1) if n[k])
        if sum(n) >= params.min_docs and math.sqrt(max(ratio, 0)) >= params.least_evidence:
            side[g] = 1 if n[1] > sum(n) * share[1] else -1
    known = list(side)
    rng = np.random.default_rng(params.seed)
    vectors = [list(map(float, v)) for v in rng.normal(0, 0.1, (len(known), params.dim)).astype(np.float32)]
    soft = [list(map(float, v)) for v in rng.normal(0, 0.5, (params.dim, 2)).astype(np.float32)]
    bias, index = [0.0, 0.0], {g: k for k, g in enumerate(known)}

    def parts(word):  # (vector, share) of a word's known n-grams
        every = grams(word)
        own = [index[g] for g in every if g in index]
        return [(k, 1 / max(len(own), len(every) / 2)) for k in own]

    def bags(doc):
        cut = [doc[k : k + params.bag_words] for k in range(0, len(doc), params.bag_words)]
        return [[(k, s / params.bag_words) for w in sorted(set(b)) for k, s in parts(w)] for b in cut]

    laid = [bags(doc) for doc in docs]
    n_class = [max(1, sum(1 for b, y in zip(laid, labels) if b and y == k)) for k in (0, 1)]
    dims = range(params.dim)

    def margins(bag):
        mean = [sum(vectors[k][d] * s for k, s in bag) for d in dims]
        return mean, [sum(mean[d] * soft[d][c] for d in dims) + bias[c] for c in (0, 1)]

    momentum = {"v": ([[0.0] * params.dim for _ in known], 0.0), "s": ([[0.0, 0.0] for _ in dims], 0.0), "b": ([[0.0, 0.0]], 0.0)}

    def descend(name, value, grad, rate):
        mean, largest = momentum[name]
        for row, g in zip(mean, grad):
            for d, x in enumerate(g):
                row[d] += 0.1 * (x - row[d])
        largest = max(max(abs(x) for g in grad for x in g), 0.9 * largest, 1e-12)
        momentum[name] = mean, largest
        for row, m in zip(value, mean):
            for d, x in enumerate(m):
                row[d] -= rate / largest * x

    for step in range(params.steps):
        g_v, g_s, g_b = [[0.0] * params.dim for _ in known], [[0.0, 0.0] for _ in dims], [[0.0, 0.0]]
        for doc, y in zip(laid, labels):
            seen = [(bag, *margins(bag)) for bag in doc]
            p = [1 / (1 + math.exp(m[0] - m[1])) for _, _, m in seen]
            for (bag, mean, _), q in zip(seen, p):
                weight = 0.0 if y else 0.5 / n_class[0] / len(doc)
                if step < params.warm_steps:
                    weight = 0.5 / n_class[1] / len(doc) if y else weight
                elif q >= max(p):
                    weight = 0.5 / n_class[1] if y else weight + 0.5 / n_class[0]
                off = (q - y) * weight
                for c, grad in ((0, -off), (1, off)):
                    g_b[0][c] += grad
                    for d in dims:
                        g_s[d][c] += mean[d] * grad
                        for k, s in bag:
                            g_v[k][d] += s * soft[d][c] * grad
        descend("v", vectors, g_v, params.rate)
        across = [soft[d][1] - soft[d][0] for d in dims]
        for k, g in enumerate(known):
            vectors[k] = [x * (1 - params.decay) for x in vectors[k]]
            margin = sum(x * a for x, a in zip(vectors[k], across))
            if margin * side[g] < 0:
                vectors[k] = [x - margin * a / sum(b * b for b in across) for x, a in zip(vectors[k], across)]
        descend("s", soft, g_s, 0.05)
        both = [bias]
        descend("b", both, g_b, 0.1)

    def score(text):
        found = [margins(bag)[1] for bag in bags(text.lower().split())] or [bias]
        return 1 / (1 + math.exp(-max(m[1] - m[0] for m in found)))

    return score


@pytest.mark.parametrize("dim", [2, 5])
def test_toxicity_equals_plain_training_and_scoring(dim):
    rng = random.Random(9)
    rows = [(" ".join(t.split()[: rng.randrange(3, 40)] + t.split()[-1:]), y) for t, y in _toxic_rows(rng, 45)]
    rows += [("", 0), ("quvix quvix Quvixen!", 1), ("zgrompfo zgrompf", 1)]
    texts, labels = [t for t, _ in rows], [y for _, y in rows]
    params = toxicity.Params(bits=12, steps=12, warm_steps=5, dim=dim, bag_words=7, least_evidence=1.5, rate=2.0)
    score = _plain_toxicity(texts, labels, params)
    model = toxicity.train(texts, np.array(labels), params)
    asked = texts + ["zgrompfling", "kolu minati", "ko " * 30 + "quvix", "never seen words"]
    got = toxicity.score_texts(model, pa.array(asked))
    assert got == pytest.approx([score(t) for t in asked], abs=2e-3)
    assert got.max() - got.min() > 0.1
