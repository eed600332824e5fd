"""Filter audit, URL rules and whitening against plain versions."""

import collections
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from works_risk.llm import filter_audit, tiles, url_rules, whitening

GAP = re.compile(r"[\x20\x09-\x0D]+")


def _plain_counts(text):
    words = [w for w in GAP.split(text or "") if w]
    text = text or ""
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def _texts():
    rng = random.Random(11)
    alphabet = ["a", "B", "é", "漢", "😀", "#", "|", " ", "\n", "\t", "\x0b", "\u00a0", "Z", "x" * 70, "y" * 70, "x" * 71]
    texts = [None, "", " ", "\n\n", "a", "A a", "\u2003a", "ÀB", "end ", " start", "a" * 3000 + " " + "a" * 3000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(150)]
    texts += [" ".join(rng.choice(["w%d" % (i % 40) for i in range(60)]) for _ in range(900))]
    return texts


def test_one_pass_counts_as_plain_python_does():
    texts = _texts()
    for part in (texts, texts[3:40], [], [None], ["\u00e9"]):
        counts, data, edges = filter_audit.scan(pa.array(part, pa.string()))
        found = list(zip(counts.words, counts.distinct, counts.capitals, counts.points, counts.symbols))
        assert found == [_plain_counts(t) for t in part]
        assert [bytes(data[a:b]) for a, b in zip(edges, edges[1:])] == [(t or "").encode() for t in part]
    sliced = pa.array(texts, pa.string()).slice(5, 30)
    assert list(filter_audit.scan(sliced)[0].words) == [_plain_counts(t)[0] for t in texts[5:35]]


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit.SpanTable, "hashes", lambda self: np.full(len(self.start), 2**64 - 2, np.uint64))
    texts = _texts()[:60]
    assert list(filter_audit.scan(pa.array(texts, pa.string()))[0].distinct) == [_plain_counts(t)[1] for t in texts]


def _plain_audit(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = []
    for i, text, lang in docs:
        n, distinct, caps, points, symbols = _plain_counts(text)
        bad = "A" * (n < 100) + "B" * (100 * distinct < 80 * n) + "C" * (100 * caps > 10 * points) + "D" * (symbols > 0)
        failed.append((lang or "", i, bad + "E" * (i is not None and i > least[text or ""])))
    out = {}
    for part in {p for p, _, _ in failed}:
        mine = [(i, bad) for p, i, bad in failed if p == part]
        share = collections.Counter()
        rows = {}
        for order in itertools.permutations("ABCDE"):
            here = list(mine)
            for step, f in enumerate(order, 1):
                gone = [(i, bad) for i, bad in here if f in bad]
                here = [(i, bad) for i, bad in here if f not in bad]
                fails = sum(f in bad for _, bad in mine)
                only = sum(bad == f for _, bad in mine)
                share[f] += len(gone)
                rows[part, "".join(order), step] = [
                    len(here), len(gone), fails - len(gone), only, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)
                ]
        for key, row in rows.items():
            out[key] = (*row, share[key[1][key[2] - 1]])
    return out


def _audited(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_audit_equals_running_every_order(spark):
    rng = random.Random(5)
    long = " ".join(f"w{k}" for k in range(150))
    pool = [None, "", long, long + " $", long.upper(), " ".join(["same"] * 200), "short", "short #", long + " tail"]
    docs = [(k, rng.choice(pool), rng.choice(["en", "de", None, ""])) for k in range(120)]
    docs += [(None, long, "en"), (None, "short", None), (7, docs[7][1], "en"), (7, docs[7][1], "en"), (500, "only", "xx")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    docs_df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, part string, bits int")
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = _audited(filter_audit.audit(docs_df, labels_df))
    assert found == _plain_audit(docs, labels)
    assert len(found) == 600 * 4
    assert _audited(filter_audit.audit(docs_df, labels_df.limit(0))).keys() == found.keys()
    assert filter_audit.audit(docs_df.limit(0), labels_df).count() == 0


def test_audit_of_very_long_and_very_many_equal_texts(spark):
    text = "palabra Otra " * 60_000
    docs = spark.createDataFrame([(k, "same text", "en") for k in range(3000)] + [(5000, text, "es")], "doc_id long, text string, lang string")
    found = _audited(filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert found["en", "EABCD", 1][:2] == (1, 2999) and found["en", "AEBCD", 2][:3] == (0, 0, 2999)
    assert found["es", "BACDE", 1][:2] == (0, 1) and found["es", "ACDEB", 5][1] == 1


def _plain_judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in rules:
        if h is None:
            continue
        h, p = h.lower(), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len(h + p), len(h), h + p, verdict == "block"))
    return host, path, best[2] if best else None, (("block" if best[3] else "allow") if best else default)


RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
    ("block", "a.b.c", ""), ("allow", "b.c", "/x"), ("block", "b.c", "/x/y"), ("allow", "b.c", "/x/y/z"), ("block", "c", "/xx"),
    ("allow", "B.C", "/x/y"), ("block", "ample.net", "/"), ("allow", "d.e.f.g.h", "/"), ("block", None, "/"), ("allow", "é.fr", "/à"),
    ("block", "e.net", None), ("allow", "c.net", "/"),
]


def _urls():
    rng = random.Random(3)
    labels = ["net", "example", "com", "org", "a", "b", "c", "x", "ample", "e", "é", "fr", "", "EXAMPLE", "Net", "d", "f", "g", "h"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/de/1", "/fr/", "/x", "/x/y", "/x/y/z/1", "/xx", "/à", "/en/?q=/de/", "#/en/", "?a", "/x#y"]
    urls = [None, "", "no scheme", "://", "http://", "http:///en/", "a://b://c", "http://net", "http://net/", "http://x.net:80/", "http://u@x.net/"]
    urls += ["http://" + "a." * 3000 + "net/en/", "http://m.example.net/en/" + "z" * 5000, "http://line\n.net/a\nb"]
    urls += ["http://a.b.c", "http://q.a.b.c/x/y", "http://b.c/x/y/z9", "http://m.b.c/x/y", "http://b.c/xx", "http://www.é.fr/à/b"]
    for _ in range(600):
        urls.append("http://" + ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 6))) + rng.choice(paths))
    return urls


@pytest.mark.parametrize("parts", [1, 7])
def test_urls_are_judged_as_by_trying_every_rule(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set(coalesce, "false")
    try:
        urls = _urls()
        pages = spark.createDataFrame([(k % 590, u, "own", k) for k, u in enumerate(urls)], "page_id long, url string, Rule string, n long")
        rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
        found = url_rules.judge(pages, rules)
        assert found.columns == ["page_id", "url", "n", "host", "path", "rule", "verdict"]
        rows = {r.n: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
        assert rows == {k: _plain_judge(u, RULES) for k, u in enumerate(urls)}
        assert {r[2] for r in rows.values()} >= {"net/", "b.c/x/y/z", "a.b.c", "é.fr/à", "e.net", None}
    finally:
        spark.conf.unset(coalesce)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_url_rules_on_hot_hosts_and_empty_tables(spark):
    pages = spark.range(4000).selectExpr("id AS page_id", "if(id % 3 = 0, 'http://hot.example.net/en/', concat('http://hot.example.net/', id)) AS url")
    rules = url_rules.rule_table(spark, RULES[:4])
    found = url_rules.judge(pages.unionAll(pages), rules)
    assert {(r.rule, r.verdict): r["count"] for r in found.groupBy("rule", "verdict").count().collect()} == {
        ("example.net/en/", "allow"): 2 * 1334, ("net/", "block"): 2 * 2666
    }
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    no_rules = url_rules.judge(pages.limit(5), rules.limit(0), default="block")
    assert {(r.rule, r.verdict) for r in no_rules.collect()} == {(None, "block")}


def test_a_sweep_keeps_its_stack_across_partitions(spark):
    rng = random.Random(2)
    keys = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(80)})
    points = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 8))) for _ in range(200)]
    p = spark.createDataFrame(list(enumerate(points)), "point long, key string")
    i = spark.createDataFrame([(k, k) for k in keys], "interval string, key string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set(coalesce, "false")
    try:
        whole = {(r.point, r.interval) for r in url_rules.sweep(p, i, True).collect()}
        top = {r.point: r.interval for r in url_rules.sweep(p, i, False).collect()}
    finally:
        spark.conf.unset(coalesce)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert whole == {(n, k) for n, x in enumerate(points) for k in keys if x.startswith(k)}
    assert top == {n: max((k for k in keys if x.startswith(k)), key=len) for n, x in enumerate(points) if any(x.startswith(k) for k in keys)}


def test_no_python_in_the_url_plan(spark, capsys):
    pages = tiles.written(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), "plan-pages")
    url_rules.judge(pages, url_rules.rule_table(spark, RULES[:4])).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def _plain_whitening(rows, components=4):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = collections.Counter(len(v) for _, v in good)
    dim = max(lengths, key=lambda k: (lengths[k], -k))
    x = [(i, tuple(math.floor(256 * np.float64(np.float32(c))) for c in v)) for i, v in good if len(v) == dim]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(v[d] for v in fit) for d in range(dim)]
    y = np.array([[n * v[d] - sums[d] for d in range(dim)] for v in fit], float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:components]
    trace = sum(Fraction(n * v[d] - sums[d], n) ** 2 for v in fit for d in range(dim)) / n
    return n, sums, x, values[order], vectors[:, order], float(trace)


def _vectors(rng, n, dim):
    scales = np.linspace(3, 0.2, dim)
    return (rng.normal(size=(n, dim)) * scales @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]).astype(np.float32)


def test_whitening_equals_a_dense_solution(spark):
    rng = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(_vectors(rng, 700, 24))]
    rows += [(1000 + k, rows[k][1]) for k in range(50)] + [(1000, rows[0][1])]
    rows += [(2000, None), (2001, []), (2002, [None] + [1.0] * 23), (2003, [float("nan")] * 24), (2004, [float("inf")] * 24), (2005, [1.0, 2.0])]
    rows += [(None, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, n int, component int")
    found = whitening.whiten(df.repartition(5)).collect()
    n, sums, x, values, vectors, trace = _plain_whitening(rows)
    assert len(found) == 4 * len(x)
    by_row = collections.defaultdict(list)
    for r in found:
        by_row[r.vec_id].append(r)
    sign = {}
    for i, v in x:
        y = np.array([n * c - s for c, s in zip(v, sums)], object)
        for r in by_row[i]:
            assert r.n == n and r.deviation == sum(int(c) ** 2 for c in y)
            k = r.component - 1
            want = float((y / n).astype(float) @ vectors[:, k]) / math.sqrt(values[k])
            sign.setdefault(k, 1 if want * r.whitened > 0 else -1)
            assert r.whitened == pytest.approx(sign[k] * want, abs=1e-9)
            assert r.explained == pytest.approx(values[k] / trace, rel=1e-10)
            assert r.identity_error < 1e-10
    assert {len(v) for i, v in by_row.items() if i not in (1000,)} == {4} and len(by_row[1000]) == 8


@pytest.mark.parametrize("dim", [1, 2, 5, 40, 200])
def test_pairs_reach_double_precision(dim):
    rng = np.random.default_rng(dim)
    basis = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    for values in (np.sort(rng.random(dim))[::-1] * 50, np.r_[[7.0] * min(3, dim), np.full(max(dim - 3, 0), 0.5)], np.r_[[9.0], np.zeros(dim - 1)]):
        a = (basis * values) @ basis.T
        found = whitening.leading(lambda v: a @ v, dim)
        top = np.sort(values)[::-1][: min(4, dim)]
        assert np.allclose(found.values, top, rtol=0, atol=1e-13 * top[0])
        assert np.linalg.norm(a @ found.vectors - found.vectors * found.values, axis=0).max() < 1e-12 * top[0]
        assert np.allclose(found.vectors.T @ found.vectors, np.eye(len(top)), atol=1e-13)


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(12, 12))
    a = a @ a.T
    values, vectors = np.linalg.eigh(a)
    u = np.linalg.qr(vectors[:, -2:] + 0.01 * rng.normal(size=(12, 2)))[0]
    theta = (u * (a @ u)).sum(axis=0)
    r = a @ u - u * theta
    t = whitening.corrections(lambda v: a @ v, theta, u, r, np.zeros((12, 0)), 10)
    p = np.eye(12) - u @ u.T
    for k in range(2):
        left = p @ ((a - theta[k] * np.eye(12)) @ (p @ t[:, k]))
        assert np.allclose(left, -p @ r[:, k], atol=1e-8 * np.linalg.norm(r[:, k]) + 1e-10)


def test_whitening_without_spread_and_with_huge_entries(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 1.0, 2.0 * k]) for k in range(6)], schema)).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1)
    huge = whitening.whiten(spark.createDataFrame([(k, [3e38 * (-1) ** k, float(k)]) for k in range(4)], schema)).collect()
    assert {r.deviation for r in huge} == {None} and {r.component for r in huge} == {1}
    big = whitening.whiten(spark.createDataFrame([(k, [1e5 * k, float(k % 3)]) for k in range(9)], schema)).collect()
    n, sums, x, *_ = _plain_whitening([(k, [1e5 * k, float(k % 3)]) for k in range(9)])
    want = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x}
    assert {r.vec_id: r.deviation for r in big} == want
