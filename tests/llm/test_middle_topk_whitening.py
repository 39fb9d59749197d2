"""Fill-in-the-middle, exact top-k search and whitening against brute force."""
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from propcube.llm import fill_middle, topk_search, whitening
from propcube.llm.jacobi_davidson import largest

VECTORS = "vec_id long, embedding array<double>, label int, x string, score double, id long"


def cut_plainly(doc_id, text, unit, rate, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else r"(?s).", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or c % 100 >= rate or re.search("<[PSM]>", text):
        return len(units), "plain", None, None, text
    lo, hi = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if d % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice(["a", "é", "日", "🙂", " ", "\n", "<", "P", ">", "\r"]) for _ in range(n))
    rows = [(i, text(rng.choice([1, 5, 60, 4096, 9000]))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n\n\n"), (104, "no line end"), (105, "with <M> inside\nx\n"),
             (106, "🙂\n" * 30_000), (107, "x" * 50_000), (None, "one\ntwo\nthree"), (None, "one\ntwo\nthree"),
             (104, "the id again\n"), (108, "<\n<P\n>S>\n")]
    rows = [(i, t, "extra", 1, "x") for i, t in rows]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, output string, n int, key string").repartition(3)


@pytest.mark.parametrize("unit, rate, spm", [("line", 100, 50), ("char", 100, 0), ("line", 40, 100)])
def test_fill_in_middle_equals_brute_force(odd_docs, unit, rate, spm):
    rows, docs = odd_docs
    made = fill_middle.fill_in_middle(docs, unit=unit, rate=rate, spm=spm)
    back = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()]
    want = [(i, *cut_plainly(i, t, unit, rate, spm), t or "") for i, t, *_ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_text_index_finds_every_cut():
    text = "ab\n\n日本🙂\n" * 40 + "end"
    raw = np.frombuffer(text.encode(), np.uint8)
    for block in (1, 7, 64, 4096):
        index = fill_middle.TextIndex(raw, "line", block)
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert (index.units, index.points) == (len(units), len(text))
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert index.cut(k) == (len(head.encode()), len(head))


def test_fill_in_middle_of_no_rows(no_docs):
    assert fill_middle.digests(fill_middle.fill_in_middle(no_docs)).count() == 0


def usable(rows):
    """[(id, x)] of the rows that take part, filled up to one length."""
    keep = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dim = max((len(x) for _, x in keep), default=0)
    return [(i, x + [0] * (dim - len(x))) for i, x in keep]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "y", 0.5, 3) for i, v in rows], VECTORS).repartition(4)


def held(score):
    return max(-(1 << 63), min((1 << 63) - 1, score))


def plain_top(rows, k):
    out = []
    rows = usable(rows)
    for a, (i, x) in enumerate(rows):
        if i is None or i % 50:
            continue
        scored = sorted((-held(sum(p * q for p, q in zip(x, y))), j is None, j or 0) for b, (j, y) in enumerate(rows) if a != b)
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(8)
    hot = rng.normal(size=8).round(3).tolist()
    rows = [(i, hot if i % 3 == 0 else (rng.normal(size=8) if i % 3 == 1 else np.round(rng.normal(size=8))).tolist())
            for i in range(600)]
    rows += [(600, None), (650, [None] * 8), (700, [float("nan")] + [1.0] * 7), (750, [float("inf")] * 8), (800, [0.0] * 8),
             (850, []), (900, [1.0, -2.0]), (None, hot), (None, rows[1][1]), (50, hot), (50, hot), (100, rows[50][1])]
    return rows


def test_top_k_equals_brute_force(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(topk_search, "SEGMENT", 32)  # several segments, parts and blocks
    monkeypatch.setattr(topk_search, "HOLD", 40)
    monkeypatch.setattr(topk_search, "QUERIES", 5)
    monkeypatch.setattr(topk_search, "BLOCK", 8)
    for k in (1, 5):
        got = topk_search.nearest(vectors(spark, odd_vectors), F.col("vec_id") % 50 == 0, k=k)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain_top(odd_vectors, k)


@pytest.mark.parametrize("scale", [1e5, 1e9])
def test_top_k_of_large_components_is_exact(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) * scale).tolist()) for i in range(60)]
    got = topk_search.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_top(rows, 5)


def test_top_k_of_few_rows(spark):
    for rows in ([], [(0, None)], [(0, [1.0])], [(0, []), (1, [])], [(0, [1.0, 2.0]), (7, [3.0, 4.0])]):
        got = topk_search.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_top(rows, 5)


def test_pruned_blocks_hold_nothing_better():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(40, 6)).repeat(30, axis=0) * 50 + rng.normal(size=(1200, 6)))
    x = x[topk_search.halves(x, 32)]
    cuts = range(0, 1200, 32)
    high, low = (np.array([f(x[c:c + 32], axis=0) for c in cuts]) for f in (np.max, np.min))
    q = x[::100]
    bound = topk_search.bounds(q, high, low)
    best = np.array([(x[c:c + 32] @ q.T).max(axis=0) for c in cuts]).T
    assert (bound >= best).all()
    kth = np.sort(x @ q.T, axis=0)[-5]
    assert (bound < kth[:, None]).mean() > 0.5  # alike vectors share blocks, so most blocks are skipped


def check_whitening(rows, got, k=4):
    have = usable(rows)
    fit = np.array(sorted({tuple(x) for _, x in have}), float)
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    mean = fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 1e-9 * e.sum()).sum()))
    assert len(got) == k * len(have)
    byrow = {}
    for r in got:
        byrow.setdefault((r.vec_id, r.deviation), []).append(r)
    sign = {}
    for i, x in have:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, total))
        mine = [r for r in byrow[(i, dev)]]
        for c in range(k):
            want = float((np.array(x) - mean) @ u[:, c] / np.sqrt(e[c]))
            vals = [r for r in mine if r.component == c + 1]
            sign.setdefault(c, 1 if min(abs(r.whitened - want) for r in vals) < 1e-6 else -1)
            assert min(abs(r.whitened - sign[c] * want) for r in vals) < 1e-8 * max(1, abs(want))
            assert all(r.n == n and abs(r.explained - e[c] / e.sum()) < 1e-12 and r.identity_error < 1e-10 for r in vals)


def test_whitening_equals_eigenvectors(spark, odd_vectors):
    check_whitening(odd_vectors, whitening.whiten(vectors(spark, odd_vectors)).collect())


def test_whitening_of_low_rank_and_few_rows(spark):
    for rows in ([(1, [1.0, 2.0]), (2, [3.0, 5.0]), (2, [3.0, 5.0]), (3, [0.0, 0.0])], [(5, [1.0, 2.0, 0.5]), (6, [2.0, 4.0, 1.0])]):
        check_whitening(rows, whitening.whiten(vectors(spark, rows)).collect())
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]):
        assert whitening.whiten(vectors(spark, rows)).collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 1.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert got[1] is None and got[2] is None and got[3] == (3 * 256 - 256) ** 2


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 5, 3, 2, 1, 0, 0], [1] * 12, [9, 8, 7, 6.999999, 1], [4], list(range(90, 0, -1))])
def test_jacobi_davidson_reaches_double_precision(values):
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(len(values),) * 2))
    a = (q * np.array(values, float)) @ q.T
    e, u = largest(lambda w: a @ w, len(values), 4, len(values))
    k = min(4, len(values))
    assert np.abs(e - sorted(values, reverse=True)[:k]).max() < 1e-13 * max(values)
    assert np.abs(a @ u - u * e).max() < 1e-13 * max(values) and np.abs(u.T @ u - np.eye(k)).max() < 1e-13
