"""Exact top-k against brute force, and on repeated ids, nulls, ties and empty tables."""

import numpy as np

from mnemospark.llm import topk


def brute(rows):
    ok = [(n, i, np.floor(64 * np.array(v, float)).astype(object)) for n, (i, v, *_) in enumerate(rows) if i is not None and v is not None and np.isfinite(v).all()]
    out = []
    for n, i, q in ok:
        if i % 20 == 0:
            best = sorted((-int((q * c).sum()), j) for m, j, c in ok if m != n and len(c) == len(q))[:20]
            out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    return sorted(out)


def found(spark, rows, schema="vec_id long, embedding array<double>, rank int, `a.b` int"):
    return sorted(map(tuple, topk.search(spark, spark.createDataFrame(rows, schema)).collect()))


def test_topk(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 24)) / 5
    v[50:90] = v[50]
    rows = [(i, [float(x) for x in r], 1, 2) for i, r in enumerate(v)]
    odd = [(1000, None, 1, 2), (1020, [float("nan")] * 24, 1, 2), (1040, [1.0], 1, 2), (1060, [], 1, 2), (None, [1.0] * 24, 1, 2), (1080, [float("inf")] * 24, 1, 2)]
    got = found(spark, rows + odd)
    assert got == brute(rows + odd) and {r[0] for r in got} == set(range(0, 300, 20))


def test_rows_that_share_an_id(spark):
    """Queries with one id are queries of their own, and each a candidate of the others."""
    rng = np.random.default_rng(2)
    rows = [(20 if i < 2 else i, [float(x) for x in rng.normal(size=6)], 1, 2) for i in range(20)]
    got = found(spark, rows)
    assert len(got) == 38 and got == brute(rows)
    again = [rows[0]] * 3 + rows
    assert found(spark, again) == brute(again)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(topk, "COMPONENTS", 1)
    monkeypatch.setattr(topk, "ROWS", 1)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=40)], 1, 2) for i in range(700)]
    assert found(spark, rows) == brute(rows)


def test_topk_of_large_numbers():
    q = np.array([[2**40, 1]], object)
    c = np.array([[2**40, 1], [2**40, 2], [1, 1]], object)
    some = topk.best(q, np.array([9]), c, np.array([1, 2, 3]), np.array([1, 2, 3]), 2)
    assert [(p.tolist(), list(s)) for _, p, s in some] == [([1, 0], [2**80 + 2, 2**80 + 1])]
