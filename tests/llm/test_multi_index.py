"""Multi-index hashing: the pigeonhole against all codes, recall and scores against brute force, and odd rows."""

import numpy as np
import pytest

from mnemospark.llm import multi_index as mi

SCHEMA = "vec_id long, embedding array<double>, rank int, `a.b` int"


def brute(rows, k=5):
    """query_id -> the k nearest (score, vec_id), for queries by row."""
    ok = [(n, i, np.array(v, float)) for n, (i, v, *_) in enumerate(rows) if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for n, i, q in ok:
        if i % 50 == 0:
            out[n] = (i, sorted((-float(q @ c / np.sqrt((q @ q) * (c @ c))), j) for m, j, c in ok if m != n and len(c) == len(q))[:k])
    return out


def found(spark, rows, **more):
    return [tuple(r) for r in mi.search(spark, spark.createDataFrame(rows, SCHEMA), **more).collect()]


def rows_of(v, first=0):
    return [(first + i, [float(x) for x in r], 1, 2) for i, r in enumerate(v)]


def recall(got, want):
    near = {}
    for q, _, j, _ in got:
        near.setdefault(q, set()).add(j)
    return sum(len(near.get(i, set()) & {j for _, j in best}) for i, best in want.values()) / sum(len(best) for _, best in want.values())


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2, (40, 100), dtype=np.uint8)
    codes = np.concatenate([base] + [np.where(rng.random(base.shape) < p, 1 - base, base) for p in (0.02, 0.05, 0.1, 0.2, 0.3)]).astype(np.uint8)
    index = mi.Index(codes)
    assert len(index.cuts) == 13 and index.cuts[-1] == (96, 100)
    values = np.stack([index.values(codes, a, b) for a, b in index.cuts], axis=1).tolist()
    for radius in (0, 1, 5, 12, 13, 20, 30, 45):
        probes = index.probes(radius)
        for i in range(0, len(codes), 7):
            want = np.flatnonzero((codes != codes[i]).sum(axis=1) <= radius)
            assert index.within(values[i], index.words[i], radius, probes).tolist() == want.tolist()


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 32))
    v[600:1600] = v[600] + rng.normal(size=(1000, 32)) / 10  # a large group of near copies
    v[1600:1800] = v[1600]  # and one of exact ones
    rows = rows_of(v)
    got, want = found(spark, rows), brute(rows)
    assert recall(got, want) >= 0.95
    assert sorted((q, r) for q, r, *_ in got) == sorted((i, r) for i, best in want.values() for r in range(1, len(best) + 1))
    for q, _, j, s in got:
        assert s == pytest.approx(float(v[q] @ v[j] / np.sqrt((v[q] @ v[q]) * (v[j] @ v[j]))), abs=1e-12)
    # copies tie, and the smaller ids come first
    assert [j for q, _, j, _ in sorted(got) if q == 1700] == [1600, 1601, 1602, 1603, 1604]


def test_tables_of_the_driver(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    assert recall([tuple(r) for r in mi.search(spark, vectors).collect()], brute(rows)) >= 0.9


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = rows_of(rng.normal(size=(120, 8)))
    odd = [(1000, None, 1, 2), (1050, [0.0] * 8, 1, 2), (1100, [1.0, None] + [1.0] * 6, 1, 2), (1150, [float("nan")] * 8, 1, 2), (1200, [float("inf")] * 8, 1, 2), (1250, [], 1, 2), (None, [1.0] * 8, 1, 2)]
    lone = [(2000, [1.0, 2.0], 1, 2), (3000, [1.0, 2.0, 3.0], 1, 2), (3001, [1.0, 2.0, 4.0], 1, 2), (4000, [1e-200] * 8, 1, 2), (4001, [1e200] * 8, 1, 2)]
    again = [rows[0]] * 3
    got = found(spark, rows + odd + lone + again)
    by = {}
    for q, r, j, s in got:
        by.setdefault(q, []).append((r, j, round(s, 9)))
    assert set(by) == {0, 50, 100, 3000, 4000}
    assert [x[1:] for x in by[3000]] == [(3001, round(25 / np.sqrt(14 * 21) - 0, 9))] or by[3000][0][1] == 3001 and len(by[3000]) == 1
    assert min(by[4000])[1:] == (4001, 1.0)
    assert len(by[0]) == 20 and all(j == 0 and s == 1 for r, j, s in by[0] if r <= 3)  # four equal rows, each with the three others first


def test_fewer_rows_than_asked_for(spark):
    rows = rows_of(np.random.default_rng(3).normal(size=(4, 5)))
    assert sorted(r for *_, r, _ in [(q, r, 0) for q, r, *_ in found(spark, rows)]) == [1, 2, 3]
    assert found(spark, []) == [] and found(spark, rows[:1]) == []


def test_queries_short_of_neighbours_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(mi, "QUANTILE", 0.0)
    rows = rows_of(np.random.default_rng(4).normal(size=(500, 16)))
    got = found(spark, rows)
    assert sorted((q, r) for q, r, *_ in got) == sorted((q, r) for q in range(0, 500, 50) for r in range(1, 6))


def test_blocks_change_little(spark, monkeypatch):
    rows = rows_of(np.random.default_rng(5).normal(size=(700, 16)))
    one = sorted(found(spark, rows))
    monkeypatch.setattr(mi, "ROWS", 256)
    monkeypatch.setattr(mi, "ASKED", 4)
    many = sorted(found(spark, rows))
    assert [x[:3] for x in one] == [x[:3] for x in many] and [x[3] for x in one] == pytest.approx([x[3] for x in many], abs=1e-12)
