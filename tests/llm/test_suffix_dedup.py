"""Removal of repeated strings against counts of all windows, on every split, and on odd rows."""

import collections
import hashlib
import random

import numpy as np
import pytest

from mnemospark.llm import suffix_dedup

SCHEMA = "doc_id long, text string, lang string, n_chars long, id string, spans int, `a.b` int"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def strip(data):
    """For each byte string what of it goes, as a mask."""
    seen = collections.Counter(x[k : k + 200] for x in data for k in range(len(x) - 199))
    out = []
    for x in data:
        cut = np.zeros(len(x), bool)
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                cut[k : k + 200] = True
        out.append(cut)
    return out


def brute(rows):
    data = [(t or "").encode() for _, t in rows]
    out = collections.Counter()
    for (d, _), x, cut in zip(rows, data, strip(data), strict=True):
        runs = int((np.diff(np.concatenate(([0], cut.view(np.int8)))) == 1).sum())
        out[d, len(x), int(cut.sum()), runs, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~cut])).hexdigest()] += 1
    return out


def stripped_text(rows):
    data = [(t or "").encode() for _, t in rows]
    return [None if t is None else bytes(np.frombuffer(x, np.uint8)[~cut]).decode("utf-8", "ignore") for (_, t), x, cut in zip(rows, data, strip(data), strict=True)]


def texts():
    rng = random.Random(5)
    base = sentence(rng, 400)
    near = base.split()
    near[100] = "changed"
    passage = sentence(rng, 60)
    out = [base, base, " ".join(near), None, "", "   ", "one two three", passage + " " + sentence(rng, 80), sentence(rng, 90) + "\n" + passage, sentence(rng, 3000), "a" * 900, "ab" * 300]
    out += [base[:199], base[50:250], base[50:249] + "Q", "é" * 150 + sentence(rng, 20), "xé" + "é" * 150, passage * 4]
    common = sentence(rng, 35)
    out += [sentence(rng, rng.randint(5, 60)) + " " + common + " " + sentence(rng, rng.randint(5, 60)) for _ in range(60)]
    return list(enumerate(out)) + [(None, "no id at all " * 30), (None, None), (0, base)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if t is None else len(t), "x", 1, 2) for i, t in rows], SCHEMA)


def check(spark, rows):
    df = frame(spark, rows)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(spark, df).collect())
    assert got == brute(rows)
    left = suffix_dedup.stripped(spark, df)
    assert left.columns == df.columns
    left = left.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == sorted((str(d), str(t)) for (d, _), t in zip(rows, stripped_text(rows), strict=True))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in left)


def test_odd_rows(spark):
    check(spark, texts())


def test_documents(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


@pytest.mark.parametrize("classes", [((2, 8), (5, suffix_dedup.PLACES)), ((2, suffix_dedup.PLACES),)])
def test_anchors_with_many_regions(spark, monkeypatch, classes):
    """Split into classes, at once or in steps, anchors give the same result."""
    monkeypatch.setattr(suffix_dedup, "CLASSES", classes)
    check(spark, texts()[:40])


def test_empty_table(spark):
    none = frame(spark, [(1, "x")]).where("false")
    assert suffix_dedup.remove(spark, none).count() == 0 and suffix_dedup.stripped(spark, none).count() == 0


def test_bytes_that_are_not_utf8(spark):
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(400))
    tail = bytes(rng.randrange(256) for _ in range(30))
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(raw[:250] + tail))], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove(spark, df).collect()}
    assert got == {1: (400, 250), 2: (280, 250)}


@pytest.mark.parametrize("seed", range(4))
def test_construction(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab c") for _ in range(1200)) if seed else bytes(i % 256 for i in range(1200))
    some = [base[k : k + rng.randint(200, 368)] for k in (rng.randint(0, 800) for _ in range(25))] + [b"a" * 260]
    seen = collections.Counter(x[i : i + 200] for x in some for i in range(len(x) - 199))
    for x, f in zip(some, suffix_dedup.repeated(some), strict=True):
        assert f.tolist() == [seen[x[i : i + 200]] > 1 for i in range(len(x) - 199)]


def test_transform_is_that_of_sorted_suffixes(tmp_path):
    """Transform and common prefixes equal those of the suffixes sorted outright; equal suffixes go by text."""
    rng = random.Random(3)
    some = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60))) for _ in range(20)]
    files = suffix_dedup.Files(str(tmp_path))
    bwt, lcp, symbols = suffix_dedup.construct(some, files)
    files.close()
    suffixes = sorted(((x[i:], d, i) for d, x in enumerate(some) for i in range(len(x) + 1)))
    want = [0 if i == 0 else int(np.searchsorted(symbols, some[d][i - 1])) + 1 for _, d, i in suffixes]
    order = lambda xs: [sorted(b for (s, *_), b in zip(suffixes, xs, strict=True) if s == t) for t in sorted({s for s, *_ in suffixes})]
    assert order(want) == order(bwt.tolist())
    for k in range(1, len(suffixes)):
        a, b = suffixes[k - 1][0], suffixes[k][0]
        n = next((j for j, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
        assert lcp[k] == min(n, 255)


def test_classes_split_alike():
    """Windows dealt to classes find the same strings as whole regions do."""
    assert all(sum(1 for c in range(j) if c * -(-suffix_dedup.PLACES // j) <= o <= min(suffix_dedup.PLACES, (c + 1) * -(-suffix_dedup.PLACES // j)) - 1) == 1 for _, j in suffix_dedup.CLASSES for o in range(suffix_dedup.PLACES))
