"""Fill-in-the-middle against plain Python, and back again."""

import hashlib
import re

import pytest

from mnemospark.llm import fill_middle

SCHEMA = "doc_id long, text string, n int, form string, `a.b` int"
UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def brute(i, text):
    text = text or ""
    units = UNIT.findall(text)
    x = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * j : 8 * j + 8], 16) for j in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


TEXTS = ["", None, " ", "\n\n", "one", " one", "one ", "a b\tc\x0bd\x0ce\r\nf   g h", "é́ \U0001f600 中文 x\x00y", "has <P> in it", "a <S> b", "x<M>", "ends with < and <S", "S> at first", "P>S>M> <<S <<P", "'quote' \\ %s {0}", "word " * 50]


def rows():
    return [(i, TEXTS[i % len(TEXTS)] if i % 3 else f"row {i} " + "wörd  \n" * (i % 37), 1, "f", 2) for i in range(400)]


def test_against_plain_python(spark):
    data = rows() + [(None, "no id at all here", 1, "f", 2), (5, "an id again", 1, "f", 2), (5, "an id again", 1, "f", 2)]
    df = spark.createDataFrame(data, SCHEMA)
    want = sorted((brute(r[0], r[1]) for r in data), key=repr)
    out = fill_middle.transform(df)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert {r[2] for r in want} == {"plain", "spm", "psm"}
    back = sorted((r["doc_id"] is not None, r["doc_id"], r["text"]) for r in fill_middle.restore(out).where("doc_id is not null").collect())
    assert back == sorted((True, r[0], r[1] or "") for r in data if r[0] is not None)
    got = sorted(map(tuple, fill_middle.digests(df).collect()), key=repr)
    assert got == sorted(((*w[:5], sha(w[5]), sha(r[1] or "")) for w, r in ((brute(r[0], r[1]), r) for r in data)), key=repr)


def test_very_long_texts_are_taken_whole(spark):
    i = next(i for i in range(100) if brute(i, "a b c d")[2] != "plain")
    text = " ".join(f"w{j}" for j in range(900_000)) + "\n"
    df = spark.createDataFrame([(i, text, 1, "f", 2), (i, "x" * 6_000_000, 1, "f", 2), (i, "a b c", 1, "f", 2)], SCHEMA)
    want = sorted((*brute(i, t)[:5], sha(brute(i, t)[5]), sha(t)) for t in (text, "x" * 6_000_000, "a b c"))
    assert sorted(map(tuple, fill_middle.digests(df).collect())) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert fill_middle.transform(df).count() == fill_middle.digests(df).count() == fill_middle.restore(fill_middle.transform(df)).count() == 0


@pytest.mark.parametrize("size", [1, 50])
def test_slices_change_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(fill_middle, "SLICE", size)
    df = spark.createDataFrame(rows(), SCHEMA)
    assert sorted(map(tuple, fill_middle.transform(df).collect()), key=repr) == sorted((brute(r[0], r[1]) for r in rows()), key=repr)


def test_other_names_and_seeds(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumnsRenamed({"doc_id": "k.1", "text": "body"})
    a = {r["doc_id"]: r["form"] for r in fill_middle.transform(df, "k.1", "body", seed=7).collect()}
    b = {r["doc_id"]: r["form"] for r in fill_middle.transform(df, "k.1", "body").collect()}
    assert a != b and a.keys() == b.keys()


def test_agrees_with_sql(spark):
    import duckdb

    from tests.oracle_check import differences, tables

    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    tables(con, d)
    assert differences(spark, con, d, "op13", lambda s, x: fill_middle.digests(s.read.parquet(f"{x}/documents.parquet")), fill_middle.ORACLE) == ""
