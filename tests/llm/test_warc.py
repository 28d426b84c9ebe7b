"""Revisit resolution against a plain search by URL and time, and on ties, repeats, extra columns and empty tables."""

import random

from mnemospark.llm import warc

SCHEMA = "record_id long, url string, ts long, kind string, headers map<string,string>, digest string, slice int, near string, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def brute(rows, canonical):
    out = {}
    for i, url, ts, kind, h, d in rows:
        if kind != "revisit":
            continue
        h = h or {}
        earlier = [(t, j, g or {}, e) for j, u, t, k, g, e in rows if k == "response" and url is not None and u is not None and ts is not None and t is not None and canonical[u] == canonical[url] and t <= ts]
        if not earlier:
            out[i] = ("unresolved", None, None, None)
            continue
        _, j, g, e = max(earlier, key=lambda x: x[:2])
        weak = lambda t: t.removeprefix("W/")
        if "etag" in h and "etag" in g:
            status = "verified" if weak(h["etag"]) == weak(g["etag"]) else "stale"
        elif "last-modified" in h and "last-modified" in g:
            status = "verified" if h["last-modified"] == g["last-modified"] else "stale"
        elif d is not None and e is not None:
            status = "verified" if d == e else "stale"
        else:
            status = "unverified"
        merged = {**g, **{k: v for k, v in h.items() if k in warc.RENEWED}}
        out[i] = (status, j, merged, e) if status != "stale" else (status, None, None, None)
    return out


def check(spark, rows):
    df = frame(spark, rows)
    urls = sorted({r[1] for r in rows if r[1] is not None})
    canonical = {r.u: r.c for r in spark.createDataFrame([(u,) for u in urls] or [("",)], "u string").select("u", warc.canonical(warc.F.col("u")).alias("c")).collect()}
    got = {r.record_id: (r.status, r.response_id, r.headers_merged, r.digest_resolved) for r in warc.resolve(df).collect()}
    assert got == brute(rows, canonical)


def test_against_search(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        url = rng.choice((None, "http://www.a.com/x?utm_source=f#top", "https://a.com:443/x/", "http://m.a.com/x", "b.org/", "b.org/index.html", "c.net/q?x=1&ref=2"))
        ts = rng.choice((None, *range(40)))
        h = rng.choice((None, {}, {"etag": '"1"'}, {"etag": 'W/"1"', "date": str(i)}, {"etag": '"2"', "content-type": "t"}, {"last-modified": "m1"}, {"last-modified": "m2", "vary": "v"}))
        rows.append((i, url, ts, rng.choice(("response", "revisit")), h, rng.choice((None, "p1", "p2"))))
    check(spark, rows)


def test_one_hot_url(spark):
    """Captures of one URL lie in many slices of time; what a slice inherits from earlier ones is found."""
    rows = [(2 * i, "a.com/x", i * 1000, "response", {"etag": f'"{i}"'}, None) for i in range(0, 300, 7)]
    rows += [(2 * i + 1, "a.com/x", i * 1000 + 1, "revisit", {"etag": f'"{i // 7 * 7}"'}, None) for i in range(300)]
    check(spark, rows)


def test_urls(spark):
    same = ["http://www.a.com/x?utm_source=f#top", "https://a.com:443/x/", "http://m.a.com/x", "A.com/x/index.html", " a.com/x?gclid=1&fbclid=2 "]
    df = spark.createDataFrame([(u,) for u in same], "u string")
    assert {r[0] for r in df.select(warc.canonical(warc.F.col("u"))).collect()} == {"a.com/x"}


def test_odd_rows(spark):
    check(spark, [(1, "a/x", 5, "response", None, None), (2, "a/x", 5, "revisit", None, None), (3, "a/x", 5, "response", {"etag": "1"}, None), (4, "a/x", 4, "revisit", {"etag": "1"}, None)])
    assert warc.resolve(frame(spark, [(1, "a", 1, "revisit", None, None)]).where("false")).count() == 0
    again = frame(spark, [(1, "a/x", 1, "response", {}, "p"), (2, "a/x", 2, "revisit", {}, "p"), (2, "a/x", 2, "revisit", {}, "p")])
    assert [r.response_id for r in warc.resolve(again).collect()] == [1, 1]


def test_times_of_any_spread(spark):
    """An outlier in time and equal times crowd no slot, and answers stay those of the plain search."""
    F = warc.F
    for make in (lambda i: 0 if i == 0 else 10**12 + i, lambda i: 7, lambda i: 7 if i % 3 else i):
        times = sorted(make(i) for i in range(40000))
        cuts = [times[i * len(times) // 100] for i in range(1, 100)]
        df = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "ts long, i long")
        most = df.groupBy(warc.slots(cuts)("ts", F.pmod(F.xxhash64("i"), F.lit(1 << 31))).alias("s")).count().agg(F.max("count")).first()[0]
        assert most <= 2 * len(times) / 100, most
    rng = random.Random(9)
    for make in (lambda i: 0 if i == 5 else 10**12 + i, lambda i: 7, lambda i: rng.choice((7, 7, 7, i)), lambda i: rng.choice((7, 8))):
        rows = [(i, "a.com/x", make(i), rng.choice(("response", "revisit", "revisit")), {"etag": f'"{rng.randint(1, 3)}"'}, None) for i in range(400)]
        check(spark, rows)
