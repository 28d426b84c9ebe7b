"""The Merkle manifest against a tree built by hand in plain Python."""

import hashlib
import zlib

from mnemospark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, tree string, `a.b` int, idx int"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root of a list of digests, and for each its path of (before, after)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for j, p in enumerate(paths):
            run, own = runs[at[j] // 16], at[j] % 16
            p.append(("".join(run[:own]), "".join(run[own + 1 :])))
            at[j] //= 16
        level = [h("".join(r)) for r in runs]
    return level[0], paths


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0], leaf(r[:5]), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = {s: climb([x[1] for x in trees[s]]) for s in names}
    root, tops = climb([subs[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (i, own, r), path in zip(trees[s], subs[s][1], strict=True):
            path = path + top
            now = own
            if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and r[4] is not None:
                now = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                now = h(a + now + b)
            out.append((i, own, subs[s][0], root, h("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=repr)


def found(spark, rows):
    return sorted(map(tuple, merkle.manifest(spark, spark.createDataFrame(rows, SCHEMA)).drop("path").collect()), key=repr)


def made(n, source, first=0, text="Some Text"):
    return [(first + i, source(i) if callable(source) else source, "en", i, f"{text} {i}", "t", 1, 2) for i in range(n)]


def test_manifest(spark):
    rows = made(700, lambda i: "hot" if i % 3 else f"s{i % 40}") + made(300, "Hot", 5000, "ÄÖ Über ЖЖ")
    odd = [(None, None, None, None, None, None, None, None), (9000, "", "", 0, "", None, None, None), (9001, None, "x", -3, "A" * 300000, None, None, None), (10, "hot", "en", 1, None, None, None, None), (-4, "é", "en", 1, "x:y-", None, None, None)]
    rows += odd + rows[:3] + [(10, "hot", "en", 1, "Other", None, None, None)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert len(got) == len(rows) and {r[6] for r in got} == {True, False}


def test_trees_of_every_size(spark):
    for n in (1, 2, 16, 17, 257):
        rows = made(n, "one")
        assert found(spark, rows) == brute(rows)
    rows = made(40, lambda i: f"s{i}")  # a leaf each, so that every leaf is a subroot
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_equal_rows_take_the_places_one_after_another(spark):
    rows = made(1, "one") * 40
    assert found(spark, rows) == brute(rows)


def test_paths_hold_what_a_reader_needs(spark):
    rows = made(50, "one")
    for r in merkle.manifest(spark, spark.createDataFrame(rows, SCHEMA)).collect():
        now = r["leaf"]
        for s in r["path"]:
            now = h(s["before"] + now + s["after"])
        assert now == r["root"]
