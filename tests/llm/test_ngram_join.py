"""The n-gram join against all pairs compared, and on repeated ids, rows without id, nulls and empty tables."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import ngram_join
from mnemospark.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute(rows):
    """Multiset of (doc_id, class_id, n_links) by comparing all pairs of different sets that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=sorted)
    by = collections.defaultdict(list)
    for i, s in enumerate(distinct):
        for x in s:
            by[x].append(i)
    top, links = list(range(len(distinct))), [0] * len(distinct)

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in enumerate(distinct):
        for j, n in collections.Counter(j for x in s for j in by[x] if j < i).items():
            if 5 * n >= 4 * (len(s) + len(distinct[j]) - n):
                links[i] += 1
                links[j] += 1
                top[root(i)] = root(j)
    at = {s: i for i, s in enumerate(distinct)}
    ids = collections.defaultdict(list)
    for (d, _), s in zip(rows, sets, strict=True):
        if s and d is not None:
            ids[root(at[s])].append(d)
    out = collections.Counter()
    for (d, _), s in zip(rows, sets, strict=True):
        out[(d, min(ids[root(at[s])], default=None), links[at[s]]) if s else (d, d, 0)] += 1
    return out, links


def mixture(rng):
    """Pairs of similarity about 0.8 and more, one large group of near copies, copies, and unrelated texts."""
    rows = []
    for _ in range(120):
        base = words(rng, rng.randint(60, 300))
        near = list(base)
        for k in range(rng.randint(0, max(1, len(base) // 45))):
            near[rng.randrange(len(near))] = f"other{k}"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(near))]
    base = words(rng, 150)
    for i in range(300):
        near = list(base)
        near[i % 150] = f"other{i}"
        rows.append((1000 + i, " ".join(near)))
    return rows + [(2000 + i, rows[0][1]) for i in range(50)] + [(3000 + i, " ".join(words(rng, rng.randint(1, 40)))) for i in range(100)]


def test_against_all_pairs(spark):
    rng = random.Random(7)
    rows = mixture(rng)
    near = " ".join(rows[0][1].split()[:-1] + ["end"])
    rows += [(5, rows[0][1]), (5, near), (9, None), (9, ""), (None, near), (None, "only here " * 9), (None, "only here " * 9), (None, None)]
    rng.shuffle(rows)
    want, links = brute(rows)
    assert sum(links) > 80000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.match(spark, df).collect())
    assert got == want
    # nothing goes but for a copy that stays
    left = [(r.doc_id, r.text) for r in ngram_join.keep_one(spark, df).collect()]
    classes = collections.defaultdict(set)
    for (d, t), n in collections.Counter(rows).items():
        classes[d, t] = n
    assert len(left) == len({c for _, c, n in want if c is not None}) - len({9}) + sum(1 for _, t in rows if not shingle_set(t)) + 1
    after, _ = brute(left)
    assert all(n == 0 for _, _, n in after)


@pytest.mark.parametrize("rows", [[(1, "a b c d e f g"), (2, "a b c d e f g h")], [(1, "same text here for two"), (1, "same text here for two")]])
def test_small(spark, rows):
    want, _ = brute(rows)
    got = ngram_join.match(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want


def test_recall_on_borderline_pairs(spark):
    """Pairs between 0.8 and 0.85 under the shortest target: the forest's own edges, before groups are verified."""
    rng = random.Random(11)
    rows, pairs = [], []
    while len(pairs) < 400:
        base = words(rng, rng.randint(100, 300))
        near = list(base)
        step = len(base) // max(1, int(len(base) * 0.02))
        for k in range(3, len(base), step + rng.randint(0, 3)):
            near[k] = f"other{k}"
        a, b = shingle_set(" ".join(base)), shingle_set(" ".join(near))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            pairs.append(len(rows))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(near))]
    got = {r.doc_id: r.n_links for r in ngram_join.match(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == 1 for i in pairs) >= 0.99 * len(pairs)


def test_large_nodes_are_split_and_shortened(spark, monkeypatch):
    """With tiny nodes allowed, prefixes go down to the last level, and up again where the recall asks for it."""
    rng = random.Random(5)
    base = words(rng, 200)
    rows = []
    for i in range(200):
        near = list(base)
        near[i] = f"other{i}"
        rows.append((i, " ".join(near)))
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = Scratch(spark)
    reps = df.select(F.col("text").cast("binary").alias("text"), "doc_id", F.lit(0).cast("long").alias("th")).select("doc_id", "th", "text").mapInArrow(ngram_join._sign, ngram_join.SIGNED).select(F.col("doc_id").alias("rep"), "label")
    buckets = ngram_join.forest(scratch, reps)
    trees = buckets.groupBy("rep").count().collect()
    assert len(trees) == 200 and max(r["count"] for r in trees) <= ngram_join.TREES
    assert buckets.groupBy("bucket").count().where("count > 4").count() > 0
    assert {r.n_links for r in ngram_join.match(spark, df).collect()} == {199}


def test_blocks_by_size(spark, tmp_path):
    """In a group of several blocks any two sets that could be linked by their sizes meet exactly once, others never; small groups are one part."""
    rng = random.Random(8)
    sizes = [rng.choice((1, 2, 4, 5, 40, 50, 51, 400, 500, 501, 4000)) for _ in range(700)] + [rng.randint(1, 3000) for _ in range(300)]
    rows = [(i, 1, bytes(8 * n)) for i, n in enumerate(sizes)] + [(2000 + i, 2, bytes(8 * n)) for i, n in enumerate(sizes[:50])] + [(3000, 3, bytes(8))]
    got = ngram_join._sized(Scratch(spark), spark.createDataFrame(rows, "rep long, group long, sh binary")).select("rep", "group", "part", "side").collect()
    parts = collections.defaultdict(list)
    for r in got:
        parts[r.group, r.part].append((r.rep, r.side))
    assert not any(g == 3 for g, _ in parts) and [len(v) for (g, _), v in parts.items() if g == 2] == [50]
    met = collections.Counter()
    for (g, _), members in parts.items():
        if g == 1:
            same = all(side == 0 for _, side in members)
            left = [i for i, side in members if side <= 0]
            right = left if same else [i for i, side in members if side > 0]
            met.update((min(i, j), max(i, j)) for i in left for j in right if i < j or not same)
    assert set(met.values()) == {1}
    size = lambda i: sizes[i]
    for i in range(1000):
        for j in range(i + 1, 1000):
            low, high = sorted((size(i), size(j)))
            if low * 5 >= high * 4:
                assert (i, j) in met
    assert all(max(size(i), size(j)) <= 1.6 * min(size(i), size(j)) for i, j in met)


def test_target_depth():
    d = ngram_join.deepest(ngram_join.RECALL)
    assert 1 - (1 - 0.8**d) ** ngram_join.TREES >= ngram_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** ngram_join.TREES


def test_empty_table_and_odd_names(spark):
    schema = "doc_id long, text string, `a.b` int, row int, th string, packed int, words int"
    none = spark.createDataFrame([], schema)
    assert ngram_join.match(spark, none).count() == 0 and ngram_join.keep_one(spark, none).count() == 0
    some = spark.createDataFrame([(1, "a b c", 1, 2, "x", 3, 4), (2, "a b c", 1, 2, "x", 3, 4), (3, None, 1, 2, "x", 3, 4)], schema)
    kept = ngram_join.keep_one(spark, some)
    assert kept.columns == some.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_shingles_tell_words_apart():
    rng = random.Random(2)
    for t in [" ".join(words(rng, n)) for n in (1, 3, 5, 6, 3000)] + ["", "  ", "a" * 900, "x y " * 300, " é 😀\tz\n"]:
        assert len(ngram_join.shingles(t.encode())) == len(shingle_set(t) or ())


def test_rows_that_differ_in_other_columns_only(spark):
    """Which of the rows with one id and text stays hangs on what they hold, not on where they lie."""
    rows = [(1, "one text of some words that repeats", s, {"k": i}, None if i % 2 else float(i)) for i, s in enumerate("dbaec")] + [(2, "another text of quite other words here", "z", None, None)] * 3
    schema = "doc_id long, text string, `so.urce` string, m map<string,int>, x double"
    kept = [sorted((r[0], r[2]) for r in ngram_join.keep_one(spark, spark.createDataFrame(some, schema).repartition(n)).collect()) for some, n in ((rows, 1), (rows[::-1], 5), (rows[3:] + rows[:3], 3))]
    assert kept == [[(1, "a"), (2, "z")]] * 3
