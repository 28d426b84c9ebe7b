"""The parallel fold against one record at a time, and the similarity join against all pairs."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import words
from mnemospark.operators import guard, similar
from mnemospark.plans import catalogue

BATCH = "project string, seq long, kind string, data map<string,string>"


def tokens(s, before):
    out = set()
    for w in s.split():
        bare = w.strip(".,!?")
        if w not in words.GUARD_STOP and len(w if before else bare) > 2:
            out.add(bare)
    return out


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def check(kind, data, held):
    """The reason of one record against the texts of its kind that are held, in order."""
    if kind not in guard.MAIN:
        return f"Unknown type: {kind}"
    for f in guard.REQUIRED[kind]:
        if not (data.get(f) or "").strip():
            return f"Missing required field: '{f}'"
    raw = data[guard.MAIN[kind]]
    if kind == "snapshot":
        return "Too vague — 'file_structure' needs more detail" if max(len(raw.split(",")), len(raw.split("/"))) < 2 and len(raw.strip()) < 10 else "ok"
    text, n = raw.strip(), len(raw.split())
    if n < 5:
        return f"Too vague — '{guard.MAIN[kind]}' needs at least 5 words (got {n})"
    if kind != "dead_end" and ascii_lower(text) in {ascii_lower(x) for x in held}:
        return f"Exact duplicate{' task' if kind == 'open_task' else ''}: '{text[:60]}'"
    low = text.lower()
    for old in held if kind == "decision" else ():
        for m in words.MARKERS:
            if m in low and m in old.lower():
                a, b, c, d = (tokens(x, False) for x in (*low.split(m, 1), *old.lower().split(m, 1)))
                if a & d and b & c and not (a & c and b & d):
                    return f"Contradicts existing decision: '{old[:80]}'"
    mine = tokens(low, True)
    for old in held:
        theirs = tokens(old.lower(), True)
        if mine and theirs and (sim := len(mine & theirs) / len(mine | theirs)) >= words.SIMILAR:
            return f"Too similar to existing {guard.NAMES[kind]} ({int(sim * 100)}% match): '{old[:70]}'"
    if kind == "decision" and not (data.get("why") or "").strip():
        return guard.NO_REASON
    return "ok"


def one_by_one(new, existing=()):
    held, out = {}, {}
    for p, _, kind, data in sorted(existing, key=lambda r: r[1]):
        held.setdefault((p, kind), []).append(data[guard.MAIN[kind]].strip())
    for p, seq, kind, data in sorted(new, key=lambda r: r[1]):
        mine = held.setdefault((p, kind), [])
        out[p, seq] = reason = check(kind, data, mine)
        if reason == "ok":
            mine.append(data[guard.MAIN[kind]].strip())
    return out


def made(n, seed, kinds=("decision", "open_task", "dead_end", "snapshot", "poem")):
    rng, out = random.Random(seed), []
    vocabulary = [f"{a}{b}" for a in ("log", "page", "queue", "cache", "table", "node", "job", "key") for b in ("", "s", "er", "ing", "ness")]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 9))) for _ in range(max(3, n // 12))]
    for i in range(n):
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            t.insert(rng.randint(1, len(t) - 1), rng.choice(["over", "vs", "not", "instead of"]))
        text = rng.choice(["", " ", "\t"]) + " ".join(x.upper() if rng.random() < 0.1 else x for x in t) + rng.choice(["", ".", " ", "\n"])
        kind = rng.choices(kinds, [10, 4, 3, 1, 1][: len(kinds)])[0]
        field = guard.MAIN.get(kind, "what")
        data = {field: text if rng.random() < 0.95 else rng.choice(["", "  ", "too few words", "of of of of of of"])}
        if kind == "decision" and rng.random() < 0.9:
            data["why"] = rng.choice(["because", " ", "it works"])
        if kind == "dead_end":
            data["why_failed"] = rng.choice(["slow", "slow", ""])
        if out and rng.random() < 0.2:  # an earlier record again, in other letters
            kind, data = out[-1][2], {k: v.upper() if rng.random() < 0.5 else f" {v}" for k, v in out[-1][3].items()}
        out.append((rng.choice("ppq"), i, kind, data))
    return out


@pytest.mark.parametrize(("n", "seed", "nearest"), [(150, 1, 1024), (260, 2, 3)])
def test_fold_is_one_record_at_a_time(spark, monkeypatch, n, seed, nearest):
    """Also where lists of postings are looked at three records at a time, so that many rounds are needed."""
    monkeypatch.setattr(guard, "NEAREST", nearest)
    rows = made(n, seed)
    existing = [r for r in made(60, seed + 50, ("decision", "open_task", "dead_end")) if r[3][guard.MAIN[r[2]]].strip()][:30]
    want = one_by_one(rows, existing)
    got = {(r["project"], r["seq"]): (r["status"], r["reason"]) for r in guard.fold(spark.createDataFrame(rows, BATCH), spark.createDataFrame(existing, BATCH)).collect()}
    assert {k: r for k, (_, r) in got.items()} == want
    assert {r.split(":")[0].split(" (")[0] for r in want.values()} >= {"ok", "Exact duplicate", "Contradicts existing decision", "Too similar to existing decision"}
    assert all(s == ("committed" if r == "ok" else "rejected" if r.startswith("Unknown") else "staged") for s, r in got.values())


def test_fold_on_the_documents(spark):
    """The registered query, whole first lines of four projects, against one record at a time."""
    d = "/root/testdata/sf0.001"
    rows = [(r["project"], r["seq"], "decision", {"what": r["what"], "why": "because"}) for r in catalogue.short(spark, d).collect()]
    got = {(r["project"], r["seq"]): r["reason"] for r in catalogue.sequential_guard(spark, d).collect()}
    assert got == one_by_one(rows)


def test_a_hot_group_settles_in_a_few_rounds(spark):
    """Twenty thousand near copies and as many exact ones of one project: no list is compared beyond its head."""
    near = spark.range(20000).select(F.lit("p").alias("project"), F.col("id").alias("seq"), F.lit("decision").alias("kind"), F.create_map(F.lit("what"), F.concat(F.lit("the common words of a hot group stay alike number"), F.col("id").cast("string")), F.lit("why"), F.lit("x")).alias("data"))
    same = near.select("project", (F.col("seq") + 20000).alias("seq"), "kind", F.create_map(F.lit("what"), F.lit("quite another text that is here again and again"), F.lit("why"), F.lit("x")).alias("data"))
    both = near.unionByName(same)
    got = guard.fold(both, both.where("false")).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"committed": 2, "staged": 39998}


def test_empty_batches(spark):
    none = spark.createDataFrame([], BATCH)
    assert guard.fold(none, none).count() == 0


def test_similar_pairs_against_all(spark):
    rng = random.Random(3)
    sets = set()
    while len(sets) < 300:
        sets.add(tuple(sorted(rng.sample("abcdefghijklmnopqrst", rng.randint(1, 12)))))
    rows = [("s" if i % 3 else "r", i, list(t)) for i, t in enumerate(sorted(sets))]
    df = spark.createDataFrame(rows, "scope string, sid long, t array<string>")
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    for least in (0.45, 0.8):
        want = {(a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and sim(a[2], b[2]) >= least}
        assert {(r["scope"], r["x"], r["y"]) for r in similar.within(df, least).collect()} == want
        both = {(r["scope"], r["x"], r["y"]) for r in similar.between(df, df, least).collect()}
        assert both == want | {(s, y, x) for s, x, y in want} | {(r[0], r[1], r[1]) for r in rows}


def linked_one_by_one(rows, there):
    """The reasons of records (project, seq, kind, data, id) one at a time, links followed."""
    held, want, kept = {}, {}, {}
    for p, seq, kind, data, id_ in sorted(rows, key=lambda r: r[1]):
        mine = held.setdefault((p, kind), [])
        reason = check(kind, data, mine)
        link = next((x.strip() for x in (data.get("supersedes_id"), data.get("chosen_decision_id")) if x and x.strip()), None)
        if reason == "ok" and link and link not in there and kept.get(link) != p:
            reason = f"Referenced decision does not exist: '{link}'"
        want[p, seq] = reason
        if reason == "ok":
            mine.append(data[guard.MAIN[kind]].strip())
            if kind == "decision":
                kept[id_] = p
    return want


def test_the_batch_of_documents(spark):
    """The registered query against one record at a time."""
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in catalogue.batch(spark, d).collect()]
    got = {(r["project"], r["seq"]): r["reason"] for r in catalogue.batch_outcomes(spark, d).collect()}
    want = linked_one_by_one(rows, set())
    assert got == want and {r.split(":")[0].split(" (")[0] for r in want.values()} >= {"ok", "Referenced decision does not exist"}


def test_links_within_a_batch(spark):
    """Records that name a decision of the batch count only once that is accepted; those left out stand in nobody's way."""
    rng, rows = random.Random(5), []
    for p, i, kind, data in made(160, 9, ("decision", "open_task", "dead_end")):
        if kind != "open_task" and rng.random() < 0.5:
            data = data | {"supersedes_id" if kind == "decision" else "chosen_decision_id": rng.choice([f"b{rng.randrange(i + 5)}", f"b{max(0, i - 1)}", "held", "nope", " "])}
        rows.append((p, i, kind, data, f"b{i}"))
    want = linked_one_by_one(rows, {"held"})
    new = spark.createDataFrame(rows, BATCH + ", id string")
    got = {(r["project"], r["seq"]): r["reason"] for r in guard.fold(new, new.where("false"), decisions=spark.createDataFrame([("held",)], "id string")).collect()}
    assert got == want and sum(r.startswith("Referenced") for r in want.values()) > 10


def shuffled(spark, df):
    """Bytes that a query's shuffles write, as the executors count them."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total = lambda: sum(x.totalShuffleWrite() for x in (lambda s: [s.apply(i) for i in range(s.size())])(store.executorList(False)))
    before = total()
    rows = df().count()
    time.sleep(1)  # the counts come by way of the listener
    return rows, total() - before


def near_copies(spark, n):
    """n near copies of one text of twelve words, half of them under a second opening."""
    what = F.concat(F.lit("alpha bravo charlie delta echo foxtrot golf hotel india juliet number"), F.col("id").cast("string"), F.lit(" sort"), F.pmod("id", F.lit(7)).cast("string"))
    return spark.range(n).select(F.lit("p").alias("project"), "id", F.col("id").alias("seq"), what.alias("what"), F.lit("").alias("why"))


@pytest.mark.parametrize("query", [guard.fuzzy_pairs, guard.reasons])
def test_shuffles_of_near_copies_grow_with_their_number(spark, query):
    """Four times the copies, not sixteen times the bytes: pairs are reduced to the first one where they are made."""
    (_, few), (rows, many) = (shuffled(spark, lambda n=n: query(near_copies(spark, n))) for n in (1000, 4000))
    assert rows >= 3999 and many < 8 * few


@pytest.mark.parametrize(("longer", "head"), [(1024, 64), (8, 3), (1, 1)])
def test_the_first_similar_set_against_all(spark, monkeypatch, longer, head):
    """Also where lists are looked at by their heads first."""
    monkeypatch.setattr(similar, "LONG", longer)
    monkeypatch.setattr(similar, "HEAD", head)
    rng = random.Random(11)
    made_sets = lambda n: [("s" if rng.random() < 0.7 else "r", i, sorted(rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(1, 12)))) for i in range(n)]
    one, two = made_sets(250), made_sets(200)
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    frame = lambda rows: spark.createDataFrame(rows, "scope string, sid long, t array<string>")
    for others, fits in ((None, lambda x, y: y < x), (two, lambda x, y: True)):
        want = {}
        for scope, x, t in one:
            hit = next(((y, sim(t, u)) for s, y, u in others or one if s == scope and fits(x, y) and sim(t, u) >= 0.45), None)
            if hit:
                want[scope, x] = hit
        got = similar.first(frame(one), frame(others) if others else None, 0.45).collect()
        assert {(r["scope"], r["x"]): (r["y"], r["sim"]) for r in got} == want and len(got) == len(want) > 50


def test_equal_ids_of_different_texts_stay_apart(spark):
    """An id that comes twice keeps the tokens of its texts apart."""
    rows = [("p", 1, 1, "red green blue white black"), ("p", 2, 2, "one two three four five six"), ("p", 2, 2, "red green blue white black grey"), ("p", 3, 3, "one two three four five six seven")]
    got = guard.fuzzy_pairs(spark.createDataFrame(rows, "project string, id long, seq long, what string")).collect()
    assert sorted((r["id"], r["other"]) for r in got) == [(2, 1), (3, 2)]


def test_only_records_that_were_not_accepted_are_looked_up(spark, monkeypatch):
    texts = ["Use the alpha queue for jobs today", "use the ALPHA queue for jobs today", "Use the alpha queue for jobs today now", "Keep beta cache near the edge nodes", "Write gamma logs into cold storage weekly", "Too short"]
    rows = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "project string, seq long, what string")
    rows = rows.select("project", "seq", F.lit("decision").alias("kind"), F.create_map(F.lit("what"), "what", F.lit("why"), F.lit("because")).alias("data"))
    asked, searched = [], []
    judge, listed = guard.judge, guard.similar.first
    monkeypatch.setattr(guard, "judge", lambda known, *a: (asked.extend(r.seq for r in known.collect()), judge(known, *a))[1])
    monkeypatch.setattr(guard.similar, "first", lambda a, *b: (searched.append(a.count()), listed(a, *b))[1])
    got = {r.seq: r.status for r in guard.fold(rows, rows.where("false")).collect()}
    assert got == {0: "committed", 1: "staged", 2: "staged", 3: "committed", 4: "committed", 5: "staged"}
    # the equal text is told without a search for similar ones
    assert sorted(asked) == [1, 2, 5] and searched[-1] == 1


def test_tokens_of_one_side_alone_have_no_codes(spark):
    a = spark.createDataFrame([("s", 1, ["x", "y"]), ("s", 2, ["x", "only"]), ("s", 3, ["only", "y"])], "scope string, sid long, t array<string>")
    b = spark.createDataFrame([("s", 9, ["x", "other"]), ("s", 10, ["other", "y"])], "scope string, sid long, t array<string>")
    steps = guard.Steps(spark)
    assert {r.token for r in guard.similar.codes(steps, a, b).collect()} == {"x", "y"}
    assert {r.token for r in guard.similar.codes(steps, a).collect()} == {"x", "y", "only"}
    assert sorted((r.x, r.y) for r in guard.similar.between(a, b, 0.3).collect()) == [(1, 9), (1, 10), (2, 9), (3, 10)]
