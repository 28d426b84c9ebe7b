"""The record engine: fixed cases of its rules, its calls end to end, and agreement of queries with SQL."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions import scoring, words
from mnemospark.functions.text import STEM, category, postings
from mnemospark.operators import guard, rank, records
from mnemospark.operators.memory import Memory
from mnemospark.plans import catalogue
from mnemospark.sources import git

from .oracle_check import differences, tables

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    tables(c, SF)
    return c


@pytest.mark.parametrize("name", ["audit_counts", "policy_stats", "policy_fixture", "hot_tasks_pack", "keyword_rank", "warm_pack", "recent_rank", "route_task", "contradictions", "extract_gates", "supersede_view", "provenance"])
def test_queries_agree_with_sql(spark, con, name):
    assert differences(spark, con, SF, name, catalogue.queries()[name], catalogue.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["exact_dups", "fuzzy_dups", "guard_reasons"])
def test_queries_of_lines_agree_with_sql(spark, con, name):
    assert differences(spark, con, SF, name, catalogue.queries()[name], catalogue.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["dense_rank", "dense_topk", "rrf_fuse", "hybrid_pin"])
def test_every_twentieth_vector_is_a_query(spark, con, name):
    assert differences(spark, con, SF, name, catalogue.queries()[name], catalogue.oracle_sql()[name]) == ""
    ids = [r[0] for r in catalogue.vectors(spark, SF).where("id % 20 = 0").select("id").collect()]
    assert len(ids) > 2 and {r.query_id for r in catalogue.queries()[name](spark, SF).collect()} == set(ids)


def test_every_language_is_tokenised(spark, con):
    assert differences(spark, con, SF, "tokenize", catalogue.queries()["tokenize"], catalogue.oracle_sql()["tokenize"]) == ""
    docs = catalogue.decisions(spark, SF).select("id", "project")
    got = catalogue.tokenize(spark, SF).select("id").distinct().join(docs, "id").select("project").distinct()
    assert {r[0] for r in got.collect()} == {r[0] for r in docs.select("project").distinct().collect()}


def test_words_after_the_twentieth_count(spark, tmp_path):
    head = " ".join(f"word{i}" for i in range(20))
    rows = [(i, f"{head} {' '.join(f'{t}{j}' for j in range(60))}\nmore", "en", "a") for i, t in enumerate(["left", "right"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    assert catalogue.exact_dups(spark, d).count() == 0 and catalogue.fuzzy_dups(spark, d).count() == 0
    assert {r.status for r in catalogue.sequential_guard(spark, d).collect()} == {"committed"}


def test_every_query_has_sql_or_is_a_fold():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"sequential_guard", "batch_outcomes"}


def test_stems(spark):
    pairs = {"tries": "try", "tried": "try", "classes": "class", "connection": "connect", "station": "station", "monitoring": "monitor", "saved": "save", "matched": "matche", "tested": "test", "quickly": "quick", "errors": "error", "status": "status", "bus": "bus"}
    df = spark.createDataFrame(list(pairs.items()), "w string, want string").withColumn("got", F.expr(STEM))
    assert [r for r in df.collect() if r["got"] != r["want"]] == []


def test_related_terms_follow_the_stem(spark):
    df = spark.createDataFrame([(1, "Redis errors, hashing!")], "id int, t string")
    assert {r["token"] for r in postings(df, ["id"], ["t"]).collect()} == {"redis", "cache", "key-value", "error", "hash"}


def test_decay(spark):
    rows = [(1.0, NOW), (1.0, NOW - timedelta(90)), (0.5, NOW + timedelta(5)), (None, NOW - timedelta(180))]
    df = spark.createDataFrame(rows, "c double, t timestamp")
    got = [r[0] for r in df.select(scoring.effective(F.col("c"), F.col("t"), F.lit(NOW))).collect()]
    assert got == pytest.approx([1.0, 0.5, 0.5, 0.25])


def test_category(spark):
    assert spark.range(1).select(category(F.lit("Too vague — 'what' needs"))).first()[0] == "Too vague"


def test_fusion_keeps_a_clear_first(spark):
    kw = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.3, 2), (1, "c", 0.2, 3)], "query_id int, id string, base double, pos int")
    dn = spark.createDataFrame([(1, "c", 1), (1, "b", 2), (1, "a", 3)], "query_id int, id string, pos int")
    order = lambda k: [r["id"] for r in rank.fuse_and_guard(k, dn).orderBy("pos").collect()]
    assert order(kw)[0] == "a"
    assert order(kw.withColumn("base", F.lit(0.0))) == ["c", "b", "a"]


def test_fold_sees_what_it_accepted(spark):
    rows = [("p", i, "decision", {"what": w, "why": "because"}) for i, w in enumerate(["Use one queue for all jobs", "use one queue for all jobs", "Pick one queue for all jobs", "Short one"])]
    new = spark.createDataFrame(rows, "project string, seq long, kind string, data map<string,string>")
    got = {r["seq"]: r["status"] for r in guard.fold(new, new.where("false")).collect()}
    assert got == {0: "committed", 1: "staged", 2: "staged", 3: "staged"}


def test_memory_end_to_end(spark, tmp_path):
    m = Memory(spark, str(tmp_path))
    a = m.write("decision", "p", {"what": "Use SQLite over PostgreSQL as the data store", "why": "no server to run"}, NOW)
    assert a["status"] == "committed"
    assert m.write("decision", "p", {"what": "Put PostgreSQL over SQLite in new services", "why": "x"}, NOW)["reason"].startswith("Contradicts")
    b = m.write("dead_end", "p", {"what_tried": "Tried a shared json file for records", "why_failed": "races", "chosen_decision_id": a["id"]}, NOW)
    assert b["status"] == "committed"
    assert m.write("dead_end", "p", {"what_tried": "Tried another odd thing for records too", "why_failed": "no", "chosen_decision_id": "nope"}, NOW)["status"] == "rejected"
    assert len(m.provenance(a["id"])["dead_ends"]) == 1 and m.provenance("nope") is None
    assert [r["id"] for r in m.warm("p", "which database for data", NOW).collect()] == [a["id"]]
    assert m.sweep(NOW + timedelta(400)) == [a["id"]]
    assert m.warm("p", "database", NOW).count() == 0
    m.reinforce(a["id"], NOW + timedelta(401))
    assert m.warm("p", "database", NOW + timedelta(402)).count() == 1
    first = m.handoff("p", "x", "y", NOW + timedelta(403))
    assert len(first["delta"]["decisions_added"]) == 1
    assert m.handoff("p", "y", "x", NOW + timedelta(404))["delta"]["decisions_added"] == []
    staged = m.staging("p").collect()
    assert m.promote(staged[0]["id"], NOW)["status"] == "committed" and m.reject("nope", NOW)["status"] == "not_found"


def toy(texts):
    """Vectors of length one from counts of a few words: a provider for tests."""
    out = []
    for t in texts:
        v = [1.0 + t.lower().count(w) for w in ("rest", "grpc", "api", "queue", "log", "cache")]
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v])
    return out


def test_stored_texts_are_stripped(spark, tmp_path):
    m = Memory(spark, str(tmp_path))
    assert m.write("decision", "p", {"what": "  Use one queue for all jobs ", "why": " simple "}, NOW)["status"] == "committed"
    row = m.store.current("decisions").first()
    assert (row["what"], row["why"]) == ("Use one queue for all jobs", "simple")
    again = m.write("decision", "p", {"what": "use one queue for all jobs", "why": "x"}, NOW)
    assert again["reason"].startswith("Exact duplicate")


def test_read_estimates_and_leaves_an_event(spark, tmp_path):
    m = Memory(spark, str(tmp_path))
    m.write("decision", "p", {"what": "Use one queue for all jobs", "why": "simple"}, NOW)
    m.write("open_task", "p", {"description": "Move the old jobs to the queue"}, NOW)
    out = m.read("p", "which queue", NOW)
    warm = out["warm"].collect()
    assert out["token_estimate"] == sum(r["cost"] for r in warm) + sum(r["cost"] for r in out["hot"].collect())
    assert warm[0]["effective_confidence"] == 1.0
    event = m.audit_log("p").where("kind = 'query'").collect()
    assert len(event) == 1 and '"decisions_returned": 1' in event[0]["payload"] and '"open_tasks_returned": 1' in event[0]["payload"]


def test_batches_persist(spark, tmp_path):
    m = Memory(spark, str(tmp_path))
    rows = [("p", 1, "decision", {"what": " Use one queue for all jobs", "why": "simple", "confidence": "3"}), ("p", 2, "decision", {"what": "use one queue for all jobs", "why": "x"}),
            ("q", 1, "decision", {"what": "Use one queue for all jobs", "why": "other project"}), ("q", 2, "open_task", {"description": "Write down how the queue works"}), ("q", 3, "poem", {})]
    got = {(r["project"], r["seq"]): r for r in m.write_batch(spark.createDataFrame(rows, "project string, seq long, kind string, data map<string,string>"), NOW).collect()}
    assert {k: r["status"] for k, r in got.items()} == {("p", 1): "committed", ("p", 2): "staged", ("q", 1): "committed", ("q", 2): "committed", ("q", 3): "rejected"}
    assert sorted((r["project"], r["what"], r["confidence"]) for r in m.store.current("decisions").collect()) == [("p", "Use one queue for all jobs", 1.0), ("q", "Use one queue for all jobs", 1.0)]
    assert m.store.current("open_tasks").first()["status"] == "open" and m.staging("p").count() == 1 and m.audit_log().count() == 5
    assert m.write_batch(spark.createDataFrame(rows[:1], "project string, seq long, kind string, data map<string,string>"), NOW).first()["status"] == "staged"
    seqs = [r["seq"] for r in m.store.log("audit_log").orderBy("seq").collect()]
    assert len(seqs) == len(set(seqs)) == 6


def test_hybrid_read_with_a_provider(spark, tmp_path):
    m = Memory(spark, str(tmp_path), embed=toy, model="toy")
    rows = [("p", i, "decision", {"what": what, "why": "because it works"}) for i, what in enumerate(("Keep a log of every single job", "Serve the api by rest calls only", "Put a cache before slow pages", "Keep the queue small at night"))]
    out = m.write_batch(spark.createDataFrame(rows, "project string, seq long, kind string, data map<string,string>"), NOW)
    assert {r["status"] for r in out.collect()} == {"committed"}
    warm = [r["what"] for r in m.warm("p", "api design", NOW).collect()]
    assert warm[0] == "Serve the api by rest calls only" and len(warm) == 4
    # no token in common: the dense order stands
    assert m.warm("p", "grpc grpc rest", NOW).first()["what"] == "Serve the api by rest calls only"
    kept = m.store.current("decision_embeddings")
    assert kept.count() == 4 and {r["model"] for r in kept.collect()} == {"toy"}


def test_contradictions_in_meaning(spark, tmp_path):
    m = Memory(spark, str(tmp_path), embed=toy, model="toy")
    m.write("decision", "p", {"what": "Adopted rest for the public api", "why": "simple"}, NOW)
    assert m.write("decision", "p", {"what": "Moved to rest grpc for this public api now", "why": "speed"}, NOW)["reason"].startswith("Contradicts")
    assert m.write("decision", "p", {"what": "Wrote the public queue cache log page", "why": "speed"}, NOW)["status"] == "committed"


def test_opposed_against_pairs(spark):
    import itertools

    whats = ["Moved to rest for the api", "Adopted rest for the api", "Dropped the queue for jobs", "Run the queue for jobs", "Cache pages", "No longer cache pages"]
    rows = [("p" if i < 5 else "q", i, i, w, toy([w])[0]) for i, w in enumerate(whats)] + [("q", 9, 9, "Cache pages again", toy(["Cache pages again"])[0])]
    df = spark.createDataFrame(rows, "project string, id long, seq long, what string, embedding array<double>")
    tokens = {r[1]: {x.token for x in postings(df.where(F.col("id") == r[1]), ["id"], ["what"]).collect()} for r in rows}
    cue = {r[1]: any(c in r[3].lower() for c in words.REPLACED) for r in rows}
    want = {}
    for a, b in itertools.product(rows, rows):
        if a[0] == b[0] and b[2] < a[2] and tokens[a[1]] & tokens[b[1]] and (cue[a[1]] or cue[b[1]]) and sum(x * y for x, y in zip(a[4], b[4], strict=True)) >= 0.9:
            want[a[1]] = min(want.get(a[1], b[1]), b[1])
    assert want and {r["id"]: r["other"] for r in guard.opposed(df, df, 0.9).collect()} == want


def test_positions_within_slices_of_time(spark):
    times = [NOW + timedelta(minutes=(i * i) % 97) for i in range(200)]
    df = spark.createDataFrame([("pq"[i % 2], i, t, 1.0) for i, t in enumerate(times)] + [("one", 900, NOW, 1.0), ("none", 901, None, 1.0)], "project string, id long, created_at timestamp, confidence double")
    got = {r["id"]: r["recency"] for r in rank.recency(df).collect()}
    for p in "pq":
        mine = sorted((t, i) for i, t in enumerate(times) if "pq"[i % 2] == p)
        assert [got[i] for _, i in mine] == pytest.approx([k / 99 * words.RECENCY_WEIGHT for k in range(100)])
    assert got[900] == got[901] == 0.0


def test_ranges_are_even_whatever_the_times(spark):
    """One record far before all others, and all at one time: no range holds twice the mean."""
    for n, name in ((1, "outlier"), (20000, "equal")):
        t = F.when(F.col("id") < n, F.lit(datetime(1970, 1, 1) if name == "outlier" else NOW)).otherwise(F.timestamp_micros(F.lit(1704067200000000) + F.col("id") % 5000))
        df = spark.range(20000).select(F.lit("hot").alias("project"), "id", t.alias("created_at"))
        got = rank.positions(df, "project", ["created_at", "id"])
        sizes = [r["count"] for r in got.groupBy("part").count().collect()]
        assert max(sizes) <= 2 * sum(sizes) / len(sizes) and len(sizes) > 4
        want = df.select("id", (F.row_number().over(Window.partitionBy("project").orderBy("created_at", "id")) - 1).alias("want"))
        assert got.join(want, "id").where("nth <> want or n <> 20000").isEmpty()


def test_distractors_are_all_different(spark):
    d = rank.distractors(spark, 5000)
    assert d.select("what", "why").distinct().count() == 5000 and d.select("id").distinct().count() == 5000
    assert d.orderBy("nth").first()["what"] == rank.distractors(spark, 3).orderBy("nth").first()["what"]
    with pytest.raises(ValueError, match="combinations"):
        rank.distractors(spark, 10**9)


def test_kept_postings_are_those_of_a_rebuild(spark, tmp_path):
    """After several appends, images that change no text, and one that does."""
    from mnemospark.operators import postings as kept_postings

    m = Memory(spark, str(tmp_path))
    asked = spark.createDataFrame([(t,) for t in ("queue", "job", "cache", "page", "rest", "api", "log")], "token string")
    cols = [c for c, _ in m.store.fields("decisions")]
    def put(rows, op="insert"):
        full = [(i, p, w, "because it works", "a", NOW, 1.0, None, None, None) for i, p, w in rows]
        m.store.append("decisions", spark.createDataFrame(full, ", ".join(" ".join(x) for x in m.store.fields("decisions"))).select(*cols), op, NOW)
    def same():
        m.kept.refresh()
        docs = m.store.current("decisions")
        want = kept_postings.build(docs).join(asked, "token").select("project", "id", "token", "in_what")
        assert sorted(map(tuple, m.kept.flags(docs, asked).select("project", "id", "token", "in_what").collect())) == sorted(map(tuple, want.collect()))
    put([("a", "p", "Use one queue for all jobs"), ("b", "p", "Serve the api by rest calls")])
    same()
    put([("c", "q", "Put a cache before slow pages")])
    put([("a", "p", "Use one queue for all jobs")], "reinforce")  # the same text again
    same()
    before = m.kept._read(m.kept._adds(m.store.version()), "texts", "id string, text_key long").count()
    assert before == 3
    put([("b", "p", "Keep a log of the api calls")], "edit")
    same()
    m.kept.fold()
    same()
    assert len(m.kept._adds(m.store.version())) == 1 and m.kept.refresh() >= 0


def test_bounds_lose_none_of_the_best(spark):
    d = SF
    docs, q = catalogue.decisions(spark, d).where("archived_at is null"), catalogue.asked(spark, d)
    whole = rank.ranked(rank.keyword_scores(docs, q, catalogue.as_of(), tail=None), 5).select("query_id", "project", "id", "pos")
    some = rank.ranked(rank.keyword_scores(docs, q, catalogue.as_of(), tail=None, k=5), 5).select("query_id", "project", "id", "pos")
    assert whole.exceptAll(some).isEmpty() and some.exceptAll(whole).isEmpty()


def test_commits_as_a_stream(spark, tmp_path):
    """A stream that dies after a batch was committed, and is started again, gives the tables of one pass."""
    import json

    from mnemospark.streaming.capture import capture_stream

    shape = "project string, at timestamp, sha string, message string, files string"
    messages = ["feat(api): switched to cursor pages instead of offsets\n\nOffsets were slow because deep pages rescan rows.", "chore: tidy imports in all the old modules",
                "perf: adopted arena allocation for parse trees\n\nFrees dominated the profile of the parser.", "feat: replaced polling with push for status pages\n\nPolling cost us a third of all requests."]
    for f in (0, 1):
        (tmp_path / "in").mkdir(exist_ok=True)
        lines = [json.dumps({"project": "p", "at": f"2024-05-0{2 * f + i + 1} 00:00:00", "sha": f"{f}{i}" * 10, "message": messages[2 * f + i], "files": "a.py, b.py"}) for i in (0, 1)]
        (tmp_path / "in" / f"{f}.json").write_text("\n".join(lines))
    source = lambda n: spark.readStream.schema(shape).option("maxFilesPerTrigger", n).json(f"{tmp_path}/in")
    whole, broken = Memory(spark, f"{tmp_path}/whole"), Memory(spark, f"{tmp_path}/broken")
    capture_stream(whole, source(9), "git", f"{tmp_path}/c1").awaitTermination()

    class Dies:
        """Takes the first batch and dies before the stream can note it."""

        def capture_batch(self, *a):
            assert broken.capture_batch(*a)
            raise OSError("killed")

    with pytest.raises(Exception, match="killed"):
        capture_stream(Dies(), source(1), "git", f"{tmp_path}/c2").awaitTermination()
    capture_stream(broken, source(1), "git", f"{tmp_path}/c2").awaitTermination()
    shown = lambda m: [sorted(map(tuple, m.store.current(t).select(*c).collect())) for t, c in (("decisions", ("what", "why", "confidence", "source")), ("snapshots", ("file_structure",)), ("audit_log", ("kind",)))]
    assert shown(whole) == shown(broken) and len(shown(whole)[0]) == 3
    skip = whole.audit_log("p").where("kind = 'extract_skipped'").first()["payload"]
    assert json.loads(skip) == {"sha": "010101010101", "reason": "type_gate", "subject": "chore: tidy imports in all the old modules"}
    assert whole.store.current("stream_ledger").count() == 1 and broken.store.current("stream_ledger").count() == 2


def test_git_sources(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q")
    for i, message in enumerate(["feat: use one queue\n\nbecause it is simple", "fix: second"]):
        (tmp_path / f"f{i}.txt").write_text("x")
        run("add", "-A")
        run("commit", "-qm", message)
    assert git.project(str(tmp_path)) == tmp_path.name and git.tree(str(tmp_path)) == "f0.txt, f1.txt"
    rows = git.log(spark, 5, str(tmp_path)).collect()
    assert [r["message"].split("\n")[0] for r in rows] == ["fix: second", "feat: use one queue"]
    assert git.message(rows[0]["sha"], str(tmp_path)).strip() == "fix: second"
    (tmp_path / "log.txt").write_text(git.run(["log", f"--format={git.FORMAT}"], str(tmp_path)))
    framed = git.framed(spark, str(tmp_path / "log.txt")).collect()
    assert [(r["sha"], r["message"].strip()) for r in framed] == [(r["sha"], r["message"].strip()) for r in rows]
    assert git.tree("/") == "(empty tree)"


def labelled(tmp_path):
    import json

    whats = ["Use one queue for all jobs", "Serve the api by rest calls", "Cache pages before the api", "Keep logs of jobs", "Sign tokens with a key"]
    data = {"seed": 1, "decisions": [{"id": f"d{i}", "what": w, "why": "it works for jobs" if i % 2 else "simple", "domain": "x"} for i, w in enumerate(whats)],
            "queries": [{"query": t, "expected_id": e, "category": c} for t, e, c in (("which queue runs jobs", "d0", "exact"), ("api calls", "d1", "exact"), ("jobs", "d3", "vague"), ("nothing shared zebra", "d4", "vague"), ("the of and", "d2", "vague"), ("api pages", "d2", "exact"))]}
    path = tmp_path / "set.json"
    path.write_text(json.dumps(data, indent=1))
    return str(path), data


def test_evaluation_of_a_labelled_set(spark, tmp_path):
    from math import log

    from mnemospark.sources.labelled import json_lines, labelled_set, write_json

    path, data = labelled(tmp_path)
    docs, queries = labelled_set(spark, path)
    token = lambda texts: [{r.token for r in postings(spark.createDataFrame([(t,)], "t string").withColumn("i", F.lit(1)), ["i"], ["t"]).collect()} for t in texts]
    sets, asked = token([f"{d['what']}. {d['why']}" for d in data["decisions"]]), token([q["query"] for q in data["queries"]])
    idf = lambda t: log((len(sets) + 1) / (sum(t in s for s in sets) + 1)) + 1 if any(t in s for s in sets) else 1.0
    want = {}
    for i, (q, a) in enumerate(zip(data["queries"], asked, strict=True)):
        total = sum(map(idf, a))
        score = [round(sum(map(idf, a & s)) / total, 9) if total else 0.0 for s in sets]
        order = sorted(range(len(sets)), key=lambda j: (-score[j], j))
        want[i] = order.index(int(q["expected_id"][1:])) + 1
    places = rank.evaluate(docs, queries)
    assert {r.query_id: r.pos for r in places.collect()} == want
    all_of = rank.summary(places).first()
    assert all_of["n"] == 6 and all_of["recall_1"] == pytest.approx(sum(p == 1 for p in want.values()) / 6) and all_of["mrr"] == pytest.approx(sum(1 / p for p in want.values()) / 6)
    assert {r["category"]: r["n"] for r in rank.summary(places, ["category"]).collect()} == {"exact": 3, "vague": 3}
    assert [r.query_id for r in rank.misses(places).collect()] == [i for i, p in sorted(want.items(), key=lambda x: (-x[1], x[0])) if p > 1]
    more = docs.select("id", "nth", "what", "why").unionByName(rank.distractors(spark, 50).withColumn("nth", F.col("nth") + 4))
    assert rank.summary(rank.evaluate(more, queries)).first()["n"] == 6
    write_json(docs, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 5 and '"nth":0' in json_lines(docs).first()["value"]


def test_latencies(spark):
    r = rank.latencies(spark.createDataFrame([(float(x),) for x in range(1, 101)], "ms double")).first()
    assert (r["n"], r["p50"], r["p95"]) == (100, 50.0, 95.0)


def test_routing_with_vectors(spark, tmp_path):
    plain, dense = Memory(spark, f"{tmp_path}/a"), Memory(spark, f"{tmp_path}/b", embed=toy, model="toy")
    for m in (plain, dense):
        m.write("decision", "p", {"what": "Serve the api by rest calls only", "why": "simple", "agent": "ann"}, NOW)
        m.write("decision", "p", {"what": "Put a cache before slow pages", "why": "speed", "agent": "bob"}, NOW)
    best, proof = plain.route("p", "api calls", NOW)
    assert [r["agent"] for r in best.collect()] == ["ann"] and proof.first()["relevance"] <= 1
    best, _ = dense.route("p", "api calls", NOW)
    assert [r["agent"] for r in best.orderBy("pos").collect()] == ["ann", "bob"]


def test_previews_and_ids(spark, tmp_path):
    m = Memory(spark, str(tmp_path))
    m.write("decision", "p", {"what": "too short", "why": "x"}, NOW)
    m.write("dead_end", "p", {"what_tried": "also short", "why_failed": "x"}, NOW)
    rows = m.preview("p").collect()
    assert sorted(r["preview"] for r in rows) == ["(no preview)", "too short"] and all(len(r["short_id"]) == 8 for r in rows)
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert records.same_ids(ids, ids.orderBy(F.desc("id"))) and not records.same_ids(ids, ids.union(ids))
    assert records.cascade(spark.createDataFrame([("a", 1), ("z", 2)], "id string, n int"), ids).count() == 1


def test_every_white_space_separates(spark):
    df = spark.createDataFrame([(1, "one\u00a0two\u2003three\x1cfour\x85five\u200bsix")], "id int, t string")
    assert {r["token"] for r in postings(df, ["id"], ["t"]).collect()} == {"one", "two", "three", "four", "five\u200bsix"}
