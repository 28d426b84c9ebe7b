"""The commit log: order, whole appends, refused commits, stores of older layouts; batches against single writes."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemospark.operators.memory import Memory
from mnemospark.sources.store import SCHEMAS, Conflict, Store, Unit, unit

NOW = datetime(2024, 6, 1)
BATCH = "project string, seq long, kind string, data map<string,string>"


def events(spark, ids, project="p"):
    return spark.createDataFrame([(i, project, "k", "{}", NOW) for i in ids], SCHEMAS["audit_log"])


def test_handles_in_turn_share_no_number(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.create()
    b.create()
    for n, s in enumerate((a, b, a, b)):
        s.append("audit_log", events(spark, [f"e{n}{i}" for i in range(3)]), "insert", NOW)
    for s in (a, b):
        rows = s.log("audit_log").orderBy("seq").collect()
        assert len({r["seq"] for r in rows}) == 12 and [r["id"] for r in rows] == [f"e{n}{i}" for n in range(4) for i in range(3)]
    # the image that was appended last counts, whoever appended it
    image = lambda s, what: s.append("decisions", spark.createDataFrame([("d", "p", what)], "id string, project string, what string").select("id", "project", "what", *[F.lit(None).cast(t).alias(c) for c, t in s.fields("decisions")[3:]]), "insert", NOW)
    image(a, "one"), image(b, "two"), image(a, "three")
    assert [s.current("decisions").first()["what"] for s in (a, b)] == ["three", "three"]


def test_no_reader_sees_half_an_append(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.create()
    one, two = a.stage("audit_log", events(spark, "xy"), NOW, "insert"), a.stage("staging_history", spark.createDataFrame([("h", "p", "t", "c", "o", NOW)], SCHEMAS["staging_history"]), NOW, "insert")
    assert b.log("audit_log").isEmpty() and b.log("staging_history").isEmpty()
    before = b.version()
    a.commit([one, two])
    assert (b.log("audit_log").count(), b.log("staging_history").count()) == (2, 1)
    assert b.log("audit_log", version=before).isEmpty()
    assert a.stage("audit_log", events(spark, []), NOW, "insert") is None


def test_what_was_read_and_has_changed_is_decided_anew(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.create()
    seen = []

    def work(u: Unit):
        seen.append(u.current("audit_log", "p").count())
        if len(seen) == 1:
            b.append("audit_log", events(spark, ["other"]), "insert", NOW)  # another writer comes first
        u.put("audit_log", "insert", id=f"mine{len(seen)}", project="p", kind="k", payload="{}", created_at=NOW)
        return len(seen)

    assert unit(a, NOW, [("audit_log", "p")], work) == 2 and seen == [0, 1]
    assert {r["id"] for r in b.log("audit_log").collect()} == {"other", "mine2"}
    # another project, and a unit that read nothing, are not in the way
    seen.clear()
    assert unit(a, NOW, [("audit_log", "q")], lambda u: (b.append("staging_history", spark.createDataFrame([("h", "q", "t", "c", "o", NOW)], SCHEMAS["staging_history"]), "insert", NOW), u.put("audit_log", "insert", project="q", created_at=NOW))[1])
    with pytest.raises(Conflict):
        unit(a, NOW, [("audit_log", None)], lambda u: (b.append("audit_log", events(spark, ["again"]), "insert", NOW), u.put("audit_log", "insert", project="p", created_at=NOW)), tries=2)


def test_writers_at_once(spark, tmp_path):
    stores = [Store(spark, str(tmp_path)) for _ in range(4)]
    stores[0].create()
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda x: [x[1].append("audit_log", events(spark, [f"{x[0]}-{i}-{j}" for j in range(2)]), "insert", NOW) for i in range(3)], enumerate(stores)))
    rows = stores[0].log("audit_log").collect()
    assert len(rows) == len({r["seq"] for r in rows}) == len({r["id"] for r in rows}) == 24
    assert stores[1].version() == 12


def test_claims(spark, tmp_path):
    files = Store(spark, str(tmp_path)).files
    assert files.claim(f"{tmp_path}/x", "one") and not files.claim(f"{tmp_path}/x", "two")
    assert files.read(f"{tmp_path}/x") == "one" and files.names(str(tmp_path)) == ["x"]


def test_a_store_without_a_log_and_with_fewer_columns(spark, tmp_path):
    """Such as the library wrote at first: a folder a table, numbers in the files; some columns came later."""
    old = spark.createDataFrame([("d1", "p", "Use one queue for all jobs", "simple", "ann", NOW, 1.0, 1, "insert", NOW), ("d2", "7", "Serve the api by rest calls", "x", "bob", NOW, 0.5, 2, "insert", NOW), ("d1", "p", "Use two queues for all jobs", "simple", "ann", NOW, 1.0, 3, "reinforce", NOW)],
                                "id string, project string, what string, why string, agent string, created_at timestamp, confidence double, seq long, op string, at timestamp")
    old.write.partitionBy("project").parquet(f"{tmp_path}/decisions")
    m = Memory(spark, str(tmp_path))
    rows = {r["id"]: r for r in m.store.current("decisions").collect()}
    assert rows["d1"]["what"] == "Use two queues for all jobs" and rows["d2"]["project"] == "7" and rows["d1"]["source"] is None and rows["d1"]["archived_at"] is None
    assert m.archive("d1", NOW)["status"] == "archive"
    again = Store(spark, str(tmp_path))
    assert {r["id"]: r["archived_at"] for r in again.current("decisions").collect()} == {"d1": NOW, "d2": None}
    assert m.write("decision", "p", {"what": "use two QUEUES for all jobs", "why": "x"}, NOW)["reason"].startswith("Exact duplicate")
    again.files.claim(f"{tmp_path}/_log/{again.version() + 1:020d}.json", '{"format": 99, "adds": [], "drops": []}')
    with pytest.raises(RuntimeError, match="format 99"):
        again.version()


def test_compaction(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.create()
    for i in range(3):
        a.append("audit_log", events(spark, [f"e{i}", "same"], f"p{i % 2}" if i else "p0"), "insert", NOW + timedelta(i))
    a.append("audit_log", events(spark, ["e0"], "p0"), "delete", NOW)
    want = sorted((r["id"], r["seq"]) for r in a.current("audit_log").collect())
    before = b.version()
    a.compact("audit_log")
    b.append("audit_log", events(spark, ["later"], "p0"), "insert", NOW)
    for s in (a, b):
        assert sorted((r["id"], r["seq"]) for r in s.current("audit_log").where("id <> 'later'").collect()) == want
        assert s.current("audit_log").agg(F.max_by("id", "seq")).first()[0] == "later"
        assert len([x for x in s.live[s.version()] if x["table"] == "audit_log"]) == 2
    assert b.log("audit_log", version=before).count() == 7
    # two handles that fold the same appends: the second finds them folded
    live = len(a.live[a.version()])
    with pytest.raises(Conflict):
        b.commit([{"table": "audit_log", "append": "x", "format": 2, "projects": None, "compacted": True}], before, drops=[x["append"] for x in b.live[before] if x["table"] == "audit_log"])
    assert len(a.live[a.version()]) == live
    # what is new alone, with a deletion of what was folded before
    a.append("audit_log", events(spark, ["e1"], "p1"), "delete", NOW)
    now = sorted((r["id"], r["seq"]) for r in b.current("audit_log").collect())
    a.compact("audit_log", whole=False)
    assert sorted((r["id"], r["seq"]) for r in b.current("audit_log").collect()) == now and "e1" not in dict(now)
    assert [x.get("compacted") for x in b.live[b.version()] if x["table"] == "audit_log"] == [True, True]


def test_many_appends_are_folded_on_the_way(spark, tmp_path, monkeypatch):
    from mnemospark.sources import store

    monkeypatch.setattr(store, "APPENDS", 4)
    monkeypatch.setattr(store, "FOLDED", 2)
    m = Memory(spark, str(tmp_path))
    for i in range(9):
        m.audit("p", f"k{i}", NOW)
    assert [r["kind"] for r in m.audit_log("p").orderBy("id").collect()] == [f"k{i}" for i in range(9)]
    assert len([x for x in m.store.live[m.store.version()] if x["table"] == "audit_log"]) <= 4


def test_a_batch_is_its_records_one_by_one(spark, tmp_path):
    one, many = Memory(spark, f"{tmp_path}/one"), Memory(spark, f"{tmp_path}/many")
    held = {"what": "Keep the old index for slow reads", "why": "x"}
    old = [m.write("decision", "p", held, NOW)["id"] for m in (one, many)]
    ref = lambda n: ("batch", n)  # noqa: E731  a record of the batch
    data = [
        ("decision", {"what": "\tUse one queue for all jobs\n", "why": " simple ", "confidence": "3", "agent": ""}),
        ("decision", {"what": "Serve the api by rest calls only", "why": "tools", "supersedes_id": "old"}),
        ("dead_end", {"what_tried": "Tried a shared json file for records", "why_failed": "races", "chosen_decision_id": ref(1)}),
        ("decision", {"what": "Put a cache before slow pages now", "why": "speed", "supersedes_id": "nope"}),
        ("decision", {"what": "Put a cache before slow pages now", "why": "speed", "supersedes_id": ref(2), "agent": "ann"}),
        ("decision", {"what": "use one queue for all JOBS", "why": "x", "supersedes_id": "  "}),
        ("dead_end", {"what_tried": "Tried to write the cache to disk first", "why_failed": "slow", "chosen_decision_id": ref(6)}),
        ("open_task", {"description": "Move the old jobs to the queue"}),
    ]
    ids = {}
    for i, (kind, d) in enumerate(data, 1):
        d = {k: (ids.get(v[1]) or "not there" if isinstance(v, tuple) else old[0] if v == "old" else v) for k, v in d.items()}
        out = one.write(kind, "p", d, NOW)
        ids[i] = out["id"] if out["status"] == "committed" else None
        data[i - 1] += (out["status"], out["reason"].replace(old[0], "").replace("not there", ""))
    rows = [("p", i, kind, {k: (Memory.batch_id("b", "p", v[1]) if isinstance(v, tuple) else old[1] if v == "old" else v) for k, v in d.items()}) for i, (kind, d, *_) in enumerate(data, 1)]
    got = {r["seq"]: r for r in many.write_batch(spark.createDataFrame(rows, BATCH), NOW, batch="b").collect()}
    assert {i: got[i]["status"] for i in got} == {i: d[2] for i, d in enumerate(data, 1)}
    assert [d[2] for d in data] == ["committed", "committed", "committed", "rejected", "committed", "staged", "rejected", "committed"]
    assert [got[i]["reason"].split("'")[0] for i in sorted(got)] == [d[3].split("'")[0] for d in data]
    assert got[1]["id"] == Memory.batch_id("b", "p", 1) and got[4]["id"] is None
    shown = lambda m: sorted((r["what"], r["why"], r["agent"], r["confidence"], r["archived_at"], r["supersedes_id"] is not None) for r in m.store.current("decisions").collect())
    assert shown(one) == shown(many) and sum(r[4] is not None for r in shown(many)) == 2
    for table in ("dead_ends", "open_tasks", "staging"):
        assert one.store.current(table).count() == many.store.current(table).count()
    kinds = lambda m: sorted((r["kind"], r["n"]) for r in m.store.current("audit_log").groupBy("kind").agg(F.count("*").alias("n")).collect())
    assert kinds(one) == kinds(many)


def toy(texts):
    out = []
    for t in texts:
        v = [1.0 + t.lower().count(w) for w in ("rest", "grpc", "api", "queue", "log", "cache")]
        n = sum(x * x for x in v) ** 0.5
        out.append([x / n for x in v])
    return out


def test_batches_are_checked_by_meaning(spark, tmp_path):
    m = Memory(spark, str(tmp_path), embed=toy, model="toy")
    rows = [("p", 1, "decision", {"what": "Adopted rest for the public api", "why": "simple"}), ("p", 2, "decision", {"what": "Moved to rest grpc for this public api now", "why": "speed"}), ("p", 3, "decision", {"what": "Wrote the public queue cache log page", "why": "speed"})]
    got = {r["seq"]: r["reason"] for r in m.write_batch(spark.createDataFrame(rows, BATCH), NOW).collect()}
    assert got[1] == got[3] == "ok" and got[2] == "Contradicts existing decision: 'Adopted rest for the public api'"


def test_a_provider_that_fails_is_gone_on_without(spark, tmp_path):
    def broken(texts):
        raise OSError("no model")

    m = Memory(spark, str(tmp_path), embed=broken)
    assert m.write("decision", "p", {"what": "Use one queue for all jobs", "why": "simple"}, NOW)["status"] == "committed"
    assert [r["what"] for r in m.warm("p", "queue", NOW).collect()] == ["Use one queue for all jobs"]
    assert isinstance(m.embed_error, OSError)


def test_vectors_from_blobs(spark, tmp_path):
    import struct

    m = Memory(spark, str(tmp_path), embed=toy, model="old")
    vectors = {"a": [1.0, -2.5, 0.1, 0.0], "b": [3.4028234663852886e38, 1e-45, -0.0, 1.17549435e-38], "c": []}
    rows = [(i, "p", "old", len(v), struct.pack(f"<{len(v)}f", *v)) for i, v in vectors.items()]
    df = spark.createDataFrame(rows, "id string, project string, model string, dim int, blob binary")
    assert m.import_vectors(df, NOW) == 3
    want = {i: list(struct.unpack(f"<{len(v)}f", struct.pack(f"<{len(v)}f", *v))) for i, v in vectors.items()}
    assert {r["id"]: r["vector"] for r in m.store.current("decision_embeddings").collect()} == want
    with pytest.raises(ValueError, match="length"):
        m.import_vectors(df.withColumn("dim", F.lit(9)), NOW)
