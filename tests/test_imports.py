"""Tables of a relational store, as a database holds them, taken over whole, twice, and by layouts without the later columns."""

import sqlite3
import struct
from datetime import datetime, timedelta

import pytest

from mnemospark.operators import records
from mnemospark.operators.memory import Memory

NOW = datetime(2024, 6, 1)
KINDS = {"decisions": "id string, project string, what string, why string, agent string, created_at string, confidence double, supersedes_id string, archived_at string, source string",
         "dead_ends": "id string, project string, what_tried string, why_failed string, chosen_decision_id string, agent string, created_at string, confidence double",
         "audit_log": "id long, project string, kind string, payload string, created_at string",
         "guard_policy": "project string, category string, action string, sample_size long, accept_rate double, updated_at string",
         "decision_embeddings": "decision_id string, model string, dim int, vector binary, created_at string"}


def database():
    con = sqlite3.connect(":memory:")
    con.execute("create table decisions (id text, project text, what text, why text, agent text, created_at text, confidence real, supersedes_id text, archived_at text, source text)")
    con.execute("create table dead_ends (id text, project text, what_tried text, why_failed text, chosen_decision_id text, agent text, created_at text, confidence real)")
    con.execute("create table audit_log (id integer primary key, project text, kind text, payload text, created_at text)")
    con.execute("create table guard_policy (project text, category text, action text, sample_size integer, accept_rate real, updated_at text)")
    con.execute("create table decision_embeddings (decision_id text, model text, dim integer, vector blob, created_at text)")
    rows = [("d1", "p", "Use Redis over Memcached for the session cache", "persistence", "a", "2024-01-01T10:00:00+00:00", 1.0, None, "2024-02-01T00:00:00.250000+00:00", None),
            ("d2", "p", "Use Postgres over Redis for the session cache", "one store", "b", "2024-02-01T00:00:00.250000+00:00", 0.8, "d1", None, "agent"),
            ("d3", "q", "Ship nightly builds from the main branch", "speed", None, "no time", None, None, None, None)]
    con.executemany("insert into decisions values (?,?,?,?,?,?,?,?,?,?)", rows)
    con.execute("insert into dead_ends values ('e1','p','Files on disk for sessions','locks','d2','a','2024-01-15T00:00:00+02:00',1.0)")
    con.executemany("insert into audit_log values (?,?,?,?,?)", [(i, "p", "query", "{}", "2024-03-01T00:00:00+00:00") for i in (10, 9, 100)])
    con.execute("insert into guard_policy values ('p','vague','auto_reject',12,0.05,'2024-03-01T00:00:00+00:00')")
    con.execute("insert into decision_embeddings values ('d2','m',3,?,'2024-03-01T00:00:00+00:00')", (struct.pack("<3f", 0.5, -1, 2),))
    return con


def frames(spark, con, names=KINDS):
    return {n: spark.createDataFrame([tuple(r) for r in con.execute(f"select * from {n}")], KINDS[n]) for n in names}


def test_taken_over_whole_and_once(spark, tmp_path):
    m, con = Memory(spark, str(tmp_path)), database()
    before = m.store.version()
    assert m.import_tables(frames(spark, con), NOW) == {"decisions": 3, "dead_ends": 1, "audit_log": 3, "guard_policy": 1, "decision_embeddings": 1}
    assert m.store.version() == before + 1
    got = {r["id"]: r.asDict() for r in m.store.current("decisions").collect()}
    assert got["d1"]["created_at"] == datetime(2024, 1, 1, 10) and got["d1"]["archived_at"] == datetime(2024, 2, 1, 0, 0, 0, 250000)
    assert got["d2"]["archived_at"] is None and got["d2"]["supersedes_id"] == "d1" and got["d3"]["created_at"] == datetime(1970, 1, 1)
    assert m.store.current("dead_ends").first()["created_at"] == datetime(2024, 1, 14, 22)
    assert [r["id"] for r in m.store.current("audit_log").orderBy("seq").collect()] == ["9", "10", "100"]
    assert m.policy_action("p", "vague") == "auto_reject"
    v = m.store.current("decision_embeddings").first()
    assert (v["project"], v["vector"]) == ("p", [0.5, -1.0, 2.0])
    # the calls work on what was imported
    assert m.provenance("d2")["id"] == "d2" and [r["id"] for r in m.read("p", "session cache", NOW, audit=False)["warm"].collect()] == ["d2"]
    assert m.write("decision", "p", {"what": "use postgres over redis for the session cache", "why": "x"}, NOW)["status"] == "staged"
    # once more, after a change here and with a row more there
    m.archive("d2", NOW)
    con.execute("insert into decisions values ('d4','p','Cache pages at the edge for a day','cost','a','2024-05-01T00:00:00+00:00',1.0,null,null,null)")
    assert m.import_tables(frames(spark, con, ("decisions", "audit_log")), NOW + timedelta(1)) == {"decisions": 1, "audit_log": 0}
    assert m.store.current("decisions").where("id = 'd2'").first()["archived_at"] == NOW


def test_older_layouts_and_refusals(spark, tmp_path):
    m = Memory(spark, str(tmp_path))
    old = spark.createDataFrame([("d", "p", "Use tabs over spaces in all files", None, "a", "2024-01-01T00:00:00")], "id string, project string, what string, why string, agent string, created_at string")
    assert m.import_tables({"decisions": old}, NOW) == {"decisions": 1}
    row = m.store.current("decisions").first()
    assert row["confidence"] is None and row["source"] is None and row["archived_at"] is None
    at = m.store.version()
    for tables in ({"decisions": old.selectExpr("cast(null as string) id", "project", "what", "created_at")}, {"nothing": old}):
        with pytest.raises(ValueError):
            m.import_tables(tables, NOW)
    blob = spark.createDataFrame([("d", "m", 3, b"1234", "2024-01-01T00:00:00")], KINDS["decision_embeddings"])
    lost = spark.createDataFrame([("none", "m", 1, b"1234", "2024-01-01T00:00:00")], KINDS["decision_embeddings"])
    for vectors in (blob, lost):
        with pytest.raises(ValueError, match="decision_embeddings"):
            m.import_tables({"decision_embeddings": vectors}, NOW)
    assert m.store.version() == at and m.import_tables({"decisions": old.limit(0)}, NOW) == {"decisions": 0}


def test_prefixes(spark):
    """None, the one, or not unique, as one prefix at a time would give; odd prefixes and empty tables too."""
    ids = ["abc", "abd", "b", "", None, "é😀x", "abc1"]
    asked = ["", "a", "ab", "abc", "abd", "b", "bb", "é😀", None, "a", "x" * 50]
    df, want = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(p,) for p in asked], "prefix string")
    got = {r["prefix"]: (r["found"], r["id"]) for r in records.resolved(df, want).collect()}
    brute = {p: [i for i in ids if i is not None and i.startswith(p)] for p in asked if p is not None}
    assert got == {p: (len(f), f[0] if len(f) == 1 else None) for p, f in brute.items()}
    assert records.resolved(df, want.limit(0)).count() == 0 and all(r["found"] == 0 for r in records.resolved(df.limit(0), want).collect())
