"""The engine's calls on single records and projects: each reads current views, runs one of the plans, and appends.

Time is given with every call. With an embedding provider, a function from a list of texts to a list of vectors of length
one, reads are improved by dense ranks and decisions are checked for contradictions in meaning; without one, neither is.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, words
from ..functions.text import category, cost, postings
from ..sources import imports
from ..sources.store import Store, Unit, unit
from ..steps import Steps
from . import extract, guard, rank, records
from .postings import Kept

BATCH = "project string, seq long, kind string, data map<string,string>"
#: Fields that are stored without white space around them.
STRIPPED = {"what", "why", "description", "what_tried", "why_failed", "supersedes_id", "chosen_decision_id"}
#: Those that name a decision; of blanks alone they name none.
LINKS = {"supersedes_id", "chosen_decision_id"}
TABLES = {"decision": "decisions", "snapshot": "snapshots", "open_task": "open_tasks", "dead_end": "dead_ends"}


class Memory:
    def __init__(self, spark: SparkSession, root: str, embed: Callable[[list[str]], list[list[float]]] | None = None, model: str = "given"):
        self.spark, self.store, self.embed, self.model = spark, Store(spark, root), embed, model
        #: What the provider failed with last; calls then go on without vectors.
        self.embed_error: Exception | None = None
        self.store.create()
        self.kept = Kept(self.store)

    # writes
    def _unit(self, as_of: datetime, reads: list[tuple[str, str | None]], work: Callable[[Unit], Any]) -> Any:
        """One commit of what a call decides; decided again where a table that it read has changed before it could commit."""
        out = unit(self.store, as_of, reads, work)
        self.store.tidy()
        return out

    def _get(self, name: str, id_: str, u: Unit | None = None) -> dict | None:
        found = (u or self.store).current(name).where(F.col("id") == id_).limit(1).collect()
        return {k: v for k, v in found[0].asDict(True).items() if k not in ("seq", "op", "at")} if found else None

    @staticmethod
    def _event(u: Unit, project: str, kind: str, as_of: datetime, **payload) -> None:
        u.put("audit_log", "insert", project=project, kind=kind, payload=json.dumps(payload), created_at=as_of)

    def audit(self, project: str, kind: str, as_of: datetime, **payload) -> None:
        self._unit(as_of, [], lambda u: self._event(u, project, kind, as_of, **payload))

    @staticmethod
    def _existing(u: Unit, project: str | None = None, vectors: DataFrame | None = None) -> DataFrame:
        """What checks look at: all decisions, archived ones too, open tasks and dead ends."""
        parts = []
        for kind, where in (("decision", "true"), ("open_task", "status = 'open'"), ("dead_end", "true")):
            f = guard.MAIN[kind]
            rows = u.current(TABLES[kind], project).where(where)
            if vectors is not None:
                rows = rows.join(vectors.select("id", "embedding"), "id", "left") if kind == "decision" else rows.withColumn("embedding", F.lit(None).cast("array<double>"))
            parts.append(rows.select("project", "seq", F.lit(kind).alias("kind"), F.create_map(F.lit(f), F.col(f)).alias("data"), *(["embedding"] if vectors is not None else [])))
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def write(self, kind: str, project: str, data: dict, as_of: datetime, source: str | None = None) -> dict:
        """status committed, staged, auto_rejected or rejected, with id and reason; all that it leads to is one commit."""
        reads = [(t, project) for t in ("decisions", "open_tasks", "dead_ends")]
        return self._unit(as_of, reads, lambda u: self._write(u, kind, project, data, as_of, source))

    def _write(self, u: Unit, kind: str, project: str, data: dict, as_of: datetime, source: str | None) -> dict:
        text = {k: v for k, v in data.items() if v is None or isinstance(v, str)}
        link = next((x.strip() for x in (text.get("supersedes_id"), text.get("chosen_decision_id")) if x and x.strip()), None)
        linked = None if link is None else self._get("decisions", link, u) is not None
        new = self.spark.createDataFrame([(project, 1, kind, text)], BATCH)
        vectors = self.vectors(u.current("decisions", project), as_of) if self.embed and kind == "decision" else None
        asked = self._query_vector(project, text.get("what") or "") if vectors is not None else None
        if asked is not None:
            new = new.join(asked.select("project", "embedding"), "project")
        else:
            vectors = None
        known = guard.prepared(new).withColumn("linked", F.lit(linked).cast("boolean"))
        judged = guard.judge(known, guard.held_texts(self._existing(u, project, vectors)), one=text.get(guard.MAIN.get(kind, "")) or "")
        status, reason, cat = judged.select("status", "reason", category(F.col("reason"))).first()
        if status == "rejected":
            self._event(u, project, "write_rejected", as_of, type=kind, reason=reason)
            return {"status": status, "id": None, "reason": reason}
        if status == "staged":
            if self.policy_action(project, cat) == "auto_reject":
                self._event(u, project, "write_auto_rejected", as_of, type=kind, category=cat, reason=reason)
                return {"status": "auto_rejected", "id": None, "reason": reason}
            id_ = u.put("staging", "insert", type=kind, project=project, data=json.dumps(data), reason=reason, created_at=as_of, source=source)
            self._event(u, project, "write_staged", as_of, type=kind, category=cat, reason=reason, source=source)
            return {"status": "staged", "id": id_, "reason": reason}
        id_ = self._insert(u, kind, project, data, as_of, source)
        self._event(u, project, "write_commit", as_of, type=kind, id=id_)
        return {"status": "committed", "id": id_, "reason": "ok"}

    def _insert(self, u: Unit, kind, project, data, as_of, source, confidence=None, agent="unknown"):
        row = {k: (v.strip() or (None if k in LINKS else "")) if k in STRIPPED and isinstance(v, str) else v for k, v in data.items() if k != "id"} | {"project": project, "created_at": as_of}
        if kind in ("decision", "dead_end"):
            c = data.get("confidence") if confidence is None else confidence
            row |= {"confidence": min(1.0, max(0.0, 1.0 if c is None else float(c))), "agent": data.get("agent") or agent}
        if kind == "decision":
            row["source"] = source
            if row.get("supersedes_id") and (old := self._get("decisions", row["supersedes_id"], u)) and old["archived_at"] is None:
                u.put("decisions", "archive", **old | {"archived_at": as_of})
        if kind == "open_task":
            row["status"] = "open"
        return u.put(TABLES[kind], "insert", **row)

    @staticmethod
    def batch_id(batch: str, project: str, seq: int) -> str:
        """The id that a record of a batch gets, so that later ones of its project may name it."""
        h = hashlib.md5(f"{batch}/{project}/{seq}".encode()).hexdigest()
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))

    @staticmethod
    def _named(steps: Steps, rows: DataFrame, batch: str) -> DataFrame:
        """Records with the ids that batch_id() gives, written down."""
        made = F.md5(F.concat_ws("/", F.lit(batch), "project", F.col("seq").cast("string")).cast("binary"))
        made = F.regexp_replace(made, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        return steps.keep(rows.select("project", F.col("seq").cast("long").alias("seq"), "kind", "data", made.alias("id")))

    def write_batch(self, rows: DataFrame, as_of: datetime, source: str | None = None, batch: str | None = None) -> DataFrame:
        """What write() would do with the records (project, seq, kind, data) of each project one after another, in one commit.

        Returns project, seq, status, reason, and the id of what is committed or staged: batch_id() of the batch's name, made
        on the executors. A link may name a decision that there is, or one that the batch has accepted before in its project.
        Tables are read once for all projects; no record passes through the driver. project and seq tell records apart.
        """
        steps = Steps(self.spark)
        fixed = self._named(steps, rows, batch or uuid.uuid4().hex)
        reads = [(t, None) for t in ("decisions", "open_tasks", "dead_ends")]
        return self._unit(as_of, reads, lambda u: self._write_batch(u, steps, fixed, as_of, source))

    def _write_batch(self, u: Unit, steps: Steps, fixed: DataFrame, as_of: datetime, source: str | None) -> DataFrame:
        touched = fixed.select("project").distinct()
        vectors, new = None, fixed
        if self.embed:
            old = u.current("decisions").join(touched, "project", "left_semi")
            vectors, fresh = self.vectors(old, as_of), self._embedded(steps, fixed.where("kind = 'decision'").select("project", "id", F.coalesce(F.col("data")["what"], F.lit("")).alias("text")))
            vectors = vectors if fresh is not None else None
            new = fixed.join(fresh.select("id", F.col("vector").cast("array<double>").alias("embedding")), "id", "left") if vectors is not None else fixed
        held = self._existing(u, vectors=vectors).join(touched, "project", "left_semi")
        judged = guard.fold(new, held, u.current("guard_policy").select("project", "category", "action"), u.current("decisions").select("id"))
        named = steps.keep(fixed.join(judged, ["project", "seq"]))
        at, data = F.lit(as_of).cast("timestamp"), F.col("data")
        where = {}
        for kind, table in TABLES.items():
            mine = named.where((F.col("status") == "committed") & (F.col("kind") == kind))
            value = lambda f: F.nullif(guard.stripped(data[f]), F.lit("")) if f in LINKS else guard.stripped(data[f]) if f in STRIPPED else data[f]
            made = {"id": F.col("id"), "project": F.col("project"), "created_at": at, "source": F.lit(source), "status": F.lit("open"), "closed_at": F.lit(None), "archived_at": F.lit(None),
                    "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(data["confidence"].try_cast("double"), F.lit(1.0)))),
                    "agent": F.coalesce(F.nullif(data["agent"], F.lit("")), F.lit("unknown"))}
            where[kind] = mine.select(*[(made[c] if c in made else value(c)).cast(t).alias(c) for c, t in self.store.fields(table)], F.lit("insert").alias("op"), (F.col("seq") * 2).alias("nth"))
        # what is superseded, of the store or of the batch, is archived just before what supersedes it comes in
        made = steps.keep(where["decision"])
        later = made.where("supersedes_id is not null").groupBy(F.col("supersedes_id").alias("id")).agg((F.min("nth") - 1).alias("nth"))
        live = u.current("decisions").where("archived_at is null").select(*[c for c, _ in self.store.fields("decisions")]).unionByName(made.drop("op", "nth"))
        gone = live.join(later, "id").withColumn("archived_at", at).withColumn("op", F.lit("archive"))
        where["decision"] = made.unionByName(gone.select(*made.columns))
        for kind, table in TABLES.items():
            u.frame(table, where[kind])
        u.frame("staging", named.where("status = 'staged'").select("id", F.col("kind").alias("type"), "project", F.to_json("data").alias("data"), "reason", at.alias("created_at"), F.lit(source).alias("source"), F.lit("insert").alias("op"), F.col("seq").alias("nth")))
        kinds = F.create_map(*[F.lit(x) for p in (("committed", "write_commit"), ("staged", "write_staged"), ("auto_rejected", "write_auto_rejected"), ("rejected", "write_rejected")) for x in p])
        told = F.struct(F.col("kind").alias("type"), F.when(F.col("status") == "committed", F.col("id")).alias("id"), F.when(F.col("status").isin("staged", "auto_rejected"), category(F.col("reason"))).alias("category"),
                        F.when(F.col("status") != "committed", F.col("reason")).alias("reason"), F.when(F.col("status") == "staged", F.lit(source)).alias("source"))
        self._events(u, named.select("project", kinds[F.col("status")].alias("kind"), F.to_json(told).alias("payload"), F.col("seq").alias("nth")), as_of)
        return named.select("project", "seq", "status", "reason", F.when(F.col("status").isin("committed", "staged"), F.col("id")).alias("id"))

    @staticmethod
    def _events(u: Unit, events: DataFrame, as_of: datetime) -> None:
        """Audit events (project, kind, payload, nth) in one append."""
        u.frame("audit_log", events.select(F.expr("uuid()").alias("id"), "project", "kind", "payload", F.lit(as_of).cast("timestamp").alias("created_at"), F.lit("insert").alias("op"), "nth"))

    def close_task(self, id_: str, as_of: datetime) -> dict:
        def work(u: Unit) -> dict:
            row = self._get("open_tasks", id_, u)
            if row is None or row["status"] != "open":
                return {"status": "not_found"}
            u.put("open_tasks", "close", **row | {"status": "done", "closed_at": as_of})
            self._event(u, row["project"], "task_close", as_of, id=id_)
            return {"status": "closed"}

        return self._unit(as_of, [("open_tasks", None)], work)

    def _review(self, u: Unit, id_: str, outcome: str, as_of: datetime) -> dict | None:
        row = self._get("staging", id_, u)
        if row:
            u.put("staging", "delete", **row)
            cat = self.spark.range(1).select(category(F.lit(row["reason"])).alias("c")).first()["c"]
            u.put("staging_history", "insert", project=row["project"], type=row["type"], category=cat, outcome=outcome, created_at=as_of)
            self._event(u, row["project"], "staging_accept" if outcome == "accepted" else "staging_reject", as_of, id=id_)
        return row

    def promote(self, id_: str, as_of: datetime) -> dict:
        """A staged record goes in as it is, by the reviewer's word; its link to a superseded one does not."""
        def work(u: Unit) -> dict:
            row = self._review(u, id_, "accepted", as_of)
            if row is None:
                return {"status": "not_found"}
            data = {k: v for k, v in json.loads(row["data"]).items() if k != "supersedes_id"}
            return {"status": "committed", "id": self._insert(u, row["type"], row["project"], data, as_of, "human-reviewed", 1.0, "human-reviewed")}

        return self._unit(as_of, [("staging", None)], work)

    def reject(self, id_: str, as_of: datetime) -> dict:
        return self._unit(as_of, [("staging", None)], lambda u: {"status": "rejected" if self._review(u, id_, "rejected", as_of) else "not_found"})

    def clear(self, project: str, as_of: datetime) -> int:
        """Rejects all that is staged of a project, in one commit of frames."""
        def work(u: Unit) -> int:
            rows = Steps(self.spark).keep(u.current("staging", project))
            at, nth = F.lit(as_of).cast("timestamp"), F.col("seq").alias("nth")
            u.frame("staging", rows.select(*[c for c, _ in self.store.fields("staging")], F.lit("delete").alias("op"), nth))
            u.frame("staging_history", rows.select(F.expr("uuid()").alias("id"), "project", "type", category(F.col("reason")).alias("category"), F.lit("rejected").alias("outcome"), at.alias("created_at"), F.lit("insert").alias("op"), nth))
            self._events(u, rows.select("project", F.lit("staging_reject").alias("kind"), F.to_json(F.struct("id")).alias("payload"), nth), as_of)
            return rows.count()

        return self._unit(as_of, [("staging", project)], work)

    def _change(self, id_: str, op: str, kind: str | None, as_of: datetime, change) -> dict:
        def work(u: Unit) -> dict:
            row = self._get("decisions", id_, u)
            if row is None:
                return {"status": "not_found"}
            u.put("decisions", op, **row | change(row))
            if kind:
                self._event(u, row["project"], kind, as_of, id=id_)
            return {"status": op}

        return self._unit(as_of, [("decisions", None)], work)

    def reinforce(self, id_: str, as_of: datetime, by: float = words.STEP) -> dict:
        up = lambda r: {"confidence": min(1.0, max(0.0, (r["confidence"] or 1.0) + by)), "created_at": as_of, "archived_at": None}
        return self._change(id_, "reinforce", "decision_reinforce", as_of, up)

    def archive(self, id_: str, as_of: datetime) -> dict:
        return self._change(id_, "archive", "decision_archive", as_of, lambda r: {"archived_at": r["archived_at"] or as_of})

    def unarchive(self, id_: str, as_of: datetime) -> dict:
        return self._change(id_, "unarchive", None, as_of, lambda r: {"archived_at": None})

    def sweep(self, as_of: datetime, project: str | None = None, floor: float = words.FLOOR) -> list[str]:
        """Archives live decisions whose confidence has decayed below the floor, in one commit of frames; returns their ids."""
        def work(u: Unit) -> list[str]:
            at = F.lit(as_of).cast("timestamp")
            low = records.sweep(u.current("decisions", project), at, floor).drop("eff", "op", "at").withColumn("archived_at", at)
            low = Steps(self.spark).keep(low.withColumnRenamed("seq", "nth").withColumn("op", F.lit("archive")))
            u.frame("decisions", low)
            self._events(u, low.select("project", F.lit("decision_archive").alias("kind"), F.to_json(F.struct("id")).alias("payload"), "nth"), as_of)
            return [r["id"] for r in low.orderBy("nth").select("id").collect()]

        return self._unit(as_of, [("decisions", project)], work)

    # policy
    def tune(self, as_of: datetime) -> DataFrame:
        out = Steps(self.spark).keep(records.tune(self.store.current("staging_history")))
        rows = out.withColumn("id", F.concat_ws("/", "project", "category")).withColumn("updated_at", F.lit(as_of).cast("timestamp"))
        self.store.append("guard_policy", rows, "upsert", as_of)
        return out

    def policy_action(self, project: str, cat: str) -> str:
        r = self.store.current("guard_policy", project).where(F.col("category") == cat).select("action").limit(1).collect()
        return r[0]["action"] if r else "stage"

    def policy_stats(self) -> DataFrame:
        return records.policy_stats(self.store.current("staging_history"), self.store.current("guard_policy")).orderBy(F.desc("n"))

    # reads
    def staging(self, project: str | None = None) -> DataFrame:
        return self.store.current("staging", project).orderBy("created_at", "seq")

    def preview(self, project: str | None = None) -> DataFrame:
        return records.preview(self.staging(project))

    def resolve(self, prefix: str) -> list[str]:
        """Ids of staged records that begin with a prefix, at most two: none, the one, or not unique."""
        return [r["id"] for r in self.store.current("staging").where(F.col("id").startswith(prefix)).select("id").limit(2).collect()]

    def hot(self, project: str) -> DataFrame:
        t = self.store.current("open_tasks", project).where("status = 'open'")
        return rank.pack(t, ["project"], [F.desc("created_at"), F.desc("seq")], cost(F.col("description")), words.HOT_BUDGET)

    def snapshot(self, project: str) -> DataFrame:
        return records.latest(self.store.current("snapshots", project), "project", "created_at", "seq")

    def warm(self, project: str, query: str, as_of: datetime, include_archived: bool = False) -> DataFrame:
        """Decisions by keyword, recency and confidence within the token budget; a query without words ranks by recency."""
        docs = self.store.current("decisions", project)
        docs = docs if include_archived else docs.where("archived_at is null")
        at = F.lit(as_of).cast("timestamp")
        q = self.spark.createDataFrame([(1, project, query or "")], "query_id int, project string, text string")
        empty = postings(q, ["query_id"], ["text"]).isEmpty()
        if empty:
            order = rank.recent(docs.select("project", "id", "created_at", "confidence"), at, words.WARM_BUDGET).select("project", "id", "score", "pos")
        else:
            self.kept.refresh()
            order = rank.ranked(rank.keyword_scores(docs, q, at, kept=self.kept.flags)).select("query_id", "project", "id", "base", "score", "pos")
            asked = self._query_vector(project, query) if self.embed else None
            if asked is not None:
                # the keyword order with its first places improved by the dense one; without vectors it stands as it is
                v = self.vectors(docs, as_of)
                near = rank.dense_rank(v.select("project", "id", "embedding"), asked).select("query_id", "id", "pos")
                fused = rank.fuse_and_guard(order.select("query_id", "id", "base", "pos"), near)
                order = order.drop("pos").join(fused.drop("query_id"), "id")
        eff = F.bround(scoring.effective(F.col("confidence"), F.col("created_at"), at), 3)
        rows = docs.drop("seq", "op", "at").join(order.select("project", "id", "score", "pos"), ["project", "id"]).withColumn("score", F.bround("score", 3)).withColumn("effective_confidence", eff)
        return rank.pack(rows, ["project"], ["pos"], rank.tokens_cost(), words.WARM_BUDGET).orderBy("pos")

    def _query_vector(self, project: str, text: str) -> DataFrame | None:
        """One row with the vector of a text, or None where the provider fails."""
        try:
            return self.spark.createDataFrame([(1, project, [float(x) for x in self.embed([text])[0]])], "query_id int, project string, embedding array<double>")
        except Exception as e:  # noqa: BLE001  whatever a given function raises
            self.embed_error = e
            return None

    def _embedded(self, steps: Steps, texts: DataFrame) -> DataFrame | None:
        """project, id, vector of (project, id, text), written down so that the provider is asked once; None where it fails."""
        embed = self.embed

        def run(batches):
            for b in batches:
                given = [[float(x) for x in v] for v in embed(b.column(2).to_pylist())] if b.num_rows else []
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(given, pa.list_(pa.float32()))], names=["project", "id", "vector"])

        try:
            return steps.keep(texts.select("project", "id", "text").mapInArrow(run, "project string, id string, vector array<float>"))
        except Exception as e:  # noqa: BLE001  whatever a given function raises on the executors
            self.embed_error = e
            return None

    def vectors(self, docs: DataFrame, as_of: datetime) -> DataFrame:
        """project, id, seq, what, embedding of decisions: from the table of the model, and for those that it lacks from the provider, whose answers are kept.

        Where the provider fails, those without a vector are left out.
        """
        steps = Steps(self.spark)
        known = self.store.current("decision_embeddings").where(F.col("model") == self.model).select("id", "vector")
        lacking = steps.keep(docs.join(known, "id", "left_anti").select("project", "id", F.concat(F.col("what"), F.lit(". "), F.coalesce("why", F.lit(""))).alias("text")))
        if not lacking.isEmpty() and (fresh := self._embedded(steps, lacking)) is not None:
            at = F.lit(as_of).cast("timestamp")
            self.store.append("decision_embeddings", fresh.select("id", "project", F.lit(self.model).alias("model"), F.size("vector").alias("dim"), "vector", at.alias("created_at")), "upsert", as_of)
            known = known.unionByName(fresh.select("id", "vector"))
        return docs.join(known, "id").select("project", "id", "seq", "what", F.col("vector").cast("array<double>").alias("embedding"))

    def import_tables(self, tables: dict[str, DataFrame], as_of: datetime) -> dict[str, int]:
        """Takes over tables of a relational store by name, in one commit; how many rows each got (see sources.imports)."""
        return imports.take_over(self.store, tables, as_of)

    def import_vectors(self, rows: DataFrame, as_of: datetime) -> int:
        """Takes over vectors stored as blobs of little-endian 32-bit floats: id, project, model, dim, blob; those of another length than dim are refused."""
        found = rows.withColumn("vector", scoring.floats(F.col("blob"))).withColumn("created_at", F.lit(as_of).cast("timestamp"))
        bad = found.where(F.col("blob").isNull() | (F.octet_length("blob") != F.col("dim") * 4)).select("id").limit(1).collect()
        if bad:
            raise ValueError(f"the vector of {bad[0]['id']} has not the length that it names")
        return self.store.append("decision_embeddings", found, "upsert", as_of)

    def read(self, project: str, query: str, as_of: datetime, include_archived: bool = False, audit: bool = True) -> dict:
        """hot tasks, the last snapshot, warm decisions and token_estimate; each read is an audit event unless audit is False."""
        hot, snap, warm = self.hot(project), self.snapshot(project), self.warm(project, query, as_of, include_archived)
        # what the budgets let through: bounded by them
        tasks, decisions = hot.select("cost").collect(), warm.select("cost", "score", "pos").orderBy("pos").collect()
        layout = snap.select(cost(F.coalesce("file_structure", F.lit(""))).alias("cost")).collect()
        estimate = sum(r["cost"] for r in [*tasks, *decisions, *layout])
        if audit:
            self.audit(project, "query", as_of, query=(query or "")[:120], decisions_returned=len(decisions), open_tasks_returned=len(tasks), top_score=decisions[0]["score"] if decisions else 0.0, token_estimate=estimate)
        return {"hot": hot, "snapshot": snap, "warm": warm, "token_estimate": estimate}

    def provenance(self, id_: str) -> dict | None:
        ids = self.spark.createDataFrame([(id_,)], "id string")
        r = records.provenance(self.store.current("decisions"), self.store.current("dead_ends"), ids).collect()
        return r[0].asDict(True) if r else None

    def route(self, project: str, task: str, as_of: datetime, top: int = 3) -> tuple[DataFrame, DataFrame]:
        q = self.spark.createDataFrame([(1, project, task)], "query_id int, project string, text string")
        old, near = self.store.current("decisions", project), None
        if self.embed and (asked := self._query_vector(project, task)) is not None:
            live = old.where("archived_at is null")
            near = rank.dense_rank(self.vectors(live, as_of).select("project", "id", "embedding"), asked)
        best, proof = records.route(old, q, F.lit(as_of).cast("timestamp"), top, similar=near)
        return best.withColumn("score", F.bround("score", 4)), proof  # ranked before it is rounded

    def handoff(self, project: str, from_agent: str | None, to_agent: str | None, as_of: datetime) -> dict:
        """The packet, as it is stored: id, project, agents, time, state (five latest decisions, hot tasks, snapshot) and what changed since the last one."""
        plain = lambda df: [{k: (v.isoformat() if isinstance(v, datetime) else v) for k, v in r.asDict(True).items()} for r in df.collect()]

        def work(u: Unit) -> dict:
            past = u.current("handoffs", project)
            since = past.agg(F.max("created_at")).first()[0]
            pick = lambda name, at, where=None: plain(records.delta(u.current(name, project), past, at, where).orderBy(at, "seq").drop("seq", "op", "at", "since"))
            state = {"decisions": plain(self.warm(project, "", as_of).where("pos <= 5")), "tasks": plain(self.hot(project)), "snapshot": plain(self.snapshot(project))}
            delta = {"since": since.isoformat() if since else None, "decisions_added": pick("decisions", "created_at"), "dead_ends_added": pick("dead_ends", "created_at"),
                     "tasks_opened": pick("open_tasks", "created_at"), "tasks_closed": pick("open_tasks", "closed_at", F.col("status") == "done")}
            id_ = str(uuid.uuid4())
            packet = {"id": id_, "project": project, "from_agent": from_agent, "to_agent": to_agent, "created_at": as_of.isoformat(), "state": state, "delta": delta}
            u.put("handoffs", "insert", id=id_, project=project, from_agent=from_agent, to_agent=to_agent, payload=json.dumps(packet, default=str), created_at=as_of)
            told = {"id": id_, "from": from_agent, "to": to_agent, "decisions_added": len(delta["decisions_added"]), "tasks_closed": len(delta["tasks_closed"])}
            self._event(u, project, "handoff_create", as_of, **told)
            return packet

        return self._unit(as_of, [("handoffs", project)], work)

    def get_handoff(self, id_: str) -> dict | None:
        row = self._get("handoffs", id_)
        return json.loads(row["payload"]) if row else None

    def latest_handoff(self, project: str) -> dict | None:
        r = records.latest(self.store.current("handoffs", project), "project", "created_at", "seq").collect()
        return json.loads(r[0]["payload"]) if r else None

    # commits
    def capture(self, message: str, project: str, as_of: datetime, files: str | None = None, sha: str = "") -> dict:
        """A commit's decision, if it passes the gates, goes through the checks as a machine's; then the snapshot is renewed."""
        one = extract.gates(extract.parse(self.spark.createDataFrame([(message,)], "message string"))).first()
        if one["status"] != "candidate":
            self.audit(project, "extract_skipped", as_of, sha=sha[:12], reason=one["status"], subject=one["subject"][:80])
            return {"status": "skipped", "reason": one["status"]}
        out = self.write("decision", project, {"what": one["what"], "why": one["why"], "agent": "git-hook", "confidence": words.MACHINE_CONFIDENCE}, as_of, "git-hook")
        snap = self.write("snapshot", project, {"file_structure": files or "(empty tree)"}, as_of, "git-hook")
        return {"status": out["status"], "decision": out, "snapshot": snap["status"]}

    def capture_batch(self, commits: DataFrame, as_of: datetime, stream: str, batch: int) -> bool:
        """capture() for many commits (project, nth, sha, message, files) in one commit of the store; False if the stream's batch was taken before.

        The ledger's row is part of that commit, so a batch that is given twice, after whatever failure, counts once.
        """
        steps = Steps(self.spark)
        seen = steps.keep(extract.gates(extract.parse(commits)))
        good = seen.where("status = 'candidate'")
        text = lambda **more: F.create_map(*[y for k, v in more.items() for y in (F.lit(k), v)])
        decided = good.select("project", (F.col("nth") * 2).alias("seq"), F.lit("decision").alias("kind"), text(what=F.col("what"), why=F.col("why"), agent=F.lit("git-hook"), confidence=F.lit(str(words.MACHINE_CONFIDENCE))).alias("data"))
        layout = good.select("project", (F.col("nth") * 2 + 1).alias("seq"), F.lit("snapshot").alias("kind"), text(file_structure=F.coalesce(F.nullif("files", F.lit("")), F.lit("(empty tree)"))).alias("data"))
        fixed = self._named(steps, decided.unionByName(layout), f"{stream}/{batch}")
        skipped = seen.where("status <> 'candidate'").select("project", F.lit("extract_skipped").alias("kind"), F.to_json(F.struct(F.substring("sha", 1, 12).alias("sha"), F.col("status").alias("reason"), F.substring("subject", 1, 80).alias("subject"))).alias("payload"), "nth")

        def work(u: Unit) -> bool:
            key = f"{stream}/{batch}"
            if not u.current("stream_ledger", stream).where(F.col("id") == key).isEmpty():
                return False
            self._write_batch(u, steps, fixed, as_of, "git-hook")
            self._events(u, skipped, as_of)
            u.put("stream_ledger", "insert", id=key, project=stream, batch=batch, created_at=as_of)
            return True

        return self._unit(as_of, [(t, None) for t in ("decisions", "open_tasks", "dead_ends", "stream_ledger")], work)

    def stats(self, project: str | None = None) -> dict[str, DataFrame]:
        log = self.store.current("audit_log", project).where("kind = 'extract_skipped'")
        return {"by_source": records.source_stats(self.store.current("decisions", project)), "skipped": records.skip_reasons(log)}

    def audit_log(self, project: str | None = None) -> DataFrame:
        return self.store.current("audit_log", project).withColumn("id", F.col("seq"))
