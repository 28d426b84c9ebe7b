"""Policy learning, audit reports, provenance, hand-offs, routing and sweeping, as plans over record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring, words
from ..functions.text import postings
from .rank import weighted

FAILURES = ("write_staged", "write_auto_rejected", "write_rejected")


def policy_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("project", "category").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "accepted").alias("accepted"))


def tune(history: DataFrame) -> DataFrame:
    """(project, category, action, sample_size, accept_rate): categories that reviewers nearly always turn down are turned down at once."""
    rate = F.col("accepted") / F.col("n")
    action = F.when((F.col("n") >= words.POLICY_SAMPLE) & (rate <= words.POLICY_RATE), "auto_reject").otherwise("stage")
    return policy_counts(history).select("project", "category", action.alias("action"), F.col("n").alias("sample_size"), rate.alias("accept_rate"))


def policy_stats(history: DataFrame, policy: DataFrame) -> DataFrame:
    out = policy_counts(history).join(policy.select("project", "category", "action"), ["project", "category"], "left")
    return out.select("project", "category", "n", "accepted", (F.col("accepted") / F.col("n")).alias("accept_rate"), F.coalesce("action", F.lit("stage")).alias("action"))


def counts(log: DataFrame, project=None) -> DataFrame:
    return (log.where(F.col("project") == project) if project is not None else log).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def tail(log: DataFrame, limit: int = 50, project=None) -> DataFrame:
    return (log.where(F.col("project") == project) if project is not None else log).orderBy(F.desc("id")).limit(limit)


def fails(log: DataFrame, project=None, kinds=FAILURES) -> DataFrame:
    return (log.where(F.col("project") == project) if project is not None else log).where(F.col("kind").isin(*kinds)).orderBy(F.desc("id"))


def skip_reasons(payloads: DataFrame, path: str = "$.reason") -> DataFrame:
    return payloads.groupBy(F.coalesce(F.get_json_object("payload", path), F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def source_stats(decisions: DataFrame) -> DataFrame:
    live = decisions.where("archived_at is null")
    return live.groupBy(F.coalesce("source", F.lit("agent")).alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 1.0).alias("at_cap"))


def latest(df: DataFrame, key: str = "project", at: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest row of each key, by a maximum that is pre-aggregated, not by a sort."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(at, tie)).alias("r")).select(key, "r.*")


def sweep(decisions: DataFrame, as_of: Column, floor: float = words.FLOOR) -> DataFrame:
    eff = scoring.effective(F.col("confidence"), F.col("created_at"), as_of)
    return decisions.where("archived_at is null").withColumn("eff", eff).where(F.col("eff") < floor)


def provenance(decisions: DataFrame, dead_ends: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Each decision with what it superseded and, in order, the ways that were given up for it; archived rows too."""
    d = decisions.join(ids, "id", "left_semi") if ids is not None else decisions
    tried = dead_ends.groupBy(F.col("chosen_decision_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("created_at", F.col("id").alias("dead_end_id"), "what_tried", "why_failed"))).alias("dead_ends"))
    old = decisions.select(F.col("id").alias("supersedes_id"), F.col("what").alias("superseded_what"), F.col("why").alias("superseded_why"))
    return d.join(old, "supersedes_id", "left").join(tried, "id", "left")


def delta(rows: DataFrame, handoffs: DataFrame, at: str, extra: Column | None = None) -> DataFrame:
    """Rows newer than their project's last hand-off, or all that have the time where there was none."""
    since = handoffs.groupBy("project").agg(F.max("created_at").alias("since"))
    out = rows.join(since, "project", "left").where(F.col(at).isNotNull() & (F.col("since").isNull() | (F.col(at) > F.col("since"))))
    return out.where(extra) if extra is not None else out


def route(decisions: DataFrame, tasks: DataFrame, as_of: Column, top: int = 3, evidence: int = 3, space: str | None = None, similar: DataFrame | None = None, kept=None) -> tuple[DataFrame, DataFrame]:
    """Agents by the decayed relevance of their decisions to a task, and their best evidence. tasks: query_id, project, text.

    Relevance is the share of the task's tokens by weight, and with `similar` (query_id, project, id, sim) the similarity
    of the vectors besides, as far as it is over 0; a task without tokens has no agents.
    """
    live = decisions.where("archived_at is null")
    hits = weighted(live, tasks, *((space,) if space else ()), kept=kept).select("query_id", "project", "id", (F.col("hit") / F.col("total")).alias("relevance"))
    if similar is not None:
        told = postings(tasks, ["query_id", "project"], ["text"], *((space,) if space else ())).select("query_id", "project").distinct()
        near = similar.join(told, ["query_id", "project"], "left_semi").select("query_id", "project", "id", F.greatest(F.lit(0.0), F.col("sim")).alias("near"))
        hits = hits.join(near, ["query_id", "project", "id"], "full").select("query_id", "project", "id", (F.coalesce("relevance", F.lit(0.0)) + F.coalesce("near", F.lit(0.0))).alias("relevance"))
    eff = scoring.effective(F.col("confidence"), F.col("created_at"), as_of)
    rel = hits.where("relevance > 0").join(live.select("project", "id", F.coalesce(F.nullif("agent", F.lit("")), F.lit("unknown")).alias("agent"), eff.alias("eff")), ["project", "id"])
    rel = rel.withColumn("contribution", F.col("relevance") * F.col("eff"))
    agents = rel.groupBy("query_id", "project", "agent").agg(F.sum("contribution").alias("score"), F.count("*").alias("n"))
    w = Window.partitionBy("query_id", "project").orderBy(F.round("score", 9).desc(), "agent")
    best = agents.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top)
    # evidence counts for what it contributes, as it is shown: to four places
    rel = rel.withColumn("relevance", F.bround("contribution", 4))
    e = Window.partitionBy("query_id", "project", "agent").orderBy(F.col("relevance").desc(), "id")
    proof = rel.withColumn("nth", F.row_number().over(e)).where(F.col("nth") <= evidence).join(best.select("query_id", "project", "agent"), ["query_id", "project", "agent"], "left_semi")
    return best, proof


def preview(staged: DataFrame, most: int = 80) -> DataFrame:
    """id, short_id, type, reason and the first text of a staged record that isn't empty, cut for a list."""
    field = lambda f: F.nullif(F.get_json_object("data", f"$.{f}"), F.lit(""))
    text = F.coalesce(*map(field, ("what", "description", "file_structure")), F.lit("(no preview)"))
    return staged.select("id", F.substring("id", 1, 8).alias("short_id"), "project", "type", "reason", F.substring(text, 1, most).alias("preview"))


def cascade(rows: DataFrame, owners: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose owner is still there."""
    return rows.join(owners.select(F.col("id").alias(key)), key, "left_semi")


def same_ids(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same ids, each as often."""
    a, b = a.select("id"), b.select("id")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def supersede_view(log: DataFrame, key: str = "id") -> DataFrame:
    """Current rows of an append-only log of full row images: the last by seq, unless it is a tombstone; links to rows that are gone are null."""
    now = latest(log, key, "seq", "seq").where("op <> 'delete'")
    alive = now.select(F.col(key).alias("__alive"))
    return now.join(alive, F.col("supersedes_id") == F.col("__alive"), "left").withColumn("supersedes_id", F.col("__alive")).drop("__alive")


def resolved(ids: DataFrame, asked: DataFrame) -> DataFrame:
    """(prefix, found, id): how many ids begin with each asked prefix, and the id where it is the only one.

    Ids and prefixes meet on length and leading part, so no id is held against a prefix that it doesn't begin with; matches
    are counted before they are exchanged, and prefixes have few lengths. An empty prefix is one that all ids begin with.
    """
    want = asked.select(F.col("prefix").cast("string").alias("prefix")).where("prefix is not null").distinct()
    sizes = [r[0] for r in want.select(F.length("prefix")).distinct().collect()]  # as many as ids have characters, at most
    parts = ids.select(F.col("id").cast("string").alias("id")).where("id is not null").select("id", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("size")).where("size <= length(id)")
    counts = parts.groupBy(F.expr("left(id, size)").alias("prefix")).agg(F.count("*").alias("found"), F.min("id").alias("id"))
    return want.join(counts, "prefix", "left").select("prefix", F.coalesce("found", F.lit(0)).alias("found"), F.when(F.col("found") == 1, F.col("id")).alias("id"))
