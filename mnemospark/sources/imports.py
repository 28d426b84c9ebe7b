"""Whole tables of a relational store taken over into the log, with ids, links, times and vectors as they were."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from .store import SCHEMAS, Conflict, Store

#: Tables that hold no column `created_at`, and what orders their rows instead.
ORDER = {"guard_policy": "updated_at"}


def moment(text: Column) -> Column:
    """The time of an ISO text; null stays null, what cannot be read is the start of 1970, as it counts for ages."""
    return F.when(text.isNotNull(), F.timestamp_micros(F.round(scoring.epoch(text) * 1e6).cast("long")))


def images(store: Store, name: str, rows: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Rows of a table as the log keeps them, with `nth` to order them by; columns that older layouts lack are null.

    Times are ISO texts or timestamps. Policies are named by project and category. Vectors come as (decision_id, model,
    dim, vector as little-endian 32-bit floats) and get the project of their decision.
    """
    if name == "guard_policy":
        rows = rows.withColumn("id", F.concat_ws("/", "project", "category"))
    if name == "decision_embeddings":
        owners = decisions.groupBy("id").agg(F.min("project").alias("project"))
        rows = rows.select(F.col("decision_id").cast("string").alias("id"), "model", "dim", F.col("vector").cast("binary").alias("blob"), "created_at").join(owners, "id", "left")
        fits = F.octet_length("blob") == F.col("dim") * 4
        rows = rows.withColumn("vector", F.when(fits, scoring.floats(F.col("blob"))))
    kinds = dict(rows.dtypes)

    def column(c: str, kind: str) -> Column:
        if c not in kinds:
            return F.lit(None).cast(kind).alias(c)
        return (moment(F.col(c)) if kind == "timestamp" and kinds[c] == "string" else F.col(c).cast(kind)).alias(c)

    out = rows.select(*[column(c, kind) for c, kind in store.fields(name)])
    needed = ["id", "project", *(["vector"] if name == "decision_embeddings" else [])]
    bad = out.where(F.greatest(*[F.col(c).isNull() for c in needed], F.lit(False))).select("id").limit(1).collect()
    if bad:
        raise ValueError(f"a row of {name} lacks one of {needed}: {bad[0]['id']}")
    at = ORDER.get(name, "created_at")
    return out.withColumn("nth", F.struct(F.col(at).alias("at"), F.expr("try_cast(id as bigint)").alias("number"), F.col("id").alias("id")))


def take_over(store: Store, tables: Mapping[str, DataFrame], as_of, tries: int = 50) -> dict[str, int]:
    """Adds the rows of the given tables, oldest first, in one commit; how many each got.

    A row whose id the log has met is left as it is here, whatever became of it, so what is imported twice counts once, and
    a later export adds what is new in it.
    """
    unknown = sorted(set(tables) - set(SCHEMAS))
    if unknown:
        raise ValueError(f"no such table: {unknown}")
    for left in reversed(range(tries)):
        base, adds = store.version(), {}
        held = store.log("decisions", version=base).select("id", "project")
        decisions = held.unionByName(tables["decisions"].select(F.col("id").cast("string").alias("id"), "project")) if "decisions" in tables else held
        for name, rows in tables.items():
            fresh = images(store, name, rows, decisions).join(store.log(name, version=base).select("id").distinct(), "id", "left_anti")
            adds[name] = store.stage(name, fresh, as_of, "insert", order="nth")
        try:
            store.commit(adds.values(), base, [(name, None) for name in tables])
            return {name: add["rows"] if add else 0 for name, add in adds.items()}
        except Conflict:
            store.discard(adds.values())
            if not left:
                raise
    return {}
