"""Commits as a stream: each micro-batch is one commit of the store, taken once however often it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.memory import Memory


def capture_stream(memory: Memory, commits: DataFrame, name: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """Captures decisions from a stream of (project, at, sha, message, files), in the order of at and sha within a batch.

    A batch's time is that of its newest commit, so that a batch that is given again is the same one. The checkpoint of the stream
    and the ledger of the store together make a restarted stream add what one pass would have added.
    """
    def take(df: DataFrame, batch: int) -> None:
        newest = df.agg(F.max("at")).first()[0]
        if newest is None:
            return
        # the micro-seconds since 1970 and the hash keep commits apart and in order, without a window over the batch
        order = F.unix_micros("at") * 1024 + F.pmod(F.xxhash64("sha"), F.lit(1024))
        memory.capture_batch(df.dropDuplicates(["project", "sha"]).withColumn("nth", order), newest, name, batch)

    writer = commits.writeStream.queryName(name.replace("/", "_")).option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if available else writer).start()
