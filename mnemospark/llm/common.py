"""What the training-data operators share: scratch tables, grouped streaming in Python, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, as in tests, a temporary one, in local mode only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a reread and no recomputation.

    keep() writes and rereads a frame; drop() deletes one that nothing reads any more. What a returned
    frame still reads stays until the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.n, self.paths = 0, {}
        atexit.register(self._delete, self.root)

    def keep(self, df: DataFrame, sort: str | None = None) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        try:
            jvm, sc = self.spark._jvm, self.spark.sparkContext
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended; nothing depends on the deletion
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """The columns of a frame, whatever signs their names hold."""
    return [F.col("`{}`".format(c.replace("`", "``"))) for c in df.columns]


def grows(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is shuffled and sorted, however small it is today, never broadcast."""
    return df.hint("merge")


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the runs of equal keys in sorted batches; a run may go on over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i in range(len(rows) + 1):
            if i == len(rows):
                held.append(b.slice(start))
            elif rows[i] != last:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, rows[i]
    if held:
        yield pa.Table.from_batches(held)


def components(scratch: Scratch, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root): the smallest id of each component, by alternating large-star and small-star contraction.

    edges has long columns a and b. Each half round is a minimum by node and a join back to the edges, which
    Spark pre-aggregates and, for hot nodes, splits: the minima are written first, so that both sides of a join are plain
    exchanges. No adjacency list is ever collected. Edges are rewritten to the shared folder each round. Nodes that have no edge but to themselves come out as their own root.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = scratch.keep(both.distinct())
    seen = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node points at the node's least neighbour
        u = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = scratch.keep(u.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = u.where("v > u").join(grows(least), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.union(now.where("a = b")).distinct())
        # small star: every smaller neighbour of a node, and the node, point at the least of them
        low = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(grows(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = scratch.keep(small.distinct())
        n = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now, least, large, low)
        now = after
        if n == seen:
            break
        seen = n
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.col("b").alias("root"))
