"""Postings of records kept beside them: written once for each text, grown from the log's new rows, read by token.

A row says that a token stands in a record, and whether in its headline. Files are dealt to buckets by the token's hash and
sorted by token, so a query reads the buckets of its own tokens and, in these, the row groups that hold them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, terms
from ..sources.store import PART, PLACE, Conflict, Store
from ..steps import Steps

BUCKETS = 64
#: Appends beyond which they are folded into one.
MOST = 32
ROWS = "project string, id string, token string, in_what int, text_key long"
NAME = "postings"


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def text_key(df: DataFrame) -> Column:
    """Tells the texts that a record has had apart."""
    return F.xxhash64(F.coalesce("what", F.lit("")), F.coalesce("why", F.lit("")))


def build(docs: DataFrame, space: str = SPACE) -> DataFrame:
    """(project, id, token, in_what) of each record, each token once; docs: project, id, what, why."""
    found = terms(docs, ["project", "id"], ["what", "why"], space)
    return found.groupBy("project", "id", "token").agg(F.max((F.col("field") == "what").cast("int")).alias("in_what"))


class Kept:
    """The postings of a store's decisions, as of its newest version."""

    def __init__(self, store: Store):
        self.store = store

    def _adds(self, version: int) -> list[dict]:
        return [x for x in self.store.live[version] if x["table"] == NAME]

    def _read(self, adds: list[dict], kind: str, shape: str) -> DataFrame:
        paths = [f"{self.store.root}/{NAME}/{x['append']}/{kind}" for x in adds if self.store.files.exists(f"{self.store.root}/{NAME}/{x['append']}/{kind}")]
        spark = self.store.spark
        if not paths:
            return spark.createDataFrame([], shape)
        # a path each, and no listing of what no commit names
        out = spark.read.schema(shape).parquet(paths[0])
        for p in paths[1:]:
            out = out.unionByName(spark.read.schema(shape).parquet(p))
        return out

    def refresh(self) -> int:
        """Adds the postings of texts that the log has got since the last call, by whomever; returns the version they stand for.

        Images that change no text add nothing. Two refreshes at once may both add a text; reading counts it once.
        """
        now = self.store.version()
        adds = self._adds(now)
        done = max((x["through"] for x in adds), default=-1)
        news = [x for x in self.store.live[now] if x["table"] == "decisions" and x["version"] > done]
        if not news:
            return done
        steps = Steps(self.store.spark)
        log = self.store.log("decisions", version=now)
        if done >= 0:
            log = log.where(F.col("seq") > (done + 1) << (PLACE + PART))
        last = log.groupBy("id").agg(F.max_by(F.struct("project", "what", "why"), "seq").alias("r")).select("id", "r.*").withColumn("text_key", text_key(log))
        posted = self._read(adds, "texts", "id string, text_key long")
        fresh = steps.keep(last.join(posted, ["id", "text_key"], "left_anti"))
        self._write(steps, fresh, build(fresh).join(fresh.select("id", "text_key"), "id"), fresh.select("id", "text_key"), now)
        steps.done()
        if len(adds) >= MOST:
            self.fold()
        return now

    def _write(self, steps: Steps, rows: DataFrame, posts: DataFrame, texts: DataFrame, through: int, drops: list[str] = ()) -> None:
        token = uuid.uuid4().hex
        at = f"{self.store.root}/{NAME}/{token}"
        if drops or not rows.isEmpty():
            posts = posts.withColumn("bucket", bucket(F.col("token"))).repartition("bucket").sortWithinPartitions("bucket", "token", "project", "id")
            posts.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#token", "true").parquet(f"{at}/rows")
            texts.write.parquet(f"{at}/texts")
        self.store.commit([{"table": NAME, "append": token, "format": 2, "projects": None, "through": through}], drops=drops)

    def fold(self) -> None:
        """Writes all postings as one append."""
        adds = self._adds(self.store.version())
        steps = Steps(self.store.spark)
        texts = self._read(adds, "texts", "id string, text_key long").distinct()
        posts = self._read(adds, "rows", ROWS).distinct()
        try:
            self._write(steps, texts, posts, texts, max(x["through"] for x in adds), [x["append"] for x in adds])
        except Conflict:  # another handle has folded them
            pass

    def flags(self, docs: DataFrame, asked: DataFrame) -> DataFrame:
        """(project, id, token, in_what) of the tokens in `asked` and of records as they are in docs: project, id, what, why."""
        at = [r[0] for r in asked.select(bucket(F.col("token"))).distinct().collect()]  # at most BUCKETS numbers
        rows = self._read(self._adds(self.store.version()), "rows", f"{ROWS}, bucket int").where(F.col("bucket").isin(at))
        mine = docs.select("project", "id", text_key(docs).alias("text_key"))
        # dealt by document, as rank.weights() wants them
        found = rows.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi").repartition("project", "id").join(mine, ["project", "id", "text_key"], "left_semi")
        return found.groupBy("project", "id", "token").agg(F.max("in_what").alias("in_what"))
