"""Tables as append-only logs of full row images under a root folder, folded into current views.

A commit log orders them: an append writes its files where no reader looks, then claims the next version by making a file that
must not exist yet, which names them. So readers see whole appends only, writers never overwrite each other, and a
claim that comes second takes the next version, or, where it was decided on what the other has changed since, is refused
and decided anew. One commit may add to several tables. `seq` is (version, partition, place) in one number, in order of arrival; tables are partitioned by
project, which scans prune by.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "seq long, op string, at timestamp"
#: Bits of seq for the place in a partition of an append, and for the partition.
PLACE, PART = 23, 13
#: Versions between two lists of all that is live, from which a new handle starts.
STATE_EVERY = 64
#: Appends of a table that are folded into one when a call finds so many, and folded ones likewise.
APPENDS, FOLDED = 128, 16
#: The layout of this store; 1 is a folder a table without a log, which is adopted as its first commit.
FORMAT = 2
SCHEMAS = {
    "decisions": "id string, project string, what string, why string, agent string, created_at timestamp, confidence double, supersedes_id string, archived_at timestamp, source string",
    "snapshots": "id string, project string, file_structure string, active_stack string, current_module string, created_at timestamp",
    "open_tasks": "id string, project string, description string, assigned_agent string, status string, created_at timestamp, closed_at timestamp",
    "staging": "id string, type string, project string, data string, reason string, created_at timestamp, source string",
    "staging_history": "id string, project string, type string, category string, outcome string, created_at timestamp",
    "guard_policy": "id string, project string, category string, action string, sample_size long, accept_rate double, updated_at timestamp",
    "audit_log": "id string, project string, kind string, payload string, created_at timestamp",
    "decision_embeddings": "id string, project string, model string, dim int, vector array<float>, created_at timestamp",
    "dead_ends": "id string, project string, what_tried string, why_failed string, chosen_decision_id string, agent string, created_at timestamp, confidence double",
    "stream_ledger": "id string, project string, batch long, created_at timestamp",
    "handoffs": "id string, project string, from_agent string, to_agent string, payload string, created_at timestamp",
}


class Conflict(RuntimeError):
    """What a commit was decided on has changed since."""


class Files:
    """The few calls on small files that the log needs, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def names(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def claim(self, path: str, text: str) -> bool:
        """Whether this call made the file: with all of its text at once, and only if it was not there.

        A file system that renames without overwriting, as HDFS does, or local links decide who was first.
        """
        draft = f"{path}.{uuid.uuid4().hex}"
        fs, at = self._at(draft)
        stream = fs.create(at, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.getUri().getScheme() != "file":
            won = not self.exists(path) and fs.rename(at, self._at(path)[1])
        else:
            local = lambda p: self._at(p)[1].toUri().getPath()
            try:
                os.link(local(draft), local(path))
                won = True
            except FileExistsError:
                won = False
        if not won or fs.getUri().getScheme() == "file":
            fs.delete(at, False)
        return won


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        #: Commits read so far, by version, and what is live by now.
        self.entries: dict[int, dict] = {}
        self.live: dict[int, list[dict]] = {}

    def schema(self, name: str) -> str:
        return f"{SCHEMAS[name]}, {LOG}"

    def fields(self, name: str) -> list[list[str]]:
        return [f.split(" ", 1) for f in SCHEMAS[name].split(", ")]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self) -> None:
        """Begins the log, unless it is there; tables of a store without one are taken over as they are."""
        if self.files.exists(f"{self.root}/_log/{0:020d}.json"):
            return
        old = [{"table": n, "append": "", "format": 1, "projects": None} for n in SCHEMAS if any(x.startswith("project=") for x in self.files.names(self.path(n)))]
        self.files.claim(f"{self.root}/_log/{0:020d}.json", json.dumps({"format": FORMAT, "adds": old, "drops": []}))

    # the log
    def version(self) -> int:
        """The newest version; reads what has come since the last call."""
        if not self.live:
            states = [int(x[:20]) for x in self.files.names(f"{self.root}/_log") if x.endswith(".state.json")]
            if states:
                self.live[max(states)] = json.loads(self.files.read(f"{self.root}/_log/{max(states):020d}.state.json"))
        v = max(self.live, default=-1)
        while self.files.exists(at := f"{self.root}/_log/{v + 1:020d}.json"):
            entry = json.loads(self.files.read(at))
            if entry["format"] > FORMAT:
                raise RuntimeError(f"the store has format {entry['format']}, this library reads up to {FORMAT}")
            v += 1
            gone = set(entry["drops"])
            before = [x for x in self.live.get(v - 1, []) if x["append"] not in gone or not x["append"]]
            self.entries[v], self.live[v] = entry, before + [x | {"version": v} for x in entry["adds"]]
            if v % STATE_EVERY == 0 and v:
                self.files.claim(f"{self.root}/_log/{v:020d}.state.json", json.dumps(self.live[v]))
            for stale in [x for x in self.live if x < v - 2 * STATE_EVERY]:
                del self.live[stale]
        return v

    def stage(self, name: str, rows: DataFrame, as_of, op: str | None = None, order: str | None = None, project: str | None = None, n: int | None = None) -> dict | None:
        """Writes images in the order of a column, where no reader sees them yet; what commit() takes, or None of an empty frame.

        Rows are sorted by range and keep partition and place, so no task sees the whole batch and nothing is counted first.
        A frame of n rows in one partition, where n is given, is taken in the order that it has.
        """
        token, got = uuid.uuid4().hex, Observation()
        out = (rows if n else rows.orderBy(order or "id")).withColumn("nth", F.monotonically_increasing_id())
        out = out.withColumn("part", F.shiftright("nth", 33)).withColumn("place", F.col("nth").bitwiseAND(F.lit((1 << 33) - 1)))
        out = out.withColumn("op", F.lit(op) if op else F.col("op")).withColumn("at", F.lit(as_of).cast("timestamp"))
        kept = [F.col(c).cast(kind).alias(c) for c, kind in self.fields(name)] + [F.lit(None).cast("long").alias("seq"), "op", "at", "part", "place"]
        out = out.select(*kept)
        if not n:
            out = out.observe(got, F.count(F.lit(1)).alias("n"), F.max("part").alias("part"), F.max("place").alias("place"))
        out.write.partitionBy("project").parquet(f"{self.path(name)}/append={token}")
        seen = {"n": n, "part": 0, "place": 0} if n else got.get
        if not seen["n"]:
            self.files.delete(f"{self.path(name)}/append={token}")
            return None
        if seen["part"] >= 1 << PART or seen["place"] >= 1 << PLACE:
            raise RuntimeError(f"an append takes {1 << PART} partitions of {1 << PLACE} rows at most: {seen}")
        return {"table": name, "append": token, "format": FORMAT, "projects": None if project is None else [project], "rows": seen["n"]}

    def commit(self, adds: Iterable[dict | None], base: int | None = None, reads: Iterable[tuple[str, str | None]] = (), drops: Iterable[str] = ()) -> int:
        """Makes staged appends visible, all at once, as the next version.

        With `base`, the version that they were decided at, and `reads`, the tables (and projects) that they were decided on,
        the commit is refused if one of these has changed since.
        """
        adds, drops = [x for x in adds if x], list(drops)
        if not adds and not drops:
            return self.version()
        reads, v = list(reads), (self.version() if base is None else base) + 1
        text = json.dumps({"format": FORMAT, "adds": adds, "drops": drops})
        while not self.files.claim(f"{self.root}/_log/{v:020d}.json", text):
            self.version()
            if base is not None and any(_touches(x, reads) for x in self.entries[v]["adds"]):
                raise Conflict(f"version {v} changed what version {base} was read for")
            if set(drops) & set(self.entries[v]["drops"]):
                raise Conflict(f"version {v} has folded the same appends")
            v += 1
        return v

    def discard(self, adds: Iterable[dict | None]) -> None:
        for x in adds:
            if x:
                self.files.delete(f"{self.path(x['table'])}/append={x['append']}")

    def append(self, name: str, rows: DataFrame, op: str, as_of, order: str | None = None) -> int:
        """Appends images whatever else has happened meanwhile; returns how many."""
        staged = self.stage(name, rows, as_of, op, order)
        self.commit([staged])
        return staged["rows"] if staged else 0

    # reading
    def log(self, name: str, project: str | None = None, version: int | None = None, adds: list[dict] | None = None) -> DataFrame:
        """All images up to a version, or those of some appends; columns that older files lack are null."""
        now = self.version()
        live = adds if adds is not None else [x for x in self.live[now if version is None else version] if x["table"] == name and (project is None or x["projects"] is None or project in x["projects"])]
        shape, places = ", ".join([SCHEMAS[name], LOG]), "append string, part long, place long"
        cols = [f.split(" ")[0] for f in shape.split(", ")]
        out = self.spark.createDataFrame([], shape)
        if old := [x for x in live if x["format"] == 1]:
            folders = [f"{self.path(name)}/{x}" for x in self.files.names(self.path(name)) if x.startswith("project=")]
            out = self.spark.read.schema(shape).option("basePath", self.path(name)).parquet(*folders).select(*cols) if old and folders else out
        if new := [x for x in live if x["format"] == 2]:
            got = self.spark.read.schema(f"{shape}, {places}").option("basePath", self.path(name)).parquet(*[f"{self.path(name)}/append={x['append']}" for x in new])
            # a compacted append keeps the numbers that its rows have
            given = F.create_map(*[F.lit(y) for x in new for y in (x["append"], x["version"])])[F.col("append")].cast("long")
            number = F.shiftleft(given, PLACE + PART) + F.shiftleft(F.col("part"), PLACE) + F.col("place") + 1
            got = got.withColumn("seq", F.coalesce("seq", number)).select(*cols)
            out = got if not old else out.unionByName(got)
        return out.where(F.col("project") == project) if project is not None else out

    def current(self, name: str, project: str | None = None, version: int | None = None) -> DataFrame:
        """The latest image of each row, without deleted ones: a pre-aggregated maximum, no sort of the log."""
        log = self.log(name, project, version)
        now = log.groupBy("id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "id"]), "seq").alias("r")).select("id", "r.*")
        return now.where("op <> 'delete'")

    def last_time(self, name: str):
        """When the table was last appended to."""
        return self.log(name).agg(F.max("at")).first()[0]

    def compact(self, name: str, whole: bool = True) -> int:
        """Folds a table into one append, sorted by id within a project, with a Bloom filter on ids; versions before stay readable.

        Unless `whole`, only appends that were not folded yet are, and what they delete is kept as such, so that the cost follows what is new.
        Appends of others since then are kept beside it. Returns the version.
        """
        base = self.version()
        live = [x for x in self.live[base] if x["table"] == name and x["format"] == FORMAT and (whole or not x.get("compacted"))]
        if not live:
            return base
        # what an older layout holds stays beside, and so do the deletions of its rows
        keep_deleted = not whole or any(x["table"] == name and x["format"] == 1 for x in self.live[base])
        log = self.log(name, adds=live)
        rows = log.groupBy("id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "id"]), "seq").alias("r")).select("id", "r.*")
        rows = (rows if keep_deleted else rows.where("op <> 'delete'")).withColumn("part", F.lit(0).cast("long")).withColumn("place", F.lit(0).cast("long"))
        token = uuid.uuid4().hex
        writer = rows.repartition("project", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("project", "id").write.partitionBy("project")
        writer.option("parquet.bloom.filter.enabled#id", "true").parquet(f"{self.path(name)}/append={token}")
        add = {"table": name, "append": token, "format": FORMAT, "projects": None, "rows": None, "compacted": True}
        try:
            return self.commit([add], base, drops=[x["append"] for x in live])
        except Conflict:  # another handle was first; its result will do
            self.discard([add])
            return self.version()

    def tidy(self) -> None:
        """Folds what is new of tables that have got many appends, and all of those that have many folded ones."""
        now = self.live[self.version()]
        for name in SCHEMAS:
            mine = [x for x in now if x["table"] == name and x["format"] == FORMAT]
            folded = sum(bool(x.get("compacted")) for x in mine)
            if len(mine) - folded >= APPENDS or folded >= FOLDED:
                self.compact(name, whole=folded >= FOLDED)


def _touches(add: dict, reads: list[tuple[str, str | None]]) -> bool:
    if add.get("compacted"):
        return False
    return any(add["table"] == t and (p is None or add["projects"] is None or p in add["projects"]) for t, p in reads)


class Unit:
    """What one call adds, to however many tables, in one commit; decided on the store as it was at `base`."""

    def __init__(self, store: Store, as_of, reads: Iterable[tuple[str, str | None]]):
        self.store, self.as_of, self.reads, self.base = store, as_of, list(reads), store.version()
        self.rows: dict[str, list[dict]] = {}
        self.frames: dict[str, list[DataFrame]] = {}

    def current(self, name: str, project: str | None = None) -> DataFrame:
        return self.store.current(name, project, self.base)

    def put(self, name: str, op: str, **row: Any) -> str:
        row.setdefault("id", str(uuid.uuid4()))
        self.rows.setdefault(name, []).append(row | {"op": op})
        return row["id"]

    def frame(self, name: str, rows: DataFrame) -> None:
        """Images with their op, in the order of a number nth; behind what the table has got before in this unit."""
        self.frames.setdefault(name, []).append(rows)

    def commit(self) -> int:
        adds: list[dict | None] = []
        for name in [*self.rows, *(x for x in self.frames if x not in self.rows)]:
            cols, parts, own = [c for c, _ in self.store.fields(name)] + ["op"], self.frames.get(name, []), self.rows.get(name, [])
            if own:
                values = [(*[r.get(c) for c in cols], i) for i, r in enumerate(own)]
                parts = [self.store.spark.createDataFrame(values, ", ".join([SCHEMAS[name], "op string", "nth long"])).coalesce(1), *parts]
            # one append a table, so that no two rows get one number
            df = None
            for i, x in enumerate(parts):
                x = x.select(*cols, F.struct(F.lit(i).alias("of"), F.col("nth").cast("long").alias("nth")).alias("nth"))
                df = x if df is None else df.unionByName(x)
            projects = {r["project"] for r in own}
            alone = len(parts) == 1 and bool(own)
            adds.append(self.store.stage(name, df, self.as_of, order="nth", project=projects.pop() if alone and len(projects) == 1 else None, n=len(own) if alone else None))
        try:
            return self.store.commit(adds, self.base, self.reads)
        except Conflict:
            self.store.discard(adds)
            raise


def unit(store: Store, as_of, reads: Iterable[tuple[str, str | None]], work: Callable[[Unit], Any], tries: int = 50) -> Any:
    """Runs work(unit) and commits it; where what it read has changed meanwhile, once more on the store as it is then."""
    reads = list(reads)
    for left in reversed(range(tries)):
        u = Unit(store, as_of, reads)
        out = work(u)
        try:
            u.commit()
            return out
        except Conflict:
            if not left:
                raise
    return None
