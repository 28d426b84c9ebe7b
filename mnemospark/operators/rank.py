"""Keyword ranking, token budgets, dense ranking, rank fusion, and their evaluation."""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField
from pyspark.sql.window import Window

from ..functions import scoring, words
from ..functions.text import SPACE, cost, postings, row_flags
from ..steps import Steps
from . import dense


def flags(docs: DataFrame, space: str = SPACE, asked: DataFrame | None = None) -> DataFrame:
    """(project, id, token, in_what) of each document, in one aggregate; with `asked`, of the tokens in it alone.

    Frequencies and hits both read this, with all its columns, so that Spark makes and exchanges it once.
    """
    found = row_flags(docs, space)
    if asked is not None:
        found = found.join(F.broadcast(asked.select("token").distinct()), "token", "left_semi")
    # dealt by document, so that what is summed up by document stays in its task
    return found.repartition("project", "id").groupBy("project", "id", "token").agg(F.max("in_what").alias("in_what"))


def idf(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """(project, token, df, idf) of flagged tokens: documents without tokens count in n too."""
    n = docs.groupBy("project").agg(F.count("*").alias("n"))
    df = flagged.groupBy("project", "token").agg(F.count("in_what").alias("df"))
    return df.join(n, "project").select("project", "token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


Flags = Callable[[DataFrame, DataFrame], DataFrame]


def weights(docs: DataFrame, queries: DataFrame, space: str = SPACE, kept: Flags | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, project, token, w, df, total) of the tokens of queries, and the flags of documents that have them.

    Only the tokens of queries are kept before anything is exchanged; frequencies of other tokens are not needed. kept: a
    function of (docs, asked) that reads these flags from kept postings; without it, they come from the texts.
    """
    asked = postings(queries, ["query_id", "project"], ["text"], space).select("query_id", "project", "token")
    flagged = kept(docs, asked) if kept else flags(docs, space, asked)
    asked = asked.join(idf(docs, flagged).select("project", "token", "df", "idf"), ["project", "token"], "left").withColumn("w", F.coalesce("idf", F.lit(1.0)))
    total = asked.groupBy("query_id", "project").agg(F.sum("w").alias("total"))
    return asked.join(total, ["query_id", "project"]).select("query_id", "project", "token", "w", F.coalesce("df", F.lit(0)).alias("df"), "total"), flagged


def weighted(docs: DataFrame, queries: DataFrame, space: str = SPACE, kept: Flags | None = None) -> DataFrame:
    """(query_id, project, id, hit, hit_what, total): the weights of the tokens that a document shares with a query."""
    asked, flagged = weights(docs, queries, space, kept)
    return _summed(_met(flagged, asked))


def _met(flagged: DataFrame, asked: DataFrame) -> DataFrame:
    """The postings of documents with the weights of the queries that ask for their tokens.

    The queries' tokens go to the documents, which are dealt by (project, id): so pairs of queries and documents are made and summed up
    in a task, and none is exchanged. The queries of one call are what is broadcast.
    """
    return flagged.join(F.broadcast(asked), ["project", "token"])


def _summed(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "project", "id").agg(F.sum("w").alias("hit"), F.sum(F.col("w") * F.col("in_what")).alias("hit_what"), F.first("total").alias("total"))


def positions(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with nth, the place from 0 within a column's groups in the order of others, and n, the size of the group; and part, where a row was counted.

    Rows are dealt by ranges of (group, order), whose splitters Spark samples, so tasks are even whatever the distribution; a place
    is that in its range and the counts of the ranges before, which are one number a range and group. The ranges
    are written down, so that all that reads them sees the same ones.
    """
    steps = Steps(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, by, *order).sortWithinPartitions(by, *order).withColumn("at", F.monotonically_increasing_id())
    dealt = steps.keep(dealt.withColumn("part", F.shiftright("at", 33)))
    held = dealt.groupBy(by, "part").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    w = Window.partitionBy(by)
    before = F.coalesce(F.sum("m").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(F.col(by).alias("group"), F.col("part").alias("range"), (before - F.col("first")).alias("shift"), F.sum("m").over(w).alias("n"))
    out = dealt.join(held, F.col(by).eqNullSafe(F.col("group")) & (F.col("part") == F.col("range")))
    return out.withColumn("nth", F.col("at") + F.col("shift")).drop("group", "range", "shift", "at")


def recency(docs: DataFrame) -> DataFrame:
    """docs with `recency`, from 0 for a project's oldest record to the full weight for its newest, by exact positions."""
    placed = positions(docs, "project", ["created_at", "id"])
    share = F.coalesce(F.col("nth") / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0))
    return placed.withColumn("recency", share * words.RECENCY_WEIGHT).drop("nth", "n", "part")


#: Times k documents that a query's rarest tokens are to have before a floor is taken from them.
SEEDS = 4


def promising(asked: DataFrame, flagged: DataFrame, static: DataFrame, k: int) -> DataFrame:
    """(query_id, project, id) of documents that can come among the k best of a query; all the best are among them.

    A floor comes first: the k-th best whole score of the documents that have the query's rarest tokens is what the k-th best of all scores
    at least. Then tokens go from the lightest up as long as what they can all give together, with the best of what does not hang on
    tokens, stays under the floor: a document that has only such tokens cannot come in, so their
    postings, which are the long ones, are not met. static: project, id, static.
    """
    most = static.groupBy("project").agg(F.max("static").alias("best"), F.min("static").alias("worst"))
    rare = Window.partitionBy("query_id", "project").orderBy(F.desc("w"), "token")
    before = F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seed = asked.withColumn("before", before).where(F.col("before") < SEEDS * k)
    tried = flagged.join(seed.select("query_id", "project", "token"), ["project", "token"]).select("query_id", "project", "id").distinct()
    # whole scores of these: the query's tokens meet the documents' by document, not by posting
    whole = _summed(tried.join(flagged, ["project", "id"]).join(asked, ["query_id", "project", "token"])).join(most, "project")
    floor = (F.col("hit") + words.WHAT_WEIGHT * F.col("hit_what")) / F.col("total") + F.col("worst")
    nth = F.row_number().over(Window.partitionBy("query_id", "project").orderBy(F.desc("floor")))
    floors = whole.withColumn("floor", floor).withColumn("nth", nth).where(F.col("nth") == k).select("query_id", "project", "floor")
    light = Window.partitionBy("query_id", "project").orderBy("w", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gives = F.sum(F.col("w") * (1 + words.WHAT_WEIGHT)).over(light) / F.col("total")
    told = asked.withColumn("gives", gives).join(floors, ["query_id", "project"], "left").join(most, "project")
    heavy = told.where(F.col("floor").isNull() | (F.col("gives") + F.col("best") >= F.col("floor") - 1e-6))
    return flagged.join(heavy.select("query_id", "project", "token"), ["project", "token"]).select("query_id", "project", "id").distinct()


def keyword_scores(docs: DataFrame, queries: DataFrame, as_of: Column, space: str = SPACE, tail: int | None = words.WARM_BUDGET, kept: Flags | None = None, k: int | None = None) -> DataFrame:
    """(query_id, project, id, base, score, created_at) of all documents with a common token; with k, of those that can come among the k best.

    Every document takes part in a ranking, but those without a common token stand behind in an order that no query
    changes; so of these only the first `tail` of each project are added, which is as many as any budget can hold.
    docs: project, id, created_at, confidence, what, why. queries: query_id, project, text. kept: as in weights().
    """
    age = recency(docs.select("project", "id", "created_at", "confidence"))
    nudge = words.CONFIDENCE_WEIGHT * (F.col("eff") - 1)
    meta = age.select("project", "id", "created_at", "recency", scoring.effective(F.col("confidence"), F.col("created_at"), as_of).alias("eff"))
    asked, flagged = weights(docs, queries, space, kept)
    met = _met(flagged, asked)
    if k:
        met = met.join(promising(asked, flagged, meta.select("project", "id", (F.col("recency") + nudge).alias("static")), k), ["query_id", "project", "id"], "left_semi")
    hits = _summed(met)
    base, what = F.col("hit") / F.col("total"), F.col("hit_what") / F.col("total")
    scored = hits.join(meta, ["project", "id"]).select("query_id", "project", "id", "created_at", base.alias("base"), (base + words.WHAT_WEIGHT * what + F.col("recency") + nudge).alias("score"))
    if not tail:
        return scored
    rest = meta.withColumn("score", nudge).withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy(*_order()))).where(F.col("k") <= tail)
    rest = queries.select("query_id", "project").join(rest, "project").join(hits.select("query_id", "project", "id"), ["query_id", "project", "id"], "left_anti")
    return scored.unionByName(rest.select("query_id", "project", "id", "created_at", F.lit(0.0).alias("base"), "score"))


def _order() -> list[Column]:
    return [F.round("score", 9).desc(), F.col("created_at").desc(), F.col("id")]


def ranked(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds pos from 1 within a query and project."""
    out = scores.withColumn("pos", F.row_number().over(Window.partitionBy("query_id", "project").orderBy(*_order())))
    return out.where(F.col("pos") <= limit) if limit else out


def recent(docs: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """The order of an empty query: recency and confidence alone."""
    eff = scoring.effective(F.col("confidence"), F.col("created_at"), as_of)
    scored = recency(docs).withColumn("score", F.col("recency") + words.CONFIDENCE_WEIGHT * (eff - 1)).drop("recency")
    out = scored.withColumn("pos", F.row_number().over(Window.partitionBy("project").orderBy(*_order())))
    return out.where(F.col("pos") <= limit) if limit else out


def pack(rows: DataFrame, keys: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """The rows before the first that overflows the budget; costs are at least 1, so the running sum decides alone."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("cost", size).withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= budget)


def most_that_fit(rows: DataFrame, key: str, size: Column, budget: int) -> int:
    """As many rows as any choice from one group can have within the budget: those of the smallest sizes, which are at least 1."""
    w = Window.partitionBy(key).orderBy("size")
    small = rows.select(key, size.alias("size")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= budget)
    fits = small.withColumn("used", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("used") <= budget)
    return fits.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0] or 1


def _near(sim: str = "sim") -> list[Column]:
    return [F.round(sim, 9).desc(), F.col("id")]


_POS, _SIM, _SCORE = StructField("pos", IntegerType()), StructField("sim", DoubleType()), StructField("score", DoubleType())


def dense_rank(vectors: DataFrame, queries: DataFrame, k: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, project, id, sim, pos) of a stated set of queries against all vectors of their project; sim is rounded to digits, if any.

    Whole orders are made where a query is dealt to (dense.orders), so no pair is exchanged, as long as a task can hold the vectors. Beyond that, and with k,
    products are made by blocks (dense.scores); with k, each block keeps what can be among the k best of a query.
    """
    if not k:
        whole = dense.orders(vectors, queries, dense.whole_order(digits), [_SIM, _POS], ["query_id", "project"])
        if whole is not None:
            return whole
    out = dense.scores(vectors, queries, k)
    out = out.withColumn("pos", F.row_number().over(Window.partitionBy("query_id", "project").orderBy(*_near())))
    out = out.where(F.col("pos") <= k) if k else out
    return out if digits is None else out.withColumn("sim", F.round("sim", digits))


def dense_rrf(vectors: DataFrame, queries: DataFrame, k: int = words.RRF_K, digits: int | None = None) -> DataFrame:
    """(query_id, id, score, pos): what rrf() gives for the dense orders of the two vectors of each query, `embedding` and `second`.

    Both orders of a query are made and fused in one task (dense.orders); where the vectors are more than that can hold, both products of a pair
    come in one row, so pairs are exchanged once and never joined. Ids of vectors and of queries must each be there once. vectors: project, id, embedding.
    """
    whole = dense.orders(vectors, queries, dense.fused_order(k, digits), [_SCORE, _POS])
    if whole is not None:
        return whole
    out = dense.scores(vectors, queries).drop("project").repartition("query_id")
    by = Window.partitionBy("query_id")
    for i, sim in enumerate(("sim", "sim_2")):
        out = out.withColumn(f"pos_{i}", F.row_number().over(by.orderBy(*_near(sim)))).drop(sim)
    out = out.withColumn("score", F.lit(1.0) / (k + F.col("pos_0")) + F.lit(1.0) / (k + F.col("pos_1")))
    # every id stands in the first order, in which ties stay
    out = out.withColumn("pos", F.row_number().over(by.orderBy(F.round("score", 12).desc(), "pos_0"))).select("query_id", "id", "score", "pos")
    return out if digits is None else out.withColumn("score", F.round("score", digits))


def rrf(lists: list[DataFrame], keys: list[str], k: int = words.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of frames with pos from 1: (keys, id, score, pos); ties keep the order of the first list."""
    each = [x.select(*keys, "id", (F.lit(1.0) / (k + F.col("pos"))).alias("part"), F.lit(i).alias("src"), "pos") for i, x in enumerate(lists)]
    both = each[0]
    for x in each[1:]:
        both = both.unionByName(x)
    out = both.groupBy(*keys, "id").agg(F.sum("part").alias("score"), F.min(F.struct("src", "pos")).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.round("score", 12).desc(), "first", "id")
    return out.withColumn("pos", F.row_number().over(w)).select(*keys, "id", "score", "pos")


def fuse_and_guard(keyword: DataFrame, near: DataFrame, head: int | None = words.HEAD, scored: bool = True, gives_way: bool = True) -> DataFrame:
    """(query_id, id, pos) of a keyword order improved by a dense one within its head.

    keyword: query_id, id, base, pos from 1. near: query_id, id, pos from 1, the dense order. Where no base is over 0, the dense order
    stands, unless not gives_way. A first that leads by the margin keeps its place; the rest of the head is fused, both ranks counted anew.
    """
    key = ["query_id"]
    by = Window.partitionBy("query_id")
    lead = keyword.groupBy("query_id").agg(
        F.max((F.col("base") > 0).cast("int")).alias("signal"), F.count("*").alias("n"),
        F.max(F.when(F.col("pos") == 1, F.col("base"))).alias("b0"), F.max(F.when(F.col("pos") == 2, F.col("base"))).alias("b1"),
    )
    pin = (F.lit(True) if not scored else (F.col("n") <= 1) | (F.col("b0") - F.col("b1") >= words.MARGIN)) if head else F.lit(False)
    lead = lead.select("query_id", (F.col("signal") > 0 if gives_way else F.lit(True)).alias("signal"), pin.alias("pin"))
    kw = keyword.join(lead, "query_id")
    top = kw.where(F.col("pos") <= head) if head else kw
    rest = top.where(~(F.col("pin") & (F.col("pos") == 1)))
    a = rest.withColumn("pos", F.row_number().over(by.orderBy("pos")))
    b = near.join(rest.select("query_id", "id"), ["query_id", "id"], "left_semi").withColumn("pos", F.row_number().over(by.orderBy("pos")))
    fused = rrf([a, b], key).select("query_id", "id", F.col("pos").alias("at"), F.lit(1).alias("part"))
    pinned = top.where(F.col("pin") & (F.col("pos") == 1)).select("query_id", "id", F.lit(0).alias("at"), F.lit(0).alias("part"))
    tail = kw.where(F.col("pos") > head).select("query_id", "id", F.col("pos").alias("at"), F.lit(2).alias("part")) if head else None
    out = pinned.unionByName(fused)
    out = (out.unionByName(tail) if tail is not None else out).join(lead.where("signal"), "query_id", "left_semi")
    out = out.unionByName(near.join(lead.where("not signal"), "query_id", "left_semi").select("query_id", "id", F.col("pos").alias("at"), F.lit(3).alias("part")))
    return out.select("query_id", "id", F.row_number().over(by.orderBy("part", "at", "id")).alias("pos"))


def fuse_dense(vectors: DataFrame, first: DataFrame, second: DataFrame, head: int = words.HEAD) -> DataFrame:
    """(query_id, id, pos): what fuse_and_guard() gives for the dense orders of two vectors of each query, the first always in place of keywords.

    Of the second order only the turn of each head's ids counts, so just these products are made; behind the head the first order
    stands as it is. vectors: project, id, embedding; first and second: query_id, project, embedding. Ids must each be there once.
    """
    top = dense_rank(vectors, first, head).select("query_id", "project", "id", F.col("sim").alias("base"), "pos")
    top = Steps(vectors.sparkSession).keep(top)
    sim = scoring.dot(F.col("embedding"), F.col("q"))
    near = top.join(second.withColumnRenamed("embedding", "q"), ["query_id", "project"]).join(vectors, ["project", "id"]).select("query_id", "id", sim.alias("sim"))
    near = near.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(*_near())).alias("pos"))
    fused = fuse_and_guard(top.select("query_id", "id", "base", "pos"), near, head, gives_way=False)
    whole = dense.orders(vectors, first, dense.tail_order(head), [_POS])
    if whole is not None:
        return fused.unionByName(whole)
    by = Window.partitionBy("query_id", "project").orderBy(*_near())
    # where the second product is null, the guard leaves the first row out, and what follows moves up
    up = F.nth_value("sim", 2).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).isNull().cast("int")
    tail = dense.scores(vectors, first).withColumn("pos", F.row_number().over(by)).withColumn("up", up).where(F.col("pos") > head)
    return fused.unionByName(tail.select("query_id", "id", (F.col("pos") - F.col("up")).alias("pos")))


def recall(found: DataFrame, expected: DataFrame, by: list[str] = ()) -> DataFrame:
    """Recall at 1 and 3 and mean reciprocal rank of expected ids; one that is not found has rank 0 and counts as a miss."""
    r = expected.join(found.select("query_id", "id", "pos"), ["query_id", "id"], "left").withColumn("pos", F.coalesce("pos", F.lit(0)))
    hit = lambda n: F.avg(F.col("pos").between(1, n).cast("double"))
    return r.groupBy(*by).agg(F.count("*").alias("n"), hit(1).alias("recall_1"), hit(3).alias("recall_3"), F.avg(F.when(F.col("pos") > 0, 1 / F.col("pos")).otherwise(0.0)).alias("mrr"))


def tokens_cost() -> Column:
    return cost(F.concat_ws(" ", "what", "why"))


def evaluate(docs: DataFrame, queries: DataFrame, space: str = SPACE, kept: Flags | None = None) -> DataFrame:
    """(query_id, id, category, pos): where a labelled set's expected records come, by shared tokens alone; ties keep the order of nth.

    docs: id, nth from 0, what, why. queries: query_id, text, expected, category. Records without a common token stand
    behind the others in their order, so their places follow from counts and no pairs are formed for them. kept: as in weights(), of a project "set".
    """
    all_docs = docs.withColumn("project", F.lit("set"))
    weight, flagged = weights(all_docs, queries.withColumn("project", F.lit("set")), space, kept)
    score = F.round(F.col("hit") / F.col("total"), 9)
    own = F.broadcast(queries.select(F.col("expected").alias("id")).distinct())
    mine = _summed(_met(flagged.join(own, "id", "left_semi"), weight)).select("query_id", "id", score.alias("mine"))
    asked = queries.select("query_id", F.col("expected").alias("id"), "category").join(docs.select("id", F.col("nth").alias("own")), "id", "left")
    asked = asked.join(mine, ["query_id", "id"], "left").withColumn("mine", F.coalesce("mine", F.lit(0.0)))
    hits = _summed(_met(flagged, weight)).join(all_docs.select("project", "id", "nth"), ["project", "id"]).select("query_id", "nth", score.alias("score"))
    # all hits of a query are counted against its expected record, where they are made
    ahead = F.count_if((F.col("nth") != F.col("own")) & ((F.col("score") > F.col("mine")) | ((F.col("score") == F.col("mine")) & (F.col("nth") < F.col("own")))))
    key = ["query_id", "id", "category", "own", "mine"]
    counted = hits.join(F.broadcast(asked), "query_id").groupBy(*key).agg(ahead.alias("ahead"), F.count_if(F.col("nth") < F.col("own")).alias("hits_before"))
    counted = asked.join(counted.select("query_id", "id", "ahead", "hits_before"), ["query_id", "id"], "left").na.fill(0, ["ahead", "hits_before"])
    pos = F.when(F.col("mine") > 0, F.col("ahead") + 1).otherwise(F.col("ahead") + F.col("own") - F.col("hits_before") + 1)
    return counted.select("query_id", "id", "category", F.coalesce(pos, F.lit(0)).cast("int").alias("pos"))


def summary(places: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, recall_1, recall_3 and mrr of evaluate(), over all or by a column."""
    return recall(places.select("query_id", "id", "pos"), places.drop("pos"), list(by))


def misses(places: DataFrame, first: int = 1) -> DataFrame:
    """What does not come among the first, the worst first."""
    return places.where((F.col("pos") > first) | (F.col("pos") == 0)).orderBy(F.desc("pos"), "query_id")


def latencies(times: DataFrame, column: str = "ms") -> DataFrame:
    """The median and the 95th percentile of measured times, each a time that was measured."""
    return times.agg(F.count("*").alias("n"), F.expr(f"percentile_disc(0.5) within group (order by `{column}`)").alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by `{column}`)").alias("p95"))


def distractors(spark, n: int, seed: int = 1234) -> DataFrame:
    """n made-up records (id, nth, what, why), no two alike, that scale an evaluation: thing, purpose, manner and reason of each.

    A record's number goes through an affine permutation of all combinations, so that none comes twice and no row depends on another.
    """
    parts = (words.TOOLS, words.ROLES, words.AIMS, words.MANNERS, words.REASONS)
    space = 1
    for p in parts:
        space *= len(p)
    if n > space:
        raise ValueError(f"there are {space} combinations")
    step = next(x for x in range(space * 5 // 8 + seed % 97, 2 * space) if gcd(x, space) == 1)
    rows, left = spark.range(1, n + 1).withColumn("at", F.pmod(F.col("id").cast("decimal(38,0)") * step + seed, F.lit(space)).cast("long")), 1
    for i, p in enumerate(parts):
        rows = rows.withColumn(f"p{i}", F.array(*map(F.lit, p))[F.pmod(F.floor(F.col("at") / left), F.lit(len(p))).cast("int")])
        left *= len(p)
    what = F.concat_ws(" ", F.lit("Run"), "p0", F.lit("as the"), "p1", F.lit("for"), "p2", "p3")
    return rows.select(F.format_string("x%09d", "id").alias("id"), F.col("id").alias("nth"), what.alias("what"), F.concat_ws(" ", F.lit("It"), "p4", F.lit("where"), "p2", F.lit("matter")).alias("why"))
