"""Exact top-k inner products by columnar branch and bound.

Vectors become integers, floor(64 * x). Every row gets a number, written once, by which it is told apart from all others.
Queries and candidates are dealt to bounded blocks by these numbers, and each pair of blocks meets in a partition of its
own. There the candidates lie in vertical layout, one row a dimension. Products are accumulated a block of
dimensions at a time; what the rest can add is at most the product of the remaining norms, so a candidate whose upper
bound is under the k-th best whole product of a query's most promising candidates is compacted away before the next block
of dimensions is read.

Defined results: null vectors, and those with a null, NaN or infinite component, and rows without an id take no part, an
empty vector scores 0 with others; vectors of different lengths are not compared; rows that share an id, or all they
hold, are queries and candidates of their own, each a candidate of the others; ties go to the smaller id; an empty table
gives no rows; other columns are not looked at. Scores beyond 64 bits are reported as the nearest long, after ranking by the exact numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, by_group

K, EVERY, SCALE = 20, 20, 64
#: Components of a block of queries or candidates at most, its rows at most, and dimensions added at a time.
COMPONENTS, ROWS, DIMENSIONS = 1 << 20, 16384, 16
PARTITIONS = 20_000
#: Candidates of which whole products are taken first, for a bound on the k-th best.
TRIED = 64
TOP = "query_row long, query_id long, vec_id long, score long"


def best(q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, k: int = K):
    """For each query (row of q) the positions and scores of its k best candidates (rows of c), best first.

    A candidate with the query's own row number is none; ties go to the smaller of c_ids.
    """
    n, dims = c.shape
    big = max(int(abs(q).max(initial=0)), int(abs(c).max(initial=0)))
    exact = big * big * max(dims, 1) < 2**53
    column = np.ascontiguousarray(c.T.astype(np.float64)) if exact else c.T.astype(object)
    rows = q.astype(np.float64) if exact else q.astype(object)
    size = (c.astype(np.float64) ** 2)[:, ::-1].cumsum(axis=1)[:, ::-1]
    rest_c = np.ascontiguousarray(np.sqrt(np.concatenate((size, np.zeros((n, 1))), axis=1)).T)
    size = (q.astype(np.float64) ** 2)[:, ::-1].cumsum(axis=1)[:, ::-1]
    rest_q = np.sqrt(np.concatenate((size, np.zeros((len(q), 1))), axis=1))
    cuts = [*range(0, dims, DIMENSIONS), dims] if dims else [0, 0]
    for at in range(0, len(q), 256):
        some = slice(at, min(at + 256, len(q)))
        sums = rows[some, : cuts[1]] @ column[: cuts[1]] if dims else np.zeros((some.stop - at, n))
        own = [np.flatnonzero(c_rows == r) for r in q_rows[some]]
        least = [_least(sums[i], rows[at + i], column, cuts[1], own[i], k) for i in range(len(sums))]

        def survivors(i, a, part, live=slice(None), at=at, least=least):
            value = part.astype(np.float64)
            return np.flatnonzero(value + rest_q[at + i, a] * rest_c[a, live] * (1 + 1e-9) + abs(value) * 1e-12 + 1 >= least[i])

        # while most candidates survive, a block of dimensions is added for all queries at once
        done = 1
        while done + 1 < len(cuts) and np.mean([len(survivors(i, cuts[done], sums[i])) for i in range(min(4, len(sums)))]) > n / 2:
            sums = sums + rows[some, cuts[done] : cuts[done + 1]] @ column[cuts[done] : cuts[done + 1]]
            done += 1
        for i in range(len(sums)):
            live = survivors(i, cuts[done], sums[i])
            live = live[~np.isin(live, own[i])]
            part = sums[i][live]
            for a, b in zip(cuts[done:], cuts[done + 1 :], strict=False):
                part = part + rows[at + i, a:b] @ column[a:b, live]
                keep = survivors(i, b, part, live)
                live, part = live[keep], part[keep]
            order = np.lexsort((c_ids[live], -part))[:k] if exact else np.array(sorted(range(len(live)), key=lambda x: (-part[x], c_ids[live[x]]))[:k], int)
            yield at + i, live[order], part[order]


def _least(part: np.ndarray, row: np.ndarray, column: np.ndarray, a: int, own: np.ndarray, k: int) -> float:
    """A lower bound on the k-th best product: the k-th best whole product of the candidates with the highest sums up to dimension a."""
    if len(part) - len(own) <= max(k, TRIED):
        return -np.inf
    rough = part.astype(np.float64)
    rough[own] = -np.inf
    best = np.argpartition(rough, len(part) - TRIED)[len(part) - TRIED :] if k <= TRIED else np.zeros(0, int)
    if not len(best):
        return -np.inf
    whole = np.partition((part[best] + row[a:] @ column[a:, best]).astype(np.float64), TRIED - k)[TRIED - k]
    return float(whole - abs(whole) * 1e-12)


def _search(batches):
    lo, hi = -(2**63), 2**63 - 1
    for t in by_group(batches, ["dims", "qb", "cb"]):
        ids, side = t.column("vec_id").to_numpy(), t.column("is_query").to_numpy(zero_copy_only=False)
        rows, dims = t.column("row").to_numpy(), t.column("dims")[0].as_py()
        flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        v = np.floor(SCALE * flat.reshape(len(ids), dims))
        v = v.astype(np.int64) if abs(v).max(initial=0) < 2**62 else np.array([[int(x) for x in r] for r in v], object).reshape(len(ids), dims)
        q, c = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(q) or not len(c):
            continue
        out: list[list] = [[], [], [], []]
        for j, found, score in best(v[q], rows[q], v[c], rows[c], ids[c]):
            out[0] += [int(rows[q[j]])] * len(found)
            out[1] += [int(ids[q[j]])] * len(found)
            out[2] += ids[c[found]].tolist()
            out[3] += [min(hi, max(lo, int(s))) for s in score]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_row", "query_id", "vec_id", "score"])


def search(spark: SparkSession, vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k best of all other rows.

    The numbers of blocks follow from the table, so that a block of the longest vectors has at most COMPONENTS numbers
    on average; the shuffle grows with rows times blocks, as in any exact search in blocks.
    """
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    good = Scratch(spark).keep(good.select(F.monotonically_increasing_id().alias("row"), F.size("embedding").alias("dims"), "vec_id", "embedding"))
    asks = F.col("vec_id") % every == 0
    n, m, dims = good.agg(F.count("*"), F.count_if(asks), F.max("dims")).first()
    size = max(256, min(ROWS, COMPONENTS // max(1, dims or 0)))
    cs, qs = max(1, -(-n // size)), max(1, -(-m // size))
    blocks = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    every_block = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    c = good.select("row", "dims", "vec_id", "embedding", F.lit(False).alias("is_query"), every_block(qs).alias("qb"), blocks(cs).alias("cb"))
    q = good.where(asks).select("row", "dims", "vec_id", "embedding", F.lit(True).alias("is_query"), blocks(qs).alias("qb"), every_block(cs).alias("cb"))
    # a pair of blocks is a partition, so that none waits for another; beyond PARTITIONS, some pairs share one
    parts = min(qs * cs, PARTITIONS)
    both = c.unionByName(q).repartitionById(parts, F.pmod(F.col("qb").cast("long") * cs + F.col("cb"), F.lit(parts)).cast("int")).sortWithinPartitions("dims", "qb", "cb")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return both.mapInArrow(_search, TOP).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: The same over a table of embeddings in DuckDB.
ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) z, row_number() over () n from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.n, q.vec_id::bigint query_id, c.vec_id::bigint vec_id, list_inner_product(q.z, c.z)::bigint score
  from v q join v c on q.vec_id % 20 = 0 and q.n <> c.n and len(q.z) = len(c.z)),
r as (select query_id, row_number() over (partition by n order by score desc, vec_id)::int "rank", vec_id, score from s)
select query_id, "rank", vec_id, score from r where "rank" <= 20
"""
