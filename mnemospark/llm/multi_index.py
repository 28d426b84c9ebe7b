"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors become bits: the sides of hyperplanes that iterative quantisation learns, TURNS rotations of the main directions of a bounded
sample. All rows are dealt to bounded blocks by hash and each block keeps an index of its own: codes are split into substrings, and a
table for each substring lists the rows by its value. A code within `radius` of a query's agrees with it, in at least one
substring, up to radius // substrings bits (one less behind the first radius % substrings + 1), so probing all such values of
every table finds every code within the radius. What is found and does lie within it is ranked by the cosine of the vectors as given.

The radius comes from the data: for at most TRIED queries the true nearest of all rows are found by a scan, and the radius is what
holds QUANTILE of their codes. Queries go to all blocks, as in any search of a stated set against all rows, and come back with k rows
from each, so large groups of near copies spread over the blocks and no pairs leave a task. A query for which fewer than k rows lie within the
radius is searched once more without one, exactly. What is fitted on a sample is bounded by SAMPLE and TRIED; every row is indexed.

Defined results: null vectors, zero ones, those with a null, NaN or infinite component, and rows without an id take no part; vectors
of different lengths are not compared, and each length, of which few are expected, has a model of its own; rows that share an id, or all they hold, are queries and
candidates of their own; ties go to the smaller id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, by_group

K, EVERY = 5, 50
#: Rows that a model is fitted on and queries that the radius is fitted on, about; and the share of true neighbours that it is to hold.
SAMPLE, TRIED, QUANTILE = 8192, 128, 0.98
#: Rotations, main directions of each at most, and rounds of fitting.
TURNS, DIRECTIONS, ROUNDS = 4, 64, 25
#: Components of a block of rows and its rows at most, queries of a block at most.
COMPONENTS, ROWS, ASKED = 1 << 20, 8192, 4096
PARTITIONS = 20_000
TOP = "query_row long, query_id long, vec_id long, score double"


def scaled(flat: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine, so that no square overflows or vanishes."""
    most = np.abs(flat).max(axis=1, initial=0)
    return np.ldexp(flat, -np.frexp(most)[1][:, None])


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


class Model:
    """Bits of vectors of one length: signs of products with learned directions, after the mean is taken off."""

    def __init__(self, sample: np.ndarray, seed: int = 0):
        u = unit(scaled(sample))
        self.mean = u.mean(axis=0)
        x = u - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, :DIRECTIONS]
        x, rng, found = x @ axes, np.random.default_rng(seed), []
        for _ in range(TURNS):
            turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
            for _ in range(ROUNDS):
                a, _, b = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
                turn = (a @ b).T
            found.append(axes @ turn)
        self.planes = np.concatenate(found, axis=1)
        self.bits = self.planes.shape[1]

    def codes(self, u: np.ndarray) -> np.ndarray:
        """Rows of 0 and 1."""
        return ((u - self.mean) @ self.planes > 0).astype(np.uint8)


def words(codes: np.ndarray) -> np.ndarray:
    packed = np.packbits(codes, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Index:
    """The codes of a block by the values of their substrings."""

    def __init__(self, codes: np.ndarray):
        n, bits = codes.shape
        width = min(16, max(8, int(n).bit_length() - 1))
        self.cuts = [(a, min(bits, a + width)) for a in range(0, bits, width)]
        self.words, self.rows = words(codes), n
        self.tables = []
        for a, b in self.cuts:
            value = self.values(codes, a, b)
            self.tables.append((np.argsort(value, kind="stable"), np.concatenate(([0], np.bincount(value, minlength=1 << (b - a)).cumsum()))))

    @staticmethod
    def values(codes: np.ndarray, a: int, b: int) -> np.ndarray:
        return codes[:, a:b].astype(np.int64) @ (1 << np.arange(b - a))

    def probes(self, radius: int) -> list[np.ndarray]:
        """For each table what is to be flipped in a value so that no code within the radius is missed; none for tables that needn't be looked at."""
        each, more = divmod(radius, len(self.cuts))
        out = []
        for j, (a, b) in enumerate(self.cuts):
            flips = np.arange(1 << (b - a))
            out.append(flips[np.bitwise_count(flips) <= (each if j <= more else each - 1)] if each or j <= more else flips[:0])
        return out

    def within(self, values: list[int], word: np.ndarray, radius: int, probes: list[np.ndarray]) -> np.ndarray:
        """The rows whose codes lie within the radius of a query's."""
        hit = np.zeros(self.rows, bool)
        for value, flips, (order, starts) in zip(values, probes, self.tables, strict=True):
            at = value ^ flips
            low = starts[at]
            size = starts[at + 1] - low
            full = np.flatnonzero(size)
            if len(full):
                low, size = low[full], size[full]
                ends = size.cumsum()
                hit[order[np.repeat(low - (ends - size), size) + np.arange(ends[-1])]] = True
        rows = np.flatnonzero(hit)
        return rows[distances(self.words[rows], word) <= radius]


def best(rows: np.ndarray, vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of the largest cosine with a query, and the cosines; each row's products are summed alike, so equal vectors tie."""
    score = (vectors[rows] * query).sum(axis=1) / (norms[rows] * np.sqrt((query * query).sum()))
    order = np.lexsort((ids[rows], -score))[:k]
    return rows[order], score[order]


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["query_row", "query_id", "vec_id", "score"])


def _search(models: dict[int, Model], radius: dict[int, int], k: int):
    """For mapInArrow: the k best of each query within each pair of blocks; without a radius, of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["dims", "qb", "cb"]):
            side, dims = t.column("is_query").to_numpy(zero_copy_only=False), t.column("dims")[0].as_py()
            ids, row = t.column("vec_id").to_numpy(), t.column("row").to_numpy()
            v = scaled(_matrix(t.column("embedding"), len(ids)))
            q, c = np.flatnonzero(side), np.flatnonzero(~side)
            if not len(q) or not len(c):
                continue
            cv, norms = v[c], np.sqrt((v[c] * v[c]).sum(axis=1))
            r = radius.get(dims)
            if r is not None:
                model = models[dims]
                index, codes = Index(model.codes(cv / norms[:, None])), model.codes(unit(v[q]))
                asked, probes = words(codes), index.probes(r)
                values = np.stack([index.values(codes, a, b) for a, b in index.cuts], axis=1).tolist()
            out: list[list] = [[], [], [], []]
            for i, at in enumerate(q):
                rows = index.within(values[i], asked[i], r, probes) if r is not None else np.arange(len(c))
                found, score = best(rows[row[c[rows]] != row[at]], cv, norms, ids[c], v[at], k)
                out[0] += [row[at]] * len(found)
                out[1] += [ids[at]] * len(found)
                out[2] += ids[c[found]].tolist()
                out[3] += score.tolist()
            yield _batch(out)

    return run


def _tried(models: dict[int, Model], samples: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """For mapInArrow: how far the codes of the k nearest rows, of those that a task sees, lie from each sampled query's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            dims = t.column("dims").to_numpy()
            for d in np.unique(dims):
                part = t.filter(pa.array(dims == d))
                if d not in samples or not part.num_rows:
                    continue
                rows, asked = samples[d]
                own, u = part.column("row").to_numpy(), unit(scaled(_matrix(part.column("embedding"), part.num_rows)))
                near = u @ asked.T
                w, codes = words(models[d].codes(u)), words(models[d].codes(asked))
                for i, r in enumerate(rows):
                    sims = np.where(own == r, -np.inf, near[:, i])
                    top = np.argpartition(-sims, k - 1)[:k] if len(sims) > k else np.arange(len(sims))
                    top = top[sims[top] > -np.inf]
                    held = kept.setdefault(int(r), [])
                    held += [(int(d), -float(sims[x]), int(own[x]), int(distances(w[x], codes[i]))) for x in top]
                    held.sort()
                    del held[k:]
        flat = [(r, *x) for r, held in kept.items() for x in held]
        cols = list(zip(*flat, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["query_row", "dims", "far", "row", "distance"])

    return run


def _some(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """About a share of the rows, by hash, the same at every run over a written table."""
    return rows.where(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) < F.lit(min(1 << 30, int(share * (1 << 30)) + 1)))


def fit(good: DataFrame, counts: dict[int, tuple[int, int]], asks, k: int) -> tuple[dict[int, Model], dict[int, int]]:
    """A model and a radius for each length; counts: rows and queries by length."""
    models, samples = {}, {}
    for d, (n, m) in counts.items():
        if not m:
            continue
        mine = good.where(F.col("dims") == d)
        some = _some(mine, SAMPLE / n, 1).orderBy("row").limit(2 * SAMPLE).select("embedding").toArrow()
        if not some.num_rows:  # by chance, of a small table
            some = mine.orderBy("row").limit(SAMPLE).select("embedding").toArrow()
        models[d] = Model(_matrix(some.column(0), some.num_rows))
        asked = _some(mine.where(asks), TRIED / m, 2).orderBy("row").limit(2 * TRIED).select("row", "embedding").toArrow()
        if asked.num_rows:
            samples[d] = asked.column(0).to_numpy(), unit(scaled(_matrix(asked.column(1), asked.num_rows)))
    near = good.select("row", "dims", "embedding").mapInArrow(_tried(models, samples, k), "query_row long, dims int, far double, row long, distance long")
    first = F.row_number().over(Window.partitionBy("query_row").orderBy("far", "row"))
    seen: dict[int, list[int]] = {}
    for r in near.withColumn("nth", first).where(F.col("nth") <= k).select("dims", "distance").collect():  # k for each sampled query
        seen.setdefault(r["dims"], []).append(r["distance"])
    return models, {d: int(np.quantile(seen[d], QUANTILE, method="higher")) if seen.get(d) else m.bits for d, m in models.items()}


def search(spark: SparkSession, vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k nearest found among all other rows."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    )
    scratch = Scratch(spark)
    good = scratch.keep(good.select(F.monotonically_increasing_id().alias("row"), F.size("embedding").alias("dims"), "vec_id", "embedding"))
    asks = F.col("vec_id") % every == 0
    counts = {r["dims"]: (r["n"], r["m"]) for r in good.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(asks).alias("m")).collect()}  # a row for each length
    models, radius = fit(good, counts, asks, k)
    n = sum(x for x, _ in counts.values())
    size = max(256, min(ROWS, COMPONENTS // max([1, *counts])))
    cs = max(1, -(-n // size))

    def blocks(queries: DataFrame, count: int, radius: dict[int, int]) -> DataFrame:
        qs = max(1, -(-count // ASKED))
        block = lambda b: F.pmod(F.xxhash64("row"), F.lit(b)).cast("int")
        every_block = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
        c = good.select("row", "dims", "vec_id", "embedding", F.lit(False).alias("is_query"), every_block(qs).alias("qb"), block(cs).alias("cb"))
        q = queries.select("row", "dims", "vec_id", "embedding", F.lit(True).alias("is_query"), block(qs).alias("qb"), every_block(cs).alias("cb"))
        parts = min(qs * cs, PARTITIONS)
        both = c.unionByName(q).repartitionById(parts, F.pmod(F.col("qb").cast("long") * cs + F.col("cb"), F.lit(parts)).cast("int")).sortWithinPartitions("dims", "qb", "cb")
        w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        return both.mapInArrow(_search(models, radius, k), TOP).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    found = scratch.keep(blocks(good.where(asks), sum(m for _, m in counts.values()), radius))
    # queries with fewer rows within the radius than there are are searched without one
    enough = F.create_map(*[F.lit(x) for d, (n, _) in counts.items() for x in (d, min(k, n - 1))])[F.col("dims")] if counts else F.lit(0)
    had = found.groupBy("query_row").agg(F.count("*").alias("had"))
    lack = good.where(asks).join(had.hint("merge"), F.col("row") == F.col("query_row"), "left").where(F.coalesce("had", F.lit(0)) < enough).drop("query_row", "had")
    lack = scratch.keep(lack)
    if count := lack.count():
        whole = blocks(lack, count, {})
        found = found.join(lack.select(F.col("row").alias("query_row")).hint("merge"), "query_row", "left_anti").unionByName(whole.select(*found.columns))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
