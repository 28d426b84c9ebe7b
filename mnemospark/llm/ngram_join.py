"""N-gram Jaccard self-join of documents: MinHash LSH forest, then exact verification.

1. Each row gets a number. A document's distinct 5-word shingles become 64-bit hashes; documents with the same set form
   one class, which goes on as a single representative, its lowest row number, with a MinHash signature. Shorter texts
   count as one shingle.
2. The signature makes a label of `DEPTH` levels for each of `TREES` prefix tries. A representative is looked up under
   the longest prefix that others share, and that prefix is shortened as long as its node would then hold at most
   `SMALL` members: from the root, a node with more is split by one more level, down to the last. All members of a node
   decide alike, so any two that share it meet.
3. From the depths that a representative got, the probability follows that a partner of similarity 0.8 meets it in some
   tree. Those for which it is below `RECALL` shorten their prefixes in all trees to the longest at which that recall
   is certain, `deepest(RECALL)`; the nodes that they ask for then take the place of all nodes below them.
4. Within a node, signatures are compared in blocks; pairs far below the threshold fall out (a bound of more than
   five standard deviations). Each block gives at most one edge a member, never all pairs. What hangs together forms
   a candidate group.
5. The shingle sets of each candidate group meet once, in bounded blocks, and every pair of a
   group is verified exactly, so links are counted whole whether or not the forest saw them itself.

Defined results: words are runs of anything but ASCII white space, case counts; a null text or one without words has
no shingles, is linked to nothing and is a class of its own; repeated rows and equal texts share a class; rows that share
a doc_id but not the text are compared like any others, and so are rows without a doc_id; class_id is the smallest
doc_id of what hangs together, null only if no row of it has one; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, by_group, columns, components, grows

WORDS, THRESHOLD = 5, 0.8
#: Trees, levels of a label, bytes of a level, and the shortest prefix that is looked at.
TREES, DEPTH, LEVEL, SHORTEST = 16, 6, 2, 2
#: The probability with which two texts of similarity 0.8 must meet, and the members of a node that is not split.
RECALL, SMALL = 0.999, 32
#: Members of a block, by the size n of a bucket or group: bounded, and small enough to spread a hot group.
BUCKET, BLOCK = "512", "greatest(128, least(2048, pow(n, 0.66)))"
#: Estimates below this are more than five standard deviations of 96 hashes off a similarity of 0.8.
DOUBT = 0.58

_RNG = np.random.Generator(np.random.PCG64(20))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_A = _RNG.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def deepest(recall: float, trees: int = TREES, depth: int = DEPTH, similarity: float = THRESHOLD) -> int:
    """The longest prefix at which pairs of this similarity meet in some tree with the target probability."""
    return max((d for d in range(1, depth + 1) if 1 - (1 - similarity**d) ** trees >= recall), default=1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a UTF-8 text, a block of bytes at a time in vectors."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = turns[::2], turns[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64)
    # polynomial hash of each word by differences of running sums over powers that start anew in every word
    lens = end - begin
    at = np.arange(len(raw)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(raw)])))) if begin[0] == 0 else None
    if at is None:
        first = begin[0]
        at = np.concatenate((np.zeros(first, np.int64), np.arange(first, len(raw)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(raw)]))))))
    longest = int(lens.max())
    power = np.cumprod(np.full(longest + 1, _STEP, np.uint64))
    value = _BYTE[raw] * power[np.minimum(at, longest)]
    words = np.add.reduceat(value, np.column_stack((begin, np.minimum(end, len(raw) - 1))).ravel())[::2]
    if end[-1] == len(raw):  # the last word reaches the end, where reduceat has no closing index
        words[-1] = value[begin[-1] :].sum(dtype=np.uint64)
    words = _mix(words + lens.astype(np.uint64))
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(words))):
        out += words[j : j + n] * _ODD[j]
    return np.unique(_mix(out + np.uint64(min(WORDS, len(words)))))


def signature(sh: np.ndarray) -> np.ndarray:
    """Minima of TREES * DEPTH hash functions, as 32-bit numbers; the low bits of equal minima are equal too."""
    out = np.full(TREES * DEPTH, 2**32 - 1, np.uint32)
    for at in range(0, len(sh), 4096):
        x = sh[at : at + 4096]
        h = ((x[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, h.min(axis=1), out=out)
    return out


SIGNED = "doc_id long, th long, class_key binary, label binary, small binary"


def _sign(batches):
    """Class, the labels in all trees one after the other, and the signature cut to one byte a hash."""
    import xxhash

    for b in batches:
        cols: list[list] = [[], [], []]
        for text in b.column(2).to_pylist():
            sh = shingles(text or b"")
            sig = signature(sh)
            values = (xxhash.xxh3_128_digest(sh.tobytes()), sig.astype("<u2").tobytes(), sig.astype(np.uint8).tobytes()) if len(sh) else (None, None, None)
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.binary()) for c in cols]], names=["doc_id", "th", "class_key", "label", "small"])


def _near(batches):
    """Within each bucket of a tree, joins members whose signatures agree well enough; at most one edge a member and block."""
    for t in by_group(batches, ["bucket", "part"]):
        ids = t.column("rep").to_numpy()
        if len(ids) < 2:
            continue
        side = t.column("side").to_numpy()
        sig = np.frombuffer(b"".join(t.column("small").to_pylist()), np.uint8).reshape(len(ids), -1)
        left = np.flatnonzero(side <= 0)
        right = np.flatnonzero(side >= 0) if side.any() else left
        # bits that chance makes agree: 1 of 256
        least = (DOUBT + (1 - DOUBT) / 256) * sig.shape[1]
        tops = np.full(len(ids), -1)
        for i in range(len(ids)):  # breadth first, so that a member is compared with those that have no root yet
            if tops[i] >= 0:
                continue
            tops[i], queue = i, [i]
            while queue:
                j = queue.pop()
                others = left if side[j] > 0 else right
                free = others[tops[others] < 0]
                if not len(free):
                    continue
                met = free[(sig[free] == sig[j]).sum(axis=1) >= least]
                tops[met] = i
                queue += met.tolist()
        own = tops != np.arange(len(ids))
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[tops[own]])], names=["a", "b"])


def _verify(batches):
    """Exact similarities within each pair of blocks of a candidate group: the number of links of each member, and a root."""
    for t in by_group(batches, ["group", "part"]):
        ids, side = t.column("rep").to_numpy(), t.column("side").to_numpy()
        own = bool((side == 0).all())
        sets = [np.frombuffer(x, np.uint64) for x in t.column("sh").to_pylist()]
        size = np.array([len(s) for s in sets], np.float32)
        left, right = (np.arange(len(ids)),) * 2 if own else (np.flatnonzero(side < 0), np.flatnonzero(side > 0))
        if not len(left) or not len(right):
            continue
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in sets])
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        common = np.zeros((len(left), len(right)), np.float32)
        row = np.full((2, len(ids)), -1)
        row[0, left], row[1, right] = np.arange(len(left)), np.arange(len(right))
        often = np.bincount(code, minlength=len(values)) > 1
        new = np.cumsum(often) - 1
        keep = often[code]
        owner, code = owner[keep], new[code[keep]]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        wide = max(64, min(8192, 2**25 // (4 * len(ids))))
        for at in range(0, int(often.sum()), wide):
            lo, hi = np.searchsorted(code, [at, at + wide])
            o, c = owner[lo:hi], code[lo:hi] - at
            x = np.zeros((len(left), wide), np.float32)
            y = np.zeros((len(right), wide), np.float32)
            a, b = row[0, o] >= 0, row[1, o] >= 0
            x[row[0, o[a]], c[a]] = 1
            y[row[1, o[b]], c[b]] = 1
            common += x @ y.T
        union = size[left][:, None] + size[right][None, :] - common
        linked = common.astype(np.float64) * 5 >= union.astype(np.float64) * 4
        if own:
            np.fill_diagonal(linked, False)
        # spanning edges by breadth-first search over the linked pairs
        links = np.zeros(len(ids), np.int64)
        links[left] += linked.sum(axis=1)
        if not own:
            links[right] += linked.sum(axis=0)
        top = np.full(len(ids), -1)
        for i in np.argsort(ids, kind="stable"):
            if top[i] >= 0 or not links[i]:
                continue
            top[i], edge = i, [i]
            while edge:
                fresh = []
                ls = row[0, edge]
                ls = ls[ls >= 0]
                if len(ls):
                    fresh += list(right[linked[ls].any(axis=0)])
                rs = row[1, edge]
                rs = rs[rs >= 0]
                if len(rs):
                    fresh += list(left[linked[:, rs].any(axis=1)])
                edge = [int(j) for j in dict.fromkeys(fresh) if top[j] < 0]
                top[edge] = i
        got = links > 0
        if got.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array(ids[top[got]]), pa.array(links[got])], names=["rep", "top", "links"])


def _shingled(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([shingles(x or b"").tobytes() for x in b.column(2).to_pylist()], pa.binary())],
            names=["rep", "group", "sh"],
        )


def _blocked(scratch: Scratch, df: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Adds `part` and `side`: members of a key dealt to pairs of blocks, so that any two meet in exactly one part.

    The block of a member is its hash modulo the number of blocks; `size`, an expression over the key's count n, says how
    many share a block. A block on the diagonal has side 0, others -1 and 1.
    """
    counts = scratch.keep(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"))
    df = df.join(grows(counts), key)
    blocks = F.ceil(F.col("n") / F.expr(size)).cast("int")
    df = df.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(order), F.col("blocks")).cast("int"))
    dealt = F.expr("transform(sequence(0, blocks - 1), o -> named_struct('part', least(own, o) * blocks + greatest(own, o), 'side', case when o = own then 0 when own < o then -1 else 1 end))")
    return df.withColumn("d", F.explode(dealt)).select("*", "d.part", "d.side").drop("d", "blocks", "own", "n")


def _sized(scratch: Scratch, sets: DataFrame) -> DataFrame:
    """Adds `part` and `side` as `_blocked` does, to sets of shingles by group; blocks whose sets differ too much in size to be linked don't meet.

    Of sets with a similarity of 0.8 one has at most 1.25 times the shingles of the other, so the classes of their sizes, on
    a scale of powers of that, are the same or next to each other. A group that fits into one block is one class.
    """
    sets = sets.withColumn("class", F.floor(F.log(F.greatest(F.length("sh") / 8, F.lit(1))) / math.log(1.2501)).cast("int"))
    counts = sets.groupBy("group", "class").agg(F.count("*").alias("m"))
    of_group, nearby = Window.partitionBy("group"), Window.partitionBy("group").orderBy("class")
    counts = counts.withColumn("n", F.sum("m").over(of_group)).where("n > 1").withColumn("size", F.expr(BLOCK)).withColumn("one", F.col("n") <= F.col("size"))
    beside = lambda by: F.coalesce(F.ceil(F.sum("m").over(nearby.rangeBetween(by, by)) / F.col("size")), F.lit(0))
    plain = lambda c, x: F.when(F.col("one"), x).otherwise(c).cast("long")
    counts = counts.select("group", "class", plain(F.col("class"), 0).alias("at"), plain(F.ceil(F.col("m") / F.col("size")), 1).alias("blocks"), plain(beside(-1), 0).alias("below"), plain(beside(1), 0).alias("above"))
    df = sets.join(grows(scratch.keep(counts)), ["group", "class"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # a part is a pair of classes (the same, or one and the next) and a block of each
    part = lambda pair, a, b: f"shiftleft({pair}, 44) + shiftleft({a}, 22) + {b}"
    dealt = F.expr(f"""
      concat(
        transform(sequence(0L, blocks - 1), o -> named_struct('part', {part('2 * at', 'least(own, o)', 'greatest(own, o)')}, 'side', case when o = own then 0 when own < o then -1 else 1 end)),
        transform(filter(sequence(0L, below), o -> o < below), o -> named_struct('part', {part('2 * at - 1', 'o', 'own')}, 'side', 1)),
        transform(filter(sequence(0L, above), o -> o < above), o -> named_struct('part', {part('2 * at + 1', 'own', 'o')}, 'side', -1)))
    """)
    return df.withColumn("d", F.explode(dealt)).select("rep", "group", "sh", "d.part", "d.side")


def forest(scratch: Scratch, reps: DataFrame) -> DataFrame:
    """(rep, bucket): the nodes under which representatives are compared; reps has rep and label."""
    label = F.expr(f"substring(label, tree * {DEPTH * LEVEL} + 1, {DEPTH * LEVEL})")
    rows = reps.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select("rep", "tree", label.alias("label"))
    node = lambda depth: F.xxhash64("tree", F.expr(f"substring(label, 1, {depth * LEVEL})"))
    settled, deep = [], []
    for depth in range(SHORTEST, DEPTH + 1):
        keyed = rows.withColumn("bucket", node(depth))
        # written before the join, so that both of its sides are plain exchanges and a hot node can be split
        sizes = scratch.keep(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
        found = keyed.join(grows(sizes), "bucket", "inner" if depth == SHORTEST else "left")
        found = scratch.keep(found.select("rep", "tree", "label", "bucket", F.coalesce("n", F.lit(1)).alias("n"), F.lit(depth).alias("depth")))
        stays = found.where((F.col("n") <= SMALL) | (F.col("depth") == DEPTH))
        (settled if depth == SHORTEST else deep).append(stays)
        rows = found.where(F.col("n") > SMALL).select("rep", "tree", "label")
        if depth < DEPTH and rows.isEmpty():
            break
    out = settled[0].select("rep", "bucket")
    if not deep:
        return out
    below = deep[0]
    for more in deep[1:]:
        below = below.union(more)
    # what is missed: the product over trees of the chance not to share the prefix
    here = 1 - THRESHOLD**SHORTEST
    missed = below.groupBy("rep").agg((F.count("*").alias("trees")), F.sum(F.log(1 - F.pow(F.lit(THRESHOLD), "depth"))).alias("miss"))
    short = missed.where(F.exp(F.col("miss") + (TREES - F.col("trees")) * float(np.log(here))) > 1 - RECALL).select("rep")
    limit = deepest(RECALL)
    far = below.where(F.col("depth") > limit).withColumn("up", node(limit))
    asked = far.join(grows(short), "rep", "left_semi").select("up").distinct().withColumn("asked", F.lit(True))
    far = far.join(grows(scratch.keep(asked)), "up", "left").select("rep", F.when(F.col("asked"), F.col("up")).otherwise(F.col("bucket")).alias("bucket"))
    return out.union(below.where(F.col("depth") <= limit).select("rep", "bucket")).union(far)


def _linked(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, th, class_key) of each row, and (class_key, root, n_links, n_copies, first_id) of each class of equal sets."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("th"), F.col("text").cast("string").cast("binary").alias("text"))
    signed = scratch.keep(whole.mapInArrow(_sign, SIGNED).select(F.monotonically_increasing_id().alias("row"), "*"))
    reps = signed.where("class_key is not null").groupBy("class_key").agg(
        F.min(F.struct("row", "doc_id", "th")).alias("of"), F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("label").alias("label"), F.first("small").alias("small")
    )
    reps = scratch.keep(reps.select("class_key", F.col("of.row").alias("rep"), "of.doc_id", "of.th", "first_id", "n_copies", "label", "small"))
    buckets = scratch.keep(forest(scratch, reps.select("rep", "label")).join(grows(reps.select("rep", "small")), "rep"))
    parts = _blocked(scratch, buckets, "bucket", "rep", BUCKET)
    near = parts.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_near, "a long, b long")
    groups = components(scratch, near).withColumnRenamed("root", "group")
    wanted = scratch.keep(groups.withColumnRenamed("id", "rep").join(grows(reps.select("rep", "doc_id", "th")), "rep"))
    texts = grows(wanted).join(whole.withColumnRenamed("doc_id", "id"), ["th"]).where(F.col("doc_id").eqNullSafe(F.col("id"))).select("rep", "group", "text")
    # rows that agree in id and text stand for each other
    sets = texts.mapInArrow(_shingled, "rep long, group long, sh binary").groupBy("rep", "group").agg(F.first("sh").alias("sh"))
    verified = _sized(scratch, scratch.keep(sets)).repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(_verify, "rep long, top long, links long")
    verified = scratch.keep(verified)
    roots = components(scratch, verified.select(F.col("rep").alias("a"), F.col("top").alias("b")))
    links = verified.groupBy("rep").agg(F.sum("links").alias("n_links"))
    classes = reps.select("class_key", "rep", "n_copies", "first_id").join(grows(links), "rep", "left").join(grows(roots.withColumnRenamed("id", "rep")), "rep", "left")
    return signed.select("row", "doc_id", "th", "class_key"), classes.select("class_key", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "first_id")


def _text_key():
    return F.xxhash64(F.col("text").cast("string"), F.col("doc_id").cast("long"))


def match(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, rep_id, n_copies: one row for each input row.

    class_id is the smallest doc_id of what hangs together; n_links counts the other different texts (shingle sets) that
    are similar to this one at 0.8 or more; rep_id is the smallest doc_id of the class of equal sets, which has n_copies rows.
    """
    scratch = Scratch(spark)
    rows, classes = _linked(spark, docs, scratch)
    classes = scratch.keep(classes)
    ids = classes.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = classes.join(grows(ids), "root").drop("root")
    return rows.join(grows(named), "class_key", "left").select(
        "doc_id", F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("rep_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, or a row without if none has one.

    Rows that share an id are told apart by their texts, so none goes but for a copy that stays. Of rows that agree in
    id and text that one stays whose other columns come first as JSON. Rows whose text has no words have no copies and all stay.
    """
    scratch = Scratch(spark)
    rows, classes = _linked(spark, docs, scratch)
    found = rows.join(grows(classes.select("class_key", "root")), "class_key")
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "th")).alias("best"))
    kept = scratch.keep(kept.select(F.col("best.doc_id").alias("id"), F.col("best.th").alias("th")))
    packed = docs.select(F.struct(*columns(docs)).alias("packed"), F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("th"), F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words"))
    same = packed.where("words").join(grows(kept), "th").where(F.col("doc_id").eqNullSafe(F.col("id")))
    others = [F.col("packed")[c] for c in docs.columns if c not in ("doc_id", "text")]
    first = F.to_json(F.struct(F.lit(0).alias("0"), *[c.cast("string").alias(f"c{i}") for i, c in enumerate(others)]))
    stay = same.groupBy("doc_id", "th").agg(F.min_by("packed", first).alias("packed")).select("packed.*")
    return stay.union(packed.where("not words").select("packed.*"))
