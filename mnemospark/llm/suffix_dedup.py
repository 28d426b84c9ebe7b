"""Removal of repeated 200-byte strings by column-wise construction of collection Burrows-Wheeler transforms.

Every window of `WIDTH` bytes belongs to one anchor, its least `GRAM`-byte string by hash (the leftmost of equals), so
equal windows have equal anchors and only texts around equal anchors need comparing. The windows of an anchor follow
each other; together they are a region of at most 2 * WIDTH bytes.

1. One pass over the texts gives each region's anchor hash and content hash. Anchors that occur once drop out.
   Where all regions of an anchor are equal, all of their windows are repeated; equal here means that two independent
   64-bit hashes agree, one of the anchor and one of the whole region.
2. The other regions, each distinct one once, go to the construction, dealt by anchor. It inserts one symbol of every
   region each round, from the right: a new suffix goes where the transform's counts put it, and its common prefixes
   with its neighbours are one more than the least common prefix between the places they come from. Transform and
   prefixes lie in files that each round reads from front to back and writes anew. At the end, a suffix with a common
   prefix of WIDTH bytes or more begins a repeated window. Regions that share no long core with any other are left out
   before. A construction takes about LOAD bytes, so its files fit in memory too; they lie in a temporary folder of the
   task, which ends with it, and a lost executor's tasks are simply run again.
3. An anchor with many distinct regions is split: its windows are dealt to classes by the anchor's place in them, and
   by the hash of the bytes that all windows of a class have in common; in the limit, by the whole window.

Defined results: null text is empty; a text of fewer than 200 bytes keeps all; repeated rows are documents of their
own, so equal texts of 200 bytes or more lose everything; bytes that aren't UTF-8 are treated as they are; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, by_group, columns, grows

WIDTH, GRAM = 200, 32
#: k-byte strings in a window
PLACES = WIDTH - GRAM + 1
#: Bytes of a text that are hashed at a time, and bytes of regions of a construction.
CHUNK, LOAD = 1 << 17, 1 << 21
#: Distinct regions of an anchor beyond which its windows are split into so many classes.
CLASSES = ((256, 8), (20_000, PLACES))

_RNG = np.random.Generator(np.random.PCG64(3))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWER = np.concatenate(([np.uint64(1)], np.cumprod(np.full(CHUNK + 2 * WIDTH, _BASE, np.uint64))))
_BACK = np.concatenate(([np.uint64(1)], np.cumprod(np.full(CHUNK + 2 * WIDTH, _INVERSE, np.uint64))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _grams(raw: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-byte strings, by differences of running sums."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _POWER[: len(raw)], out=sums[1:])
    n = len(raw) - k + 1
    return _mix((sums[k:] - sums[:n]) * _BACK[:n])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w, by running minima of blocks from both sides."""
    n = len(x)
    m = -(-n // w) * w
    y = np.full(m, np.iinfo(x.dtype).max, x.dtype)
    y[:n] = x
    y = y.reshape(-1, w)
    head = np.minimum.accumulate(y, axis=1).ravel()
    tail = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor's place, anchor's hash) of each region of a chunk, in order."""
    h = _grams(raw, GRAM)
    low = np.uint64((1 << 20) - 1)
    least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), PLACES)
    at = (least & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return first, np.diff(np.concatenate((first, [len(at)]))), at[first], h[at[first]]


REGIONS = "id long, th long, s long, nwin int, place int, ahash long, rhash long"


def _regions(batches):
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if not text or len(text) < WIDTH:
                continue
            raw = np.frombuffer(text, np.uint8)
            for at in range(0, len(raw) - WIDTH + 1, CHUNK):
                part = raw[at : at + CHUNK + WIDTH - 1]
                first, n, place, h = anchors(part)
                view = memoryview(text)
                out[0].append(np.full(len(n), doc))
                out[1].append(np.full(len(n), th))
                out[2].append(first + at)
                out[3].append(n)
                out[4].append(place - first)
                out[5].append(h.view(np.int64))
                ends = (first + n + (at + WIDTH - 1)).tolist()
                digest = xxhash.xxh3_64_intdigest
                out[6].append(np.array([digest(view[i:j]) for i, j in zip((first + at).tolist(), ends, strict=True)], np.uint64).view(np.int64))
        if out[0]:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, kinds, strict=True)], names=["id", "th", "s", "nwin", "place", "ahash", "rhash"])


def _squeeze(batches):
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack.compress(x or b"") for x in b.column(2).to_pylist()], pa.binary())], names=["id", "th", "z"])


PIECES = "gk long, sub long, ahash long, rhash long, off int, nwin int, copies long, bytes binary"


def _cut(batches):
    """The bytes of the regions that a text stands for, split by class where their anchor has many."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out: list[tuple] = []
        for z, wanted in zip(b.column("z").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            text = unpack.decompress(z)
            for r in wanted:
                region = text[r["s"] : r["s"] + r["nwin"] + WIDTH - 1]
                j = 1
                for most, classes in CLASSES:
                    if r["m"] > most:
                        j = classes
                if j == 1:
                    out.append((r["ahash"], r["rhash"], r["ahash"], r["rhash"], 0, r["nwin"], r["copies"], region))
                    continue
                wide = -(-PLACES // j)
                # the anchor stands `place - w` bytes into window w of the region
                for c in range(j):
                    lo, hi = c * wide, min(PLACES, (c + 1) * wide) - 1
                    w0, w1 = max(0, r["place"] - hi), min(r["nwin"] - 1, r["place"] - lo)
                    if w0 > w1 or lo > hi:
                        continue
                    core = region[max(0, r["place"] - lo) : r["place"] - hi + WIDTH]
                    part = region[w0 : w1 + WIDTH]
                    key = xxhash.xxh3_64_intdigest(core, seed=(r["ahash"] ^ c) & (2**64 - 1))
                    sub = xxhash.xxh3_64_intdigest(part, seed=w1 - w0)
                    out.append((_signed(key), _signed(sub), r["ahash"], r["rhash"], w0, w1 - w0 + 1, r["copies"], part))
        cols = list(zip(*out, strict=True)) or [()] * 8
        kinds = (pa.int64(),) * 4 + (pa.int32(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["gk", "sub", "ahash", "rhash", "off", "nwin", "copies", "bytes"])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


class Files:
    """The transform and the common prefixes, each in two files in turn: one is read from front to back while the other is written."""

    def __init__(self, folder: str):
        self.at = [[open(os.path.join(folder, f"{n}{i}"), "w+b", buffering=0) for n in ("bwt", "lcp")] for i in (0, 1)]  # noqa: SIM115
        self.now, self.n, self.kinds = 0, 0, ()

    def load(self) -> list[np.ndarray]:
        out = []
        for f, kind in zip(self.at[self.now], self.kinds, strict=True):
            f.seek(0)
            out.append(np.fromfile(f, kind, self.n))
        return out

    def store(self, *columns: np.ndarray) -> None:
        self.now, self.n, self.kinds = 1 - self.now, len(columns[0]), [x.dtype for x in columns]
        for f, x in zip(self.at[self.now], columns, strict=True):
            f.seek(0)
            x.tofile(f)

    def close(self) -> None:
        for f in sum(self.at, []):
            f.close()


def construct(texts: list[bytes], files: Files) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, common prefixes up to 255, symbols) of a collection. Each text ends in an own least symbol, code 0.

    Round t inserts the suffix of length t of every text that has one. The suffixes after a round are the ends of all
    texts and, for each suffix before it whose preceding symbol is known, that suffix with the symbol in front; so the
    place of a new suffix is the number of texts plus the number of smaller symbols in the transform plus the number
    of equal ones before the place of its tail.
    """
    m = len(texts)
    lens = np.array([len(x) for x in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    symbols, code = np.unique(flat, return_inverse=True)
    kind = np.uint8 if len(symbols) < 256 else np.uint16  # strings that aren't UTF-8 may hold all 256 bytes
    code = (code + 1).astype(kind)
    ends = np.cumsum(lens)
    width = len(symbols) + 1
    files.store(code[ends - 1], np.zeros(m, np.uint8))
    docs, pos = np.arange(m), np.arange(m)  # texts still growing, in the order of their places
    for t in range(1, int(lens.max()) + 1):
        bwt, lcp = files.load()
        n = len(bwt)
        c = bwt[pos].astype(np.int64)
        # places in the order of their symbols: beside each place stand the ones before and after it with the same symbol
        order = np.argsort(bwt, kind="stable")
        at = np.empty(n, np.int64)
        at[order] = np.arange(n)
        total = np.bincount(bwt, minlength=width)
        i = at[pos]
        rank = i - (np.cumsum(total) - total)[c]
        place = m + i - total[0]
        prev = np.where(rank > 0, order[i - 1], -1)
        after = np.where(rank + 1 < total[c], order[np.minimum(i + 1, n - 1)], n)
        low = _least(lcp, prev + 1, pos + 1)
        high = _least(lcp, pos + 1, np.minimum(after, n - 1) + 1)
        # write the new files: old entries keep their order around the new ones
        order = np.argsort(place, kind="stable")
        docs, place = docs[order], place[order]
        fresh = np.zeros(n + len(place), bool)
        fresh[place] = True
        new_bwt, new_lcp = np.empty(len(fresh), kind), np.empty(len(fresh), np.uint8)
        old = ~fresh
        new_bwt[old], new_lcp[old] = bwt, lcp
        left = lens[docs] - t
        new_bwt[place] = np.where(left > 0, code[np.maximum(ends[docs] - t - 1, 0)], 0)
        follows = (rank > 0)[order]
        new_lcp[place] = np.where(follows, np.minimum(low[order].astype(np.int64) + 1, 255), 0)
        leads = (after < n)[order]
        nxt = place[leads] + 1
        new_lcp[nxt] = np.minimum(high[order][leads].astype(np.int64) + 1, 255)
        files.store(new_bwt, new_lcp)
        grows = left > 0
        docs, pos = docs[grows], place[grows]
    bwt, lcp = files.load()
    return bwt, lcp, symbols


def _least(lcp, lo, hi):
    """Minima of lcp[lo:hi] for each pair, where hi > lo; 0 where the range is empty."""
    pairs = np.column_stack((lo, hi)).ravel()
    out = np.minimum.reduceat(np.concatenate((lcp, np.zeros(1, np.uint8))), pairs)[::2]
    return np.where(hi > lo, out, 0)


def repeated(texts: list[bytes], folder: str | None = None) -> list[np.ndarray]:
    """For each text, which of its windows of WIDTH bytes start anywhere else in the collection."""
    flags = [np.zeros(max(0, len(x) - WIDTH + 1), bool) for x in texts]
    with tempfile.TemporaryDirectory(dir=folder) as at:
        files = Files(at)
        bwt, lcp, _ = construct(texts, files)
        files.close()
    n, m = len(bwt), len(texts)
    deep = lcp >= WIDTH
    shared = deep.copy()
    shared[:-1] |= deep[1:]
    # walk from the ends of the texts to their starts: where the symbol before a suffix leads
    back = np.empty(n, np.int64)
    by = np.argsort(bwt, kind="stable")
    back[by[m:]] = np.arange(m, n)
    pos = np.arange(m)
    lens = np.array([len(x) for x in texts])
    alive = np.arange(m)
    for t in range(1, int(lens.max()) + 1):
        pos = back[pos]
        if t >= WIDTH:
            for d in alive[shared[pos]]:
                flags[d][lens[d] - t] = True
        going = lens[alive] > t
        alive, pos = alive[going], pos[going]
    return flags


def _worth(regions: list[bytes]) -> list[tuple[int, int] | None]:
    """The windows of each region, first and last, that may be repeated: those around a core that occurs in another place too.

    A window is kept if every core of WIDTH - 24 bytes in it occurs elsewhere too, as in any repeated window.
    """
    core = WIDTH - 24
    sizes = [len(r) - core + 1 for r in regions]
    hashes = np.concatenate([_grams(np.frombuffer(r, np.uint8), core) for r in regions])
    _, code, n = np.unique(hashes, return_inverse=True, return_counts=True)
    often = (n > 1)[code]
    out, at = [], 0
    for r, size in zip(regions, sizes, strict=True):
        at += size
        last = len(r) - WIDTH
        # a repeated window's cores, from its start to 24 bytes on, are all repeated
        run = np.concatenate(([0], np.cumsum(often[at - size : at])))
        full = np.flatnonzero(run[25:] - run[:-25] == 25) if size >= 25 else np.zeros(0, int)
        full = full[full <= last]
        out.append((int(full[0]), int(full[-1])) if len(full) else None)
    return out


FOUND = "gk long, sub long, lo int, hi int"


def _build(batches):
    """Constructions over whole groups, about LOAD bytes at a time; runs of repeated windows of each region."""
    held, load = [], 0

    def flush():
        cols: list[list] = [[], [], [], []]
        regions = [r[2] for r in held]
        single = [i for i, r in enumerate(held) if r[3] < 2]
        for i, r in enumerate(held):
            if r[3] >= 2:
                for c, v in zip(cols, (r[0], r[1], 0, len(r[2]) - WIDTH + 1), strict=True):
                    c.append(v)
        if single:
            worth = _worth(regions)
            # equal texts of a group enter once, with the number of regions that hold them
            texts: dict[tuple[int, bytes], int] = {}
            of: dict[int, tuple[int, bytes]] = {}
            for i, w in enumerate(worth):
                if w:
                    of[i] = (held[i][0], regions[i][w[0] : w[1] + WIDTH])
                    texts[of[i]] = texts.get(of[i], 0) + held[i][3]
            per = Counter(g for g, _ in texts)
            lone = {k[0] for k, n in texts.items() if n == 1}  # where all texts stand twice, all is known
            # no window occurs twice in one region: its anchor would stand in two places
            use = [k for k in texts if per[k[0]] > 1 and k[0] in lone]
            flags = dict(zip(use, repeated([k[1] for k in use]), strict=True)) if use else {}
            for i in single:
                if i not in of:
                    continue
                f = np.ones(worth[i][1] - worth[i][0] + 1, bool) if texts[of[i]] > 1 else flags.get(of[i])
                if f is None:
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([0], f.view(np.int8), [0]))))
                for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    for c, v in zip(cols, (held[i][0], held[i][1], lo + worth[i][0], hi + worth[i][0]), strict=True):
                        c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["gk", "sub", "lo", "hi"])

    for t in by_group(batches, ["gk"]):
        if load >= LOAD:
            yield flush()
            held, load = [], 0
        for r in zip(*(t.column(c).to_pylist() for c in ("gk", "sub", "bytes", "copies")), strict=True):
            held.append(r)
            load += len(r[2])
    if held:
        yield flush()


def _strip(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the bytes of windows that start in the given runs, and the number of maximal runs removed."""
    keep, at, n = [], 0, 0
    end = -1
    for lo, hi in sorted(spans):
        stop = hi - 1 + WIDTH
        if lo > end:
            keep.append(text[max(at, 0) : lo])
            n += 1
        end = max(end, stop)
        at = end
    keep.append(text[at:])
    return b"".join(keep), n


def _finish(batches):
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        for z, spans in zip(b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
            text = unpack.decompress(z)
            kept, n = _strip(text, [(x["lo"], x["hi"]) for x in spans or ()])
            out.append((len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(cols[4], pa.binary())], names=["id", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _keys() -> list[Column]:
    """id and th together tell documents with different texts apart, null ids included."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("th")]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*_keys(), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def spans(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """id, th, spans: the runs of starts of repeated windows of each document that has any, apart from each other and in order.

    Counts by anchor are written before they are joined, so that both sides of a join are plain exchanges and an anchor
    that very many regions have is split. Runs that overlap are merged in a sorted pass before a document's are collected.
    """
    texts = _keyed(docs)
    regions = scratch.keep(texts.where("octet_length(text) >= %d" % WIDTH).mapInArrow(_regions, REGIONS))
    groups = regions.groupBy("ahash").agg(F.count("*").alias("n"), F.min("rhash").alias("r0"), F.max("rhash").alias("r1")).where("n > 1")
    groups = scratch.keep(groups.select("ahash", (F.col("r0") != F.col("r1")).alias("mixed")))
    hits = scratch.keep(regions.join(grows(groups), "ahash"))
    scratch.drop(regions, groups)
    mixed = hits.where("mixed")
    distinct = mixed.groupBy("ahash", "rhash").agg(F.count("*").alias("copies"), F.min(F.struct("id", "th", "s", "nwin", "place")).alias("rep"))
    distinct = scratch.keep(distinct)
    many = scratch.keep(distinct.groupBy("ahash").agg(F.count("*").alias("m")))
    wanted = distinct.join(grows(many), "ahash").groupBy("rep.id", "rep.th").agg(
        F.collect_list(F.struct("ahash", "rhash", "rep.s", "rep.nwin", "rep.place", "copies", "m")).alias("wanted")
    )
    cut = wanted.join(texts.mapInArrow(_squeeze, "id long, th long, z binary").dropDuplicates(["id", "th"]), ["id", "th"]).mapInArrow(_cut, PIECES)
    cut = scratch.keep(cut)
    one = cut.groupBy("gk", "sub").agg(F.sum("copies").alias("copies"), F.first("bytes").alias("bytes"))
    found = one.repartition("gk").sortWithinPartitions("gk").mapInArrow(_build, FOUND)
    by_region = cut.select("gk", "sub", "ahash", "rhash", "off").join(found, ["gk", "sub"]).select("ahash", "rhash", (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"))
    part = mixed.select("id", "th", "s", "ahash", "rhash").join(grows(scratch.keep(by_region)), ["ahash", "rhash"]).select("id", "th", (F.col("s") + F.col("lo")).alias("lo"), (F.col("s") + F.col("hi")).alias("hi"))
    full = hits.where("not mixed").select("id", "th", F.col("s").alias("lo"), (F.col("s") + F.col("nwin")).alias("hi"))
    by = Window.partitionBy("id", "th").orderBy("lo")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = full.union(part).withColumn("starts", F.coalesce(F.col("lo") > before, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "th", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def remove(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left)."""
    scratch = Scratch(spark)
    found = spans(spark, docs, scratch)
    texts = _keyed(docs).mapInArrow(_squeeze, "id long, th long, z binary")
    out = texts.join(found, ["id", "th"], "left").mapInArrow(_finish, "id long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.nullif("id", F.lit(-(2**63))).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def stripped(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every row with what is left of its text, and n_chars set anew; a character of which some bytes go is dropped whole. Null texts stay null."""
    scratch = Scratch(spark)
    found = spans(spark, docs, scratch)
    row = docs.select(F.struct(*columns(docs)).alias("packed"), F.col("text").cast("string").cast("binary").alias("raw"), *_keys())
    joined = row.join(found, ["id", "th"], "left").select("packed", "raw", "spans")
    shape = docs.schema

    def run(batches):
        for b in batches:
            rows = b.column(0)
            names = shape.names
            cols = [rows.field(i) for i in range(len(names))]
            texts, n = [], []
            for i, (x, s) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if x is not None and s:
                    x = _strip(x, [(y["lo"], y["hi"]) for y in s])[0]
                texts.append(None if x is None else x.decode("utf-8", "ignore"))
                n.append(None if x is None else len(texts[i]))
            for i, name in enumerate(names):
                if name == "text":
                    cols[i] = pa.array(texts, pa.string())
                elif name == "n_chars":
                    cols[i] = pa.array(n, cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, shape)
