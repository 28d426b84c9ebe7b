"""Best-fit packing of token sequences by a configuration linear program.

The lengths of all pieces form a histogram of at most `capacity` entries, which is all that reaches the driver.
A covering program over patterns (multisets of lengths that fit into one sequence) is solved by multiplicative
weights: each round prices the lengths by their weights, a knapsack dynamic program finds the best patterns, these are
used up to a share of the stock of their scarcest length, and lengths that are covered beyond the others lose weight.
Multiplicative updates of the amounts then bring the coverage of every length close to its stock. The amounts are
rounded down; where a length has run out, its room in a pattern goes to the longest pieces that fit, and what no whole
pattern takes is packed best fit in decreasing order. Pieces then find their places by their rank within their length.

Defined results: null text packs as an empty document, i.e. as its end token alone; equal documents are packed
each on their own; an empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, grows

CAPACITY, END = 1024, 2
#: Fixed value: how byte-level tokenizers of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rounds of weights, the share of a need that a round may cover, how fast weights fall, how far from the best price a
#: pattern may be, and updates of the amounts.
ROUNDS, SHARE, RATE, SLACK, FITS = 400, 0.02, 0.01, 0.01, 1500
#: Ranks within a length are counted in so many groups, so that no length gathers in one task.
SALTS = 256


class Encoder:
    """Ids of a byte-level BPE tokenizer.

    Texts of Latin letters and ASCII go through the same vocabulary in ranked form, whose encoder is several times
    faster; tests compare whole texts with the library. Texts with characters beyond these, with special tokens, or
    with very long runs of one kind of character go through the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # printable bytes stand for themselves in the vocabulary, the others for characters from 256 on; ids are merge ranks
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(back[c] for c in w): i for w, i in self.library.get_vocab(with_added_tokens=False).items() if w not in special}
        self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("|".join(["[^\x00-\u024f]", *map(re.escape, special)]))
        self.run = re.compile(r"(?<!\S)\S{4096}|(?<!\s)\s{4096}")

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.odd.search(text) or self.run.search(text):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.asarray(self.ranked.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes()


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("salt", T.IntegerType())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece. Documents of more than `capacity` tokens are cut so that all pieces but the first are full."""

    def run(batches):
        encode, tail = encoder(tokenizer), np.asarray([end], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + tail
                n = len(ids) // 4
                at, k = 0, 0
                size = n if n <= capacity else n % capacity or capacity
                while at < n:
                    crc = zlib.crc32(ids[4 * at : 4 * (at + size)])
                    out.append((doc, k, at, size, crc, ((doc or 0) * 31 + k * 7919) * 2654435761 % 2**32 % SALTS))
                    at, k, size = at + size, k + 1, capacity
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=PIECES.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest total price by room, and the index of the length to take first there (-1: leave one token free)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        n = fitting[room]
        value = price[:n] + best[room - lengths[:n]]
        i = int(value.argmax())
        best[room] = best[room - 1]
        if value[i] > best[room]:
            best[room], pick[room] = value[i], i
    return best, pick


def best_pattern(room: int, pick: np.ndarray, lengths: np.ndarray) -> list[int]:
    """The lengths, by index and with repeats, that a knapsack table takes for a room."""
    out = []
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            out.append(int(pick[room]))
            room -= int(lengths[pick[room]])
    return out


def program(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS, share: float = SHARE, rate: float = RATE, slack: float = SLACK, fits: int = FITS) -> dict[tuple[tuple[int, int], ...], float]:
    """Amounts of patterns that cover each length about as often as needed; a pattern is ((index of a length, count), ..).

    A pattern is taken in a round if its price is within `slack` of the best one's, and in such an amount that no
    length is covered more than `share` of its need in the round. Weights fall exponentially with what a length is
    covered beyond the mean.
    """
    mass = need * lengths / (need @ lengths)
    have, weight = np.zeros(len(need)), np.ones(len(need))
    used: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(rounds):
        price = lengths / capacity * weight
        best, pick = knapsack(price, lengths, capacity)
        with_one = price + best[capacity - lengths]  # the best pattern that holds a given length
        good = np.flatnonzero(with_one >= best[capacity] * (1 - slack))
        room = share * need
        for i in good[np.argsort(have[good] / need[good], kind="stable")].tolist():
            if room[i] <= 0:
                continue
            pattern = Counter([i, *best_pattern(int(capacity - lengths[i]), pick, lengths)])
            amount = min(room[j] / c for j, c in pattern.items())
            if amount > 1e-9 * need[i]:
                key = tuple(sorted(pattern.items()))
                used[key] = used.get(key, 0.0) + amount
                for j, c in pattern.items():
                    room[j] -= c * amount
                    have[j] += c * amount
        covered = have / need
        weight = np.exp(np.clip(-rate * (covered - covered @ mass) / share, -8, 8))
    # amounts such that the mean length is covered once, then multiplied until each is
    patterns = list(used)
    amount = np.array([used[p] for p in patterns]) / ((have / need) @ mass)
    of = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    item = np.array([j for p in patterns for j, _ in p])
    count = np.array([c for p in patterns for _, c in p], float)
    part = count * lengths[item]
    whole = np.bincount(of, part)
    for _ in range(fits):
        covered = np.bincount(item, count * amount[of], len(need)) / need
        amount = amount * np.exp(-np.bincount(of, part * np.log(np.maximum(covered, 1e-9))[item]) / whole)
    return dict(zip(patterns, amount.tolist(), strict=True))


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) whose patterns take every piece exactly once. A pattern maps lengths to counts."""
    stock = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[dict[int, int], int]] = []
    if capacity in stock:
        out.append(({capacity: 1}, stock.pop(capacity)))
    if not stock:
        return out
    lengths = sorted(stock)
    amounts = program(np.array(lengths), np.array([stock[n] for n in lengths], float), capacity)
    order = list(lengths)
    for pattern, amount in sorted(amounts.items(), key=lambda p: (-int(p[1]), p[0])):
        times = int(amount)
        while times > 0:
            taken = {lengths[j]: min(c, stock[lengths[j]]) for j, c in pattern if stock[lengths[j]]}
            if not taken:
                break
            if sum(n * c for n, c in taken.items()) < sum(lengths[j] * c for j, c in pattern):
                order = [n for n in order if stock[n]]
                fill(taken, stock, order, capacity)
            k = min(times, *(stock[n] // c for n, c in taken.items()))
            for n, c in taken.items():
                stock[n] -= c * k
            out.append((taken, k))
            times -= k
    return out + best_fit(stock, capacity)


def fill(pattern: dict[int, int], stock: dict[int, int], order: list[int], capacity: int) -> None:
    """Adds the longest pieces of the stock that still fit, as often as it allows; order has the lengths in stock, rising."""
    room = capacity - sum(n * c for n, c in pattern.items())
    i = bisect.bisect_right(order, room) - 1
    while i >= 0 and room:
        n = order[i]
        take = min(stock[n] - pattern.get(n, 0), room // n)
        if take > 0:
            pattern[n] = pattern.get(n, 0) + take
            room -= take * n
        i = min(i, bisect.bisect_right(order, room)) - 1


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Opens a sequence with the longest piece that is left and fills it with the longest that fit, as often as the stock allows."""
    stock = {n: c for n, c in left.items() if c > 0}
    order, out = sorted(stock), []
    while order:
        pattern: dict[int, int] = {}
        fill(pattern, stock, order, capacity)
        times = min(stock[n] // c for n, c in pattern.items())
        for n, c in pattern.items():
            stock[n] -= c * times
            if not stock[n]:
                order.pop(bisect.bisect_left(order, n))
        out.append((pattern, times))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count in a sequence, first sequence, offset in it) for each length of each pattern."""
    rows, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in solve(histogram, capacity):
        at = 0
        for n in sorted(pattern, reverse=True):
            rows.append((n, taken[n], pattern[n], sequence, at))
            taken[n] += pattern[n] * times
            at += n * pattern[n]
        sequence += times
    return rows


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document, once.

    The plan has some ten thousand entries whatever the input (at most one pattern for each length and round, and one for
    each length that runs out) and is broadcast for that reason, after a look at its size. Pieces are partitioned by length
    and salt once, for their ranks, and meet the counts of those before them in the same partitions.
    """
    scratch = Scratch(spark)
    rows = scratch.keep(pieces(docs, tokenizer, capacity, end))
    counts = scratch.keep(rows.groupBy("length", "salt").count())
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    slots = plan(histogram, capacity)
    if len(slots) > capacity * (4 * ROUNDS + 64) or len(histogram) > capacity:
        raise ValueError("the plan is larger than its bound")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = rows.withColumn("k", F.row_number().over(within) - 1).join(grows(base), ["length", "salt"])
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, first, count, sequence, at in slots:
        by.setdefault(n, []).append((first, count, sequence, at))
    ranges = spark.createDataFrame(
        [(n, [(a, b, c, d) for a, b, c, d in sorted(v)]) for n, v in by.items()],
        "length long, slots array<struct<first:long,count:long,sequence:long,at:long>>",
    )
    r = F.col("base") + F.col("k")
    # the last slot whose first rank is not beyond r; arrays are short, and read without a row for each entry
    placed = ranked.join(F.broadcast(ranges), "length").withColumn("r", r).withColumn("slot", F.expr("element_at(filter(slots, s -> s.first <= r), -1)"))
    j = F.col("r") - F.col("slot.first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.floor(j / F.col("slot.count"))).cast("long").alias("sequence_id"),
        (F.col("slot.at") + F.pmod(j, F.col("slot.count")) * F.col("length")).cast("long").alias("offset"),
    )
