"""Sampled SentencePiece segmentations by forward filtering and backward sampling; lossless decoding.

White space becomes the piece mark, and no piece that is used holds a mark behind another character, so a text's lattice
falls apart at words. The distinct words of about CHUNK characters are worked together, in vectors: a trie of the
pieces, held as one table of transitions, gives all arcs of all their lattices, a character further at a time;
the forward pass sums, place by place from the left, the weights exp(alpha * score) of all ways to each place, as
logarithms; backward, a way is drawn for every occurrence of a word, piece by piece, with the probabilities that the
forward sums give. A row's random numbers come from a counter-based generator keyed by the row's key, so that they do
not depend on how rows are dealt.

Characters that no piece covers, and a literal piece mark, become their UTF-8 bytes, which the vocabulary has; decoding
joins pieces and bytes, turns marks into spaces and drops the one put in front, which gives back every text exactly.

Defined results: null and empty texts have no pieces and decode to an empty text; rows with equal keys and texts are
segmented alike; an empty table gives no rows; other columns are not looked at. Texts are encoded whole; a word of n
characters takes n rounds of the forward pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

MARK = "▁"
#: Sharpness of the distribution: scores of this vocabulary are merge ranks, so differences run to thousands.
ALPHA, SEED = 0.0005, 17
#: The negative logarithm of the weight of a character that no piece covers.
UNKNOWN = 40.0
#: Characters that are encoded together; a longer text goes alone.
CHUNK = 1 << 21
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Stands for a literal piece mark while words are cut: a lone surrogate, which no UTF-8 text holds.
PRIVATE = "\udc00"
#: Bits of a code point in a transition of the trie.
BITS = 21


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. for size[0] numbers, then those from begin[1], and so on."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(begin - before, size)


def uniform(keys: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """sizes[i] numbers of [0, 1) for each key: the i-th of a key is a mix of key, seed and i, whatever the other rows."""
    with np.errstate(over="ignore"):
        start = keys ^ (np.uint64(seed) * np.uint64(0xD1B54A32D192ED03))
        x = np.repeat(start, sizes) + _gather(np.zeros(len(sizes), np.int64), sizes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Lattice:
    """A vocabulary as a trie in arrays; `score` has the pieces that segmentations may use, `alpha` scales their scores."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        byte = {i: int(n[3:5], 16) for i, n in enumerate(names) if sp.is_byte(i)}
        self.alpha, self.size = alpha, len(names)
        self.bytes = {b: i for i, b in byte.items()}
        skip = {i for i in range(len(names)) if i in byte or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        # a piece with a mark behind another character would bind words together
        self.score = {n: (i, max(sp.get_score(i), -60000.0)) for i, n in enumerate(names) if i not in skip and MARK not in n.lstrip(MARK)}
        raw = [bytes([byte[i]]) if i in byte else n.replace(MARK, " ").encode("utf-8", "surrogatepass") for i, n in enumerate(names)]
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.width = np.array([len(x) for x in raw])
        self.begin = np.cumsum(self.width) - self.width
        nodes, piece, weight = {}, [-1], [0.0]
        for n, (i, s) in self.score.items():
            at = 0
            for c in n:
                step = (at << BITS) | ord(c)
                if step not in nodes:
                    nodes[step] = len(piece)
                    piece.append(-1)
                    weight.append(0.0)
                at = nodes[step]
            piece[at], weight[at] = i, alpha * s
        self.piece, self.weight = np.array(piece), np.array(weight)
        # transitions in a hash table of four to eight times their number; -1 marks a free place
        self.bits = max(4, (4 * len(nodes)).bit_length())
        self.steps, self.into = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1)
        at = self._slot(np.array(list(nodes), np.int64)).tolist()
        for h, (step, node) in zip(at, nodes.items(), strict=True):
            while self.steps[h] >= 0:
                h = (h + 1) & ((1 << self.bits) - 1)
            self.steps[h], self.into[h] = step, node

    def _slot(self, step: np.ndarray) -> np.ndarray:
        return ((step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def follow(self, step: np.ndarray) -> np.ndarray:
        """The nodes that transitions lead to, -1 where the trie has none."""
        h = self._slot(step)
        seen = self.steps[h]
        out = np.where(seen == step, self.into[h], -1)
        rest = np.flatnonzero((seen != step) & (seen >= 0))
        while len(rest):
            h[rest] = (h[rest] + 1) & ((1 << self.bits) - 1)
            seen = self.steps[h[rest]]
            hit = seen == step[rest]
            out[rest[hit]] = self.into[h[rest[hit]]]
            rest = rest[~hit & (seen >= 0)]
        return out

    def bytes_of(self, char: str) -> list[int]:
        return [self.bytes[b] for b in (MARK if char == PRIVATE else char).encode("utf-8", "surrogatepass")]

    def arcs(self, code: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, length, piece, log weight) of every piece that stands anywhere in the characters `code`.

        A piece from character i ends at stop[i] at the latest. Where no piece covers a single character, the arc over
        it has the character plus the size of the vocabulary as its piece.
        """
        live, state, k = np.arange(len(code)), np.zeros(len(code), np.int64), 0
        out: list[tuple] = []
        while len(live):
            state = self.follow((state << BITS) | code[live + k])
            if k == 0:
                at = live[(state < 0) | (self.piece[state] < 0)]
                out.append((at, np.ones(len(at), np.int64), code[at] + self.size, np.full(len(at), -UNKNOWN)))
            ok = state >= 0
            live, state = live[ok], state[ok]
            k += 1
            hit = self.piece[state] >= 0
            out.append((live[hit], np.full(int(hit.sum()), k), self.piece[state[hit]], self.weight[state[hit]]))
            more = live + k < stop[live]
            live, state = live[more], state[more]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Choices:
    """The lattices of distinct words. Place p of word w is node first[w] + p; arcs are sorted by the node that they lead to."""

    def __init__(self, lattice: Lattice, words: list[str]):
        size = np.array([len(w) for w in words])
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(size)
        word = np.repeat(np.arange(len(words)), size)
        origin, length, piece, weight = lattice.arcs(code, ends[word])
        self.top = ends + np.arange(len(words))  # the node at a word's end
        source = origin + word[origin]  # one more node than characters in each word
        node = source + length
        place = node - (self.top - size)[word[origin]]
        # by place, node and length, which are all different
        deep, wide = int(length.max()).bit_length(), int(node.max()).bit_length()
        order = np.argsort((((place << wide) | node) << deep) | length)
        source, node, weight, place = source[order], node[order], weight[order], place[order]
        total = np.full(len(code) + len(words), -np.inf)
        total[self.top - size] = 0.0
        fresh = np.concatenate(([True], node[1:] != node[:-1]))
        group = np.cumsum(fresh) - 1
        begin = np.flatnonzero(fresh)
        part = np.empty(len(node))
        cuts = np.searchsorted(place, np.arange(1, int(place[-1]) + 2))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # all nodes at a place at once
            w = total[source[lo:hi]] + weight[lo:hi]
            g = group[lo:hi] - group[lo]
            starts = begin[group[lo] : group[hi - 1] + 1] - lo
            most = np.maximum.reduceat(w, starts)
            part[lo:hi] = np.exp(w - most[g])
            whole = np.add.reduceat(part[lo:hi], starts)
            part[lo:hi] /= whole[g]
            total[node[begin[group[lo] : group[hi - 1] + 1]]] = most + np.log(whole)
        self.first, self.last = np.zeros(len(total), np.int64), np.zeros(len(total), np.int64)
        self.first[node[begin]], self.last[node[begin]] = begin, np.concatenate((begin[1:], [len(node)])) - 1
        self.source, self.piece, self.share = source, piece[order], part
        self.start = np.zeros(len(total), bool)
        self.start[self.top - size] = True

    def draw(self, at: np.ndarray, random: np.ndarray, u_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs of a way through each word of `at`, first to last, and how many each has; word i uses random[u_at[i]:]."""
        live, node, count = np.arange(len(at)), self.top[at], np.zeros(len(at), np.int64)
        steps = []
        while len(live):
            arc, left = self.first[node], random[u_at[live] + len(steps)]
            more = np.arange(len(arc))
            while len(more):  # pass over arcs until their shares reach the random number
                left[more] -= self.share[arc[more]]
                more = more[(left[more] >= 0) & (arc[more] < self.last[node[more]])]
                arc[more] += 1
            steps.append((live, arc))
            count[live] += 1
            node = self.source[arc]
            go = ~self.start[node]
            live, node = live[go], node[go]
        end = np.cumsum(count)
        out = np.empty(int(count.sum()), np.int64)
        for k, (live, arc) in enumerate(steps):  # the k-th drawn is the k-th from the end
            out[end[live] - 1 - k] = arc
        return out, count


def words_of(text: str) -> list[str]:
    if MARK in text:
        text = text.replace(MARK, PRIVATE)
    return WORD.findall(MARK + text.replace(" ", MARK))


def encode(lattice: Lattice, rows: list[tuple[int, str]], seed: int = SEED) -> list[np.ndarray]:
    """Piece ids of each (key, text)."""
    index: dict[str, int] = {}
    at, n_words, n_chars = [], [], []
    for _, text in rows:
        parts = words_of(text) if text else []
        at += [index.setdefault(w, len(index)) for w in parts]
        n_words.append(len(parts))
        n_chars.append(len(text) + 1 if text else 0)
    if not index:
        return [np.zeros(0, np.int64) for _ in rows]
    words = list(index)
    choices = Choices(lattice, words)
    at = np.array(at)
    size = np.array([len(w) for w in words])[at]
    # one random number for each character at most; those of a word follow each other
    random = uniform(np.array([k & (2**64 - 1) for k, _ in rows], np.uint64), np.array(n_chars), seed)
    arcs, count = choices.draw(at, random, np.cumsum(size) - size)
    ids = choices.piece[arcs]
    wide = np.ones(len(ids), np.int64)
    odd = np.flatnonzero(ids >= lattice.size)
    if len(odd):
        chars, which = np.unique(ids[odd], return_inverse=True)
        spelt = [lattice.bytes_of(chr(c - lattice.size)) for c in chars.tolist()]
        lens = np.array([len(s) for s in spelt])
        wide[odd] = lens[which]
        begin = np.cumsum(wide) - wide
        flat = np.repeat(ids, wide)
        flat[_gather(begin[odd], wide[odd])] = np.concatenate([np.array(s) for s in spelt])[_gather((np.cumsum(lens) - lens)[which], lens[which])]
        ids = flat
    row = np.concatenate(([0], np.cumsum(n_words)))
    words_end = np.concatenate(([0], np.cumsum(np.concatenate(([0], np.cumsum(wide)))[np.cumsum(count)] - np.concatenate(([0], np.cumsum(wide)))[np.cumsum(count) - count])))
    return np.split(ids, words_end[row[1:-1]])


def chunks(rows: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """The rows in their order, about CHUNK characters at a time."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[1]) > CHUNK:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield held


def decode(lattice: Lattice, ids: np.ndarray) -> bytes:
    """The UTF-8 text of pieces."""
    ids = np.asarray(ids, np.int64)
    return lattice.blob[_gather(lattice.begin[ids], lattice.width[ids])].tobytes()[1:]


@lru_cache(2)
def lattice(path: str, alpha: float) -> Lattice:
    return Lattice(path, alpha)


def key_of(*parts) -> int:
    return xxhash.xxh3_64_intdigest(repr(parts).encode())


def sample(rows: DataFrame, keys: list[str], model: str, alpha: float = ALPHA, seed: int = SEED, pieces: bool = False) -> DataFrame:
    """The key columns, n_pieces, ids_crc32, lossless, and with `pieces` the ids: one row for each row; nothing is exchanged."""
    at = {c: i for i, c in enumerate(rows.columns)}
    plain = [f"k{i}" for i in range(len(keys))]  # names with dots can't be passed on
    keyed = [columns(rows)[at[k]].alias(p) for k, p in zip(keys, plain, strict=True)]
    kinds = ", ".join(f"{p} {rows.schema[k].dataType.simpleString()}" for k, p in zip(keys, plain, strict=True))
    extra = ", ids array<int>" if pieces else ""

    def run(batches):
        t = lattice(model, alpha)
        for b in batches:
            texts = [x or "" for x in b.column(len(keys)).to_pylist()]
            named = [key_of(*k) for k in zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True)]
            ids, same, crc, sizes = [], [], [], []
            for some in chunks(list(zip(named, texts, strict=True))):  # ids of long texts are let go chunk by chunk
                coded = encode(t, some, seed)
                same += [decode(t, x) == y.encode("utf-8", "surrogatepass") for x, (_, y) in zip(coded, some, strict=True)]
                crc += [zlib.crc32(x.astype("<u4").tobytes()) for x in coded]
                sizes += map(len, coded)
                if pieces:
                    ids += [x.astype(np.int32) for x in coded]
            cols = [*b.columns[: len(keys)], pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            names = [*plain, "n_pieces", "ids_crc32", "lossless"]
            if pieces:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = rows.select(*keyed, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{kinds}, n_pieces long, ids_crc32 long, lossless boolean{extra}")
    return out.toDF(*keys, *out.columns[len(keys) :])
