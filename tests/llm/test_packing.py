"""Packing against the tokenizer library, a gapless layout, and bounds on the number of sequences."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemospark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece int, length long, `a.b` int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute(library, rows):
    """Multiset of (doc_id, piece, start, length, crc) of every piece."""
    out = collections.Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out


def check(spark, library, rows):
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], SCHEMA)
    got = packing.pack(spark, df, PATH).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute(library, rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= 1024
    return by


def test_pieces_and_places(spark, library):
    rng = random.Random(3)
    odd = ["a  b", " a\n b \nc", "x <|endoftext|> y", "日本 é", "it's  the\t\tend ", "", None, "é" * 9000, " " * 6000, "word " * 30000]
    # texts whose tokens with the end come to just under, at and over multiples of 1024
    one = next(w for w in (" the", " and", " of") if len(library.encode(w * 10, add_special_tokens=False).ids) == 10)
    odd += [one * n for n in (0, 1, 1022, 1023, 1024, 2046, 2047, 2048, 3071)]
    odd += ["".join(rng.choice("abc dé\n") for _ in range(rng.randint(0, 9000))) for _ in range(60)]
    rows = list(enumerate(odd)) + [(None, "no id"), (None, None), (3, "again"), (3, "again")]
    check(spark, library, rows)
    encode = packing.Encoder(PATH)
    assert all(encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd if t)


def test_documents_are_packed_tightly(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    by = check(spark, library, rows)
    used = sum(n for placed in by.values() for _, n in placed)
    assert len(by) <= -(-used // 1024) * 1.01 + 1


def test_empty_table(spark):
    assert packing.pack(spark, spark.createDataFrame([], SCHEMA), PATH).count() == 0


def histogram(seed, pieces, times=1):
    """Lengths as a corpus has them: many full pieces, and documents around a few hundred tokens."""
    rng = random.Random(seed)
    h = collections.Counter(min(1024, max(1, int(rng.lognormvariate(6.2, 0.8)))) for _ in range(pieces))
    h[1024] += pieces // 3
    return {n: c * times for n, c in h.items()}


def spread(seed, pieces):
    rng = random.Random(seed)
    return dict(collections.Counter(rng.randint(20, 1024) for _ in range(pieces)))


def whole(plan, h):
    """The number of sequences, after a look that they hold every piece once and none is too long."""
    used = collections.Counter()
    for pattern, times in plan:
        assert times > 0 and sum(n * c for n, c in pattern.items()) <= 1024
        for n, c in pattern.items():
            used[n] += c * times
    assert used == collections.Counter(h)
    return sum(t for _, t in plan)


@pytest.mark.parametrize("h", [histogram(1, 4000), histogram(2, 4000, 200), histogram(3, 40000), spread(1, 200000)])
def test_program_is_near_the_bound(h):
    least = sum(n * c for n, c in h.items()) / 1024
    assert whole(packing.solve(h), h) <= least * 1.001 + len(h)


@pytest.mark.parametrize("h", [histogram(2, 4000, 200), histogram(3, 40000)])
def test_program_is_what_packs(h):
    """Most pieces go by patterns of the program, and no more sequences are needed than by best fit alone."""
    lengths = sorted(n for n in h if n != 1024)
    amounts = packing.program(np.array(lengths), np.array([h[n] for n in lengths], float), 1024)
    rounded = sum(int(v) * sum(lengths[j] * c for j, c in p) for p, v in amounts.items())
    assert rounded >= 0.5 * sum(n * h[n] for n in lengths)
    assert whole(packing.solve(h), h) <= whole(packing.best_fit(dict(h), 1024), h)


@pytest.mark.parametrize("h", [{}, {1024: 3}, {1: 5000}, {513: 100, 512: 30, 511: 50, 100: 5}, {700: 10, 324: 5, 3: 2}])
def test_odd_histograms(h):
    n = whole(packing.solve(h), h)
    assert n <= whole(packing.best_fit(dict(h), 1024), h)


def test_knapsack_finds_the_best():
    rng = random.Random(9)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(1, 40), 6)))
        price = np.array([rng.random() for _ in range(6)])
        best, pick = packing.knapsack(price, lengths, 40)
        reach = np.zeros(41)
        for room in range(1, 41):
            reach[room] = max([reach[room - 1]] + [price[i] + reach[room - n] for i, n in enumerate(lengths) if n <= room])
        assert best == pytest.approx(reach)
        pattern = packing.best_pattern(40, pick, lengths)
        assert sum(lengths[pattern]) <= 40 and sum(price[pattern]) == pytest.approx(best[40])
