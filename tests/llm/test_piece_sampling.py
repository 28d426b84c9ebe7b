"""Sampled segmentations: exact round trips, frequencies against all ways enumerated, and odd rows."""

import collections

import numpy as np
import public_tokenizers
import pytest

from mnemospark.llm import piece_sampling, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return piece_sampling.Lattice(MODEL)


def test_round_trips(lattice):
    odd = ["Hello  world ▁x 梦😀\n\tfoo", " a ", "", "x" * 300, "▁", " \U000f0000 ", "naïve \U000f0001\U000f0002▁▁ b"]
    a = piece_sampling.encode(lattice, list(enumerate(odd)))
    assert [piece_sampling.decode(lattice, x).decode() for x in a] == odd
    again = piece_sampling.encode(piece_sampling.Lattice(MODEL), list(enumerate(odd)))
    assert all((x == y).all() for x, y in zip(a, again, strict=True))
    alone = [piece_sampling.encode(lattice, [row])[0] for row in enumerate(odd)]
    assert all(x.tolist() == y.tolist() for x, y in zip(a, alone, strict=True))
    many = piece_sampling.encode(lattice, [(i, "international") for i in range(400)])
    assert len({tuple(x) for x in many}) > 3


def ways_of(lattice, word):
    """Every segmentation of a word with its probability."""
    ways = {}

    def walk(rest, ids, w):
        if not rest:
            ways[tuple(ids)] = w
        for j in range(1, len(rest) + 1):
            if rest[:j] in lattice.score:
                i, s = lattice.score[rest[:j]]
                walk(rest[j:], [*ids, i], w + lattice.alpha * s)
            elif j == 1:
                walk(rest[1:], [*ids, *lattice.bytes_of(rest[0])], w - piece_sampling.UNKNOWN)

    walk(word, [], 0.0)
    total = sum(np.exp(w) for w in ways.values())
    return {k: np.exp(w) / total for k, w in ways.items()}


@pytest.mark.parametrize("word", ["om", "them", "naïf", "ab\U000f0001"])
def test_sampled_frequencies_follow_the_weights(word):
    lat = piece_sampling.Lattice(MODEL, 0.001)
    n = collections.Counter(tuple(x.tolist()) for x in piece_sampling.encode(lat, [(piece_sampling.key_of(i), word) for i in range(6000)]))
    ways = ways_of(lat, "▁" + word)
    assert set(n) <= set(ways)
    for ids, p in ways.items():
        assert n[ids] / 6000 == pytest.approx(p, abs=0.03)


def test_numbers_are_those_of_the_row_alone():
    keys = np.array([1, 5, 2**64 - 1], np.uint64)
    whole = piece_sampling.uniform(keys, np.array([4, 0, 7]), 17)
    assert whole[:4].tolist() == piece_sampling.uniform(keys[:1], np.array([4]), 17).tolist()
    assert whole[4:].tolist() == piece_sampling.uniform(keys[2:], np.array([7]), 17).tolist()
    many = piece_sampling.uniform(np.arange(200, dtype=np.uint64), np.full(200, 100), 3)
    assert 0 <= many.min() and many.max() < 1 and abs(many.mean() - 0.5) < 0.01 and len(np.unique(many)) == len(many)


def test_rows(spark):
    rows = [(1, "Hello  world", 1), (1, "Hello  world", 2), (2, "", 3), (3, None, 4), (None, "no key", 5), (4, "naïve 梦 ▁" * 50000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    out = piece_sampling.sample(df, ["doc_id"], MODEL, pieces=True).collect()
    assert len(out) == 6 and all(r.lossless for r in out)
    by = {r.doc_id: r for r in out}
    assert by[2].ids == by[3].ids == [] and len({tuple(r.ids) for r in out if r.doc_id == 1}) == 1 and by[4].n_pieces > 400000
    assert piece_sampling.sample(df.where("false"), ["doc_id"], MODEL).count() == 0
    assert piece_sampling.sample(df, ["a.b"], MODEL).count() == 6


def test_pieces_cover_both_tables(spark, tmp_path):
    spark.createDataFrame([(1, "Hello  world"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 0, "Good day")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op10_sentencepiece_sampling(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.conv_id or 0) for r in got) == [(0, 7), (1, 0), (2, 0)]
    assert all(r.lossless for r in got)
