"""Encoding that loses nothing."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabchain.operators import pieces as p
from tabchain.operators.encoding import BOS_ID, EOS_ID, PAD_ID

TEXTS = [
    None, "", " ", "the cat sat", "the cat  sat on\n\nthe mat ", "\tthe", "é ñandú 日本語 😀x", "a_b--c", "x" * 5000, "the " * 900, "\x00 \x0b\x85 ",
    "the cat sat",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, t, f"n{k}") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id int, s string, ids string").repartition(3)


@pytest.mark.parametrize("size", [0, 1, 3, 1000])
def test_every_text_comes_back(texts, size):
    vocab = p.piece_vocabulary(texts, ["s"], size)
    encoded = p.encode_pieces(texts, "id", "s", vocab)
    back = {r.id: r.text for r in p.decode_pieces(encoded, "id", "ids", vocab).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}


def test_ids_are_pieces_or_bytes(texts):
    vocab = p.piece_vocabulary(texts, ["s"], 3)
    numbers = {r.piece: r.piece_id for r in vocab.collect()}
    cut = lambda t: re.findall(r"[ \t\n\x0b\f\r]*[^\W_]+|[ \t\n\x0b\f\r]*(?:[^\w \t\n\x0b\f\r]|_)|[ \t\n\x0b\f\r]+", t or "")
    counts = Counter(x for t in TEXTS for x in cut(t))
    assert numbers == {x: p.FIRST_PIECE + k for k, (x, _) in enumerate(sorted(counts.items(), key=lambda c: (-c[1], c[0].encode()))[:3])}
    for r in p.encode_pieces(texts, "id", "s", vocab).collect():
        words = cut(TEXTS[r.id])
        want = [i for w in words for i in ([numbers[w]] if w in numbers else [p.FIRST_BYTE + b for b in w.encode()])]
        assert (r.ids, r.n_pieces) == (want, len(words))


def test_encoding_is_narrow(texts):
    encoded = p.encode_pieces(texts.limit(5).coalesce(1), "id", "s", p.piece_vocabulary(texts, ["s"], 5))
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Generate" not in plan


def test_lists_that_start_within_a_batch():
    lists = pa.array([["a"], ["b", "c"], [], ["a", "é"]])[1:]
    assert p._spelled(lists, pa.array(["b"])).to_pylist() == [
        [p.FIRST_PIECE, p.FIRST_BYTE + 99], [], [p.FIRST_BYTE + 97, p.FIRST_BYTE + 0xC3, p.FIRST_BYTE + 0xA9],
    ]
    assert p._joined(pa.array([[0], [1, 0], [], [2]], pa.list_(pa.int32()))[1:], pa.array([b"x", b"yy", b"z"], pa.large_binary())).to_pylist() == [b"yyx", b"", b"z"]


def test_special_ids_stand_for_nothing_and_cut_characters_are_replaced(spark, texts):
    vocab = p.piece_vocabulary(texts, ["s"], 1)
    rows = spark.createDataFrame([(1, [BOS_ID, p.FIRST_PIECE, EOS_ID, PAD_ID]), (2, [p.FIRST_BYTE + 0xC3]), (3, None)], "id int, ids array<int>")
    back = {r.id: r.text for r in p.decode_pieces(rows, "id", "ids", vocab).collect()}
    assert back == {1: vocab.first().piece, 2: "�", 3: ""}


def test_a_vocabulary_that_is_too_large_is_an_error(texts, monkeypatch):
    monkeypatch.setattr(p, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError, match="at most 10"):
        p.encode_pieces(texts, "id", "s", p.piece_vocabulary(texts, ["s"], 5))


@pytest.mark.parametrize("n", [0, 1, 6, 7, 12, 13])
def test_windows_hold_all_ids(spark, n):
    ids = list(range(100, 100 + n))
    made = spark.createDataFrame([(ids,)], "ids array<int>").select(p.windows(F.col("ids"), 8).alias("w")).first().w
    assert all(len(w) == 8 and w[0] == BOS_ID for w in made) and len(made) == max(1, -(-n // 6))
    assert [i for w in made for i in w if i >= 100] == ids
    assert all(w[len([i for i in w if i >= 100]) + 1] == EOS_ID for w in made)
