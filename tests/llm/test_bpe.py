"""Byte-level BPE against the tiktoken library, and its round trip."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tabchain.llm import byte_bpe
from tabchain.llm.byte_bpe import (
    decode, encode, encode_and_decode, encode_word, merged, pack_list, pack_numbers, ranks_path, reclassified, token_bytes, token_ranks,
    unpack_list, unpack_numbers, words_of,
)
from tabchain.llm.queries import QUERIES

ODD = [
    None, "", " ", "\n\t \n", "a", "It's  we'll DON'T I'd ''s", "x y\x1cz\x85w    q", "éa ́b", "12 3½ ² ٣", "   a   b   ",
    "<|endoftext|>", "日本語 テスト", "\x00\x01", "a_b __ -- ...!?", "😀 x😀y", "word " * 6000, "z" * 20_000, "ab" * 9_000, " " * 5_000,
    "Za՘b ࢏1 \U000323b0x \U00011de0 9",
]


@lru_cache
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_ranks(ranks_path()), special_tokens={}
    )


def expected(text):
    return library().encode_ordinary(text or "")


def own(text):
    pattern = public_tokenizers.PATTERN
    return [k for word in words_of(text, pattern) for k in encode_word(word.encode(), ranks_path(), pattern)]


@pytest.mark.parametrize("k", range(len(ODD)))
def test_odd_texts_have_the_librarys_ids(k):
    assert own(ODD[k]) == expected(ODD[k])


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" 's\n\ta1."), st.characters(max_codepoint=0x17F), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text_has_the_librarys_ids(text):
    assert own(text) == expected(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" 'sltverd\n"), st.characters(max_codepoint=0x7F)), max_size=60))
def test_plain_texts_have_the_librarys_ids(text):
    assert own(text) == expected(text)


def test_pattern_for_plain_texts():
    assert byte_bpe.ascii_pattern(r" ?\p{L}+|[^\s\p{L}\p{N}]|\p{Lu}|[\]\p{N}]") == r" ?[A-Za-z]+|[^\sA-Za-z0-9]|\p{Lu}|[\]0-9]"
    assert words_of("Ab1 é", r"\p{Lu}|\p{N}") == ["A", "1"]


def test_every_character_has_the_librarys_class():
    moved = "".join(map(chr, reclassified()))
    assert own(moved) == expected(moved)
    for start in range(0, 0x110000, 0x4000):
        text = "".join(f"{chr(c)}a1 " for c in range(start, start + 0x4000) if not 0xD800 <= c <= 0xDFFF)
        assert own(text) == expected(text)


def rows(spark):
    values = [(k if k != 3 else None, t, "x", 0) for k, t in enumerate(ODD)] + [(5, ODD[5], "y", 1), (5, "other", "y", 1)]
    return spark.createDataFrame(values, "doc_id long, text string, ids string, block int").repartition(3)


@settings(max_examples=300, deadline=None)
@given(st.text("ab z'", min_size=1, max_size=60))
def test_merges_are_those_of_the_library(word):
    assert merged(word.encode(), token_ranks(ranks_path())) == library()._core_bpe.encode_single_piece(word.encode())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=9)), st.lists(st.integers(0, 2**32 - 1)))
def test_packing_round_trip(values, numbers):
    assert unpack_list(pack_list(values)) == values
    assert unpack_numbers(pack_numbers(np.array(numbers, np.uint32))).tolist() == numbers


@pytest.mark.parametrize(("positions", "parts", "bucket_words"), [(1, 1, 1), (7000, 20, 40), (8_000_000, 1_000_000, 400_000)])
def test_rows_are_encoded_and_decoded(spark, positions, parts, bucket_words):
    docs = rows(spark)
    sizes = {"positions": positions, "part_positions": parts, "bucket_words": bucket_words}
    found = decode(encode(docs, **sizes), positions=positions).collect()
    at_once = encode_and_decode(docs, **sizes).collect()
    got, same = (sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in x) for x in (found, at_once))
    assert got == same
    want = []
    for r in docs.collect():
        ids = expected(r.text)
        want.append((str(r.doc_id), len(ids), np.array(ids, "<u4").tobytes(), (r.text or "").encode()))
    assert got == sorted(want)


def test_no_rows(spark):
    assert decode(encode(rows(spark).limit(0))).count() == 0
    assert encode_and_decode(rows(spark).limit(0)).count() == 0


def test_ids_outside_the_vocabulary_and_null_ids(spark):
    values = [(1, np.array([0, 3_000_000_000], "<u4").tobytes()), (2, None), (3, np.array([0], "<u4").tobytes())]
    encoded = spark.createDataFrame(values, "doc_id long, ids binary")
    found = {r.doc_id: r for r in decode(encoded).collect()}
    assert found[1].decoded is None and found[1].n_tokens == 2 and bytes(found[1].ids) == values[0][1]
    assert bytes(found[2].decoded) == b"" and found[2].n_tokens == 0
    assert bytes(found[3].decoded) == library().decode_bytes([0])


def test_token_table_is_the_vocabulary(spark):
    assert {bytes(r.value): r.id for r in token_bytes(spark).collect()} == token_ranks(ranks_path())


def test_every_distinct_word_is_encoded_once(spark, tmp_path, monkeypatch):
    """The tasks of one job write down what they encode: no word twice."""
    docs = spark.createDataFrame([(k, f"the cat number {k % 7} sat") for k in range(60)], "doc_id long, text string").repartition(6)
    log = str(tmp_path / "log")

    def noted(word):
        with open(log, "ab") as f:
            f.write(word + b"\n")
        return [0]

    run = byte_bpe._encode_buckets
    monkeypatch.setattr(byte_bpe, "_encode_buckets", lambda encode_one: run(noted))
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 6)
    assert sum(r.n_tokens for r in encode(docs, positions=30, bucket_words=3).collect()) == 60 * 5
    words = open(log, "rb").read().split(b"\n")[:-1]
    assert sorted(words) == sorted({f" {k}".encode() for k in range(7)} | {b"the", b" cat", b" number", b" sat"})


def test_query_over_documents(spark, data):
    found = {r.doc_id: r for r in QUERIES["op13_byte_bpe"][0](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        ids = np.array(expected(r.text), "<u4").tobytes()
        text = (r.text or "").encode()
        assert found[r.doc_id].n_tokens == len(ids) // 4
        assert found[r.doc_id].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert found[r.doc_id].decoded_sha256 == hashlib.sha256(text).hexdigest()
