"""Token ids, binary records and packing, against the tokenizer and brute force."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabchain.llm.packing import CapacityTree, best_fit, pack, settle
from tabchain.llm.queries import QUERIES
from tabchain.llm.records import framed, packed, read_index, read_records, unframed, unpacked, with_start, write_records
from tabchain.llm.tokens import encoder, vocabulary_path

ODD = [
    None, "", " ", "\n\t", "a", "It's  we'll DON'T I'd", "İstanbul ŉ ſs", "x y\x1cz\x85w", "éa ́b", "12 3½ ² ٣",
    "<|endoftext|> a<|startoftext|>b <|", "ñandú Öl ÀÉ × ÷ ß", "日本語 テスト", "\x00\x01", "a_b __ -- ...!?", "😀 x😀y", "ΣΑΣ ὈΔΥΣΣΕΎΣ",
    "word " * 6000, "z" * 5000,
]


def expected(text):
    return encoder(vocabulary_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


def got(text):
    return np.frombuffer(encoder(vocabulary_path()).encode(text), "<u2").tolist()


@pytest.mark.parametrize("k", range(len(ODD)))
def test_odd_texts_have_the_tokenizers_ids(k):
    assert got(ODD[k]) == expected(ODD[k])


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x17F), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_has_the_tokenizers_ids(text):
    assert got(text) == expected(text)


def test_documents_have_the_tokenizers_ids(spark, data):
    for row in spark.read.parquet(f"{data}/documents.parquet").select("text").collect():
        assert got(row.text) == expected(row.text)


def rows(spark):
    values = [(k if k != 3 else None, t, "x", 0) for k, t in enumerate(ODD)] + [(5, ODD[5], "y", 1), (5, "other", "y", 1)]
    return spark.createDataFrame(values, "doc_id long, text string, ids string, start int").repartition(3)


def test_frame_round_trip_and_damage():
    payload = packed(-7, np.arange(5, dtype="<u2").tobytes())
    record = framed(payload)
    doc_id, ids = unpacked(unframed(record))
    assert (doc_id, ids.tolist()) == (-7, [0, 1, 2, 3, 4])
    for k in range(len(record)):
        broken = bytearray(record)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            unframed(bytes(broken))


@pytest.mark.parametrize("seed", [None, 4])
def test_records_round_trip(spark, tmp_path, seed):
    folder = f"{tmp_path}/records"
    write_records(rows(spark), folder, files=3)
    found = with_start(read_records(spark, folder, seed), spark, folder).orderBy("start").collect()
    want = sorted(((r.doc_id, r.text) for r in rows(spark).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1]))
    start = 0
    assert len(found) == len(want)
    for r, (doc_id, text) in zip(found, want, strict=True):
        ids = [*expected(text), 1]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        start += len(ids)


def test_no_rows(spark, tmp_path):
    empty = rows(spark).limit(0)
    write_records(empty, f"{tmp_path}/none")
    assert read_records(spark, f"{tmp_path}/none").count() == 0
    assert read_index(spark, f"{tmp_path}/none").count() == 0
    assert pack(empty).count() == 0


def test_record_query_over_documents(spark, data):
    got_rows = {r.doc_id: r for r in QUERIES["op4_token_records"][0](spark, data).collect()}
    start = 0
    for doc_id, text in sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()):
        ids = np.array([*expected(text), 1], "<u4")
        r = got_rows.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got_rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 16), max_size=30), st.integers(0, 16))
def test_tree_finds_the_tightest(capacities, need):
    tree = CapacityTree(16)
    for k, c in enumerate(capacities):
        tree.add(c, k)
    fits = [c for c in capacities if c >= need]
    found = tree.take(need)
    assert (found[0] if found else None) == (min(fits) if fits else None)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=40))
def test_packing_is_whole_and_tight(lengths):
    plain = best_fit(lengths, 16)
    windows = settle(plain, 16)
    seen = sorted((doc, at + k) for w in windows for doc, at, n in w for k in range(n))
    assert seen == [(d, k) for d, n in enumerate(lengths) for k in range(n)]
    for w in windows:
        total = sum(p[2] for p in w)
        assert 0 < total <= 16 and (total & (total - 1) == 0)
    assert all(p[2] > 0 for w in windows for p in w)
    # Best fit never opens a window that an earlier one had room for.
    assert len(plain) <= 2 * -(-sum(lengths) // 16) + 1


def check_pieces(found, texts):
    whole, sequences = {}, {}
    for r in found:
        whole.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    return whole, sequences


def test_pack_odd_rows(spark):
    distinct = rows(spark).filter("doc_id is null or doc_id <> 5")
    texts = {r.doc_id: r.text for r in distinct.collect()}
    whole, _ = check_pieces(pack(distinct, block_tokens=4000).collect(), texts)
    assert whole.keys() == texts.keys()
    for doc_id, text in texts.items():
        pieces = sorted(whole[doc_id], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist()
        assert ids == [*expected(text), 2]
        assert {p.doc_tokens for p in pieces} == {len(ids)}


def test_pack_query_over_documents(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = QUERIES["op8_packing"][0](spark, data).collect()
    whole, sequences = check_pieces(found, docs)
    assert whole.keys() == docs.keys()
    for doc_id, text in docs.items():
        ids = np.array([*expected(text), 2], "<u4")
        at = 0
        for p in sorted(whole[doc_id], key=lambda r: r.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids) == p.doc_tokens
    lengths = [sum(r.length for r in s) for s in sequences.values()]
    assert all(n & (n - 1) == 0 for n in lengths)
