"""What a Python worker holds at a time does not grow with the batches that Spark sends."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tabchain.operators import mapping, pieces


@pytest.fixture
def sent(monkeypatch, spark):
    """The functions that are sent to the workers."""
    found = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, fn, schema: found.append(fn) or self)
    return found


def test_slices_hold_every_row_in_order():
    batch = pa.RecordBatch.from_pydict({"k": list(range(9))})
    weights = np.array([3, 3, 3, 20, 0, 0, 9, 1, 1])
    slices = [s.column(0).to_pylist() for s in mapping.row_slices(batch, weights, 9)]
    assert slices == [[0, 1, 2], [3], [4, 5, 6], [7, 8]]
    assert not list(mapping.row_slices(batch.slice(0, 0), np.array([], np.int64), 9))


def test_user_tokenizer_encodes_a_few_rows_at_a_time(spark, sent):
    df = spark.createDataFrame([], "id long, source string, target string")
    mapping.encode_with(df, "id", "source", "target", lambda: lambda text: [ord(c) for c in text], 8)
    texts = ["ab", None, "", "123456789"] * 1000
    batch = pa.RecordBatch.from_pydict({"id": list(range(4000)), "source": pa.array(texts), "target": pa.array(texts[::-1])})
    made = list(sent[0](iter([batch])))
    assert max(b.num_rows for b in made) <= mapping.ROWS_AT_ONCE
    rows = [row for b in made for row in b.to_pylist()]
    assert [r["id"] for r in rows] == list(range(4000))
    assert [r["input_ids"] for r in rows[:4]] == [[97, 98] + [0] * 6, [0] * 8, [0] * 8, list(range(49, 57))]
    assert [sum(r["attention_mask"]) for r in rows[:4]] == [2, 0, 0, 8]
    assert [r["labels"] for r in rows[:2]] == [list(range(49, 57)), [0] * 8]


def test_pieces_are_looked_up_in_bounded_slices(spark, sent, monkeypatch):
    monkeypatch.setattr(pieces, "ITEMS_AT_ONCE", 100)
    vocabulary = spark.createDataFrame([("a", 1, pieces.FIRST_PIECE), (" b", 1, pieces.FIRST_PIECE + 1)], "piece string, n long, piece_id int")
    df = spark.createDataFrame([], "id long, text string")
    pieces.encode_pieces(df, "id", "text", vocabulary)
    lists = [["a", " b", "é"], [], [], ["a"] * 300] * 50
    batch = pa.RecordBatch.from_pydict({"id": list(range(200)), "n_pieces": pa.array([0] * 200, pa.int32()), "ids": pa.array(lists, pa.list_(pa.string()))})
    made = list(sent[0](iter([batch])))
    assert max(sum(len(x) for x in b.column(2).to_pylist()) for b in made) <= 301
    ids = [x for b in made for x in b.column(2).to_pylist()]
    first = pieces.FIRST_PIECE
    spelled = [b + pieces.FIRST_BYTE for b in "é".encode()]
    assert ids == [[first, first + 1, *spelled], [], [], [first] * 300] * 50

    coded = spark.createDataFrame([], "id long, ids array<int>")
    pieces.decode_pieces(coded, "id", "ids", vocabulary)
    back = list(sent[1](iter([pa.RecordBatch.from_pydict({"id": list(range(200)), "text": pa.array(ids, pa.list_(pa.int32()))})])))
    assert len(back) >= 50
    assert [x.decode() for b in back for x in b.column(1).to_pylist()] == ["a bé", "", "", "a" * 300] * 50
