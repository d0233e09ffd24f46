"""Encoding of texts that loses nothing: frequent pieces, and bytes for the rest.

A text is cut into pieces that cover all of it, each a word or a mark with the white
space before it. The most frequent pieces of the corpus have ids of their own; any
other piece is spelled out in bytes, which have ids too. No id stands for
"unknown", and decoding gives every text back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabchain.functions.sqltext import lit
from tabchain.operators.assembly import union_sets
from tabchain.operators.encoding import BOS_ID, EOS_ID, PAD_ID, SPECIAL_TOKENS
from tabchain.operators.mapping import row_slices

#: Words with the white space before them, single marks likewise, white space at the end.
PIECE_PATTERN = r"\s*[\p{L}\p{N}]+|\s*[^\s\p{L}\p{N}]|\s+"

FIRST_BYTE = len(SPECIAL_TOKENS)
FIRST_PIECE = FIRST_BYTE + 256
#: Bytes of all pieces of a vocabulary together: what is sent to each executor.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pieces, or ids, of the lists that are looked up at a time.
ITEMS_AT_ONCE = 1 << 18


def pieces(text: str) -> Column:
    """Pieces of a text (SQL expression); their concatenation is the text."""
    return F.expr(f"regexp_extract_all({text}, {lit(PIECE_PATTERN)}, 0)")


def piece_vocabulary(df: DataFrame, text_columns: list[str], size: int) -> DataFrame:
    """``(piece, n, piece_id)``: the ``size`` most frequent pieces, ties by piece.

    Pieces are counted per task first, so a frequent one is a row per task. ``size``
    bounds the table.
    """
    each = [df.select(F.explode(pieces(c)).alias("piece")) for c in text_columns]
    counts = union_sets(each).groupBy("piece").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "piece").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "piece"))
    return top.select("piece", "n", (rank + FIRST_PIECE - 1).alias("piece_id"))


class PieceTable:
    """A vocabulary on its way to the executors: once to each, in a broadcast of checked size."""

    def __init__(self, vocabulary: DataFrame):
        size = vocabulary.agg(F.sum(F.octet_length("piece") + 4)).first()[0] or 0
        if size > MAX_VOCABULARY_BYTES:
            raise ValueError(f"a vocabulary of {size} bytes; at most {MAX_VOCABULARY_BYTES} are sent to executors")
        rows = vocabulary.select("piece", "piece_id").orderBy("piece_id").collect()
        if [r.piece_id for r in rows] != list(range(FIRST_PIECE, FIRST_PIECE + len(rows))):
            raise ValueError("ids of pieces don't follow each other")
        sink = pa.BufferOutputStream()
        table = pa.table({"piece": pa.array([r.piece for r in rows], pa.string())})
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.sent = vocabulary.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def pieces(self) -> pa.Array:
        with pa.ipc.open_stream(self.sent.value) as reader:
            return reader.read_all()["piece"].combine_chunks()

    def by_id(self) -> pa.Array:
        """What each id stands for; special tokens stand for nothing."""
        head = [b""] * FIRST_BYTE + [bytes([k]) for k in range(256)]
        return pa.concat_arrays([pa.array(head, pa.large_binary()), self.pieces().cast(pa.large_binary())])


def _list_sizes(lists: pa.ListArray) -> np.ndarray:
    """Items of each list, one at least, so that a slice of empty lists is bounded too."""
    return np.maximum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), 1)


def _spelled(lists: pa.ListArray, known: pa.Array) -> pa.ListArray:
    """Ids of lists of pieces, all of a batch as flat arrays."""
    flat = lists.flatten()
    found = pc.index_in(flat, value_set=known.cast(flat.type))
    is_known = found.is_valid().to_numpy(zero_copy_only=False)
    spelled = flat.cast(pa.binary()).filter(pa.array(~is_known))
    lengths = np.ones(len(flat), np.int64)
    lengths[~is_known] = pc.binary_length(spelled).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], lengths.cumsum()])
    ids = np.empty(ends[-1], np.int32)
    ids[ends[:-1][is_known]] = found.drop_null().to_numpy() + FIRST_PIECE
    rest = np.ones(ends[-1], bool)
    rest[ends[:-1][is_known]] = False
    ids[rest] = np.frombuffer(b"".join(spelled.to_pylist()), np.uint8).astype(np.int32) + FIRST_BYTE
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    offsets = ends[np.concatenate([[0], counts.cumsum()])]
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32()))


def encode_pieces(df: DataFrame, id_col: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """``(id_col, n_pieces, ids)``: every id of every whole text; a NULL text has none.

    Texts are cut into pieces in Spark expressions; the lists are looked up on Arrow
    batches, so nothing is exploded or shuffled.
    """
    table = PieceTable(vocabulary)
    rows = df.select(F.col(id_col), pieces(f"coalesce({text}, '')").alias("ids"))
    rows = rows.select(id_col, F.size("ids").alias("n_pieces"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.pieces()
        for batch in batches:
            for part in row_slices(batch, _list_sizes(batch.column(2)), ITEMS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([*part.columns[:2], _spelled(part.column(2), known)], names=part.schema.names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _joined(lists: pa.ListArray, by_id: pa.Array) -> pa.Array:
    """Bytes of each list: the taken values lie side by side, so only offsets are made."""
    taken = by_id.take(lists.flatten())
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)
    counts = pc.list_value_length(pc.fill_null(lists, [])).to_numpy(zero_copy_only=False)
    offsets = ends[np.concatenate([[0], counts.cumsum()])]
    joined = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), taken.buffers()[2]])
    return joined.cast(pa.binary())


def decode_pieces(df: DataFrame, id_col: str, ids: str, vocabulary: DataFrame, name: str = "text") -> DataFrame:
    """``(id_col, name)``: the text of each list of ids, special tokens left out.

    A list that was cut within a character ends in a replacement character. An id
    beyond the vocabulary is an error.
    """
    table = PieceTable(vocabulary)
    rows = df.select(F.col(id_col), F.coalesce(ids, F.array().cast("array<int>")).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = table.by_id()
        for batch in batches:
            for part in row_slices(batch, _list_sizes(batch.column(1)), ITEMS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([part.column(0), _joined(part.column(1), by_id)], names=part.schema.names)

    found = rows.mapInArrow(run, T.StructType([rows.schema.fields[0], T.StructField(name, T.BinaryType())]))
    return found.withColumn(name, F.make_valid_utf8(F.col(name).cast("string")))


def windows(ids: Column, max_length: int) -> Column:
    """All ids as windows of a fixed length, each with its marks, the last one padded.

    Nothing is cut off: a text of ``n`` ids has ``ceil(n / (max_length - 2))`` windows,
    one at least.
    """
    room = max_length - 2
    count = F.greatest(F.lit(1), F.ceil(F.size(ids) / F.lit(room)).cast("int"))

    def window(k: Column) -> Column:
        kept = F.concat(F.array(F.lit(BOS_ID)), F.slice(ids, k * room + 1, F.lit(room)), F.array(F.lit(EOS_ID)))
        return F.concat(kept, F.array_repeat(F.lit(PAD_ID), F.lit(max_length) - F.size(kept)))

    return F.transform(F.sequence(F.lit(0), count - 1), window)
