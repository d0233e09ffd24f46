"""Token ids in length-delimited binary files, with an offset index beside them.

A data file is a row of records, in ascending id order within and across files:

    length of the payload    unsigned 64 bits, little-endian
    masked checksum of it    unsigned 32 bits
    payload
    masked checksum of it    unsigned 32 bits

A checksum is CRC-32, rotated right by 15 bits and raised by a constant, so that a
checksum of data that holds checksums stays useful. The payload is a header (id,
number of tokens, bytes per token, flags) and the ids in little-endian order. An
index file holds, per record, the id, offset, length, tokens before it in the
file, and flags. The table ``files`` lists the files of the finished job; a reader
takes only what it lists, so what a lost attempt left behind is never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabchain.llm.tokens import encoder, vocabulary_path
from tabchain.operators.mapping import row_slices, text_bytes

END_ID = 1
#: Bytes of text that are encoded at a time.
BYTES_AT_ONCE = 4 << 20
LENGTH, CHECK = struct.Struct("<Q"), struct.Struct("<I")
HEADER = struct.Struct("<qIBB")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("start", "<u8"), ("flags", "u1")])
_MASK = 0xA282EAD8
NULL_ID = 1

FILES_SCHEMA = "file_no int, name string, records long, tokens long"
INDEX_SCHEMA = "file_no int, name string, doc_id long, offset long, length long, start_in_file long"
RECORD_SCHEMA = "file_no int, doc_id long, start_in_file long, n_tokens long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = LENGTH.pack(len(payload))
    return b"".join((length, CHECK.pack(masked(length)), payload, CHECK.pack(masked(payload))))


def unframed(record: bytes) -> bytes:
    """Payload of a record; raises if a checksum or the length doesn't fit."""
    length = record[:8]
    payload = record[12:-4]
    if (
        len(record) < 16
        or CHECK.unpack(record[8:12])[0] != masked(length)
        or LENGTH.unpack(length)[0] != len(payload)
        or CHECK.unpack(record[-4:])[0] != masked(payload)
    ):
        raise ValueError("damaged record")
    return payload


def packed(doc_id: int | None, ids: bytes) -> bytes:
    """Payload of 16-bit ids."""
    flags = NULL_ID if doc_id is None else 0
    return HEADER.pack(doc_id or 0, len(ids) // 2, 2, flags) + ids


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, n, width, flags = HEADER.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", n, HEADER.size)
    return None if flags & NULL_ID else doc_id, ids


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _uri(folder: str) -> str:
    """``file:/x``, as Hadoop writes it, as ``file:///x``."""
    return f"file://{folder[5:]}" if folder.startswith("file:/") and not folder.startswith("file://") else folder


def write_records(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    end_id: int = END_ID,
    files: int | None = None,
) -> None:
    """Encode every whole text, append ``end_id``, write the files under ``folder``.

    ``folder`` is on storage that driver and executors share. Rows are dealt to
    files by ranges of ids, so one source or one group of copies fills no single
    file; equal ids stay together, ordered by text. A task writes under a name of
    its own attempt and renames the whole file at its end, so a lost or doubled
    attempt leaves a whole file of the same content or none. Null texts and empty
    ones hold the end id alone. Rows without an id come first and are marked so.
    No rows give an empty list of files.
    """
    path = path or vocabulary_path()
    folder = _uri(folder)
    end = np.array([end_id], "<u2").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number, attempt = task.partitionId(), task.taskAttemptId()
        system, root = _filesystem(folder)
        words = encoder(path)
        name = f"part-{number:05d}"
        out, index, offset, tokens = None, [], 0, 0
        for batch in batches:
            for part in row_slices(batch, text_bytes(batch.column(1)), BYTES_AT_ONCE):
                for doc_id, text_ids in zip(part.column(0).to_pylist(), words.encode_all(part.column(1)), strict=True):
                    if out is None:
                        system.create_dir(root, recursive=True)
                        out = system.open_output_stream(f"{root}/.{name}.{attempt}.bin")
                    ids = text_ids + end
                    record = framed(packed(doc_id, ids))
                    out.write(record)
                    index.append((doc_id or 0, offset, len(record), tokens, NULL_ID if doc_id is None else 0))
                    offset += len(record)
                    tokens += len(ids) // 2
        if out is None:
            return
        out.close()
        with system.open_output_stream(f"{root}/.{name}.{attempt}.idx") as f:
            f.write(np.array(index, INDEX).tobytes())
        for kind in ("bin", "idx"):
            system.move(f"{root}/.{name}.{attempt}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict(
            {"file_no": [number], "name": [name], "records": [len(index)], "tokens": [tokens]},
            schema=pa.schema([("file_no", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())]),
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")
    dealt.sortWithinPartitions("doc_id", "text").mapInArrow(write, FILES_SCHEMA).write.parquet(f"{folder}/files")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: where it is, from the index files."""
    folder = _uri(folder)
    listed = spark.read.schema(FILES_SCHEMA).parquet(f"{folder}/files")
    arrow = pa.schema(
        [("file_no", pa.int32()), ("name", pa.string()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("start_in_file", pa.int64())]
    )

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        for batch in batches:
            for number, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_stream(f"{root}/{name}.idx") as f:
                    rows = np.frombuffer(f.read(), INDEX)
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * n, pa.int32()),
                        pa.array([name] * n, pa.string()),
                        pa.array(rows["doc_id"], mask=(rows["flags"] & NULL_ID) > 0),
                        *(pa.array(rows[c].astype("i8")) for c in ("offset", "length", "start")),
                    ],
                    schema=arrow,
                )

    # A task per file: the list itself is too small to be spread by its size.
    return listed.repartitionByRange(max(1, listed.count()), "file_no").mapInArrow(entries, INDEX_SCHEMA)


def read_records(spark: SparkSession, folder: str, seed: int | None = None) -> DataFrame:
    """``(file_no, doc_id, start_in_file, n_tokens, ids)``, ids as 32-bit numbers.

    With a seed, records come in an order that a hash of seed and place decides;
    without one, each task reads its records in the order of the files. Every
    checksum is checked.
    """
    folder = _uri(folder)
    index = read_index(spark, folder)
    if seed is not None:
        drawn = F.xxhash64(F.lit(seed), "file_no", "offset")
        index = index.withColumn("drawn", drawn).repartition("drawn").sortWithinPartitions("drawn").drop("drawn")
    arrow = pa.schema(
        [("file_no", pa.int32()), ("doc_id", pa.int64()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    )
    block = 256

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        opened: dict = {}
        for batch in batches:
            for first in range(0, batch.num_rows, block):
                rows = batch.slice(first, block).to_pydict()
                found: list = [[], [], [], [], []]
                places = zip(*(rows[c] for c in ("file_no", "name", "doc_id", "offset", "length", "start_in_file")), strict=True)
                for number, name, doc_id, offset, length, start in places:
                    if name not in opened:
                        if len(opened) >= 64:
                            opened.popitem()[1].close()
                        opened[name] = system.open_input_file(f"{root}/{name}.bin")
                    stored_id, ids = unpacked(unframed(opened[name].read_at(length, offset)))
                    if stored_id != doc_id:
                        raise ValueError(f"index and record differ in {name} at {offset}")
                    for column, value in zip(found, (number, doc_id, start, len(ids), ids.astype("<u4").tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t.type) for v, t in zip(found, arrow, strict=True)], schema=arrow
                )

    return index.mapInArrow(read, RECORD_SCHEMA)


def with_start(records: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Adds ``start``: the ids of all records before, over all files."""
    files = spark.read.schema(FILES_SCHEMA).parquet(f"{_uri(folder)}/files")
    # One row per file: as many as the job had tasks.
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file_no", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    return records.join(F.broadcast(base), "file_no").withColumn(
        "start", F.col("base") + F.col("start_in_file")
    )
