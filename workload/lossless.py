"""Queries over the encoding that loses nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabchain.operators.encoding import BOS_ID, EOS_ID, PAD_ID
from tabchain.operators.mapping import encode_with
from tabchain.operators.pieces import FIRST_BYTE, FIRST_PIECE, decode_pieces, encode_pieces, piece_vocabulary, windows
from workload.corpora import table
from workload.texts import LENGTH, _model, _pairs

#: Pieces with ids of their own; the rest is spelled in bytes.
PIECES = 8_192


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return piece_vocabulary(table(spark, d, "documents"), ["text"], PIECES)


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    return encode_pieces(table(spark, d, "documents"), "doc_id", "text", _vocabulary(spark, d))


def encode(spark, d):
    """All ids of every document, frequent pieces by number, others in bytes."""
    return _encoded(spark, d).select("doc_id", "n_pieces", F.size("ids").alias("n_ids"), F.array_join("ids", " ").alias("ids"))


def decode(spark, d):
    """Every document encoded and decoded again."""
    return decode_pieces(_encoded(spark, d), "doc_id", "ids", _vocabulary(spark, d))


def encode_windows(spark, d):
    """All ids of every document in windows of a fixed length."""
    found = _encoded(spark, d).select("doc_id", F.posexplode(windows(F.col("ids"), LENGTH)).alias("window_no", "ids"))
    return found.select("doc_id", "window_no", F.array_join("ids", " ").alias("ids"))


def encode_batch_ids(spark, d):
    """Input ids of the fixed-length encoding by a user tokenizer: bytes, moved up by one for the pad id."""
    byte_tokenizer = lambda: lambda text: [b + 1 for b in text.encode("utf-8")]
    encoded = encode_with(_pairs(spark, d), "doc_id", "source", "target", byte_tokenizer, LENGTH)
    return encoded.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("attention_mask", "").alias("attention_mask"))


# RE2 in the patterns below leaves the vertical tab out of white space, which the given texts don't hold.
_PATTERN = r"'\s*[\p{L}\p{N}]+|\s*[^\s\p{L}\p{N}]|\s+'"

_HEX = "hex(encode(piece))"
_BYTES = f"list_transform(range(1, strlen({_HEX}) + 1, 2), lambda p: ('0x' || substr({_HEX}, p::BIGINT, 2))::INTEGER + {FIRST_BYTE})"

_CTE = f"""
docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_PATTERN}) AS t FROM documents),
long AS (SELECT doc_id, unnest(t) AS piece, unnest(range(1, len(t) + 1)) AS p FROM docs),
cnt AS (SELECT piece, count(*) AS n FROM long GROUP BY piece),
vocab AS (SELECT piece, n, (row_number() OVER (ORDER BY n DESC, encode(piece)) + {FIRST_PIECE - 1})::INTEGER AS piece_id
  FROM cnt QUALIFY piece_id < {FIRST_PIECE + PIECES}),
spelled AS (SELECT piece, CASE WHEN piece_id IS NULL THEN {_BYTES} ELSE [piece_id] END AS ids FROM cnt LEFT JOIN vocab USING (piece, n)),
encoded AS (SELECT docs.doc_id, len(t)::INTEGER AS n_pieces, coalesce(e.ids, []) AS ids FROM docs LEFT JOIN
  (SELECT doc_id, flatten(list(ids ORDER BY p)) AS ids FROM long JOIN spelled USING (piece) GROUP BY doc_id) e ON e.doc_id = docs.doc_id)"""

ENCODE_SQL = f"""
WITH {_CTE} SELECT doc_id, n_pieces, len(ids)::INTEGER AS n_ids, array_to_string(ids, ' ') AS ids FROM encoded"""

_ROOM = LENGTH - 2
WINDOWS_SQL = f"""
WITH {_CTE},
w AS (SELECT doc_id, ids, unnest(range(0, greatest(1, (len(ids) + {_ROOM - 1}) // {_ROOM})))::INTEGER AS window_no FROM encoded),
kept AS (SELECT doc_id, window_no, list_concat([{BOS_ID}], list_slice(ids, window_no * {_ROOM} + 1, window_no * {_ROOM} + {_ROOM}), [{EOS_ID}]) AS k FROM w)
SELECT doc_id, window_no, array_to_string(list_concat(k, list_transform(range(len(k), {LENGTH}), lambda x: {PAD_ID})), ' ') AS ids FROM kept"""

ENCODE_BATCH_SQL = f"""
WITH t AS (SELECT doc_id, hex(encode({_model('text')})) AS h FROM documents),
b AS (SELECT doc_id, list_transform(range(1, least(strlen(h), {2 * LENGTH}) + 1, 2), lambda p: ('0x' || substr(h, p::BIGINT, 2))::INTEGER + 1) AS ids FROM t)
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(len(ids), {LENGTH}), lambda x: 0)), ' ') AS input_ids,
  repeat('1', len(ids)) || repeat('0', {LENGTH} - len(ids)) AS attention_mask FROM b"""

QUERIES = {
    "piece_vocabulary": (_vocabulary, f"WITH {_CTE} SELECT piece, n, piece_id FROM vocab"),
    "encode_pieces": (encode, ENCODE_SQL),
    "decode_pieces": (decode, "SELECT doc_id, coalesce(text, '') AS text FROM documents"),
    "encode_windows": (encode_windows, WINDOWS_SQL),
    "encode_batch_ids": (encode_batch_ids, ENCODE_BATCH_SQL),
}
