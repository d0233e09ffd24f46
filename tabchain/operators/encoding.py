"""Vocabulary and fixed-length encoding of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabchain.functions.sqltext import lit
from tabchain.functions.text import model_text
from tabchain.operators.assembly import union_sets

#: Runs of letters and digits, or single other marks.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"

# Ids of the special tokens and the label that is not scored.
PAD_ID, BOS_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
SPECIAL_TOKENS = {"<pad>": PAD_ID, "<s>": BOS_ID, "</s>": EOS_ID, "<unk>": UNK_ID}
MASKED_LABEL = -100

MAX_LENGTH = 1024
VOCABULARY_SIZE = 32_000
#: Largest vocabulary that is sent to the executors, in tokens and in bytes.
MAX_VOCABULARY, MAX_VOCABULARY_BYTES = 1_000_000, 64 << 20


def tokens(text: str) -> Column:
    return F.expr(f"regexp_extract_all({model_text(text)}, {lit(TOKEN_PATTERN)}, 0)")


def token_counts(df: DataFrame, text_columns: list[str]) -> DataFrame:
    """Occurrences of each token over whole texts; counted per task first."""
    each = [df.select(F.explode(tokens(c)).alias("token")) for c in text_columns]
    return union_sets(each).groupBy("token").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, text_columns: list[str], size: int = VOCABULARY_SIZE) -> DataFrame:
    """The ``size`` most frequent tokens with their ids; ties by token.

    ``size`` bounds the table, so it may be broadcast and numbered in one task.
    """
    top = token_counts(df, text_columns).orderBy(F.col("n").desc(), "token").limit(size)
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "token"))
    return top.select("token", "n", (rank + len(SPECIAL_TOKENS) - 1).alias("token_id"))


def fixed_length(ids: Column, max_length: int) -> Column:
    """Begin mark, ids, end mark, cut at and padded to ``max_length``."""
    kept = F.slice(ids, 1, max_length - 2)
    padding = F.array_repeat(F.lit(PAD_ID), F.lit(max_length))
    marked = F.concat(F.array(F.lit(BOS_ID)), kept, F.array(F.lit(EOS_ID)), padding)
    return F.slice(marked, 1, max_length)


def attention_mask(n_tokens: Column, max_length: int) -> Column:
    used = F.least(n_tokens + 2, F.lit(max_length))
    return F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(max_length) - used))


def _vocabulary_lists(vocab: DataFrame) -> tuple[list[str], list[int]]:
    """Tokens and ids on the driver; a table beyond the bounds is an error."""
    size = vocab.agg(F.sum(F.octet_length("token"))).first()[0] or 0
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary has at most {MAX_VOCABULARY_BYTES} bytes, not {size}")
    rows = vocab.select("token", "token_id").limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary has at most {MAX_VOCABULARY} tokens")
    return [r.token for r in rows], [r.token_id for r in rows]


def _look_up(df: DataFrame, columns: list[str], keys: pa.Array, values: pa.Array, default: int | str) -> DataFrame:
    """Replace each element of the list columns by the value of its key.

    A narrow step on Arrow batches: the lists are looked up as one flat column
    per batch, so nothing is exploded, shuffled or grouped again.
    """
    places = [df.columns.index(c) for c in columns]
    element = T.StringType() if pa.types.is_string(values.type) else T.IntegerType()
    schema = T.StructType(
        [T.StructField(f.name, T.ArrayType(element)) if f.name in columns else f for f in df.schema]
    )
    sink = pa.BufferOutputStream()
    table = pa.table({"key": keys, "value": values})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    # Once to each executor, not with every task.
    sent = df.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with pa.ipc.open_stream(sent.value) as reader:
            received = reader.read_all()
        keys, values = (received[c].combine_chunks() for c in ("key", "value"))
        for batch in batches:
            arrays = list(batch.columns)
            for i in places:
                lists = arrays[i]
                known = keys.cast(lists.values.type)
                found = values.take(pc.index_in(lists.values, value_set=known))
                arrays[i] = type(lists).from_arrays(lists.offsets, pc.fill_null(found, default))
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def encode_samples(
    df: DataFrame,
    id_col: str,
    source: str,
    target: str,
    vocab: DataFrame,
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """``input_ids, attention_mask, labels`` of a fixed length per sample.

    Texts become tokens, and ids become fixed-length arrays, in Spark
    expressions; only the token lists up to the cut leave the JVM, to be looked
    up in the bounded vocabulary. There is no shuffle. A NULL text is empty.
    """
    text = lambda c: tokens(f"coalesce({c}, '')")
    kept = (
        df.select(id_col, text(source).alias("s"), text(target).alias("t"))
        .select(
            id_col,
            F.size("s").alias("n_source"),
            F.size("t").alias("n_target"),
            F.slice("s", 1, max_length - 2).alias("s"),
            F.slice("t", 1, max_length - 2).alias("t"),
        )
    )
    words, ids = _vocabulary_lists(vocab)
    found = _look_up(kept, ["s", "t"], pa.array(words, pa.string()), pa.array(ids, pa.int32()), UNK_ID)
    return found.select(
        id_col,
        "n_source",
        "n_target",
        fixed_length(F.col("s"), max_length).alias("input_ids"),
        attention_mask(F.col("n_source"), max_length).alias("attention_mask"),
        fixed_length(F.col("t"), max_length).alias("labels"),
    )


def truncation_report(df: DataFrame, texts: list[str], max_length: int = MAX_LENGTH) -> DataFrame:
    """Samples, tokens and tokens lost to the cut, per text column."""
    per_text = union_sets(
        [df.select(F.lit(c).alias("side"), F.size(tokens(c)).alias("n")) for c in texts]
    )
    lost = F.greatest(F.col("n") - (max_length - 2), F.lit(0))
    return per_text.groupBy("side").agg(
        F.count("*").alias("samples"),
        F.sum("n").alias("tokens"),
        F.count_if(lost > 0).alias("cut_samples"),
        F.sum(lost).alias("lost_tokens"),
    )


def unmask_labels(labels: Column) -> Column:
    """Masked labels as padding."""
    return F.transform(labels, lambda x: F.when(x == MASKED_LABEL, F.lit(PAD_ID)).otherwise(x))


def decode_labels(df: DataFrame, id_col: str, labels: str, vocab: DataFrame) -> DataFrame:
    """Text of each label sequence: unmasked, without special tokens."""
    specials = F.array(*[F.lit(i) for i in SPECIAL_TOKENS.values()])
    plain = F.filter(unmask_labels(F.col(labels)), lambda x: ~F.array_contains(specials, x))
    words, ids = _vocabulary_lists(vocab)
    found = _look_up(
        df.select(id_col, plain.alias("text")), ["text"], pa.array(ids, pa.int32()), pa.array(words, pa.string()), ""
    )
    return found.select(id_col, F.array_join(F.filter("text", lambda w: w != ""), " ").alias("text"))
