"""User functions over a corpus: per row, per batch, and user tokenizers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabchain.functions.text import model_text

#: Rows, and bytes of their texts, that are encoded at a time.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 4 << 20


def map_batches(
    df: DataFrame,
    fn: Callable[..., pd.DataFrame],
    schema: str,
    input_columns: list[str] | None = None,
    **kwargs: Any,
) -> DataFrame:
    """Apply ``fn(batch, **kwargs)`` to Arrow batches of the input columns.

    Only the named columns leave the JVM; the result has just the columns of
    ``schema``, so dropping input columns means leaving them out of it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch, **kwargs)

    return (df.select(*input_columns) if input_columns else df).mapInPandas(run, schema)


def map_rows(
    df: DataFrame,
    fn: Callable[..., dict],
    schema: str,
    input_columns: list[str] | None = None,
    **kwargs: Any,
) -> DataFrame:
    """Apply ``fn(row_dict, **kwargs) -> dict`` to each row, in Arrow batches."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        names = list(batch.columns)
        rows = (fn(dict(zip(names, values)), **kwargs) for values in zip(*(batch[n] for n in names)))
        return pd.DataFrame(list(rows))

    return map_batches(df, run, schema, input_columns)


def text_bytes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, none of a NULL."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def row_slices(batch: pa.RecordBatch, weights: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """All rows of a batch in order, in slices of at most ``most`` weight; a heavier row is a slice of its own."""
    ends = np.cumsum(weights)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode_with(
    df: DataFrame,
    id_col: str,
    source: str,
    target: str,
    make_tokenizer: Callable[[], Callable[[str], list[int]]],
    max_length: int,
    pad_id: int = 0,
) -> DataFrame:
    """Fixed-length encoding with a user tokenizer.

    A NULL text counts as empty. ``make_tokenizer`` runs once per task, so a tokenizer that cannot be
    pickled is built where it is used. A few rows are encoded at a time, so memory doesn't
    grow with the batches that Spark sends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = make_tokenizer()
        pad = lambda x: x + [pad_id] * (max_length - len(x))
        arrays = lambda lists: pa.array(lists, pa.list_(pa.int32()))
        for batch in batches:
            sizes = [text_bytes(batch.column(k)) for k in (1, 2)]
            weights = np.maximum(sum(sizes), BYTES_AT_ONCE // ROWS_AT_ONCE)
            for part in row_slices(batch, weights, BYTES_AT_ONCE):
                ids, labels = ([tokenize(t or "")[:max_length] for t in part.column(k).to_pylist()] for k in (1, 2))
                mask = [[1] * len(x) + [0] * (max_length - len(x)) for x in ids]
                columns = [part.column(0), arrays([pad(x) for x in ids]), arrays(mask), arrays([pad(x) for x in labels])]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "input_ids", "attention_mask", "labels"])

    id_type = df.schema[id_col].dataType.simpleString()
    texts = df.select(
        id_col, F.expr(model_text(source)).alias("source"), F.expr(model_text(target)).alias("target")
    )
    return texts.mapInArrow(
        run, f"{id_col} {id_type}, input_ids array<int>, attention_mask array<int>, labels array<int>"
    )
