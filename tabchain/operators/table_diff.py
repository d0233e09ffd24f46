"""Comparison of flat tables of any size as multisets of rows.

Digests decide: the number of rows with the sum and the exclusive or of their hashes
is the same for the same rows in any order, needs one pass and no shuffle of rows,
and adds up over tasks. Columns are matched by the digests of their values. What
differs is listed exactly, by counting equal rows of both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabchain.operators.joins import quoted


def _digest(columns: list[Column], name: str) -> list[Column]:
    """Sum and exclusive or over two unlike hashes of the row; NULL has a hash of its own."""
    seen = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    marks = [c.isNull() for c in columns]
    one, two = F.xxhash64(*seen, *marks), F.xxhash64(F.lit(1), *marks, *seen)
    return [
        F.sum(one.cast("decimal(38,0)")).alias(f"{name}_sum"),
        F.bit_xor(one).alias(f"{name}_xor"),
        F.sum(two.cast("decimal(38,0)")).alias(f"{name}_sum2"),
        F.bit_xor(two).alias(f"{name}_xor2"),
    ]


def table_digest(df: DataFrame, columns: list[str] | None = None) -> tuple:
    """Digest of the rows' multiset over columns in the given order."""
    chosen = [F.col(quoted(c)) for c in (columns or df.columns)]
    return tuple(df.agg(F.count("*").alias("n"), *_digest(chosen, "d")).first())


def column_digests(df: DataFrame) -> dict[str, tuple]:
    """Digest of each column's values, all in one pass."""
    parts = [part for k, c in enumerate(df.columns) for part in _digest([F.col(quoted(c))], f"c{k}")]
    row = df.agg(F.count("*").alias("n"), *parts).first()
    return {c: (row[0], *row[1 + 4 * k : 5 + 4 * k]) for k, c in enumerate(df.columns)}


def match_columns(truth: DataFrame, pred: DataFrame) -> dict[str, str]:
    """Truth columns with the prediction's columns that hold the same values.

    Among several of them the one of the same name comes first, then the leftmost that
    is still free.
    """
    have, free = column_digests(truth), column_digests(pred)
    matched = {c: c for c, d in have.items() if free.get(c) == d}
    for c in matched.values():
        free.pop(c)
    for c, digest in have.items():
        if c not in matched and (same := next((p for p, d in free.items() if d == digest), None)) is not None:
            matched[c] = same
            free.pop(same)
    return matched


@dataclass(frozen=True)
class TableMatch:
    """Whether two tables hold the same rows, and how their columns go together."""

    equal: bool
    columns: dict[str, str]
    differences: DataFrame


def compare_tables(truth: DataFrame, pred: DataFrame, by_content: bool = False) -> TableMatch:
    """Truth against prediction, as multisets of rows.

    Columns go together by name, or ``by_content``: by their values first, by name
    otherwise. Tables are equal if every column has a partner and the digests of their
    rows are the same. ``differences`` holds, over the columns that have one, each row
    with other counts on the two sides, ``n_truth`` and ``n_pred``; it is not run here.
    """
    columns = match_columns(truth, pred) if by_content else {}
    taken = set(columns.values())
    columns |= {c: c for c in truth.columns if c not in columns and c in pred.columns and c not in taken}
    columns = {c: columns[c] for c in truth.columns if c in columns}
    whole = len(columns) == len(truth.columns) == len(pred.columns)
    equal = whole and table_digest(truth, list(columns)) == table_digest(pred, list(columns.values()))
    return TableMatch(equal, columns, row_differences(truth, pred, columns))


def row_differences(truth: DataFrame, pred: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows with their counts on both sides, where these differ; equal rows are combined per task first."""
    one = lambda df, names, a, b: df.select(
        *[F.col(quoted(n)).alias(c) for c, n in names], F.lit(a).alias("n_truth"), F.lit(b).alias("n_pred")
    )
    both = one(truth, [(c, c) for c in columns], 1, 0).union(one(pred, list(columns.items()), 0, 1))
    counts = both.groupBy(*[F.col(quoted(c)) for c in columns]).agg(F.sum("n_truth").alias("n_truth"), F.sum("n_pred").alias("n_pred"))
    return counts.where("n_truth <> n_pred")

