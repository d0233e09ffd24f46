"""Aligning, uniting and repairing sets of samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabchain.functions.cells import clean_tables, evaluate_once, table_from_split_json
from tabchain.functions.parsing import parse_multi_source, parse_target
from tabchain.functions.sqltext import let, struct, transform
from tabchain.functions.text import repair_query

# Columns of an earlier encoding that a new corpus drops.
ENCODED_COLUMNS = ("input_ids", "attention_mask", "labels", "decoder_input_ids")


def drop_columns(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """Drop columns; absent ones are no error."""
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def query_text(df: DataFrame) -> str:
    """The question where the set has one, else the query."""
    if "question" in df.columns and "query" in df.columns:
        return "coalesce(question, query)"
    return "question" if "question" in df.columns else "query"


def align(df: DataFrame, drop: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """One set in corpus form: dropped, renamed, without encoded columns."""
    return drop_columns(rename_columns(drop_columns(df, drop or []), rename or {}), ENCODED_COLUMNS)


def union_sets(frames: list[DataFrame]) -> DataFrame:
    """All rows of sets with the same column names."""
    if not frames:
        raise ValueError("no set to unite")
    return reduce(lambda a, b: a.unionByName(b), frames)


def fill_from_text(df: DataFrame) -> DataFrame:
    """Structured fields from the linear text where they are NULL.

    Needs ``query, table_names, tables, answer`` (tables as TABLE values) and
    ``source, target``. The text is parsed once, and only in rows that miss a
    field; ``parse_reason`` says why a text does not fit its form, else it is NULL.
    """
    missing = "query IS NULL OR tables IS NULL OR table_names IS NULL"
    field = lambda p, name: f"if({p} IS NULL, {name}, {p}.{name})"
    record = let(
        f"if({missing}, {parse_multi_source('source')}, NULL)",
        lambda p: let(
            f"if(answer IS NULL, {parse_target('target')}, answer)",
            lambda a: struct(
                **{name: field(p, name) for name in ("query", "table_names", "tables")},
                answer=a,
                parse_reason=f"coalesce({p}.reason, if({a} IS NULL AND target IS NOT NULL, 'broken answer', NULL))",
            ),
        ),
    )
    return evaluate_once(df, record, ("query", "table_names", "tables", "answer", "parse_reason"))


def decode_tables(df: DataFrame, tables: str = "tables", answer: str = "answer") -> DataFrame:
    """Split-JSON text columns as TABLE values."""
    return df.withColumns(
        {
            tables: F.expr(transform(tables, table_from_split_json)),
            answer: F.expr(table_from_split_json(answer)),
        }
    )


def split_rejects(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Good rows without the reason column, and rejects with it."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def alignment_reason(tables: str = "tables", names: str = "table_names") -> Column:
    """Why tables and names do not pair, or NULL."""
    return (
        F.when(F.col(tables).isNull() | F.col(names).isNull(), "missing")
        .when(F.size(tables) != F.size(names), "length mismatch")
        .when(F.exists(tables, lambda t: t.isNull()), "broken table")
    )


def pretraining_sample(df: DataFrame) -> DataFrame:
    """First table only, blank table name, repaired question."""
    return df.withColumns(
        {
            "tables": F.expr(clean_tables("slice(tables, 1, 1)")),
            "table_names": F.array(F.lit("")),
            "question": F.expr(repair_query(query_text(df))),
        }
    )
