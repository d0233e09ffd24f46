"""Sample formatting jobs: structured or linear samples to text pairs.

All of them are narrow projections: one pass over the corpus, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabchain.functions.cells import clean_table, clean_tables, evaluate_once
from tabchain.functions.formats import FORMATS, render_table, rendered_source
from tabchain.functions.linear import linear_source, linear_target
from tabchain.functions.parsing import parse_multi_source, parse_single_source, parse_target
from tabchain.functions.sqltext import let, lit, struct, transform
from tabchain.functions.text import model_text
from tabchain.operators.assembly import alignment_reason, fill_from_text, query_text, split_rejects

#: Table name of single-table samples.
SINGLE_NAME = "table"


def linear_samples(df: DataFrame, null_mode: str = "empty", lower_case: bool = False) -> DataFrame:
    """Samples with ``source`` and ``target`` in linear form."""
    source = linear_source(
        f"coalesce({query_text(df)}, '')", clean_tables("tables", null_mode), "table_names"
    )
    target = f"coalesce({linear_target(clean_table('answer', null_mode))}, '')"
    if lower_case:
        source, target = f"lower({source})", f"lower({target})"
    return df.withColumns({"source": F.expr(source), "target": F.expr(target)})


def _filled(df: DataFrame) -> DataFrame:
    if not {"source", "target"} <= set(df.columns):
        return df.withColumn("reason", alignment_reason())
    filled = fill_from_text(df)
    return filled.withColumn("reason", F.coalesce("parse_reason", alignment_reason())).drop("parse_reason")


def format_multi_table(
    df: DataFrame, table_type: str, null_mode: str = "empty", keep: tuple[str, ...] = ("sample_id",)
) -> DataFrame:
    """Multi-table samples as ``(*keep, source, target)`` in one table type.

    Missing structured fields are parsed from the linear text where the set
    has it. Samples whose tables and names do not pair are left out; see
    :func:`format_rejects`.
    """
    good, _ = split_rejects(_filled(df))
    source, target = _rendered(table_type, null_mode)
    return good.select(*keep, F.expr(source).alias("source"), F.expr(target).alias("target"))


def _rendered(table_type: str, null_mode: str) -> tuple[str, str]:
    render = lambda t: render_table(clean_table(t, null_mode), table_type)
    return rendered_source("coalesce(query, '')", transform("tables", render), "table_names"), render("answer")


def format_outcomes(
    df: DataFrame, table_type: str, null_mode: str = "empty", keep: tuple[str, ...] = ("sample_id",)
) -> DataFrame:
    """``(*keep, source, target, reason)`` of every sample, parsed once.

    What :func:`format_multi_table` makes of the samples that pair, in model form, and
    a reason instead of texts for the others.
    """
    pairs = F.col("reason").isNull()
    source, target = (F.when(pairs, F.expr(model_text(text))) for text in _rendered(table_type, null_mode))
    return _filled(df).select(*keep, source.alias("source"), target.alias("target"), "reason")


def format_rejects(df: DataFrame) -> DataFrame:
    """Samples that cannot be formatted, with the reason."""
    return split_rejects(_filled(df))[1]


def parse_single_samples(df: DataFrame) -> DataFrame:
    """Linear single-table samples with ``query, table, answer, reason``."""
    record = let(
        struct(s=parse_single_source("source"), answer=parse_target("target")),
        lambda p: struct(
            query=f"{p}.s.query",
            table=f"{p}.s.table",
            answer=f"{p}.answer",
            reason=f"coalesce({p}.s.reason, if({p}.answer IS NULL, 'no answer header', NULL))",
        ),
    )
    return evaluate_once(df, record)


def parse_multi_samples(df: DataFrame) -> DataFrame:
    """Linear multi-table samples with ``query, table_names, tables, reason``."""
    return evaluate_once(df, parse_multi_source("source"))


def format_single_table(df: DataFrame, keep: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Linear single-table samples as source and target in all three formats.

    Cells are taken as they are. Malformed samples are left out.
    """
    good, _ = split_rejects(parse_single_samples(df))
    source = lambda t: rendered_source(
        "query", f"array({render_table('table', t)})", f"array({lit(SINGLE_NAME)})"
    )
    columns = []
    for table_type in FORMATS:
        columns.append(F.expr(source(table_type)).alias(f"source_{table_type}"))
        columns.append(F.expr(render_table("answer", table_type)).alias(f"target_{table_type}"))
    return good.select(*keep, *columns)


def model_pairs(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Source and target in model form."""
    return df.withColumns({source: F.expr(model_text(source)), target: F.expr(model_text(target))})
