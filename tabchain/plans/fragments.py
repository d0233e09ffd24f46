"""Text of tables of any size, as ordered fragments.

A table that is too large for one value becomes one fragment of text per row, with its
place. Two passes make it: the first aggregates the width of each column, the second
pads the cells. The fragments in their order, joined by line breaks, are the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabchain.functions.cells import cell_text, text_array, text_cells
from tabchain.functions.formats import HTML_END, html_head, html_row
from tabchain.operators.joins import quoted
from tabchain.operators.positions import with_position


def _cells(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.expr(cell_text(quoted(f.name), f.dataType)), F.lit("")) for f in df.schema.fields]


def column_widths(df: DataFrame) -> dict[str, int]:
    """Characters of the widest cell of each column, in one aggregate; 0 without rows."""
    row = df.agg(*[F.coalesce(F.max(F.length(c)), F.lit(0)).alias(f"w{k}") for k, c in enumerate(_cells(df))]).first()
    return dict(zip(df.columns, row, strict=True))


def _padded(text: Column, width: int, right: bool) -> Column:
    return F.lpad(text, width, " ") if right else F.rpad(text, width, " ")


def markdown_fragments(df: DataFrame, order: str | list[str]) -> DataFrame:
    """``(place, text)`` of a padded pipe table with a leading 0-based index.

    Places 0 and 1 are the header and the rule, then one row each in the given order,
    equal ones by their other columns. Numbers stand to the right, other cells to
    the left; NULL is an empty cell. A text may hold what separates cells, as in the
    nested form.
    """
    rows = with_position(df, order, "_place")
    totals = rows.agg(F.coalesce(F.max("_place"), F.lit(0))).first()[0]
    first = max(2, len(str(totals)))
    widths = column_widths(df)
    right = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    widths = {c: max(w, len(c) + 2) for c, w in widths.items()}
    # The header's and the rule's cells, padded here: there are as many as columns.
    head = " | ".join(c.rjust(w) if right[c] else c.ljust(w) for c, w in widths.items())
    rule = "|".join("-" * (w + 1) + ":" if right[c] else ":" + "-" * (w + 1) for c, w in widths.items())
    top = [(0, f"| {' ' * first} | {head} |"), (1, f"|{'-' * (first + 1)}:|{rule}|")]
    cells = [_padded(cell, widths[c], right[c]) for c, cell in zip(df.columns, _cells(df), strict=True)]
    line = F.concat(F.lit("| "), F.lpad(F.col("_place").cast("string"), first, " "), F.lit(" | "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = rows.select((F.col("_place") + 2).alias("place"), line.alias("text"))
    return df.sparkSession.createDataFrame(top, "place long, text string").unionByName(body)


def html_fragments(df: DataFrame, order: str | list[str]) -> DataFrame:
    """``(place, text)`` of an HTML table with a leading 0-based index.

    Place 0 opens the table, then one row each, and the last place closes it. The
    fragments end where the next one begins: joined by nothing they are the text that
    :func:`tabchain.functions.formats.html_table` makes of a nested table.
    """
    rows = with_position(df, order, "_place")
    cells = text_cells(df.schema, df.columns)
    body = rows.select((F.col("_place") + 1).alias("place"), F.expr(html_row(cells, "_place")).alias("text"))
    last = rows.agg(F.coalesce(F.max("_place") + 2, F.lit(1)).cast("long").alias("place"))
    start = df.sparkSession.range(1).select(F.col("id").alias("place"), F.expr(html_head(text_array(df.columns))).alias("text"))
    return start.unionByName(body).unionByName(last.withColumn("text", F.lit(HTML_END)))
