"""Between flat rows and nested tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabchain.functions.cells import table_value, text_array, text_cells


def nest_rows(
    df: DataFrame,
    keys: list[str],
    position: str,
    columns: list[str],
    rows_per_table: int,
) -> DataFrame:
    """Tables of at most ``rows_per_table`` rows: ``(*keys, part_no, table)``.

    ``position`` is a whole number that is unique within the keys. A key with
    more rows becomes several tables, one for each range of positions, so no
    group can grow beyond the bound and no single key can fill one task.
    """
    if rows_per_table < 1:
        raise ValueError("rows_per_table must be at least 1")
    part = F.expr(f"`{position}` div {rows_per_table}")
    cells = df.select(
        *keys, part.alias("part_no"), F.col(position).alias("_pos"), F.expr(text_cells(df.schema, columns)).alias("_cells")
    )
    return (
        cells.groupBy(*keys, "part_no")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "_cells"))).alias("_rows"))
        .select(
            *keys,
            "part_no",
            F.expr(table_value(text_array(columns), "_rows._cells")).alias("table"),
        )
    )


def long_cells(df: DataFrame, id_col: str, tables: str, names: str) -> DataFrame:
    """One row per cell, numbered from 1; a narrow projection."""
    return (
        df.select(id_col, F.posexplode(F.arrays_zip(F.col(names).alias("n"), F.col(tables).alias("t"))).alias("_t", "_p"))
        .select(
            id_col,
            (F.col("_t") + 1).alias("table_no"),
            F.col("_p.n").alias("table_name"),
            F.col("_p.t.columns").alias("_columns"),
            F.posexplode("_p.t.rows").alias("_r", "_row"),
        )
        .select(
            id_col,
            "table_no",
            "table_name",
            (F.col("_r") + 1).alias("row_no"),
            "_columns",
            F.posexplode("_row").alias("_c", "value"),
        )
        .select(
            id_col,
            "table_no",
            "table_name",
            "row_no",
            (F.col("_c") + 1).alias("col_no"),
            F.get("_columns", F.col("_c")).alias("col_name"),
            "value",
        )
    )
