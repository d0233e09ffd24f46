"""Linear text form of tables.

``<table_name> : t col : a | b row 1 : x | y row 2 : …`` — every function is an
expression over TABLE values, so rendering is a narrow projection.
"""

from __future__ import annotations

from tabchain.functions.cells import strip
from tabchain.functions.sqltext import let, lit, transform, zip_with

# The marks of the linear form.
CELL_MARK = " | "
NAME_MARK = "<table_name> : "
HEADER_MARK = "col : "


def linear_header(columns: str) -> str:
    return f"concat({lit(HEADER_MARK)}, array_join({columns}, {lit(CELL_MARK)}, ''))"


def linear_name(name: str) -> str:
    return f"concat({lit(NAME_MARK)}, {name})"


def linear_row(row: str, number: str) -> str:
    """One row with its 1-based number; NULL cells are empty."""
    return f"concat('row ', CAST({number} AS string), ' : ', array_join({row}, {lit(CELL_MARK)}, ''))"


def linear_rows(rows: str) -> str:
    return f"array_join({transform(rows, lambda r, i: linear_row(r, f'{i} + 1'))}, ' ')"


def linear_table(table: str, name: str | None = None) -> str:
    """Whole table as linear text; without a name the header comes first."""
    start = "NULL" if name is None else f"if({name} != '', {linear_name(name)}, NULL)"
    return let(
        table,
        lambda t: (
            f"if({t} IS NOT NULL, "
            + strip(f"concat_ws(' ', {start}, {linear_header(f'{t}.columns')}, {linear_rows(f'{t}.rows')})")
            + ", NULL)"
        ),
    )


def repair_not_equal(query: str) -> str:
    """Write ``<>`` as ``!=``."""
    return f"replace({query}, '<>', '!=')"


def join_query(query: str, tables_text: str) -> str:
    """Query and tables text with one blank, or whichever is not empty."""
    return f"concat_ws(' ', nullif({repair_not_equal(query)}, ''), {let(tables_text, lambda t: f'''nullif({t}, '')''')})"


def has_cells(table: str) -> str:
    return f"(size({table}.rows) > 0 AND size({table}.columns) > 0)"


def linear_source(query: str, tables: str, names: str) -> str:
    """Query followed by all non-empty tables in linear form."""
    texts = zip_with(tables, names, lambda t, n: f"if({has_cells(t)}, {linear_table(t, n)}, NULL)")
    return join_query(query, f"array_join({texts}, ' ')")


def linear_target(answer: str) -> str:
    """Answer table in linear form; an empty answer gives empty text."""
    return let(answer, lambda t: f"if({has_cells(t)}, {linear_table(t)}, '')")
