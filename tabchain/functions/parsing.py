"""Parsing linear text back into TABLE values.

Every parser is one expression; text that does not fit the form gives a
``reason`` instead of an exception, so malformed samples become reject rows.
Rows are cut at `` row <digits> : `` and only that prefix is removed, so a
cell may hold ``": "`` or the word "row".
"""

from __future__ import annotations

from tabchain.functions.cells import empty_table, strip, table_value
from tabchain.functions.sqltext import exists, forall, let, lit, struct, tail, transform

# The marks that separate the parts of linear text.
ROW_PATTERN = " row [0-9]+ : "
CELL_PATTERN = " [|] "
HEADER_SPLIT = " col : "
TABLE_SPLIT = " <table_name> "


def _cells(text: str) -> str:
    return transform(f"split({text}, {lit(CELL_PATTERN)})", strip)


def _table(body: str) -> str:
    """TABLE from the text after the header mark: header, then numbered rows."""
    pieces = f"split(concat({body}, ' '), {lit(ROW_PATTERN)})"
    return let(pieces, lambda p: table_value(_cells(f"get({p}, 0)"), transform(tail(p), _cells)))


def _header_parts(text: str) -> str:
    """Text before and after the first header mark."""
    return f"split({text}, {lit(HEADER_SPLIT)}, 2)"


def _after_header(parts: str) -> str:
    return f"if(size({parts}) = 2, {_table(f'get({parts}, 1)')}, NULL)"


def _widths_fit(table: str) -> str:
    return forall(f"{table}.rows", lambda r: f"size({r}) = size({table}.columns)")


def parse_target(text: str) -> str:
    """``col : a | b row 1 : …`` to TABLE; NULL without a header or with a row of other width.

    A header without rows gives a table without rows; empty text gives a table
    without columns and rows.
    """
    read = let(_header_parts(f"concat(' ', {text})"), _after_header)
    table = let(read, lambda t: f"if({t} IS NULL OR {_widths_fit(t)}, {t}, NULL)")
    return f"if({strip(text)} = '', {empty_table()}, {table})"


def parse_single_source(text: str) -> str:
    """Single-table source to ``struct(query, table, reason)``.

    ``reason`` is NULL when the text fits the form.
    """
    parsed = let(
        _header_parts(f"concat(' ', {text})"),
        lambda p: struct(query=strip(f"get({p}, 0)"), table=_after_header(p)),
    )
    return let(
        parsed,
        lambda s: struct(
            query=f"{s}.query",
            table=f"{s}.table",
            reason=f"CASE WHEN {s}.table IS NULL THEN 'no header' WHEN NOT {_widths_fit(f'{s}.table')} THEN 'row width' END",
        ),
    )


def parse_multi_source(text: str) -> str:
    """Multi-table source to ``struct(query, table_names, tables, reason)``."""
    one = lambda piece: let(
        _header_parts(piece),
        lambda p: struct(
            name=strip(f"regexp_replace(get({p}, 0), '^: ', '')"), table=_after_header(p)
        ),
    )
    parsed = let(
        f"split(concat(' ', {text}), {lit(TABLE_SPLIT)})",
        lambda p: struct(query=strip(f"get({p}, 0)"), parts=transform(tail(p), one)),
    )
    return let(
        parsed,
        lambda s: struct(
            query=f"{s}.query",
            table_names=f"{s}.parts.name",
            tables=f"{s}.parts.table",
            reason=(
                f"CASE WHEN size({s}.parts) = 0 THEN 'no table' "
                f"WHEN {exists(f'{s}.parts', lambda t: f'{t}.table IS NULL')} THEN 'no header' "
                f"WHEN {exists(f'{s}.parts', lambda t: f'''NOT {_widths_fit(f'{t}.table')}''')} THEN 'row width' END"
            ),
        ),
    )
