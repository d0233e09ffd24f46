"""The nested TABLE value and the cleaning of its cells.

A TABLE is ``struct<columns:array<string>, rows:array<array<string>>>``: one
row of a corpus carries its tables as values, so samples with different
columns live in one DataFrame and every operation on them is a column
expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from tabchain.functions.sqltext import exists, forall, let, lit, transform

TABLE_DDL = "struct<columns:array<string>,rows:array<array<string>>>"
SPLIT_JSON_DDL = "columns array<string>, data array<array<string>>"

# The characters that text stripping removes.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: the timestamp format of cleaned cells.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

NULL_MODES = ("empty", "literal")


def evaluate_once(df: DataFrame, record: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the fields of a struct expression that is costly to compute.

    The struct is evaluated by a one-row generator. Filters and projections
    above it read its fields, and the optimizer cannot copy the expression
    into each of them.
    """
    kept = [f"`{c}`" for c in df.columns if c not in drop]
    return df.selectExpr(*kept, f"inline(array({record}))")


def strip(text: str) -> str:
    """Remove all leading and trailing whitespace, not only blanks."""
    return f"btrim({text}, {lit(STRIP_CHARS)})"


def number_text(value: str) -> str:
    """Text of a double: plain digits up to 16 places, exponent form beyond.

    A cast to string switches to exponent form at ten million already, which
    would make the text of one number depend on its neighbours' size.
    """

    def expand(p: str) -> str:
        sign = f"if({p} LIKE '-%', '-', '')"
        # Digits without the point, and the power of ten of the first digit.
        parts = let(
            f"regexp_extract({p}, '^-?([0-9]+[.][0-9]+)E', 1)",
            lambda m: (
                f"named_struct('d', concat(split_part({m}, '.', 1), regexp_replace(split_part({m}, '.', 2), '^0$', '')), "
                f"'e', try_cast(regexp_extract({p}, 'E(-?[0-9]+)$', 1) AS int))"
            ),
        )
        large = lambda s: (
            f"if(length({s}.d) <= {s}.e + 1, concat(rpad({s}.d, {s}.e + 1, '0'), '.0'), "
            f"concat(substr({s}.d, 1, {s}.e + 1), '.', substr({s}.d, {s}.e + 2)))"
        )
        small = lambda s: f"concat('0.', repeat('0', -{s}.e - 1), {s}.d)"
        scientific = lambda s: (
            f"concat(substr({s}.d, 1, 1), if(length({s}.d) > 1, concat('.', substr({s}.d, 2)), ''), "
            f"'e', if({s}.e < 0, '-', '+'), if(abs({s}.e) < 10, '0', ''), abs({s}.e))"
        )
        expanded = let(
            parts,
            lambda s: (
                f"concat({sign}, CASE WHEN {s}.e >= 0 AND {s}.e < 16 THEN {large(s)} "
                f"WHEN {s}.e < 0 AND {s}.e >= -4 THEN {small(s)} ELSE {scientific(s)} END)"
            ),
        )
        return (
            f"CASE {p} WHEN 'NaN' THEN 'nan' WHEN 'Infinity' THEN 'inf' WHEN '-Infinity' THEN '-inf' "
            f"ELSE if({p} LIKE '%E%', {expanded}, {p}) END"
        )

    return let(f"CAST({value} AS string)", expand)


def cell_text(column: str, data_type: T.DataType) -> str:
    """Text of one typed cell: timestamps formatted, numbers plain, rest cast."""
    if isinstance(data_type, T.TimestampNTZType):
        # Already wall-clock time: no detour over the session time zone.
        return f"substr(CAST({column} AS string), 1, 19)"
    if isinstance(data_type, T.TimestampType):
        return f"date_format({column}, {lit(TIMESTAMP_FORMAT)})"
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return number_text(column)
    if isinstance(data_type, T.BooleanType):
        return f"initcap(CAST({column} AS string))"
    return f"CAST({column} AS string)"


def text_cells(schema: T.StructType, columns: list[str]) -> str:
    """The named columns of a typed DataFrame as one array of cell texts."""
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    return f"array({', '.join(cell_text(quoted(c), schema[c].dataType) for c in columns)})"


def text_array(texts: list[str] | tuple[str, ...]) -> str:
    """Array of fixed texts."""
    return f"CAST(array({', '.join(lit(t) for t in texts)}) AS array<string>)"


def table_value(columns: str, rows: str) -> str:
    return f"CAST(named_struct('columns', {columns}, 'rows', {rows}) AS {TABLE_DDL})"


def empty_table() -> str:
    return table_value("array()", "array()")


_JSON_TEXT = r'"(?:[^"\\]++|\\.)*+"'


def _json_object(depth: int) -> str:
    """Pattern of a JSON object with objects in it to a depth."""
    inner = f"|{_json_object(depth - 1)}" if depth else ""
    return rf'\{{(?:[^"{{}}]++|{_JSON_TEXT}{inner})*+\}}'


#: Depth of objects in a cell whose numbers are left alone.
OBJECT_DEPTH = 4
#: All up to the next number that is a cell: texts and objects are stepped over as a
#: whole, so nothing in them is taken for a number. Then the number, as JSON writes it.
_NUMBER_CELL = (
    rf'\G((?:\A\s*+\{{|[^"{{0-9-]++|{_JSON_TEXT}|{_json_object(OBJECT_DEPTH)})*+)'
    r"(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)(?=\s*+[,\]}])"
)
#: An array within a row.
_ARRAY_CELL = r"\[[^\[\]]*+(?:\[[^\[\]]*+\][^\[\]]*+)*+\[[^\[\]]*+\["


def table_from_split_json(text: str) -> str:
    """Nested table from split-oriented JSON; broken JSON gives NULL.

    Cells keep the JSON literal as text, without type inference: numbers become texts
    before the JSON is read, so ``1.10``, ``1e5`` and numbers of any length stay as they
    stand. Objects are cells as the JSON reader prints them. So is every number of a
    table with an array in a cell, where only exponents are printed plain again.
    """
    is_exponent = lambda x: f"{x} RLIKE '^-?[0-9][.][0-9]+E-?[0-9]+$'"
    plain = lambda rows: (
        f"if({exists(rows, lambda r: exists(r, is_exponent))}, "
        + transform(
            rows,
            lambda r: transform(r, lambda x: f"if({is_exponent(x)}, {number_text(f'try_cast({x} AS double)')}, {x})"),
        )
        + f", {rows})"
    )
    read = lambda json: f"from_json({json}, {lit(SPLIT_JSON_DDL)})"
    made = lambda rows: lambda t: (
        f"if({t}.columns IS NOT NULL AND {t}.data IS NOT NULL, {table_value(f'{t}.columns', rows(f'{t}.data'))}, NULL)"
    )
    literals = f"regexp_replace({text}, {lit(_NUMBER_CELL)}, {lit('$1"$2"')})"
    bare = f"regexp_replace(regexp_replace(ltrim({text}), {lit(_JSON_TEXT)}, ''), {lit('(?!^)' + _json_object(OBJECT_DEPTH))}, '')"
    return (
        f"if(regexp_like({bare}, {lit(_ARRAY_CELL)}), "
        f"{let(read(text), made(plain))}, {let(read(literals), made(lambda rows: rows))})"
    )


def dedup_names(columns: str) -> str:
    """Repeated column names become ``name -1``, ``name -2`` by position."""
    count = lambda names, c: f"size(filter({names}, n -> n = {c}))"
    renamed = transform(
        columns,
        lambda c, i: f"if({count(columns, c)} > 1, concat({c}, ' -', {count(f'slice({columns}, 1, {i} + 1)', c)}), {c})",
    )
    return f"if(size(array_distinct({columns})) = size({columns}), {columns}, {renamed})"


def _fill_literal(rows: str) -> str:
    """NULL cells as text: ``nan`` in numeric columns, ``None`` elsewhere."""

    def is_numeric(j: str) -> str:
        some = exists(rows, lambda r: f"get({r}, {j}) IS NOT NULL")
        every = forall(rows, lambda r: f"get({r}, {j}) IS NULL OR try_cast(get({r}, {j}) AS double) IS NOT NULL")
        return f"{some} AND {every}"

    marks = transform(f"get({rows}, 0)", lambda _, j: f"if({is_numeric(j)}, 'nan', 'None')")
    return let(
        marks,
        lambda m: transform(rows, lambda r: transform(r, lambda x, j: f"coalesce({x}, get({m}, {j}))")),
    )


def clean_table(table: str, null_mode: str = "empty") -> str:
    """Cleaned TABLE: unique column names and no NULL cell.

    A table without rows is left as it is.
    """
    if null_mode not in NULL_MODES:
        raise ValueError(f"null_mode must be one of {NULL_MODES}, not {null_mode!r}")

    def cleaned(t: str) -> str:
        rows = f"{t}.rows"
        if null_mode == "empty":
            filled = transform(rows, lambda r: transform(r, lambda x: f"coalesce({x}, '')"))
        else:
            filled = _fill_literal(rows)
        has_null = exists(rows, lambda r: exists(r, lambda x: f"{x} IS NULL"))
        new = table_value(dedup_names(f"{t}.columns"), f"if({has_null}, {filled}, {rows})")
        return f"if(size({rows}) > 0, {new}, {t})"

    return let(table, cleaned)


def clean_tables(tables: str, null_mode: str = "empty") -> str:
    return transform(tables, lambda t: clean_table(t, null_mode))


def latin1_text(binary: str) -> str:
    """Text of bytes stored as ISO-8859-1."""
    return f"decode({binary}, 'ISO-8859-1')"
