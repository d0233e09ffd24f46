"""Chains of steps per sample, on nested tables.

Each sample carries its own steps, so one projection answers all questions of
a corpus. A step that names an unknown column or table, or an unknown step,
leaves the sample's result as it is and is counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabchain.functions.cells import TABLE_DDL, clean_table, clean_tables, evaluate_once, table_value
from tabchain.functions.sqltext import fold, forall, is_number, let, number_comparison, sort_with, struct, transform, where
from tabchain.functions.tables import column_position, join_tables, runs

#: One step: ``columns`` for select, sort keys or the join key; ``op`` and
#: ``value`` for filter; ``n`` for limit; ``table`` (from 1) to start from or join.
STEP_DDL = "struct<step:string,columns:array<string>,op:string,value:string,n:int,table:int>"


def _with_column(table: str, step: str, body) -> str:
    """``body(position)`` of the step's first column, or NULL when it is unknown."""
    return let(
        column_position(table, f"get({step}.columns, 0)"), lambda at: f"if({at} IS NULL, NULL, {body(at)})"
    )


def _select(table: str, step: str) -> str:
    def chosen(at: str) -> str:
        known = forall(at, lambda p: f"{p} IS NOT NULL")
        rows = transform(f"{table}.rows", lambda r: transform(at, lambda p: f"get({r}, {p})"))
        return f"if({known}, {table_value(f'{step}.columns', rows)}, NULL)"

    return let(transform(f"{step}.columns", lambda c: column_position(table, c)), chosen)


def cell_holds(cell: str, op: str, value: str) -> str:
    """Whether a cell compares with a value, as numbers where both are numbers."""
    both = f"({is_number(cell)} AND {is_number(value)})"
    test = lambda o: f"if({both}, {number_comparison(cell, o, value)}, {cell} {o} {value})"
    cases = " ".join(f"WHEN '{o}' THEN {test(o)}" for o in ("=", "!=", "<", ">", "<=", ">="))
    return f"coalesce(CASE {op} {cases} END, false)"


def sort_key(cell: str) -> dict[str, str]:
    """What cells are sorted by: numbers before texts, empty cells last."""
    return {
        "kind": f"CASE WHEN coalesce({cell}, '') = '' THEN 2 WHEN {is_number(cell)} THEN 0 ELSE 1 END",
        "number": f"if({is_number(cell)}, try_cast({cell} AS double), NULL)",
        "whole": f"if({is_number(cell)}, try_cast({cell} AS decimal(38,0)), NULL)",
        "text": cell,
    }


def _filter(table: str, step: str) -> str:
    """Rows whose cell holds."""
    keep = lambda cell: cell_holds(cell, f"{step}.op", f"{step}.value")
    return _with_column(
        table,
        step,
        lambda at: table_value(
            f"{table}.columns", where(f"{table}.rows", lambda r: keep(f"get({r}, {at})"))
        ),
    )


def _sort(table: str, step: str, descending: bool) -> str:
    """Stable sort on one column."""
    before, after = (1, -1) if descending else (-1, 1)

    def keyed(r: str, i: str, at: str) -> str:
        return let(f"get({r}, {at})", lambda cell: struct(**sort_key(cell), i=i, r=r))

    order = lambda x, y: (
        f"CASE WHEN {x}.kind != {y}.kind THEN {x}.kind - {y}.kind "
        f"WHEN {x}.number < {y}.number THEN {before} WHEN {x}.number > {y}.number THEN {after} "
        f"WHEN {x}.kind = 0 AND {x}.whole < {y}.whole THEN {before} WHEN {x}.kind = 0 AND {x}.whole > {y}.whole THEN {after} "
        f"WHEN {x}.kind = 1 AND {x}.text < {y}.text THEN {before} WHEN {x}.kind = 1 AND {x}.text > {y}.text THEN {after} "
        f"ELSE {x}.i - {y}.i END"
    )

    def ordered(at: str) -> str:
        pairs = transform(f"{table}.rows", lambda r, i: keyed(r, i, at))
        return table_value(f"{table}.columns", f"{sort_with(pairs, order)}.r")

    return _with_column(table, step, ordered)


def _limit(table: str, step: str) -> str:
    return table_value(f"{table}.columns", f"slice({table}.rows, 1, greatest({step}.n, 0))")


def _group_count(table: str, step: str) -> str:
    """Rows per value, by value: sort once, then take the length of each run."""

    def counted(at: str) -> str:
        values = f"array_sort(filter(transform({table}.rows, r -> get(r, {at})), x -> x IS NOT NULL))"
        rows = runs(values, lambda x: x, lambda v, first, n: f"array(get({v}, {first}), CAST({n} AS string))")
        return table_value(f"array(get({step}.columns, 0), 'count')", rows)

    return _with_column(table, step, counted)


def _join(table: str, step: str, tables: str) -> str:
    """Inner join with another table of the sample on one shared column."""
    return let(
        f"get({tables}, {step}.table - 1)",
        lambda other: join_tables(table, other, f"get({step}.columns, 0)"),
    )


def run_corpus_step(table: str, step: str, tables: str) -> str:
    """Result of one step, or NULL when it cannot be applied."""
    results = {
        "use": f"get({tables}, {step}.table - 1)",
        "select": _select(table, step),
        "filter": _filter(table, step),
        "sort": _sort(table, step, False),
        "sort_desc": _sort(table, step, True),
        "limit": _limit(table, step),
        "group_count": _group_count(table, step),
        "join": _join(table, step, tables),
    }
    cases = " ".join(f"WHEN '{name}' THEN {result}" for name, result in results.items())
    return f"CASE {step}.step {cases} END"


def run_corpus_chains(df: DataFrame, id_col: str = "sample_id", null_mode: str = "empty") -> DataFrame:
    """``(id, truth, pred, failed_steps)`` for samples with ``tables, steps, answer``.

    A chain starts on the sample's first table.
    """

    def one(tables: str):
        return lambda state, step: let(
            run_corpus_step(f"{state}.inter", step, tables),
            lambda result: struct(
                inter=f"CAST(coalesce({result}, {state}.inter) AS {TABLE_DDL})",
                failed=f"{state}.failed + CAST({result} IS NULL AS int)",
            ),
        )

    result = let(
        clean_tables("tables", null_mode),
        lambda tables: fold(
            "steps",
            struct(inter=f"CAST(get({tables}, 0) AS {TABLE_DDL})", failed="0"),
            one(tables),
            lambda s: struct(pred=f"{s}.inter", failed_steps=f"{s}.failed"),
        ),
    )
    samples = df.select(id_col, "tables", "steps", F.expr(clean_table("answer", null_mode)).alias("truth"))
    return evaluate_once(samples, result, ("tables", "steps"))
