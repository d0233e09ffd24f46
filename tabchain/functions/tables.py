"""Joins and runs on nested tables."""

from __future__ import annotations

from collections.abc import Callable

from tabchain.functions.cells import table_value
from tabchain.functions.sqltext import let, struct, transform, where


def column_position(table: str, name: str) -> str:
    """0-based position of a column; NULL when it is unknown."""
    return f"CAST(nullif(array_position({table}.columns, {name}), 0L) - 1 AS int)"


def runs(values: str, key: Callable[[str], str], body: Callable[[str, str, str], str]) -> str:
    """``body(array, first index, length)`` of each run of equal keys in a sorted array."""

    def with_values(v: str) -> str:
        starts = where(
            f"sequence(0, size({v}) - 1)",
            lambda i: f"{i} = 0 OR NOT {key(f'get({v}, {i})')} <=> {key(f'get({v}, {i} - 1)')}",
        )
        ends = lambda s, j: f"coalesce(get({s}, {j} + 1), size({v}))"
        found = let(starts, lambda s: transform(s, lambda x, j: body(v, x, f"{ends(s, j)} - {x}")))
        return f"if(size({v}) = 0, array(), {found})"

    return let(values, with_values)


def join_tables(left: str, right: str, name: str) -> str:
    """Inner join of two nested tables on a shared column, or NULL without it.

    Clashing other names get ``_x`` and ``_y``. The rows of both sides are sorted
    together by key, each run of one key gives its pairs, and the pairs are sorted
    back into the order of the left and the right rows, so the work follows the sizes of both
    sides and of the result, not their product.
    """

    def joined(ctx: str) -> str:
        a, b = f"{ctx}.a", f"{ctx}.b"
        others = lambda row: f"filter({row}, (x, i) -> i != {b})"
        side = lambda rows, number, at, kept: transform(
            rows, lambda r, i: struct(k=f"coalesce(get({r}, {at}), '')", side=str(number), i=i, cells=kept(r))
        )
        both = f"concat({side(f'{left}.rows', 0, a, lambda r: r)}, {side(f'{right}.rows', 1, b, others)})"

        def pairs(v: str, first: str, n: str) -> str:
            """Pairs of one run, which holds its left rows first."""
            of = lambda run, number: where(run, lambda x: f"{x}.side = {number}")
            return let(
                f"slice({v}, {first} + 1, {n})",
                lambda run: let(
                    of(run, 1),
                    lambda r: "flatten("
                    + transform(
                        of(run, 0),
                        lambda x: transform(r, lambda y: struct(i=f"{x}.i", j=f"{y}.i", cells=f"concat({x}.cells, {y}.cells)")),
                    )
                    + ")",
                ),
            )

        rows = f"array_sort(flatten({runs(f'array_sort({both})', lambda x: f'{x}.k', pairs)})).cells"
        left_names = transform(
            f"{left}.columns",
            lambda c: f"if({c} != {name} AND array_contains({right}.columns, {c}), concat({c}, '_x'), {c})",
        )
        right_names = transform(
            others(f"{right}.columns"),
            lambda c: f"if(array_contains({left}.columns, {c}), concat({c}, '_y'), {c})",
        )
        names = f"concat({left_names}, {right_names})"
        return (
            f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN size({right}.rows) = 0 "
            f"THEN {table_value(names, 'array()')} ELSE {table_value(names, rows)} END"
        )

    return let(struct(a=column_position(left, name), b=column_position(right, name)), joined)
