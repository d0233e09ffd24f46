"""Chains per sample as plans over flat rows.

Each sample carries a chain of its own. Samples are grouped by the shape of their
chain, which is the names of its steps; a shape is one DataFrame plan over the rows of
all its samples, and what a step needs besides its name (columns, constants, tables)
comes from the sample. Rows know their sample and their place, so a sample with a very
large table is many tasks, and no table is one value.

A step that a sample can't take (an unknown column or table) leaves the sample's
result as it is and is counted, as in :mod:`tabchain.plans.corpus_chain`, whose steps
have the same results here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabchain.functions.sqltext import forall, is_number, transform, where
from tabchain.operators.generation import decimal_text
from tabchain.operators.positions import numbered
from tabchain.plans.corpus_chain import cell_holds, sort_key
from tabchain.session import cut_lineage

#: Shapes of chains that one call takes; each is a plan of its own.
MAX_SHAPES = 256
#: Rows of the tables for each task that an ordering is dealt to.
ROWS_PER_TASK = 50_000
#: Exact type of sums and means, and places of a mean.
NUMBER, MEAN_PLACES = "decimal(38,10)", 4

_CONTEXT = ["columns", "others", "steps", "failed"]
STEPS: dict[str, Callable[[State, str], State]] = {}


@dataclass(frozen=True)
class State:
    """Rows ``(sample_id, pos, cells, *context)``, one row of context per sample, and all tables."""

    rows: DataFrame
    heads: DataFrame
    tables: DataFrame
    #: Tasks that an ordering of the rows is dealt to.
    parts: int = 1

    def each(self, ok: str, columns: str | None = None, cells: str | None = None) -> State:
        """New columns and cells where the step can be taken; it is counted where it can't."""
        context = {"failed": F.expr(f"failed + if({ok}, 0, 1)")}
        if columns is not None:
            context["columns"] = F.expr(f"if({ok}, {columns}, columns)")
        more = {"cells": F.expr(f"if({ok}, {cells}, cells)")} if cells is not None else {}
        return State(self.rows.withColumns(context | more), self.heads.withColumns(context), self.tables, self.parts)

    def replaced(self, ok: str, rows: Callable[[DataFrame], DataFrame], columns: str | None = None) -> State:
        """Other rows (``sample_id, pos, cells``) for the samples that can take the step."""
        made = rows(self.rows.where(ok)).select("sample_id", "pos", "cells")
        met = made.join(self.heads.where(ok), "sample_id").select(*self.rows.columns)
        both = State(self.rows.where(f"NOT ({ok})").unionByName(met), self.heads, self.tables, self.parts)
        return both.each(ok, columns)


def step(name: str):
    def register(fn):
        STEPS[name] = fn
        return fn

    return register


def _position(name: str, columns: str = "columns") -> str:
    return f"CAST(nullif(array_position({columns}, {name}), 0L) - 1 AS int)"


def _first(s: str) -> str:
    """Position of the step's first column; NULL when it is unknown."""
    return _position(f"get({s}.columns, 0)")


def _second(s: str) -> str:
    return _position(f"get({s}.columns, 1)")


def _sorted_in(rows: DataFrame, parts: int, order: list[Column | str]) -> DataFrame:
    """Rows in a global order, in as many tasks as asked: what a task sorts doesn't grow with the rows."""
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order) if parts > 1 else rows.orderBy(*order)


def _ordered(rows: DataFrame, order: list[Column | str], parts: int) -> DataFrame:
    """Rows with their place in a new order, within their sample."""
    return numbered(_sorted_in(rows, parts, ["sample_id", *order]).withColumnRenamed("pos", "_old"), "pos").drop("_old")


def _ranked(placed: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 and ``size`` in the sample to rows whose places are dense; they are counted, not windowed."""
    ends = placed.groupBy("sample_id").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    met = placed.join(ends, "sample_id")
    return met.withColumns({"rank": F.col("pos") - F.col("_first"), "size": F.col("_last") - F.col("_first") + 1}).drop("_first", "_last")


def _sorted(state: State, at: str, ok: str, descending: bool) -> DataFrame:
    names = list(sort_key("c"))
    keys = {f"_{n}": F.expr(f"if({ok}, {e}, NULL)") for n, e in sort_key(f"get(cells, {at})").items()}
    order = [F.col(f"_{n}").desc() if descending and n != "kind" else F.col(f"_{n}") for n in names]
    return _ordered(state.rows.withColumns(keys), [*order, "pos"], state.parts).drop(*keys)


@step("select")
def select(state: State, s: str) -> State:
    at = transform(f"{s}.columns", lambda c: _position(c))
    cells = transform(at, lambda p: f"get(cells, {p})")
    return state.each(forall(at, lambda p: f"{p} IS NOT NULL"), f"{s}.columns", cells)


@step("filter")
def filter_rows(state: State, s: str) -> State:
    ok = f"{_first(s)} IS NOT NULL"
    kept = state.rows.where(f"NOT ({ok}) OR {cell_holds(f'get(cells, {_first(s)})', f'{s}.op', f'{s}.value')}")
    return State(kept, state.heads, state.tables, state.parts).each(ok)


@step("add_column")
def add_column(state: State, s: str) -> State:
    """Part ``n`` (from 0) of the first column's cell, cut at ``value``, as a column of the second name."""
    part = f"trim(get(split(get(cells, {_first(s)}), {s}.value), coalesce({s}.n, 0)))"
    return state.each(f"{_first(s)} IS NOT NULL AND size({s}.columns) = 2", f"concat(columns, array(get({s}.columns, 1)))", f"concat(cells, array({part}))")


@step("row_mean")
def row_mean(state: State, s: str) -> State:
    """Mean of the columns' numbers in each row, other cells left out, as a column named ``value``."""
    at = transform(f"{s}.columns", lambda c: _position(c))
    numbers = where(transform(at, lambda p: f"if({is_number(f'get(cells, {p})')}, try_cast(get(cells, {p}) AS {NUMBER}), NULL)"), lambda x: f"{x} IS NOT NULL")
    total = f"aggregate({numbers}, CAST(0 AS {NUMBER}), (a, x) -> CAST(a + x AS {NUMBER}))"
    mean = decimal_text(f"CAST(round(try_divide({total}, size({numbers})), {MEAN_PLACES}) AS {NUMBER})")
    return state.each(forall(at, lambda p: f"{p} IS NOT NULL"), f"concat(columns, array({s}.value))", f"concat(cells, array({mean}))")


@step("sort")
def sort(state: State, s: str) -> State:
    ok = f"{_first(s)} IS NOT NULL"
    return State(_sorted(state, _first(s), ok, False), state.heads, state.tables, state.parts).each(ok)


@step("sort_desc")
def sort_desc(state: State, s: str) -> State:
    ok = f"{_first(s)} IS NOT NULL"
    return State(_sorted(state, _first(s), ok, True), state.heads, state.tables, state.parts).each(ok)


def _cut(state: State, ok: str, keep: str) -> State:
    """Rows that ``keep`` by their rank, of a state that was just ordered."""
    kept = _ranked(state.rows).where(f"NOT ({ok}) OR {keep}").drop("rank", "size")
    return State(kept.select(*state.rows.columns), state.heads, state.tables, state.parts)


@step("limit")
def limit(state: State, s: str) -> State:
    placed = State(_ordered(state.rows, ["pos"], state.parts), state.heads, state.tables, state.parts)
    return _cut(placed, "true", f"rank < coalesce({s}.n, 0)").each("true")


@step("top")
def top(state: State, s: str) -> State:
    """First ``n`` rows, the greatest first."""
    ok = f"{_first(s)} IS NOT NULL"
    placed = State(_sorted(state, _first(s), ok, True), state.heads, state.tables, state.parts)
    return _cut(placed, ok, f"rank < coalesce({s}.n, 0)").each(ok)


@step("tail")
def tail(state: State, s: str) -> State:
    """Last ``n`` rows in ascending order."""
    ok = f"{_first(s)} IS NOT NULL"
    placed = State(_sorted(state, _first(s), ok, False), state.heads, state.tables, state.parts)
    return _cut(placed, ok, f"rank >= size - coalesce({s}.n, 0)").each(ok)


@step("argmax")
def argmax(state: State, s: str) -> State:
    """The first column's cell of the first row with the greatest second column."""
    ok = f"{_first(s)} IS NOT NULL AND {_second(s)} IS NOT NULL"
    placed = State(_sorted(state, _second(s), ok, True), state.heads, state.tables, state.parts)
    return _cut(placed, ok, "rank < 1").each(ok, f"array(get({s}.columns, 0))", f"array(get(cells, {_first(s)}))")


def _grouped(state: State, s: str, ok: str, name: str, value: Column) -> State:
    def rows(own: DataFrame) -> DataFrame:
        keyed = own.withColumn("_key", F.expr(f"get(cells, {_first(s)})")).where("_key IS NOT NULL")
        groups = keyed.groupBy("sample_id", "_key").agg(value.alias("_value"))
        placed = numbered(_sorted_in(groups, state.parts, ["sample_id", "_key"]), "pos")
        return placed.withColumn("cells", F.array("_key", "_value"))

    return state.replaced(ok, rows, f"array(get({s}.columns, 0), {name})")


@step("group_count")
def group_count(state: State, s: str) -> State:
    """Rows per value, by value."""
    return _grouped(state, s, f"{_first(s)} IS NOT NULL", "'count'", F.count("*").cast("string"))


@step("aggregate")
def aggregate(state: State, s: str) -> State:
    """SUM, AVG, COUNT, MIN or MAX (``op``) of the second column's numbers per value of the first."""
    number = F.expr(f"if({is_number(f'get(cells, {_second(s)})')}, try_cast(get(cells, {_second(s)}) AS {NUMBER}), NULL)")
    op = F.first(F.expr(f"{s}.op"))
    exact = (
        F.when(op == "SUM", F.try_sum(number).cast(NUMBER))
        .when(op == "AVG", F.round(F.try_avg(number), MEAN_PLACES).cast(NUMBER))
        .when(op == "COUNT", F.count(number).cast(NUMBER))
        .when(op == "MIN", F.min(number))
        .when(op == "MAX", F.max(number))
    )
    ok = f"{_first(s)} IS NOT NULL AND {_second(s)} IS NOT NULL AND coalesce({s}.op IN ('SUM', 'AVG', 'COUNT', 'MIN', 'MAX'), false)"
    text = F.regexp_replace(exact.cast("string"), "[.]?0+$", "")
    return _grouped(state, s, ok, f"concat({s}.op, '(', get({s}.columns, 1), ')')", text)


def _named(s: str) -> str:
    """Columns of the table that the step names; NULL without it."""
    return f"get(others, {s}.table - 1)"


@step("use")
def use(state: State, s: str) -> State:
    ok = f"{_named(s)} IS NOT NULL"
    wanted = state.heads.where(ok).select("sample_id", F.expr(f"{s}.table").alias("table_no"))
    return state.replaced(ok, lambda _: state.tables.join(wanted, ["sample_id", "table_no"]), _named(s))


@step("union")
def union(state: State, s: str) -> State:
    """Rows of another table with the same columns, behind these."""
    ok = f"{_named(s)} = columns"
    wanted = state.heads.where(f"coalesce({ok}, false)").select("sample_id", F.expr(f"{s}.table").alias("table_no"))

    def rows(own: DataFrame) -> DataFrame:
        more = state.tables.join(wanted, ["sample_id", "table_no"]).select("sample_id", "pos", "cells", F.lit(1).alias("_late"))
        both = own.select("sample_id", "pos", "cells", F.lit(0).alias("_late")).unionByName(more)
        return _ordered(both, ["_late", "pos"], state.parts)

    return state.replaced(f"coalesce({ok}, false)", rows)


@step("join")
def join(state: State, s: str) -> State:
    """Inner join with another table of the sample on one shared column; clashing names get ``_x`` and ``_y``."""
    name = f"get({s}.columns, 0)"
    a, b = _position(name), _position(name, _named(s))
    ok = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    left_names = transform("columns", lambda c: f"if({c} != {name} AND array_contains({_named(s)}, {c}), concat({c}, '_x'), {c})")
    rest = where(_named(s), lambda c: f"{c} != {name}")
    right_names = transform(rest, lambda c: f"if(array_contains(columns, {c}), concat({c}, '_y'), {c})")

    def rows(own: DataFrame) -> DataFrame:
        keyed = own.select(
            "sample_id", F.expr(f"{s}.table").alias("table_no"), F.expr(f"coalesce(get(cells, {a}), '')").alias("_key"),
            "pos", "cells", F.expr(b).alias("_at"),
        )
        places = state.heads.where(ok).select("sample_id", F.expr(f"{s}.table").alias("table_no"), F.expr(b).alias("_b"))
        other = state.tables.join(places, ["sample_id", "table_no"]).select(
            "sample_id", "table_no", F.expr("coalesce(get(cells, _b), '')").alias("_key"), F.col("pos").alias("_right"), F.col("cells").alias("_cells")
        )
        met = keyed.join(other, ["sample_id", "table_no", "_key"])
        joined = F.expr("concat(cells, filter(_cells, (x, i) -> i != _at))")
        return _ordered(met.select("sample_id", "pos", "_right", joined.alias("cells")), ["pos", "_right"], state.parts)

    return state.replaced(ok, rows, f"concat({left_names}, {right_names})")


def run_sample_plans(tables: DataFrame, headers: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last rows ``(sample_id, pos, cells)`` and ``(sample_id, columns, failed_steps)`` of every sample.

    ``tables`` holds the rows ``(sample_id, table_no, row_no, cells)``, ``headers`` the
    ``columns`` of each ``(sample_id, table_no)``, numbered from 1 without gaps, ``steps``
    a chain per sample in the form of :data:`tabchain.plans.corpus_chain.STEP_DDL`. A
    chain starts on table 1. ``pos`` orders the rows of a sample. A NULL cell is an
    empty one. Chains and rows are written once, since every shape and step reads them.
    """
    lists = headers.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("table_no", "columns")))["columns"].alias("others"))
    shape = F.array_join(F.transform("steps", lambda s: s["step"]), ">")
    chains = steps.join(lists, "sample_id").select(
        "sample_id", F.get("others", F.lit(0)).alias("columns"), "others", "steps", F.lit(0).alias("failed"), shape.alias("shape")
    )
    chains = cut_lineage(chains)
    shapes = [r.shape for r in chains.select("shape").distinct().limit(MAX_SHAPES + 1).collect()]
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"at most {MAX_SHAPES} shapes of chains run at a time")
    cells = F.transform("cells", lambda c: F.coalesce(c, F.lit("")))
    flat = tables.select("sample_id", "table_no", F.col("row_no").cast("long").alias("pos"), cells.alias("cells"))
    if shapes:
        flat = cut_lineage(flat)
    parts = -(-flat.count() // ROWS_PER_TASK) if shapes else 1
    done = [_run_shape(flat, chains.where(F.col("shape") == x).drop("shape"), x, parts) for x in sorted(shapes)]
    if not done:
        return flat.select("sample_id", "pos", "cells").where("false"), chains.select("sample_id", "columns", F.col("failed").alias("failed_steps"))
    rows = reduce(DataFrame.unionByName, [s.rows.select("sample_id", "pos", "cells") for s in done])
    heads = reduce(DataFrame.unionByName, [s.heads.select("sample_id", "columns", F.col("failed").alias("failed_steps")) for s in done])
    return rows, heads


def _run_shape(tables: DataFrame, heads: DataFrame, shape: str, parts: int) -> State:
    own = tables.join(heads.select("sample_id"), "sample_id", "left_semi")
    rows = own.where("table_no = 1").join(heads, "sample_id").select("sample_id", "pos", "cells", *_CONTEXT)
    state = State(rows, heads.select("sample_id", *_CONTEXT), own, parts)
    for k, name in enumerate(shape.split(">") if shape else []):
        s = f"get(steps, {k})"
        state = STEPS[name](state, s) if name in STEPS else state.each("false")
    return state
