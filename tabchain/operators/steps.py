"""Table steps: each is a function ``(inter, tables, **args) -> DataFrame``.

A step only composes the plan. Nothing runs until the end of the chain, so
Catalyst prunes columns and pushes filters through all steps at once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabchain.operators.grid_join import grid_join
from tabchain.operators.joins import quoted, spread_join, table_join

# Aggregates and comparisons of the steps and the generator.
AGGREGATES = ("SUM", "AVG", "COUNT", "MIN", "MAX")
NUMERIC_OPS = ("<", ">", "=", "!=", "<=", ">=")
STRING_OPS = ("=", "!=")
CONNECTORS = ("AND", "OR")

Tables = dict[str, DataFrame]
STEPS: dict[str, Callable[..., DataFrame]] = {}


def step(name: str):
    def register(fn):
        STEPS[name] = fn
        return fn

    return register


def compare(left: Column, op: str, right: Column) -> Column:
    if op not in NUMERIC_OPS:
        raise ValueError(f"comparison must be one of {NUMERIC_OPS}, not {op!r}")
    return {
        "<": left < right,
        ">": left > right,
        "=": left == right,
        "!=": left != right,
        "<=": left <= right,
        ">=": left >= right,
    }[op]


def conjunction(conditions: list[Column], connectors: list[str]) -> Column:
    """Conditions with mixed AND and OR; AND binds tighter, no parentheses."""
    if len(connectors) != len(conditions) - 1:
        raise ValueError("one connector between each two conditions")
    groups = [[conditions[0]]]
    for connector, condition in zip(connectors, conditions[1:]):
        if connector not in CONNECTORS:
            raise ValueError(f"connector must be one of {CONNECTORS}, not {connector!r}")
        if connector == "OR":
            groups.append([])
        groups[-1].append(condition)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, g) for g in groups])


def _numeric_columns(df: DataFrame, skip: list[str]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def _list(value: str | list[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _named(df: DataFrame, name: str) -> Column:
    """A column of exactly this name, whatever stands in it, else what Spark reads in it."""
    return F.col(quoted(name) if name in df.columns else name)


def _with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a NULL key."""
    return df.where(reduce(lambda a, b: a & b, [_named(df, k).isNotNull() for k in keys])) if keys else df


@step("select")
def select(inter: DataFrame, tables: Tables, columns: list[str]) -> DataFrame:
    return inter.select(*[_named(inter, c) for c in _list(columns)])


@step("filter")
def filter_rows(
    inter: DataFrame,
    tables: Tables,
    where: str | None = None,
    conditions: list[tuple] | None = None,
    connectors: list[str] | None = None,
) -> DataFrame:
    """Rows that meet a SQL condition or ``(column, op, value)`` conditions."""
    if where is not None:
        return inter.where(where)
    columns = [compare(F.col(quoted(c)), op, F.lit(v)) for c, op, v in conditions]
    return inter.where(conjunction(columns, connectors or ["AND"] * (len(columns) - 1)))


@step("add_column")
def add_column(
    inter: DataFrame,
    tables: Tables,
    name: str,
    expr: str | None = None,
    split: str | None = None,
    separator: str | None = None,
    part: int = 0,
    pattern: str | None = None,
    group: int = 1,
) -> DataFrame:
    """Derived column: an expression, a part of a cell, or a matched group."""
    if expr is not None:
        value = F.expr(expr)
    elif pattern is not None:
        value = F.regexp_extract(_named(inter, split), pattern, group)
    else:
        value = F.trim(F.get(F.split(_named(inter, split), separator), F.lit(part)))
    return inter.withColumn(name, value)


@step("group_by")
def group_by(inter: DataFrame, tables: Tables, columns: str | list[str], name: str = "count", keep_nulls: bool = False) -> DataFrame:
    """Rows per group; rows with a NULL key are left out unless kept."""
    keys = _list(columns)
    rows = inter if keep_nulls else _with_keys(inter, keys)
    return rows.groupBy(*[_named(inter, k) for k in keys]).agg(F.count("*").alias(name))


@step("aggregate")
def aggregate(
    inter: DataFrame,
    tables: Tables,
    by: str | list[str],
    aggs: dict[str, str],
    having: str | None = None,
    keep_nulls: bool = False,
) -> DataFrame:
    """Aggregates per group as ``{new name: SQL aggregate}``, with HAVING."""
    keys = _list(by)
    rows = inter if keep_nulls else _with_keys(inter, keys)
    grouped = rows.groupBy(*[_named(inter, k) for k in keys]).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])
    return grouped.where(having) if having else grouped


@step("group_mean")
def group_mean(inter: DataFrame, tables: Tables, by: str | list[str]) -> DataFrame:
    """Mean of every numeric column per group; NULL keys are left out."""
    keys = _list(by)
    return (
        _with_keys(inter, keys)
        .groupBy(*[_named(inter, k) for k in keys])
        .agg(*[F.avg(quoted(c)).alias(c) for c in _numeric_columns(inter, keys)])
    )


@step("row_mean")
def row_mean(inter: DataFrame, tables: Tables, columns: list[str] | None = None, name: str = "mean") -> DataFrame:
    """Mean over the columns of each row; NULLs are skipped, all NULL gives NULL."""
    chosen = columns or _numeric_columns(inter, [])
    inter.select(*[_named(inter, c) for c in chosen])
    values = [F.col(quoted(c)).cast("double") for c in chosen]
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    present = reduce(lambda a, b: a + b, [F.when(v.isNull(), 0).otherwise(1) for v in values])
    return inter.withColumn(name, total / F.nullif(present, F.lit(0)))


@step("join")
def join(
    inter: DataFrame,
    tables: Tables,
    table: str,
    on: str | list[str],
    how: str = "inner",
    match_null_keys: bool = True,
    spread_by: list[str] | None = None,
    grid: bool = False,
) -> DataFrame:
    """Join with a registered table; ``spread_by`` salts a skewed left side, ``grid`` spreads keys hot on either or both."""
    if grid:
        return grid_join(inter, tables[table], on, how, match_null_keys)
    if spread_by:
        return spread_join(inter, tables[table], _list(on), spread_by, how, match_null_keys=match_null_keys)
    return table_join(inter, tables[table], on, how, match_null_keys)


@step("sort")
def sort(inter: DataFrame, tables: Tables, by: str | list[str], descending: bool | list[bool] = False) -> DataFrame:
    """Global sort, NULLs last in both directions."""
    return inter.orderBy(*sort_order(inter, _list(by), descending))


def sort_order(df: DataFrame, by: list[str], descending: bool | list[bool]) -> list[Column]:
    flags = descending if isinstance(descending, list) else [descending] * len(by)
    return [_named(df, c).desc_nulls_last() if d else _named(df, c).asc_nulls_last() for c, d in zip(by, flags)]


@step("limit")
def limit(inter: DataFrame, tables: Tables, n: int) -> DataFrame:
    return inter.limit(n)


@step("top")
def top(inter: DataFrame, tables: Tables, n: int, by: str | list[str], descending: bool | list[bool] = True) -> DataFrame:
    """First ``n`` rows of a sort, kept per task before they are merged."""
    return inter.orderBy(*sort_order(inter, _list(by), descending)).limit(n)


@step("tail")
def tail(inter: DataFrame, tables: Tables, n: int, by: str) -> DataFrame:
    """Last ``n`` rows by a sequence column, in ascending order."""
    return inter.orderBy(_named(inter, by).desc()).limit(n).orderBy(_named(inter, by))


@step("argmax")
def argmax(inter: DataFrame, tables: Tables, column: str, by: str, tie: str, group: list[str] | None = None) -> DataFrame:
    """Value of ``column`` where ``by`` is greatest; least ``tie`` of any type wins.

    Each task keeps its first row, per group if there are groups, before any is
    shuffled. No row with a ``by`` gives no row.
    """
    keys = [_named(inter, k) for k in group or []]
    order = [_named(inter, by).desc(), _named(inter, tie).asc_nulls_last()]
    rows = inter.where(_named(inter, by).isNotNull())
    wanted = [*keys, _named(inter, column).alias(column), _named(inter, by).alias(by)]
    if not keys:
        return rows.orderBy(*order).limit(1).select(*wanted)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") == 1).select(*wanted)


@step("union")
def union(inter: DataFrame, tables: Tables, table: str) -> DataFrame:
    return inter.unionByName(tables[table])


@step("sql")
def sql(inter: DataFrame, tables: Tables, query: str) -> DataFrame:
    """SQL over the registered tables and ``inter``, each named in braces.

    Only braces around one of these names stand for a table. Tables are views of
    that name while the query is analysed.
    """
    spark, known, views = inter.sparkSession, {"inter": inter, **tables}, {}

    def view(found: re.Match) -> str:
        name = found[1]
        if name not in known:
            return found[0]
        if name not in views:
            views[name] = f"step_{uuid.uuid4().hex}"
            known[name].createOrReplaceTempView(views[name])
        return views[name]

    try:
        return spark.sql(re.sub(r"\{(\w+)\}", view, query))
    finally:
        for name in views.values():
            spark.catalog.dropTempView(name)
