"""Synthetic queries whose constants come from the tables themselves.

One row in is a table (or a pair of tables), rows out are queries: as text and
as structured conditions that Spark evaluates. All choices are draws on
``(seed, table key, query number, slot)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabchain.functions.draws import draw, draw_below, draw_item
from tabchain.functions.sqltext import exists, fold, is_number, let, lit, number_comparison, struct, transform, where
from tabchain.functions.tables import column_position, join_tables
from tabchain.operators.joins import spread_join
from tabchain.operators.steps import AGGREGATES, CONNECTORS, NUMERIC_OPS, STRING_OPS
from tabchain.session import cut_lineage

CONDITION_DDL = (
    "array<struct<col:string,owner:int,pos:int,agg:string,op:string,"
    "val:string,is_num:boolean,connector:string>>"
)
#: Exact type of cells and of their sums, least and greatest values: they do not depend on the row order.
RESULT_TYPE = "decimal(38,10)"
#: Places of a generated mean.
MEAN_PLACES = 4
#: Rows of queries that a task groups at a time.
ROWS_PER_TASK = 250_000


def with_query_numbers(df: DataFrame, per_table: int, name: str = "query_no") -> DataFrame:
    """Each table row ``per_table`` times."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(per_table - 1))))


def owned_columns(tables: list[str]) -> str:
    """Columns of one or two tables; the first table owns a shared name."""
    first = transform(f"{tables[0]}.columns", lambda c, i: struct(col=c, owner="0", pos=i))
    if len(tables) == 1:
        return first
    names = f"{tables[0]}.columns"
    second = transform(
        f"{tables[1]}.columns",
        lambda c, i: struct(
            col=c,
            owner=f"if(array_contains({names}, {c}), 0, 1)",
            pos=f"if(array_contains({names}, {c}), CAST(array_position({names}, {c}) - 1 AS int), {i})",
        ),
    )
    return f"concat({first}, {second})"


def _drawn_order(entries: str, keep: str, *key: str | int) -> str:
    """``keep`` entries in drawn order, without replacement."""
    keyed = transform(entries, lambda e, i: struct(k=draw(*key, "'col'", i), i=i, e=e))
    return f"slice(array_sort({keyed}), 1, {keep}).e"


def sample_values(df: DataFrame, key: str, table: str, columns: int, seed: int) -> DataFrame:
    """Drawn columns without replacement, and one drawn cell of each."""
    chosen = _drawn_order(owned_columns([table]), f"least({columns}, size({table}.columns))", seed, key)
    row = lambda j: f"get({table}.rows, {draw_below(f'size({table}.rows)', seed, key, lit('row'), j)})"
    return (
        df.withColumn("_drawn", F.expr(chosen))
        .withColumns(
            {
                "drawn_columns": F.col("_drawn.col"),
                "drawn_values": F.expr(transform("_drawn", lambda e, j: f"get({row(j)}, {e}.pos)")),
            }
        )
        .drop("_drawn")
    )


def generate_conditions(
    tables: list[str],
    seed: int,
    key: list[str],
    with_aggs: bool = False,
    count_range: bool = True,
) -> str:
    """Conditions over distinct columns with values drawn from the tables.

    A number may be compared in six ways, a text for equality only. With
    ``with_aggs`` about half of the numeric conditions get an aggregate; the
    constant of a COUNT is drawn from 1 to the number of rows when
    ``count_range`` is on. ``connector`` links a condition to the next one.
    """
    columns = owned_columns(tables)
    k = (seed, *key)
    keep = f"{draw_below(f'size({columns})', *k, lit('n'))} + 1"
    rows_of = lambda owner: (
        f"{tables[0]}.rows"
        if len(tables) == 1
        else f"if({owner} = 0, {tables[0]}.rows, {tables[1]}.rows)"
    )

    def condition(e: str, j: str, last: str) -> str:
        rows = rows_of(f"{e}.owner")
        cell = f"coalesce(get(get({rows}, {draw_below(f'size({rows})', *k, lit('row'), j)}), {e}.pos), '')"
        op = lambda numeric: (
            f"if({numeric}, {draw_item(NUMERIC_OPS, *k, lit('op'), j)}, {draw_item(STRING_OPS, *k, lit('op'), j)})"
        )
        link = f"if({j} < {last}, {draw_item(CONNECTORS, *k, lit('link'), j)}, '')"
        drawn_agg = lambda numeric: (
            f"if({numeric} AND {draw_below(2, *k, lit('half'), j)} = 1, {draw_item(AGGREGATES, *k, lit('agg'), j)}, '')"
        )
        count_to = f"CAST({draw_below(f'size({rows})', *k, lit('count'), j)} + 1 AS string)"

        def finish(s: str) -> str:
            val = f"if({s}.agg = 'COUNT', {count_to}, {s}.val)" if with_aggs and count_range else f"{s}.val"
            return struct(
                col=f"{e}.col",
                owner=f"{e}.owner",
                pos=f"{e}.pos",
                agg=f"{s}.agg",
                op=op(f"{s}.is_num"),
                val=val,
                is_num=f"{s}.is_num",
                connector=link,
            )

        typed = let(cell, lambda v: struct(val=v, is_num=is_number(v)))
        return let(
            typed,
            lambda t: let(
                struct(val=f"{t}.val", is_num=f"{t}.is_num", agg=drawn_agg(f"{t}.is_num") if with_aggs else "''"),
                finish,
            ),
        )

    chosen = let(
        _drawn_order(columns, keep, *k),
        lambda c: transform(c, lambda e, j: condition(e, j, f"size({c}) - 1")),
    )
    return f"CAST({chosen} AS {CONDITION_DDL})"


def _quoted_column(name: str) -> str:
    return f"concat('`', replace({name}, '`', '``'), '`')"


def item_text(item: str) -> str:
    """A column or an aggregate of it."""
    column = _quoted_column(f"{item}.col")
    return f"if({item}.agg = '', {column}, concat({item}.agg, '(', {column}, ')'))"


def condition_text(c: str) -> str:
    """One condition in Spark SQL: quoted column, escaped text constant."""
    backslash, quote = chr(92), "'"
    text = (
        f"replace(replace({c}.val, {lit(backslash)}, {lit(backslash * 2)}), {lit(quote)}, {lit(backslash + quote)})"
    )
    right = f"if({c}.is_num, {c}.val, concat({lit(quote)}, {text}, {lit(quote)}))"
    return f"concat_ws(' ', {item_text(c)}, {c}.op, {right}, nullif({c}.connector, ''))"


def conditions_text(conditions: str) -> str:
    """All conditions with their connectors."""
    return f"array_join({transform(conditions, condition_text)}, ' ')"


def _compare(left: str, op: str, right: str) -> str:
    cases = " ".join(f"WHEN '{o}' THEN {left} {o} {right}" for o in NUMERIC_OPS)
    return f"CASE {op} {cases} END"


def holds_all(conditions: str, holds) -> str:
    """Mixed AND and OR over a condition array; AND binds tighter.

    ``holds`` maps a condition to its truth; an unknown truth counts as false.
    """

    def merge(state: str, c: str) -> str:
        open_ = f"({state}.open AND coalesce({holds(c)}, false))"
        closes = f"{c}.connector != 'AND'"
        return let(
            open_,
            lambda o: struct(done=f"{state}.done OR ({closes} AND {o})", open=f"{closes} OR {o}"),
        )

    return fold(conditions, struct(done="false", open="true"), merge, lambda s: f"{s}.done")


def _compare_numbers(left: str, op: str, right: str) -> str:
    cases = " ".join(f"WHEN '{o}' THEN {number_comparison(left, o, right)}" for o in NUMERIC_OPS)
    return f"if({is_number(left)}, CASE {op} {cases} END, NULL)"


def _cells_hold(row: str):
    return lambda c: let(
        f"get({row}, {c}.pos)",
        lambda cell: (
            f"if({c}.is_num, {_compare_numbers(cell, f'{c}.op', f'{c}.val')}, {_compare(cell, f'{c}.op', f'{c}.val')})"
        ),
    )


def matching_rows(table: str, conditions: str) -> str:
    """Rows of a nested table that meet plain conditions on that table."""
    return where(f"{table}.rows", lambda r: row_holds(r, conditions))


def _with_conditions(
    df: DataFrame, key: str, tables: list[str], per_table: int, seed: int, with_aggs: bool, count_range: bool = True
) -> DataFrame:
    usable = reduce(
        lambda d, t: d.where(f"size({t}.rows) > 0 AND size({t}.columns) > 0"), tables, df.select(key, *tables)
    )
    conditions = generate_conditions(tables, seed, [key, "query_no"], with_aggs, count_range)
    return (
        with_query_numbers(usable, per_table)
        .withColumn("conditions", F.expr(conditions))
        .withColumn("text", F.expr(conditions_text("conditions")))
    )


def generate_where(
    df: DataFrame, key: str, table: str, per_table: int, seed: int, with_aggs: bool = False
) -> DataFrame:
    """WHERE conditions from one table: ``(key, table, query_no, conditions, text)``.

    Conditions with aggregates are HAVING conditions; they are not valid in
    WHERE. Tables without rows or columns give no query.
    """
    return _with_conditions(df, key, [table], per_table, seed, with_aggs)


def generate_where_two(
    df: DataFrame, key: str, first: str, second: str, per_table: int, seed: int, with_aggs: bool = False
) -> DataFrame:
    """Conditions over the columns of two tables; for use behind their join."""
    return _with_conditions(df, key, [first, second], per_table, seed, with_aggs)


def generate_having(
    df: DataFrame, key: str, tables: list[str], per_table: int, seed: int, with_aggs: bool = False
) -> DataFrame:
    """HAVING conditions from one or two tables; constants are always cells."""
    return _with_conditions(df, key, tables, per_table, seed, with_aggs, count_range=False)


def group_by_items(columns: str, first_row: str, seed: int, key: list[str]) -> str:
    """SELECT list of a GROUP BY: the drawn group column plain, others aggregated.

    Numeric columns (by their first value) get a drawn aggregate, others COUNT.
    """
    k = (seed, *key)
    agg = lambda g, i: (
        f"CASE WHEN {i} = {g} THEN '' WHEN {is_number(f'get({first_row}, {i})')} "
        f"THEN {draw_item(AGGREGATES, *k, lit('agg'), i)} ELSE 'COUNT' END"
    )
    return let(
        draw_below(f"size({columns})", *k, lit("group")),
        lambda g: transform(columns, lambda c, i: struct(col=c, pos=i, agg=agg(g, i))),
    )


def generate_group_by(
    df: DataFrame, key: str, columns: str, first_row: str, name: str, per_table: int, seed: int
) -> DataFrame:
    """GROUP BY queries: ``(key, query_no, items, group_pos, text)``.

    ``columns``, ``first_row`` and ``name`` are expressions on the table rows.
    """
    tables = df.selectExpr(key, f"{columns} AS columns", f"{first_row} AS first_row", f"{name} AS table_name")
    queries = with_query_numbers(tables.where("size(columns) > 0"), per_table).withColumn(
        "items", F.expr(group_by_items("columns", "first_row", seed, [key, "query_no"]))
    )
    plain = where("items", lambda x: f"{x}.agg = ''")
    group = f"get({plain}, 0)"
    text = (
        f"concat('SELECT ', array_join({transform('items', item_text)}, ', '), ' FROM ', table_name, "
        f"' GROUP BY ', {let(group, item_text)})"
    )
    return queries.selectExpr(key, "query_no", "items", f"{group}.pos AS group_pos", f"{text} AS text")


def _aggregate_result() -> Column:
    """The one aggregate that the group's item names.

    Each aggregate is fed only with the rows of its own items.
    """
    only = lambda *names: F.when(F.col("agg").isin(*names), F.col("number"))
    return (
        F.when(F.col("agg") == "COUNT", F.count("cell").cast(RESULT_TYPE))
        .when(F.col("agg") == "SUM", F.try_sum(only("SUM")).cast(RESULT_TYPE))
        .when(F.col("agg") == "AVG", F.round(F.try_avg(only("AVG")), MEAN_PLACES).cast(RESULT_TYPE))
        .when(F.col("agg") == "MAX", F.max(only("MAX")))
        .otherwise(F.min(only("MIN", "")))
    )


def decimal_text(value: str) -> str:
    """Decimal without trailing zeros."""
    return f"regexp_replace(CAST({value} AS string), '[.]?0+$', '')"


def row_holds(cells: str, conditions: str) -> str:
    """Whether a row's cells meet plain conditions on their table."""
    return holds_all(conditions, _cells_hold(cells))


def with_where(queries: DataFrame, wheres: DataFrame, key: str) -> DataFrame:
    """GROUP BY queries with the WHERE of their number; one without conditions has none."""
    group = f"concat(' GROUP BY ', {let('get(items, group_pos)', item_text)})"
    select = f"substring(text, 1, length(text) - length({group}))"
    clause = f"if(size(wheres) > 0, concat(' WHERE ', {conditions_text('wheres')}), '')"
    plain = F.coalesce("conditions", F.array().cast(CONDITION_DDL)).alias("wheres")
    met = queries.join(wheres.select(key, "query_no", "conditions"), [key, "query_no"], "left")
    return met.select(*queries.columns, plain).withColumn("text", F.expr(f"concat({select}, {clause}, {group})"))


def _dealt(joined: DataFrame, rows: DataFrame, wanted: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Rows of queries in tasks of about :data:`ROWS_PER_TASK`, as many as the rows need.

    A task's groups take memory; without this, as few tasks as there are cores would
    share the groups of any number of rows.
    """
    queries = wanted.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    parts = -(-rows.count() * queries // ROWS_PER_TASK)
    return joined.repartition(parts, *by) if parts > 1 else joined


def having_from_groups(
    rows: DataFrame,
    queries: DataFrame,
    key: str,
    row_id: str,
    seed: int,
    salts: int = 32,
    wheres: DataFrame | None = None,
) -> DataFrame:
    """Full ``SELECT … [WHERE …] GROUP BY … HAVING …`` queries with their answer size.

    ``rows`` holds the tables as flat rows ``(key, row_id, cells)`` of any
    number per key, ``queries`` comes from :func:`generate_group_by`. Every GROUP BY runs
    once for all tables; the HAVING constants are drawn from its results, the
    query is checked by filtering the groups. A query without a usable
    condition has empty text and is not valid.

    ``wheres`` holds plain conditions ``(key, query_no, conditions)`` on positions of
    ``cells``, as :func:`generate_where` makes them. They filter the rows before they are
    grouped, so the constants come from the groups that are left; a query that no row
    is left for has empty text, no groups, and is not valid.

    The joins on the table key spread hot tables and the groups are aggregated
    per task first, so a table that holds most of the rows is not one task's
    work. The grouped results are read several times, so they are written once.
    """
    used = where("items", lambda x: f"{x}.agg != '' OR size(items) = 1")
    if wheres is not None:
        queries = with_where(queries, wheres, key)
    extra = ["wheres"] if wheres is not None else []
    wanted = queries.select(key, "query_no", "group_pos", F.expr(used).alias("items"), *extra)
    joined = _dealt(spread_join(rows, wanted, [key], [row_id], salts=salts), rows, wanted, key, [row_id, "query_no"])
    if wheres is not None:
        joined = joined.where(f"size(wheres) = 0 OR {row_holds('cells', 'wheres')}")
    cells = (
        joined.selectExpr(
            key, "query_no", "get(cells, group_pos) AS group_value", "cells", "posexplode(items) AS (item_no, item)"
        )
        .selectExpr(
            key,
            "query_no",
            "group_value",
            "item_no",
            "item.col AS col",
            "item.agg AS agg",
            "get(cells, item.pos) AS cell",
        )
        .withColumn("number", F.expr(f"if(agg = 'COUNT', NULL, try_cast(cell AS {RESULT_TYPE}))"))
    )
    results = cut_lineage(
        cells.groupBy(key, "query_no", "group_value", "item_no", "col", "agg").agg(
            _aggregate_result().alias("result")
        )
    )
    place = draw(seed, key, "query_no", "item_no", lit("value"), "coalesce(group_value, '')")
    constants = (
        results.groupBy(key, "query_no", "item_no", "col", "agg")
        .agg(F.expr(f"min_by(result, struct({place}, coalesce(group_value, '')))").alias("result"))
        .groupBy(key, "query_no")
        .agg(F.sort_array(F.collect_list(F.struct("item_no", "col", "agg", "result"))).alias("items"))
    )
    k = (seed, key, "query_no")
    keep = f"{draw_below('size(items)', *k, lit('n'))} + 1"
    usable = where(_drawn_order("items", keep, *k), lambda x: f"{x}.result IS NOT NULL")
    condition = lambda items: lambda x, j: struct(
        item_no=f"{x}.item_no",
        col=f"{x}.col",
        agg=f"{x}.agg",
        op=draw_item(NUMERIC_OPS, *k, lit("op"), j),
        val=decimal_text(f"{x}.result"),
        result=f"{x}.result",
        is_num="true",
        connector=f"if({j} < size({items}) - 1, {draw_item(CONNECTORS, *k, lit('link'), j)}, '')",
    )
    having = constants.select(
        key, "query_no", F.expr(let(usable, lambda items: transform(items, condition(items)))).alias("conditions")
    )
    groups = results.groupBy(key, "query_no", "group_value").agg(
        F.map_from_entries(F.collect_list(F.struct("item_no", "result"))).alias("results")
    )
    holds = lambda c: _compare(f"try_element_at(results, {c}.item_no)", f"{c}.op", f"{c}.result")
    survivors = (
        spread_join(groups, having, [key, "query_no"], ["group_value"], salts=salts)
        .withColumn("kept", F.expr(f"size(conditions) > 0 AND {holds_all('conditions', holds)}"))
        .groupBy(key, "query_no")
        .agg(F.count("*").alias("n_groups"), F.count_if("kept").alias("n_kept"))
    )
    full = f"if(size(conditions) > 0, concat(text, ' HAVING ', {conditions_text('conditions')}), '')"
    if wheres is not None:
        return (
            queries.select(key, "query_no", "text")
            .join(having, [key, "query_no"], "left")
            .join(survivors, [key, "query_no"], "left")
            .selectExpr(
                key,
                "query_no",
                f"coalesce({full}, '') AS text",
                "coalesce(size(conditions) > 0, false) AS valid",
                "coalesce(n_groups, 0) AS n_groups",
                "coalesce(n_kept, 0) AS n_kept",
            )
        )
    return (
        queries.select(key, "query_no", "text")
        .join(having, [key, "query_no"])
        .join(survivors, [key, "query_no"])
        .selectExpr(
            key, "query_no", f"{full} AS text", "size(conditions) > 0 AS valid", "n_groups", "n_kept"
        )
    )


def run_generated_two(queries: DataFrame, key: str, first: str, second: str, on: str) -> DataFrame:
    """Answers of plain conditions over two tables, on their join by ``on``.

    A column of both tables is meant as the first table's, which owns it.
    """

    def answer(joined: str) -> str:
        position = lambda c: (
            f"coalesce({column_position(joined, f'{c}.col')}, "
            f"{column_position(joined, f'concat({c}.col, ' + lit('_x') + ')')})"
        )
        fields = ("col", "owner", "agg", "op", "val", "is_num", "connector")
        moved = transform(
            "conditions", lambda c: struct(pos=position(c), **{name: f"{c}.{name}" for name in fields})
        )
        return let(moved, lambda conditions: matching_rows(joined, conditions))

    return queries.select(
        key, "query_no", "text", F.expr(let(join_tables(first, second, lit(on)), answer)).alias("answer_rows")
    )


def run_generated(queries: DataFrame, key: str, table: str = "table") -> DataFrame:
    """Answers of generated WHERE queries; HAVING-only ones are not valid."""
    has_agg = exists("conditions", lambda c: f"{c}.agg != ''")
    return queries.withColumn("valid", F.expr(f"NOT {has_agg} AND size(conditions) > 0")).selectExpr(
        key,
        "query_no",
        "if(valid, text, '') AS text",
        "valid",
        f"if(valid, {matching_rows(table, 'conditions')}, NULL) AS answer_rows",
    )
