"""Queries that generate queries over flat tables, and run all of them in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabchain.operators import flat_queries, generation as g
from tabchain.operators.steps import CONNECTORS, NUMERIC_OPS, STRING_OPS
from workload import sql_parts as q
from workload.corpora import table
from workload.generated import _NUMBER, SEED
from workload.sql_parts import quoted

KEY = "o_orderpriority"
COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
CONSTANTS = 40  # per table and column
PER_TABLE = 200  # of five tables: 1,000 queries


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as five flat tables, one per priority; some cells are NULL."""
    price = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice").cast("decimal(15,2)"))
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(KEY, "o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice"), day.alias("o_orderdate"))


def constants(spark, d):
    return flat_queries.drawn_constants(_rows(spark, d), KEY, "o_orderkey", COLUMNS, CONSTANTS, SEED)


def _generated(spark, d) -> DataFrame:
    tables = flat_queries.constant_tables(_rows(spark, d), KEY, "o_orderkey", COLUMNS, CONSTANTS, SEED)
    return g.generate_where(tables, KEY, "table", PER_TABLE, SEED)


def where_flat(spark, d):
    return _generated(spark, d).select(KEY, "query_no", "text")


def execute_flat(spark, d):
    """A thousand generated queries over flat tables, counted in one pass."""
    return flat_queries.count_matches(_rows(spark, d), KEY, _generated(spark, d))


_KEY = (SEED, KEY, "query_no")
_FLAT = f"""
flat AS (SELECT {KEY}, o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice::DECIMAL(15,2) END::VARCHAR AS o_totalprice, o_orderdate::DATE::VARCHAR AS o_orderdate FROM orders),
cells AS ({' UNION ALL '.join(f"SELECT {KEY}, o_orderkey, {i} AS i, '{c}' AS col, {c} AS val FROM flat" for i, c in enumerate(COLUMNS))}),
consts AS (SELECT {KEY}, i, col, val, row_number() OVER (PARTITION BY {KEY}, col ORDER BY {q.draw(SEED, KEY, 'col', 'o_orderkey')}, o_orderkey)::INTEGER AS rank
  FROM cells WHERE val IS NOT NULL QUALIFY rank <= {CONSTANTS})"""

CONSTANTS_SQL = f"WITH {_FLAT} SELECT {KEY}, col, rank, val FROM consts"

_CONDITIONS = f"""
{_FLAT},
sizes AS (SELECT {KEY}, i, count(*) AS n_values FROM consts GROUP BY 1, 2),
qn AS (SELECT {KEY}, unnest(range(0, {PER_TABLE}))::INTEGER AS query_no FROM (SELECT DISTINCT {KEY} FROM orders)),
qk AS (SELECT *, {q.draw(*_KEY, quoted('n'))} % {len(COLUMNS)} + 1 AS keep FROM qn),
ordered AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, query_no ORDER BY {q.draw(*_KEY, quoted('col'), 'i')}, i) - 1 AS j
  FROM qk, (SELECT unnest(range(0, {len(COLUMNS)})) AS i)),
drawn AS (SELECT o.*, ({q.draw(SEED, 'o.' + KEY, 'o.query_no', quoted('row'), 'o.j')} % {CONSTANTS}) % n_values + 1 AS rank
  FROM ordered o JOIN sizes s ON s.{KEY} = o.{KEY} AND s.i = o.i WHERE j < keep),
valued AS (SELECT d.{KEY}, d.query_no, d.j, d.keep, c.col, c.val, regexp_full_match(c.val, {_NUMBER}) AS is_num
  FROM drawn d JOIN consts c ON c.{KEY} = d.{KEY} AND c.i = d.i AND c.rank = d.rank),
conds AS (SELECT *, CASE WHEN is_num THEN {q.item(NUMERIC_OPS, q.draw(*_KEY, quoted('op'), 'j'))} ELSE {q.item(STRING_OPS, q.draw(*_KEY, quoted('op'), 'j'))} END AS op,
  CASE WHEN j < keep - 1 THEN {q.item(CONNECTORS, q.draw(*_KEY, quoted('link'), 'j'))} ELSE '' END AS link FROM valued),
texts AS (SELECT {KEY}, query_no, string_agg('`' || col || '` ' || op || ' ' || CASE WHEN is_num THEN val ELSE '''' || val || '''' END ||
  CASE WHEN link = '' THEN '' ELSE ' ' || link END, ' ' ORDER BY j) AS text FROM conds GROUP BY 1, 2)"""

WHERE_SQL = f"WITH {_CONDITIONS} SELECT {KEY}, query_no, text FROM texts"

_COMPARE = lambda a, b: (
    f"CASE op WHEN '=' THEN {a} = {b} WHEN '!=' THEN {a} <> {b} WHEN '<' THEN {a} < {b} WHEN '>' THEN {a} > {b} "
    f"WHEN '<=' THEN {a} <= {b} WHEN '>=' THEN {a} >= {b} END"
)
EXECUTE_SQL = f"""
WITH {_CONDITIONS},
linked AS (SELECT *, coalesce(sum((link = 'OR')::INTEGER) OVER (PARTITION BY {KEY}, query_no ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM conds),
truth AS (SELECT l.{KEY}, query_no, grp, o_orderkey, bool_and(coalesce(CASE WHEN is_num
  THEN {_COMPARE('try_cast(c.val AS DECIMAL(28,4))', 'try_cast(l.val AS DECIMAL(28,4))')} ELSE {_COMPARE('c.val', 'l.val')} END, false)) AS ok
  FROM linked l JOIN cells c ON c.{KEY} = l.{KEY} AND c.col = l.col GROUP BY ALL),
hits AS (SELECT {KEY}, query_no, count(DISTINCT o_orderkey) FILTER (ok) AS n FROM truth GROUP BY ALL)
SELECT {KEY}, query_no, text, true AS valid, n AS n_rows FROM texts JOIN hits USING ({KEY}, query_no)"""

QUERIES = {
    "flat_constants": (constants, CONSTANTS_SQL),
    "gen_where_flat": (where_flat, WHERE_SQL),
    "gen_execute_flat": (execute_flat, EXECUTE_SQL),
}
