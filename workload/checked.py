"""Queries over chains that fail at run time, their logs and previews, and tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabchain.functions.cells import number_text
from tabchain.functions.formats import format_column, render_table
from tabchain.functions.text import model_text
from tabchain.plans.chain import ChainResult, Step, run_chain
from tabchain.plans.checked import run_checked
from tabchain.session import scratch_path
from tabchain.sources.registry import decode_latin1, load_named, load_parquet, read_indexed_csvs, view_tables
from workload.corpora import order_tables, table

STEPS = [
    Step("filter", {"conditions": [("o_orderstatus", "!=", "P")]}, on="orders"),
    Step("add_column", {"name": "level", "expr": "cast(o_orderpriority as int)"}),
    Step("filter", {"where": "level > 2"}),
    Step("add_column", {"name": "month", "expr": "month(o_orderdate)"}),
    Step("filter", {"where": "1000 div (month - 2) > 0"}),
    Step("aggregate", {"by": "month", "aggs": {"n": "count(*)", "last": "max(o_orderkey)"}}),
    Step("sort", {"by": "month"}),
]
LOG_COLUMNS = ["step_no", "op", "status", "condition"]


def _checked(spark: SparkSession, d: str) -> ChainResult:
    return run_checked(STEPS, load_parquet(spark, d, ["orders"]))


def last_good(spark, d):
    """Orders per month, by a chain of which three steps are left out: a cast of text, a filter on it, a division by zero."""
    return _checked(spark, d).inter


def checked_log(spark, d):
    """The log of that chain, with the condition that each error names."""
    log = _checked(spark, d).log_frame(spark)
    condition = F.nullif(F.regexp_extract("error", r"^\[([A-Z0-9_.]+)\]", 1), F.lit(""))
    return log.withColumn("condition", condition).select(*LOG_COLUMNS)


_COUNTED = "SELECT month(o_orderdate)::INTEGER AS month, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1"

# The month is checked where it fails: it does if an order of February is left.
LOG_SQL = """
SELECT step_no::INTEGER AS step_no, op, CASE WHEN condition IS NULL THEN 'ok' ELSE 'error' END AS status, condition FROM (VALUES
  (1, 'filter', NULL),
  (2, 'add_column', CASE WHEN (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P' AND try_cast(o_orderpriority AS INTEGER) IS NULL) > 0 THEN 'CAST_INVALID_INPUT' END),
  (3, 'filter', 'UNRESOLVED_COLUMN.WITH_SUGGESTION'),
  (4, 'add_column', NULL),
  (5, 'filter', CASE WHEN (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P' AND month(o_orderdate) = 2) > 0 THEN 'DIVIDE_BY_ZERO' END),
  (6, 'aggregate', NULL), (7, 'sort', NULL)) t(step_no, op, condition)"""


def step_preview(spark, d):
    """First 50 customers of a chain as Markdown."""
    steps = [
        Step("select", {"columns": ["c_custkey", "c_name", "c_mktsegment"]}, on="customer"),
        Step("sort", {"by": "c_custkey"}),
    ]
    text = run_chain(steps, load_parquet(spark, d, ["customer"])).preview()
    return spark.createDataFrame([(text,)], "preview string")


PREVIEW_SQL = """
SELECT '|  | c_custkey | c_name | c_mktsegment |' || chr(10) || '|---:|:---|:---|:---|' || chr(10) ||
  string_agg('| ' || k || ' | ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |', chr(10) ORDER BY k) AS preview
FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer) WHERE k < 50"""


def indexed_csvs(spark, d):
    """Tables as CSV files with an index column in front, read back by number and joined."""
    paths = []
    for name, columns in (("customer", ["c_custkey", "c_nationkey"]), ("nation", ["n_nationkey", "n_name"])):
        paths.append(scratch_path(spark, f"csv-{name}"))
        index = F.col(columns[0]).alias("index")
        table(spark, d, name).select(index, *columns).write.option("header", True).csv(paths[-1])
    schemas = ["index bigint, c_custkey bigint, c_nationkey int", "index int, n_nationkey int, n_name string"]
    read_indexed_csvs(spark, paths, schemas)
    return spark.sql("SELECT n_name, count(*) AS n FROM df1 JOIN df2 ON c_nationkey = n_nationkey GROUP BY n_name")


def named_tables(spark, d):
    """A catalog table with ISO-8859-1 bytes, read by name and decoded."""
    raw = table(spark, d, "customer").selectExpr("c_custkey", "encode(concat('é ', c_name), 'ISO-8859-1') AS name", "c_mktsegment")
    raw.createOrReplaceTempView("raw_customer")
    return decode_latin1(load_named(spark, ["raw_customer"])["raw_customer"])


def tables_view(spark, d):
    """First ten rows of two tables under their names."""
    tables = load_parquet(spark, d, ["nation", "customer"])
    tables["nation"] = tables["nation"].select("n_nationkey", "n_name").orderBy("n_nationkey")
    tables["customer"] = tables["customer"].select("c_custkey", "c_name").orderBy("c_custkey")
    return spark.createDataFrame([(view_tables(tables, ["nation", "customer"]),)], "view string")


def _view_sql(name: str, key: str, value: str) -> str:
    return f"""(SELECT '{name}:' || chr(10) || '|  | {key} | {value} |' || chr(10) || '|---:|:---|:---|' || chr(10) ||
  string_agg('| ' || k || ' | ' || {key} || ' | ' || {value} || ' |', chr(10) ORDER BY k)
  FROM (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS k FROM {name}) WHERE k < 10)"""


VIEW_SQL = f"""
SELECT 'Here are .head(10) of the dataframes you requested to see:' || chr(10) || {_view_sql('nation', 'n_nationkey', 'n_name')} || chr(10) ||
  {_view_sql('customer', 'c_custkey', 'c_name')} AS view"""


def number_cells(spark, d):
    """Prices and their parts as cell text."""
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber",
        f"{number_text('l_extendedprice')} AS price", f"{number_text('l_discount')} AS discount", f"{number_text('l_quantity * 1e9D')} AS large",
    )


_PLAIN = lambda c: f"CASE WHEN {c} = floor({c}) THEN {c}::DECIMAL(38,0)::VARCHAR || '.0' ELSE {c}::VARCHAR END"
NUMBER_SQL = f"""
SELECT l_orderkey, l_partkey, l_linenumber, {_PLAIN('l_extendedprice')} AS price, {_PLAIN('l_discount')} AS discount, {_PLAIN('(l_quantity * 1e9)')} AS large FROM lineitem"""


def format_columns(spark, d):
    """Every block of orders as Markdown and its model form, under the names of the source columns."""
    source, target = format_column("source", "markdown"), format_column("target", "markdown")
    found = order_tables(spark, d).select("sample_id", F.expr(render_table("table", "markdown")).alias(source))
    return found.withColumn(target, F.expr(model_text(source)))


FORMAT_SQL = """
WITH s AS (SELECT o_orderkey // 8 AS sample_id, row_number() OVER (PARTITION BY o_orderkey // 8 ORDER BY o_orderkey) - 1 AS k, o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders),
t AS (SELECT sample_id, '|  | o_orderkey | o_custkey | o_orderstatus | o_orderdate |' || chr(10) || '|---:|:---|:---|:---|:---|' || chr(10) ||
  string_agg('| ' || k || ' | ' || o_orderkey || ' | ' || o_custkey || ' | ' || o_orderstatus || ' | ' || o_orderdate || ' |', chr(10) ORDER BY k) AS source_markdown
  FROM s GROUP BY sample_id)
SELECT sample_id, source_markdown, lower(source_markdown) AS target_markdown FROM t"""

QUERIES = {
    "chain_checked": (last_good, _COUNTED),
    "chain_checked_log": (checked_log, LOG_SQL),
    "step_preview": (step_preview, PREVIEW_SQL),
    "indexed_csvs": (indexed_csvs, "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "named_tables": (named_tables, "SELECT c_custkey, 'é ' || c_name AS name, c_mktsegment FROM customer"),
    "tables_view": (tables_view, VIEW_SQL),
    "number_cells": (number_cells, NUMBER_SQL),
    "format_columns": (format_columns, FORMAT_SQL),
}
