"""Queries over tables of any size: shards with a manifest, comparison, text in fragments, a log with many writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabchain.operators.positions import with_shuffled_position
from tabchain.operators.table_diff import compare_tables
from tabchain.plans.fragments import html_fragments, markdown_fragments
from tabchain.session import scratch_path
from tabchain.sources import chain_log as log
from tabchain.sources.shard_store import read_manifest, read_shards_of, write_shard_store
from workload import sql_parts as q
from workload.corpora import chain_log, single_texts, table
from workload.texts import LOG_SQL

SEED = 3
SHARD = 100


def shard_store(spark: SparkSession, d: str) -> DataFrame:
    """All shards of a corpus, read back through the manifest, beside what it says of them."""
    root = scratch_path(spark, "shard-store")
    write_shard_store(with_shuffled_position(single_texts(spark, d), "sample_id", SEED), root, SHARD)
    rows = read_shards_of(spark, root).groupBy("shard_id").agg(F.count("*").alias("samples"), F.sum(F.length("source")).alias("chars"))
    return rows.join(read_manifest(spark, root).select("shard_id", "rows", "first_position"), "shard_id")


SHARDS_SQL = f"""
WITH {q.SINGLE_CTE}, p AS (SELECT length({q.SINGLE_QUERY_OUT} || ' ' || tbl) AS chars,
  row_number() OVER (ORDER BY {q.draw(SEED, 'sample_id')}, sample_id) - 1 AS pos FROM src)
SELECT pos // {SHARD} AS shard_id, count(*) AS samples, sum(chars)::BIGINT AS chars, count(*) AS rows, min(pos) AS first_position FROM p GROUP BY 1"""


def _predicted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and a prediction of them with changed, missing and repeated rows."""
    truth = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    status = F.when(F.col("o_orderkey") % 97 == 0, F.lit("?")).otherwise(F.col("o_orderstatus"))
    pred = truth.where("o_orderkey % 103 <> 0").withColumn("o_orderstatus", status)
    return truth, pred.union(pred.where("o_orderkey % 101 = 0"))


def table_diff(spark, d):
    """Rows whose counts differ between the two."""
    return compare_tables(*_predicted(spark, d)).differences


DIFF_SQL = """
WITH p AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN '?' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 103 <> 0),
b AS (SELECT o_orderkey, o_custkey, o_orderstatus, 1 AS t, 0 AS p FROM orders UNION ALL SELECT *, 0, 1 FROM p UNION ALL SELECT *, 0, 1 FROM p WHERE o_orderkey % 101 = 0)
SELECT o_orderkey, o_custkey, o_orderstatus, sum(t)::BIGINT AS n_truth, sum(p)::BIGINT AS n_pred FROM b GROUP BY ALL HAVING sum(t) <> sum(p)"""


def table_columns(spark, d):
    """Columns of customers found by their values in a permuted and renamed copy, and whether the rows are the same."""
    truth = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    copy = truth.select(F.col("c_mktsegment").alias("a"), F.col("c_custkey").alias("b"), F.col("c_nationkey").alias("c_name"), F.col("c_name").alias("c"))
    shuffled = copy.withColumn("b", F.lit(1) + F.col("b") - 1).orderBy(F.desc("b"))
    broken = shuffled.withColumn("a", F.when(F.col("b") == 1, "?").otherwise(F.col("a")))
    rows = []
    for name, other in (("copy", shuffled), ("broken", broken)):
        found = compare_tables(truth, other, by_content=True)
        rows += [(name, c, p, found.equal) for c, p in found.columns.items()]
    return spark.createDataFrame(rows, "version string, truth_column string, pred_column string, equal boolean")


_COLUMN_PAIRS = [("c_custkey", "b"), ("c_name", "c"), ("c_nationkey", "c_name"), ("c_mktsegment", "a")]
_SAME = lambda a, b: f"NOT EXISTS (SELECT {a}::VARCHAR FROM customer EXCEPT ALL SELECT {b}::VARCHAR FROM {{t}})"
COLUMNS_SQL = f"""
WITH copy AS (SELECT c_mktsegment AS a, c_custkey AS b, c_nationkey AS c_name, c_name AS c FROM customer),
broken AS (SELECT CASE WHEN b = 1 THEN '?' ELSE a END AS a, b, c_name, c FROM copy)
{' UNION ALL '.join(f"SELECT '{t}' AS version, '{a}' AS truth_column, '{b}' AS pred_column, "
  f"NOT EXISTS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer EXCEPT ALL SELECT b, c, c_name, a FROM {t}) AS equal WHERE {_SAME(a, b).format(t=t)}"
  for t in ('copy', 'broken') for a, b in _COLUMN_PAIRS)}"""


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"))


def markdown_large(spark, d):
    """All customers as one padded pipe table, a fragment per row."""
    return markdown_fragments(_customers(spark, d), "c_custkey")


def html_large(spark, d):
    """All customers as one HTML table, a fragment per row."""
    return html_fragments(_customers(spark, d), "c_custkey")


_LINES = """
t AS (SELECT *, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE '' END AS segment, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer)"""
MARKDOWN_SQL = f"""
WITH {_LINES},
w AS (SELECT greatest(2, length(max(k)::VARCHAR)) AS i, greatest(11, max(length(c_custkey::VARCHAR))) AS a, greatest(8, max(length(c_name))) AS b,
  greatest(13, max(length(c_nationkey::VARCHAR))) AS c, greatest(9, max(length(segment))) AS d FROM t)
SELECT 0::BIGINT AS place, '| ' || repeat(' ', i) || ' | ' || lpad('c_custkey', a::INTEGER, ' ') || ' | ' || rpad('c_name', b::INTEGER, ' ') || ' | ' ||
  lpad('c_nationkey', c::INTEGER, ' ') || ' | ' || rpad('segment', d::INTEGER, ' ') || ' |' AS text FROM w
UNION ALL SELECT 1, '|' || repeat('-', i + 1) || ':|' || repeat('-', a + 1) || ':|:' || repeat('-', b + 1) || '|' || repeat('-', c + 1) || ':|:' || repeat('-', d + 1) || '|' FROM w
UNION ALL SELECT k + 2, '| ' || lpad(k::VARCHAR, i::INTEGER, ' ') || ' | ' || lpad(c_custkey::VARCHAR, a::INTEGER, ' ') || ' | ' || rpad(c_name, b::INTEGER, ' ') || ' | ' ||
  lpad(c_nationkey::VARCHAR, c::INTEGER, ' ') || ' | ' || rpad(segment, d::INTEGER, ' ') || ' |' FROM t, w"""

_TD = lambda c: f"'      <td>' || {c} || '</td>' || chr(10)"
HTML_SQL = f"""
WITH {_LINES}
SELECT 0::BIGINT AS place, '<table border="1" class="dataframe">' || chr(10) || '  <thead>' || chr(10) || '    <tr style="text-align: right;">' || chr(10) || '      <th></th>' || chr(10) ||
  {' || '.join(f"'      <th>{c}</th>' || chr(10)" for c in ('c_custkey', 'c_name', 'c_nationkey', 'segment'))} || '    </tr>' || chr(10) || '  </thead>' || chr(10) || '  <tbody>' || chr(10) AS text
UNION ALL SELECT k + 1, '    <tr>' || chr(10) || '      <th>' || k || '</th>' || chr(10) || {' || '.join(map(_TD, ('c_custkey', 'c_name', 'c_nationkey', 'segment')))} || '    </tr>' || chr(10) FROM t
UNION ALL SELECT coalesce(max(k), -1) + 2, '  </tbody>' || chr(10) || '</table>' FROM t"""


def _written_log(spark: SparkSession, d: str) -> DataFrame:
    """The chain log by two writers with three batches each: one sent twice, a compaction, and one sent again after it."""
    path = scratch_path(spark, "chain-log")
    rows = chain_log(spark, d).select(
        F.col("seq").cast("int").alias("place"),
        F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, seq % 60)").alias("logged_at"),
        "query", "chain", "answer",
    )
    batch = lambda writer, number: log.write_batch(
        rows.where((F.col("place") % 2 == writer) & (F.col("place") % 3 == number)), path, f"w{writer}", number
    )
    for writer, number in ((0, 0), (1, 0), (0, 1), (0, 0)):
        batch(writer, number)
    log.compact(spark, path)
    for writer, number in ((1, 1), (0, 2), (0, 1), (1, 2)):
        batch(writer, number)
    return log.read_log(spark, path)


def log_writers(spark, d):
    return _written_log(spark, d).withColumn("logged_at", F.unix_timestamp("logged_at"))


WRITERS_SQL = f"""
WITH {LOG_SQL}
SELECT 'w' || (seq % 2) AS writer, (seq % 3)::BIGINT AS batch, seq::INTEGER AS place, 1704067200 + seq % 60 AS logged_at, query, chain, answer FROM log"""


def log_last(spark, d):
    """The last five chains of that log."""
    return log.last_logged(_written_log(spark, d)).select("writer", "batch", "place", "query", "chain")


QUERIES = {
    "shard_store": (shard_store, SHARDS_SQL),
    "table_diff": (table_diff, DIFF_SQL),
    "table_columns": (table_columns, COLUMNS_SQL),
    "markdown_large": (markdown_large, MARKDOWN_SQL),
    "html_large": (html_large, HTML_SQL),
    "chain_log_writers": (log_writers, WRITERS_SQL),
    "chain_log_last": (log_last, f"SELECT writer, batch, place, query, chain FROM ({WRITERS_SQL}) ORDER BY logged_at DESC, writer DESC, batch DESC, place DESC LIMIT 5"),
}
