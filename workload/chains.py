"""Queries over flat tables: chains of table steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabchain.operators.positions import numbered
from tabchain.plans.chain import chain
from tabchain.sources.registry import load_parquet, run_sql
from workload.corpora import table


def _tables(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    return load_parquet(spark, d, list(names))


def topk_customers(spark: SparkSession, d: str) -> DataFrame:
    """Five customers of one nation with the most orders, and what they spent.

    Orders are grouped before the join, so a customer with very many orders
    meets the join as one row.
    """
    t = _tables(spark, d, "orders", "customer", "nation")
    t["customer"] = t["customer"].withColumnRenamed("c_custkey", "o_custkey")
    t["nation"] = t["nation"].select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return chain(
        t,
        ("aggregate", {"by": "o_custkey", "aggs": {"n_orders": "count(*)", "spent": "sum(cast(o_totalprice as decimal(18,2)))"}}, "orders"),
        ("join", {"table": "customer", "on": "o_custkey", "match_null_keys": False}),
        ("join", {"table": "nation", "on": "c_nationkey", "match_null_keys": False}),
        ("filter", {"conditions": [("n_name", "=", "NATION_7")]}),
        ("top", {"n": 5, "by": ["n_orders", "o_custkey"], "descending": [True, False]}),
        ("add_column", {"name": "mean_spent", "expr": "cast(spent as double) / n_orders"}),
        ("select", {"columns": ["o_custkey", "c_name", "n_orders", "mean_spent"]}),
    )


TOPK_SQL = """
SELECT o_custkey, c_name, count(*) AS n_orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_spent
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE n_name = 'NATION_7' GROUP BY o_custkey, c_name
ORDER BY n_orders DESC, o_custkey LIMIT 5"""


def filter_select(spark, d):
    return chain(
        _tables(spark, d, "lineitem"),
        ("filter", {"conditions": [("l_quantity", ">=", 30), ("l_returnflag", "=", "R")]}, "lineitem"),
        ("select", {"columns": ["l_orderkey", "l_linenumber", "l_quantity"]}),
    )


def mixed_and_or(spark, d):
    return chain(
        _tables(spark, d, "lineitem"),
        (
            "filter",
            {
                "conditions": [("l_quantity", "<", 5), ("l_returnflag", "=", "R"), ("l_linestatus", "!=", "F"), ("l_linenumber", "<=", 2), ("l_quantity", ">", 45)],
                "connectors": ["AND", "OR", "AND", "AND"],
            },
            "lineitem",
        ),
        ("select", {"columns": ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"]}),
    )


def add_column(spark, d):
    return chain(
        _tables(spark, d, "part"),
        ("add_column", {"name": "brand_no", "split": "p_brand", "separator": "#", "part": 1}, "part"),
        ("add_column", {"name": "size_inch", "expr": "cast(floor(p_size * 100 / 2.54D) as bigint)"}),
        ("add_column", {"name": "last_word", "split": "p_name", "pattern": "([a-z]+)$"}),
        ("select", {"columns": ["p_partkey", "brand_no", "size_inch", "last_word"]}),
    )


def group_count(spark, d):
    return chain(_tables(spark, d, "orders"), ("group_by", {"columns": "o_orderpriority"}, "orders"))


def entity_count(spark, d):
    """How often one customer segment ordered, per priority."""
    t = _tables(spark, d, "orders", "customer")
    t["customer"] = t["customer"].where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return chain(
        t,
        ("group_by", {"columns": ["o_custkey", "o_orderpriority"], "name": "n"}, "orders"),
        ("join", {"table": "customer", "on": "o_custkey", "match_null_keys": False}),
        ("aggregate", {"by": "o_orderpriority", "aggs": {"n_orders": "sum(n)", "n_customers": "count(*)"}}),
    )


def agg_all(spark, d):
    return chain(
        _tables(spark, d, "lineitem"),
        (
            "aggregate",
            {
                "by": ["l_returnflag", "l_linestatus"],
                "aggs": {
                    "sum_price": "cast(sum(cast(l_extendedprice as decimal(18,2))) as double)",
                    "avg_line": "avg(l_linenumber)",
                    "n": "count(l_orderkey)",
                    "min_qty": "min(l_quantity)",
                    "max_price": "max(l_extendedprice)",
                },
            },
            "lineitem",
        ),
    )


def group_mean(spark, d):
    t = {"part": table(spark, d, "part").select("p_type", "p_size", "p_partkey")}
    return chain(t, ("group_mean", {"by": "p_type"}, "part"))


def group_mean_all(spark, d):
    """Means of all numeric columns; the price's mean to six places, as its sum has no fixed order."""
    means = chain({"part": table(spark, d, "part")}, ("group_mean", {"by": "p_type"}, "part"))
    return means.withColumn("p_retailprice", F.round("p_retailprice", 6))


def row_mean(spark, d):
    t = {"lineitem": table(spark, d, "lineitem").withColumn("l_tax", F.expr("nullif(l_tax, 0.0D)"))}
    return chain(
        t,
        ("row_mean", {"columns": ["l_quantity", "l_linenumber", "l_tax"], "name": "row_mean"}, "lineitem"),
        ("select", {"columns": ["l_orderkey", "l_partkey", "l_linenumber", "row_mean"]}),
    )


def _lines_and_orders(spark, d):
    return {
        "lines": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"),
        "orders": table(spark, d, "orders"),
    }


def inner_join(spark, d):
    """Line items grouped per order, then joined: an order with very many lines is one row."""
    return chain(
        _lines_and_orders(spark, d),
        ("aggregate", {"by": "o_orderkey", "aggs": {"n": "count(*)", "q": "cast(sum(l_quantity) as bigint)"}}, "lines"),
        ("join", {"table": "orders", "on": "o_orderkey", "match_null_keys": False}),
        ("aggregate", {"by": "o_orderpriority", "aggs": {"n_lines": "sum(n)", "quantity": "sum(q)"}}),
    )


def skewed_join(spark, d):
    """The same join with the line items of each order spread over salts, per order."""
    return chain(
        _lines_and_orders(spark, d),
        ("join", {"table": "orders", "on": "o_orderkey", "spread_by": ["l_partkey", "l_suppkey", "l_linenumber"]}, "lines"),
        ("aggregate", {"by": "o_orderkey", "aggs": {"priority": "max(o_orderpriority)", "n_lines": "count(*)", "quantity": "cast(sum(l_quantity) as bigint)"}}),
    )


def null_key_join(spark, d):
    """Group counts joined on a key with NULLs: NULL meets NULL, names clash."""
    c = table(spark, d, "customer").select(F.expr("nullif(c_nationkey, 3)").alias("k"), F.col("c_custkey").alias("id"))
    s = table(spark, d, "supplier").select(F.expr("nullif(s_nationkey, 3)").alias("k"), F.col("s_suppkey").alias("id"))
    t = {
        "c": chain({"c": c}, ("group_by", {"columns": "k", "name": "n", "keep_nulls": True}, "c")),
        "s": chain({"s": s}, ("group_by", {"columns": "k", "name": "n", "keep_nulls": True}, "s")),
    }
    joined = chain(t, ("join", {"table": "s", "on": "k", "how": "outer"}, "c"))
    return joined.select(F.coalesce(F.col("k"), F.lit(-1)).alias("k"), F.coalesce("n_x", F.lit(0)).alias("n_x"), F.coalesce("n_y", F.lit(0)).alias("n_y"))


def multi_join(spark, d):
    """Facts grouped per customer, then joined to the metadata tables."""
    t = {
        "orders": table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")),
        "customer": table(spark, d, "customer"),
        "nation": table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"),
        "region": table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"),
    }
    return chain(
        t,
        ("group_by", {"columns": "c_custkey", "name": "n"}, "orders"),
        ("join", {"table": "customer", "on": "c_custkey", "match_null_keys": False}),
        ("join", {"table": "nation", "on": "c_nationkey", "match_null_keys": False}),
        ("join", {"table": "region", "on": "n_regionkey", "match_null_keys": False}),
        ("aggregate", {"by": ["r_name", "c_mktsegment"], "aggs": {"n_orders": "sum(n)"}}),
        ("top", {"n": 7, "by": ["n_orders", "r_name", "c_mktsegment"], "descending": [True, False, False]}),
    )


def argmax(spark, d):
    return chain(
        _tables(spark, d, "customer"),
        ("argmax", {"column": "c_name", "by": "c_acctbal", "tie": "c_custkey", "group": ["c_nationkey"]}, "customer"),
    )


def sort_nulls_last(spark, d):
    """Head of an ascending sort: Spark's own order would put the NULLs first."""
    o = table(spark, d, "orders").withColumn("late", F.expr("nullif(o_orderpriority, '1-URGENT')"))
    return chain(
        {"orders": o},
        ("sort", {"by": ["late", "o_orderkey"]}, "orders"),
        ("limit", {"n": 300}),
        ("select", {"columns": ["o_orderkey", "late"]}),
    )


def sort_all(spark, d):
    """The whole ascending sort, NULLs last, with each row's place in it."""
    o = table(spark, d, "orders").withColumn("late", F.expr("nullif(o_orderpriority, '1-URGENT')"))
    return numbered(
        chain(
            {"orders": o.select("o_orderkey", "late")},
            ("sort", {"by": ["late", "o_orderkey"]}, "orders"),
        )
    )


def tail(spark, d):
    return chain(
        _tables(spark, d, "events"),
        ("tail", {"n": 25, "by": "event_id"}, "events"),
        ("select", {"columns": ["event_id", "user_id", "event_type"]}),
    )


def having(spark, d):
    return chain(
        _tables(spark, d, "lineitem"),
        ("aggregate", {"by": "l_suppkey", "aggs": {"n": "count(*)", "top_line": "max(l_linenumber)"}, "having": "n >= 20 and top_line > 3"}, "lineitem"),
    )


def union(spark, d):
    t = {
        "c": table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("c").alias("kind")),
        "s": table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation")),
    }
    return chain(t, ("union", {"table": "s"}, "c"), ("group_by", {"columns": ["nation", "kind"], "name": "n"}))


_SQL = "SELECT p_brand, count(*) AS n, max(p_size) AS top_size FROM part WHERE p_type <> 'SMALL' GROUP BY p_brand"


def sql_text(spark, d):
    return run_sql(spark, _SQL, _tables(spark, d, "part"))


#: Join types, and whether NULL keys match.
GRID_JOINS = (("inner", True), ("left", False), ("right", True), ("outer", True))


def grid_join_types(spark, d):
    """Customers and suppliers by a key of which a third on either side is one value and a third is NULL, joined in four ways."""
    key = lambda c, n: F.when(F.col(c) % n == 0, None).when(F.col(c) % n == 1, F.lit(0)).otherwise(F.col(c)).alias("k")
    t = {
        "customer": table(spark, d, "customer").select(key("c_custkey", 8), "c_custkey"),
        "supplier": table(spark, d, "supplier").select(key("s_suppkey", 8), "s_suppkey"),
    }
    joined = [
        chain(t, ("join", {"table": "supplier", "on": "k", "how": how, "grid": True, "match_null_keys": match}, "customer"))
        .withColumns({"how": F.lit(how), "null_keys": F.lit(match)})
        for how, match in GRID_JOINS
    ]
    return reduce(DataFrame.unionByName, joined)


def _grid_sql() -> str:
    key = lambda c: f"CASE WHEN {c} % 8 = 0 THEN NULL WHEN {c} % 8 = 1 THEN 0 ELSE {c} END"
    one = lambda how, match: (
        f"SELECT coalesce(a.k, b.k) AS k, c_custkey, s_suppkey, '{how}' AS how, {str(match).lower()} AS null_keys "
        f"FROM a {'FULL' if how == 'outer' else how} JOIN b ON a.k {'IS NOT DISTINCT FROM' if match else '='} b.k"
    )
    return f"""
WITH a AS (SELECT {key('c_custkey')} AS k, c_custkey FROM customer), b AS (SELECT {key('s_suppkey')} AS k, s_suppkey FROM supplier)
{' UNION ALL '.join(one(how, match) for how, match in GRID_JOINS)}"""


QUERIES = {
    "chain_grid_join": (grid_join_types, _grid_sql()),
    "chain_topk_customers": (topk_customers, TOPK_SQL),
    "chain_filter_select": (filter_select, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_returnflag = 'R'"),
    "mixed_and_or": (
        mixed_and_or,
        "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity FROM lineitem "
        "WHERE l_quantity < 5 AND l_returnflag = 'R' OR l_linestatus != 'F' AND l_linenumber <= 2 AND l_quantity > 45",
    ),
    "chain_add_column": (
        add_column,
        "SELECT p_partkey, split_part(p_brand, '#', 2) AS brand_no, CAST(floor(p_size * 100 / 2.54::DOUBLE) AS BIGINT) AS size_inch, "
        "regexp_extract(p_name, '([a-z]+)$', 1) AS last_word FROM part",
    ),
    "chain_group_count": (group_count, 'SELECT o_orderpriority, count(*) AS "count" FROM orders GROUP BY 1'),
    "chain_entity_count": (
        entity_count,
        "SELECT o_orderpriority, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers FROM orders "
        "JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY 1",
    ),
    "chain_agg_all": (
        agg_all,
        "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, avg(l_linenumber) AS avg_line, "
        "count(l_orderkey) AS n, min(l_quantity) AS min_qty, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1, 2",
    ),
    "chain_group_mean": (group_mean, "SELECT p_type, avg(p_size) AS p_size, avg(p_partkey) AS p_partkey FROM part GROUP BY 1"),
    "chain_group_mean_all": (
        group_mean_all,
        "SELECT p_type, avg(p_size) AS p_size, avg(p_partkey) AS p_partkey, round(avg(p_retailprice), 6) AS p_retailprice FROM part GROUP BY 1",
    ),
    "chain_row_mean": (
        row_mean,
        "SELECT l_orderkey, l_partkey, l_linenumber, (l_quantity + l_linenumber::DOUBLE + coalesce(nullif(l_tax, 0), 0)) "
        "/ CASE WHEN l_tax = 0 THEN 2 ELSE 3 END AS row_mean FROM lineitem",
    ),
    "chain_inner_join": (
        inner_join,
        "SELECT o_orderpriority, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS quantity "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    ),
    "chain_skewed_join": (
        skewed_join,
        "SELECT o_orderkey, max(o_orderpriority) AS priority, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS quantity "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    ),
    "chain_null_key_join": (
        null_key_join,
        "WITH c AS (SELECT coalesce(nullif(c_nationkey, 3), -1) AS k, count(*) AS n FROM customer GROUP BY 1), "
        "s AS (SELECT coalesce(nullif(s_nationkey, 3), -1) AS k, count(*) AS n FROM supplier GROUP BY 1) "
        "SELECT k, coalesce(c.n, 0) AS n_x, coalesce(s.n, 0) AS n_y FROM c FULL JOIN s USING (k)",
    ),
    "chain_multi_join": (
        multi_join,
        "SELECT r_name, c_mktsegment, count(*) AS n_orders FROM orders JOIN customer ON c_custkey = o_custkey "
        "JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'F' "
        "GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 7",
    ),
    "chain_argmax": (
        argmax,
        "SELECT c_nationkey, c_name, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey "
        "ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1",
    ),
    "chain_sort_nulls_last": (
        sort_nulls_last,
        "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS late FROM orders ORDER BY late NULLS LAST, o_orderkey LIMIT 300",
    ),
    "chain_sort_all": (
        sort_all,
        "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS late, "
        "row_number() OVER (ORDER BY nullif(o_orderpriority, '1-URGENT') NULLS LAST, o_orderkey) - 1 AS pos FROM orders",
    ),
    "chain_tail": (tail, "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 25"),
    "having_filter": (
        having,
        "SELECT l_suppkey, count(*) AS n, max(l_linenumber) AS top_line FROM lineitem GROUP BY 1 HAVING count(*) >= 20 AND max(l_linenumber) > 3",
    ),
    "chain_union": (
        union,
        "SELECT nation, kind, count(*) AS n FROM (SELECT c_nationkey AS nation, 'c' AS kind FROM customer "
        "UNION ALL SELECT s_nationkey, 's' FROM supplier) GROUP BY 1, 2",
    ),
    "sql_text": (sql_text, _SQL),
}
