"""Sample corpora that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabchain.functions.cells import table_value, text_array
from tabchain.functions.linear import linear_source, linear_target
from tabchain.functions.sqltext import lit
from tabchain.operators.nesting import nest_rows

SINGLE_ROWS = 8  # orders per single-table sample
MULTI_ORDERS, MULTI_CUSTOMERS = 20, 2  # rows per table of a multi-table sample
SINGLE_QUERY = "select o_orderkey , o_orderdate from w where o_orderstatus <> 'O' and o_orderstatus <> 'P'"
MULTI_QUERY = "Which orders are finished ?"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def split_name() -> Column:
    """Split of a sample: one in ten for test, one in ten for validation."""
    rest = F.col("sample_id") % 10
    return F.when(rest == 0, "test").when(rest == 1, "validation").otherwise("train")


def order_tables(spark: SparkSession, d: str, rows_per_table: int = SINGLE_ROWS) -> DataFrame:
    """``(sample_id, table)``: blocks of orders by order key."""
    return nest_rows(
        table(spark, d, "orders"),
        [],
        "o_orderkey",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"],
        rows_per_table,
    ).withColumnRenamed("part_no", "sample_id")


#: Key and date of the finished orders of a block.
FINISHED = table_value(
    text_array(["o_orderkey", "o_orderdate"]),
    "transform(filter(table.rows, r -> get(r, 2) = 'F'), r -> array(get(r, 0), get(r, 3)))",
)


def single_samples(spark: SparkSession, d: str) -> DataFrame:
    """``(sample_id, query, table, answer)``"""
    return order_tables(spark, d).select(
        "sample_id", F.lit(SINGLE_QUERY).alias("query"), "table", F.expr(FINISHED).alias("answer")
    )


def single_texts(spark: SparkSession, d: str) -> DataFrame:
    """``(sample_id, source, target)`` in linear single-table form."""
    return single_samples(spark, d).selectExpr(
        "sample_id",
        f"{linear_source('query', 'array(table)', 'array(' + lit('') + ')')} AS source",
        f"{linear_target('answer')} AS target",
    )


def multi_samples(spark: SparkSession, d: str) -> DataFrame:
    """``(sample_id, split, query, table_names, tables, answer)``: orders and customers."""
    orders = order_tables(spark, d, MULTI_ORDERS)
    customers = nest_rows(
        table(spark, d, "customer"),
        [],
        "c_custkey",
        ["c_custkey", "c_name", "c_mktsegment"],
        MULTI_CUSTOMERS,
    ).select(F.col("part_no").alias("sample_id"), F.col("table").alias("customers"))
    return orders.join(customers, "sample_id").select(
        "sample_id",
        split_name().alias("split"),
        F.lit(MULTI_QUERY).alias("query"),
        F.array(F.lit("orders"), F.lit("customer")).alias("table_names"),
        F.array("table", "customers").alias("tables"),
        F.expr(FINISHED).alias("answer"),
    )


def query_texts(spark: SparkSession, d: str) -> DataFrame:
    """``(c_custkey, query)``: generated-looking queries with split operators."""
    c = table(spark, d, "customer")
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    text = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("SELECT c_name  FROM customer WHERE c_nationkey ! = "), nation))
        .when(
            F.col("c_custkey") % 4 == 1,
            F.concat(F.lit("select count(*) from customer where c_custkey > = "), key, F.lit(" and c_nationkey <> "), nation),
        )
        .when(
            F.col("c_custkey") % 4 == 2,
            F.concat(
                F.lit("Select c_name From customer Where c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey < = "),
                nation,
                F.lit(" )"),
            ),
        )
        .otherwise(F.concat(F.lit(" SELECT "), F.col("c_mktsegment"), F.lit("\t> = 1 ! =")))
    )
    return c.select("c_custkey", text.alias("query"))


def chain_log(spark: SparkSession, d: str) -> DataFrame:
    """``(seq, query, chain, answer)``: one logged chain per customer."""
    c = table(spark, d, "customer")
    nation = F.col("c_nationkey").cast("string")
    chain = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("<BEGIN> -> filter("), nation, F.lit(") -> sort(c_name) -> <END>")))
        .when(F.col("c_custkey") % 3 == 1, F.lit("group_by(c_mktsegment) -> sort(count) -> limit(5) -> <END>"))
        .otherwise(F.concat(F.lit("<BEGIN> ->join(nation)-> filter("), nation, F.lit(") -> <END>")))
    )
    return c.select(
        F.col("c_custkey").alias("seq"),
        F.concat(F.lit("Which customers are like "), "c_name", F.lit("?")).alias("query"),
        chain.alias("chain"),
        F.col("c_mktsegment").alias("answer"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """``(sample_id, prediction)``: the targets, some in capitals, some wrong, some NULL."""
    return single_texts(spark, d).select(
        "sample_id",
        F.when(F.col("sample_id") % 13 == 0, F.lit(None))
        .when(F.col("sample_id") % 11 == 0, F.concat("target", F.lit(" ?")))
        .when(F.col("sample_id") % 7 == 0, F.upper("target"))
        .otherwise(F.col("target"))
        .alias("prediction"),
    )
