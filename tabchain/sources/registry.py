"""Tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabchain.functions.cells import latin1_text, table_value, text_cells
from tabchain.functions.formats import markdown_table

#: Rows of a table view.
VIEW_ROWS = 10
# Fixed value: first line of a view of several tables, with its number of rows.
VIEW_TITLE = "Here are .head({rows}) of the dataframes you requested to see:\n"


def read_csv_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header; pass a schema to save the pass that infers one."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def register(tables: list[DataFrame]) -> dict[str, DataFrame]:
    """Tables as ``df1 … dfN``, also as temp views of these names."""
    named = {f"df{i}": table for i, table in enumerate(tables, start=1)}
    for name, table in named.items():
        table.createOrReplaceTempView(name)
    return named


def read_indexed_csvs(
    spark: SparkSession, paths: list[str], schemas: list[str | T.StructType] | None = None
) -> dict[str, DataFrame]:
    """CSV files whose first column is an index, registered by number."""
    frames = [
        read_csv_table(spark, path, schemas[i] if schemas else None) for i, path in enumerate(paths)
    ]
    return register([f.drop(f.columns[0]) for f in frames])


def load_named(spark: SparkSession, names: list[str], jdbc: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Full scan of each named table, from the catalog or over JDBC."""
    if jdbc is None:
        return {name: spark.table(name) for name in names}
    return {name: spark.read.format("jdbc").options(**jdbc, dbtable=name).load() for name in names}


def load_parquet(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def spread_scan(df: DataFrame) -> DataFrame:
    """A scan with fewer tasks than cores, spread over all cores.

    For costly work per row on a few files. A scan that fills the cores, as any
    large one does, stays as it is and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def decode_latin1(df: DataFrame) -> DataFrame:
    """Every binary column as ISO-8859-1 text."""
    binary = [f.name for f in df.schema if isinstance(f.dataType, T.BinaryType)]
    return df.withColumns({c: F.expr(latin1_text(f"`{c}`")) for c in binary})


def run_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """SQL over temp views; given tables are registered first."""
    for name, table in (tables or {}).items():
        table.createOrReplaceTempView(name)
    return spark.sql(query)


def preview_text(df: DataFrame, rows: int) -> str:
    """First rows of a table as Markdown. Collects ``rows`` rows."""
    taken = df.limit(rows).select(F.expr(text_cells(df.schema, df.columns)).alias("cells"))
    cells = [list(r.cells) for r in taken.collect()]
    one = df.sparkSession.createDataFrame([(df.columns, cells)], "columns array<string>, rows array<array<string>>")
    return one.select(F.expr(markdown_table(table_value("columns", "rows"))).alias("text")).first().text


def view_tables(tables: dict[str, DataFrame], names: list[str], rows: int = VIEW_ROWS) -> str:
    """First rows of several tables as Markdown under their names."""
    return (VIEW_TITLE.format(rows=rows) + "".join(f"{n}:\n{preview_text(tables[n], rows)}\n" for n in names)).strip()
