"""Shards with a manifest, comparison of flat tables, and text in fragments."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabchain.functions.cells import table_value, text_array, text_cells
from tabchain.functions.formats import html_table, markdown_table
from tabchain.operators import table_diff as td
from tabchain.plans.fragments import html_fragments, markdown_fragments
from tabchain.sources.shard_store import read_manifest, read_shards_of, write_shard_store


@pytest.fixture
def small_files(spark):
    """Partitions of a few kilobytes, so that a small store has several files."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "4k")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    for name in ("adaptive.advisoryPartitionSizeInBytes", "adaptive.coalescePartitions.minPartitionSize"):
        spark.conf.unset(f"spark.sql.{name}")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_shard_is_read_without_other_files(spark, tmp_path, small_files):
    root = str(tmp_path / "store")
    df = spark.range(2000).select(F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    write_shard_store(df.repartition(7), root, 30)
    manifest = {r.shard_id: r for r in read_manifest(spark, root).collect()}
    assert sorted(manifest) == list(range(67)) and sum(r.rows for r in manifest.values()) == 2000
    files = {r.file for r in manifest.values()}
    assert 3 < len(files) < 67, "files follow bytes, not shards"
    for n in (0, 40, 66):
        got = read_shards_of(spark, root, [n])
        assert [f.rpartition("/")[2] for f in got.inputFiles()] == [manifest[n].file]
        assert sorted(r.pos for r in got.collect()) == list(range(30 * n, min(2000, 30 * n + 30)))
        place = read_shards_of(spark, root, [n]).select(F.min("_metadata.row_index").alias("i")).first().i
        assert place == manifest[n].first_row
    several = read_shards_of(spark, root, [1, 2, 60, 1])
    assert set(f.rpartition("/")[2] for f in several.inputFiles()) == {manifest[n].file for n in (1, 2, 60)}
    assert several.count() == 90 and read_shards_of(spark, root).count() == 2000 and read_shards_of(spark, root, []).count() == 0
    with pytest.raises(ValueError, match="unknown shards"):
        read_shards_of(spark, root, [1, 67])


def test_a_store_written_anew(spark, tmp_path):
    root = str(tmp_path / "store")
    write_shard_store(spark.range(10).withColumnRenamed("id", "pos"), root, 4)
    before = read_shards_of(spark, root)
    write_shard_store(spark.range(3).withColumnRenamed("id", "pos"), root, 4)
    assert before.count() == 10 and read_shards_of(spark, root).count() == 3 and read_manifest(spark, root).count() == 1


ROWS = [(1, "a", 1.5, None), (2, "b", 2.5, "x"), (2, "b", 2.5, "x"), (None, "a", 1.5, "y")]
SCHEMA = "k int, s string, d double, t string"


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_equal_tables_in_any_order_and_under_other_names(spark, truth):
    other = spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(3)
    assert td.compare_tables(truth, other).equal
    moved = other.select(F.col("t").alias("k"), F.col("d").alias("x"), F.col("k").alias("s"), F.col("s").alias("q"))
    found = td.compare_tables(truth, moved, by_content=True)
    assert found.equal and found.columns == {"k": "s", "s": "q", "d": "x", "t": "k"} and found.differences.isEmpty()
    assert not td.compare_tables(truth, moved).equal


@pytest.mark.parametrize(
    "rows",
    [ROWS[:3], [*ROWS, ROWS[0]], [ROWS[0], ROWS[1], ROWS[3], ROWS[3]], [(1, "a", 1.5, ""), *ROWS[1:]], [(2, "a", 1.5, None), *ROWS[1:]], []],
)
def test_differences_are_counted(spark, truth, rows):
    found = td.compare_tables(truth, spark.createDataFrame(rows, SCHEMA))
    have, want = Counter(ROWS), Counter(rows)
    differ = {r: (have[r], want[r]) for r in have | want if have[r] != want[r]}
    assert not found.equal
    assert {tuple(r)[:4]: tuple(r)[4:] for r in found.differences.collect()} == differ


def test_cells_that_are_swapped_between_rows(spark):
    """Columns alone are the same, rows are not; a pair of equal rows is not lost in the digest."""
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "a string, b string")
    b = spark.createDataFrame([("x", "2"), ("y", "1")], "a string, b string")
    found = td.compare_tables(a, b, by_content=True)
    assert found.columns == {"a": "a", "b": "b"} and not found.equal and found.differences.count() == 4
    twice = spark.createDataFrame([("x", "1")] * 2, "a string, b string")
    assert not td.compare_tables(twice, spark.createDataFrame([("y", "1")] * 2, "a string, b string")).equal


def test_columns_without_a_partner(spark, truth):
    found = td.compare_tables(truth, truth.drop("t").withColumn("u", F.lit(1)), by_content=True)
    assert not found.equal and found.columns == {"k": "k", "s": "s", "d": "d"} and found.differences.isEmpty()


def joined(fragments, between):
    rows = sorted(map(tuple, fragments.collect()))
    assert [place for place, _ in rows] == list(range(len(rows)))
    return between.join(text for _, text in rows)


def nested(df, order, form):
    cells = df.withColumn("cells", F.expr(text_cells(df.schema, df.columns)))
    rows = [r.cells for r in cells.orderBy(order).collect()]
    one = df.sparkSession.createDataFrame([(rows,)], "rows array<array<string>>")
    return one.select(F.expr(form(table_value(text_array(df.columns), "rows"))).alias("t")).first().t


@pytest.mark.parametrize("n", [0, 1, 12, 150])
def test_fragments_are_the_nested_form(spark, n):
    texts = spark.range(n).selectExpr(
        "lpad(id, 4, '0') AS `No.`", "if(id % 3 = 0, NULL, concat('<', repeat('é', int(id % 30)), ' & ', id)) AS s", "concat('a\\n', id) AS `x``y`"
    ).repartition(3)
    plain = texts.drop("x`y")
    assert joined(markdown_fragments(plain, "No."), "\n") == nested(plain, "`No.`", lambda t: markdown_table(t, padded=True))
    assert joined(html_fragments(texts, "No."), "") == nested(texts, "`No.`", html_table)


def test_numbers_stand_to_the_right(spark):
    df = spark.createDataFrame([(5, 1.25, "x"), (100, None, None)], "n int, share double, s string")
    assert joined(markdown_fragments(df, "n"), "\n").split("\n") == [
        "|    |   n |   share | s   |",
        "|---:|----:|--------:|:----|",
        "|  0 |   5 |    1.25 | x   |",
        "|  1 | 100 |         |     |",
    ]
