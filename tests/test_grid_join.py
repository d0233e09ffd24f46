"""Joins with keys that are hot on both sides, against the plain join."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabchain.operators import grid_join as gj
from tabchain.operators.joins import JOIN_TYPES, table_join
from tabchain.plans.chain import chain


def side(spark, seed, n, kind="bigint"):
    draw = random.Random(seed)
    rows = [(draw.choice([None, None, 7, 7, 7, *range(20)]), draw.choice(["x", None, "y"]), k, draw.random() < 0.5) for k in range(n)]
    return spark.createDataFrame(rows, f"`k.1` {kind}, s string, id int, flag boolean").repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", JOIN_TYPES)
@pytest.mark.parametrize(("match", "share", "on"), [(True, 4, ["k.1"]), (True, 1000, ["k.1", "s"]), (False, 20, ["k.1", "s"])])
def test_any_join_equals_the_plain_one(spark, monkeypatch, how, match, share, on):
    """A share of 4 makes the hottest keys hot, 1000 every key."""
    monkeypatch.setattr(gj, "HOT_SHARE", share)
    left, right = side(spark, 1, 120), side(spark, 2, 60, "int").where("`k.1` is null or `k.1` <> 3")
    want, got = table_join(left, right, on, how, match), gj.grid_join(left, right, on, how, match)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert rows(got) == rows(want)


@pytest.mark.parametrize(("how", "match"), [("left", False), ("right", True), ("outer", True)])
def test_hot_keys_without_a_partner(spark, how, match):
    left, right = side(spark, 3, 80), side(spark, 4, 80)
    for a, b in ((left.where("`k.1` = 7"), right.where("`k.1` is null")), (left, right.limit(0)), (left.limit(0), right)):
        assert rows(gj.grid_join(a, b, "k.1", how, match)) == rows(table_join(a, b, "k.1", how, match))


def test_copies_of_one_row_on_both_sides(spark):
    left = spark.range(0, 300, 1, 5).select(F.lit(1).alias("k"), F.lit("same").alias("v"))
    right = spark.range(0, 200, 1, 3).select(F.lit(1).alias("k"), F.lit("other").alias("w"))
    assert gj.grid_join(left, right, "k").groupBy("k", "v", "w").count().collect()[0]["count"] == 60_000


def test_no_cell_holds_a_hot_key_whole(spark, monkeypatch):
    monkeypatch.setattr(gj, "HOT_SHARE", 20)
    left = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 1).alias("k"), F.col("id").alias("a"))
    right = spark.range(1000).select(F.when(F.col("id") % 2 == 0, 1).alias("k"), F.col("id").alias("b"))
    found, shape = gj.hot_grid(left, right, ["k"])
    assert sorted((r.k or 0, r._lines, r._columns) for r in found) == [(0, 10, 10), (1, 10, 10)]
    marked = gj._marked(left, spark.createDataFrame(found, shape.schema), ["k"])
    cells = gj._dealt(marked, "_line", "_lines", "_column", "_columns", None).groupBy("k", "_line", "_column").count().collect()
    assert len(cells) == 200 and max(c["count"] for c in cells) < 2 * 2000 / 10
    plan = gj.grid_join(left, right, "k", "outer")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("how", JOIN_TYPES)
def test_hot_rows_meet_blocks(spark, monkeypatch, how):
    """The join sees blocks, not single rows, of the right side; copies and sides of keys alone lose nothing."""
    monkeypatch.setattr(gj, "BLOCK_ROWS", 7)
    monkeypatch.setattr(gj, "TASK_ROWS", 1000)
    left, right = side(spark, 7, 90), side(spark, 8, 60, "int").union(side(spark, 8, 60, "int"))
    for a, b in ((left, right), (left.select("`k.1`"), right), (left, right.select("`k.1`"))):
        got, want = gj.grid_join(a, b, "k.1", how), table_join(a, b, "k.1", how)
        assert rows(got) == rows(want)
    plan = gj.grid_join(left, right, "k.1", how)._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline(_rows" in plan


def test_blocks_hold_each_row_once(spark, monkeypatch):
    monkeypatch.setattr(gj, "BLOCK_ROWS", 10)
    marks = {"_hot": F.lit(0), "_lines": F.lit(1), "_columns": F.lit(3)}
    same = spark.range(0, 100, 1, 1).select(F.lit(None).cast("int").alias("k"), F.lit("x").alias("v"))
    other = spark.range(0, 100, 1, 4).select(F.lit(None).cast("int").alias("k"), F.col("id").cast("string").alias("v"))
    found = gj._blocks(same.union(other).withColumns(marks), "_column", "_columns", None, ["v"]).collect()
    assert max(len(b._rows) for b in found) == 10 and {b._column for b in found} == {0, 1, 2}
    assert sorted(r._r0 for b in found for r in b._rows) == sorted(["x"] * 100 + [str(k) for k in range(100)])


def test_tasks_follow_the_pairs(spark):
    left, right = spark.range(40_000).select(F.lit(1).alias("k"), "id"), spark.range(3_000).select(F.lit(1).alias("k"), "id")
    found, _ = gj.hot_grid(left, right, ["k"])
    assert gj._tasks(found) == 1 + 40_000 * 3_000 // gj.TASK_ROWS
    assert gj.grid_join(left.limit(4000), right, "k").count() == 12_000_000


def test_step(spark):
    tables = {"l": side(spark, 5, 40), "r": side(spark, 6, 30)}
    made = chain(tables, ("join", {"table": "r", "on": "k.1", "how": "outer", "grid": True}, "l"))
    assert rows(made) == rows(table_join(tables["l"], tables["r"], "k.1", "outer"))
    with pytest.raises(ValueError, match="join type"):
        gj.grid_join(tables["l"], tables["r"], "k.1", "cross")
