"""Chains per sample over flat rows, against the nested form and plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tabchain.functions.cells import TABLE_DDL
from tabchain.plans.corpus_chain import STEP_DDL, run_corpus_chains
from tabchain.plans.sample_plans import run_sample_plans

LEFT = (["id", "who", "n"], [["1", "ann", "10"], ["2", "bob", "9"], ["3", "ann", None], ["4", "", "x"], ["5", "cid 7", "9.5"]])
RIGHT = (["id", "who", "to"], [["1", "z", "p"], ["1", "y", "q"], ["9", "x", "r"], [None, "w", "s"]])
THIRD = (["id", "who", "n"], [["7", "eve", "1"]])
SAMPLES = f"sample_id int, tables array<{TABLE_DDL}>, steps array<{STEP_DDL}>, answer {TABLE_DDL}"


def step(name, columns=(), op=None, value=None, n=None, table=None):
    return (name, list(columns), op, value, n, table)


def run(spark, chains, tables=(LEFT, RIGHT, THIRD)):
    """Results by sample: columns, rows in order, failed steps."""
    df = spark.createDataFrame([(k, list(tables), list(c), (["a"], [])) for k, c in enumerate(chains)], SAMPLES)
    each = df.select("sample_id", F.posexplode("tables").alias("t", "table")).withColumn("table_no", F.col("t") + 1)
    headers = each.select("sample_id", "table_no", "table.columns")
    rows = each.select("sample_id", "table_no", F.posexplode("table.rows").alias("row_no", "cells"))
    found, heads = run_sample_plans(rows.repartition(3), headers, df.select("sample_id", "steps"))
    by_sample = {r.sample_id: (list(r["columns"]), [], r.failed_steps) for r in heads.collect()}
    for r in sorted(found.collect(), key=lambda r: (r.sample_id, r.pos)):
        by_sample[r.sample_id][1].append(list(r.cells))
    nested = {
        r.sample_id: (list(r.pred["columns"]), [list(x) for x in r.pred["rows"]], r.failed_steps)
        for r in run_corpus_chains(df).collect()
    }
    return by_sample, nested


def test_steps_of_the_nested_form(spark):
    """Random chains of one to four shapes, every sample with columns and constants of its own."""
    draw = random.Random(4)
    column = lambda: draw.choice(["id", "who", "n", "to", "who_x", "nothing"])
    make = {
        "select": lambda: step("select", draw.sample(["id", "who", "n", "to", "nothing"], draw.randint(1, 2))),
        "filter": lambda: step("filter", [column()], draw.choice(["=", "!=", "<", ">", "<=", ">=", "~"]), draw.choice(["9", "ann", "", "3"])),
        "sort": lambda: step("sort", [column()]),
        "sort_desc": lambda: step("sort_desc", [column()]),
        "limit": lambda: step("limit", n=draw.choice([0, 1, 3, 10])),
        "group_count": lambda: step("group_count", [column()]),
        "join": lambda: step("join", [column()], table=draw.choice([1, 2, 3, 9])),
        "use": lambda: step("use", table=draw.choice([1, 2, 3, 9])),
        "fly": lambda: step("fly"),
    }
    shapes = [["filter", "sort_desc", "limit"], ["join", "select", "sort"], ["use", "group_count", "fly"], ["sort", "join", "filter"], []]
    chains = [[make[name]() for name in draw.choice(shapes)] for _ in range(40)]
    found, nested = run(spark, chains)
    for k, chain in enumerate(chains):
        assert found[k] == nested[k], chain


OTHER_STEPS = [
    ([step("add_column", ["who", "last"], value=" ", n=1)], (["id", "who", "n", "last"], [["1", "ann", "10", None], ["2", "bob", "9", None], ["3", "ann", "", None], ["4", "", "x", None], ["5", "cid 7", "9.5", "7"]], 0)),
    ([step("row_mean", ["id", "n"], value="mean"), step("select", ["mean"])], (["mean"], [["5.5"], ["5.5"], ["3"], ["4"], ["7.25"]], 0)),
    ([step("aggregate", ["who", "id"], op="SUM")], (["who", "SUM(id)"], [["", "4"], ["ann", "4"], ["bob", "2"], ["cid 7", "5"]], 0)),
    ([step("aggregate", ["who", "n"], op="AVG")], (["who", "AVG(n)"], [["", None], ["ann", "10"], ["bob", "9"], ["cid 7", "9.5"]], 0)),
    ([step("aggregate", ["who", "n"], op="MEDIAN"), step("select", ["id"])], (["id"], [["1"], ["2"], ["3"], ["4"], ["5"]], 1)),
    ([step("top", ["n"], n=2), step("select", ["id"])], (["id"], [["1"], ["5"]], 0)),
    ([step("tail", ["id"], n=2), step("select", ["id"])], (["id"], [["4"], ["5"]], 0)),
    ([step("top", ["nothing"], n=2), step("select", ["id"])], (["id"], [["1"], ["2"], ["3"], ["4"], ["5"]], 1)),
    ([step("argmax", ["who", "n"])], (["who"], [["ann"]], 0)),
    ([step("sort_desc", ["id"]), step("union", table=3), step("select", ["id"])], (["id"], [["5"], ["4"], ["3"], ["2"], ["1"], ["7"]], 0)),
    ([step("union", table=2), step("limit", n=1)], (["id", "who", "n"], [["1", "ann", "10"]], 1)),
]


def test_other_steps(spark):
    """One sample per case, of eleven shapes, in one run."""
    found, _ = run(spark, [steps for steps, _ in OTHER_STEPS])
    for k, (steps, expected) in enumerate(OTHER_STEPS):
        assert found[k] == expected, steps


def test_a_large_sample_is_many_tasks(spark):
    rows = spark.range(0, 4000, 1, 4).select(F.lit(1).alias("sample_id"), F.lit(1).alias("table_no"), F.col("id").alias("row_no"), F.array(F.col("id").cast("string"), (F.col("id") % 7).cast("string")).alias("cells"))
    headers = spark.createDataFrame([(1, 1, ["k", "m"])], "sample_id int, table_no int, columns array<string>")
    chain = [step("filter", ["m"], "=", "3"), step("sort_desc", ["k"]), step("limit", n=500)]
    steps = spark.createDataFrame([(1, chain)], f"sample_id int, steps array<{STEP_DDL}>")
    found, _ = run_sample_plans(rows, headers, steps)
    assert [r.cells[0] for r in found.orderBy("pos").collect()] == [str(k) for k in range(3999, -1, -1) if k % 7 == 3][:500]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(sample_id" not in plan and "collect_list" not in plan


def test_no_samples(spark):
    empty = spark.createDataFrame([], f"sample_id int, steps array<{STEP_DDL}>")
    rows = spark.createDataFrame([(1, 1, 0, ["x"])], "sample_id int, table_no int, row_no int, cells array<string>")
    headers = spark.createDataFrame([(1, 1, ["k"])], "sample_id int, table_no int, columns array<string>")
    found, heads = run_sample_plans(rows, headers, empty)
    assert found.count() == 0 and heads.count() == 0
