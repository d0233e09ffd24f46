"""Tasks of sorts and groupings are as many as the rows need, with the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabchain.operators import generation
from tabchain.plans import sample_plans
from tabchain.plans.corpus_chain import STEP_DDL


def test_sorts_of_sample_plans_are_dealt_to_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(sample_plans, "ROWS_PER_TASK", 50)
    asked = []
    plain = sample_plans._sorted_in
    monkeypatch.setattr(sample_plans, "_sorted_in", lambda rows, parts, order: asked.append(parts) or plain(rows, parts, order))
    rows = spark.range(1000).select((F.col("id") % 2).cast("int").alias("sample_id"), F.lit(1).alias("table_no"), F.col("id").alias("row_no"), F.array(F.col("id").cast("string"), (F.col("id") % 7).cast("string")).alias("cells"))
    headers = spark.createDataFrame([(0, 1, ["a", "b"]), (1, 1, ["a", "b"])], "sample_id int, table_no int, columns array<string>")
    steps = spark.createDataFrame([(0, [("sort_desc", ["a"], None, None, None, None)]), (1, [("group_count", ["b"], None, None, None, None)])], f"sample_id int, steps array<{STEP_DDL}>")
    found, _ = sample_plans.run_sample_plans(rows, headers, steps)
    cells = {k: [r.cells for r in found.where(f"sample_id = {k}").orderBy("pos").collect()] for k in (0, 1)}
    assert cells[0] == [[str(n), str(n % 7)] for n in range(998, -1, -2)]
    assert cells[1] == [[str(k), str(sum(1 for n in range(1, 1000, 2) if n % 7 == k))] for k in range(7)]
    assert asked == [20, 20]


def test_having_groups_deals_rows_to_bounded_tasks(spark, monkeypatch):
    rows = spark.range(600).select(F.lit("t").alias("key"), "id", F.array((F.col("id") % 3).cast("string"), F.col("id").cast("string")).alias("cells"))
    tables = spark.createDataFrame([("t", ["g", "v"], ["0", "0"])], "key string, columns array<string>, first_row array<string>")
    queries = generation.generate_group_by(tables, "key", "columns", "first_row", "'t'", 4, 7)
    run = lambda: sorted(map(tuple, generation.having_from_groups(rows, queries, "key", "id", 7).collect()))
    whole = run()
    dealt = []
    plain = type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, *a: dealt.append(a[0]) or plain(self, *a))
    monkeypatch.setattr(generation, "ROWS_PER_TASK", 100)
    assert run() == whole
    assert 24 in dealt
