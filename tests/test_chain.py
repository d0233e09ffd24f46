"""Chains of steps on flat tables and on nested tables."""

from __future__ import annotations

import math

import pytest

from tabchain.functions.cells import TABLE_DDL
from tabchain.operators.joins import hot_keys, spread_join, table_join
from tabchain.operators.steps import STEPS, conjunction
from tabchain.plans.chain import MAX_STEPS, Step, chain, run_chain
from tabchain.plans.corpus_chain import STEP_DDL, run_corpus_chains
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def tables(spark):
    votes = spark.createDataFrame(
        [(1, "speed", 4.0), (1, "care", None), (2, "care", 2.0), (None, "care", 1.0), (3, "speed", 5.0)],
        "personId bigint, reason string, grade double",
    )
    person = spark.createDataFrame(
        [(1, "ann", "red"), (2, "bob", "blue"), (None, "nobody", None)], "personId bigint, name string, team string"
    )
    return {"votes": votes, "person": person}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_join_keys_match_each_other(tables):
    joined = chain(tables, ("join", {"table": "person", "on": "personId"}, "votes"), ("select", {"columns": ["personId", "name", "reason"]}))
    assert (None, "nobody", "care") in rows(joined)
    assert joined.count() == 4
    plain = chain(tables, ("join", {"table": "person", "on": "personId", "match_null_keys": False}, "votes"))
    assert plain.count() == 3


def test_clashing_names_get_suffixes(tables):
    other = {"a": tables["votes"], "b": tables["votes"].withColumn("extra", F.lit(1))}
    assert chain(other, ("join", {"table": "b", "on": "personId"}, "a")).columns == [
        "personId", "reason_x", "grade_x", "reason_y", "grade_y", "extra",
    ]


@pytest.mark.parametrize("how, n", [("inner", 4), ("left", 5), ("right", 4), ("outer", 5)])
def test_join_types(tables, how, n):
    joined = table_join(tables["votes"], tables["person"], "personId", how)
    assert joined.count() == n
    assert {r.personId for r in joined.collect()} == ({None, 1, 2} if how in ("inner", "right") else {None, 1, 2, 3})


def test_null_group_keys_are_dropped(tables):
    assert rows(chain(tables, ("group_by", {"columns": "personId"}, "votes"))) == [(1, 2), (2, 1), (3, 1)]
    assert rows(chain(tables, ("group_mean", {"by": "personId"}, "votes"))) == [(1, 4.0), (2, 2.0), (3, 5.0)]
    assert (None, 1) in rows(chain(tables, ("group_by", {"columns": "personId", "keep_nulls": True}, "votes")))


def test_nulls_sort_last_in_both_directions(tables):
    for descending in (False, True):
        last = chain(tables, ("sort", {"by": "grade", "descending": descending}, "votes")).collect()[-1]
        assert last.grade is None


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (None, None, None)], "a double, b double, c double")
    got = [r.mean for r in chain({"t": df}, ("row_mean", {}, "t")).collect()]
    assert got == [2.0, None]


def test_chain_equals_the_dataframe(tables):
    by_chain = chain(
        tables,
        ("filter", {"where": "reason = 'care' AND personId IS NOT NULL"}, "votes"),
        ("join", {"table": "person", "on": "personId"}),
        ("group_by", {"columns": "name", "name": "n"}),
        ("top", {"n": 1, "by": ["n", "name"], "descending": [True, False]}),
    )
    by_hand = (
        tables["votes"].where("reason = 'care'").join(tables["person"], "personId").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(1)
    )
    assert rows(by_chain) == rows(by_hand) == [("ann", 1)]


def test_failed_step_keeps_the_last_result(spark, tables):
    result = run_chain(
        [
            Step("select", {"columns": ["personId", "reason"]}, "votes"),
            Step("filter", {"where": "no_such_column = 1"}),
            Step("filter", {"where": "this is not sql ((("}),
            Step("sort", {"by": "no_such_column"}),
            Step("fly", {}),
            Step("join", {"table": "nowhere", "on": "personId"}),
            Step("join", {"table": "person", "on": "no_such_column"}),
            Step("filter", {"where": "reason = 'speed'"}),
        ],
        tables,
    )
    assert rows(result.inter) == [(1, "speed"), (3, "speed")]
    assert [entry[3] for entry in result.log] == ["ok"] + ["error"] * 6 + ["ok"]
    assert all(entry[4] for entry in result.log if entry[3] == "error")
    log = result.log_frame(spark)
    assert log.columns == ["step_no", "op", "args", "status", "error"] and log.count() == 8
    assert result.chain().startswith("<BEGIN> -> votes.select(") and result.chain().endswith("-> <END>")


def test_preview_is_markdown(tables):
    result = run_chain([Step("sort", {"by": ["personId", "reason"]}, "votes"), Step("limit", {"n": 2})], tables)
    assert result.preview() == "|  | personId | reason | grade |\n|---:|:---|:---|:---|\n| 0 | 1 | care |  |\n| 1 | 1 | speed | 4.0 |"


def test_bounded_chain_keeps_what_it_has(tables):
    steps = [Step("limit", {"n": 1}, "votes")] * (MAX_STEPS + 2)
    result = run_chain(steps, tables)
    assert result.inter.count() == 1 and len(result.actions) == MAX_STEPS
    assert [entry[3] for entry in result.log] == ["ok"] * MAX_STEPS + ["error"]
    assert "at most" in result.log[-1][4]


def test_bound_of_a_chain_is_its_callers(tables):
    steps = [Step("limit", {"n": 1}, "votes")] * (MAX_STEPS + 2)
    assert len(run_chain(steps, tables, max_steps=None).actions) == MAX_STEPS + 2
    assert len(run_chain(steps, tables, max_steps=3).actions) == 3


def test_first_step_needs_a_table(tables):
    assert run_chain([Step("limit", {"n": 1})], tables).log[0][3] == "error"
    with pytest.raises(ValueError):
        chain(tables, ("limit", {"n": 1}))


def test_sql_step_reads_inter(tables):
    got = chain(tables, ("filter", {"where": "grade > 1"}, "votes"), ("sql", {"query": "SELECT count(*) AS n FROM {inter}"}))
    assert rows(got) == [(3,)]


def test_sql_step_binds_names_only(spark, tables):
    query = "SELECT '{' AS a, '{other}' AS b, count(*) AS n FROM {inter} JOIN {person} USING (personId)"
    assert rows(chain(tables, ("filter", {"where": "grade > 1"}, "votes"), ("sql", {"query": query}))) == [("{", "{other}", 2)]
    assert rows(chain(tables, ("sql", {"query": "SELECT 1 AS x"}, "votes"))) == [(1,)]
    assert not [v.name for v in spark.catalog.listTables() if v.name.startswith("step_")]


def test_mixed_connectors_follow_sql_precedence(spark):
    df = spark.range(8).selectExpr("id", "id & 1 = 1 AS a", "id & 2 = 2 AS b", "id & 4 = 4 AS c")
    built = df.where(conjunction([F.col("a"), F.col("b"), F.col("c")], ["OR", "AND"]))
    assert rows(built) == rows(df.where("a OR b AND c"))
    built = df.where(conjunction([F.col("a"), F.col("b"), F.col("c")], ["AND", "OR"]))
    assert rows(built) == rows(df.where("a AND b OR c"))


# --- skew -------------------------------------------------------------------


def test_spread_join_with_a_hot_key(spark):
    """One key holds a third of the rows; its rows are spread, and none is lost."""
    big = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 7, id % 5000) AS k")
    small = spark.range(5_000).selectExpr("id AS k", "id * 10 AS v")
    assert {r.k for r in hot_keys(big, ["k"])} >= {7}
    joined = spread_join(big, small, ["k"], ["id"])
    plain = big.join(small, "k")
    assert joined.select("id", "k", "v").exceptAll(plain.select("id", "k", "v")).count() == 0
    assert joined.count() == plain.count() == 30_000
    counts = joined.groupBy("k").agg(F.count("*").alias("n"))
    assert counts.where("k = 7").first().n == big.where("k = 7").count()


def test_spread_left_join_keeps_unmatched_rows(spark):
    big = spark.range(6_000).selectExpr("id", "if(id % 3 = 0, 7, id) AS k")
    small = spark.range(10).selectExpr("id AS k", "1 AS v")
    joined = spread_join(big, small, ["k"], ["id"], "left")
    assert joined.count() == 6_000
    assert joined.where("v IS NOT NULL").count() == big.where("k < 10").count()


def test_without_hot_keys_the_join_is_plain(spark):
    even = spark.range(400_000).selectExpr("id", "id % 100000 AS k")
    assert hot_keys(even, ["k"]) == []
    assert "_salt" not in spread_join(even, even.selectExpr("k", "id AS other"), ["k"], ["id"])._jdf.queryExecution().toString()


# --- chains on nested tables -------------------------------------------------

SCHEMA = f"sample_id bigint, tables array<{TABLE_DDL}>, steps array<{STEP_DDL}>, answer {TABLE_DDL}"


def step(name, columns=(), op=None, value=None, n=None, table=None):
    return (name, list(columns), op, value, n, table)


def run_one(spark, tables, *steps):
    df = spark.createDataFrame([(1, tables, list(steps), (["a"], []))], SCHEMA)
    got = run_corpus_chains(df).first()
    return list(got.pred["columns"]), [list(r) for r in got.pred["rows"]], got.failed_steps


LEFT = (["id", "who", "n"], [["1", "ann", "10"], ["2", "bob", "9"], ["3", "ann", None], ["4", "", "x"]])
RIGHT = (["id", "who", "to"], [["1", "z", "p"], ["1", "y", "q"], ["9", "x", "r"], [None, "w", "s"]])


@pytest.mark.parametrize(
    "steps, expected",
    [
        ([], (LEFT[0], [["1", "ann", "10"], ["2", "bob", "9"], ["3", "ann", ""], ["4", "", "x"]], 0)),
        ([step("select", ["n", "id"]), step("limit", n=1)], (["n", "id"], [["10", "1"]], 0)),
        ([step("filter", ["n"], ">", "9")], (LEFT[0], [["1", "ann", "10"], ["4", "", "x"]], 0)),
        ([step("filter", ["who"], "!=", "ann"), step("select", ["id"])], (["id"], [["2"], ["4"]], 0)),
        ([step("sort", ["n"]), step("select", ["id"])], (["id"], [["2"], ["1"], ["4"], ["3"]], 0)),
        ([step("sort_desc", ["n"]), step("select", ["id"])], (["id"], [["1"], ["2"], ["4"], ["3"]], 0)),
        ([step("group_count", ["who"])], (["who", "count"], [["", "1"], ["ann", "2"], ["bob", "1"]], 0)),
        ([step("join", ["id"], table=2)], (["id", "who_x", "n", "who_y", "to"], [["1", "ann", "10", "z", "p"], ["1", "ann", "10", "y", "q"]], 0)),
        ([step("use", table=2), step("limit", n=1)], (RIGHT[0], [["1", "z", "p"]], 0)),
        ([step("select", ["nope"]), step("fly"), step("join", ["id"], table=5), step("use", table=9), step("sort", ["nope"]), step("limit", n=1)], (LEFT[0], [["1", "ann", "10"]], 5)),
        ([step("filter", ["id"], "=", "nothing"), step("group_count", ["who"])], (["who", "count"], [], 0)),
        ([step("filter", ["id"], "=", "nothing"), step("join", ["id"], table=2)], (["id", "who_x", "n", "who_y", "to"], [], 0)),
    ],
)
def test_corpus_steps(spark, steps, expected):
    assert run_one(spark, [LEFT, RIGHT], *steps) == expected


def test_corpus_join_with_an_empty_table(spark):
    assert run_one(spark, [LEFT, (["id", "to"], [])], step("join", ["id"], table=2)) == (["id", "who", "n", "to"], [], 0)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("match", [True, False])
def test_spread_join_is_the_plain_join(spark, how, match):
    """Null keys, clashing names and every join type as in the plain join."""
    big = spark.range(3_000).selectExpr("id AS `No.`", "if(id % 2 = 0, NULL, if(id % 3 = 0, 7, id)) AS `k.`", "id * 2 AS v")
    small = spark.createDataFrame([(None, 1), (7, 2), (9, 3), (-1, 4)], "`k.` long, v long")
    spread = spread_join(big, small, ["k."], ["No."], how, match_null_keys=match)
    plain = table_join(big, small, "k.", how, match)
    assert spread.columns == plain.columns == ["k.", "No.", "v_x", "v_y"]
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


def test_steps_on_headers_with_dots_and_backticks(spark):
    """Web tables have headers such as ``No.``; every step takes them as they stand."""
    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 3, 4.0), ("b", 3, 1.0), (None, 2, 2.0)], "`No.` string, `Pts.` int, `x``y` double")
    run = lambda step, /, **more: [tuple(r) for r in STEPS[step](rows, {}, **more).collect()]
    assert run("select", columns=["Pts.", "x`y"])[0] == (1, 2.0)
    assert sorted(run("group_by", columns="No.")) == [("a", 1), ("b", 2)]
    assert sorted(run("group_mean", by="No.")) == [("a", 1.0, 2.0), ("b", 3.0, 2.5)]
    assert run("row_mean", columns=["Pts.", "x`y"])[0][-1] == 1.5
    assert [r[1] for r in run("sort", by=["Pts.", "x`y"], descending=True)] == [3, 3, 2, 1]
    assert run("top", n=1, by=["Pts.", "x`y"])[0] == ("b", 3, 4.0)
    assert [r[1] for r in run("tail", n=2, by="Pts.")] == [3, 3]
    assert run("argmax", column="x`y", by="Pts.", tie="No.") in ([(4.0, 3)], [(1.0, 3)])
    assert run("argmax", column="No.", by="Pts.", tie="x`y") == [("b", 3)]
    assert sorted(run("argmax", column="Pts.", by="x`y", tie="Pts.", group=["No."]), key=str) == [("a", 1, 2.0), ("b", 3, 4.0), (None, 2, 2.0)]
    assert run("aggregate", by="No.", aggs={"n": "sum(`Pts.`)"})
    assert run("add_column", name="z", split="No.", separator="x")[0][-1] == "a"


def test_cells_that_only_look_like_numbers(spark):
    """Numbers are what numbers look like in a cell, and whole ones compare exactly."""
    table = (["k"], [["3f"], ["2d"], ["9007199254740993"], ["9007199254740992"], ["NaN"], ["1e2"], ["0x1"]])
    run = lambda *step: [r[0] for r in run_one(spark, [table], step)[1]]
    assert run("filter", ["k"], "=", "9007199254740993", 0, 0) == ["9007199254740993"]
    assert run("filter", ["k"], "<", "9007199254740993", 0, 0) == ["3f", "2d", "9007199254740992", "1e2", "0x1"]
    assert run("filter", ["k"], ">", "1", 0, 0) == ["3f", "2d", "9007199254740993", "9007199254740992", "NaN", "1e2"]
    assert run("sort_desc", ["k"], "", "", 0, 0) == ["9007199254740993", "9007199254740992", "1e2", "NaN", "3f", "2d", "0x1"]
