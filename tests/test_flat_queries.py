"""Generated queries over flat tables: drawn constants, and many conditions in one pass."""

from __future__ import annotations

import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabchain.operators import flat_queries as f
from tabchain.operators import generation as g

LARGE = 2**53
SCHEMA = "t string, id int, n bigint, d decimal(12,2), x double, s string, `a.b` int"


@pytest.fixture(scope="module")
def values():
    draw = random.Random(2)
    pick = lambda *items: draw.choice([None, *items])
    return [
        (
            pick("a", "a", "b"), k, pick(1, 2, -5, LARGE, LARGE + 1, LARGE + 2), pick(Decimal("1.50"), Decimal("-2.00"), Decimal("0.01")),
            pick(0.5, 1.0, float("nan"), -1e300), pick("1", "1.0", "é", "", "zz", "10"), pick(1, 2, 3),
        )
        for k in range(400)
    ]


@pytest.fixture(scope="module")
def rows(spark, values):
    return spark.createDataFrame(values, SCHEMA).repartition(3)


NAMES = ["t", "id", "n", "d", "x", "s", "a.b"]
CONSTANTS = {
    "n": (str(LARGE), str(LARGE + 1), "1", "1.5", "-5", "1e3", "99999999999999999999999"),
    "d": ("1.5", "1.504", "-2", "0.01", "7"),
    "x": ("0.5", "1", "-1e300"),
    "s": ("1", "10", "nonsense"),
    "a.b": ("1", "2.5", "3"),
}


def number(value):
    try:
        return Decimal(str(value)) if not isinstance(value, float) else value
    except ArithmeticError:
        return None


def truth(row, c):
    cell = row[NAMES.index(c["col"])]
    if cell is None:
        return False
    if c["is_num"]:
        left, right = number(cell), number(c["val"])
        if c["col"] in ("x", "s"):
            left, right = (float(v) if v is not None else None for v in (left, right))
        if left is None or right is None or left != left:
            return False
    else:
        left, right = str(cell).encode(), c["val"].encode()
    return {"<": left < right, ">": left > right, "=": left == right, "!=": left != right, "<=": left <= right, ">=": left >= right}[c["op"]]


def holds(row, conditions):
    clauses = [[]]
    for c in conditions:
        clauses[-1].append(c)
        if c["connector"] == "OR":
            clauses.append([])
    return any(all(truth(row, c) for c in clause) for clause in clauses if clause)


def made_queries(n):
    draw = random.Random(n)
    queries = []
    for k in range(n):
        conditions = []
        size = draw.randint(1, 4)
        for j in range(size):
            col = draw.choice(list(CONSTANTS))
            is_num = col != "s" or draw.random() < 0.5
            val = draw.choice(CONSTANTS[col]) if is_num else draw.choice(["1", "é", "", "zz", "q"])
            link = draw.choice(["AND", "OR"]) if j < size - 1 else ""
            conditions.append({"col": col, "owner": 0, "pos": 0, "agg": "", "op": draw.choice(["<", ">", "=", "!=", "<=", ">="]), "val": val, "is_num": is_num, "connector": link})
        queries.append((draw.choice(["a", "b", None]), k, f"text {k}", conditions))
    return queries


@pytest.mark.parametrize(("n", "block"), [(300, 1024), (300, 7), (65, 64)])
def test_counts_equal_brute_force(spark, rows, values, monkeypatch, n, block):
    monkeypatch.setattr(f, "BLOCK_QUERIES", block)
    queries = made_queries(n)
    df = spark.createDataFrame(queries, f"t string, query_no int, text string, conditions {g.CONDITION_DDL}")
    found = {r.query_no: r for r in f.count_matches(rows, "t", df).collect()}
    assert len(found) == n
    for t, k, text, conditions in queries:
        want = sum(holds(row, conditions) for row in values if row[0] == t)
        assert (found[k].t, found[k].text, found[k].valid, found[k].n_rows) == (t, text, True, want)


def test_rows_are_read_once_and_not_paired_with_queries(spark, rows):
    df = spark.createDataFrame(made_queries(50), f"t string, query_no int, text string, conditions {g.CONDITION_DDL}")
    plan = f.count_matches(rows, "t", df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("MapInArrow") == 1


def test_queries_that_are_no_where(spark, rows):
    plain = made_queries(1)[0][3]
    with_agg = [plain[0] | {"agg": "SUM", "connector": ""}]
    df = spark.createDataFrame([("a", 0, "x", []), ("a", 1, "y", with_agg), ("none", 2, "z", plain)], f"t string, query_no int, text string, conditions {g.CONDITION_DDL}")
    found = {r.query_no: tuple(r) for r in f.count_matches(rows, "t", df).collect()}
    assert found == {0: ("a", 0, "", False, None), 1: ("a", 1, "", False, None), 2: ("none", 2, "z", True, 0)}
    unknown = spark.createDataFrame([("a", 0, "x", [plain[0] | {"col": "nothing"}])], df.schema)
    with pytest.raises(ValueError, match="nothing"):
        f.count_matches(rows, "t", unknown)


def test_constants_are_those_of_the_least_draws(rows, values):
    found = sorted(tuple(r) for r in f.drawn_constants(rows.where("t is not null"), "t", "id", ["n", "a.b"], 5, 9).collect())
    place = lambda t, c, k: int(hashlib.md5(f"9/{t}/{c}/{k}".encode()).hexdigest()[:12], 16)
    want = []
    for t in "ab":
        for c, at in (("n", 2), ("a.b", 6)):
            order = sorted((place(t, c, r[1]), str(r[at])) for r in values if r[0] == t and r[at] is not None)
            want += [(t, c, rank, val) for rank, (_, val) in enumerate(order[:5], 1)]
    assert found == sorted(want)


def test_no_more_than_k_rows_of_a_key_leave_a_task(rows):
    plan = f.drawn_constants(rows, "t", "id", ["n", "s"], 5, 9)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning", 1)[1].split("\n", 1)[1]


def test_constant_tables_feed_every_generator(spark, rows):
    few = spark.createDataFrame([("a", 1, 7, None), ("a", 2, 8, None), ("b", 3, None, None)], "t string, id int, n int, s string")
    tables = {r.t: r.table for r in f.constant_tables(few, "t", "id", ["n", "s"], 3, 1).collect()}
    assert set(tables) == {"a"} and tables["a"].columns == ["n", "s"]
    assert sorted(set(r[0] for r in tables["a"].rows)) == ["7", "8"] and {r[1] for r in tables["a"].rows} == {None}
    made = f.constant_tables(rows.where("t is not null"), "t", "id", ["n", "s"], 8, 1)
    assert g.generate_having(made, "t", ["table"], 3, 1, with_aggs=True).count() == 6
    counted = f.count_matches(rows, "t", g.generate_where(made, "t", "table", 20, 1))
    assert counted.where("valid").count() == 40 and counted.agg(F.sum("n_rows")).first()[0] > 0
