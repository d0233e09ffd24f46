"""Chains whose steps fail when they run."""

from __future__ import annotations

import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tabchain.plans.chain import Step, apply_step
from tabchain.plans.checked import data_error, run_checked, run_to_end

GOOD = [
    Step("add_column", {"name": "twice", "expr": "n * 2"}),
    Step("filter", {"where": "n % 3 <> 1"}),
    Step("add_column", {"name": "other", "expr": "length(t)"}),
    Step("sort", {"by": "n"}),
]
BAD = [
    Step("add_column", {"name": "x", "expr": "cast(t as int)"}),
    Step("add_column", {"name": "y", "expr": "100 div (n - 6)"}),
    Step("filter", {"where": "array(1, 2)[n] = 1"}),
    Step("add_column", {"name": "z", "expr": "raise_error(t)"}),
]
UNPLANNABLE = [Step("select", {"columns": ["nothing"]}), Step("nosuch"), Step("join", {"table": "absent", "on": "n"})]


@pytest.fixture(scope="module")
def tables(spark):
    return {"t": spark.range(12).select(F.col("id").cast("int").alias("n"), F.concat(F.lit("text "), "id").alias("t"))}


def step_by_step(steps, tables):
    """Each step run to its end on the last good table."""
    inter, log = None, []
    for number, step in enumerate(steps, 1):
        try:
            made = apply_step(step, inter, tables)
            run_to_end(made)
            inter = made
            log.append((number, "ok"))
        except Exception:  # noqa: BLE001
            log.append((number, "error"))
    return inter, log


@pytest.mark.parametrize(("seed", "cut"), [(0, False), (1, True), (2, False), (3, True)])
def test_any_chain_equals_running_step_by_step(tables, seed, cut):
    draw = random.Random(seed)
    steps = [Step("filter", {"where": "n >= 0"}, on="t"), *draw.choices(GOOD + BAD + UNPLANNABLE, k=7)]
    want, log = step_by_step(steps, tables)
    found = run_checked(steps, tables, cut=cut)
    assert [(row[0], row[3]) for row in found.log] == log
    assert found.inter.columns == want.columns
    assert sorted(map(tuple, found.inter.collect())) == sorted(map(tuple, want.collect()))


def test_a_chain_that_runs_is_run_once(tables):
    probes = []
    run_checked([Step("filter", {"where": "n > 1"}, on="t"), *GOOD], tables, probe=lambda df: probes.append(run_to_end(df)))
    assert len(probes) == 1


def test_one_failing_step_takes_logarithmic_probes(tables):
    probes = []

    def probe(df):
        probes.append(1)
        run_to_end(df)

    steps = [Step("filter", {"where": "n > 1"}, on="t"), *[GOOD[0]] * 20, BAD[0], *[GOOD[1]] * 10]
    found = run_checked(steps, tables, probe=probe)
    assert [row[0] for row in found.log if row[3] == "error"] == [22]
    assert len(probes) <= 2 + 5


def test_the_log_says_why(spark, tables):
    steps = [Step("filter", {"where": "n > 1"}, on="t"), BAD[0], Step("select", {"columns": ["x"]}), BAD[1]]
    found = run_checked(steps, tables)
    errors = [row[4] for row in found.log]
    assert errors[0] is None and errors[1].startswith("[CAST_INVALID_INPUT]")
    assert errors[2].startswith("[UNRESOLVED_COLUMN") and errors[3].startswith("[DIVIDE_BY_ZERO]")
    assert [row.status for row in found.log_frame(spark).collect()] == ["ok", "error", "error", "error"]
    assert found.chain() == '<BEGIN> -> t.filter(where="n > 1") -> <END>'


def test_what_is_never_computed_is_no_error(tables):
    steps = [Step("filter", {"where": "n > 1"}, on="t"), BAD[0], Step("select", {"columns": ["n"]})]
    found = run_checked(steps, tables)
    assert [row[3] for row in found.log] == ["ok"] * 3 and found.inter.count() == 10


def test_chains_without_a_good_step(tables):
    found = run_checked([BAD[0], UNPLANNABLE[1]], tables)
    assert found.inter is None and [row[3] for row in found.log] == ["error", "error"]
    first = run_checked([Step("add_column", BAD[0].args, on="t")], tables)
    assert first.inter is None and first.log[0][3] == "error"
    assert run_checked([], tables).inter is None
    bound = run_checked([Step("filter", {"where": "n > 1"}, on="t"), *GOOD], tables, max_steps=2)
    assert [row[3] for row in bound.log] == ["ok", "ok", "error"] and "at most 2" in bound.log[-1][4]


def test_user_functions_and_subqueries_count_as_data_errors(spark, tables):
    broken = tables["t"].withColumn("u", F.udf(lambda x: 1 // 0, "int")("n"))
    with pytest.raises(PythonException) as caught:
        run_to_end(broken)
    assert data_error(caught.value) == "ZeroDivisionError: integer division or modulo by zero"
    with pytest.raises(Py4JJavaError) as many:
        run_to_end(tables["t"].where("n = (select id from range(3))"))
    assert data_error(many.value).startswith("[SCALAR_SUBQUERY_TOO_MANY_ROWS]")


def test_other_errors_are_raised(tables):
    def lost(df):
        raise OSError("no space left")

    with pytest.raises(OSError):
        run_checked([Step("filter", {"where": "n > 1"}, on="t")], tables, probe=lost)
    unreadable = tables["t"].withColumn("u", F.raise_error(F.lit("broken input")))
    with pytest.raises(RuntimeError, match="starts from"):
        run_checked([UNPLANNABLE[1]], tables, inter=unreadable)
