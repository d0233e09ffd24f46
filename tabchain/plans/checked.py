"""Chains whose steps may fail when they run, not only when they are planned.

A chain is one lazy plan, so an error in the data (a cell that is no number, a
division by zero, a failing user function) shows only when the whole plan runs.
Here the chain is run to its end once, into a sink that drops the rows. If that
fails, the failing step is found by bisection over the prefixes of the chain: each
probe runs one prefix. The step is logged and left out, what comes after it is
planned anew on the last good table, and the rest is run again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import (
    AnalysisException,
    ArithmeticException,
    ArrayIndexOutOfBoundsException,
    DateTimeException,
    IllegalArgumentException,
    NumberFormatException,
    ParseException,
    PythonException,
    SparkRuntimeException,
    SparkUpgradeException,
)
from pyspark.sql import DataFrame

from tabchain.operators.steps import Tables
from tabchain.plans.chain import MAX_STEPS, ChainResult, Step, apply_step
from tabchain.session import cut_lineage

PLAN_ERRORS = (AnalysisException, ParseException, ValueError, TypeError, KeyError)
#: What rows can cause. A lost executor or a full disk is none of these.
DATA_ERRORS = (
    ArithmeticException,
    ArrayIndexOutOfBoundsException,
    DateTimeException,
    IllegalArgumentException,
    NumberFormatException,
    PythonException,
    SparkRuntimeException,
    SparkUpgradeException,
)


def run_to_end(df: DataFrame) -> None:
    """All columns of all rows, into a sink that drops them."""
    df.write.format("noop").mode("overwrite").save()


#: An error condition and its state, as Spark writes them. States of class XX are Spark's own faults.
CONDITION = re.compile(r"\[[A-Z][A-Z0-9_.]+\] .*?SQLSTATE: (?!XX)[0-9A-Z]{5}", re.DOTALL)


def _first_line(text: str) -> str:
    return text.strip().split("\n")[0]


def data_error(error: Exception) -> str | None:
    """What the log says of an error that the rows caused; None for any other error."""
    text = str(error)
    if isinstance(error, PythonException):
        raised = [x.strip() for x in text.split("\n") if x.partition(":")[0].strip().endswith(("Error", "Exception"))]
        return raised[-1] if raised else "a user function failed"
    if isinstance(error, DATA_ERRORS):
        return _first_line(text) or type(error).__name__
    if isinstance(error, Py4JJavaError):
        found = CONDITION.search(text)
        return _first_line(found[0]) if found else None
    return None


class _Composed:
    """The chain as planned so far: the table after each step, and why steps were left out."""

    def __init__(self, steps: list[Step], tables: Tables, first: DataFrame | None):
        self.steps, self.tables = steps, tables
        self.states: list[DataFrame | None] = [first, *[None] * len(steps)]
        self.errors: dict[int, str] = {}

    def plan(self, start: int, failed: dict[int, str]) -> None:
        """Plan the steps from ``start`` on (0-based); ``failed`` names those that fail when run."""
        for k in range(start, len(self.steps)):
            self.states[k + 1] = self.states[k]
            self.errors.pop(k, None)
            if k in failed:
                self.errors[k] = failed[k]
                continue
            try:
                self.states[k + 1] = apply_step(self.steps[k], self.states[k], self.tables)
            except PLAN_ERRORS as error:
                self.errors[k] = _first_line(str(error))


def run_checked(
    steps: Iterable[Step],
    tables: Tables,
    inter: DataFrame | None = None,
    max_steps: int | None = MAX_STEPS,
    cut: bool = False,
    probe: Callable[[DataFrame], None] = run_to_end,
) -> ChainResult:
    """Last table that runs to its end, and the log of all steps.

    A step is left out if it can't be planned, or if the chain up to it fails on the
    rows while the chain before it doesn't. The result's ``inter`` has been run to its
    end once. What a chain never computes can't fail it: a bad column that a later
    step drops is not an error. A chain that runs costs one job, a failing step about
    ``log2`` of the number of steps more. With ``cut`` the last good table is written
    to the checkpoint folder once a step has failed, so that later runs start from it.
    Errors that the rows didn't cause are raised, as are those of ``inter`` itself.
    """
    steps = list(steps)
    beyond = len(steps) if max_steps is None else max_steps
    chain, failed, good = _Composed(steps[:beyond], tables, inter), {}, 0
    chain.plan(0, failed)
    while (error := _fault(chain, len(chain.steps), probe)) is not None:
        low, high = good, len(chain.steps)
        while high - low > 1:
            middle = (low + high) // 2
            found = _fault(chain, middle, probe)
            if found is None:
                low = middle
            else:
                high, error = middle, found
        # The table after `low` steps runs, that after `high` steps doesn't.
        if chain.states[high] is chain.states[low]:
            raise RuntimeError("the table that the chain starts from can't be read to its end")
        good, failed[high - 1] = low, error
        if cut and chain.states[low] is not None:
            chain.states[low] = cut_lineage(chain.states[low])
        chain.plan(low, failed)
    log = [
        (k + 1, step.op, json.dumps(step.args), "error" if k in chain.errors else "ok", chain.errors.get(k))
        for k, step in enumerate(chain.steps)
    ]
    if len(steps) > beyond:
        step = steps[beyond]
        log.append((beyond + 1, step.op, json.dumps(step.args), "error", f"a chain has at most {max_steps} steps"))
    actions = [step.text() for k, step in enumerate(chain.steps) if k not in chain.errors]
    return ChainResult(chain.states[-1], log, actions)


def _fault(chain: _Composed, n: int, probe: Callable[[DataFrame], None]) -> str | None:
    """What the rows make of the first ``n`` steps; None if they run."""
    table = chain.states[n]
    if table is None:
        return None
    try:
        probe(table)
    except Exception as error:  # noqa: BLE001 - what the rows didn't cause goes on
        text = data_error(error)
        if text is None:
            raise
        return text
    return None
