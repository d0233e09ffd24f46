"""Chains of table steps over registered DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from tabchain.operators.steps import STEPS, Tables
from tabchain.sources.registry import preview_text

#: Steps a chain may have, unless its caller says otherwise.
MAX_STEPS = 40
#: Rows of a step preview.
PREVIEW_ROWS = 50

LOG_SCHEMA = "step_no int, op string, args string, status string, error string"


@dataclass(frozen=True)
class Step:
    """One step; ``on`` names a registered table instead of the last result."""

    op: str
    args: dict = field(default_factory=dict)
    on: str | None = None

    def text(self) -> str:
        args = ", ".join(f"{k}={json.dumps(v)}" for k, v in self.args.items())
        return f"{self.on or 'inter'}.{self.op}({args})"


@dataclass
class ChainResult:
    """Last good table and the log of all steps."""

    inter: DataFrame | None
    log: list[tuple]
    actions: list[str]

    def log_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, LOG_SCHEMA)

    def chain(self) -> str:
        return " -> ".join(["<BEGIN>", *self.actions, "<END>"])

    def preview(self, rows: int = PREVIEW_ROWS) -> str:
        """First rows as Markdown; runs a job, so it is only made on request."""
        return preview_text(self.inter, rows)


def apply_step(step: Step, inter: DataFrame | None, tables: Tables) -> DataFrame:
    """Plan of one step on the last result or on a registered table."""
    if step.op not in STEPS:
        raise ValueError(f"unknown step {step.op!r}; known: {sorted(STEPS)}")
    if step.on is not None and step.on not in tables:
        raise ValueError(f"unknown table {step.on!r}; known: {sorted(tables)}")
    source = inter if step.on is None else tables[step.on]
    if source is None:
        raise ValueError("the first step must name a table")
    named = step.args.get("table")
    if named is not None and named not in tables:
        raise ValueError(f"unknown table {named!r}; known: {sorted(tables)}")
    return STEPS[step.op](source, tables, **step.args)


def run_chain(
    steps: Iterable[Step],
    tables: Tables,
    inter: DataFrame | None = None,
    max_steps: int | None = MAX_STEPS,
) -> ChainResult:
    """Compose all steps lazily.

    A step that cannot be planned (unknown column, table or step, bad
    arguments) is logged as an error and leaves the last result in place. So is the
    first step beyond ``max_steps``, where the chain ends with what it has; None sets
    no bound.
    """
    log: list[tuple] = []
    actions: list[str] = []
    for number, step in enumerate(steps, start=1):
        if max_steps is not None and number > max_steps:
            log.append((number, step.op, json.dumps(step.args), "error", f"a chain has at most {max_steps} steps"))
            break
        try:
            inter = apply_step(step, inter, tables)
            actions.append(step.text())
            log.append((number, step.op, json.dumps(step.args), "ok", None))
        except (AnalysisException, ParseException, ValueError, TypeError, KeyError) as error:
            log.append((number, step.op, json.dumps(step.args), "error", str(error).strip().split("\n")[0]))
    return ChainResult(inter, log, actions)


def chain(tables: Tables, *steps: tuple | Step) -> DataFrame:
    """Result of a chain in which every step must plan; errors are raised.

    Steps may be given as ``(op, args)`` or ``(op, args, table)``.
    """
    inter = None
    for item in steps:
        inter = apply_step(item if isinstance(item, Step) else Step(*item), inter, tables)
    return inter
