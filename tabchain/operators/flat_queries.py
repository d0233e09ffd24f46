"""Generated queries over flat tables of any size.

Constants: every table and column gives its ``k`` values with the least draws. The
windows that choose them cut each task's rows to ``k`` per key before anything is
shuffled. The chosen values stand as a table of ``k`` rows in one nested value, which
the generators of :mod:`tabchain.operators.generation` take like any other table.

Execution: all queries of all tables are counted in one pass over the rows. The
conditions are indexed, not the rows: per column the constants are sorted, which
cuts its values into intervals, and for each interval a set of bits, one per query,
says which queries' conditions hold there. A row looks up one interval per column
and combines whole sets of queries by AND and OR; no row is paired with a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from functools import reduce
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from tabchain.functions.cells import table_value, text_array
from tabchain.functions.draws import draw
from tabchain.functions.sqltext import lit, struct
from tabchain.operators.joins import quoted
from tabchain.operators.steps import NUMERIC_OPS

#: Queries that one call counts; their conditions are sent to the executors.
MAX_QUERIES = 100_000
#: Queries of one table that share a set of bits, and rows that are counted at a time.
BLOCK_QUERIES, BLOCK_ROWS = 1_024, 4_096

_COUNTS = "table string, query_no int, n long"


# --- constants ----------------------------------------------------------------


def cell_text(name: str) -> Column:
    return F.col(quoted(name)).cast("string")


def drawn_constants(rows: DataFrame, key: str, row_id: str, columns: list[str], k: int, seed: int) -> DataFrame:
    """``(key, col, rank, val)``: per table and column ``k`` values of drawn rows, as text.

    ``row_id`` tells the rows of a table apart. NULL cells are never drawn; a column
    with fewer other cells than ``k`` gives all of them.
    """
    each = F.array(*[F.struct(F.lit(c).alias("col"), cell_text(c).alias("val")) for c in columns])
    cells = rows.select(key, F.col(row_id).alias("_row"), F.inline(each)).where("val IS NOT NULL")
    placed = cells.withColumn("_place", F.expr(draw(seed, key, "col", "_row")))
    order = Window.partitionBy(key, "col").orderBy("_place", "_row")
    return placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "col", "rank", "val")


def constant_tables(rows: DataFrame, key: str, row_id: str, columns: list[str], k: int, seed: int) -> DataFrame:
    """``(key, table)``: the drawn constants of each table as a nested table of ``k`` rows.

    A column with fewer values repeats them; one without any holds NULL cells.
    """
    drawn = drawn_constants(rows, key, row_id, columns, k, seed)
    values = lambda c: F.sort_array(
        F.collect_list(F.when(F.col("col") == c, F.struct("rank", "val")))
    )["val"]
    lists = drawn.groupBy(key).agg(*[values(c).alias(f"_{i}") for i, c in enumerate(columns)])
    cell = lambda i: f"get(_{i}, CAST(try_mod(j, nullif(size(_{i}), 0)) AS int))"
    cells = f"transform(sequence(0, {k - 1}), j -> array({', '.join(cell(i) for i in range(len(columns)))}))"
    return lists.select(key, F.expr(table_value(text_array(columns), cells)).alias("table"))


# --- execution ----------------------------------------------------------------


def _exact(text: str) -> Decimal | None:
    try:
        number = Decimal(text)
    except (InvalidOperation, TypeError):
        return None
    return number if number.is_finite() else None


class NumberIntervals:
    """Where values stand among sorted constants: an odd number at a constant, an even one between two.

    Whole numbers (a decimal column is sent as whole numbers of its last place) are
    compared with the constants rounded down and up, so the comparison is exact.
    """

    def __init__(self, constants: list[str], scale: int | None):
        scaled = {c: _exact(c) for c in set(constants)}
        known = {c: v * 10 ** (scale or 0) for c, v in scaled.items() if v is not None}
        self.sorted = sorted(set(known.values()))
        place = {v: k for k, v in enumerate(self.sorted)}
        self.place = {c: place[v] for c, v in known.items()}
        self.count = 2 * len(self.sorted) + 2  # the last one: no number
        if scale is None:
            self.below = self.upto = np.array([float(v) for v in self.sorted], np.float64)
        else:
            whole = [(floor(v), ceil(v)) for v in self.sorted]
            kind = np.int64 if all(abs(x) < 1 << 63 for pair in whole for x in pair) else object
            self.below, self.upto = (np.array(side, kind) for side in (zip(*whole) if whole else ((), ())))

    def of(self, values: pa.Array) -> np.ndarray:
        missing = values.is_null().to_numpy(zero_copy_only=False)
        numbers = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        found = np.searchsorted(self.below, numbers, "left") + np.searchsorted(self.upto, numbers, "right")
        if values.type == pa.float64():
            missing |= np.isnan(numbers)
        return np.where(missing, self.count - 1, found)

    def holds(self, op: str, constant: str) -> np.ndarray:
        truth = np.zeros(self.count, bool)
        if constant not in self.place:
            return truth
        at = 2 * self.place[constant] + 1
        where = np.arange(self.count - 1)
        truth[:-1] = {"<": where < at, ">": where > at, "=": where == at, "!=": where != at, "<=": where <= at, ">=": where >= at}[op]
        return truth


class TextIntervals:
    """Which constant a text equals; order is that of the UTF-8 bytes."""

    def __init__(self, constants: list[str]):
        self.sorted = sorted({c.encode() for c in constants})
        self.keys = pa.array(self.sorted, pa.binary())
        self.count = 2 * len(self.sorted) + 2

    def of(self, values: pa.Array) -> np.ndarray:
        missing = values.is_null().to_numpy(zero_copy_only=False)
        spread = pc.dictionary_encode(pc.fill_null(values, "").cast(pa.binary()))
        texts = np.array([*spread.dictionary.to_pylist(), b""], object)[:-1]
        constants = np.array([*self.sorted, b""], object)[:-1]
        found = np.searchsorted(constants, texts, "left") + np.searchsorted(constants, texts, "right")
        return np.where(missing, self.count - 1, found[spread.indices.to_numpy()])

    def holds(self, op: str, constant: str) -> np.ndarray:
        truth = np.zeros(self.count, bool)
        at = 2 * self.sorted.index(constant.encode()) + 1
        where = np.arange(self.count - 1)
        truth[:-1] = {"<": where < at, ">": where > at, "=": where == at, "!=": where != at, "<=": where <= at, ">=": where >= at}[op]
        return truth


def _clauses(conditions: list[dict]) -> list[list[dict]]:
    """Conditions between two ORs; a clause holds if all of its conditions do."""
    clauses: list[list[dict]] = [[]]
    for condition in conditions:
        clauses[-1].append(condition)
        if condition["connector"] != "AND":
            clauses.append([])
    return [c for c in clauses if c]


class QueryIndex:
    """Sets of queries by interval, for queries of one table."""

    def __init__(self, queries: list[tuple[int, list[dict]]], views: dict[tuple[str, bool], int | None]):
        """``queries`` are ``(number, conditions)``; ``views`` the scale of each (column, as number) that they use."""
        self.numbers = np.array([number for number, _ in queries], np.int64)
        clauses = [_clauses(conditions) for _, conditions in queries]
        wanted: dict[tuple[str, bool], list[str]] = {}
        for c in (c for per_query in clauses for clause in per_query for c in clause):
            wanted.setdefault((c["col"], c["is_num"]), []).append(c["val"])
        self.intervals = {
            view: NumberIntervals(constants, views[view]) if view[1] else TextIntervals(constants)
            for view, constants in wanted.items()
        }
        words = -(-len(queries) // 64)
        self.slots: list[tuple[np.ndarray, dict[tuple[str, bool], np.ndarray]]] = []
        for slot in range(max(map(len, clauses), default=0)):
            alive = np.zeros(words * 64, bool)
            truth: dict[tuple[str, bool], np.ndarray] = {}
            for place, per_query in enumerate(clauses):
                if slot >= len(per_query):
                    continue
                alive[place] = True
                for c in per_query[slot]:
                    view = (c["col"], c["is_num"])
                    table = truth.setdefault(view, np.ones((self.intervals[view].count, words * 64), bool))
                    table[:, place] &= self.intervals[view].holds(c["op"], c["val"])
            pack = lambda bits: np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)
            self.slots.append((pack(alive), {view: pack(table) for view, table in truth.items()}))

    def count(self, columns: dict[tuple[str, bool], pa.Array], n: int) -> np.ndarray:
        """How many of ``n`` rows each query holds for."""
        total = np.zeros(len(self.numbers), np.int64)
        found = {view: interval.of(columns[view]) for view, interval in self.intervals.items()}
        for first in range(0, n, BLOCK_ROWS):
            some = {view: at[first : first + BLOCK_ROWS] for view, at in found.items()}
            held = reduce(
                np.bitwise_or,
                (
                    reduce(np.bitwise_and, (table[some[view]] for view, table in truth.items()), alive[None, :])
                    for alive, truth in self.slots
                ),
            )
            bits = np.unpackbits(held.view(np.uint8), axis=1, bitorder="little", count=len(self.numbers))
            total += bits.sum(axis=0, dtype=np.int64)
        return total


def _views(rows: DataFrame, used: set[tuple[str, bool]]) -> tuple[dict[tuple[str, bool], int | None], list[Column]]:
    """How each used column is sent: as whole numbers with a scale, as doubles (no scale), or as text."""
    scales, sent = {}, []
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    for name, as_number in sorted(used):
        column, kind, scale = F.col(quoted(name)), kinds[name], None
        if not as_number:
            value = cell_text(name)
        elif isinstance(kind, T.IntegralType):
            value, scale = column.cast("long"), 0
        elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
            value, scale = (column * F.lit(10**kind.scale)).cast("decimal(38,0)").cast("long"), kind.scale
        else:
            value = F.expr(f"try_cast({quoted(name)} AS double)")
        scales[name, as_number] = scale
        sent.append(value.alias(f"_{len(sent)}"))
    return scales, sent


def _grouped(queries: list[Row], key: str) -> dict[str | None, list[tuple[int, list[dict]]]]:
    tables: dict[str | None, list[tuple[int, list[dict]]]] = {}
    for row in queries:
        tables.setdefault(row[key], []).append((row["query_no"], [c.asDict() for c in row["conditions"]]))
    return tables


def count_matches(rows: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """``(key, query_no, text, valid, n_rows)``: how many rows of its table each query holds for.

    ``queries`` comes from the generators: ``(key, query_no, text, conditions)``.
    A condition on numbers compares whole numbers and decimals of up to 18 digits
    exactly, other numbers and numbers in texts as doubles; any other condition compares
    texts. An unknown truth counts as false, AND binds tighter than OR. Conditions with
    aggregates don't belong into WHERE: such a query is not valid, has no text and no
    count, nor has one without conditions. The queries are sent to the executors, at most
    ``MAX_QUERIES``; the rows are read once and not shuffled.
    """
    is_valid = F.expr("size(conditions) > 0 AND NOT exists(conditions, c -> c.agg != '')")
    queries = queries.select(key, "query_no", "text", "conditions", is_valid.alias("valid"))
    listed = queries.where("valid").select(F.col(key).cast("string").alias("table"), "query_no", "conditions")
    listed = listed.limit(MAX_QUERIES + 1).collect()
    if len(listed) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} queries are counted at a time")
    tables = _grouped(listed, "table")
    used = {(c["col"], c["is_num"]) for per_table in tables.values() for _, cs in per_table for c in cs}
    unknown = {name for name, _ in used} - set(rows.columns)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    scales, sent = _views(rows, used)
    views = sorted(used)
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: dict[str | None, list[QueryIndex]] = {}
        counts: dict[str | None, list[np.ndarray]] = {}
        for batch in batches:
            keys = pc.dictionary_encode(batch.column(0))
            places = pc.fill_null(keys.indices, len(keys.dictionary)).to_numpy(zero_copy_only=False)
            for place, name in enumerate([*keys.dictionary.to_pylist(), None]):
                own = pa.array(np.flatnonzero(places == place))
                if name not in shared.value or not len(own):
                    continue
                if name not in indexes:
                    all_ = shared.value[name]
                    indexes[name] = [QueryIndex(all_[k : k + BLOCK_QUERIES], scales) for k in range(0, len(all_), BLOCK_QUERIES)]
                    counts[name] = [np.zeros(len(index.numbers), np.int64) for index in indexes[name]]
                columns = {view: batch.column(k + 1).take(own) for k, view in enumerate(views)}
                for index, total in zip(indexes[name], counts[name], strict=True):
                    total += index.count(columns, len(own))
        for name, per_block in counts.items():
            for index, total in zip(indexes[name], per_block, strict=True):
                n = len(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(index.numbers, pa.int32()), pa.array(total)],
                    names=["table", "query_no", "n"],
                )

    scanned = rows.select(F.col(key).cast("string").alias("_table"), *sent)
    found = scanned.mapInArrow(run, _COUNTS).groupBy("table", "query_no").agg(F.sum("n").alias("n"))
    same = F.col(key).cast("string").eqNullSafe(found["table"]) & (queries["query_no"] == found["query_no"])
    return queries.join(found, same, "left").select(
        queries[key],
        queries["query_no"],
        F.when(F.col("valid"), F.col("text")).otherwise(F.lit("")).alias("text"),
        "valid",
        F.when(F.col("valid"), F.coalesce("n", F.lit(0))).alias("n_rows"),
    )
