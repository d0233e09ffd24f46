"""Joins of any type with keys that are hot on both sides.

A key with ``m`` rows on the left and ``n`` on the right makes ``m * n`` rows, which
no salt on one side can spread. Here such a key gets a grid of cells, sized from the
exact counts of both sides: a left row has a line of the grid and goes to all its
cells, a right row has a column, so each pair meets in one cell. Right rows travel in
blocks of bounded length: the join is one of left rows and blocks, and each of its rows is
unfolded into the pairs. The counts also say which keys have no partner at all, so
unmatched rows of hot keys need no join, and only rows of other keys go through the
plain one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from tabchain.operators.joins import HOT_SHARE, JOIN_TYPES, quoted, table_join

_LINE, _COLUMN = "_line", "_column"
#: Rows in a block at most.
BLOCK_ROWS = 1024
#: Rows of the result that one task makes of hot keys, as far as the number of tasks allows.
TASK_ROWS = 8_000_000
MAX_TASKS = 10_000


#: What the rows of a hot key are marked with: the key's number and the size of its grid.
_MARKS = ("_hot", "_lines", "_columns")


def _list(on: str | list[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def key_counts(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``(*on, _left, _right)``: rows of each key on both sides, counted per task first."""
    keys = [quoted(k) for k in on]
    one = lambda frame, a, b: frame.select(*keys, F.lit(a).alias("_left"), F.lit(b).alias("_right"))
    return one(left, 1, 0).union(one(right, 0, 1)).groupBy(*keys).agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))


def hot_grid(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[list[Row], DataFrame]:
    """Keys with more than ``1 / HOT_SHARE`` of the rows of either side, with the size of their grid.

    There are fewer than ``2 * HOT_SHARE`` of them, and a grid has at most ``HOT_SHARE``
    lines and columns, each with about ``1 / HOT_SHARE`` of that side's rows.
    """
    counts = key_counts(left, right, on)
    totals = counts.agg(F.sum("_left").alias("l"), F.sum("_right").alias("r"))
    # A side without rows has no parts: least() then takes the key's own count, zero.
    parts = lambda n, total: F.ceil(F.try_divide(F.col(n) * HOT_SHARE, total)).cast("int")
    sized = counts.withColumns({"_all_left": totals.select("l").scalar(), "_all_right": totals.select("r").scalar()})
    sized = sized.where((F.col("_left") * HOT_SHARE > F.col("_all_left")) | (F.col("_right") * HOT_SHARE > F.col("_all_right")))
    found = sized.select(
        *[quoted(k) for k in on],
        F.least("_left", parts("_left", F.col("_all_left"))).cast("int").alias("_lines"),
        F.least("_right", parts("_right", F.col("_all_right"))).cast("int").alias("_columns"),
        "_right",
        (F.col("_left").cast("double") * F.col("_right")).alias("_pairs"),
    )
    return found.collect(), found


def _marked(frame: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the grid of their key, NULL for keys that aren't hot."""
    a, b = frame.alias("a"), F.broadcast(hot).alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{quoted(k)}").eqNullSafe(F.col(f"b.{quoted(k)}")) for k in on])
    return a.join(b, same, "left").select("a.*", *[f"b.{m}" for m in _MARKS if m in hot.columns])


def _place(rows: DataFrame, count: str, by: list[str] | None) -> tuple[Column, Column]:
    """A hash of the row and of the task that reads it, and the row's place by it.

    The task counts so that whole copies of a row are spread as well.
    """
    values = [F.col(quoted(c)) for c in (by or rows.columns) if c not in _MARKS]
    drawn = F.xxhash64(*values, F.spark_partition_id())
    return drawn, F.pmod(drawn, F.greatest(F.col(count), F.lit(1))).cast("int")


def _repeated(rows: DataFrame, axis: str, count: str) -> DataFrame:
    """Each row at all places of an axis."""
    return rows.withColumn(axis, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))


def _dealt(rows: DataFrame, own: str, own_count: str, other: str, other_count: str, by: list[str] | None) -> DataFrame:
    """Each row at one place of its own axis and at all places of the other."""
    return _repeated(rows.withColumn(own, _place(rows, own_count, by)[1]), other, other_count)


def _blocks(rows: DataFrame, own: str, own_count: str, by: list[str] | None, columns: list[str]) -> DataFrame:
    """``(_hot, _lines, _columns, own, _rows)``: up to ``BLOCK_ROWS`` rows of one key and place as an array.

    An entry holds the named columns as ``_r0``, ``_r1`` and so on. Rows of a place are
    numbered in the order of their hash, so that a task that runs again makes the same blocks.
    """
    drawn, place = _place(rows, own_count, by)
    entry = [F.col(quoted(c)).alias(f"_r{k}") for k, c in enumerate(columns)] or [F.lit(True).alias("_r")]
    placed = rows.select(*_MARKS, place.alias(own), drawn.alias("_drawn"), F.struct(*entry).alias("_entry"))
    number = F.row_number().over(Window.partitionBy(*_MARKS, own).orderBy("_drawn"))
    blocks = placed.withColumn("_block", F.floor((number - 1) / BLOCK_ROWS)).groupBy(*_MARKS, own, "_block")
    return blocks.agg(F.collect_list("_entry").alias("_rows")).drop("_block")


def _product(left: DataFrame, right: DataFrame, keys: list[str], left_by: list[str] | None, right_by: list[str] | None, tasks: int) -> DataFrame:
    """Keys, the left side's other columns, then the right side's, for each pair of rows of a hot key.

    A left row meets blocks of right rows, and each meeting is unfolded into its pairs.
    """
    rest = {side: [c for c in frame.columns if c not in keys and c not in _MARKS] for side, frame in (("l", left), ("r", right))}
    lines = _dealt(left, _LINE, "_lines", _COLUMN, "_columns", left_by)
    columns = _repeated(_blocks(right, _COLUMN, "_columns", right_by, rest["r"]), _LINE, "_lines")
    cell = ["_hot", _LINE, _COLUMN]
    own = [F.col(quoted(c)).alias(f"_l{k}") for k, c in enumerate([*keys, *rest["l"]])]
    # The number of tasks follows the rows made, not the few bytes read; a broadcast of the
    # blocks, which are larger than their table's size lets expect, would not be bounded.
    a = lines.select(*cell, *own).repartition(tasks, *cell)
    b = columns.select(*cell, "_rows").repartition(tasks, *cell).hint("merge")
    first = [f"_l{k}" for k in range(len(own))]
    pairs = a.join(b, cell).select(*first, F.inline("_rows"))
    return pairs.select(*first, *[f"_r{k}" for k in range(len(rest["r"]))])


def _tasks(found: list[Row]) -> int:
    """Tasks for the pairs of all hot keys."""
    return min(MAX_TASKS, 1 + int(sum(r._pairs for r in found) / TASK_ROWS))


def _null_key(on: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(quoted(k)).isNull() for k in on])


def grid_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    how: str = "inner",
    match_null_keys: bool = True,
    left_by: list[str] | None = None,
    right_by: list[str] | None = None,
) -> DataFrame:
    """``table_join`` (rows, names, types and NULL rule) for keys that are hot on one side or both.

    NULL is a key like any other if NULL keys match; if not, rows with one are
    unmatched from the start and join nothing. ``left_by`` and ``right_by`` name columns
    that differ within a key; all columns by default. The keys of both sides are
    counted first, in one narrow pass with a shuffle of the counts alone. Without a
    hot key this is the plain join.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"join type must be one of {JOIN_TYPES}, not {how!r}")
    keys = _list(on)
    plain = table_join(left, right, keys, how, match_null_keys)
    found, shape = hot_grid(left, right, keys)
    if not found:
        return plain
    numbered = [(*row, k) for k, row in enumerate(found)]
    hot = left.sparkSession.createDataFrame(numbered, T.StructType([*shape.schema.fields, T.StructField("_hot", T.IntegerType(), False)]))
    # Left rows are repeated once per column, so there are no more of these than full blocks need.
    hot = hot.withColumn("_columns", F.least("_columns", F.ceil(F.col("_right") / BLOCK_ROWS).cast("int")))
    sides = {"left": _marked(left, hot, keys), "right": _marked(right, hot, keys)}
    partner = {"left": "_columns", "right": "_lines"}
    usable = F.lit(True) if match_null_keys else ~_null_key(keys)
    is_hot = F.col("_lines").isNotNull()

    cold = {side: rows.where(~is_hot & usable).drop(*_MARKS) for side, rows in sides.items()}
    parts = [table_join(cold["left"], cold["right"], keys, how, match_null_keys)]
    both = is_hot & usable & (F.col("_lines") > 0) & (F.col("_columns") > 0)
    made = _product(sides["left"].where(both), sides["right"].where(both), keys, left_by, right_by, _tasks(found))
    parts.append(made.toDF(*plain.columns))
    for side, frame in (("left", left), ("right", right)):
        if how in (side, "outer"):
            alone = sides[side].where(~usable | (is_hot & (F.col(partner[side]) == 0))).drop(*_MARKS)
            parts.append(_without_partner(alone, frame.columns, plain, keys, side, len(left.columns) - len(keys)))
    typed = [
        part.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in plain.schema.fields]) for part in parts
    ]
    return reduce(DataFrame.union, typed)


def _without_partner(rows: DataFrame, columns: list[str], joined: DataFrame, keys: list[str], side: str, left_rest: int) -> DataFrame:
    """Unmatched rows of a side under the names of the joined table, the other side NULL."""
    names = joined.columns
    first = len(keys) + (0 if side == "left" else left_rest)
    own = {name: names[first + k] for k, name in enumerate(c for c in columns if c not in keys)}
    given = {renamed: F.col(quoted(name)) for name, renamed in own.items()} | {k: F.col(quoted(k)) for k in keys}
    return rows.select(*[given.get(n, F.lit(None)).alias(n) for n in names])
