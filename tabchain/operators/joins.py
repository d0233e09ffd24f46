"""Joins with the null and name rules of the table steps, and skew spreading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

JOIN_TYPES = ("inner", "left", "right", "outer")
#: A key is hot when it holds more than one part in HOT_SHARE of the rows.
HOT_SHARE = 1000


def quoted(name: str) -> str:
    """A column's name as it stands, also with dots and backticks in it."""
    return "`" + name.replace("`", "``") + "`"


def table_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    how: str = "inner",
    match_null_keys: bool = True,
) -> DataFrame:
    """Equi-join on shared columns.

    NULL keys match each other unless ``match_null_keys`` is off; clashing
    other columns get ``_x`` and ``_y``. Spark picks broadcast or shuffle from
    the sizes it sees at run time and splits skewed partitions.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"join type must be one of {JOIN_TYPES}, not {how!r}")
    keys = [on] if isinstance(on, str) else list(on)
    a, b = left.alias("a"), right.alias("b")
    for frame in (left, right):
        frame.select(*[quoted(k) for k in keys])  # an unknown key fails here, when the plan is built
    same: list[Column] = [
        F.col(f"a.{quoted(k)}").eqNullSafe(F.col(f"b.{quoted(k)}")) if match_null_keys else F.col(f"a.{quoted(k)}") == F.col(f"b.{quoted(k)}")
        for k in keys
    ]
    joined = a.join(b, reduce(lambda x, y: x & y, same), how)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    key_side = {"inner": "a", "left": "a", "right": "b"}.get(how)
    key_columns = [
        (F.col(f"{key_side}.{quoted(k)}") if key_side else F.coalesce(F.col(f"a.{quoted(k)}"), F.col(f"b.{quoted(k)}"))).alias(k)
        for k in keys
    ]
    rest = [
        F.col(f"{side}.{quoted(c)}").alias(c + suffix if c in clash else c)
        for side, frame, suffix in (("a", left, "_x"), ("b", right, "_y"))
        for c in frame.columns
        if c not in keys
    ]
    return joined.select(*key_columns, *rest)


def hot_keys(df: DataFrame, on: list[str]) -> list[Row]:
    """Keys that hold more than ``1 / HOT_SHARE`` of all rows, by exact counts.

    There are fewer than ``HOT_SHARE`` of them by construction, so collecting them
    is bounded.
    """
    keys = [quoted(k) for k in on]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.where(F.col("_n") * HOT_SHARE > total.scalar()).select(*keys).collect()


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    by: list[str],
    how: str = "inner",
    salts: int = 32,
    match_null_keys: bool = True,
) -> DataFrame:
    """``table_join`` that spreads the hot keys of the big side over ``salts`` tasks.

    Only rows of hot keys get a salt, NULL keys included, and only their partners on
    the small side are repeated, once per salt. Use it where one key may hold a large
    share of the big side and a grouping on the same key follows: without the salt
    Spark would run both in the one task that holds the key. ``by`` names columns of
    the big side that differ within a key. Rows, names and NULL rule are those of
    ``table_join``; so is the whole join without a hot key, and for right and outer
    joins, whose unmatched rows a repeated side would multiply.
    """
    found = hot_keys(big, on) if how in ("inner", "left") else []
    if not found:
        return table_join(big, small, on, how, match_null_keys)
    # Fewer than HOT_SHARE rows, so the broadcast is bounded.
    keys = big.sparkSession.createDataFrame(found, big.select(*[quoted(k) for k in on]).schema)
    hot = F.broadcast(keys.withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*[quoted(c) for c in by]), F.lit(salts)).cast("int")
    salted = table_join(big, hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0)))
    repeated = table_join(small, hot, on, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return table_join(
        salted.drop("_hot"), repeated.drop("_hot"), [*on, "_salt"], how, match_null_keys
    ).drop("_salt")
