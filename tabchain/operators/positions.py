"""Row positions, seeded shuffle and shards without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabchain.functions.draws import DRAW_BITS, draw
from tabchain.operators.joins import quoted
from tabchain.session import cut_lineage

#: Bits of the shuffle hash that name a bucket: 65,536 buckets at most, which
#: bounds the offset table that is broadcast and its one-task running sum.
BUCKET_BITS = 16
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row number below


def _running_offsets(counts: DataFrame, bucket: str) -> DataFrame:
    """Rows before each bucket. The input has one row per bucket or partition."""
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))


def hash_shuffle(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """Rows in a seeded order that no partitioning can change."""
    return df.orderBy(F.expr(draw(seed, id_col)), id_col)


def with_shuffled_position(df: DataFrame, id_col: str, seed: int = 0, name: str = "pos") -> DataFrame:
    """0-based position of each row in the seeded shuffle.

    The top bits of the hash name a bucket, so buckets follow the shuffle order
    and are equally full. One pass over the ids counts the buckets, and one
    shuffle of the rows numbers them within their bucket.
    """
    key = F.expr(draw(seed, id_col))
    bucket = F.shiftright(key, DRAW_BITS - BUCKET_BITS)
    counts = df.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = _running_offsets(counts, "_bucket")
    inside = Window.partitionBy("_bucket").orderBy("_key", id_col)
    return (
        df.withColumns({"_key": key, "_bucket": bucket})
        .withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_row") - 1)
        .drop("_key", "_bucket", "_row", "_offset")
    )


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def with_position(df: DataFrame, order: str | list[str], name: str = "pos") -> DataFrame:
    """0-based position of each row in the order of columns, every row once.

    Rows that are equal in them follow by their other columns, as far as those can be
    sorted; whole copies are interchangeable.
    """
    columns = [order] if isinstance(order, str) else list(order)
    ties = [f.name for f in df.schema.fields if f.name not in columns and _sortable(f.dataType)]
    return numbered(df.orderBy(*[F.col(quoted(c)) for c in [*columns, *ties]]), name)


def numbered(ordered: DataFrame, name: str = "pos") -> DataFrame:
    """0-based position of each row of a globally sorted DataFrame, in its order.

    The sorted rows are checkpointed, so the partition numbers that the positions
    rest on cannot change.
    """
    fixed = cut_lineage(ordered.withColumn("_id", F.monotonically_increasing_id()))
    fixed = fixed.withColumn("_part", F.shiftright("_id", _ROW_BITS))
    offsets = _running_offsets(fixed.groupBy("_part").agg(F.count("*").alias("_n")), "_part")
    row = F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    return fixed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + row).drop("_id", "_part", "_offset")


def position_range(df: DataFrame, start: int, end: int, name: str = "pos") -> DataFrame:
    """Rows with a position in ``[start, end)``; an end beyond the last row is fine."""
    return df.where((F.col(name) >= start) & (F.col(name) < end))


def pick_positions(df: DataFrame, positions: list[int], name: str = "pos") -> DataFrame:
    return df.where(F.col(name).isin(positions))


def shard_id(size: int, name: str = "pos") -> Column:
    """Number of the contiguous shard of ``size`` rows that holds the row."""
    return F.expr(f"`{name}` div {size}").alias("shard_id")


def take_first(df: DataFrame, n: int, order: str | list[str]) -> DataFrame:
    """First ``n`` rows in a stable order."""
    columns = [order] if isinstance(order, str) else order
    return df.orderBy(*columns).limit(n)


def take_last(df: DataFrame, n: int, order: str) -> DataFrame:
    """Last ``n`` rows, in ascending order."""
    return df.orderBy(F.col(order).desc()).limit(n).orderBy(order)
