"""Shards with a manifest: many shards to a file, files sized by bytes.

Rows are sorted by shard and dealt to files in ranges of whole shards. How many
files there are follows the bytes that the shuffle measures, not the number of
shards. The manifest says for each shard in which file it lies, from which row on, and
how many rows it has; a reader asks it first and opens only the files it needs.
Within a file the reader's filter skips row groups by their least and greatest shard.

A store that is written anew gets a new data folder. The manifest is written last,
so a reader sees the old shards or the new ones, never a mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabchain.operators.positions import shard_id

_MANIFEST = "manifest"


def write_shard_store(df: DataFrame, root: str, size: int, position: str = "pos") -> None:
    """Rows as contiguous shards of ``size`` rows by their position, and the manifest.

    A shard lies in one file. Older data folders are left to readers that still use them.
    """
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    rows = df.withColumn("shard_id", shard_id(size, position))
    dealt = rows.repartitionByRange("shard_id").sortWithinPartitions("shard_id", position)
    dealt.write.parquet(f"{root}/{folder}")
    written = spark.read.parquet(f"{root}/{folder}")
    listed = written.groupBy("shard_id", F.col("_metadata.file_name").alias("file")).agg(
        F.min("_metadata.row_index").alias("first_row"),
        F.count("*").alias("rows"),
        F.min(position).alias("first_position"),
        F.first("_metadata.file_size").alias("file_bytes"),
    )
    listed.withColumn("folder", F.lit(folder)).write.mode("overwrite").parquet(f"{root}/{_MANIFEST}")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``(shard_id, file, first_row, rows, first_position, file_bytes, folder)``"""
    return spark.read.parquet(f"{root}/{_MANIFEST}")


def read_shards_of(spark: SparkSession, root: str, shards: list[int] | None = None) -> DataFrame:
    """Rows of the named shards, or of all; only files that hold one of them are opened.

    A shard that isn't there is an error. No shards give no rows.
    """
    manifest = read_manifest(spark, root)
    folder = manifest.select("folder").first()
    if folder is None:
        raise ValueError(f"no shards under {root}")
    whole = f"{root}/{folder.folder}"
    if shards is None:
        return spark.read.parquet(whole)
    wanted = sorted(set(shards))
    found = manifest.where(F.col("shard_id").isin(wanted)).select("shard_id", "file").collect()
    missing = set(wanted) - {r.shard_id for r in found}
    if missing:
        raise ValueError(f"unknown shards {sorted(missing)}")
    files = sorted({r.file for r in found})
    if not files:
        return spark.read.parquet(whole).where("false")
    return spark.read.parquet(*[f"{whole}/{f}" for f in files]).where(F.col("shard_id").isin(wanted))
