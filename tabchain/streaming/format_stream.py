"""Incremental corpus formatting: the batch projections on a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tabchain.plans.formatting import format_multi_table, format_outcomes, format_rejects, model_pairs


def read_samples_stream(
    spark: SparkSession, folder: str, schema: str | T.StructType, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Samples as they land; the reader is lazy and keeps no state but file names."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


def format_stream(
    samples: DataFrame,
    out: str,
    checkpoint: str,
    table_type: str = "html",
    partition_by: str | None = None,
) -> StreamingQuery:
    """Format all samples that have landed and stop.

    A second start picks up only files that are new since the checkpoint. Samples that
    cannot be formatted are left to :func:`format_stream_rejects`.
    """
    keep = ("sample_id", partition_by) if partition_by else ("sample_id",)
    formatted = model_pairs(format_multi_table(samples, table_type, keep=keep))
    writer = (
        formatted.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    return (writer.partitionBy(partition_by) if partition_by else writer).start()


def format_stream_rejects(
    samples: DataFrame, out: str, checkpoint: str, partition_by: str | None = None
) -> StreamingQuery:
    """Write the landed samples that :func:`format_stream` leaves out, with their reason, and stop.

    A stream of its own with its own checkpoint: started on the same folder, the two
    outputs add up to the input.
    """
    writer = (
        format_rejects(samples)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    return (writer.partitionBy(partition_by) if partition_by else writer).start()


GOOD, REJECTED = "good", "rejected"


def format_stream_outcomes(
    samples: DataFrame, out: str, checkpoint: str, table_type: str = "html", partition_by: str | None = None
) -> StreamingQuery:
    """Format all samples that have landed, good ones and rejects in one pass, and stop.

    Each micro-batch is parsed and written once, under its own number and then by
    outcome. A batch that is repeated after a failure replaces itself, so the outputs
    add up to the input at any time.
    """
    keep = ("sample_id", partition_by) if partition_by else ("sample_id",)
    folders = ["outcome", *([partition_by] if partition_by else [])]

    def write(batch: DataFrame, number: int) -> None:
        outcome = F.when(F.col("reason").isNull(), GOOD).otherwise(REJECTED).alias("outcome")
        rows = format_outcomes(batch, table_type, keep=keep).select("*", outcome)
        rows.write.mode("overwrite").partitionBy(*folders).parquet(f"{out}/batch={number}")

    return samples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_outcomes(spark: SparkSession, out: str, outcome: str) -> DataFrame:
    """The good samples or the rejects of a stream; only their folders are read."""
    return spark.read.parquet(out).where(F.col("outcome") == outcome).drop("outcome", "batch")
