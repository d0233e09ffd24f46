"""A chain log with many writers.

Writers append batches. A batch lies in a folder of its own, named by its writer and
its number, and is written there as a whole: writers never meet, and a batch that is
sent twice stands there once. Chains are ordered by time, writer, batch and place in
the batch. A compaction gathers batches into segments; a segment keeps which batch each
chain came from, so a reader takes every batch from one place, also while batches that
a segment holds still lie beside it, or when two compactions gathered the same ones.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BATCHES, SEGMENTS = "batches", "segments"
ORDER = ("logged_at", "writer", "batch", "place")

CHAIN_SCHEMA = (
    T.StructType()
    .add("place", T.IntegerType())
    .add("logged_at", T.TimestampType())
    .add("query", T.StringType())
    .add("chain", T.StringType())
    .add("answer", T.StringType())
)
ENTRY_SCHEMA = T.StructType([T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType()), *CHAIN_SCHEMA])


def _read(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame | None:
    """What lies under a path; None if nothing does."""
    try:
        return spark.read.schema(schema).options(**options).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return None


def write_batch(chains: DataFrame, path: str, writer: str, batch: int) -> None:
    """Write one batch: ``(place, logged_at, query, chain, answer)``, ``place`` unique in it.

    Writing the same batch again replaces it. A writer numbers its batches itself and
    must not use a number for two contents.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", writer):
        raise ValueError(f"a writer's name has letters, digits, '_', '.' and '-', not {writer!r}")
    rows = chains.select(*[F.col(f.name).cast(f.dataType) for f in CHAIN_SCHEMA])
    rows.write.mode("overwrite").parquet(f"{path}/{BATCHES}/writer={writer}/batch={batch:d}")


def _loose(spark: SparkSession, path: str) -> DataFrame:
    found = _read(spark, f"{path}/{BATCHES}/*/*", ENTRY_SCHEMA, basePath=f"{path}/{BATCHES}")
    return spark.createDataFrame([], ENTRY_SCHEMA) if found is None else found.select(*ENTRY_SCHEMA.names)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*ENTRY_SCHEMA, T.StructField("segment", T.StringType())])
    found = _read(spark, f"{path}/{SEGMENTS}/*", schema, basePath=f"{path}/{SEGMENTS}")
    return spark.createDataFrame([], schema) if found is None else found.select(*schema.names)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All chains, each once: ``(writer, batch, place, logged_at, query, chain, answer)``.

    A batch in several segments is taken from the first by name, one that also lies
    loose from its segment. Only names of batches are compared, one row for each. A
    missing log is empty.
    """
    kept, loose = _segments(spark, path), _loose(spark, path)
    first = kept.groupBy("writer", "batch").agg(F.min("segment").alias("segment"))
    once = kept.join(first, ["writer", "batch", "segment"], "left_semi").drop("segment")
    return once.unionByName(loose.join(first, ["writer", "batch"], "left_anti"))


def compact(spark: SparkSession, path: str) -> str | None:
    """Gather the loose batches into a new segment, in the order of the log; its name, or None.

    The segment appears as a whole when its job commits. Its files follow the size of
    its rows, not the number of batches.
    """
    found = _read(spark, f"{path}/{BATCHES}/*/*", ENTRY_SCHEMA, basePath=f"{path}/{BATCHES}")
    if found is None:
        return None
    known = _segments(spark, path).select("writer", "batch").distinct()
    fresh = found.select(*ENTRY_SCHEMA.names).join(known, ["writer", "batch"], "left_anti")
    if fresh.isEmpty():
        return None
    name = uuid.uuid4().hex
    rows = fresh.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    rows.write.parquet(f"{path}/{SEGMENTS}/segment={name}")
    return name


def drop_compacted(spark: SparkSession, path: str) -> int:
    """Remove loose batches that a segment holds; how many. Not beside a running reader."""
    held = _segments(spark, path).select("writer", "batch").distinct()
    loose = _loose(spark, path).select("writer", "batch").distinct().join(held, ["writer", "batch"], "left_semi")
    removed = 0
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for row in loose.toLocalIterator():
        folder = hadoop(f"{path}/{BATCHES}/writer={row.writer}/batch={row.batch}")
        removed += bool(folder.getFileSystem(conf).delete(folder, True))
    return removed


def last_logged(log: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` chains in the order they were logged."""
    return log.orderBy(*[F.desc(c) for c in ORDER]).limit(n).orderBy(*ORDER)
