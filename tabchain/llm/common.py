"""Helpers that several operators of this folder share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabchain.session import scratch_path


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the short way."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda repeats its body."""
    return F.transform(F.array(value), body)[0]


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def stored(df: DataFrame, name: str) -> DataFrame:
    """Rows written once to the shared folder and read back.

    It cuts the lineage: what is read again is neither computed again nor lost
    with an executor, and only the columns asked for are read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
