"""Corpus pipeline: stages over ``documents``, each on what the one before kept.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next one's ``docs``. Stages that filter return the columns of
``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabchain.llm.common import documents, id_bucket, stored
from tabchain.llm.decontaminate import without_leaks
from tabchain.llm.langid import accepted, train, training_pieces
from tabchain.llm.line_dedup import line_dedup
from tabchain.llm.minhash import one_per_group
from tabchain.llm.packing import pack

#: Mean probability of its language that a document needs. Short clean texts of a
#: few words reach about twice this.
LEAST_LANGUAGE_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or of no likely language go.

    Languages are learned from rows with an id and a language. Without any there is
    nothing to tell a document's language by, and every row stays.
    """
    learned = docs.filter((id_bucket(F.col("doc_id"), 3) != 1) & F.col("doc_id").isNotNull())
    pieces, names = training_pieces(learned)
    return accepted(docs, train(pieces, names), LEAST_LANGUAGE_SCORE) if pieces else docs


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and runs of lines go; ``n_chars`` follows the text.

    Every row stays, and so do all other columns, whatever their names. Null texts
    stay null.
    """
    names = [c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(docs.columns)]
    cleaned = line_dedup(docs.toDF(*names), short_runs=True).select(*names).toDF(*docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8.

    Texts without words, null ones too, are linked with nothing and stay.
    """
    return one_per_group(docs, words=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with a checksum of their ids; a null text is an empty document."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Trained networks and tokenizers are beyond SQL; the tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
