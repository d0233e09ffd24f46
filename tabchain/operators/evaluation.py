"""Exact match, table match and quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabchain.functions.linear import has_cells
from tabchain.functions.sqltext import exists


def pair_predictions(references: DataFrame, predictions: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Full outer pairing by sample, so missing sides stay visible."""
    return references.join(predictions, id_col, "full_outer")


def is_exact_match(prediction: Column, reference: Column, ignore_case: bool = True) -> Column:
    """Equal texts; a missing side is no match."""
    if ignore_case:
        prediction, reference = F.lower(prediction), F.lower(reference)
    return F.coalesce(prediction == reference, F.lit(False))


def exact_match(
    pairs: DataFrame, by: list[str] | None = None, prediction: str = "prediction", reference: str = "reference"
) -> DataFrame:
    """Share of exact matches rounded to four places, over all or per group."""
    hit = is_exact_match(F.col(prediction), F.col(reference))
    return pairs.groupBy(*(by or [])).agg(
        F.count("*").alias("samples"),
        F.count_if(hit).alias("matches"),
        F.round(F.avg(hit.cast("double")), 4).alias("exact_match"),
    )


def table_match(truth: Column, pred: Column, ordered: bool = False) -> Column:
    """Equal columns and equal rows, as a list or as a multiset."""
    rows = (lambda t: t["rows"]) if ordered else (lambda t: F.array_sort(t["rows"]))
    return F.coalesce(
        (truth["columns"] == pred["columns"]) & (rows(truth) == rows(pred)), F.lit(False)
    )


def table_match_report(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pairs.groupBy(*(by or [])).agg(
        F.count("*").alias("samples"),
        F.count_if(table_match(F.col("truth"), F.col("pred"), ordered=True)).alias("ordered_matches"),
        F.count_if(table_match(F.col("truth"), F.col("pred"))).alias("unordered_matches"),
    )


def quality_report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of samples that would draw a warning, in one pass."""
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("samples"),
        F.count_if(F.coalesce("query", F.lit("")) == "").alias("empty_query"),
        F.count_if(F.expr(exists("tables", lambda t: f"NOT {has_cells(t)}"))).alias("empty_table"),
        F.count_if(F.col("answer").isNull()).alias("null_answer"),
        F.count_if(F.expr(f"answer IS NOT NULL AND NOT {has_cells('answer')}")).alias("empty_answer"),
        F.count_if(F.size("tables") != F.size("table_names")).alias("length_mismatch"),
    )


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("samples"))
