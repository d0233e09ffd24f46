"""Every pipeline stage on tables that lack something."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, total_lines string, removed_chunks string, component_id long, kept string, row string"
FILTERS = corpus_pipeline.STAGES[:-1]
WORDS = "the of and to in is it that was for on are as with his they at be this from have or by one had not but what all were"


def rows(spark, *texts, lang=None):
    values = [(k, t, lang, "web", len(t or ""), "mine", "ours", -k, "k", "r") for k, t in enumerate(texts)]
    return spark.createDataFrame(values, SCHEMA).repartition(2)


@pytest.mark.parametrize(("name", "stage"), FILTERS)
def test_no_rows(spark, data, name, stage):
    found = stage(spark, rows(spark, "x").limit(0), data)
    assert found.count() == 0 and found.columns == rows(spark, "x").columns


def test_no_rows_are_no_pieces(spark, data):
    assert corpus_pipeline.packed(spark, rows(spark, "x").limit(0), data).count() == 0


@pytest.mark.parametrize(("name", "stage"), FILTERS)
def test_unlabelled_clean_documents_and_all_columns_stay(spark, data, name, stage):
    docs = rows(spark, WORDS, "another text of its own kind with words", "short", WORDS.upper() + " and more of them than there are")
    found = stage(spark, docs, data)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize(("name", "stage"), FILTERS)
def test_null_and_empty_texts(spark, data, name, stage):
    docs = rows(spark, None, "", None, "").withColumn("source", F.lit(None).cast("string"))
    found = stage(spark, docs, data)
    assert sorted(r.doc_id for r in found.collect()) == [0, 1, 2, 3], "without a labelled language every stage keeps them"
    assert {r.text for r in found.collect()} == {None, ""}


def test_repeated_rows(spark, data):
    docs = rows(spark, f"{WORDS} {WORDS}", "something else entirely, said once")
    docs = docs.unionByName(docs)
    assert corpus_pipeline.known_language(spark, docs, data).count() == 4
    assert corpus_pipeline.without_repeated_lines(spark, docs, data).count() == 4
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, data).collect()} == {0, 1}
    assert corpus_pipeline.without_benchmark(spark, docs, data).count() == 4
    assert corpus_pipeline.packed(spark, docs, data).select("doc_id").distinct().count() == 2
