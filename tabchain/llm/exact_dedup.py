"""Exact dedup by skew-safe combining.

Equal texts meet in three steps, each of which compares whole contents and not
digests alone: rows of one task are combined before anything is shuffled, the
survivors of all tasks are combined per (digest, salt), and the winners of the
salts are combined per digest. A group of any size reaches a step as at most one
row per task or per salt, so no key is hot and no list of a group is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabchain.llm.common import ascii_lower, stored

SALTS = 16


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def exact_groups(texts: DataFrame, salts: int = SALTS) -> DataFrame:
    """``(digest, content, keep_id, group_size, contents)``, a row per distinct content.

    ``texts`` holds ``doc_id, digest, content``; ``contents`` counts the contents
    that share a digest.
    """
    salted = texts.withColumn("salt", F.spark_partition_id() % salts)
    merged = salted.groupBy("digest", "salt", "content").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    winners = (
        merged.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    return winners.withColumn("contents", F.count("*").over(Window.partitionBy("digest")))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row.

    Texts are equal when they are identical after A-Z became a-z. The largest id
    of a group stays. Null texts count as empty, and all empty texts are one
    group. Rows that repeat an id are rows of their own and count in
    ``group_size``; if the largest id is repeated, each of its rows is kept. A
    null id is the kept one only if its whole group has no other; ``keep_id`` is
    null then. Other columns are ignored, whatever their names. No rows give no
    rows.

    Rows find their group by digest, since the combining has shown that it stands
    for one content. Should a digest stand for several, its rows are looked up by
    content too.
    """
    content = normalised(F.col(text_col))
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(content, 256).alias("digest"), content.alias("content")
    )
    groups = stored(
        exact_groups(texts, salts).withColumn(
            "content", F.when(F.col("contents") > 1, F.col("content"))
        ),
        "exact-groups",
    )
    return look_up(texts, groups)


def look_up(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row's group; ``groups`` holds a content only where a digest has several."""
    columns = [
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    ]
    single = groups.filter("contents = 1").drop("content", "contents")
    several = groups.filter("contents > 1").drop("contents")
    found = texts.drop("content").join(single, "digest").select(*columns)
    if several.isEmpty():
        return found
    return found.unionByName(texts.join(several, ["digest", "content"]).select(*columns))
