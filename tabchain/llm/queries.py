"""Queries of this folder: ``{name: (callable(spark, sf_dir), SQL text or None)}``.

Each applies its operator, with production parameters, to its whole table, and
takes the digest columns of the result from what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabchain.llm import oracles
from tabchain.llm.byte_bpe import encode_and_decode
from tabchain.llm.common import documents, id_bucket
from tabchain.llm.decontaminate import find_leaks
from tabchain.llm.exact_dedup import exact_dedup
from tabchain.llm.langid import identify
from tabchain.llm.line_dedup import line_dedup
from tabchain.llm.manifest import folded, leaf_text, manifest, proof
from tabchain.llm.minhash import near_duplicates
from tabchain.llm.negatives import hard_negatives
from tabchain.llm.packing import pack
from tabchain.llm.quality import THRESHOLD, classify
from tabchain.llm.records import read_records, with_start, write_records
from tabchain.llm.secrets import KINDS, scan_secrets
from tabchain.llm.url_filter import filter_urls
from tabchain.session import scratch_path


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(documents(spark, folder))

    def listed(spans):
        text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(text, ",")

    def of(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind_no"] < len(KINDS))
    return found.select(
        "doc_id",
        *[of(kind) for kind in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        of("entropy"),
    )


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def line_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: lines, removed lines, removed spans, digest of what stays."""
    cleaned = line_dedup(documents(spark, folder).select("doc_id", "text"))
    removed = F.aggregate("removed_chunks", F.lit(0), lambda n, c: n + c["lines"])
    spans = F.transform("removed_chunks", lambda c: F.concat_ws(":", c["first"], c["first"] + c["lines"]))
    return cleaned.select(
        "doc_id",
        F.col("total_lines").alias("n_lines"),
        removed.alias("n_removed"),
        F.array_join(spans, ",").alias("removed_lines"),
        F.sha2(F.col("text"), 256).alias("text_sha256"),
    )


def token_records(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch_path(spark, "token-records")
    write_records(documents(spark, folder), place)
    records = with_start(read_records(spark, place), spark, place)
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "file_no")


def minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder), words=2)


def packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(documents(spark, folder))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def quality(spark: SparkSession, folder: str) -> DataFrame:
    held_out = id_bucket(F.col("doc_id"), 5) == 0
    scored = classify(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def language(spark: SparkSession, folder: str) -> DataFrame:
    held_out = id_bucket(F.col("doc_id"), 3) == 1
    return identify(documents(spark, folder), held_out).withColumn("held_out", held_out)


def exact_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(documents(spark, folder))


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{folder}/pages.parquet"))


def hard_negatives_query(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"))


def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every row's witness, and the root that it gives to a row with half of them tampered with."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    without_breaks = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in columns]
    tampered = F.when(id_bucket(F.col("doc_id"), 2) == 0, F.sha2(leaf_text(without_breaks), 256))
    rows = manifest(documents(spark, folder), columns, {"tampered": tampered})
    text = lambda c: F.lower(F.hex(c)).alias(c)
    found = rows.select(
        "doc_id", *map(text, ("leaf", "subroot", "root")), F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", F.lower(F.hex("leaf"))), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_and_decode(documents(spark, folder)).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {
    "op1_secret_scan": (secret_scan, oracles.SECRET_SCAN),
    "op2_decontamination": (decontamination, None),
    "op3_line_dedup": (line_dedup_query, None),
    "op4_token_records": (token_records, None),
    "op5_minhash_dedup": (minhash_dedup, None),
    "op6_exact_dedup": (exact_dedup_query, oracles.EXACT_DEDUP),
    "op7_quality_neighbours": (quality, None),
    "op8_packing": (packing, None),
    "op9_language_id": (language, None),
    "op10_url_filter": (url_filter, None),
    "op11_hard_negatives": (hard_negatives_query, oracles.HARD_NEGATIVES),
    "op12_merkle_manifest": (merkle_manifest, oracles.MANIFEST),
    "op13_byte_bpe": (byte_bpe, None),
}
