"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

The URLs that a rule decides are the labelled ones. A bounded number of them
trains the trees; every URL without a rule is judged by the model.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabchain.llm.common import ascii_lower, stored
from tabchain.operators.joins import spread_join

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: At most so many URLs of each label train the trees.
TRAIN_PER_LABEL = 4_000
TREES, DEPTH, STEP = 12, 4, 0.3
SMOOTHING = 8.0


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path`` (both empty for null or without ``://``)."""
    rest = F.when(
        F.col(url).contains("://"), F.regexp_replace(F.col(url), r"(?s)^.*?://", "")
    ).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": ascii_lower(host), "path": path})


def rule_column(rules: tuple = RULES) -> Column:
    """Longest rule that fits, as ``struct<rule, verdict>``; null without one."""
    chosen = F.lit(None)
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = (
            (F.col("host") == host) | F.col("host").endswith(f".{host}")
        ) & F.col("path").startswith(path)
        hit = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, hit).otherwise(chosen)
    return chosen


def _share(text: Column, pattern: str) -> Column:
    kept = F.length(F.regexp_replace(text, pattern, ""))
    return F.when(F.length(text) > 0, 1 - kept / F.length(text)).otherwise(0.0)


def _entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of the characters of a text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    return F.coalesce(
        F.aggregate(
            F.array_distinct(chars),
            F.lit(0.0),
            lambda acc, c: acc
            - F.size(F.filter(chars, lambda d: d == c)) / n * F.log2(F.size(F.filter(chars, lambda d: d == c)) / n),
        ),
        F.lit(0.0),
    )


def suffixes() -> tuple[Column, Column]:
    """Last label of the host, and its last two."""
    return F.substring_index("host", ".", -1), F.substring_index("host", ".", -2)


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """``(suffix, blocked_share, log_count)``: smoothed, for every labelled suffix."""
    one, two = suffixes()
    counted = (
        labelled.select("blocked", F.explode(F.array_distinct(F.array(one, two))).alias("suffix"))
        .groupBy("suffix")
        .agg(F.count("*").alias("n"), F.sum("blocked").alias("n_blocked"))
    )
    return counted.select(
        "suffix",
        ((F.col("n_blocked") + SMOOTHING / 2) / (F.col("n") + SMOOTHING)).alias("blocked_share"),
        F.log1p("n").alias("log_count"),
    )


FEATURES = (
    "length", "host_length", "host_depth", "depth", "digit_ratio", "host_digit_ratio",
    "entropy", "host_entropy", "parameters", "hyphens", "fragment", "secure", "last_length",
    "share_1", "count_1", "share_2", "count_2",
)


def with_features(pages: DataFrame, statistics: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features of ``FEATURES``; needs ``host`` and ``path``."""
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    one, two = suffixes()
    lexical = pages.withColumns(
        {
            "length": F.length(text),
            "host_length": F.length("host"),
            "host_depth": F.size(F.split("host", r"\.")),
            "depth": F.size(F.filter(F.split("path", "/"), lambda p: p != "")),
            "digit_ratio": _share(text, "[0-9]"),
            "host_digit_ratio": _share(F.col("host"), "[0-9]"),
            "entropy": _entropy(text),
            "host_entropy": _entropy(F.col("host")),
            "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")),
            "hyphens": F.length("host") - F.length(F.regexp_replace("host", "-", "")),
            "fragment": text.contains("#").cast("int"),
            "secure": ascii_lower(F.substring(text, 1, 8)).startswith("https").cast("int"),
            "last_length": F.length(F.substring_index("path", "/", -1)),
            "suffix_1": one,
            "suffix_2": two,
        }
    )
    for k in (1, 2):
        side = statistics.select(
            F.col("suffix").alias(f"suffix_{k}"),
            F.col("blocked_share").alias(f"share_{k}"),
            F.col("log_count").alias(f"count_{k}"),
        )
        lexical = spread_join(lexical, side, [f"suffix_{k}"], [url], "left")
    return lexical.fillna({"share_1": 0.5, "count_1": 0.0, "share_2": 0.5, "count_2": 0.0})


def train(labelled: DataFrame, statistics: DataFrame, per_label: int = TRAIN_PER_LABEL):
    """Trees fitted on at most ``per_label`` URLs of each label, chosen by hash."""
    chosen = None
    for label in (0, 1):
        part = (
            labelled.filter(F.col("blocked") == label)
            .orderBy(F.xxhash64("url", "page_id"), "url", "page_id")
            .limit(per_label)
        )
        chosen = part if chosen is None else chosen.unionByName(part)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows = with_features(stored(chosen, "url-chosen"), statistics)
    # The joins give no order; the trees are fitted on rows in one order.
    rows = rows.repartition(1).sortWithinPartitions("blocked", F.xxhash64("url", "page_id"), "url", "page_id")
    rows = rows.select(*FEATURES, F.col("blocked").cast("double"))
    fitted = assembler.transform(stored(rows, "url-training")).select("features", "blocked")
    booster = GBTClassifier(
        labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, cacheNodeIds=False
    )
    return assembler, booster.fit(fitted)


def filter_urls(
    pages: DataFrame,
    rules: tuple = RULES,
    id_col: str = "page_id",
    url: str = "url",
    per_label: int = TRAIN_PER_LABEL,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, block_score)`` for every row.

    The rule's verdict holds where one fits. Elsewhere the trees decide: ``block``
    from a score of 0.5. ``block_score`` is null where a rule decided. A null or
    odd URL has an empty host and path, fits no rule and is judged like any other.
    Repeated rows are judged alike. Where the rules label URLs with one verdict
    only, all others get that verdict; without any labelled URL they are allowed;
    the score is then 1 or 0. Other columns are ignored. No rows give no rows.
    """
    parts = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url")))
    judged = parts.withColumn("hit", rule_column(rules))
    labelled = judged.filter("hit is not null").withColumn(
        "blocked", (F.col("hit.verdict") == "block").cast("int")
    )
    seen = {r.blocked for r in labelled.select("blocked").distinct().collect()}
    by_rule = F.col("hit.verdict")
    if seen != {0, 1}:
        score = F.lit(1.0 if seen == {1} else 0.0)
        scored = judged.withColumn("score", score)
    else:
        statistics = stored(suffix_statistics(labelled), "url-suffixes")
        assembler, model = train(labelled, statistics, per_label)
        features = assembler.setHandleInvalid("keep").transform(with_features(judged, statistics))
        scored = model.transform(features).withColumn("score", vector_to_array("probability")[1])
    by_method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(by_rule, by_method).alias("verdict"),
        F.when(F.col("hit").isNull(), F.col("score")).alias("block_score"),
    )
