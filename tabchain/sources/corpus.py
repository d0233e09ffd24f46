"""Reading and writing corpora of samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabchain.operators.assembly import align, union_sets
from tabchain.operators.positions import shard_id, with_shuffled_position

SPLITS = ("train", "validation", "test")


def read_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """All saved shards that match a glob, as one scan."""
    return spark.read.parquet(pattern)


def read_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """One split of a corpus; only its folder is read, a missing one is empty."""
    return spark.read.parquet(root).where(F.col("split") == split)


def write_splits(df: DataFrame, root: str) -> None:
    """Corpus in one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(root)


def write_shards(df: DataFrame, root: str, size: int, table_type: str, position: str = "pos") -> None:
    """Contiguous shards of ``size`` rows under their table type and number.

    Rows are brought together by shard, so each shard is one file.
    """
    (
        df.withColumn("shard_id", shard_id(size, position))
        .withColumn("table_type", F.lit(table_type))
        .repartition("shard_id")
        .sortWithinPartitions("shard_id", position)
        .write.mode("overwrite")
        .partitionBy("table_type", "shard_id")
        .parquet(root)
    )


def write_pairs(df: DataFrame, path: str) -> None:
    """Truth and prediction tables per sample."""
    df.select("sample_id", "truth", "pred").write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class SetSource:
    """One stored set and how it is aligned before the union; an optional one may be missing."""

    path: str
    drop: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)
    optional: bool = False


@dataclass(frozen=True)
class DatasetConfig:
    """Sources per split; a split without sources is missing."""

    train: tuple[SetSource, ...]
    validation: tuple[SetSource, ...]
    test: tuple[SetSource, ...] = ()
    shuffle_seed: int | None = None


# Names of the sets, and the columns each drops and renames.
# Their folders hang under a root.
DATASETS: dict[str, Callable[[str], DatasetConfig]] = {
    "tapex_pretraining": lambda root: DatasetConfig(
        train=(SetSource(f"{root}/tapex_pretraining/preprocessed_train_*"),),
        validation=(SetSource(f"{root}/tapex_pretraining/preprocessed_valid"),),
    ),
    "multitable_pretraining": lambda root: DatasetConfig(
        train=(
            SetSource(f"{root}/synthetic/train", ("db_name", "query"), {"question": "query"}),
            SetSource(f"{root}/spider_sql/train", ("question",)),
        ),
        validation=(SetSource(f"{root}/spider_sql/validation", ("question",)),),
        shuffle_seed=0,
    ),
    "spider_nq": lambda root: DatasetConfig(
        train=(SetSource(f"{root}/spider_nq/train"),),
        validation=(SetSource(f"{root}/spider_nq/validation"),),
        test=(SetSource(f"{root}/spider_nq/test", optional=True),),
    ),
    "atis": lambda root: _question_sets(root, "atis"),
    "geoquery": lambda root: _question_sets(root, "geoquery"),
}


def _question_sets(root: str, name: str) -> DatasetConfig:
    one = lambda split: (SetSource(f"{root}/{name}/{split}", (), {"question": "query"}),)
    return DatasetConfig(one("train"), one("validation"), one("test"))


def _read_set(spark: SparkSession, source: SetSource) -> DataFrame | None:
    """The aligned set, or None where an optional one is missing."""
    try:
        stored = spark.read.parquet(source.path)
    except AnalysisException as error:
        if not source.optional or "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return None
    return align(stored, list(source.drop), source.rename)


def load_dataset(
    spark: SparkSession, name: str, root: str, configs: dict[str, Callable[[str], DatasetConfig]] | None = None
) -> dict[str, DataFrame]:
    """Aligned splits of a named set; a missing test split is left out.

    The train split of a shuffled set carries its position as ``pos``, which
    needs a ``sample_id``.
    """
    known = configs or DATASETS
    if name not in known:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(known)}")
    config = known[name](root)
    splits = {}
    for split in SPLITS:
        found = [_read_set(spark, s) for s in getattr(config, split)]
        found = [df for df in found if df is not None]
        if not found:
            continue
        united = union_sets(found)
        if split == "train" and config.shuffle_seed is not None:
            united = with_shuffled_position(united, "sample_id", config.shuffle_seed)
        splits[split] = united
    return splits


CHAIN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("chain", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)


def read_chain_log(spark: SparkSession, path: str) -> DataFrame:
    """The chain log; a missing log is empty."""
    try:
        return spark.read.schema(CHAIN_LOG_SCHEMA).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return spark.createDataFrame([], CHAIN_LOG_SCHEMA)


def append_chain(spark: SparkSession, path: str, query: str, chain: str, answer: str) -> None:
    """Append one chain with the next sequence number; one writer at a time."""
    last = read_chain_log(spark, path).agg(F.max("seq").alias("last")).first().last
    row = [(0 if last is None else last + 1, query, chain, answer)]
    spark.createDataFrame(row, CHAIN_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def last_chains(log: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` chains in the order they were logged."""
    return log.orderBy(F.col("seq").desc()).limit(n).orderBy("seq")


def few_shot_text(log: DataFrame, n: int = 5) -> DataFrame:
    """The last chains as one example text; ``n`` rows are joined at most."""
    line = F.concat(F.lit("Question: "), "query", F.lit("\nChain: "), "chain", F.lit("\n\n"))
    return (
        last_chains(log, n)
        .agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("text")))).alias("lines"))
        .select(F.array_join(F.transform("lines", lambda x: x["text"]), "").alias("examples"))
    )
