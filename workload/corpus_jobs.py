"""Queries over whole corpora: assembly, positions, shards, evaluation, chains per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabchain.functions.cells import table_value, text_array
from tabchain.functions.linear import linear_table
from tabchain.functions.sqltext import lit, struct
from tabchain.operators import evaluation as ev
from tabchain.operators import positions as pos
from tabchain.operators.assembly import align, union_sets
from tabchain.operators.generation import sample_values
from tabchain.plans.corpus_chain import STEP_DDL, run_corpus_chains
from tabchain.plans.sample_plans import run_sample_plans
from tabchain.session import scratch_path
from tabchain.sources import corpus
from tabchain.streaming.format_stream import (
    format_stream,
    format_stream_outcomes,
    format_stream_rejects,
    read_outcomes,
    read_samples_stream,
)
from workload import sql_parts as q
from workload.corpora import (
    multi_samples,
    order_tables,
    predictions,
    single_samples,
    single_texts,
    split_name,
    table,
)
from workload.nested import MODEL_WRAP, format_multi_sql

SEED = 3


def _raw_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two raw sets with different columns: customers and suppliers as questions."""
    synthetic = table(spark, d, "customer").select(
        (F.col("c_custkey") * 2).alias("sample_id"),
        F.lit("shop").alias("db_name"),
        F.lit("select 1").alias("query"),
        F.concat(F.lit("who is "), "c_name").alias("question"),
        F.array(F.lit(1)).alias("input_ids"),
    )
    spider = table(spark, d, "supplier").select(
        F.lit("unused").alias("question"),
        F.concat(F.lit("where is "), "s_name").alias("query"),
        (F.col("s_suppkey") * 2 + 1).alias("sample_id"),
        F.array(F.lit(2)).alias("labels"),
    )
    return synthetic, spider


def union_align(spark, d):
    synthetic, spider = _raw_sets(spark, d)
    return union_sets([align(synthetic, ["db_name", "query"], {"question": "query"}), align(spider, ["question"])])


UNION_SQL = "SELECT c_custkey * 2 AS sample_id, 'who is ' || c_name AS query FROM customer UNION ALL SELECT s_suppkey * 2 + 1, 'where is ' || s_name FROM supplier"


def load_dataset(spark, d):
    """A named set from stored parts: written, scanned, aligned, united, shuffled."""
    root = scratch_path(spark, "sets")
    synthetic, spider = _raw_sets(spark, d)
    synthetic.write.parquet(f"{root}/synthetic/train")
    spider.where("sample_id % 10 <> 1").write.parquet(f"{root}/spider_sql/train")
    spider.where("sample_id % 10 = 1").write.parquet(f"{root}/spider_sql/validation")
    splits = corpus.load_dataset(spark, "multitable_pretraining", root)
    return union_sets(
        [df.select(F.lit(name).alias("split"), "sample_id", "query", (F.col("pos") if "pos" in df.columns else F.lit(-1).cast("bigint")).alias("pos")) for name, df in splits.items()]
    )


LOAD_SQL = f"""
WITH u AS ({UNION_SQL}), t AS (SELECT * FROM u WHERE sample_id % 2 = 0 OR sample_id % 10 <> 1)
SELECT 'train' AS split, sample_id, query, row_number() OVER (ORDER BY {q.draw(0, 'sample_id')}, sample_id) - 1 AS pos FROM t
UNION ALL SELECT 'validation', sample_id, query, -1 FROM u WHERE sample_id % 2 = 1 AND sample_id % 10 = 1"""


def shard_assign(spark, d):
    """Positions of all orders by key, and their shards of 1000."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return pos.with_position(o, "o_orderkey").select("o_orderkey", "o_custkey", "pos", pos.shard_id(1000))


SHARD_SQL = """
SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos,
       (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS shard_id FROM orders"""


def shuffle_positions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return pos.with_shuffled_position(o, "o_orderkey", SEED)


def shuffle_slice(spark, d):
    """Rows ``[100, 400)`` of the seeded shuffle."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return pos.position_range(pos.with_shuffled_position(o, "o_orderkey", SEED), 100, 400)


def hash_shuffle(spark, d):
    """Seeded sample: the first 200 orders of the shuffle."""
    return pos.hash_shuffle(table(spark, d, "orders"), "o_orderkey", SEED).limit(200).select("o_orderkey", "o_custkey")


def hash_shuffle_all(spark, d):
    """All orders in the seeded shuffle, with their place in it."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return pos.numbered(pos.hash_shuffle(o, "o_orderkey", SEED))


def take_first(spark, d):
    return pos.take_first(table(spark, d, "events"), 500, ["event_id"]).select("event_id", "event_type")


def pick(spark, d):
    p = pos.with_position(table(spark, d, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"])
    return pos.pick_positions(p, [2, 5, 150])


_SHUFFLED = f"SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY {q.draw(SEED, 'o_orderkey')}, o_orderkey) - 1 AS pos FROM orders"


def shard_files(spark, d):
    """Shards written under their number and read back by glob."""
    root = scratch_path(spark, "shards")
    texts = pos.with_shuffled_position(single_texts(spark, d), "sample_id", SEED)
    corpus.write_shards(texts, root, 100, "linear")
    back = spark.read.option("basePath", root).parquet(f"{root}/table_type=linear/shard_id=*")
    return back.groupBy("table_type", F.col("shard_id").cast("bigint").alias("shard_id")).agg(
        F.count("*").alias("samples"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum(F.length("source")).alias("chars")
    )


SHARD_FILES_SQL = f"""
WITH {q.SINGLE_CTE}, p AS (SELECT sample_id, length({q.SINGLE_QUERY_OUT} || ' ' || tbl) AS chars,
  row_number() OVER (ORDER BY {q.draw(SEED, 'sample_id')}, sample_id) - 1 AS pos FROM src)
SELECT 'linear' AS table_type, pos // 100 AS shard_id, count(*) AS samples, min(pos) AS first, max(pos) AS last, sum(chars)::BIGINT AS chars FROM p GROUP BY 2"""


def split_files(spark, d):
    """A corpus written by split; one split is read back alone."""
    root = scratch_path(spark, "splits")
    corpus.write_splits(multi_samples(spark, d), root)
    return corpus.read_split(spark, root, "validation").select(
        "sample_id", "split", F.expr(linear_table("get(tables, 1)", "get(table_names, 1)")).alias("text")
    )


SPLIT_FILES_SQL = f"WITH {q.MULTI_CTE} SELECT sample_id, {q.SPLIT} AS split, tbl AS text FROM src2 SEMI JOIN s USING (sample_id) WHERE split = 'validation'"


def split_files_all(spark, d):
    """A corpus written by split; every split is read back, with every table."""
    root = scratch_path(spark, "splits")
    corpus.write_splits(multi_samples(spark, d), root)
    back = union_sets([corpus.read_split(spark, root, split) for split in corpus.SPLITS])
    each = back.select("sample_id", "split", F.explode(F.arrays_zip("table_names", "tables")).alias("t"))
    return each.select(
        "sample_id", "split", F.col("t.table_names").alias("table_name"), F.expr(linear_table("t.tables", "t.table_names")).alias("text")
    )


SPLIT_FILES_ALL_SQL = f"""
WITH {q.MULTI_CTE} SELECT sample_id, {q.SPLIT} AS split, 'orders' AS table_name, tbl AS text FROM src1 SEMI JOIN c USING (sample_id)
UNION ALL SELECT sample_id, {q.SPLIT}, 'customer', tbl FROM src2 SEMI JOIN s USING (sample_id)"""


def split_sizes(spark, d):
    return ev.split_sizes(multi_samples(spark, d))


def draw_values(spark, d):
    """One drawn row value and two drawn columns per table."""
    return sample_values(order_tables(spark, d), "sample_id", "table", 2, SEED).select(
        "sample_id", F.array_join("drawn_columns", ",").alias("drawn_columns"), F.array_join("drawn_values", ",").alias("drawn_values")
    )


def _draw_sql() -> str:
    names = q.ORDER_COLUMNS
    case = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(names))
    value = " ".join(f"WHEN {i} THEN c{i + 1}" for i in range(4))
    return f"""
WITH s AS ({q.order_block()}), n AS (SELECT sample_id, count(*) AS nrows FROM s GROUP BY 1),
e AS (SELECT sample_id, nrows, unnest(range(0, 4)) AS i FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {q.draw(SEED, 'sample_id', q.quoted('col'), 'i')}, i) - 1 AS j FROM e),
p AS (SELECT *, {q.draw(SEED, 'sample_id', q.quoted('row'), 'j')} % nrows + 1 AS rn FROM o WHERE j < 2)
SELECT sample_id, string_agg(CASE i {case} END, ',' ORDER BY j) AS drawn_columns, string_agg(CASE i {value} END, ',' ORDER BY j) AS drawn_values
FROM p JOIN s USING (sample_id, rn) GROUP BY sample_id"""


def _pairs(spark, d) -> DataFrame:
    references = single_texts(spark, d).select("sample_id", split_name().alias("split"), F.col("target").alias("reference"))
    return ev.pair_predictions(references, predictions(spark, d))


def exact_match(spark, d):
    return ev.exact_match(_pairs(spark, d))


def exact_match_by_split(spark, d):
    return ev.exact_match(_pairs(spark, d), ["split"])


_MATCH = "sample_id % 13 <> 0 AND sample_id % 11 <> 0"
_IDS = f"ids AS (SELECT DISTINCT o_orderkey // {q.SINGLE_ROWS} AS sample_id FROM orders)"
_MATCH_COLUMNS = f"count(*) AS samples, count(*) FILTER ({_MATCH}) AS matches, round(avg(({_MATCH})::INTEGER), 4) AS exact_match"


def table_match(spark, d):
    """Answer tables against predictions: same, other row order, changed, missing."""
    truth = single_samples(spark, d).select("sample_id", split_name().alias("split"), F.col("answer").alias("truth"))
    pred = f"""CASE WHEN sample_id % 5 = 0 THEN {table_value('truth.columns', 'reverse(truth.rows)')}
        WHEN sample_id % 7 = 0 THEN {table_value('truth.columns', 'slice(truth.rows, 1, 1)')}
        WHEN sample_id % 9 != 0 THEN truth END"""
    return ev.table_match_report(truth.withColumn("pred", F.expr(pred)), ["split"])


TABLE_MATCH_SQL = f"""
WITH s AS ({q.order_block()}), n AS (SELECT sample_id, count(*) FILTER (c3 = 'F') AS k FROM s GROUP BY 1)
SELECT {q.SPLIT} AS split, count(*) AS samples,
  count(*) FILTER (CASE WHEN sample_id % 5 = 0 OR sample_id % 7 = 0 THEN k < 2 ELSE sample_id % 9 <> 0 END) AS ordered_matches,
  count(*) FILTER (CASE WHEN sample_id % 5 = 0 THEN true WHEN sample_id % 7 = 0 THEN k < 2 ELSE sample_id % 9 <> 0 END) AS unordered_matches
FROM n GROUP BY 1"""


def _step(step: str, *columns: str, op: str = "", value: str = "", n: int = 0, table_no: int = 0) -> str:
    fields = struct(step=lit(step), columns=text_array(columns), op=lit(op), value=lit(value), n=str(n), table=str(table_no))
    return f"CAST({fields} AS {STEP_DDL})"


def chain_samples(spark, d) -> DataFrame:
    """Order blocks as two tables that share the key, with a chain per sample."""
    cells = lambda *at: f"transform(table.rows, r -> array({', '.join(f'get(r, {i})' for i in at)}))"
    first = table_value(text_array(["o_orderkey", "o_custkey", "o_orderstatus"]), cells(0, 1, 2))
    second = table_value(text_array(["o_orderkey", "o_orderstatus", "o_orderdate"]), cells(0, 2, 3))
    filtered = (_step("filter", "o_orderstatus", op="=", value="F"), _step("select", "no_such_column"), _step("select", "o_orderkey"))
    top = (_step("sort_desc", "o_custkey"), _step("limit", n=3), _step("select", "o_custkey", "o_orderkey"))
    joined = (
        _step("filter", "o_orderkey", op=">=", value="40"),
        _step("join", "o_orderkey", table_no=2),
        _step("select", "o_orderkey", "o_orderstatus_x", "o_orderdate"),
    )
    steps = f"""CASE sample_id % 4 WHEN 0 THEN array({', '.join(filtered)}) WHEN 1 THEN array({_step("group_count", "o_orderstatus")})
        WHEN 2 THEN array({', '.join(top)}) ELSE array({', '.join(joined)}) END"""
    finished = table_value(text_array(["o_orderkey"]), "transform(filter(table.rows, r -> get(r, 2) = 'F'), r -> slice(r, 1, 1))")
    return order_tables(spark, d).selectExpr(
        "sample_id", f"array({first}, {second}) AS tables", f"{steps} AS steps", f"if(sample_id % 4 = 0, {finished}, {first}) AS answer"
    )


def corpus_chain(spark, d):
    done = run_corpus_chains(chain_samples(spark, d))
    return done.selectExpr("sample_id", f"{linear_table('pred')} AS pred", "failed_steps")


CORPUS_CHAIN_SQL = f"""
WITH s AS ({q.order_block()}), ids AS (SELECT DISTINCT sample_id FROM s),
r AS (
  SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY rn) AS n, c1 AS cells FROM s WHERE sample_id % 4 = 0 AND c3 = 'F'
  UNION ALL SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY c3), c3 || ' | ' || count(*) FROM s WHERE sample_id % 4 = 1 GROUP BY sample_id, c3
  UNION ALL SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY c2::BIGINT DESC, rn) AS n, c2 || ' | ' || c1 FROM s WHERE sample_id % 4 = 2 QUALIFY n <= 3
  UNION ALL SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY rn), c1 || ' | ' || c3 || ' | ' || c4 FROM s WHERE sample_id % 4 = 3 AND c1::BIGINT >= 40),
t AS (SELECT sample_id, string_agg('row ' || n || ' : ' || cells, ' ' ORDER BY n) AS body FROM r GROUP BY 1)
SELECT sample_id, 'col : ' || CASE sample_id % 4 WHEN 0 THEN 'o_orderkey' WHEN 1 THEN 'o_orderstatus | count' WHEN 2 THEN 'o_custkey | o_orderkey'
  ELSE 'o_orderkey | o_orderstatus_x | o_orderdate' END || coalesce(' ' || body, '') AS pred, CASE WHEN sample_id % 4 = 0 THEN 1 ELSE 0 END AS failed_steps
FROM ids LEFT JOIN t USING (sample_id)"""


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of each sample numbered for the comparison, cells as one text."""
    n = F.row_number().over(Window.partitionBy("sample_id").orderBy("pos"))
    return rows.select("sample_id", n.alias("n"), F.array_join("cells", " | ").alias("cells"))


def sample_plans(spark, d):
    """The chains of corpus_chain as plans over flat rows: every last row of every sample."""
    samples = chain_samples(spark, d)
    tables = samples.select("sample_id", F.posexplode("tables").alias("t", "table")).withColumn("table_no", F.col("t") + 1)
    headers = tables.select("sample_id", "table_no", "table.columns")
    rows = tables.select("sample_id", "table_no", F.posexplode("table.rows").alias("row_no", "cells"))
    return _placed(run_sample_plans(rows, headers, samples.select("sample_id", "steps"))[0])


SAMPLE_PLANS_SQL = f"{CORPUS_CHAIN_SQL.partition('t AS (')[0].rstrip().rstrip(',')} SELECT sample_id, n::INTEGER AS n, cells FROM r"

_ORDER_TABLE = ["o_orderkey", "o_custkey", "o_orderstatus", "o_year"]
_CUSTOMER_TABLE = ["o_custkey", "c_mktsegment"]


def sample_plans_large(spark, d):
    """Five samples, the orders of each priority beside all customers, with a chain each, of three shapes."""
    sample = F.substring("o_orderpriority", 1, 1).cast("int").alias("sample_id")
    year = F.substring(F.col("o_orderdate").cast("string"), 1, 4)
    orders = table(spark, d, "orders").select(
        sample, F.lit(1).alias("table_no"), F.col("o_orderkey").alias("row_no"),
        F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"), year).alias("cells"),
    )
    ids = spark.range(1, 6).select(F.col("id").cast("int").alias("sample_id"))
    customers = table(spark, d, "customer").select(
        F.explode(F.sequence(F.lit(1), F.lit(5))).alias("sample_id"), F.lit(2).alias("table_no"), F.col("c_custkey").alias("row_no"),
        F.array(F.col("c_custkey").cast("string"), F.col("c_mktsegment")).alias("cells"),
    )
    names = lambda columns: F.array(*map(F.lit, columns))
    headers = ids.select("sample_id", F.explode(F.array(F.struct(F.lit(1).alias("table_no"), names(_ORDER_TABLE).alias("columns")), F.struct(F.lit(2).alias("table_no"), names(_CUSTOMER_TABLE).alias("columns")))).alias("h")).select("sample_id", "h.*")
    joined = ("join", ["o_custkey"], None, None, None, 2)
    chains = [
        (1, [joined, ("aggregate", ["c_mktsegment", "o_orderkey"], "COUNT", None, None, None)]),
        (2, [joined, ("aggregate", ["o_orderstatus", "o_custkey"], "SUM", None, None, None)]),
        (3, [("filter", ["o_orderstatus"], "=", "F", None, None), ("top", ["o_custkey"], None, None, 20, None)]),
        (4, [("filter", ["o_year"], ">=", "1996", None, None), ("top", ["o_orderkey"], None, None, 15, None)]),
        (5, [("sort_desc", ["o_custkey"], None, None, None, None), ("select", ["o_custkey", "o_orderkey"], None, None, None, None)]),
    ]
    steps = spark.createDataFrame(chains, f"sample_id int, steps array<{STEP_DDL}>")
    return _placed(run_sample_plans(orders.unionByName(customers.withColumn("row_no", F.col("row_no").cast("bigint"))), headers, steps)[0])


SAMPLE_LARGE_SQL = """
WITH o AS (SELECT substr(o_orderpriority, 1, 1)::INTEGER AS s, *, year(o_orderdate)::VARCHAR AS y FROM orders),
j AS (SELECT o.*, c_mktsegment FROM o JOIN customer ON c_custkey = o_custkey)
SELECT 1 AS sample_id, row_number() OVER (ORDER BY c_mktsegment)::INTEGER AS n, c_mktsegment || ' | ' || count(*) AS cells FROM j WHERE s = 1 GROUP BY c_mktsegment
UNION ALL SELECT 2, row_number() OVER (ORDER BY o_orderstatus)::INTEGER, o_orderstatus || ' | ' || sum(o_custkey) FROM j WHERE s = 2 GROUP BY o_orderstatus
UNION ALL (SELECT 3, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey)::INTEGER AS n, concat_ws(' | ', o_orderkey, o_custkey, o_orderstatus, y) FROM o WHERE s = 3 AND o_orderstatus = 'F' QUALIFY n <= 20)
UNION ALL (SELECT 4, row_number() OVER (ORDER BY o_orderkey DESC)::INTEGER AS n, concat_ws(' | ', o_orderkey, o_custkey, o_orderstatus, y) FROM o WHERE s = 4 AND y >= '1996' QUALIFY n <= 15)
UNION ALL SELECT 5, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey)::INTEGER, o_custkey || ' | ' || o_orderkey FROM o WHERE s = 5"""


def chain_pairs(spark, d):
    """Truth and prediction pairs saved and scored."""
    path = scratch_path(spark, "pairs")
    corpus.write_pairs(run_corpus_chains(chain_samples(spark, d)), path)
    return ev.table_match_report(spark.read.parquet(path))


CHAIN_PAIRS_SQL = f"""
WITH {_IDS} SELECT count(*) AS samples, count(*) FILTER (sample_id % 4 = 0) AS ordered_matches,
       count(*) FILTER (sample_id % 4 = 0) AS unordered_matches FROM ids"""


def stream_format(spark, d):
    """Samples landed as files, formatted by a stream, read back."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "formatted")
    samples = multi_samples(spark, d)
    samples.write.parquet(landing)
    stream = read_samples_stream(spark, landing, samples.schema)
    format_stream(stream, out, scratch_path(spark, "stream-state"), "html", "split").awaitTermination()
    return spark.read.parquet(out)


def stream_rejects(spark, d):
    """Samples of which every fifth lost its table names: counts of both outputs of the stream."""
    landing, out, rejects = (scratch_path(spark, n) for n in ("landing", "formatted", "rejects"))
    samples = multi_samples(spark, d).withColumn("table_names", F.expr("if(sample_id % 5 = 0, slice(table_names, 1, 1), table_names)"))
    samples.write.parquet(landing)
    stream = read_samples_stream(spark, landing, samples.schema)
    format_stream(stream, out, scratch_path(spark, "stream-state"), "html", "split").awaitTermination()
    format_stream_rejects(stream, rejects, scratch_path(spark, "reject-state"), "split").awaitTermination()
    good = spark.read.schema("sample_id bigint, source string, target string, split string").parquet(out)
    bad = spark.read.schema("sample_id bigint, reason string, split string").parquet(rejects)
    both = good.select("split", F.lit("").alias("reason")).unionByName(bad.select("split", "reason"))
    return both.groupBy("split", "reason").agg(F.count("*").alias("samples"))


def stream_outcomes(spark, d):
    """The same samples by one stream that parses them once: every good text, and the reason of every reject."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "outcomes")
    samples = multi_samples(spark, d).withColumn("table_names", F.expr("if(sample_id % 5 = 0, slice(table_names, 1, 1), table_names)"))
    samples.write.parquet(landing)
    stream = read_samples_stream(spark, landing, samples.schema)
    format_stream_outcomes(stream, out, scratch_path(spark, "outcome-state"), "html", "split").awaitTermination()
    found = [read_outcomes(spark, out, outcome) for outcome in ("good", "rejected")]
    return found[0].unionByName(found[1]).select("sample_id", "split", "source", "target", "reason")


STREAM_OUTCOMES_SQL = f"""
WITH good AS ({format_multi_sql('html', MODEL_WRAP)})
SELECT sample_id, {q.SPLIT} AS split, CASE WHEN sample_id % 5 <> 0 THEN source END AS source, CASE WHEN sample_id % 5 <> 0 THEN target END AS target,
  CASE WHEN sample_id % 5 = 0 THEN 'length mismatch' END AS reason FROM good"""

STREAM_REJECTS_SQL = f"""
WITH {q.MULTI_CTE}, ids AS (SELECT DISTINCT sample_id FROM s SEMI JOIN c USING (sample_id))
SELECT {q.SPLIT} AS split, CASE WHEN sample_id % 5 = 0 THEN 'length mismatch' ELSE '' END AS reason, count(*) AS samples FROM ids GROUP BY 1, 2"""


QUERIES = {
    "union_align": (union_align, UNION_SQL),
    "load_dataset": (load_dataset, LOAD_SQL),
    "shard_assign": (shard_assign, SHARD_SQL),
    "shuffle_positions": (shuffle_positions, _SHUFFLED),
    "shuffle_slice": (shuffle_slice, f"SELECT * FROM ({_SHUFFLED}) WHERE pos >= 100 AND pos < 400"),
    "hash_shuffle": (hash_shuffle, f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {q.draw(SEED, 'o_orderkey')}, o_orderkey LIMIT 200"),
    "hash_shuffle_all": (
        hash_shuffle_all,
        f"SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY {q.draw(SEED, 'o_orderkey')}, o_orderkey) - 1 AS pos FROM orders",
    ),
    "take_first": (take_first, "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 500"),
    "pick_positions": (
        pick,
        "SELECT * FROM (SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS pos FROM part) WHERE pos IN (2, 5, 150)",
    ),
    "shard_files": (shard_files, SHARD_FILES_SQL),
    "split_files": (split_files, SPLIT_FILES_SQL),
    "split_files_all": (split_files_all, SPLIT_FILES_ALL_SQL),
    "split_sizes": (
        split_sizes,
        f"WITH {q.MULTI_CTE}, ids AS (SELECT DISTINCT sample_id FROM s SEMI JOIN c USING (sample_id)) SELECT {q.SPLIT} AS split, count(*) AS samples FROM ids GROUP BY 1",
    ),
    "draw_values": (draw_values, _draw_sql()),
    "exact_match": (exact_match, f"WITH {_IDS} SELECT {_MATCH_COLUMNS} FROM ids"),
    "exact_match_by_split": (exact_match_by_split, f"WITH {_IDS} SELECT {q.SPLIT} AS split, {_MATCH_COLUMNS} FROM ids GROUP BY 1"),
    "table_match": (table_match, TABLE_MATCH_SQL),
    "corpus_chain": (corpus_chain, CORPUS_CHAIN_SQL),
    "sample_plans": (sample_plans, SAMPLE_PLANS_SQL),
    "sample_plans_large": (sample_plans_large, SAMPLE_LARGE_SQL),
    "chain_pairs": (chain_pairs, CHAIN_PAIRS_SQL),
    "stream_format": (stream_format, format_multi_sql("html", MODEL_WRAP)),
    "stream_rejects": (stream_rejects, STREAM_REJECTS_SQL),
    "stream_outcomes": (stream_outcomes, STREAM_OUTCOMES_SQL),
}
