"""Queries over texts: normalisation, query profiles, chain logs, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabchain.functions import text
from tabchain.operators import encoding
from tabchain.operators.mapping import encode_with, map_batches, map_rows
from tabchain.sources.corpus import few_shot_text, last_chains
from tabchain.sources.registry import spread_scan
from workload import sql_parts as q
from workload.corpora import chain_log, query_texts, single_texts, table

VOCABULARY = 4_000
LENGTH = encoding.MAX_LENGTH
# The stripped characters that the oracle names; the given texts hold no others at their ends.
_STRIP = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)||chr(8239)||chr(12288)"


def _model(column: str) -> str:
    return f"replace(lower(trim({column}, {_STRIP})), '\"', '')"


def normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("turn"), "text")
    talks = table(spark, d, "conversations").select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    return docs.unionByName(talks).withColumn("text", F.expr(text.model_text("text")))


NORMALIZE_SQL = f"""
SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS turn, {_model('text')} AS text FROM documents
UNION ALL SELECT 'conversation', conv_id, turn, {_model('text')} FROM conversations"""

# The query texts of workload.corpora.query_texts, in SQL.
QUERY_TEXTS = """
q AS (SELECT c_custkey, CASE c_custkey % 4
  WHEN 0 THEN 'SELECT c_name  FROM customer WHERE c_nationkey ! = ' || c_nationkey
  WHEN 1 THEN 'select count(*) from customer where c_custkey > = ' || c_custkey || ' and c_nationkey <> ' || c_nationkey
  WHEN 2 THEN 'Select c_name From customer Where c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey < = ' || c_nationkey || ' )'
  ELSE ' SELECT ' || c_mktsegment || chr(9) || '> = 1 ! =' END AS query FROM customer)"""


def repair(spark, d):
    return query_texts(spark, d).selectExpr("c_custkey", f"{text.repair_query('query')} AS query")


REPAIR_SQL = """
SELECT c_custkey, CASE c_custkey % 4
  WHEN 0 THEN 'SELECT c_name FROM customer WHERE c_nationkey != ' || c_nationkey
  WHEN 1 THEN 'select count(*) from customer where c_custkey >= ' || c_custkey || ' and c_nationkey <> ' || c_nationkey
  WHEN 2 THEN 'Select c_name From customer Where c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey <= ' || c_nationkey || ' )'
  ELSE 'SELECT ' || c_mktsegment || ' >= 1 !=' END AS query FROM customer"""


def keyword_profile(spark, d):
    """Keyword counts and spans of each query."""
    spans = lambda s: f"array_join(transform({s}, x -> concat(x.start, '-', x.end)), ',')"
    return query_texts(spark, d).selectExpr(
        "c_custkey",
        f"{text.keyword_count('query', text.SELECT_PATTERN)} AS n_select",
        f"{text.keyword_count('query', text.FROM_PATTERN)} AS n_from",
        f"{spans(text.select_spans('query'))} AS select_spans",
        f"{spans(text.from_spans('query'))} AS from_spans",
    )


def _spans_sql(word: str) -> str:
    n = len(word)
    return (
        f"coalesce((SELECT string_agg((p - 1) || '-' || (p - 1 + {n}), ',' ORDER BY p) FROM (SELECT unnest(range(1, length(query) + 1)) AS p) "
        f"WHERE lower(substr(query, p, {n})) = '{word}'), '')"
    )


PROFILE_SQL = f"""
WITH {QUERY_TEXTS}
SELECT c_custkey, len(regexp_extract_all(query, '(?i)select '))::INTEGER AS n_select, len(regexp_extract_all(query, '(?i)from'))::INTEGER AS n_from,
       {_spans_sql('select ')} AS select_spans, {_spans_sql('from')} AS from_spans FROM q"""


def profile_levels(spark, d):
    """Nesting levels of the query corpus."""
    levels = query_texts(spark, d).selectExpr(
        f"{text.keyword_count('query', text.SELECT_PATTERN)} AS level",
        f"{text.keyword_count('query', text.FROM_PATTERN)} AS n_from",
    )
    return levels.groupBy("level").agg(F.count("*").alias("queries"), F.sum("n_from").alias("n_from"))


LEVELS_SQL = f"""
WITH {QUERY_TEXTS}
SELECT len(regexp_extract_all(query, '(?i)select '))::INTEGER AS level, count(*) AS queries,
       sum(len(regexp_extract_all(query, '(?i)from')))::BIGINT AS n_from FROM q GROUP BY 1"""

LOG_SQL = """
log AS (SELECT c_custkey AS seq, 'Which customers are like ' || c_name || '?' AS query, CASE c_custkey % 3
  WHEN 0 THEN '<BEGIN> -> filter(' || c_nationkey || ') -> sort(c_name) -> <END>'
  WHEN 1 THEN 'group_by(c_mktsegment) -> sort(count) -> limit(5) -> <END>'
  ELSE '<BEGIN> ->join(nation)-> filter(' || c_nationkey || ') -> <END>' END AS chain, c_mktsegment AS answer FROM customer)"""


def next_action(spark, d):
    return chain_log(spark, d).selectExpr("seq", f"{text.next_action('chain')} AS action")


NEXT_SQL = """
SELECT c_custkey AS seq, CASE c_custkey % 3 WHEN 0 THEN 'filter(' || c_nationkey || ')'
  WHEN 1 THEN 'group_by(c_mktsegment)' ELSE 'join(nation)' END AS action FROM customer"""


def chain_steps(spark, d):
    """How often each step stands at each place of a logged chain."""
    steps = chain_log(spark, d).selectExpr(f"posexplode({text.chain_actions('chain')}) AS (p, action)")
    return steps.groupBy((F.col("p") + 1).alias("step_no"), "action").agg(F.count("*").alias("n"))


CHAIN_STEPS_SQL = """
SELECT step_no, action, count(*) AS n FROM (
  SELECT unnest([1, 2])::INTEGER AS step_no, unnest(['filter(' || c_nationkey || ')', 'sort(c_name)']) AS action FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT unnest([1, 2, 3])::INTEGER, unnest(['group_by(c_mktsegment)', 'sort(count)', 'limit(5)']) FROM customer WHERE c_custkey % 3 = 1
  UNION ALL SELECT unnest([1, 2])::INTEGER, unnest(['join(nation)', 'filter(' || c_nationkey || ')']) FROM customer WHERE c_custkey % 3 = 2
) GROUP BY 1, 2"""


def chain_texts(spark, d):
    return chain_log(spark, d).selectExpr("seq", f"{text.chain_text(text.chain_actions('chain'))} AS chain")


CHAIN_TEXT_SQL = f"""
WITH {LOG_SQL} SELECT seq, replace(replace(chain, '<BEGIN> ->join(nation)->', 'join(nation) ->'), '<BEGIN> -> ', '') AS chain FROM log"""


def last_n(spark, d):
    return last_chains(chain_log(spark, d), 5)


def few_shot(spark, d):
    return few_shot_text(chain_log(spark, d), 5)


FEW_SHOT_SQL = f"""
WITH {LOG_SQL}, t AS (SELECT * FROM log ORDER BY seq DESC LIMIT 5)
SELECT string_agg('Question: ' || query || '\nChain: ' || chain || '\n\n', '' ORDER BY seq) AS examples FROM t"""


# --- encoding ---------------------------------------------------------------


def _documents(spark, d) -> DataFrame:
    return spread_scan(table(spark, d, "documents"))


def vocabulary(spark, d):
    return encoding.vocabulary(_documents(spark, d), ["text"], VOCABULARY)


_TOKENS = r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'"


def _vocabulary_sql(source: str) -> str:
    return f"""
tok AS (SELECT unnest(regexp_extract_all({_model('text')}, {_TOKENS})) AS token FROM {source}),
cnt AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
vocab AS (SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 3)::INTEGER AS token_id FROM cnt QUALIFY token_id <= {VOCABULARY + 3})"""


VOCABULARY_SQL = f"WITH {_vocabulary_sql('documents')} SELECT token, n, token_id FROM vocab"


def _pairs(spark, d) -> DataFrame:
    """Document text as source, its language and source name as target."""
    return _documents(spark, d).select("doc_id", F.col("text").alias("source"), F.concat_ws(" ", "lang", F.lit('"from"'), "source").alias("target"))


def encode_fixed(spark, d):
    pairs = _pairs(spark, d)
    encoded = encoding.encode_samples(pairs, "doc_id", "source", "target", vocabulary(spark, d), LENGTH)
    line = lambda c: F.array_join(F.col(c), " ")
    return encoded.select("doc_id", "n_source", "n_target", line("input_ids").alias("input_ids"), line("attention_mask").alias("attention_mask"), line("labels").alias("labels"))


def _ids_sql(column: str, out: str) -> str:
    return f"""
{out}_tok AS (SELECT doc_id, regexp_extract_all({_model(column)}, {_TOKENS}) AS t FROM pairs),
{out}_long AS (SELECT doc_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS p FROM {out}_tok),
{out}_ids AS (SELECT doc_id, string_agg(coalesce(token_id, 3)::VARCHAR, ' ' ORDER BY p) AS ids
  FROM {out}_long LEFT JOIN vocab USING (token) WHERE p <= {LENGTH - 2} GROUP BY doc_id),
{out} AS (SELECT doc_id, len(t)::INTEGER AS n, '1 ' || coalesce(ids || ' ', '') || '2' || repeat(' 0', {LENGTH - 2} - least(len(t), {LENGTH - 2})) AS ids,
  rtrim(repeat('1 ', least(len(t) + 2, {LENGTH})) || repeat('0 ', {LENGTH} - least(len(t) + 2, {LENGTH}))) AS mask
  FROM {out}_tok LEFT JOIN {out}_ids USING (doc_id))"""


ENCODE_CTE = f"""
{_vocabulary_sql('documents')},
pairs AS (SELECT doc_id, text AS source, lang || ' "from" ' || source AS target FROM documents),
{_ids_sql('source', 'enc')}, {_ids_sql('target', 'lab')}"""

ENCODE_SQL = f"""
WITH {ENCODE_CTE} SELECT doc_id, enc.n AS n_source, lab.n AS n_target, enc.ids AS input_ids, enc.mask AS attention_mask, lab.ids AS labels
FROM enc JOIN lab USING (doc_id)"""


def truncation(spark, d):
    return encoding.truncation_report(_pairs(spark, d), ["source", "target"], LENGTH)


def _truncation_sql() -> str:
    one = lambda side: (
        f"SELECT '{side}' AS side, len(regexp_extract_all({_model(side)}, {_TOKENS})) AS n FROM pairs"
    )
    return f"""
WITH pairs AS (SELECT text AS source, lang || ' "from" ' || source AS target FROM documents), t AS ({one('source')} UNION ALL {one('target')})
SELECT side, count(*) AS samples, sum(n)::BIGINT AS tokens, count(*) FILTER (n > {LENGTH - 2}) AS cut_samples,
       sum(greatest(n - {LENGTH - 2}, 0))::BIGINT AS lost_tokens FROM t GROUP BY side"""


def label_unmask(spark, d):
    """Encoded targets with masked padding, back to text."""
    vocab = vocabulary(spark, d)
    encoded = encoding.encode_samples(_pairs(spark, d), "doc_id", "source", "target", vocab, LENGTH)
    masked = encoded.withColumn("labels", F.transform("labels", lambda x: F.when(x == encoding.PAD_ID, encoding.MASKED_LABEL).otherwise(x)))
    return encoding.decode_labels(masked, "doc_id", "labels", vocab)


LABELS_SQL = f"""
WITH {ENCODE_CTE}
SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY p) FILTER (token IN (SELECT token FROM vocab)), '') AS text
FROM lab_tok LEFT JOIN lab_long USING (doc_id) WHERE p <= {LENGTH - 2} GROUP BY doc_id"""


def encode_batch(spark, d):
    """Fixed-length encoding by a user tokenizer: bytes, moved up by one for the pad id."""
    # Made here, so that it travels with the job and tasks need not import this module.
    byte_tokenizer = lambda: lambda text: [b + 1 for b in text.encode("utf-8")]
    encoded = encode_with(_pairs(spark, d), "doc_id", "source", "target", byte_tokenizer, LENGTH)
    line = lambda c: F.array_join(F.col(c), " ")
    return encoded.select("doc_id", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("used"), line("labels").alias("labels"))


ENCODE_BATCH_SQL = f"""
WITH t AS (SELECT doc_id, least(strlen({_model('text')}), {LENGTH})::INTEGER AS used, {_model("lang || ' from ' || source")} AS target FROM documents)
SELECT doc_id, used, array_to_string(list_transform(range(1, {LENGTH} + 1), lambda p: CASE WHEN p <= length(target) THEN ascii(substr(target, p::BIGINT, 1)) + 1 ELSE 0 END), ' ') AS labels FROM t"""


def map_row_function(spark, d):
    """A user function per row, with an argument and without the input columns."""

    def shorten(row: dict, places: int) -> dict:
        name, number = row["c_name"].split("#")
        return {"c_custkey": row["c_custkey"], "short": name[:places] + str(int(number))}

    return map_rows(table(spark, d, "customer"), shorten, "c_custkey bigint, short string", ["c_custkey", "c_name"], places=2)


def map_batch_function(spark, d):
    """A user function per batch."""

    def price_band(batch, width: int):
        return batch.assign(band=(batch["p_retailprice"] // width).astype("int64"))[["p_partkey", "band"]]

    return map_batches(table(spark, d, "part"), price_band, "p_partkey bigint, band bigint", ["p_partkey", "p_retailprice"], width=50)


def split_cell(spark, d):
    """Parts of cells that hold several values."""
    return table(spark, d, "part").selectExpr(
        "p_partkey",
        f"{text.split_cell('p_name', ' ', 0)} AS first",
        f"coalesce({text.split_cell('p_name', ' ', 1)}, '') AS second",
    )


QUERIES = {
    "normalize_text": (normalize, NORMALIZE_SQL),
    "repair_query": (repair, REPAIR_SQL),
    "select_from_profile": (keyword_profile, PROFILE_SQL),
    "query_profile_levels": (profile_levels, LEVELS_SQL),
    "chain_next_action": (next_action, NEXT_SQL),
    "chain_steps": (chain_steps, CHAIN_STEPS_SQL),
    "chain_text": (chain_texts, CHAIN_TEXT_SQL),
    "last_n": (last_n, f"WITH {LOG_SQL} SELECT * FROM log ORDER BY seq DESC LIMIT 5"),
    "fewshot_text": (few_shot, FEW_SHOT_SQL),
    "vocabulary": (vocabulary, VOCABULARY_SQL),
    "encode_fixed": (encode_fixed, ENCODE_SQL),
    "truncation_report": (truncation, _truncation_sql()),
    "label_unmask": (label_unmask, LABELS_SQL),
    "encode_batch": (encode_batch, ENCODE_BATCH_SQL),
    "map_rows": (
        map_row_function,
        "SELECT c_custkey, substr(c_name, 1, 2) || split_part(c_name, '#', 2)::BIGINT AS short FROM customer",
    ),
    "map_batches": (map_batch_function, "SELECT p_partkey, CAST(floor(p_retailprice / 50) AS BIGINT) AS band FROM part"),
    "split_cell": (split_cell, "SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second FROM part"),
}
