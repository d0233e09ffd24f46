"""Sources, sinks, positions, encoding, generation, evaluation and streaming."""

from __future__ import annotations

import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tabchain.functions.cells import TABLE_DDL, text_array
from tabchain.functions.sqltext import lit
from tabchain.operators import encoding, evaluation, generation, nesting, positions
from tabchain.operators.assembly import align, alignment_reason, decode_tables, drop_columns, fill_from_text, query_text, split_rejects
from tabchain.operators.mapping import encode_with
from tabchain.plans.formatting import format_multi_table, format_rejects, linear_samples, model_pairs
from tabchain.session import cut_lineage, scratch_path
from tabchain.sources import corpus, registry
from tabchain.streaming.format_stream import format_stream, format_stream_outcomes, format_stream_rejects, read_outcomes, read_samples_stream
from workload import corpora

SAMPLE = f"sample_id bigint, query string, table_names array<string>, tables array<{TABLE_DDL}>, answer {TABLE_DDL}"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- sources and sinks --------------------------------------------------------


def test_indexed_csvs_are_registered(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"coworker{i}.csv").write_text(f"idx,personId,name\n0,{i},ann\n1,{i + 1},bob\n")
    paths = [str(tmp_path / f"coworker{i}.csv") for i in range(2)]
    schemas = ["idx int, personId bigint, name string"] * 2
    for named in (registry.read_indexed_csvs(spark, paths), registry.read_indexed_csvs(spark, paths, schemas)):
        assert list(named) == ["df1", "df2"]
        assert named["df2"].columns == ["personId", "name"]
        assert registry.run_sql(spark, "SELECT sum(personId) AS s FROM df2").first().s == 3


def test_named_tables_and_views(spark):
    spark.range(12).selectExpr("id", "encode('é', 'ISO-8859-1') AS b").createOrReplaceTempView("numbers")
    named = registry.load_named(spark, ["numbers"])
    assert registry.decode_latin1(named["numbers"]).first().b == "é"
    view = registry.view_tables({"numbers": named["numbers"].select("id")}, ["numbers"])
    lines = view.split("\n")
    assert lines[0].startswith("Here are .head(10)") and lines[1] == "numbers:"
    assert len(lines) == 2 + 2 + 10
    short = registry.view_tables({"numbers": named["numbers"].select("id")}, ["numbers"], rows=3).split("\n")
    assert short[0].startswith("Here are .head(3)") and len(short) == 2 + 2 + 3


def test_split_files_and_missing_split(spark, tmp_path):
    root = str(tmp_path / "corpus")
    df = spark.range(10).selectExpr("id AS sample_id", "if(id < 7, 'train', 'validation') AS split")
    corpus.write_splits(df, root)
    assert corpus.read_split(spark, root, "validation").count() == 3
    assert corpus.read_split(spark, root, "test").count() == 0
    plan = corpus.read_split(spark, root, "train")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*split.*train", plan)


def test_shards_are_contiguous_files(spark, tmp_path):
    root = str(tmp_path / "shards")
    df = positions.with_shuffled_position(spark.range(95).withColumnRenamed("id", "sample_id"), "sample_id", 1)
    corpus.write_shards(df, root, 20, "html")
    back = corpus.read_shards(spark, f"{root}/table_type=html/shard_id=*")
    assert back.count() == 95
    one = spark.read.parquet(f"{root}/table_type=html/shard_id=4")
    assert sorted(r.pos for r in one.collect()) == list(range(80, 95))
    assert len(list((tmp_path / "shards/table_type=html/shard_id=0").glob("*.parquet"))) == 1


def test_unknown_dataset(spark):
    with pytest.raises(ValueError, match="unknown dataset"):
        corpus.load_dataset(spark, "nothing", "/nowhere")


def test_datasets_without_test_split(spark, tmp_path):
    for split in ("train", "validation"):
        spark.range(3).selectExpr("id AS sample_id", "'q' AS query").write.parquet(str(tmp_path / "spider_nq" / split))
    assert list(corpus.load_dataset(spark, "spider_nq", str(tmp_path))) == ["train", "validation"]


def test_optional_test_split_is_read(spark, tmp_path):
    for n, split in enumerate(corpus.SPLITS, 3):
        spark.range(n).selectExpr("id AS sample_id", "'q' AS query").write.parquet(str(tmp_path / "spider_nq" / split))
    found = corpus.load_dataset(spark, "spider_nq", str(tmp_path))
    assert {split: df.count() for split, df in found.items()} == {"train": 3, "validation": 4, "test": 5}


def test_missing_split_that_is_not_optional_fails(spark, tmp_path):
    with pytest.raises(AnalysisException):
        corpus.load_dataset(spark, "spider_nq", str(tmp_path))


def test_question_sets_are_renamed(spark, tmp_path):
    for split in corpus.SPLITS:
        spark.range(3).selectExpr("id AS sample_id", "'q' AS question", "array(1) AS labels").write.parquet(str(tmp_path / "atis" / split))
    splits = corpus.load_dataset(spark, "atis", str(tmp_path))
    assert all(df.columns == ["sample_id", "query"] for df in splits.values()) and len(splits) == 3


def test_chain_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert corpus.read_chain_log(spark, path).count() == 0
    assert corpus.few_shot_text(corpus.read_chain_log(spark, path)).first().examples == ""
    for i in range(7):
        corpus.append_chain(spark, path, f"q{i}", f"a{i} -> <END>", "x")
    last = corpus.last_chains(corpus.read_chain_log(spark, path), 3).collect()
    assert [(r.seq, r.query) for r in last] == [(4, "q4"), (5, "q5"), (6, "q6")]
    text = corpus.few_shot_text(corpus.read_chain_log(spark, path), 2).first().examples
    assert text == "Question: q5\nChain: a5 -> <END>\n\nQuestion: q6\nChain: a6 -> <END>\n\n"


def test_pairs_file(spark, tmp_path):
    df = spark.sql("SELECT 1L AS sample_id, 'x' AS truth, 'y' AS pred, 0 AS more")
    corpus.write_pairs(df, str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).columns == ["sample_id", "truth", "pred"]


def test_checkpoint_cuts_the_plan(spark):
    cut = cut_lineage(spark.range(5).selectExpr("id * 2 AS x"))
    assert "Range" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert rows(cut) == [(0,), (2,), (4,), (6,), (8,)]
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


# --- assembly -----------------------------------------------------------------


def test_drop_and_align(spark):
    df = spark.sql("SELECT 1 AS sample_id, 'a' AS question, 'd' AS db_name, array(1) AS input_ids")
    assert drop_columns(df, ["db_name", "absent"]).columns == ["sample_id", "question", "input_ids"]
    assert align(df, ["db_name"], {"question": "query"}).columns == ["sample_id", "query"]


def test_query_choice(spark):
    both = spark.sql("SELECT 'q' AS query, CAST(NULL AS string) AS question UNION ALL SELECT 'q', 'n'")
    assert rows(both.selectExpr(query_text(both))) == [("n",), ("q",)]
    assert query_text(spark.sql("SELECT 1 AS query")) == "query"


def test_decode_and_reject(spark):
    json = '{"columns":["a"],"index":[0],"data":[["x"]]}'
    df = spark.createDataFrame(
        [(1, ["t"], [json], json), (2, ["t", "u"], [json], json), (3, ["t"], ["broken"], json), (4, None, [json], json)],
        "sample_id bigint, table_names array<string>, tables array<string>, answer string",
    ).withColumn("query", F.lit("q"))
    decoded = decode_tables(df)
    assert {(r.sample_id, r.reason) for r in format_rejects(decoded).collect()} == {
        (2, "length mismatch"), (3, "broken table"), (4, "missing"),
    }
    assert [r.sample_id for r in format_multi_table(decoded, "html").collect()] == [1]
    good, bad = split_rejects(decoded.withColumn("reason", alignment_reason()))
    assert good.count() == 1 and bad.count() == 3 and "reason" not in good.columns


def test_missing_fields_come_from_the_text(spark):
    source, target = "who <table_name> : t col : a | b row 1 : 1 | 2", "col : a row 1 : 1"
    df = spark.createDataFrame(
        [(1, None, None, None, None, source, target), (2, "kept", ["k"], [(["z"], [["9"]])], (["z"], []), source, target)],
        SAMPLE + ", source string, target string",
    )
    got = {r.sample_id: r for r in fill_from_text(df).collect()}
    assert (got[1].query, got[1].table_names) == ("who", ["t"])
    assert list(got[1].tables[0]["rows"][0]) == ["1", "2"] and got[1].answer["columns"] == ["a"]
    assert (got[2].query, got[2].table_names, got[2].answer["columns"]) == ("kept", ["k"], ["z"])
    assert got[1].parse_reason is None and got[2].parse_reason is None


def test_text_that_does_not_fit_is_not_filled_silently(spark):
    good, target = "who <table_name> : t col : a | b row 1 : 1 | 2", "col : a row 1 : 1"
    wide, ragged = "who <table_name> : t col : a | b row 1 : 1 | 2 | 3", "col : a row 1 : 1 | 2"
    df = spark.createDataFrame(
        [(i, None, None, None, None, s, t) for i, (s, t) in enumerate([(good, target), (wide, target), (good, ragged)])],
        SAMPLE + ", source string, target string",
    )
    got = {r.sample_id: r.parse_reason for r in fill_from_text(df).collect()}
    assert got == {0: None, 1: "row width", 2: "broken answer"}


def test_nested_tables_are_bounded(spark):
    """One key with most of the rows becomes many tables, and no row is lost."""
    df = spark.range(1000).selectExpr("if(id < 900, 'hot', 'cold') AS k", "id AS pos", "CAST(id AS string) AS v")
    nested = nesting.nest_rows(df, ["k"], "pos", ["v"], 64)
    sizes = [r.n for r in nested.selectExpr("size(table.rows) AS n").collect()]
    assert max(sizes) <= 64 and sum(sizes) == 1000
    with pytest.raises(ValueError):
        nesting.nest_rows(df, ["k"], "pos", ["v"], 0)


def test_long_cells(spark):
    df = spark.createDataFrame([(1, ["t"], [(["a", "b"], [["x", None], ["y", "z"]])])], f"id bigint, ns array<string>, ts array<{TABLE_DDL}>")
    assert rows(nesting.long_cells(df, "id", "ts", "ns")) == [
        (1, 1, "t", 1, 1, "a", "x"), (1, 1, "t", 1, 2, "b", None), (1, 1, "t", 2, 1, "a", "y"), (1, 1, "t", 2, 2, "b", "z"),
    ]


# --- determinism ----------------------------------------------------------------


@pytest.mark.parametrize("make", ["shuffled", "ordered", "where", "shuffle_head"])
def test_partitioning_changes_nothing(spark, data, make):
    orders = corpora.table(spark, data, "orders").select("o_orderkey", "o_orderstatus")
    tables = corpora.order_tables(spark, data)

    def run(n):
        if make == "shuffled":
            return rows(positions.with_shuffled_position(orders.repartition(n), "o_orderkey", 5))
        if make == "ordered":
            return rows(positions.with_position(orders.repartition(n), ["o_orderstatus", "o_orderkey"]))
        if make == "shuffle_head":
            return [tuple(r) for r in positions.hash_shuffle(orders.repartition(n), "o_orderkey", 5).limit(20).collect()]
        made = generation.generate_where(tables.repartition(n), "sample_id", "table", 2, 5)
        return rows(made.select("sample_id", "query_no", "text"))

    assert run(1) == run(3) == run(8)


def test_positions_are_dense(spark):
    df = spark.range(0, 5000, 7).repartition(5)
    for made in (positions.with_shuffled_position(df, "id", 2), positions.with_position(df, "id")):
        assert sorted(r.pos for r in made.collect()) == list(range(df.count()))
    picked = positions.pick_positions(positions.with_position(df, "id"), [0, 3])
    assert sorted(r.id for r in picked.collect()) == [0, 21]
    part = positions.position_range(positions.with_position(df, "id"), 710, 9999)
    assert sorted(r.pos for r in part.collect()) == [710, 711, 712, 713, 714]


def test_positions_of_equal_keys(spark):
    """Each row once, equal keys in the order of the other columns, whole copies next to each other."""
    rows = [(1, "b", {"x": 1}), (1, "a", None), (None, "z", None), (2, "c", None), (2, "c", None)]
    df = spark.createDataFrame(rows, "`k.1` int, v string, m map<string,int>").repartition(3)
    made = positions.with_position(df, "k.1")
    assert made.columns == ["k.1", "v", "m", "pos"]
    assert [(r["k.1"], r.v) for r in sorted(made.collect(), key=lambda r: r.pos)] == [(None, "z"), (1, "a"), (1, "b"), (2, "c"), (2, "c")]
    assert sorted(r.pos for r in made.collect()) == list(range(5))


def test_whole_shuffle_is_numbered(spark):
    """Every row, over several sorted partitions and with rows that are no multiple of them."""
    from tabchain.operators import positions

    df = spark.range(1003).repartition(5)
    want = [r.id for r in positions.hash_shuffle(df, "id", 3).collect()]
    found = positions.numbered(positions.hash_shuffle(df, "id", 3)).collect()
    assert [r.id for r in sorted(found, key=lambda r: r.pos)] == want
    assert sorted(r.pos for r in found) == list(range(1003))


def test_shuffles_differ_by_seed(spark):
    df = spark.range(100)
    order = lambda seed: [r.id for r in positions.hash_shuffle(df, "id", seed).collect()]
    assert order(0) != order(1) and sorted(order(0)) == list(range(100))


# --- encoding -------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoded(spark):
    texts = spark.createDataFrame(
        [(1, 'The cat, the "dog"', "cat"), (2, "", "the the cat"), (3, "a b c d e f g h the", "zebra")], "id bigint, s string, t string"
    )
    vocab = encoding.vocabulary(texts, ["s", "t"], 2)
    return texts, vocab


def test_vocabulary_keeps_the_most_frequent(encoded):
    assert rows(encoded[1].select("token", "n", "token_id")) == [("cat", 3, 5), ("the", 5, 4)]


def test_fixed_length_encoding(encoded):
    texts, vocab = encoded
    got = {r.id: r for r in encoding.encode_samples(texts, "id", "s", "t", vocab, 8).collect()}
    assert got[1].input_ids == [1, 4, 5, 3, 4, 3, 2, 0] and got[1].attention_mask == [1] * 7 + [0]
    assert got[1].labels == [1, 5, 2, 0, 0, 0, 0, 0]
    assert got[2].input_ids == [1, 2, 0, 0, 0, 0, 0, 0] and got[2].attention_mask == [1, 1, 0, 0, 0, 0, 0, 0]
    assert got[3].input_ids == [1, 3, 3, 3, 3, 3, 3, 2] and got[3].attention_mask == [1] * 8
    assert (got[3].n_source, got[3].n_target) == (9, 1)
    report = {r.side: r for r in encoding.truncation_report(texts, ["s", "t"], 8).collect()}
    assert (report["s"].tokens, report["s"].cut_samples, report["s"].lost_tokens) == (14, 1, 3)


def test_encoding_is_narrow_and_takes_null_texts(spark, encoded):
    texts = spark.createDataFrame([(1, None, "cat"), (2, "the", None)], "id bigint, s string, t string")
    made = encoding.encode_samples(texts, "id", "s", "t", encoded[1], 4)
    assert "Exchange" not in plan(made) and "MapInArrow" in plan(made)
    assert rows(made.select("id", "n_source", "input_ids", "labels")) == [(1, 0, [1, 2, 0, 0], [1, 5, 2, 0]), (2, 1, [1, 4, 2, 0], [1, 2, 0, 0])]


def test_encoding_over_batches(spark):
    """Lists that cross Arrow batches and an empty vocabulary."""
    df = spark.range(500).selectExpr("id", "repeat(concat('w', id % 7, ' '), CAST(id % 5 AS int)) AS s")
    vocab = encoding.vocabulary(df, ["s"], 4)
    ids = {r.token: r.token_id for r in vocab.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        made = encoding.encode_samples(df, "id", "s", "s", vocab, 6).collect()
        none = encoding.encode_samples(df, "id", "s", "s", vocab.where("false"), 6).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = lambda i, known: ([1] + [known.get(f"w{i % 7}", 3)] * (i % 5) + [2, 0, 0, 0, 0, 0])[:6]
    assert all(r.input_ids == expected(r.id, ids) for r in made) and len(made) == 500
    assert all(r.input_ids == expected(r.id, {}) for r in none)


def test_decoding_unmasks_and_skips_specials(spark, encoded):
    df = spark.createDataFrame([(1, [1, 4, -100, 5, 2, 0, 3]), (2, [-100, -100]), (3, [])], "id bigint, labels array<int>")
    assert rows(encoding.decode_labels(df, "id", "labels", encoded[1])) == [(1, "the cat"), (2, ""), (3, "")]


def test_user_tokenizer(encoded):
    made = encode_with(encoded[0], "id", "s", "t", lambda: lambda s: [len(w) for w in s.split()], 3)
    got = {r.id: (r.input_ids, r.attention_mask, r.labels) for r in made.collect()}
    assert got[1] == ([3, 4, 3], [1, 1, 1], [3, 0, 0]) and got[2] == ([0, 0, 0], [0, 0, 0], [3, 3, 3])


# --- generation -----------------------------------------------------------------


def test_generated_conditions_run_as_sql(spark):
    """The text of a generated query, run by Spark SQL, gives the rows the conditions give."""
    columns, cells = ["n", "who`s", "x"], [["1", "it's", "2.5"], ["2", "b\\c", "-1"], ["3", "", "0"], ["2", "it's", "7"]]
    tables = spark.createDataFrame([(i, (columns, cells)) for i in range(6)], f"id bigint, t {TABLE_DDL}")
    flat = spark.createDataFrame([(int(a), b, float(c)) for a, b, c in cells], ["n", "who`s", "x"])
    made = generation.generate_where(tables, "id", "t", 3, 11)
    answered = generation.run_generated(made.withColumnRenamed("t", "table"), "id").collect()
    assert len(answered) == 18 and len({r.text for r in answered}) > 6
    for r in answered:
        expected = sorted((a, b, c) for a, b, c in flat.where(r.text).collect())
        assert sorted((int(a), b, float(c)) for a, b, c in r.answer_rows) == expected, r.text


def test_two_tables_share_a_column(spark):
    schema = f"id bigint, a {TABLE_DDL}, b {TABLE_DDL}"
    df = spark.createDataFrame([(i, (["k", "x"], [["1", "p"]]), (["k", "y"], [["2", "q"]])) for i in range(30)], schema)
    conditions = [c for r in generation.generate_where_two(df, "id", "a", "b", 2, 1).collect() for c in r.conditions]
    assert {(c.col, c.val) for c in conditions} == {("k", "1"), ("x", "p"), ("y", "q")}


def test_tables_without_rows_give_no_query(spark):
    df = spark.createDataFrame([(1, (["a"], [])), (2, ([], []))], f"id bigint, t {TABLE_DDL}")
    assert generation.generate_where(df, "id", "t", 2, 1).count() == 0


def test_condition_shapes(spark, data):
    made = generation.generate_where(corpora.order_tables(spark, data), "sample_id", "table", 4, 3, with_aggs=True)
    for r in made.select("conditions", F.size("table.rows").alias("n")).collect():
        assert 1 <= len(r.conditions) <= 4 and len({c.col for c in r.conditions}) == len(r.conditions)
        assert [c.connector != "" for c in r.conditions] == [True] * (len(r.conditions) - 1) + [False]
        for c in r.conditions:
            assert c.op in (("<", ">", "=", "!=", "<=", ">=") if c.is_num else ("=", "!="))
            assert c.agg == "" or c.is_num
            assert c.agg != "COUNT" or 1 <= int(c.val) <= r.n


def test_having_queries_run_as_sql(spark):
    """Generated GROUP BY … HAVING text, run by Spark SQL, keeps the counted groups; one table is hot."""
    flat = spark.range(3000).selectExpr(
        "if(id % 3 > 0, 'hot', concat('t', id % 5)) AS k", "id",
        "array(CAST(id % 7 AS string), concat('w', id % 4), CAST(id % 11 AS string)) AS cells",
    )
    firsts = flat.groupBy("k").agg(F.min_by("cells", "id").alias("first_row"))
    queries = generation.generate_group_by(firsts, "k", text_array(["a", "w", "b"]), "first_row", lit("rows_of_one"), 3, 4)
    made = generation.having_from_groups(flat, queries, "k", "id", 9).collect()
    assert len(made) == firsts.count() * 3 and all(r.valid for r in made)
    for r in made:
        one = flat.where(F.col("k") == r.k).selectExpr("CAST(cells[0] AS int) AS a", "cells[1] AS w", "CAST(cells[2] AS int) AS b")
        one.createOrReplaceTempView("rows_of_one")
        # Means are compared at four places, as in the text.
        text = re.sub(r"AVG\((`\w+`)\)(?= [<>=!])", r"round(AVG(\1), 4)", r.text)
        assert spark.sql(text).count() == r.n_kept, r.text


def test_having_behind_where_runs_as_sql(spark):
    """Rows are filtered before they are grouped; one query's WHERE leaves no row, one query has none."""
    flat = spark.range(900).selectExpr(
        "concat('t', id % 3) AS k", "id", "array(CAST(id % 7 AS string), concat('w', id % 4), CAST(id % 11 AS string)) AS cells"
    )
    firsts = flat.groupBy("k").agg(F.min_by("cells", "id").alias("first_row"))
    names = text_array(["a", "w", "b"])
    queries = generation.generate_group_by(firsts, "k", names, "first_row", lit("rows_of_one"), 4, 4)
    tables = flat.groupBy("k").agg(F.struct(F.expr(names).alias("columns"), F.collect_list("cells").alias("rows")).alias("table"))
    wheres = generation.generate_where(tables, "k", "table", 4, 5).where("NOT (k = 't0' AND query_no = 0)")
    empty = F.expr("if(k = 't1' AND query_no = 1, transform(conditions, c -> struct(c.col, c.owner, c.pos, c.agg, '=' AS op, 'none' AS val, false AS is_num, c.connector)), conditions)")
    wheres = wheres.withColumn("conditions", empty)
    made = {(r.k, r.query_no): r for r in generation.having_from_groups(flat, queries, "k", "id", 9, wheres=wheres).collect()}
    assert len(made) == 12
    r = made.pop(("t1", 1))
    assert (r.text, r.valid, r.n_groups, r.n_kept) == ("", False, 0, 0)
    assert " WHERE " not in made["t0", 0].text
    for r in (r for r in made.values() if r.valid):
        assert (" WHERE " in r.text) == ((r.k, r.query_no) != ("t0", 0))
        one = flat.where(F.col("k") == r.k).selectExpr("CAST(cells[0] AS int) AS a", "cells[1] AS w", "CAST(cells[2] AS int) AS b")
        one.createOrReplaceTempView("rows_of_one")
        text = re.sub(r"AVG\((`\w+`)\)(?= [<>=!])", r"round(AVG(\1), 4)", r.text)
        assert spark.sql(text).count() == r.n_kept, r.text
    assert sum(r.valid for r in made.values()) >= 8


def test_single_column_group_by(spark):
    flat = spark.range(20).selectExpr("'t' AS k", "id", "array(CAST(id % 3 AS string)) AS cells")
    words = spark.range(20).selectExpr("'w' AS k", "id", "array(concat('x', id)) AS cells")
    rows_ = flat.unionByName(words)
    firsts = rows_.groupBy("k").agg(F.min_by("cells", "id").alias("first_row"))
    queries = generation.generate_group_by(firsts, "k", text_array(["a"]), "first_row", lit("t"), 1, 4)
    got = {r.k: r for r in generation.having_from_groups(rows_, queries, "k", "id", 9).collect()}
    assert got["t"].valid and " HAVING `a` " in got["t"].text
    assert not got["w"].valid and got["w"].text == ""


# --- evaluation -----------------------------------------------------------------


def test_exact_match_counts_missing_sides(spark):
    refs = spark.createDataFrame([(1, "Ab"), (2, "b"), (3, "c")], "sample_id bigint, reference string")
    preds = spark.createDataFrame([(1, "aB"), (2, "x"), (4, "d")], "sample_id bigint, prediction string")
    assert rows(evaluation.exact_match(evaluation.pair_predictions(refs, preds))) == [(4, 1, 0.25)]


def test_table_match_orders(spark):
    schema = f"truth {TABLE_DDL}, pred {TABLE_DDL}"
    a, b = (["c"], [["1"], ["2"]]), (["c"], [["2"], ["1"]])
    df = spark.createDataFrame([(a, a), (a, b), (a, (["d"], a[1])), (a, None), (a, (["c"], [["1"], ["1"]]))], schema)
    assert rows(evaluation.table_match_report(df)) == [(5, 1, 2)]


# --- streaming ------------------------------------------------------------------


def test_stream_formats_only_new_files(spark, data, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    samples = corpora.multi_samples(spark, data)
    first, second = samples.where("sample_id < 30"), samples.where("sample_id >= 30")

    def run():
        stream = read_samples_stream(spark, landing, samples.schema, max_files_per_trigger=1)
        format_stream(stream, out, state, "markdown", "split").awaitTermination()
        return spark.read.parquet(out)

    first.write.mode("append").parquet(landing)
    assert run().count() == 30
    assert run().count() == 30
    second.write.mode("append").parquet(landing)
    batch = model_pairs(format_multi_table(samples, "markdown", keep=("sample_id", "split")))
    columns = ["sample_id", "split", "source", "target"]
    assert rows(run().select(*columns)) == rows(batch.select(*columns))


def test_stream_outputs_add_up(spark, data, tmp_path):
    landing, out, bad = (str(tmp_path / n) for n in ("landing", "out", "bad"))
    samples = corpora.multi_samples(spark, data).withColumn("table_names", F.expr("if(sample_id % 7 = 0, NULL, table_names)"))
    samples.write.parquet(landing)
    stream = read_samples_stream(spark, landing, samples.schema)
    for _ in range(2):
        format_stream(stream, out, f"{out}-state").awaitTermination()
        format_stream_rejects(stream, bad, f"{bad}-state").awaitTermination()
    good, rejects = spark.read.parquet(out), spark.read.parquet(bad)
    assert rejects.count() and good.count() + rejects.count() == samples.count()
    assert {(r.sample_id % 7, r.reason) for r in rejects.collect()} == {(0, "missing")}


def test_one_stream_with_both_outcomes(spark, data, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    samples = corpora.multi_samples(spark, data).withColumn("table_names", F.expr("if(sample_id % 7 = 0, NULL, table_names)"))
    for part in (samples.where("sample_id < 20"), samples.where("sample_id >= 20")):
        part.coalesce(1).write.mode("append").parquet(landing)
        stream = read_samples_stream(spark, landing, samples.schema, max_files_per_trigger=1)
        for _ in range(2):  # the second start finds nothing new
            format_stream_outcomes(stream, out, state, "markdown", "split").awaitTermination()
    good, rejects = (read_outcomes(spark, out, outcome) for outcome in ("good", "rejected"))
    columns = ["sample_id", "split", "source", "target"]
    batch = model_pairs(format_multi_table(samples, "markdown", keep=("sample_id", "split")))
    assert rows(good.select(*columns)) == rows(batch.select(*columns))
    assert {(r.sample_id % 7, r.reason, r.source) for r in rejects.collect()} == {(0, "missing", None)}
    assert good.count() + rejects.count() == samples.count()


def test_generated_constants_keep_ten_places(spark):
    cells = [("a", 1, ["x", "0.123456789"]), ("a", 2, ["x", "0.000000001"]), ("a", 3, ["y", "1234567890123456789012345.5"])]
    flat = spark.createDataFrame(cells, "t string, id int, cells array<string>")
    queries = spark.createDataFrame([("a",)], "t string").selectExpr(
        "t", "0 AS query_no", "0 AS group_pos", "'SELECT s FROM t GROUP BY g' AS text",
        "array(named_struct('col', 'g', 'pos', 0, 'agg', ''), named_struct('col', 'n', 'pos', 1, 'agg', 'SUM')) AS items",
    )
    made = generation.having_from_groups(flat, queries, "t", "id", 1).first()
    assert made.n_groups == 2 and made.text.split()[-1] in ("0.12345679", "1234567890123456789012345.5")


def test_lower_case_option(spark):
    df = spark.createDataFrame([(1, "WHO", ["T"], [(["A"], [["X"]])], (["A"], [["Y"]]))], SAMPLE)
    assert linear_samples(df, lower_case=True).select("source", "target").first() == (
        "who <table_name> : t col : a row 1 : x", "col : a row 1 : y",
    )


# --- plans ----------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    from workload.chains import filter_select, topk_customers

    text = plan(filter_select(spark, data))
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_returnflag), GreaterThanOrEqual(l_quantity,30.0), EqualTo(l_returnflag,R)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in text
    text = plan(topk_customers(spark, data))
    assert "TakeOrderedAndProject" in text and "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text


def test_formatting_needs_no_shuffle(spark, data, tmp_path):
    path = str(tmp_path / "samples")
    corpora.multi_samples(spark, data).write.parquet(path)
    text = plan(model_pairs(format_multi_table(spark.read.parquet(path), "html")))
    assert "Exchange" not in text


def test_parsing_is_evaluated_once(spark, data, tmp_path):
    from tabchain.plans.formatting import format_single_table

    path = str(tmp_path / "texts")
    corpora.single_texts(spark, data).write.parquet(path)
    text = plan(format_single_table(spark.read.parquet(path)))
    assert "Exchange" not in text
    assert text.count("no header") == 1
