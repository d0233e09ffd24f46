"""Expressions on single values: every edge rule by hand."""

from __future__ import annotations

import math
import re

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tabchain.functions import cells, formats, linear, parsing, text
from tabchain.functions.sqltext import lit
from tabchain.operators.generation import condition_text

T = f"t {cells.TABLE_DDL}"
S = "s string"


def as_table(row):
    return list(row["columns"]), [list(r) for r in row["rows"]]


# --- cells ------------------------------------------------------------------


@pytest.mark.parametrize(
    "names, expected",
    [
        (["a", "b", "a"], ["a -1", "b", "a -2"]),
        (["a", "b"], ["a", "b"]),
        (["x", "x", "x"], ["x -1", "x -2", "x -3"]),
    ],
)
def test_repeated_names(value, names, expected):
    assert value(cells.dedup_names("c"), "c array<string>", (names,)) == expected


def test_null_cells_in_both_modes(value):
    table = (["n", "s"], [["1.5", None], [None, "q"]])
    assert as_table(value(cells.clean_table("t"), T, (table,)))[1] == [["1.5", ""], ["", "q"]]
    assert as_table(value(cells.clean_table("t", "literal"), T, (table,)))[1] == [["1.5", "None"], ["nan", "q"]]


def test_unknown_null_mode():
    with pytest.raises(ValueError, match="null_mode"):
        cells.clean_table("t", "drop")


def test_table_without_rows_is_not_renamed(value):
    assert as_table(value(cells.clean_table("t"), T, ((["a", "a"], []),))) == (["a", "a"], [])


@pytest.mark.parametrize(
    "number",
    [0.0, 1.5, -2.25, 1e7, 12345678.9, -1.25e15, 1e16, 1.5e300, 0.001, 0.00012, -0.0001, 1e-5, -1.25e-7, 123456789.125, 2.0**53],
)
def test_number_text_is_plain(value, number):
    assert value(cells.number_text("x"), "x double", (number,)) == str(number)


@pytest.mark.parametrize("number, expected", [(math.inf, "inf"), (-math.inf, "-inf"), (math.nan, "nan")])
def test_number_text_of_special_values(value, number, expected):
    assert value(cells.number_text("x"), "x double", (number,)) == expected


def test_typed_cells(spark):
    df = spark.sql("SELECT 1 AS i, 2.5D AS d, true AS b, TIMESTAMP_NTZ'2024-01-02 03:04:05.5' AS n, TIMESTAMP'2024-01-02 03:04:05' AS z, CAST(NULL AS string) AS s")
    got = df.selectExpr(f"{cells.text_cells(df.schema, df.columns)} AS v").first().v
    assert got == ["1", "2.5", "True", "2024-01-02 03:04:05", "2024-01-02 03:04:05", None]


def test_split_json(value):
    json = '{"columns":["city",7,"city"],"index":[0,1],"data":[["a & b",10,null],["01",100000000.0,"1.0E8x"]]}'
    columns, rows = as_table(value(cells.table_from_split_json("s"), S, (json,)))
    assert columns == ["city", "7", "city"]
    assert rows == [["a & b", "10", None], ["01", "100000000.0", "1.0E8x"]]


@pytest.mark.parametrize(
    "literal",
    ["1.10", "0.1000", "1e5", "12345678.123456789012", "-0", "-0.50", "1E-7", "100000000.0", "9" * 60, "true", "0", "12", "1e400", "-1.0E+05"],
)
def test_json_literals_stay_as_they_stand(value, literal):
    json = f'{{"columns": ["a", 1.50], "index": [0], "data": [[{literal}, "x, {literal}, y"], [ {literal} , {literal}]]}}'
    columns, rows = as_table(value(cells.table_from_split_json("s"), S, (json,)))
    assert columns == ["a", "1.50"] and rows == [[literal, f"x, {literal}, y"], [literal, literal]]


def test_json_texts_and_objects_are_no_numbers(value):
    json = r'{"columns":["a"],"data":[["[1, 2]","\"3\",4,"," 5 ","1.0E8"],[{"x":1,"y":[2,{"z":-3}]},"{",6.0,"\\",7e1],[null,false,"",{},8]]}'
    _, rows = as_table(value(cells.table_from_split_json("s"), S, (json,)))
    assert rows == [["[1, 2]", '"3",4,', " 5 ", "1.0E8"], ['{"x":1,"y":[2,{"z":-3}]}', "{", "6.0", "\\", "7e1"], [None, "false", "", "{}", "8"]]


def test_json_with_arrays_as_cells(value):
    _, rows = as_table(value(cells.table_from_split_json("s"), S, ('{"columns":["a","b"],"data":[[[1,2],"[["],[3,100000000.0]]}',)))
    assert rows == [["[1,2]", "[["], ["3", "100000000.0"]]


def test_long_json(value):
    rows = [[str(k), f'"text {k}"'] for k in range(20_000)]
    json = '{"columns":["a","b"],"data":[' + ",".join(f"[{a},{b}]" for a, b in rows) + ']}'
    assert as_table(value(cells.table_from_split_json("s"), S, (json,)))[1] == [[a, b.strip('"')] for a, b in rows]
    texts = '{"columns":["a"],"data":[' + ",".join(['["x"]'] * 20_000) + "]}"
    assert len(as_table(value(cells.table_from_split_json("s"), S, (texts,)))[1]) == 20_000


@pytest.mark.parametrize("json", ['{"columns":["a"],"data":[[01]]}', '{"columns":["a"],"data":[[1.]]}', '{"columns":["a"],"data":[[--1]]}', '{"columns":["a"],"data":[[1 2]]}', "not json", '{"columns":["a"]}', '{"data":[["a"]]}'])
def test_broken_split_json_is_null(value, json):
    assert value(cells.table_from_split_json("s"), S, (json,)) is None


def test_strip_takes_all_whitespace(value):
    assert value(cells.strip("s"), S, ("\u3000\t a b\u00a0\n\x0b",)) == "a b"


def test_latin1(value):
    assert value(cells.latin1_text("b"), "b binary", ("é".encode("latin1"),)) == "é"


# --- linear text ------------------------------------------------------------


def test_linear_table(value):
    table = (["id", "name"], [["1", "ann"], ["2", None]])
    assert value(linear.linear_table("t", lit("crew")), T, (table,)) == (
        "<table_name> : crew col : id | name row 1 : 1 | ann row 2 : 2 |"
    )
    assert value(linear.linear_table("t"), T, (table,)) == "col : id | name row 1 : 1 | ann row 2 : 2 |"
    assert value(linear.linear_table("t", lit("")), T, (table,)) == "col : id | name row 1 : 1 | ann row 2 : 2 |"


def test_linear_source_skips_empty_tables(value):
    tables = [(["a"], []), (["b"], [["1"]])]
    schema = f"q string, ts array<{cells.TABLE_DDL}>, ns array<string>"
    source = linear.linear_source("q", "ts", "ns")
    assert value(source, schema, ("who <> me", tables, ["x", "y"])) == "who != me <table_name> : y col : b row 1 : 1"
    assert value(source, schema, ("", tables, ["x", "y"])) == "<table_name> : y col : b row 1 : 1"
    assert value(source, schema, ("who", tables[:1], ["x"])) == "who"
    assert value(source, schema, ("", [], [])) == ""


def test_empty_answer_is_empty_text(value):
    assert value(linear.linear_target("t"), T, ((["a"], []),)) == ""
    assert value(linear.linear_target("t"), T, ((["a"], [["1"]]),)) == "col : a row 1 : 1"


# --- formats ----------------------------------------------------------------

CELL = st.text(st.sampled_from("ab&<>\"' \t\n\r|é1"), max_size=8)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 4).flatmap(lambda n: st.tuples(st.lists(CELL, min_size=n, max_size=n), st.lists(st.lists(CELL, min_size=n, max_size=n), max_size=4))))
def test_html_equals_pandas(value, table):
    columns, rows = table
    expected = pd.DataFrame(rows, columns=columns, dtype=object).to_html()
    assert value(formats.html_table("t"), T, ((columns, rows),)) == expected


def test_html_cuts_neither_rows_nor_cells(value):
    rows = [["x" * 200] for _ in range(150)]
    assert value(formats.html_table("t"), T, ((["a"], rows),)) == pd.DataFrame(rows, columns=["a"]).to_html()


def test_latex(value):
    assert value(formats.latex_table("t"), T, ((["a", "b"], [["x", "y"], ["z", ""]]),)) == (
        "\\begin{tabular}{lll}\n\\toprule\n & a & b \\\\\n\\midrule\n0 & x & y \\\\\n1 & z &  \\\\\n\\bottomrule\n\\end{tabular}\n"
    )


def test_markdown(value):
    table = (["a", "b"], [["x", "long cell"], ["", None]])
    assert value(formats.markdown_table("t"), T, (table,)) == "|  | a | b |\n|---:|:---|:---|\n| 0 | x | long cell |\n| 1 |  |  |"
    assert value(formats.markdown_table("t", padded=True), T, (table,)) == (
        "|    | a   | b         |\n|---:|:----|:----------|\n|  0 | x   | long cell |\n|  1 |     |           |"
    )
    assert value(formats.markdown_table("t"), T, ((["a"], []),)) == "|  | a |\n|---:|:---|"


def test_rendered_source_keeps_empty_tables(value):
    schema = "q string, ts array<string>, ns array<string>"
    assert value(formats.rendered_source("q", "ts", "ns"), schema, ("a <> b", ["T1", "T2"], ["x", "y"])) == (
        "a != b <table_name> : x T1 <table_name> : y T2"
    )
    assert value(formats.rendered_source("q", "ts", "ns"), schema, ("", ["T"], ["x"])) == "<table_name> : x T"


def test_format_column():
    assert formats.format_column("source", "html") == "source_html"
    for wrong in (("answer", "html"), ("source", "pdf")):
        with pytest.raises(ValueError):
            formats.format_column(*wrong)
    with pytest.raises(ValueError):
        formats.render_table("t", "pdf")


# --- parsing ----------------------------------------------------------------


def test_parse_single_source(value):
    got = value(parsing.parse_single_source("s"), S, ("select city from w where pop > 3 col : city | pop row 1 : a | 10 row 2 : c | 2",))
    assert got.query == "select city from w where pop > 3"
    assert as_table(got.table) == (["city", "pop"], [["a", "10"], ["c", "2"]])
    assert got.reason is None


def test_parse_multi_source(value):
    source = "who flew <table_name> : crew col : id | name row 1 : 1 | ann row 2 : 2 | bob <table_name> : trip col : id | to row 1 : 1 | x"
    got = value(parsing.parse_multi_source("s"), S, (source,))
    assert (got.query, got.table_names, got.reason) == ("who flew", ["crew", "trip"], None)
    assert [as_table(t) for t in got.tables] == [
        (["id", "name"], [["1", "ann"], ["2", "bob"]]),
        (["id", "to"], [["1", "x"]]),
    ]


def test_empty_query_keeps_the_first_table(value):
    got = value(parsing.parse_multi_source("s"), S, ("<table_name> : a col : x row 1 : 1",))
    assert (got.query, got.table_names) == ("", ["a"])


@pytest.mark.parametrize("cell", ["a: b", "a : b", "the row b", "row 7", "", "x <y>"])
def test_cells_that_survive(value, cell):
    got = value(parsing.parse_target("s"), S, (f"col : a | b row 1 : {cell} | 2 row 2 : 3 | {cell}",))
    assert as_table(got) == (["a", "b"], [[cell, "2"], ["3", cell]])


@pytest.mark.parametrize(
    "source, reason",
    [
        ("q <table_name> : t col : a row 1 : x | y", "row width"),
        ("q <table_name> : t row 1 : x", "no header"),
        ("only a query", "no table"),
    ],
)
def test_rejected_sources(value, source, reason):
    assert value(parsing.parse_multi_source("s"), S, (source,)).reason == reason


def test_target_without_rows_or_text(value):
    assert as_table(value(parsing.parse_target("s"), S, ("col : a | b",))) == (["a", "b"], [])
    assert as_table(value(parsing.parse_target("s"), S, ("",))) == ([], [])
    assert value(parsing.parse_target("s"), S, ("nothing here",)) is None


WORD = st.text(st.sampled_from("abc:-_<>&1 "), max_size=6).map(lambda s: re.sub(" +", " ", s).strip())


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 3).flatmap(lambda n: st.tuples(st.lists(WORD, min_size=n, max_size=n), st.lists(st.lists(WORD, min_size=n, max_size=n), min_size=1, max_size=4))))
def test_linear_text_round_trips(value, table):
    columns, rows = table
    source = f"concat('q ', {linear.linear_table('t', lit('name'))})"
    got = value(parsing.parse_multi_source(source), T, ((columns, rows),))
    assert got.reason is None
    assert as_table(got.tables[0]) == (columns, rows)


# --- text -------------------------------------------------------------------


@pytest.mark.parametrize(
    "query, expected",
    [
        ("x ! = 3", "x != 3"),
        ("a  > =\t4 and b < = 5", "a >= 4 and b <= 5"),
        ("x <> 3", "x <> 3"),
        ("x ! =", "x !="),
        ("  ", ""),
        ("= =", "= ="),
    ],
)
def test_query_repair(value, query, expected):
    assert value(text.repair_query("s"), S, (query,)) == expected


@pytest.mark.parametrize("query", ["SELECT a FROM (select b from c)", "no keyword", "selected fromage", "", "Select Select from"])
def test_keyword_spans(value, query):
    spans = lambda p, flags=re.I: [m.span() for m in re.finditer(p, query, flags)]
    got = lambda e: [(x.start, x.end) for x in value(e, S, (query,))]
    assert got(text.select_spans("s")) == spans("select ")
    assert got(text.from_spans("s")) == spans("from")
    assert value(text.keyword_count("s", text.SELECT_PATTERN), S, (query,)) == len(spans("select "))


@pytest.mark.parametrize(
    "chain, action, steps",
    [
        ("<BEGIN> -> a -> <END>", "a", ["a"]),
        ("a -> <END>", "a", ["a"]),
        ("<BEGIN>->a->b", "a", ["a", "b"]),
        ("<BEGIN>", None, []),
    ],
)
def test_chain_text(value, chain, action, steps):
    assert value(text.next_action("s"), S, (chain,)) == action
    assert value(text.chain_actions("s"), S, (chain,)) == steps
    assert value(text.chain_text("array('a', 'b')")) == "a -> b -> <END>"


def test_model_text(value):
    assert value(text.model_text("s"), S, ('\n A "Quoted" Text\t',)) == "a quoted text"


def test_condition_text_escapes(value):
    schema = "c struct<col:string,agg:string,op:string,val:string,is_num:boolean,connector:string>"
    sql = value(condition_text("c"), schema, (("a`b", "", "=", "it's \\", False, ""),))
    assert sql == "`a``b` = 'it\\'s \\\\'"
    assert value(f"(SELECT {sql} FROM VALUES ('it\\'s \\\\') AS t(`a``b`))") is True
