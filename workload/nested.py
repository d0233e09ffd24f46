"""Queries over nested tables: cleaning, rendering, parsing, formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabchain.functions import formats, linear
from tabchain.functions.cells import clean_table, table_from_split_json, table_value, text_array
from tabchain.functions.sqltext import lit
from tabchain.functions.text import baseline_prompt, table_descriptor
from tabchain.operators.assembly import fill_from_text, pretraining_sample
from tabchain.operators.evaluation import quality_report
from tabchain.operators.nesting import long_cells
from tabchain.plans.formatting import (
    format_multi_table,
    format_single_table,
    linear_samples,
    model_pairs,
    parse_multi_samples,
    parse_single_samples,
)
from workload import sql_parts as q
from workload.corpora import MULTI_QUERY, multi_samples, order_tables, single_samples, single_texts, table


def linear_header(spark: SparkSession, d: str) -> DataFrame:
    return order_tables(spark, d).selectExpr("sample_id", f"{linear.linear_header('table.columns')} AS header")


def linear_rows(spark, d):
    return order_tables(spark, d).selectExpr("sample_id", f"{linear.linear_rows('table.rows')} AS rows")


def linear_table(spark, d):
    return order_tables(spark, d).selectExpr("sample_id", f"{linear.linear_table('table', lit('orders'))} AS text")


def linear_source(spark, d):
    return linear_samples(multi_samples(spark, d)).select("sample_id", "source")


def linear_target(spark, d):
    return single_samples(spark, d).selectExpr("sample_id", f"{linear.linear_target('answer')} AS target")


def _render(form: str):
    def run(spark, d):
        return order_tables(spark, d).selectExpr("sample_id", f"{formats.render_table('table', form)} AS text")

    return run


def _render_sql(form: str) -> str:
    return (
        f"WITH s AS ({q.order_block()}) SELECT sample_id, {q.rendered(form, q.ORDER_CELLS, q.ORDER_COLUMNS)} AS text "
        "FROM s GROUP BY sample_id"
    )


def escaped_html(spark, d):
    """Rendering of whole raw page sources as cells."""
    p = table(spark, d, "pages")
    one = table_value(text_array(["url", "<html>"]), "array(array(url, html))")
    return p.selectExpr("page_id", f"{formats.html_table(one)} AS text")


# Characters that the text stripping removes, as a SQL text.
_STRIP = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)||chr(8239)||chr(12288)"


def _html_cell(column: str) -> str:
    text = column
    for a, b in (("'&'", "'&amp;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"), ("chr(9)", "'\\t'"), ("chr(13)", "'\\r'"), ("chr(10)", "'\\n'")):
        text = f"replace({text}, {a}, {b})"
    return f"trim({text}, {_STRIP})"


ESCAPED_SQL = f"""
SELECT page_id, '<table border="1" class="dataframe">\n  <thead>\n    <tr style="text-align: right;">\n      <th></th>\n      <th>url</th>
      <th>&lt;html&gt;</th>\n    </tr>\n  </thead>\n  <tbody>\n    <tr>\n      <th>0</th>\n      <td>' || {_html_cell('url')} || '</td>
      <td>' || {_html_cell('html')} || '</td>\n    </tr>\n  </tbody>\n</table>' AS text
FROM pages"""


def format_single(spark, d):
    return format_single_table(single_texts(spark, d))


# Samples without a finished order have no answer header and cannot be parsed.
_EMPTY = {
    "html": '<table border="1" class="dataframe">\n  <thead>\n    <tr style="text-align: right;">\n      <th></th>\n    </tr>\n  </thead>\n  <tbody>\n  </tbody>\n</table>',
    "latex": "\\begin{tabular}{l}\n\\toprule\n &  \\\\\n\\midrule\n\\bottomrule\n\\end{tabular}\n",
    "markdown": "|  |  |\n|---:|",
}


def _format_single_sql() -> str:
    parts, joins, columns = [], [], []
    for form in ("latex", "html", "markdown"):
        parts.append(f"s_{form} AS (SELECT sample_id, {q.rendered(form, q.ORDER_CELLS, q.ORDER_COLUMNS)} AS t FROM s GROUP BY sample_id)")
        parts.append(f"t_{form} AS (SELECT sample_id, {q.rendered(form, q.ANSWER_CELLS, q.ANSWER_COLUMNS)} AS t FROM f GROUP BY sample_id)")
        joins.append(f"JOIN s_{form} USING (sample_id) LEFT JOIN t_{form} USING (sample_id)")
        columns.append(f"{q.SINGLE_QUERY_OUT} || ' <table_name> : table ' || s_{form}.t AS source_{form}")
        columns.append(f"coalesce(t_{form}.t, '{_EMPTY[form]}') AS target_{form}")
    return (
        f"WITH s AS ({q.order_block()}), f AS ({q.finished()}), ids AS (SELECT DISTINCT sample_id FROM s), {', '.join(parts)} "
        f"SELECT sample_id, {', '.join(columns)} FROM ids {' '.join(joins)}"
    )


def _format_multi(form: str):
    def run(spark, d):
        return format_multi_table(multi_samples(spark, d), form, keep=("sample_id", "split"))

    return run


def _empty_answer(form: str) -> str:
    heads = q.ANSWER_COLUMNS
    return {
        "html": _EMPTY["html"].replace("<th></th>\n", "<th></th>\n" + "".join(f"      <th>{c}</th>\n" for c in heads)),
        "latex": "\\begin{tabular}{lll}\n\\toprule\n & o_orderkey & o_orderdate \\\\\n\\midrule\n\\bottomrule\n\\end{tabular}\n",
        "markdown": "|  | o_orderkey | o_orderdate |\n|---:|:---|:---|",
    }[form]


def format_multi_sql(form: str, wrap: str = "{}") -> str:
    source = wrap.format(f"{q.MULTI_QUERY_OUT} || ' <table_name> : orders ' || o.t || ' <table_name> : customer ' || k.t")
    target = wrap.format(f"coalesce(a.t, '{_empty_answer(form)}')")
    return f"""
WITH {q.MULTI_CTE},
o AS (SELECT sample_id, {q.rendered(form, q.ORDER_CELLS, q.ORDER_COLUMNS)} AS t FROM s GROUP BY sample_id),
k AS (SELECT sample_id, {q.rendered(form, q.CUSTOMER_CELLS, q.CUSTOMER_COLUMNS)} AS t FROM c GROUP BY sample_id),
a AS (SELECT sample_id, {q.rendered(form, q.ANSWER_CELLS, q.ANSWER_COLUMNS)} AS t FROM f GROUP BY sample_id)
SELECT sample_id, {q.SPLIT} AS split, {source} AS source, {target} AS target
FROM o JOIN k USING (sample_id) LEFT JOIN a USING (sample_id)"""


def parse_single(spark, d):
    """Rendered single-table samples parsed back to cells."""
    parsed = parse_single_samples(single_texts(spark, d))
    both = parsed.where("reason is null").selectExpr(
        "sample_id", "array(table, answer) AS tables", "array('source', 'target') AS names"
    )
    return long_cells(both, "sample_id", "tables", "names")




def _cells_sql(block: str, no: int, name: str, columns: list[str], cells: list[str]) -> str:
    return (
        f"SELECT sample_id, {no} AS table_no, '{name}' AS table_name, CAST(rn AS INTEGER) AS row_no, "
        f"unnest(range(1, {len(cells) + 1}))::INTEGER AS col_no, unnest({columns}) AS col_name, unnest([{', '.join(cells)}]) AS value FROM {block}"
    )


PARSE_SINGLE_SQL = (
    f"WITH s AS ({q.order_block()}), f AS ({q.finished()}) "
    + _cells_sql("s", 1, "source", q.ORDER_COLUMNS, q.ORDER_CELLS)
    + " UNION ALL "
    + _cells_sql("f", 2, "target", q.ANSWER_COLUMNS, q.ANSWER_CELLS)
)


def parse_multi(spark, d):
    """Rendered multi-table samples parsed back to cells."""
    texts = linear_samples(multi_samples(spark, d)).select("sample_id", "source")
    good = parse_multi_samples(texts).where((F.col("reason").isNull()) & (F.col("query") == MULTI_QUERY))
    return long_cells(good, "sample_id", "tables", "table_names")


PARSE_MULTI_SQL = (
    f"WITH {q.MULTI_CTE}, ids AS (SELECT DISTINCT sample_id FROM s SEMI JOIN c USING (sample_id)) "
    + _cells_sql("s SEMI JOIN ids USING (sample_id)", 1, "orders", q.ORDER_COLUMNS, q.ORDER_CELLS)
    + " UNION ALL "
    + _cells_sql("c SEMI JOIN ids USING (sample_id)", 2, "customer", q.CUSTOMER_COLUMNS, q.CUSTOMER_CELLS)
)


def parse_rejects(spark, d):
    """Samples whose cells hold the separator do not parse and are counted by reason."""
    p = table(spark, d, "part").select(
        (F.col("p_partkey")).alias("sample_id"),
        F.concat(
            F.when(F.col("p_partkey") % 5 == 0, F.lit("no header here")).otherwise(F.lit("q <table_name> : part col : p_name | p_brand row 1 : ")),
            "p_name",
            F.when(F.col("p_partkey") % 3 == 0, F.lit(" | x | ")).otherwise(F.lit(" | ")),
            "p_brand",
        ).alias("source"),
    )
    return parse_multi_samples(p).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("samples"))


REJECTS_SQL = """
SELECT CASE WHEN p_partkey % 5 = 0 THEN 'no table' WHEN p_partkey % 3 = 0 THEN 'row width' ELSE 'none' END AS reason,
       count(*) AS samples FROM part GROUP BY 1"""


def fill_missing(spark, d):
    """Structured fields from the linear text in samples that lost them."""
    full = linear_samples(multi_samples(spark, d))
    lost = F.col("sample_id") % 3 == 0
    holes = full.withColumns({c: F.when(~lost, F.col(c)) for c in ("query", "tables", "table_names", "answer")})
    filled = fill_from_text(holes)
    return filled.selectExpr(
        "sample_id",
        "query",
        "array_join(table_names, ',') AS names",
        f"{linear.linear_source('query', 'tables', 'table_names')} AS source",
        f"{linear.linear_target('answer')} AS target",
    )


LINEAR_SOURCE_SQL = f"WITH {q.MULTI_CTE} SELECT sample_id, {q.MULTI_QUERY_OUT} || ' ' || src1.tbl || ' ' || src2.tbl AS source FROM src1 JOIN src2 USING (sample_id)"
FILL_SQL = (
    f"WITH {q.MULTI_CTE} SELECT sample_id, {q.MULTI_QUERY_OUT} AS query, 'orders,customer' AS names, "
    f"{q.MULTI_QUERY_OUT} || ' ' || src1.tbl || ' ' || src2.tbl AS source, coalesce(tgt.tbl, '') AS target "
    "FROM src1 JOIN src2 USING (sample_id) LEFT JOIN tgt USING (sample_id)"
)


def split_json(spark, d):
    """Split-oriented JSON text of each part, read back as cells."""
    p = table(spark, d, "part")
    quote = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    json = F.concat(
        F.lit('{"columns":["p_name",7,"p_size","flag","none"],"index":[0,1],"data":[['),
        quote("p_name"), F.lit(","), quote("p_brand"), F.lit(","), F.col("p_size").cast("string"), F.lit(",true,null],["),
        quote("p_type"), F.lit(",{\"x\":1},12500000.0,false,"), F.col("p_partkey").cast("string"), F.lit("]]}"),
    )
    tables = p.withColumn("json", json).selectExpr("p_partkey", f"array({table_from_split_json('json')}) AS t", "array('part') AS n")
    cells = long_cells(tables, "p_partkey", "t", "n")
    return cells.select("p_partkey", "row_no", "col_no", "col_name", F.coalesce("value", F.lit("<null>")).alias("value"))


SPLIT_JSON_SQL = """
SELECT p_partkey, 1 AS row_no, unnest(range(1, 6))::INTEGER AS col_no, unnest(['p_name', '7', 'p_size', 'flag', 'none']) AS col_name,
       unnest([p_name, p_brand, p_size::VARCHAR, 'true', '<null>']) AS value FROM part
UNION ALL
SELECT p_partkey, 2, unnest(range(1, 6))::INTEGER, unnest(['p_name', '7', 'p_size', 'flag', 'none']),
       unnest([p_type, '{"x":1}', '12500000.0', 'false', p_partkey::VARCHAR]) FROM part"""


def json_literals(spark, d):
    """Numbers as JSON may write them, in cells beside texts that look like them."""
    price = F.col("l_extendedprice").cast("decimal(15,2)").cast("string")
    json = F.concat(
        F.lit('{"columns":["a","b"],"data":[['), price, F.lit("0,1e"), F.col("l_linenumber").cast("string"), F.lit('],["'), price,
        F.lit(',5.0","'), price, F.lit('"],[12345678.12345678901'), F.col("l_orderkey").cast("string"), F.lit(",-0.10]]}"),
    )
    tables = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", json.alias("json"))
    rows = tables.selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{table_from_split_json('json')} AS t")
    return rows.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "array_join(transform(t.rows, r -> array_join(r, '|')), ';') AS cells")


_PRICE = "l_extendedprice::DECIMAL(15,2)::VARCHAR"
JSON_LITERALS_SQL = f"""
SELECT l_orderkey, l_linenumber, l_partkey, {_PRICE} || '0|1e' || l_linenumber || ';' || {_PRICE} || ',5.0|' || {_PRICE} ||
  ';12345678.12345678901' || l_orderkey || '|-0.10' AS cells FROM lineitem"""


def _dirty(spark, d) -> DataFrame:
    """Order blocks with repeated names and NULL cells."""
    holes = "transform(table.rows, r -> transform(r, (x, i) -> if(i != 2 OR x != 'O', x, NULL)))"
    dirty = table_value(text_array(["key", "who", "key", "date"]), holes)
    return order_tables(spark, d).selectExpr("sample_id", f"{dirty} AS table")


def clean_cells(spark, d):
    """Cleaned blocks in both null modes."""
    t = _dirty(spark, d)
    return t.selectExpr(
        "sample_id",
        f"{linear.linear_table(clean_table('table'))} AS empty_mode",
        f"{linear.linear_table(clean_table('table', 'literal'))} AS literal_mode",
    )


def _clean_sql() -> str:
    text = lambda null: (
        "'col : key -1 | who | key -2 | date ' || string_agg('row ' || rn || ' : ' || c1 || ' | ' || c2 || ' | ' || "
        f"CASE WHEN c3 = 'O' THEN {null} ELSE c3 END || ' | ' || c4, ' ' ORDER BY rn)"
    )
    return f"WITH s AS ({q.order_block()}) SELECT sample_id, {text(repr(''))} AS empty_mode, {text(repr('None'))} AS literal_mode FROM s GROUP BY sample_id"


def dedup_columns(spark, d):
    return _dirty(spark, d).selectExpr("sample_id", f"array_join({clean_table('table')}.columns, ',') AS columns")


def descriptor(spark, d):
    return multi_samples(spark, d).selectExpr("sample_id", f"{table_descriptor('tables')} AS text")


def prompt(spark, d):
    s = single_samples(spark, d)
    return s.selectExpr("sample_id", f"{baseline_prompt(linear.linear_table('table'), lit('Who ordered last?'))} AS prompt")


def pretraining(spark, d):
    s = multi_samples(spark, d).withColumn("query", F.concat(F.lit("who  is ! = "), F.col("sample_id").cast("string"), F.lit(" <  = ")))
    p = pretraining_sample(s)
    return p.selectExpr(
        "sample_id",
        "question",
        "size(tables) AS n_tables",
        f"{linear.linear_source('question', 'tables', 'table_names')} AS source",
    )


PRETRAINING_SQL = f"""
WITH {q.SINGLE_CTE.replace(f'// {q.SINGLE_ROWS}', f'// {q.MULTI_ORDERS}')}, c AS ({q.CUSTOMER_BLOCK})
SELECT sample_id, 'who is != ' || sample_id || ' <=' AS question, 1 AS n_tables,
       'who is != ' || sample_id || ' <= ' || tbl AS source
FROM src WHERE sample_id IN (SELECT sample_id FROM c)"""


def quality(spark, d):
    """Quality counts of samples with holes made by rule."""
    s = multi_samples(spark, d)
    holes = s.withColumns(
        {
            "query": F.when(F.col("sample_id") % 7 == 0, "").otherwise(F.col("query")),
            "answer": F.when(F.col("sample_id") % 11 != 0, F.col("answer")),
            "table_names": F.when(F.col("sample_id") % 13 == 0, F.slice("table_names", 1, 1)).otherwise(F.col("table_names")),
            "tables": F.expr(f"transform(tables, (t, i) -> if(i = 1 AND sample_id % 5 = 0, {table_value('t.columns', 'array()')}, t))"),
        }
    )
    return quality_report(holes, ["split"])


QUALITY_SQL = f"""
WITH {q.MULTI_CTE}, ids AS (SELECT DISTINCT sample_id FROM s SEMI JOIN c USING (sample_id))
SELECT {q.SPLIT} AS split, count(*) AS samples, count(*) FILTER (sample_id % 7 = 0) AS empty_query,
       count(*) FILTER (sample_id % 5 = 0) AS empty_table, count(*) FILTER (sample_id % 11 = 0) AS null_answer,
       count(*) FILTER (sample_id % 11 <> 0 AND sample_id NOT IN (SELECT sample_id FROM f)) AS empty_answer,
       count(*) FILTER (sample_id % 13 = 0) AS length_mismatch
FROM ids GROUP BY 1"""


def model_form(spark, d):
    """The formatted multi-table corpus in model form."""
    return model_pairs(format_multi_table(multi_samples(spark, d), "html", keep=("sample_id", "split")))


MODEL_WRAP = "replace(lower({}), '\"', '')"
BLOCK = f"WITH s AS ({q.order_block()})"

QUERIES = {
    "linear_header": (linear_header, f"SELECT DISTINCT o_orderkey // {q.SINGLE_ROWS} AS sample_id, '{q.ORDER_HEAD}' AS header FROM orders"),
    "linear_rows": (linear_rows, f"{BLOCK} SELECT sample_id, {q.ORDER_ROWS} AS rows FROM s GROUP BY sample_id"),
    "linear_table": (linear_table, f"{BLOCK} SELECT sample_id, '<table_name> : orders {q.ORDER_HEAD} ' || {q.ORDER_ROWS} AS text FROM s GROUP BY sample_id"),
    "linear_source": (linear_source, LINEAR_SOURCE_SQL),
    "linear_target": (
        linear_target,
        f"WITH {q.SINGLE_CTE} SELECT src.sample_id, coalesce(tgt.tbl, '') AS target FROM src LEFT JOIN tgt ON src.sample_id = tgt.sample_id",
    ),
    "render_html": (_render("html"), _render_sql("html")),
    "render_latex": (_render("latex"), _render_sql("latex")),
    "render_markdown": (_render("markdown"), _render_sql("markdown")),
    "render_html_escaped": (escaped_html, ESCAPED_SQL),
    "format_single": (format_single, _format_single_sql()),
    "format_multi": (_format_multi("html"), format_multi_sql("html")),
    "format_multi_latex": (_format_multi("latex"), format_multi_sql("latex")),
    "format_multi_markdown": (_format_multi("markdown"), format_multi_sql("markdown")),
    "model_form": (model_form, format_multi_sql("html", MODEL_WRAP)),
    "parse_single": (parse_single, PARSE_SINGLE_SQL),
    "parse_multi": (parse_multi, PARSE_MULTI_SQL),
    "parse_rejects": (parse_rejects, REJECTS_SQL),
    "fill_from_text": (fill_missing, FILL_SQL),
    "split_json_cells": (split_json, SPLIT_JSON_SQL),
    "json_literals": (json_literals, JSON_LITERALS_SQL),
    "clean_cells": (clean_cells, _clean_sql()),
    "dedup_columns": (dedup_columns, f"SELECT DISTINCT o_orderkey // {q.SINGLE_ROWS} AS sample_id, 'key -1,who,key -2,date' AS columns FROM orders"),
    "table_descriptor": (
        descriptor,
        f"WITH {q.MULTI_CTE} SELECT DISTINCT sample_id, 'df1: table with columns - {','.join(q.ORDER_COLUMNS)}\n"
        f"df2: table with columns - {','.join(q.CUSTOMER_COLUMNS)}\n' AS text FROM s SEMI JOIN c USING (sample_id)",
    ),
    "baseline_prompt": (
        prompt,
        f"WITH {q.SINGLE_CTE} SELECT sample_id, 'Here''s a serialized table.\n\n' || tbl || "
        "'\n\nGiven this table please answer the question: Who ordered last?\nAnswer: ' AS prompt FROM src",
    ),
    "pretraining_sample": (pretraining, PRETRAINING_SQL),
    "quality_report": (quality, QUALITY_SQL),
}
