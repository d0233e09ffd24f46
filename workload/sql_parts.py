"""SQL text shared by the oracle queries."""

from __future__ import annotations

from workload.corpora import MULTI_CUSTOMERS, MULTI_ORDERS, MULTI_QUERY, SINGLE_QUERY, SINGLE_ROWS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def draw(*parts: object) -> str:
    """Hash draw over SQL expressions and plain numbers or quoted texts."""
    return f"('0x' || substr(md5(concat_ws('/', {', '.join(str(p) for p in parts)})), 1, 12))::BIGINT"


def item(items: tuple[str, ...], index: str) -> str:
    return f"list_extract([{', '.join(quoted(i) for i in items)}], CAST(({index}) % {len(items)} AS INTEGER) + 1)"


#: Cells of the order blocks: one row per order, cells c1..c4 as text.
def order_block(rows_per_table: int = SINGLE_ROWS) -> str:
    return f"""
    SELECT o_orderkey // {rows_per_table} AS sample_id,
           row_number() OVER (PARTITION BY o_orderkey // {rows_per_table} ORDER BY o_orderkey) AS rn,
           CAST(o_orderkey AS VARCHAR) AS c1, CAST(o_custkey AS VARCHAR) AS c2,
           o_orderstatus AS c3, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS c4
    FROM orders"""


CUSTOMER_BLOCK = f"""
    SELECT c_custkey // {MULTI_CUSTOMERS} AS sample_id,
           row_number() OVER (PARTITION BY c_custkey // {MULTI_CUSTOMERS} ORDER BY c_custkey) AS rn,
           CAST(c_custkey AS VARCHAR) AS c1, c_name AS c2, c_mktsegment AS c3
    FROM customer"""

#: Finished orders of each block, renumbered.
def finished(block: str = "s") -> str:
    return f"""
    SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY rn) AS rn, c1, c4
    FROM {block} WHERE c3 = 'F'"""


SPLIT = "CASE sample_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"

ORDER_HEAD = "col : o_orderkey | o_custkey | o_orderstatus | o_orderdate"
ANSWER_HEAD = "col : o_orderkey | o_orderdate"
CUSTOMER_HEAD = "col : c_custkey | c_name | c_mktsegment"

ORDER_ROWS = "string_agg('row ' || rn || ' : ' || c1 || ' | ' || c2 || ' | ' || c3 || ' | ' || c4, ' ' ORDER BY rn)"
ANSWER_ROWS = "string_agg('row ' || rn || ' : ' || c1 || ' | ' || c4, ' ' ORDER BY rn)"
CUSTOMER_ROWS = "string_agg('row ' || rn || ' : ' || c1 || ' | ' || c2 || ' | ' || c3, ' ' ORDER BY rn)"

SINGLE_CTE = f"""
s AS ({order_block()}),
f AS ({finished()}),
src AS (SELECT sample_id, '{ORDER_HEAD} ' || {ORDER_ROWS} AS tbl FROM s GROUP BY sample_id),
tgt AS (SELECT sample_id, '{ANSWER_HEAD} ' || {ANSWER_ROWS} AS tbl FROM f GROUP BY sample_id)"""

MULTI_CTE = f"""
s AS ({order_block(MULTI_ORDERS)}),
f AS ({finished()}),
c AS ({CUSTOMER_BLOCK}),
src1 AS (SELECT sample_id, '<table_name> : orders {ORDER_HEAD} ' || {ORDER_ROWS} AS tbl FROM s GROUP BY sample_id),
src2 AS (SELECT sample_id, '<table_name> : customer {CUSTOMER_HEAD} ' || {CUSTOMER_ROWS} AS tbl FROM c GROUP BY sample_id),
tgt AS (SELECT sample_id, '{ANSWER_HEAD} ' || {ANSWER_ROWS} AS tbl FROM f GROUP BY sample_id)"""

SINGLE_QUERY_OUT = quoted(SINGLE_QUERY.replace("<>", "!="))
MULTI_QUERY_OUT = quoted(MULTI_QUERY)


def html(cells: list[str], columns: list[str]) -> str:
    """HTML text of each sample of a block."""
    head = "".join(f"      <th>{c}</th>\n" for c in columns)
    body = " || ".join(f"'      <td>' || {c} || '</td>\n'" for c in cells)
    start = (
        '<table border="1" class="dataframe">\n  <thead>\n    <tr style="text-align: right;">\n'
        f"      <th></th>\n{head}    </tr>\n  </thead>\n  <tbody>\n"
    )
    row = f"'    <tr>\n      <th>' || (rn - 1) || '</th>\n' || {body} || '    </tr>\n'"
    return f"'{start}' || coalesce(string_agg({row}, '' ORDER BY rn), '') || '  </tbody>\n</table>'"


def latex(cells: list[str], columns: list[str]) -> str:
    start = f"\\begin{{tabular}}{{l{'l' * len(columns)}}}\n\\toprule\n & {' & '.join(columns)} \\\\\n\\midrule\n"
    row = f"(rn - 1) || ' & ' || {' || chr(32) || chr(38) || chr(32) || '.join(cells)} || ' \\\\\n'"
    return f"'{start}' || coalesce(string_agg({row}, '' ORDER BY rn), '') || '\\bottomrule\n\\end{{tabular}}\n'"


def markdown(cells: list[str], columns: list[str]) -> str:
    start = f"|  | {' | '.join(columns)} |\n|---:|{':---|' * len(columns)}"
    joined = " || ' | ' || ".join(cells)
    row = f"'\n| ' || (rn - 1) || ' | ' || {joined} || ' |'"
    return f"'{start}' || coalesce(string_agg({row}, '' ORDER BY rn), '')"


ORDER_CELLS, ORDER_COLUMNS = ["c1", "c2", "c3", "c4"], ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]
CUSTOMER_CELLS, CUSTOMER_COLUMNS = ["c1", "c2", "c3"], ["c_custkey", "c_name", "c_mktsegment"]
ANSWER_CELLS, ANSWER_COLUMNS = ["c1", "c4"], ["o_orderkey", "o_orderdate"]


def rendered(form: str, cells: list[str], columns: list[str]) -> str:
    """Rendered text of each sample of a block, by output format."""
    return {"html": html, "latex": latex, "markdown": markdown}[form](cells, columns)
