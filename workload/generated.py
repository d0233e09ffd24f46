"""Queries that generate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabchain.functions.cells import table_value, text_array
from tabchain.functions.sqltext import lit
from tabchain.operators import generation as g
from tabchain.operators.steps import AGGREGATES, CONNECTORS, NUMERIC_OPS, STRING_OPS
from tabchain.sources.registry import spread_scan
from workload import sql_parts as q
from workload.corpora import multi_samples, order_tables, table
from workload.sql_parts import quoted

SEED = 7
PER_TABLE = 2

_NUMBER = r"'[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?'"


def where_one(spark: SparkSession, d: str) -> DataFrame:
    made = g.generate_where(order_tables(spark, d), "sample_id", "table", PER_TABLE, SEED)
    return made.select("sample_id", "query_no", "text")


def where_aggs(spark, d):
    made = g.generate_where(order_tables(spark, d), "sample_id", "table", PER_TABLE, SEED, with_aggs=True)
    return made.select("sample_id", "query_no", "text")


def _two_tables(spark, d) -> DataFrame:
    return multi_samples(spark, d).select("sample_id", F.expr("get(tables, 0) AS a"), F.expr("get(tables, 1) AS b"))


def where_two(spark, d):
    return g.generate_where_two(_two_tables(spark, d), "sample_id", "a", "b", PER_TABLE, SEED).select("sample_id", "query_no", "text")


def execute_two(spark, d):
    """Conditions over two tables that share the order key, run on their join."""
    cells = lambda *at: f"transform(table.rows, r -> array({', '.join(f'get(r, {i})' for i in at)}))"
    pairs = order_tables(spark, d).selectExpr(
        "sample_id",
        f"{table_value(text_array(q.ORDER_COLUMNS[:3]), cells(0, 1, 2))} AS a",
        f"{table_value(text_array(['o_orderkey', 'o_orderdate']), cells(0, 3))} AS b",
    )
    made = g.generate_where_two(pairs, "sample_id", "a", "b", PER_TABLE, SEED)
    answered = g.run_generated_two(made, "sample_id", "a", "b", "o_orderkey")
    return answered.select(
        "sample_id", "query_no", "text", F.expr("array_join(transform(answer_rows, r -> array_join(r, '|')), ',') AS found")
    )


def having_one(spark, d):
    made = g.generate_having(order_tables(spark, d), "sample_id", ["table"], PER_TABLE, SEED, with_aggs=True)
    return made.select("sample_id", "query_no", "text")


def having_two(spark, d):
    made = g.generate_having(_two_tables(spark, d), "sample_id", ["a", "b"], PER_TABLE, SEED, with_aggs=True)
    return made.select("sample_id", "query_no", "text")


def execute(spark, d):
    """Generated conditions, run on their own tables; aggregates make them invalid there."""
    made = g.generate_where(order_tables(spark, d), "sample_id", "table", PER_TABLE, SEED, with_aggs=True)
    answered = g.run_generated(made, "sample_id")
    return answered.select(
        "sample_id",
        "query_no",
        "text",
        "valid",
        F.expr("coalesce(array_join(transform(answer_rows, r -> get(r, 0)), ','), '-') AS keys"),
    )


def group_by(spark, d):
    t = order_tables(spark, d)
    made = g.generate_group_by(t, "sample_id", "table.columns", "get(table.rows, 0)", lit("orders"), PER_TABLE, SEED)
    return made.select("sample_id", "query_no", "group_pos", "text")


_FLAT_COLUMNS = ("o_orderstatus", "o_year", "o_month", "o_custkey")


def _flat_rows(spark, d) -> DataFrame:
    """Orders as flat tables, one per priority: ``(o_orderpriority, o_orderkey, cells)``."""
    text = F.col("o_orderdate").cast("string")
    return spread_scan(table(spark, d, "orders")).select(
        "o_orderpriority",
        "o_orderkey",
        F.array(
            "o_orderstatus",
            F.substring(text, 1, 4),
            F.substring(text, 6, 2).cast("int").cast("string"),
            F.col("o_custkey").cast("string"),
        ).alias("cells"),
    )


def having_groups(spark, d):
    """GROUP BY … HAVING over flat tables of any size; constants come from the grouped results."""
    flat = _flat_rows(spark, d)
    firsts = flat.groupBy("o_orderpriority").agg(F.min_by("cells", "o_orderkey").alias("first_row"))
    made = g.generate_group_by(firsts, "o_orderpriority", text_array(_FLAT_COLUMNS), "first_row", lit("orders"), 3, SEED)
    return g.having_from_groups(flat, made, "o_orderpriority", "o_orderkey", SEED)


def having_where(spark, d):
    """The same behind a WHERE per query on the order status, with the first row's as its constant."""
    flat = _flat_rows(spark, d)
    firsts = flat.groupBy("o_orderpriority").agg(F.min_by("cells", "o_orderkey").alias("first_row"))
    made = g.generate_group_by(firsts, "o_orderpriority", text_array(_FLAT_COLUMNS), "first_row", lit("orders"), 3, SEED)
    status = firsts.select("o_orderpriority", F.expr(table_value(text_array(_FLAT_COLUMNS[:1]), "array(slice(first_row, 1, 1))")).alias("table"))
    wheres = g.generate_where(status, "o_orderpriority", "table", 3, SEED)
    return g.having_from_groups(flat, made, "o_orderpriority", "o_orderkey", SEED, wheres=wheres)


# --- SQL --------------------------------------------------------------------

# Order key and the three other columns; the key stands in both tables.
_SHARED_ENTRIES = [("o_orderkey", 0, 0), ("o_custkey", 0, 1), ("o_orderstatus", 0, 2), ("o_orderkey", 0, 0), ("o_orderdate", 0, 3)]
_ORDER_ENTRIES = [(c, 0, i) for i, c in enumerate(q.ORDER_COLUMNS)]
_TWO_ENTRIES = _ORDER_ENTRIES + [(c, 1, i) for i, c in enumerate(q.CUSTOMER_COLUMNS)]


def _condition_ctes(two: bool, aggs: bool, count_range: bool, shared: bool = False) -> str:
    entries = _SHARED_ENTRIES if shared else _TWO_ENTRIES if two else _ORDER_ENTRIES
    key = (SEED, "sample_id", "query_no")
    values = ", ".join(f"({i}, '{c}', {o}, {p})" for i, (c, o, p) in enumerate(entries))
    blocks = f"s AS ({q.order_block(q.MULTI_ORDERS if two else q.SINGLE_ROWS)})"
    cells = f"SELECT sample_id, 0 AS owner, rn - 1 AS r, unnest(range(0, 4)) AS pos, unnest([{', '.join(q.ORDER_CELLS)}]) AS val FROM s"
    ids = "SELECT DISTINCT sample_id FROM s"
    if two:
        blocks += f", c AS ({q.CUSTOMER_BLOCK})"
        cells += f" UNION ALL SELECT sample_id, 1, rn - 1, unnest(range(0, 3)), unnest([{', '.join(q.CUSTOMER_CELLS)}]) FROM c"
        ids += " SEMI JOIN c USING (sample_id)"
    agg = (
        f"CASE WHEN is_num AND {q.draw(*key, quoted('half'), 'j')} % 2 = 1 THEN {q.item(AGGREGATES, q.draw(*key, quoted('agg'), 'j'))} ELSE '' END"
        if aggs
        else "''"
    )
    constant = f"CASE WHEN agg = 'COUNT' THEN ({q.draw(*key, quoted('count'), 'j')} % nrows + 1)::VARCHAR ELSE val END" if aggs and count_range else "val"
    return f"""
{blocks},
cells AS ({cells}),
sizes AS (SELECT sample_id, owner, max(r) + 1 AS nrows FROM cells GROUP BY 1, 2),
qn AS (SELECT sample_id, unnest(range(0, {PER_TABLE}))::INTEGER AS query_no FROM ({ids})),
qk AS (SELECT *, {q.draw(*key, quoted('n'))} % {len(entries)} + 1 AS keep FROM qn),
ent AS (SELECT * FROM (VALUES {values}) t(i, col, owner, pos)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY sample_id, query_no ORDER BY {q.draw(*key, quoted('col'), 'i')}, i) - 1 AS j FROM qk CROSS JOIN ent),
sized AS (SELECT *, {q.draw(*key, quoted('row'), 'j')} % nrows AS r FROM ordered JOIN sizes USING (sample_id, owner) WHERE j < keep),
drawn AS (SELECT *, regexp_full_match(val, {_NUMBER}) AS is_num FROM sized JOIN cells USING (sample_id, owner, pos, r)),
typed AS (SELECT *, {agg} AS agg,
  CASE WHEN is_num THEN {q.item(NUMERIC_OPS, q.draw(*key, quoted('op'), 'j'))} ELSE {q.item(STRING_OPS, q.draw(*key, quoted('op'), 'j'))} END AS op,
  CASE WHEN j < keep - 1 THEN {q.item(CONNECTORS, q.draw(*key, quoted('link'), 'j'))} ELSE '' END AS link FROM drawn),
conds AS (SELECT *, {constant} AS const FROM typed),
texts AS (SELECT sample_id, query_no, string_agg(
  CASE WHEN agg = '' THEN '`' || col || '`' ELSE agg || '(`' || col || '`)' END || ' ' || op || ' ' ||
  CASE WHEN is_num THEN const ELSE '''' || const || '''' END || CASE WHEN link = '' THEN '' ELSE ' ' || link END, ' ' ORDER BY j) AS text,
  bool_and(agg = '') AS valid FROM conds GROUP BY 1, 2)"""


def _conditions_sql(two: bool = False, aggs: bool = False, count_range: bool = True) -> str:
    return f"WITH {_condition_ctes(two, aggs, count_range)} SELECT sample_id, query_no, text FROM texts"


def _execute_sql(shared: bool = False) -> str:
    compare = lambda a, b: (
        f"CASE op WHEN '=' THEN {a} = {b} WHEN '!=' THEN {a} <> {b} WHEN '<' THEN {a} < {b} WHEN '>' THEN {a} > {b} "
        f"WHEN '<=' THEN {a} <= {b} WHEN '>=' THEN {a} >= {b} END"
    )
    return f"""
WITH {_condition_ctes(False, not shared, True, shared)},
linked AS (SELECT *, coalesce(sum((link = 'OR')::INTEGER) OVER (PARTITION BY sample_id, query_no ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM conds),
truth AS (SELECT a.sample_id, query_no, b.r AS row_no, grp,
  CASE WHEN is_num THEN {compare('try_cast(b.val AS DOUBLE)', 'try_cast(const AS DOUBLE)')} ELSE {compare('b.val', 'const')} END AS ok
  FROM linked a JOIN cells b ON a.sample_id = b.sample_id AND a.pos = b.pos),
groups AS (SELECT sample_id, query_no, row_no, grp, bool_and(coalesce(ok, false)) AS ok FROM truth GROUP BY 1, 2, 3, 4),
hits AS (SELECT sample_id, query_no, row_no FROM groups GROUP BY 1, 2, 3 HAVING bool_or(ok)),
keys AS (SELECT hits.sample_id, query_no, string_agg({'concat_ws(\'|\', c1, c2, c3, c4)' if shared else 'c1'}, ',' ORDER BY row_no) AS keys FROM hits JOIN s ON s.sample_id = hits.sample_id AND s.rn = row_no + 1 GROUP BY ALL)
SELECT t.sample_id, t.query_no, {"text, coalesce(keys, '') AS found" if shared else
    "CASE WHEN valid THEN text ELSE '' END AS text, valid, CASE WHEN valid THEN coalesce(keys, '') ELSE '-' END AS keys"}
FROM texts t LEFT JOIN keys k ON t.sample_id = k.sample_id AND t.query_no = k.query_no"""


def _items_cte(key: str, columns: tuple[str, ...], numeric: list[bool], per_table: int) -> str:
    """SELECT items of each GROUP BY query from fixed column types."""
    k = (SEED, key, "query_no")
    values = ", ".join(f"({i}, '{c}', {str(n).lower()})" for i, (c, n) in enumerate(zip(columns, numeric)))
    return f"""
qn AS (SELECT {key}, unnest(range(0, {per_table}))::INTEGER AS query_no FROM ids),
qg AS (SELECT *, ({q.draw(*k, quoted('group'))} % {len(columns)})::INTEGER AS group_pos FROM qn),
ent AS (SELECT * FROM (VALUES {values}) t(i, col, is_num)),
items AS (SELECT *, CASE WHEN i = group_pos THEN '' WHEN is_num THEN {q.item(AGGREGATES, q.draw(*k, quoted('agg'), 'i'))} ELSE 'COUNT' END AS agg FROM qg CROSS JOIN ent),
selects AS (SELECT {key}, query_no, group_pos, 'SELECT ' || string_agg(CASE WHEN agg = '' THEN '`' || col || '`' ELSE agg || '(`' || col || '`)' END, ', ' ORDER BY i)
  || ' FROM orders GROUP BY `' || max(col) FILTER (agg = '') || '`' AS text FROM items GROUP BY 1, 2, 3)"""


GROUP_BY_SQL = (
    f"WITH ids AS (SELECT DISTINCT o_orderkey // {q.SINGLE_ROWS} AS sample_id FROM orders), "
    + _items_cte("sample_id", tuple(q.ORDER_COLUMNS), [True, True, False, False], PER_TABLE)
    + " SELECT sample_id, query_no, group_pos, text FROM selects"
)


def _having_groups_sql(where: bool = False) -> str:
    key = "o_orderpriority"
    k = (SEED, key, "query_no")
    wheres, met, text, linked = "", "", "x.text", ""
    if where:
        wheres = f"""
w AS (SELECT {key} AS w_key, query_no AS w_no, val, {q.item(STRING_OPS, q.draw(*k, quoted('op'), 0))} AS op FROM qn
  JOIN (SELECT {key}, min_by(o_orderstatus, o_orderkey) AS val FROM orders GROUP BY 1) USING ({key})),"""
        met = f" JOIN w ON w_key = a.{key} AND w_no = a.query_no AND (w.op = '=') = (cells[1] = w.val)"
        text = "replace(x.text, ' GROUP BY ', ' WHERE `o_orderstatus` ' || op || ' ' || chr(39) || val || chr(39) || ' GROUP BY ')"
        linked = f" JOIN w ON w_key = x.{key} AND w_no = x.query_no"
    # Results are whole numbers of ten-thousandths, so sums and means are exact.
    return f"""
WITH ids AS (SELECT DISTINCT {key} FROM orders),
{_items_cte(key, _FLAT_COLUMNS, [False, True, True, True], 3)},{wheres}
flat AS (SELECT {key}, [o_orderstatus, year(o_orderdate)::VARCHAR, month(o_orderdate)::VARCHAR, o_custkey::VARCHAR] AS cells FROM orders),
aggs AS (SELECT *, row_number() OVER (PARTITION BY {key}, query_no ORDER BY i) - 1 AS item_no FROM items WHERE agg <> ''),
vals AS (SELECT a.{key}, query_no, item_no, col, agg, cells[group_pos + 1] AS gval, try_cast(cells[i + 1] AS BIGINT) AS v
  FROM aggs a JOIN flat f ON a.{key} = f.{key}{met}),
res AS (SELECT {key}, query_no, item_no, col, agg, gval, CASE agg WHEN 'COUNT' THEN count(*) * 10000 WHEN 'SUM' THEN sum(v) * 10000
  WHEN 'MIN' THEN min(v) * 10000 WHEN 'MAX' THEN max(v) * 10000 ELSE (sum(v) * 20000 + count(*)) // (2 * count(*)) END::BIGINT AS e4
  FROM vals GROUP BY 1, 2, 3, 4, 5, 6),
consts AS (SELECT {key}, query_no, item_no, col, agg, e4 AS c4 FROM (SELECT *, row_number() OVER (PARTITION BY {key}, query_no, item_no
  ORDER BY {q.draw(*k, 'item_no', quoted('value'), 'gval')}, gval) AS rn FROM res) WHERE rn = 1),
sized AS (SELECT *, count(*) OVER (PARTITION BY {key}, query_no) AS n FROM consts),
placed AS (SELECT *, {q.draw(*k, quoted('n'))} % n + 1 AS keep, row_number() OVER (PARTITION BY {key}, query_no ORDER BY {q.draw(*k, quoted('col'), 'item_no')}, item_no) - 1 AS j FROM sized),
conds AS (SELECT *, {q.item(NUMERIC_OPS, q.draw(*k, quoted('op'), 'j'))} AS op,
  CASE WHEN j < keep - 1 THEN {q.item(CONNECTORS, q.draw(*k, quoted('link'), 'j'))} ELSE '' END AS link,
  CASE WHEN c4 % 10000 = 0 THEN (c4 // 10000)::VARCHAR ELSE regexp_replace((c4 // 10000) || '.' || lpad((c4 % 10000)::VARCHAR, 4, '0'), '0+$', '') END AS const
  FROM placed WHERE j < keep),
texts AS (SELECT {key}, query_no, string_agg(agg || '(`' || col || '`) ' || op || ' ' || const || CASE WHEN link = '' THEN '' ELSE ' ' || link END, ' ' ORDER BY j) AS having_text FROM conds GROUP BY 1, 2),
linked AS (SELECT *, coalesce(sum((link = 'OR')::INTEGER) OVER (PARTITION BY {key}, query_no ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM conds),
truth AS (SELECT l.{key}, l.query_no, gval, grp, bool_and(CASE op WHEN '=' THEN e4 = c4 WHEN '!=' THEN e4 <> c4 WHEN '<' THEN e4 < c4 WHEN '>' THEN e4 > c4 WHEN '<=' THEN e4 <= c4 ELSE e4 >= c4 END) AS ok
  FROM linked l JOIN res r ON l.{key} = r.{key} AND l.query_no = r.query_no AND l.item_no = r.item_no GROUP BY 1, 2, 3, 4),
kept AS (SELECT {key}, query_no, count(*) AS n_groups, count(*) FILTER (ok) AS n_kept FROM
  (SELECT {key}, query_no, gval, bool_or(ok) AS ok FROM truth GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT x.{key}, x.query_no, {text} || ' HAVING ' || having_text AS text, true AS valid, n_groups, n_kept
FROM selects x JOIN texts USING ({key}, query_no) JOIN kept USING ({key}, query_no){linked}"""


QUERIES = {
    "gen_where": (where_one, _conditions_sql()),
    "gen_where_aggs": (where_aggs, _conditions_sql(aggs=True)),
    "gen_where_two": (where_two, _conditions_sql(two=True)),
    "gen_having": (having_one, _conditions_sql(aggs=True, count_range=False)),
    "gen_having_two": (having_two, _conditions_sql(two=True, aggs=True, count_range=False)),
    "gen_group_by": (group_by, GROUP_BY_SQL),
    "gen_having_groups": (having_groups, _having_groups_sql()),
    "gen_having_where": (having_where, _having_groups_sql(where=True)),
    "gen_execute": (execute, _execute_sql()),
    "gen_execute_two": (execute_two, _execute_sql(shared=True)),
}
