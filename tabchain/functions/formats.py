"""HTML, LaTeX and Markdown forms of TABLE values."""

from __future__ import annotations

from functools import reduce

from tabchain.functions.cells import strip
from tabchain.functions.linear import join_query, linear_name
from tabchain.functions.sqltext import let, lit, struct, transform, zip_with

FORMATS = ("latex", "html", "markdown")

# Characters escaped in HTML headers and cells, in this order.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
# Characters written by their names, in cells only.
HTML_CONTROLS = (
    ("\t", "\\t"),
    ("\r", "\\r"),
    ("\n", "\\n"),
)
# The frame of an HTML table.
HTML_START = (
    '<table border="1" class="dataframe">\n  <thead>\n'
    '    <tr style="text-align: right;">\n      <th></th>\n'
)
HTML_BODY = "    </tr>\n  </thead>\n  <tbody>\n"
HTML_END = "  </tbody>\n</table>"


def _escaped(value: str, escapes: tuple[tuple[str, str], ...]) -> str:
    text = reduce(
        lambda text, pair: f"replace({text}, {lit(pair[0])}, {lit(pair[1])})",
        escapes,
        f"coalesce({value}, '')",
    )
    return strip(text)


def _html_cells(cells: str, tag: str) -> str:
    escapes = HTML_ESCAPES if tag == "th" else HTML_ESCAPES + HTML_CONTROLS
    end = lit(f"</{tag}>\n")
    one = lambda x: f"concat('      <{tag}>', {_escaped(x, escapes)}, {end})"
    return f"array_join({transform(cells, one)}, '')"


def html_head(columns: str) -> str:
    """All of an HTML table before its rows."""
    return f"concat({lit(HTML_START)}, {_html_cells(columns, 'th')}, {lit(HTML_BODY)})"


def html_row(cells: str, number: str) -> str:
    return (
        f"concat({lit('    <tr>' + chr(10) + '      <th>')}, CAST({number} AS string), {lit('</th>' + chr(10))}, "
        f"{_html_cells(cells, 'td')}, {lit('    </tr>' + chr(10))})"
    )


def html_table(table: str) -> str:
    """HTML table with a leading 0-based index column."""
    return let(
        table,
        lambda t: f"concat({html_head(f'{t}.columns')}, array_join({transform(f'{t}.rows', html_row)}, ''), {lit(HTML_END)})",
    )


def latex_table(table: str) -> str:
    """LaTeX tabular with rules and a leading 0-based index column."""
    line = lambda cells: f"concat(array_join({cells}, ' & ', ''), {lit(' ' + chr(92) * 2 + chr(10))})"
    row = lambda r, i: f"concat(CAST({i} AS string), ' & ', {line(r)})"
    start, head = lit("\\begin{tabular}{l"), lit("}\n\\toprule\n & ")
    rule, end = lit("\\midrule\n"), lit("\\bottomrule\n\\end{tabular}\n")
    return let(
        table,
        lambda t: (
            f"concat({start}, repeat('l', size({t}.columns)), {head}, {line(f'{t}.columns')}, {rule}, "
            f"array_join({transform(f'{t}.rows', row)}, ''), {end})"
        ),
    )


def markdown_table(table: str, padded: bool = False) -> str:
    """Pipe table with a leading 0-based index column.

    ``padded`` aligns the cells: texts to the left, the index to the right.
    """
    newline = lit("\n")
    if not padded:
        line = lambda first, cells: f"concat('| ', {first}, ' | ', array_join({cells}, ' | ', ''), ' |')"
        rows = lambda t: transform(f"{t}.rows", lambda r, i: line(f"CAST({i} AS string)", r))
        return let(
            table,
            lambda t: (
                f"concat_ws({newline}, {line(lit(''), f'{t}.columns')}, "
                f"concat('|---:|', repeat(':---|', size({t}.columns))), {rows(t)})"
            ),
        )
    pad = lambda text, width: f"rpad({text}, greatest({width}, length({text})), ' ')"

    def widths(t: str) -> str:
        longest = lambda j: f"array_max({transform(f'{t}.rows', lambda r: f'''length(coalesce(get({r}, {j}), ''))''')})"
        return transform(f"{t}.columns", lambda c, j: f"greatest(length({c}) + 2, coalesce({longest(j)}, 0))")

    def aligned(s: str) -> str:
        cells = lambda c: f"array_join({zip_with(c, f'{s}.widths', lambda x, w: pad(f'''coalesce({x}, '')''', w))}, ' | ')"
        line = lambda first, c: f"concat('| ', lpad({first}, {s}.first, ' '), ' | ', {cells(c)}, ' |')"
        rule = transform(f"{s}.widths", lambda w: f"concat(':', repeat('-', {w} + 1))")
        return (
            f"concat_ws({newline}, {line(lit(''), f'{s}.t.columns')}, "
            f"concat('|', repeat('-', {s}.first + 1), ':|', array_join({rule}, '|'), '|'), "
            + transform(f"{s}.t.rows", lambda r, i: line(f"CAST({i} AS string)", r))
            + ")"
        )

    return let(
        table,
        lambda t: let(
            struct(t=t, first=f"greatest(2, length(CAST(size({t}.rows) - 1 AS string)))", widths=widths(t)),
            aligned,
        ),
    )


def render_table(table: str, table_type: str) -> str:
    if table_type not in FORMATS:
        raise ValueError(f"table type must be one of {FORMATS}, not {table_type!r}")
    return {"html": html_table, "latex": latex_table, "markdown": markdown_table}[table_type](table)


def rendered_source(query: str, rendered: str, names: str) -> str:
    """Query and ``<table_name> : n <rendered>`` parts; empty tables stay."""
    parts = zip_with(rendered, names, lambda t, n: f"concat_ws(' ', {linear_name(n)}, {t})")
    return join_query(query, f"array_join({parts}, ' ')")


def format_column(side: str, table_type: str) -> str:
    """Name of the source or target column of one table type."""
    if side not in ("source", "target"):
        raise ValueError(f"side must be 'source' or 'target', not {side!r}")
    if table_type not in FORMATS:
        raise ValueError(f"table type must be one of {FORMATS}, not {table_type!r}")
    return f"{side}_{table_type}"
