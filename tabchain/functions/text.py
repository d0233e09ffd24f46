"""Expressions on queries, chains and cells."""

from __future__ import annotations

from tabchain.functions.cells import strip
from tabchain.functions.sqltext import fold, let, lit, struct, transform, where

# Chain marks and the keyword patterns of the query profile.
CHAIN_ARROW = "->"
CHAIN_BEGIN = "<BEGIN>"
CHAIN_END = "<END>"
SELECT_PATTERN = "(?i)select "
FROM_PATTERN = "(?i)from"

# Fixed value: the question template of the baseline prompt.
BASELINE_TEMPLATE = (
    "Here's a serialized table.\n\n{table}\n\n"
    "Given this table please answer the question: {question}\nAnswer: "
)


def model_text(text: str) -> str:
    """Stripped, lower-cased text without double quotes."""
    return f"replace(lower({strip(text)}), '\"', '')"


def repair_query(query: str) -> str:
    """Collapse whitespace and close up ``! =``, ``> =`` and ``< =``."""
    collapsed = strip(f"regexp_replace({query}, {lit('\\s+')}, ' ')")
    return f"regexp_replace({collapsed}, '(^| )([!<>]) =(?= |$)', '$1$2=')"


def keyword_count(query: str, pattern: str) -> str:
    return f"regexp_count({query}, {lit(pattern)})"


def keyword_spans(query: str, pattern: str, width: int) -> str:
    """0-based ``(start, end)`` of each match of a fixed-width pattern."""
    ends = lambda acc, piece: f"concat({acc}, array(coalesce(get({acc}, size({acc}) - 1) + {width}, 0) + length({piece})))"
    starts = let(
        f"split({query}, {lit(pattern)})",
        lambda p: fold(f"slice({p}, 1, greatest(size({p}) - 1, 0))", "CAST(array() AS array<int>)", ends, lambda a: a),
    )
    return transform(starts, lambda s: struct(start=s, end=f"{s} + {width}"))


def select_spans(query: str) -> str:
    return keyword_spans(query, SELECT_PATTERN, 7)


def from_spans(query: str) -> str:
    return keyword_spans(query, FROM_PATTERN, 4)


def next_action(chain: str) -> str:
    """First open step of a chain text."""
    return strip(f"get(split({chain}, {lit(CHAIN_ARROW)}), if(contains({chain}, {lit(CHAIN_BEGIN)}), 1, 0))")


def chain_actions(chain: str) -> str:
    """All steps of a chain text without its begin and end marks."""
    return where(
        transform(f"split({chain}, {lit(CHAIN_ARROW)})", strip),
        lambda s: f"{s} NOT IN ({lit(CHAIN_BEGIN)}, {lit(CHAIN_END)}, '')",
    )


def chain_text(actions: str) -> str:
    """Steps joined to a closed chain text."""
    return f"concat(array_join({actions}, {lit(f' {CHAIN_ARROW} ')}), {lit(f' {CHAIN_ARROW} {CHAIN_END}')})"


def table_descriptor(tables: str) -> str:
    """One line per table: its name ``df<i>`` and its columns."""
    line = lambda t, i: (
        f"concat('df', CAST({i} + 1 AS string), ': table with columns - ', array_join({t}.columns, ','), {lit(chr(10))})"
    )
    return f"array_join({transform(tables, line)}, '')"


def baseline_prompt(table_text: str, question: str) -> str:
    """Serialised table and question in the baseline's template."""
    before, rest = BASELINE_TEMPLATE.split("{table}")
    between, after = rest.split("{question}")
    return f"concat({lit(before)}, {table_text}, {lit(between)}, {question}, {lit(after)})"


def split_cell(cell: str, separator: str, part: int) -> str:
    """One part (0-based) of a cell that holds several values."""
    return strip(f"get(split({cell}, {lit(separator)}), {part})")
