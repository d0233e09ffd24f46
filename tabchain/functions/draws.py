"""Reproducible draws.

A draw is a hash of its key, never ``rand()``: a retried task, another number
of partitions or another engine gives the same value.
"""

from __future__ import annotations

from tabchain.functions.sqltext import lit

#: Draws are uniform over 48 bits.
DRAW_BITS = 48


def draw(*parts: str | int) -> str:
    """Integer in ``[0, 2**48)`` from the hash of all parts (SQL expressions)."""
    texts = ", ".join(f"CAST({p} AS string)" for p in parts)
    return f"CAST(conv(substr(md5(concat_ws('/', {texts})), 1, 12), 16, 10) AS bigint)"


def draw_below(limit: str | int, *parts: str | int) -> str:
    """Integer in ``[0, limit)``; NULL when the limit is zero."""
    return f"CAST(try_mod({draw(*parts)}, nullif(CAST({limit} AS bigint), 0L)) AS int)"


def draw_item(items: tuple[str, ...], *parts: str | int) -> str:
    """One of a fixed list of texts."""
    return f"get(array({', '.join(lit(i) for i in items)}), {draw_below(len(items), *parts)})"
