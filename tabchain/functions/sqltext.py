"""SQL expression text with higher-order functions.

The functions of this package return Spark SQL expressions as text and take
their arguments as text, so a large nested expression reaches the JVM in one
call: ``df.select("id", F.expr(linear_table("table")))``. Lambda variables get
fresh names, so expressions nest freely.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from itertools import count

_NUMBERS = count()


def lit(text: str) -> str:
    """A Python text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lambda(body: Callable[..., str]) -> str:
    names = [f"v{next(_NUMBERS)}" for _ in inspect.signature(body).parameters]
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {body(*names)}"


def transform(array: str, body: Callable[..., str]) -> str:
    return f"transform({array}, {_lambda(body)})"


def where(array: str, body: Callable[..., str]) -> str:
    return f"filter({array}, {_lambda(body)})"


def exists(array: str, body: Callable[[str], str]) -> str:
    return f"exists({array}, {_lambda(body)})"


def forall(array: str, body: Callable[[str], str]) -> str:
    return f"forall({array}, {_lambda(body)})"


def zip_with(left: str, right: str, body: Callable[[str, str], str]) -> str:
    return f"zip_with({left}, {right}, {_lambda(body)})"


def fold(array: str, start: str, merge: Callable[[str, str], str], finish: Callable[[str], str]) -> str:
    return f"aggregate({array}, {start}, {_lambda(merge)}, {_lambda(finish)})"


def sort_with(array: str, order: Callable[[str, str], str]) -> str:
    return f"array_sort({array}, {_lambda(order)})"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return f"get({transform(f'array({value})', body)}, 0)"


def struct(**fields: str) -> str:
    return f"named_struct({', '.join(f'{lit(name)}, {value}' for name, value in fields.items())})"


def tail(array: str) -> str:
    """All elements but the first."""
    return f"slice({array}, 2, greatest(size({array}) - 1, 0))"


# Fixed value: what counts as a number in a cell.
NUMBER_PATTERN = "^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_WHOLE_PATTERN = "^[+-]?[0-9]{1,38}$"


def is_number(text: str) -> str:
    return f"coalesce({text} RLIKE {lit(NUMBER_PATTERN)}, false)"


def number_comparison(left: str, op: str, right: str) -> str:
    """Two number texts compared: whole numbers of up to 38 digits exactly, others as doubles."""
    whole = f"({left} RLIKE {lit(_WHOLE_PATTERN)} AND {right} RLIKE {lit(_WHOLE_PATTERN)})"
    cast = lambda text, kind: f"try_cast({text} AS {kind})"
    return (
        f"if({whole}, {cast(left, 'decimal(38,0)')} {op} {cast(right, 'decimal(38,0)')}, "
        f"{cast(left, 'double')} {op} {cast(right, 'double')})"
    )
