"""Bind an expression to a name inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body uses it.

    Without this, nested text expressions are copied at every use: the plan grows exponentially and
    the work is repeated for each copy.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_sql(value: Column, body: str) -> Column:
    """Like `let`, with the body as SQL text over the name `x`.

    For long bodies: one parsed string instead of a thousand calls across the Python gateway.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(f"x -> {body}")), F.lit(0))


def raw(pattern: str) -> str:
    """A pattern as a raw SQL string literal."""
    if "'" in pattern and '"' in pattern:
        raise ValueError("pattern holds both kinds of quotes")
    quote = '"' if "'" in pattern else "'"
    return f"r{quote}{pattern}{quote}"
