"""Larger expressions as SQL text: a function of one value, written once, applied to any column.

An expression of hundreds of parts takes far longer to put together from column objects, one call into the
engine each, than to plan or to run; as text the engine reads it in one go.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex(pattern: str) -> str:
    """A pattern as a raw string literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def part(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract({text}, {regex(pattern)}, {group})"


def without(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {regex(pattern)}, '{by}')"


def apply(function: str, value: Column) -> Column:
    """What the lambda ``function`` gives for a column's value."""
    return F.get(F.call_function("transform", F.array(value), F.expr(function)), F.lit(0))
