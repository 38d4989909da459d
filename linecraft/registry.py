"""The table of queries and of the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Added before rounding, so that two engines whose last bits differ round an exact tie alike.
NUDGE = 1.7e-9


def rounded(x: Column | str, digits: int = 6) -> Column:
    """``x`` to some digits as a double; ties go up, whatever the last bits of ``x``.

    Whole numbers of the last digit are rounded, as DuckDB does: rounding the decimal text of ``x`` goes the other way next to a tie.
    """
    unit = 10.0**digits
    return F.round(((F.col(x) if isinstance(x, str) else x).cast("double") + NUDGE) * unit) / unit


def nudged(sql: str) -> str:
    """``sql`` with the same treatment of every ``round(x, digits)``; a negative zero becomes zero."""
    out, at = [], 0
    for found in re.finditer(r"\bround\(", sql):
        if found.start() < at:
            continue
        depth, comma, k = 1, None, found.end()
        while depth:
            c = sql[k]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 1:
                comma = k
            k += 1
        if comma is not None:
            out += [sql[at : found.start()], "(0.0::DOUBLE + round((", nudged(sql[found.end() : comma]), f")::DOUBLE + {NUDGE}::DOUBLE", sql[comma:k], ")"]
            at = k
    return "".join(out) + sql[at:]


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = nudged(sql)
        return f

    return add
