"""Nested price payloads as rows, by a table function that sees a whole series in order.

``Offerings`` is polymorphic: its output has the input table's own columns without the payload, then book,
period, market, side, value and whether the value is the first of its series.  It takes a table partitioned by
series and ordered in time and passes on an offering only where its value differs from the one before, so a
feed of full snapshots becomes a feed of changes in one pass.  A partition's state is one value an offering.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, Row, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .flatten import objects

_ADDED = [("book", StringType()), ("period", StringType()), ("market", StringType()), ("side", StringType()), ("value", DoubleType()), ("first", BooleanType())]


class Offerings:
    """Rows of the maps book -> period -> market -> side of a JSON column; malformed payloads have none."""

    def __init__(self) -> None:
        self._held: dict[tuple, float | None] = {}

    @staticmethod
    def analyze(rows: AnalyzeArgument, payload: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(payload.value, str) or payload.value not in rows.dataType.fieldNames():
            raise ValueError("a table and the name of its payload column are needed")
        kept = [f for f in rows.dataType.fields if f.name != payload.value]
        taken = {f.name.lower() for f in kept}
        added = [StructField(n + "_" * (n in taken), t) for n, t in _ADDED]
        return AnalyzeResult(schema=StructType([*kept, *added]))

    def eval(self, row: Row, payload: str):
        try:
            books = json.loads(row[payload] or "{}")
        except ValueError:
            return
        own = tuple(row[c] for c in row.__fields__ if c != payload)
        for key, value in _leaves(books, ()):
            if key not in self._held or self._held[key] != value:
                yield (*own, *key, value, key not in self._held)
                self._held[key] = value


def _leaves(node, path: tuple):
    """(book, period, market, side) and the number there, in order of names; other shapes are passed over."""
    if len(path) == 4:
        if node is None or (isinstance(node, (int, float)) and not isinstance(node, bool)):
            yield path, None if node is None else float(node)
    elif isinstance(node, dict):
        for k in sorted(node):
            yield from _leaves(node[k], (*path, k))


def changed_offerings(snapshots: DataFrame, series: list[str], order: list[str], payload: str = "payload") -> DataFrame:
    """The offerings of ``snapshots`` that differ from those before them in their series.

    What ``Offerings`` does, with columns and one window instead of a call a row.
    """
    if payload not in snapshots.columns:
        raise ValueError("a table and the name of its payload column are needed")
    kept = [c for c in snapshots.columns if c != payload]
    taken = {c.lower() for c in kept}
    book, period, market, side, value, first = names = [n + "_" * (n in taken) for n, _ in _ADDED]
    out = snapshots.select(*kept, F.explode(objects(F.try_parse_json(payload))).alias("__x"))
    for name in (book, period, market):
        out = out.select(*out.columns[:-1], F.col("__x.key").alias(name), F.explode(objects(F.col("__x.value"))).alias("__x"))
    leaf, kind = F.col("__x.value"), F.schema_of_variant("__x.value")
    number = (kind == "VOID") | kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    out = out.filter(number).select(*out.columns[:-1], F.col("__x.key").alias(side), F.try_variant_get(leaf, "$", "double").alias(value))
    w = Window.partitionBy(*series, book, period, market, side).orderBy(*order)
    out = out.withColumns({first: F.row_number().over(w) == 1, "__was": F.lag(value).over(w)})
    return out.filter(F.col(first) | ~F.col(value).eqNullSafe(F.col("__was"))).select(*kept, *names)
