"""Streams with state of their own: the closing pair of quotes of each event, frozen at its kickoff.

Each event keeps the last tick of either side as of the kickoff, whatever its status.  A timer at the kickoff
(in event time, so files may be late by the watermark's delay, and may come again) freezes the pair if both
last ticks are valid and stand at one line; a side whose last tick is invalid has no price, even if an earlier
one was fine.  A stream that starts after the kickoff catches up: its timer is due at once.  The ticks are let go
when the timer has fired; that the event is frozen is remembered for some more days of event time, on a second
timer, so a file that comes again does not freeze it twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a tick needs: its event and kickoff, side, time, id, line, price and status.
TICK = "event long, kickoff timestamp, side string, ts timestamp, tick_id long, line double, price double, status string"
FROZEN = "event long, kickoff timestamp, line double, over_price double, under_price double, over_ts timestamp, under_ts timestamp"
#: Status of a price that can be had; none at all is one too.
VALID = ("normal", "opener")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(t) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


class ClosingPair(StatefulProcessor):
    """State by event: the last tick of each side; timers at the kickoff and when the event is forgotten."""

    def __init__(self, keep_ms: int):
        self._keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getMapState("last", "side string", "ts long, tick_id long, line double, price double, status string")
        self._kickoff = handle.getValueState("kickoff", "at long")
        self._frozen = handle.getValueState("frozen", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self._frozen.exists():
            for _ in rows:
                pass
            return
        for batch in rows:
            for r in batch.itertuples(index=False):
                at = _millis(r.kickoff)
                if not self._kickoff.exists():
                    self._kickoff.update((at,))
                    self._handle.registerTimer(at)
                ts = _millis(r.ts)
                if ts > at or r.side not in ("over", "under"):
                    continue
                held = self._last.getValue((r.side,)) if self._last.containsKey((r.side,)) else None
                if held is None or (ts, int(r.tick_id)) > (held[0], held[1]):
                    none = lambda x: None if pd.isna(x) else x
                    self._last.updateValue((r.side,), (ts, int(r.tick_id), none(r.line), none(r.price), none(r.status)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._frozen.exists():
            self._frozen.clear()
            return
        sides = [self._last.getValue((s,)) if self._last.containsKey((s,)) else None for s in ("over", "under")]
        at = self._kickoff.get()[0]
        self._frozen.update((at,))
        self._handle.registerTimer(at + self._keep)
        self._last.clear()
        self._kickoff.clear()
        if all(s is not None and s[2] is not None and s[3] is not None and (s[4] is None or s[4] in VALID) for s in sides) and sides[0][2] == sides[1][2]:
            over, under = sides
            stamp = lambda ms: pd.Timestamp(ms, unit="ms")
            yield pd.DataFrame({"event": [key[0]], "kickoff": [stamp(at)], "line": [over[2]], "over_price": [over[3]], "under_price": [under[3]], "over_ts": [stamp(over[0])], "under_ts": [stamp(under[0])]})

    def close(self) -> None:
        pass


def closing_pairs(ticks: DataFrame, late: str = "2 days", keep_days: int = 30) -> DataFrame:
    """The frozen pairs of a stream of ticks (columns of ``TICK``), one row an event, when the watermark has passed its kickoff.

    Needs the RocksDB state store (``use_rocksdb``).
    """
    rows = ticks.withWatermark("ts", late).groupBy("event")
    return rows.transformWithStateInPandas(ClosingPair(keep_days * 86_400_000), FROZEN, "Append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def closing_pairs_batch(ticks: DataFrame) -> DataFrame:
    """The same from a table: the last tick of each side up to the kickoff, then its validity."""
    known = ticks.filter(F.col("ts") <= F.col("kickoff"))
    last = lambda s: F.max_by(F.when(F.col("side") == s, F.struct("ts", "line", "price", "status")), F.when(F.col("side") == s, F.struct("ts", "tick_id")))
    both = known.groupBy("event", "kickoff").agg(last("over").alias("o"), last("under").alias("u"))
    valid = lambda s: F.col(f"{s}.price").isNotNull() & (F.col(f"{s}.status").isNull() | F.col(f"{s}.status").isin(*VALID))
    return both.filter(valid("o") & valid("u") & (F.col("o.line") == F.col("u.line"))).select("event", "kickoff", F.col("o.line").alias("line"), F.col("o.price").alias("over_price"), F.col("u.price").alias("under_price"), F.col("o.ts").alias("over_ts"), F.col("u.ts").alias("under_ts"))
