"""Streaks of errors of a stage as a keyed state machine with timers.

A stage is closed until most errors have come one after the other; then it
is open for a cooldown, whatever comes meanwhile; after that it is half open until the
next span, which closes it, or opens it again if it is an error.  Each interval
that the stage was not closed is a row as soon as it ends; the end of
a cooldown is a timer in event time, so it comes without a further span of that stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql import types as T

OUT = "name string, state string, start_ms long, end_ms long"
#: Settings that a session needs for these queries.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _rows(found: list[tuple]) -> Iterator[pd.DataFrame]:
    if found:
        yield pd.DataFrame(found, columns=["name", "state", "start_ms", "end_ms"])


class Streaks(StatefulProcessor):
    """State of one stage: (state, errors in a row, when the state began in milliseconds)."""

    def __init__(self, most: int, cooldown_ms: int) -> None:
        self.most, self.cooldown_ms = most, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stage = handle.getValueState("stage", "state string, errors int, since long")

    def _at(self, state: tuple, ms: int) -> tuple[tuple, list[tuple]]:
        """The state once time has come to ms, and the interval that ended until then."""
        name, errors, since = state
        if name == "open" and ms >= since + self.cooldown_ms:
            return ("half_open", 0, since + self.cooldown_ms), [("open", since, since + self.cooldown_ms)]
        return state, []

    def _step(self, state: tuple, ms: int, error: bool) -> tuple[tuple, list[tuple]]:
        """The state after a span, and the intervals that ended."""
        state, ended = self._at(state, ms)
        name, errors, since = state
        if name == "half_open":
            ended.append(("half_open", since, ms))
            return (("open", 0, ms) if error else ("closed", 0, ms)), ended
        if name == "closed":
            errors = errors + 1 if error else 0
            return (("open", 0, ms) if errors >= self.most else ("closed", errors, since)), ended
        return state, ended

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.stage.get()) if self.stage.exists() else ("closed", 0, 0)
        spans = sorted((int(m), str(i), bool(e)) for batch in rows for m, i, e in zip(batch["ms"], batch["span_id"], batch["error"]))
        found = []
        for ms, _, error in spans:
            state, ended = self._step(state, ms, error)
            found += [(key[0], *e) for e in ended]
        self.stage.update(state)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state[0] == "open":
            self.handle.registerTimer(state[2] + self.cooldown_ms)
        yield from _rows(found)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, ended = self._at(tuple(self.stage.get()), expiredTimerInfo.getExpiryTimeInMs())
        self.stage.update(state)
        yield from _rows([(key[0], *e) for e in ended])

    def close(self) -> None:
        pass


def streaks(spans: DataFrame, most: int = 3, cooldown_ms: int = 30_000, late: str = "1 minute", time: str = "ts") -> DataFrame:
    """(name, state, start_ms, end_ms): the intervals in which stages were open or half open, from a stream of spans (name, span_id, status, ts).

    Spans of a stage are taken in the order of time, then span_id; a span that comes in a later batch than
    one after it is counted when it comes.
    """
    rows = spans.withWatermark(time, late).select(time, "name", F.col("span_id").cast("string").alias("span_id"), F.unix_millis(time).alias("ms"), (F.col("status") != "ok").alias("error"))
    return rows.groupBy("name").transformWithStateInPandas(Streaks(most, cooldown_ms), T._parse_datatype_string(OUT), "Append", "EventTime")
