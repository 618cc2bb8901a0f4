"""Structured Streaming forms of the keyed operators."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import FOLDED, IDLE_MINUTES, Inquiry, advance, folded_row, lease_step

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that the processors below need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def deduplicated(events: DataFrame, key: str, at: str, watermark: str = "1 day") -> DataFrame:
    """Each key once within the watermark; the store forgets older ones."""
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])


def _ms(at) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


class _Timed(StatefulProcessor):
    """State that a timer of event time clears `keep` milliseconds after its last event."""

    keep: int

    def _again(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Fold(_Timed):
    """The inquiry of one user, message after message, by the same transition as the batch form."""

    def __init__(self, user: str, minutes: int):
        self.user, self.keep = user, minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("inquiry", "value string, turn int, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        inquiry, turn, last = (Inquiry(**json.loads(held[0])), held[1], held[2]) if held else (Inquiry(), 0, None)
        out = []
        # One trigger's messages of one user, of which the source admits so many at a time.
        for at, text in pd.concat(list(rows)).sort_values(["at", "t"], kind="stable")[["at", "t"]].itertuples(index=False):
            now = _ms(at)
            idle = last is not None and now - last > self.keep
            turn = 0 if idle else turn
            inquiry = advance(inquiry, text, idle)
            out.append((key[0], *folded_row(at, turn, inquiry)))
            turn, last = turn + 1, now if last is None else max(last, now)
        self.state.update((json.dumps(asdict(inquiry)), turn, last))
        self._again(last)
        yield pd.DataFrame(out, columns=[self.user, *(c.split()[0] for c in FOLDED.split(", "))])


def inquiry_stream(messages: DataFrame, user: str, at: str, text: str, minutes: int = IDLE_MINUTES, watermark: str = "10 minutes") -> DataFrame:
    """The fold of a stream: what inquiry_fold gives for messages that come in order.

    A user who is silent for `minutes` is forgotten once the watermark has passed that; messages later than the watermark
    are dropped.
    """
    kind = messages.schema[user].dataType.simpleString()
    rows = messages.where(f"{user} is not null").selectExpr(f"{user} as u", f"cast({at} as timestamp) as at", f"{text} as t").withWatermark("at", watermark)
    return rows.groupBy("u").transformWithStateInPandas(_Fold(user, minutes), f"`{user}` {kind}, {FOLDED}", "Append", "EventTime")


class _Lease(_Timed):
    """Who may work on an update: events are claim, complete and fail; a claim holds for some seconds."""

    def __init__(self, seconds: int, keep_seconds: int):
        self.seconds, self.keep = seconds, keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "status string, claimed double, attempts int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else ("", 0.0, 0)
        out = []
        for event, at in pd.concat(list(rows)).sort_values("at", kind="stable")[["event", "at"]].itertuples(index=False):
            held, granted = lease_step(held, event, at.timestamp(), self.seconds)
            out.append((key[0], event, at, granted, held[0], held[2]))
        self.state.update(held)
        self._again(_ms(out[-1][2]))
        yield pd.DataFrame(out, columns=["update_id", "event", "at", "granted", "status", "attempts"])


def lease_stream(events: DataFrame, seconds: int = 300, keep_seconds: int = 7 * 86_400, watermark: str = "10 minutes") -> DataFrame:
    """(update_id, event, at, granted, status, attempts) for a stream of (update_id, event, at).

    An update is forgotten `keep_seconds` after its last event, by which time its sender has long stopped to repeat it.
    """
    schema = f"update_id {events.schema['update_id'].dataType.simpleString()}, event string, at timestamp, granted boolean, status string, attempts int"
    return events.withWatermark("at", watermark).groupBy("update_id").transformWithStateInPandas(_Lease(seconds, keep_seconds), schema, "Append", "EventTime")
