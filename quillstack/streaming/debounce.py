"""Trailing debounce with bypass, and inactivity, as one stateful stream with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.sessions import TIMEOUT

#: What a stream of ``debounce_stream`` needs of its session: a state store that has timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _schema(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


class Debounce(StatefulProcessor):
    """Per user: the events that still wait, by time, and the time of the last one.

    Every event sets a timer at the end of its wait. When the watermark is past it no event from within the wait can
    come any more, so the event counts if none is there; and a user of whom nothing came for ``timeout`` ms has expired.
    """

    def __init__(self, user: str, wait: int, timeout: int):
        self.user, self.wait, self.timeout = user, wait, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _schema("at", "event_id"))
        self.active = handle.getListState("active", _schema("at"))

    def _out(self, key, rows: list[tuple]) -> Iterator[Row]:
        for event, kind, at in rows:
            yield Row(**{self.user: key[0], "event_id": event, "kind": kind, "at": at})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at_once, waiting, times = [], [], set()
        for row in rows:
            times.add(row.event_ms)
            if row.at_once:
                at_once.append((row.event_id, "immediate", row.event_ms))
            else:
                waiting.append((row.event_ms, row.event_id))
        for at in {at for at, _ in waiting}:
            self.handle.registerTimer(at + self.wait + 1)
        if waiting:
            self.waiting.appendList(waiting)
        # Times of activity that may still end a session: those not followed by another one within the timeout are few.
        known = sorted(times | {r[0] for r in self.active.get()})
        self.active.put([(at,) for at in self._ends(known)])
        for at in times:
            self.handle.registerTimer(at + self.timeout + 1)
        yield from self._out(key, at_once)

    def _ends(self, times: list[int]) -> list[int]:
        """Times after which nothing is known for the timeout; the others can't end a session whatever comes."""
        return [a for a, b in zip(times, [*times[1:], None], strict=True) if b is None or b - a >= self.timeout]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting, out, left = sorted((r[0], r[1]) for r in self.waiting.get()), [], []
        for k, (at, event) in enumerate(waiting):
            if at + self.wait >= now:
                left.append((at, event))
            elif k + 1 == len(waiting) or waiting[k + 1][0] - at >= self.wait:
                out.append((event, "settled", at))
        if len(left) < len(waiting):
            self.waiting.put(left) if left else self.waiting.clear()
        active = [r[0] for r in self.active.get()]
        ended = [at for at in active if at + self.timeout < now]
        if ended:
            rest = [(at,) for at in active if at + self.timeout >= now]
            self.active.put(rest) if rest else self.active.clear()
            out += [(None, "expired", at) for at in ended]
        yield from self._out(key, out)

    def close(self) -> None:
        pass


def debounce_stream(events: DataFrame, user: str = "user_id", ts: str = "ts", event: str = "event_id", wait_ms: int = 1000, timeout_ms: int = TIMEOUT, late: str = "1 hour", bypass: Column | None = None) -> DataFrame:
    """(user, ts, event) stream -> user, event_id, kind, at, in append mode.

    ``settled`` are the events after which the user is quiet for ``wait_ms``; ``immediate`` those where ``bypass`` holds,
    which count at once and neither end nor prolong the wait of the others; ``expired`` (event_id null) says that
    nothing came for ``timeout_ms`` after ``at``. The first and the last are given out once the watermark, ``late`` behind the newest event, is past
    the wait; later events are dropped. Rows with a null user, time or event are left out. The session must use ``STORE``.
    """
    at_once = F.lit(False) if bypass is None else F.coalesce(bypass, F.lit(False))
    rows = events.filter(F.col(user).isNotNull() & F.col(ts).isNotNull() & F.col(event).isNotNull())
    rows = rows.select(F.col(user), F.col(ts).cast("timestamp").alias("event_time"), F.col(event).cast("long").alias("event_id"), at_once.alias("at_once"))
    timed = rows.withColumn("event_ms", F.unix_millis("event_time")).withWatermark("event_time", late)
    kind = timed.schema[user].dataType.simpleString()
    out = timed.groupBy(user).transformWithState(Debounce(user, wait_ms, timeout_ms), f"`{user}` {kind}, event_id long, kind string, at long", "Append", "EventTime")
    return out.withColumn("at", F.timestamp_millis("at"))
