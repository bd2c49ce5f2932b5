"""The sliding-log rate limiter on keyed state with timers: requests are decided in the order of their
own times, whatever order they arrive in.

A request waits in its key's state until the watermark has passed its time; a timer then decides it.
Requests of a key lie in stretches of a window's length, each with a timer at its first request that
decides all of them that the watermark has passed. Timers of a key fire in order, and each looks at one
stretch and at a log of at most `most` allowed times, so that neither a batch nor a key is ever held as a
whole; a call of the state serves all requests of a stretch. A last timer clears the log once a window has
passed without a request: a key that is gone leaves no state.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.streaming.jobs import MAX_REQUESTS, WINDOW_SECONDS

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Requests of a key that are put into its state together.
ROWS = 4096


def _ms(micros: int) -> int:
    """The first millisecond that is not before a time."""
    return -(-micros // 1000)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and maps of state need, for queries started inside."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


class SlidingLog(StatefulProcessor):
    """State of a key: requests waiting, by stretches of a window's length, and the times of those allowed
    within a window with the time of the timer that looks at them again."""

    def __init__(self, window: float, most: int):
        self.window, self.most = round(window * 1_000_000), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "cell long", "times array<long>")
        self.log = handle.getValueState("log", "times array<long>, again long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        while some := list(islice(rows, ROWS)):
            cells: dict[int, list[int]] = {}
            for row in some:
                cells.setdefault(_ms(row["micros"]) * 1000 // self.window, []).append(row["micros"])
            empty = not self.waiting.exists()
            for cell, times in cells.items():
                held = None if empty else self.waiting.getValue((cell,))
                old = list(held[0]) if held else []
                self.waiting.updateValue((cell,), (old + times,))
                if not old or min(times) < min(old):
                    self.handle.registerTimer(_ms(min(times)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        ms, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        state = self.log.get()
        log, again = (list(state[0]), state[1]) if state else ([], 0)
        cell = ms * 1000 // self.window
        held = self.waiting.getValue((cell,))
        times = sorted(held[0]) if held else []
        due = bisect_right(times, passed, key=_ms)
        for now in times[:due]:
            log = [t for t in log if t >= now - self.window]
            allowed = len(log) < self.most
            if allowed:
                log.append(now)
            yield Row(key=key[0], micros=now, allowed=allowed)
        if due == len(times) and due:
            self.waiting.removeKey((cell,))
        elif due:
            self.waiting.updateValue((cell,), (times[due:],))
            self.handle.registerTimer(_ms(times[due]))
        at = max([ms, *map(_ms, times[max(due - 1, 0) : due])])
        log = [t for t in log if t >= at * 1000 - self.window]
        if not log:
            self.log.clear()
            return
        if again <= at:
            # When the last of them has left the window, this looks again.
            again = _ms(log[-1]) + self.window // 1000 + 1
            self.handle.registerTimer(again)
        self.log.update((log, again))

    def close(self) -> None:
        pass


def limited_in_order(requests: DataFrame, window: float = WINDOW_SECONDS, most: int = MAX_REQUESTS, late: str = "10 seconds") -> DataFrame:
    """key, at, allowed for a stream of requests (key string, at timestamp), each once its time is past the
    watermark, which is `late` behind the latest time seen; what arrives later than that is dropped. Of
    requests at one time any may be the allowed ones. Start the query inside keyed_state."""
    timed = requests.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at")).where("key IS NOT NULL").withWatermark("at", late)
    asked = timed.withColumn("micros", F.unix_micros("at"))
    out = asked.groupBy("key").transformWithState(SlidingLog(window, most), "key string, micros long, allowed boolean", "append", "EventTime")
    return out.select("key", F.timestamp_micros("micros").alias("at"), "allowed")
