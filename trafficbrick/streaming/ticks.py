"""Windows without traffic on a stream (F2, E10): one row for every window, on time.

A processor keeps the end of the window that is due next and an event-time timer for it.
When the watermark passes it, the timer emits a tick for that window and for every later one
that has ended as well, whether packets came or not, and is set again. The watermark may be
driven by traffic that the summary itself leaves out.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

_OUT = "window_close timestamp, start bigint, end bigint"


def window_clock() -> StatefulProcessor:
    """The processor of the ticks (a class that travels by value, see :mod:`trafficbrick.streaming.vote`)."""

    class WindowClock(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.due = handle.getValueState("due", "end bigint, step bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
            seen = [(int(p["end"].min()), int((p["end"] - p["start"]).iloc[0])) for p in rows if len(p)]
            end, step = min(seen)
            now = timerValues.getCurrentWatermarkInMs() * 1000
            held = self.due.get() if self.due.exists() else None
            if end > now and (held is None or end < held[0]):
                if held is not None:
                    self.handle.deleteTimer(-(-held[0] // 1000))
                self.due.update((end, step))
                self.handle.registerTimer(-(-end // 1000))
            return
            yield

        def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            end, step = self.due.get()
            now = timerValues.getCurrentWatermarkInMs() * 1000
            ends = list(range(end, now + 1, step))
            due = ends[-1] + step if ends else end
            self.due.update((due, step))
            self.handle.registerTimer(-(-due // 1000))
            if ends:
                yield pd.DataFrame({"window_close": pd.to_datetime([e - 1 for e in ends], unit="us"),
                                    "start": [e - step for e in ends], "end": ends})

        def close(self) -> None:
            pass

    return WindowClock()


def window_ticks(windowed: DataFrame) -> DataFrame:
    """``start, end`` (microseconds) of every window from the first with rows on, emitted once the
    watermark has passed its end. ``windowed`` has a ``window`` under a watermark; each window
    reaches the processor once."""
    once = (windowed.select("window").dropDuplicates(["window"])
                    .select("window", F.unix_micros("window.start").alias("start"), F.unix_micros("window.end").alias("end"),
                            F.lit(0).alias("clock")))
    return once.groupBy("clock").transformWithStateInPandas(window_clock(), _OUT, "append", "EventTime",
                                                            eventTimeColumnName="window_close")
