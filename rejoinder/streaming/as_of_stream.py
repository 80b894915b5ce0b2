"""An as-of join of two streams: each event with the latest row before it and the first one after it, by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Neighbours(StatefulProcessor):
    """State of a key: rows that an event may still need, and events that wait for the watermark.

    What was before an event is known once the watermark has passed it, and what comes after once it has passed the
    first later row, or the event's horizon without one. Timers stand at these times; nothing else keeps state.
    """

    def __init__(self, back: int, ahead: int):
        self.back, self.ahead = back, ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us long, id string")
        self.events = handle.getListState("events", "us long, id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for state, own in ((self.rows, part[~part["is_event"]]), (self.events, part[part["is_event"]])):
                if len(own):
                    state.appendList([(int(u), str(i)) for u, i in zip(own["us"], own["id"], strict=True)])
        yield from self.ready(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.ready(key, timerValues)

    def ready(self, key, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # what comes from now on isn't before this
        rows, events = (sorted((r[0], r[1]) for r in s.get()) if s.exists() else [] for s in (self.rows, self.events))
        out, wait, wake, i = [], [], set(), 0
        for us, id_ in events:
            while i < len(rows) and rows[i][0] < us:
                i += 1
            j = i
            while j < len(rows) and rows[j][0] == us:
                j += 1
            end = min(rows[j][0], us + self.ahead) if j < len(rows) else us + self.ahead
            if end < passed:
                pre = rows[i - 1] if i and us - rows[i - 1][0] <= self.back else None
                post = rows[j] if j < len(rows) and rows[j][0] - us <= self.ahead else None
                out.append((key[0], us, id_, pre and pre[1], post and post[1]))
            else:
                wait.append((us, id_))
                wake.add(max(end, 0) // 1000 + 1)
        least = min([passed, *(us for us, _ in wait)]) - self.back
        keep = [r for r in rows if r[0] >= least]
        for state, left, had in ((self.rows, keep, rows), (self.events, wait, events)):
            if not left:
                state.clear()
            elif len(left) < len(had):
                state.put(left)
        known = set(self.handle.listTimers())
        if wake and min(wake) not in known:
            self.handle.registerTimer(min(wake))  # when it rings all that the watermark has passed are ready
        if keep and not wait and (gone := (keep[-1][0] + self.back) // 1000 + 1) not in known:
            self.handle.registerTimer(gone)  # rows leave with the watermark too
        if out:
            yield pd.DataFrame(out, columns=["key", "us", "event_id", "pre_id", "post_id"])

    def close(self) -> None:
        pass


def as_of_stream(events: DataFrame, rows: DataFrame, key: str, at: str, id_: str, back: int = 48 * HOUR, ahead: int = 48 * HOUR, late: str = "1 hour") -> DataFrame:
    """key, us, event_id, pre_id, post_id of each event, once.

    Both streams have the columns key, at (a timestamp) and id_ (a text). pre is the latest row strictly before, at most
    ``back`` microseconds; post the first strictly after, at most ``ahead``; of rows at one time the largest id is the
    latest, the smallest the first. Times are after 1970 began. What comes later than ``late`` behind the newest time seen is dropped, rows and
    events alike; without such, the result is that of the batch join on the same rows, for all events whose horizon the
    watermark has passed. A key's state holds the rows of ``back`` before the watermark and the events that wait.
    """
    spark = events.sparkSession
    if spark.conf.get(STORE, None) != ROCKS:
        spark.conf.set(STORE, ROCKS)  # keyed state with timers is kept in no other
    own = [df.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.unix_micros(at).alias("us"), F.col(id_).cast("string").alias("id"), F.lit(e).alias("is_event")) for df, e in ((events, True), (rows, False))]
    both = own[0].unionByName(own[1]).filter("key is not null and at is not null").withWatermark("at", late)
    return both.groupBy("key").transformWithStateInPandas(Neighbours(back, ahead), "key string, us long, event_id string, pre_id string, post_id string", "Append", "EventTime")
