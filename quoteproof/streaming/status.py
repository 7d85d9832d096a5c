"""The status machine over a stream: keyed state, events applied in the order of their time.

Events of a key wait in its state until the watermark has passed them, since an earlier one may still come; a timer at
the earliest waiting event then applies all that are due, in order. State is a key's status, its illegal events and what
waits; it lives in the state store, so a restart from the checkpoint goes on where it stopped. An event behind the
watermark is dropped by the engine, as the batch that it belongs to has been answered.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quoteproof.schema import TRANSITIONS

#: The state store that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class StatusMachine(StatefulProcessor):
    """key, at, nth, event in; key, status, illegal_steps out, whenever events have been applied."""

    def __init__(self, start: str, table=TRANSITIONS):
        self.start, self.to = start, {(e, a): b for e, a, b in table}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, illegal long")
        self.waiting = handle.getMapState("waiting", "at long, nth long", "event string")

    def handleInputRows(self, key, rows, timerValues):
        for batch in rows:
            times = batch["at"].astype("datetime64[us, UTC]" if batch["at"].dt.tz is not None else "datetime64[us]").astype("int64")
            for at, nth, event in zip(times, batch["nth"], batch["event"], strict=True):
                self.waiting.updateValue((int(at), int(nth)), (None if pd.isna(event) else event,))
                self.handle.registerTimer(-(-int(at) // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted((k, v[0]) for k, v in self.waiting.iterator() if k[0] <= due)
        if not ready:
            return
        status, illegal = self.now.get() or (self.start, 0)
        for place, event in ready:
            after = self.to.get((event, status))
            status, illegal = (status, illegal + 1) if after is None else (after, illegal)
            self.waiting.removeKey(place)
        self.now.update((status, illegal))
        yield pd.DataFrame({"key": [key[0]], "status": [status], "illegal_steps": [illegal]})

    def close(self) -> None:
        pass


def folded_stream(events: DataFrame, key: str, at: str, nth: str, event: str, start: str, table=TRANSITIONS, late: str = "1 hour") -> DataFrame:
    """key, status, illegal_steps after each batch in which events of the key became due; update mode.

    ``nth`` orders events of one time; events that are equal in key, time and ``nth`` are one event.
    """
    named = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(nth).cast("long").alias("nth"), F.col(event).alias("event"))
    kind = named.schema["key"].dataType.simpleString()
    return named.withWatermark("at", late).groupBy("key").transformWithStateInPandas(StatusMachine(start, table), f"key {kind}, status string, illegal_steps long", "Update", "EventTime")
