"""Lookups as a stream with memory: what was found is kept, a miss is remembered for some time.

Each key's state is what its last answer was and until when that holds.  A request for a key that is
known is answered from the state; any other is passed on to be asked, once.  A miss and an open
question are forgotten when their time is over, told by the requests' own times: a request after that
is asked again, and a timer on the watermark frees the state of keys that nobody asks for any more.
A request that comes later than the watermark allows is dropped.  The state lives in RocksDB and resumes from the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

DAY = 86_400_000
TTL = 30 * DAY
OUT = "key string, at bigint, action string, value string"
FOREVER = (1 << 63) - 1
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Memory(StatefulProcessor):
    """``ttl`` and ``open_for``: how long a miss and an open question hold, in milliseconds."""

    def __init__(self, ttl: int, open_for: int):
        self.ttl, self.open_for = ttl, open_for

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "kind string, value string, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # of one time, answers come before requests
        events = sorted((at, kind != "answer", kind, value) for f in rows for at, kind, value in zip(f["at"].tolist(), f["kind"], f["value"].where(f["value"].notna(), None)))
        kind, value, until = self.known.get() if self.known.exists() else ("", None, -FOREVER)
        out, before = [], until
        for at, _, event, found in events:
            if event == "answer":
                kind, value, until = ("miss", None, at + self.ttl) if found is None else ("found", found, FOREVER)
            elif at < until:
                out.append((key[0], at, kind, value))
            else:
                kind, value, until = "open", None, at + self.open_for
                out.append((key[0], at, "ask", None))
        self.known.update((kind, value, until))
        if until not in (before, FOREVER):
            self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=["key", "at", "action", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.known.exists() and self.known.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.known.clear()
        yield pd.DataFrame([], columns=["key", "at", "action", "value"])

    def close(self) -> None:
        pass


def remembered(events: DataFrame, late: str = "1 day", ttl: int = TTL, open_for: int = TTL) -> DataFrame:
    """``key, at, action, value`` for each request of a stream: ask, or found, miss or open from memory.

    ``events`` has ``key, at`` (milliseconds), ``kind`` (request or answer) and ``value`` (an answer's,
    null for a miss).  Rows without a key or time are none.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    timed = events.where("key IS NOT NULL AND at IS NOT NULL").select("key", "at", "kind", F.col("value").cast("string").alias("value"), F.timestamp_millis("at").alias("time")).withWatermark("time", late)
    return timed.groupBy("key").transformWithStateInPandas(Memory(ttl, open_for), OUT, "Append", "EventTime")


def written(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream's rows to Parquet files, each batch once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events from JSON lines."""
    return spark.readStream.schema("key string, at bigint, kind string, value string").option("maxFilesPerTrigger", files_per_trigger).json(path)
