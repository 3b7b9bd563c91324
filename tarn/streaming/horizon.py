"""Duplicates over a stream: each content key's sent rows are kept for fourteen days, and what is asked about a key is answered
from them once the watermark says that nothing earlier can come.

The answers are those of identity.duplicates over all rows, however the stream is split into batches and in whatever order rows
come within the watermark's delay: a question waits, as a timer of its key, for the watermark to pass its own time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HORIZON_US, DELAY = 14 * 86_400 * 1_000_000, "1 hour"
ANSWERS = "id string, duplicate_of string"
_EVENT = "at long, id string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(rows: DataFrame) -> DataFrame:
    """id, content_key, first_seen_at, notified_at to events (content_key, time, at in microseconds, kind, id): a question at a row's
    first sight, and a fact when it was sent. Rows without a key ask nothing and answer nothing."""
    stamp = lambda c: F.col(c).cast("timestamp")
    asked = F.struct(stamp("first_seen_at").alias("time"), F.lit("asked").alias("kind"))
    sent = F.when(F.col("notified_at").isNotNull(), F.struct(stamp("notified_at").alias("time"), F.lit("sent").alias("kind")))
    rows = rows.filter("content_key is not null and first_seen_at is not null").select("id", "content_key", F.explode(F.array_compact(F.array(asked, sent))).alias("e"))
    return rows.select("content_key", "e.time", F.unix_micros("e.time").alias("at"), "e.kind", "id")


class Horizon(StatefulProcessor):
    """State of a content key: what was sent within the horizon of any open or future question, and the open questions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getListState("sent", _EVENT)
        self.asked = handle.getListState("asked", _EVENT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for state, kind in ((self.sent, "sent"), (self.asked, "asked")):
                some = batch[batch["kind"] == kind]
                if len(some):
                    state.appendList([(int(a), i) for a, i in zip(some["at"], some["id"])])
                    if kind == "asked":
                        for at in {int(a) // 1000 + 1 for a in some["at"]}:  # past the time itself
                            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        asked, sent = [tuple(x) for x in self.asked.get()], sorted(tuple(x) for x in self.sent.get())
        due, later = [x for x in asked if x[0] < now], [x for x in asked if x[0] >= now]
        out = []
        for at, i in due:
            found = next((other for time, other in sent if at - HORIZON_US <= time <= at and other != i), None)
            if found is not None:
                out.append((i, found))
        oldest = min([now, *(x[0] for x in later)]) - HORIZON_US
        self._keep(self.asked, later)
        self._keep(self.sent, [x for x in sent if x[0] >= oldest])
        return iter((pd.DataFrame(out, columns=["id", "duplicate_of"]),) if out else ())

    @staticmethod
    def _keep(state: Any, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    def close(self) -> None:
        pass


def duplicates_stream(rows: DataFrame, delay: str = DELAY) -> DataFrame:
    """id, duplicate_of over a stream of rows (see events): appended when the watermark has passed a row's first sight."""
    use_rocksdb(rows.sparkSession)
    keyed = events(rows).withWatermark("time", delay).groupBy("content_key")
    return keyed.transformWithStateInPandas(Horizon(), ANSWERS, "Append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; it also keeps state outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
