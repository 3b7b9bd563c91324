"""Micro-batches: one run of the monitor over what has been fetched, and the query that drives it.

State lives in versioned folders of one path: a run reads the latest complete version and writes the next,
so a lost run leaves the last one as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.operators.gates import VERDICT
from tarn.operators.identity import content_key, first_of_crawl
from tarn.operators.lifecycle import Config, first_status, outbox, screened, upsert

INTERVAL = "15 minutes"
STATE = (
    f"id string, page_id long, dedupe_key string, title string, company string, location string, compensation string, url string, link_source string, link_note string, "
    f"link_score double, content_key string, first_seen_at timestamp, last_seen_at timestamp, notified_at timestamp, filter_status string, filter_verdict {VERDICT}, "
    f"company_status string, pending_notify boolean, duplicate_of string, keyword_filtered boolean, negative_keyword_filtered boolean"
)


def run_batch(
    state: DataFrame, crawl: DataFrame, now: Column, config: Config, judge: Column | None = None, cut: Callable[[DataFrame], DataFrame] = DataFrame.persist,
    others: DataFrame | None = None,
) -> DataFrame:
    """The postings after one run. cut: what is done to the two intermediate tables that are read several
    times; they are persisted, and made anew where an executor that held them is lost. others: id, content_key,
    first_seen_at, notified_at of rows that are not part of the state and count as sent.

    crawl: page_id, pos, dedupe_key, title, company, location, compensation, url, link_source, link_note,
    link_score, first_crawl_done. Rows are keyed, upserted, screened and sent, in this order.
    """
    new = first_of_crawl(crawl).select(
        F.sha2(F.concat_ws("\u0001", "page_id", "dedupe_key"), 256).alias("id"), "page_id", "dedupe_key", "title", "company", "location", "compensation", "url", "link_source",
        "link_note", "link_score", content_key(F.col("title"), F.col("company")).alias("content_key"), now.alias("first_seen_at"), now.alias("last_seen_at"),
        F.lit(None).cast("timestamp").alias("notified_at"), first_status(F.col("first_crawl_done")).alias("filter_status"), F.lit(None).cast(VERDICT).alias("filter_verdict"),
        F.lit("none").alias("company_status"), F.lit(False).alias("pending_notify"), F.lit(None).cast("string").alias("duplicate_of"), F.lit(False).alias("keyword_filtered"),
        F.lit(False).alias("negative_keyword_filtered"),
    )
    rows = cut(upsert(state, cut(new), now))
    after = screened(rows.withColumn("fallback", F.lit(None).cast("string")), config, judge, others).drop("page_id")
    changed = [c for c in after.columns if c != "id"]
    rows = rows.join(after.select("id", *[F.col(c).alias(f"new_{c}") for c in changed]), "id")
    touched = F.col("new_filter_status") != F.col("filter_status")
    rows = rows.select(*[c for c in state.columns if c not in changed], *[F.when(touched, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in changed])
    rows = cut(rows)
    sent = outbox(rows, now, others).select("id", "send", F.col("duplicate_of").alias("dup"), F.lit(True).alias("queued"))
    rows = rows.join(sent, "id", "left").withColumn("queued", F.coalesce("queued", F.lit(False)))
    return rows.withColumns({
        "notified_at": F.when(F.col("send"), now).otherwise(F.col("notified_at")), "duplicate_of": F.coalesce("dup", "duplicate_of"), "pending_notify": F.col("pending_notify") & ~F.col("queued"),
    }).select(*state.columns)


class Versions:
    """Snapshots of a table in numbered folders; a version counts once its success mark is there. The last `kept`
    versions stay, so that a run that reads the one before can still end."""

    def __init__(self, spark: SparkSession, path: str, schema: str, kept: int = 3):
        self.spark, self.path, self.schema, self.kept = spark, path, schema, kept

    def _complete(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS")))

    def latest(self) -> int:
        return max(self._complete(), default=-1)

    def read(self) -> DataFrame:
        n = self.latest()
        return self.spark.createDataFrame([], self.schema) if n < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/v{n}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        for old in [n for n in self._complete() if n <= version - self.kept]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def start(crawls: DataFrame, state: Versions, config: Config, checkpoint: str, now: Callable[[], str], judge: Column | None = None, once: bool = False) -> StreamingQuery:
    """Runs every INTERVAL over a stream of crawl rows (or over what is there, once). A batch that is run
    again writes the same version again, from the one before it."""

    def run(batch: DataFrame, number: int) -> None:
        if number <= state.latest():
            return
        held: list[DataFrame] = []

        def cut(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        state.write(run_batch(state.read(), batch, F.lit(now()).cast("timestamp"), config, judge, cut), number)
        for df in held:
            df.unpersist()

    writer = crawls.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()


def ticks(events: DataFrame, at: str = "ts") -> DataFrame:
    """Counts and sums by tick of the poll, for a batch or a stream."""
    counted = events.groupBy(F.window(at, INTERVAL).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("tick"), "event_type", "n", "total")
