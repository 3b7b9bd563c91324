"""The stored postings, in buckets of pages: a run rewrites the buckets that it touches and no other.

The table is partitioned by (bucket, batch). A run of batch n reads, of each bucket that it touches, the rows of the latest batch
before n, and writes them again as (bucket, n) with dynamic partition overwrite. So a run that is lost half-way and made
again starts from the same rows and overwrites what it had written; buckets that it does not touch keep their batch.
Of each bucket the last KEPT batches stay, so that readers that began before a run can end; older ones expire.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.operators.lifecycle import Config
from tarn.streaming.poll import INTERVAL, STATE, run_batch

BUCKETS, KEPT = 64, 2
_SENT = ["id", "content_key", "first_seen_at", "notified_at"]


class Buckets:
    """A table of rows with a key, dealt by it into buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str = STATE, key: str = "page_id", buckets: int = BUCKETS, kept: int = KEPT):
        self.spark, self.path, self.schema, self.key, self.buckets, self.kept = spark, path, schema, key, buckets, kept

    def of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> dict[int, list[int]]:
        """The batches that are there, ascending, by bucket: names of folders, as many as buckets times those kept."""
        out: dict[int, list[int]] = {}
        root, fs = self._folder(self.path)
        for bucket in fs.listStatus(root) if fs.exists(root) else []:
            name = bucket.getPath().getName()
            if name.startswith("bucket="):
                found = [b.getPath().getName() for b in fs.listStatus(bucket.getPath())]
                out[int(name[7:])] = sorted(int(b[6:]) for b in found if b.startswith("batch="))
        return out

    def read(self, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of every bucket's (of only these buckets') latest batch, or of the latest before one."""
        current = []
        for bucket, found in self.batches().items():
            found = [b for b in found if before is None or b < before]
            if found and (only is None or bucket in only):
                current.append(f"{self.path}/bucket={bucket}/batch={found[-1]}")
        return self.spark.read.schema(self.schema).parquet(*sorted(current)) if current else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.of(F.col(self.key))).distinct().collect()}  # as many as buckets at most

    def write(self, rows: DataFrame, batch: int) -> None:
        """rows as the given batch of the buckets that they are in."""
        dealt = rows.withColumn("bucket", self.of(F.col(self.key))).withColumn("batch", F.lit(batch)).repartition("bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)

    def expire(self, batch: int) -> None:
        """Deletes, of each bucket, what is older than the last kept batches up to this one."""
        for bucket, found in self.batches().items():
            for old in [b for b in found if b <= batch][: -self.kept]:
                folder, fs = self._folder(f"{self.path}/bucket={bucket}/batch={old}")
                fs.delete(folder, True)


def clock(spark: SparkSession, path: str, batch: int, now: Callable[[], str]) -> str:
    """The time of a batch: now, the first time it is asked for, and the same again if the batch is run again."""
    place = f"{path}/batch={batch}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([(now(),)], "at string").coalesce(1).write.mode("overwrite").parquet(place)
    return spark.read.schema("at string").parquet(place).first()[0]


def run_touched(state: Buckets, crawl: DataFrame, batch: int, now: Column, config: Config, judge: Column | None = None) -> set[int]:
    """One run over a crawl: of the state, only the buckets of its pages are read in full and written. What was sent from
    other buckets counts for duplicates; four columns of it are read. Gives the buckets written."""
    touched = state.touched(crawl)
    if touched:
        held: list[DataFrame] = []

        def cut(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return held[-1]

        others = set(range(state.buckets)) - touched
        sent = state.read(batch, others).select(*_SENT).filter("notified_at is not null")
        state.write(run_batch(state.read(batch, touched), crawl, now, config, judge, cut, sent), batch)
        for df in held:
            df.unpersist()
    state.expire(batch)
    return touched


def start(crawls: DataFrame, state: Buckets, config: Config, checkpoint: str, now: Callable[[], str], judge: Column | None = None, once: bool = False) -> StreamingQuery:
    """Runs every INTERVAL over a stream of crawl rows, or over what is there, once."""

    def run(batch: DataFrame, number: int) -> None:
        at = clock(state.spark, f"{checkpoint}-clock", number, now)
        run_touched(state, batch.persist(), number, F.lit(at).cast("timestamp"), config, judge)
        batch.unpersist()

    writer = crawls.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()
