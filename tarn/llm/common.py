"""What several operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes per Arrow batch: a batch of very long texts must still fit beside the JVM heap.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes. These are settings of the
    session, read when a plan runs; they are only ever lowered."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", spark.conf.get(key, str(most))) or most)
        if now > most or now <= 0:
            spark.conf.set(key, str(most))


def capped_batches(spark: SparkSession) -> None:
    """As small_batches, which leaves Spark's own defaults (10 000 rows, 64 MB) as they are: these count too."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if now > most or now <= 0:
            spark.conf.set(key, str(most))


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind: they go when its action ends, not when the driver collects garbage.
    No table may be computed twice inside; those that are read again are materialised."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Only a local master, as in tests, may do without:
    it gets a temporary one. Elsewhere executors would write to different disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tarn-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor costs no recomputation, and
    what is read twice is made once. The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def total(columns: Iterable[Column]) -> Column:
    """The sum of columns, as a balanced tree."""
    level = list(columns)
    while len(level) > 1:
        level = [level[i] + level[i + 1] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]
