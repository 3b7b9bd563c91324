"""Batches that go to Python are small under Spark's own defaults too."""

from tarn.llm import language_model
from tarn.llm.common import BATCH_ROWS


def sizes(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])


def test_op7_sends_small_batches(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.unset(k)
    try:
        docs = spark.range(10, numPartitions=1).selectExpr("id as doc_id", "'a b c' as text")
        language_model.language_scores(docs).count()
        most = spark.range(3000, numPartitions=1).mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert most <= BATCH_ROWS
