"""Rows that no judge looked at match nothing: what they repeat is not looked for."""

from pyspark.sql import functions as F

from tarn.operators import gates, lifecycle


def test_unjudged_rows_are_not_joined(spark):
    row = "id string, page_id long, title string, company string, location string, compensation string, content_key string, first_seen_at date, notified_at date, filter_status string, fallback string"
    rows = spark.sql("select * from values ('a', 1L, 'red', 'x', 'Nation 1', '', 'k', date'2001-01-01', null, 'pending', null), ('b', 1L, 'blue', '', '', '', 'k', date'2001-01-02', date'2001-01-02', 'matched', null) "
                     f"as t({', '.join(c.split()[0] for c in row.split(', '))})")  # fmt: skip
    config = lifecycle.Config(gates.Profile(title_keywords="red", roles="red"))
    out = lifecycle.screened(rows, config)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r for r in out.collect()}
    assert got["a"].filter_status == "pending" and got["a"].duplicate_of is None and got["b"].filter_status == "matched"
    said = lifecycle.screened(rows, config, judge=F.struct(F.lit("match").alias("verdict"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("title_mismatch")))
    assert out.schema == said.schema and {r.id: r.filter_status for r in said.collect()} == {"a": "matched", "b": "matched"}
