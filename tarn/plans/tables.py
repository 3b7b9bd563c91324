"""The tables that queries read, and the posting and page views that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per line item, with a state made of its keys: a stand-in for a postings table of any size."""
    line, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    joined = (
        line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
    )
    page = F.col("l_suppkey") % 50
    kind = F.col("l_linenumber") % 4
    status = F.when(kind == 0, "pending").when(kind == 1, "matched").when(kind == 2, "filtered").otherwise("skipped")
    text = lambda c: F.col(c).cast("string")
    return joined.select(
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("id"),
        page.alias("page_id"),
        F.concat("p_name", F.lit(" "), "p_type").alias("title"),
        F.col("s_name").alias("company"),
        F.col("n_name").alias("location"),
        F.concat(F.lit("$"), F.floor("l_extendedprice").cast("string")).alias("compensation"),
        F.col("l_shipdate").alias("first_seen_at"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("notified_at"),
        F.concat(F.lit("https://b"), page.cast("string"), F.lit(".example.com/jobs/"), text("l_partkey"), F.lit("?utm_source=f&id="), text("l_suppkey")).alias("url"),
        status.alias("filter_status"),
        F.when(F.col("l_partkey") % 4 == 0, "none").when(F.col("l_partkey") % 4 == 1, "pending").when(F.col("l_partkey") % 4 == 2, "ok").otherwise("warned").alias("company_status"),
        (F.col("l_returnflag") == "A").alias("pending_notify"),
        F.when(F.col("l_suppkey") % 11 == 0, F.concat(F.lit("dup-"), text("l_partkey"))).alias("duplicate_of"),
        ((kind == 2) & (F.col("l_partkey") % 2 == 0)).alias("keyword_filtered"),
        ((kind == 2) & (F.col("l_partkey") % 6 == 1)).alias("negative_keyword_filtered"),
        F.when(F.col("l_suppkey") % 3 == 0, "none").when(F.col("l_suppkey") % 3 == 1, "cited").otherwise("matched").alias("link_source"),
    )


#: The same view for the SQL side.
POSTINGS_SQL = """
postings_v AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y-%m-%d') AS id,
         l_suppkey % 50 AS page_id, p_name || ' ' || p_type AS title, s_name AS company, n_name AS location,
         '$' || CAST(floor(l_extendedprice) AS BIGINT) AS compensation, l_shipdate AS first_seen_at,
         CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS notified_at,
         'https://b' || (l_suppkey % 50) || '.example.com/jobs/' || l_partkey || '?utm_source=f&id=' || l_suppkey AS url,
         CASE l_linenumber % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'matched' WHEN 2 THEN 'filtered' ELSE 'skipped' END AS filter_status,
         CASE l_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'pending' WHEN 2 THEN 'ok' ELSE 'warned' END AS company_status,
         l_returnflag = 'A' AS pending_notify, CASE WHEN l_suppkey % 11 = 0 THEN 'dup-' || l_partkey END AS duplicate_of,
         (l_linenumber % 4 = 2 AND l_partkey % 2 = 0) AS keyword_filtered, (l_linenumber % 4 = 2 AND l_partkey % 6 = 1) AS negative_keyword_filtered,
         CASE l_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'cited' ELSE 'matched' END AS link_source
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One watched page per supplier, with a crawl state made of its key."""
    key = F.col("s_suppkey")
    at = lambda hours: F.lit("2024-02-01 00:00:00").cast("timestamp") - F.make_interval(hours=hours)
    return table(spark, sf_dir, "supplier").select(
        key.alias("page_id"), F.concat(F.lit("https://www."), F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", "")), F.lit(".example.com/jobs")).alias("url"),
        F.col("s_name").alias("label"), (key % 7 != 0).alias("active"), (key % 9).cast("int").alias("failure_count"),
        F.when(key % 5 != 0, at((key % 11).cast("int"))).alias("last_checked_at"), at((key % 300).cast("int")).alias("created_at"),
        F.when(key % 6 == 0, at((key % 2).cast("int"))).alias("poll_claimed_at"), (key % 4 != 0).alias("first_crawl_done"),
        F.when(key % 13 == 0, "HTTP 403 from the site").when(key % 13 == 1, "timeout after 15 s").alias("last_error"),
    )


SOURCES_SQL = """
sources_v AS (
  SELECT s_suppkey AS page_id, 'https://www.' || lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) || '.example.com/jobs' AS url, s_name AS label,
         s_suppkey % 7 <> 0 AS active, CAST(s_suppkey % 9 AS INTEGER) AS failure_count,
         CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '2024-02-01 00:00:00' - to_hours(s_suppkey % 11) END AS last_checked_at,
         TIMESTAMP '2024-02-01 00:00:00' - to_hours(s_suppkey % 300) AS created_at,
         CASE WHEN s_suppkey % 6 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' - to_hours(s_suppkey % 2) END AS poll_claimed_at,
         s_suppkey % 4 <> 0 AS first_crawl_done,
         CASE s_suppkey % 13 WHEN 0 THEN 'HTTP 403 from the site' WHEN 1 THEN 'timeout after 15 s' END AS last_error
  FROM supplier)
"""
