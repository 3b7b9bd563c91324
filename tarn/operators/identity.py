"""Which rows are the same posting: within a crawl, across crawls, and across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import ascii_text, norm_text
from tarn.functions.url import dedupe_key, stored_form

HORIZON = "INTERVAL 14 DAYS"


def title_key(title: Column, company: Column, location: Column) -> Column:
    """The key of a posting without an address."""
    n = lambda c: norm_text(F.coalesce(c, F.lit("")))
    return F.concat(F.lit("t:"), n(title), F.lit("|c:"), n(company), F.lit("|l:"), n(location))


def posting_key(canonical: Column, title: Column, company: Column, location: Column) -> Column:
    return F.coalesce(dedupe_key(canonical), title_key(title, company, location))


def content_key(title: Column, company: Column) -> Column:
    """title|company, or null if either has no word."""
    t, c = norm_text(title), norm_text(company)
    return F.when((t != "") & (c != ""), F.concat(t, F.lit("|"), c))


def stored_content_key(title: Column, company: Column) -> Column:
    """The form that stored rows were given: ASCII only, and an empty company part is allowed."""
    t, c = ascii_text(title), ascii_text(company)
    return F.when((F.trim(company) != "") & (t != ""), F.concat(t, F.lit("|"), c))


def first_of_crawl(rows: DataFrame) -> DataFrame:
    """The first row (by pos) of each page_id and dedupe_key."""
    order = Window.partitionBy("page_id", "dedupe_key").orderBy("pos")
    return rows.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def new_rows(crawl: DataFrame, existing: DataFrame) -> DataFrame:
    return crawl.join(existing.select("page_id", "dedupe_key"), ["page_id", "dedupe_key"], "left_anti")


def repairs(crawl: DataFrame, existing: DataFrame) -> DataFrame:
    """id, url, link_source, link_note, link_score of the stored rows whose link the crawl corrects."""
    new = crawl.select("page_id", "dedupe_key", *[F.col(c).alias(f"new_{c}") for c in ("url", "link_source", "link_note", "link_score")])
    met = existing.join(new, ["page_id", "dedupe_key"])
    return met.filter(~F.col("url").eqNullSafe(F.col("new_url")) | (F.col("link_source") == "unknown")).select(
        "id", *[F.col(f"new_{c}").alias(c) for c in ("url", "link_source", "link_note", "link_score")]
    )


def _two_earliest(sent: DataFrame, *by: str) -> DataFrame:
    """The two lowest (dup_at, dup_id) of each group: one of them is another row than the one that asks."""
    order = Window.partitionBy(*by).orderBy("dup_at", "dup_id")
    return sent.withColumn("rn", F.row_number().over(order)).filter("rn <= 2").drop("rn")


def duplicates(rows: DataFrame, now: Column | None = None, asked: DataFrame | None = None) -> DataFrame:
    """id, duplicate_of: for each row (of `asked`, if it is given: some of the rows) the earliest other one of its content_key that was notified within the
    horizon before `now`; without it, within the horizon before the row's own first_seen_at.

    rows: id, content_key, first_seen_at, notified_at. With a common `now` each key is first reduced to its
    two earliest rows. Without it, what a row asks for is the next one sent from fourteen days before it on: rows sent and
    rows asking are put in one order of time, and a running window carries the nearest one sent, so the work is linear in a key's
    rows. Keys are dealt by fortnights, so that a popular one is spread over time.
    """
    asked = (rows if asked is None else asked).filter("content_key is not null").select("id", "content_key", F.col("first_seen_at").alias("at"))
    sent = rows.filter("content_key is not null and notified_at is not null").select("content_key", F.col("id").alias("dup_id"), F.col("notified_at").alias("dup_at"))
    if now is not None:
        met = asked.join(_two_earliest(sent.filter(F.col("dup_at") >= now - F.expr(HORIZON)), "content_key"), "content_key").filter("id != dup_id")
        return met.groupBy("id").agg(F.min(F.struct("dup_at", "dup_id")).alias("m")).select("id", F.col("m.dup_id").alias("duplicate_of"))
    stamp = lambda c: F.unix_micros(c.cast("timestamp"))
    fortnight = lambda t: F.floor(F.col(t) / (14 * 86_400_000_000)).cast("long")
    own = sent.select("content_key", stamp(F.col("dup_at")).alias("time"), F.col("dup_id").alias("sent_id"))
    after = F.lead(F.struct("time", "sent_id")).over(Window.partitionBy("content_key", "period").orderBy("time", "sent_id"))
    # A row sent is in its own fortnight and in the one before: what is asked for begins in one of them.
    own = own.withColumn("period", F.explode(F.array(fortnight("time"), fortnight("time") - 1)))
    own = own.select("content_key", "period", "time", "sent_id", F.struct(F.struct("time", "sent_id").alias("own"), after.alias("next")).alias("sent"))
    question = asked.filter("at is not null").select("content_key", stamp(F.col("at") - F.expr(HORIZON)).alias("time"), "id", stamp(F.col("at")).alias("until")).withColumn("period", fortnight("time"))
    both = own.unionByName(question, allowMissingColumns=True)
    latest_first = Window.partitionBy("content_key", "period").orderBy(F.desc("time"), F.col("sent_id").isNull(), F.desc("sent_id")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("nearest", F.last("sent", ignorenulls=True).over(latest_first)).filter("id is not null")
    found = F.when(F.col("nearest.own.sent_id") == F.col("id"), F.col("nearest.next")).otherwise(F.col("nearest.own"))
    return met.withColumn("found", found).filter("found.time <= until").select("id", F.col("found.sent_id").alias("duplicate_of"))


def first_of_batch(rows: DataFrame) -> Column:
    """Whether a row is the first of its content_key within one batch: what is sent later is a duplicate of it."""
    order = Window.partitionBy(F.coalesce("content_key", F.concat(F.lit("\0"), F.col("id")))).orderBy("first_seen_at", "id")
    return F.row_number().over(order) == 1


def survivors(rows: DataFrame) -> DataFrame:
    """The rows that stay when stored rows are merged by their stored form: notified ones first, then the
    earliest. rows: id, page_id, url, dedupe_key, first_seen_at, notified_at."""
    form = F.regexp_replace(stored_form(F.col("url")), "/$", "")
    keyed = rows.withColumn("group_key", F.lower(F.coalesce(F.nullif(form, F.lit("")), F.col("dedupe_key"))))
    order = Window.partitionBy("page_id", "group_key").orderBy(F.col("notified_at").isNull(), "first_seen_at", "id")
    return keyed.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def backfilled_keys(rows: DataFrame) -> DataFrame:
    """rows with dedupe_key replaced by their stored form where no other row of the page has that key.

    How many rows have a key is counted from (page_id, dedupe_key) alone, and joined to the pair of page and new key.
    """
    form = F.nullif(F.regexp_replace(F.lower(stored_form(F.col("url"))), "/$", ""), F.lit(""))
    holders = rows.groupBy("page_id", F.col("dedupe_key").alias("new_key")).agg(F.count(F.lit(1)).alias("holders_"))
    met = rows.withColumn("new_key", form).join(holders, ["page_id", "new_key"], "left")
    others = F.coalesce("holders_", F.lit(0)) - (F.col("dedupe_key") == F.col("new_key")).cast("int")
    taken = F.col("new_key").isNull() | (F.coalesce(others, F.col("holders_"), F.lit(0)) > 0)
    return met.select(*[F.when(taken, F.col("dedupe_key")).otherwise(F.col("new_key")).alias(c) if c == "dedupe_key" else F.col(c) for c in rows.columns])
