"""The state of pages and postings from run to run, as pure transitions: every rule about time takes `now`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.display import BLOCKED_MESSAGE, LINK_WARNING
from tarn.operators import gates
from tarn.operators.identity import duplicates, first_of_batch

SCREEN, COMPANY, NOTIFY, RUN = 20, 10, 20, 4
STALE, BACKOFF, PROBE, FAILURES = "INTERVAL 3 MINUTES", "INTERVAL 3 HOURS", "INTERVAL 12 HOURS", 5


def is_blocked(error: Column) -> Column:
    return F.coalesce(error.rlike("(?i)blocked by anti-bot check|access denied|HTTP 403"), F.lit(False))


def in_backoff(failures: Column, last_checked: Column, now: Column) -> Column:
    return F.coalesce((failures >= FAILURES) & (last_checked > now - F.expr(BACKOFF)), F.lit(False))


def claimable(claimed_at: Column, now: Column) -> Column:
    return claimed_at.isNull() | (claimed_at < now - F.expr(STALE))


def worklist(pages: DataFrame, now: Column) -> DataFrame:
    """The pages that are due, the longest unchecked first, with turn (from 1) and batch (from 0)."""
    due = pages.filter(F.col("active") & claimable(F.col("poll_claimed_at"), now) & ~in_backoff(F.col("failure_count"), F.col("last_checked_at"), now))
    order = Window.orderBy(F.asc_nulls_first("last_checked_at"), "created_at", "page_id")  # one row per source
    return due.withColumn("turn", F.row_number().over(order)).withColumn("batch", F.floor((F.col("turn") - 1) / RUN).cast("int"))


def changed(fetched: DataFrame, pages: DataFrame) -> DataFrame:
    """The fetched pages (page_id, content_hash) whose hash is not the stored one."""
    return fetched.join(pages.select("page_id", "last_content_hash"), "page_id").filter(~F.col("content_hash").eqNullSafe(F.col("last_content_hash"))).drop("last_content_hash")


def first_status(first_crawl_done: Column) -> Column:
    """A page's first crawl is a silent baseline."""
    return F.when(first_crawl_done, "pending").otherwise("skipped")


def batch_cap(rows: DataFrame, most: int) -> DataFrame:
    """The oldest `most` rows of every page."""
    order = Window.partitionBy("page_id").orderBy("first_seen_at", "id")
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).drop("rn")


def next_probe(degraded: Column, skipped: Column, current: Column, now: Column) -> Column:
    return F.when(~degraded, F.lit(None)).when(skipped, current).otherwise(now + F.expr(PROBE))


def after_failure(error: Column, failures: Column) -> Column:
    """struct<failure_count, last_error> after a fetch that failed."""
    n = failures + 1
    return F.struct(n.alias("failure_count"), F.when(is_blocked(error) & (n >= FAILURES), BLOCKED_MESSAGE).otherwise(F.substring(error, 1, 500)).alias("last_error"))


def link_warning(rows: DataFrame) -> DataFrame:
    """page_id, n, unlinked, warning: pages of three rows or more of which over half have no link."""
    counts = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("link_source") == "none").alias("unlinked"))
    bad = (F.col("n") >= 3) & (F.col("unlinked") / F.col("n") > 0.5)
    text = F.concat(F.lit(LINK_WARNING + " ("), F.col("unlinked").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(")"))
    return counts.withColumn("warning", F.when(bad, text))


def page_error(step: Column, truncated: Column, warning: Column) -> Column:
    """What a page shows: a step's error, else what was cut and what links are missing."""
    note = F.when(truncated, "content was truncated")
    return F.coalesce(F.nullif(step, F.lit("")), F.nullif(F.concat_ws(" | ", note, warning), F.lit("")))


def upsert(existing: DataFrame, crawl: DataFrame, now: Column) -> DataFrame:
    """The stored rows after a crawl: seen ones touched and their links repaired, new ones added.

    existing and crawl share their columns; crawl's rows are distinct in page_id and dedupe_key. Running the
    same crawl again changes nothing but last_seen_at.
    """
    links = ("url", "link_source", "link_note", "link_score")
    seen = crawl.select("page_id", "dedupe_key", F.lit(True).alias("seen"), *[F.col(c).alias(f"new_{c}") for c in links])
    drift = F.col("seen") & (~F.col("url").eqNullSafe(F.col("new_url")) | (F.col("link_source") == "unknown"))
    old = existing.join(seen, ["page_id", "dedupe_key"], "left").withColumn("drift", F.coalesce(drift, F.lit(False)))
    old = old.withColumns({c: F.when(F.col("drift"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in links})
    old = old.withColumn("last_seen_at", F.when(F.col("seen"), now).otherwise(F.col("last_seen_at"))).select(*existing.columns)
    return old.unionByName(crawl.join(existing.select("page_id", "dedupe_key"), ["page_id", "dedupe_key"], "left_anti"), allowMissingColumns=True)


def merged(existing: DataFrame, merges: DataFrame) -> DataFrame:
    """existing with the keys of renamed rows; merges: page_id, dedupe_key, id."""
    return existing.join(merges.select("id", F.col("dedupe_key").alias("renamed")), "id", "left").withColumn("dedupe_key", F.coalesce("renamed", "dedupe_key")).drop("renamed")


@dataclass(frozen=True)
class Config:
    """What a run needs to know."""

    profile: gates.Profile
    company_layer: bool = False


def _with_others(rows: DataFrame, others: DataFrame | None) -> DataFrame:
    rows = rows.select("id", "content_key", "first_seen_at", "notified_at")
    return rows if others is None else rows.unionByName(others.select(*rows.columns))


def screened(rows: DataFrame, config: Config, judge: Column | None = None, others: DataFrame | None = None) -> DataFrame:
    """rows with the state after screening. rows: id, page_id, title, company, location, compensation,
    content_key, first_seen_at, notified_at, filter_status, fallback (a page's own company, or null).

    Only the oldest SCREEN pending rows of a page are looked at. judge: the verdict that a model gave a row,
    null where it gave none (the row stays pending). Without a profile what no keyword blocks is skipped.
    others: id, content_key, first_seen_at, notified_at of rows kept elsewhere, which count as sent.
    """
    p = config.profile
    pending = F.coalesce(F.col("filter_status") == "pending", F.lit(False))
    turn = Window.partitionBy("page_id").orderBy("first_seen_at", "id")
    # Only what is pending is put in order, not a page's whole history.
    every = rows
    rows = rows.filter(pending).withColumn("now", F.row_number().over(turn) <= SCREEN).unionByName(rows.filter(~pending).withColumn("now", F.lit(False)))
    blocked = gates.blocked_keyword(F.col("title"), p.negative_keywords)
    rows = rows.withColumn("blocked", F.when(F.col("now"), gates.blocked_verdict(F.col("title"), blocked)))
    rows = rows.withColumn("blocked", F.when(F.col("now") & blocked.isNotNull(), F.col("blocked")))
    gate = gates.pre_filter(F.col("title"), F.col("location"), F.col("compensation"), p) if p.has_content() else F.lit(None).cast(gates.VERDICT)
    rows = rows.withColumn("gate", F.when(F.col("now") & F.col("blocked").isNull(), gate))
    said = judge if judge is not None else F.lit(None).cast(gates.VERDICT)
    said = gates.thin_backstop(said, F.col("title"), F.col("company"), F.col("location"), F.col("compensation"), p)
    open_ = F.col("now") & F.col("blocked").isNull() & F.col("gate").isNull()
    rows = rows.withColumn("said", F.when(open_ & F.lit(p.has_content()), said))
    match = F.coalesce(F.col("said.verdict") == "match", F.lit(False))
    if judge is None:  # no row has a verdict, so none matches, and none is asked for what it repeats
        rows = rows.withColumn("dup", F.lit(None).cast(every.schema["id"].dataType))
    else:
        columns = ["id", "content_key", "first_seen_at", "notified_at"]
        dup = duplicates(_with_others(every, others), asked=rows.filter(match).select(*columns))
        rows = rows.join(dup.withColumnRenamed("duplicate_of", "dup"), "id", "left")
    skip = open_ & F.lit(not p.has_content())
    to_company = F.lit(config.company_layer) & F.coalesce("company", "fallback").isNotNull()
    go = skip | (match & F.col("dup").isNull())
    held = F.col("blocked").isNotNull() | F.col("gate").isNotNull() | (F.col("said").isNotNull() & ~match)
    return rows.select(
        "id", "page_id",
        F.when(held, "filtered").when(skip, "skipped").when(match, "matched").otherwise(F.col("filter_status")).alias("filter_status"),
        F.coalesce("blocked", "gate", "said").alias("filter_verdict"), F.col("blocked").isNotNull().alias("negative_keyword_filtered"), F.col("gate").isNotNull().alias("keyword_filtered"),
        F.when(match, F.col("dup")).alias("duplicate_of"), (go & ~to_company).alias("pending_notify"), F.when(go & to_company, "pending").otherwise("none").alias("company_status"),
    )


def outbox(rows: DataFrame, now: Column, others: DataFrame | None = None) -> DataFrame:
    """id, page_id, duplicate_of, send for the queued rows of one run: the oldest NOTIFY of a page; a row is
    suppressed if its content was sent within the horizon or comes earlier in this run."""
    queued = batch_cap(rows.filter("pending_notify and notified_at is null").select("id", "page_id", "content_key", "first_seen_at"), NOTIFY)
    dup = duplicates(_with_others(rows, others), now, queued)
    out = queued.join(dup, "id", "left").withColumn("first", first_of_batch(queued))
    return out.select("id", "page_id", "duplicate_of", (F.col("duplicate_of").isNull() & F.col("first")).alias("send"))
