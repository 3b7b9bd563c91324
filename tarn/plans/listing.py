"""The query interface: lists with filters, order and pages; counts; the funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES, COMPANY_STATUSES = ("pending", "matched", "filtered", "skipped"), ("none", "pending", "ok", "warned")
SORTS = ("first_seen_at", "title", "company", "notified_at")


def conditions(
    status: str | None = None, page_id=None, company_status: str | None = None, notified: bool | None = None, pending_notify: bool | None = None,
    screened: bool = False, duplicate: bool = False, keyword_filtered: bool | None = None, negative_keyword_filtered: bool | None = None,
) -> Column:
    """All given filters together; unknown statuses are ignored."""
    out = F.lit(True)
    if status in STATUSES:
        out &= F.col("filter_status") == status
    if page_id is not None:
        out &= F.col("page_id") == page_id
    if company_status in COMPANY_STATUSES:
        out &= F.col("company_status") == company_status
    if notified is not None:
        out &= F.col("notified_at").isNotNull() if notified else F.col("notified_at").isNull()
    if screened:
        out &= F.col("filter_status").isin("matched", "filtered")
    if duplicate:
        out &= F.col("duplicate_of").isNotNull()
    for name, value in (("pending_notify", pending_notify), ("keyword_filtered", keyword_filtered), ("negative_keyword_filtered", negative_keyword_filtered)):
        if value is not None:
            out &= F.col(name) == F.lit(value)
    return out


def list_postings(postings: DataFrame, sort: str = "first_seen_at", ascending: bool = False, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """One page of the list: whitelisted sort, nulls last either way, id as the tie break, 200 rows at most."""
    by = F.col(sort if sort in SORTS else "first_seen_at")
    order = by.asc_nulls_last() if ascending else by.desc_nulls_last()
    page = postings.filter(conditions(**filters)).orderBy(order, "id")
    return page.offset(max(offset, 0)).limit(min(limit or 50, 200))


#: The most rows that one plain read of a table gives, whatever is asked for.
CEILING = 1000


def capped_read(rows: DataFrame, *order: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A plain read of a table through the interface: at most CEILING rows of it, in a stated order."""
    return rows.orderBy(*order).offset(max(offset, 0)).limit(CEILING if limit is None else min(max(limit, 0), CEILING))


def count_postings(postings: DataFrame, **filters) -> DataFrame:
    return postings.filter(conditions(**filters)).agg(F.count(F.lit(1)).alias("total"))


def with_sources(postings: DataFrame, pages: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """postings with page_label and page_url, and with their company's dossier if companies are given."""
    out = postings.join(pages.select("page_id", F.col("label").alias("page_label"), F.col("url").alias("page_url")), "page_id", "left")
    return out if companies is None else out.join(companies, "company_id", "left")


def funnel(postings: DataFrame) -> DataFrame:
    """The twelve counts and what follows from them, in one pass."""
    n = lambda c, name: F.count_if(c).alias(name)
    status = F.col("filter_status")
    counts = postings.agg(
        F.count(F.lit(1)).alias("total"), *[n(status == s, s) for s in STATUSES], n(F.col("notified_at").isNotNull(), "notified"), n(F.col("pending_notify"), "pending_notify"),
        n(F.col("duplicate_of").isNotNull(), "duplicates"), n(F.col("company_status") == "warned", "company_warned"), n(F.col("company_status") == "pending", "company_pending"),
        n(F.col("keyword_filtered"), "keyword_filtered"), n(F.col("negative_keyword_filtered"), "negative_keyword_filtered"),
    )
    gone = F.col("keyword_filtered") + F.col("negative_keyword_filtered")
    return counts.select("*", (F.col("matched") + F.col("filtered")).alias("screened"), (F.col("pending") + F.col("company_pending") + F.col("pending_notify")).alias("in_pipeline"), (F.col("filtered") - gone).alias("judge_failed"))


def per_source(postings: DataFrame) -> DataFrame:
    return postings.groupBy("page_id").agg(*[F.count_if(F.col("filter_status") == s).alias(s) for s in ("matched", "filtered", "pending")])


def dashboard(pages: DataFrame, postings: DataFrame, now: Column) -> DataFrame:
    """active, errors, last_checked, and today's among the latest 50 matches."""
    latest = postings.filter("filter_status = 'matched'").orderBy(F.col("first_seen_at").desc(), "id").limit(50)
    today = latest.agg(F.count_if(F.to_date("first_seen_at") == F.to_date(now)).alias("matches_today"))
    state = pages.agg(F.count_if("active").alias("active"), F.count_if(F.col("last_error").isNotNull()).alias("errors"), F.max("last_checked_at").alias("last_checked"))
    return state.join(today, F.lit(True))


def summary(rows: DataFrame) -> DataFrame:
    """What a run did, by page: rows are screened ones (see lifecycle.screened) with notified."""
    return rows.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("new"), F.count_if(F.col("filter_status") != "pending").alias("screened"), F.count_if(F.col("filter_status") == "filtered").alias("filtered_out"),
        F.count_if(F.col("company_status") == "warned").alias("warned"), F.count_if("notified").alias("notified"),
    )


def stage_graph(counts: dict[str, int], title_gate: bool, company_layer: bool) -> list[dict]:
    """The pipeline's stages as data: name, on, count, what leaves to the filtered ones, and the next stage."""
    c = lambda k: counts.get(k, 0)
    return [
        {"stage": "sources", "on": True, "count": c("total"), "rejects": 0, "next": "keyword_filter"},
        {"stage": "keyword_filter", "on": title_gate, "count": c("screened"), "rejects": c("keyword_filtered") + c("negative_keyword_filtered"), "next": "judge"},
        {"stage": "judge", "on": True, "count": c("matched"), "rejects": c("judge_failed"), "next": "duplicates"},
        {"stage": "duplicates", "on": True, "count": c("duplicates"), "rejects": 0, "next": "company"},
        {"stage": "company", "on": company_layer, "count": c("company_warned"), "rejects": 0, "next": "notified"},
        {"stage": "notified", "on": True, "count": c("notified"), "rejects": 0, "next": None},
    ]


ROSTERS = {
    "source": {}, "judge": {"screened": True}, "keyword_filter": {"keyword_filtered": True}, "company": {"company_status": "warned"}, "duplicates": {"duplicate": True},
    "notified": {"notified": True}, "filtered": {"status": "filtered"},
}


def roster(postings: DataFrame, panel: str, **filters) -> DataFrame:
    """The newest 20 of an inspector panel; what was sent is ordered by when."""
    return list_postings(postings, sort="notified_at" if panel == "notified" else "first_seen_at", limit=20, **{**ROSTERS[panel], **filters})
