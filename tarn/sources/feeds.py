"""RSS and Atom bodies as posting rows, and where a site may keep its feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import decode_entities, strip
from tarn.functions.url import part, resolved

# The paths that are tried, in this order, and how many at most.
ORIGIN_PATHS = ("/feed", "/feed.xml", "/rss", "/rss.xml", "/atom.xml", "/index.xml")
JOB_PATHS = ("/jobs/rss", "/jobs/feed", "/jobs.rss")
MOST_PROBES = 16


def field(xml: Column, name: str) -> Column:
    """The text of the first element of a name, CDATA undone; null if there is none."""
    raw = strip(F.regexp_extract(xml, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1))
    inner = strip(F.regexp_extract(raw, r"(?s)^<!\[CDATA\[(.*?)\]\]>$", 1))
    return F.when(xml.rlike(rf"(?is)<{name}[^>]*>.*?</{name}>"), F.when(raw.startswith("<![CDATA["), inner).otherwise(raw))


def items(feeds: DataFrame, body: str = "body") -> DataFrame:
    """The feeds' other columns with pos, title, url, posted_text of every item that has a title."""
    keep = [c for c in feeds.columns if c != body]
    found = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<item\b.*?</item>|<entry\b.*?</entry>"), F.lit(0))
    rows = feeds.select(*keep, F.posexplode(found).alias("pos", "x"))
    x = F.col("x")
    address = F.coalesce(F.nullif(F.regexp_extract(x, r'(?i)<link\b[^>]*href="([^"]+)"', 1), F.lit("")), field(x, "link"))
    posted = F.coalesce(field(x, "pubDate"), field(x, "updated"), field(x, "published"))
    return rows.select(*keep, "pos", decode_entities(field(x, "title")).alias("title"), address.alias("url"), posted.alias("posted_text")).filter("title != ''")


def looks_like_feed(content_type: Column, body: Column) -> Column:
    head = F.substring(body, 1, 500)
    return content_type.contains("xml") | head.contains("<rss") | head.contains("<feed")


def accepted(rows: DataFrame, key: str) -> DataFrame:
    """The feeds (by key) with at least one item of which at least four fifths have an address."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif("url", F.lit(""))).alias("linked"))
    return counts.filter(F.col("linked") / F.col("n") >= 0.8)


def candidates(pages: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """page columns without the body, probe, candidate: what the page advertises, then the usual places;
    each address once, MOST_PROBES at most."""
    keep = [c for c in pages.columns if c != body]
    on = F.col(url)
    tags = F.filter(F.regexp_extract_all(F.col(body), F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike("(?i)rel=[\"']?alternate") & t.rlike("(?i)type=[\"']application/(rss|atom)\\+xml"))
    said = F.filter(F.transform(tags, lambda t: resolved(F.regexp_extract(t, "(?i)href=[\"']([^\"']+)", 1), on)), lambda u: u.isNotNull())
    origin = F.concat(part(on, 1), F.lit("://"), part(on, 2))
    beside = F.regexp_replace(F.concat(origin, part(on, 3)), "/+$", "")
    usual = [F.concat(beside, F.lit(p)) for p in ("/feed", "/rss", ".rss")] + [F.concat(origin, F.lit(p)) for p in (*JOB_PATHS, *ORIGIN_PATHS)]
    every = F.slice(F.array_distinct(F.concat(said, F.array(*usual))), 1, MOST_PROBES)
    return pages.select(*keep, F.posexplode(every).alias("probe", "candidate"))


def first_accepted(probed: DataFrame, key: str) -> DataFrame:
    """Of each page's accepted candidates the one probed first."""
    order = Window.partitionBy(key).orderBy("probe")
    return probed.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")
