"""Job boards' JSON bodies as posting rows. Bodies are landed strings; nothing here opens a connection.

Every reader gives: the input's other columns, then title, url, company, location, compensation, posted_text.
Rows without a title are dropped; a body that is no JSON gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import strip
from tarn.functions.url import bare_host, first_segment, part

# The hosts whose pages have a board behind them.
HOSTS = {"greenhouse": "greenhouse.io", "lever": "lever.co", "ashby": "ashbyhq.com", "himalayas": "himalayas.app", "workingnomads": "workingnomads.com"}
# Fixed values in the readers: the names of the boards' JSON fields.
_COLUMNS = ("title", "url", "company", "location", "compensation", "posted_text")


def board(url: Column) -> Column:
    """Which board a page's address belongs to, or null."""
    host, out = bare_host(url), F.lit(None).cast("string")
    for name, domain in reversed(HOSTS.items()):
        out = F.when((host == domain) | host.endswith("." + domain), name).otherwise(out)
    return out


def token(url: Column) -> Column:
    return first_segment(url)


def _rows(bodies: DataFrame, items: Column, fields: dict[str, Column], body: str, pos: str | None = None) -> DataFrame:
    """pos: the name of a column with an item's place in its body, if one is wanted."""
    keep = [c for c in bodies.columns if c != body]
    rows = bodies.select(*keep, F.posexplode(items).alias(pos, "j") if pos else F.explode(items).alias("j"))
    keep += [pos] if pos else []
    made = rows.select(*keep, *[fields.get(c, F.lit(None)).cast("string").alias(c) for c in _COLUMNS])
    return made.withColumn("title", strip(F.coalesce("title", F.lit("")))).filter("title != ''")


def greenhouse(bodies: DataFrame, body: str = "body", pos: str | None = None) -> DataFrame:
    items = F.from_json(body, "struct<jobs: array<struct<title: string, absolute_url: string, location: struct<name: string>, updated_at: string>>>")["jobs"]
    return _rows(bodies, items, {"title": F.col("j.title"), "url": F.col("j.absolute_url"), "location": F.col("j.location.name"), "posted_text": F.col("j.updated_at")}, body, pos)


def lever(bodies: DataFrame, body: str = "body", pos: str | None = None) -> DataFrame:
    items = F.from_json(body, "array<struct<text: string, hostedUrl: string, categories: struct<location: string>>>")
    return _rows(bodies, items, {"title": F.col("j.text"), "url": F.col("j.hostedUrl"), "location": F.col("j.categories.location")}, body, pos)


def ashby(bodies: DataFrame, body: str = "body", pos: str | None = None) -> DataFrame:
    items = F.from_json(body, "struct<jobs: array<struct<title: string, jobUrl: string, location: string>>>")["jobs"]
    return _rows(bodies, items, {"title": F.col("j.title"), "url": F.col("j.jobUrl"), "location": F.col("j.location")}, body, pos)


def himalayas(bodies: DataFrame, body: str = "body", pos: str | None = None) -> DataFrame:
    """Descriptions are blanked before parsing: they are most of the body and nothing is read from them."""
    short = F.regexp_replace(body, r'"description"\s*:\s*"(?:[^"\\]|\\.)*"', '"description":""')
    kind = "struct<title: string, companyName: string, applicationLink: string, guid: string, locationRestrictions: array<string>, minSalary: double, maxSalary: double, currency: string, salaryPeriod: string>"
    items = F.from_json(short, f"struct<jobs: array<{kind}>>")["jobs"]
    low, high = F.nullif(F.col("j.minSalary"), F.lit(0.0)), F.nullif(F.col("j.maxSalary"), F.lit(0.0))
    shown = lambda x: F.format_number(x, 0)
    amount = F.when(low.isNotNull() & high.isNotNull(), F.concat(shown(low), F.lit("–"), shown(high))).otherwise(shown(F.coalesce(low, high)))
    pay = F.concat(F.coalesce("j.currency", F.lit("USD")), F.lit(" "), amount, F.lit(" "), F.coalesce("j.salaryPeriod", F.lit("annual")))
    where = F.when(F.size("j.locationRestrictions") > 0, F.array_join("j.locationRestrictions", ", ")).otherwise("Remote")
    return _rows(bodies, items, {"title": F.col("j.title"), "url": F.coalesce("j.applicationLink", "j.guid"), "company": F.col("j.companyName"), "location": where, "compensation": pay}, body, pos)


def himalayas_keyword(url: Column) -> Column:
    found = [F.nullif(F.regexp_extract(part(url, 4), rf"[?&]{k}=([^&]*)", 1), F.lit("")) for k in ("keyword", "q")]
    return F.coalesce(*found, F.lit("design"))


def workingnomads(bodies: DataFrame, body: str = "body", pos: str | None = None) -> DataFrame:
    kind = "struct<title: string, company: string, slug: string, apply_url: string, locations: array<string>, location_base: string, salary_range: string, pub_date: string>"
    items = F.transform(F.from_json(body, f"struct<hits: struct<hits: array<struct<_source: {kind}>>>>")["hits"]["hits"], lambda h: h["_source"])
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    url = F.coalesce(filled("j.apply_url"), F.concat(F.lit("https://www.workingnomads.com/jobs/"), filled("j.slug")))
    where = F.when(F.size("j.locations") > 0, F.array_join("j.locations", ", ")).otherwise(F.coalesce(filled("j.location_base"), F.lit("Remote")))
    fields = {"title": F.col("j.title"), "url": url, "company": strip(F.col("j.company")), "location": where, "compensation": filled("j.salary_range"), "posted_text": filled("j.pub_date")}
    return _rows(bodies, items, fields, body, pos)


def workingnomads_category(url: Column) -> Column:
    """The category that a page's path names, or null."""
    path = F.regexp_replace(part(url, 3), "^/+|/+$", "")
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^remote-", ""), "-jobs$", ""), "-", " "))
    return F.when(~path.isin("", "jobs") & (name != ""), F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30)))


READERS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "himalayas": himalayas, "workingnomads": workingnomads}


def structured(bodies: DataFrame, url: str = "url", body: str = "body", pos: str | None = None) -> DataFrame:
    """Each body through its board's reader, with strategy; bodies of no known board give no rows."""
    marked = bodies.withColumn("strategy", board(F.col(url))).withColumn("page_url", F.col(url)).drop(*([url] if url != "page_url" else []))
    out = None
    for name, reader in READERS.items():
        rows = reader(marked.filter(F.col("strategy") == name), body, pos)
        out = rows if out is None else out.unionByName(rows)
    return out
