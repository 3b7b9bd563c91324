"""Registered queries for the functions and sources that the first module's queries do not reach, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import dates, display, html, money, place, text
from tarn.operators import cards, companies, lifecycle, links, registry
from tarn.plans import listing
from tarn.plans.queries import _ANCHORS_SQL, _CRAWLS, _MATCHING, _crawl, _first_words, _page_anchors, _sql_norm, _titles, query
from tarn.plans.stored import stored
from tarn.plans.tables import postings, sources, table
from tarn.sources import boards

# --- joins -----------------------------------------------------------------------------------------


@query("SELECT id, page_label, n_name AS industry FROM (SELECT p.id, s.label AS page_label, p.company FROM postings_v p LEFT JOIN sources_v s USING (page_id)) LEFT JOIN (SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0) ON company = s_name", "ps")
def postings_with_companies(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    known = known.select(F.col("s_name").alias("company_id"), F.col("n_name").alias("industry"))
    return listing.with_sources(postings(spark, sf_dir).withColumn("company_id", F.col("company")), sources(spark, sf_dir), known).select("id", "page_label", "industry")


_POSTED = "posted AS (SELECT doc_id % 50 AS page_id, doc_id AS pos, title, tw, CASE WHEN doc_id % 3 < 2 THEN doc_id END AS link_id, CASE WHEN doc_id % 2 = 0 THEN 'HTTPS://X.example.com/' || (doc_id * 7 % 60) END AS url FROM titles JOIN w ON pos = doc_id)"
_SHARE = "CASE WHEN len(tw) = 0 OR len(aw) = 0 THEN 0.0::DOUBLE WHEN title <> '' AND contains(text, title) THEN least(1.0::DOUBLE, len(list_filter(tw, lambda x: list_contains(aw, x)))::DOUBLE / len(tw) + 0.15::DOUBLE) ELSE len(list_filter(tw, lambda x: list_contains(aw, x)))::DOUBLE / len(tw) END"


def _posted(words):
    """Postings that cite a link, have an address of their own, both or neither."""
    k = F.col("pos")
    return _titles(words).withColumns({"link_id": F.when(k % 3 < 2, k), "url": F.when(k % 2 == 0, F.concat(F.lit("HTTPS://X.example.com/"), (k * 7 % 60).cast("string")))})


@query(f"WITH {_MATCHING}, {_POSTED} SELECT p.page_id, pos, href AS cited, round({_SHARE}, 6) AS score FROM posted p JOIN links_v l ON p.page_id = l.page_id AND p.link_id = l.link_id")
def cited_links(spark, sf_dir):
    words = stored(_first_words(spark, sf_dir), "first-words")
    return links.cited_links(_posted(words), _page_anchors(words)).select("page_id", "pos", "cited", F.round("cited_score", 6).alias("score"))


@query(f"WITH {_MATCHING}, {_POSTED}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, lower(href) ORDER BY link_id) AS rn FROM links_v) WHERE rn = 1) SELECT p.page_id, pos, url AS own, round({_SHARE}, 6) AS score FROM posted p JOIN firsts f ON p.page_id = f.page_id AND lower(p.url) = lower(f.href)")
def own_address_links(spark, sf_dir):
    words = stored(_first_words(spark, sf_dir), "first-words")
    return links.own_links(_posted(words), _page_anchors(words)).select("page_id", "pos", "own", F.round("own_score", 6).alias("score"))


@query(f"""
WITH {_MATCHING}, {_POSTED}, k AS (SELECT page_id, pos FROM posted WHERE pos % 4 = 0), firsts AS (SELECT DISTINCT page_id, lower(href) AS key FROM links_v),
c AS (SELECT DISTINCT p.page_id, pos FROM posted p JOIN links_v l ON p.page_id = l.page_id AND p.link_id = l.link_id)
SELECT p.page_id, p.pos, CASE WHEN k.pos IS NOT NULL THEN 'card' WHEN c.pos IS NOT NULL THEN 'cited' WHEN f.key IS NOT NULL THEN 'own' WHEN b.pos IS NOT NULL THEN 'best' ELSE 'none' END AS branch
FROM posted p LEFT JOIN k ON p.page_id = k.page_id AND p.pos = k.pos LEFT JOIN c ON p.page_id = c.page_id AND p.pos = c.pos LEFT JOIN firsts f ON p.page_id = f.page_id AND lower(p.url) = f.key
LEFT JOIN best b ON p.page_id = b.page_id AND p.pos = b.pos""")
def link_priority(spark, sf_dir):
    """Which branch gives each posting its link, before two claims on one link are settled."""
    words = stored(_first_words(spark, sf_dir), "first-words")
    rows, usable = _posted(words), _page_anchors(words)
    card = rows.filter("pos % 4 = 0").select("page_id", "pos", F.lit("https://c.example.com/").alias("href"), F.lit(1.0).alias("score"))
    return links.branches(rows, usable, card).select("page_id", "pos", "branch")


@query(f"""
WITH g AS (SELECT page_id, title, company, min(id) AS id FROM postings_v GROUP BY page_id, title, company),
c AS (SELECT page_id, title, 'https://x.example.com/' || id AS href, CASE WHEN length(title) % 3 = 0 THEN '' ELSE {_sql_norm('company')} END AS named FROM g WHERE length(title) % 4 <> 0),
m AS (SELECT g.page_id, g.id AS pos, c.href, c.named = {_sql_norm('g.company')} AS named, count(*) OVER w AS n, count(*) FILTER (c.named = {_sql_norm('g.company')}) OVER w AS k
  FROM g JOIN c ON g.page_id = c.page_id AND {_sql_norm('g.title')} = {_sql_norm('c.title')} WINDOW w AS (PARTITION BY g.page_id, g.id))
SELECT page_id, pos, href FROM m WHERE n = 1 OR (k = 1 AND named)""", "p")
def card_matches(spark, sf_dir):
    """Cards of one title on a page: one alone is taken; of several, the one that names the company."""
    g = postings(spark, sf_dir).groupBy("page_id", "title", "company").agg(F.min("id").alias("id"))
    named = F.when(F.length("title") % 3 == 0, "somebody").otherwise(F.col("company"))
    found = g.filter(F.length("title") % 4 != 0).select("page_id", F.concat(F.lit("https://x.example.com/"), "id").alias("href"), "title", F.concat("title", F.lit(" at "), named).alias("text"))
    return cards.match_cards(g.withColumnRenamed("id", "pos"), found).select("page_id", "pos", "href")


# --- the stored rows -------------------------------------------------------------------------------

_LINKED = ("url", "link_source", "link_note", "link_score")


@query(f"""
WITH {_CRAWLS},
o AS (SELECT page_id, id, dedupe_key, 'https://x.example.com/' || dedupe_key AS url, CASE WHEN n % 3 = 0 THEN 'unknown' ELSE 'cited' END AS src FROM old),
c AS (SELECT page_id, id, dedupe_key, 'https://x.example.com/' || dedupe_key || CASE WHEN n % 5 = 0 THEN '/moved' ELSE '' END AS url, 'matched' AS src FROM new)
SELECT o.page_id, o.dedupe_key, o.id, CASE WHEN c.url IS NOT NULL AND (c.url <> o.url OR o.src = 'unknown') THEN c.url ELSE o.url END AS url,
       CASE WHEN c.url IS NOT NULL AND (c.url <> o.url OR o.src = 'unknown') THEN c.src ELSE o.src END AS link_source, c.url IS NOT NULL AS seen_now
FROM o LEFT JOIN c USING (page_id, dedupe_key)
UNION ALL SELECT page_id, dedupe_key, id, url, src, true FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.page_id = c.page_id AND o.dedupe_key = c.dedupe_key)""", "p")
def ingest_upsert(spark, sf_dir):
    """Stored rows after a crawl: touched, links repaired where they drifted or were unknown, new ones added."""
    at = lambda s: F.lit(s).cast("timestamp")
    same = {"link_note": F.lit(None).cast("string"), "link_score": F.lit(1.0)}
    old = _crawl(spark, sf_dir, False).withColumns({"link_source": F.when(F.col("n") % 3 == 0, "unknown").otherwise("cited"), "last_seen_at": at("2024-01-01"), **same})
    new = _crawl(spark, sf_dir, True).withColumns({"link_source": F.lit("matched"), "url": F.when(F.col("n") % 5 == 0, F.concat("url", F.lit("/moved"))).otherwise(F.col("url")), "last_seen_at": at("2024-02-01"), **same})
    columns = ["page_id", "dedupe_key", "id", *_LINKED, "last_seen_at"]
    out = lifecycle.upsert(old.select(*columns), new.select(*columns), at("2024-02-01"))
    return out.select("page_id", "dedupe_key", "id", "url", "link_source", (F.col("last_seen_at") == at("2024-02-01")).alias("seen_now"))


@query("SELECT id, page_id, url, poll_claimed_at IS NULL OR poll_claimed_at < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 3 MINUTE AS claimable FROM (SELECT page_id AS id, * FROM sources_v)", "s")
def claimable_pages(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return sources(spark, sf_dir).select(F.col("page_id").alias("id"), "page_id", "url", lifecycle.claimable(F.col("poll_claimed_at"), now).alias("claimable"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 3 = 0 THEN strftime(last_checked_at, '%Y-%m-%d %H:%M') ELSE '2024-02-01 12:00' END AS next_probe, CASE WHEN last_error IS NOT NULL THEN last_error WHEN page_id % 2 = 0 AND page_id % 7 = 0 THEN 'content was truncated | links are missing' WHEN page_id % 2 = 0 THEN 'content was truncated' WHEN page_id % 7 = 0 THEN 'links are missing' END AS shown FROM sources_v", "s")
def probes_and_errors(spark, sf_dir):
    k, now = F.col("page_id"), F.lit("2024-02-01 00:00:00").cast("timestamp")
    probe = lifecycle.next_probe(k % 5 != 0, k % 3 == 0, F.col("last_checked_at"), now)
    return sources(spark, sf_dir).select("page_id", F.date_format(probe, "yyyy-MM-dd HH:mm").alias("next_probe"), lifecycle.page_error(F.col("last_error"), k % 2 == 0, F.when(k % 7 == 0, "links are missing")).alias("shown"))


@query("SELECT page_id, count(*) AS new, count(*) FILTER (filter_status <> 'pending') AS screened, count(*) FILTER (filter_status = 'filtered') AS filtered_out, count(*) FILTER (company_status = 'warned') AS warned, count(*) FILTER (notified_at IS NOT NULL) AS notified FROM postings_v GROUP BY page_id", "p")
def run_summary(spark, sf_dir):
    return listing.summary(postings(spark, sf_dir).withColumn("notified", F.col("notified_at").isNotNull()))


@query("SELECT page_id, CASE WHEN count(company) = 0 AND trim(any_value(label)) <> '' THEN trim(any_value(label)) END AS fallback FROM (SELECT s.page_id, s.label, p.company FROM sources_v s LEFT JOIN (SELECT page_id, company FROM postings_v WHERE page_id % 3 <> 0) p USING (page_id)) GROUP BY page_id", "ps")
def company_fallback(spark, sf_dir):
    named = F.when(F.col("page_id") % 3 != 0, F.col("company"))
    return companies.page_fallback(postings(spark, sf_dir).withColumn("company", named), sources(spark, sf_dir))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000 OFFSET 50")
def ceiling_read(spark, sf_dir):
    rows = listing.capped_read(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", limit=5000, offset=50)
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT s.page_id, label, s.url, active, first_crawl_done, CAST(NULL AS VARCHAR) AS last_content_hash, CAST(NULL AS VARCHAR) AS last_error, CAST(0 AS INTEGER) AS failure_count, count(p.id) AS had, CAST(0 AS BIGINT) AS has FROM sources_v s LEFT JOIN postings_v p USING (page_id) GROUP BY ALL", "ps")
def crawl_reset(spark, sf_dir):
    """Every page after a reset, with how many postings it had and has."""
    before = postings(spark, sf_dir)
    pages = sources(spark, sf_dir).withColumn("last_content_hash", F.sha2("url", 256))
    again, after = registry.reset_crawls(pages, before)
    counts = lambda rows, name: rows.groupBy("page_id").agg(F.count("id").alias(name))
    rows = again.join(counts(before, "had"), "page_id", "left").join(counts(after, "has"), "page_id", "left").fillna(0, ["had", "has"])
    return rows.select("page_id", "label", "url", "active", "first_crawl_done", "last_content_hash", "last_error", F.col("failure_count").cast("int").alias("failure_count"), "had", "has")


# --- boards ----------------------------------------------------------------------------------------


def _bodies(spark, sf_dir, job, of=lambda jobs: F.to_json(F.struct(jobs.alias("jobs")))):
    """A board body per page, made of its postings: id, title, location and a number k."""
    rows = postings(spark, sf_dir).groupBy("page_id", "title", "location").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("k"))
    return rows.groupBy("page_id").agg(of(F.collect_list(job)).alias("body"))


_JOBS = "WITH g AS (SELECT page_id, title, location, min(id) AS id, count(*) AS k FROM postings_v GROUP BY page_id, title, location)"


@query(f"{_JOBS} SELECT page_id, title, 'https://l.example.com/' || id AS url, location FROM g", "p")
def lever_json(spark, sf_dir):
    job = F.struct(F.col("title").alias("text"), F.concat(F.lit("https://l.example.com/"), "id").alias("hostedUrl"), F.struct("location").alias("categories"))
    return boards.lever(_bodies(spark, sf_dir, job, F.to_json)).select("page_id", "title", "url", "location")


@query(f"{_JOBS} SELECT page_id, title, 'https://a.example.com/' || id AS url, location FROM g", "p")
def ashby_json(spark, sf_dir):
    job = F.struct("title", F.concat(F.lit("https://a.example.com/"), "id").alias("jobUrl"), "location")
    return boards.ashby(_bodies(spark, sf_dir, job)).select("page_id", "title", "url", "location")


@query(f"""{_JOBS} SELECT page_id, title, CASE WHEN k % 2 = 0 THEN 'https://apply.example.com/' ELSE 'https://h.example.com/' END || id AS url, 'Co ' || k AS company, CASE WHEN k % 3 = 0 THEN 'Remote' ELSE location || ', Anywhere' END AS location,
 CASE WHEN k % 4 = 0 THEN 'EUR 40,000–50,000 annual' WHEN k % 4 = 1 THEN 'USD 40,000 month' WHEN k % 4 = 2 THEN 'USD 50,000 annual' END AS compensation FROM g""", "p")
def himalayas_json(spark, sf_dir):
    k = F.col("k")
    job = F.struct(
        "title", F.concat(F.lit("Co "), k.cast("string")).alias("companyName"), F.when(k % 2 == 0, F.concat(F.lit("https://apply.example.com/"), "id")).alias("applicationLink"), F.concat(F.lit("https://h.example.com/"), "id").alias("guid"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("location", F.lit("Anywhere"))).alias("locationRestrictions"), F.lit('a "quoted" {text}').alias("description"),
        F.when(k % 4 < 2, 40000).otherwise(0).alias("minSalary"), F.when(k % 4 % 2 == 0, F.when(k % 4 == 3, 0).otherwise(50000)).otherwise(0).alias("maxSalary"),
        F.when(k % 4 == 0, "EUR").alias("currency"), F.when(k % 4 == 1, "month").alias("salaryPeriod"),
    )
    return boards.himalayas(_bodies(spark, sf_dir, job)).select("page_id", "title", "url", "company", "location", "compensation")


@query(f"{_JOBS} SELECT page_id, title, CASE WHEN k % 2 = 0 THEN 'https://apply.example.com/' || id ELSE 'https://www.workingnomads.com/jobs/' || id END AS url, 'Co' AS company, CASE WHEN k % 3 = 0 THEN 'Remote' ELSE location || ', Anywhere' END AS location FROM g", "p")
def workingnomads_json(spark, sf_dir):
    k = F.col("k")
    job = F.struct(F.struct("title", F.lit(" Co ").alias("company"), F.col("id").alias("slug"), F.when(k % 2 == 0, F.concat(F.lit("https://apply.example.com/"), "id")).otherwise("").alias("apply_url"),
                            F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("location", F.lit("Anywhere"))).alias("locations")).alias("_source"))
    return boards.workingnomads(_bodies(spark, sf_dir, job, lambda j: F.to_json(F.struct(F.struct(j.alias("hits")).alias("hits"))))).select("page_id", "title", "url", "company", "location")


# --- display, pay, places, dates -------------------------------------------------------------------


@query("""SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'Red Barn ' || s_suppkey WHEN 1 THEN 'Supplier ' || s_suppkey WHEN 2 THEN 'Company' WHEN 3 THEN s_name ELSE 'Blue Hill' END AS company,
 CASE s_suppkey % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'x' ELSE 'uncertain' END AS level, CASE s_suppkey % 5 WHEN 0 THEN 'Verified' WHEN 1 THEN 'Not researched' ELSE 'Uncertain' END AS level_shown FROM supplier""")
def company_display(spark, sf_dir):
    k, s = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    raw = F.when(k % 5 == 0, F.concat(F.lit("https://x.io/company/red-barn-"), s)).when(k % 5 == 3, F.col("s_name")).when(k % 5 == 4, "https://x.io/jobs/company-blue_hill")
    title = F.when(k % 5 == 1, F.concat(F.lit("Cook at Supplier "), s)).otherwise("Cook")
    level = F.when(k % 5 == 0, "verified").when(k % 5 == 1, "x").otherwise("uncertain")
    return table(spark, sf_dir, "supplier").select(k.alias("k"), display.company(raw, title).alias("company"), level.alias("level"), display.named(level, display.LEGITIMACY, "Not researched").alias("level_shown"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://j.example.com/' || page_id WHEN 1 THEN regexp_extract(url, '^(https://[^/]+)', 1) || '/jobs/' || page_id ELSE CASE WHEN page_id % 4 = 2 THEN url END END AS href,
 page_id % 4 < 2 AS is_direct, CASE WHEN page_id % 4 = 2 THEN 'Open source listing' ELSE 'View Posting' END AS label FROM sources_v""", "s")
def posting_links(spark, sf_dir):
    k = F.col("page_id")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" https://j.example.com/"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("/jobs/"), k.cast("string")))
    shown = display.link(raw, F.when(k % 4 != 3, F.col("url")))
    return sources(spark, sf_dir).select("page_id", shown["href"].alias("href"), shown["is_direct"].alias("is_direct"), shown["label"].alias("label"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'own' || page_id || '.example.com' WHEN 1 THEN 'job' || page_id || '.example.net' END AS domain,
 CASE page_id % 4 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'Direct' WHEN 2 THEN 'My list' ELSE 'Harbour' END AS site,
 CASE WHEN NOT first_crawl_done THEN 'awaiting first crawl' ELSE page_id || ' matched · 0 filtered' END AS stat, CASE page_id % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'maybe' WHEN 2 THEN 'no fit' ELSE '…' END AS verdict FROM sources_v""", "s")
def source_display(spark, sf_dir):
    k, s = F.col("page_id"), F.col("page_id").cast("string")
    domain = display.icon_domain(F.when(k % 3 == 0, F.concat(F.lit("www.own"), s, F.lit(".example.com/about"))), F.when(k % 3 == 1, F.concat(F.lit("https://job"), s, F.lit(".example.net/1"))).when(k % 3 == 2, "https://uk.linkedin.com/jobs/1"))
    label = F.when(k % 4 == 0, "LinkedIn search").when(k % 4 == 1, "Barn Works jobs").when(k % 4 == 2, "My list").otherwise("")
    site = display.site_name(label, F.when(k % 4 == 3, "https://www.harbour.org/x").otherwise(""), F.lit("Barn Works"))
    verdict = display.verdict_label(F.when(k % 4 == 0, "match").when(k % 4 == 1, "borderline").when(k % 4 == 2, "mismatch"), F.lit("pending"))
    return sources(spark, sf_dir).select("page_id", domain.alias("domain"), site.alias("site"), display.source_stat(F.col("first_crawl_done"), k, F.lit(None).cast("long")).alias("stat"), verdict.alias("verdict"))


@query("""WITH d AS (SELECT DISTINCT CAST(floor(l_extendedprice) AS BIGINT) * 1000 AS n, l_partkey % 4 AS k FROM lineitem),
s AS (SELECT n, k, CASE WHEN k = 2 AND n // 1000 < 1000 THEN '$' || (n // 1000) ELSE '$' || n END AS x FROM d)
SELECT n, k, CASE k WHEN 0 THEN 'From ' || m || ' / yr' WHEN 1 THEN 'Up to ' || m || ' / mo' WHEN 2 THEN m || ' – ' || m || ' / yr' ELSE '' END AS range, CASE k WHEN 3 THEN 'Pay undisclosed' ELSE '$' || n END AS shown,
 CASE WHEN k < 3 THEN n::DOUBLE END AS least, format('{:,}', n) AS typed
FROM (SELECT *, CASE WHEN n >= 1000000 THEN '$' || ((n + 50000) // 100000) // 10 || CASE WHEN ((n + 50000) // 100000) % 10 = 0 THEN '' ELSE '.' || ((n + 50000) // 100000) % 10 END || 'M'
   ELSE '$' || ((n + 50) // 100) // 10 || CASE WHEN ((n + 50) // 100) % 10 = 0 THEN '' ELSE '.' || ((n + 50) // 100) % 10 END || 'K' END AS m FROM s)""")
def pay_display(spark, sf_dir):
    n, k = F.col("n"), F.col("k")
    rows = table(spark, sf_dir, "lineitem").select((F.floor("l_extendedprice").cast("long") * 1000).alias("n"), (F.col("l_partkey") % 4).alias("k")).distinct()
    period = F.when(k == 1, "month").otherwise("year")
    raw = F.when(k == 3, "Full-time").otherwise(F.concat(F.lit("$"), n.cast("string")))
    return rows.select(
        "n", "k", money.range_text(F.when(k.isin(0, 2), n), F.when(k.isin(1, 2), n), F.lit("USD"), period).alias("range"), money.shown(raw).alias("shown"),
        money.legacy_range(raw)["min"].alias("least"), money.grouped(money.typed_amount(F.concat(F.lit("$ "), n.cast("string")))).alias("typed"),
    )


@query("SELECT n_name, 'Only: ' || n_name || ', Remote. Never: Mars' AS prose, n_name || ';Remote' AS include, 'Mars' AS exclude, n_name AS remote_or FROM nation")
def place_lists(spark, sf_dir):
    n = F.col("n_name")
    said = place.prose(F.array(n, F.lit("Remote")), F.array(F.lit("Mars")))
    back, other = place.legacy_lists(said), place.legacy_lists(F.concat(F.lit("Remote or "), n))
    return table(spark, sf_dir, "nation").select("n_name", said.alias("prose"), F.array_join(back["include"], ";").alias("include"), F.array_join(back["exclude"], ";").alias("exclude"), other["include"][1].alias("remote_or"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '3d ago' WHEN 3 THEN '31d ago' ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-02-01') || 'd ago' END AS age,
 CASE WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS posted FROM orders""")
def posted_ages(spark, sf_dir):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(k == 0, "3d ago").when(k == 1, F.date_format(day, "yyyy-MM-dd")).when(k == 2, F.concat(F.lit("Mon, "), F.date_format(day, "d MMM yyyy"), F.lit(" 00:00:00 +0000"))).otherwise("soon")
    now, seen = F.lit("2024-02-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.posted_age(raw, seen, now).alias("age"), dates.posted_date(raw).alias("posted"))


@query(f"SELECT doc_id, CASE WHEN length(t) > 40 THEN substr(t, 1, 39) || '…' ELSE t END AS short, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, regexp_extract(t, '^[^ ]*') AS first FROM (SELECT doc_id, {_sql_norm('text')} AS t FROM documents)")
def text_display(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.norm_text(F.col("text")).alias("t"))
    return rows.select("doc_id", text.truncate(F.col("t"), 40).alias("short"), text.escape_html(F.col("t")).alias("escaped"), F.regexp_extract("t", "^[^ ]*", 0).alias("first"))


_MARKDOWN_SQL = rf"""
WITH {_ANCHORS_SQL},
kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY link_id) AS k FROM anchors WHERE NOT regexp_matches(text, '[\[\]<>&]') AND href LIKE '/%')
SELECT page_id, string_agg('* [[' || k || ']]' || text || '[[/' || k || ']] of ' || link_id, chr(10) ORDER BY link_id) AS text, count(*) AS n,
       string_agg(regexp_extract(url, '(?i)^(https?://[^/?#]*)', 1) || href, ' ' ORDER BY link_id) AS hrefs FROM kept GROUP BY page_id"""


@query(_MARKDOWN_SQL)
def markdown_links(spark, sf_dir):
    """Pages' own links as a reader service would write them."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(html.anchors(F.col("html"))).alias("i", "a")).filter(~F.col("a.text").rlike(r"[\[\]<>&]") & F.col("a.href").startswith("/"))
    line = F.concat(F.lit("* ["), F.col("a.text"), F.lit("]("), F.col("a.href"), F.lit(") of "), (F.col("i") + 1).cast("string"))
    bodies = rows.groupBy("page_id", "url").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("lines"))
    bodies = bodies.select("page_id", html.marked_markdown(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.col("url")).alias("m"))
    return bodies.select("page_id", "m.text", F.size("m.links").cast("long").alias("n"), F.array_join(F.transform("m.links", lambda x: x["href"]), " ").alias("hrefs"))


@query(rf"""
WITH {_ANCHORS_SQL}
SELECT p.page_id, sha256(html) AS body_sha256, coalesce(a.back, '') AS back FROM pages p
LEFT JOIN (SELECT page_id, string_agg('<a href="' || regexp_extract(url, '(?i)^(https?://[^/?#]*)', 1) || href || '">', ' ' ORDER BY link_id) AS back FROM anchors WHERE href LIKE '/%' AND NOT regexp_matches(href, '[&"<>'']') GROUP BY page_id) a USING (page_id)""")
def reader_bodies(spark, sf_dir):
    """Whole pages behind the head that a reader service puts before them, and their links out of an archive."""
    pages = table(spark, sf_dir, "pages")
    head = F.concat(F.lit("---\ntitle: page "), F.col("page_id").cast("string"), F.lit("\nurl: "), F.col("url"), F.lit("\n---\n\n"))
    bodies = pages.select("page_id", F.sha2(html.without_frontmatter(F.concat(head, "html")), 256).alias("body_sha256"))
    links = pages.select("page_id", "url", F.posexplode(html.anchors(F.col("html"))).alias("i", "a")).filter(F.col("a.href").startswith("/") & ~F.col("a.href").rlike("[&\"<>']"))
    old = F.concat(F.lit('<a href="/web/20200101000000/'), F.regexp_extract("url", "(?i)^(https?://[^/?#]*)", 1), F.col("a.href"), F.lit('">'))
    old = links.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("i", old.alias("a")))).alias("links"))
    old = old.select("page_id", html.snapshot_links(F.array_join(F.transform("links", lambda x: x["a"]), " ")).alias("back"))
    return bodies.join(old, "page_id", "left").fillna("", ["back"])


@query(f"SELECT doc_id, sha256({_sql_norm('text')}) AS norm_sha256 FROM documents WHERE text IS NOT NULL")
def wide_titles(spark, sf_dir):
    """Texts written in full-width letters and ligatures have the keys of the same texts written plainly."""
    plain, wide = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ", "".join(chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") + "\u3000"
    dressed = F.translate(F.replace(F.replace("text", F.lit("ffi"), F.lit("ﬃ")), F.lit("fi"), F.lit("ﬁ")), plain, wide)
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2(text.norm_text(dressed), 256).alias("norm_sha256"))
