"""Registered queries for the validators of model answers, tags, settings, rosters and details of a posting's row, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import display, money, text, url
from tarn.operators import companies, identity, lifecycle, models
from tarn.plans import listing
from tarn.plans.queries import _sql_ascii, _sql_norm, query
from tarn.plans.tables import postings, sources, table

# --- what a model answered -------------------------------------------------------------------------

#: A document's text as a title, an answer of odd shape around it, and what is left of it.
_POSTING_SQL = r"""
WITH a AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\s ﻿]+|[\s ﻿]+$', '', 'g') AS title, doc_id % 7 AS k FROM documents),
v AS (
  SELECT doc_id, substr(title, 1, 300) AS title, CASE WHEN k = 1 THEN 12 END AS link_id, CASE WHEN k <> 2 THEN 'Co ' || (doc_id % 50) END AS company,
         CASE WHEN k = 3 THEN NULL ELSE 'Berlin ' || doc_id END AS location, CASE WHEN k = 4 THEN '2024-01-1' || (doc_id % 10) END AS posted_at,
         CASE k WHEN 0 THEN '$120k' WHEN 5 THEN '80,000 EUR' WHEN 6 THEN NULL ELSE '€' || doc_id END AS compensation
  FROM a WHERE title <> '')
SELECT doc_id, 1 AS n, title, CAST(link_id AS INTEGER) AS link_id, company, location, posted_at, compensation FROM v WHERE doc_id % 11 <> 0
"""


@query(_POSTING_SQL)
def model_postings(spark, sf_dir):
    key = F.col("doc_id")
    k = key % 7
    rows = table(spark, sf_dir, "documents")
    entry = F.struct(
        F.concat(F.lit(" \n"), F.coalesce("text", F.lit("")), F.lit("\t ")).alias("title"), F.when(k == 1, "12").when(k == 2, "x1").when(k == 3, "-4").when(k == 4, "99999999999").alias("link_id"), F.lit(" ").alias("url"),
        F.when(k == 2, "  ").otherwise(F.concat(F.lit(" Co "), key % 50)).alias("company"), F.when(k == 3, F.repeat(F.lit("far away "), 30)).otherwise(F.concat(F.lit("Berlin "), key, F.lit("  "))).alias("location"),
        F.when(k == 4, F.concat(F.lit(" 2024-01-1"), key % 10)).otherwise("last week").alias("posted_at"),
        F.when(k == 0, " $120k ").when(k == 5, "80,000 EUR").when(k == 6, "competitive").otherwise(F.concat(F.lit("€"), key)).alias("compensation"),
    )
    blank = F.struct(*[F.lit(v).cast("string").alias(c) for c, v in (("title", "  "), ("link_id", "1"), ("url", None), ("company", "nobody"), ("location", None), ("posted_at", None), ("compensation", None))])
    whole = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(entry, blank).alias("postings"))), F.lit("\n```"))
    raw = F.when(key % 11 == 0, "Sorry, no postings.").otherwise(whole)
    found = rows.select("doc_id", models.postings(raw).alias("found")).filter("found is not null")
    found = found.select("doc_id", F.size("found").alias("n"), F.explode("found").alias("p"))
    return found.select("doc_id", "n", *[F.col(f"p.{c}").alias(c) for c in ("title", "link_id", "company", "location", "posted_at", "compensation")])


_VERDICT_SQL = """
WITH e AS (SELECT event_id AS id, user_id % 4 AS k, event_type FROM events),
v AS (
  SELECT id, k AS place, CASE WHEN k = 1 THEN 'mismatch' WHEN k = 2 THEN 'borderline' ELSE 'match' END AS verdict, CASE WHEN k = 3 THEN '' ELSE 'seen ' || event_type END AS summary,
         CASE WHEN k = 1 THEN 'not a ' || event_type END AS title_mismatch FROM e
  UNION ALL SELECT id, 4, 'mismatch', 'second', 'other level' FROM e)
SELECT id, place, verdict, summary, title_mismatch FROM v
"""


@query(_VERDICT_SQL.replace("event_id", "ts_id").replace("FROM events", "FROM (SELECT *, epoch_us(ts) || '-' || user_id AS ts_id FROM events)"))
def model_verdicts(spark, sf_dir):
    """One verdict an id, the first; unknown kinds and ids are dropped; a stated mismatch decides, 'none' states nothing."""
    k = F.col("user_id") % 4
    said = lambda i, kind, summary, mismatch: F.struct(i.cast("string").alias("id"), F.lit(kind).alias("verdict") if isinstance(kind, str) else kind.alias("verdict"), summary.alias("summary"), mismatch.cast("string").alias("title_mismatch"))
    kind = F.when(k == 2, "borderline").otherwise("match")
    first = said(k, kind, F.when(k != 3, F.concat(F.lit(" seen "), "event_type")), F.when(k == 1, F.concat(F.lit("not a "), "event_type")).when(k == 2, " None ").when(k == 0, "N/A"))
    again = said(k, "mismatch", F.lit("too late"), F.lit("never"))
    rest = [said(F.lit(4), "match", F.lit("second"), F.lit("other level")), said(F.lit(5), "match", F.lit("no such id"), F.lit(None)), said(F.lit("x"), "match", F.lit("no id"), F.lit(None)), said(F.lit(0), "perhaps", F.lit("no kind"), F.lit(None))]
    raw = F.to_json(F.struct(F.array(said(k, "perhaps", F.lit("no kind"), F.lit(None)), first, again, *rest).alias("verdicts")))
    rows = table(spark, sf_dir, "events").select(F.concat_ws("-", F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.col("user_id").cast("string")).alias("id"), F.explode(models.verdicts(raw, F.lit(5))).alias("place", "v"))
    return rows.select("id", F.col("place").cast("long").alias("place"), "v.verdict", "v.summary", "v.title_mismatch")


_LEVELS = "['verified', 'likely_real', 'uncertain', 'suspicious', 'unknown', 'splendid']"


@query(f"""
WITH d AS (SELECT s_suppkey AS k, s_name, s_acctbal FROM supplier),
v AS (
  SELECT k, CASE WHEN k % 3 = 0 THEN s_name ELSE 'The ' || s_name END AS name, CASE WHEN k % 6 = 5 THEN 'uncertain' ELSE {_LEVELS}[k % 6 + 1] END AS legitimacy, CASE WHEN k % 4 = 1 THEN 'high' ELSE 'low' END AS confidence,
         CASE WHEN k % 5 = 0 THEN NULL ELSE 'Industry ' || (k % 9) END AS industry, CASE WHEN k % 2 = 0 THEN '2001' END AS founded, 2 - k % 2 AS n_founders, k % 3 AS n_flags FROM d)
SELECT k AS s_suppkey, name, legitimacy, confidence, industry, CAST(n_founders AS INTEGER) AS n_founders, CAST(n_flags AS INTEGER) AS n_flags,
       CASE WHEN industry IS NOT NULL THEN 'seed ' || industry ELSE 'seed' END || ', 11-50' AS line,
       array_to_string(list_filter([industry, '11-50', 'seed', CASE WHEN founded IS NOT NULL THEN 'founded ' || founded END], lambda x: x IS NOT NULL), '; ') AS facts,
       'legitimacy: ' || legitimacy || chr(10) || 'confidence: ' || confidence || chr(10) || 'summary: They do ' || k || coalesce(chr(10) || 'industry: ' || industry, '') || chr(10) || 'size: 11-50' || chr(10) || 'stage: seed'
         || coalesce(chr(10) || 'founded: ' || founded, '') || CASE WHEN n_flags > 0 THEN chr(10) || 'flags: ' || array_to_string(list_transform(range(n_flags), lambda i: 'flag ' || i), '; ') ELSE '' END AS prompt,
       CASE WHEN legitimacy IN ('suspicious', 'uncertain') OR confidence = 'low' THEN 'warn' ELSE 'ok' END AS decision
FROM v""")
def company_dossiers(spark, sf_dir):
    """Dossiers validated from a model's JSON, and what is said of a company from them."""
    from tarn.operators.registry import company_facts

    k = F.col("s_suppkey")
    founder = lambda n: F.struct(F.lit(n).alias("name"), F.lit(" ").alias("bio"))
    flags = F.array_append(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.when(i < k % 3, F.concat(F.lit(" flag "), i, F.lit(" "))).otherwise("  ")), F.lit(""))
    raw = F.to_json(F.struct(
        F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit(" The "), "s_name")).alias("name"), F.concat(F.lit("They do "), k, F.lit("  ")).alias("summary"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Industry "), k % 9)).alias("industry"),
        F.lit(" 11-50").alias("size_estimate"), F.lit("seed").alias("stage"), F.lit("  ").alias("funding"), F.when(k % 2 == 0, "2001").alias("founded"), F.element_at(F.array(*map(F.lit, _LEVELS[2:-2].split("', '"))), (k % 6 + 1).cast("int")).alias("legitimacy"),
        F.when(k % 4 == 1, "high").otherwise("rather").alias("confidence"), F.array(founder("A"), founder(" "), F.when(k % 2 == 0, founder("B")).otherwise(founder(""))).alias("founders"), flags.alias("flags"),
    ))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", companies.dossier(raw, F.col("s_name")).alias("d"))
    return rows.select(
        "s_suppkey", "d.name", "d.legitimacy", "d.confidence", "d.industry", F.size("d.founders").alias("n_founders"), F.size("d.flags").alias("n_flags"), companies.summary_line(F.col("d")).alias("line"),
        F.array_join(company_facts(F.col("d")), "; ").alias("facts"), companies.prompt_text(F.col("d")).alias("prompt"), companies.rule_verdict(F.col("d.legitimacy"), F.col("d.confidence"))["decision"].alias("decision"),
    )


# --- tags, chats -----------------------------------------------------------------------------------


@query(r"""
WITH t AS (SELECT p_partkey, p_name, p_type, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, p_name || '|' || p_type || '|' || upper(p_name) AS split, CASE WHEN lower(p_type) = p_name THEN p_name ELSE p_name || ', ' || p_type END AS tags,
       CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS kept, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_chats, (p_partkey % 3 = 0 OR p_partkey = 77) AS to_itself FROM t""")
def tag_lists(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    raw = F.concat(F.lit(" "), name, F.lit(" ;,\n"), F.col("p_type"), F.lit(", "), F.upper(name))
    spaced = F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit(" \n ")), F.lit(" "))
    every = text.distinct_tags(F.array(name, spaced, F.upper(name), F.lit(" ,"), F.col("p_type")))
    kept = text.kept_tags(F.array(F.when(k % 2 == 0, name).otherwise("gone"), F.lit("never there")), F.concat(F.lit("other; "), F.upper(F.replace(name, F.lit(" "), F.lit(" \t ")))))
    ids = F.when(k % 3 == 0, F.concat(F.lit(" 77 ,, "), k)).otherwise(" 77 ")
    token = F.concat(k.cast("string"), F.lit(":secret"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(text.split_tags(raw), "|").alias("split"), text.join_tags(every).alias("tags"), F.array_join(kept, "|").alias("kept"), F.size(text.chat_ids(ids)).alias("n_chats"),
        (text.sends_to_itself(token, ids)).alias("to_itself"),
    )


# --- lists, sources, gates -------------------------------------------------------------------------

_PANELS = {"source": "true", "judge": "filter_status IN ('matched', 'filtered')", "keyword_filter": "keyword_filtered", "company": "company_status = 'warned'", "duplicates": "duplicate_of IS NOT NULL", "notified": "notified_at IS NOT NULL", "filtered": "filter_status = 'filtered'"}
_ROSTER_SQL = " UNION ALL ".join(
    f"(SELECT '{panel}' AS panel, id FROM postings_v WHERE {what} ORDER BY {'notified_at' if panel == 'notified' else 'first_seen_at'} DESC NULLS LAST, id LIMIT 20)" for panel, what in _PANELS.items()
)


@query(_ROSTER_SQL, "p")
def rosters(spark, sf_dir):
    rows, out = postings(spark, sf_dir), None
    for panel in _PANELS:
        part = listing.roster(rows, panel).select(F.lit(panel).alias("panel"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
WITH c AS (SELECT page_id, count(*) FILTER (filter_status = 'matched') AS matched, count(*) FILTER (filter_status = 'filtered') AS filtered FROM postings_v GROUP BY page_id)
SELECT s.page_id, CASE WHEN s.page_id % 10 = 0 AND (last_checked_at IS NULL OR last_checked_at < TIMESTAMP '2024-01-31 20:00:00') THEN 'checking now' WHEN s.page_id % 17 = 3 THEN 'links unreliable' WHEN s.page_id % 17 = 4 THEN 'blocked by site'
            WHEN last_error IS NOT NULL THEN CASE WHEN length(last_error) > 44 THEN substr(last_error, 1, 43) || '…' ELSE last_error END WHEN first_crawl_done THEN 'ok' ELSE 'pending first crawl' END AS status,
       CASE WHEN NOT first_crawl_done THEN 'awaiting first crawl' ELSE coalesce(matched, 0) || ' matched · ' || coalesce(filtered, 0) || ' filtered' END AS stat,
       CASE WHEN first_crawl_done THEN 'pending' ELSE 'skipped' END AS first_status, 'jobs' AS segment
FROM (SELECT * EXCLUDE last_error, CASE WHEN page_id % 19 = 5 THEN repeat('a long error ', 9) ELSE last_error END AS last_error FROM sources_v) s LEFT JOIN c ON c.page_id = s.page_id""", "ps")
def source_rows(spark, sf_dir):
    k = F.col("page_id")
    counts = postings(spark, sf_dir).groupBy("page_id").agg(F.count_if(F.col("filter_status") == "matched").alias("matched"), F.count_if(F.col("filter_status") == "filtered").alias("filtered"))
    said = F.when(k % 19 == 5, F.repeat(F.lit("a long error "), 9)).otherwise(F.col("last_error"))
    error = F.when(k % 17 == 3, display.LINK_WARNING + " (3 of 4)").when(k % 17 == 4, display.BLOCKED_MESSAGE).otherwise(said)
    checking = display.being_checked(k % 10 == 0, F.col("last_checked_at"), F.lit("2024-01-31 20:00:00").cast("timestamp"))
    return sources(spark, sf_dir).join(counts, "page_id", "left").select(
        "page_id", display.source_status(error, F.col("first_crawl_done"), checking).alias("status"), display.source_stat(F.col("first_crawl_done"), F.col("matched"), F.col("filtered")).alias("stat"),
        lifecycle.first_status(F.col("first_crawl_done")).alias("first_status"), url.first_segment(F.col("url")).alias("segment"),
    )


@query(f"""
SELECT id, CASE WHEN trim(company) <> '' AND {_sql_ascii('title')} <> '' THEN {_sql_ascii('title')} || '|' || {_sql_ascii('company')} END AS stored_key, {_sql_norm('title')} AS norm FROM postings_v""", "p")
def stored_keys(spark, sf_dir):
    return postings(spark, sf_dir).select("id", identity.stored_content_key(F.col("title"), F.col("company")).alias("stored_key"), text.norm_text(F.col("title")).alias("norm"))


@query("SELECT id FROM postings_v WHERE filter_status = 'matched' ORDER BY company NULLS LAST, id LIMIT 30 OFFSET 60", "p")
def list_second_page(spark, sf_dir):
    return listing.list_postings(postings(spark, sf_dir), sort="company", ascending=True, limit=30, offset=60, status="matched").select("id")


@query("""
SELECT p_partkey, CASE WHEN p_retailprice > 0 THEN CAST(floor(p_retailprice + 0.5) AS BIGINT) END AS amount, CAST(p_partkey AS BIGINT) * 1000 + p_size AS typed,
       CASE WHEN length(CAST(p_partkey * 1000 + p_size AS VARCHAR)) <= 3 THEN CAST(p_partkey * 1000 + p_size AS VARCHAR) ELSE reverse(regexp_replace(reverse(CAST(p_partkey * 1000 + p_size AS VARCHAR)), '(\\d{3})(?=\\d)', '\\1,', 'g')) END AS grouped
FROM part""".replace("reverse(regexp_replace(reverse(CAST(p_partkey * 1000 + p_size AS VARCHAR)), '(\\d{3})(?=\\d)', '\\1,', 'g'))", "format('{:,}', CAST(p_partkey * 1000 + p_size AS BIGINT))"))
def typed_amounts(spark, sf_dir):
    typed = F.concat(F.lit("$ "), F.col("p_partkey").cast("string"), F.lit("."), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" / yr"))
    n = money.typed_amount(typed)
    return table(spark, sf_dir, "part").select("p_partkey", money.positive_amount(F.col("p_retailprice")).alias("amount"), n.alias("typed"), money.grouped(n).alias("grouped"))
