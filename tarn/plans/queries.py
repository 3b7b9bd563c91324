"""The registered queries of the monitor, each beside its SQL.

Queries read whole tables. A list is cut only where cutting is what it does (pages of a list, caps per run).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import dates, display, html, money, place, text, url
from tarn.operators import companies, gates, identity, lifecycle, links, registry
from tarn.plans import listing
from tarn.plans.stored import stored
from tarn.plans.tables import POSTINGS_SQL, SOURCES_SQL, postings, sources, table
from tarn.sources import attempts, boards, feeds
from tarn.streaming.poll import ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"
PROFILE = gates.Profile(
    roles="Red Widget, Blue Gear", role_synonyms="hot plate; old anvil", title_keywords="red, gear; widget", compensation="From $20K / yr",
    locations_include=("Nation 1", "NATION_2"), locations_exclude=("nation-13",), compensation_min=20_000, negative_keywords="small economy\nplate promo, OLD",
)


def query(sql: str | None = None, views: str = ""):
    """Registers a query and its SQL; views: the derived tables that the SQL starts from."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            parts = [v for k, v in (("p", POSTINGS_SQL), ("s", SOURCES_SQL)) if k in views]
            body = sql.strip()
            if parts:
                head = "WITH " + ", ".join(x.strip() for x in parts)
                body = head + (", " + body[5:] if body.startswith("WITH ") else " " + body)
            ORACLE[f.__name__] = body
        return f

    return register


def _now():
    return F.lit(NOW).cast("timestamp")


def _sql_norm(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _sql_ascii(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


# --- pages: addresses, anchors, text ---------------------------------------------------------------

_TRACKED = ", ".join(f"'{p}'" for p in url.TRACKING)
_ABSOLUTE = r"'(?i)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?'"
_CANONICAL = rf"""
regexp_replace(lower(regexp_extract(u, {_ABSOLUTE}, 1)) || '://' || lower(regexp_extract(u, {_ABSOLUTE}, 2))
  || CASE WHEN regexp_extract(u, {_ABSOLUTE}, 3) = '' THEN '/' ELSE regexp_extract(u, {_ABSOLUTE}, 3) END
  || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_transform(kept, lambda x: x.p), '&') END, '/$', '')
"""
_KEPT = rf"""
list_sort(list_filter(list_transform(list_filter(string_split(substr(regexp_extract(u, {_ABSOLUTE}, 4), 2), '&'), lambda p: p <> ''),
  lambda p, i: {{'k': string_split(p, '=')[1], 'i': i, 'p': CASE WHEN contains(p, '=') THEN p ELSE p || '=' END}}), lambda x: lower(x.k) NOT IN ({_TRACKED})))
"""


@query(f"WITH q AS (SELECT page_id, url AS u, {_KEPT.replace('u,', 'url,')} AS kept FROM pages) SELECT page_id, {_CANONICAL} AS canonical, lower({_CANONICAL}) AS dedupe_key FROM q")
def canonical_url(spark, sf_dir):
    c = url.canonical(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", c.alias("canonical"), url.dedupe_key(c).alias("dedupe_key"))


@query()
def canonical_url_full(spark, sf_dir):
    """The same with full resolution; equal to canonical_url on absolute addresses without escapes."""
    return table(spark, sf_dir, "pages").select("page_id", url.canonical_url("url", F.lit("https://example.org/")).alias("canonical"))


_STORED = rf"""regexp_replace(regexp_replace(regexp_replace(split_part(coalesce(url, ''), '#', 1), '{url.STORED_TRACKING}', '\1', 'gi'), '\?&+', '?', 'g'), '[?&]+$', '')"""


@query(f"""
WITH k AS (SELECT page_id, url, lower(coalesce(nullif(regexp_replace({_STORED}, '/$', ''), ''), url)) AS group_key FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY page_id) AS rn FROM k)
SELECT page_id, group_key FROM r WHERE rn = 1""")
def sql_url_backfill_survivors(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.lit(0).alias("page_id"), "url", F.col("url").alias("dedupe_key"), F.lit(0).alias("first_seen_at"), F.lit(1).alias("notified_at")
    )
    return identity.survivors(rows).select(F.col("id").alias("page_id"), "group_key")


@query(r"""
WITH h AS (SELECT page_id, url, list_filter(string_split(regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#:]*)', 1)), '^www\.', ''), '.'), lambda p: p <> '') AS a FROM pages),
n AS (SELECT page_id, CASE WHEN len(a) >= 2 THEN a[len(a) - 1] ELSE a[1] END AS name FROM h)
SELECT page_id, upper(substr(name, 1, 1)) || substr(name, 2) AS label FROM n""")
def source_label(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.label(F.col("url")).alias("label"))


_ANCHOR = r"""'(?is)<a\b(?:[^>]*?\s)?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a\s*>'"""
_DECODED = "replace(replace(replace(replace(replace({0}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"
_ANCHORS_SQL = rf"""
anchors AS (
  SELECT page_id, url, i AS link_id, {_DECODED.format("hrefs[i]")} AS href, regexp_replace(regexp_replace(regexp_replace(texts[i], '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text
  FROM (SELECT page_id, url, hrefs, texts, unnest(range(1, len(hrefs) + 1)) AS i
        FROM (SELECT page_id, url, regexp_extract_all(html, {_ANCHOR}, 1) AS hrefs, regexp_extract_all(html, {_ANCHOR}, 2) AS texts FROM pages)))
"""


def anchor_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(html.anchors(F.col("html"))).alias("i", "a"))
    return rows.select("page_id", "url", (F.col("i") + 1).alias("link_id"), "a.href", "a.text")


@query(f"WITH {_ANCHORS_SQL} SELECT page_id, link_id, href, text FROM anchors")
def anchor_table(spark, sf_dir):
    return anchor_rows(spark, sf_dir).select("page_id", "link_id", "href", "text")


def usable_rows(spark, sf_dir):
    rows = anchor_rows(spark, sf_dir).withColumn("link", url.resolved(F.col("href"), F.col("url")))
    return rows.withColumn("usable", url.usable(F.col("link"), F.col("url")))


_USABLE_SQL = rf"""
found AS (SELECT *, regexp_extract(url, '(?i)^(https?://[^/?#]*)', 1) || href AS link, regexp_extract(href, '^([^?#]*)', 1) AS path FROM anchors),
usable AS (
  SELECT * FROM found
  WHERE href LIKE '/%' AND NOT (path IN ('', '/') AND NOT contains(href, '?'))
    AND NOT regexp_matches(path, '{url.AD_PATH}') AND NOT regexp_matches(path, '{url.CLICK_PATH}') AND NOT regexp_matches(path, '{url.TAXONOMY_PATH}') AND NOT regexp_matches(path, '{url.SITE_PATH}')
    AND lower(link) <> lower(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/$', '')))
"""


@query(f"WITH {_ANCHORS_SQL}, {_USABLE_SQL} SELECT page_id, count(*) AS n_links, count(DISTINCT lower(link)) AS n_targets FROM usable GROUP BY page_id")
def usable_links(spark, sf_dir):
    rows = usable_rows(spark, sf_dir).filter("usable")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct(F.lower("link")).alias("n_targets"))


_TEXT = r"html"
for _pattern, _new in ((r"\[\[(/?)(\d+)\]\]", " "), (r"(?i)<script[\s\S]*?</script>", " "), (r"(?i)<style[\s\S]*?</style>", " "), (r"(?i)<noscript[\s\S]*?</noscript>", " "),
                       (r"<!--[\s\S]*?-->", " "), (r"(?i)</?a\b[^>]*>", ""), (r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])[^>]*>", "@@LF@@"), (r"<[^>]+>", " ")):
    _TEXT = f"regexp_replace({_TEXT}, '{_pattern}', '{_new}', 'g')"
_TEXT = "replace(replace(" + _TEXT + ", '@@LF@@', chr(10)), '&nbsp;', ' ')"
_TEXT = "regexp_replace(regexp_replace(" + _DECODED.format(_TEXT) + r", '(?i)&#x27;', '''', 'g'), '[ \t]+', ' ', 'g')"
_TEXT = rf"regexp_replace(regexp_replace({_TEXT}, '(\$?\b\d+)\s+,\s*(\d{{3}}\b)', '\1,\2', 'g'), '\n\s*\n+', chr(10), 'g')"
_TEXT = rf"regexp_replace({_TEXT}, '^\s+|\s+$', '', 'g')"


@query(f"WITH t AS (SELECT page_id, {_TEXT} AS t FROM pages) SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256 FROM t")
def html_text(spark, sf_dir):
    t = html.plain_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), html.content_hash(t).alias("text_sha256"))


@query()
def html_marked(spark, sf_dir):
    """Pages with numbered link markers; tested against written cases."""
    marked = table(spark, sf_dir, "pages").select("page_id", html.marked_html("html", "url").alias("m"))
    return marked.select("page_id", F.size("m.links").alias("n_links"), F.length("m.text").alias("n_chars"), F.sha2("m.text", 256).alias("text_sha256"), "m.truncated")


@query()
def page_cards(spark, sf_dir):
    """The cards of pages; tested against written cases."""
    from tarn.operators.cards import cards

    return table(spark, sf_dir, "pages").select("page_id", F.explode(cards("html", "url")).alias("c")).select("page_id", "c.href", "c.title")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", html.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


_SIGNS = ", ".join(f"'{s}'" for s in html.BLOCK_SIGNS)


@query(f"""
WITH t AS (SELECT doc_id, text, lower(substr(text, 1, 3000)) AS head FROM documents)
SELECT doc_id, coalesce(list_filter([{_SIGNS}], lambda s: contains(head, s))[1], CASE WHEN contains(head, 'challenge-platform') THEN 'challenge-platform' END) AS sign,
       length(text) < 500 AS is_shell, length(text) > 20000 AS is_cut FROM t""")
def block_signature(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", html.block_sign(t).alias("sign"), html.is_shell(t).alias("is_shell"), (F.length(html.capped(t, 20_000)) < F.length(t)).alias("is_cut"))


@query(f"""
SELECT doc_id, sha256({_sql_norm('text')}) AS norm_sha256, sha256({_sql_ascii('text')}) AS ascii_sha256,
       CAST(len(list_filter(string_split({_sql_norm('text')}, ' '), lambda t: t <> '' AND t NOT IN ({", ".join(f"'{w}'" for w in text.STOPWORDS)}))) AS INTEGER) AS n_tokens FROM documents""")
def norm_texts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(text.norm_text(t), 256).alias("norm_sha256"), F.sha2(text.ascii_text(t), 256).alias("ascii_sha256"), F.size(text.tokens(t)).alias("n_tokens")
    )


# --- attempts, feeds, boards -----------------------------------------------------------------------


def _attempts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = F.array(*map(F.lit, attempts.STRATEGIES))
    k = (F.col("doc_id") % 4).cast("int")
    return docs.select(
        F.floor(F.col("doc_id") / 4).cast("long").alias("page_id"), (k + 1).alias("attempt_no"), F.get(names, k).alias("strategy"), F.col("text").alias("content"),
        (F.col("doc_id") % 3).cast("int").alias("n_links"), (F.col("doc_id") % 2 == 0).alias("link_bearing"), F.when(F.col("doc_id") % 5 == 0, "HTTP 500").alias("error"),
    )


@query(f"""
WITH a AS (SELECT doc_id // 4 AS page_id, doc_id % 4 + 1 AS attempt_no, ['direct', 'direct-alt', 'direct-social', 'proxy:pure'][doc_id % 4 + 1] AS strategy, text,
  doc_id % 2 = 0 AND doc_id % 3 = 0 AS bare, CASE WHEN doc_id % 5 = 0 THEN 'HTTP 500' END AS error,
  list_filter([{_SIGNS}, 'challenge-platform'], lambda s: contains(lower(substr(text, 1, 3000)), s))[1] AS sign FROM documents),
t AS (SELECT *, CASE WHEN error IS NOT NULL OR sign IS NOT NULL THEN 4 WHEN length(text) < 500 THEN 3 WHEN bare THEN 2 ELSE 1 END AS tier FROM a),
e AS (SELECT page_id, string_agg(strategy || ': ' || coalesce(error, 'blocked by anti-bot check (matched "' || sign || '")'), ' | ' ORDER BY attempt_no) AS errors FROM t WHERE tier = 4 GROUP BY page_id),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY tier, CASE WHEN tier > 1 THEN -length(text) END NULLS FIRST, attempt_no) AS rn FROM t)
SELECT page_id, CASE WHEN tier < 4 THEN strategy END AS strategy, CASE WHEN tier < 4 THEN length(text) END AS n_chars, CASE WHEN tier < 4 THEN bare OR tier > 1 END AS degraded,
       CASE WHEN tier = 4 THEN errors END AS error FROM r LEFT JOIN e USING (page_id) WHERE rn = 1""")
def attempt_tiering(spark, sf_dir):
    best = attempts.select_attempts(_attempts(spark, sf_dir))
    return best.select("page_id", "strategy", F.length("content").cast("long").alias("n_chars"), "degraded", "error")


def _feed_bodies(spark, sf_dir):
    """A feed per page, made of its anchors."""
    a = anchor_rows(spark, sf_dir).filter("text != ''")
    item = F.concat(F.lit("<item><title><![CDATA["), "text", F.lit("]]></title><link>"), "url", "href", F.lit("</link><pubDate>2024-01-0"), (F.col("link_id") % 9 + 1).cast("string"), F.lit("</pubDate></item>"))
    items = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("link_id", item.alias("x")))), lambda s: s["x"]), "\n")
    return a.groupBy("page_id").agg(F.concat(F.lit("<rss><channel>"), items, F.lit("</channel></rss>")).alias("body"))


@query(f"""WITH {_ANCHORS_SQL} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY link_id) - 1 AS INTEGER) AS pos, trim(text) AS title, url || href AS url,
 '2024-01-0' || (link_id % 9 + 1) AS posted_text FROM anchors WHERE text <> ''""")
def rss_items(spark, sf_dir):
    return feeds.items(_feed_bodies(spark, sf_dir)).select("page_id", "pos", "title", "url", "posted_text")


@query(f"WITH {_ANCHORS_SQL} SELECT page_id, count(*) AS n, count(nullif(url || href, '')) AS linked FROM anchors WHERE text <> '' GROUP BY page_id HAVING count(nullif(url || href, '')) / count(*) >= 0.8")
def feed_acceptance(spark, sf_dir):
    return feeds.accepted(feeds.items(_feed_bodies(spark, sf_dir)), "page_id")


@query(rf"""
WITH q AS (SELECT page_id, regexp_extract(url, '(?i)^(https?://[^/?#]*)', 1) AS origin, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '') AS beside FROM pages),
c AS (SELECT page_id, list_concat([beside || p FOR p IN ['/feed', '/rss', '.rss']], [origin || p FOR p IN [{", ".join(f"'{p}'" for p in (*feeds.JOB_PATHS, *feeds.ORIGIN_PATHS))}]]) AS every FROM q)
SELECT page_id, CAST(min(i) - 1 AS INTEGER) AS probe, candidate FROM (SELECT page_id, unnest(every) AS candidate, unnest(range(1, len(every) + 1)) AS i FROM c) GROUP BY page_id, candidate""")
def feed_candidates(spark, sf_dir):
    return feeds.candidates(table(spark, sf_dir, "pages"), body="html").select("page_id", "probe", "candidate")


def _board_bodies(spark, sf_dir):
    """A board body per supplier, made of its parts' postings."""
    rows = postings(spark, sf_dir).groupBy("page_id", "title", "location").agg(F.min("id").alias("id"))
    job = F.struct(F.col("title"), F.concat(F.lit("https://x.example.com/"), "id").alias("absolute_url"), F.struct(F.col("location").alias("name")).alias("location"))
    return rows.groupBy("page_id").agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("body"))


@query("SELECT page_id, title, 'https://x.example.com/' || min(id) AS url, location FROM postings_v GROUP BY page_id, title, location", "p")
def ats_json(spark, sf_dir):
    return boards.greenhouse(_board_bodies(spark, sf_dir)).select("page_id", "title", "url", "location")


# --- keys, duplicates, merges ----------------------------------------------------------------------


@query(f"SELECT DISTINCT title, company, location, 't:' || {_sql_norm('title')} || '|c:' || {_sql_norm('company')} || '|l:' || {_sql_norm('location')} AS title_key, {_sql_norm('title')} || '|' || {_sql_norm('company')} AS content_key FROM postings_v", "p")
def norm_text_keys(spark, sf_dir):
    c = [F.col(x) for x in ("title", "company", "location")]
    return postings(spark, sf_dir).select(*c).distinct().select(*c, identity.title_key(*c).alias("title_key"), identity.content_key(c[0], c[1]).alias("content_key"))


_SUFFIXES = "|".join(text.LEGAL_SUFFIXES)


@query(rf"""SELECT s_suppkey, regexp_replace(trim(regexp_replace(lower(s_name || CASE s_suppkey % 3 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Pvt. Ltd' ELSE ' & Co' END), '[.,''’"“”&()\-–—/\s]+', ' ', 'g')), '( ({_SUFFIXES}))+$', '') AS norm_name FROM supplier""")
def company_normalise(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    name = F.concat("s_name", F.when(k == 0, ", Inc.").when(k == 1, " Pvt. Ltd").otherwise(" & Co"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.company_name(name).alias("norm_name"))


_KEYED = f"keyed AS (SELECT *, {_sql_norm('title')} || '|' || {_sql_norm('company')} AS content_key FROM postings_v)"


def _keyed(spark, sf_dir):
    return postings(spark, sf_dir).withColumn("content_key", identity.content_key(F.col("title"), F.col("company")))


@query(f"""
WITH {_KEYED},
m AS (SELECT a.id, b.id AS dup_id, row_number() OVER (PARTITION BY a.id ORDER BY b.notified_at, b.id) AS rn FROM keyed a JOIN keyed b
  ON a.content_key = b.content_key AND a.id <> b.id AND b.notified_at <= a.first_seen_at AND b.notified_at >= a.first_seen_at - INTERVAL 14 DAY)
SELECT id, dup_id AS duplicate_of FROM m WHERE rn = 1""", "p")
def cross_source_duplicates(spark, sf_dir):
    return identity.duplicates(_keyed(spark, sf_dir))


def _crawl(spark, sf_dir, later: bool):
    """Two crawls of the same listings: the later one has new slugs for some titles, and lacks others."""
    rows = postings(spark, sf_dir).groupBy("page_id", "title").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    slug = F.regexp_replace(F.lower("title"), " ", "-")
    if later:
        rows = rows.filter(F.length("title") % 5 != 0)
        slug = F.when(F.col("n") % 2 == 0, F.concat(slug, F.lit("-new"))).otherwise(slug)
    return rows.select("page_id", "id", slug.alias("dedupe_key"), identity.title_key(F.col("title"), F.lit(None), F.lit(None)).alias("title_key"), F.concat(F.lit("https://x.example.com/"), slug).alias("url"), "n")


_CRAWLS = """
g AS (SELECT page_id, title, min(id) AS id, count(*) AS n FROM postings_v GROUP BY page_id, title),
old AS (SELECT page_id, id, n, replace(lower(title), ' ', '-') AS dedupe_key, title FROM g),
new AS (SELECT page_id, id, n, replace(lower(title), ' ', '-') || CASE WHEN n % 2 = 0 THEN '-new' ELSE '' END AS dedupe_key, title FROM g WHERE length(title) % 5 <> 0)
"""


@query(f"WITH {_CRAWLS} SELECT new.page_id, new.dedupe_key, old.id FROM new JOIN old ON new.page_id = old.page_id AND new.title = old.title WHERE new.dedupe_key <> old.dedupe_key AND NOT EXISTS (SELECT 1 FROM new x WHERE x.page_id = old.page_id AND x.dedupe_key = old.dedupe_key)", "p")
def rename_merge(spark, sf_dir):
    return links.rename_merges(_crawl(spark, sf_dir, True), _crawl(spark, sf_dir, False))


@query(f"WITH {_CRAWLS} SELECT page_id, dedupe_key, id FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.page_id = new.page_id AND old.dedupe_key = new.dedupe_key)", "p")
def new_rows_anti(spark, sf_dir):
    return identity.new_rows(_crawl(spark, sf_dir, True), _crawl(spark, sf_dir, False)).select("page_id", "dedupe_key", "id")


@query(f"WITH {_CRAWLS} SELECT old.id, 'https://y.example.com/' || new.dedupe_key AS url, 'cited' AS link_source FROM new JOIN old ON new.page_id = old.page_id AND new.dedupe_key = old.dedupe_key WHERE old.n % 3 = 0 OR new.n % 3 = 1", "p")
def repair_rows(spark, sf_dir):
    n = F.col("n") % 3
    extra = {"link_note": F.lit(None).cast("string"), "link_score": F.lit(1.0)}
    old = _crawl(spark, sf_dir, False).withColumns({"link_source": F.when(n == 0, "unknown").otherwise("cited"), "url": F.when(n == 2, F.concat(F.lit("https://y.example.com/"), "dedupe_key")).otherwise(F.col("url")), **extra})
    new = _crawl(spark, sf_dir, True).withColumns({"link_source": F.lit("cited"), "url": F.concat(F.lit("https://y.example.com/"), "dedupe_key"), **extra})
    return identity.repairs(new, old).select("id", "url", "link_source")


@query(f"""
WITH n AS (SELECT id, page_id, url AS dedupe_key, regexp_replace(lower({_STORED}), '/$', '') AS new_key FROM postings_v)
SELECT id, CASE WHEN EXISTS (SELECT 1 FROM n o WHERE o.page_id = n.page_id AND o.dedupe_key = n.new_key AND o.id <> n.id) THEN dedupe_key ELSE new_key END AS dedupe_key FROM n""", "p")
def not_exists_keys(spark, sf_dir):
    return identity.backfilled_keys(postings(spark, sf_dir).withColumn("dedupe_key", F.col("url"))).select("id", "dedupe_key")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY id) AS rn FROM postings_v) SELECT id, page_id, url FROM r WHERE rn = 1", "p")
def first_of_crawl(spark, sf_dir):
    rows = postings(spark, sf_dir).select("id", "page_id", "url", F.col("url").alias("dedupe_key"), F.col("id").alias("pos"))
    return identity.first_of_crawl(rows).select("id", "page_id", "url")


# --- gates -----------------------------------------------------------------------------------------

_WANTED, _BLOCKED = "['red', 'gear', 'widget']", "['small economy', 'plate promo', 'old']"
_GATE_ROWS = "WITH d AS (SELECT DISTINCT title, location, compensation FROM postings_v)"


def _distinct(spark, sf_dir, *columns):
    return postings(spark, sf_dir).select(*columns).distinct()


@query(f"SELECT DISTINCT title, len(list_filter({_WANTED}, lambda k: contains({_sql_ascii('title')}, k))) > 0 AS wanted FROM postings_v", "p")
def title_keyword_gate(spark, sf_dir):
    return _distinct(spark, sf_dir, "title").select("title", gates.title_wanted(F.col("title"), PROFILE.title_keywords).alias("wanted"))


@query(f"SELECT DISTINCT title, list_filter({_BLOCKED}, lambda k: contains(lower(title), k))[1] AS keyword FROM postings_v", "p")
def negative_keyword_gate(spark, sf_dir):
    return _distinct(spark, sf_dir, "title").select("title", gates.blocked_keyword(F.col("title"), PROFILE.negative_keywords).alias("keyword"))


_PLACE = "trim(regexp_replace(regexp_replace(lower(location), '[.''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_KIND = f"CASE WHEN contains({_PLACE}, 'nation 13') THEN 'excluded' WHEN NOT (contains({_PLACE}, 'nation 1') OR contains({_PLACE}, 'nation 2')) THEN 'not-included' END"


@query(f"SELECT DISTINCT location, {_KIND} IS NULL AS ok, {_KIND} AS kind, CASE WHEN {_KIND} = 'excluded' THEN 'nation-13' END AS term FROM postings_v", "p")
def location_gate(spark, sf_dir):
    return _distinct(spark, sf_dir, "location").select("location", gates.location_decision(F.col("location"), PROFILE).alias("d")).select("location", "d.*")


_PAY_TEXT = "raw"
_PAY_RAW = """
WITH d AS (SELECT DISTINCT l_extendedprice AS price, l_partkey % 8 AS k FROM lineitem),
r AS (SELECT price, k, CAST(floor(price) AS BIGINT) AS n, CASE k WHEN 0 THEN '$' || n WHEN 1 THEN '€' || n || ' - ' || (n + 500) WHEN 2 THEN '$' || n || ' per month' WHEN 3 THEN (n // 1000) || 'k GBP'
  WHEN 4 THEN '$' || n || '/hr' WHEN 5 THEN 'Competitive' WHEN 6 THEN '₹' || n || '.75 per annum' ELSE '1.5m usd' END AS raw FROM d)
"""


def _pays(spark, sf_dir):
    n, k = F.floor("l_extendedprice").cast("long"), F.col("l_partkey") % 8
    s = n.cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("$"), s)).when(k == 1, F.concat(F.lit("€"), s, F.lit(" - "), (n + 500).cast("string"))).when(k == 2, F.concat(F.lit("$"), s, F.lit(" per month")))
        .when(k == 3, F.concat(F.expr("cast(floor(l_extendedprice) as bigint) div 1000").cast("string"), F.lit("k GBP"))).when(k == 4, F.concat(F.lit("$"), s, F.lit("/hr"))).when(k == 5, "Competitive")
        .when(k == 6, F.concat(F.lit("₹"), s, F.lit(".75 per annum"))).otherwise("1.5m usd")
    )
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("price"), k.alias("k"), raw.alias("raw"), n.alias("n")).distinct()


_PAY_MAX = "CASE k WHEN 0 THEN CASE WHEN n >= 1000 THEN n::DOUBLE END WHEN 1 THEN CASE WHEN n + 500 >= 1000 THEN (n + 500)::DOUBLE END WHEN 2 THEN n * 12::DOUBLE WHEN 3 THEN CASE WHEN n // 1000 > 0 THEN (n // 1000) * 1000::DOUBLE END WHEN 6 THEN CASE WHEN n >= 1000 THEN n::DOUBLE END WHEN 7 THEN 1500000::DOUBLE END"
_PAY_CUR = f"CASE WHEN ({_PAY_MAX}) IS NOT NULL THEN CASE k WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'GBP' WHEN 6 THEN 'INR' WHEN 7 THEN 'USD' END END"


@query(f"{_PAY_RAW} SELECT price, k, {_PAY_MAX} AS max_per_year, {_PAY_CUR} AS currency FROM r")
def compensation_parse(spark, sf_dir):
    return _pays(spark, sf_dir).select("price", "k", money.pay(F.col("raw")).alias("p")).select("price", "k", "p.max_per_year", "p.currency")


@query(f"{_PAY_RAW} SELECT price, k, (({_PAY_MAX}) IS NULL OR {_PAY_CUR} <> 'USD' OR ({_PAY_MAX}) >= 20000) AS ok FROM r")
def compensation_gate(spark, sf_dir):
    return _pays(spark, sf_dir).select("price", "k", gates.pay_ok(F.col("raw"), PROFILE).alias("ok"))


@query("""
WITH d AS (SELECT DISTINCT CAST(floor(l_extendedprice) AS BIGINT) * (1 + l_partkey % 90) AS n, l_partkey % 2 AS k FROM lineitem),
t AS (SELECT n, k, CASE WHEN k = 0 AND n >= 1000000 THEN 1000000 WHEN k = 1 AND n >= 10000000 THEN 10000000 WHEN k = 1 AND n >= 100000 THEN 100000 WHEN n >= 1000 THEN 1000 ELSE 0 END AS unit FROM d),
v AS (SELECT *, CASE WHEN unit > 0 THEN (n * 10 + unit // 2) // unit END AS tenths FROM t)
SELECT n, k, CASE WHEN k = 0 THEN '$' ELSE '₹' END || CASE WHEN unit = 0 THEN CAST(n AS VARCHAR) ELSE (tenths // 10) || CASE WHEN tenths % 10 = 0 THEN '' ELSE '.' || (tenths % 10) END
  || CASE WHEN unit = 1000 THEN 'K' WHEN unit = 100000 THEN 'L' WHEN unit = 10000000 THEN 'Cr' ELSE 'M' END END AS shown FROM v""")
def compact_amount(spark, sf_dir):
    n, k = F.floor("l_extendedprice").cast("long") * (F.col("l_partkey") % 90 + 1), F.col("l_partkey") % 2
    rows = table(spark, sf_dir, "lineitem").select(n.alias("n"), k.alias("k")).distinct()
    return rows.select("n", "k", money.compact(F.col("n"), F.when(F.col("k") == 0, "USD").otherwise("INR")).alias("shown"))


_TITLE_OK = f"len(list_filter({_WANTED}, lambda k: contains({_sql_ascii('title')}, k))) > 0"
_N = "CAST(substr(compensation, 2) AS BIGINT)"
_HELD = "'Held back before the AI judge: \"' || title || '\" "
_PRE = f"""
CASE WHEN NOT ({_TITLE_OK}) THEN 'Held back before the AI judge: "' || title || '" doesn''t contain any of the profile''s declared title keywords ({PROFILE.title_keywords}).'
  WHEN {_KIND} = 'excluded' THEN {_HELD}is in ' || location || ', which matches your excluded location "nation-13".'
  WHEN {_KIND} = 'not-included' THEN {_HELD}is in ' || location || ', which isn''t one of your included locations (Nation 1, NATION_2).'
  WHEN {_N} >= 1000 AND {_N} < 20000 THEN {_HELD}states pay of ' || compensation || ', below your target of {PROFILE.compensation}.' END
"""


@query(f"{_GATE_ROWS} SELECT title, location, compensation, {_PRE} AS summary, CASE WHEN ({_PRE}) IS NOT NULL THEN 'mismatch' END AS verdict FROM d", "p")
def prefilter_verdict(spark, sf_dir):
    rows = _distinct(spark, sf_dir, "title", "location", "compensation")
    v = gates.pre_filter(F.col("title"), F.col("location"), F.col("compensation"), PROFILE)
    return rows.select("title", "location", "compensation", v.alias("v")).select("title", "location", "compensation", "v.summary", "v.verdict")


_SCOPE = "['red widget', 'blue gear', 'hot plate', 'old anvil']"


@query(f"""
WITH d AS (SELECT DISTINCT title, l % 2 = 0 AS thin FROM (SELECT title, length(compensation) AS l FROM postings_v)),
s AS (SELECT *, len(list_filter({_SCOPE}, lambda k: contains({_sql_ascii('title')}, k) OR contains(k, {_sql_ascii('title')}))) > 0 AS in_scope FROM d)
SELECT title, thin, in_scope, CASE WHEN thin AND NOT in_scope THEN 'mismatch' ELSE 'match' END AS verdict FROM s""", "p")
def thin_backstop(spark, sf_dir):
    rows = postings(spark, sf_dir).select("title", (F.length("compensation") % 2 == 0).alias("thin")).distinct()
    said = F.struct(F.lit("match").alias("verdict"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("title_mismatch"))
    other = F.when(F.col("thin"), F.lit(None).cast("string")).otherwise("x")
    v = gates.thin_backstop(said, F.col("title"), other, other, other, PROFILE)
    return rows.select("title", "thin", gates.within_scope(F.col("title"), PROFILE.roles, PROFILE.role_synonyms).alias("in_scope"), v["verdict"].alias("verdict"))


# --- titles and anchors ----------------------------------------------------------------------------


def _first_words(spark, sf_dir):
    """doc_id and the first eight words of every document: what titles and anchors are made of."""
    return table(spark, sf_dir, "documents").select("doc_id", text.first_tokens(F.col("text"), 8).alias("words"))


def _titles(words):
    """Every document of a page's number as a title to place: its first five words."""
    return words.select((F.col("doc_id") % 50).alias("page_id"), F.col("doc_id").alias("pos"), F.array_join(F.slice("words", 1, 5), " ").alias("title"))


def _page_anchors(words):
    """Anchors of page k: the first eight words of every document whose number divides likewise, shifted."""
    href = F.concat(F.lit("https://x.example.com/"), (F.col("doc_id") % 40).cast("string"))
    return words.select(((F.col("doc_id") + F.col("doc_id") % 3) % 50).alias("page_id"), F.col("doc_id").alias("link_id"), href.alias("href"), F.array_join("words", " ").alias("text"))


_WORDS = f"list_filter(string_split({_sql_norm('text')}, ' '), lambda t: t <> '' AND t NOT IN ({', '.join(repr(w) for w in text.STOPWORDS)}))"
_MATCHING = f"""
w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
titles AS (SELECT doc_id % 50 AS page_id, doc_id AS pos, array_to_string(words[1:5], ' ') AS title, words[1:5] AS tw FROM w),
links_v AS (SELECT (doc_id + doc_id % 3) % 50 AS page_id, doc_id AS link_id, 'https://x.example.com/' || (doc_id % 40) AS href, array_to_string(words[1:8], ' ') AS text, words[1:8] AS aw FROM w),
scored AS (SELECT t.page_id, pos, link_id, href, CASE WHEN len(tw) = 0 OR len(aw) = 0 THEN 0.0::DOUBLE
  WHEN title <> '' AND contains(text, title) THEN least(1.0::DOUBLE, len(list_filter(tw, lambda x: list_contains(aw, x)))::DOUBLE / len(tw) + 0.15::DOUBLE)
  ELSE len(list_filter(tw, lambda x: list_contains(aw, x)))::DOUBLE / len(tw) END AS score FROM titles t JOIN links_v USING (page_id) WHERE len(list_intersect(tw, aw)) > 0),
ranked AS (SELECT *, row_number() OVER o AS rn, coalesce(lead(score) OVER o, 0) AS nxt FROM scored WINDOW o AS (PARTITION BY page_id, pos ORDER BY score DESC, link_id)),
best AS (SELECT page_id, pos, link_id, href, score FROM ranked WHERE rn = 1 AND score >= 0.6 AND score - nxt >= 0.15)
"""


@query(f"WITH {_MATCHING} SELECT page_id, pos, link_id, round(score, 6) AS score FROM best")
def title_anchor_best(spark, sf_dir):
    words = stored(_first_words(spark, sf_dir), "first-words")
    best = links.best_anchor(_titles(words), _page_anchors(words))
    return best.select("page_id", "pos", "link_id", F.round("score", 6).alias("score"))


@query(f"""
WITH {_MATCHING},
c AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY score DESC, pos) AS claim FROM best),
again AS (SELECT c.page_id, c.pos, s.href, s.score, row_number() OVER o AS k, coalesce(lead(s.score) OVER o, 0) AS nxt
  FROM c JOIN scored s ON s.page_id = c.page_id AND s.pos = c.pos AND s.href <> c.href WHERE claim > 1 WINDOW o AS (PARTITION BY c.page_id, c.pos ORDER BY s.score DESC, s.link_id)),
alt AS (SELECT * FROM again WHERE k = 1 AND score >= 0.6 AND score - nxt >= 0.15)
SELECT t.page_id, t.pos, CASE WHEN claim > 1 THEN alt.href ELSE c.href END AS url, CASE WHEN c.href IS NULL THEN 'none' WHEN claim > 1 AND alt.href IS NULL THEN 'none' ELSE 'matched' END AS source,
       round(CASE WHEN claim > 1 AND alt.href IS NOT NULL THEN alt.score ELSE c.score END, 6) AS score
FROM titles t LEFT JOIN c ON c.page_id = t.page_id AND c.pos = t.pos LEFT JOIN alt ON alt.page_id = t.page_id AND alt.pos = t.pos""")
def href_arbitration(spark, sf_dir):
    words = stored(_first_words(spark, sf_dir), "first-words")
    rows = _titles(words).withColumns({"link_id": F.lit(None).cast("long"), "url": F.lit(None).cast("string")})
    out = links.resolve(rows, _page_anchors(words).withColumn("usable", F.lit(True)))
    return out.select("page_id", "pos", "url", "source", F.round("score", 6).alias("score"))


# --- lists and counts ------------------------------------------------------------------------------


@query("SELECT id, title, company FROM postings_v WHERE filter_status = 'matched' AND notified_at IS NULL ORDER BY first_seen_at DESC NULLS LAST, id LIMIT 50 OFFSET 50", "p")
def list_postings(spark, sf_dir):
    return listing.list_postings(postings(spark, sf_dir), limit=50, offset=50, status="matched", notified=False).select("id", "title", "company")


@query("SELECT id, page_label, page_url FROM (SELECT p.id, s.label AS page_label, s.url AS page_url, notified_at FROM postings_v p LEFT JOIN sources_v s USING (page_id)) ORDER BY notified_at NULLS LAST, id LIMIT 200", "ps")
def list_with_sources(spark, sf_dir):
    page = listing.list_postings(postings(spark, sf_dir), sort="notified_at", ascending=True, limit=500)
    return listing.with_sources(page, sources(spark, sf_dir)).select("id", "page_label", "page_url")


@query("SELECT count(*) AS total FROM postings_v WHERE filter_status IN ('matched', 'filtered') AND duplicate_of IS NOT NULL AND pending_notify", "p")
def count_postings(spark, sf_dir):
    return listing.count_postings(postings(spark, sf_dir), screened=True, duplicate=True, pending_notify=True)


def _count(c: str, name: str) -> str:
    return f"CAST(count(*) FILTER ({c}) AS BIGINT) AS {name}"


_FUNNEL = "c AS (SELECT count(*) AS total, " + ", ".join(
    [_count(f"filter_status = '{s}'", s) for s in listing.STATUSES]
    + [_count("notified_at IS NOT NULL", "notified"), _count("pending_notify", "pending_notify"), _count("duplicate_of IS NOT NULL", "duplicates"), _count("company_status = 'warned'", "company_warned")]
    + [_count("company_status = 'pending'", "company_pending"), _count("keyword_filtered", "keyword_filtered"), _count("negative_keyword_filtered", "negative_keyword_filtered")]
) + " FROM postings_v)"


@query(f"WITH {_FUNNEL} SELECT *, matched + filtered AS screened, pending + company_pending + pending_notify AS in_pipeline, filtered - keyword_filtered - negative_keyword_filtered AS judge_failed FROM c", "p")
def funnel_counts(spark, sf_dir):
    return listing.funnel(postings(spark, sf_dir))


@query("SELECT page_id, " + ", ".join(_count(f"filter_status = '{s}'", s) for s in ("matched", "filtered", "pending")) + " FROM postings_v GROUP BY page_id", "p")
def per_source_stats(spark, sf_dir):
    return listing.per_source(postings(spark, sf_dir))


@query("""
WITH l AS (SELECT first_seen_at FROM postings_v WHERE filter_status = 'matched' ORDER BY first_seen_at DESC, id LIMIT 50)
SELECT (SELECT count(*) FILTER (active) FROM sources_v) AS active, (SELECT count(last_error) FROM sources_v) AS errors, (SELECT strftime(max(last_checked_at), '%Y-%m-%d %H:%M') FROM sources_v) AS last_checked,
       (SELECT count(*) FILTER (CAST(first_seen_at AS DATE) = DATE '2001-11-04') FROM l) AS matches_today""", "ps")
def dashboard_stats(spark, sf_dir):
    out = listing.dashboard(sources(spark, sf_dir), postings(spark, sf_dir), F.lit("2001-11-04 12:00:00").cast("timestamp"))
    return out.withColumn("last_checked", F.date_format("last_checked", "yyyy-MM-dd HH:mm"))


@query("SELECT id FROM postings_v WHERE duplicate_of IS NOT NULL ORDER BY first_seen_at DESC, id LIMIT 20", "p")
def duplicates_roster(spark, sf_dir):
    return listing.roster(postings(spark, sf_dir), "duplicates").select("id")


@query("SELECT page_id, count(*) AS n, count(*) FILTER (link_source = 'none') AS unlinked, CASE WHEN count(*) >= 3 AND count(*) FILTER (link_source = 'none') / count(*) > 0.5 THEN 'Most postings on this crawl have no direct link (' || count(*) FILTER (link_source = 'none') || ' of ' || count(*) || ')' END AS warning FROM (SELECT l_suppkey AS page_id, CASE WHEN l_suppkey % 3 = 0 AND l_linenumber > 2 THEN 'none' ELSE 'cited' END AS link_source FROM lineitem) GROUP BY page_id")
def link_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page_id"), F.when((F.col("l_suppkey") % 3 == 0) & (F.col("l_linenumber") > 2), "none").otherwise("cited").alias("link_source"))
    return lifecycle.link_warning(rows)


@query("SELECT lower(replace(company, '#', '#')) AS norm_name, count(*) AS n, arg_min(title, first_seen_at::VARCHAR || id) AS first_title, min(id) AS first_id FROM postings_v GROUP BY company", "p")
def company_groups(spark, sf_dir):
    found = companies.groups(postings(spark, sf_dir))
    return found.select("norm_name", "n", "first_title", "first_id")


# --- runs ------------------------------------------------------------------------------------------


@query(f"""
WITH d AS (SELECT *, TIMESTAMP '{NOW}' AS now FROM sources_v),
q AS (SELECT page_id, row_number() OVER (ORDER BY last_checked_at NULLS FIRST, created_at, page_id) AS turn FROM d
  WHERE active AND (poll_claimed_at IS NULL OR poll_claimed_at < now - INTERVAL 3 MINUTE) AND NOT coalesce(failure_count >= 5 AND last_checked_at > now - INTERVAL 3 HOUR, false))
SELECT page_id, CAST(turn AS INTEGER) AS turn, CAST((turn - 1) // 4 AS INTEGER) AS batch FROM q""", "s")
def worklist(spark, sf_dir):
    return lifecycle.worklist(sources(spark, sf_dir), _now()).select("page_id", "turn", "batch")


@query("SELECT page_id, CAST(failure_count + 1 AS INTEGER) AS failure_count, CASE WHEN last_error LIKE 'HTTP 403%' AND failure_count >= 4 THEN '" + display.BLOCKED_MESSAGE.replace("'", "''") + "' ELSE last_error END AS last_error FROM sources_v WHERE last_error IS NOT NULL", "s")
def failure_accounting(spark, sf_dir):
    rows = sources(spark, sf_dir).filter("last_error is not null")
    return rows.select("page_id", lifecycle.after_failure(F.col("last_error"), F.col("failure_count")).alias("s")).select("page_id", "s.*")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first_seen_at, id) AS rn FROM postings_v WHERE filter_status = 'pending') SELECT id, page_id FROM r WHERE rn <= 20", "p")
def screen_batch_cap(spark, sf_dir):
    return lifecycle.batch_cap(postings(spark, sf_dir).filter("filter_status = 'pending'"), lifecycle.SCREEN).select("id", "page_id")


@query("SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS tick, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def poll_ticks_15m(spark, sf_dir):
    t = ticks(table(spark, sf_dir, "events"))
    return t.select(F.date_format("tick", "yyyy-MM-dd HH:mm").alias("tick"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH h AS (SELECT page_id, sha256(html) AS now, sha256(CASE WHEN page_id % 3 = 0 THEN html ELSE url END) AS before FROM pages) SELECT page_id, now AS content_hash FROM h WHERE now IS DISTINCT FROM before")
def changed_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    stored = pages.select("page_id", html.content_hash(F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.col("url"))).alias("last_content_hash"))
    return lifecycle.changed(pages.select("page_id", html.content_hash(F.col("html")).alias("content_hash")), stored).select("page_id", "content_hash")


_BLOCKED_NOW = f"list_filter({_BLOCKED}, lambda k: contains(lower(title), k))[1]"
_PRE_HELD = f"(NOT ({_TITLE_OK}) OR {_KIND} IS NOT NULL OR ({_N} >= 1000 AND {_N} < 20000))"


@query(f"""
WITH t AS (SELECT *, filter_status = 'pending' AND row_number() OVER (PARTITION BY page_id, filter_status = 'pending' ORDER BY first_seen_at, id) <= 20 AS now FROM postings_v)
SELECT id, CASE WHEN now AND ({_BLOCKED_NOW} IS NOT NULL OR {_PRE_HELD}) THEN 'filtered' ELSE filter_status END AS filter_status,
       now AND {_BLOCKED_NOW} IS NOT NULL AS negative_keyword_filtered, now AND {_BLOCKED_NOW} IS NULL AND {_PRE_HELD} AS keyword_filtered FROM t""", "p")
def lifecycle_transition(spark, sf_dir):
    rows = _keyed(spark, sf_dir).withColumn("fallback", F.lit(None).cast("string"))
    out = lifecycle.screened(rows, lifecycle.Config(PROFILE))
    return out.select("id", "filter_status", "negative_keyword_filtered", "keyword_filtered")


@query(f"""
WITH {_KEYED},
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first_seen_at, id) AS turn FROM keyed WHERE pending_notify AND notified_at IS NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY first_seen_at, id) AS k FROM r WHERE turn <= 20),
h AS (SELECT content_key, arg_min(id, notified_at::VARCHAR || id) AS dup FROM keyed WHERE notified_at >= TIMESTAMP '2001-10-25' GROUP BY content_key)
SELECT id, page_id, dup AS duplicate_of, dup IS NULL AND k = 1 AS send FROM q LEFT JOIN h USING (content_key)""", "p")
def notification_outbox(spark, sf_dir):
    return lifecycle.outbox(_keyed(spark, sf_dir), F.lit("2001-11-08 00:00:00").cast("timestamp"))


@query("""
SELECT id, CASE WHEN notified_at IS NOT NULL THEN 'sent' WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN pending_notify THEN 'queued' WHEN filter_status = 'pending' THEN 'screening'
  WHEN company_status = 'pending' THEN 'company check' WHEN filter_status = 'filtered' THEN 'filtered' WHEN filter_status = 'skipped' THEN 'baseline' ELSE 'matched' END AS status FROM postings_v""", "p")
def status_pill(spark, sf_dir):
    p = postings(spark, sf_dir)
    return p.select("id", display.posting_status({c: F.col(c) for c in p.columns}).alias("status"))


@query("SELECT page_id, CASE WHEN last_error IS NOT NULL THEN last_error WHEN first_crawl_done THEN 'ok' ELSE 'pending first crawl' END AS status FROM sources_v", "s")
def source_status(spark, sf_dir):
    return sources(spark, sf_dir).select("page_id", display.source_status(F.col("last_error"), F.col("first_crawl_done"), F.lit(False)).alias("status"))


def _asked(spark, sf_dir):
    """Addresses to watch: some known, some new, some repeated, some no address."""
    s = sources(spark, sf_dir)
    k = F.col("page_id") % 4
    return s.select(F.col("page_id").alias("pos"), F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit(" "), "url", F.lit("/new "))).when(k == 2, "https://one.example.com/x").otherwise("no address"))\
        .toDF("pos", "url")


@query("""
WITH a AS (SELECT page_id AS pos, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '/new' WHEN 2 THEN 'https://one.example.com/x' ELSE 'no address' END AS url FROM sources_v),
d AS (SELECT DISTINCT url FROM a WHERE url LIKE 'https://%')
SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM sources_v s WHERE s.url = d.url)) AS added, count(*) FILTER (EXISTS (SELECT 1 FROM sources_v s WHERE s.url = d.url)) AS skipped,
       (SELECT count(*) FROM a WHERE url = 'no address') AS invalid FROM d""", "s")
def bulk_add_counts(spark, sf_dir):
    return registry.bulk_add(sources(spark, sf_dir), _asked(spark, sf_dir))[1]


@query("""
WITH f AS (SELECT id, page_id, min(id) OVER (PARTITION BY title, page_id % 7) AS first_id FROM postings_v)
SELECT p.id, o.id AS duplicate_of FROM f p LEFT JOIN f o ON o.id = p.first_id AND o.page_id % 3 <> 0 WHERE p.page_id % 3 <> 0""", "p")
def delete_cascade(spark, sf_dir):
    """Every third page goes, its postings go, and links to them are cut."""
    alike = Window.partitionBy("title", F.col("page_id") % 7)
    rows = postings(spark, sf_dir).select("id", "page_id", F.min("id").over(alike).alias("duplicate_of"))
    gone = rows.select("page_id").filter("page_id % 3 = 0")
    kept = registry.delete_pages(sources(spark, sf_dir), rows, gone)[1]
    return kept.select("id", "duplicate_of")


# --- display ---------------------------------------------------------------------------------------

_TITLE_KINDS = ("", " (Full-time)", " - Remote", " | Senior", " [Contract] Hybrid", " Lead")


def _display_titles(spark, sf_dir):
    k = (F.col("l_suppkey") % 6).cast("int")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_name", k.alias("k")).distinct()
    return rows.select("p_name", "k", F.concat("p_name", F.get(F.array(*map(F.lit, _TITLE_KINDS)), F.col("k"))).alias("title"))


@query("""
WITH d AS (SELECT DISTINCT p_name, CAST(l_suppkey % 6 AS INTEGER) AS k FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_name, k, p_name AS title, ['Matched', 'Full-time', 'Remote', 'Senior level', 'Contract, Hybrid', 'Lead'][k + 1] AS tags FROM d""")
def job_tags(spark, sf_dir):
    rows = _display_titles(spark, sf_dir).select("p_name", "k", display.job_tags(F.col("title")).alias("d"))
    return rows.select("p_name", "k", F.col("d.title").alias("title"), F.array_join("d.tags", ", ").alias("tags"))


@query("""
WITH d AS (SELECT n_name, unnest(range(0, 6)) AS k FROM nation)
SELECT n_name, CAST(k AS INTEGER) AS k, [n_name, 'Worldwide', n_name, 'United States', n_name, 'Location unlisted'][k + 1] AS shown FROM d""")
def clean_location(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_name", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    n = F.col("n_name")
    raw = F.get(F.array(n, F.lit("Remote"), F.concat(F.lit("Remote, "), n), F.lit("Austin, United States"), F.concat(n, F.lit("; "), n, F.lit(" | Remote")), F.lit("")), F.col("k"))
    return rows.select("n_name", "k", place.shown(raw).alias("shown"))


@query(f"""
SELECT DISTINCT location, compensation, title, '🔔  ' || title || chr(10) || chr(10) || '🏢  ' || company || chr(10) || '💰  ' || compensation || chr(10) || '📍  ' || location || chr(10) || chr(10)
  || company || ' - <a href="' || replace(url, '&', '&amp;') || '">See Job Post</a>' || chr(10) || '_________________________________' AS message FROM postings_v WHERE pending_notify""", "p")
def notify_message(spark, sf_dir):
    rows = postings(spark, sf_dir).filter("pending_notify")
    m = display.message(F.col("title"), F.col("url"), F.col("company"), F.col("compensation"), F.col("location"), F.col("company"))
    return rows.select("location", "compensation", "title", m.alias("message")).distinct()


@query("""
WITH e AS (SELECT event_id, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-31 00:00:00') AS s FROM events)
SELECT event_id, CASE WHEN s < 5 THEN 'just now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age FROM e""")
def event_age(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.age(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("age"))


@query("""
SELECT DISTINCT company, CASE WHEN k % 4 = 0 THEN 'warn' WHEN k % 4 = 1 THEN 'ok' WHEN k % 4 = 2 THEN 'warn' ELSE 'warn' END AS decision FROM (SELECT s_name AS company, s_suppkey AS k FROM supplier)""")
def company_rule(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    level = F.when(k == 0, F.lit(None)).when(k == 3, "suspicious").otherwise("verified")
    v = companies.rule_verdict(level, F.when(k == 2, "low").otherwise("high"))
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("company"), v["decision"].alias("decision")).distinct()


@query(f"""
WITH c AS (SELECT s_suppkey AS k, 'n' || s_suppkey AS norm_name FROM supplier),
q AS (SELECT k % 10 AS page_id, norm_name, k, CASE WHEN k % 6 = 0 THEN NULL ELSE k % 6 END AS f FROM c),
r AS (SELECT *, coalesce((k % 6 = 1 AND k % 2 = 1 AND k % 50 < 30) OR f >= 3, false) AS ready FROM q),
d AS (SELECT *, NOT ready AND (f IS NULL OR (f < 3 AND (k % 50 >= 1 OR k % 5 = 0))) AS due FROM r)
SELECT page_id, norm_name, ready, due AND row_number() OVER (PARTITION BY page_id, due ORDER BY k, norm_name) <= 3 AS research FROM d""")
def research_budget(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("n"), k.cast("string")).alias("norm_name")
    at = F.when((k % 5 != 0) | (k % 50 != 0), _now() - F.make_interval(days=(k % 50).cast("int")))
    known = rows.filter(k % 6 != 0).select(name, F.when(k % 6 == 1, "ok").otherwise("failed").alias("research_status"), F.when(k % 2 == 1, "{}").alias("dossier"), at.alias("researched_at"), (k % 6).cast("int").alias("failure_count"))
    queue = rows.select((k % 10).alias("page_id"), name, k.alias("first_seen_at"))
    return companies.research_queue(queue, known, _now())
