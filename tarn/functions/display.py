"""What a posting and a source look like to their reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions import dates, money, place
from tarn.functions.text import escape_attribute, escape_html, strip, truncate
from tarn.functions.url import bare_host, part

# Kinds of employment by the words that name them, in the order they are looked for.
TAG_WORDS = (
    ("(full[- ]?time)", "Full-time"), ("(part[- ]?time)", "Part-time"), ("(contract|contractor)", "Contract"), ("(internship|intern)", "Internship"),
    ("(remote)", "Remote"), ("(hybrid)", "Hybrid"), ("(in[- ]?office|on[- ]?site)", "In office"), ("(flexible[- ]?schedule|flexible)", "Flexible schedule"),
    (r"(senior level|sr\.? level|senior)", "Senior level"), (r"(junior level|jr\.? level|junior)", "Junior level"), ("(lead|principal)", "Lead"),
)
# Sites that list other companies' postings.
AGGREGATORS = (
    "contra.com", "dribbble.com", "linkedin.com", "weworkremotely.com", "cryptocurrencyjobs.co", "wellfound.com", "angel.co", "indeed.com",
    "ycombinator.com", "remoteok.com", "dailyremote.com", "himalayas.app", "nodesk.co", "flexjobs.com", "workingnomads.com", "startup.jobs",
)
# Fixed values: (in the label, in the address, the site's name), the first that fits.
SITES = (
    ("linkedin", "linkedin", "LinkedIn"), ("dribbble", "dribbble", "Dribbble"), ("greenhouse", "greenhouse", "Greenhouse"), ("lever", "lever", "Lever"),
    ("ashby", "ashby", "Ashby"), ("y combinator", "ycombinator", "Y Combinator"), ("wellfound", "wellfound|angel", "Wellfound"), ("indeed", "indeed", "Indeed"),
    ("weworkremotely", "weworkremotely", "WeWorkRemotely"), ("cryptocurrency", "cryptocurrencyjobs", "Cryptocurrency Jobs"), ("contra", "contra.com", "Contra"),
    ("startup.jobs", "startup.jobs", "Startup Jobs"), ("himalayas", "himalayas.app", "Himalayas"), ("nodesk", "nodesk.co", "NoDesk"), ("dailyremote", "dailyremote.com", "DailyRemote"),
)
BLOCKED_PREFIX = "Site blocks automated access"
BLOCKED_MESSAGE = (
    "Site blocks automated access (anti-bot challenge) and publishes no usable job feed. This can't be fetched automatically, so it's now only "
    "retried every few hours — remove this source if you don't want it checked."
)
LINK_WARNING = "Most postings on this crawl have no direct link"
LEGITIMACY = {"verified": "Verified", "likely_real": "Likely real", "uncertain": "Uncertain", "suspicious": "Suspicious", "unknown": "Not researched"}
LINK_SOURCES = {"platform": "Job board API", "card": "Listing card", "cited": "Cited link", "matched": "Matched by title", "none": "No direct link", "unknown": "Not recorded"}


def _capital(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def job_tags(title: Column, location: Column | None = None) -> Column:
    """struct<title, tags>: the words of employment leave the title and become at most three tags."""
    raw = F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled Role"))
    rest, found = raw, []
    for words, tag in TAG_WORDS:
        found.append(F.when(rest.rlike(rf"(?i)\b{words}\b"), tag))
        rest = F.regexp_replace(rest, rf"(?i)[(\[|\-–—]?\s*\b{words}\b\s*[)\]]?", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"^[\s\-–—:,(\[]+", ""), r"[\s\-–—:,(\[]+$", "")
    rest = F.trim(F.regexp_replace(rest, r"\s{2,}", " "))
    clean = F.when(rest == "", raw).otherwise(rest)
    if location is not None:
        found.append(F.when(place.says_remote(location), "Remote"))
    low = F.lower(clean)
    default = F.when(low.contains("designer") | low.contains("engineer") | low.contains("developer"), "Full-time").otherwise("Matched")
    tags = F.array_distinct(F.array_compact(F.array(*found)))
    return F.struct(clean.alias("title"), F.when(F.size(tags) == 0, F.array(default)).otherwise(F.slice(tags, 1, 3)).alias("tags"))


def company(raw: Column, title: Column) -> Column:
    """A company's name: a slug's words if only an address is known, what follows "at" in the title if nothing is."""
    name = F.coalesce(strip(raw), F.lit(""))
    url = F.when(name.startswith("http"), name).otherwise(F.concat(F.lit("https://"), name))
    segments = F.filter(F.split(part(url, 3), "/"), lambda s: s != "")
    last = F.coalesce(F.get(segments, F.size(segments) - 1), bare_host(url))
    slug = F.trim(F.regexp_replace(F.regexp_replace(last, r"(?i)^(company|org|employer|jobs|careers)[-_.]?", ""), "[-_]+", " "))
    words = F.array_join(F.transform(F.split(slug, " "), _capital), " ")
    from_title = F.nullif(strip(F.regexp_extract(title, r"(?i)\b(?:at|@)\s+([A-Z0-9.\-\s]{2,30})$", 1)), F.lit(""))
    is_url = name.startswith("http://") | name.startswith("https://") | name.contains("/")
    return F.when(F.coalesce(raw, F.lit("")) == "", F.coalesce(from_title, F.lit("Company"))).when(is_url & (slug != ""), words).otherwise(name)


def direct_url(url: Column, page: Column) -> Column:
    from tarn.functions.url import resolved

    link, on = strip(url), strip(page)
    return F.when(F.coalesce(link, F.lit("")) == "", F.lit(None)).when(link.rlike("^https?://"), link).when(on.rlike("^https?://"), resolved(link, on)).when(
        link.startswith("/") | link.startswith("http"), link
    )


def link(url: Column, page: Column) -> Column:
    """struct<href, is_direct, label, tooltip> of the link to offer."""
    direct, source = direct_url(url, page), F.nullif(strip(page), F.lit(""))
    only_page = direct.isNull() & source.isNotNull()
    tip = "This source doesn't expose a direct link for this posting — this opens the page it was found on."
    return F.struct(
        F.coalesce(direct, source).alias("href"), direct.isNotNull().alias("is_direct"),
        F.when(only_page, "Open source listing").otherwise("View Posting").alias("label"), F.when(only_page, tip).alias("tooltip"),
    )


def icon_domain(website: Column, url: Column) -> Column:
    """The company's own domain, from its website or from a link that is not an aggregator's."""
    absolute = lambda s: F.when(s.startswith("http"), s).otherwise(F.concat(F.lit("https://"), s))
    own, host = F.nullif(bare_host(absolute(strip(website))), F.lit("")), F.nullif(bare_host(absolute(url)), F.lit(""))
    listed = F.exists(F.array(*map(F.lit, AGGREGATORS)), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
    return F.coalesce(own, F.when(~listed, host))


def site_name(label: Column, page: Column, name: Column) -> Column:
    shown, url = F.coalesce(strip(label), F.lit("")), F.coalesce(page, F.lit(""))
    low, low_url = F.lower(shown), F.lower(url)
    squash = lambda s: F.regexp_replace(F.lower(s), r"[\s,.\-]+", "")
    comp, lab = squash(name), squash(shown)
    main = F.nullif(F.split(bare_host(F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))), r"\.")[0], F.lit(""))
    direct = (comp != "") & (lab != "") & (lab.contains(comp) | comp.contains(lab))
    plain = (shown != "") & ~low.contains("http") & ~low.contains("feed") & ~low.contains("postings")
    rest = F.when(direct, "Direct").when(plain, shown).when(main.isNull() | comp.contains(F.lower(main)), "Direct").otherwise(_capital(main))
    for in_label, in_url, site in reversed(SITES):
        rest = F.when(low.contains(in_label) | low_url.rlike(in_url.replace(".", r"\.")), site).otherwise(rest)
    return rest


def posting_status(p: dict[str, Column]) -> Column:
    """sent, duplicate, queued, screening, company check, filtered, baseline or matched, the first that holds."""
    return (
        F.when(p["notified_at"].isNotNull(), "sent").when(p["duplicate_of"].isNotNull(), "duplicate").when(p["pending_notify"], "queued")
        .when(p["filter_status"] == "pending", "screening").when(p["company_status"] == "pending", "company check")
        .when(p["filter_status"] == "filtered", "filtered").when(p["filter_status"] == "skipped", "baseline").otherwise("matched")
    )


def verdict_label(verdict: Column, filter_status: Column) -> Column:
    return (
        F.when(verdict == "match", "match").when(verdict == "borderline", "maybe").when(verdict.isNotNull(), "no fit")
        .when(filter_status == "pending", "…").otherwise("—")
    )


def named(value: Column, names: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for key, name in names.items():
        out = F.when(value == key, name).otherwise(out)
    return out


def source_status(last_error: Column, first_crawl_done: Column, checking: Column) -> Column:
    return (
        F.when(checking, "checking now").when(last_error.startswith(BLOCKED_PREFIX), "blocked by site").when(last_error.startswith(LINK_WARNING), "links unreliable")
        .when(F.coalesce(last_error, F.lit("")) != "", truncate(last_error, 44)).when(first_crawl_done, "ok").otherwise("pending first crawl")
    )


def being_checked(selected: Column, last_checked: Column, started: Column) -> Column:
    return selected & (last_checked.isNull() | (last_checked < started))


def source_stat(first_crawl_done: Column, matched: Column, filtered: Column) -> Column:
    counts = F.concat(F.coalesce(matched, F.lit(0)).cast("string"), F.lit(" matched · "), F.coalesce(filtered, F.lit(0)).cast("string"), F.lit(" filtered"))
    return F.when(~first_crawl_done, "awaiting first crawl").otherwise(counts)


def message(title: Column, url: Column, company_name: Column, pay: Column, location: Column, page_label: Column) -> Column:
    """The notification's text. Missing parts have no line; the two blank lines stay."""
    line = lambda icon, s: F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit(icon + "  "), escape_html(truncate(s, 150, True))))
    source = escape_html(truncate(page_label, 100, True))
    where = F.when(F.coalesce(url, F.lit("")) != "", F.concat(source, F.lit(' - <a href="'), escape_attribute(url), F.lit('">See Job Post</a>'))).when(page_label != "", source)
    return F.concat_ws(
        "\n", F.concat(F.lit("🔔  "), escape_html(truncate(title, 300, True))), F.lit(""), line("🏢", company_name), line("💰", pay), line("📍", location),
        F.lit(""), where, F.lit("_________________________________"),
    )


def details(p: dict[str, Column], now: Column) -> Column:
    """Everything that a posting's row shows, as a struct."""
    tagged, name = job_tags(p["title"], p["location"]), company(p["company"], p["title"])
    return F.struct(
        tagged["title"].alias("title"), tagged["tags"].alias("tags"), name.alias("company"), site_name(p["page_label"], F.coalesce(p["page_url"], p["url"]), name).alias("site"),
        icon_domain(p["website"], p["url"]).alias("domain"), link(p["url"], p["page_url"]).alias("link"), place.shown(p["location"]).alias("location"),
        money.shown(p["compensation"]).alias("pay"), dates.posted_age(p["posted_text"], p["first_seen_at"], now).alias("age"),
    )
