"""URLs: canonical forms, labels and the test of whether a link can be a posting's."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "ref", "referrer", "source", "src",
    "gh_src", "gh_jid", "lever-source", "lever_source", "fbclid", "gclid", "gclsrc", "mc_cid", "mc_eid", "igshid", "trk", "pk", "t",
    "click_id", "clickid", "target",
)
# The same for stored rows, where any utm_ parameter counts.
STORED_TRACKING = (
    "([?&])(pk|t|source|src|ref|referrer|gh_src|gh_jid|lever-source|lever_source|fbclid|gclid|gclsrc|mc_cid|mc_eid|igshid|trk|click_id|clickid|target|utm_[a-z]+)=[^&]*"
)
# Paths and hosts that are never a posting.
AD_PATH, CLICK_PATH = "(?i)/(ads|sponsored|promo)/", "(?i)/click(/|$)"
TAXONOMY_PATH = "(?i)^/(companies|company|employers|categories|category|tags|tag|locations|topics)/[^/]+/?$"
SITE_PATH = "(?i)^/(login|log-in|signin|sign-in|signup|sign-up|register|post-a-job|pricing|about|contact|privacy|terms|faq|newsletter|rss|feed)/?$"
SOCIAL_HOSTS = ("twitter.com", "x.com", "facebook.com", "instagram.com", "youtube.com", "discord.gg", "t.me")
_PARTS = r"(?i)^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 host with port, 3 path, 4 query with its question mark; empty where there is none."""
    return F.regexp_extract(url, _PARTS, group)


def resolved(url: Column, page: Column) -> Column:
    """An absolute http(s) form of url as found on page, from expressions alone; null for other schemes.

    Covers absolute, scheme-relative, root-relative and query-only links and links beside the page, without
    dot segments; canonical_url has no such limits.
    """
    origin = F.concat(part(page, 1), F.lit("://"), part(page, 2))
    folder = F.regexp_replace(F.when(part(page, 3) == "", "/").otherwise(part(page, 3)), "[^/]*$", "")
    return (
        F.when(url.rlike("(?i)^https?://"), url)
        .when(url.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(url.startswith("//"), F.concat(part(page, 1), F.lit(":"), url))
        .when(url.startswith("/"), F.concat(origin, url))
        .when(url.startswith("?"), F.concat(origin, part(page, 3), url))
        .otherwise(F.concat(origin, folder, url))
    )


def canonical(url: Column) -> Column:
    """The canonical form of an absolute http(s) URL without escapes: scheme and host in lower case, no
    fragment, no tracking parameters, the others sorted by key, one trailing slash less."""
    pairs = F.filter(F.split(F.substring(part(url, 4), 2, 1 << 30), "&"), lambda p: p != "")
    indexed = F.transform(pairs, lambda p, i: F.struct(F.split(p, "=")[0].alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    kept = F.sort_array(F.filter(indexed, lambda x: ~F.lower(x["k"]).isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda x: x["p"]), "&")
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    whole = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike("(?i)^https?://[^/?#]"), F.regexp_replace(whole, "/$", ""))


def stored_form(url: Column) -> Column:
    """The form that stored rows are grouped by: three replacements, no sorting."""
    s = F.regexp_replace(F.split_part(F.coalesce(url, F.lit("")), F.lit("#"), F.lit(1)), "(?i)" + STORED_TRACKING, "$1")
    return F.regexp_replace(F.regexp_replace(s, r"\?&+", "?"), "[?&]+$", "")


def _canonical(raw: str | None, page: str | None) -> str | None:
    try:
        joined = urljoin(page or "", (raw or "").strip())
        u = urlsplit(joined)
        host = (u.hostname or "").encode("idna").decode() if u.hostname else ""
        port = u.port
    except (ValueError, UnicodeError):
        return None
    if not u.scheme or (u.scheme in ("http", "https") and not host):
        return None
    if u.scheme not in ("http", "https"):
        return joined.split("#")[0] or None
    at = f"{host}:{port}" if port and port != {"http": 80, "https": 443}[u.scheme] else host
    kept = sorted(((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in TRACKING), key=lambda x: x[0])
    query = "&".join(f"{quote_plus(k, safe='*')}={quote_plus(v, safe='*')}".replace("~", "%7E") for k, v in kept)
    path = quote(u.path or "/", safe="/%:@!$&'()*+,;=~-._|[]^")
    whole = f"{u.scheme}://{at}{path}" + (f"?{query}" if query else "")
    return whole[:-1] if whole.endswith("/") else whole


@F.pandas_udf(T.StringType())
def canonical_url(raw: pd.Series, page: pd.Series) -> pd.Series:
    """The canonical form with full resolution against the page: dot segments, escapes, any scheme."""
    return pd.Series([_canonical(r, p) for r, p in zip(raw, page)], dtype=object)


def dedupe_key(canonical_form: Column) -> Column:
    return F.lower(canonical_form)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(part(url, 2), r"^.*@|:\d*$", "")), r"^www\.", "")


def first_segment(url: Column) -> Column:
    return F.nullif(F.get(F.filter(F.split(part(url, 3), "/"), lambda s: s != ""), F.lit(0)), F.lit(""))


def label(url: Column) -> Column:
    """A site's name: the part of the host before its last one, capitalised; the input if it is no URL."""
    parts = F.filter(F.split(bare_host(url), r"\."), lambda p: p != "")
    name = F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise(F.get(parts, F.lit(0)))
    return F.when(part(url, 2) == "", url).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30)))


def usable(href: Column, page: Column) -> Column:
    """Whether an absolute link found on a page may lead to a posting."""
    path = part(href, 3)
    return F.coalesce(
        href.rlike("(?i)^https?://[^/?#]")
        & (F.lower(canonical(href)) != F.coalesce(F.lower(canonical(page)), F.lit("")))
        & ~(path.isin("", "/") & part(href, 4).isin("", "?"))
        & ~path.rlike(AD_PATH) & ~path.rlike(CLICK_PATH) & ~path.rlike(TAXONOMY_PATH) & ~path.rlike(SITE_PATH)
        & ~(bare_host(href).isin(*SOCIAL_HOSTS) & (bare_host(href) != bare_host(page))),
        F.lit(False),
    )
