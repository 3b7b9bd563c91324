"""Text normalisation as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry nothing in an anchor's or a title's text.
STOPWORDS = ("a", "an", "the", "at", "in", "of", "for", "and", "job", "jobs", "role", "apply", "view", "remote")
# Legal forms at the end of company names.
LEGAL_SUFFIXES = (
    "inc", "incorporated", "llc", "llp", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "ag", "plc", "sa", "bv", "oy",
    "ab", "as", "aps", "pvt", "pte", "srl", "sarl", "kk", "pty",
)
_WIDE_SPACE = r"[\s ﻿]"
SPACE_AT_ENDS = f"^{_WIDE_SPACE}+|{_WIDE_SPACE}+$"


def nfkc(s: Column) -> Column:
    """NFKC. ASCII texts are their own; others go through the JVM's Unicode library, still without leaving it."""
    return F.when(s.rlike(r"[^\x00-\x7F]"), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), s, F.lit(True))).otherwise(s)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: a lambda would evaluate it again for every element it meets."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(s: Column) -> Column:
    """Without white space at both ends, no-break spaces included."""
    return F.regexp_replace(s, SPACE_AT_ENDS, "")


def squeeze(s: Column) -> Column:
    return strip(F.regexp_replace(s, f"{_WIDE_SPACE}+", " "))


def blank_to_null(s: Column) -> Column:
    return F.nullif(strip(s), F.lit(""))


def norm_text(s: Column) -> Column:
    """NFKC in lower case; runs of what is neither letter nor digit become one space."""
    return F.trim(F.regexp_replace(F.lower(nfkc(s)), r"[^\p{L}\p{N}]+", " "))


def ascii_text(s: Column) -> Column:
    """As norm_text, where only ASCII letters and digits count."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def place_text(s: Column) -> Column:
    """Dots and apostrophes go, so that U.S.A. is usa; then as ascii_text."""
    return ascii_text(F.regexp_replace(F.lower(s), "[.'’]", ""))


def terms(value: Column, delimiters: str = "[,;\n]") -> Column:
    """The normalised entries of a delimited list, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), delimiters), ascii_text), lambda t: t != "")


def keywords(value: Column) -> Column:
    """Blocked keywords: one a line or comma, lower case, order kept."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[\n,]"), lambda t: F.lower(strip(t))), lambda t: t != "")


def clean_list(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda t: strip(F.coalesce(t, F.lit("")))), lambda t: t != "")


def telling(normalised: Column) -> Column:
    """The words of what norm_text gave that say something."""
    return F.filter(F.split(normalised, " "), lambda t: (t != "") & ~t.isin(*STOPWORDS))


def tokens(s: Column) -> Column:
    """The words of norm_text that say something."""
    return telling(norm_text(s))


def first_tokens(s: Column, n: int, head: int = 400) -> Column:
    """The first n of tokens(s), whatever the text's length.

    What stands before a space is normalised alike whatever comes after it: if the text's head, up to its last space, has n of
    them, they are the first n of the whole text; if it has fewer, the whole text is normalised.
    """
    begun = tokens(F.regexp_extract(F.left(s, F.lit(head)), "(?s)^(.*) ", 1))
    return let(begun, lambda t: F.when(F.size(t) >= n, F.slice(t, 1, n)).otherwise(F.slice(tokens(s), 1, n)))


def company_name(s: Column) -> Column:
    """Punctuation to spaces, legal forms off the end as long as a word is left before them."""
    spaced = F.trim(F.regexp_replace(F.lower(nfkc(s)), r"[.,'’\"“”&()\-–—/\s]+", " "))
    return F.regexp_replace(spaced, f"( ({'|'.join(LEGAL_SUFFIXES)}))+$", "")


def _chain(s: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def decode_entities(s: Column) -> Column:
    """The five named and numbered entities of feeds and anchors; the ampersand first."""
    s = _chain(s, [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")])
    return F.regexp_replace(s, "(?i)&#x27;", "'")


def escape_html(s: Column) -> Column:
    return _chain(s, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def escape_attribute(s: Column) -> Column:
    return _chain(escape_html(s), [('"', "&quot;")])


def truncate(s: Column, most: int, trim_cut: bool = False) -> Column:
    """At most `most` characters, the last an ellipsis if something was cut."""
    cut = F.substring(s, 1, most - 1)
    cut = F.regexp_replace(cut, r"\s+$", "") if trim_cut else cut
    return F.when(F.length(s) > most, F.concat(cut, F.lit("…"))).otherwise(s)


# --- tags ------------------------------------------------------------------------------------------


def split_tags(s: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), "[,;\n]"), strip), lambda t: t != "")


def join_tags(tags: Column) -> Column:
    return F.array_join(tags, ", ")


def tag_key(s: Column) -> Column:
    return F.lower(squeeze(s))


def normal_tag(s: Column) -> Column:
    return squeeze(F.regexp_replace(s, "[,;\n]", " "))


def distinct_tags(tags: Column) -> Column:
    """Cleaned tags, the first of those equal but for case."""
    clean = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), normal_tag), lambda t: t != "")
    none = F.array().cast("array<string>")
    return F.aggregate(clean, none, lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.array_append(acc, t)))


def kept_tags(claimed: Column, present: Column) -> Column:
    """The claimed tags that are still among those present."""
    own = F.coalesce(claimed, F.array().cast("array<string>"))
    return let(F.transform(split_tags(present), tag_key), lambda keys: F.filter(own, lambda t: F.array_contains(keys, tag_key(t))))


def chat_ids(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), strip), lambda t: t != "")


def bot_id(token: Column) -> Column:
    return F.split(token, ":")[0]


def sends_to_itself(token: Column, ids: Column) -> Column:
    return (bot_id(token) != "") & F.array_contains(chat_ids(ids), bot_id(token))
