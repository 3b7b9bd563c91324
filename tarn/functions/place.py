"""Locations: the profile's lists and what is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.text import join_tags, split_tags, strip


def prose(include: Column, exclude: Column) -> Column:
    only = F.when(F.size(include) > 0, F.concat(F.lit("Only: "), join_tags(include)))
    never = F.when(F.size(exclude) > 0, F.concat(F.lit("Never: "), join_tags(exclude)))
    return F.concat_ws(". ", only, never)


def legacy_lists(value: Column) -> Column:
    """struct<include, exclude> from prose: the inverse of prose(), "Remote or X", or a plain list."""
    text = strip(F.coalesce(value, F.lit("")))
    none = F.array().cast("array<string>")
    only, never = (F.regexp_extract(text, rf"(?i)\b{w}:\s*([^.]*)", 1) for w in ("only", "never"))
    marked = text.rlike(r"(?i)\b(only|never):")
    remote = F.regexp_extract(text, "(?i)^remote or (.+)$", 1)
    include = F.when(marked, split_tags(only)).when(remote != "", F.concat(F.array(F.lit("Remote")), split_tags(remote))).otherwise(split_tags(text))
    return F.struct(include.alias("include"), F.when(marked, split_tags(never)).otherwise(none).alias("exclude"))


# Fixed values in the two functions below: the words that only say that a place does not matter.


def says_remote(raw: Column) -> Column:
    return F.coalesce(raw.rlike(r"(?i)\b(remote|remote-friendly|work from anywhere|worldwide|anywhere)\b"), F.lit(False))


def shown(raw: Column) -> Column:
    """The place to show, without the words that only say remote."""
    text = strip(F.coalesce(raw, F.lit("")))
    rest = F.regexp_replace(text, r"(?i)\b(remote-friendly|remote|work from anywhere|worldwide|anywhere)\b[\s,;\-|]*", "")
    rest = strip(F.regexp_replace(rest, r"(?i)[\s,;\-|]*\b(remote-friendly|remote)\b", ""))
    first = F.get(F.filter(F.transform(F.split(rest, "[;|]"), strip), lambda s: s != ""), F.lit(0))
    first = strip(F.regexp_replace(F.regexp_replace(first, r"^[\s,;\-|]+", ""), r"[\s,;\-|]+$", ""))
    low = F.lower(first)
    named = F.when(low.contains("united states") | low.isin("us", "usa"), "United States").otherwise(first)
    short = F.when(F.length(named) > 30, strip(F.split(named, ",")[0])).otherwise(named)
    return F.when(text == "", "Location unlisted").when(rest == "", "Worldwide").otherwise(F.coalesce(short, F.lit("Location unlisted")))
