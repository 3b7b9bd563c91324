"""The company layer: names, the dossier cache, research budgets and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import blank_to_null, company_name, strip

FRESH, RETRY, MOST_FAILURES, BATCH, PER_RUN = "INTERVAL 30 DAYS", "INTERVAL 10 MINUTES", 3, 10, 3
LEVELS, CONFIDENCE = ("verified", "likely_real", "uncertain", "suspicious", "unknown"), ("high", "medium", "low")
DOSSIER = (
    "struct<name: string, website: string, summary: string, product_breakdown: string, industry: string, size_estimate: string, stage: string, funding: string, "
    "founded: string, company_type: string, founders: array<struct<name: string, title: string, x_url: string, linkedin_url: string, bio: string>>, "
    "socials: struct<linkedin_url: string, x_url: string, github_url: string, crunchbase_url: string>, legitimacy: string, flags: array<string>, confidence: string, "
    "sources: array<struct<title: string, url: string>>>"
)


def layer_active(enabled: bool, search_key: str) -> bool:
    return enabled and search_key.strip() != ""


def is_fresh(status: Column, has_dossier: Column, researched_at: Column, now: Column) -> Column:
    return F.coalesce((status == "ok") & has_dossier & (researched_at > now - F.expr(FRESH)), F.lit(False))


def retry_due(failures: Column, researched_at: Column, now: Column) -> Column:
    return (failures < MOST_FAILURES) & (researched_at.isNull() | (researched_at < now - F.expr(RETRY)))


def page_fallback(postings: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, fallback: a page's label, where no posting of it ever named a company."""
    named = postings.groupBy("page_id").agg(F.bool_or(F.col("company").isNotNull()).alias("named"))
    return pages.join(named, "page_id", "left").select("page_id", F.when(~F.coalesce("named", F.lit(False)), blank_to_null(F.col("label"))).alias("fallback"))


def members(postings: DataFrame) -> DataFrame:
    """norm_name and id of every posting that names a company: rows, as a popular name may have any number."""
    return postings.select(company_name(F.col("company")).alias("norm_name"), "id").filter("norm_name != ''")


def groups(postings: DataFrame) -> DataFrame:
    """norm_name, display_name, first_title, n (postings) and first_id of each company; nameless ones are left out."""
    named = postings.withColumn("norm_name", company_name(F.col("company"))).filter("norm_name != ''")
    first = lambda c: F.min_by(c, F.struct("first_seen_at", "id"))
    return named.groupBy("norm_name").agg(first("company").alias("display_name"), first("title").alias("first_title"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def missing(found: DataFrame, companies: DataFrame) -> DataFrame:
    return found.select("norm_name", "display_name").join(companies.select("norm_name"), "norm_name", "left_anti")


def research_queue(queue: DataFrame, companies: DataFrame, now: Column) -> DataFrame:
    """queue (page_id, norm_name, first_seen_at) with ready (cached or given up) and research (within the
    page's budget for one run)."""
    known = companies.select("norm_name", is_fresh(F.col("research_status"), F.col("dossier").isNotNull(), F.col("researched_at"), now).alias("fresh"), "failure_count", "researched_at")
    rows = queue.join(known, "norm_name", "left").withColumn("ready", F.coalesce(F.col("fresh") | (F.col("failure_count") >= MOST_FAILURES), F.lit(False)))
    rows = rows.withColumn("due", ~F.col("ready") & F.coalesce(retry_due(F.col("failure_count"), F.col("researched_at"), now), F.lit(True)))
    turn = Window.partitionBy("page_id", "due").orderBy("first_seen_at", "norm_name")
    return rows.withColumn("research", F.col("due") & (F.row_number().over(turn) <= PER_RUN)).select("page_id", "norm_name", "ready", "research")


def dossier(raw: Column, fallback: Column) -> Column:
    """A validated dossier from a model's JSON: unknown levels become uncertain and low, blanks null."""
    d = F.from_json(raw, DOSSIER)
    text = lambda c: F.coalesce(strip(d[c]), F.lit(""))
    optional = lambda c: blank_to_null(c)
    none = lambda kind: F.array().cast(kind)
    people = F.filter(F.coalesce(d["founders"], none("array<struct<name: string, title: string, x_url: string, linkedin_url: string, bio: string>>")), lambda f: blank_to_null(f["name"]).isNotNull())
    people = F.transform(people, lambda f: F.struct(*[optional(f[k]).alias(k) for k in ("name", "title", "x_url", "linkedin_url", "bio")]))
    sources = F.filter(F.coalesce(d["sources"], none("array<struct<title: string, url: string>>")), lambda s: blank_to_null(s["url"]).isNotNull())
    sources = F.transform(sources, lambda s: F.struct(F.coalesce(strip(s["title"]), F.lit("")).alias("title"), strip(s["url"]).alias("url")))
    flags = F.transform(F.filter(F.coalesce(d["flags"], none("array<string>")), lambda f: blank_to_null(f).isNotNull()), strip)
    plain = ("website", "industry", "size_estimate", "stage", "funding", "founded", "company_type")
    return F.struct(
        F.coalesce(optional(d["name"]), fallback).alias("name"), *[optional(d[k]).alias(k) for k in plain], text("summary").alias("summary"), text("product_breakdown").alias("product_breakdown"),
        people.alias("founders"), F.struct(*[optional(d["socials"][k]).alias(k) for k in ("linkedin_url", "x_url", "github_url", "crunchbase_url")]).alias("socials"),
        F.when(d["legitimacy"].isin(*LEVELS), d["legitimacy"]).otherwise("uncertain").alias("legitimacy"), flags.alias("flags"),
        F.when(d["confidence"].isin(*CONFIDENCE), d["confidence"]).otherwise("low").alias("confidence"), sources.alias("sources"),
    )


def summary_line(d: Column) -> Column:
    kind = F.coalesce(F.concat_ws(" ", F.nullif(d["stage"], F.lit("")), F.nullif(d["industry"], F.lit(""))), F.lit(""))
    parts = F.concat_ws(", ", F.nullif(kind, F.lit("")), F.nullif(d["size_estimate"], F.lit("")), F.nullif(d["funding"], F.lit("")))
    return F.coalesce(F.nullif(parts, F.lit("")), d["summary"])


def prompt_text(d: Column) -> Column:
    lines = [F.concat(F.lit("legitimacy: "), d["legitimacy"]), F.concat(F.lit("confidence: "), d["confidence"])]
    for name, key in (("summary", "summary"), ("industry", "industry"), ("size", "size_estimate"), ("stage", "stage"), ("funding", "funding"), ("founded", "founded")):
        lines.append(F.when(F.coalesce(d[key], F.lit("")) != "", F.concat(F.lit(f"{name}: "), d[key])))
    lines.append(F.when(F.size(d["flags"]) > 0, F.concat(F.lit("flags: "), F.array_join(d["flags"], "; "))))
    return F.concat_ws("\n", *lines)


def rule_verdict(legitimacy: Column, confidence: Column) -> Column:
    """struct<decision, reason> by the rule alone; it stands in for a model and does not judge as one would."""
    unknown = legitimacy.isNull()
    warn = unknown | legitimacy.isin("suspicious", "uncertain") | (confidence == "low")
    why = F.when(unknown, "Could not research this company after repeated attempts — treat with care.").when(
        warn, F.concat(F.lit("Could not confirm this company: legitimacy "), legitimacy, F.lit(", confidence "), F.coalesce(confidence, F.lit("unknown")), F.lit("."))
    )
    return F.struct(F.when(warn, "warn").otherwise("ok").alias("decision"), F.coalesce(why, F.lit("No cause for caution found.")).alias("reason"))
