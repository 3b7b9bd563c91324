"""The company half of a run: postings that wait for their company move on to ok, warned or none, within budgets.

All pages of a run go through it together. A page takes its oldest COMPANY waiting rows and may have PER_RUN companies looked up, in
the order in which its rows were first seen; a company is looked up once, whichever pages ask, and what is found counts for
all of them. What was not reached, or failed, waits for the next run: the budget, the count of failures and the time of the last
attempt are in the tables, so nothing else is carried from run to run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import company_name, strip
from tarn.operators.companies import DOSSIER, dossier, research_queue, rule_verdict
from tarn.operators.lifecycle import COMPANY, batch_cap
from tarn.plans.stored import stored

#: What is known of a company.
COMPANIES = (
    f"norm_name string, display_name string, dossier {DOSSIER}, legitimacy string, research_status string, research_error string, failure_count int, researched_at timestamp"
)
#: norm_name, display_name and about (a title of theirs) to norm_name, raw (a dossier's JSON) and error.
Research = Callable[[DataFrame], DataFrame]
#: struct<decision, reason> of a company by the columns legitimacy and dossier; null leaves its postings waiting.
Judge = Callable[[Column, Column], Column]


def by_rule(legitimacy: Column, known: Column) -> Column:
    return rule_verdict(legitimacy, known["confidence"])


def waiting(postings: DataFrame, fallback: DataFrame) -> DataFrame:
    """id, page_id, title, first_seen_at, name, norm_name of each page's oldest waiting rows; fallback: page_id, fallback."""
    rows = batch_cap(postings.filter("company_status = 'pending'").select("id", "page_id", "title", "company", "first_seen_at"), COMPANY)
    name = strip(F.coalesce("company", "fallback", F.lit("")))
    return rows.join(fallback, "page_id", "left").select("id", "page_id", "title", "first_seen_at", name.alias("name"), company_name(name).alias("norm_name"))


def looked_up(companies: DataFrame, asked: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """companies (COMPANIES) after a run. asked: norm_name, display_name of those that rows wait for, new ones among them;
    answers: norm_name, raw, error of those that were looked up. An answer that is no dossier is an error."""
    rows = companies.join(asked.select("norm_name", F.col("display_name").alias("said")), "norm_name", "full").join(answers.withColumn("tried", F.lit(True)), "norm_name", "left")
    name = F.coalesce("display_name", "said")
    rows = rows.withColumn("display_name", name).withColumn("found", F.when(F.from_json("raw", DOSSIER).isNotNull() & F.col("raw").rlike(r"^\s*\{"), dossier(F.col("raw"), name).cast(DOSSIER)))
    tried, ok = F.coalesce("tried", F.lit(False)), F.col("found").isNotNull()
    failures = F.coalesce("failure_count", F.lit(0))
    said = F.substring(F.coalesce("error", F.lit("the answer is no dossier")), 1, 500)
    return rows.select(
        "norm_name", "display_name", F.when(ok, F.col("found")).otherwise(F.col("dossier")).alias("dossier"), F.when(ok, F.col("found.legitimacy")).otherwise(F.col("legitimacy")).alias("legitimacy"),
        F.when(~tried, F.coalesce("research_status", F.lit("pending"))).when(ok, "ok").otherwise("failed").alias("research_status"),
        F.when(~tried, F.col("research_error")).when(~ok, said).alias("research_error"), F.when(~tried, failures).when(ok, 0).otherwise(failures + 1).cast("int").alias("failure_count"),
        F.when(tried, now).otherwise(F.col("researched_at")).alias("researched_at"),
    )


def company_step(
    postings: DataFrame, companies: DataFrame, fallback: DataFrame, research: Research, now: Column, active: bool = True, judge: Judge = by_rule,
    cut: Callable[[DataFrame, str], DataFrame] = stored,
) -> tuple[DataFrame, DataFrame]:
    """(postings, companies) after a run's company step.

    postings: id, page_id, title, company, first_seen_at, company_status, pending_notify and others; they get company_id (the normalised
    name) and company_verdict where they have none. Rows without any name are let go as they are; with the layer off, all
    waiting rows of the batch are. A company that could not be looked up three times is judged without a dossier. Every row
    that leaves is queued for notification, a warned one too.
    """
    verdict = "struct<decision: string, reason: string>"
    for name, kind in (("company_id", "string"), ("company_verdict", verdict)):
        if name not in postings.columns:
            postings = postings.withColumn(name, F.lit(None).cast(kind))
    rows = cut(waiting(postings, fallback), "waiting")
    if not active:
        moved = rows.select("id", F.lit("none").alias("status"), F.lit(None).cast("string").alias("of"), F.lit(None).cast(verdict).alias("verdict"))
        return _moved(postings, moved), companies
    named = rows.filter("norm_name != ''")
    turn = F.struct("first_seen_at", "id")
    first = lambda c, name: F.min_by(c, turn).alias(name)
    queue = named.groupBy("page_id", "norm_name").agg(F.min(turn).alias("first_seen_at"))
    asked = cut(named.groupBy("norm_name").agg(first("name", "display_name"), first("title", "about")), "asked")
    marked = cut(research_queue(queue, companies, now), "queue")
    wanted = marked.filter("research").select("norm_name").distinct().join(asked, "norm_name")
    known = wanted.join(companies.select("norm_name", F.col("display_name").alias("stored")), "norm_name", "left").select("norm_name", F.coalesce("stored", "display_name").alias("display_name"), "about")
    answers = cut(research(known).select("norm_name", "raw", "error"), "answers")
    after = cut(looked_up(companies, asked, answers, now), "companies")
    done = answers.select("norm_name").join(after.filter("research_status = 'ok'"), "norm_name", "left_semi")
    ready = marked.filter("ready").select("norm_name").unionByName(done.select("norm_name")).distinct()
    judged = after.join(ready, "norm_name", "left_semi").select("norm_name", judge(F.col("legitimacy"), F.col("dossier")).alias("verdict")).filter("verdict is not null")
    status = F.when(F.col("verdict.decision") == "warn", "warned").otherwise("ok")
    moved = named.join(judged, "norm_name").select("id", status.alias("status"), F.col("norm_name").alias("of"), "verdict")
    free = rows.filter("norm_name = ''").select("id", F.lit("none").alias("status"), F.lit(None).cast("string").alias("of"), F.lit(None).cast(verdict).alias("verdict"))
    # COMPANY rows of a page at most: written, their true size is known, and a small table is not a reason to shuffle all postings.
    return _moved(postings, cut(moved.unionByName(free), "moved")), after


def _moved(postings: DataFrame, moved: DataFrame) -> DataFrame:
    rows = postings.join(moved, "id", "left")
    went = F.col("status").isNotNull()
    new = {"company_status": F.coalesce("status", "company_status"), "pending_notify": went | F.col("pending_notify"), "company_id": F.coalesce("of", "company_id"), "company_verdict": F.coalesce("verdict", "company_verdict")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in postings.columns])
