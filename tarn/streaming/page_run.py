"""One run over landed pages: choice of a body, extraction, links, keys, and what the page keeps of it.

Nothing here raises because of a page. What goes wrong with one is a row (page_id, step, error); a page with such a row
takes no part in later steps, keeps what was stored for it, and shows the error. All pages of a run go through each
step together, so a step costs the same shuffles for four pages or for four million.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import html, url
from tarn.functions.display import LINK_WARNING
from tarn.operators import lifecycle, links, models
from tarn.operators.cards import card_links, match_cards
from tarn.operators.identity import first_of_crawl, posting_key
from tarn.plans.stored import stored
from tarn.sources import attempts, boards, feeds

#: What is done to a table that is read several times, by its name.
Cut = Callable[[DataFrame, str], DataFrame]
#: What finds the cards of a body at a base address: dicts of href, title and text.
CardReader = Callable[[str, str], list[dict]]
RSS = "rss"
#: What a page keeps from run to run.
PAGE = (
    "page_id long, url string, label string, first_crawl_done boolean, last_content_hash string, failure_count int, last_error string, fetch_strategy string, "
    "strategy_probe_after timestamp, last_checked_at timestamp, poll_claimed_at timestamp"
)
_CARDS = "struct<links: array<struct<href: string, title: string, text: string>>, error: string>"
_POSTING = ("title", "url", "company", "location", "compensation", "posted_text")


@dataclass(frozen=True)
class PageRun:
    """rows: the keyed crawl (see poll.run_batch), with raw fields; pages: the page states after it; failures: page_id, step, error."""

    rows: DataFrame
    pages: DataFrame
    failures: DataFrame


def guarded(read: CardReader) -> Callable[..., Column]:
    """A column of what read (body, base: list of href, title, text) finds in each page, or of the error that it raised there."""

    @F.pandas_udf(_CARDS)
    def cards(body: pd.Series, base: pd.Series) -> pd.DataFrame:
        found, errors = [], []
        for b, u in zip(body, base):
            try:
                found.append([{k: c[k] for k in ("href", "title", "text")} for c in read(b or "", u or "")])
                errors.append(None)
            except Exception as error:  # noqa: BLE001  whatever one page's markup does, it is that page's error
                found.append([])
                errors.append(f"{type(error).__name__}: {error}"[:500])
        return pd.DataFrame({"links": found, "error": errors})

    return cards


def _usable_feeds(bodies: DataFrame) -> DataFrame:
    """page_id, pos and posting columns of the landed feeds that are accepted as one; of several the first tried."""
    feed = bodies.filter((F.col("strategy") == RSS) & F.col("error").isNull() & feeds.looks_like_feed(F.lit(""), F.col("content")))
    found = feeds.items(feed.select("page_id", "attempt_no", "content"), "content").withColumn("feed", F.struct("page_id", "attempt_no"))
    first = feeds.accepted(found, "feed").groupBy("feed.page_id").agg(F.min("feed.attempt_no").alias("attempt_no"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    return found.join(first, ["page_id", "attempt_no"]).select("page_id", "pos", "title", "url", none("company"), none("location"), none("compensation"), "posted_text")


def choose(pages: DataFrame, bodies: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """(chosen, structured): for each page kind, strategy, content, hash, degraded, truncated or error; the postings of the
    pages whose body lists them (page_id, pos and posting columns).

    bodies: page_id, attempt_no, strategy, content, n_links, link_bearing, error. A known board comes first; a feed if the page is
    new or had one last time; else the best attempt; if none is usable, a feed that was not asked for; else the attempts' errors.
    """
    known = bodies.filter("error is null").join(pages.select("page_id", "url"), "page_id").filter(F.col("strategy") == boards.board(F.col("url")))
    # Of a board's bodies the last one counts.
    last = known.groupBy("page_id").agg(F.max_by("content", "attempt_no").alias("body"), F.first("url").alias("url"))
    board = boards.structured(last, pos="pos").select("page_id", "pos", *_POSTING, "strategy")
    feed = _usable_feeds(bodies).withColumn("strategy", F.lit(RSS))
    listed = cut(board.unionByName(feed), "listed")
    entry = F.struct("pos", *_POSTING)
    digests = listed.groupBy("page_id", "strategy").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(entry))), 256).alias("hash"))
    of = lambda what, name: digests.filter(what).select("page_id", F.col("strategy").alias(f"{name}_strategy"), F.col("hash").alias(f"{name}_hash"))
    tried = attempts.select_attempts(bodies.filter(F.col("strategy").isin(*attempts.STRATEGIES)))
    rows = pages.select("page_id", "first_crawl_done", "fetch_strategy")
    rows = rows.join(of(F.col("strategy") != RSS, "board"), "page_id", "left").join(of(F.col("strategy") == RSS, "feed"), "page_id", "left").join(tried, "page_id", "left")
    wanted = ~F.coalesce("first_crawl_done", F.lit(False)) | F.col("fetch_strategy").eqNullSafe(F.lit(RSS))
    kind = (
        F.when(F.col("board_hash").isNotNull(), "board").when(F.col("feed_hash").isNotNull() & wanted, "feed").when(F.col("content").isNotNull(), "page")
        .when(F.col("feed_hash").isNotNull(), "feed").otherwise("none")
    )
    rows = rows.withColumn("kind", kind)
    pick = lambda board, feed, page: F.when(F.col("kind") == "board", board).when(F.col("kind") == "feed", feed).when(F.col("kind") == "page", page)
    content = F.when(F.col("kind") == "page", html.capped(F.col("content")))
    chosen = rows.select(
        "page_id", "kind", pick(F.col("board_strategy"), F.lit(RSS), F.col("strategy")).alias("strategy"), content.alias("content"),
        pick(F.col("board_hash"), F.col("feed_hash"), html.content_hash(content)).alias("hash"), F.coalesce(F.col("degraded") & (F.col("kind") == "page"), F.lit(False)).alias("degraded"),
        F.coalesce(F.length(content) < F.length("content"), F.lit(False)).alias("truncated"),
        F.when(F.col("kind") == "none", F.coalesce(F.nullif("error", F.lit("")), F.lit("nothing was fetched"))).alias("error"),
    )
    taken = chosen.filter(F.col("kind").isin("board", "feed")).select("page_id", "strategy")
    return chosen, listed.join(taken, ["page_id", "strategy"]).drop("strategy")


def read_answers(chosen: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, failures) of the chosen pages that a model was asked about; answers: page_id, raw."""
    read = chosen.filter("kind = 'page'").select("page_id").join(answers.select("page_id", "raw"), "page_id", "left").withColumn("found", models.postings(F.col("raw")))
    error = F.when(F.col("raw").isNull(), "no answer from the model").when(F.col("found").isNull(), "the model's answer is not a list of postings")
    failures = read.withColumn("error", error).filter("error is not null").select("page_id", F.lit("extraction").alias("step"), "error")
    rows = read.filter("found is not null").select("page_id", F.posexplode("found").alias("pos", "p")).select("page_id", "pos", *[F.col(f"p.{c}").alias(c) for c in _POSTING], "p.link_id")
    return rows, failures


def _with_address(rows: DataFrame) -> DataFrame:
    """rows (url, page_url and others) with link, the address that url is on its page, and canonical, its canonical form."""
    return rows.withColumn("link", url.resolved(F.col("url"), F.col("page_url"))).withColumn("canonical", url.canonical(F.col("link")))


def resolved_links(postings: DataFrame, chosen: DataFrame, pages: DataFrame, cut: Cut, read_cards: CardReader) -> tuple[DataFrame, DataFrame]:
    """(links, failures): page_id, pos, url, source, score, note of the postings of chosen pages, from their own markup."""
    bodies = chosen.filter("kind = 'page'").join(pages.select("page_id", "url"), "page_id").select("page_id", "url", "content")
    bodies = bodies.join(postings.select("page_id").distinct(), "page_id", "left_semi")
    read = cut(bodies.select("page_id", guarded(read_cards)("content", "url").alias("c")), "read")
    failures = read.filter("c.error is not null").select("page_id", F.lit("links").alias("step"), F.col("c.error").alias("error"))
    cards = read.select("page_id", F.explode("c.links").alias("card")).select("page_id", "card.*")
    anchors = bodies.select("page_id", F.col("url").alias("page_url"), F.posexplode(html.anchors(F.col("content"))).alias("i", "a"))
    anchors = _with_address(anchors.select("page_id", "page_url", (F.col("i") + 1).alias("link_id"), F.col("a.href").alias("url"), "a.text"))
    anchors = anchors.select("page_id", "link_id", F.col("canonical").alias("href"), "text", url.usable(F.col("link"), F.col("page_url")).alias("usable"))
    rows = _with_address(postings.join(pages.select("page_id", F.col("url").alias("page_url")), "page_id"))
    rows = cut(rows.select("page_id", "pos", "title", "company", "link_id", F.col("canonical").alias("url")), "cited")
    return links.resolve(rows, cut(anchors, "anchors"), cut(match_cards(rows, cards), "cards"), by_prefix=False), failures


def _first_failures(*tables: DataFrame) -> DataFrame:
    """The first failure of each page, in the order of the tables."""
    every = None
    for i, rows in enumerate(tables):
        rows = rows.withColumn("nth", F.lit(i))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("page_id").agg(F.min(F.struct("nth", "step", "error")).alias("f")).select("page_id", "f.step", "f.error")


def run_pages(pages: DataFrame, bodies: DataFrame, answers: DataFrame, now: Column, cut: Cut = stored, read_cards: CardReader = card_links) -> PageRun:
    """The keyed rows of a run, the state of its pages after it, and what failed.

    pages: see PAGE, one row for each page of the run; bodies: see choose; answers: page_id, raw, one row a page. cut: what is done to
    tables that are read several times; they are written. A page whose hash is the stored one has no rows and keeps a warning about its links. The
    hash of a page that failed in a later step is not stored, so the next run reads it again.
    """
    chosen, listed = choose(pages, bodies, cut)
    chosen = cut(chosen, "chosen")
    fetching = chosen.filter("error is not null").select("page_id", F.lit("fetch").alias("step"), "error")
    fresh = chosen.filter("error is null").join(pages.select("page_id", "last_content_hash"), "page_id")
    fresh = fresh.filter(~F.col("hash").eqNullSafe(F.col("last_content_hash"))).drop("last_content_hash")
    asked, unread = read_answers(fresh, answers)
    asked = cut(asked, "postings")
    found, unlinked = resolved_links(asked, fresh, pages, cut, read_cards)
    failures = cut(_first_failures(fetching, unread, unlinked), "failures")
    platform = _with_address(listed.join(fresh.select("page_id"), "page_id", "left_semi").join(pages.select("page_id", F.col("url").alias("page_url")), "page_id"))
    platform = platform.select("page_id", "pos", *[F.col("canonical").alias(c) if c == "url" else F.col(c) for c in _POSTING], F.lit("platform").alias("source"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("note"))
    page = asked.drop("url", "link_id").join(found, ["page_id", "pos"]).join(failures, "page_id", "left_anti")
    crawl = cut(platform.unionByName(page.select(*platform.columns)), "addressed").join(pages.select("page_id", "first_crawl_done"), "page_id")
    key = posting_key(F.col("url"), F.col("title"), F.col("company"), F.col("location"))
    crawl = crawl.select(
        "page_id", "pos", key.alias("dedupe_key"), "title", "company", "location", "compensation", "posted_text", "url", F.col("source").alias("link_source"), F.col("note").alias("link_note"),
        F.col("score").alias("link_score"), F.coalesce("first_crawl_done", F.lit(False)).alias("first_crawl_done"),
    )
    rows = cut(first_of_crawl(crawl), "crawl")
    return PageRun(rows, after_run(pages, chosen, rows, failures, now), failures)


def after_run(pages: DataFrame, chosen: DataFrame, rows: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """The page states (PAGE, with status) after a run: error, unchanged or ok."""
    warned = lifecycle.link_warning(rows.filter("link_source != 'platform'")).select("page_id", "warning")
    said = chosen.select("page_id", F.col("strategy").alias("new_strategy"), "hash", "degraded", "truncated")
    met = pages.join(said, "page_id").join(failures.select("page_id", F.col("error").alias("failed")), "page_id", "left").join(warned, "page_id", "left")
    failed, same = F.col("failed").isNotNull(), F.col("hash").eqNullSafe(F.col("last_content_hash"))
    status = F.when(failed, "error").when(same, "unchanged").otherwise("ok")
    then = lifecycle.after_failure(F.col("failed"), F.coalesce("failure_count", F.lit(0)))
    kept = F.when(F.col("last_error").startswith(LINK_WARNING), F.col("last_error"))
    error = F.when(failed, then["last_error"]).when(same, kept).otherwise(lifecycle.page_error(F.lit(None).cast("string"), F.col("truncated"), F.col("warning")))
    skipped = F.coalesce(F.col("strategy_probe_after") > now, F.lit(False))
    probe = lifecycle.next_probe(F.col("degraded"), skipped, F.col("strategy_probe_after"), now)
    ok = ~failed & ~same
    return met.select(
        "page_id", "url", "label", F.when(ok, True).otherwise(F.col("first_crawl_done")).alias("first_crawl_done"), F.when(ok, F.col("hash")).otherwise(F.col("last_content_hash")).alias("last_content_hash"),
        F.when(failed, then["failure_count"]).otherwise(0).cast("int").alias("failure_count"), error.alias("last_error"),
        F.when(failed, F.col("fetch_strategy")).otherwise(F.col("new_strategy")).alias("fetch_strategy"), F.when(failed, F.col("strategy_probe_after")).otherwise(probe).cast("timestamp").alias("strategy_probe_after"),
        now.alias("last_checked_at"), F.lit(None).cast("timestamp").alias("poll_claimed_at"), status.alias("status"),
    )
