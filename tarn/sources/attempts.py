"""Fetch attempts as a landed table, and the choice of the best one for each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.html import block_sign, is_shell

# The strategies in the order in which they are tried.
STRATEGIES = ("direct", "direct-alt", "direct-social", "proxy:pure", "proxy:jina", "proxy:cors", "proxy:archive")


def attempt_order(strategy: Column, preferred: Column) -> Column:
    """The place of a strategy, the one that last worked first."""
    at = F.array_position(F.array(*map(F.lit, STRATEGIES)), strategy)
    return F.when(strategy.eqNullSafe(preferred), 0).otherwise(at).cast("int")


def select_attempts(attempts: DataFrame, enforce_links: bool = True) -> DataFrame:
    """One row per page_id: strategy, content, degraded, error.

    attempts: page_id, attempt_no, strategy, content, n_links, link_bearing, error. The first usable attempt
    wins; else the longest without links; else the longest shell; else the errors are joined. A page that
    blocks readers is an error, whatever its length.
    """
    sign = block_sign(F.col("content"))
    bare = F.col("link_bearing") & (F.col("n_links") == 0)
    failed = F.col("error").isNotNull() | sign.isNotNull() | F.col("content").isNull()
    tier = F.when(failed, 4).when(is_shell(F.col("content")), 3).when(bare & F.lit(enforce_links), 2).otherwise(1)
    said = F.concat(F.col("strategy"), F.lit(": "), F.coalesce("error", F.concat(F.lit('blocked by anti-bot check (matched "'), sign, F.lit('")')), F.lit("no content")))
    rows = attempts.select("page_id", "attempt_no", "strategy", "content", tier.alias("tier"), (bare | (tier > 1)).alias("degraded"), F.when(tier == 4, said).alias("said"))
    order = Window.partitionBy("page_id").orderBy("tier", F.when(F.col("tier") > 1, -F.length("content")), "attempt_no")
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("attempt_no", "said"))).over(Window.partitionBy("page_id"))), lambda s: s["said"]), " | ")
    best = rows.select("*", F.row_number().over(order).alias("rn"), errors.alias("errors")).filter("rn = 1")
    ok = F.col("tier") < 4
    return best.select("page_id", F.when(ok, F.col("strategy")).alias("strategy"), F.when(ok, F.col("content")).alias("content"), F.when(ok, F.col("degraded")).alias("degraded"), F.when(~ok, F.col("errors")).alias("error"))


def search_results(results: DataFrame, most: int = 5, chars: int = 4000) -> DataFrame:
    """The first results of each query (query, rank, title, url, content), blank ones dropped, contents cut."""
    rows = results.filter("trim(coalesce(content, '')) != '' and trim(coalesce(url, '')) != ''")
    order = Window.partitionBy("query").orderBy("rank")
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).withColumn("content", F.substring("content", 1, chars)).drop("rn")
