"""Cards of one title are counted and joined by name, not paired with every posting of the title."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import cards


def plain_cards(postings, found):
    out = set()
    for page, pos, title, company in postings:
        same = [(href, text) for p, href, t, text in found if p == page and t.lower() == title.lower()]
        named = [href for href, text in same if company and company.lower() in text.lower()]
        if len(same) == 1:
            out.add((page, pos, same[0][0]))
        elif len(named) == 1:
            out.add((page, pos, named[0]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cards_named_by_any_stretch_of_their_text(spark, seed):
    rng = random.Random(seed)
    names = ["Acme", "Acme Red", "me re", "Red", "d", "Bolt Works Ltd", "works", "", None, "É Acme", "acme acme"]
    postings = [(p, i, rng.choice(["Ring", "Bolt", "Nut", "Cog"]), rng.choice(names)) for p in range(8) for i in range(12)]
    text = lambda: " ".join(rng.choice(["Acme", "Red", "Bolt", "Works", "Ltd", "É", "at"]) for _ in range(rng.randint(0, 6)))
    found = [(p, f"https://x.org/{p}/{i}", rng.choice(["ring", "bolt", "nut", "cog"]), text()) for p in range(8) for i in range(rng.choice([2, 5, 9]))]
    a = spark.createDataFrame(postings, "page_id int, pos int, title string, company string")
    b = spark.createDataFrame(found, "page_id int, href string, title string, text string")
    got = {(r.page_id, r.pos, r.href) for r in cards.match_cards(a, b).collect()}
    assert got == plain_cards(postings, found) and len(got) > 10


def rows_at_most(spark, frame):
    """The most rows that an operator of the executed plan put out."""
    df = frame
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    most, stack = 0, [plan]
    while stack:
        node = stack.pop()
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        name = node.getClass().getSimpleName()
        children = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        kids = node.children()
        stack += children + [kids.apply(i) for i in range(kids.size())]
    return most


def test_cards_of_one_title_are_not_paired_with_its_postings(spark):
    n = 1500
    rows = spark.range(n).select(F.lit(1).alias("page_id"), F.col("id").alias("pos"), F.lit("Ring").alias("title"), F.format_string("Supplier#%09d", "id").alias("company"))
    found = rows.select("page_id", F.concat(F.lit("https://x.org/"), F.col("pos").cast("string")).alias("href"), "title", F.concat(F.lit("Ring at "), "company").alias("text"))
    got = cards.match_cards(rows, found)
    assert rows_at_most(spark, got) <= 10 * n
    assert got.filter("href = concat('https://x.org/', pos)").count() == n
