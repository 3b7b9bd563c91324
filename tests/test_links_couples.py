"""Titles of words that many anchors of a page have: anchors are found by two of them."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.functions import text
from tarn.operators import links
from tarn.plans import queries

TITLES = "page_id long, pos int, title string"
ANCHORS = "page_id long, link_id int, href string, text string"


def frames(spark, seed, n_titles, n_anchors, vocabulary=30, most=6):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["the", "of", "w1x", "xw2"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, most)))
    titles = [(p, i, line()) for p in (1, 2) for i in range(n_titles)]
    near = lambda t: rng.choice(["", "x", "w3 "]) + t + rng.choice(["", "x", " w4", " w5 w6"])
    anchors = [(p, i, f"https://x.org/{rng.randint(0, 30)}", near(rng.choice(titles)[2]) if rng.random() < 0.5 else line()) for p in (1, 2) for i in range(n_anchors)]
    return spark.createDataFrame(titles, TITLES), spark.createDataFrame(anchors, ANCHORS)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_close_pair_of_common_words_is_lost(spark, seed):
    titles, anchors = frames(spark, seed, 60, 400)
    every = {(r.page_id, r.pos, r.link_id): r.score for r in links.scored(titles, anchors).collect()}
    of = links.lookup(titles, anchors)
    assert of.couples.count() > 0 and of.ends.count() > 0
    for least in (links.NEAR_FULL, links.NEAR_STRONG):
        got = {(r.page_id, r.pos, r.link_id): r.score for r in links._close(of, of.ranked, least).collect()}
        assert got == {k: v for k, v in every.items() if v > least} and got
    rows = lambda df: {tuple(r) for r in df.select("page_id", "pos", "link_id", "href", "score").collect()}
    assert rows(links.best_anchor(titles, anchors)) == rows(links.best_anchor(titles, anchors, by_prefix=False))


def test_titles_of_common_words_do_not_meet_all_that_share_one(spark):
    rng = random.Random(4)
    line = lambda k: " ".join(rng.sample([f"w{i}" for i in range(60)], k))
    titles = spark.createDataFrame([(1, i, line(5)) for i in range(300)], TITLES)
    anchors = spark.createDataFrame([(1, i, f"https://x.org/{i}", line(8)) for i in range(3000)], ANCHORS)
    # About one anchor in three has one of a title's three rarest words: some 300 000 pairs by reckoning.
    of = links.lookup(titles, anchors)
    assert links._found(of, of.ranked, links.NEAR_STRONG).count() < 120_000
    assert links.close_pairs(titles, anchors, links.NEAR_STRONG).count() < 30_000


def test_first_tokens_are_those_of_the_whole_text(spark):
    rng = random.Random(6)
    parts = ["The", "of", "ΟΔΟΣ", "Σ.", "é", " ́", "İx", "ﬁn", "a b", "\n", "--", "½", "x" * 30, "  ", "\t", "日本", "Σ'", "'s"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", " ", "x" * 900, "the " * 300 + "a b c"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select([F.slice(text.tokens(F.col("s")), 1, 4).alias("want")] + [text.first_tokens(F.col("s"), 4, head).alias(f"h{head}") for head in (5, 20, 60)])
    assert all(r.want == r.h5 == r.h20 == r.h60 for r in rows.collect())


def test_words_of_the_documents_are_found_once(spark, monkeypatch):
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.sparkSession.createDataFrame([], df.schema)

    monkeypatch.setattr(queries, "stored", noted)
    queries.href_arbitration(spark, "/root/testdata/sf0.001").collect()
    assert len(plans) == 1 and "text" in plans[0]
