"""TPUT search against scoring every document for every item."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tarn.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
DOCS = "doc_id long, text string, item_id string, item long, term string, bag string, n long, score int, rank int"
ITEMS = "item_id long, text string, doc_id long, item long, term string, weight string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=ranking.TOP):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [x for x in bags if x[1]]
    texts, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item_id, text in items:
        scores = []
        for doc_id, bag in bags:
            m = 100 - 75 + 75 * sum(bag.values()) * texts // length
            score = sum(math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
            scores.append((-score, doc_id is None, doc_id or 0))
        for i, (score, none, doc_id) in enumerate(sorted(x for x in scores if x[0])[:top]):
            out[(item_id, i + 1, None if none else doc_id, -score)] += 1
    return out


def tables(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 1, "t", "b", 2, 3, 4) for i, t in docs], DOCS).repartition(3),
            spark.createDataFrame([(i, t, 5, 6, "t", "w") for i, t in items], ITEMS))


def texts_of(rng, n, words=60):
    names = [f"w{k}" for k in range(words)]
    return [" ".join(rng.choices(names, weights=[1 / (k + 1) for k in range(words)], k=rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("top", [1, 3, ranking.TOP])
def test_search_is_that_of_scoring_everything(spark, top):
    rng = random.Random(top)
    docs = list(enumerate(texts_of(rng, 300)))
    copy = docs[7][1]
    docs += [(1000 - i, copy) for i in range(60)] + [(None, copy), (None, "only é 中文 x"), (5000, None), (5001, ""), (5002, " .-/"), (5003, copy.upper() + "!"), docs[3], docs[3]]
    docs += [(6000, " ".join(["w1", "w59"] * 4000)), (6001, "É é \x00nul\x7fdel a_b")]
    items = list(enumerate(texts_of(rng, 12) + [copy, copy, "é 中文", "none of these here", "w0", "w59 w59 w59 w58", None, "", "É nul del a b"]))
    items += [items[0], (None, copy)]
    got = Counter(tuple(r) for r in ranking.search(*tables(spark, docs, items), top).collect())
    assert got == plain(docs, items, top)


def test_most_of_a_long_list_is_not_read(spark):
    rng = random.Random(5)
    docs = list(enumerate(texts_of(rng, 900, 400)))
    items = [(0, "w0 w1 w200 w333")]
    asked = spark.createDataFrame([(t,) for t in ("w0", "w1", "w200", "w333")], "term string")
    postings, members, n = ranking.indexed(tables(spark, docs, [])[0], asked)
    assert n == members.count() == 900
    df = defaultdict(int)
    for _, text in docs:
        for t in set(terms(text)):
            df[t] += 1
    assert {r.term: r["sum(copies)"] for r in postings.groupBy("term").sum("copies").collect()} == {t: df[t] for t in ("w0", "w1", "w200", "w333")}
    per_term = defaultdict(list)
    for r in postings.collect():
        per_term[r.term].append(r.impact)
    assert all(1000000000 // (1000 + 8 * 25) >= max(v) or max(v) < 1000000 for v in per_term.values())
    assert Counter(tuple(r) for r in ranking.search(*tables(spark, docs, items)).collect()) == plain(docs, items)


def test_empty_tables(spark):
    some, none = [(1, "a b")], []
    for docs, items in ((none, none), (some, none), (none, some), ([(1, None)], some)):
        df = ranking.search(*tables(spark, docs, items))
        assert df.columns == ["item_id", "rank", "doc_id", "score"] and df.count() == 0
    # one document has its terms' df at its highest: weights are still above 0
    [row] = ranking.search(*tables(spark, some, [(9, "B")])).collect()
    assert (row.item_id, row["rank"], row.doc_id) == (9, 1, 1) and row.score == list(plain(some, [(9, "B")]))[0][3]
