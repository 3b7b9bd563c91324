"""MinHash near duplicates against comparing all sets."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import minhash

SCHEMA = "doc_id long, text string, node long, n long, low int, cell long, root long, th long, pairs string, s0 int"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset((w,) for w in words)


def plain(rows):
    sets = [shingle_set(t) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=sorted)
    parent = {s: s for s in distinct}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    holders = {}
    for s in distinct:
        for x in s:
            holders.setdefault(x, []).append(s)
    for a in distinct:
        for b, both in Counter(itertools.chain.from_iterable(holders[x] for x in a)).items():
            if 100 * both >= 80 * len(a | b):
                parent[find(a)] = find(b)
    low = {}
    order = lambda i: (i is None, i or 0)
    for (i, _), s in zip(rows, sets):
        if s:
            low[find(s)] = min(low.get(find(s), i), i, key=order)
    out = Counter()
    for (i, _), s in zip(rows, sets):
        c = low[find(s)] if s else i
        out[(i, len(s), c, i == c)] += 1
    return out


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def changed(rng, text, share):
    out = list(text)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = f"x{rng.randrange(10**6)}"
    return out


def awkward(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n\t\x0b", "one", "ONE", "one one", "one one one", "one two", "two one", "é É", "É é"]
    texts += [" ".join(words(rng, rng.randint(2, 9), 12)) for _ in range(80)]
    base = words(rng, 120)
    texts += [" ".join(changed(rng, base, rng.choice([0.01, 0.03, 0.06, 0.1]))) for _ in range(60)]
    for _ in range(12):
        own = words(rng, rng.randint(20, 300))
        texts += [" ".join(own), "\n".join(own).upper(), " ".join(changed(rng, own, 0.04)), " ".join(changed(rng, own, 0.05)), " ".join(own[: len(own) * 9 // 10])]
    long = words(rng, 9000, 5000)
    texts += [" ".join(long), " ".join(long[:8500]), " ".join(changed(rng, long, 0.05)), "a" * 50000]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return rows + [rows[-6], rows[-6], (None, texts[-9]), (None, None), (None, "nobody else says this"), (-3, texts[-10])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, "p", 7) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed, list_rows, set_rows", [(1, minhash.LIST_ROWS, minhash.SET_ROWS), (2, 8, 6)])
def test_components_are_those_of_all_pairs(spark, seed, list_rows, set_rows):
    rows = awkward(seed)
    df = minhash.near_duplicates(frame(spark, rows), list_rows, set_rows)
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(tuple(r) for r in df.collect()) == plain(rows)


def test_no_rows_and_no_words(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    got = minhash.near_duplicates(frame(spark, [(2, None), (1, " "), (None, "")])).collect()
    assert {tuple(r) for r in got} == {(2, 0, 2, True), (1, 0, 1, True), (None, 0, None, True)}


def test_sketches_never_count_fewer_collisions():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for same in (300, 270, 200, 30):
        b = np.concatenate([a[:same], rng.integers(0, 1 << 63, 300 - same, dtype=np.uint64)])
        x, y = minhash.signature(np.unique(a)), minhash.signature(np.unique(b))
        met = int((x == y).sum())
        counted = int(minhash._collide(minhash.sketch(x)[None], minhash.sketch(y)[None])[0])
        jaccard = same / (600 - same)
        assert met <= counted <= met + 20 and abs(met / 64 - jaccard) < 0.25


def test_sketches_are_counted_alike_in_columns(spark):
    rng = np.random.default_rng(7)
    marks = rng.integers(0, 1 << 64, (50, 8), dtype=np.uint64)
    marks[:10, 4:] = marks[:10, :4]
    marks[10:20, 4:7] = marks[10:20, :3]
    rows = spark.createDataFrame([tuple(int(x) for x in r) for r in marks.view(np.int64)], ", ".join(f"c{i} long" for i in range(8)))
    got = [r[0] for r in rows.select(minhash.collisions([F.col(f"c{i}") for i in range(4)], [F.col(f"c{i}") for i in range(4, 8)])).collect()]
    assert got == list(minhash._collide(marks[:, :4], marks[:, 4:]))


def test_signatures_estimate_the_similarity():
    rng = random.Random(9)
    hits = []
    for _ in range(200):
        own = [rng.getrandbits(64) for _ in range(180)]
        a, b = np.array(sorted(set(own[:160])), dtype=np.uint64), np.array(sorted(set(own[20:])), dtype=np.uint64)
        hits.append(int((minhash.signature(a) == minhash.signature(b)).sum()))
    assert abs(np.mean(hits) / 64 - 140 / 180) < 0.02 and min(hits) >= minhash.MATCHES
