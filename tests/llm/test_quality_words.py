"""What the classifier reads of words, and how many rows it fits."""

import random

import numpy as np

from tarn.llm import quality
from tests.llm.test_operators import frame, prose, word


def plain_buckets(text):
    import xxhash

    shares = np.zeros(2 * quality.BUCKETS)
    words, raw = text.split(), text.encode()
    for w in words:
        shares[xxhash.xxh3_64_intdigest(w.lower()) % quality.BUCKETS] += 1 / len(words)
    for i in range(len(raw) - 2):
        a, b, c = raw[i : i + 3]
        h = ((a * 0x10001 ^ b * 0x101 ^ c) * 0x9E3779B1) % (1 << 32)
        shares[quality.BUCKETS + (h >> 25)] += 1 / (len(raw) - 2)
    return np.round(255 * np.sqrt(shares))


def test_buckets_are_those_of_a_plain_version():
    rng = random.Random(2)
    for text in ("one", "a b", "é é É", "x", prose(rng, 60), prose(rng, 20000)):
        assert np.abs(quality.features(text)[len(quality.FEATURES) :] - plain_buckets(text)).max() <= 1, text
    assert not quality.features(" \n").any()


def test_packing_keeps_the_features():
    rng = random.Random(3)
    x = np.array([quality.features(t) for t in ("", "one", prose(rng, 80))])
    back = quality.unpacked([quality.packed(r) for r in x])
    assert np.allclose(back, x, rtol=1e-6) and quality.unpacked([]).shape == (0, x.shape[1])


def test_words_alone_tell_texts_apart(spark):
    """Good and bad texts of one form, of different words."""
    rng = random.Random(4)
    kinds = [[word(rng) for _ in range(40)] for _ in range(2)]
    good = [i % 4 != 0 for i in range(1600)]
    rows = [(i, " ".join(rng.choice(kinds[not g]) for _ in range(60)), None) for i, g in enumerate(good)]
    labels = spark.createDataFrame([(i, 1, 0) for i, g in enumerate(good) if g and i % 2], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = quality.score(docs, quality.train(docs, labels)).filter("held_out").collect()
    by = lambda g: np.mean([r.score for r in got if good[r.doc_id] == g])
    assert by(True) > by(False) + 0.2
    ranks = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in got if good[a.doc_id] for b in got if not good[b.doc_id]]
    assert np.mean(ranks) > 0.95


def test_an_id_of_many_rows_does_not_grow_the_sample(spark, monkeypatch):
    rng, seen = random.Random(5), []
    rows = [(7, prose(rng, 12), None) for _ in range(3000)] + [(7, "the same", None)] * 500 + [(i, prose(rng, 12), None) for i in range(100, 300)]
    monkeypatch.setattr(quality, "fit", lambda good, unlabelled: seen.append((len(good), len(unlabelled))))
    quality.train(frame(spark, rows), spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int"), sample=200)
    assert all(n <= 300 for n in seen[0]) and seen[0][0] > 100
