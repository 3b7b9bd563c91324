"""Leaks of a stretch of an item, against all stretches."""

import itertools
import random

import numpy as np

from tarn.llm import decontamination


def longest(same, n):
    """The most matched tokens of the whole item, or of any stretch of 25 tokens or more, at 80 %."""
    if 5 * sum(same) >= 4 * n:
        return sum(same)
    return max((sum(same[i:j]) for i in range(len(same)) for j in range(i + 25, len(same) + 1) if 5 * sum(same[i:j]) >= 4 * (j - i)), default=0)


def test_any_stretch_of_25_tokens_counts():
    rng = random.Random(2)
    same = [True] * 20 + [False, True, False, True] * 2 + [True] * 4 + [False] * 28
    assert longest(same, 60) and decontamination.verified(np.array(same), 60)
    for _ in range(400):
        n = rng.randint(20, 70)
        same = [rng.random() < rng.choice([0.6, 0.75, 0.85]) for _ in range(rng.randint(5, n))]
        got = decontamination.verified(np.array(same), n)
        assert (got[0] if got else 0) == longest(same, n)
        if got and 5 * sum(same) < 4 * n:
            assert got[1] >= 25 and 5 * got[0] >= 4 * got[1]


def test_an_excerpt_with_substitutions_leaks():
    rng = random.Random(3)
    item = [f"w{i}" for i in range(60)]
    index = decontamination.Index([(1, " ".join(item))])
    for size, changed in ((25, 5), (30, 4), (40, 6), (40, 8)):
        for _ in range(50):
            low = rng.randint(0, 60 - size)
            part = item[low : low + size]
            for k in rng.sample(range(size), changed):
                part[k] = "zzz"
            text = ["a"] * 9 + part + ["b"] * 9
            hashes, starts = decontamination._laid([" ".join(text)], decontamination._Hashes())
            assert index.leaks(hashes, starts)


def test_masks_hit_every_copy_of_25_tokens_with_a_fifth_substituted():
    for changed in itertools.combinations(range(25), 5):
        left = set(range(25)) - set(changed)
        assert any(all(o + p in left for p in m) for m in decontamination.MASKS for o in range(25 - m[-1]))
