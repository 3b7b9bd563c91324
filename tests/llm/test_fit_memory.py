"""The fit of the quality model holds its sample once."""

import tracemalloc

import numpy as np

from tarn.llm import quality


def sample(n, seed):
    rng = np.random.default_rng(seed)
    form, buckets = rng.random((n, len(quality.FEATURES))), rng.integers(0, 60, (n, 2 * quality.BUCKETS))
    return np.concatenate([form, buckets], axis=1).astype(np.float32)


def test_the_driver_holds_the_sample_once(monkeypatch):
    monkeypatch.setattr(quality, "_descend", lambda p, u, prior, steps=400: np.zeros(p.shape[1]))
    n = 20_000
    rows = [quality.packed(x) for x in sample(n, 1)]
    tracemalloc.start()
    held = [quality.unpacked(rows)]
    size = held[0].nbytes
    model = quality._fitted(held, n // 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The sample and its design, which is half as wide again; a second copy of the sample would not fit.
    assert not held and len(model.weights) > 400 and peak < 3.3 * size


def test_one_array_gives_the_model_of_two():
    good, other = sample(300, 2), sample(400, 3)
    a, b = quality.fit(good, other), quality._fitted([np.concatenate([good, other])], 300)
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior
    both = np.concatenate([good, other])[:, len(quality.FEATURES) :]
    assert np.allclose(a.spread, both.std(axis=0) + 1.0)
    for p, u in ((good, other[:0]), (good[:0], other), (good[:0], other[:0])):
        assert (quality.fit(p, u).score(good) > 0.9).all()
