"""Every long context that is met twice or more is a candidate of the language model, and no other."""

import numpy as np

from tarn.llm import language_model


def test_every_position_with_a_long_context_is_a_candidate():
    place = np.r_[np.arange(-2, 30), np.arange(-2, 3), np.arange(-2, 9)]
    at, hashes = language_model._candidates(np.arange(len(place)), place, 4)
    assert at.tolist() == [k for k in range(4, len(place)) if place[k] >= 4] and len(set(hashes.tolist())) == len(at)


def test_contexts_met_once_are_not_kept_whatever_they_gain(spark):
    counts = spark.createDataFrame([(1, 10, 1, 1e-9), (2, 20, 2, 1e-9), (3, 30, 1, 1e-9), (3, None, 1, None)], "c long, g long, n long, p double")
    keys = {r.key for r in language_model.long_values(counts).collect()}
    assert 10 not in keys and {20, 30} <= keys
