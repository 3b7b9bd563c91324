"""Long contexts go to their counts and values packed by parts of their hashes, whatever the number of parts, and a context with a
next token has one row."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tarn.llm import language_model


def test_scores_do_not_depend_on_the_parts(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    lines = [" ".join(rng.choices(words, k=12)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(lines) if rng.random() < 0.7 else rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    for part, held in ((language_model.PART, language_model.HELD), (500, 2000)):
        monkeypatch.setattr(language_model, "PART", part)
        monkeypatch.setattr(language_model, "HELD", held)
        seen.append({r.doc_id: r.score for r in language_model.language_scores(docs, pairs=1e-3, gain=1.0).collect()})
    assert language_model.part_bits(20_000) > 3
    for other in seen[1:]:
        assert other.keys() == seen[0].keys() and all(other[k] == pytest.approx(seen[0][k], abs=1e-8) for k in other)


def test_contexts_met_twice_are_packed(spark):
    ids = np.r_[np.arange(300), np.arange(100)].astype(np.int32)
    rows = list(language_model._context_marks(0, 4, 2)(iter([pa.record_batch([pa.array([ids.tobytes()])], ["ids"])])))
    assert sum(r.num_rows for r in rows) == 4 and sum(r.column("heads").nbytes for r in rows) < 5 * len(ids)
    df = spark.createDataFrame([(bytearray(ids.tobytes()),)], "ids binary")
    bits = language_model.recurring_map(df, 0, 2)
    assert int(np.bitwise_count(bits).sum()) == 96
    every, _, place = language_model.laid([ids.tobytes()], 0)
    assert len(language_model._recurring(every, place, bits, 4)[0]) == 2 * 96


def test_a_context_with_a_token_has_one_value_row(spark):
    counts = spark.createDataFrame([(2, 20, 2, 1e-9), (3, 30, 1, 1e-9), (3, None, 1, None)], "c long, g long, n long, p double")
    assert language_model.long_values(counts).count() == 4  # (2, 20), (3, 30), and what 2 and 3 leave
