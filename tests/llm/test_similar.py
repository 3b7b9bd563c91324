"""The pipeline's near duplicates against all pairs of five-word shingle sets."""

import random

import corpus_pipeline

from tarn.llm import simhash
from tests.llm.test_operators import awkward, frame, prose


def shingles_of(text):
    t = (text or "").encode().lower().split()
    return {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_near_copies_of_many_bits_are_linked(spark):
    rng = random.Random(4)
    rows = awkward(7)
    for i in range(60):
        text = prose(rng, rng.randint(30, 200)).split()
        near = list(text)
        for _ in range(rng.randint(1, 3)):
            near[rng.randrange(len(near))] = "changed"
        rows += [(1000 + 2 * i, " ".join(text), "src0"), (1001 + 2 * i, " ".join(near), "src1")]
    base = prose(rng, 150).split()
    for i in range(30):  # a chain: only neighbours are similar
        base[5 * i % 150] = f"step{i}"
        rows.append((2000 + i, " ".join(base), "src0"))
    sets = [shingles_of(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    want = sorted(str(min((x for x in ids if x is not None), default=None)) for ids in groups.values())
    kept = corpus_pipeline.near_deduplicated(spark, frame(spark, rows), "").collect()
    assert sorted(str(r.doc_id) for r in kept) == want
    kept = simhash.one_of_similar(frame(spark, rows), cell_rows=4).collect()
    assert sorted(str(r.doc_id) for r in kept) == want
