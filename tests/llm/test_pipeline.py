"""The pipeline on small tables, stage by stage against plain versions."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from tarn.llm import quality
from tests.llm.test_operators import SCHEMA, awkward, classes, frame, junk, leaks_of, prose, simhash_of, words


def tables(spark, path, rows, labels, items):
    frame(spark, rows).repartition(3).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_every_stage(spark, tmp_path):
    rng = random.Random(21)
    rows = awkward(5)
    good = [(1000 + i, prose(rng, rng.randint(40, 160)), rng.choice(["src0", "src0", "src1", "src2"])) for i in range(300)]
    bad = [(2000 + i, junk(rng, rng.randint(40, 160)), "src0") for i in range(80)]
    item = prose(rng, 30)
    leaked = [(3000 + i, prose(rng, 40) + " " + item + " " + prose(rng, 40), "src1") for i in range(5)]
    copies = [(4000 + i, good[i % 7][1], "src2") for i in range(40)]
    every = rows + good + bad + leaked + copies
    path = str(tmp_path)
    tables(spark, path, every, [(i, 1, 0) for i, _, _ in good[::2]] + [(i, 0, 0) for i, _, _ in bad[::2]], [(1, item), (2, None)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "shards":
            assert out.columns == columns
        before, after = docs.collect(), out.collect()
        check(name, before, after, spark, path, item)
        seen.append((name, len(after)))
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    whole = corpus_pipeline.run(spark, path).select(*docs.columns).collect()
    assert Counter(map(str, whole)) == Counter(map(str, docs.select(*docs.columns).collect()))


def check(name, before, after, spark, path, item):
    b, a = (Counter((r.doc_id, r.text) for r in x) for x in (before, after))
    if name == "quality":
        model = quality.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
        assert a == Counter({k: n for k, n in b.items() if model.score(quality.np.array([quality.features(k[1] or "")]))[0] >= quality.THRESHOLD})
        ids = {k[0] for k in a if k[0] is not None}
        assert sum(1000 <= i < 1300 for i in ids) >= 290 and sum(2000 <= i < 2080 for i in ids) <= 6
    elif name == "near duplicates":
        root = classes([simhash_of(r.text or "") for r in before])
        groups = defaultdict(list)
        for r, g in zip(before, root):
            groups[g].append(r)
        kept = Counter(root[before.index(r)] for r in after)
        assert set(kept) == set(groups) and set(kept.values()) == {1} and not a - b
        for r in after:
            ids = [x.doc_id for x in groups[root[before.index(r)]] if x.doc_id is not None]
            assert r.doc_id == min(ids, default=None)
    elif name == "decontamination":
        assert a == Counter({k: n for k, n in b.items() if not leaks_of(k[1], item)}) and sum((b - a).values()) == 5
    elif name == "mix":
        assert set(a) <= set(b) and max(a.values()) <= 2 * max(b.values())
        size, taken = defaultdict(int), defaultdict(int)
        for rows, total in ((before, size), (after, taken)):
            for r in rows:
                total[r.source] += words(r.text)
        longest = max(words(r.text) for r in before)
        assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= longest * len(size)
    else:
        assert Counter((r.doc_id, r.text) for r in after) == b
        assert all(0 <= r.shard < 8 and r.grown_shard in (r.shard, 8) for r in after)


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).agg(F.count(F.lit(1))).first()[0] == 0
