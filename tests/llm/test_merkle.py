"""The Merkle manifest against a plain version of its definition."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarn.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, run string, at int, node string, path string, top string, root string, block int, levels int"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [*row[:3], row[3] if row[3] is None else row[3] + more, row[4]]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_of(levels, place):
    out = []
    for level in levels[:-1]:
        out.append((level[place - 1], "") if place % 2 else ("", "".join(level[place + 1 : place + 2])))
        place //= 2
    return out


def plain(rows):
    runs = {}
    for r in rows:
        runs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    trees = {k: levels_of([x[2] for x in sorted(v, key=lambda x: x[:3])]) for k, v in runs.items()}
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    top = levels_of([trees[k][-1][0] for k in order])
    out = Counter()
    for i, k in enumerate(order):
        for place, (_, _, own, r) in enumerate(sorted(runs[k], key=lambda x: x[:3])):
            path = path_of(trees[k], place) + path_of(top, i)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1) if tampered else own
            for left, right in path:
                node = digest(left, node, right)
            out[(r[0], own, trees[k][-1][0], top[-1][0], digest(*[x + y for x, y in path]), node, node == top[-1][0])] += 1
    return out


def awkward():
    rows = [(i * 7 % 60 - 3, f"src{i % 3}", ["en", "de", "é", "", None, "zz", "ﬀ", "😀"][min(i % 11, 7)], i, f"text {i} é") for i in range(57)]
    rows += [(i, None, "en", None, "same") for i in (4, 4, 4)] + [(None, "s", "en", 5, "x"), (None, "s", None, None, None), (None, None, "en", None, None), (None, "s", "en", 5, "x")]
    return rows + [(14, "s", "de", 9223372036854775807, ""), (21, "s", "one row", 3, "a" * 70000), (-(1 << 63), "", "", 0, "")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", 1, "n", "p", "t", "r", 2, 3) for r in rows], SCHEMA)


def found(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [2, 4, merkle.BLOCK])
def test_manifest_is_that_of_the_plain_tree(spark, block):
    rows = awkward()
    assert found(merkle.manifest(frame(spark, rows).repartition(3), block)) == plain(rows)


def test_blocks_of_many_levels(spark):
    rows = [(i, "s", "en" if i % 4 else "de", i, str(i)) for i in range(333)]
    got = found(merkle.manifest(frame(spark, rows).repartition(5), 4))
    assert got == plain(rows)
    assert {r[6] for r in got} == {True, False}
    assert all(r[6] == (zlib.crc32(str(r[0]).encode()) % 7 != 0) for r in got)


def test_no_rows_and_one_row(spark):
    none = merkle.manifest(frame(spark, []))
    assert none.columns == COLUMNS and none.count() == 0
    row = (3, None, None, 2, "ab")
    [got] = merkle.manifest(frame(spark, [row])).collect()
    assert got.leaf == got.subroot == got.root == leaf(row) and got.proof_sha256 == digest() and got.verified


def test_a_change_of_any_field_changes_the_root(spark):
    rows = [(i, "s", "en", i, str(i)) for i in range(9)]
    roots = set()
    for row in [rows[4], (4, None, "en", 4, "4"), (4, "s", "en", None, "4"), (4, "s", "en", 4, None), (4, "s", "en", 4, ""), (4, "s", None, 4, "4")]:
        roots |= {r.root for r in merkle.manifest(frame(spark, [*rows[:4], row, *rows[5:]])).select("root").distinct().collect()}
    assert len(roots) == 6


def test_places_are_gapless_in_each_run(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("run"), (F.col("id") % 700).alias("k"))
    got = merkle.ordered(rows.repartition(7), ["k"]).collect()
    for run in {r.run for r in got}:
        own = sorted((r.at, r.k) for r in got if r.run == run)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)
