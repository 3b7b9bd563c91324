"""Attempts read from landed files, and what is pushed into their reader."""

import json

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

from tarn.sources import attempts, landed


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    rows = {
        "direct": [{"page_id": 1, "attempt_no": 1, "content": None, "n_links": 0, "link_bearing": True, "error": "HTTP 403"}, {"page_id": 2, "attempt_no": 1, "content": "é" * 600, "n_links": 3, "link_bearing": True}],
        "proxy:jina": [{"page_id": 1, "attempt_no": 2, "content": "text " * 200, "n_links": 2, "link_bearing": True}, {"page_id": "no", "attempt_no": 9}, {"page_id": 3, "attempt_no": "two", "content": "x" * 700, "n_links": True}],
    }
    for name, some in rows.items():
        place = root / f"strategy={name.replace(':', '%3A')}"
        place.mkdir()
        (place / "a.jsonl").write_text("\n".join(map(json.dumps, some)) + "\nnot json\n[1]\n\n" + json.dumps({"page_id": 9, "attempt_no": 7}))
    (root / "strategy=direct" / "notes.txt").write_text("nothing")
    return str(root)


def test_files_are_rows(spark, folder):
    rows = {(r.page_id, r.attempt_no, r.strategy): r for r in landed.read(spark, folder).collect()}
    assert set(rows) == {(1, 1, "direct"), (2, 1, "direct"), (9, 7, "direct"), (1, 2, "proxy:jina"), (3, None, "proxy:jina"), (9, 7, "proxy:jina")}
    assert rows[2, 1, "direct"].content == "é" * 600 and rows[3, None, "proxy:jina"].n_links is None and rows[1, 1, "direct"].error == "HTTP 403"
    assert landed.read(spark, folder + "/none").count() == 0


def test_a_filter_on_the_strategy_is_pushed(spark, folder):
    reader = landed.LandedReader(folder)
    other = IsNotNull(("strategy",))
    assert list(reader.pushFilters([EqualTo(("strategy",), "proxy:jina"), other, GreaterThan(("attempt_no",), 2)])) == [other]
    assert [p.strategy for p in reader.partitions()] == ["proxy:jina"]
    assert [r["page_id"] for b in reader.read(reader.partitions()[0]) for r in b.to_pylist()] == [9]
    assert list(reader.pushFilters([In(("strategy",), ("direct",))])) == [] and [p.path for p in reader.partitions()] == [""]
    some = landed.read(spark, folder).filter("strategy = 'direct' and attempt_no > 1")
    assert [(r.page_id, r.attempt_no) for r in some.collect()] == [(9, 7)] and some.rdd.getNumPartitions() == 1


def test_the_best_attempt_of_a_page_is_chosen_from_them(spark, folder):
    best = {r.page_id: r for r in attempts.select_attempts(landed.read(spark, folder)).collect()}
    assert best[1].strategy == "proxy:jina" and best[2].strategy == "direct" and best[9].error
