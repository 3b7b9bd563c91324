"""The query of page states after a run: what it shows of pages that did not fail."""

import duckdb
import pytest

from tarn.plans.queries import ORACLE, _now
from tarn.plans.run_queries import landed, page_run_states
from tarn.streaming import page_run

WORDS = "<p>" + "some words " * 60 + "</p>"


def linked(*hrefs):
    return "".join(f'<a href="{h}">Link to {h[1:]}</a> ' for h in hrefs) + WORDS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pages")
    long = linked("/a", "/b") + "x" * 100_000
    rows = [(6, long), (8, linked("/login", "/pricing", "/terms")), (12, linked("/a", "/b")), (14, linked("/a")), (1, long), (11, linked("/a", "/b") + "y" * 100_000)]
    rows = [(i, f"https://p{i}.example.com/news/1", html) for i, html in rows]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return str(root)


def test_notes_about_pages_that_did_not_fail_are_no_errors(spark, folder):
    noted = {r.page_id: (r.status, r.last_error) for r in page_run.run_pages(*landed(spark, folder), _now()).pages.collect()}
    assert noted[6] == ("ok", "content was truncated") and noted[8][0] == "ok" and noted[8][1]
    got = page_run_states(spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE['page_run_states']})").fetchall())
