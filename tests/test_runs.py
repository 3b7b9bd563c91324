"""Runs of the monitor: landed pages, buckets of state, the company step and duplicates over a stream."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarn.functions.display import BLOCKED_MESSAGE, LINK_WARNING
from tarn.operators import company_run, gates, identity
from tarn.operators.cards import card_links
from tarn.operators.lifecycle import Config
from tarn.streaming import buckets, horizon, page_run
from tarn.streaming.poll import STATE

NOW = datetime(2024, 2, 1)
BODIES = "page_id long, attempt_no int, strategy string, content string, n_links int, link_bearing boolean, error string"


def now():
    return F.lit(str(NOW)).cast("timestamp")


def page(i, url, first=True, stored=None, failures=0, error=None, strategy="direct"):
    return (i, url, None, first, stored, failures, error, strategy, None, None, None)


def reader(body, base):
    if "broken" in body:
        raise ValueError("no such markup")
    return card_links(body, base)


def body_of(*titles):
    return "<ul>" + "".join(f'<li><h3><a href="/jobs/{i}">{t}</a></h3><p>see more</p></li>' for i, t in enumerate(titles)) + "</ul>" + "words " * 200


ANSWER = '{"postings": [{"title": "Night Baker", "company": "Oven", "link_id": null}, {"title": "Tram Driver", "link_id": "2"}]}'


@pytest.fixture(scope="module")
def run(spark):
    text = body_of("Night Baker", "Tram Driver")
    board = '{"jobs": [{"title": "Welder", "absolute_url": "https://x.org/w?utm_source=a"}, {"title": " "}, {"title": "Fitter", "absolute_url": "https://x.org/f"}, {"title": "Welder", "absolute_url": "https://x.org/w"}]}'
    feed = "<rss>" + "".join(f"<item><title>Feed job {i}</title><link>https://f.org/{i}</link></item>" for i in range(3)) + "</rss>"
    bare = "<p>" + "no links here " * 60
    pages = [
        page(1, "https://a.org/jobs"), page(2, "https://b.org/jobs"), page(3, "https://boards.greenhouse.io/c"), page(4, "https://d.org/", first=False), page(5, "https://e.org/"),
        page(6, "https://g.org/", failures=4), page(7, "https://h.org/", failures=1), page(8, "https://i.org/", error=LINK_WARNING + " (3 of 4)"), page(9, "https://j.org/"), page(10, "https://k.org/"), page(11, "https://l.org/"),
    ]
    direct = lambda i, content, error=None: (i, 1, "direct", content, 1, True, error)
    bodies = [
        direct(1, text), direct(2, text + "broken"), (3, 1, "greenhouse", board, 1, True, None), direct(3, text), direct(4, text), (4, 2, "rss", feed, 1, True, None), direct(5, None, "HTTP 403"),
        (5, 2, "rss", feed, 1, True, None), direct(6, None, "HTTP 403"), direct(7, "Just a moment " + text), direct(8, text), direct(9, text), direct(10, text), direct(11, bare),
    ]
    answers = [(1, ANSWER), (2, ANSWER), (4, ANSWER), (8, ANSWER), (9, "sorry"), (11, '{"postings": [{"title": "A one"}, {"title": "B two"}, {"title": "C three"}]}')]
    pages = spark.createDataFrame(pages, page_run.PAGE)
    bodies = spark.createDataFrame(bodies, BODIES)
    chosen, _ = page_run.choose(pages, bodies, lambda df, name: df)
    same = chosen.filter("page_id = 8").first().hash
    pages = pages.withColumn("last_content_hash", F.when(F.col("page_id") == 8, same))
    return page_run.run_pages(pages, bodies, spark.createDataFrame(answers, "page_id long, raw string"), now(), read_cards=reader)


def test_one_broken_page_does_not_stop_the_others(run):
    assert {(r.page_id, r.step, r.error) for r in run.failures.collect()} == {
        (2, "links", "ValueError: no such markup"), (6, "fetch", "direct: HTTP 403"), (7, "fetch", 'direct: blocked by anti-bot check (matched "just a moment")'),
        (9, "extraction", "the model's answer is not a list of postings"), (10, "extraction", "no answer from the model"),
    }
    rows = Counter(r.page_id for r in run.rows.collect())
    assert rows == {1: 2, 3: 2, 4: 3, 5: 3, 11: 3}


def test_pages_remember_what_a_run_made_of_them(run):
    got = {r.page_id: r for r in run.pages.collect()}
    assert {i: r.status for i, r in got.items()} == {1: "ok", 2: "error", 3: "ok", 4: "ok", 5: "ok", 6: "error", 7: "error", 8: "unchanged", 9: "error", 10: "error", 11: "ok"}
    assert [got[i].failure_count for i in (1, 2, 6, 7, 8)] == [0, 1, 5, 2, 0]
    assert got[6].last_error == BLOCKED_MESSAGE and got[2].last_error == "ValueError: no such markup"
    assert got[8].last_error == LINK_WARNING + " (3 of 4)" and got[1].last_error is None and got[11].last_error.startswith(LINK_WARNING)
    assert got[2].last_content_hash is None and got[1].last_content_hash and got[4].first_crawl_done
    assert [got[i].fetch_strategy for i in (1, 3, 4, 5, 6)] == ["direct", "greenhouse", "rss", "rss", "direct"]
    assert all(r.last_checked_at == NOW and r.poll_claimed_at is None for r in got.values())


def test_links_and_keys_of_a_run(run):
    rows = {(r.page_id, r.title): r for r in run.rows.collect()}
    assert rows[1, "Night Baker"].url == "https://a.org/jobs/0" and rows[1, "Night Baker"].link_source == "card"
    assert rows[1, "Tram Driver"].dedupe_key == "https://a.org/jobs/1"
    assert rows[3, "Welder"].url == "https://x.org/w" and rows[3, "Welder"].link_source == "platform"
    assert rows[11, "A one"].url is None and rows[11, "A one"].dedupe_key == "t:a one|c:|l:" and not rows[4, "Feed job 0"].first_crawl_done


# --- buckets ---------------------------------------------------------------------------------------

CRAWL = "page_id long, pos int, dedupe_key string, title string, company string, location string, compensation string, url string, link_source string, link_note string, link_score double, first_crawl_done boolean"


def crawl_row(p, n, company="Oven"):
    return (p, n, f"k{n}", f"Role {n}", company, "Here", None, f"https://x.org/{p}/{n}", "cited", None, 1.0, True)


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_tick_rewrites_only_the_buckets_that_it_touches(spark, tmp_path):
    path = tmp_path / "state"
    state = buckets.Buckets(spark, str(path))
    config = Config(gates.Profile())
    every = spark.createDataFrame([crawl_row(p, n) for p in range(200) for n in (1, 2)], CRAWL)
    assert len(buckets.run_touched(state, every, 0, now(), config)) > 50 and state.read().count() == 400
    before = files(path)
    one = spark.createDataFrame([crawl_row(7, 1), crawl_row(7, 3)], CRAWL)
    assert len(buckets.run_touched(state, one, 1, now() + F.expr("INTERVAL 15 MINUTES"), config)) == 1
    new = {f: t for f, t in files(path).items() if before.get(f) != t}
    assert len({f.split("/")[0] for f in new}) == 1 and all("batch=1" in f for f in new) and set(before) <= set(files(path))
    rows = {(r.page_id, r.dedupe_key): r for r in state.read().collect()}
    assert len(rows) == 401 and rows[7, "k1"].last_seen_at == NOW + timedelta(minutes=15) and rows[8, "k1"].last_seen_at == NOW
    # The same content was sent from pages of other buckets.
    assert rows[7, "k3"].notified_at is not None and rows[7, "k1"].notified_at is None or rows[7, "k1"].duplicate_of is None


def test_a_batch_that_is_run_again_gives_the_same_rows_and_old_ones_expire(spark, tmp_path):
    state = buckets.Buckets(spark, str(tmp_path / "state"), buckets=4, kept=2)
    config = Config(gates.Profile())
    crawl = lambda k: spark.createDataFrame([crawl_row(p, n, f"C{p}{n}") for p in range(8) for n in range(k)], CRAWL)
    for batch in range(4):
        buckets.run_touched(state, crawl(batch + 1), batch, now() + F.make_interval(hours=F.lit(batch)), config)
    assert set(map(tuple, state.batches().values())) == {(2, 3)}
    rows = lambda: sorted(map(str, state.read().collect()))
    was = rows()
    buckets.run_touched(state, crawl(4), 3, now() + F.make_interval(hours=F.lit(3)), config)
    assert rows() == was and state.read(before=3).count() == 24


def test_what_other_buckets_sent_counts(spark, tmp_path):
    state = buckets.Buckets(spark, str(tmp_path / "state"))
    config = Config(gates.Profile())
    buckets.run_touched(state, spark.createDataFrame([crawl_row(1, 5)], CRAWL), 0, now(), config)
    buckets.run_touched(state, spark.createDataFrame([crawl_row(2, 5), crawl_row(2, 6)], CRAWL), 1, now() + F.expr("INTERVAL 1 DAY"), config)
    rows = {(r.page_id, r.dedupe_key): r for r in state.read().collect()}
    assert rows[1, "k5"].notified_at == NOW and rows[2, "k6"].notified_at == NOW + timedelta(days=1)
    assert rows[2, "k5"].notified_at is None and rows[2, "k5"].duplicate_of == rows[1, "k5"].id


def test_the_stream_runs_over_buckets_and_keeps_a_batch_its_time(spark, tmp_path):
    spark.createDataFrame([crawl_row(1, 1), crawl_row(2, 2)], CRAWL).coalesce(1).write.parquet(str(tmp_path / "in"))
    state = buckets.Buckets(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema(CRAWL).parquet(str(tmp_path / "in"))
    buckets.start(stream, state, Config(gates.Profile()), str(tmp_path / "check"), lambda: str(NOW), once=True).awaitTermination(120)
    assert {r.first_seen_at for r in state.read().collect()} == {NOW} and state.read().count() == 2
    assert buckets.clock(spark, str(tmp_path / "check-clock"), 0, lambda: "2030-01-01 00:00:00") == str(NOW)
    assert state.read().columns == [c.split()[0] for c in STATE.split(", ") if " " in c and not c.startswith(("summary", "title_mismatch"))]


# --- the company step ------------------------------------------------------------------------------

POSTINGS = "id string, page_id long, title string, company string, first_seen_at timestamp, company_status string, pending_notify boolean"


def posting(i, page_id, company, status="pending"):
    return (f"p{i:02}", page_id, f"Title {i}", company, NOW - timedelta(hours=50 - i), status, False)


def known(name, status="ok", legitimacy="verified", failures=0, age=timedelta(days=1)):
    dossier = {"name": name, "legitimacy": legitimacy, "confidence": "high"} if status == "ok" else None
    return (name.lower(), name, dossier, legitimacy if dossier else None, status, None, failures, NOW - age)


def test_companies_move_over_runs_within_their_budgets(spark):
    rows = [posting(i, 1, c) for i, c in enumerate(["Fresh", "New1", "Bad", "New2", "New3", "New1", None, "Gone", "Stale", "Odd", "Late"])]
    rows += [posting(20, 2, "New3"), posting(21, 3, None), posting(22, 1, "Fresh", "ok")]
    companies = [known("Fresh"), known("Gone", "failed", failures=3), known("Stale", age=timedelta(days=31)), known("Bad", "failed", failures=2)]
    state = spark.createDataFrame(rows, POSTINGS)
    cache = spark.createDataFrame(companies, company_run.COMPANIES)
    fallback = spark.createDataFrame([(3, "Page Label")], "page_id long, fallback string")
    said = {"new1": '{"legitimacy": "suspicious"}', "new2": '{"legitimacy": "verified", "confidence": "high"}', "new3": '{"legitimacy": "verified", "confidence": "high"}', "stale": '{"legitimacy": "likely_real", "confidence": "high"}', "page label": "no idea"}
    asked = []

    def research(wanted):
        names = sorted(r.norm_name for r in wanted.collect())
        asked.append(names)
        return spark.createDataFrame([(n, said.get(n), None if n in said else "search failed") for n in names], "norm_name string, raw string, error string")

    def step(minutes):
        nonlocal state, cache
        state, cache = company_run.company_step(state, cache, fallback, research, now() + F.make_interval(mins=F.lit(minutes)))
        return {r.id: r for r in state.collect()}, {r.norm_name: r for r in cache.collect()}

    first, companies = step(0)
    # Page 1 looks three up (new1, bad, new2), page 2 new3 and page 3 its label; what page 2 found counts for page 1.
    assert asked[0] == ["bad", "new1", "new2", "new3", "page label"]
    assert [first[f"p{i:02}"].company_status for i in range(11)] == ["ok", "warned", "pending", "ok", "ok", "warned", "none", "warned", "pending", "pending", "pending"]
    assert first["p20"].company_status == "ok" and first["p21"].company_status == "pending" and first["p22"].company_verdict is None
    assert all(r.pending_notify == (r.company_status != "pending") for k, r in first.items() if k != "p22")
    assert (companies["bad"].failure_count, companies["page label"].failure_count, companies["new2"].failure_count) == (3, 1, 0)
    assert companies["page label"].research_error == "the answer is no dossier" and companies["odd"].research_status == "pending" and "late" not in companies
    second, companies = step(5)
    # Bad has failed three times and is judged without a dossier; the label was tried five minutes ago.
    assert asked[1] == ["late", "odd", "stale"] and second["p02"].company_status == "warned" and second["p21"].company_status == "pending"
    assert "repeated attempts" in second["p02"].company_verdict.reason and second["p08"].company_status == "ok"
    step(20)
    third, companies = step(40)
    assert companies["page label"].failure_count == 3 and companies["odd"].failure_count == 3
    last, _ = step(60)
    assert last["p21"].company_status == "warned" and not [r for r in last.values() if r.company_status == "pending"]


def test_with_the_layer_off_rows_go_on_as_they_are(spark):
    state = spark.createDataFrame([posting(i, 1, "A") for i in range(12)], POSTINGS)
    none = spark.createDataFrame([], company_run.COMPANIES)
    after, companies = company_run.company_step(state, none, spark.createDataFrame([], "page_id long, fallback string"), None, now(), active=False)
    assert Counter((r.company_status, r.pending_notify) for r in after.collect()) == {("none", True): 10, ("pending", False): 2} and companies.count() == 0


# --- duplicates over a stream ----------------------------------------------------------------------

ROWS = "id string, content_key string, first_seen_at timestamp, notified_at timestamp"


@pytest.mark.parametrize("splits", [1, 3])
def test_duplicates_over_a_stream_are_those_of_all_rows(spark, tmp_path, splits):
    rng = random.Random(splits)
    rows = []
    for i in range(120):
        seen = NOW + timedelta(hours=rng.randrange(24 * 40), microseconds=rng.choice([0, 1, 999, 1000]))
        sent = rng.choice([None, seen, seen + timedelta(hours=rng.randrange(40))])
        rows.append((f"r{i:03}", rng.choice(["a", "b", "c", None]), seen, sent))
    rows += [("x1", "a", NOW, NOW), ("x2", "a", NOW, NOW), ("x3", "a", NOW + timedelta(days=14), None), ("x4", "a", NOW + timedelta(days=14, microseconds=1), None)]
    rows.sort(key=lambda r: r[2])
    want = {(r.id, r.duplicate_of) for r in identity.duplicates(spark.createDataFrame(rows, ROWS)).collect()}
    # A batch holds a stretch of time, in any order; a fact may come up to forty hours before its time.
    end = [("end", "zz", NOW + timedelta(days=90), None)]
    for k in range(splits):
        part = rows[k * len(rows) // splits : (k + 1) * len(rows) // splits]
        rng.shuffle(part)
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(end, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    answers = horizon.duplicates_stream(stream, "60 days")
    query = answers.writeStream.format("memory").queryName(f"answers{splits}").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {(r.id, r.duplicate_of) for r in spark.table(f"answers{splits}").collect()}
    sure = {r[0] for r in rows if r[2] < NOW + timedelta(days=29)}
    assert {g for g in got if g[0] in sure} == {w for w in want if w[0] in sure} and want and got <= want
