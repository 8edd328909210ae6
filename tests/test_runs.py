"""Fetching by a scripted transport, versioned tables, company outputs, runs as one unit, robots rules."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sievewell.functions.fetching import Host, Options, Response, agent_key, backoff_ms, followed, http_get, robots_allow, robots_rules, unsafe
from sievewell.operators import page_postings, robots
from sievewell.operators.runs import Runs
from sievewell.operators.settings import PERSONAS
from sievewell.session import workers_import
from sievewell.sinks.companies import known_resolution, raw_posting_texts, remember_resolution, write_context, write_raw_postings
from sievewell.sinks.versioned import Versioned
from sievewell.sources.page_tree import page_facts
from sievewell.sources.web_pages import CACHE_SCHEMA, WebPages, fetch_pages, fetch_totals, new_cache_rows
from sievewell.sources.yaml_files import raw_postings
from tests import scripted

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)


@pytest.fixture
def agent(tmp_path):
    (tmp_path / "asked").mkdir()
    return f"test folder={tmp_path}/asked"


def _fetched(spark, urls, agent, cache=None, **options):
    workers_import(spark)
    opts = Options(user_agent=agent, **({"delay_ms": 0, "backoff_ms": 0, "robots": "off"} | options))
    got = fetch_pages(spark.createDataFrame([(u,) for u in urls], "url string"), scripted.get, opts, cache, NOW)
    rows = got.collect()
    return {r.url: r for r in rows}, spark.createDataFrame(rows, got.schema)


def _cache(spark, minutes, url="https://a.example/down", body="old"):
    return spark.createDataFrame([(url, 200, url, body, NOW - timedelta(minutes=minutes))], "url string, status int, final_url string, body string, fetched_at timestamp").select(F.sha2("url", 256).alias("cache_key"), "*")


def test_retries_until_it_answers(spark, agent):
    rows, table = _fetched(spark, ["https://a.example/flaky", "https://b.example/gone", "https://c.example/down"], agent, retries=2)
    assert (rows["https://a.example/flaky"].status, rows["https://a.example/flaky"].retries, rows["https://a.example/flaky"].requests) == (200, 2, 3)
    assert (rows["https://b.example/gone"].state, rows["https://b.example/gone"].status, rows["https://b.example/gone"].retries) == ("network", 404, 0)
    assert (rows["https://c.example/down"].state, rows["https://c.example/down"].error, rows["https://c.example/down"].requests) == ("failed", "connection refused", 3)
    assert fetch_totals(table).first().asDict() == {"fresh_cache_hits": 0, "cache_misses": 3, "stale_cache_fallbacks": 0, "retries_used": 4, "outgoing_requests": 7, "failures": 1}
    assert [r.url for r in new_cache_rows(table).collect()] == ["https://a.example/flaky"]


def test_fresh_answers_need_no_request_and_stale_ones_stand_in(spark, agent, tmp_path):
    url = "https://a.example/down"
    rows, table = _fetched(spark, [url], agent, _cache(spark, 719))
    assert (rows[url].state, rows[url].body, scripted.requests(tmp_path / "asked")) == ("fresh", "old", []) and fetch_totals(table).first().fresh_cache_hits == 1
    rows, table = _fetched(spark, [url], agent, _cache(spark, 721), retries=1)
    assert (rows[url].state, rows[url].body, rows[url].retries, rows[url].error) == ("stale", "old", 1, "connection refused") and new_cache_rows(table).isEmpty()
    assert _fetched(spark, ["https://x.example/"], agent, _cache(spark, 900, "https://x.example/"))[0]["https://x.example/"].state == "network"


def test_a_host_keeps_its_pace(spark, agent, tmp_path):
    urls = [f"https://{h}.example/{i}" for h in ("slow", "other") for i in range(3)]
    _fetched(spark, urls, agent, delay_ms=200)
    times = {h: [t for u, t in scripted.requests(tmp_path / "asked") if h in u] for h in ("slow", "other")}
    assert all(b - a >= 0.19 for ts in times.values() for a, b in zip(ts, ts[1:])) and all(len(ts) == 3 for ts in times.values())


def test_robots_rules_come_first(spark, agent, tmp_path):
    urls = ["https://rules.example/private/x", "https://rules.example/private/jobs/1", "https://rules.example/", "https://none.example/private/x"]
    rows, _ = _fetched(spark, urls, agent, robots="strict")
    assert {u.split(".example")[1] + u[8]: r.state for u, r in rows.items()} == {"/private/xr": "blocked", "/private/jobs/1r": "network", "/r": "network", "/private/xn": "network"}
    assert sum(u.endswith("robots.txt") for u, _ in scripted.requests(tmp_path / "asked")) == 2
    warned = _fetched(spark, urls[:1], agent, robots="warn")[0][urls[0]]
    assert warned.state == "network" and "disallowed" in warned.warning


def test_redirects_are_followed_safely(spark, agent):
    rows, _ = _fetched(spark, ["http://hops.example/hop6", "http://hops.example/hop7", "https://in.example/inward", "http://10.0.0.1/", None], agent, retries=0)
    assert (rows["http://hops.example/hop6"].final_url, rows["http://hops.example/hop6"].body) == ("http://hops.example/hop0", "end") and rows["http://hops.example/hop7"].status == 302
    assert rows["https://in.example/inward"].error == "Private or local network addresses are not allowed." and rows["http://10.0.0.1/"].state == "unsafe" and rows[""].error == "URL cannot be blank."
    assert followed("https://a.example/x", "http://a.example/y?z") == "https://a.example/y?z" and followed("https://a.example/", "http://b.example/") == "http://b.example/"


def test_addresses_and_pauses():
    assert [unsafe(u) is None for u in ("https://a.example/", "http://localhost/", "http://[::1]/", "ftp://a.example", "https://u:p@a.example/", "http://100.64.0.1/", "http://8.8.8.8/", "http://[bad", "https:///x")] == [True, False, False, False, False, False, True, False, False]
    assert [backoff_ms(i, 300) for i in (0, 1, 5, 40)] == [300, 600, 9600, 10000] and backoff_ms(3, 0) == 0
    with pytest.raises(OSError):
        http_get("http://127.0.0.1:9/", 5, "x")
    pauses, answers = [], iter([Response(500, ""), Response(429, ""), Response(200, "ok")])
    host = Host(lambda *_: next(answers), Options(retries=2, backoff_ms=100, delay_ms=0), clock=lambda: 0.0, sleep=pauses.append)
    assert host.fetch("https://a.example/")["retries"] == 2 and pauses == [0.1, 0.2]


def test_few_addresses_as_a_source(spark, agent):
    workers_import(spark)
    spark.dataSource.register(WebPages)
    got = spark.read.format("web_pages").options(addresses='["https://a.example/1", "https://b.example/2", "https://a.example/1"]', transport="tests.scripted:get", useragent=agent, delay_ms="0", robots="off").load()
    assert sorted((r.url, r.status) for r in got.collect()) == [("https://a.example/1", 200), ("https://b.example/2", 200)]
    assert spark.read.format("web_pages").option("addresses", "[]").load().count() == 0


def test_fetched_pages_become_raw_postings(spark, agent, tmp_path):
    """From addresses to texts by company, and back into postings; a company's partition is replaced whole, others stay."""
    _, pages = _fetched(spark, ["https://a.example/careers", "https://b.example/careers"], agent)
    found = page_postings.candidates(page_facts(pages.withColumn("page", F.col("host")), "page", "final_url", "body"), "page")
    of = found.selectExpr("page as company_id", "upper(page) as company_name", "'https://' || page as career_url", "rank", "title", "url", "snippet", "timestamp '2024-05-01 12:00:00' as fetched_at")
    out = f"file://{tmp_path}/raw"
    write_raw_postings(of, out)
    back = spark.read.parquet(out)
    assert sorted((r.company, r.file_name) for r in back.collect()) == [("a-example", "01-platform-engineer.txt"), ("b-example", "01-platform-engineer.txt")]
    posting = raw_postings(back.select(F.col("file_name").alias("source_file"), "raw_text")).where("company_name = 'A.EXAMPLE'").first()
    assert posting.title == "Platform Engineer" and "Source URL: https://a.example/jobs/1" in posting.description
    write_raw_postings(of.where("company_id = 'a.example'").withColumn("title", F.lit("QA Engineer")).withColumn("rank", F.lit(123)), out)
    spark.catalog.refreshByPath(out)
    assert sorted((r.company, r.file_name) for r in spark.read.parquet(out).collect()) == [("a-example", "123-qa-engineer.txt"), ("b-example", "01-platform-engineer.txt")]
    write_context(spark.createDataFrame([("a", "T", "", []), ("b", "", "", []), ("c", "", None, ["x"])], "company_id string, page_title string, page_description string, contexts array<string>"), f"file://{tmp_path}/context")
    assert sorted(r.company for r in spark.read.parquet(f"file://{tmp_path}/context").collect()) == ["a", "c"]


def test_resolution_is_remembered(spark, tmp_path):
    state = Versioned(spark, f"file://{tmp_path}/resolution")
    rows = lambda *r: spark.createDataFrame([(*x, NOW) for x in r], "company_id string, career_url string, resolved_url string, confidence int, jobs_found int, updated_at timestamp")
    assert known_resolution(state).count() == 0
    remember_resolution(rows(("a", "u", "u/jobs", 50, 3), ("b", "v", "v/jobs", 70, 1)), state)
    remember_resolution(rows(("a", "u", "u/careers", 90, 4), ("b", "v", "v/none", 10, 0), ("c", "w", " ", 5, 2)), state)
    assert sorted((r.company_id, r.resolved_url) for r in known_resolution(state).collect()) == [("a", "u/careers"), ("b", "v/jobs")]


def test_versions_switch_whole_or_not_at_all(spark, tmp_path):
    table = Versioned(spark, f"file://{tmp_path}/t", keep=1)
    rows = lambda *r: spark.createDataFrame(r, "k int, v string")
    assert table.version() is None and table.read() is None and table.read("k int").count() == 0
    table.merge(rows((1, "a"), (2, "b")), "k")
    held = table.read()
    crashed = table.write(rows((9, "never")))
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "b")]
    table.merge(rows((2, "c"), (3, "d")), "k")
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, held.collect())) == [(1, "a"), (2, "b")], "a reader keeps the version that it has resolved"
    table.merge(spark.createDataFrame([(3, "old", 1), (3, "new", 2)], "k int, v string, at int"), "k", "at")
    assert {r.k: r.v for r in table.read().collect()} == {1: "a", 2: "c", 3: "new"}
    table.switch(crashed)
    assert [tuple(r) for r in table.read().collect()] == [(9, "never")]
    cached = Versioned(spark, f"file://{tmp_path}/cache")
    cached.merge(_cache(spark, 5), "cache_key", "fetched_at")
    assert cached.read(CACHE_SCHEMA).count() == 1


def _raw(spark, **texts):
    line = "Company: {0}\nTitle: {1}\nLocation: Tokyo\nSalary: {2}\nWork style: Hybrid\n{3}\n"
    files = spark.createDataFrame([(i, f"{n}.txt", line.format(*t)) for i, (n, t) in enumerate(sorted(texts.items()))], "ordinal long, source_file string, raw_text string")
    return raw_postings(files)


A = ("Aomori Pay", "Backend Engineer", "JPY 9,000,000 - 12,000,000", "English-first team with product ownership.")
B = ("Kita Retail", "Frontend Engineer", "JPY 8,000,000 - 10,000,000", "Product role.")
B2 = ("Kita Retail", "Frontend Engineer", "JPY 8,500,000 - 10,500,000", "Product role with code review.")
C = ("Minato Learn", "Platform Engineer", "JPY 10,000,000 - 13,000,000", "English-first environment.")


def test_incremental_run_judges_only_what_changed(spark, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/runs", PERSONAS[0])
    assert runs.table("state") is None
    first = runs.run(_raw(spark, a=A, b=B), "one")
    assert (first["evaluated"], first["new"], first["unchanged"]) == (2, 2, 0)
    second = runs.run(_raw(spark, a=A, b=B2, c=C), "two")
    assert (second["evaluated"], second["new"], second["updated"], second["unchanged"], second["removed"]) == (2, 1, 1, 1, 0)
    assert sorted(r.title for r in runs.table("items").collect()) == ["Frontend Engineer", "Platform Engineer"]
    assert sorted(r.title for r in runs.table("standing").collect()) == ["Backend Engineer", "Frontend Engineer", "Platform Engineer"]
    again = runs.run(_raw(spark, c=C), "two")
    assert again == second and runs.table("history").count() == 2
    third = runs.run(_raw(spark, a=A), "three", incremental=False)
    assert (third["evaluated"], third["unchanged"], third["removed"]) == (1, 1, 2) and runs.table("standing").count() == 1
    with pytest.raises(ValueError):
        runs.run(_raw(spark, a=A), "../x")


def test_a_run_that_died_is_made_again(spark, tmp_path, monkeypatch):
    runs = Runs(spark, f"file://{tmp_path}/runs", PERSONAS[0])
    first = runs.run(_raw(spark, a=A, b=B), "one")
    for broken in ("standing", "alerts"):
        write = Runs._written

        def dies(self, rows, run, table, broken=broken, write=write):
            if table == broken:
                raise RuntimeError("lost")
            return write(self, rows, run, table)

        monkeypatch.setattr(Runs, "_written", dies)
        with pytest.raises(RuntimeError):
            runs.run(_raw(spark, a=A, b=B2, c=C), "two")
        monkeypatch.undo()
        assert runs.versions.version() == "one" and [r.asDict() for r in runs.table("history").collect()] == [first] and runs.table("standing").count() == 2
    assert runs.run(_raw(spark, a=A, b=B2, c=C), "two")["evaluated"] == 2 and sorted(r.number for r in runs.table("history").collect()) == [1, 2]


def test_alerts_of_a_run(spark, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/runs", PERSONAS[0])
    runs.run(_raw(spark, **{f"n{i}": (f"Firm {i}", "Backend Engineer", "JPY 9M", "English-first.") for i in range(3)}), "one", incremental=False)
    assert runs.table("alerts").count() == 0
    runs.run(_raw(spark, **{f"n{i}": (f"Firm {i}", "Backend Engineer", "TBD", "Consulting company with dispatch to client sites. Onsite only.") for i in range(12)}), "two", incremental=False)
    assert ("CRITICAL", "NO_GO_JUMP") in {(r.severity, r.code) for r in runs.table("alerts").collect()}


ROBOTS = {
    "a": "User-agent: *\nDisallow: /private\nAllow: /private/jobs # open\n\nUser-agent: Finder/2.1\nUser-agent: Scout\nDisallow: /\nAllow: /jobs",
    "b": "user-agent: finder\nDisallow:\n\nUser-agent: *\nDisallow: /",
    "c": "Disallow: /lost\nnonsense\n: x\nUser-agent:\nUser-agent: *\n#\nDisallow: jobs/x\n# gone\nUser-agent: *\nDisallow: jobs/y\r\nAllow: jobs/y",
    "d": "",
}


def test_robots_rules_as_joins_are_those_of_one_host(spark):
    paths = ["", "/", "/jobs/1", "/private/x", "/private/jobs/2", "/lost", "/jobs/x1", "/jobs/y", "/a" * 300]
    agents = ["Finder/1.0 (x)", "scout", "other", "", None]
    visits = spark.createDataFrame([(h, a, p) for h in (*ROBOTS, "e") for a in agents for p in paths] * 2, "host string, agent string, path string")
    rules = robots.robots_rules(spark.createDataFrame(list(ROBOTS.items()), "host string, body string"))
    got = robots.allowed(visits, rules).collect()
    assert len(got) == visits.count()
    for r in got:
        known = robots_rules(ROBOTS.get(r.host, ""))
        assert r.allowed == robots_allow(known, f"https://{r.host}.example{r.path}", r.agent or ""), r
    assert agent_key("Finder/2 (x)") == "finder" and agent_key("  ") == "*"
