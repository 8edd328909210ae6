"""Postings out of page trees: links, containers, snippets, content roots, metadata; and hostile markup."""

import time

import pytest

from sievewell.functions.markup import attributes, parse
from sievewell.operators import page_postings as P
from sievewell.operators.evaluation import evaluate
from sievewell.operators.settings import PERSONAS, Company
from sievewell.plans.page_queries import page_context
from sievewell.sources.page_tree import distinct_lines, facts, page_facts

BASE = "https://example.com/careers"


def _facts(spark, *pages, url=BASE):
    rows = [(i, p[0] if isinstance(p, tuple) else url, p[1] if isinstance(p, tuple) else p) for i, p in enumerate(pages)]
    return page_facts(spark.createDataFrame(rows, "page_id long, url string, html string"))


def _jobs(spark, page, url=BASE, most=10):
    return [(r.title, r.url, r.snippet) for r in P.candidates(_facts(spark, page, url=url), most=most).orderBy("rank").collect()]


def test_links_name_postings_and_noise_does_not(spark):
    page = """<body><div><a href="https://example.com/jobs/payments-backend">Backend Engineer</a><p>Senior role in payments, Kotlin and queues.</p></div>
        <div><a href="https://example.com/jobs/apps">Mobile Engineer</a><p>Builds our apps for both kinds of phone.</p></div><a href="https://example.com/privacy">Privacy Policy</a>
        <nav><a href="/jobs/x">Platform Engineer</a></nav><a href="/jobs/y">Jan 12, 2024 Platform Engineer</a><a href="javascript:go()">Security Engineer</a></body>"""
    assert [(t, u) for t, u, _ in _jobs(spark, page)] == [("Backend Engineer", "https://example.com/jobs/payments-backend"), ("Mobile Engineer", "https://example.com/jobs/apps")]


def test_repeats_count_once_and_the_rest_beyond_the_limit_goes(spark):
    links = "".join(f'<a href="/jobs/{k}-engineer">{t}</a>' for k, t in (("backend", "Backend Engineer"), ("backend", "BACKEND engineer"), ("frontend", "Frontend Engineer"), ("platform", "Platform Engineer")))
    assert [t for t, _, _ in _jobs(spark, links, most=2)] == ["Backend Engineer", "Frontend Engineer"] and len(_jobs(spark, links)) == 3


def test_snippets_climb_to_the_best_scored_ancestor(spark):
    page = '<body><article><a href="/jobs/platform">Platform Engineer</a><p>English-first team with hybrid work and code review.</p></article></body>'
    assert _jobs(spark, page)[0][2] == "Platform Engineer English-first team with hybrid work and code review."
    card = '<section><div class="card"><h4><a href="/companies/umi/jobs/software">Software Engineer</a></h4><p>Umi</p><p>No Japanese required Apply from abroad No remote Backend</p></div></section>'
    (title, url, snippet), = _jobs(spark, card, url="https://board.example/companies/umi")
    assert title == "Software Engineer" and url == "https://board.example/companies/umi/jobs/software" and "No remote" in snippet and "Apply from abroad" in snippet
    # Beyond 520 characters an ancestor tells too much; without any fitting one the title stands for it.
    assert _jobs(spark, f'<div><a href="/jobs/1">Platform Engineer</a> {"word " * 120}</div>')[0][2] == "Platform Engineer"


def test_containers_follow_links(spark):
    page = "<ul><li><b>Data Scientist</b> Requirements: statistics, and patience.</li><li>Our kitchen is open</li></ul><div><a href='/jobs/1'>QA Engineer</a> tests all of it, every day of the week</div>"
    got = _jobs(spark, page)
    assert [(t, u) for t, u, _ in got] == [("QA Engineer", "https://example.com/jobs/1"), ("Data Scientist", BASE)]


def test_boards_links_and_summaries(spark):
    page = """<head><title> Umi  Works </title><meta name="Description" content="We ship&amp;sail."></head><body><a href="/open">Open positions</a><a href="/open">Open positions again</a><a href="/careers">here</a>
        <a href="/culture">Our culture</a><a href="/team-jobs">Team jobs</a><a href="mailto:a@b.example">careers</a><h2>Engineering culture</h2><p>Diversity matters here.</p><p>diversity matters here.</p><li>tea</li><p>Benefits: lunch</p></body>"""
    known = _facts(spark, page)
    assert [r.url for r in P.job_boards(known).orderBy("rank").collect()] == ["https://example.com/open", "https://example.com/team-jobs"]
    assert [r.title for r in P.context_links(known).collect()] == ["Our culture"]
    told = P.context_summary(known).first()
    assert (told.page_title, told.page_description, told.contexts) == ("Umi Works", "We ship&sail.", ["Engineering culture", "Diversity matters here.", "Benefits: lunch"])


def test_context_query_counts_all_links_and_tells_all_items(spark, tmp_path):
    boards = [f'<a href="/list/{i}">Open positions {i}</a><a href="/list/{i}">Careers again</a>' for i in range(9)]
    links = [f'<a href="/who/{i}">Our culture</a><a href="/WHO/{i}">our CULTURE</a>' for i in range(11)]
    items = [f"<li>Team {i:02d}</li><li>TEAM {i:02d}</li>" for i in reversed(range(12))]
    pages = [(0, BASE, "".join(boards + links + items)), (1, BASE, boards[0] + links[0] + items[0]), (2, BASE, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.n_boards, r.n_links, r.contexts.split("\n")) for r in page_context(spark, str(tmp_path)).collect()}
    assert got == {0: (9, 11, [f"Team {i:02d}" for i in reversed(range(12))]), 1: (1, 1, ["Team 11"]), 2: (0, 0, [""])}


DETAIL = """<html><head><title>Software Engineer - Umi | Board</title></head><body>
<header><section id="job-header"><h1>Software Engineer</h1>
<p>Umi</p>
<ul><li>¥4.5M ~ ¥8M annually</li>
<li>No remote</li>
<li>Japan residents only</li>
<li>No Japanese required</li></ul></section></header>
<main>
<nav><a href="/jobs">Jobs</a></nav>
<h1>Software Engineer</h1>
<section><h2>About Umi</h2>
<p>We sell the sea to shops.</p></section>
<section>
<h2>About the position</h2>
<p>Requirements</p>
<p>Two years of experience with databases</p></section>
<section>
<h2>Hiring Process</h2>
<p>In-person or remote interview with the team</p></section>
<section>
<h2>Meet Umi's Developers</h2>
<p>A story that must not be evaluated.</p></section>
<section>
<h2>Related jobs</h2>
<a href="https://board.example/companies/kita/jobs/1">Software Engineer - Robots</a>
<p>Partially remote</p></section></main></body></html>"""
WORKPLACE = """<html><head><title>Application Engineer | Kita Group</title></head><body><main>
<h1>Application Engineer</h1>
<h2>Qualifications</h2>
<p>Individuals who can proactively engage in a work environment requiring daily English usage.</p>
<p>Current fluency is not a requirement. We provide an environment for learning through actual work and support to become comfortable with English.</p>
<h2>Work Conditions</h2>
<p>Location: Harbour office, Tokyo</p>
<p>・Annual Salary Range: JPY 6,560,000 - JPY 21,240,000</p></main></body></html>"""
SHELL = """<html><head><title>Backend Engineer, Ruby - Minato</title><meta property="og:title" content="Backend Engineer, Ruby - Minato"><meta name="description" content="About Minato. Other backend frameworks are also welcome. Tokyo, Japan."></head><body><div id="app"></div></body></html>"""
CLIENT = """<html><head><title>Senior Software Engineer - Based in Japan</title><meta name="description" content="About Our Client. Build services for a platform team in Tokyo, Japan."></head><body><div id="app"></div></body></html>"""


@pytest.fixture(scope="module")
def read(spark):
    pages = [("https://board.example/companies/umi/jobs/1", DETAIL), ("https://www.kita.example/careers/en/job/?id=1588", WORKPLACE), ("https://apply.example/minato-hiring/j/6E/", SHELL), ("https://www.blue-heron.co.jp/en/job-detail/jn-04", CLIENT), (BASE, None), (None, "<body>Just a moment</body>"), (BASE, "<title>Only a title</title>")]
    got = P.page_postings(_facts(spark, *pages), companies=[Company("Kita Group", career_url="https://kita.example/")])
    return {r["page_id"]: r.asDict() for r in got.collect()}


def test_detail_page_is_cut_to_its_posting(read):
    row = read[0]
    assert (row["company_name"], row["title"], row["remote_policy"], row["error"]) == ("Umi", "Software Engineer", "Onsite-only", None)
    assert row["description"].startswith("Software Engineer\nUmi\n") and row["description"].endswith("\nSource URL: https://board.example/companies/umi/jobs/1")
    assert "must not be evaluated" not in row["description"] and "Robots" not in row["description"] and "Hiring Process" in row["description"]


def test_labels_inside_pages_are_parsed_and_judged(spark, read):
    row = read[1]
    assert (row["company_name"], row["salary_range"], row["location"]) == ("Kita Group", "JPY 6,560,000 - JPY 21,240,000", "Harbour office, Tokyo") and "Title not found" not in " ".join(row["warnings"])
    fields = {k: row[k] for k in ("company_name", "title", "location", "salary_range", "remote_policy", "description")}
    judged = evaluate(spark.createDataFrame([fields]), PERSONAS[0]).first()
    assert "english_support_environment" in judged.positive_signals and "language_friction" not in judged.risk_signals and judged.verdict != "NO_GO" and judged.language_friction_index <= 20


def test_shells_are_told_by_their_metadata(read):
    assert (read[2]["company_name"], read[2]["title"]) == ("Minato", "Backend Engineer, Ruby - Minato") and "also welcome" in read[2]["description"] and read[2]["warnings"][0] == P.METADATA_ONLY
    assert read[3]["company_name"] == "Blue Heron" and read[3]["warnings"][0] == P.METADATA_ONLY


def test_pages_without_title_or_text(read):
    assert read[4]["error"] == P.NO_TITLE and read[4]["description"] is None and read[5]["error"] == P.NO_TITLE and read[6]["error"] == P.NO_TEXT


def test_overrides(spark):
    row = P.page_postings(_facts(spark, DETAIL), company="'Tama'", title="'Lead'").first()
    assert (row.company_name, row.title) == ("Tama", "Lead")


@pytest.mark.parametrize("page", ["<a " * 100_000, "<b>" * 100_000 + "</i>" * 100_000, '<a href="x>' * 50_000, "<p><button>" + "<b>" * 40_000 + "<h1></h1>" * 40_000, "<" * 200_000, "<!--" * 50_000, "<script>" * 50_000, "<a " + "x=" * 100_000 + ">", "<div>" * 20_000], ids=["unclosed", "unmatched", "quotes", "barrier", "signs", "comments", "scripts", "attributes", "deep"])
def test_hostile_markup_takes_time_in_proportion(page):
    began = time.time()
    parse(page)
    facts(page, BASE)
    assert time.time() - began < 12


def test_trees_and_lines():
    page = "<p>one<p>two<ul><li>a<li>b</ul><br/>x &lt; y<![CDATA[no]]><!-- no --><img src=a>z</i></p>"
    root = parse(page)
    assert [c.tag for c in root.children if not isinstance(c, tuple)] == ["p", "p", "ul", "br", "img"]
    assert attributes(""" HREF='/a b' class="x" hidden data-n=3 class=y""") == {"href": "/a b", "class": "x", "hidden": "", "data-n": "3"}
    assert distinct_lines(" a \r\n\n\tb  c\x0b a  b c ") == "a\nb c"
    assert facts("<base href='/x/'><a href='y'>t</a><a href='http://[bad'>u</a>", "https://h.example/p")["anchors"][0]["url"] == "https://h.example/x/y"
