"""Queries over raw texts, candidates and readings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import DUCKDB as D, SPARK, Marked, Spark
from ..operators import candidate, company_names, raw_text, reading
from ..operators.evaluation import evaluate, evaluate_sql, staged, staged_sql
from ..sources.postings import postings, postings_sql
from .registry import PERSONA, query

#: Requirement sections that postings are given, by their ordinal.
_SECTIONS = (
    "\nRequirements:\n3+ years of experience with Java.\nKnowledge of PostgreSQL\nNice to have\nKotlin",
    "\nResponsibilities\nBuild retail checkout.\nMust have\n- Hands-on experience with Go or Rust-free services\n- microservices",
    "\nWe need 12 years of experience.\nProficiency in Flutter\nmobile apps for players",
    "\nPreferred: Kubernetes\nSalary and paid leave are described.",
    "\nRequired skills: AWS, Spring Boot\n8+ years experience\nStreaming and omnichannel inventory",
)


def _extended(d: Spark) -> str:
    cases = " ".join(f"when {i} then {d.text(s)}" for i, s in enumerate(_SECTIONS))
    return f"description || case ordinal % 7 {cases} else '' end"


def _postings(spark, sf_dir):
    return postings(spark, sf_dir).withColumn("description", F.expr(_extended(SPARK)))


_POSTINGS = f"(select * replace ({_extended(D)} as description) from {postings_sql(D)})"
_CANDIDATE = candidate.CANDIDATE
_FIT = "candidate_stack_fit candidate_domain_fit candidate_seniority_fit candidate_stack_gap candidate_domain_gap candidate_seniority_mismatch".split()
_JUDGED = evaluate_sql(_POSTINGS, PERSONA, D, candidate=candidate.stages(D, _CANDIDATE))


def _judged(spark, sf_dir, d, keep=()):
    return evaluate(_postings(spark, sf_dir), PERSONA, candidate=candidate.stages(d, _CANDIDATE), keep=keep, d=d)


@query(f"select ordinal, {', '.join(f'list_contains(positive_signals, {D.text(s)}) or list_contains(risk_signals, {D.text(s)}) as {s}' for s in _FIT)}, raw_score, score, verdict from {_JUDGED}")
def candidate_fit(spark, sf_dir):
    """The six signals of a posting beside a candidate, and the score with them."""
    has = lambda s: (F.array_contains("positive_signals", s) | F.array_contains("risk_signals", s)).alias(s)
    return _judged(spark, sf_dir, Marked()).select("ordinal", *map(has, _FIT), "raw_score", "score", "verdict")


_READ = [c for c in reading.COLUMNS if c not in ("why_still_interesting", "why_waste_of_time", "reasoning")]
_READ_LISTS = ("why_still_interesting", "why_waste_of_time", "reasoning")


@query(f"select ordinal, {', '.join(_READ)}, {', '.join(f'array_to_string({c}, chr(10)) as {c}' for c in _READ_LISTS)} from {staged_sql(_JUDGED, reading.stages(D, PERSONA, _CANDIDATE))}")
def human_reading(spark, sf_dir):
    """Levels, summary and reasons of every posting."""
    d = Marked()
    said = reading.stages(d, PERSONA, _CANDIDATE)  # before the texts are marked by all words asked for
    out = staged(_judged(spark, sf_dir, d, (d.marks_of("txt"), "c_text", "c_years")), said, reading.COLUMNS)
    return out.select("ordinal", *_READ, *[F.array_join(c, "\n").alias(c) for c in _READ_LISTS])


def _raw(d: Spark) -> str:
    """A raw text of each posting: labels in some, headings, prose or nothing in others."""
    line = lambda value: f"{value} || {d.text(chr(10))}"
    said = {
        0: [line("'Company: ' || company_name"), line("'- Title: ' || title"), line("'Location: ' || location"), line("'Salary: ' || salary_range"), line("'Work style: ' || remote_policy")],
        1: [line("'# ' || company_name"), line("'* ' || title"), line("'JPY 8M - 12M per year, partially remote'"), line("'Interview: remote video call'")],
        2: [line("'About ' || company_name"), line("'We are looking for an experienced platform   ENGINEER to join us in Osaka.'"), line("'no remote'")],
        3: [line("'会社名： ' || company_name"), line("'職種: ' || title"), line("'勤務地：東京'"), line("'想定年収: 800万'"), line("'働き方: リモート'")],
        4: [line("'Minato Works'"), line("'Senior Backend Engineer'"), line("'¥9,000,000'"), line("'Work mode: office'")],
        5: [line("'  '")],
        6: [line("'• job title:  ' || title"), line("'employer: '"), line("'Based in: Kyoto'"), line("'remote and office, in office twice a week'")],
    }
    return f"case ordinal % 7 {' '.join(f'when {i} then ' + ' || '.join(x) for i, x in said.items())} end"


_PARSED = [c for c in raw_text.PARSED if c != "warnings"]


@query(f"select ordinal, {', '.join(_PARSED)}, {D.joined('warnings')} as warnings from {staged_sql(f'(select ordinal, {_raw(D)} as raw_text from {postings_sql(D)})', raw_text.stages(D))}")
def raw_parse(spark, sf_dir):
    """Raw texts to postings, with warnings."""
    texts = postings(spark, sf_dir).select("ordinal", F.expr(_raw(SPARK)).alias("raw_text"))
    return staged(texts, raw_text.stages(SPARK), raw_text.PARSED).select("ordinal", *_PARSED, F.array_join("warnings", ",").alias("warnings"))


def _named(d: Spark) -> dict[str, str]:
    return {
        "page_id": "page_id",
        "company_name": "case page_id % 6 when 0 then 'Unknown Company' when 1 then 'One of our clients' when 2 then ' Acme   KK ' when 3 then null when 4 then 'careers.example.com' else 'Based in Tokyo' end",
        "title": "case page_id % 5 when 0 then 'Backend Engineer - Kita Works Careers' when 1 then 'Jobs | Aomori Pay' when 2 then 'Engineer - our client' when 3 then '' else 'SRE |  Umi   Labs jobs -' end",
        "description": f"case page_id % 4 when 0 then 'Source URL: https://x.example/1' || {d.text(chr(10))} || 'About Sora Tech. We build.' when 1 then 'About' when 2 then 'About Nami: games' else 'We build.' end",
        "heading": "case page_id % 3 when 0 then 'Hoshi Inc' else 'client' end",
        "url": "case page_id % 11 when 0 then 'https://www.japan-dev.com/jobs/1' when 1 then 'https://jobs.blue-moon.co.jp/x' when 2 then null when 3 then 'https://localhost/x' else url end",
    }


_select = lambda columns: [f"{e} as {n}" for n, e in columns.items()]


@query(f"select page_id, resolved from {staged_sql(f'(select {chr(44).join(_select(_named(D)))} from pages)', company_names.stages(D))}")
def company_name_resolution(spark, sf_dir):
    """The best name of a posting's company, by precedence of its sources."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(*_select(_named(SPARK)))
    return staged(pages, company_names.stages(SPARK), ["resolved"]).select("page_id", "resolved")
