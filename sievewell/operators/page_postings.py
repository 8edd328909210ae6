"""Postings in web pages: candidates among links and containers, and a page as one posting.

The facts of a page's tree come from sources.page_tree; all rules here are expressions,
aggregates and windows over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import web
from ..functions.dialect import SPARK, Spark
from ..functions.urls import url_expressions
from . import company_names, raw_text
from .evaluation import staged
from .settings import COMPANIES

# Words around postings, hints that a snippet tells of one, titles that begin like news.
CONTEXT_WORDS = ("responsibilities", "requirements", "qualifications", "what you'll do", "role overview", "hiring", "apply")
SNIPPET_HINTS = ("remote", "hybrid", "onsite", "japanese", "english", "apply from abroad", "residents only", "fully remote", "partially remote", "backend", "frontend", "fullstack", "tokyo", "¥", "jpy")
NEWS_DATE = r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)\s+\d{1,2},\s+\d{4}"
# What links to listings and to pages about a company are called.
BOARD_WORDS = ("jobs", "careers", "open positions", "positions", "vacancies", "recruit", "hiring", "mid-career", "job description", "engineers and architects", "採用", "求人", "募集")
ABOUT_WORDS = ("workplace", "benefits", "culture", "values", "mission", "vision", "engineering culture", "working style", "work style", "people", "team", "environment", "diversity", "inclusion", "well-being", "福利厚生", "働き方", "文化", "カルチャー", "採用情報")
ABOUT_URL_HINTS = ("/workplace", "/benefits", "/culture", "/values", "/mission", "/vision", "/people", "/team", "/environment", "/diversity", "/inclusion", "/well-being", "/wellbeing", "/about", "/who-we-are", "/philosophy")
SUMMARY_WORDS = ("culture", "workplace", "benefits", "values", "mission", "vision", "engineering", "team", "diversity", "inclusion", "働き方", "福利厚生", "カルチャー")
# What content roots tell, what pages say that only check the visitor, headings that end a posting.
ROOT_HINTS = ("remote", "hybrid", "onsite", "japan residents only", "apply from abroad", "no japanese required", "experience required", "requirements", "responsibilities", "salary", "¥")
CHALLENGES = ("just a moment", "enable javascript and cookies to continue", "__cf_chl_opt")
STOP_HEADING = r"(?i)^(?:related jobs|more jobs like this|other openings|similar jobs|you may also like|meet .+ developers|get the newsletter)$"
ABOUT_NO_COMPANY = ("the job", "the position", "the role", "the company", "the team", "us")
# Lengths.
TITLE_CHARS, SNIPPET_CHARS, SUMMARY_CHARS, DESCRIPTION_CHARS = (6, 140), 420, 220, 16000
METADATA_ONLY = "Page body was unavailable; evaluated the URL using title and metadata only."
NO_TITLE, NO_TEXT = "Could not infer a job title from URL page content.", "Could not extract meaningful job content from URL page."


def is_title(d: Spark, x: str, low: str | None = None) -> str:
    low = low or f"lower({x})"
    return f"(length({x}) between {TITLE_CHARS[0]} and {TITLE_CHARS[1]} and not {d.matches(x, NEWS_DATE)} and not {d.any_of(low, web.NON_JOB_WORDS)} and {d.any_of(low, web.JOB_WORDS)})"


def is_noise_url(d: Spark, low: str) -> str:
    return f"({low} = '' or {d.matches(low, '^(?:mailto|tel|javascript):')} or {d.inside(low, web.NON_JOB_URL_HINTS)})"


def candidate_stages(d: Spark) -> list[dict[str, str]]:
    """``likely``: whether ``title``, the address it leads to (``url``, its own if ``direct``) and the ``snippet`` around it are a posting."""
    told = f"((direct and {d.inside('k_url', web.JOB_URL_HINTS)}) or {d.any_of('k_said', CONTEXT_WORDS)} or not direct)"
    return [
        {"k_title": "lower(title)", "k_url": "lower(url)", "k_said": "lower(title || ' ' || snippet)"},
        {"likely": f"({is_title(d, 'title', 'k_title')} and not {is_noise_url(d, 'k_url')} and not {d.any_of('k_said', web.NON_JOB_WORDS)} and {told})"},
    ]


def snippet_score(d: Spark, text: str, title: str) -> str:
    return f"least(length({text}), 220) + case when {title} <> '' and contains(lower({text}), lower({title})) then 40 else 0 end + 20 * {d.inside_hits(f'lower({text})', SNIPPET_HINTS)}"


def best_snippet(title: str, above: str) -> str:
    """Of a link's ancestors' texts the best scored one, the nearest of equals; the title if there is none."""
    scored = f"transform({above}, (x, i) -> struct({snippet_score(SPARK, 'x', title)} as score, -i as nearness, x as text))"
    short = f"transform(slice(array(array_max({scored}).text), 1, 1), x -> {web.shorten('x', SNIPPET_CHARS)})[0]"
    return f"coalesce({short}, {title})"


def _ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows that repeat a title and address of their page go but for the first; the others are numbered."""
    same = F.lower(F.concat_ws("||", "title", "url"))
    first = rows.withColumn("same", same).withColumn("turn", F.row_number().over(W.partitionBy(key, "same").orderBy(*order))).where("turn = 1")
    return first.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).drop("same", "turn")


def candidates(facts: DataFrame, key: str = "page_id", most: int = 24) -> DataFrame:
    """(key, rank, title, url, snippet): postings named by links, then those of containers, each once, at most ``most`` a page.

    Links explode before they are judged, so a page of any length is split over its
    rows; groups hold one page's candidates.
    """
    # Both kinds in one explode, so that a page's tree is made once.
    link = "named_struct('source', 0, 'pos', a.pos, 'text', a.text, 'url', a.url, 'above', a.above, 'best', cast(null as string))"
    box = "named_struct('source', 1, 'pos', c.pos, 'text', c.text, 'url', c.url, 'above', cast(null as array<string>), 'best', coalesce(nullif(c.heading, ''), nullif(c.link, ''), c.own))"
    items = facts.selectExpr(key, "base", f"explode(concat(transform(anchors, a -> {link}), transform(containers, c -> {box}))) as x").select(key, "base", "x.*")
    named = [
        {"direct": "source = 0 or url <> ''", "k_best": "lower(best)"},
        {
            "title": f"case when source = 0 then text when {is_title(SPARK, 'best', 'k_best')} then best else {web.shorten('text', TITLE_CHARS[1])} end",
            "snippet": f"case when source = 0 then {best_snippet('text', 'above')} else {web.shorten('text', SNIPPET_CHARS)} end",
        },
    ]
    both = staged(items, named, ("title", "snippet", "direct")).selectExpr(key, "source", "pos", "title", "case when source = 1 then coalesce(nullif(url, ''), base) else url end as url", "snippet", "direct")
    likely = staged(both, candidate_stages(SPARK), ("likely",)).where("likely")
    return _ranked(likely, key, ["source", "pos"]).where(F.col("rank") <= most).select(key, "rank", "title", "url", "snippet")


def job_boards(facts: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, rank, title, url): all links that lead to listings, by their text or address; an address counts once."""
    low = "lower(title)"
    rows = facts.select(key, "base", F.explode("anchors").alias("a")).selectExpr(key, "base", "a.pos as pos", "a.text as title", "a.url as url")
    board = f"title <> '' and url <> '' and lower(url) <> lower(base) and ({SPARK.any_of(low, BOARD_WORDS)} or {SPARK.inside('lower(url)', web.JOB_URL_HINTS)}) and not {is_noise_url(SPARK, 'lower(url)')}"
    once = rows.where(board).withColumn("turn", F.row_number().over(W.partitionBy(key, "url").orderBy("pos"))).where("turn = 1")
    return once.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("pos"))).select(key, "rank", "title", "url")


def context_links(facts: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, rank, title, url): all links to pages about the company that are no listings."""
    rows = facts.select(key, "base", F.explode("anchors").alias("a")).selectExpr(key, "base", "a.pos as pos", "a.text as title", "a.url as url")
    about = f"({SPARK.any_of('lower(title)', ABOUT_WORDS)} or {SPARK.any_of('lower(url)', ABOUT_URL_HINTS)})"
    board = f"({SPARK.any_of('lower(title)', BOARD_WORDS)} or {SPARK.inside('lower(url)', web.JOB_URL_HINTS)})"
    return _ranked(rows.where(f"url <> '' and lower(url) <> lower(base) and {about} and not {board}"), key, ["pos"]).select(key, "rank", "title", "url")


def context_summary(facts: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, page_title, page_description, contexts): what a page tells of its company, texts shortened; all told items, repeats once."""
    told = f"filter(items, x -> length(x) >= {TITLE_CHARS[0]} and {SPARK.any_of('lower(x)', SUMMARY_WORDS)})"
    # Repeats stand side by side in the order of texts, so a page of many items is not compared pair by pair.
    said = f"sort_array(transform(transform({told}, x -> {web.shorten('x', SUMMARY_CHARS)}), (x, i) -> struct(lower(x) as low, i as turn, x as text)))"
    first = "filter(said, (x, i) -> i = 0 or x.low <> get(said, i - 1).low)"
    texts = facts.selectExpr(key, f"{web.shorten('title', SUMMARY_CHARS)} as page_title", f"{web.shorten('summary_description', SUMMARY_CHARS)} as page_description", f"{said} as said")
    return texts.selectExpr(key, "page_title", "page_description", f"transform(sort_array(transform({first}, x -> struct(x.turn as turn, x.text as text))), x -> x.text) as contexts")


def _page_title(candidate: str) -> str:
    """By the places where titles stand, the first one's text; else the first candidate's or the document's."""
    of = lambda tag, place: f"try_element_at(filter(headings, h -> h.tag = '{tag}'{f' and h.{place}' if place else ''}), 1).text"
    places = [f"nullif({of(tag, place)}, '')" for tag in ("h1", "h2") for place in ("in_header", "in_job_header", "in_main", "in_article", "")]
    return f"coalesce({', '.join(places)}, nullif({candidate}, ''), title)"


def _root_stages() -> list[dict[str, str]]:
    """The best content root: chrome before the title line and sections after a stop heading cut off, scored; the first of equals."""
    lines = "filter(split(r, '\\n'), x -> x <> '')"
    begin = "greatest(coalesce(array_position(transform(ls, x -> lower(x)), lower(p_title)), 0), 1)"
    stop = f"array_position(transform(led, x -> {SPARK.matches('x', STOP_HEADING)}), true)"
    cut = f"case when {stop} > 0 then slice(led, 1, cast({stop} as int) - 1) else led end"
    low = "lower(x)"
    starts = "x = p_title or startswith(x, p_title || '\\n')"
    score = (
        f"case when x = '' then -2147483648 when {SPARK.inside(low, CHALLENGES)} then -1073741824 else least(length(x), 320)"
        f" + case when p_title = '' then 0 when {starts} then 220 when contains({low}, lower(p_title)) then 120 else 0 end + 30 * {SPARK.inside_hits(low, ROOT_HINTS)} end"
    )
    each = "transform({0}, {1} -> {2})".format
    return [
        {"p_lines": each("roots", "r", lines)},
        {"p_led": each("p_lines", "ls", f"case when p_title = '' or size(ls) = 0 then ls else slice(ls, cast({begin} as int), size(ls)) end")},
        {"p_texts": each("p_led", "led", f"array_join({cut}, '\\n')")},
        {"p_best": f"array_max(transform(p_texts, (x, i) -> struct({score} as score, -i as earliness, x as text)))"},
        {"p_text": "case when p_best.score > -2147483648 then p_best.text else '' end"},
    ]


def configured_company(d: Spark, host: str, companies=COMPANIES) -> str:
    """The first company whose career or corporate site is the host or a parent of it, else the host."""
    site = lambda u: u.split("//", 1)[-1].split("/", 1)[0].split("@")[-1].split(":")[0].lower()
    cases = []
    for c in companies:
        sites = [s for s in dict.fromkeys((site(c.career_url), site(c.corporate_url))) if s]
        if sites:
            cases.append(f"when {' or '.join(f'{host} = {d.text(s)} or {d.ends_with(host, "." + s)}' for s in sites)} then {d.text(c.name)}")
    return f"case when coalesce({host}, '') = '' then 'unknown' {' '.join(cases)} else {host} end"


def page_postings(facts: DataFrame, key: str = "page_id", companies=COMPANIES, company: str = "''", title: str = "''") -> DataFrame:
    """Each page as one posting: key, url, the fields of a posting, warnings, error.

    The title stands in a heading, the first candidate or the document's title; the text
    is the best content root's, else the candidate's snippet, else what the metadata say
    (with a warning). ``company`` and ``title`` are expressions that override what is
    found. Pages without title or text give a row with ``error`` and no fields.
    """
    first = candidates(facts, key, 1).select(key, F.col("title").alias("c_title"), F.col("snippet").alias("c_snippet"))
    # Pages that share a key share their first candidate.
    rows = facts.drop("anchors", "containers", "items").join(first, key, "left")
    host = url_expressions(SPARK, "base")["host"]
    about = f"try_element_at(filter(transform(filter(headings, h -> h.tag in ('h2', 'h3')), h -> trim({SPARK.extract('h.text', '(?i)^about\\s+(.+)$')})), x -> x <> '' and length(x) <= 80 and lower(x) not in ({', '.join(map(SPARK.text, ABOUT_NO_COMPANY))})), 1)"
    parts = "array_distinct(filter(array(p_title, og_title, description), x -> x <> ''))"
    added = [
        {"p_title": f"coalesce(nullif(trim({title}), ''), {_page_title('c_title')})", "p_current": f"coalesce(nullif(trim({company}), ''), {configured_company(SPARK, host, companies)})", "p_about": f"coalesce({about}, '')"},
        *_root_stages(),
        {"p_meta": f"case when size({parts}) >= 2 then array_join({parts}, '\\n') else '' end", "p_snippet": "coalesce(c_snippet, '')"},
        {"p_raw": "coalesce(nullif(p_text, ''), nullif(p_snippet, ''), p_meta)", "p_from_meta": "p_text = '' and p_snippet = '' and p_meta <> ''"},
        *company_names.stages(SPARK, "p_current", "p_title", "description", "p_about", "base"),
        {"error": f"case when p_title = '' then {SPARK.text(NO_TITLE)} when p_raw = '' then {SPARK.text(NO_TEXT)} end"},
    ]
    found = staged(rows, added, ("p_raw", "p_title", "resolved", "p_from_meta", "error"))
    parsed = staged(found.select(key, "base", "p_raw", "p_title", "resolved", "p_from_meta", "error"), raw_text.stages(SPARK, "p_raw", "resolved", "p_title"), raw_text.PARSED)
    field = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    long = F.concat(F.trim(F.substring("description", 1, DESCRIPTION_CHARS)), F.lit("..."))
    described = parsed.withColumn("description", F.concat(F.when(F.length("description") > DESCRIPTION_CHARS, long).otherwise(F.col("description")), F.lit("\nSource URL: "), F.col("base")))
    warned = described.withColumn("warnings", F.concat(F.when(F.col("p_from_meta"), F.array(F.lit(METADATA_ONLY))).otherwise(F.array().cast("array<string>")), "warnings"))
    return warned.select(key, F.col("base").alias("url"), *map(field, raw_text.PARSED), "error")
