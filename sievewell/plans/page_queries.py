"""Queries over the trees of pages: what they offer, and each as one posting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import DUCKDB as D, SPARK, Spark
from ..operators import page_postings as P
from ..operators.evaluation import staged_sql
from ..sources.page_tree import page_facts
from .registry import query

#: Orders of a career page, at most: pages are made of ranges of order keys.
_PAGE_ORDERS = 64
_BASE = "https://careers.example/p/"
_ABOUT = "Founded in the north, we build payment rails for shops and keep them running. " * 8
#: What a card calls its posting, by order; the last two are none.
_TITLES = ("Senior Backend Engineer", "Platform Architect", "QA Specialist (Payments)", "Mobile iOS Developer", "Events Manager", "Chef de Cuisine")


def _title(d: Spark) -> str:
    return f"(case o_orderkey % {len(_TITLES)} {' '.join(f'when {i} then {d.text(t)}' for i, t in enumerate(_TITLES))} end || ' ' || cast(o_orderkey % 3 as varchar(9)))"


_KEY = "cast(o_orderkey as varchar(20))"
#: Cards by order: (html before the title, html after it, address or None, text after the title).
_CARDS = (
    ("<article><h3><a href='/jobs/%'>", "</a></h3>\n<p>Hybrid work in Tokyo &amp; Osaka,\n apply from abroad, order %.</p></article>", "https://careers.example/jobs/%", " Hybrid work in Tokyo & Osaka, apply from abroad, order %."),
    ("<ul><li><A HREF=https://boards.example/apply/x class=c>", "</a> &ndash; fully remote <i>across</i> Japan, no Japanese required</ul>", "https://boards.example/apply/x", " – fully remote across Japan, no Japanese required"),
    ("<div><b>", "</b> wanted. Requirements: five years, a calm head %.</div>", None, " wanted. Requirements: five years, a calm head %."),
    ("<div><script>var t='<a href=/jobs/9>Lead Engineer</a>';</script><a href='../team/%'>", "</a><p>Responsibilities: the ledger, and the people who read it.</div>", "https://careers.example/team/%", " Responsibilities: the ledger, and the people who read it."),
    ("<p><a href='/news/%'>", "</a>", "https://careers.example/news/%", ""),
    ("<nav><a href='/jobs/%'>", "</a></nav>", "", ""),
    ("<section><a href='mailto:jobs@careers.example'>", "</a> apply by mail</section>", "mailto:jobs@careers.example", " apply by mail"),
)


def _cards(d: Spark, part) -> str:
    """A text of the card by order, with the key in place of %."""
    text = lambda t: " || ".join(x for i, p in enumerate(t.split("%")) for x in ([_KEY] if i else []) + [d.text(p)])
    cases = " ".join(f"when {i} then {'null' if part(c) is None else text(part(c))}" for i, c in enumerate(_CARDS))
    return f"case (o_orderkey * 5 + o_custkey) % {len(_CARDS)} {cases} end"


def _expected() -> str:
    """What the pages offer, from the rows that they are made of: no page is read."""
    offered = f"""select o_orderkey, o_orderkey // {_PAGE_ORDERS} as page_id, {_title(D)} as title, {_cards(D, lambda c: c[2])} as link, {_title(D)} || {_cards(D, lambda c: c[3])} as said, (o_orderkey * 5 + o_custkey) % {len(_CARDS)} as card from orders"""
    rows = f"select *, coalesce(link, '{_BASE}' || cast(page_id as varchar(20))) as url, link is not null as direct from ({offered}) where card <> 5"
    judged = f"select *, case when length(said) between 40 and 520 then said else title end as snippet from ({rows})"
    # A card without a title of its kind is called by its whole text, a linked one a second time, after the links.
    boxed = f"""select page_id, o_orderkey, 0 as source, title, url, snippet, direct from ({judged}) where direct
        union all select page_id, o_orderkey, 1, case when {P.is_title(D, 'title')} then title else {P.web.shorten('said', P.TITLE_CHARS[1])} end, url, {P.web.shorten('said', P.SNIPPET_CHARS)}, direct from ({judged}) where card <> 4"""
    likely = f"select * from {staged_sql(f'({boxed})', P.candidate_stages(D))} where likely"
    once = f"select *, row_number() over (partition by page_id, lower(title || '||' || url) order by source, o_orderkey) as turn from ({likely})"
    return f"select page_id, rank, title, url, snippet from (select *, cast(row_number() over (partition by page_id order by source, o_orderkey) as int) as rank from ({once}) where turn = 1) where rank <= 24"


@query(_expected())
def career_page_jobs(spark, sf_dir):
    """Postings found in the trees of career pages, which are made of the orders; the SQL tells them from the orders themselves."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", f"cast(o_orderkey div {_PAGE_ORDERS} as bigint) as page_id", f"{_cards(SPARK, lambda c: c[0])} || {_title(SPARK)} || {_cards(SPARK, lambda c: c[1])} as card")
    # A page has the orders of a range of keys, so its cards are bounded.
    cards = orders.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "card"))), lambda c: c["card"]), "\n").alias("cards"))
    html = F.concat(F.lit(f"<!DOCTYPE html><html><head><title>Careers</title></head><body><p>{_ABOUT}</p>"), "cards", F.lit("<footer><a href='/jobs/0'>Staff Engineer</a></footer></body></html>"))
    pages = cards.select("page_id", F.concat(F.lit(_BASE), F.col("page_id").cast("string")).alias("url"), html.alias("html"))
    return P.candidates(page_facts(pages))


@query()
def page_as_posting(spark, sf_dir):
    """Every given page as one posting, read through its element tree."""
    out = P.page_postings(page_facts(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.withColumn("warnings", F.array_join("warnings", ","))


@query()
def page_context(spark, sf_dir):
    """What every given page tells of its company: title, description, items; links to listings and about the company."""
    facts = page_facts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    boards, links = P.job_boards(facts).groupBy("page_id").agg(F.count("*").alias("n_boards")), P.context_links(facts).groupBy("page_id").agg(F.count("*").alias("n_links"))
    said = P.context_summary(facts).withColumn("contexts", F.array_join("contexts", "\n"))
    return said.join(boards, "page_id", "left").join(links, "page_id", "left").fillna(0, ["n_boards", "n_links"])
