"""Queries over runs, caches and robots rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.dialect import DUCKDB as D, SPARK, Spark
from ..functions.urls import url_expressions
from ..operators import robots, snapshots
from ..operators.evaluation import evaluate_sql
from ..operators.runs import Runs
from ..session import scratch_dir
from ..sinks.versioned import Versioned
from ..sources.postings import postings, postings_sql
from .registry import PERSONA, query

_SHIFT = "case when o_orderkey % 7 = 0 then 250000 else 0 end"
_THEN = f"(select * from {snapshots.keyed_sql(D, f'(select * from {postings_sql(D)} where ordinal % 13 <> 0)')})"
_NOW = f"(select * from {snapshots.keyed_sql(D, f'(select * from {postings_sql(D, _SHIFT)} where ordinal % 11 <> 0)')})"


def _run_sql() -> str:
    """Both runs from their snapshots alone: the first judges all, the second what is new or has another fingerprint."""
    changed = f"(select n.*, case when t.job_key is null then 'NEW' when n.fingerprint = t.fingerprint then 'UNCHANGED' else 'UPDATED' end as status from {_NOW} n left join {_THEN} t on n.job_key = t.job_key)"
    removed = f"(select count(*) from {_THEN} t where not exists (select 1 from {_NOW} n where n.job_key = t.job_key))"
    count = lambda c, name: f"cast(count(case when {c} then 1 end) as bigint) as {name}"
    verdicts = ", ".join(count(f"verdict = '{v}'", v.lower()) for v in ("GO", "GO_WITH_CAUTION", "NO_GO"))
    first = evaluate_sql(f"(select *, 'NEW' as status from {_THEN})", PERSONA, D)
    second = evaluate_sql(f"(select * from {changed} where status <> 'UNCHANGED')", PERSONA, D)
    statuses = f"select {count("status = 'NEW'", 'new')}, {count("status = 'UPDATED'", 'updated')}, {count("status = 'UNCHANGED'", 'unchanged')} from {changed}"
    return f"""with s as ({statuses}) select 'first' as run, cast(count(*) as bigint) as evaluated, cast(count(*) as bigint) as new, cast(0 as bigint) as updated, cast(0 as bigint) as unchanged, cast(0 as bigint) as removed, {verdicts} from {first}
        union all select 'second', cast(count(*) as bigint), (select new from s), (select updated from s), (select unchanged from s), cast({removed} as bigint), {verdicts} from {second}"""


@query(_run_sql())
def incremental_runs(spark, sf_dir):
    """Two runs, the second over changed postings, made twice each; the history that they leave."""
    runs = Runs(spark, f"{scratch_dir(spark)}/runs-{uuid.uuid4().hex}", PERSONA)
    for name, rows in (("first", postings(spark, sf_dir).where("ordinal % 13 <> 0")), ("second", postings(spark, sf_dir, _SHIFT).where("ordinal % 11 <> 0")), ("first", postings(spark, sf_dir))):
        runs.run(rows, name)
    return runs.table("history").select("run", "evaluated", "new", "updated", "unchanged", "removed", "go", "go_with_caution", "no_go")


def _answers(d: Spark, shift: int, every: int) -> str:
    """Answers to the pages' addresses at some time, some twice."""
    key = d.sha256("url")
    return f"select {key} as cache_key, url, cast(200 + page_id % 3 as int) as status, {d.text(f'run {shift} ')} || cast(page_id as varchar(20)) as body, timestamp '2024-01-01 00:00:00' + (page_id + {shift}) * interval '1' minute as fetched_at from @pages where page_id % {every} <> 1"


_TABLES = lambda sql, sf: sql.replace("@pages", f"parquet.`{sf}/pages.parquet`")


def _upserted() -> str:
    rows = f"select *, 2 as run from ({_answers(D, 10000, 3)}) union all select *, 1 as run from ({_answers(D, 0, 5)})"
    best = f"select *, row_number() over (partition by cache_key order by run desc, fetched_at desc) as place from ({rows})"
    return f"select cache_key, url, status, body, fetched_at from ({best}) where place = 1".replace("@pages", "pages")


@query(_upserted())
def cache_upsert(spark, sf_dir):
    """A cache after two merges of answers by address: later ones replace earlier ones, the rest stay."""
    cache = Versioned(spark, f"{scratch_dir(spark)}/cache-{uuid.uuid4().hex}")
    for shift, every in ((0, 5), (10000, 3)):
        cache.merge(spark.sql(_TABLES(_answers(SPARK, shift, every), sf_dir)), "cache_key", "fetched_at")
    return cache.read()


_AGENTS = ("Finder/2.0 (+https://finder.example)", "scout", "other", " ")


def _visits(d: Spark) -> str:
    path = d.extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    agent = f"case page_id % {len(_AGENTS)} {' '.join(f'when {i} then {d.text(a)}' for i, a in enumerate(_AGENTS))} end"
    return f"select page_id, {url_expressions(d)['host']} as host, {path} as path, {agent} as agent from @pages"


#: What a host says of each beginning of its pages' paths, by the beginning's place: (agent line or None, rule, whose first sign is cut off).
_SAID = (("User-agent: *", "Disallow: ", 0), (None, "Allow: ", 0), ("User-agent: FINDER # ours", "disallow : ", 0), (None, "Allow: ", 1), ("User-agent: scout/1", "Disallow:", -1))


def _robots(d: Spark) -> str:
    """(host, body): rules over the distinct beginnings of a host's paths, a handful each; every third one ends its group."""
    starts = f"select distinct host, substr(path, 1, 5) as start from ({_visits(d)})"
    placed = f"select *, cast(row_number() over (partition by host order by start) as int) - 1 as i from ({starts})"
    nl = d.text("\n")
    text = " ".join(f"when {k} then {d.text(agent + chr(10) if agent else '')} || {d.text(rule)} || {'start' if cut == 0 else 'substr(start, 2)' if cut > 0 else d.text('')}" for k, (agent, rule, cut) in enumerate(_SAID))
    line = f"case i % {len(_SAID)} {text} end || case when i % 3 = 2 then {nl} else '' end"
    if d.name == "spark":
        return f"select host, array_join(transform(array_sort(collect_list(struct(i, {line} as line))), x -> x.line), {nl}) as body from ({placed}) group by host"
    return f"select host, string_agg({line}, {nl} order by i) as body from ({placed}) group by host"


def _robots_sql() -> str:
    """Every visit beside every rule of its host."""
    return f"""with texts as ({_robots(D)}),
    pos as (select host, ls, unnest(range(1, len(ls) + 1)) as pos from (select host, {D.lines('body')} as ls from texts)),
    lines as (select host, pos, trim(regexp_replace(ls[pos], '#.*', '')) as line from pos),
    parts as (select *, sum(case when line = '' then 1 else 0 end) over (partition by host order by pos) as part from lines),
    said as (select host, pos, part, lower(trim({D.extract('line', '^([^:]+):', 1)})) as word, trim({D.extract('line', '^[^:]+:(.*)$', 1)}) as value from parts),
    rules as (select a.host, regexp_replace(lower(a.value), '[/ ].*', '') as agent, r.word as kind, case when r.value = '' or starts_with(r.value, '/') then r.value else '/' || r.value end as prefix
        from said r join said a on a.host = r.host and a.part = r.part and a.pos < r.pos where a.word = 'user-agent' and a.value <> '' and r.word in ('allow', 'disallow')),
    visits as (select page_id, host, coalesce(nullif(path, ''), '/') as path, coalesce(nullif(regexp_replace(lower(trim(agent)), '[/ ].*', ''), ''), '*') as agent from ({_visits(D)})),
    own as (select v.*, exists (select 1 from rules r where r.host = v.host and r.agent = v.agent) as own from visits v),
    met as (select v.page_id, max(case when kind = 'allow' then length(prefix) end) as yes, max(case when kind = 'disallow' then length(prefix) end) as no
        from own v join rules r on r.host = v.host and r.agent = case when v.own then v.agent else '*' end and prefix <> '' and starts_with(v.path, prefix) group by 1)
    select v.page_id, coalesce(yes, -1) >= coalesce(no, -1) as allowed from visits v left join met m on m.page_id = v.page_id"""


@query(_robots_sql().replace("@pages", "pages"))
def robots_over_pages(spark, sf_dir):
    """Whether the agent that asks for each page may have it, by rules that every host states over its own paths."""
    rules = robots.robots_rules(spark.sql(_TABLES(_robots(SPARK), sf_dir)))
    return robots.allowed(spark.sql(_TABLES(_visits(SPARK), sf_dir)), rules).select("page_id", "allowed")
