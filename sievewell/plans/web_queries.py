"""Queries over addresses, pages, settings and artifacts: each is one SQL text in both dialects."""

from __future__ import annotations

from ..functions import web
from ..functions.catalogue import POSITIVE, RISK
from ..functions.dialect import Spark
from ..functions.urls import url_expressions
from ..operators.artifacts import file_name
from ..operators.reports import RUN_ALERTS
from ..operators.settings import PERSONAS
from .registry import sql_query

#: Addresses to judge, beside the pages' own.
_ADDRESSES = (
    "", "ftp://example.com/x", "https://user:pw@example.com/", "https:///x", "http://localhost:8080/", "https://db.internal/x", "http://10.1.2.3/", "http://172.20.0.1/x", "http://172.32.0.1/x", "http://100.64.0.1/", "http://[::1]/",
    "http://[fd00::1]/x", "https://198.18.0.9/", "https://198.20.0.9/", "mailto:a@b.example", "http://printer.local",
)


def _cases(d: Spark, key: str, values, otherwise: str) -> str:
    return f"case {key} % {len(values) + 4} " + " ".join(f"when {i} then {d.text(v)}" for i, v in enumerate(values)) + f" else {otherwise} end"


@sql_query
def url_safety(d):
    """Why an address must not be fetched."""
    return f"select page_id, address, {web.unsafe_reason(d, 'address')} as reason from (select page_id, {_cases(d, 'page_id', _ADDRESSES, 'url')} as address from @pages)"


_ROBOTS = {
    "a.example": "User-agent: *\nDisallow: /private\nAllow: /private/jobs # open\n\nUser-agent: Finder\nUser-agent: Scout\nDisallow: /\nAllow: /jobs",
    "b.example": "user-agent: finder\nDisallow:\n\nUser-agent: *\nDisallow: /",
    "c.example": "Disallow: /lost\nnonsense\nUser-agent: *\nDisallow: jobs/x",
}
_VISITS = tuple((h, a, p) for h in (*_ROBOTS, "d.example") for a in ("Finder", "scout", "other") for p in ("/", "/jobs/1", "/private/x", "/private/jobs/2", "/lost"))


@sql_query
def robots_allowed(d):
    """Whether an agent may fetch a path: its own rules or those for all, the longest prefix of either kind, allowing wins ties."""
    texts = d.rows("t", "host, body", [f"({d.text(h)}, {d.text(b)})" for h, b in _ROBOTS.items()])
    visits = d.rows("t", "host, agent, path", [f"({d.text(h)}, {d.text(a)}, {d.text(p)})" for h, a, p in _VISITS])
    pos = f"select host, pos, trim({d.replace(d.at('ls', 'cast(pos as int)'), '#.*', '')}) as line from (select host, ls, {d.unnest(d.numbers_to(d.size('ls')))} as pos from (select host, {d.lines('body')} as ls from {texts}))"
    return f"""
    with lines as (select host, pos, line, sum(case when line = '' then 1 else 0 end) over (partition by host order by pos) as part from ({pos})),
    said as (select host, pos, part, lower(trim({d.extract('line', '^([^:]+):', 1)})) as word, trim({d.extract('line', '^[^:]+:(.*)$', 1)}) as value from lines),
    rules as (select a.host, lower(a.value) as agent, r.word as kind, case when r.value = '' or substr(r.value, 1, 1) = '/' then r.value else '/' || r.value end as prefix
        from said r join said a on a.host = r.host and a.part = r.part and a.pos < r.pos where a.word = 'user-agent' and a.value <> '' and r.word in ('allow', 'disallow')),
    visits as (select * from {visits}),
    agents as (select v.host, v.agent, v.path, max(case when r.agent = lower(v.agent) then 1 else 0 end) as own from visits v left join rules r on r.host = v.host group by 1, 2, 3),
    longest as (select g.host, g.agent, g.path,
        max(case when r.kind = 'allow' then length(r.prefix) else -1 end) as yes, max(case when r.kind = 'disallow' then length(r.prefix) else -1 end) as no
        from agents g left join rules r on r.host = g.host and r.agent = case when g.own = 1 then lower(g.agent) else '*' end and r.prefix <> '' and {'startswith(g.path, r.prefix)' if d.name == 'spark' else 'starts_with(g.path, r.prefix)'}
        group by 1, 2, 3)
    select host, agent, path, coalesce(yes, -1) >= coalesce(no, -1) as allowed from longest"""


@sql_query
def cache_state(d):
    """Each address beside its cached answer: fresh within 720 minutes, stale beyond, or missing."""
    now = "timestamp '2024-02-01 00:00:00'"
    at = f"{now} - page_id % 1500 * interval '1' minute"
    return f"""with cached as (select distinct {d.sha256('url')} as key, {at} as fetched_at from @pages where page_id % 3 <> 0),
    latest as (select key, max(fetched_at) as fetched_at from cached group by key)
    select p.page_id, {d.sha256('p.url')} as cache_key, case when c.key is null then 'miss' when {d.minutes_between('c.fetched_at', now)} <= 720 then 'fresh' else 'stale' end as state
    from @pages p left join latest c on {d.sha256('p.url')} = c.key"""


@sql_query
def best_career_page(d):
    """The best page of each host: by score, jobs, shorter address, then the earliest; and how sure that is."""
    jobs = "cast(page_id % 4 as int)"
    score = web.career_score(d, "url", jobs, "first_url", "cast(page_id % 3 as int)", "cast(page_id % 2 as int)")
    return f"""with pages_of as (select page_id, url, {url_expressions(d)['host']} as host from @pages),
    seen as (select *, first_value(url) over (partition by host order by page_id) as first_url from pages_of),
    scored as (select page_id, url, host, {jobs} as jobs, cast({score} as int) as score from seen)
    select host, page_id, url, jobs, score, case when jobs < 1 then 0 else least(100, greatest(0, 20 + score + jobs * 4)) end as confidence
    from (select *, row_number() over (partition by host order by score desc, jobs desc, length(url), page_id) as place from scored) where place = 1"""


@sql_query
def anchor_jobs(d):
    """Links of each page that name postings, each once; at most 24 a page, in page order."""
    anchor = r"(?is)<a\s[^>]*href=[\x22']([^\x22'>]*)[\x22'][^>]*>(.*?)</a>"
    both = d.pairs(d.extract_all("html", anchor, 1), d.extract_all("html", anchor, 2), lambda u, t: f"{u} || chr(1) || trim({d.replace(d.replace(t, '<[^>]*>', ' '), r'\s+', ' ')})")
    both = both.replace("chr(1)", "char(1)") if d.name == "spark" else both
    mark = "char(1)" if d.name == "spark" else "chr(1)"
    part = lambda i: f"split_part(link, {mark}, {i})"
    return f"""with links as (select page_id, ls, {d.unnest(d.numbers_to(d.size('ls')))} as pos from (select page_id, {both} as ls from @pages) where {d.size('ls')} > 0),
    named as (select page_id, pos, {part(1)} as url, {part(2)} as title from (select page_id, pos, {d.at('ls', 'cast(pos as int)')} as link from links)),
    judged as (select page_id, pos, url, title, {web.likely_job(d, 'title', 'url')} as likely from named),
    once as (select *, row_number() over (partition by page_id, lower(title), lower(url) order by pos) as turn from judged)
    select page_id, title, url, likely from (select *, row_number() over (partition by page_id order by pos) as place from once where turn = 1) where place <= 24"""


@sql_query
def artifact_names(d):
    """A stable file name of each address: its host and last segment, and a hash of all of it."""
    return f"select page_id, {file_name(d, d.text('Engineer'), d.text('none'))} as name, {web.scope_id(d, d.text('Engineer One'), d.text('none'))} as scope from @pages"


@sql_query
def ad_hoc_groups(d):
    """Stored sources: one group per kind and address, its files in order, the first for all; and a file per persona, old or new."""
    people = d.rows("t", "persona", [f"({d.text(p.name)})" for p in PERSONAS])
    return f"""with artifacts as (select event_type as kind, 'https://example.com/' || cast(user_id % 40 as varchar(9)) as url, 'adhoc-' || lpad(cast(event_id as varchar(9)), 8, '0') || '.yaml' as path from @events),
    sources as (select kind, url, count(*) as n, min(path) as representative from artifacts group by kind, url),
    existing as (select kind, url, case length(kind) % 3 when 0 then 'engineer' when 1 then 'engineer_strict' else 'nobody' end as persona, min(path) as path from artifacts group by kind, url)
    select s.kind, s.url, s.n, s.representative, p.persona, coalesce(e.path, 'adhoc-url-' || p.persona || '-' || {d.fnv('s.url')} || '.yaml') as target, e.path is null as is_new
    from sources s cross join {people} p left join existing e on e.kind = s.kind and e.url = s.url and e.persona = p.persona"""


@sql_query
def run_artifacts(d):
    """Report files by run: the type from the file's name, the run from its folder."""
    name = "case event_id % 5 when 0 then 'batch-evaluation.json' when 1 then 'weekly-digest.md' when 2 then 'trend-alerts.json' when 3 then 'batch-evaluation.md' else 'notes.txt' end"
    kind = "case when path like '%digest%.md' then 'weekly_digest' when path like '%batch%.json' then 'batch_json' when path like '%batch%.md' then 'batch_markdown' when path like '%alerts%.json' then 'alerts' else 'other' end"
    return f"""with files as (select distinct 'reports/run-' || lpad(cast(user_id as varchar(9)), 6, '0') || '/' || {name} as path from @events)
    select {d.extract('path', '/(run-[0-9]+)/', 1)} as run_id, {kind} as kind, count(*) as n, {d.sorted_texts('path')} as paths from files group by 1, 2"""


@sql_query
def persona_selection(d):
    """Personas as asked for: in that order, each once; one unknown name empties the selection and is told."""
    asked = {"both": ("Engineer_Strict", "engineer", "engineer_strict"), "typo": ("engineer", "enginer"), "blank": ()}
    rows = d.rows("t", "selection, place, id", [f"({d.text(s)}, {i}, {d.text(p.lower())})" for s, ps in asked.items() for i, p in enumerate(ps)])
    people = d.rows("t", "persona", [f"({d.text(p.name)})" for p in PERSONAS])
    return f"""with wanted as (select selection, id, min(place) as place from {rows} group by 1, 2),
    met as (select w.selection, w.place, w.id, p.persona from wanted w left join {people} p on p.persona = w.id),
    wrong as (select selection from met where persona is null)
    select selection, row_number() over (partition by selection order by place) as place, persona, cast(null as varchar(40)) as error from met where selection not in (select selection from wrong)
    union all select selection, 0, null, 'unknown persona: ' || id from met where persona is null"""


@sql_query
def page_search(d):
    """The second page, of ten, of what a search in titles and addresses finds at one source."""
    title = "trim(" + d.extract("html", "<title>([^<]*)</title>", 1) + ")"
    return f"""select page_id, title, url from (select *, row_number() over (order by page_id) as place from (select page_id, {title} as title, url from @pages)
    where contains(lower(title || ' ' || url), 'e') and contains(url, 'example')) where place between 11 and 20"""


@sql_query
def listing_urls(d):
    """Addresses without query under which several titles stand are listings."""
    title = "lower(trim(" + d.extract("html", "<title>([^<]*)</title>", 1) + "))"
    return f"select address, count(distinct title) as titles, count(distinct title) > 1 as is_listing from (select {d.extract('url', '^([^?#]*/)', 1)} as address, {title} as title from @pages) group by address"


@sql_query
def stale_companies(d):
    """Companies last resolved before a cutoff, or without any raw file."""
    return """with resolved as (select o_custkey as company, max(o_orderdate) as updated_at from @orders where o_orderpriority <> '5-LOW' group by 1),
    files as (select distinct o_custkey as company from @orders where o_orderstatus = 'F'),
    latest as (select max(o_orderdate) as run_at from @orders)
    select c.c_custkey as company, coalesce(r.updated_at, timestamp '1970-01-01 00:00:00') as updated_at, f.company is null as no_files
    from @customer c cross join latest l left join resolved r on r.company = c.c_custkey left join files f on f.company = c.c_custkey
    where coalesce(r.updated_at, timestamp '1970-01-01 00:00:00') < l.run_at - interval '180' day or f.company is null"""


@sql_query
def company_selection(d):
    """Companies whose id is listed, whatever its case and blanks; an empty list selects all."""
    listed = d.rows("t", "selection, id", ["('some', ' Customer#000000007 ')", "('some', 'CUSTOMER#000000011')"])
    return f"""with wanted as (select selection, lower(trim(id)) as id from {listed}), selections as (select 'some' as selection union all select 'all')
    select s.selection, c.c_custkey from selections s cross join @customer c
    where s.selection not in (select selection from wanted) or exists (select 1 from wanted w where w.selection = s.selection and w.id = lower(trim(c.c_name)))"""


#: Settings with faults, so that every rule of the check has something to tell.
_COMPANIES = (
    ("aomori_pay", "Aomori Pay", "https://careers.aomoripay.example/", "https://aomoripay.example/en/", ("expat_friendly", "expat_friendly"), ()),
    ("Kita", "Kita Retail", "ftp://kita.example", "https://kita.example.co.jp/", ("rich",), ("language_friction_high",)),
    ("aomori_pay", "kita retail", "http://192.168.0.4/", "https://x.internal/", (), ("layoff_risk", "late")),
)
_PEOPLE = (("engineer", "salary", "consulting_company", 0, (("remote_friendly", 3), ("no_such_signal", 1))), ("engineer", "", "", -5, (("onsite_bias", -1),)), ("Bad Id", "salary,salary", "startup", 1, ()))


@sql_query
def config_violations(d):
    """What is wrong with settings: ids, duplicates, tags, addresses, ranges, weights of unknown signals."""
    tags = lambda xs: ", ".join(map(d.text, xs)) or "''"
    companies = d.rows("t", "pos, id, name, career_url, corporate_url, profile_tags, risk_tags", [f"({i}, {d.text(a)}, {d.text(b)}, {d.text(c)}, {d.text(e)}, {d.text(','.join(p))}, {d.text(','.join(r))})" for i, (a, b, c, e, p, r) in enumerate(_COMPANIES)])
    people = d.rows("t", "pos, id, priorities, hard_no, floor", [f"({i}, {d.text(a)}, {d.text(b)}, {d.text(c)}, {f})" for i, (a, b, c, f, _) in enumerate(_PEOPLE)])
    weights = d.rows("t", "pos, signal, weight", [f"({i}, {d.text(s)}, {w})" for i, p in enumerate(_PEOPLE) for s, w in p[4]])
    signals = d.rows("t", "signal", [f"({d.text(s[0])})" for s in (*POSITIVE, *RISK)])
    allowed = {"profile_tags": ("expat_friendly", "engineering_brand", "strong_wlb", "stable_public", "product_leader", "reputation_strong"), "risk_tags": ("language_friction_high", "overtime_risk", "reputation_risk", "layoff_risk")}
    at = lambda what: f"'{what}[' || cast(pos as varchar(9)) || ']"
    items = lambda source, column: f"(select pos, {d.unnest(d.split_on(column, ','))} as item from {source} where {column} <> '')"
    parts = []
    for source, what in (("companies", "companies"), ("people", "personas")):
        parts.append(f"select {at(what)}.id must match pattern ^[a-z0-9_]+$' as error from {source} where not {d.matches('id', '^[a-z0-9_]+$')}")
        parts.append(f"select 'Duplicate id: ' || id from (select id, row_number() over (partition by lower(trim(id)) order by pos) as turn from {source}) where turn > 1")
    parts.append("select 'Duplicate company name: ' || name from (select name, row_number() over (partition by lower(trim(name)) order by pos) as turn from companies) where turn > 1")
    for column in ("career_url", "corporate_url"):
        parts.append(f"select {at('companies')}.{column} must be a valid public http/https URL' from companies where {web.unsafe_reason(d, column)} is not null")
    for column, known in allowed.items():
        parts.append(f"select {at('companies')}.{column} has unsupported tag ' || item from {items('companies', column)} where item not in ({tags(known)})")
    for source, what, column in (("companies", "companies", "profile_tags"), ("companies", "companies", "risk_tags"), ("people", "personas", "priorities"), ("people", "personas", "hard_no")):
        parts.append(f"select {at(what)}.{column} contains duplicate value ' || item from {items(source, column)} group by pos, item having count(*) > 1")
    for column in ("priorities", "hard_no"):
        parts.append(f"select {at('personas')}.{column} must contain at least one item' from people where {column} = ''")
    parts.append(f"select {at('personas')}.minimum_salary_yen must be non-negative' from people where floor < 0")
    parts.append(f"select {at('personas')}.signal_weights has unknown signal ' || w.signal from weights w where not exists (select 1 from {signals} s where s.signal = w.signal)")
    parts.append(f"select {at('personas')}.signal_weights.' || signal || ' must be non-negative' from weights where weight < 0")
    return f"with companies as (select * from {companies}), people as (select * from {people}), weights as (select * from {weights}) " + " union all ".join(parts)


def _daily(d: Spark) -> str:
    count = lambda c: f"count(case when {c} then 1 end)"
    return f"""select {d.day('ts') if d.name == 'spark' else 'cast(ts as date)'} as run, count(*) as jobs, {count("event_type = 'purchase'")} as go, {count("event_type = 'error'")} as no_go,
        {count("event_type = 'view' and extract(day from ts) % 4 = 0")} as updated, avg(value) as avg_score, avg(case when event_type = 'click' then value end) as avg_friction, avg(case when event_type = 'view' then value end) as avg_reputation from @events group by 1"""


_TRENDS = ("jobs", "go", "no_go", "updated", "avg_score", "avg_friction", "avg_reputation")


@sql_query
def run_alerts_sorted(d):
    """Every alert of every run, a surge of updates among them, the gravest first."""
    lags = ", ".join(f"{c} - lag({c}) over (order by run) as d_{c}, lag({c}) over (order by run) as p_{c}" for c in _TRENDS)
    rules = " union all ".join(f"select run, '{s}' as severity, '{k}' as code from compared where p_jobs is not null and ({c})" for k, s, c in RUN_ALERTS)
    rank = "case severity when 'CRITICAL' then 0 when 'WARNING' then 1 else 2 end"
    return f"with compared as (select *, {lags} from ({_daily(d)})), found as ({rules}) select run, severity, code, row_number() over (partition by run order by {rank}, code) as place from found"


@sql_query
def trend_lines(d):
    """Changes between runs as they are printed, with their sign."""
    whole = lambda c: d.signed("%+d", f"{c} - lag({c}) over (order by run)")
    return f"select run, case when n > 1 then 'jobs ' || {whole('jobs')} || ', go ' || {whole('go')} || ', no_go ' || {whole('no_go')} end as line from (select *, row_number() over (order by run) as n from ({_daily(d)}))"


@sql_query
def text_helpers(d):
    """Shortened, cleaned and compared texts."""
    return f"""select doc_id, {web.shorten('text', 80)} as short, {web.slug(d, 'source')} as slug, length({web.sanitized(d, 'text')}) as clean_chars, length({web.sanitized(d, 'text')}) > 100000 as too_long,
    {d.sha256('key')} as dedupe_key, {web.boilerplate(d, 'key')} as is_boilerplate from (select *, {web.dedupe_key(d, 'text')} as key from @documents)"""
