"""Queries over stored evaluations of single sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.dialect import DUCKDB as D, SPARK, Spark
from ..functions.urls import url_expressions
from ..operators import artifacts as A
from ..operators.evaluation import evaluate_sql, staged_sql
from ..operators.settings import PERSONAS
from ..session import scratch_dir
from ..sinks.versioned import Versioned
from ..sources.postings import postings, postings_sql
from .registry import query

_PEOPLE, _AT = PERSONAS[1:], "2024-06-01 00:00:00"


def _artifact(d: Spark) -> dict[str, str]:
    """An artifact of some postings: up to seven of each address, by several personas."""
    host = "case ordinal % 4 when 0 then 'jobs.kita.example.co.jp' when 1 then 'nami-labs.example' when 2 then 'careers.aomoripay.example' else 'boards.greenhouse.io' end"
    return {
        "path": "'adhoc-' || lpad(cast(ordinal as varchar(20)), 12, '0') || '.yaml'",
        "persona": "case ordinal % 3 when 0 then 'Engineer_Strict' when 1 then 'engineer_pragmatic' else 'nobody' end",
        "candidate_profile": "case ordinal % 5 when 0 then 'mid' else 'none' end",
        "kind": "'url'",
        "url": f"'https://' || {host} || '/careers/role-' || cast({d.div('ordinal', '28')} as varchar(20))",
        "raw_text": "''",
        **{c: c for c in ("company_name", "title", "location", "salary_range", "remote_policy", "description")},
        "verdict": "cast(null as varchar(20))",
        "score": "cast(null as int)",
        "generated_at": "timestamp '2024-01-01 00:00:00' + ordinal * interval '1' minute",
    }


_ARTIFACTS = f"(select {', '.join(f'{e} as {n}' for n, e in _artifact(D).items())} from {postings_sql(D)})"
_MENDED = f"(select * replace (case when renamed then resolved else company_name end as company_name) from {staged_sql(_ARTIFACTS, A.name_stages(D))})"


def _rerun_sql() -> str:
    first = f"(select *, row_number() over (partition by url order by path) as turn from {_MENDED})"
    judged = " union all ".join(f"select path, url, company_name, {D.text(p.name)} as who, verdict, score from {evaluate_sql(f'(select path, url, company_name, title, salary_range, remote_policy, description from {first} where turn = 1)', p, D)}" for p in _PEOPLE)
    return f"""with mended as materialized (select * from {_MENDED}), judged as (select j.*, coalesce(s.stored, {A.file_name(D, 'who', D.text('none'))}) as target from ({judged}) j
        left join (select url as at, lower(persona) as by, min(path) as stored from mended where candidate_profile = 'none' group by 1, 2) s on s.at = j.url and s.by = j.who)
    select target as path, who as persona, 'none' as candidate_profile, url, company_name, verdict, score, timestamp '{_AT}' as generated_at from judged
    union all select path, persona, candidate_profile, url, company_name, verdict, score, generated_at from mended where path not in (select target from judged)"""


@query(_rerun_sql())
def artifact_rerun(spark, sf_dir):
    """A table of stored evaluations after names are mended in it and two personas have judged its sources again."""
    store = Versioned(spark, f"{scratch_dir(spark)}/artifacts-{uuid.uuid4().hex}")
    store.replace(postings(spark, sf_dir).selectExpr(*[f"{e} as {n}" for n, e in _artifact(SPARK).items()]))
    A.mend_names_in(store)
    A.rerun_in(store, _PEOPLE, generated_at=_AT)
    return store.read().select("path", "persona", "candidate_profile", "url", "company_name", "verdict", "score", "generated_at")


def _jobs(d: Spark) -> dict[str, str]:
    """Postings that tell their address: of single roles, of teams with several titles, of listings; some without a time."""
    nl = d.text("\n")
    url = "'https://jobs.example/' || case ordinal % 6 when 0 then 'careers' when 1 then 'team-' || cast(o_custkey as varchar(20)) when 2 then '' else 'role-' || cast(ordinal as varchar(20)) || '?x=1' end"
    fetched = f"case when ordinal % 7 = 0 then '' else {nl} || 'Fetched At: 2024-02-' || lpad(cast(1 + ordinal % 28 as varchar(2)), 2, '0') || ' 10:00:00' end"
    return {"url": url, "company_name": "company_name", "title": "title", "description": f"description || {nl} || '  Source URL: ' || {url} || {fetched} || {nl} || 'end'", "modified_at": "timestamp '2024-02-01 00:00:00' + ordinal * interval '1' minute"}


def _saved(d: Spark) -> list[str]:
    """Artifacts at some of those addresses."""
    columns = {**_artifact(d), "url": _jobs(d)["url"], "verdict": "case ordinal % 2 when 0 then 'GO' else 'NO_GO' end", "generated_at": "timestamp '2024-02-10 00:00:00' + (ordinal % 1000) * interval '10' minute"}
    return [f"{e} as {n}" for n, e in columns.items()]


def _history_sql() -> str:
    source = f"(select p.*, o.o_custkey from {postings_sql(D)} p join orders o on o.o_orderkey = p.ordinal)"
    columns = ", ".join(f"{e} as {n}" for n, e in _jobs(D).items())
    concrete = url_expressions(D)["concrete"]
    at = "case when ordinal % 7 = 0 then modified_at else cast('2024-02-' || lpad(cast(1 + ordinal % 28 as varchar), 2, '0') || ' 10:00:00' as timestamp) end"
    return f"""with told as (select *, {at} as seen_at from (select ordinal, {columns} from {source})),
    listings as (select url from told group by url having count(distinct lower(trim(title))) > 1),
    jobs as (select * from (select *, row_number() over (partition by url order by seen_at desc, title desc) as turn from told where url not in (select url from listings) and {concrete}) where turn = 1),
    saved as (select * from (select *, row_number() over (partition by url order by generated_at desc, path desc) as turn from (select {', '.join(_saved(D))} from {source} where ordinal % 3 = 0) where {concrete}) where turn = 1),
    merged as (select coalesce(j.url, s.url) as url, j.url is not null and (s.url is null or j.seen_at >= s.generated_at) as job, j.company_name as c, j.title as t, seen_at, s.* exclude (url) from jobs j full join saved s on j.url = s.url)
    select url, case when job then 'pipeline_job' else 'ad_hoc' end as origin, case when job then c else company_name end as company_name, case when job then t else title end as title, case when job then seen_at else generated_at end as generated_at,
        case when job then '' else persona end as persona, case when job then '' else candidate_profile end as candidate_profile, path as saved_path, verdict as saved_verdict from merged"""


@query(_history_sql())
def url_history(spark, sf_dir):
    """What was judged at each address, of postings and stored evaluations the newer, beside the newest stored one."""
    source = postings(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ordinal"), "o_custkey"), "ordinal")
    jobs = source.selectExpr(*[f"{e} as {n}" for n, e in _jobs(SPARK).items() if n != "url"])
    stored = source.where("ordinal % 3 = 0").selectExpr(*_saved(SPARK))
    return A.url_history(jobs, stored)
