"""The registered queries over postings and web data, and their SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.catalogue import POSITIVE, RISK
from ..functions.dialect import DUCKDB, SPARK, Spark
from ..functions.urls import url_expressions
from ..operators import reports, snapshots
from ..operators.evaluation import all_personas, evaluate, evaluate_sql, same_company, stages
from ..operators.settings import BLACKLIST, COMPANIES, PERSONAS
from ..sources.postings import postings, postings_sql
from .registry import ORACLES, PERSONA, QUERIES, query

D = DUCKDB


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVALUATED = evaluate_sql(postings_sql(D), PERSONA, D)
_LISTS = ", ".join(f"{D.joined(c)} as {c}" for c in ("positive_signals", "risk_signals", "hard_reject_reasons"))
_NUMBERS = "ordinal, verdict, score, raw_score, language_friction_index, company_reputation_index"


@query(f"select {_NUMBERS}, {_LISTS} from {EVALUATED}")
def evaluation(spark, sf_dir):
    """Every posting with its verdict, scores, indices, signals and reasons."""
    out = evaluate(postings(spark, sf_dir), PERSONA)
    return out.select(*_NUMBERS.split(", "), *[F.array_join(c, ",").alias(c) for c in ("positive_signals", "risk_signals", "hard_reject_reasons")])


@query(" union all ".join(f"select '{p.name}' as persona, verdict, count(*) as n from {evaluate_sql(postings_sql(D), p, D)} group by verdict" for p in PERSONAS))
def verdict_by_persona(spark, sf_dir):
    return all_personas(postings(spark, sf_dir), PERSONAS).groupBy("persona", "verdict").agg(F.count("*").alias("n"))


def _top_sql(strategy: str) -> str:
    order = ", ".join([*reports.RANKINGS[strategy], "ordinal"])
    return f"select verdict, place, ordinal, company_name, score from (select *, row_number() over (partition by verdict order by {order}) as place from {EVALUATED}) where place <= 5"


@query(_top_sql("by_score"))
def top_k_per_verdict(spark, sf_dir):
    return reports.ranked(evaluate(postings(spark, sf_dir), PERSONA)).select("verdict", "place", "ordinal", "company_name", "score")


@query(" union all ".join(f"select '{s}' as strategy, * from ({_top_sql(s)})" for s in reports.RANKINGS))
def top_k_by_strategy(spark, sf_dir):
    items = evaluate(postings(spark, sf_dir), PERSONA).select("ordinal", "company_name", "verdict", "score", "language_friction_index", "company_reputation_index")
    return reports.ranked_by_all(items).select("strategy", "verdict", "place", "ordinal", "company_name", "score")


@query(" union all ".join(f"select '{k}' as kind, entry, count(*) as n from (select unnest({c}) as entry from {EVALUATED}) group by entry" for k, c in (("positive", "positive_signals"), ("risk", "risk_signals"))))
def signal_frequency(spark, sf_dir):
    items = evaluate(postings(spark, sf_dir), PERSONA)
    named = lambda kind: F.transform(f"{kind}_signals", lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("entry")))
    both = items.select(F.explode(F.concat(named("positive"), named("risk"))).alias("x"))
    return both.groupBy("x.kind", "x.entry").agg(F.count("*").alias("n"))


@query(f"select entry, count(*) as n from (select unnest(hard_reject_reasons) as entry from {EVALUATED}) group by entry")
def reject_reason_frequency(spark, sf_dir):
    return reports.frequencies(evaluate(postings(spark, sf_dir), PERSONA), "hard_reject_reasons")


_COUNTS = "count(*) as jobs, " + ", ".join(f"count(*) filter (verdict = '{v}') as {v.lower()}" for v in reports.VERDICTS)
_MEANS = "coalesce(avg(score), 0.0) as avg_score, coalesce(avg(language_friction_index), 0.0) as avg_friction, coalesce(avg(company_reputation_index), 0.0) as avg_reputation"
_SHOWN = "case when trim(coalesce(company_name, '')) = '' then 'Unknown Company' else trim(company_name) end"


@query(f"select lower(shown) as company_key, min_by(shown, ordinal) as company, {_COUNTS}, {_MEANS} from (select *, {_SHOWN} as shown from {EVALUATED}) group by 1")
def company_stats(spark, sf_dir):
    return reports.company_stats(evaluate(postings(spark, sf_dir), PERSONA)).select("company_key", "company", "jobs", "go", "go_with_caution", "no_go", "avg_score", "avg_friction", "avg_reputation")


@query(f"select {_COUNTS}, {_MEANS} from {EVALUATED}")
def run_summary(spark, sf_dir):
    return reports.verdict_counts(evaluate(postings(spark, sf_dir), PERSONA))


def _weights_sql() -> str:
    rows = [f"('{p.name}', {p.positive_weight(*s)})" for p in PERSONAS for s in POSITIVE] + [f"('{p.name}', {-p.risk_weight(*s)})" for p in PERSONAS for s in RISK]
    return f"select p as persona, cast(sum(case when w < 0 then w else 0 end) as bigint) as low, cast(sum(case when w > 0 then w else 0 end) as bigint) as high from (values {', '.join(rows)}) t(p, w) group by p"


@query(_weights_sql())
def score_range(spark, sf_dir):
    """The lowest and the highest raw score a persona can give."""
    signals = spark.createDataFrame([(s, g, 0, 1) for s, g in POSITIVE] + [(s, g, x, -1) for s, g, x in RISK], "signal string, grp string, extra int, sign int")
    people = spark.createDataFrame([(p.name, list(p.priorities), p.weights) for p in PERSONAS], "persona string, priorities array<string>, weights map<string,int>")
    preferred = F.array_contains("priorities", F.col("grp"))
    weight = F.coalesce(F.try_element_at("weights", F.col("signal")), F.when(F.col("sign") > 0, F.when(preferred, 2).otherwise(1)).otherwise(F.when(preferred, 3).otherwise(2) + F.col("extra")))
    both = signals.join(F.broadcast(people)).withColumn("w", weight * F.col("sign"))
    return both.groupBy("persona").agg(F.sum(F.least("w", F.lit(0))).alias("low"), F.sum(F.greatest("w", F.lit(0))).alias("high"))


_NAMES = ", ".join(f"({i}, {D.text(c.name)})" for i, c in enumerate(COMPANIES, 1))


@query(f"""select name, n, (select min(i) from (values {_NAMES}) t(i, c) where {same_company(D, "lower(name)", "lower(c)")}) as tracked
    from (select company_name as name, count(*) as n from {postings_sql(D)} group by 1)""")
def tracked_company_match(spark, sf_dir):
    """The first tracked company of each name: a theta join of distinct names with the small list, the first in its order."""
    names = postings(spark, sf_dir).groupBy(F.col("company_name").alias("name")).agg(F.count("*").alias("n"))
    tracked = spark.createDataFrame([(i, c.name.lower()) for i, c in enumerate(COMPANIES, 1)], "i int, c string")
    met = names.join(F.broadcast(tracked), F.expr(same_company(SPARK, "lower(name)", "c")), "left")
    return met.groupBy("name", "n").agg(F.min("i").alias("tracked"))


_LISTED = ", ".join(f"({D.text(b.lower())})" for b in BLACKLIST)
_ON_LIST = f"exists (select 1 from (values {_LISTED}) t(b) where {same_company(D, 'lower(company_name)', 'b')})"


def _blacklisted(spark, sf_dir, how):
    listed = spark.createDataFrame([(b.lower(),) for b in BLACKLIST], "b string")
    jobs = postings(spark, sf_dir).select("ordinal", "company_name")
    return jobs.join(F.broadcast(listed), F.expr(same_company(SPARK, "lower(company_name)", "b")), how)


@query(f"select ordinal, company_name from {postings_sql(D)} where {_ON_LIST}")
def blacklist_semi_join(spark, sf_dir):
    return _blacklisted(spark, sf_dir, "left_semi")


@query(f"select ordinal, company_name from {postings_sql(D)} where not {_ON_LIST}")
def not_blacklisted_anti_join(spark, sf_dir):
    return _blacklisted(spark, sf_dir, "left_anti")


_SHIFT = "case when o_orderkey % 7 = 0 then 250000 else 0 end"
_NOW = snapshots.keyed_sql(D, f"(select * from {postings_sql(D, _SHIFT)} where ordinal % 11 <> 0)")
_THEN = snapshots.keyed_sql(D, f"(select * from {postings_sql(D)} where ordinal % 13 <> 0)")
_DIFF = f"""(select coalesce(n.job_key, t.job_key) as job_key, n.ordinal, t.source_file as previous_file,
    case when t.job_key is null then 'NEW' when n.job_key is null then 'REMOVED' when n.fingerprint = t.fingerprint then 'UNCHANGED' else 'UPDATED' end as change_status
    from {_NOW} n full outer join {_THEN} t on n.job_key = t.job_key)"""


def _snapshots(spark, sf_dir):
    now = snapshots.keyed(postings(spark, sf_dir, _SHIFT).where("ordinal % 11 <> 0"))
    then = snapshots.keyed(postings(spark, sf_dir).where("ordinal % 13 <> 0"))
    return now, then


@query(f"select job_key, change_status, ordinal, previous_file from {_DIFF}")
def snapshot_diff(spark, sf_dir):
    return snapshots.diff(*_snapshots(spark, sf_dir))


@query(f"select change_status, count(*) as n from {_DIFF} group by 1")
def change_counts(spark, sf_dir):
    return snapshots.diff(*_snapshots(spark, sf_dir)).groupBy("change_status").agg(F.count("*").alias("n"))


@query(f"select job_key, source_file, company_name from {_THEN} t where not exists (select 1 from {_NOW} n where n.job_key = t.job_key)")
def removed_jobs(spark, sf_dir):
    return snapshots.removed(*_snapshots(spark, sf_dir)).select("job_key", "source_file", "company_name")


@query(f"select ordinal, job_key, fingerprint from {_NOW} n where not exists (select 1 from {_THEN} t where n.job_key = t.job_key and n.fingerprint = t.fingerprint)")
def incremental_only(spark, sf_dir):
    return snapshots.changed(*_snapshots(spark, sf_dir)).select("ordinal", "job_key", "fingerprint")


@query(f"select ordinal, base_key, job_key from {snapshots.keyed_sql(D, postings_sql(D))}")
def job_key_dedupe(spark, sf_dir):
    return snapshots.keyed(postings(spark, sf_dir)).select("ordinal", "base_key", "job_key")


_MONTHLY = f"(select date_trunc('month', o_orderdate)::timestamp as run, * from {EVALUATED})"
_RUNS = f"(select run, 'all' as scope, {_COUNTS}, {_MEANS} from {_MONTHLY} group by run)"
_TREND = [c for c in reports.TREND if c not in ("new", "updated", "removed")]
_DELTAS = f"(select *, {', '.join(f'{c} - lag({c}) over (partition by scope order by run) as d_{c}, lag({c}) over (partition by scope order by run) as p_{c}' for c in _TREND)} from {_RUNS})"


def _monthly(spark, sf_dir):
    return evaluate(postings(spark, sf_dir), PERSONA).withColumn("run", F.date_trunc("month", "o_orderdate"))


def _runs(spark, sf_dir):
    return reports.verdict_counts(_monthly(spark, sf_dir), "run").withColumn("scope", F.lit("all"))


@query(f"select run, jobs, go, no_go, d_jobs, d_go, d_go_with_caution, d_no_go, round(d_avg_score, 6) as d_avg_score, round(d_avg_friction, 6) as d_avg_friction, round(d_avg_reputation, 6) as d_avg_reputation from {_DELTAS}")
def run_trend_delta(spark, sf_dir):
    out = reports.deltas(_runs(spark, sf_dir), "scope", "run")
    return out.select("run", "jobs", "go", "no_go", "d_jobs", "d_go", "d_go_with_caution", "d_no_go", *[F.round(c, 6).alias(c) for c in ("d_avg_score", "d_avg_friction", "d_avg_reputation")])


def _alert_sql(source: str, rules, keys: str) -> str:
    return " union all ".join(f"select {keys}, '{s}' as severity, '{k}' as code from {source} where p_jobs is not null and ({c})" for k, s, c in rules if "updated" not in c)


@query(_alert_sql(_DELTAS, reports.RUN_ALERTS, "run"))
def trend_alerts(spark, sf_dir):
    return reports.alerts(reports.deltas(_runs(spark, sf_dir), "scope", "run"), reports.RUN_ALERTS, ["run"])


_BY_COMPANY = f"(select run, lower({_SHOWN}) as company_key, {_COUNTS}, {_MEANS} from {_MONTHLY} group by 1, 2)"
_COMPANY_DELTAS = f"(select *, {', '.join(f'{c} - lag({c}) over (partition by company_key order by run) as d_{c}, lag({c}) over (partition by company_key order by run) as p_{c}' for c in _TREND)} from {_BY_COMPANY})"


@query(_alert_sql(_COMPANY_DELTAS, reports.COMPANY_ALERTS, "run, company_key"))
def company_trend_alerts(spark, sf_dir):
    by_company = reports.company_stats(_monthly(spark, sf_dir), "run").drop("company")
    return reports.alerts(reports.deltas(by_company, "company_key", "run"), reports.COMPANY_ALERTS, ["run", "company_key"])


def _half(sign: str) -> str:
    return f"(select lower({_SHOWN}) as company_key, avg(score) as avg_score from {EVALUATED} where ordinal % 2 {sign} 0 group by 1)"


@query(f"select company_key, round(delta, 6) as delta from (select a.company_key, a.avg_score - b.avg_score as delta from {_half('=')} a join {_half('<>')} b using (company_key)) order by abs(delta) desc, company_key limit 5")
def company_movers(spark, sf_dir):
    items = evaluate(postings(spark, sf_dir), PERSONA).withColumn("now", F.expr("ordinal % 2 = 0"))
    return reports.movers(items, "now").select("company_key", F.round("delta", 6).alias("delta"))


@query("select run, n from (select *, row_number() over (order by run desc) as back from (select date_trunc('month', o_orderdate)::timestamp as run, count(*) as n from orders group by 1)) where back <= 26")
def retention_last_n(spark, sf_dir):
    runs = _read(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("run")).agg(F.count("*").alias("n"))
    return snapshots.retained(runs.withColumn("scope", F.lit("all")), "scope", "run").select("run", "n")


_WORDS = ("the", "of", "en", "de", "token", "and the", "über", "th-e")


def _hits(d: Spark, how) -> str:
    return f"select doc_id, {how(d)} as hits from (select doc_id, {d.norm('text')} as txt from documents)"


@query(_hits(D, lambda d: d.hits("txt", _WORDS)))
def keyword_hits_word(spark, sf_dir):
    return _read(spark, sf_dir, "documents").selectExpr("doc_id", f"{SPARK.norm('text')} as txt").selectExpr("doc_id", f"{SPARK.hits('txt', _WORDS)} as hits")


@query(_hits(D, lambda d: d.inside_hits("txt", _WORDS)))
def keyword_hits_substring(spark, sf_dir):
    return _read(spark, sf_dir, "documents").selectExpr("doc_id", f"{SPARK.norm('text')} as txt").selectExpr("doc_id", f"{SPARK.inside_hits('txt', _WORDS)} as hits")


def _years(d: Spark) -> str:
    from ..functions.lexicon import YEARS_EXPERIENCE_PATTERN as p

    return f"coalesce({d.largest(d.each(d.extract_all(d.norm('description'), p), lambda x: f'try_cast({x} as int)'))}, 0)"


@query(f"select ordinal, {_years(D)} as years from {postings_sql(D)}")
def required_years_max(spark, sf_dir):
    return postings(spark, sf_dir).selectExpr("ordinal", f"{_years(SPARK)} as years")


_SALARY = "ordinal, s_explicit, s_anomaly, s_missing, s_transparent, s_upper"


def _salary_stages(d: Spark):
    first = {"salary": d.norm("salary_range")}
    found = [s for s in stages(d, PERSONA) if any(k.startswith("s_") for k in s) and "s_benchmark" not in s]
    return [first, *found]


def _salary_sql() -> str:
    out = postings_sql(D)
    for s in _salary_stages(D):
        out = f"(select *, {', '.join(f'{e} as {n}' for n, e in s.items())} from {out})"
    return f"select {_SALARY}, {D.joined('s_values')} as s_values from {out}"


@query(_salary_sql())
def salary_parse(spark, sf_dir):
    out = postings(spark, sf_dir)
    for s in _salary_stages(SPARK):
        out = out.selectExpr("*", *[f"{e} as {n}" for n, e in s.items()])
    return out.selectExpr(*_SALARY.split(", "), "array_join(s_values, ',') as s_values")


_URL = ", ".join(f"{e} as {n}" for n, e in url_expressions(D).items())


@query(f"select page_id, {_URL} from pages")
def url_parts(spark, sf_dir):
    """Canonical form, host, brand token and whether the URL names one posting."""
    return _read(spark, sf_dir, "pages").selectExpr("page_id", *[f"{e} as {n}" for n, e in url_expressions(SPARK).items()])


_SITES = ("example.com", "theres.example.com", "example.net", "ththe.example.org")
_SITE_ROWS = ", ".join(f"({i}, '{s}')" for i, s in enumerate(_SITES))


@query(f"select page_id, (select min(i) from (values {_SITE_ROWS}) t(i, s) where host = s or suffix(host, '.' || s)) as site from (select page_id, {url_expressions(D)['host']} as host from pages)")
def host_suffix_match(spark, sf_dir):
    """The first configured site that is a page's host or a parent of it: host suffixes are exploded, so it is a hash join."""
    pages = _read(spark, sf_dir, "pages").selectExpr("page_id", f"{url_expressions(SPARK)['host']} as host")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sites = spark.createDataFrame(list(enumerate(_SITES)), "i int, s string")
    met = pages.select("page_id", F.explode(suffixes).alias("s")).join(F.broadcast(sites), "s", "left")
    return met.groupBy("page_id").agg(F.min("i").alias("site"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id) as place from events) where place = 1")
def latest_per_key(spark, sf_dir):
    """The newest record of each key; of equal times the first."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))
    return _read(spark, sf_dir, "events").withColumn("place", place).where("place = 1").select("user_id", "event_id", "event_type")


@query(f"""select ordinal, company_name, score from (select *, row_number() over (order by coalesce(score, -1) desc, ordinal) as place from {EVALUATED} where verdict = 'GO') where place between 21 and 40""")
def filtered_page(spark, sf_dir):
    """The second page, of twenty, of one verdict by score."""
    page = evaluate(postings(spark, sf_dir), PERSONA).where("verdict = 'GO'").orderBy(F.coalesce("score", F.lit(-1)).desc(), "ordinal").offset(20).limit(20)
    return page.select("ordinal", "company_name", "score")


@query("""select url, origin, ts from (select *, row_number() over (partition by url order by ts desc, origin) as place from (
    select 'u' || user_id as url, 'history' as origin, max(ts) as ts from events where event_type = 'view' group by 1
    union all select 'u' || user_id, 'ad_hoc', max(ts) from events where event_type = 'click' group by 1)) where place = 1""")
def history_union(spark, sf_dir):
    """Two histories together, the newest record of each address."""
    events = _read(spark, sf_dir, "events").withColumn("url", F.concat(F.lit("u"), F.col("user_id")))
    one = lambda kind, origin: events.where(F.col("event_type") == kind).groupBy("url").agg(F.max("ts").alias("ts")).withColumn("origin", F.lit(origin))
    place = F.row_number().over(W.partitionBy("url").orderBy(F.desc("ts"), "origin"))
    return one("view", "history").unionByName(one("click", "ad_hoc")).withColumn("place", place).where("place = 1").select("url", "origin", "ts")


@query("""select user_id, coalesce(last_ok, timestamp '1970-01-01') as last_ok, views from
    (select user_id, max(ts) filter (event_type = 'purchase') as last_ok, count(*) filter (event_type = 'view') as views from events group by 1)
    where coalesce(last_ok, timestamp '1970-01-01') < timestamp '2024-01-20' or views = 0""")
def stale_keys(spark, sf_dir):
    """Keys whose last success is older than a cutoff, or that have nothing yet."""
    when = lambda kind: F.when(F.col("event_type") == kind, F.col("ts"))
    keys = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(F.max(when("purchase")), F.timestamp_seconds(F.lit(0))).alias("last_ok"), F.count(when("view")).alias("views"))
    return keys.where((F.col("last_ok") < F.lit("2024-01-20").cast("timestamp")) | (F.col("views") == 0))


from . import artifact_queries, context_queries, page_queries, posting_queries, run_queries, scrub_queries, settings_queries, web_queries  # noqa: E402, F401  registers its queries

__all__ = ["ORACLES", "QUERIES"]
