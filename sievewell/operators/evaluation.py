"""Signals, hard filters, indices, score and verdict of postings.

All of it is one narrow projection without join or shuffle: staged column
expressions, and one pass in Arrow batches that tells which words of all lists
stand in a text, as bits that the expressions test. Companies, personas and word lists are small settings that
become literals of the plan. The stages are SQL in either dialect, so the
oracle's SQL says the same to another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import lexicon as L
from ..functions.catalogue import POSITIVE, RISK
from ..functions.dialect import Marked, Spark
from ..functions.marks import marker
from ..session import small_methods, workers_import
from .settings import BLACKLIST, COMPANIES, Company, Persona

UNKNOWN_COMPANY = "Unknown Company"
REASONS = {
    "consulting": "consulting / dispatch indicators detected",
    "onsite": "onsite-only work policy detected",
    "salary": "salary information is missing or non-transparent",
    "startup": "early-stage startup indicators detected",
    "overtime": "abusive overtime indicators detected",
    "japanese": "critical Japanese-only communication environment detected",
    "overload": "overload workload policy detected (no fixed hours + minimum weekly commitment + overtime pressure)",
    "relocation": "company-controlled overseas relocation risk detected",
}
_DASHES = ("-", "–", "—", "~", "〜", "～", " to ")
#: Signals whose rule reads the persona; all others are the same for every persona.
_OF_PERSONA = ("salary_below_persona_floor", "onsite_bias")
_CANDIDATE = ("candidate_stack_fit", "candidate_domain_fit", "candidate_seniority_fit", "candidate_stack_gap", "candidate_domain_gap", "candidate_seniority_mismatch")


def same_company(d: Spark, name: str, other: str) -> str:
    """Two normalised names are equal or one holds the other; an empty name is in every other."""
    return f"({name} = {other} or contains({name}, {other}) or contains({other}, {name}))"


def company_number(d: Spark, name: str, companies) -> str:
    """The place, from 1, of the first tracked company that the name matches, else 0."""
    cases = " ".join(f"when {same_company(d, name, d.text(c.name.strip().lower()))} then {i}" for i, c in enumerate(companies, 1))
    return f"case {cases} else 0 end" if cases else "0"


def _inputs(d: Spark, companies, blacklist, extra: str) -> list[dict[str, str]]:
    listed = " or ".join(same_company(d, "n_company", d.text(b.strip().lower())) for b in blacklist) or "false"
    job = f"coalesce(company_name, '') || ' ' || coalesce(title, '') || ' ' || coalesce(description, '')"
    flag = lambda test: f"(tracked in ({', '.join(str(i) for i, c in enumerate(companies, 1) if test(c)) or '-1'}))"
    tag = lambda t: flag(lambda c: t in c.profile_tags)
    risk = lambda t: flag(lambda c: t in c.risk_tags)
    return [
        {"n_company": d.norm("company_name"), "n_title": d.norm("title"), "n_description": d.norm("description"), "remote": d.norm("remote_policy"), "salary": d.norm("salary_range")},
        {"tracked": company_number(d, "n_company", companies), "blacklisted": f"({listed})"},
        {
            "txt": d.norm(f"{d.norm(job)} || ' ' || coalesce({d.pick('tracked', [d.text(c.context) for c in companies])}, '') || ' ' || {d.norm(extra)}"),
            **{f"t_{t}": tag(t) for t in ("expat_friendly", "engineering_brand", "strong_wlb", "stable_public", "product_leader", "reputation_strong")},
            **{f"r_{t}": risk(t) for t in ("language_friction_high", "reputation_risk", "layoff_risk", "overtime_risk")},
            "english_site": flag(lambda c: c.english_site),
            "japanese_site": flag(lambda c: c.japanese_site),
            "product_hint": flag(lambda c: "product" in c.type_hint.strip().lower()),
        },
        *([{column: d.padded(x) for x, column in d.word_columns.items()}] if d.word_columns else []),
    ]


def _salary(d: Spark, words=L) -> list[dict[str, str]]:
    number = lambda x: f"cast(replace({x}, ',', '') as double)"
    scale = lambda y: f"case {y} when 'm' then 1000000 when 'million' then 1000000 when 'k' then 1000 else 1 end"
    yen = lambda x, k: f"cast(round({number(x)} * {k}) as bigint)"
    grouped = lambda x: f"cast(replace(replace({x}, ',', ''), '.', '') as bigint)"
    p = words.SALARY_ORDERED_TOKEN_PATTERN
    span = " or ".join(f"contains(salary, {d.text(s)})" for s in _DASHES)
    return [
        {
            "s_values": d.pairs(d.extract_all("salary", p, 1), d.extract_all("salary", p, 2), lambda x, y: yen(x, scale(y))),
            "s_missing_word": d.any_of("salary", words.SALARY_MISSING_KEYWORDS),
            "s_millions": d.largest(d.each(d.extract_all("salary", words.SALARY_MILLION_PATTERN, 1), lambda x: yen(x, "1000000"))),
            "s_numbers": d.largest(d.each(d.extract_all("salary", words.SALARY_NUMBER_PATTERN, 1), grouped)),
        },
        {
            "s_explicit": f"(salary <> '' and not s_missing_word and {d.size('s_values')} >= 2 and ({span} or (contains(salary, 'between') and contains(salary, ' and '))))",
            "s_anomaly": f"(salary <> '' and {d.size('s_values')} >= 2 and coalesce({d.at('s_values', '1')} > {d.at('s_values', '2')}, false))",
            "s_upper": "cast(case when coalesce(s_millions, 0) > 0 then s_millions else coalesce(s_numbers, 0) end as bigint)",
            "s_low": d.at("s_values", "1"),
            "s_high": d.at("s_values", "-1"),
        },
        {"s_missing": "(salary = '' or s_missing_word or not s_explicit)", "s_transparent": "(s_explicit and not s_anomaly)"},
    ]


def _language(d: Spark, words=L) -> list[dict[str, str]]:
    w = lambda words: d.any_of("txt", words)
    p = lambda patterns: d.any_pattern("txt", patterns)
    return [
        {
            "l_word": w(words.LANGUAGE_REQUIRED_KEYWORDS),
            "l_pattern": p(words.LANGUAGE_REQUIRED_PATTERNS),
            "l_medium": w(words.LANGUAGE_MEDIUM_HIGH_FRICTION_KEYWORDS),
            "l_high": w(words.LANGUAGE_HIGH_FRICTION_KEYWORDS),
            "l_assigned": f"({w(words.LANGUAGE_ASSIGNMENT_DEPENDENT_KEYWORDS)} or {p(words.LANGUAGE_ASSIGNMENT_DEPENDENCY_PATTERNS)})",
            "l_optional": f"({w(words.LANGUAGE_OPTIONAL_OR_EXEMPT_KEYWORDS)} or {p(words.LANGUAGE_OPTIONAL_PATTERNS)})",
            "l_soft": w(words.LANGUAGE_FRICTION_SOFT_KEYWORDS),
            "l_internal": f"({w(words.JAPANESE_INTERNAL_ONLY_KEYWORDS)} or {p(words.JAPANESE_INTERNAL_ONLY_PATTERNS)})",
            "e_friendly": f"(contains(txt, 'english') or {w(words.LANGUAGE_ENGLISH_FRIENDLY_KEYWORDS)} or english_site)",
            "e_support": w(words.LANGUAGE_ENGLISH_SUPPORT_ENVIRONMENT_KEYWORDS),
        },
        {
            # Where both are said, a requirement stands only if it is a clear one.
            "l_required": "((l_word or l_pattern) and (not l_optional or l_high or l_medium or l_pattern))",
            "l_critical": "((l_medium or l_high or l_word or l_pattern) and l_internal)",
        },
        {"f_base": f"case when l_required then 75 when l_assigned then {words.LANGUAGE_ASSIGNMENT_DEPENDENT_BASE_INDEX} when l_optional then 5 when l_soft then 45 else 0 end"},
        {"f_raised": "greatest(f_base, case when l_medium then 85 else 0 end, case when l_high then 95 else 0 end, case when l_critical then 100 else 0 end, case when r_language_friction_high then 70 else 0 end)"},
        {"f_eased": "f_raised - case when not l_required and e_friendly then 10 else 0 end - case when not l_required and english_site then 5 else 0 end + case when not l_required and japanese_site and not english_site then 3 else 0 end"},
        {"f_capped": f"least(f_eased, case when not l_required and e_support then {words.LANGUAGE_ENGLISH_SUPPORT_MAX_INDEX} else 1000 end, case when not l_required and l_optional then 15 else 1000 end)"},
        {"language_friction_index": f"cast(least(100, greatest(0, f_capped, case when not l_required and l_assigned then {words.LANGUAGE_ASSIGNMENT_DEPENDENT_MIN_INDEX} else 0 end)) as int)"},
    ]


def _reputation(d: Spark, words=L) -> list[dict[str, str]]:
    good, bad = d.hits("txt", words.REPUTATION_POSITIVE_KEYWORDS), d.hits("txt", words.REPUTATION_RISK_KEYWORDS)
    tags = "50 + case when t_reputation_strong then 20 else 0 end + case when t_stable_public then 8 else 0 end - case when r_reputation_risk then 22 else 0 end - case when r_layoff_risk then 22 else 0 end"
    return [{"company_reputation_index": f"cast(least(100, greatest(0, {tags} + least(18, 6 * {good}) - least(32, 8 * {bad}))) as int)"}]


def _flags(d: Spark, words=L) -> list[dict[str, str]]:
    w = lambda words: d.any_of("txt", words)
    title = lambda words: d.any_of("n_title", words)
    return [
        {
            "onsite_only": f"(not {d.any_of('remote', words.REMOTE_OR_HYBRID_KEYWORDS)} and {d.any_of('remote', words.ONSITE_ONLY_KEYWORDS)})",
            "consulting": f"(blacklisted or {w(words.CONSULTING_HARD_KEYWORDS)})",
            "startup": w(words.STARTUP_RISK_KEYWORDS),
            "pressed": f"({w(words.WORKLOAD_PRESSURE_KEYWORDS)} or {w(words.WORK_LIFE_BALANCE_OVERTIME_RISK_KEYWORDS)})",
            "no_hours": w(words.WORKLOAD_NO_FIXED_HOURS_KEYWORDS),
            "min_week": w(words.WORKLOAD_MIN_WEEKLY_COMMITMENT_KEYWORDS),
            "manages": w(words.ROLE_MANAGER_SCOPE_KEYWORDS),
            "manager_title": title(words.ROLE_MANAGER_TITLE_KEYWORDS),
            "between": d.hits("txt", words.INTERMEDIARY_CONTRACT_KEYWORDS),
            "marketing": d.hits("txt", words.JOB_POST_QUALITY_GENERIC_MARKETING_RISK_KEYWORDS),
            "position": d.norm(d.extract("n_description", words.POSITION_LABEL_PATTERN)),
            "flextime": f"({d.inside('txt', words.REAL_FLEXTIME_KEYWORDS)} or {d.matches('txt', words.CORE_TIME_WINDOW_PATTERN)})",
            "overtime_hours": f"try_cast(nullif({d.extract('txt', words.AVERAGE_OVERTIME_HOURS_PATTERN)}, '') as int)",
        },
        {
            "intermediary": f"(between >= 2 or (between >= 1 and {d.hits('txt', words.APPLICATION_PROCESS_TEMPLATE_KEYWORDS)} >= 3 and {d.matches('txt', words.GENERIC_DESIRED_SKILLS_ENGINEER_PATTERN)}))",
            "title_software": title(words.ROLE_SOFTWARE_KEYWORDS),
            "title_other": title(words.ROLE_NON_SOFTWARE_MISMATCH_KEYWORDS),
            "position_software": d.any_of("position", words.ROLE_SOFTWARE_KEYWORDS),
            "position_other": d.any_of("position", words.ROLE_NON_SOFTWARE_MISMATCH_KEYWORDS),
        },
        {"s_benchmark": f"case when {d.size('s_values')} >= 2 and s_low <= s_high then s_low + {d.div('(s_high - s_low)', 'case when consulting or intermediary then 4 else 2 end')} else s_upper end"},
    ]


def signal_rules(d: Spark, persona: Persona, candidate: dict[str, str] | None = None, words=L) -> dict[str, str]:
    """The condition of every signal, over the staged columns."""
    w = lambda words: d.any_of("txt", words)
    s = lambda words: d.inside("txt", words)
    rules = {
        "salary_transparency": "s_transparent",
        "hybrid_work": "contains(remote, 'hybrid')",
        "remote_friendly": "contains(remote, 'remote')",
        "english_environment": "(e_friendly or t_expat_friendly)",
        "product_company": f"(product_hint or {w(words.PRODUCT_COMPANY_KEYWORDS)} or t_product_leader)",
        "engineering_culture": f"({w(words.ENGINEERING_CULTURE_KEYWORDS)} or t_engineering_brand)",
        "engineering_environment": w(words.ENGINEERING_ENVIRONMENT_POSITIVE_KEYWORDS),
        "inhouse_product_engineering": w(words.INHOUSE_PRODUCT_ENGINEERING_KEYWORDS),
        "global_team_collaboration": w(words.GLOBAL_TEAM_COLLABORATION_KEYWORDS),
        "english_support_environment": "e_support",
        "visa_sponsorship_support": w(words.VISA_SPONSORSHIP_SUPPORT_KEYWORDS),
        "work_life_balance": f"({w(words.WORK_LIFE_BALANCE_KEYWORDS)} or t_strong_wlb)",
        "stability": f"(tracked > 0 or {w(words.STABILITY_KEYWORDS)} or contains(n_company, 'corp') or contains(n_company, 'inc'))",
        "product_pm_collaboration": f"({s(words.PM_COLLABORATION_KEYWORDS)} and {s(words.PRODUCT_DELIVERY_KEYWORDS)})",
        "engineering_maturity": f"{d.inside_hits('txt', words.ENGINEERING_MATURITY_KEYWORDS)} >= 2",
        "casual_interview": s(words.CASUAL_INTERVIEW_KEYWORDS),
        "async_communication": s(words.ASYNC_COMMUNICATION_KEYWORDS),
        "real_flextime": "flextime",
        "low_overtime_disclosed": "coalesce(overtime_hours <= 15, false)",
        "company_reputation_positive": "company_reputation_index >= 65",
        "company_reputation_positive_strong": "company_reputation_index >= 85",
        "salary_low_confidence": "s_missing",
        "salary_below_persona_floor": f"({persona.minimum_salary_yen} > 0 and s_transparent and s_benchmark > 0 and s_benchmark < {persona.minimum_salary_yen})",
        "onsite_bias": f"case when onsite_only then {'false' if 'onsite_only' in persona.hard_no else 'true'} else contains(remote, 'onsite') or contains(remote, 'office') end",
        "japanese_assignment_dependency": "l_assigned",
        "language_friction": "(l_required or l_assigned or (not l_optional and l_soft) or (r_language_friction_high and not e_support and not l_optional))",
        "language_friction_critical": "l_critical",
        "overtime_risk": f"({w(words.WORK_LIFE_BALANCE_OVERTIME_RISK_KEYWORDS)} or r_overtime_risk)",
        "engineering_environment_risk": w(words.ENGINEERING_ENVIRONMENT_RISK_KEYWORDS),
        "role_mismatch_manager_vs_ic_title": f"(n_title <> '' and manages and {d.any_of('n_title', words.ROLE_IC_TITLE_KEYWORDS)} and not manager_title)",
        "role_identity_mismatch": "(n_title <> '' and position <> '' and ((title_software and position_other and not position_software) or (title_other and position_software and not title_software)))",
        "intermediary_contract_risk": "intermediary",
        "anonymous_employer_risk": f"(coalesce(company_name, '') = {d.text(UNKNOWN_COMPANY)} and {w(words.ANONYMOUS_EMPLOYER_RISK_KEYWORDS)})",
        "generic_marketing_post_risk": f"(marketing >= {words.JOB_POST_QUALITY_GENERIC_MARKETING_RISK_HIT_MIN} or (coalesce(company_name, '') = {d.text(UNKNOWN_COMPANY)} and marketing >= 1))",
        "vague_conditions_risk": f"({w(words.JOB_POST_QUALITY_CONDITIONS_SECTION_KEYWORDS)} and {d.hits('txt', words.JOB_POST_QUALITY_VAGUE_CONDITIONS_RISK_KEYWORDS)} >= {words.JOB_POST_QUALITY_VAGUE_CONDITIONS_RISK_HIT_MIN} and not {w(words.JOB_POST_QUALITY_CONCRETE_CONDITIONS_KEYWORDS)})",
        "inclusion_contradiction": f"({w(words.FOREIGN_WELCOME_KEYWORDS)} and l_internal)",
        "pre_ipo_risk": w(words.PRE_IPO_RISK_KEYWORDS),
        "manager_scope_salary_misaligned": "(s_transparent and (manages or manager_title) and s_upper > 0 and s_upper <= 9000000)",
        "workload_policy_risk": "(case when no_hours then 1 else 0 end + case when min_week then 1 else 0 end + case when pressed then 1 else 0 end >= 2)",
        "holiday_policy_risk": w(words.WORK_LIFE_BALANCE_HOLIDAY_POLICY_RISK_KEYWORDS),
        "location_mobility_risk": w(words.MOBILITY_LOCATION_MOBILITY_RISK_KEYWORDS),
        "salary_range_anomaly": "s_anomaly",
        "debt_first_culture_risk": w(words.DEBT_FIRST_CULTURE_RISK_KEYWORDS),
        "hypergrowth_execution_risk": w(words.HYPERGROWTH_EXECUTION_RISK_KEYWORDS),
        "startup_risk": "startup",
        "consulting_risk": "consulting",
        "algorithmic_interview_risk": f"{d.inside_hits('txt', words.ALGORITHMIC_INTERVIEW_KEYWORDS)} >= 2",
        "pressure_culture_risk": f"({s(words.PRESSURE_CULTURE_STRONG_KEYWORDS)} or {d.inside_hits('txt', words.PRESSURE_CULTURE_KEYWORDS)} >= 2)",
        "fake_flextime_risk": f"(not flextime and {s(words.GENERIC_FLEXTIME_KEYWORDS)})",
        "traditional_corporate_process_risk": s(words.TOEIC_KEYWORDS + words.TRADITIONAL_CORPORATE_PROCESS_KEYWORDS),
        "customer_site_risk": s(words.CUSTOMER_SITE_KEYWORDS),
        "company_reputation_risk": "company_reputation_index <= 40",
        "company_reputation_risk_high": "company_reputation_index <= 20",
    }
    return rules | dict.fromkeys(_CANDIDATE, "false") | (candidate or {})


def _hard_filters(d: Spark, persona: Persona, words=L) -> list[str]:
    control = f"({d.any_of('txt', words.LOCATION_CHANGE_BY_COMPANY_KEYWORDS)} and {d.any_of('txt', words.LOCATION_OVERSEAS_TRANSFER_KEYWORDS)})"
    ordered = [
        ("consulting", "consulting_company", "consulting"),
        ("onsite", "onsite_only", "onsite_only"),
        ("salary", "salary_missing", "s_missing"),
        ("startup", "early_stage_startup", "startup"),
        ("overtime", None, d.any_of("txt", words.ABUSIVE_OVERTIME_KEYWORDS)),
        ("japanese", "japanese_only_environment", "l_critical"),
        ("overload", "workload_overload", "(no_hours and min_week and pressed)"),
        ("relocation", "forced_relocation", control),
    ]
    return [f"case when {rule} then {d.text(REASONS[reason])} end" for reason, hard_no, rule in ordered if hard_no is None or hard_no in persona.hard_no]


def stages(d: Spark, persona: Persona, companies=COMPANIES, blacklist=BLACKLIST, extra: str = "''", candidate: list[dict[str, str]] | None = None, words=L) -> list[dict[str, str]]:
    """The columns to add, stage by stage; each may read those of the stages before it. ``words``: the word lists and thresholds, as settings may replace them."""
    candidate = candidate or []
    rules = signal_rules(d, persona, candidate[-1] if candidate else None, words)
    own = {k: v for k, v in rules.items() if k in _OF_PERSONA}
    found = {f"sig_{k}": v for k, v in rules.items() if k not in own}
    named = lambda table: d.present([f"case when {own.get(s[0], 'sig_' + s[0])} then {d.text(s[0])} end" for s in table])
    weigh = lambda column, weight, table: d.total(d.each(column, lambda x: f"case {x} " + " ".join(f"when {d.text(s[0])} then {weight(*s)}" for s in table) + " else 0 end"))
    low, high = persona.score_range
    ratio = f"(raw_score - ({low})) * 100.0 / ({high} - ({low}))" if high > low else "50.0"
    return [
        *_inputs(d, companies, blacklist, extra),
        *_salary(d, words),
        *_language(d, words),
        *_reputation(d, words),
        *_flags(d, words),
        *candidate[:-1],
        found,
        {"positive_signals": named(POSITIVE), "risk_signals": named(RISK), "hard_reject_reasons": d.present(_hard_filters(d, persona, words) or ["cast(null as string)"])},
        {"raw_score": f"cast({weigh('positive_signals', persona.positive_weight, POSITIVE)} - {weigh('risk_signals', persona.risk_weight, RISK)} as int)"},
        {
            "verdict": f"case when {d.size('hard_reject_reasons')} > 0 then 'NO_GO' when raw_score >= 8 then 'GO' when raw_score >= 1 then 'GO_WITH_CAUTION' else 'NO_GO' end",
            "score": f"cast(least(case when {d.size('hard_reject_reasons')} > 0 then 20 else 100 end, 100, greatest(0, floor(cast({ratio} as double) + 0.5))) as int)",
        },
    ]


RESULT = ("verdict", "score", "raw_score", "language_friction_index", "company_reputation_index", "hard_reject_reasons", "positive_signals", "risk_signals")


def evaluate(postings: DataFrame, persona: Persona, companies=COMPANIES, blacklist=BLACKLIST, context: str | None = None, candidate: list[dict[str, str]] | None = None, keep: tuple[str, ...] = (), words=L, d: Marked | None = None) -> DataFrame:
    """Adds the result columns to postings (company_name, title, salary_range, remote_policy, description), and staged columns to keep.

    ``d``: the dialect that the candidate's stages were made by, and what else reads marks that are kept; others may be made by ``WORDED``.
    """
    kept, d = postings.columns, d or Marked()
    out = _marked(postings, stages(d, persona, companies, blacklist, context or "''", candidate, words), d)
    return _fenced(out, [*kept, *RESULT, *keep])


def _marked(df: DataFrame, added: list[dict[str, str]], d: Marked) -> DataFrame:
    """The stages' columns, and the marks of each text after the stage that makes it."""
    small_methods(workers_import(df.sparkSession))
    ready: set[str] = set()
    for stage in added:
        df = df.selectExpr("*", *[f"{e} as {name}" for name, e in stage.items()])
        ready |= stage.keys() & d.words.keys()
        if ready == d.words.keys():
            # All at once, so that texts go to Python and back one time.
            found = {d.marks_of(x): F.arrow_udf(marker(list(d.words[x])), "array<bigint>")(x) for x in d.words if d.words[x]}
            df, ready = df.withColumns(found), set()
    return df


def _fenced(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns behind a generator of one row: a filter on one of them is not inlined into all that it is computed from."""
    return df.selectExpr(f"inline(array(struct({', '.join(f'`{c}`' for c in columns)})))")


def staged(df: DataFrame, added: list[dict[str, str]], columns) -> DataFrame:
    """The columns of ``df`` and ``columns``, which the stages compute."""
    small_methods(df.sparkSession)
    kept = df.columns
    for stage in added:
        df = df.selectExpr("*", *[f"{e} as {name}" for name, e in stage.items()])
    return _fenced(df, [*kept, *columns])


def staged_sql(source: str, added: list[dict[str, str]]) -> str:
    """The same as a SQL text, with all columns of all stages."""
    for i, stage in enumerate(added):
        source = f"(with t{i} as materialized (select * from {source}) select *, {', '.join(f'{e} as {name}' for name, e in stage.items())} from t{i})"
    return source


def evaluate_sql(source: str, persona: Persona, d: Spark, companies=COMPANIES, blacklist=BLACKLIST, candidate: list[dict[str, str]] | None = None) -> str:
    """The same as a SQL text over a table or subquery; stages are materialised, or an engine may inline them over and over."""
    out = source
    for i, stage in enumerate(stages(d, persona, companies, blacklist, candidate=candidate)):
        columns = ", ".join(f"{e} as {name}" for name, e in stage.items())
        out = f"(with s{i} as materialized (select * from {out}) select *, {columns} from s{i})"
    return f"(with result as materialized (select * from {out}) select * from result)"


def all_personas(postings: DataFrame, personas, companies=COMPANIES, blacklist=BLACKLIST, candidate: list[dict[str, str]] | None = None) -> DataFrame:
    """Every persona judges every posting: one scan and one pass over the texts, a row per posting and persona."""
    kept, out = postings.columns, postings
    d = Marked()
    each = [stages(d, p, companies, blacklist, candidate=candidate) for p in personas]
    out = _marked(out, each[0][:-3], d)
    out = out.selectExpr("*", f"explode(sequence(0, {len(personas) - 1})) as who")
    by_persona = lambda values: "case who " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"
    for step in (-3, -2, -1):
        out = out.selectExpr("*", *[f"{by_persona([steps[step][n] for steps in each])} as {n}" for n in each[0][step]])
    names = by_persona([d.text(p.name) for p in personas])
    return out.selectExpr(f"{names} as persona", *kept, *RESULT)
