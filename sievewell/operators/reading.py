"""What an evaluation says in words: reasons, five levels, a summary."""

from __future__ import annotations

from ..functions import lexicon as L, taxonomy as T
from ..functions.dialect import Spark
from .candidate import Candidate, alias, domain_hits
from .evaluation import REASONS
from .settings import Persona


def _texts(d: Spark, items: list[str]) -> str:
    """The items that are not null, in order."""
    return d.present(items)


def _labels(d: Spark, pairs: list[tuple[str, str]]) -> str:
    """The labels, three at most, whose condition holds, with commas; repeated ones once."""
    named = dict.fromkeys(label for _, label in pairs)
    tests = {label: " or ".join(c for c, other in pairs if other == label) for label in named}
    listed = d.present([f"case when {tests[n]} then {d.text(n)} end" for n in named] or ["cast(null as varchar(1))"])
    return d.glued(d.first_of(listed, "3"), d.text(", "))


def stages(d: Spark, persona: Persona, c: Candidate | None = None) -> list[dict[str, str]]:
    """Columns over the result of an evaluation and company_name, title, description; with a candidate, also txt, c_text and c_years, which the evaluation must keep."""
    pos = lambda *names: "(" + " or ".join(d.contains_item("positive_signals", n) for n in names) + ")"
    risk = lambda *names: "(" + " or ".join(d.contains_item("risk_signals", n) for n in names) + ")"
    rejected = f"{d.size('hard_reject_reasons')} > 0"
    low, high = persona.score_range
    affinity, stack, domain, seniority, fit = "false", "", "", "", []
    if c:
        themes = [d.inside("h_text", words) for words in T.AFFINITY_THEMES.values() if any(w in c.narrative.lower() for w in words)]
        shape = f"{domain_hits(d, 'h_text', c.generic(c.strong), True)} >= 1 or {domain_hits(d, 'h_text', c.generic(c.moderate), True)} >= 2"
        affinity = "(" + " or ".join([shape, *themes]) + ")"
        skills = _labels(d, [(d.inside("h_text", T.SKILLS[s]), T.skill_label(s, T.READING_SKILL_LABELS)) for s in c.skills])
        both = [*c.direct(c.strong), *c.direct(c.moderate)]
        domains = _labels(d, [(d.inside("h_text", T.DOMAINS[k]), T.domain_label(k, T.READING_DOMAIN_LABELS)) for k in both if k in T.DOMAINS])
        say = lambda signal, labels, some, none: f"case when not {pos(signal)} then null when {labels} <> '' then {d.text(some)} || {labels} || '.' else {d.text(none)} end"
        stack = say("candidate_stack_fit", skills, "There is direct stack overlap on ", "The shipped stack overlap looks direct enough for this role.")
        domain = say("candidate_domain_fit", domains, "The post maps well to your background in ", "The domain lines up directly with your recent experience.")
        senior = d.inside("lower(coalesce(title, ''))", L.SENIOR_ROLE_KEYWORDS)
        seniority = (
            f"case when not {pos('candidate_seniority_fit')} then null"
            f" when h_years > 0 then 'The seniority bar looks fine: the role asks for ' || cast(h_years as varchar(9)) || '+ years and your profile shows {c.years} years.'"
            f" when {senior} then 'The role is explicitly senior-level and your profile already sits above that bar.' else 'The seniority level looks compatible with your profile.' end"
        )
        matched = _labels(d, [(alias(d, "c_text", [s]), T.skill_label(s)) for s in c.skills])
        known = _labels(d, [(d.any_of("txt", T.DOMAINS[k]), T.domain_label(k)) for k in both if k in T.DOMAINS])
        fit = [
            say("candidate_stack_fit", matched, "Candidate stack fit evidence: requirements overlap with your shipped skills in ", "Candidate stack fit evidence: multiple stated requirements overlap with your shipped stack."),
            say("candidate_domain_fit", known, "Candidate domain fit evidence: the post aligns with your background in ", "Candidate domain fit evidence: the domain language lines up with your recent direct experience."),
            f"case when {pos('candidate_seniority_fit')} then case when c_years > 0 then 'Candidate seniority fit evidence: the role asks for ' || cast(c_years as varchar(9)) || '+ years and your profile shows {c.years} years.'"
            f" else 'Candidate seniority fit evidence: the role reads senior enough for your {c.years} years of experience.' end end",
        ]
    listing = lambda column, label: f"case when {d.size(column)} > 0 then '{label}: ' || {d.glued(column, d.text(', '))} || '.' else '{label}: none.' end"
    number = lambda x: f"cast({x} as varchar(12))"
    hard = [f"case when {d.contains_item('hard_reject_reasons', r)} then 'Hard filter triggered: {r}.' end" for r in REASONS.values()]
    opaque = f"({d.contains_item('hard_reject_reasons', REASONS['salary'])} or {risk('salary_low_confidence')})"
    domain_or = f"coalesce({domain}, " if domain else "("
    why = [
        stack or "cast(null as varchar(1))",
        seniority or "cast(null as varchar(1))",
        f"{domain_or}case when domain_fit = 'MIXED' and h_affinity then 'There is adjacent domain potential from your background and education.' when execution_fit = 'STRONG' then 'The execution fit looks strong for your current senior backend profile.' end)",
        f"case when {pos('english_environment')} or access_fit = 'STRONG' then 'English collaboration evidence is present in the post.' end",
        f"case when {pos('remote_friendly', 'hybrid_work')} then 'The work policy looks compatible with your preferences.' end",
        "case when h_structured or opportunity_quality = 'STRONG' then 'The post includes concrete working-condition details instead of pure marketing.' end",
    ]
    waste = [
        "case when h_opaque then 'Salary is opaque, so interview ROI is hard to justify under this persona.' end",
        f"case when {risk('language_friction_critical')} or access_fit = 'WEAK' then 'Japanese looks like a real gate for getting through the process.' when {risk('japanese_assignment_dependency')} then 'Team placement may still depend on Japanese ability.' end",
        f"case when {risk('consulting_risk')} then 'It still looks intermediary-driven rather than a direct product opportunity.' end",
        "case when execution_fit = 'WEAK' then 'The implementation expectations look materially outside your current shipped fit.' end",
        "case when opportunity_quality = 'WEAK' then 'The posting quality looks too weak or too vague to invest process energy.' end",
    ]
    up, down = f"coalesce({d.at('why_still_interesting', '1')}, '')", f"coalesce({d.at('why_waste_of_time', '1')}, '')"
    return [
        {"h_text": "lower(coalesce(title, '') || '\n' || coalesce(description, '') || '\n' || coalesce(company_name, ''))"},
        {
            "h_years": f"coalesce({d.largest(d.each(d.extract_all('h_text', L.YEARS_EXPERIENCE_PATTERN), lambda x: f'try_cast({x} as int)'))}, 0)",
            "h_structured": d.inside("h_text", T.STRUCTURED_CONDITIONS),
            "h_affinity": affinity,
            "h_opaque": opaque,
            "h_good": f"(case when {pos('salary_transparency')} then 1 else 0 end + case when {pos('remote_friendly', 'hybrid_work')} then 1 else 0 end + case when {pos('work_life_balance', 'real_flextime', 'low_overtime_disclosed')} then 1 else 0 end"
            f" + case when {pos('stability', 'company_reputation_positive')} or company_reputation_index >= 65 then 1 else 0 end)",
            "h_risk": risk("consulting_risk", "company_reputation_risk_high", "workload_policy_risk", "overtime_risk"),
            "access_fit": f"case when {risk('language_friction_critical')} or language_friction_index >= 85 then 'WEAK' when {risk('japanese_assignment_dependency', 'language_friction')} or language_friction_index >= 20 then 'MIXED'"
            f" when {pos('english_environment', 'global_team_collaboration', 'english_support_environment')} then 'STRONG' else 'MIXED' end",
            "execution_fit": f"case when {pos('candidate_stack_fit')} and {pos('candidate_seniority_fit')} and not {risk('candidate_stack_gap', 'candidate_seniority_mismatch')} then 'STRONG'"
            f" when {risk('candidate_stack_gap', 'candidate_seniority_mismatch')} and not {pos('candidate_stack_fit', 'candidate_seniority_fit')} then 'WEAK' else 'MIXED' end",
        },
        {
            "domain_fit": f"case when {pos('candidate_domain_fit')} then 'STRONG' when h_affinity then 'MIXED' when {risk('candidate_domain_gap')} then 'WEAK' else 'MIXED' end",
            "opportunity_quality": f"case when {risk('anonymous_employer_risk', 'generic_marketing_post_risk', 'vague_conditions_risk')} then 'WEAK' when not h_opaque and h_good >= 3 and not h_risk then 'STRONG'"
            " when h_opaque and h_structured and h_good >= 1 then 'MIXED' when h_risk and h_good = 0 then 'WEAK' else 'MIXED' end",
        },
        {
            "interview_roi": f"case when {rejected} or access_fit = 'WEAK' or opportunity_quality = 'WEAK' then 'WEAK' when access_fit = 'STRONG' and execution_fit = 'STRONG' and opportunity_quality = 'STRONG' then 'STRONG' else 'MIXED' end",
            "why_still_interesting": d.first_of(_texts(d, why), "3"),
            "waste": _texts(d, waste),
            "reasoning": _texts(
                d,
                [
                    *hard,
                    listing("positive_signals", "Positive signals"),
                    listing("risk_signals", "Risk signals"),
                    *fit,
                    f"'Raw weighted score: ' || {number('raw_score')} || ' (range {low} to {high}).'",
                    f"'Normalized score: ' || {number('score')} || '/100.'",
                    f"'Language friction index: ' || {number('language_friction_index')} || '/100.'",
                    f"'Company reputation index: ' || {number('company_reputation_index')} || '/100.'",
                    f"case when {rejected} then 'Final verdict forced to NO_GO due to hard filters.' else 'Final verdict derived from weighted score: ' || verdict || '.' end",
                ],
            ),
        },
        {"why_waste_of_time": f"case when {d.size('waste')} = 0 and verdict = 'NO_GO' then {d.strings([d.text('This persona would still screen it out before it becomes interview-worthy.')])} else {d.first_of('waste', '3')} end"},
        {
            "summary": f"case interview_roi when 'STRONG' then case when {up} = '' then 'Worth serious consideration.' else 'Worth serious consideration: ' || {up} end"
            f" when 'MIXED' then case when {up} <> '' and {down} <> '' then 'Mixed call: ' || {up} || ' Main caution: ' || {down} when {up} <> '' then 'Mixed call: ' || {up} when {down} <> '' then 'Mixed call: ' || {down} else 'Mixed call overall.' end"
            f" else case when {down} <> '' and {up} <> '' then 'Likely low interview ROI: ' || {down} || ' Main upside: ' || {up} when {down} <> '' then 'Likely low interview ROI: ' || {down} else 'Likely low interview ROI.' end end"
        },
    ]


COLUMNS = ("access_fit", "execution_fit", "domain_fit", "opportunity_quality", "interview_roi", "summary", "why_still_interesting", "why_waste_of_time", "reasoning")
