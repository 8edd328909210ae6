"""How a posting fits a candidate: requirement lines, skills, domains, seniority.

A profile is a setting of one row, so its lists are literals of the plan; a
posting's lines stay one array, read by expressions, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..functions import lexicon as L, taxonomy as T
from ..functions.dialect import Spark


@dataclass(frozen=True)
class Candidate:
    """A candidate's profile."""

    name: str = "candidate"
    years: int = 0
    production: tuple[str, ...] = ()
    learning: tuple[str, ...] = ()
    strong: tuple[str, ...] = ()
    moderate: tuple[str, ...] = ()
    limited: tuple[str, ...] = ()
    narrative: str = ""

    @property
    def skills(self) -> tuple[str, ...]:
        return T.skill_ids(self.production)

    def direct(self, domains: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(d for d in domains if d not in T.GENERIC_DOMAINS)

    def generic(self, domains: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(d for d in domains if d in T.GENERIC_DOMAINS)


#: An invented profile for the registered queries.
CANDIDATE = Candidate("backend", 6, ("Java 17", "Spring Boot", "AWS", "PostgreSQL", "REST APIs"), ("Kubernetes",), ("ecommerce_platforms", "payment_integrations", "system_design"), ("cloud_basics", "data_pipelines", "omnichannel_retail"), ("mobile_cross_platform",), "retail platforms and mobile games")


#: Begins a section of lines within the text they are glued to.
_SECTION = "\x1e"


def alias(d: Spark, x: str, skills) -> str:
    """Any alias of the skills between signs that are neither letter nor digit."""
    words = [a for s in skills for a in T.SKILLS[s]]
    if not words:
        return "false"
    return f"({d.inside(x, words)} and {d.matches(x, '(^|[^a-z0-9])(?:' + '|'.join(map(d.escaped, words)) + ')([^a-z0-9]|$)')})"


def domain_hits(d: Spark, x: str, domains, inside: bool = False) -> str:
    """How many of the domains a text tells of."""
    found = d.inside if inside else d.any_of
    return "(0" + "".join(f" + case when {found(x, T.DOMAINS[k])} then 1 else 0 end" for k in domains if k in T.DOMAINS) + ")"


def stages(d: Spark, c: Candidate) -> list[dict[str, str]]:
    """Staged columns; the last stage is the rules of the six signals. They read n_title, txt and description."""
    # Lines are trimmed, so none begins with the sign that begins a section; a section's first letter tells its kind.
    kind = lambda x: f"case when {d.any_of(x, L.CANDIDATE_REQUIREMENT_SECTION_KEYWORDS)} then {d.text(_SECTION + '2')} when {d.any_of(x, L.CANDIDATE_NON_REQUIREMENT_SECTION_KEYWORDS)} then {d.text(_SECTION + '1')} else '' end"
    of_section = lambda s: d.keep(d.split_on(f"substr({s}, 2)", r"\n"), lambda x: f"{x} <> '' and (left({s}, 1) = '2' or (left({s}, 1) = '0' and {d.any_of(x, L.CANDIDATE_REQUIREMENT_LINE_HINTS)}))")
    shape = "false"
    if {"distributed_product_systems", "system_design"} & {*c.strong, *c.moderate}:
        shape = alias(d, "x", ["microservices"])
    count = lambda test: d.size(d.keep("c_required", lambda x: test))
    broad = "(0" + "".join(f" + case when {alias(d, 'c_text', [s])} then 1 else 0 end" for s in c.skills) + ")"
    in_domain = f"({domain_hits(d, 'txt', c.direct(c.strong))} >= 1 or {domain_hits(d, 'txt', c.direct(c.moderate))} >= 2)"
    return [
        {"c_lines": d.keep(d.each(d.lines("coalesce(description, '')"), d.norm), lambda x: f"{x} <> ''")},
        {"c_sections": d.split_on(f"'0' || {d.text(chr(10))} || {d.glued(d.each('c_lines', lambda x: f'{kind(x)} || {x}'), d.text(chr(10)))}", r"\n" + _SECTION)},
        {"c_required": f"flatten({d.each('c_sections', of_section, 's')})"},
        {
            "c_text": d.glued("c_required", d.text("\n")),
            "c_years": f"coalesce({d.largest(d.each(d.extract_all('txt', L.YEARS_EXPERIENCE_PATTERN), lambda x: f'try_cast({x} as int)'))}, 0)",
            "c_junior": d.any_pattern("n_title", L.JUNIOR_MID_TITLE_PATTERNS),
            "c_senior": d.any_of("n_title", L.SENIOR_ROLE_KEYWORDS),
            "c_domain": in_domain,
        },
        {
            "candidate_stack_fit": f"({alias(d, 'c_text', c.skills)} and ({broad} >= 2 or {count(alias(d, 'x', c.skills))} >= 2))",
            "candidate_domain_fit": "c_domain",
            "candidate_seniority_fit": f"case when c_years > 0 and c_years <= {c.years} then not c_junior else c_senior and {c.years} >= 5 end",
            "candidate_stack_gap": f"{alias(d, 'c_text', T.SKILLS)} and {count(f'{alias(d, chr(120), T.SKILLS)} and not {alias(d, chr(120), c.skills)} and not {shape}')} > 0",
            "candidate_domain_gap": f"({domain_hits(d, 'txt', c.direct(c.limited))} > 0 and not c_domain)",
            "candidate_seniority_mismatch": f"(c_years > {c.years} or ({c.years} >= 10 and c_junior))",
        },
    ]
