"""Settings in YAML files: candidate profiles, runtime limits, word lists; which of them is meant, and what is wrong with them.

Settings are few rows, so they are objects on the driver; word lists and profiles become
literals of plans. Checks of tables of companies are a query (plans/settings_queries.py).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace
from types import SimpleNamespace

from pyspark.sql import SparkSession

from ..functions import lexicon
from ..functions.fetching import Options, unsafe
from ..operators.candidate import Candidate
from ..operators.settings import Company, Persona
from .postings import read_texts
from .yaml_files import _load

# Tags that companies may have, what robots modes there are, and the shape of ids.
PROFILE_TAGS = ("expat_friendly", "engineering_brand", "strong_wlb", "stable_public", "product_leader", "reputation_strong")
RISK_TAGS = ("language_friction_high", "overtime_risk", "reputation_risk", "layoff_risk")
ROBOTS_MODES = ("strict", "warn", "off")
ID = r"[a-z0-9_]+"
#: A request for no candidate profile.
NO_PROFILE = "none"


@dataclass(frozen=True)
class Profile:
    """A candidate's profile as its file has it."""

    id: str
    name: str = ""
    title: str = ""
    location: str = ""
    years: int = 0
    production: tuple[str, ...] = ()
    learning: tuple[str, ...] = ()
    gaps: tuple[str, ...] = ()
    strong: tuple[str, ...] = ()
    moderate: tuple[str, ...] = ()
    limited: tuple[str, ...] = ()
    education: tuple[tuple[str, str, str], ...] = ()
    roles: tuple[str, ...] = ()
    differentiators: tuple[str, ...] = ()

    def candidate(self) -> Candidate:
        """What postings are matched with."""
        return Candidate(self.id, self.years, self.production, self.learning, self.strong, self.moderate, self.limited, " ".join((self.title, *self.roles, *self.differentiators)).lower())


@dataclass(frozen=True)
class Runtime:
    """Limits of fetching and evaluating. Spark's own parallelism stands for the limits of threads, which are only checked."""

    timeout_seconds: int = 20
    user_agent: str = Options.user_agent
    retries: int = 2
    backoff_millis: int = 300
    request_delay_millis: int = 1200
    max_concurrency: int = 4
    max_concurrency_per_host: int = 1
    robots_mode: str = "strict"
    cache_ttl_minutes: int = 720
    evaluation_max_concurrency: int = 4

    def options(self) -> Options:
        return Options(self.user_agent, self.timeout_seconds, self.retries, self.backoff_millis, self.request_delay_millis, self.robots_mode.strip().lower())


class _Reader:
    """Fields of a mapping, with what is wrong written down under its name."""

    def __init__(self, values, context: str, errors: list[str]):
        self.values, self.context, self.errors = values if isinstance(values, dict) else {}, context, errors

    def _wrong(self, what: str):
        self.errors.append(f"{self.context} {what}")

    def below(self, key: str, required: bool = True) -> _Reader:
        value = self.values.get(key)
        if not isinstance(value, dict) and (required or value is not None):
            self._wrong(f"missing map field '{key}'" if required else f"field '{key}' must be a map")
        return _Reader(value, f"{self.context}.{key}", self.errors)

    def text(self, key: str, default: str | None = None) -> str:
        value = self.values.get(key)
        if value is None and default is not None:
            return default
        if not isinstance(value, str):
            self._wrong(f"missing string field '{key}'" if default is None else f"field '{key}' must be a string")
            return default or ""
        if default is None and not value.strip():
            self._wrong(f"field '{key}' cannot be blank")
        return value.strip()

    def number(self, key: str, default: int | None = None) -> int:
        value = self.values.get(key)
        if value is None and default is not None:
            return default
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            self._wrong(f"missing integer field '{key}'" if default is None else f"field '{key}' must be an integer")
            return default or 0
        return int(value)

    def _strings(self, values: list, what: str) -> tuple[str, ...]:
        out = []
        for i, item in enumerate(values):
            if not isinstance(item, str):
                self._wrong(f"{what} item[{i}] must be a string")
            elif item.strip():
                out.append(item.strip())
        return tuple(out)

    def texts(self, key: str, default: tuple[str, ...] = ()) -> tuple[str, ...]:
        value = self.values.get(key)
        if value is None:
            return default
        if not isinstance(value, list):
            self._wrong(f"field '{key}' must be a list")
            return default
        return self._strings(value, f"field '{key}'")

    def flat(self) -> tuple[str, ...]:
        """All texts of nested lists and mappings, in order."""
        out: list[str] = []
        for key, value in self.values.items():
            if isinstance(value, list):
                out += self._strings(value, f"field '{key}'")
            elif isinstance(value, dict):
                out += _Reader(value, f"{self.context}.{key}", self.errors).flat()
            else:
                self._wrong(f"{key} must be a list or nested map")
        return tuple(out)


def _root(text: str, what: str, errors: list[str]) -> dict | None:
    try:
        root = _load(text or "")
    except RuntimeError:
        raise
    except Exception as e:  # the parser's own errors
        errors.append(f"Invalid YAML in {what}: {str(e).splitlines()[0]}")
        return None
    if not isinstance(root, dict):
        errors.append(f"Empty YAML file: {what}" if root is None else f"YAML root must be a mapping object: {what}")
        return None
    return root


def load_profile(text: str, file_name: str, errors: list[str]) -> Profile | None:
    """A profile; its file's name without ending is its id. What is missing or of another kind is told and left empty."""
    root = _root(text, file_name, errors)
    if root is None:
        return None
    r = _Reader(root, f"candidate-profiles/{file_name}", errors)
    who, stack, known = r.below("candidate"), r.below("stack"), r.below("domain_expertise")
    schools = root.get("education")
    if schools is not None and not isinstance(schools, list):
        r._wrong("field 'education' must be a list")
        schools = []
    education = []
    for i, item in enumerate(schools or []):
        if not isinstance(item, dict):
            r._wrong(f"field 'education' item[{i}] must be a map")
            continue
        said = tuple(item[k].strip() if isinstance(item.get(k), str) else "" for k in ("degree", "institution", "note"))
        if any(said):
            education.append(said)
    return Profile(
        file_name.rsplit(".", 1)[0], who.text("name"), who.text("title"), who.text("location", ""), who.number("total_experience_years"),
        stack.below("production_proven").flat(), stack.texts("actively_learning"), stack.texts("gaps_honest"),
        *(known.texts(k) for k in ("strong", "moderate", "limited")), tuple(education), r.below("target_roles", required=False).flat(), r.texts("differentiators"),
    )


def read_profiles(spark: SparkSession, path: str) -> tuple[list[Profile], list[str]]:
    """The profiles of a folder's YAML files, by name, and what is wrong with them; examples do not count."""
    errors: list[str] = []
    files = read_texts(spark, path, "*.{yaml,yml}").collect()
    names = sorted((r["source_file"].rsplit("/", 1)[-1], r["raw_text"]) for r in files)
    loaded = [load_profile(text, name, errors) for name, text in names if not re.search(r"(?i)\.example\.ya?ml$", name)]
    return [p for p in loaded if p is not None], errors


def load_runtime(text: str, errors: list[str]) -> Runtime:
    """Limits; those that are not given keep their defaults."""
    root, base = _root(text, "runtime.yaml", errors) or {}, Runtime()
    fetch = _Reader(root, "runtime.yaml", errors).below("fetch_web", required=False)
    found = {f.name: fetch.text(f.name, getattr(base, f.name)) if f.type == "str" else fetch.number(f.name, getattr(base, f.name)) for f in fields(Runtime) if f.name != "evaluation_max_concurrency"}
    evaluation = _Reader(root, "runtime.yaml", errors).below("evaluation", required=False)
    return replace(base, **found, evaluation_max_concurrency=evaluation.number("max_concurrency", base.evaluation_max_concurrency))


#: Sections of word lists, and the beginning of their names among the words of evaluation.
_SECTIONS = {"language": "LANGUAGE_", "work_life_balance": "WORK_LIFE_BALANCE_", "mobility": "MOBILITY_", "job_post_quality": "JOB_POST_QUALITY_"}
# The word lists and thresholds that settings may replace.
SIGNAL_LISTS = {
    "language": ("required_keywords", "friction_soft_keywords", "medium_high_friction_keywords", "high_friction_keywords", "assignment_dependent_keywords", "optional_or_exempt_keywords", "english_friendly_keywords", "english_support_environment_keywords"),
    "work_life_balance": ("overtime_risk_keywords", "holiday_policy_risk_keywords"),
    "mobility": ("location_mobility_risk_keywords",),
    "job_post_quality": ("generic_marketing_risk_keywords", "conditions_section_keywords", "vague_conditions_risk_keywords", "concrete_conditions_keywords"),
}
SIGNAL_NUMBERS = {"language": ("english_support_max_index", "assignment_dependent_base_index", "assignment_dependent_min_index"), "job_post_quality": ("generic_marketing_risk_hit_min", "vague_conditions_risk_hit_min")}


def load_words(text: str, errors: list[str]) -> SimpleNamespace:
    """All words of evaluation, those of the file in place of the given ones; for ``evaluate(words=...)``."""
    root = _root(text, "decision-signals.yaml", errors) or {}
    words = {k: v for k, v in vars(lexicon).items() if k.isupper()}
    for section, start in _SECTIONS.items():
        r = _Reader(root, "decision-signals.yaml", errors).below(section, required=False)
        for key in SIGNAL_LISTS[section]:
            name = start + key.upper()
            words[name] = tuple(w.lower() for w in r.texts(key, words[name]))
        for key in SIGNAL_NUMBERS.get(section, ()):
            name = start + key.upper()
            words[name] = r.number(key, words[name])
    return SimpleNamespace(**words)


def find_persona(personas: list[Persona], wanted: str) -> Persona | None:
    """By id, whatever its case and blanks around it."""
    return next((p for p in personas if p.name.strip().lower() == wanted.strip().lower()), None)


def resolve_profile(profiles: list[Profile], wanted: str = "") -> tuple[Profile | None, bool, str]:
    """(profile, whether it was chosen for being the only one, error). Nothing asked for means the only profile, or none of several."""
    wanted = (wanted or "").strip()
    if not wanted:
        return (profiles[0], True, "") if len(profiles) == 1 else (None, False, "")
    if wanted.lower() == NO_PROFILE:
        return None, False, ""
    found = next((p for p in profiles if p.id.strip().lower() == wanted.lower()), None)
    return found, False, "" if found else f"Unknown candidate profile id '{wanted}'."


def selected(personas: list[Persona], wanted: list[str]) -> tuple[list[Persona], list[str]]:
    """(personas asked for, in that order, each once; errors). One unknown id empties the selection; nothing asked for means all."""
    if not wanted:
        return list(personas), []
    unknown = [w for w in wanted if find_persona(personas, w) is None]
    if unknown:
        return [], [f"Unknown persona id '{w}'." for w in unknown]
    found = [find_persona(personas, w) for w in wanted]
    return list({p.name: p for p in found}.values()), []


def _repeats(values, what: str) -> list[str]:
    seen, out = set(), []
    for value in values:
        key = value.strip().lower()
        if key and key in seen:
            out.append(f"{what} contains duplicate value '{value}'")
        seen.add(key)
    return out


def _ids(names: list[str], what: str, told: str) -> list[str]:
    out, seen = [], set()
    for i, name in enumerate(names):
        if not name.strip():
            out.append(f"{what}[{i}].id cannot be blank")
        elif not re.fullmatch(ID, name):
            out.append(f"{what}[{i}].id must match pattern ^{ID}$")
        key = name.strip().lower()
        if key and key in seen:
            out.append(f"Duplicate {told} id: {name}")
        seen.add(key)
    return out


def check_companies(companies: list[Company], ids: list[str] | None = None) -> list[str]:
    """Companies; their ids, where the settings have them."""
    if not companies:
        return ["At least one company is required in config/companies.yaml"]
    out, names = _ids(ids, "companies", "company") if ids is not None else [], set()
    for i, c in enumerate(companies):
        at, key = f"companies[{i}]", c.name.strip().lower()
        out += [f"Duplicate company name: {c.name}"] if key and key in names else []
        names.add(key)
        out += [f"{at}.{field} must be a valid public http/https URL" for field, url in (("career_url", c.career_url), ("corporate_url", c.corporate_url)) if unsafe(url)]
        for field, tags, allowed in (("profile_tags", c.profile_tags, PROFILE_TAGS), ("risk_tags", c.risk_tags, RISK_TAGS)):
            out += _repeats(tags, f"{at}.{field}")
            out += [f"{at}.{field} contains unknown tag '{t}'" for t in tags if t.strip().lower() not in allowed]
    return out


def check_personas(personas: list[Persona]) -> list[str]:
    if not personas:
        return ["At least one persona is required in config/personas.yaml"]
    out = _ids([p.name for p in personas], "personas", "persona")
    for i, p in enumerate(personas):
        out += [f"personas[{i}].{field} must contain at least one item" for field, values in (("priorities", p.priorities), ("hard_no", p.hard_no)) if not values]
        out += [f"personas[{i}].minimum_salary_yen must be non-negative"] if p.minimum_salary_yen < 0 else []
        out += _repeats(p.priorities, f"personas[{i}].priorities") + _repeats(p.hard_no, f"personas[{i}].hard_no")
    return out


def check_blacklist(entries: list[tuple[str, str]]) -> list[str]:
    """(name, reason) of companies that are never worth it."""
    out, names = [], set()
    for i, (name, reason) in enumerate(entries):
        out += [f"blacklisted_companies[{i}].{field} cannot be blank" for field, value in (("name", name), ("reason", reason)) if not value.strip()]
        key = name.strip().lower()
        out += [f"Duplicate blacklisted company name: {name}"] if key and key in names else []
        names.add(key)
    return out


def check_profiles(profiles: list[Profile]) -> list[str]:
    out = _ids([p.id for p in profiles], "candidate_profiles", "candidate profile")
    for i, p in enumerate(profiles):
        at = f"candidate_profiles[{i}]"
        out += [f"{at}.{field} cannot be blank" for field in ("name", "title") if not getattr(p, field).strip()]
        out += [f"{at}.total_experience_years must be non-negative"] if p.years < 0 else []
        for field, values in (("production_skills", p.production), ("learning_skills", p.learning), ("gap_skills", p.gaps)):
            out += _repeats(values, f"{at}.{field}")
        for field, values in (("strong_domains", p.strong), ("moderate_domains", p.moderate), ("limited_domains", p.limited)):
            out += [e.replace("duplicate value", "duplicate domain id") for e in _repeats(values, f"{at}.{field}")]
    return out


def check_runtime(r: Runtime) -> list[str]:
    least = {"timeout_seconds": 5, "retries": 0, "backoff_millis": 0, "request_delay_millis": 0, "max_concurrency": 1, "max_concurrency_per_host": 1, "cache_ttl_minutes": 1}
    out = [f"runtime.fetch_web.{k} must be {'non-negative' if n == 0 else f'at least {n}'}" for k, n in least.items() if getattr(r, k) < n]
    out += ["runtime.fetch_web.user_agent cannot be blank"] if not r.user_agent.strip() else []
    out += [f"runtime.fetch_web.robots_mode must be one of: {', '.join(ROBOTS_MODES)}"] if r.robots_mode.strip().lower() not in ROBOTS_MODES else []
    return out + (["runtime.evaluation.max_concurrency must be at least 1"] if r.evaluation_max_concurrency < 1 else [])


def check_words(words) -> list[str]:
    out = []
    for section, start in _SECTIONS.items():
        for key in SIGNAL_LISTS[section]:
            values, at = getattr(words, start + key.upper()), f"decision-signals.{section}.{key}"
            out += _repeats(values, at) if values else [f"{at} must contain at least one item"]
        for key in SIGNAL_NUMBERS.get(section, ()):
            value, at = getattr(words, start + key.upper()), f"decision-signals.{section}.{key}"
            if key.endswith("_index") and not 0 <= value <= 100:
                out.append(f"{at} must be between 0 and 100")
            if key.endswith("_min") and value < 1:
                out.append(f"{at} must be at least 1")
    if words.LANGUAGE_ASSIGNMENT_DEPENDENT_MIN_INDEX > words.LANGUAGE_ASSIGNMENT_DEPENDENT_BASE_INDEX:
        out.append("decision-signals.language.assignment_dependent_min_index must be <= assignment_dependent_base_index")
    return out
