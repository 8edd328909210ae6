"""Settings from files: profiles, limits, word lists, selections, checks."""

from dataclasses import replace
from types import SimpleNamespace

import pytest

from sievewell.functions import lexicon
from sievewell.operators import candidate
from sievewell.operators.evaluation import evaluate
from sievewell.functions.dialect import SPARK
from sievewell.operators.settings import COMPANIES, PERSONAS, Company, Persona
from sievewell.sources import settings_files as S

PROFILE = """candidate: {name: N, title: ' Senior Backend Engineer ', location: Tokyo, total_experience_years: 10}
stack:
  production_proven: {backend: [Java, ' Spring Boot ', ''], data: {stores: [PostgreSQL]}}
  actively_learning: [Kotlin]
domain_expertise: {strong: [ecommerce_platforms], moderate: [system_design]}
education: [{degree: CS, institution: U}, {year: 2012}]
target_roles: {ideal: [Platform Engineer]}
differentiators: [Ships retail checkout]
"""


def test_profiles_are_read(spark, tmp_path):
    for name, text in (("b.yaml", PROFILE), ("a.yml", "candidate: 7\nstack: {production_proven: {x: 1, y: [2]}, gaps_honest: z}\neducation: [1]\n"), ("x.example.yaml", PROFILE), ("c.yaml", "[1"), ("d.yaml", "# nothing"), ("notes.txt", "x")):
        (tmp_path / name).write_text(text)
    profiles, errors = S.read_profiles(spark, f"file://{tmp_path}")
    assert [p.id for p in profiles] == ["a", "b"]
    b = profiles[1]
    assert (b.title, b.years, b.production, b.learning, b.strong, b.limited, b.education, b.roles) == ("Senior Backend Engineer", 10, ("Java", "Spring Boot", "PostgreSQL"), ("Kotlin",), ("ecommerce_platforms",), (), (("CS", "U", ""),), ("Platform Engineer",))
    told = "\n".join(errors)
    for part in ("a.yml missing map field 'candidate'", "a.yml.candidate missing string field 'name'", "missing integer field 'total_experience_years'", "x must be a list or nested map", "field 'y' item[0] must be a string", "field 'gaps_honest' must be a list", "field 'education' item[0] must be a map", "Invalid YAML in c.yaml", "Empty YAML file: d.yaml"):
        assert part in told, part
    assert S.check_profiles([b]) == []
    posting = spark.createDataFrame([("A", "Senior Backend Engineer", "JPY 9M - 12M", "Remote", "Requirements:\n5+ years of experience with Java\nPostgreSQL and Spring Boot")], "company_name string, title string, salary_range string, remote_policy string, description string")
    assert "candidate_stack_fit" in evaluate(posting, PERSONAS[0], candidate=candidate.stages(SPARK, b.candidate())).first().positive_signals


def test_limits_are_read_and_checked():
    errors = []
    r = S.load_runtime("fetch_web: {timeout_seconds: 31, robots_mode: ' WARN ', retries: '2', user_agent: x/1}\nevaluation: {max_concurrency: 2}", errors)
    assert (r.timeout_seconds, r.retries, r.backoff_millis, r.evaluation_max_concurrency) == (31, 2, 300, 2) and r.options().robots == "warn" and r.options().user_agent == "x/1"
    assert errors == ["runtime.yaml.fetch_web field 'retries' must be an integer"] and S.check_runtime(r) == []
    bad = S.Runtime(4, " ", -1, -1, -1, 0, 0, "maybe", 0, 0)
    told = "\n".join(S.check_runtime(bad))
    assert all(f"runtime.{k} " in told for k in ("fetch_web.timeout_seconds", "fetch_web.user_agent", "fetch_web.retries", "fetch_web.backoff_millis", "fetch_web.request_delay_millis", "fetch_web.max_concurrency", "fetch_web.max_concurrency_per_host", "fetch_web.robots_mode", "fetch_web.cache_ttl_minutes", "evaluation.max_concurrency"))
    assert S.load_runtime("fetch_web: 3", errors) == S.Runtime() and "field 'fetch_web' must be a map" in errors[-1]


def test_word_lists_are_replaced_and_change_signals(spark):
    errors = []
    words = S.load_words("language: {required_keywords: [Must sing in Welsh], assignment_dependent_base_index: 40}\njob_post_quality: {generic_marketing_risk_hit_min: 1}", errors)
    assert errors == [] and words.LANGUAGE_REQUIRED_KEYWORDS == ("must sing in welsh",) and words.LANGUAGE_ASSIGNMENT_DEPENDENT_BASE_INDEX == 40 and words.ONSITE_ONLY_KEYWORDS == lexicon.ONSITE_ONLY_KEYWORDS and S.check_words(words) == []
    posting = spark.createDataFrame([("A", "Backend Engineer", "JPY 9M - 12M", "Remote", "You must sing in Welsh.")], "company_name string, title string, salary_range string, remote_policy string, description string")
    assert evaluate(posting, PERSONAS[0], words=words).first().language_friction_index >= 75 > evaluate(posting, PERSONAS[0]).first().language_friction_index
    wrong = SimpleNamespace(**vars(words) | {"LANGUAGE_REQUIRED_KEYWORDS": (), "LANGUAGE_HIGH_FRICTION_KEYWORDS": ("a", "A "), "LANGUAGE_ENGLISH_SUPPORT_MAX_INDEX": 101, "LANGUAGE_ASSIGNMENT_DEPENDENT_MIN_INDEX": 50, "JOB_POST_QUALITY_VAGUE_CONDITIONS_RISK_HIT_MIN": 0, "MOBILITY_LOCATION_MOBILITY_RISK_KEYWORDS": ()})
    told = "\n".join(S.check_words(wrong))
    for part in ("language.required_keywords must contain", "language.high_friction_keywords contains duplicate", "english_support_max_index must be between", "assignment_dependent_min_index must be <=", "vague_conditions_risk_hit_min must be at least 1", "mobility.location_mobility_risk_keywords must contain"):
        assert part in told, part


def test_selections():
    people = list(PERSONAS)
    assert S.find_persona(people, " ENGINEER ") is people[0] and S.find_persona(people, "x") is None
    assert S.selected(people, ["Engineer_Strict", "engineer", "engineer_strict"]) == ([people[1], people[0]], []) and S.selected(people, []) == (people, [])
    assert S.selected(people, ["engineer", "enginer"]) == ([], ["Unknown persona id 'enginer'."])
    one, two = S.Profile("one"), S.Profile("two")
    assert S.resolve_profile([one]) == (one, True, "") and S.resolve_profile([one, two]) == (None, False, "") and S.resolve_profile([]) == (None, False, "")
    assert S.resolve_profile([one], " NONE ") == (None, False, "") and S.resolve_profile([one, two], "Two ") == (two, False, "") and S.resolve_profile([one], "x")[2] == "Unknown candidate profile id 'x'."


def test_checks_of_companies_and_personas():
    assert S.check_companies(list(COMPANIES[:1])) == [] and S.check_companies([]) == ["At least one company is required in config/companies.yaml"]
    bad = [Company("A", "http://localhost/x", "https://10.0.0.1/", profile_tags=("rich", "strong_wlb", "STRONG_WLB")), Company(" a ", "https://a.example/", "https://a.example/", risk_tags=("late",))]
    told = "\n".join(S.check_companies(bad, ["ok_1", "Bad Id"]))
    for part in ("companies[0].career_url must", "companies[0].corporate_url must", "unknown tag 'rich'", "profile_tags contains duplicate", "Duplicate company name:  a ", "companies[1].risk_tags contains unknown tag 'late'", "companies[1].id must match"):
        assert part in told, part
    assert S.check_personas([Persona("own", hard_no=("consulting_company",))]) == []
    told = "\n".join(S.check_personas([Persona("p", (), ()), replace(PERSONAS[0], name="P", priorities=("salary", "Salary"), minimum_salary_yen=-1), Persona(" ")]))
    for part in ("personas[0].priorities must contain", "personas[0].hard_no must contain", "personas[1].id must match", "Duplicate persona id: P", "personas[1].minimum_salary_yen", "personas[1].priorities contains duplicate", "personas[2].id cannot be blank"):
        assert part in told, part
    assert S.check_blacklist([("X", "why"), ("x ", ""), ("", "z")]) == ["blacklisted_companies[1].reason cannot be blank", "Duplicate blacklisted company name: x ", "blacklisted_companies[2].name cannot be blank"]
    told = "\n".join(S.check_profiles([S.Profile("a", "", "T", years=-1, production=("x", "X"), strong=("d", "d")), S.Profile("A", "N", "T")]))
    for part in ("[0].name cannot be blank", "total_experience_years must", "production_skills contains duplicate value", "strong_domains contains duplicate domain id 'd'", "[1].id must match", "Duplicate candidate profile id: A"):
        assert part in told, part


@pytest.mark.parametrize("text", ["- 1", "a: [", "7"])
def test_roots_that_are_no_mapping(text):
    errors = []
    assert S.load_profile(text, "x.yaml", errors) is None and len(errors) == 1
