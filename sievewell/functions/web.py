"""Expressions over addresses, anchors and career pages, in either dialect."""

from __future__ import annotations

from .dialect import Spark
from .urls import url_expressions

# Words of job titles, of text around them, of addresses, and what tells that a link is none.
JOB_WORDS = ("engineer", "developer", "backend", "front", "frontend", "fullstack", "full stack", "mobile", "ios", "android", "platform", "devops", "sre", "qa", "quality", "security", "specialist", "data scientist", "machine learning", "ml", "ai", "software", "manager", "architect", "staff engineer", "principal engineer")
NON_JOB_WORDS = (
    "cookie", "privacy", "terms", "newsletter", "sign in", "log in", "contact us", "about us", "sustainability", "our mission", "our values", "company profile", "investor relations", "newsroom", "event", "events",
    "information session", "career registration", "see more", "in the spotlight", "workplace", "benefits", "faq", "サステナビリティ", "会社概要", "ニュース", "福利厚生",
)
JOB_URL_HINTS = ("/job", "/jobs", "/job-description", "/career", "/careers", "/recruit", "/mid-career", "/positions", "/vacanc", "/openings", "workdayjobs", "greenhouse.io", "lever.co", "/apply")
NON_JOB_URL_HINTS = ("/sustainability", "/about", "/company", "/mission", "/vision", "/values", "/culture", "/workplace", "/benefits", "/faq", "/news", "/blog", "/press", "/investor", "/ir", "/privacy", "/terms", "/contact", "/our-latest", "/stories", "/event", "/landingpage")
PROVIDERS = ("ashbyhq.com", "greenhouse.io", "lever.co", "myworkdayjobs.com", "smartrecruiters.com", "workable.com", "bamboohr.com")
NON_JOB_PATHS = ("/about", "/company", "/mission", "/vision", "/values", "/sustainability", "/news", "/press", "/ir", "/investor", "/blog")
NAVIGATION = ("about us", "vision", "ceo message", "company overview", "our business", "history", "press releases", "photo library", "governance", "what's new", "links", "home")


def slug(d: Spark, x: str, blank: str = "unknown") -> str:
    out = d.replace(d.replace(f"lower({x})", "[^a-z0-9]+", "-"), "^-|-$", "")
    return f"coalesce(nullif({out}, ''), '{blank}')"


def scope_id(d: Spark, persona: str, profile: str) -> str:
    part = lambda x: d.replace(f"lower({x})", "[^a-z0-9_-]", "_")
    return f"{part(persona)} || '--' || {part(profile)}"


def shorten(x: str, n: int) -> str:
    return f"case when length({x}) <= {n} then {x} else trim(substr({x}, 1, {n - 3})) || '...' end"


def dedupe_key(d: Spark, x: str) -> str:
    out = d.replace(d.replace(d.norm(x), r"\s+", " "), r"[^\p{L}\p{N}\s]+", " ")
    return f"trim({d.replace(out, r'\s+', ' ')})"


def boilerplate(d: Spark, key: str) -> str:
    return f"(length({key}) < 16 or {d.inside_hits(key, NAVIGATION)} >= 4)"


def sanitized(d: Spark, x: str) -> str:
    """Without control characters but line ends and tabs, trimmed."""
    return d.trimmed(d.replace(f"coalesce({x}, '')", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def unsafe_reason(d: Spark, url: str) -> str:
    """Why an address must not be fetched, or null. Names are judged as they are; what they resolve to is not looked up."""
    scheme = f"lower({d.extract(url, r'^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)})"
    login = d.matches(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+@")
    host = f"coalesce(nullif({url_expressions(d, url)['host']}, ''), lower({d.extract(url, r'^[a-zA-Z]+://(\[[0-9a-fA-F:.]+\])', 1)}))"
    four = r"^(?:0|10|127)\.[0-9.]+$|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^198\.1[89]\.|^2(?:2[4-9]|3[0-9])\."
    private = f"(({d.matches(host, r'^[0-9.]+$')} and {d.matches(host, four)}) or {d.matches(host, r'^\[(?:::1?|f[cd][0-9a-f]*:.*|fe[89ab][0-9a-f]*:.*|ff.*)\]$')})"
    local = f"{host} = 'localhost' or " + " or ".join(d.ends_with(host, s) for s in (".localhost", ".local", ".internal"))
    return (
        f"case when trim(coalesce({url}, '')) = '' then 'URL cannot be blank.' when {scheme} not in ('http', 'https') then 'Only public http/https URLs are allowed.' when {login} then 'URLs with embedded credentials are not allowed.'"
        f" when {host} = '' then 'URL host is missing or invalid.' when {local} then 'Local or internal hosts are not allowed.' when {private} then 'Private or local network addresses are not allowed.' end"
    )


def likely_job(d: Spark, title: str, url: str) -> str:
    """A link that names a posting: a title of its kind, no noise in text or address, and an address that says so."""
    low, address = f"lower({title})", f"lower({url})"
    is_title = f"length({title}) between 4 and 140 and not {d.matches(title, r'^[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}.*')} and {d.any_of(low, JOB_WORDS)}"
    noise = f"{address} = '' or {d.matches(address, '^(?:mailto|tel|javascript):')} or {d.inside(address, NON_JOB_URL_HINTS)}"
    return f"({is_title} and not ({noise}) and not {d.any_of(low, NON_JOB_WORDS)} and {d.inside(address, JOB_URL_HINTS)})"


def career_score(d: Spark, url: str, jobs: str, configured: str, described: str = "0", events: str = "0") -> str:
    low = f"lower({url})"
    less = " + ".join(f"case when contains({low}, '{h}') then 10 else 0 end" for h in NON_JOB_PATHS)
    return (
        f"({jobs} * 20 + case when {low} = lower({configured}) then 6 else 0 end + case when {d.inside(low, PROVIDERS)} then 18 else 0 end + case when {d.inside(low, ('/job', '/career', '/recruit'))} then 8 else 0 end"
        f" - ({less}) + least(18, {described} * 6) - {events} * 8 + case when {jobs} > 0 then 12 else 0 end)"
    )
