"""Raw job texts to postings: labelled lines, inference where a label is missing, warnings."""

from __future__ import annotations

from ..functions.dialect import Spark

# What a line may begin with before its label.
_PREFIX = r"^\s*[•・*\-]?\s*"
# Labels, as lines are read; the value is the last group.
COMPANY_LABELS = (r"(?i)" + _PREFIX + r"(?:company|company name|employer)\s*:\s*(.+)$", _PREFIX + r"(?:会社名|企業名|雇用主)\s*[:：]\s*(.+)$")
TITLE_LABELS = (r"(?i)" + _PREFIX + r"(?:title|role|position)\s*:\s*(.+)$", r"(?i)" + _PREFIX + r"job\s+title\s*:\s*(.+)$", _PREFIX + r"(?:職種|募集職種|ポジション|求人名)\s*[:：]\s*(.+)$")
LOCATION_LABELS = (r"(?i)" + _PREFIX + r"(?:location|office|based in)\s*:\s*(.+)$", _PREFIX + r"(?:勤務地|勤務場所)\s*[:：]\s*(.+)$")
SALARY_LABELS = (r"(?i)" + _PREFIX + r"(?:salary|compensation|pay range|annual salary range|annual salary|年収|給与|想定年収|月給|年俸|報酬)\s*[:：]\s*(.+)$",)
REMOTE_LABELS = (
    r"(?i)" + _PREFIX + r"(?:remote policy|work style|working style|work mode|remote/hybrid|employment type|work location)\s*[:：]\s*(.+)$",
    _PREFIX + r"(?:勤務形態|働き方|リモートワーク)\s*[:：]\s*(.+)$",
)
# Words of work policies.
ONSITE = ("onsite", "on-site", "on site", "onsite only", "office attendance required", "work from office", "in office", "office-based", "office based", "出社", "出社必須")
REMOTE = ("remote", "work from home", "wfh", "remote work system available", "remote available", "fully remote", "在宅", "リモート", "在宅勤務")
NO_REMOTE = ("no remote", "not remote", "remote not available", "remote unavailable", "remote work not available", "without remote")
HYBRID = ("hybrid", "partially remote", "partial remote", "remote and office", "office and remote", "ハイブリッド")
NOT_POLICY = ("interview", "technical assignment", "hiring process", "selection process", "group video call")
# Words of titles, and of headings that are none.
TITLE_WORDS = (
    "engineer", "developer", "architect", "scientist", "designer", "manager", "backend", "front-end", "frontend", "full-stack", "full stack", "mobile", "ios", "android", "platform", "sre", "qa",
    "server-side", "serverside", "client-side", "clientside", "エンジニア", "開発", "設計", "デザイナー", "マネージャ", "バックエンド", "フロントエンド", "サーバサイド", "クライアントサイド",
)
TITLE_NOISE = ("requirements", "responsibilities", "qualifications", "benefits", "conditions", "待遇", "福利厚生", "勤務地", "給与")
_CURRENCY = r"(?:JPY|USD|EUR|¥|\$|€)"
_AMOUNT = r"\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:million|m))?"
CURRENCY_RANGE = rf"(?i)({_CURRENCY}{_AMOUNT}(?:\s*(?:-|~|to)\s*{_CURRENCY}?{_AMOUNT})?)"
COMPANY_SHAPE = r"^[A-Z][\w&+,.()'/-]*(?:\s+[A-Z][\w&+,.()'/-]*){0,5}$"
ABOUT = r"(?i)^about\s+(.+)$"
LOOKING_FOR = r"(?i)looking\s+for\s+(?:an?|the)?\s*(?:experienced|senior|staff|lead|principal|talented)?\s*([a-z][a-z0-9/+&\- ]{1,80}?(?:engineer|developer|architect|scientist|manager|designer))\b"
LEADING_LINES = 6

PARSED = ("company_name", "title", "location", "salary_range", "remote_policy", "description", "warnings")


def _candidate(d: Spark, x: str) -> str:
    return d.trimmed(d.replace(d.replace(d.trimmed(x), r"^#+\s*", ""), r"^\s*[•・*\-]+\s*", ""))


def _title_like(d: Spark, x: str) -> str:
    return f"({x} <> '' and length({x}) <= 140 and not {d.inside(f'lower({x})', TITLE_NOISE)} and {d.inside(f'lower({x})', TITLE_WORDS)})"


def _company_like(d: Spark, x: str) -> str:
    return f"({x} <> '' and length({x}) <= 100 and not {_title_like(d, x)} and not contains({x}, ':') and not contains({x}, '：') and not {d.matches(x, '^https?://')} and (contains({x}, '株式会社') or {d.matches(x, COMPANY_SHAPE)}))"


def _labelled(d: Spark, patterns) -> str:
    """The first line's value under the first pattern that gives one."""
    value = lambda x: "coalesce(" + ", ".join(f"nullif({d.trimmed(d.extract(x, p))}, '')" for p in patterns) + ")" if len(patterns) > 1 else f"nullif({d.trimmed(d.extract(x, patterns[0]))}, '')"
    return d.at(d.keep(d.each("r_lines", value), lambda v: f"{v} is not null", "v"), "1")


def titled(d: Spark, x: str) -> str:
    """Words with a capital first letter and small others, one space between them."""
    return d.glued(d.each(d.words(x), lambda w: f"upper(substr({w}, 1, 1)) || lower(substr({w}, 2))"), "' '")


def _policy(flags: dict[str, str], otherwise: str) -> str:
    return f"case when {flags['no']} then 'Onsite-only' when {flags['hybrid']} or ({flags['remote']} and {flags['onsite']}) then 'Hybrid' when {flags['remote']} then 'Remote' when {flags['onsite']} then 'Onsite-only' else {otherwise} end"


def stages(d: Spark, raw: str = "raw_text", company: str | None = None, title: str | None = None) -> list[dict[str, str]]:
    """Staged columns over a raw text; the last two hold the posting and its warnings. ``company`` and ``title`` override labels where they are not empty."""
    over = lambda x, label: f"coalesce(nullif(trim({x}), ''), {label})" if x else label
    first = lambda xs: d.at(xs, "1")
    said = lambda words: f"{d.size(d.keep('r_policy_lines', lambda x: d.inside(x, words)))} > 0"
    label = lambda words: d.inside("lower(r_remote)", words)
    about = lambda x: d.trimmed(d.extract(x, ABOUT))
    narrative = lambda x: d.extract(x, LOOKING_FOR)
    place = " ".join(
        [
            f"when {d.inside('r_low', ('otemachi', '東京', 'tokyo'))} then 'Tokyo'", "when contains(r_low, 'osaka') then 'Osaka'", "when contains(r_low, 'kyoto') then 'Kyoto'",
            f"when {d.inside('r_low', ('japan', '日本国内'))} then 'Japan'", f"when {d.inside('r_low', NO_REMOTE)} then ''", f"when {d.inside('r_low', REMOTE)} then 'Remote'",
        ]
    )
    warn = lambda test, text: f"case when {test} then {d.text(text)} end"
    return [
        {"r_lines": d.lines(f"coalesce({raw}, '')"), "r_low": f"lower(coalesce({raw}, ''))"},
        {
            "r_company": over(company, _labelled(d, COMPANY_LABELS)), "r_title": over(title, _labelled(d, TITLE_LABELS)), "r_location": _labelled(d, LOCATION_LABELS), "r_salary": _labelled(d, SALARY_LABELS), "r_remote": _labelled(d, REMOTE_LABELS),
            "r_currency": first(d.keep(d.each("r_lines", lambda x: d.trimmed(d.extract(x, CURRENCY_RANGE))), lambda v: f"{v} <> ''", "v")),
            "r_candidates": d.keep(d.each("r_lines", lambda x: _candidate(d, x)), lambda v: f"{v} <> ''", "v"),
            "r_policy_lines": d.keep(d.each("r_lines", lambda x: f"lower({x})"), lambda v: f"not {d.inside(v, NOT_POLICY)}", "v"),
        },
        {
            "r_leading": d.first_of(d.keep("r_candidates", lambda x: f"not contains({x}, ':') and not contains({x}, '：')"), str(LEADING_LINES)),
            "r_heading": first(d.keep(d.each(d.keep("r_candidates", lambda x: f"substr({x}, 1, 1) = '#'"), lambda y: d.trimmed(d.replace(y, r"^#+\s*", "")), "y"), lambda v: _title_like(d, v), "v")),
            "r_narrative": first(d.keep(d.each("r_candidates", narrative), lambda v: f"{v} <> ''", "v")),
        },
        {"title": f"coalesce(r_title, r_heading, nullif({titled(d, 'r_narrative')}, ''), {first(d.keep('r_leading', lambda x: _title_like(d, x)))}, 'Unknown Role')"},
        {
            "company_name": f"coalesce(r_company, {first(d.keep(d.each('r_candidates', about), lambda v: f'''{v} <> '' and lower({v}) not in ('the job', 'job') and (length({v}) <= 80 or {_company_like(d, v)})''', 'v'))},"
            f" {first(d.keep('r_leading', lambda x: f'{x} <> title and {_company_like(d, x)}'))}, 'Unknown Company')",
            "location": f"coalesce(r_location, nullif(case {place} else '' end, ''), 'Unspecified')",
            "salary_range": "coalesce(r_salary, r_currency, 'TBD')",
            "remote_policy": f"case when r_remote is not null then {_policy({'no': label(NO_REMOTE), 'hybrid': label(HYBRID), 'remote': label(REMOTE), 'onsite': f'''({label(ONSITE)} or lower(r_remote) = 'office')'''}, 'r_remote')}"
            f" else {_policy({'no': said(NO_REMOTE), 'hybrid': said(HYBRID), 'remote': said(REMOTE), 'onsite': said(ONSITE)}, d.text('Unspecified'))} end",
            "description": f"coalesce(nullif({d.trimmed(raw)}, ''), 'No description provided.')",
        },
        {
            "warnings": d.compact(
                [
                    warn("r_title is null", "Title not found in labeled fields; using inferred/fallback title."),
                    warn("r_company is null", "Company name not found in labeled fields; using inferred/fallback company."),
                    warn("location = 'Unspecified'", "Location not found; using 'Unspecified'."),
                    warn("salary_range = 'TBD'", "Salary range not found; using 'TBD'."),
                    warn("remote_policy = 'Unspecified'", "Remote policy not found; using 'Unspecified'."),
                    warn(f"{d.trimmed(raw)} = ''", "Description was empty; using placeholder."),
                ]
            )
        },
    ]
