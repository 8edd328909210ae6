"""Company names where a posting gives none: from its title, description, heading or address."""

from __future__ import annotations

from ..functions.dialect import Spark
from ..functions.urls import url_expressions
from .raw_text import titled

# Names that stand for no company.
PLACEHOLDERS = ("unknown", "unknown company", "our client", "one of our clients", "our customer", "client", "confidential", "stealth", "hiring company", "the company")
# Sites whose address is not their name.
HOST_NAMES = {
    "bizreach.jp": "BizReach", "doda.jp": "Doda", "enworld.com": "en world", "greenhouse.io": "Greenhouse", "hays.co.jp": "Hays", "hays.com": "Hays", "japan-dev.com": "Japan Dev", "lever.co": "Lever", "linkedin.com": "LinkedIn",
    "michaelpage.co.jp": "Michael Page", "michaelpage.com": "Michael Page", "randstad.co.jp": "Randstad", "robertwalters.co.jp": "Robert Walters", "talentio.com": "Talentio", "tokyodev.com": "TokyoDev", "wantedly.com": "Wantedly", "workable.com": "Workable",
}
# Second labels of country domains.
_SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "net", "or", "org")


def _squeezed(d: Spark, x: str) -> str:
    return d.trimmed(d.replace(f"coalesce({x}, '')", r"\s+", " "))


def _cleaned(d: Spark, x: str) -> str:
    """A candidate without quotes and words such as "careers" at its end; empty if long."""
    out = d.replace(_squeezed(d, x), r"""^["'`\s]+|["'`\s]+$""", "")
    out = d.trimmed(d.replace(out, r"(?i)\b(?:group recruiting information|recruiting information|careers?|jobs?|job board|hiring)\b$", ""))
    out = d.trimmed(d.replace(out, r"[\s,;:|\-]+$", ""))
    return f"case when length({out}) > 80 then '' else {out} end"


def generic(d: Spark, x: str) -> str:
    """Whether a name stands for no company."""
    listed = ", ".join(map(d.text, PLACEHOLDERS))
    shaped = d.matches(f"lower({x})", r"^[a-z0-9][a-z0-9.-]*\.[a-z]{2,}$")
    return f"({x} = '' or lower({x}) in ({listed}) or {shaped} or contains(lower({x}), 'our client') or {d.matches(f'lower({x})', '^based in ')} or contains(lower({x}), 'confidential') or contains(lower({x}), 'stealth'))"


def stages(d: Spark, company: str = "company_name", title: str = "title", description: str = "description", heading: str = "heading", url: str = "url") -> list[dict[str, str]]:
    """Staged columns; the last one is ``resolved``."""
    known = " ".join(f"when n_host = '{h}' or {d.ends_with('n_host', '.' + h)} then {d.text(n)}" for h, n in HOST_NAMES.items())
    label = lambda i: d.at("n_labels", i)
    country = f"{d.size('n_labels')} >= 3 and length({label('-1')}) = 2 and {label('-2')} in ({', '.join(map(d.text, _SECOND_LEVEL))})"
    spaced = f"replace(replace(coalesce(case when {country} then {label('-3')} when {d.size('n_labels')} >= 2 then {label('-2')} end, ''), '-', ' '), '_', ' ')"
    told = d.replace(f"coalesce({description}, '')", r"(?im)^Source URL:\s*\S+\s*$", "")
    stop = lambda mark: f"strpos(n_told, {d.text(mark)})" if d.name == "duckdb" else f"locate({d.text(mark)}, n_told)"
    return [
        {"n_current": _squeezed(d, company), "n_title": _squeezed(d, title), "n_told": _squeezed(d, d.trimmed(told)), "n_heading": _squeezed(d, heading), "n_host": f"coalesce({url_expressions(d, url)['host']}, '')"},
        {"n_parts": d.split_on("n_title", r"\s+\|\s+"), "n_stop": f"case when {stop('.')} > 0 then {stop('.')} when {stop(':')} > 0 then {stop(':')} else {stop(' ')} end", "n_labels": d.split_on(d.replace("n_host", r"^www\.", ""), r"\.")},
        {
            "n_dashes": d.each("n_parts", lambda x: _cleaned(d, d.extract(x, r"^.* - (.+)$"))),
            "n_last": _cleaned(d, d.at("n_parts", "-1")),
            "n_about": f"case when {d.matches('lower(n_told)', '^about ')} and n_stop > 7 then {_cleaned(d, 'substr(n_told, 7, n_stop - 7)')} else '' end",
            "n_brand": titled(d, f"{d.trimmed(spaced)}"),
        },
        {
            "resolved": f"case when not {generic(d, 'n_current')} then n_current else coalesce({d.at(d.keep('n_dashes', lambda x: f'not {generic(d, x)}'), '1')},"
            f" case when {d.size('n_parts')} > 1 and not {generic(d, 'n_last')} then n_last end, case when not {generic(d, 'n_about')} then n_about end, case when not {generic(d, 'n_heading')} then n_heading end,"
            f" case when n_host <> '' then nullif(case {known} else n_brand end, '') end, n_current) end"
        },
    ]
