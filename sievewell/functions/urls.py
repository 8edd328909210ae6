"""URL expressions, in either dialect."""

from __future__ import annotations

from .dialect import Spark

_GENERIC = "careers?|jobs?|recruit|positions?|openings?|en|ja|jp|index"


def url_expressions(d: Spark, url: str = "url") -> dict[str, str]:
    """``canonical`` (scheme and host in lower case, no query or fragment, no slash at the end), ``host``, ``brand``, ``concrete``."""
    scheme = f"lower({d.extract(url, r'^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)})"
    host = f"lower({d.extract(url, r'^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)})"
    path = d.extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = d.extract(path, r"([^/]*)/?$", 1)
    labels = d.extract(host, r"([a-z0-9-]+)\.(?:(?:co|or|ne|ac|go)\.)?[a-z]+$", 1)
    marked = d.matches(last, r"[-_0-9]")
    generic = d.matches(f"lower({last})", f"^(?:{_GENERIC})?$")
    query = d.matches(url, r"[?#]")
    return {
        "canonical": f"{scheme} || '://' || {host} || {d.replace(path, '/$', '')}",
        "host": host,
        "brand": labels,
        "concrete": f"({query} or (not {generic} and {marked}))",
    }
