"""Snapshots of postings: keys, fingerprints, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.dialect import SPARK, Spark
from ..session import small_methods
from .numbering import numbered

_FIELDS = ("company_name", "title", "location", "salary_range", "remote_policy")
_SOURCE_URL, _FETCHED = r"(?im)^\s*source url:\s*(\S+)\s*$", r"(?im)^\s*fetched at:[^\n]*\n?"


def squeezed(d: Spark, x: str) -> str:
    """Trimmed, lower case, runs of white space as one space."""
    return d.replace(d.norm(x), r"\s+", " ")


def key_expressions(d: Spark) -> dict[str, str]:
    """``base_key`` and ``fingerprint`` of a posting; the line that tells when it was fetched counts for neither."""
    url = d.extract("coalesce(description, '')", _SOURCE_URL)
    role = " || '|' || ".join(squeezed(d, c) for c in ("company_name", "title", "location"))
    body = d.replace("coalesce(description, '')", _FETCHED, "")
    parts = " || '\n' || ".join([*(squeezed(d, c) for c in _FIELDS), squeezed(d, body)])
    digest = f"sha2({parts}, 256)" if d.name == "spark" else f"sha256({parts})"
    return {"base_key": f"case when {url} <> '' then 'source_url:' || {squeezed(d, url)} else 'role:' || {role} end", "fingerprint": digest}


def key_stages() -> list[dict[str, str]]:
    """What ``key_expressions`` says, for Spark: a pattern is searched only where texts hold what it looks for, and each text is made once."""
    d, text = SPARK, "coalesce(description, '')"
    single = lambda x: f"case when {x} rlike {d.text(r'[\t\n\x0B\f\r]|  ')} then {d.replace(x, r'\s+', ' ')} else {x} end"
    body = f"case when {d.contains('k_low', 'fetched at:')} then {d.replace(text, _FETCHED, '')} else {text} end"
    role = " || '|' || ".join(f"k_{c}" for c in ("company_name", "title", "location"))
    return [
        {"k_low": f"lower({text})", **{f"k_n_{c}": d.norm(c) for c in _FIELDS}},
        {"k_url": f"case when {d.contains('k_low', 'source url:')} then {d.extract(text, _SOURCE_URL)} else '' end", "k_n_body": d.norm(body), **{f"k_{c}": single(f"k_n_{c}") for c in _FIELDS}},
        {"k_body": single("k_n_body")},
        {"base_key": f"case when k_url <> '' then 'source_url:' || {squeezed(d, 'k_url')} else 'role:' || {role} end", "fingerprint": f"sha2({" || '\n' || ".join([*(f'k_{c}' for c in _FIELDS), 'k_body'])}, 256)"},
    ]


def keyed(postings: DataFrame) -> DataFrame:
    """Adds job_key and fingerprint. Repeated keys are numbered in input order, however often one repeats."""
    small_methods(postings.sparkSession)
    out = postings
    for stage in key_stages():
        out = out.selectExpr("*", *[f"{e} as {n}" for n, e in stage.items()])
    out = out.select(*postings.columns, "base_key", "fingerprint")
    return numbered(out, ("base_key",), "ordinal").withColumn("job_key", F.when(F.col("turn") == 1, F.col("base_key")).otherwise(F.concat("base_key", F.lit("#"), F.col("turn").cast("string")))).drop("turn")


def keyed_sql(d: Spark, source: str) -> str:
    columns = ", ".join(f"{e} as {n}" for n, e in key_expressions(d).items())
    return f"""(select *, case when turn = 1 then base_key else base_key || '#' || turn end as job_key
        from (select *, row_number() over (partition by base_key order by ordinal) as turn from (select *, {columns} from {source})))"""


def diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(job_key, change_status, ordinal, previous_file): NEW, UPDATED, UNCHANGED or REMOVED, by a full outer join on the key."""
    now = current.select("job_key", "ordinal", "fingerprint")
    then = previous.select("job_key", F.col("fingerprint").alias("old"), F.col("source_file").alias("previous_file"))
    status = F.when(F.col("old").isNull(), "NEW").when(F.col("fingerprint").isNull(), "REMOVED").when(F.col("fingerprint") == F.col("old"), "UNCHANGED").otherwise("UPDATED")
    return now.join(then, "job_key", "full_outer").select("job_key", status.alias("change_status"), "ordinal", "previous_file")


def changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The current postings that are new or updated: what an incremental run evaluates."""
    same = previous.select("job_key", F.col("fingerprint").alias("old"))
    return current.join(same, (current["job_key"] == same["job_key"]) & (current["fingerprint"] == same["old"]), "left_anti")


def removed(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.join(current.select("job_key"), "job_key", "left_anti")


def retained(history: DataFrame, scope: str, order: str, runs: int = 26) -> DataFrame:
    """The last runs of each scope."""
    return history.withColumn("back", F.row_number().over(W.partitionBy(scope).orderBy(F.desc(order)))).where(F.col("back") <= runs).drop("back")
