"""Stored evaluations of single sources: names mended, sources judged again by several personas, a history by address."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import web
from ..functions.dialect import SPARK, Spark
from ..functions.urls import url_expressions
from ..sinks.versioned import Versioned
from ..sources.artifact_files import COLUMNS
from ..sources.yaml_files import FIELDS
from . import company_names, raw_text
from .evaluation import all_personas, staged
from .settings import BLACKLIST, COMPANIES


def _host(url: str) -> str:
    try:
        return (urlsplit(url.strip()).hostname or "").lower()
    except ValueError:
        return ""


def tracked_by_address(d: Spark, companies=COMPANIES, url: str = "url") -> str:
    """The name of the first tracked company on whose site, or below it, an address lies; else the address's host."""
    host = f"coalesce({url_expressions(d, url)['host']}, '')"
    sites = [(h, c.name) for c in companies for h in (_host(c.career_url), _host(c.corporate_url)) if h]
    cases = " ".join(f"when {host} = {d.text(h)} or {d.ends_with(host, '.' + h)} then {d.text(name)}" for h, name in sites)
    return f"case {cases} when {host} = '' then 'Unknown Company' else {host} end"


def name_stages(d: Spark, companies=COMPANIES) -> list[dict[str, str]]:
    """Staged columns for artifacts; the last but one is ``resolved``, the last ``renamed``, which tells whether the name changes."""
    squeezed = d.trimmed(d.replace("coalesce(company_name, '')", r"\s+", " "))
    base = {"a_base": f"case when {company_names.generic(d, squeezed)} then {tracked_by_address(d, companies)} else company_name end", "a_none": "''"}
    return [base, *company_names.stages(d, "a_base", "title", "description", "a_none", "url"), {"renamed": "coalesce(trim(url), '') <> '' and resolved <> '' and resolved <> coalesce(company_name, '')"}]


def mended_names(artifacts: DataFrame, companies=COMPANIES) -> DataFrame:
    """The artifacts whose company name changes, with the new one: names that stand for no company are told from the address, the title and the description. Sources without address stay as they are."""
    rows = staged(artifacts, name_stages(SPARK, companies), ["resolved", "renamed"]).where("renamed")
    return rows.withColumn("company_name", F.col("resolved")).select(*artifacts.columns)


def file_name(d: Spark, persona: str, profile: str) -> str:
    """A stable file name for an address: its host and last segment, and a hash of all of it."""
    last = d.extract(d.extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"([^/]+)/*$", 1)
    stem = f"substr({web.slug(d, url_expressions(d)['host'], 'url')} || '-' || {web.slug(d, last, 'url')}, 1, 72)"
    return f"'adhoc-url-' || {_scope(d, persona, profile)} || '-' || {stem} || '-' || {d.fnv('url')} || '.yaml'"


def _scope(d: Spark, persona: str, profile: str) -> str:
    return web.slug(d, f"({persona} || '--' || {profile})")


def _text_file_name(d: Spark, persona: str, profile: str) -> str:
    """For a text: as its first file is named, with another persona, or a hash of the text."""
    shape = r"^(?:.*/)?(adhoc-[^-]+)-.+-text\.yaml$"
    begin, scope = d.extract("path", shape, 1), _scope(d, persona, profile)
    return f"case when {begin} <> '' then {begin} || '-' || {scope} || '-text.yaml' else 'adhoc-text-' || {scope} || '-' || {d.fnv('raw_text')} || '.yaml' end"


def rerun(artifacts: DataFrame, personas, profile: str = "none", candidate: list[dict[str, str]] | None = None, companies=COMPANIES, blacklist=BLACKLIST, fetched: DataFrame | None = None, folder: str = "", generated_at=None) -> DataFrame:
    """A row for each source and persona, with the columns of artifacts: each source is judged again, once, by all personas.

    A source is a kind, an address and a text; its artifact of the smallest path speaks for
    it. Texts are parsed again; for addresses the stored posting counts, or that of
    ``fetched`` (url and the fields of a posting), where a page was fetched anew. A row
    takes the path of the source's artifact of that persona and profile (the smallest, if
    there are several), or a new name in ``folder``. If two sources come to one name, the
    one of the larger path has it.
    """
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    source = ["kind", "url", "digest"]
    known = artifacts.withColumn("raw_text", F.coalesce("raw_text", F.lit(""))).withColumn("digest", F.sha2("raw_text", 256)).withColumn("url", F.trim(F.coalesce("url", F.lit("")))).withColumn("kind", F.coalesce("kind", F.lit("")))
    first = known.groupBy(*source).agg(F.min_by(F.struct("path", "raw_text", *FIELDS), "path").alias("first")).select(*source, "first.*")
    texts = staged(first.where("url = '' and trim(raw_text) <> ''").drop(*FIELDS), raw_text.stages(SPARK), raw_text.PARSED).drop("warnings")
    pages = first.where("url <> ''")
    if fetched is not None:
        anew = fetched.groupBy("url").agg(F.first(F.struct(*FIELDS)).alias("anew"))
        pages = pages.join(anew, "url", "left").select(*source, "path", "raw_text", *[F.coalesce(F.col(f"anew.{f}"), F.col(f)).alias(f) for f in FIELDS])
    judged = all_personas(pages.unionByName(texts), personas, companies, blacklist, candidate)
    stored = known.where(plain("candidate_profile") == profile.strip().lower()).groupBy(*source, plain("persona").alias("who")).agg(F.min("path").alias("stored"))
    profile_sql = SPARK.text(profile)
    new = F.expr(f"case when url <> '' then {file_name(SPARK, 'persona', profile_sql)} else {_text_file_name(SPARK, 'persona', profile_sql)} end")
    out = judged.withColumn("who", F.lower(F.trim("persona"))).join(stored, [*source, "who"], "left")
    target = F.coalesce("stored", F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), new))
    out = out.withColumn("target", target).withColumn("turn", F.row_number().over(W.partitionBy("target").orderBy(F.desc("path"), "kind"))).where("turn = 1")
    when = F.current_timestamp() if generated_at is None else F.lit(generated_at)
    return out.withColumn("path", F.col("target")).withColumn("candidate_profile", F.lit(profile)).withColumn("generated_at", when.cast("timestamp")).select(*COLUMNS)


def mend_names_in(store: Versioned, companies=COMPANIES) -> None:
    """Mends names in a table of artifacts; readers see the old table or the new one."""
    artifacts = store.read()
    if artifacts is not None:
        store.merge(mended_names(artifacts, companies), "path")


def rerun_in(store: Versioned, personas, **how) -> None:
    """Judges a table's sources again and puts the rows into it; a run that dies leaves the table as it was, and can be made again."""
    artifacts = store.read()
    if artifacts is not None:
        store.merge(rerun(artifacts, personas, **how), "path")


def url_history(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """What was judged at each address, the newest first: (url, origin, company_name, title, generated_at, persona, candidate_profile, saved_path, saved_verdict).

    ``jobs`` (company_name, title, description, modified_at) tell their address and time in
    lines of the description; an address under which several titles stand is a listing
    and does not count, nor do addresses of no single posting. Of an address the newest
    record counts, of equally new ones a job's, then the larger path or title. ``saved_``
    columns tell of its newest artifact.
    """
    line = lambda name: F.trim(F.regexp_extract("description", rf"(?m)^[ \t]*{name}:(.*)$", 1))
    urls = url_expressions(SPARK)
    concrete = F.expr(f"({urls['concrete']}) and {SPARK.matches('url', '^(?i)https?:')}")
    times = F.coalesce(F.expr(f"try_to_timestamp({SPARK.extract('description', r'(?m)^[ \t]*Fetched At:[ \t]*(.*)$', 1)})"), F.col("modified_at"))
    told = jobs.select(line("Source URL").alias("url"), "company_name", "title", times.alias("generated_at")).where("url <> ''")
    titles = F.expr(SPARK.norm("title"))
    single = told.groupBy("url").agg(F.min(titles).alias("a"), F.max(titles).alias("z"), F.max_by(F.struct("company_name", "title", "generated_at"), F.struct("generated_at", "title")).alias("one")).where("a = z")
    found = single.select("url", F.lit("pipeline_job").alias("origin"), "one.*", F.lit("").alias("persona"), F.lit("").alias("candidate_profile")).where(concrete)
    stored = artifacts.where("kind = 'url' and trim(coalesce(url, '')) <> ''").withColumn("url", F.trim("url")).where(concrete)
    fields = ("company_name", "title", "generated_at", "persona", "candidate_profile", "path", "verdict")
    saved = stored.groupBy("url").agg(F.max_by(F.struct(*fields), F.struct("generated_at", "path")).alias("saved"))
    # Both sides have one row an address: what is newest is told by the join itself.
    both = found.withColumnRenamed("origin", "origin_").join(saved, "url", "full_outer")
    job = F.coalesce(F.col("origin_").isNotNull() & (F.col("saved").isNull() | F.col("saved.generated_at").isNull() | (F.col("generated_at") >= F.col("saved.generated_at"))), F.lit(False))
    pick = lambda c: F.when(job, F.col(c)).otherwise(F.col(f"saved.{c}")).alias(c)
    out = both.select("url", F.when(job, "pipeline_job").otherwise("ad_hoc").alias("origin"), *map(pick, fields[:5]), F.col("saved.path").alias("saved_path"), F.col("saved.verdict").alias("saved_verdict"))
    return out.orderBy(F.desc("generated_at"), "url")
