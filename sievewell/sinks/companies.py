"""What was found for each company: raw postings, context, the career page that it was found on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import web
from ..functions.dialect import SPARK
from .versioned import Versioned

RESOLUTION = "company_id string, career_url string, resolved_url string, confidence int, jobs_found int, updated_at timestamp"


def raw_posting_texts(found: DataFrame) -> DataFrame:
    """(company, file_name, raw_text) of rows (company_id, company_name, career_url, rank, title, url, snippet, fetched_at): texts that parse back into postings."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    text = F.concat_ws(
        "\n",
        line("Company", F.col("company_name")),
        line("Company ID", F.col("company_id")),
        line("Title", F.col("title")),
        line("Source URL", F.coalesce(F.expr("nullif(trim(url), '')"), F.col("career_url"))),
        line("Fetched At", F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.lit("Location: Unspecified\nSalary: TBD\nDescription:"),
        F.coalesce("snippet", F.lit("")),
        F.lit(""),
    )
    slug = lambda c: F.expr(web.slug(SPARK, f"trim(coalesce({c}, ''))"))
    # At least two digits, as many as it takes.
    number = F.expr("lpad(cast(rank as string), greatest(2, length(cast(rank as string))), '0')")
    return found.select(slug("company_id").alias("company"), F.concat(number, F.lit("-"), slug("title"), F.lit(".txt")).alias("file_name"), text.alias("raw_text"))


def _replace_partitions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("company").parquet(path)


def write_raw_postings(found: DataFrame, path: str) -> None:
    """A partition per company, replaced whole: what a company no longer has goes, companies without rows stay as they were."""
    _replace_partitions(raw_posting_texts(found), path)


def write_context(summaries: DataFrame, path: str) -> None:
    """(company_id, page_title, page_description, contexts, links) by company; those with nothing to tell are not written."""
    told = (F.coalesce("page_title", F.lit("")) != "") | (F.coalesce("page_description", F.lit("")) != "") | (F.size("contexts") > 0)
    company = F.expr(web.slug(SPARK, "trim(coalesce(company_id, ''))"))
    _replace_partitions(summaries.where(told).withColumn("company", company), path)


def remember_resolution(found: DataFrame, state: Versioned) -> None:
    """Companies with postings take the page they were found on into the state; the others keep theirs."""
    state.merge(found.where("jobs_found > 0 and trim(coalesce(resolved_url, '')) <> ''"), "company_id", "updated_at")


def known_resolution(state: Versioned) -> DataFrame:
    return state.read(RESOLUTION)
