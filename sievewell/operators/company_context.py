"""Which tracked company a posting's company is, and what is known of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import web
from ..functions.dialect import SPARK


def _within(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(longer, shorter): pairs of texts, columns ``text``, of which one stands anywhere in the other, itself included.

    Texts are cut into the pieces of the lengths that occur among the shorter ones, and meet
    them by equality. Those lengths, whole numbers up to the longest name, come to the driver.
    Nothing here is broadcast: pieces are many times the file that names come from, by whose
    size Spark would judge them.
    """
    lengths = sorted(r[0] for r in shorter.select(F.length("text")).distinct().collect())
    if not lengths:
        return longer.limit(0).select(F.col("text").alias("longer"), F.col("text").alias("shorter"))
    sized = longer.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).where("n <= length(text)")
    pieces = sized.selectExpr("text as longer", "explode(array_distinct(transform(sequence(1, length(text) - n + 1), i -> substr(text, i, n)))) as shorter")
    return pieces.join(shorter.select(F.col("text").alias("shorter")).hint("merge"), "shorter").select("longer", "shorter")


def tracked_names(names: DataFrame, companies: DataFrame) -> DataFrame:
    """(name, ordinal): for each of ``names`` (company_name), trimmed and lower case, the first of ``companies`` (ordinal, company_name) whose name it equals, holds or stands in.

    Each distinct name is looked up once; blank names of either side match nothing. Names
    that match none have no row.
    """
    once = lambda df: df.selectExpr(f"{SPARK.norm('company_name')} as text").where("text <> ''").distinct()
    told, known = once(names), companies.selectExpr(f"{SPARK.norm('company_name')} as text", "ordinal").where("text <> ''").groupBy("text").agg(F.min("ordinal").alias("ordinal"))
    holds = _within(told, known.select("text")).select(F.col("longer").alias("name"), F.col("shorter").alias("text"))
    stands = _within(known.select("text"), told).select(F.col("shorter").alias("name"), F.col("longer").alias("text"))
    return holds.unionByName(stands).join(known.hint("merge"), "text").groupBy("name").agg(F.min("ordinal").alias("ordinal"))


def with_context(postings: DataFrame, companies: DataFrame, contexts: DataFrame) -> DataFrame:
    """Adds ``company_context`` to postings (company_name): the context (company, context) of the first of ``companies`` (ordinal, company_id, company_name) that matches, empty if there is none.

    A company's file is named by its id in lower case with hyphens. ``evaluate(context="company_context")`` judges by it.
    """
    company = web.slug(SPARK, "trim(coalesce(company_id, ''))")
    told = contexts.select("company", F.col("context").alias("company_context"))
    ids = companies.selectExpr("ordinal", f"{company} as company").groupBy("ordinal").agg(F.min("company").alias("company"))
    by_name = tracked_names(postings, companies).join(ids.hint("merge"), "ordinal").join(told.hint("merge"), "company").select("name", "company_context")
    out = postings.withColumn("_name", F.expr(SPARK.norm("company_name"))).join(by_name.hint("merge"), F.col("_name") == F.col("name"), "left")
    return out.select(*postings.columns, F.coalesce("company_context", F.lit("")).alias("company_context"))
