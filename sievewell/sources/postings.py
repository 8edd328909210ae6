"""Postings: made from the driver's tables, or read from text files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lexicon as L
from ..functions.dialect import SPARK, Spark

COLUMNS = ("ordinal", "source_file", "company_name", "title", "location", "salary_range", "remote_policy", "description")
_TITLES = ("Senior Backend Engineer", "Junior Developer", "Engineering Manager", "Platform Engineer", "Physicist", "Data Analyst", "Staff Engineer, Payments", "Mid-level Programmer")
_REMOTE = ("Hybrid (2 days onsite)", "Remote", "Onsite-only, Tokyo office", "Unspecified", "Office days agreed by team", "Work from home")
_MORE = (
    "English-first team.", "Japanese is a plus.", "JLPT N2 or above.", "All internal communications in Japanese.", "Position: physicist in research.", "Core time: 10:00-15:00.",
    "Average overtime: 12h/month.", "5+ years of experience with Java.", "Our team ships with product managers a customer-facing product.", "Tech blog and developer experience.",
    "Coding test on HackerRank.", "We offer benefits.", "Exciting opportunity to grow with us.", "Minimum 40 hours per week.",
)


def _phrases() -> list[tuple[str, int, int]]:
    """(phrase, modulus, remainder): each word list speaks in some postings."""
    lists = [v for k, v in vars(L).items() if k.isupper() and isinstance(v, tuple) and not k.endswith("PATTERNS") and not k.startswith(("CANDIDATE", "SENIOR", "ROLE_S", "ROLE_N", "SALARY", "ONSITE"))]
    phrases = [words[len(words) // 2].capitalize() + "." for words in lists] + list(_MORE)
    return [(p, 5 + 3 * (i % 9) + i % 5, i % 5) for i, p in enumerate(phrases)]


def expressions(d: Spark, salary_shift: str = "0") -> dict[str, str]:
    """Posting columns over orders joined with customer and nation."""
    pick = lambda key, values: f"case {key} % {len(values)} " + " ".join(f"when {i} then {d.text(v)}" for i, v in enumerate(values)) + " end"
    low = f"(4000000 + (o_orderkey * 7919 % 6000) * 1000 + {salary_shift})"
    high = f"({low} + (o_orderkey % 5) * 1000000 - 400000)"
    said = " || ".join(f"case when o_orderkey % {m} = {r} then {d.text(p + ' ')} else '' end" for p, m, r in _phrases())
    return {
        "ordinal": "o_orderkey",
        "source_file": "'order-' || cast(o_orderkey as varchar(20))",
        "company_name": "case o_custkey % 7 when 0 then 'Aomori Pay' when 1 then 'Kita Retail KK' when 2 then 'minato learn' when 3 then 'Umi Staffing' when 4 then 'Unknown Company' else c_name end",
        "title": pick("o_orderkey", _TITLES),
        "location": "n_name",
        "salary_range": f"case o_orderkey % 9 when 0 then 'TBD' when 1 then '' when 2 then 'JPY 9M - 12.5M' when 3 then 'up to 8 million yen' else 'JPY ' || cast({low} as varchar(20)) || ' - ' || cast({high} as varchar(20)) end",
        "remote_policy": pick("(o_orderkey * 3 + o_custkey)", _REMOTE),
        "description": said,
    }


#: Rows of a task, about, where signals are told: they cost up to milliseconds of CPU a row.
TASK_ROWS = 50_000


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df``, which has about so many ``rows``, over all cores, in tasks of some ``TASK_ROWS`` rows however large it is.

    The number is given, so that Spark does not merge narrow partitions back into long tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, math.ceil(rows / TASK_ROWS)), key)


def postings(spark: SparkSession, sf_dir: str, salary_shift: str = "0") -> DataFrame:
    """A posting per order. Nations are a fixed handful, so they are broadcast; customers grow with the orders, so they are not, whatever the size of their file."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    met = orders.join(read("customer").select("c_custkey", "c_name", "c_nationkey").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    joined = spread(met, "o_orderkey", orders.count()).join(F.broadcast(read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr(*[f"{e} as {n}" for n, e in expressions(SPARK, salary_shift).items()], "o_orderdate")


def postings_sql(d: Spark, salary_shift: str = "0") -> str:
    columns = ", ".join(f"{e} as {n}" for n, e in expressions(d, salary_shift).items())
    return f"(select {columns}, o_orderdate from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(source_file, raw_text) of the files below a path; each file is a row."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw_text"))
