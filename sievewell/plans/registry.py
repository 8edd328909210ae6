"""Where queries and their SQL are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCKDB, SPARK, Spark
from ..operators.settings import PERSONAS

PERSONA = PERSONAS[0]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_TABLE = re.compile(r"@(region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations)\b")


def sql_query(f: Callable[[Spark], str]):
    """Registers a query that is one SQL text in both dialects; @name stands for a table of the data folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", f(SPARK)))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    ORACLES[f.__name__] = _TABLE.sub(r"\1", f(DUCKDB))
    return run
