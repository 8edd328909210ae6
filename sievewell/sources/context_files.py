"""What files tell of companies: one context text a company, from YAML or plain text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import workers_import
from .postings import read_texts
from .yaml_files import _load

#: Of several files of one company the first of these extensions counts.
EXTENSIONS = ("yaml", "yml", "txt")


def flattened(text: str) -> str:
    """The texts of a company's YAML: its name, summaries, titles and descriptions of its pages, titles of its links; repeats once, whatever their case. A file that is no mapping counts as it is."""
    if not (text or "").strip():
        return ""
    root = _load(text)
    if not isinstance(root, dict):
        return text
    listed = lambda key, kind: [x for x in root.get(key) or [] if isinstance(x, kind)] if isinstance(root.get(key), list) else []
    told = [root.get("company_name"), *listed("summaries", str)]
    told += [page.get(k) for page in listed("sources", dict) for k in ("page_title", "page_description")]
    told += [link.get("title") for link in listed("links", dict)]
    once: dict[str, str] = {}
    for t in told:
        if isinstance(t, str) and t.strip():
            once.setdefault(t.strip().lower(), t.strip())
    return " ".join(once.values())


def _flat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for company, extension, text in zip(frame["company"], frame["extension"], frame["raw_text"]):
            try:
                rows.append((company, flattened(text) if extension != "txt" else text or "", None))
            except RuntimeError:
                raise
            except Exception as e:  # the parser's own errors
                rows.append((company, "", f"{company}.{extension}: {str(e).splitlines()[0]}"))
        yield pd.DataFrame(rows, columns=["company", "context", "warning"])


def contexts(files: DataFrame) -> DataFrame:
    """(company, context, warning) of files (source_file, raw_text), a row a company, which the file's name gives; files of other extensions do not count.

    A file that cannot be read gives an empty context and a warning, and no other file of the company takes its place. Spark lists no files without bytes, so these count as absent.
    """
    workers_import(files.sparkSession)
    name = F.regexp_extract("source_file", r"([^/]+)\.([A-Za-z]+)$", 1)
    extension = F.lower(F.regexp_extract("source_file", r"([^/]+)\.([A-Za-z]+)$", 2))
    place = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.col("extension"))
    known = files.select(name.alias("company"), extension.alias("extension"), "source_file", "raw_text").where(F.col("extension").isin(*EXTENSIONS))
    best = known.groupBy("company").agg(F.min_by(F.struct("extension", "raw_text"), F.struct(place, "source_file")).alias("best"))
    return best.select("company", "best.*").mapInPandas(_flat, "company string, context string, warning string")


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """The contexts of the files below a path."""
    return contexts(read_texts(spark, path, "*.{" + ",".join(EXTENSIONS) + "}"))
