"""Postings and settings in YAML files: good rows, and rows that tell what is wrong."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dialect import SPARK
from ..operators.numbering import numbered
from ..operators.settings import Company, Persona
from .postings import read_texts

FIELDS = ("company_name", "title", "location", "salary_range", "remote_policy", "description")


def _load(text: str):
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    return yaml.safe_load(text)


def parse_posting(text: str, source: str) -> tuple[dict[str, str], list[str]]:
    """(fields, errors) of one YAML document, nested below ``job`` or not; all six fields must be strings with content."""
    try:
        root = _load(text or "")
    except RuntimeError:
        raise
    except Exception as e:  # the parser's own errors
        return {}, [f"Invalid YAML in job file {source}: {str(e).splitlines()[0]}"]
    if not isinstance(root, dict):
        return {}, [f"Job YAML root must be a mapping object: {source}"]
    root = root["job"] if isinstance(root.get("job"), dict) else root
    found, errors = {}, []
    for name in FIELDS:
        value = root.get(name)
        if not isinstance(value, str):
            errors.append(f"Missing string field '{name}' in {source}")
        elif not value.strip():
            errors.append(f"Field '{name}' cannot be blank in {source}")
        else:
            found[name] = value.strip()
    return found, errors


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for source, text in zip(frame["source_file"], frame["raw_text"]):
            found, errors = parse_posting(text, source)
            rows.append([source, *[found.get(f) for f in FIELDS], errors])
        yield pd.DataFrame(rows, columns=["source_file", *FIELDS, "errors"])


def read_postings(spark: SparkSession, path: str, pattern: str = "*.yaml", recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(postings, errors) of the YAML files below a path."""
    files = read_texts(spark, path, pattern, recursive)
    rows = files.select("source_file", "raw_text").mapInPandas(_parsed, "source_file string, " + ", ".join(f"{f} string" for f in FIELDS) + ", errors array<string>")
    good = F.size("errors") == 0
    return rows.where(good).drop("errors"), rows.where(~good).select("source_file", "errors")


def write_postings(postings: DataFrame, path: str) -> None:
    """Postings as YAML documents, JSON strings being YAML, one text row each."""
    line = lambda f: F.concat(F.lit(f"{f}: "), F.regexp_extract(F.to_json(F.struct(F.col(f).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))
    postings.select(F.concat_ws("\n", *map(line, FIELDS)).alias("value")).write.mode("overwrite").option("lineSep", "\n---\n").text(path)


def load_companies(text: str) -> list[Company]:
    """Tracked companies of a settings file."""
    rows = (_load(text) or {}).get("companies") or []
    texts = lambda r, k: str(r.get(k) or "")
    return [Company(texts(r, "name"), texts(r, "career_url"), texts(r, "corporate_url"), texts(r, "type_hint"), texts(r, "notes"), tuple(r.get("profile_tags") or ()), tuple(r.get("risk_tags") or ())) for r in rows]


def load_personas(text: str) -> list[Persona]:
    """Personas of a settings file; weights must be whole numbers that are not negative."""
    out = []
    for r in (_load(text) or {}).get("personas") or []:
        weights = r.get("signal_weights") or {}
        wrong = [k for k, v in weights.items() if not isinstance(v, int) or isinstance(v, bool) or v < 0]
        if wrong:
            raise ValueError(f"signal_weights must be non-negative whole numbers: {', '.join(sorted(wrong))}")
        out.append(Persona(str(r.get("id") or ""), tuple(r.get("priorities") or ()), tuple(r.get("hard_no") or ()), dict(weights), int(r.get("minimum_salary_yen") or 0), str(r.get("ranking_strategy") or "by_score").lower()))
    return out


def load_blacklist(text: str) -> list[str]:
    return [str(r.get("name") or "") for r in (_load(text) or {}).get("blacklisted_companies") or []]


def ordered(files: DataFrame) -> DataFrame:
    """Adds ``ordinal``: files by path. Paths are few beside texts, so they are numbered apart from them."""
    return files.join(numbered(files.select("source_file"), (), "source_file", "ordinal"), "source_file")


def raw_postings(files: DataFrame) -> DataFrame:
    """Raw text files to postings, with warnings."""
    from ..operators.evaluation import staged
    from ..operators.raw_text import PARSED, stages

    return staged(files, stages(SPARK), PARSED)
