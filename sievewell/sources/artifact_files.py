"""Stored evaluations of single sources, a YAML file each: good rows, and rows that tell what is wrong."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .postings import read_texts
from .yaml_files import FIELDS, _load

COLUMNS = ("path", "persona", "candidate_profile", "kind", "url", "raw_text", *FIELDS, "verdict", "score", "generated_at")
SCHEMA = ", ".join(f"{c} {'int' if c == 'score' else 'timestamp' if c == 'generated_at' else 'string'}" for c in COLUMNS)


def parse_artifact(text: str, path: str) -> tuple[dict, list[str]]:
    """(columns, errors) of one file: a persona, a source with its kind and an address or a text, and what was read and judged, if told."""
    try:
        root = _load(text or "")
    except RuntimeError:
        raise
    except Exception as e:  # the parser's own errors
        return {}, [f"Invalid YAML in artifact {path}: {str(e).splitlines()[0]}"]
    if not isinstance(root, dict):
        return {}, [f"Artifact root must be a mapping object: {path}"]
    part = lambda key: root[key] if isinstance(root.get(key), dict) else {}
    text_of = lambda where, key: where[key].strip() if isinstance(where.get(key), str) else ""
    source, job, told = part("source"), part("job_input"), part("evaluation")
    out = {"path": path, "persona": text_of(root, "persona"), "candidate_profile": text_of(root, "candidate_profile"), "kind": text_of(source, "kind"), "url": text_of(source, "url"), "raw_text": text_of(source, "raw_text"), **{f: text_of(job, f) for f in FIELDS}}
    out["verdict"] = text_of(told, "verdict") or None
    out["score"] = told["score"] if isinstance(told.get("score"), int) and not isinstance(told["score"], bool) else None
    out["generated_at"] = _time(root.get("generated_at"))
    errors = [f"Missing string field '{name}' in {path}" for name, value in (("persona", out["persona"]), ("source.kind", out["kind"])) if not value]
    if not out["url"] and not out["raw_text"]:
        errors.append(f"An artifact needs source.url or source.raw_text: {path}")
    return out, errors


def _time(value) -> datetime | None:
    """A time with its zone, or in UTC; null if it is none."""
    try:
        out = value if isinstance(value, datetime) else datetime.fromisoformat(str(value).strip())
    except ValueError:
        return None
    return out.astimezone(timezone.utc) if out.tzinfo else out.replace(tzinfo=timezone.utc)


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, text in zip(frame["source_file"], frame["raw_text"]):
            found, errors = parse_artifact(text, path)
            rows.append([path, *[found.get(c) for c in COLUMNS[1:]], errors])
        out = pd.DataFrame(rows, columns=[*COLUMNS, "errors"])
        out["score"], out["generated_at"] = out["score"].astype("Int32"), pd.to_datetime(out["generated_at"], utc=True)
        yield out


def read_artifacts(spark: SparkSession, path: str, pattern: str = "*.yaml") -> tuple[DataFrame, DataFrame]:
    """(artifacts, errors) of the files in a folder."""
    rows = read_texts(spark, path, pattern).mapInPandas(_parsed, f"{SCHEMA}, errors array<string>")
    good = F.size("errors") == 0
    return rows.where(good).drop("errors"), rows.where(~good).selectExpr("path", "errors")
