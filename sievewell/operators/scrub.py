"""Keys and lines that tell where files lie are removed before rows are shown."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Keys and beginnings of lines that tell of files.
PATH_KEYS = ("source_file", "batch_json", "weekly_digest")
LINE_STARTS = ("- source_file:", "source_file:", "batch_json:", "weekly_digest:")


def _cleaned(x: Column, t: DataType, keys: tuple[str, ...]) -> Column | None:
    """``x`` of type ``t`` without the keys, at any depth; null if no field is left of its type. Values that hold none of them are left as they are."""
    if not _holds(t, keys):
        return x
    if isinstance(t, StructType):
        parts = [(f.name, _cleaned(x.getField(f.name), f.dataType, keys)) for f in t.fields if f.name not in keys]
        left = [part.alias(name) for name, part in parts if part is not None]
        return F.when(x.isNotNull(), F.struct(*left)) if left else None
    if isinstance(t, ArrayType):
        return None if _cleaned(x.getItem(0), t.elementType, keys) is None else F.transform(x, lambda v: _cleaned(v, t.elementType, keys))
    if isinstance(t.keyType, StringType):
        x = F.map_filter(x, lambda k, _: ~k.isin(*keys))
    if not _holds(t.valueType, keys):
        return x
    return None if _cleaned(F.lit(None), t.valueType, keys) is None else F.transform_values(x, lambda _, v: _cleaned(v, t.valueType, keys))


def _holds(t: DataType, keys: tuple[str, ...]) -> bool:
    """Whether values of a type can hold one of the keys."""
    if isinstance(t, StructType):
        return any(f.name in keys or _holds(f.dataType, keys) for f in t.fields)
    if isinstance(t, ArrayType):
        return _holds(t.elementType, keys)
    return isinstance(t, MapType) and (isinstance(t.keyType, StringType) or _holds(t.valueType, keys))


def without_keys(rows: DataFrame, keys: tuple[str, ...] = PATH_KEYS) -> DataFrame:
    """Rows without the columns, fields and entries of maps that have one of the names, however deep; one projection. Nulls stay null; a struct of which nothing is left goes."""
    name = lambda c: "`" + c.replace("`", "``") + "`"
    parts = [(f.name, _cleaned(F.col(name(f.name)), f.dataType, keys)) for f in rows.schema.fields if f.name not in keys]
    return rows.select(*[part.alias(c) for c, part in parts if part is not None])


def without_lines(x: str, starts: tuple[str, ...] = LINE_STARTS) -> Column:
    """A text without the lines that begin so, blanks before them aside; lines are joined by line feeds."""
    begins = lambda line: reduce(lambda a, b: a | b, [F.ltrim(F.translate(line, "\t", " ")).startswith(s) for s in starts], F.lit(False))
    return F.array_join(F.filter(F.split(F.col(x), r"\r?\n", -1), lambda line: ~begins(line)), "\n")


def _walked(value, keys: frozenset[str]):
    if isinstance(value, dict):
        return {k: _walked(v, keys) for k, v in value.items() if k not in keys}
    return [_walked(v, keys) for v in value] if isinstance(value, list) else value


def _refuse(name: str):
    raise ValueError(name)


def scrub_json(text: str, keys: tuple[str, ...] = PATH_KEYS) -> str:
    """A JSON text without the keys, at any depth; of a text that is no JSON, or nested too deep, the keys with texts for values are cut out."""
    try:
        return json.dumps(_walked(json.loads(text, parse_constant=_refuse), frozenset(keys)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        for key in keys:
            text = re.sub(rf'"{re.escape(key)}"\s*:\s*"(?:[^"\\]|\\.)*"\s*,?', "", text)
        return re.sub(r",\s*([}\]])", r"\1", text)


def without_json_keys(keys: tuple[str, ...] = PATH_KEYS):
    """A function for columns of JSON texts; their keys differ from row to row, so a helper walks each, in Arrow batches. Null stays null."""

    def scrub(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else scrub_json(t, keys))

    return F.pandas_udf(scrub, "string")
