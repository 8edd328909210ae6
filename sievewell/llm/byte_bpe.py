"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel and stitched where boundaries resynchronise.

Short texts are one chunk. A longer text is cut into chunks that overlap a
little. Each chunk is pre-tokenised from its own start; the first boundary on
which a chunk and its successor agree is a boundary of the whole text too, as
the pattern reads on from there alike. Pieces between such cuts are encoded
apart and their ids concatenated. A text with chunks that never agree is put
together again and encoded whole, so the ids never depend on the chunking.
"""

from __future__ import annotations

import base64

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import prepare, written

CHUNK_CHARS = 16384
OVERLAP_CHARS = 256
#: A match this near the end of a chunk may go on in the text.
_UNSURE = 4
_ENCODINGS: dict[str, tiktoken.Encoding] = {}
_PATTERN = regex.compile(public_tokenizers.PATTERN)


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoding(path: str) -> tiktoken.Encoding:
    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def boundaries(text: str, low: int, high: int, whole: bool) -> list[int]:
    """Sure pre-token boundaries of ``text`` in [low, high) between two ASCII characters of which the first is no white space."""
    sure = len(text) if whole else len(text) - _UNSURE
    out = []
    for m in _PATTERN.finditer(text):
        at = m.end()
        if at >= high or at > sure:
            break
        if at >= low and at < len(text) and text[at - 1].isascii() and text[at].isascii() and not text[at - 1].isspace():
            out.append(at)
    return out


def _cut(chunk: int, overlap: int):
    """Rows (row, text) to chunks (row, chunk, last, piece, head, tail)."""

    def run(parts):
        for rows in parts:
            for row, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                starts = range(0, len(text), chunk)
                last = [s + chunk >= len(text) for s in starts]
                pieces = [text[s : s + chunk + (0 if end else overlap)] for s, end in zip(starts, last)]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(pieces), rows.schema.field(0).type), pa.array(range(len(pieces)), pa.int32()), pa.array(last), pa.array(pieces, pa.string())], names=["row", "chunk", "last", "piece"])

    return run


def _pretokenise(chunk: int, overlap: int):
    def run(parts):
        for rows in parts:
            heads, tails = [], []
            for i, last, piece in zip(rows.column("chunk").to_pylist(), rows.column("last").to_pylist(), rows.column("piece").to_pylist()):
                heads.append(boundaries(piece[: 2 * overlap + 64], 1, overlap, False) if i else [])
                tails.append([] if last else [x - chunk for x in boundaries(piece, chunk, chunk + overlap, False)])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=[*rows.schema.names, "head", "tail"])

    return run


def _encode(path: str):
    """(key..., text) rows: the text becomes ids."""

    def run(parts):
        enc = _encoding(path)
        for rows in parts:
            n = len(rows.schema.names) - 1
            for at in range(0, rows.num_rows, 512):
                part = rows.slice(at, 512)
                ids = [enc.encode_ordinary(t or "") for t in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names[:n], "ids"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row (doc_id, ids array<int>) per input row.

    Null texts count as empty and give no ids; repeated rows each give a row; other
    columns are not read; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    path = ranks_path or default_ranks()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("row", F.struct(F.col("doc_id"), F.monotonically_increasing_id().alias("at")))
    long_text = F.length("text") > chunk_chars
    short = texts.where(~long_text).select("doc_id", "text").mapInArrow(_encode(path), "doc_id long, ids array<int>")

    row = "struct<doc_id:long,at:long>"
    chunks = texts.where(long_text).select("row", "text").mapInArrow(_cut(chunk_chars, overlap_chars), f"row {row}, chunk int, last boolean, piece string")
    chunks = chunks.repartition("row", "chunk")
    seen = chunks.mapInArrow(_pretokenise(chunk_chars, overlap_chars), f"row {row}, chunk int, last boolean, piece string, head array<int>, tail array<int>")
    ordered = W.partitionBy("row").orderBy("chunk")
    agreed = lambda tail, head: F.array_min(F.array_intersect(tail, head))
    seen = seen.withColumn("begin", F.when(F.col("chunk") == 0, 0).otherwise(agreed(F.lag("tail").over(ordered), F.col("head"))))
    seen = seen.withColumn("end", F.when(F.col("last"), F.length("piece")).otherwise(agreed(F.col("tail"), F.lead("head").over(ordered)) + chunk_chars))
    seen = seen.withColumn("fits", F.min(F.col("begin").isNotNull() & F.col("end").isNotNull()).over(W.partitionBy("row")))
    # Both branches read it, so that chunks are cut and pre-tokenised once.
    seen = written(seen.select("row", "chunk", "piece", "begin", "end", "fits"), "bpe-chunks")
    pieces = seen.where("fits").select("row", "chunk", F.expr("substring(piece, begin + 1, end - begin)").alias("text"))
    stitched = pieces.mapInArrow(_encode(path), f"row {row}, chunk int, ids array<int>").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    stitched = stitched.select("row.doc_id", F.flatten("parts.ids").alias("ids"))
    apart = seen.where("not fits").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("chunk", F.substring("piece", 1, chunk_chars).alias("text")))).alias("parts"))
    whole = apart.select("row.doc_id", F.array_join("parts.text", "").alias("text")).mapInArrow(_encode(path), "doc_id long, ids array<int>")
    return short.union(stitched).union(whole)


def decode(encoded: DataFrame, ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids, concatenated. Null ids decode to nothing."""
    prepare(encoded.sparkSession)
    path = ranks_path or default_ranks()
    at = encoded.columns.index(ids_col)

    def run(parts):
        enc = _encoding(path)
        for rows in parts:
            for low in range(0, rows.num_rows, 512):
                part = rows.slice(low, 512)
                texts = [enc.decode_bytes(x or []) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"
    return encoded.mapInArrow(run, schema)
