"""Exact top-k by inner product of integer vectors, with vector-approximation files.

Beside its exact vectors, a written block keeps each component's cell, four bits of it,
and the least and greatest value that the block really has in each cell. A query's
products with those values bound every row's score from above. A task first scans the
cells of all its blocks, then reads exact vectors in the order of their bounds until no
bound left exceeds the k-th score found. Queries go to the rows in bounded batches;
equal vectors are one row with its smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import prepare, written

#: Vectors that the cells' marks are fitted on; they only tell how tight bounds are.
SAMPLE_ROWS = 8192
CELLS = 16
BLOCK_ROWS = 4096
#: Queries broadcast at once; more go in several passes over the cells.
QUERY_ROWS = 16384
#: Blocks that a task scans together before it reads exact vectors, and queries for which it holds their bounds: 64 MB.
TASK_BLOCKS, SCAN_QUERIES = 8, 128
#: Exact vectors that are read at a time, in the order of their bounds.
READ_ROWS = 64
_EXACT = 2.0**53


def fit_marks(sample: np.ndarray) -> np.ndarray:
    """(dimensions, CELLS - 1): the marks between cells, by quantiles."""
    if not len(sample):
        return np.zeros((sample.shape[1], CELLS - 1))
    return np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0).T


def approximate(x: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two cells a byte (dimensions / 2, rows), and the least and greatest values of each dimension's cells."""
    n, d = x.shape
    low, high = np.zeros((d + d % 2, CELLS)), np.zeros((d + d % 2, CELLS))
    cells = np.zeros((d + d % 2, n), dtype=np.uint8)
    for j in range(d):
        column = np.ascontiguousarray(x[:, j])
        cells[j] = np.searchsorted(marks[j], column, side="right")
        least, most = np.full(CELLS, np.inf), np.full(CELLS, -np.inf)
        np.minimum.at(least, cells[j], column)
        np.maximum.at(most, cells[j], column)
        some = least <= most
        low[j, some], high[j, some] = least[some], most[some]
    return cells[0::2] * CELLS + cells[1::2], low, high


def upper_bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, rows): no less than each row's inner product with each query.

    Sums of whole numbers below 2**53 are exact in doubles, in any order.
    """
    if q.shape[1] < len(low):
        q = np.column_stack([q, np.zeros(len(q))])
    best = np.maximum(q[:, :, None] * low, q[:, :, None] * high)
    pairs = (best[:, 0::2, :, None] + best[:, 1::2, None, :]).reshape(len(q), len(cells), CELLS * CELLS)
    out = np.zeros((len(q), cells.shape[1]))
    for i in range(len(q)):
        for table, codes in zip(pairs[i], cells, strict=True):
            out[i] += table[codes]
    return out


def _products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of whole numbers; those beyond 2**53 by Python's integers, held at a long's ends."""
    if exact:
        return (x @ q).astype(np.int64)
    whole = [int(b) for b in q]
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in x], dtype=np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the fewest bytes."""
    return x.astype(next(kind for kind in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max))


def _blocks(marks: np.ndarray, size: int):
    """(members, vector) to blocks: ids, cells, the cells' values, exact vectors."""

    def run(parts):
        members, vectors, held = [], [], 0

        def block(m, x):
            cells, low, high = approximate(x.astype(np.float64), marks)
            ids, sizes = np.concatenate(m).astype("<i8"), np.array([len(i) for i in m], "<i4")
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (ids, sizes, cells, low.astype("<f8"), high.astype("<f8"), _narrow(x))], names=["ids", "sizes", "cells", "low", "high", "data"])

        for rows in parts:
            if rows.num_rows:
                members.extend(np.array(m, dtype=np.int64) for m in rows.column("members").to_pylist())
                flat = rows.column("vector").flatten().to_numpy(zero_copy_only=False)
                vectors.append(flat.reshape(rows.num_rows, -1))
                held += rows.num_rows
            while held >= size:
                x = np.concatenate(vectors)
                yield block(members[:size], x[:size])
                members, vectors, held = members[size:], [x[size:]], held - size
        if held:
            yield block(members, np.concatenate(vectors))

    return run


def _answers(query: int, q: np.ndarray, bound: np.ndarray | None, rows, k: int) -> tuple[np.ndarray, np.ndarray]:
    """One query's best (ids, scores) among ``rows``: exact vectors by falling bound until the k-th is certain."""
    ids, ends, sizes, x, exact = rows
    if bound is None:
        at, scores = np.arange(len(x)), _products(x, q, exact)
    else:
        # One row more than asked for, as the query's own id may be all of one.
        first = min(max(READ_ROWS, k + 1), len(x))
        at = np.argpartition(-bound, first - 1)[:first]
        scores = _products(x[at], q, exact)
        certain = lambda s: np.partition(s, len(s) - k - 1)[len(s) - k - 1] if len(s) > k else -np.inf
        least = certain(scores)
        # Equal bounds stay: an equal score with a smaller id wins.
        rest = bound >= least
        rest[at] = False
        rest = np.flatnonzero(rest)
        rest = rest[np.argsort(-bound[rest], kind="stable")]
        for low in range(0, len(rest), READ_ROWS):
            some = rest[low : low + READ_ROWS]
            if bound[some[0]] < least:
                break
            at, scores = np.concatenate([at, some]), np.concatenate([scores, _products(x[some], q, exact)])
            least = certain(scores)
    order = np.lexsort((ids[ends[at] - sizes[at]], -scores.astype(object) if not exact else -scores))[: k + 1]
    at, scores = at[order], scores[order]
    found, scores = np.concatenate([ids[ends[i] - sizes[i] : ends[i]] for i in at]), np.repeat(scores, sizes[at])
    other = found != query
    found, scores = found[other], scores[other]
    order = np.lexsort((found, -scores.astype(object) if not exact else -scores))[:k]
    return found[order], scores[order]


def _search(shared, k: int):
    """Blocks to each query's best (query_id, vec_id, score) of each ``TASK_BLOCKS`` blocks."""

    def answered(blocks):
        query_ids, queries = shared.value
        read = lambda b, name, kind: np.frombuffer(b[name], dtype=kind)
        sizes = np.concatenate([read(b, "sizes", "<i4") for b in blocks])
        ids = np.concatenate([read(b, "ids", "<i8") for b in blocks])
        counts, d = [len(b["sizes"]) // 4 for b in blocks], queries.shape[1]
        x = np.concatenate([read(b, "data", f"<i{len(b['data']) // (n * d)}").reshape(n, d).astype(np.int64) for b, n in zip(blocks, counts, strict=True)])
        approx = [(read(b, "cells", np.uint8).reshape(-1, n), read(b, "low", "<f8").reshape(-1, CELLS), read(b, "high", "<f8").reshape(-1, CELLS)) for b, n in zip(blocks, counts, strict=True)]
        reach = np.abs(x.astype(np.float64)).max() * np.abs(queries.astype(np.float64)).max(initial=0) * d
        exact = reach < _EXACT
        rows = ids, np.cumsum(sizes), sizes, x.astype(np.float64) if exact else x, exact
        out = []
        for low in range(0, len(queries), SCAN_QUERIES):
            qs = queries[low : low + SCAN_QUERIES].astype(np.float64)
            bounds = np.concatenate([upper_bounds(qs, *a) for a in approx], axis=1) if exact else None
            for i in range(len(qs)):
                found, scores = _answers(query_ids[low + i], qs[i] if exact else queries[low + i], bounds[i] if exact else None, rows, k)
                out.append((np.full(len(found), query_ids[low + i]), found, scores))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    def run(parts):
        blocks = []
        for rows in parts:
            for block in rows.to_pylist():
                blocks.append(block)
                if len(blocks) == TASK_BLOCKS:
                    yield answered(blocks)
                    blocks = []
        if blocks:
            yield answered(blocks)

    return run


def top_products(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows with the largest inner product with each query: query_id, rank (from 1), vec_id, score.

    Vectors are taken as whole numbers, floor(``scale`` * x) in double precision. Ties go
    to the smaller id; a query's own id is no candidate, rows with equal vectors are.
    Null vectors, those with null or non-finite components, without components or
    without id, and of another length than most take no part; zero vectors do. Rows that
    repeat an id count once, with the smallest vector. Components and scores beyond a
    long are held at its ends. Other columns are not read; an empty table gives no rows.
    """
    spark = prepare(rows.sparkSession)
    schema = "query_id long, rank int, vec_id long, score long"
    finite = lambda v: F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def clean(df):
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        df = df.where(F.col("vec_id").isNotNull() & F.coalesce((F.size("vector") > 0) & finite(F.col("vector")), F.lit(False)))
        whole = F.transform("vector", lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
        return df.select("vec_id", whole.alias("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector"))

    data, asked = clean(rows), clean(queries)
    lengths = data.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    d, total = lengths[0]["d"], lengths[0]["count"]
    data, asked = (df.where(F.size("vector") == d) for df in (data, asked))
    # Of equal vectors the k + 1 smallest ids can be wanted: k, and the query's own.
    place = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    classes = data.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    sample = classes.orderBy(F.xxhash64("vector"), "vector").select("vector").limit(SAMPLE_ROWS).toArrow().column(0).combine_chunks()
    marks = fit_marks(sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sample), d))
    names = "ids sizes cells low high data".split()
    blocks = written(classes.repartition(max(1, -(-total // BLOCK_ROWS)), "vector").select("members", "vector").mapInArrow(_blocks(marks, BLOCK_ROWS), ", ".join(f"{n} binary" for n in names)), "va-blocks")
    dealt = blocks.repartition(max(1, -(-blocks.count() // TASK_BLOCKS), spark.sparkContext.defaultParallelism))

    # The query set against all rows, a bounded batch of queries at a time.
    asked = written(asked.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-asked.count() // QUERY_ROWS))))), "va-queries")
    found = None
    for batch in sorted(r["batch"] for r in asked.select("batch").distinct().collect()):
        of = asked.where(F.col("batch") == batch).select("vec_id", "vector").toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((of.column(0).to_numpy(), of.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)))
        some = dealt.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long")
        found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    """DuckDB SQL for ``top_products`` of every row against the rows whose id 50 divides, on tables whose ids are unique."""
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
