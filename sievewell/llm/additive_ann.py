"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one of each codebook.
Codebooks are fitted stage by stage on the residuals of a bounded sample; codes
are found by beam search. A query's products with all codewords make a lookup
table, so a candidate's distance is a sum of table entries plus its stored norm.
Queries go to the rows, in bounded batches; each task keeps every query's best so
far over all its blocks. The best of the first block are ranked by their exact
distance, and from then on all whose table distance, less the error of their code,
does not exceed the last distance kept: what the table cannot rule out is looked
at. Equal vectors are coded once, as a class with its smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import prepare, written
from .vectors import is_valid, matrix, sample_matrix

#: Rows that codebooks are fitted on; every row is coded.
SAMPLE_ROWS = 8192
CODEBOOKS, CODEWORDS, BEAM = 16, 256, 3
BLOCK_ROWS = 4096
#: Queries that are broadcast at once, 8 MB at 64 dimensions; more go in several passes over the codes.
QUERY_ROWS = 16384
#: Blocks of a task, over which it keeps each query's best.
TASK_BLOCKS = 16
#: Candidates of a task's first block that are ranked exactly first, for each query; they give the bound for the others.
RERANKED = 128


def fit_codebooks(x: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, rounds: int = 4) -> np.ndarray:
    """Residual k-means: (codebooks, codewords, dimensions)."""
    rng = np.random.default_rng(7)
    rest, books = x.copy(), []
    for _ in range(codebooks):
        k = min(codewords, len(rest))
        book = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(rounds):
            near = (np.einsum("ij,ij->i", book, book) - 2 * rest @ book.T).argmin(axis=1)
            total = np.zeros_like(book)
            np.add.at(total, near, rest)
            count = np.bincount(near, minlength=k)
            book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
        near = (np.einsum("ij,ij->i", book, book) - 2 * rest @ book.T).argmin(axis=1)
        rest -= book[near]
        books.append(np.vstack([book, np.repeat(book[:1], codewords - k, axis=0)]))
    return np.array(books)


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, codebooks), squared norms of what they stand for, and its distances from the rows."""
    n, d = x.shape
    k = books.shape[1]
    rest = x[:, None, :]
    codes = np.zeros((n, 1, 0), dtype=np.uint8)
    for book in books:
        cost = np.einsum("kj,kj->k", book, book)[None, None, :] - 2 * (rest @ book.T) + np.einsum("nbj,nbj->nb", rest, rest)[:, :, None]
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        of, word = best // k, best % k
        rest = np.take_along_axis(rest, of[:, :, None], axis=1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, of[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
    error = np.einsum("nbj,nbj->nb", rest, rest)
    pick = error.argmin(axis=1)
    rows = np.arange(n)
    coded = x - rest[rows, pick]
    return codes[rows, pick], np.einsum("ij,ij->i", coded, coded), np.sqrt(error[rows, pick])


def _blocks(books: np.ndarray, size: int):
    """Rows (members, embedding) to blocks with codes, norms and errors."""

    def run(parts):
        members, xs, held = [], [], 0

        def block(m, x):
            codes, norms, errors = beam_encode(x, books)
            ids, sizes = np.concatenate(m).astype("<i8"), np.array([len(i) for i in m], "<i4")
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (ids, sizes, x.astype("<f8"), codes, norms.astype("<f8"), errors.astype("<f8"))], names=["ids", "sizes", "data", "codes", "norms", "errors"])

        for rows in parts:
            if rows.num_rows:
                members.extend(np.array(m, dtype=np.int64) for m in rows.column("members").to_pylist())
                xs.append(matrix(rows.column("embedding")))
                held += rows.num_rows
            while held >= size:
                x = np.concatenate(xs)
                yield block(members[:size], x[:size])
                members, xs, held = members[size:], [x[size:]], held - size
        if held:
            yield block(members, np.concatenate(xs))

    return run


def _search(books: np.ndarray, shared, k: int, reranked: int):
    """Blocks to each query's best (query_id, vec_id, score) among the task's rows."""

    def run(parts):
        query_ids, q = shared.value
        best_ids, best = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for rows in parts:
            for r in range(rows.num_rows):
                read = lambda name, kind: np.frombuffer(rows.column(name)[r].as_py(), dtype=kind)  # noqa: B023, E731
                ids, sizes = read("ids", "<i8"), read("sizes", "<i4")
                x, codes = read("data", "<f8").reshape(len(sizes), -1), read("codes", np.uint8).reshape(len(sizes), -1)
                norms, errors = read("norms", "<f8"), read("errors", "<f8")
                ends = np.cumsum(sizes)
                more_ids, more = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), np.inf)
                for low in range(0, len(q), 128):
                    qs = q[low : low + 128]
                    score = np.repeat(norms[None, :].astype(np.float32), len(qs), axis=0)
                    reach = np.full(len(qs), norms.max())
                    for m, book in enumerate(books):
                        lookup = (-2 * (qs @ book.T)).astype(np.float32)
                        reach += np.abs(lookup).max(axis=1)
                        score += lookup[:, codes[:, m]]
                    # What single precision may have added to a score, from the largest sum it can have passed.
                    slack = reach * ((len(books) + 4) * 2.0**-22)
                    for row in range(len(qs)):
                        exact = lambda at: np.sqrt(((x[at] - qs[row]) ** 2).sum(axis=1))  # noqa: B023, E731
                        at, dist = np.zeros(0, np.int64), np.zeros(0)
                        bound = best[low + row, -1] if best.shape[1] == k else np.inf
                        if not np.isfinite(bound):
                            # One class more than asked for, as the query's own id may be the whole of one.
                            keep, last = min(reranked, len(sizes)), min(k + 1, len(sizes))
                            at = np.argpartition(score[row], keep - 1)[:keep]
                            dist = exact(at)
                            bound = np.partition(dist, last - 1)[last - 1] if keep >= last == k + 1 else np.inf
                        least = np.sqrt(np.maximum(score[row] + (qs[row] @ qs[row] - slack[row]), 0)) - errors
                        # Written so that a score that is no number stays a candidate.
                        open_ = ~(least > bound * (1 + 1e-9) + 1e-12)
                        open_[at] = False
                        others = np.flatnonzero(open_)
                        at, dist = np.concatenate([at, others]), np.concatenate([dist, exact(others)])
                        if not len(at):
                            continue
                        order = np.lexsort((ids[ends[at] - sizes[at]], dist))[: k + 1]
                        at, dist = at[order], dist[order]
                        found = np.concatenate([ids[ends[i] - sizes[i] : ends[i]] for i in at])
                        dist = np.repeat(dist, sizes[at])
                        other = found != query_ids[low + row]
                        found, dist = found[other], dist[other]
                        order = np.lexsort((found, dist))[:k]
                        more_ids[low + row, : len(order)], more[low + row, : len(order)] = found[order], dist[order]
                all_ids, all_ = np.concatenate([best_ids, more_ids], axis=1), np.concatenate([best, more], axis=1)
                order = np.lexsort((all_ids, all_), axis=1)[:, :k]
                best_ids, best = np.take_along_axis(all_ids, order, axis=1), np.take_along_axis(all_, order, axis=1)
        on = np.isfinite(best)
        if on.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(query_ids[:, None], on.shape)[on]), pa.array(best_ids[on]), pa.array(best[on])], names=["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", reranked: int = RERANKED) -> DataFrame:
    """The ``k`` nearest found rows of each query: query_id, rank (from 1), vec_id, score.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller
    id; a query's own id is no candidate. Null, empty, zero or non-finite vectors,
    null ids, and vectors of another length than most rows take no part. Rows that
    repeat an id count once, with the smallest vector. Other columns are not read;
    empty tables give an empty result.
    """
    spark = prepare(rows.sparkSession)

    def clean(df):
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
        return df.where(is_valid(F.col("embedding")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    data, asked = clean(rows), clean(queries)
    lengths = data.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    d, total = lengths[0]["d"], lengths[0]["count"]
    data, asked = (df.where(F.size("embedding") == d) for df in (data, asked))
    # Of equal vectors the k + 1 smallest ids can be wanted: k, and the query's own.
    same = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    first = data.withColumn("place", same).where(F.col("place") <= k + 1)
    classes = first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).withColumn("vec_id", F.col("members")[0])
    books = fit_codebooks(sample_matrix(classes, "embedding", "vec_id", SAMPLE_ROWS))
    names = "ids sizes data codes norms errors".split()
    coded = classes.repartition(max(1, -(-total // BLOCK_ROWS)), "vec_id").select("members", "embedding").mapInArrow(_blocks(books, BLOCK_ROWS), ", ".join(f"{n} binary" for n in names))
    coded = written(coded, "aq-blocks")
    blocks = coded.count()
    dealt = coded.repartition(min(max(-(-blocks // TASK_BLOCKS), spark.sparkContext.defaultParallelism), max(blocks, 1)))

    # The query set against all rows, a bounded batch of queries at a time; few batches, as queries are a stated few of all rows.
    asked = written(asked.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-asked.count() // QUERY_ROWS))))), "aq-queries")
    found = None
    for batch in sorted(r["batch"] for r in asked.select("batch").distinct().collect()):
        rows_of = asked.where(F.col("batch") == batch).select("vec_id", "embedding").toArrow()
        shared = spark.sparkContext.broadcast((rows_of.column(0).to_numpy(), matrix(rows_of.column(1).combine_chunks())))
        some = dealt.mapInArrow(_search(books, shared, k, reranked), "query_id long, vec_id long, score double")
        found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], schema)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
