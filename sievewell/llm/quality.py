"""Quality classifier: random-indexing word vectors, pooled, then a small calibrated network.

A word's index vector follows from its hash; its context vector is the sum of
the index vectors of the words around it over all documents, counted in Spark
by hashed word. A document is pooled from its words' context vectors: their mean,
their spread, how alike neighbours are, how long the mean is. A two-layer numpy
network is fitted on a bounded sample of labelled documents, its temperature on
rows of that sample held out from fitting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean, prepare
from .texthash import batches, token_hashes

BUCKETS, DIMENSIONS, REACH = 1 << 14, 32, 2
#: Labelled documents that the network is fitted on at most.
SAMPLE_ROWS = 20_000
HIDDEN, STEPS = 32, 400
_SPREAD = 1e-3
_INDEX: list[np.ndarray] = []


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors of all hashed words."""
    if not _INDEX:
        rng = np.random.default_rng(11)
        out = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
        places = rng.permuted(np.tile(np.arange(DIMENSIONS), (BUCKETS, 1)), axis=1)[:, :4]
        np.put_along_axis(out, places, rng.choice(np.array([-1, 1], dtype=np.float32), (BUCKETS, 4)), axis=1)
        _INDEX.append(out)
    return _INDEX[0]


def _buckets(part):
    hashes, at = token_hashes(part, lower=False)
    return (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS, at


@lean
def _contexts(parts):
    """One task's sums of contexts by hashed word."""
    index = index_vectors()
    total, count = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS, dtype=np.int64)
    for rows in parts:
        for _, part in batches(rows.column(0).to_pylist()):
            word, at = _buckets(part)
            n = len(word)
            if not n:
                continue
            doc = np.repeat(np.arange(len(part)), np.diff(at))
            near = np.zeros((n, DIMENSIONS), dtype=np.float32)
            for j in range(1, REACH + 1):
                same = (doc[j:] == doc[:-j])[:, None]
                near[j:] += index[word[:-j]] * same
                near[:-j] += index[word[j:]] * same
            for d in range(DIMENSIONS):
                total[:, d] += np.bincount(word, weights=near[:, d], minlength=BUCKETS)
            count += np.bincount(word, minlength=BUCKETS)
    seen = np.flatnonzero(count)
    if len(seen):
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen]), *(pa.array(total[seen, d]) for d in range(DIMENSIONS))], names=["word", "n", *(f"v{d}" for d in range(DIMENSIONS))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(vectors, weights) of all hashed words, counted over all documents; a table of fixed size."""
    prepare(docs.sparkSession)
    columns = [f"v{d}" for d in range(DIMENSIONS)]
    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(_contexts, "word long, n long, " + ", ".join(f"{c} double" for c in columns))
    summed = partial.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).toPandas()
    vectors, share = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS)
    if len(summed):
        n = summed["n"].to_numpy().astype(float)
        v = summed[columns].to_numpy() / n[:, None]
        v -= (v * n[:, None]).sum(axis=0) / n.sum()
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
        vectors[summed["word"]] = v
        share[summed["word"]] = n / n.sum()
    return vectors.astype(np.float32), (_SPREAD / (_SPREAD + share)).astype(np.float32)


def _pool(part, vectors, weights):
    word, at = _buckets(part)
    n = np.diff(at)
    v = vectors[word]
    filled = n > 0
    first = at[:-1][filled]

    def mean(x):
        out = np.zeros((len(n), *x.shape[1:]), dtype=np.float64)
        if filled.any():
            out[filled] = np.add.reduceat(x, first, axis=0) / n[filled].reshape(-1, *[1] * (x.ndim - 1))
        return out

    centre, square, weighted = mean(v), mean(v * v), mean(v * weights[word][:, None])
    alike = np.zeros(len(word), dtype=np.float32)
    if len(word):
        doc = np.repeat(np.arange(len(n)), n)
        alike[1:] = (v[1:] * v[:-1]).sum(axis=1) * (doc[1:] == doc[:-1])
    near = mean(alike)
    length = np.linalg.norm(centre, axis=1)
    effective = length**2 * np.maximum(n, 1)
    return np.column_stack([centre, np.sqrt(np.maximum(0, square - centre**2)), weighted, near, length, np.log1p(effective), np.log1p(n), filled]).astype(np.float32)


def _batches(rows, vec, wts):
    """Slices of a batch (id, text, ...) with the features of their texts."""
    for low, part in batches(rows.column(1).to_pylist()):
        yield rows.slice(low, len(part)), _pool(part, vec, wts)


def features(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<float>) of every row, with broadcast vectors and weights."""

    @lean
    def run(parts):
        for rows in parts:
            for some, x in _batches(rows, *shared.value):
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([some.column(0), flat], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<float>")


class Network:
    """Standardised input, one hidden layer, a logit, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.temperature, self.bias = 1.0, 0.0
        self.w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0
        held = rng.random(len(x)) < 0.2
        if len(x) < 50 or y[~held].min() == y[~held].max():
            held[:] = False
        self._fit(x[~held], y[~held], rng)
        if held.any():
            self._calibrate(x[held], y[held])

    def _hidden(self, x):
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)

    def _fit(self, x, y, rng):
        params = [self.w1, self.b1, self.w2, np.array([self.b2])]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        for step in range(1, STEPS + 1):
            pick = rng.choice(len(z), min(len(z), 1024), replace=False)
            a, t = z[pick], y[pick]
            h = np.tanh(a @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            g = (p - t) / len(pick)
            dh = np.outer(g, params[2]) * (1 - h * h)
            grads = [a.T @ dh + 1e-4 * params[0], dh.sum(axis=0), h.T @ g + 1e-4 * params[2], np.array([g.sum()])]
            for q, grad, mm, vv in zip(params, grads, m, v):
                mm *= 0.9
                mm += 0.1 * grad
                vv *= 0.999
                vv += 0.001 * grad * grad
                q -= 0.01 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = params[0], params[1], params[2], float(params[3][0])

    def _calibrate(self, x, y):
        logit = self._hidden(x) @ self.w2 + self.b2
        loss = lambda t: np.logaddexp(0, np.where(y > 0.5, -logit, logit) / t).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self._hidden(x) @ self.w2 + self.b2) / self.temperature, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, sample_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``sample_rows`` labelled documents, chosen by the hash of their id; one row per id."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, shared, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """A network from labelled documents, their rows in the order of ids, so that it does not depend on the partitioning."""
    sample = labelled(docs, labels, label_col, id_col, text_col, sample_rows)
    y = dict(sample.select("doc_id", "y").collect())
    rows = sorted(features(sample, shared).collect())
    if not rows:
        return None
    return Network(np.array([r["x"] for r in rows], dtype=np.float64), np.array([y[r["doc_id"]] for r in rows], dtype=np.float64))


def held_out(doc_id) -> F.col:
    """Rows that no label is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted`` and the carried columns.

    Labels of held-out rows are never read. Null and empty texts are scored as
    texts without words; repeated rows are scored each; an id labelled several
    times counts with its largest label, an id with several texts is learned from
    its smallest; null or other labels are ignored. Without any label every score
    is 0.5. Columns that are neither id, text nor carried are not read.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(word_vectors(docs, text_col))
    network = fit(docs, labels.where(~held_out(F.col(id_col))), shared, label_col, id_col, text_col, sample_rows)

    @lean
    def run(parts):
        for rows in parts:
            for some, x in _batches(rows, *shared.value):
                s = network.scores(x.astype(np.float64)) if network else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(s), *some.columns[2:]], names=["doc_id", "score", *some.schema.names[2:]])

    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(carry)]
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *kept)
    schema = ", ".join(["doc_id long, score double", *(f"kept_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))])
    scored = read.mapInArrow(run, schema)
    carried = [F.col(f"kept_{i}").alias(c) for i, c in enumerate(carry)]
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *carried)
