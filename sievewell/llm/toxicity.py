"""Toxicity by a classifier chain of linear models.

Categories are predicted in order. Each model is linear in hashed words and in
the probabilities of the categories before it; for fitting, those probabilities
come from models that did not see the row (out of fold), as they will be when
new documents are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare
from .quality import held_out, labelled
from .texthash import batches, token_hashes

BUCKETS = 1 << 18
#: Labelled documents that the chain is fitted on at most, and hashed words it keeps.
SAMPLE_ROWS = 12_000
WORDS, STEM_BYTES = 256, 4
#: Documents that a word must stand in.
MIN_ROWS = 2
FOLDS, STEPS, PENALTY = 4, 30, 0.05
#: Labels name toxicity as a whole, so the categories before it are groups of telling words.
CATEGORIES = ("group_1", "group_2", "toxic")


def _words(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed word or word stem, how often) without repetition."""
    hashes, at, stems = token_hashes(part, lower=True, stems=STEM_BYTES)
    doc = np.repeat(np.arange(len(part)), np.diff(at))
    long_enough = stems > 0
    doc, hashes = np.concatenate([doc, doc[long_enough]]), np.concatenate([hashes, stems[long_enough]])
    pair, count = np.unique(doc * BUCKETS + (hashes >> np.uint64(20)).astype(np.int64) % BUCKETS, return_counts=True)
    return pair // BUCKETS, pair % BUCKETS, np.minimum(count, 3)


def _present(parts):
    for rows in parts:
        for low, part in batches(rows.column(1).to_pylist()):
            doc, word, count = _words(part)
            at = pa.array(np.searchsorted(doc, np.arange(len(part) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (word, count)]
            yield pa.RecordBatch.from_arrays([rows.column(0).slice(low, len(part)), rows.column(2).slice(low, len(part)), *lists], names=["doc_id", "y", "words", "counts"])


class _Linear:
    """Logistic regression with a small penalty, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        z = np.column_stack([x, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], PENALTY)
        penalty[-1] = 1e-6
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        for _ in range(STEPS):
            p = _probability(z @ w)
            g = z.T @ (p - y) + penalty * w
            h = (z * (p * (1 - p))[:, None]).T @ z
            h[np.diag_indices_from(h)] += penalty
            step = np.linalg.solve(h, g)
            w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-4:
                break
        self.w, self.b = w[:-1], w[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class Chain:
    """Linear models in the order of their categories; what earlier ones say of a row comes from models, words and groups that were chosen without it."""

    def __init__(self, words: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray):
        self.kept, x, shows = _features(words, counts, y, np.ones(len(y), bool))
        fold = np.arange(len(y)) % FOLDS
        unseen = np.zeros((len(y), len(CATEGORIES) - 1))
        for k in range(FOLDS):
            inside = fold != k
            if y[inside].min() == y[inside].max():
                continue
            _, own, own_shows = _features(words, counts, y, inside)
            for c in range(unseen.shape[1]):
                known = np.column_stack([own, unseen[:, :c]])
                unseen[~inside, c] = _probability(_Linear(known[inside], own_shows[inside, c]).logit(known[~inside]))
        self.models = [_Linear(np.column_stack([x, unseen[:, :c]]), t) for c, t in enumerate([*shows.T, y])]

    def tables(self, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of words, biases, and weights of earlier categories."""
        n = len(self.models)
        earlier = np.zeros((n, n))
        for c, m in enumerate(self.models):
            earlier[c, :c] = m.w[words:]
        return np.column_stack([m.w[:words] for m in self.models]), np.array([m.b for m in self.models]), earlier


def _features(words, counts, y, inside):
    """(kept words, counts of them, the groups that each row shows), chosen by the rows inside."""
    kept = _select([w for w, i in zip(words, inside) if i], y[inside])
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    x = np.zeros((len(words), len(kept)))
    for i, w in enumerate(words):
        at = place[w]
        x[i, at[at >= 0]] = counts[i][at >= 0]
    early = len(CATEGORIES) - 1
    strongest = np.arange(min(len(kept), 16 * early))
    shows = [(x[:, strongest[c::early]].sum(axis=1) > 0) & (y > 0) for c in range(early)]
    return kept, x, np.column_stack(shows).astype(float)


def _select(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The hashed words that tell the label best, most telling first."""
    ones = [d for d, t in zip(docs, y) if t]
    a = np.bincount(np.concatenate(ones), minlength=BUCKETS) if ones else np.zeros(BUCKETS)
    n = np.bincount(np.concatenate(docs), minlength=BUCKETS)
    p, q = (a + 0.5) / (len(ones) + 1), (n - a + 0.5) / (len(docs) - len(ones) + 1)
    gain = np.where(n >= MIN_ROWS, p * np.log(p / q) * (p > q), 0)
    telling = np.argsort(-gain, kind="stable")[:WORDS]
    return telling[gain[telling] > 0]


def _lists(column) -> list[np.ndarray]:
    """The lists of a column as views of one array of 32-bit numbers."""
    column = column.combine_chunks()
    flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1]) if len(ends) else []


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int):
    """(kept words, tables of the chain) or None without both labels.

    The earlier categories of the chain are read off the toxic documents: the most
    telling words, dealt alternately to the groups, say which a toxic document shows.
    """
    sample = labelled(docs, labels, label_col, id_col, text_col, sample_rows)
    rows = sample.select("doc_id", "text", "y").mapInArrow(_present, "doc_id long, y int, words array<int>, counts array<int>").toArrow()
    words, counts = (_lists(rows.column(c)) for c in ("words", "counts"))
    ids, labels_of = rows.column("doc_id").to_numpy(), rows.column("y").to_numpy()
    del rows
    order = sorted(range(len(ids)), key=lambda i: (ids[i], labels_of[i], words[i].tobytes(), counts[i].tobytes()))
    y, words, counts = labels_of[order].astype(float), [words[i] for i in order], [counts[i] for i in order]
    if not len(y) or y.min() == y.max():
        return None
    if not len(_select(words, y)):
        return None
    chain = Chain(words, counts, y)
    return chain.kept, chain.tables(len(chain.kept))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, the probability of each category, ``score``, ``predicted``.

    ``score`` is the last category's probability, ``predicted`` 1 from 0.5. Labels of
    held-out rows are not read. Null and empty texts are scored as texts without
    words; repeated rows are scored each; an id labelled several times counts with
    its largest label; without labels of both kinds every score is 0. Columns other
    than id and text are not read.
    """
    spark = prepare(docs.sparkSession)
    fitted = fit(docs, labels.where(~held_out(F.col(id_col))), id_col, text_col, label_col, sample_rows)
    shared = spark.sparkContext.broadcast(fitted)
    names = [f"p_{c}" for c in CATEGORIES]

    def run(parts):
        model = shared.value
        if model:
            kept, (weights, bias, earlier) = model
            place = np.full(BUCKETS, -1)
            place[kept] = np.arange(len(kept))
        for rows in parts:
            for low, part in batches(rows.column(1).to_pylist()):
                out = np.zeros((len(part), len(names)))
                if model:
                    doc, word, count = _words(part)
                    at = place[word]
                    doc, count, at = doc[at >= 0], count[at >= 0], at[at >= 0]
                    for c in range(len(names)):
                        logit = np.bincount(doc, weights=weights[at, c] * count, minlength=len(part)) + bias[c]
                        out[:, c] = _probability(logit + out[:, :c] @ earlier[c, :c])
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(low, len(part)), *(pa.array(x) for x in out.T)], names=["doc_id", *names])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))
    score = F.col(names[-1])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *names, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
