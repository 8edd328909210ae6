"""What document filters remove, alone and together, under every order of applying them.

A document's failures are a mask of five bits. A precomputed table has, for each mask
and each of the 120 orders, the step that removes the document. Tasks look their masks
up, add the removals of every part, order and step with bincount, and hand on one
array a part; the arrays are summed. No order is ever run over the documents.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
#: Of each mask and order: the step (from 0) that removes the document, STEPS if none does.
FIRST_FAILURE = np.array([[next((s for s, f in enumerate(order) if mask >> FILTERS.index(f) & 1), STEPS) for order in ORDERS] for mask in range(1 << STEPS)])
#: A part's array: removals by order and step, then failures of each filter, failures of it alone, and all documents.
REMOVED, FAILS, ALONE, ALL = 0, len(ORDERS) * STEPS, len(ORDERS) * STEPS + STEPS, len(ORDERS) * STEPS + 2 * STEPS
CELLS = ALL + 1
#: Parts whose arrays a task holds; with more it hands on what it has and starts again.
TASK_PARTS = 512

_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_SIGNS = re.compile(rb"[#$%&*|]")


def failures(text: bytes) -> int:
    """The bits of filters A to D for a text in UTF-8; ``bytes.split`` cuts at exactly the six ASCII white space characters."""
    words = text.split()
    few = len(words) < 100
    repetitive = 100 * len(set(words)) < 80 * len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    shouting = 100 * capitals > 10 * len(text.translate(None, _CONTINUED))
    return few | repetitive << 1 | shouting << 2 | (_SIGNS.search(text) is not None) << 3


def _judge(parts):
    """(doc_id, part, text) to (doc_id, part, mask of A to D, digest of the text)."""
    for rows in parts:
        masks, digests = [], []
        for value in rows.column("text"):
            text = value.as_py()
            masks.append(failures(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])


def _arrays(masks: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """(3, CELLS): what documents with these masks add, all of them, the good, the toxic (bits 1 and 2 of ``kinds``)."""
    # Equal rows count once with a weight: a batch has at most 32 masks times 4 kinds.
    seen = np.bincount(masks * 4 + kinds, minlength=(1 << STEPS) * 4).reshape(1 << STEPS, 4)
    by_label = np.stack([seen.sum(axis=1), seen[:, 1] + seen[:, 3], seen[:, 2] + seen[:, 3]])
    orders = np.arange(len(ORDERS))
    bits = np.arange(1 << STEPS)[:, None] >> np.arange(STEPS) & 1
    out = np.zeros((3, CELLS), dtype=np.int64)
    for label, counts in enumerate(by_label):
        some = np.flatnonzero(counts)
        cells = (orders * (STEPS + 1) + FIRST_FAILURE[some]).ravel()
        sums = np.bincount(cells, np.repeat(counts[some], len(ORDERS)), len(ORDERS) * (STEPS + 1)).astype(np.int64)
        out[label, REMOVED:FAILS] = sums.reshape(len(ORDERS), STEPS + 1)[:, :STEPS].ravel()
        out[label, FAILS:ALONE] = counts @ bits
        out[label, ALONE:ALL] = counts[1 << np.arange(STEPS)]
        out[label, ALL] = counts.sum()
    return out


def _count(batches):
    """(part, mask, kind) to each part's partial arrays."""

    def handed_on(held):
        cols = [list(held), *([a[label] for a in held.values()] for label in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array([a.tolist() for a in c], pa.list_(pa.int64())) for c in cols[1:])], names=["part", "documents", "good", "toxic"])

    held: dict[str, np.ndarray] = {}
    for rows in batches:
        parts = rows.column("part").dictionary_encode()
        masks, kinds, codes = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (rows.column("mask"), rows.column("kind"), parts.indices))
        for code, part in enumerate(parts.dictionary.to_pylist()):
            of = codes == code
            more = _arrays(masks[of], kinds[of])
            held[part] = held[part] + more if part in held else more
        if len(held) > TASK_PARTS:
            yield handed_on(held)
            held = {}
    if held:
        yield handed_on(held)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask: the failures of every document, bit 0 for A to bit 4 for E, as a written table without its texts.

    A null text counts as empty, a null part as the empty string. A row without id is
    judged like any other, but is neither a copy of a smaller id nor one that others
    copy; rows that repeat an id and a text do not copy each other.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    judged = written(rows.mapInArrow(_judge, "doc_id long, part string, mask int, digest binary"), "audit-masks")
    # Only texts that occur again under a larger id are joined; a group of copies comes down to one row a task before it is shuffled.
    firsts = judged.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("digest", "first_id")
    copied = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int")
    return judged.join(firsts, "digest", "left").select("doc_id", "part", (F.col("mask") + F.lit(1 << 4) * copied).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """How five filters act on each part of the documents under all orders: 600 rows a part.

    The filters fail: A texts of under 100 words; B with fewer distinct words than 80 %
    of all; C with capitals A-Z on more than 10 % of the code points; D with one of
    ``#$%&*|``; E equal to the text of any smaller id, removed or not. Columns: part,
    filter_order, step (from 1), kept, removed, redundant (failing, but removed
    earlier), unique_fails, good_lost (removed, quality 1), toxic_lost (removed, toxic 1)
    and shapley (the filter's removals over all orders). A document is good or toxic if
    any label row of its id says so; rows without id have no label. Edges of documents
    as in ``masks``; an empty table gives no rows; other columns are not read.
    """
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    kind = F.coalesce("good", F.lit(0)) + 2 * F.coalesce("bad", F.lit(0))
    rows = masks(docs, id_col, text_col, part_col).join(said, "doc_id", "left").select("part", "mask", kind.alias("kind"))
    partial = rows.mapInArrow(_count, "part string, documents array<long>, good array<long>, toxic array<long>")

    cells = partial.select("part", F.posexplode(F.arrays_zip("documents", "good", "toxic")).alias("cell", "n"))
    sums = cells.groupBy("part", "cell").agg(*(F.sum(f"n.{c}").alias(c) for c in ("documents", "good", "toxic")))
    # A part has exactly CELLS sums, so they fit a row.
    table = sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("cell", "documents", "good", "toxic"))).alias("sums"))

    orders = F.array(*(F.lit(o) for o in ORDERS))
    at = lambda field, index: F.col("sums")[index][field]
    of_order = table.select("part", "sums", F.posexplode(orders).alias("o", "filter_order"))
    of_step = of_order.select("*", F.explode(F.sequence(F.lit(1), F.lit(STEPS))).alias("step")).withColumns({"removal": F.col("o") * STEPS + F.col("step") - 1, "f": F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1})
    so_far = F.aggregate(F.slice("sums", F.col("o") * STEPS + 1, F.col("step")), F.lit(0).cast("long"), lambda total, x: total + x["documents"])
    # Each order's place of the filter: where its letter stands.
    places = {letter: [i * STEPS + o.index(letter) for i, o in enumerate(ORDERS)] for letter in FILTERS}
    every = F.array(*(F.array(*(F.lit(p) for p in places[letter])) for letter in FILTERS))
    shapley = F.aggregate(every[F.col("f")], F.lit(0).cast("long"), lambda total, p: total + at("documents", p))
    return of_step.select(
        "part",
        "filter_order",
        "step",
        (at("documents", F.lit(ALL)) - so_far).alias("kept"),
        at("documents", F.col("removal")).alias("removed"),
        (at("documents", F.lit(FAILS) + F.col("f")) - at("documents", F.col("removal"))).alias("redundant"),
        at("documents", F.lit(ALONE) + F.col("f")).alias("unique_fails"),
        at("good", F.col("removal")).alias("good_lost"),
        at("toxic", F.col("removal")).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def oracle() -> str:
    """DuckDB SQL for the rows of ``audit``: it walks every order over every document's mask."""
    return r"""
WITH d AS (
  SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), f AS (
  SELECT doc_id, part,
    len(words) < 100 AS a,
    100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d,
    COALESCE(doc_id > first_id, false) AS e
  FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(COALESCE(good, 0)) AS good, sum(COALESCE(bad, 0)) AS bad
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), k AS (SELECT unnest([1, 2, 3, 4, 5]) AS step), g AS (
  SELECT part, filter_order, step, filter_order[step:step] AS letter, filter_order[1:step - 1] AS earlier, fails, n, good, bad FROM m, o, k
), h AS (
  SELECT part, filter_order, step, letter, n, good, bad,
    contains(fails, letter) AS failing, fails = letter AS alone,
    length(regexp_replace(fails, concat('[', earlier, '_]'), '', 'g')) < length(fails) AS gone
  FROM g
), s AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failing AND NOT gone THEN bad ELSE 0 END) AS toxic_lost
  FROM h GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM s
"""
