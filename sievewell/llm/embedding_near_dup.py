"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are projected on the leading principal directions and sorted by
their grid cells of width epsilon: the epsilon grid order. The sorted sequence
is cut into blocks. Pairs of intervals are joined recursively, first intervals
of many blocks, then blocks, then halves of blocks inside a task; a pair whose
bounding boxes are further apart than epsilon holds no link and is skipped. A
task counts links and gives each vector's root within its pair, never a row per
link. Equal vectors follow each other in the order and are one class, which is
compared once: a group of copies costs a class for each 65,536 of them and for
each task that it is spread over.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import prepare, written
from .components import connected_components
from .vectors import is_valid, matrix, sample_matrix

#: Rows that the principal directions are fitted on; they change only how much is skipped.
SAMPLE_ROWS = 4096
DIRECTIONS = 8
CELL_DIRECTIONS = 4
BLOCK_ROWS = 1024
#: Copies that one class holds at most, and a block: bounds of a task's memory; more copies make more classes.
CLASS_MEMBERS, BLOCK_MEMBERS = 1 << 16, 1 << 20
_LEAF = 256


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _apart(lo_a, hi_a, lo_b, hi_b) -> float:
    gap = np.maximum(0, np.maximum(lo_b - hi_a, lo_a - hi_b))
    return float(gap @ gap)


def _projected(basis: np.ndarray, eps: float):
    def run(parts):
        for rows in parts:
            for low in range(0, rows.num_rows, 4096):
                part = rows.slice(low, 4096)
                if not part.num_rows:
                    continue
                x = _unit(matrix(part.column("embedding")))
                p = x @ basis
                cells = np.floor(p[:, :CELL_DIRECTIONS] / eps).astype(np.int32)
                digests = pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), *(pa.array(c) for c in cells.T), digests, pa.array(list(x), pa.list_(pa.float64()))], names=["vec_id", "label", *(f"c{i}" for i in range(cells.shape[1])), "digest", "x"])

    return run


def _blocks(basis: np.ndarray, block_rows: int, class_members: int):
    """Sorted rows to blocks of one label each; equal vectors that follow each other are one class with its smallest id."""

    def batch(number, label, xs, members):
        x = np.array(xs)
        p = x @ basis
        ids = np.array([m[0][0] for m in members], dtype="<i8")
        sizes = np.array([sum(map(len, m)) for m in members], dtype="<i8")
        every = np.concatenate([c for m in members for c in m]).astype("<i8")
        row = (number, label, len(ids), ids.tobytes(), sizes.tobytes(), every.tobytes(), x.astype("<f8").tobytes(), p.min(axis=0).tolist(), p.max(axis=0).tolist())
        types = (*[pa.int64()] * 3, *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 2)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["block", "label", "n", "ids", "sizes", "members", "data", "lo", "hi"])

    def run(parts):
        number, label, xs, members, held = TaskContext.get().partitionId() << 32, None, [], [], 0
        for rows in parts:
            if not rows.num_rows:
                continue
            x, ids, labels = matrix(rows.column("x")), rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
            new = np.ones(len(x), bool)
            new[1:] = (labels[1:] != labels[:-1]) | (x[1:] != x[:-1]).any(axis=1)
            new[0] = not xs or labels[0] != label or bool((x[0] != xs[-1]).any())
            cuts = np.union1d([0], np.flatnonzero(new)).astype(int).tolist()
            for low, high in zip(cuts, [*cuts[1:], len(x)]):
                fresh = bool(new[low])
                for at in range(low, high, class_members):
                    part = ids[at : min(high, at + class_members)]
                    if fresh or sum(map(len, members[-1])) + len(part) > class_members:
                        if xs and (labels[at] != label or len(xs) >= block_rows or held >= BLOCK_MEMBERS):
                            yield batch(number, label, xs, members)
                            number, xs, members, held = number + 1, [], [], 0
                        xs.append(x[at].copy())
                        members.append([])
                        label = int(labels[at])
                    members[-1].append(part)
                    held += len(part)
                    fresh = False
        if xs:
            yield batch(number, label, xs, members)

    return run


def _members(parts):
    """(vec_id, the smallest id of its class, the size of its class) of blocks."""
    for rows in parts:
        for ids, sizes, members in zip(*(rows.column(k).to_pylist() for k in ("ids", "sizes", "members"))):
            sizes = np.frombuffer(sizes, dtype="<i8")
            of = lambda v: pa.array(np.repeat(v, sizes))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(members, dtype="<i8")), of(np.frombuffer(ids, dtype="<i8")), of(sizes)], names=["vec_id", "class", "size"])


def _interval_links(xa, xb, pa_, pb, same, at, bt, limit, eps2, found):
    """Recursively joins two intervals of blocks; appends (rows of a, rows of b) that link."""
    if _apart(pa_.min(axis=0), pa_.max(axis=0), pb.min(axis=0), pb.max(axis=0)) > eps2:
        return
    if len(xa) <= _LEAF and len(xb) <= _LEAF:
        i, j = np.nonzero(xa @ xb.T >= limit)
        i, j = i + at, j + bt
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        found.append((i, j))
        return
    halves = lambda n: [(0, n)] if n <= _LEAF else [(0, n // 2), (n // 2, n)]
    for a0, a1 in halves(len(xa)):
        for b0, b1 in halves(len(xb)):
            if not same or at + a0 < bt + b1:
                _interval_links(xa[a0:a1], xb[b0:b1], pa_[a0:a1], pb[b0:b1], same, at + a0, bt + b0, limit, eps2, found)


def _pair_links(basis: np.ndarray, limit: float, eps2: float):
    def run(parts):
        for rows in parts:
            for r in range(rows.num_rows):
                get = lambda name: rows.column(name)[r].as_py()  # noqa: B023, E731
                ids_a, ids_b, sizes_a, sizes_b = (np.frombuffer(get(k), dtype="<i8") for k in ("ids_a", "ids_b", "sizes_a", "sizes_b"))
                xa, xb = (np.frombuffer(get(k), dtype="<f8").reshape(n, -1) for k, n in (("data_a", len(ids_a)), ("data_b", len(ids_b))))
                same = get("block_a") == get("block_b")
                found = []
                _interval_links(xa, xb, xa @ basis, xb @ basis, same, 0, 0, limit, eps2, found)
                i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
                if not len(i):
                    continue
                if same:
                    ids, sizes, ends = ids_a, sizes_a, (i, j)
                else:
                    ids, sizes, ends = np.concatenate([ids_a, ids_b]), np.concatenate([sizes_a, sizes_b]), (i, j + len(ids_a))
                links = np.zeros(len(ids), dtype=np.int64)
                np.add.at(links, ends[0], sizes[ends[1]])
                np.add.at(links, ends[1], sizes[ends[0]])
                root = ids.copy()
                while True:
                    least = np.minimum(root[ends[0]], root[ends[1]])
                    newer = root.copy()
                    np.minimum.at(newer, ends[0], least)
                    np.minimum.at(newer, ends[1], least)
                    if (newer == root).all():
                        break
                    root = newer
                on = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(links[on]), pa.array(root[on])], names=["vec_id", "links", "root"])

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", min_cosine: float = 0.93, block_rows: int = BLOCK_ROWS, class_members: int = CLASS_MEMBERS) -> DataFrame:
    """One row per vector id: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors of equal, not null label link when their cosine, in double precision,
    is at least ``min_cosine``. Null, empty, zero or non-finite vectors, those
    without label or id, and those of another length than most of the sample link
    with nothing. Rows that repeat an id count once, with the smallest label and
    vector. Other columns are not read; an empty table gives an empty result.
    """
    spark = prepare(rows.sparkSession)
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    vectors = vectors.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*")
    valid = vectors.where(is_valid(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    lengths = valid.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    alone = vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not lengths:
        return alone
    valid = valid.where(F.size("embedding") == lengths[0]["d"])
    sample = _unit(sample_matrix(valid, "embedding", "vec_id", SAMPLE_ROWS))
    basis = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)[2][:DIRECTIONS].T.copy()
    eps2 = 2 - 2 * min_cosine + 1e-9
    # Few or short vectors have fewer directions.
    cells = [f"c{i}" for i in range(min(CELL_DIRECTIONS, basis.shape[1]))]
    projected = valid.mapInArrow(_projected(basis, eps2**0.5), f"vec_id long, label long, {', '.join(f'{c} int' for c in cells)}, digest binary, x array<double>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("label", *cells, "digest", "vec_id")
    ordered = projected.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("vec_id", "label", "x")
    blocks = written(ordered.mapInArrow(_blocks(basis, block_rows, class_members), "block long, label long, n long, ids binary, sizes binary, members binary, data binary, lo array<double>, hi array<double>"), "ego-blocks")

    # Intervals of the sequence, recursively: those of many blocks, then blocks.
    near = lambda a, b: F.expr(f"aggregate(zip_with(zip_with({a}lo, {b}hi, (x, y) -> x - y), zip_with({b}lo, {a}hi, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D)), 0D, (s, g) -> s + g * g) <= {eps2!r}D")
    boxes = blocks.select("block", "label", "lo", "hi", F.shiftright("block", 32).alias("interval"))
    extent = lambda agg, c: F.array(*[agg(F.col(c)[i]) for i in range(basis.shape[1])]).alias(c)
    wide = boxes.groupBy("label", "interval").agg(extent(F.min, "lo"), extent(F.max, "hi"))
    side = lambda df, s: df.select("label", *[F.col(c).alias(f"{s}{c}") for c in df.columns if c != "label"])
    wide_pairs = side(wide, "a").join(side(wide, "b"), "label").where("ainterval <= binterval").where(near("a", "b")).select("label", "ainterval", "binterval")
    pairs = wide_pairs.join(side(boxes, "a"), ["label", "ainterval"]).join(side(boxes, "b"), ["label", "binterval"]).where("ablock <= bblock").where(near("a", "b"))
    pairs = written(pairs.select(F.col("ablock").alias("block_a"), F.col("bblock").alias("block_b")), "ego-pairs")
    load = lambda s: blocks.select(F.col("block").alias(f"block_{s}"), F.col("ids").alias(f"ids_{s}"), F.col("sizes").alias(f"sizes_{s}"), F.col("data").alias(f"data_{s}"))
    joined = pairs.join(load("a"), "block_a").join(load("b"), "block_b")
    found = written(joined.mapInArrow(_pair_links(basis, min_cosine, eps2), "vec_id long, links long, root long"), "ego-links")
    counts = found.groupBy(F.col("vec_id").alias("class")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("class"), "component")
    members = blocks.select("ids", "sizes", "members").mapInArrow(_members, "vec_id long, class long, size long").join(counts, "class", "left").join(roots, "class", "left")
    members = members.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "class").alias("component"))
    out = vectors.select("vec_id").join(members, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
