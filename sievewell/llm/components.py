"""Connected components of an edge table, by contraction to smaller neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import release, written

#: Edges that one task may finish, 16 MB; more are contracted by joins first.
FEW_EDGES = 1_000_000


def _roots(parts):
    """All edges (u, v) of a small graph to (node, root)."""
    edges = [np.column_stack([c.to_numpy() for c in rows.columns]) for rows in parts if rows.num_rows]
    if not edges:
        return
    nodes, ends = np.unique(np.concatenate(edges), return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        newer = root.copy()
        np.minimum.at(newer, root[u], root[v])
        np.minimum.at(newer, root[v], root[u])
        newer = newer[newer]
        if (newer == root).all() and (root[u] == root[v]).all():
            break
        root = newer
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def _pointed(edges: DataFrame) -> DataFrame:
    """(node, root): the end of each node's chain of smallest neighbours."""
    both = edges.select(F.col("v").alias("node"), F.col("u").alias("to")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("to")))
    parents = written(both.groupBy("node").agg(F.min("to").alias("root")), "cc-parents")
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = written(parents.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "cc-jump")
        moved = not jumped.where("moved").isEmpty()
        release(parents)
        parents = jumped.drop("moved")
        parents._written_path = jumped._written_path
        if not moved:
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component): each linked node's smallest reachable id.

    Each round points every node at its smallest neighbour, follows the pointers
    to their roots and contracts the edges; edges shrink geometrically. Only key
    joins and partial aggregates are used, each round is written to the shared folder.
    Once a count shows that few edges are left, one task finishes them.
    """
    edges = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "cc-edges")
    labels = None
    while left := edges.count():
        if left <= FEW_EDGES:
            parents = written(edges.coalesce(1).mapInArrow(_roots, "node long, root long"), "cc-parents")
        else:
            parents = _pointed(edges)
        if labels is None:
            labels = parents
        else:
            old = labels
            p = parents.select(F.col("node").alias("component"), F.col("root").alias("newer"))
            labels = written(old.select("node", F.col("root").alias("component")).join(p, "component", "left").select("node", F.coalesce("newer", "component").alias("root")), "cc-labels")
            release(old)
        if left <= FEW_EDGES:
            break
        pu = parents.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        pv = parents.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        contracted = edges.join(pu, "u").join(pv, "v").where("ru <> rv")
        newer = written(contracted.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "cc-edges")
        release(edges)
        edges = newer
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = labels.select("node", F.col("root").alias("component"))
    out._written_path = labels._written_path
    return out
