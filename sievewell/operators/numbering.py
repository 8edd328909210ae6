"""Numbers in order, for keys however frequent."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows of one range of the order, about; a range of one key is what one task sorts.
RANGE_ROWS = 1_000_000
#: Ranges at most, and values of the order that come to the driver for each.
RANGES, SAMPLED = 256, 64


def _range_of(x: Column, bounds: list, first: int = 0) -> Column:
    """How many of the bounds, which are sorted, are at or below ``x``: a balanced tree of comparisons."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(x < F.lit(bounds[middle]), _range_of(x, bounds[:middle], first)).otherwise(_range_of(x, bounds[middle + 1 :], first + middle + 1))


def numbered(rows: DataFrame, key: tuple[str, ...], order: str, name: str = "turn", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the number, from 1, of each row among those of its key by ``order``.

    The order is cut into ranges of like size at values of a bounded sample. Rows of one
    key and range are numbered in a task, and what the key has in the ranges before is
    added; so a key with a third of all rows is some eighty tasks' work, and no key at
    all, which numbers the whole table, is all ranges'. The sample moves the cuts only.
    ``rows`` is read for its count, for the sample, and for the counts by range. Null keys
    are a key; null orders come first; equal orders are numbered in any order.
    """
    n = rows.select(order).count()
    ranges = min(RANGES, math.ceil(n / range_rows)) if n else 1
    bounds: list = []
    if ranges > 1:
        share = min(1.0, ranges * SAMPLED / n)
        seen = sorted(r[0] for r in rows.select(order).where(F.col(order).isNotNull()).sample(share, seed=1).collect())
        bounds = sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []
    keys = [F.col(k) for k in key]
    if not bounds:
        return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(order)).cast("long"))
    placed = rows.withColumn("_range", F.when(F.col(order).isNull(), 0).otherwise(_range_of(F.col(order), bounds)))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    # A key has a row for each of its ranges here, 256 at most.
    counts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_before", before).where("_before > 0")
    counts = counts.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)], F.col("_range").alias("_of"), "_before")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(key)], F.col("_range") == F.col("_of"))
    turn = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(order)) + F.coalesce("_before", F.lit(0))
    return placed.join(counts, same, "left").withColumn(name, turn.cast("long")).select(*rows.columns, name)
