"""Exact substring dedup: which 400-byte strings start anywhere else.

Anchored window hashing, not suffix sorting: no order of suffixes and no common
prefixes are kept. Each window has an anchor, chosen by its content alone, and so
equal windows meet under equal anchors. What is carried with an anchor is the run
of windows it stands for. Runs of equal content hash form a class; where classes
under one anchor differ, the run is cut into cells of fewer windows, whose common
bytes are their anchors, and those into single windows. Grouping is Spark's own,
which spills to disk; no key's rows have to fit a task's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .anchors import GRAM, SEGMENT, owned_runs, span_hashes, window_anchors
from .common import lean, prepare, release, written
from .texthash import prefix_sums

WINDOW = 400
CELL = 32
#: A passage is a repeat of more words, found by windows of fewer bytes: over 50 ordinary words reach them.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 220
#: Bits of the filter that spares texts without open runs a shuffle; its size is fixed.
FILTER_BITS = 1 << 22
#: Members of a row of equal runs; more make several rows, so that rows can be dealt evenly.
RUN_MEMBERS = 16
#: Runs whose bytes a task hands on at once.
SLICE_RUNS = 2000
_U = np.uint64


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _runs(window: int):
    """Texts to runs: (anchor, content, n, lead, members), equal ones of a batch together, as members (row, start): of a large group of copies few rows are shuffled."""

    @lean
    def run(parts):
        for rows in parts:
            out = []
            for row, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                raw = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8)
                for low in range(0, max(0, len(raw) - window + 1), SEGMENT):
                    data = raw[low : low + SEGMENT + window - 1]
                    sums = prefix_sums(data)
                    anchor, first, last = owned_runs(window_anchors(data, sums, window))
                    lead = (anchor - first).astype(np.int64)
                    content = span_hashes(sums, first, last + window - first) + lead.astype(_U) * _U(0x9E3779B97F4A7C15)
                    out.append((span_hashes(sums, anchor, GRAM), content, np.full(len(anchor), row), first + low, last - first + 1, lead))
                if sum(len(o[0]) for o in out) > 50_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(out):
        c = [np.concatenate(x) for x in zip(*out)]
        order = np.lexsort((c[1], c[0]))
        anchor, content, row, start, n, lead = (x[order] for x in c)
        same = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1]) & (n[1:] == n[:-1]) & (lead[1:] == lead[:-1])
        new = np.append(True, ~same)
        place = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        first = np.flatnonzero(place % RUN_MEMBERS == 0)
        members = pa.StructArray.from_arrays([pa.array(row, pa.int64()), pa.array(start, pa.int64())], names=["row", "start"])
        members = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), members)
        return pa.RecordBatch.from_arrays([_signed(anchor[first]), _signed(content[first]), pa.array(n[first], pa.int32()), pa.array(lead[first], pa.int32()), members], names=["anchor", "content", "n", "lead", "members"])

    return run


def _slices(window: int):
    """(text, runs) to the bytes of each run."""
    kinds = {"anchor": pa.int64(), "content": pa.int64(), "weight": pa.int32(), "row": pa.int64(), "start": pa.int64(), "lead": pa.int32()}

    def batch(held):
        runs = pa.concat_arrays([r for r, _ in held])
        columns = [runs.field(c).cast(kind) for c, kind in kinds.items()]
        return pa.RecordBatch.from_arrays([*columns, pa.array([b for _, bs in held for b in bs], pa.binary())], names=[*kinds, "bytes"])

    @lean
    def run(parts):
        held, size = [], 0
        for rows in parts:
            for text, runs in zip(rows.column(0), rows.column(1)):
                raw, runs = text.as_buffer().to_pybytes(), runs.values
                low, n = (runs.field(c).to_numpy().tolist() for c in ("start", "n"))
                held.append((runs, [raw[a : a + k + window - 1] for a, k in zip(low, n)]))
                size += len(low)
                if size >= SLICE_RUNS:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    return run


def _cells(window: int, cell: int):
    """Runs to cells: places are counted from the anchor, so that equal windows lie in equal cells.

    ``common`` hashes the bytes that all windows of a whole cell share, ``content``
    those that its windows in this run cover. The runs of a batch are one buffer.
    """

    @lean
    def run(parts):
        for rows in parts:
            if not rows.num_rows:
                continue
            raw = rows.column("bytes")
            offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
            base, n = offsets[:-1] - offsets[0], np.diff(offsets) - window + 1
            sums = prefix_sums(data)
            lead = rows.column("lead").to_numpy().astype(np.int64)
            # Cells begin at 0, at the first place a whole number of cells from the anchor, and every cell from there.
            begin = np.where(lead % cell == 0, cell, lead % cell)
            k = 1 + np.maximum(0, -(-(n - begin) // cell))
            of = np.repeat(np.arange(len(n)), k)
            j = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
            first = np.where(j == 0, 0, begin[of] + (j - 1) * cell)
            stop = np.where(j == k[of] - 1, n[of], begin[of] + j * cell)
            lead, base = lead[of], base[of]
            place = (first - lead) // cell
            # The common bytes of the whole cell: from its last window's start to its first window's end.
            low, high = (place + 1) * cell - 1 + lead, place * cell + lead + window
            common = span_hashes(sums, base + low, high - low) ^ place.astype(_U)
            content = span_hashes(sums, base + first, stop - first + window - 1) + (first - lead - place * cell).astype(_U)
            each = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [rows.column("anchor").take(each), _signed(common), _signed(content), *(rows.column(c).take(each) for c in ("weight", "row", "start")), pa.array(first.astype(np.int32)), pa.array((stop - first).astype(np.int32))],
                names=["anchor", "common", "content", "weight", "row", "start", "first", "n"],
            )

    return run


def _windows(window: int):
    """(bytes of a run, its open cells) to single windows."""

    @lean
    def run(parts):
        for rows in parts:
            out = []
            for row, start, raw, cells in zip(*(rows.column(c).to_pylist() for c in ("row", "start", "bytes", "cells"))):
                sums = prefix_sums(np.frombuffer(raw, dtype=np.uint8))
                for c in cells:
                    at = np.arange(c["first"], c["first"] + c["n"])
                    out.append((np.full(len(at), c["common"]), span_hashes(sums, at, window), np.full(len(at), c["weight"]), np.full(len(at), row), start + at))
            if out:
                c = [np.concatenate(x) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), _signed(c[1]), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())], names=["common", "content", "weight", "row", "start"])

    return run


def _told_apart(rows: DataFrame, key: list[str], carried: list[str]) -> DataFrame:
    """Classes of equal content under each key that is met more than once: weight, one member, and whether the key is open.

    A key is open when its classes differ and one of them stands alone: only finer
    windows can tell which of that one's windows the others have too.
    """
    classes = rows.groupBy(*key, "content").agg(F.sum("weight").alias("w"), F.min(F.struct("weight", *carried)).alias("one"))
    groups = classes.groupBy(*key).agg(F.count("*").alias("k"), F.sum("w").alias("total"), F.min("w").alias("least")).where("total >= 2")
    judged = classes.join(groups.withColumn("open", F.expr("k > 1 and least = 1")).select(*key, "open"), key)
    return judged.select(*key, "content", "w", "one", "open")


def _bits(rows: DataFrame) -> np.ndarray:
    """Which filter slots the rows fill: an array of fixed size."""
    slot = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS)) + 1
    got = rows.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS, dtype=bool)
    for r in got:
        part = np.unpackbits(np.frombuffer(bytes(r["bits"]), dtype=np.uint8), bitorder="little")
        low = (r["b"] - 1) * len(part)
        out[low : low + len(part)] = part[: FILTER_BITS - low]
    return out


def _maybe(bits):
    """Rows (row, bytes, slot) whose slot is filled."""

    @lean
    def run(parts):
        filled = bits.value
        for rows in parts:
            keep = pa.array(filled[rows.column(2).to_numpy(zero_copy_only=False)])
            yield pa.RecordBatch.from_arrays([rows.column(i).filter(keep) for i in (0, 1)], names=["row", "bytes"])

    return run


def repeated_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, start, n): runs of window starts of (row, bytes) whose window starts elsewhere too."""
    spark = prepare(texts.sparkSession)
    runs = written(texts.mapInArrow(_runs(window), "anchor long, content long, n int, lead int, members array<struct<row: bigint, start: bigint>>"), "sd-runs")
    flat = runs.select("anchor", "content", F.size("members").alias("weight"), F.col("members")[0]["row"].alias("row"), F.col("members")[0]["start"].alias("start"), "n", "lead")
    judged = written(_told_apart(flat, ["anchor"], ["row", "start", "n", "lead"]), "sd-classes")
    # Members are dealt evenly before they become rows, as those of a frequent run meet in one task.
    again = runs.join(judged.where("w >= 2").select("anchor", "content"), ["anchor", "content"], "left_semi").select("n", "members").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = again.select("n", F.explode("members").alias("m")).select("m.row", "m.start", "n")
    whole = written(whole, "sd-whole")

    weight = F.least("w", F.lit(2)).cast("int").alias("weight")
    opened = judged.where("open").select("anchor", "content", weight, "one.row", "one.start", "one.n", "one.lead")
    bits = spark.sparkContext.broadcast(_bits(opened))
    slotted = texts.select("row", "bytes", F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS)).cast("int").alias("slot"))
    some = slotted.mapInArrow(_maybe(bits), "row long, bytes binary").dropDuplicates(["row"])
    by_row = opened.groupBy("row").agg(F.collect_list(F.struct("anchor", "content", "weight", "row", "start", "n", "lead")).alias("runs"))
    parts = some.join(by_row, "row").select("bytes", "runs").mapInArrow(_slices(window), "anchor long, content long, weight int, row long, start long, lead int, bytes binary")
    parts = written(parts, "sd-open")
    release(runs, judged)

    cells = parts.mapInArrow(_cells(window, CELL), "anchor long, common long, content long, weight int, row long, start long, first int, n int")
    cells = written(cells.withColumn("common", F.xxhash64("anchor", "common")).drop("anchor"), "sd-cells")
    judged = written(_told_apart(cells, ["common"], ["row", "start", "first", "n"]), "sd-cell-classes")
    in_cells = cells.where("weight = 1").join(judged.where("w >= 2").select("common", "content"), ["common", "content"], "left_semi").select("row", (F.col("start") + F.col("first")).alias("start"), "n")
    in_cells = written(in_cells, "sd-in-cells")
    finer = judged.where("open").select("common", weight, "one.row", "one.start", "one.first", "one.n").groupBy("row", "start").agg(F.collect_list(F.struct("common", "weight", "first", "n")).alias("cells"))
    single = finer.join(parts.select("row", "start", "bytes"), ["row", "start"]).mapInArrow(_windows(window), "common long, content long, weight int, row long, start long")
    single = written(single, "sd-windows")
    release(cells, judged, parts)
    twice = single.groupBy("common", "content").agg(F.sum("weight").alias("w")).where("w >= 2").select("common", "content")
    in_windows = single.where("weight = 1").join(twice, ["common", "content"], "left_semi").select("row", "start", F.lit(1).alias("n"))
    out = written(whole.union(in_cells).union(in_windows), "sd-found")
    release(whole, in_cells, single)
    return out


def _covered(found: pa.ListArray, window: int) -> list[list[tuple[int, int]]]:
    """Of each row the maximal stretches that the windows of its runs (start, n) cover; all rows at once."""
    counts = np.diff(found.offsets.to_numpy())
    runs = found.flatten()
    start, n = (runs.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
    if found.null_count:
        counts = np.where(found.is_null().to_numpy(zero_copy_only=False), 0, counts)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(counts))]
    if not len(start):
        return spans
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((start, row))
    row, low, high = row[order], start[order], (start + n + window - 1)[order]
    # Rows lie far apart on one line, so that the largest end so far is that of the same row.
    far = int(high.max()) + 2
    reach = np.maximum.accumulate(high + row * far)
    new = np.append(True, low[1:] + row[1:] * far > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    for r, a, b in zip(row[first].tolist(), low[first].tolist(), (reach[last] - row[last] * far).tolist()):
        spans[r].append((a, b))
    return spans


def _regions(short: int, window: int, over_words: int):
    """(row, bytes, found) to the stretches of repeated short windows that hold a window or more words than ``over_words``: (row, low, words, passage, bytes)."""

    @lean
    def run(parts):
        for rows in parts:
            out = []
            for row, raw, spans in zip(rows.column(0).to_pylist(), rows.column(1), _covered(rows.column(2), short)):
                raw = raw.as_buffer().to_pybytes()
                for low, high in spans:
                    over = len(raw[low:high].split()) > over_words
                    if over or high - low >= window:
                        out.append((row, low, over, high - low, raw[low:high] if high - low >= window else None))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.bool_()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.binary())], names=["row", "low", "over", "size", "bytes"])

    return run


def _keep(window: int, as_text: bool, over_words: int):
    @lean
    def run(parts):
        for rows in parts:
            out = []
            for doc, text, spans in zip(rows.column(0).to_pylist(), rows.column(1), _covered(rows.column(2), window)):
                raw = text.as_buffer().to_pybytes()
                if over_words:
                    spans = [(a, b) for a, b in spans if b - a >= WINDOW or len(raw[a:b].split()) > over_words]
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((doc, len(raw), sum(b - a for a, b in spans), len(spans), left.decode("utf-8", "ignore") if as_text else left))
            if out:
                c = list(zip(*out))
                kept = pa.array(c[4], pa.string() if as_text else pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), kept, *rows.columns[3:]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *rows.schema.names[3:]])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str, *carry) -> DataFrame:
    """(doc_id, text, carried columns, row): a row is known by a hash of its id and text."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    return texts.withColumn("row", F.xxhash64("doc_id", "text"))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, short: int = PASSAGE_BYTES, over_words: int = PASSAGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """Repeats in two steps, shorter windows first: (row, start, n) of repeated windows as ``repeated_windows`` gives them, and (row, n_passages, passage_bytes).

    All shorter windows in a repeated window are repeated, so the longer ones are
    looked for in the stretches that repeated shorter windows cover, and only
    there. Those stretches of more than ``over_words`` words are the passages.
    """
    texts = _texts(docs, id_col, text_col).select("row", F.col("text").cast("binary").alias("bytes"))
    found = repeated_windows(texts, short)
    by_row = found.groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("found"))
    regions = texts.join(by_row, "row").mapInArrow(_regions(short, window, over_words), "row long, low long, over boolean, size long, bytes binary")
    regions = written(regions, "sd-regions")
    release(found)
    counted = regions.where("over").dropDuplicates(["row", "low"]).groupBy("row").agg(F.count("*").alias("n_passages"), F.sum("size").alias("passage_bytes"))
    counted = written(counted, "sd-passages")
    keyed = regions.where("bytes is not null").withColumn("region", F.xxhash64("row", "low"))
    inside = repeated_windows(keyed.select(F.col("region").alias("row"), "bytes"), window)
    placed = keyed.select("region", F.col("row").alias("of"), "low").distinct().join(inside.withColumnRenamed("row", "region"), "region")
    runs = written(placed.select(F.col("of").alias("row"), (F.col("low") + F.col("start")).alias("start"), "n"), "sd-runs-found")
    release(regions, inside)
    return runs, counted


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, as_text: bool = False, carry: tuple[str, ...] = (), over_words: int = 0, passage_counts: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` and the carried columns.

    ``kept`` is binary, or with ``as_text`` a string without the characters that a cut has halved.

    Every byte goes that a ``window``-byte string covers which starts anywhere else,
    in the same text or another, judged on the input. Matches never cross texts.
    With ``passage_counts``, ``n_passages`` and ``passage_bytes`` tell of the repeated
    passages of over 50 words, those under 400 bytes included, which stay.
    With ``over_words``, a stretch of such bytes below 400 goes only if it has more words.
    Null and short texts are kept as they are; repeated rows repeat each other, so
    their long parts go from each; rows are known by a hash of id and text, so that
    rows without id and different texts of one id are kept apart; columns that are
    not carried are not read; an empty table gives an empty result.
    """
    texts = _texts(docs, id_col, text_col, *carry)
    if passage_counts:
        runs, counted = passages(docs, id_col, text_col, window)
    else:
        runs, counted = repeated_windows(texts.select("row", F.col("text").cast("binary").alias("bytes")), window), None
    found = runs.groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("found"))
    names = list(carry)
    if counted is not None:
        found = found.join(counted, "row", "full")
        names += ["n_passages", "passage_bytes"]
    joined = texts.join(found, "row", "left")
    if counted is not None:
        joined = joined.fillna(0, ["n_passages", "passage_bytes"])
    joined = joined.select("doc_id", "text", "found", *names)
    carried = "".join(f", `{c}` {joined.schema[c].dataType.simpleString()}" for c in names)
    return joined.mapInArrow(_keep(window, as_text, over_words), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}{carried}")
