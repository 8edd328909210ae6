"""N-gram Jaccard join by a token-group matrix.

Documents become sets of word shingles; equal sets collapse to one class. A share
of all shingles, chosen by hash, is looked up first: those that only one class
has lie outside every intersection, and most sets have too many of them to link
with any other and are done. The others are cut
into buckets by shingle hash. Two sets within the similarity differ in at most D
shingles, so that of 2 D + 8 buckets many have equal contents. These are the
tokens of the matrix. Sets are linked to the most typical set of a token first.
Then similar sets are dealt into groups of bounded size, a group's token union is
the distinct tokens of its members, and a group is opened for a query only if
their overlap reaches what any partner of the query shares. Opened groups are
compared exactly, many queries at a time. Only components are asked for, so a
group of which all members are linked to the query already is never opened.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import lean, of_ids, prepare, release, written as _written
from .components import connected_components
from .texthash import batches, mix, shingle_sets

_U = np.uint64
_SUMMARY = "doc_id long, n_shingles long, d1 long, d2 long"
#: Digests that a task remembers, so that copies which meet in it are not indexed again.
_REMEMBERED = 1_000_000
#: Looked-up shingles that a task combines before they are shuffled: a frequent one leaves one row of each chunk.
_CHUNK = 1 << 20
#: Sets in a group, and in a batch of queries, and shingles in them: more are dealt to several.
GROUP_SETS, GROUP_SHINGLES = 256, 500_000


def _bands(top: int, num: int, den: int) -> list[int]:
    """Set sizes where bands begin; partners lie in the same band or the next."""
    edges = [1, 2]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * den // num + 1))
    return [*edges, max(edges[-1] + 1, (edges[-1] - 1) * den // num + 1)]


def _looked_up(num, den):
    """The share of shingles that is looked up: more than may be missing in a partner, so that a set of which hardly any other has a part is told by it."""
    return min(1.0, 1.5 * (den - num) / den + 0.02)


def _bucket_tokens(hashes, at, num, den):
    """The tokens of each set under the schemes of its own band and the one below, and how many of them any partner has.

    Of its filled buckets a set has all but D in common with a partner. Only sets
    with fewer than D + 2 give tokens for empty buckets too.
    """
    n = np.diff(at)
    edges = np.array(_bands(int(n.max(initial=1)), num, den), dtype=np.int64)
    band = np.searchsorted(edges, n, side="right") - 1
    docs = np.repeat(np.arange(len(n)), n)
    mixed = mix(hashes.view(np.uint64) ^ _U(0xA0761D6478BD642F))
    values, owners, need = [], [], np.full(len(n), np.iinfo(np.int64).max)
    for down in (0, 1):
        scheme = band - down
        most = (edges[np.clip(scheme + 1, 0, None)] - 1) * (den - num) // num
        parts = np.where((scheme >= 0) & (n > 0) & (most > 0), 2 * most + 8, 0)
        of = parts[docs]
        use = of > 0
        if not use.any():
            continue
        d, h, p = docs[use], mixed[use], of[use].astype(np.uint64)
        bucket = ((h >> _U(20)) % p).astype(np.int64)
        first = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(parts, out=first[1:])
        cell = first[d] + bucket
        total = np.zeros(first[-1], dtype=np.uint64)
        order = np.argsort(cell, kind="stable")
        cells, start = np.unique(cell[order], return_index=True)
        total[cells] = np.add.reduceat(mix(h[order]), start)
        filled = np.zeros(first[-1], dtype=bool)
        filled[cells] = True
        owner = np.repeat(np.arange(len(n)), parts)
        full = np.bincount(owner[filled], minlength=len(n))
        few = full < most + 2
        need = np.where(parts > 0, np.minimum(need, np.where(few, 2, full - most)), need)
        emit = filled | few[owner]
        where = np.arange(first[-1]) - first[owner]
        token = mix(total + mix(where.astype(np.uint64) * _U(0x8EBC6AF09C88C6E3) + scheme[owner].astype(np.uint64)))
        values.append(token[emit])
        owners.append(owner[emit])
    if not values:
        return np.zeros(0, np.int64), np.zeros(len(n) + 1, np.int64), need
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return values[order].view(np.int64), np.searchsorted(owners[order], np.arange(len(n) + 1)), need


def _digests(hashes, at):
    u = hashes.view(np.uint64)
    sums = [np.concatenate([[_U(0)], np.cumsum(mix(u + _U(s)))]) for s in (0x51ED27, 0xC2B2AE)]
    return [(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums]


def _summaries(k):
    @lean
    def run(parts):
        for rows in parts:
            ids, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for first, part in batches(texts):
                hashes, at = shingle_sets(part, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + len(part)], pa.int64()), pa.array(np.diff(at), pa.int64()), *map(pa.array, _digests(hashes, at))], names=["doc_id", "n_shingles", "d1", "d2"])

    return run


def _lookups(k, num, den):
    """Rows (kind, key, cls, lonely): kind 0 a looked-up shingle and the one class of the chunk that has it, or null for several; kind 1 a class and how many of its looked-up shingles no other of the chunk has."""
    below = int(_looked_up(num, den) * 2**63)

    def combined(held):
        tokens, cls, classes = (np.concatenate(x) for x in zip(*held))
        once, of, times = np.unique(tokens, return_inverse=True, return_counts=True)
        alone = times[of] == 1
        classes = np.unique(classes)
        lonely = np.bincount(np.searchsorted(classes, cls), weights=alone, minlength=len(classes)).astype(np.int32)
        several = once[times > 1]
        key = np.concatenate([tokens[alone], several, classes])
        ends = len(key) - len(classes)
        kind, count, who, unknown = np.zeros(len(key), np.int8), np.zeros(len(key), np.int32), key.copy(), np.zeros(len(key), bool)
        kind[ends:], count[ends:], unknown[ends - len(several) : ends] = 1, lonely, True
        who[: ends - len(several)] = cls[alone]
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(who, mask=unknown), pa.array(count)], names=["kind", "key", "cls", "lonely"])

    @lean
    def run(parts):
        seen: set[int] = set()
        held, size = [], 0
        for rows in parts:
            for _, part in batches(rows.column(0).to_pylist()):
                hashes, at = shingle_sets(part, k)
                digest = _digests(hashes, at)[0]
                n = np.diff(at)
                fresh = n > 0
                for i, d in enumerate(digest.tolist()):
                    if d in seen:
                        fresh[i] = False
                    else:
                        seen.add(d)
                if len(seen) > _REMEMBERED:
                    seen.clear()
                take = np.repeat(fresh, n) & (mix(hashes.view(np.uint64) ^ _U(0x1B873593)) >> _U(1) < _U(below))
                held.append((hashes[take], np.repeat(digest, n)[take], digest[fresh]))
                size += int(take.sum())
                if size >= _CHUNK:
                    yield combined(held)
                    held, size = [], 0
        if held:
            yield combined(held)

    return run


def _sets(k):
    @lean
    def run(parts):
        for rows in parts:
            ids, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for first, part in batches(texts):
                hashes, at = shingle_sets(part, k)
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + len(part)], pa.int64()), *map(pa.array, _digests(hashes, at)), sets], names=["rep", "d1", "d2", "shingles"])

    return run


def _tokens(num, den):
    """(node, n, reach, apart, shingles) to (token, node, n, reach, apart, need)."""

    @lean
    def run(parts):
        for rows in parts:
            if not rows.num_rows:
                continue
            at = np.concatenate([[0], np.cumsum(rows.column("n").to_numpy())])
            tokens, owners, need = _bucket_tokens(rows.column("shingles").flatten().to_numpy(), at, num, den)
            each = pa.array(np.repeat(np.arange(rows.num_rows), np.diff(owners)))
            yield pa.RecordBatch.from_arrays([pa.array(tokens), *(rows.column(c).take(each) for c in ("node", "n", "reach", "apart")), pa.array(need).take(each)], names=["token", "node", "n", "reach", "apart", "need"])

    return run


def _opened(num, den):
    """Rows of queries and members, both lists of (node, shingles), to the roots (u, v) of what links in the row."""

    def side(cell):
        both = cell.values
        sets = both.field("shingles")
        at = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        return both.field("node").to_numpy(), sets.flatten().to_numpy(), at

    @lean
    def run(parts):
        for rows in parts:
            for queries, members in zip(rows.column("queries"), rows.column("members")):
                q, q_hashes, q_at = side(queries)
                m, m_hashes, m_at = side(members)
                order = np.argsort(m_hashes, kind="stable")
                hashes, owner, size = m_hashes[order], np.repeat(np.arange(len(m)), np.diff(m_at))[order], np.diff(m_at)
                nodes, number = np.unique(np.concatenate([q, m]), return_inverse=True)
                root = np.arange(len(nodes))
                for i in range(len(q)):
                    asked = q_hashes[q_at[i] : q_at[i + 1]]
                    low, high = np.searchsorted(hashes, asked, "left"), np.searchsorted(hashes, asked, "right")
                    times = high - low
                    at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                    both = np.bincount(owner[at], minlength=len(m))
                    near = np.flatnonzero(den * both >= num * (len(asked) + size - both))
                    if len(near):
                        met = np.unique(root[np.append(number[len(q) + near], number[i])])
                        root[np.isin(root, met)] = met[0]
                moved = root != np.arange(len(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[root[moved]]), pa.array(nodes[moved])], names=["u", "v"])

    return run


def written(df: DataFrame, label: str) -> DataFrame:
    """Steps shuffle much of the input each, so their shuffle files go with them."""
    return _written(df, label, drop_shuffles=True)


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """Adds ``part``: rows (node, n) of one ``by`` are dealt to parts of bounded size."""
    sizes = rows.groupBy(by).agg(F.greatest(F.ceil(F.count("*") / GROUP_SETS), F.ceil(F.sum("n") / GROUP_SHINGLES)).alias("parts"))
    return rows.join(sizes, by).withColumn("part", F.expr("pmod(xxhash64(node, 5), parts)")).drop("parts")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of written candidate pairs (u, v), those whose sets reach the similarity exactly; of ``sets`` only those in pairs are shuffled."""
    one = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    joined = of_ids(one("u"), pairs, "u", "inner").join(of_ids(one("v"), pairs.select("v"), "v", "left_semi"), "v")
    joined = joined.withColumn("both", F.size(F.array_intersect("su", "sv")).cast("long"))
    return joined.where(den * F.col("both") >= num * (F.size("su") + F.size("sv") - F.col("both"))).select("u", "v")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, similarity: tuple[int, int] = (9, 10)) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``.

    Two documents link when the Jaccard similarity of their shingle sets is at
    least ``similarity`` (a fraction as numerator, denominator).
    ``component_id`` is the smallest id reachable by links, the own id included.

    Null or empty texts have an empty set and link with nothing; equal and repeated
    rows are one class; rows of one id with different texts are told apart; other
    columns are not read; a null id links with nothing and has a null component.
    An empty table gives an empty result. No group is capped or sampled.
    """
    spark = prepare(docs.sparkSession)
    num, den = similarity
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = written(texts.mapInArrow(_summaries(shingle_words), _SUMMARY), "tg-sets-summary")

    # Classes of equal sets; of each only the row of the smallest id goes on.
    full = known.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"))
    turn = F.row_number().over(W.partitionBy("rep").orderBy("d1", "d2"))
    classes = written(classes.withColumn("node", F.when(turn == 1, F.col("rep")).otherwise(F.xxhash64("d1", "d2"))), "tg-classes")

    # How many looked-up shingles a class has alone. What a chunk has combined is one row of it, so frequent shingles are few rows.
    lookups = texts.where("doc_id is not null").select("text").mapInArrow(_lookups(shingle_words, num, den), "kind tinyint, key long, cls long, lonely int")
    of_key = W.partitionBy("kind", "key")
    met = lookups.select("*", (F.max(F.col("cls").isNull()).over(of_key) | (F.min("cls").over(of_key) != F.max("cls").over(of_key))).alias("several")).where("cls is not null")
    met = met.where("kind = 1 or several").select("cls", "kind", F.when(F.col("kind") == 1, F.col("lonely")).otherwise(-1).alias("lonely"))
    counts = met.groupBy(F.col("cls").alias("d1")).agg(F.floor(F.sum("lonely") / F.sum("kind")).alias("u"))
    judged = classes.join(counts, "d1", "left").withColumn("u", F.greatest(F.coalesce("u", F.lit(0)), F.lit(0)))
    judged = judged.where(f"u <= n - (n * {num} + {den - 1}) div {den} and n * {den - num} div {num} >= 1")
    # ``apart`` orders classes by the share of shingles of their own, then by id: 20 and 43 bits.
    # A set of n with u shingles of its own reaches a partner of at most ``reach``, as both / (n + m - both) >= num / den.
    judged = judged.select("node", "rep", "d1", "d2", "n", F.expr(f"cast(floor((n - u) * {num + den} / {num}) as long) - n + 1").alias("reach"), F.expr("shiftleft(cast(floor(u / n * 1048576) as long), 43) | least(greatest(rep, 0), 8796093022207)").alias("apart"))
    judged = written(judged, "tg-judged")
    mine = of_ids(texts, judged.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = mine.mapInArrow(_sets(shingle_words), "rep long, d1 long, d2 long, shingles array<long>").join(judged, ["rep", "d1", "d2"])
    sets = written(sets.select("node", "n", "reach", "apart", "shingles"), "tg-sets")
    if sets.count() > judged.count():
        repeated, sets = sets, written(sets.dropDuplicates(["node"]), "tg-sets")
        release(repeated)
    release(judged)

    # Tokens of several classes, each with its most typical class, the one least ``apart``. All is longs, so that Spark
    # aggregates by hash and rows of one class stay together, which compress; frequent tokens are joined, not windowed, so that skew can be split.
    tokens = written(sets.mapInArrow(_tokens(num, den), "token long, node long, n long, reach long, apart long, need long"), "tg-tokens")
    several = tokens.groupBy("token").agg(F.min("n").alias("least"), F.min("node").alias("low"), F.max("node").alias("high"), F.min_by("node", "apart").alias("centre"))
    several = written(several.where("low <> high").select("token", "least", "centre"), "tg-several")
    live = written(tokens.drop("apart").join(several, "token").where("least <= reach").select("token", "node", "n", "reach", "need", "centre"), "tg-live")
    release(tokens, several)

    # Classes that link to the most typical class of a token they share.
    stars = live.where("node <> centre").groupBy(F.col("centre").alias("u"), F.col("node").alias("v")).agg(F.count("*").alias("times"), F.first("need").alias("need")).where("times >= need").select("u", "v")
    stars = written(stars, "tg-stars")
    links = written(_linked(stars, sets, num, den), "tg-links")
    groups = connected_components(links)

    # The matrix: tokens by group of classes that are linked or share their centre.
    own = live.groupBy("node").agg(F.first("n").alias("n"), F.first("reach").alias("reach"), F.first("need").alias("need"), F.min("centre").alias("home"))
    own = own.join(groups, "node", "left").select("node", "n", "reach", "need", F.coalesce("component", "node").alias("component"), F.coalesce("component", "home").alias("home"))
    own = written(_dealt(own, "home").withColumn("grp", F.xxhash64("home", "part")).drop("home", "part"), "tg-groups")
    matrix = written(live.select("token", "node").join(own, "node"), "tg-matrix")
    release(stars, live)
    union = matrix.groupBy("token", F.col("grp").alias("other")).agg(
        F.min("n").alias("least"), F.max("reach").alias("farthest"), F.min("node").alias("low"), F.max("node").alias("high"), F.min("component").alias("first"), F.max("component").alias("last")
    )
    met = matrix.join(union, "token").where("other <= grp and (other <> grp or low <> high) and (first <> last or first <> component) and least <= reach and n <= farthest")
    near = written(met.groupBy("node", "other").agg(F.count("*").alias("overlap"), F.first("need").alias("need"), F.first("n").alias("n")).where("overlap >= need").select("node", "other", "n"), "tg-near")
    if not near.isEmpty():
        contents = sets.select("node", "shingles")
        listed = F.collect_list(F.struct("node", "shingles"))
        asking = written(_dealt(near, "other").select("node", "other", "part"), "tg-asking")
        asked = written(own.select("node", F.col("grp").alias("other")).join(near.select("other").distinct(), "other", "left_semi"), "tg-asked")
        queries = of_ids(contents, asking, "node", "inner").groupBy("other", "part").agg(listed.alias("queries"))
        members = of_ids(contents, asked, "node", "inner").groupBy("other").agg(listed.alias("members"))
        more = queries.join(members, "other").select("queries", "members").mapInArrow(_opened(num, den), "u long, v long")
        fewer, links = links, written(links.union(more), "tg-links")
        release(groups, fewer, asking, asked)
        groups = connected_components(links)
    release(own, matrix, near, sets, links)
    linked = classes.join(groups, "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    class_ids = written(linked.join(least, "component").select("d1", "d2", "component_id"), "tg-class-ids")
    release(groups)
    # A class without links is its own component; its copies share its smallest id.
    of_class = classes.select("d1", "d2", "rep").join(class_ids, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("component_id", "rep").alias("class_component"))
    lone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    some = known.where(~lone).join(of_class, ["d1", "d2"]).select("doc_id", "n_shingles", F.col("class_component").alias("component_id"))
    return some.union(known.where(lone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
