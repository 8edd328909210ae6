"""Words that differ by one code point, and the frequent form that each stands for.

Words of one length are points: their rank in forward order, and in reverse order. A
word with one position left open is a prefix and a suffix, an interval in each order;
the points in both are found by a wavelet tree, for every position at once. Replaced
code points are sought among words of the same length, inserted ones among words one
longer. Words meet in a task by the ends that an edit within a range of positions leaves
alone: first two ranges a word, and where too many share such ends, halves of the range,
down to single positions, where no more words can meet than there are letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, release, written

#: Code points of all words that may share the ends of one range; more are dealt again by halves of the range.
MOST_LETTERS = 500_000
#: Code points of the words that a task puts into one tree before it begins another; a group of ends is never parted.
TREE_LETTERS = 500_000
#: Distinct words that a task counts before it hands them on.
TASK_WORDS = 200_000
#: Code points of a long text that are cut into words at once.
PART_CHARS = 1 << 20

_LOWER = {c: c + 32 for c in range(65, 91)}
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")


def _runs(text: str, least: int):
    """Maximal runs of letters with ``least`` code points or more, and how often each occurs; only A-Z are lower-cased."""
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")
    seen, at = Counter(), 0
    while at < len(text):
        cut = _OTHER.search(text, at + PART_CHARS) if len(text) - at > PART_CHARS else None
        end = cut.start() if cut else len(text)
        seen.update(run.findall(text, at, end))
        at = end
    lowered = Counter()
    for word, n in seen.items():
        lowered[word.lower() if word.isascii() else word.translate(_LOWER)] += n
    return lowered


def _words(least: int, one_in: int):
    """(doc_id, text) to counts (word, n), a task's words together."""

    def handed_on(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(parts):
        held: dict[str, int] = {}
        for rows in parts:
            for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text"), strict=True):
                prefix = b"%s:" % (b"" if doc is None else str(doc).encode())
                start = zlib.crc32(prefix)
                for word, n in _runs(text.as_py(), least).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) > TASK_WORDS:
                    yield handed_on(held)
                    held = {}
        if held:
            yield handed_on(held)

    return run


def count_words(docs: DataFrame, least_chars: int = 6, least_count: int = 5, one_in: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the lower-cased runs of letters of all texts, some of them with a letter left out by the document's and word's checksum."""
    prepare(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_words(least_chars, one_in), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class WaveletTree:
    """A permutation of 0..n-1, by the bits of its values: which values of an interval of places lie in an interval."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.ranks = [], []
        for level in reversed(range(self.bits)):
            one = (values >> level & 1).astype(bool)
            self.ranks.append(np.concatenate([[0], np.cumsum(~one)]))
            self.zeros.append(int(self.ranks[-1][-1]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [least, most) at places [low, high), many queries at once."""
        query, value = np.arange(len(low)), np.zeros(len(low), dtype=np.int64)
        for depth, (ranks, zeros) in enumerate(zip(self.ranks, self.zeros, strict=True)):
            left_low, left_high = ranks[low], ranks[high]
            low = np.concatenate([left_low, zeros + low - left_low])
            high = np.concatenate([left_high, zeros + high - left_high])
            value = np.concatenate([value * 2, value * 2 + 1])
            query = np.concatenate([query, query])
            span = self.bits - depth - 1
            on = (low < high) & (value << span < most[query]) & ((value + 1) << span > least[query])
            query, value, low, high = query[on], value[on], low[on], high[on]
        return query, value


def _sorted_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of a byte matrix, and how many leading bytes each shares with the one before it in that order."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    ranked = rows[order]
    shared = np.zeros(len(rows), dtype=np.int64)
    differs = ranked[1:] != ranked[:-1]
    shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return order, shared


def _intervals(order: np.ndarray, shared: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: between which of the points, in this order, those lie whose first ``length`` bytes are the row's."""
    starts = np.flatnonzero(shared < length) if length else np.zeros(1, dtype=np.int64)
    if length:
        starts[0] = 0
    ends = np.append(starts[1:], len(order))
    low, high = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
    low[order], high[order] = np.repeat(before[starts], ends - starts), np.repeat(before[ends], ends - starts)
    return low, high


def near_words(words: list[bytes], n: np.ndarray, length: int, first: int, last: int):
    """Of words with ``length`` or one code point fewer: all pairs (row, row of a word of that length) with one code point at positions first..last-1 replaced or inserted.

    An inserted code point counts at the first of the places that give the same word,
    and ``words`` are distinct, so that no pair comes twice (replacements come from both sides).
    """
    size = np.array([len(w) for w in words])
    forward = np.zeros((len(words), length), dtype=np.uint8)
    backward = np.zeros((len(words), length), dtype=np.uint8)
    for cut in (length - 1, length):
        of = np.flatnonzero(size == cut)
        if cut and len(of):
            letters = np.frombuffer(b"".join(words[i] for i in of), dtype=np.uint8).reshape(-1, cut)
            forward[of, :cut], backward[of, :cut] = letters, letters[:, ::-1]
    point = size == length
    f_order, f_shared = _sorted_rows(forward)
    b_order, b_shared = _sorted_rows(backward)
    f_before, b_before = (np.concatenate([[0], np.cumsum(point[o])]) for o in (f_order, b_order))
    f_points, b_points = f_order[point[f_order]], b_order[point[b_order]]
    if not len(f_points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), f_order
    place = np.empty(len(words), dtype=np.int64)
    place[b_points] = np.arange(len(b_points))
    asked = []
    for i in range(first, last):
        low, high = _intervals(f_order, f_shared, f_before, i)
        least, most = _intervals(b_order, b_shared, b_before, length - 1 - i)
        # A point is in its own intervals, so alone in one of them it has no near word here.
        on = np.where(point, (high - low > 1) & (most - least > 1), (high > low) & (most > least))
        rows = np.flatnonzero(on)
        asked.append((rows, low[rows], high[rows], least[rows], most[rows], np.full(len(rows), i)))
    row, low, high, least, most, at = (np.concatenate(c) for c in zip(*asked, strict=True))
    query, value = WaveletTree(place[f_points]).report(low, high, least, most)
    near, row, at = b_points[value], row[query], at[query]
    inserted = ~point[row]
    again = inserted & (at > 0) & (forward[near, at] == forward[row, np.maximum(at - 1, 0)])
    on = (near != row) & ~again
    return row[on], near[on], f_order


def _linked(letters_limit: int):
    """Keyed words to (word, n_near, best_n, best): of each word in a tree, its near words there and the most frequent of them."""

    def tree(words, n, length, first, last):
        row, near, order = near_words(words, n, length, first, last)
        size = np.array([len(w) for w in words])
        # The shorter word finds the longer one; the longer one has the shorter as near, too.
        longer = size[row] < length
        row, near = np.concatenate([row, near[longer]]), np.concatenate([near, row[longer]])
        if not len(row):
            return None
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        by = np.lexsort((rank[near], -n[near], row))
        row, near = row[by], near[by]
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        counts = np.diff(np.append(starts, len(row)))
        text = lambda rows: pa.array([words[i].decode("latin-1") for i in rows], pa.string())
        return pa.RecordBatch.from_arrays([text(row[starts]), pa.array(counts.astype(np.int64)), pa.array(n[near[starts]]), text(near[starts])], names=["word", "n_near", "best_n", "best"])

    def run(parts):
        words, counts, letters, kind, key = [], [], 0, None, None
        for rows in parts:
            columns = [rows.column(c).to_pylist() for c in ("length", "first", "last", "ends", "word", "n")]
            for length, first, last, ends, word, n in zip(*columns, strict=True):
                now = (length, first, last)
                # A tree may hold several groups of ends, but never part of one.
                if words and (now != kind or ends != key and letters >= letters_limit):
                    out = tree(words, np.array(counts, dtype=np.int64), *kind)
                    words, counts, letters = [], [], 0
                    if out is not None:
                        yield out
                kind, key = now, ends
                words.append(word.encode("latin-1"))
                counts.append(n)
                letters += len(word)
        if words:
            out = tree(words, np.array(counts, dtype=np.int64), *kind)
            if out is not None:
                yield out

    return run


def _with_ends(rows: DataFrame) -> DataFrame:
    """What an edit at positions first..last-1 of a word of ``length`` leaves alone: code points before, code points after."""
    before = F.substring("word", F.lit(1), F.col("first"))
    rest = F.col("length") - F.col("last")
    after = F.substring("word", F.length("word") - rest + 1, rest)
    return rows.withColumn("ends", F.concat(before, F.lit(" "), after))


def _ranges(rows: DataFrame) -> DataFrame:
    """Each range of positions as its halves; a single position stays."""
    middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    halves = F.array(F.struct(F.col("first").alias("first"), middle.alias("last")), F.struct(middle.alias("first"), F.col("last").alias("last")))
    cut = rows.select("word", "n", "length", F.explode(halves).alias("range"))
    return cut.select("word", "n", "length", F.col("range.first").alias("first"), F.col("range.last").alias("last")).where(F.col("first") < F.col("last"))


def variants(words: DataFrame, most_letters: int = MOST_LETTERS, times: int = 5) -> DataFrame:
    """word, n -> word, form, root, n, n_near, form_n: near words are one inserted, deleted or replaced code point apart.

    ``form`` is the near word of largest n (ties: the smallest in code-point order), if
    its n is at least ``times`` the word's, else null; ``root`` follows forms to the last.
    ``words`` are distinct, not empty, of letters up to code point 255, and written.
    """
    lengths = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("length")
    # As a point and with a position open, a word is sought at its own length; with a code point to insert, at the next.
    whole = words.select("word", "n", lengths).withColumns({"first": F.lit(0), "last": F.col("length")})
    dealt, trees = _with_ends(_ranges(whole)), []
    # ``dealt`` is derived from the written words alone, so each round is recomputed from them.
    while True:
        key = ["length", "first", "last", "ends"]
        # At a single position no more words can share their ends than there are letters.
        crowded = written(dealt.where("last - first > 1").groupBy(*key).agg(F.sum(F.length("word")).alias("letters")).where(F.col("letters") > most_letters).drop("letters"), "spelling-crowded")
        if crowded.isEmpty():
            release(crowded)
            trees.append(dealt)
            break
        trees.append(dealt.join(crowded, key, "left_anti"))
        dealt = written(_with_ends(_ranges(dealt.join(crowded, key, "left_semi"))), "spelling-dealt")
    links = None
    for part in trees:
        ready = part.repartition("length", "ends").sortWithinPartitions("length", "first", "last", "ends").select("length", "first", "last", "ends", "word", "n")
        found = ready.mapInArrow(_linked(TREE_LETTERS), "word string, n_near long, best_n long, best string")
        links = found if links is None else links.union(found)
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:bigint,best:string>").alias("form"))
    both = none.unionByName(links.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("less"), "best").alias("form")))
    best = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("form").alias("form"))
    follows = -F.col("form.less") >= times * F.col("n")
    formed = written(best.select("word", F.when(follows, F.col("form.best")).alias("form"), "n", "n_near", F.when(follows, -F.col("form.less")).alias("form_n")), "spelling-forms")

    # Counts grow by ``times`` at each step, so chains are short, and they halve each round.
    step = formed.where("form is not null").select("word", F.col("form").alias("root"))
    chains = written(step, "spelling-chains")
    while True:
        ahead = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = written(chains.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-chains")
        moved = not jumped.where("moved").isEmpty()
        release(chains)
        chains, path = jumped.drop("moved"), jumped._written_path
        chains._written_path = path
        if not moved:
            break
    return formed.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_chars: int = 6, least_count: int = 5, one_in: int = 199, id_col: str = "doc_id", text_col: str = "text", most_letters: int = MOST_LETTERS) -> DataFrame:
    """The words of all texts with the frequent form that each varies: word, form, root, n, n_near, form_n.

    Runs of A-Z, a-z and U+00C0 to U+00FF count, with A-Z lower-cased; where ``one_in``
    divides the crc32 of ``<doc_id>:<run>``, one code point of it is left out. Words of
    fewer than ``least_chars`` code points or ``least_count`` occurrences do not count.
    Null texts have no words, a null id is written as nothing, repeated rows count as
    often as they are there; other columns are not read; an empty table has no words.
    """
    words = written(count_words(docs, least_chars, least_count, one_in, id_col, text_col), "spelling-words")
    return variants(words, most_letters)
