"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised, documents above the capacity are cut. Pieces are dealt
to shards of bounded size; each shard has several islands, each with its own
population of packings. A packing is a list of bins, crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold a
piece twice and best-fits what they displaced. After each epoch the elite of an
island migrates to the next one. Bins that the best packing leaves badly filled
are packed again with those of other shards, until one shard holds them all.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import give_back, lean, prepare, written

CAPACITY = 2048
SHARD_PIECES = 4096
ISLANDS, EPOCHS, POPULATION = 3, 2, 6
#: An epoch's crossovers at most, and how many may pass without a better child: a packing at the floor takes none.
CROSSOVERS, PATIENCE = 60, 12
#: A bin filled less is packed again with those of other shards.
WELL_FILLED = 0.995
_TOKENIZERS: dict[str, "_WordTokenizer"] = {}
#: Words of a generation, some 30 bytes each; a worker knows two generations. Fewer are asked for again more often.
_KEPT_WORDS = 150_000
#: The end of a word; no text word of letters holds it.
_MARK = "\ue000"
#: Words of letters that have one lower case, and of marks behind them, which are a word of their own for the tokenizer.
_MARKED = r"[!-&(-/:-@\[-`{-~]+$"
_PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+(?:$|%s)" % _MARKED
#: Bytes of the texts that are tokenised at once, or one longer text.
_TEXT_BYTES = 4_000_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class _WordTokenizer:
    """Ids of a text through those of its space-separated words, which no token of this vocabulary spans.

    Words of plain letters, by far the most, are merged by tiktoken over the same
    vocabulary: a mark stands for the end of a word and is joined to its last byte
    before anything else. What that gives is what the tokenizer gives, as every
    token of the vocabulary is what its own bytes merge to. All other words go to
    the tokenizer itself. Words and their ids are Arrow arrays.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known, self.known_ids = self.before, self.before_ids = _NOTHING
        model = json.loads(self.tokenizer.to_str())["model"]
        self.merger, self.ids, self.ends = _merger(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])

    @staticmethod
    def _raw(ids) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _merge(self, words: pa.Array) -> pa.Array:
        """Ids of words of letters and marks; what comes in several of them is merged once."""
        low = pc.utf8_lower(words)
        low = pc.if_else(pc.match_substring_regex(words, _MARKED), pc.replace_substring_regex(low, f"({_MARKED})", rf"{_MARK}\1"), low)
        split = pc.split_pattern(low, _MARK)
        coded = split.flatten().dictionary_encode()
        parts = coded.dictionary
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(parts)], parts), _MARK)[0].as_py() + _MARK
        ranks = self.merger.encode_to_numpy(text)
        ids = _lists(np.flatnonzero(self.ends[ranks]) + 1, self.ids[ranks]).take(coded.indices)
        return pa.ListArray.from_arrays(ids.offsets.take(split.offsets), ids.values)

    def _ask(self, words: list[str]) -> pa.Array:
        ends, raw, held = [], [], 0
        for low in range(0, len(words), 4000):
            part = words[low : low + 4000]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([len(w) + 1 for w in part])
            ends.append(held + np.searchsorted(np.array([a for a, _ in got.offsets], dtype=np.int64), starts))
            raw.append(np.array(got.ids, dtype="<u4"))
            held += len(raw[-1])
        return _lists(np.concatenate(ends), np.concatenate(raw))

    def _learn(self, words: set[str]) -> None:
        words = pa.array(list(words), pa.string())
        plain = pc.match_substring_regex(words, _PLAIN)
        letters, other = words.filter(plain), words.filter(pc.invert(plain))
        if len(letters):
            self._keep(letters, self._merge(letters))
        if len(other):
            self._keep(other, self._ask(other.to_pylist()))

    def _keep(self, words: pa.Array, ids: pa.Array) -> None:
        self.known, self.known_ids = pa.concat_arrays([self.known, words]), pa.concat_arrays([self.known_ids, ids])

    def _places(self, words: pa.Array) -> pa.Array:
        """Where the ids of words are, each of which is known then. Those that come again pass on to the next generation, the others are forgotten with theirs."""
        at = pc.index_in(words, self.known)
        if not at.null_count:
            return at
        if len(self.known) + at.null_count > _KEPT_WORDS:
            self.before, self.before_ids = self.known, self.known_ids
            self.known, self.known_ids = _NOTHING
            at = pc.index_in(words, self.known)
        fresh = words.filter(at.is_null())
        again = pc.index_in(fresh, self.before)
        self._keep(fresh.filter(again.is_valid()), self.before_ids.take(again.drop_null()))
        if again.null_count:
            self._learn(set(fresh.filter(again.is_null()).to_numpy(zero_copy_only=False)))
        return pc.index_in(words, self.known)

    def token_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; where each text's begin, and the last one's end). A null text counts as empty."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        places = self._places(coded.dictionary)
        ids = self.known_ids.take(places.take(coded.indices))
        return ids.flatten().to_numpy(), ids.offsets.to_numpy()[split.offsets.to_numpy()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, at = self.token_ids(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


def _lists(ends: np.ndarray, ids: np.ndarray) -> pa.Array:
    """The ids of each word, which end there."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.uint32()))


#: The empty word, which has no ids.
_NOTHING = pa.array([""]), pa.array([[]], pa.list_(pa.uint32()))


def _merger(vocab: dict[str, int], merges: list[tuple[str, str]]):
    """(tiktoken over the vocabulary, the vocabulary's id of each rank, whether the rank ends a word)."""
    to_char = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    to_char |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in to_char)}
    to_byte = {c: b for b, c in to_char.items()}
    mark = _MARK.encode()
    ranks, ids, ends = {bytes([b]): b for b in range(256)}, [vocab[to_char[b]] for b in range(256)], [False] * 256

    def add(raw: bytes, number: int, end: bool) -> None:
        if raw not in ranks:
            ranks[raw] = len(ids)
            ids.append(number)
            ends.append(end)

    for n in range(2, len(mark) + 1):
        add(mark[:n], 0, False)
    for b in range(256):
        add(bytes([b]) + mark, vocab[to_char[b] + "</w>"], True)
    for left, right in merges:
        token = left + right
        end = token.endswith("</w>")
        add(bytes(to_byte[c] for c in (token[:-4] if end else token)) + mark * end, vocab[token], end)
    return tiktoken.Encoding("words", pat_str=f"[^{_MARK}]*{_MARK}", mergeable_ranks=ranks, special_tokens={}), np.array(ids, dtype="<u4"), np.array(ends)


def _cuts(rows: pa.RecordBatch):
    """Rows of at most ``_TEXT_BYTES`` of text, or one longer."""
    begin = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(rows.column(1)), 0).to_pylist()):
        if i > begin and held + size > _TEXT_BYTES:
            yield rows.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < rows.num_rows:
        yield rows.slice(begin)


def _pieces(path: str, capacity: int, end_id: int):
    @lean
    def run(parts):
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = _WordTokenizer(path)
            give_back()
        tok, stop = _TOKENIZERS[path], np.array([end_id], dtype="<u4").tobytes()
        for rows in parts:
            for some in _cuts(rows):
                ids, at = tok.token_ids(some.column(1))
                out = []
                for doc, begin, end in zip(some.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                    n = end - begin + 1
                    for p, s in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - s)
                        crc = zlib.crc32(ids[begin + s : min(begin + s + length, end)])
                        out.append((doc, p, s, length, zlib.crc32(stop, crc) if s + length == n else crc))
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row: its ids, then ``end_id``, cut at ``capacity``."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_pieces(vocabulary or default_vocabulary(), capacity, end_id), PIECE)


def best_fit(order: list[int], sizes: list[int], capacity: int, bins: list[list[int]] | None = None, room: list[int] | None = None) -> tuple[list[list[int]], list[int]]:
    """Puts each piece where it leaves least room; gives the bins and their room."""
    bins, room = bins if bins is not None else [], room if room is not None else []
    open_bins = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for i in order:
        size = sizes[i]
        at = bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            left, b = open_bins.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
            room.append(capacity)
        left -= size
        room[b] = left
        if left:
            insort(open_bins, (left, b))
    return bins, room


def fitness(room: list[int], capacity: int) -> float:
    """Fewer bins first, then fuller ones: the lower the better."""
    return len(room) - sum((1 - r / capacity) ** 2 for r in room) / (len(room) + 1)


def cross(a, b, sizes, capacity, rng):
    """Injects well-filled bins of ``b`` into ``a``."""
    (bins_a, room_a), (bins_b, room_b) = a, b
    fullest = np.argsort(np.array(room_b) + rng.random(len(room_b)), kind="stable")
    chosen = [int(x) for x in fullest[: max(1, len(fullest) // 2)] if rng.random() < 0.5] or [int(fullest[0])]
    injected = {i for x in chosen for i in bins_b[x]}
    bins, room, displaced = [list(bins_b[x]) for x in chosen], [room_b[x] for x in chosen], []
    for items, r in zip(bins_a, room_a):
        if injected.isdisjoint(items):
            bins.append(list(items))
            room.append(r)
        else:
            displaced.extend(i for i in items if i not in injected)
    # The emptiest bins are opened too, so that what they hold can fill gaps.
    for x in sorted(np.argsort(room)[::-1][:2].tolist(), reverse=True):
        displaced.extend(bins.pop(x))
        room.pop(x)
    _exchange(displaced, bins, room, sizes)
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(displaced, sizes, capacity, bins, room)


def _exchange(displaced, bins, room, sizes):
    """Displaced pieces take the place of smaller ones where they fill a bin better; what they push out is displaced instead.

    A full bin takes no larger piece and a bin's room only falls, so only bins that have room are looked at.
    """
    roomy = [b for b, r in enumerate(room) if r > 0]
    held = np.array([i for b in roomy for i in bins[b]], dtype=np.int64)
    if not len(held) or not displaced:
        return
    of = np.repeat(np.array(roomy), [len(bins[b]) for b in roomy])
    size, left = np.array([sizes[i] for i in held]), np.array(room)
    for d in sorted(range(len(displaced)), key=lambda j: -sizes[displaced[j]]):
        piece = displaced[d]
        gap = size + left[of] - sizes[piece]
        fits = (gap >= 0) & (size < sizes[piece])
        if not fits.any():
            continue
        at = int(np.where(fits, gap, np.iinfo(np.int64).max).argmin())
        b, pushed = int(of[at]), int(held[at])
        bins[b][bins[b].index(pushed)] = piece
        displaced[d], held[at], size[at] = pushed, piece, sizes[piece]
        room[b] = left[b] = int(gap[at])


def _genome(bins, n):
    out = np.zeros(n, dtype=np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def _unpack(genome, sizes, capacity):
    bins = [[] for _ in range(int(max(genome)) + 1)] if len(genome) else []
    for i, b in enumerate(genome):
        bins[b].append(i)
    bins = [x for x in bins if x]
    return bins, [capacity - sum(sizes[i] for i in x) for x in bins]


def evolve(sizes: list[int], capacity: int, seed: list[int], guests: list[list[int]]) -> list[int]:
    """One epoch of one island: the best packing as each piece's bin. A child replaces the worst if it is better."""
    rng = np.random.default_rng(seed)
    n = len(sizes)
    falling = sorted(range(n), key=lambda i: (-sizes[i], i))
    people = [_unpack(g, sizes, capacity) for g in guests if g is not None]
    floor = -(-sum(sizes) // capacity)
    if not people:
        people.append(best_fit(falling, sizes, capacity))
    while len(people) < POPULATION and len(people[0][0]) > floor:
        noisy = np.array(sizes) * (1 + 0.2 * rng.random(n))
        people.append(best_fit(np.argsort(-noisy, kind="stable").tolist(), sizes, capacity))
    people.sort(key=lambda p: fitness(p[1], capacity))
    idle = 0
    for _ in range(CROSSOVERS):
        if len(people[0][0]) <= floor or len(people) < 2 or idle >= PATIENCE:
            break
        before = fitness(people[0][1], capacity)
        a, b = rng.choice(len(people), 2, replace=False)
        child = cross(people[int(a)], people[int(b)], sizes, capacity, rng)
        if fitness(child[1], capacity) < fitness(people[-1][1], capacity):
            people[-1] = child
            people.sort(key=lambda p: fitness(p[1], capacity))
        idle = 0 if fitness(people[0][1], capacity) < before else idle + 1
    return _genome(people[0][0], n).tolist()


def _seed(capacity: int):
    """Shards to their packing by best-fit decreasing."""

    @lean
    def run(parts):
        for rows in parts:
            out = []
            for shard, sizes in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                bins, room = best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, capacity)
                out.append((shard, -1, _genome(bins, len(sizes)), fitness(room, capacity), len(room) > -(-sum(sizes) // capacity)))
            yield _packings(out)

    return run


def _island(capacity: int, epoch: int):
    @lean
    def run(parts):
        for rows in parts:
            got, out = rows.to_pydict(), []
            for shard, island, sizes, own, guest in zip(got["shard"], got["island"], got["sizes"], got["genome"], got["guest"]):
                best = evolve(sizes, capacity, [shard, island, epoch], [own, guest])
                room = _unpack(best, sizes, capacity)[1]
                out.append((shard, island, best, fitness(room, capacity), len(room) > -(-sum(sizes) // capacity)))
            yield _packings(out)

    return run


STATE = "shard long, island int, genome array<int>, cost double, open boolean"


def _packings(rows) -> pa.RecordBatch:
    c = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.bool_()))], names=["shard", "island", "genome", "cost", "open"])


def _round(items: DataFrame, shards: int, capacity: int, number: int) -> DataFrame:
    """(shard, bin, fill, item...) of one round; no item is lost, none is in two bins.

    A packing of as few bins as the tokens need cannot be bettered: islands start
    only for shards that best-fit decreasing leaves above, and go on while none is there.
    """
    fields = [f.name for f in items.schema]
    # A number given is not lowered: a few shards are little data and much work.
    tasks = min(shards * ISLANDS, max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // 64))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("copy", F.lit(number)), F.lit(shards)).cast("long"))
    base = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", *[c for c in fields if c != "length"]))).alias("items"))
    base = written(base.withColumn("sizes", F.col("items.length")), "pack-shards")
    sizes = base.select("shard", "sizes")
    state = written(sizes.repartition(tasks, "shard").mapInArrow(_seed(capacity), STATE), "pack-seeds")
    states = state
    for epoch in range(EPOCHS):
        still = state.groupBy("shard").agg(F.min("open").alias("open")).where("open").select("shard")
        if still.isEmpty():
            break
        going = state.join(still, "shard").select("shard", "island", "genome")
        if epoch == 0:
            going = going.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("guest", F.lit(None).cast("array<int>"))
        else:
            guests = going.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("genome").alias("guest"))
            going = going.join(guests, ["shard", "island"])
        going = sizes.join(going, "shard").select("shard", "island", "sizes", "genome", "guest").repartition(tasks, "shard", "island")
        state = written(going.mapInArrow(_island(capacity, epoch), STATE), "pack-islands")
        states = states.union(state)
    best = states.groupBy("shard").agg(F.min_by("genome", F.struct("cost", "island")).alias("genome"))
    placed = base.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", "genome")).alias("x")).select("shard", F.col("x.genome").alias("bin"), "x.items.*")
    fill = placed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    return written(placed.join(fill, ["shard", "bin"]), "pack-placed")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    ``pieces`` has doc_id, piece, start, length and what else it needs to carry.
    Pieces of full length are sequences of their own. Repeated rows are packed
    each; an empty table gives an empty result.
    """
    prepare(pieces.sparkSession)
    fields = [f.name for f in pieces.schema]
    pieces = written(pieces, "pack-pieces")
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    items = pieces.where(F.col("length") < capacity).withColumn("copy", F.monotonically_increasing_id())
    out, number = full, 0
    while True:
        shards = max(1, -(-items.count() // shard_pieces))
        placed = _round(items, shards, capacity, number)
        last = shards == 1
        badly = F.col("fill") < WELL_FILLED * capacity
        if not last and placed.where(badly).count() > items.count() // 2:
            # Pieces that no dealing packs well, say all just over half: only each shard's emptiest bin is dealt again.
            emptiest = placed.groupBy("shard").agg(F.min_by("bin", F.struct("fill", "bin")).alias("emptiest"))
            placed = placed.join(emptiest, "shard")
            badly = F.col("bin") == F.col("emptiest")
        settled = placed if last else placed.where(~badly)
        before = "sum(length) over (partition by shard, bin order by length, copy rows between unbounded preceding and 1 preceding)"
        ids = (F.lit(number).cast("long") * (1 << 57) + F.col("shard") * (1 << 20) + F.col("bin")).alias("sequence_id")
        out = out.union(settled.select(*fields, ids, F.expr(f"coalesce({before}, 0L)").cast("long").alias("offset")))
        if last:
            return out
        items = written(placed.where(badly).select(*fields, "copy"), "pack-left")
        number += 1
