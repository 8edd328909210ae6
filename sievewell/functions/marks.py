"""Which of many words stand in texts, in one pass over a batch instead of one search a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Words of one number of an array of marks; the sign is left alone.
BITS = 63
_KEY = 4
_WORD_SIGN = np.zeros(256, dtype=bool)
_WORD_SIGN[[c for c in range(128) if chr(c).isalnum() or chr(c) == "_"]] = True


class Marker:
    """Marks texts by words (word, whole): whole ones stand between signs that are no ASCII word signs, others anywhere.

    The first four bytes of words (fewer of shorter ones) are looked up at every byte at
    once; where they stand the words that begin so are compared. So a text costs its
    length and what it holds of the words, not their number.
    """

    def __init__(self, words: list[tuple[str, bool]]):
        self.width = -(-len(words) // BITS)
        self.of_key: dict[int, dict[int, list[tuple[bytes, bool, int]]]] = {}
        for i, (word, whole) in enumerate(words):
            said = word.encode()
            n = min(len(said), _KEY)
            self.of_key.setdefault(n, {}).setdefault(int.from_bytes(said[:n], "little"), []).append((said, whole, i))

    def __call__(self, texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string()).fill_null("")
        rows = len(texts)
        marks = np.zeros((rows, self.width), dtype=np.int64)
        at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + rows + 1] if rows else np.zeros(1, dtype=np.int64)
        if at[-1] > at[0]:
            said = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
            self._mark(said, at - at[0], marks)
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * self.width, pa.int32()), pa.array(marks.ravel()))

    def _mark(self, said: np.ndarray, at: np.ndarray, marks: np.ndarray) -> None:
        longest = max(len(w) for keys in self.of_key.values() for words in keys.values() for w, _, _ in words)
        padded = np.zeros(len(said) + longest + _KEY, dtype=np.uint8)
        padded[: len(said)] = said
        row_of = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
        heads = padded[: len(said)].astype(np.uint32)
        for n in range(1, _KEY + 1):
            if n > 1:
                heads |= padded[n - 1 : n - 1 + len(said)].astype(np.uint32) << np.uint32(8 * (n - 1))
            if n in self.of_key:
                self._compare(self.of_key[n], heads, padded, row_of, at, marks)

    @staticmethod
    def _compare(of_key, heads, padded, row_of, at, marks) -> None:
        keys = np.array(sorted(of_key), dtype=np.uint32)
        hashed = lambda x: (x * np.uint32(2654435761)) >> np.uint32(16)
        seen = np.zeros(1 << 16, dtype=bool)
        seen[hashed(keys)] = True
        spots = np.flatnonzero(seen[hashed(heads)])
        place = np.minimum(np.searchsorted(keys, heads[spots]), len(keys) - 1)
        real = keys[place] == heads[spots]
        spots, place = spots[real], place[real]
        order = np.argsort(place, kind="stable")
        spots, cuts = spots[order], np.searchsorted(place[order], np.arange(len(keys) + 1))
        for k, key in enumerate(keys):
            here = spots[cuts[k] : cuts[k + 1]]
            if not len(here):
                continue
            rows = row_of[here]
            begins, ends = at[rows], at[rows + 1]
            for word, whole, bit in of_key[int(key)]:
                stop = here + len(word)
                found = stop <= ends
                for i in range(min(len(word), _KEY), len(word)):
                    found &= padded[here + i] == word[i]
                if whole:
                    found &= ((here == begins) | ~_WORD_SIGN[padded[here - 1]]) & ((stop == ends) | ~_WORD_SIGN[padded[stop]])
                marks[rows[found], bit // BITS] |= np.int64(1 << (bit % BITS))


def marker(words: list[tuple[str, bool]]):
    """A function of a batch of texts, for ``arrow_udf``."""
    found = Marker(words)

    def mark(texts: pa.Array) -> pa.Array:
        return found(texts)

    return mark
