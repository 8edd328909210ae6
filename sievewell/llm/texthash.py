"""Vectorised hashing of words and word shingles over a batch of texts.

A batch is one byte buffer. A word's hash is a polynomial over its bytes modulo
2**64, read from prefix sums, so no Python loop runs per word. From some hundred
bytes on there are words made to collide under every such polynomial, so long ones,
which are rare, are hashed by a cryptographic function.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: list[np.ndarray] = []
#: Texts hashed together; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
#: Words of more bytes get a cryptographic hash; crafted collisions of the polynomial begin at 1024.
LONG_WORD = 255


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BATCH_BYTES + 4096)
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _BASE_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def batches(texts: list[str], limit: int = BATCH_BYTES):
    """Yield (first index, encoded texts) with at most ``limit`` bytes, or one longer text."""
    part, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if part and size + len(b) > limit:
            yield first, part
            part, size, first = [], 0, i
        part.append(b)
        size += len(b) + 1
    if part:
        yield first, part


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def word_hashes(part: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``part`` in order, and where each text's words begin (one more at the end)."""
    data = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    read = _LOWER[data] if lower else data
    sums = prefix_sums(read)
    _, down = powers(len(data) + 1)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        hashes[i] = int.from_bytes(hashlib.blake2b(read[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    bounds = np.zeros(len(part) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in part], out=bounds[1:])
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(part: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes of k-word shingles, sorted as signed longs, and where each set begins.

    A text with fewer words has the whole sequence as its one shingle, one without words none.
    """
    words, at = word_hashes(part)
    n = np.diff(at)
    combined = np.zeros(len(words), dtype=np.uint64)
    factor = _U(0xD6E8FEB86659FD93)
    for j in range(k):
        shifted = np.zeros_like(combined)
        shifted[: len(words) - j] = words[j:]
        combined = mix(combined * factor + shifted + _U(j + 1))
    doc = np.repeat(np.arange(len(part)), n)
    keep = np.arange(len(words)) + k <= at[1:][doc]
    hashes, docs = combined[keep], doc[keep]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.empty(len(short), dtype=np.uint64)
        for x, d in enumerate(short):
            h = np.zeros(1, dtype=np.uint64)
            for w in words[at[d] : at[d + 1]]:
                h = mix(h * factor + w + _U(77))
            extra[x] = h[0]
        hashes, docs = np.concatenate([hashes, extra]), np.concatenate([docs, short])
    hashes = hashes.view(np.int64)
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    if len(hashes):
        new = np.empty(len(hashes), dtype=bool)
        new[0] = True
        new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
        hashes, docs = hashes[new], docs[new]
    return hashes, np.searchsorted(docs, np.arange(len(part) + 1))


_KIND = np.ones(256, dtype=np.uint8)  # letters, digits and the bytes of other scripts
_KIND[:128] = 2  # signs
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[[*range(0, 33), 127]] = 0


def token_hashes(part: list[bytes], lower: bool, stems: int = 0) -> tuple[np.ndarray, ...]:
    """As ``word_hashes``, for runs of letters and digits and runs of signs apart.

    With ``stems``, a third array has the hash of each token's first bytes, of as many, 0 for shorter tokens.
    """
    data = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
    kind = _KIND[data]
    change = np.empty(len(kind), dtype=bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    at = np.flatnonzero(change)
    ends = np.append(at[1:], len(data))
    some = kind[at] > 0
    starts, ends = at[some], ends[some]
    sums = prefix_sums(_LOWER[data] if lower else data)
    _, down = powers(len(data) + 1)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.zeros(len(part) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in part], out=bounds[1:])
    if not stems:
        return hashes, np.searchsorted(starts, bounds)
    cut = np.minimum(starts + stems, ends)
    stem = mix((sums[cut] - sums[starts]) * down[starts] ^ _U(0x5DEECE66D))
    return hashes, np.searchsorted(starts, bounds), np.where(ends - starts >= stems, stem, _U(0))
