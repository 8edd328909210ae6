"""Sampled suffixes of byte texts: every window of ``window`` bytes names one, by its content alone.

A window's anchor is the leftmost gram of least hash among those inside it, so
equal windows, wherever they stand, have equal anchors at equal places.
"""

from __future__ import annotations

import numpy as np

from .texthash import mix, powers, prefix_sums

_U = np.uint64
GRAM = 32
_PLACE_BITS = 24
#: Texts are read in segments of at most this many window starts, so that places fit their bits.
SEGMENT = 1 << 20


def span_hashes(sums: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    """Hashes of the bytes [start, start + length), from prefix sums."""
    _, down = powers(len(sums))
    return mix((sums[starts + lengths] - sums[starts]) * down[starts] + np.asarray(lengths).astype(np.uint64))


def window_anchors(data: np.ndarray, sums: np.ndarray, window: int) -> np.ndarray:
    """For each window start, the start of its anchor gram."""
    grams = len(data) - GRAM + 1
    width = window - GRAM + 1
    starts = len(data) - window + 1
    place = np.arange(grams, dtype=np.uint64)
    key = (span_hashes(sums, np.arange(grams), GRAM) >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | place
    # Sliding minimum by blocks: running minima from both ends of blocks of the width.
    padded = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:grams] = key
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:starts], left[width - 1 : width - 1 + starts])
    return (least & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)


def owned_runs(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window start, last window start) of each run of windows with one anchor."""
    first = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    last = np.append(first[1:], len(anchors)) - 1
    return anchors[first], first, last
