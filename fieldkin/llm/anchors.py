"""Anchors of byte strings: every shared string of a length has an anchor in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of the strings that are looked for, and of an anchor.
SPAN, ANCHOR = 50, 18
#: Anchors in a string: the one with the smallest hash, the leftmost of equals, is its own.
CHOICES = SPAN - ANCHOR + 1
#: Strings handled at a time; their number fits the bits that a place takes in a key.
CHUNK, PLACE_BITS = 1 << 19, 20

_BASE = 0x9E3779B97F4A7C15


def _power(exponent: int) -> np.uint64:
    return np.uint64(pow(_BASE, exponent, 2**64))


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each ``ANCHOR`` bytes, from hashes of halves."""
    parts, size = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    while size * 2 <= ANCHOR:
        half = parts[size]
        parts[size * 2] = half[:-size] * _power(size) + half[size:]
        size *= 2
    out, done = parts[size], size
    while done < ANCHOR:
        size = max(x for x in parts if x <= ANCHOR - done)
        out = out[: len(parts[size]) - done] * _power(size) + parts[size][done : done + len(out)]
        done += size
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(32))


def anchored(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of strings of ``SPAN`` bytes with the same anchor, a chunk of texts at a time.

    Yields the hash of the anchor, its place, and the first and last start of the
    strings of the run. Places count in ``data``; no string crosses a text.
    """
    starts = len(data) - SPAN + 1
    for begin in range(0, max(starts, 0), CHUNK):
        end = min(begin + CHUNK, starts)
        hashes = _hashes(data[begin : end + SPAN - 1])
        mask = np.uint64((1 << PLACE_BITS) - 1)
        keys = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width < CHOICES:
            step = min(width, CHOICES - width)
            keys = np.minimum(keys[:-step], keys[step:])
            width += step
        place = (keys & mask).astype(np.int64)
        new = np.ones(len(place) + 1, bool)
        new[1:-1] = place[1:] != place[:-1]
        # Strings that would reach into the next text belong to no run.
        low, high = np.searchsorted(offsets, [begin, end + SPAN])
        inner = offsets[low:high]
        cuts = np.concatenate([np.maximum(inner - SPAN + 1, begin), inner]) - begin
        new[cuts[cuts < len(new)]] = True
        first = np.flatnonzero(new[:-1])
        last = np.concatenate((first[1:], [len(place)])) - 1
        text = np.searchsorted(offsets, first + begin, side="right")
        whole = first + begin + SPAN <= offsets[np.minimum(text, len(offsets) - 1)]
        first, last = first[whole], last[whole]
        at = place[first]
        yield hashes[at], at + begin, first + begin, last + begin
