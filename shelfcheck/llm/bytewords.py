"""Words and word hashes of whole Arrow batches of texts, straight from their UTF-8 bytes.

A word is a longest run of digits, letters a-z (A-Z are lower-cased) and characters from U+0080 on. All bytes of
such characters are 0x80 or more, so byte classes give exactly the words of the decoded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BLOCK = 1 << 20
_P = 0x9E3779B97F4A7C15
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_VALUE = np.where(_IS_WORD, np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER], 0).astype(np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base, inverse = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 2**64), np.uint64)
        base[0] = inverse[0] = 1
        _POWERS[:] = [np.multiply.accumulate(base), np.multiply.accumulate(inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of an Arrow string array; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def groups(offsets: np.ndarray, most: int = 4 * _BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together; a longer text is alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of the texts at ``offsets``; no word crosses a text's end."""
    low, high = int(offsets[0]), int(offsets[-1])
    starts, ends, hashes = [], [], []
    while low < high:
        stop = min(high, low + _BLOCK)
        while stop < high and _IS_WORD[data[stop - 1]] and _IS_WORD[data[stop]] and not _bound(offsets, stop):
            stop += 1
        block = data[low:stop]
        inside = _IS_WORD[block]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        cuts = offsets[np.searchsorted(offsets, low, "left") : np.searchsorted(offsets, stop, "left")] - low
        before[cuts] = False
        s = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[cuts[cuts > 0] - 1] = False
        e = np.flatnonzero(inside & ~after) + 1
        if len(s):
            power, inverse = _powers(len(block))
            total = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(_VALUE[block] * power, out=total[1:])
            h = (total[e] - total[s]) * inverse[s]
            h ^= (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            starts.append(s + low)
            ends.append(e + low)
            hashes.append(h ^ (h >> np.uint64(32)))
        low = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def _bound(offsets: np.ndarray, at: int) -> bool:
    i = int(np.searchsorted(offsets, at))
    return i < len(offsets) and offsets[i] == at
