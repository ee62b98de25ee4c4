"""Word-shingle sets of whole texts as sorted 64-bit hashes, in numpy.

Words are runs of bytes other than space and the five ASCII controls 09-0D;
A-Z count as a-z.  Hashes depend on nothing but the text and the shingle size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SLICE_BYTES = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base & ((1 << 64) - 1), np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first byte) of each word; words end at blanks and where a document starts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(n + 1)
    blank = _BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[doc_starts[doc_starts <= n]] = edge[n] = edge[0] = True
    word = ~blank
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, blank[:-1]
    after[-1], after[:-1] = True, blank[1:]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    ends = np.flatnonzero(word & (after | edge[1:]))
    total = np.cumsum(_BYTE[data] * up[:n])
    own = total[ends] - np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mix(own * down[starts] + (ends - starts + 1).astype(np.uint64)), starts


def _slices(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents of about SLICE_BYTES; a longer document is a run of its own."""
    out, first = [], 0
    for i in range(1, len(offsets)):
        if offsets[i] - offsets[first] >= SLICE_BYTES or i == len(offsets) - 1:
            out.append((first, i))
            first = i
    return out


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long document, piece by piece, cut at blanks."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data):
            gap = np.flatnonzero(_BLANK[data[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + 4096)
        parts.append(word_hashes(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    out = words[: len(words) - size + 1] * _PLACE[0]
    for j in range(1, size):
        out = out + words[j : len(words) - size + 1 + j] * _PLACE[j]
    return mix(out)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _set_of(words: np.ndarray, size: int) -> np.ndarray:
    if len(words) >= size:
        return _distinct(_shingles(words, size))
    if not len(words):
        return words
    return mix((words * _PLACE[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending.

    Fewer words than ``size`` are one shingle; null, empty and blank texts have none.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    _, where, raw = texts.buffers()
    if raw is None or not len(texts):
        return [np.zeros(0, np.uint64)] * len(texts)
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, out = np.frombuffer(raw, np.uint8), []
    null = texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else None
    for a, b in _slices(offsets):
        own, base = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if b == a + 1 and len(own) > 2 * SLICE_BYTES:
            out.append(_set_of(_long_words(own), size))
            continue
        words, at = word_hashes(own, base[:-1])
        cuts = np.searchsorted(at, base)
        runs = _shingles(words, size) if len(words) >= size else np.zeros(0, np.uint64)
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out.append(_distinct(runs[x : y - size + 1]) if y - x >= size else _set_of(words[x:y], size))
    if null is not None:
        out = [np.zeros(0, np.uint64) if missing else s for s, missing in zip(out, null, strict=True)]
    return out
