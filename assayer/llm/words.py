"""Word and shingle hashes of whole texts, computed on Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of one text that are worked on at once.
PART = 1 << 22
_RANDOM = np.random.default_rng(20240607)
#: A random number for each byte, and multipliers for positions.
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_OTHER = np.random.default_rng(977).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(978).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0, np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool, second: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, first byte, end byte of each word, first word of each document and the end).

    Words are runs of bytes that are not ASCII white space, within one document.
    ``second`` adds a hash of another kind, independent of the first.
    """
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    sizes = np.diff(offsets)
    heads = offsets[:-1][sizes > 0]
    opens[heads] = solid[heads]
    starts = np.flatnonzero(opens)
    at = np.flatnonzero(solid)
    lengths = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters, n = data[at], lengths.astype(np.uint64)
    h = mix(_sums(_BYTE[letters] * powers(int(lengths.max()) if len(lengths) else 1)[place], lengths) + n)
    out = (h, starts, starts + lengths, np.searchsorted(starts, offsets))
    if second:
        # A random factor for each place, so there is no algebra between places.
        factor = _PLACE[place & 4095]
        if len(lengths) and lengths.max() > 4096:
            factor ^= mix((place >> 12).astype(np.uint64)) & ~np.uint64(1)
        out += (mix(_sums(_OTHER[letters] * factor, lengths) ^ n),)
    return out


def parts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``PART`` that cover a text and end where a word ends."""
    at, n = 0, len(data)
    while at < n or at == 0:
        end = min(n, at + PART)
        while end < n and not _SPACE[data[end]]:
            ahead = np.flatnonzero(_SPACE[data[end : end + PART]])
            end = end + int(ahead[0]) if len(ahead) else min(n, end + PART)
        yield at, end
        if end == n:
            return
        at = end


def all_hashes(data: np.ndarray, lower: bool, second: bool = False) -> np.ndarray:
    """The hashes, or with ``second`` the other hashes, of a text's words, computed part by part."""
    pick = 4 if second else 0
    found = [word_hashes(data[a:b], np.array([0, b - a]), lower, second)[pick] for a, b in parts(data)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each position; the last k - 1 positions wrap and mean nothing."""
    p = powers(k)[::-1]
    out = np.zeros(len(words), np.uint64)
    for j in range(k):
        out += np.roll(words, -j) * p[j]
    return mix(out + np.uint64(k))
