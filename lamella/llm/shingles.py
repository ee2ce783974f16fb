"""Hashes of words and word shingles of whole texts, vectorised over many texts at once.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; A-Z are lower-cased. A text's set holds its
distinct shingles of `width` words; a text of fewer words has its whole sequence as the only one, a text
without words none. Sets are arrays of 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np

_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\t-\r ]")
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of data begins, and its hash. Bounded memory: pieces of a megabyte, cut at a gap."""
    data = data.translate(_LOWER)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        piece = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        _grow(len(piece))
        blank = np.ones(len(piece) + 2, bool)
        blank[1:-1] = _BLANK[piece]
        first = np.flatnonzero(blank[:-1] & ~blank[1:])
        last = np.flatnonzero(~blank[:-1] & blank[1:])
        with np.errstate(over="ignore"):
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTES[piece] * _powers[0][: len(piece)], dtype=np.uint64, out=sums[1:])
            value = (sums[last] - sums[first]) * _powers[1][first]
            hashes.append(mix(value + (last - first).astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
        starts.append(first + at)
        at = end
    none = np.zeros(0, np.int64)
    return (np.concatenate(starts) if starts else none), (np.concatenate(hashes) if hashes else none.astype(np.uint64))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and where each text's begin (one more at the end)."""
    parts = [(t or "").encode() for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    starts, hashes = word_hashes(b"\n".join(parts))
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = words_of(texts)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)
    with np.errstate(over="ignore"):
        joined = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for j in range(width):
            joined += words[j : j + len(joined)] * factors[j]
        joined = mix(joined)
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                found = np.sort(joined[a : b - width + 1])
                new = np.ones(len(found), bool)
                new[1:] = found[1:] != found[:-1]
                sets.append(found[new])
            elif b > a:
                sets.append(mix((words[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + _U(b - a)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def set_key(shingles: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit key that equal sets share, whatever their order. Keys of two seeds are independent."""
    salt = mix(np.array([0x5851F42D4C957F2D + seed], np.uint64))
    with np.errstate(over="ignore"):
        total = mix(shingles ^ salt).sum(dtype=np.uint64, keepdims=True) + _U(len(shingles))
    return int(mix(total).view(np.int64)[0])
