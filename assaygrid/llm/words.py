"""64-bit hashes of words and word runs, for many texts at a time, in numpy.

A word is a run of bytes other than space and 0x09-0x0D.  Its hash is a polynomial of its bytes modulo 2**64,
taken from running sums over the whole block, then mixed; a run's hash is a polynomial of its words' hashes,
mixed again.  Equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Block:
    texts: list[int]  # places of the texts in the caller's list
    hashes: np.ndarray  # of all words
    first: np.ndarray  # the first word of each text, and at the end the number of words


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(BLOCK.bit_length(), (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def hashed(texts: list[str | None], lower: bool = False) -> Iterator[Block]:
    """Blocks of whole texts; null counts as empty.  With ``lower``, A-Z are lower-cased first."""
    ids: list[int] = []
    parts: list[bytes] = []
    size = 0

    def out() -> Block:
        data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
        if lower:
            data = _LOWER[data]
        gap = _SPACE[data]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        start, end = edge[0::2], edge[1::2]
        up, down = powers(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        h = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        at = np.cumsum([0, *(len(p) + 1 for p in parts)])
        return Block(ids, h, np.searchsorted(start, at))

    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "replace")
        if parts and size + len(b) > BLOCK:
            yield out()
            ids, parts, size = [], [], 0
        ids.append(i)
        parts.append(b)
        size += len(b) + 1
    if parts:
        yield out()


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words (over text ends too; the caller leaves those out)."""
    m = max(0, len(hashes) - n + 1)
    h = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        h = h * _STEP + hashes[j : j + m]
    return mixed(h + np.uint64(n))
