"""FM-index of a collection of short word sequences, with its Burrows-Wheeler transform in a wavelet tree.

The tree is stored level by level (a wavelet matrix): one bit vector for each bit of a symbol, packed in 64-bit
words with a running count.  Rotations are sorted by their first ``CONTEXT`` symbols, which is enough for
backward search of patterns shorter than that.  Searches run in lockstep: one backward step at a time for
all patterns.
"""

from __future__ import annotations

import numpy as np

CONTEXT = 64


class Bits:
    """Bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = n - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)


class FMIndex:
    def __init__(self, sequences: list[np.ndarray]):
        """Sequences of symbols from 1 up; symbol 0 is put after each."""
        lens = np.array([len(s) for s in sequences], dtype=np.int64)
        self.starts = np.cumsum(lens + 1) - lens - 1
        text = np.zeros(int(lens.sum()) + len(lens), dtype=np.int64)
        if len(lens):
            place = np.ones(len(text), dtype=bool)
            place[self.starts + lens] = False
            text[place] = np.concatenate(sequences)
        self.text, n = text, len(text)
        rank, h = text, 1
        while h < CONTEXT and n:
            nxt = np.zeros(n, dtype=np.int64)
            nxt[: n - h] = rank[h:] + 1
            _, new = np.unique(rank * np.int64(int(rank.max(initial=0)) + 3 + n) + nxt, return_inverse=True)
            rank, h = new.astype(np.int64), 2 * h
            if n and rank.max() == n - 1:
                break
        order = np.argsort(rank, kind="stable")
        bwt = text[order - 1]
        symbols = int(text.max(initial=0)) + 1
        self.counts = np.zeros(symbols + 1, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=symbols), out=self.counts[1:])
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            bit = ((bwt >> b) & 1).astype(bool)
            self.levels.append(Bits(bit))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        # after the last level equal symbols stand together; where each begins
        self.begin = np.zeros(symbols, dtype=np.int64)
        if n:
            head = np.flatnonzero(np.diff(bwt, prepend=-1))
            self.begin[bwt[head]] = head

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of c + P from the interval [lo, hi) of P."""
        m = len(c)
        at = np.concatenate([lo, hi])
        both = np.concatenate([c, c])
        for b, level in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = level.rank(at)
            at = np.where((both >> b) & 1, level.zeros + ones, at - ones)
        at += self.counts[both] - self.begin[both]
        return at[:m], at[m:]

    def first(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.counts[c], self.counts[c + 1]

    def repeated_span(self, which: np.ndarray, lens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last window start of each sequence whose window occurs at least twice in the index (-1: none).

        Windows are tried from the left until one occurs again; a window's search, from its right end, stops
        at the place where the matched part occurs once, and every window with that part is passed over.
        Then they are tried from the right.
        """
        starts = self.starts[which]
        last = lens - window
        low, high = np.full(len(which), -1), np.full(len(which), -1)
        for rising in (True, False):
            live = np.arange(len(which)) if rising else np.flatnonzero(low >= 0)
            j = np.zeros(len(live), dtype=np.int64) if rising else last[live].copy()
            if not rising:
                same = j == low[live]
                high[live[same]] = j[same]
                live, j = live[~same], j[~same]
            at = j + window - 1
            lo, hi = self.first(self.text[starts[live] + at])
            while len(live):
                ok = hi - lo >= 2
                whole = ok & (at == j)
                (low if rising else high)[live[whole]] = j[whole]
                failed = ~ok
                nj = np.where(failed, at + 1 if rising else j - 1, j)
                stay = ~whole & (nj <= last[live] if rising else nj >= 0)
                if not rising:  # the first repeated window, found from the left, ends the way down
                    reached = stay & failed & (nj == low[live])
                    high[live[reached]] = nj[reached]
                    stay &= ~reached
                live, j, at, lo, hi, failed = live[stay], nj[stay], at[stay], lo[stay], hi[stay], failed[stay]
                if not len(live):
                    break
                at = np.where(failed, j + window - 1, at - 1)
                c = self.text[starts[live] + at]
                nlo, nhi = self.first(c)
                go = np.flatnonzero(~failed)
                if len(go):
                    nlo[go], nhi[go] = self.step(c[go], lo[go], hi[go])
                lo, hi = nlo, nhi
        return low, high
