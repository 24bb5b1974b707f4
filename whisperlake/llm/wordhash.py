"""Hashes of any run of words in a text, from one pass of array operations over its bytes."""

from __future__ import annotations

import re

import numpy as np

#: Letters, digits and underscores of ASCII, and every byte of other characters, make words; ASCII capitals are lowered.
FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    if chr(_b).isalnum() and _b < 128 or _b == 95 or _b >= 128:
        FOLD[_b] = _b + 32 if 65 <= _b <= 90 else _b
_TABLE = FOLD.tobytes()
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0..n at least, modulo 2**64; kept, and doubled when too short."""
    if len(_POWERS.get(int(base), ())) <= n:
        size = max(1 << 17, 1 << int(n + 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS[int(base)] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base))])
    return _POWERS[int(base)]


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence that is not empty."""
    out, at = [], 0
    for m in SENTENCE_END.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = max(at, m.end())
    if at < len(text):
        out.append((at, len(text)))
    return out


def _runs(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of values[a:b] for each pair of bounds; it does not depend on where the run stands."""
    n = len(values)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_powers(BASE, n)[:n] * values)])
        return mix64((sums[b] - sums[a]) * _powers(INVERSE, n)[a] + (b - a).astype(np.uint64))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stretch: int = 1 << 18) -> np.ndarray:
    """A hash of data[start:end] for each of the bounds, which ascend and do not overlap; some ``stretch`` of the bytes at a time."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + stretch)))
        a, b = starts[at], ends[to - 1]
        out[at:to] = _runs(data[a:b] + np.uint64(1), starts[at:to] - a, ends[at:to] - a)
        at = to
    return out


class WordHashes:
    """Words of a text: where they start and end in its bytes, and a hash of each."""

    def __init__(self, text: str):
        self.bytes = np.frombuffer(text.encode("utf-8", "replace").translate(_TABLE), np.uint8)
        word = self.bytes != 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.words = _runs(self.bytes, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def char_starts(self) -> np.ndarray:
        """Code points before each word."""
        lead = (self.bytes & 0xC0) != 0x80
        return (np.cumsum(lead) - lead)[self.starts]

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words with one zero byte after each, and where each begins and ends there."""
        sizes = self.ends - self.starts
        to = np.cumsum(sizes + 1) - 1
        out = np.zeros(int(to[-1]) + 1 if len(to) else 0, np.uint8)
        inside = np.ones(len(out), bool)
        inside[to] = False
        out[inside] = self.bytes[self.bytes != 0]
        return out.tobytes(), to - sizes, to

    def span_hash(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes, as signed longs, of the runs of words first..end-1."""
        return _runs(self.words, first, end).view(np.int64)

    def shingles(self, width: int) -> np.ndarray:
        """Hash of every run of ``width`` words, unsigned; a shorter text has one, of all its words, if it has any."""
        n = len(self)
        if n == 0:
            return np.empty(0, np.uint64)
        first = np.arange(max(1, n - width + 1))
        return self.span_hash(first, np.minimum(first + width, n)).view(np.uint64)
