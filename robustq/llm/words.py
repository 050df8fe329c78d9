"""Vectorised words of a chunk of texts: byte classes, word bounds and 64-bit word hashes.

numpy over the Arrow string buffer of a whole chunk, so Python cost is per chunk, not per
word. Word hashes are polynomial in random byte values and mixed; they only propose
candidates, callers that need equality compare the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLOCK = 1 << 22
_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_POWERS = np.multiply.accumulate(
    np.concatenate(([1], np.full((1 << 16) - 1, BASE, np.uint64))).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts in them); null is empty."""
    col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1]
    offs = offs.astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def byte_table(word_bytes: bytes, fold: bool = True) -> np.ndarray:
    """256-entry map: word bytes to themselves (A-Z folded to a-z), others to a space."""
    t = np.full(256, 32, np.uint8)
    for b in word_bytes:
        t[b] = b
    if fold:
        for b in range(65, 91):
            t[b] = t[b + 32]
    return t


class Words:
    """Words of a chunk: ``data`` (folded bytes), ``starts``/``ends`` per word, ``first``
    (word index of each text's first word, with the total at the end)."""

    def __init__(self, col: pa.Array, table: np.ndarray):
        raw, offs = text_bytes(col)
        self.data = table[raw]
        inside = self.data != 32
        n = len(inside)
        start = inside.copy()
        end = np.zeros(n + 1, bool)
        if n:
            start[1:] &= ~inside[:-1]
            cuts = offs[:-1][offs[:-1] < n]
            start[cuts] = inside[cuts]
            end[1:] = inside
            end[1:-1] &= ~inside[1:]
            cuts = cuts[cuts > 0]
            end[cuts] = inside[cuts - 1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end)
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash per word, in blocks of bounded size."""
        out = np.empty(len(self.starts), np.uint64)
        values = BYTE_VALUES.copy()
        values[32] = 0
        i, n = 0, len(self.starts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + _BLOCK)))
            lo, hi = self.starts[i], self.ends[j - 1]
            s = self.starts[i:j] - lo
            rel = np.arange(hi - lo) - np.repeat(s, np.diff(np.append(s, hi - lo)))
            v = values[self.data[lo:hi]] * _POWERS[rel & 0xFFFF]
            out[i:j] = np.add.reduceat(v, s)
            i = j
        return mix(out)

    def word(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].tobytes().decode("utf-8", "replace")


def gram_hashes(wh: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position (length ``len(wh) - k + 1``, at least 0)."""
    n = max(0, len(wh) - k + 1)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h * np.uint64(BASE) + wh[j:j + n]
    return mix(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values (doubling; ``len(x) - w + 1`` results)."""
    if len(x) < w:
        return x[:0]
    span, m = 1, x
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[:len(m) - (w - span)], m[w - span:]) if span < w else m
