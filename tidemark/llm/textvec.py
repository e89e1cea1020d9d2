"""Words of an Arrow column of texts as numpy arrays: all texts of a batch are split
and hashed together, so no Python code runs per word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_CODE = mix(np.arange(1, 257, dtype=np.uint64))[_LOWER]  # a random number per byte, the same for A and a
_PLACE = mix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _BASE, np.uint64)
    down = np.full(n + 1, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def keep_memory() -> None:
    """Freed arrays of up to 31 MB stay with the process. The C library hands larger blocks back than it has ever seen
    freed, 128 KB at first, and gets new ones in pages that cost as much time as the arithmetic in them."""
    np.empty(31 << 20, np.uint8)


class Words:
    """Words of a batch of texts.

    buf: all bytes; offsets: where texts begin (and the end); start, end: where words do;
    doc: the text of each word; first: index of each text's first word (and the end)."""

    def __init__(self, texts: pa.Array, alnum: bool = False):
        texts = texts.cast(pa.large_binary()).fill_null(b"") if texts.null_count else texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        n = len(self.buf)
        inside = (_ALNUM if alnum else _SPACE)[self.buf]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = np.zeros(n + 1, bool)
        ends[1:] = inside
        ends[:-1] &= ~inside
        edge = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        begins[edge] |= inside[edge]
        ends[edge] |= inside[edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, A-Z taken as a-z.

        Prefix sums of code * BASE^place; a word is a difference of two, shifted to place 0."""
        n = len(self.buf)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _powers(1 << max(16, (n - 1).bit_length()))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[self.buf] * up[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * _PLACE[63])

    def texts(self, i: np.ndarray) -> list[str]:
        """The words i, A-Z in lower case."""
        if not len(i):
            return []
        size = self.end[i] - self.start[i] + 1  # a blank after each
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) + np.repeat(self.start[i] - (ends - size), size)
        out = _LOWER[self.buf[np.minimum(at, len(self.buf) - 1)]]
        out[ends - 1] = 32
        return out[:-1].tobytes().decode("utf-8", "replace").split(" ")


def shingles(w: Words, size: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingles of `size` words; a text with fewer words, but
    not none, is one shingle."""
    h = w.hashes()
    n = len(h)
    if n >= size:
        each = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            each += h[j : n - size + 1 + j] * _PLACE[j]
        each = mix(each)
    out = []
    for d, (a, c) in enumerate(zip(w.first[:-1].tolist(), w.count.tolist())):
        if c >= size:
            out.append(np.unique(each[a : a + c - size + 1]))
        elif c:
            out.append(mix((h[a : a + c] * _PLACE[:c]).sum(keepdims=True, dtype=np.uint64) + _PLACE[40 + c]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def pieces(batch: pa.RecordBatch, column: int, limit: int = 1 << 20):
    """Slices of a batch that hold about `limit` bytes of text each (a longer text is one slice)."""
    texts = batch.column(column)
    if not len(texts):
        return
    sizes = np.cumsum(np.frombuffer(_lengths(texts), np.int64))
    at = 0
    while at < len(sizes):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _lengths(texts: pa.Array) -> bytes:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
