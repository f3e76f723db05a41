"""Vectorised word, shingle and window hashing over Arrow string batches.

Words are runs of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text.  Rows lie
one after the other in one byte buffer; a row's end always ends a word.  All
hashes are 64 bits wide: a polynomial over the bytes of a word (by prefix sums,
so that no Python loop runs per byte), finalised by a mixing step, and a
Rabin-Karp polynomial over the word hashes of a window.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
RADIX = 0xD6E8FEB86659FD93 | 1
MORE = 0xA0761D6478BD642F
MASK = (1 << 64) - 1
#: Bytes of text that are hashed at once, but for a longer row.
LOT_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, dtype=U), np.ones(1, dtype=U)

#: Called when a Python worker turns to another kind of task; they drop what it remembers.
FORGET: list = []
_kind = ""


def task(kind: str) -> None:
    """To be called at the start of each task: workers are reused, so memory of earlier ones goes back to the system."""
    global _kind, _powers
    if kind != _kind:
        _powers = _powers[0][:1].copy(), _powers[1][:1].copy()
        for f in FORGET:
            f()
        _kind = kind
    trim()


def trim() -> None:
    """Gives free memory back to the system; to be called at the end of a task too, as idle workers stay."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, LOT_BYTES + 1)
        both = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        _powers = both[0], both[1]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the rows' offsets (n + 1); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def spans(lengths: np.ndarray, limit: int = LOT_BYTES):
    """(from, to) of runs of rows with at most limit bytes together, one row at least."""
    ends = np.cumsum(lengths)
    i, n = 0, len(lengths)
    while i < n:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield i, j
        i = j


def in_lots(table: pa.Table, size: int = LOT_BYTES) -> pa.Table:
    """The table in batches of about so many bytes, as each goes to the JVM at once."""
    rows = max(1, table.num_rows * size // max(table.nbytes, 1))
    return pa.Table.from_batches(table.combine_chunks().to_batches(max_chunksize=rows), table.schema)


class Words:
    """Words of some rows: byte starts and ends, rows' word offsets, word hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = np.empty(n + 2, dtype=np.int8)
        solid[0] = solid[-1] = 0
        solid[1:-1] = ~_SPACE[data]
        step = np.diff(solid)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        if len(cuts):
            cuts = np.unique(cuts)
            cuts = cuts[(solid[cuts] == 1) & (solid[cuts + 1] == 1)]  # a word runs over a row's end
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        self.starts, self.ends = starts, ends
        self.rows = np.searchsorted(starts, offsets)  # first word of each row, and the number of words
        self.hash = self._hashes() if hashes else None

    def _hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=U)
        p, inverse = powers(len(self.data) + 1)
        total = np.empty(len(self.data) + 1, dtype=U)
        total[0] = 0
        np.cumsum((self.data.astype(U) + U(1)) * p[: len(self.data)], dtype=U, out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * inverse[self.starts] + U(0x632BE59BD9B4E019))

    def more(self, first: np.ndarray, k: int) -> np.ndarray:
        """32 further bits of the hash of the windows of k words that begin at ``first``, by a polynomial of their own."""
        out = np.zeros(len(first), dtype=U)
        for j in range(k):
            out *= U(MORE)
            out += self.hash[first + j]
        return (mix(out ^ U(RADIX)) >> U(32)).astype(np.uint32)

    def windows(self, k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all windows of k words, their first words, and the rows' window offsets.

        whole: a row with fewer words, but any, gives one window of all of them.
        """
        counts = np.diff(self.rows)
        n = np.maximum(counts - k + 1, 0)
        h = self.hash
        first = np.arange(len(h)) if len(h) else np.zeros(0, np.int64)
        room = np.repeat(self.rows[1:], counts) - first  # words from here to the row's end
        first = first[room >= k]
        out = np.zeros(len(first), dtype=U)
        for j in range(k):
            out *= U(RADIX)
            out += h[first + j]
        out = mix(out + U(k))
        offsets = np.concatenate([[0], np.cumsum(n)])
        if whole and (short := np.flatnonzero((counts > 0) & (counts < k))).size:
            extra = np.empty(len(short), dtype=U)
            for i, r in enumerate(short):
                x = 0
                for w in h[self.rows[r] : self.rows[r + 1]]:
                    x = (x * RADIX + int(w)) & MASK
                extra[i] = (x + int(counts[r])) & MASK
            extra = mix(extra)
            out = np.insert(out, offsets[short], extra)
            first = np.insert(first, offsets[short], self.rows[short])
            n[short] = 1
            offsets = np.concatenate([[0], np.cumsum(n)])
        return out, first, offsets


def sorted_sets(h: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each row's distinct hashes in ascending order."""
    out = []
    for i in range(len(offsets) - 1):
        x = np.sort(h[offsets[i] : offsets[i + 1]])
        if len(x) > 1:
            new = np.empty(len(x), dtype=bool)
            new[0] = True
            np.not_equal(x[1:], x[:-1], out=new[1:])
            x = x[new]
        out.append(x)
    return out


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values (modulo 2**64 for unsigned ones); 0 for an empty row."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[offsets[1:]] - total[offsets[:-1]]
