"""Vectorised word segmentation and hashing over batches of UTF-8 text.

Everything here runs inside tasks, on one bounded Arrow batch at a time.  A word
is a maximal run of bytes outside a separator set; A-Z are lower-cased.  A word's
64-bit hash is a polynomial over a random byte table, finished by a bit mixer, and
does not depend on where the word stands, on the batch or on the platform.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 16
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
#: `[^\x20\x09-\x0D]+`
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: everything ASCII but letters
NON_LETTER = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, U(base), dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def spans(buf: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    inside = np.empty(len(buf) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(separators[buf], out=inside[1:-1].view(np.bool_))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans of `buf`, worked on in pieces that stay in cache."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        size = int(ends[j - 1]) - base
        power, inverse = _power_tables(size)
        total = np.empty(size + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[buf[base : base + size]] * power[:size], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


class Words:
    """The words of a list of texts: hash, start and end in `buf`; `bounds[i]:bounds[i+1]` are text i's."""

    __slots__ = ("bounds", "buf", "ends", "hash", "starts")

    def __init__(self, texts: list[str | None], separators: np.ndarray = SPACE):
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.buf = np.frombuffer(b"\n".join(coded) or b"\n", dtype=np.uint8)
        at = np.zeros(len(coded) + 1, dtype=np.int64)
        np.cumsum([len(c) + 1 for c in coded], out=at[1:])
        self.starts, self.ends = spans(self.buf, separators)
        self.bounds = np.searchsorted(self.starts, at)
        self.hash = hashes(self.buf, self.starts, self.ends)

    def count(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes().lower()


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` by text, along the first axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def trim() -> None:
    """Give free memory back: a worker process goes on to other tasks, and keeps the most it ever had otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(texts: list[str | None], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters; a longer text stands alone."""
    i = size = 0
    for j, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(texts):
        yield i, len(texts)


def batches(it: Iterable, limit: int = 2 << 20, rows: int = 512, column: str = "text") -> Iterator[tuple[object, list[str | None]]]:
    """(record batch slice, its texts) for Arrow batches with a text column: at most `rows` texts, and about `limit` characters."""
    trim()
    for batch in it:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            texts = part.column(part.schema.get_field_index(column)).to_pylist()
            for i, j in slices(texts, limit):
                yield part.slice(i, j - i), texts[i:j]
    batch = part = texts = None
    trim()


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width`-word shingles, and their bounds by text.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    h, n = words.hash, words.count()
    many = np.maximum(n - width + 1, np.minimum(n, 1))
    bounds = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(many, out=bounds[1:])
    first = np.repeat(words.bounds[:-1] - bounds[:-1], many) + np.arange(bounds[-1])
    size = np.repeat(np.minimum(n, width), many)
    out = size.astype(np.uint64)
    padded = np.concatenate([h, np.zeros(width, dtype=np.uint64)])
    for k in range(width):
        step = padded[first + k] * U(pow(_BASE, 2 * k + 3, 1 << 64))
        out += step if not len(size) or size.min() == width else np.where(k < size, step, U(0))
    return mix(out), bounds
