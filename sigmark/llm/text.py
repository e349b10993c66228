"""Words and word hashes of whole Arrow text columns, without a Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+``.  All hashes are 64-bit, the same on every
machine and in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes of text that are hashed at a time; one longer document is taken alone.
CHUNK = 1 << 20
#: Bytes of a word above which xxhash takes over.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


@dataclass
class Words:
    """Words of the documents first .. first+len(of)-2 of a column; of[i]:of[i+1] are those of one document."""

    first: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray
    #: Where each document's text begins in data.
    at: np.ndarray | None = None

    def hashes(self, seed: int = 1) -> np.ndarray:
        """One hash a word: its bytes, eight at a time, each lane through the finaliser, so no structure of the text cancels out."""
        size = self.end - self.start
        lanes = np.ndarray((len(self.data) + 1,), "<u8", np.concatenate((self.data, np.zeros(8, np.uint8))), strides=(1,))
        h = mix(size.astype(U) * U(0x9E3779B97F4A7C15) + mix(np.array([seed], U)))
        some = np.arange(len(size))
        for k in range(0, LONG_WORD, 8):
            some = some[size[some] > k]
            if not len(some):
                break
            left = np.minimum(size[some] - k, 8).astype(U) * U(8)
            lane = lanes[self.start[some] + k] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - left))
            h[some] = mix((h[some] ^ lane) * U(0xD6E8FEB86659FD93) + U(k + 1))
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), seed)
        return h

    def doc(self) -> np.ndarray:
        """The document number, within this chunk, of each word."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


#: Bytes that part words: white space, and where asked ASCII punctuation too.
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
PUNCT = BLANK | np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def chunks(col: pa.Array, lower: bool = False, limit: int = CHUNK, blank: np.ndarray = BLANK) -> Iterator[Words]:
    """The words of a text column, some documents at a time; lower: A-Z become a-z; blank: the bytes that part words."""
    at, data = utf8(col)
    n, a = len(at) - 1, 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1))
        part = data[at[a] : at[b]]
        if lower:
            part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        bounds = at[a : b + 1] - at[a]
        space = blank[part]
        word = ~space
        new = np.zeros(len(part) + 1, bool)
        new[bounds] = True
        begins = word.copy()
        begins[1:] &= space[:-1] | new[1:-1]
        ends = word.copy()
        ends[:-1] &= space[1:] | new[1:-1]
        start = np.flatnonzero(begins)
        yield Words(a, part, start, np.flatnonzero(ends) + 1, np.searchsorted(start, bounds), bounds)
        a = b


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of so many hashes, wherever it starts, from hashes of its halves; meaningless across documents."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, span, run = np.full(n, mix(np.array([seed * 2 + 1], U))[0]), 0, 1, hashes
    while True:
        if width & span:
            out = mix(out * U(0xA24BAED4963EE407) + run[done : done + n])
            done += span
        if 2 * span > width:
            return out
        run = mix(run[:-span] * U(0xC2B2AE3D27D4EB4F) + run[span:])
        span *= 2


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range lo..hi-1 as rows: the range's number, and the value."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return of, np.arange(len(of)) - (np.cumsum(size) - size)[of] + lo[of]


def slices(size: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of entries whose sizes sum to most, or single ones above."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def within(of: np.ndarray, width: int) -> np.ndarray:
    """Which of the window starts 0 .. words-width have their whole window in one document."""
    n = int(of[-1]) if len(of) else 0
    ok = np.zeros(n + 1, bool)
    for a, b in zip(of[:-1], of[1:], strict=True):
        if b - a >= width:
            ok[a : b - width + 1] = True
    return ok[: max(0, n - width + 1)]


def shingle_sets(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document: bounds, and the sorted hashes of one document after another.

    A document of one to k-1 words has its whole sequence as its one shingle.
    """
    h, of = words.hashes(), words.of
    w = windows(h, k)
    sets, at = [], [0]
    for a, b in zip(of[:-1], of[1:], strict=True):
        if b - a >= k:
            s = np.unique(w[a : b - k + 1])
        elif b > a:
            s = windows(h[a:b], int(b - a))
        else:
            s = w[:0]
        sets.append(s)
        at.append(at[-1] + len(s))
    return np.array(at), np.concatenate(sets) if sets else w[:0]


def set_hash(members: np.ndarray) -> bytes:
    """128 bits that stand for a set of hashes, whatever its order."""
    with np.errstate(over="ignore"):
        a = int(np.add.reduce(mix(members ^ U(0x5851F42D4C957F2D)), dtype=U)) if len(members) else 0
        b = int(np.add.reduce(mix(members * U(3) + U(0x14057B7EF767814F)), dtype=U)) if len(members) else 0
    return a.to_bytes(8, "little") + b.to_bytes(8, "little")
