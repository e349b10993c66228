"""Removal of 50-word passages that an earlier document has too, by recompression.

Recompression names runs of equal words first, then, round after round, pairs of
a left and a right symbol.  A name is a 64-bit hash of what it stands for, so it
is the same everywhere: Spark needs no exchange to agree on names, only to find
those that documents share.  Whether two symbols join depends on these two alone
(a bit of either name), so what precedes a passage can spoil its parse only from
its edge inwards, and how far is known exactly: a run at the edge may go on
outside; after that, the first symbol left whole is lost in a round only if it is
a right one, the last only if it is a left one.  The rest are the interior
symbols, which all occurrences of the passage have in common.

Each 50-word window is known by one of its interior symbols: of the last round
that leaves it any, the longest of the first LOOK.  A window of one or two runs
has none; its own hash is its name.  Names that two documents or more have reveal
candidate windows; these are verified by 128 bits of their words, 64 for each of
two unlike hashes.

Null or empty text has no words and nothing to remove.  Windows are judged on
the input.  Rows with the same doc_id are judged together and keep a row each:
only a strictly smaller doc_id removes.  A row without doc_id is left out.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .cut import cut, release, small
from .text import U

#: Words of a window, rounds of pairs, interior symbols of which a window takes the longest.
WIDTH, ROUNDS, LOOK = 50, 9, 4


class Symbols(NamedTuple):
    """A parse of n words: where symbols begin, their names, where they end, and the symbol that begins at each word."""

    at: np.ndarray
    name: np.ndarray
    ends: np.ndarray
    index: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, name: np.ndarray, n: int) -> Symbols:
        index = np.full(n + 1, len(at))
        index[at] = np.arange(len(at))
        return cls(at, name, np.append(at[1:], n), index)

    def longest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The name of the longest of the first LOOK symbols from each of lo, up to hi."""
        best = k = self.index[lo]
        long = self.ends[k] - self.at[k]
        for j in range(1, LOOK):
            other = np.minimum(k + j, len(self.at) - 1)
            size = np.where((k + j < len(self.at)) & (self.ends[other] <= hi), self.ends[other] - self.at[other], 0)
            best, long = np.where(size > long, other, best), np.maximum(size, long)
        return self.name[best]


def parses(h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[Symbols, np.ndarray, np.ndarray]]:
    """The parse after each round, and the interior's bounds: where it begins for windows from each word, where it ends for those up to each word."""
    n = len(h)
    at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
    size = np.diff(np.append(at, n))
    s = Symbols.of(at, np.where(size > 1, T.mix(h[at] * U(0xC2B2AE3D27D4EB4F) + size.astype(U)), h[at]), n)
    run = np.repeat(np.arange(len(at)), size)
    lo, hi = np.append(s.ends[run], n), np.append(0, at[run])
    yield s, lo, hi
    for r in range(1, ROUNDS + 1):
        right = (T.mix(s.name ^ U(0xA24BAED4963EE407 * r & (1 << 64) - 1)) & U(1)).astype(bool)
        first, last = s.index[lo], s.index[hi]
        lo = np.where(np.append(right, False)[first], np.append(s.ends, n)[first], lo)
        hi = np.where(np.append(True, right)[last], hi, np.append(0, s.at)[last])
        pair = ~right[:-1] & right[1:] & (doc[s.at[1:]] == doc[s.at[:-1]])
        left, name = np.flatnonzero(pair), s.name.copy()
        name[left] = T.mix(T.mix(name[left] + U(r)) * U(0xC2B2AE3D27D4EB4F) + name[left + 1])
        keep = np.append(True, ~pair)
        s = Symbols.of(s.at[keep], name[keep], n)
        yield s, lo, hi


def picks(h: np.ndarray, doc: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a chunk, as their first words, and the name that each is known by."""
    starts = np.flatnonzero(T.within(of, WIDTH))
    if not len(starts):
        return starts, np.zeros(0, U)
    names, live, last = T.windows(h, WIDTH)[starts], np.arange(len(starts)), None
    for s, lo, hi in parses(h, doc):
        a, e = lo[starts[live]], hi[starts[live] + WIDTH]
        inner = a < e
        if last and not inner.all():
            before, x, y = last
            names[live[~inner]] = before.longest(x[~inner], y[~inner])
        live, last = live[inner], (s, a[inner], e[inner])
        if not len(live):
            return starts, names
    names[live] = last[0].longest(*last[1:])
    return starts, names


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names that each document's windows are known by, once each."""
    for b in batches:
        ids = np.asarray(b.column("doc_id"))
        for w in T.chunks(b.column("text")):
            starts, name = picks(w.hashes(), doc := w.doc(), w.of)
            d = doc[starts]
            new = np.append(True, (name[1:] != name[:-1]) | (d[1:] != d[:-1]))[: len(name)]
            by = np.lexsort((name[new], d[new]))
            name, d = name[new][by], d[new][by]
            new = np.append(True, (name[1:] != name[:-1]) | (d[1:] != d[:-1]))[: len(name)]
            yield pa.RecordBatch.from_pydict({"name": name[new].view(np.int64), "doc_id": ids[w.first + d[new]]})


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that have a shared name; asks: a smaller document has that name."""
    for b in batches:
        ids, shared, flag = np.asarray(b.column("doc_id")), b.column("names"), b.column("asks")
        for w in T.chunks(b.column("text")):
            h = w.hashes()
            starts, name = picks(h, doc := w.doc(), w.of)
            d = doc[starts]
            kind = np.zeros(len(starts), np.int8)
            for k, (a, e) in enumerate(zip(*(np.searchsorted(d, np.arange(len(w.of) - 1), side) for side in ("left", "right")), strict=True)):
                known = np.asarray(shared[w.first + k].values, np.int64).view(U)
                by = np.argsort(known)
                at = np.minimum(np.searchsorted(known[by], name[a:e]), len(known) - 1)
                asks = np.asarray(flag[w.first + k].values.to_numpy(zero_copy_only=False), np.int8)
                kind[a:e] = np.where(known[by][at] == name[a:e], 1 + asks[by][at], 0)
            starts, d, kind = starts[kind > 0], d[kind > 0], kind[kind > 0]
            one, two = (T.windows(x, WIDTH, seed)[starts].view(np.int64) if len(starts) else np.zeros(0, np.int64) for x, seed in ((h, 1), (w.hashes(2), 2)))
            yield pa.RecordBatch.from_pydict({"one": one, "two": two, "doc_id": ids[w.first + d], "start": (starts - w.of[d]).astype(np.int32), "asks": kind == 2})


def kept_words(words: T.Words, k: int, starts: np.ndarray) -> tuple[int, int, list[bytes]]:
    """Words of document k, how many the windows at starts cover, and the others."""
    a, b = int(words.of[k]), int(words.of[k + 1])
    cover = np.zeros(b - a + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + WIDTH, b - a), -1)
    keep = np.cumsum(cover)[: b - a] == 0
    raw = words.data.tobytes()
    rest = [raw[x:y] for x, y in zip(words.start[a:b][keep], words.end[a:b][keep], strict=True)]
    return b - a, b - a - len(rest), rest


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {"doc_id": b.column("doc_id").to_pylist(), "n_words": [], "n_removed": [], "kept_text": []}
        starts, copy = b.column("starts"), b.column("copy").to_pylist()
        for w in T.chunks(b.column("text")):
            for k in range(len(w.of) - 1):
                n = int(w.of[k + 1] - w.of[k])
                s = np.arange(max(0, n - WIDTH + 1)) if copy[w.first + k] else np.asarray(starts[w.first + k].as_py() or [], np.int64)
                n, gone, rest = kept_words(_one(w, k), 0, s[s + WIDTH <= n])
                out["n_words"].append(n)
                out["n_removed"].append(gone)
                out["kept_text"].append(b" ".join(rest).decode())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]))


def _one(w: T.Words, k: int) -> T.Words:
    a, b = int(w.of[k]), int(w.of[k + 1])
    if a == b:
        return T.Words(0, w.data[:0], w.start[:0], w.end[:0], np.array([0, 0]))
    lo, hi = int(w.start[a]), int(w.end[b - 1])
    return T.Words(0, w.data[lo:hi], w.start[a:b] - lo, w.end[a:b] - lo, np.array([0, b - a]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([sha256(t.encode()).hexdigest() for t in b.column("kept_text").to_pylist()], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every document.

    An exact copy of a document with a smaller doc_id loses all its windows;
    it takes no part in the search, since its first copy stands for it.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    digests = docs.select("doc_id", F.md5("text").alias("digest")).where("digest is not null")
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = cut(digests.join(firsts, "digest").where("doc_id > least").select("doc_id").distinct(), "passage-copies")
    own = docs.join(small(copies), "doc_id", "left_anti")
    names = cut(own.mapInArrow(_names, "name long, doc_id long"), "passage-names")
    shared = names.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("name", "least")
    places = names.join(shared, "name").groupBy("doc_id").agg(F.collect_list(F.struct("name", (F.col("doc_id") > F.col("least")).alias("asks"))).alias("x"))
    found = cut(places.select("doc_id", F.col("x.name").alias("names"), F.col("x.asks").alias("asks")), "passage-places")
    release(names)
    # the texts of other documents stay where they are: only those with a candidate are shuffled
    hit = own.join(small(found.select("doc_id")), "doc_id", "left_semi").join(found, "doc_id")
    spans = cut(hit.mapInArrow(_candidates, "one long, two long, doc_id long, start int, asks boolean"), "passage-spans")
    least = spans.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("one", "two", "least")
    gone = cut(spans.where("asks").join(least, ["one", "two"]).where("doc_id > least").groupBy("doc_id").agg(F.collect_set("start").alias("starts")), "passage-windows")
    release(found, spans)
    marks = gone.select("doc_id", "starts", F.lit(False).alias("copy")).unionByName(copies.select("doc_id", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy")))
    ids = small(marks.select("doc_id"))
    clean = docs.join(ids, "doc_id", "left_anti").select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"), F.lit(False).alias("copy"))
    rest = docs.join(ids, "doc_id", "left_semi").join(marks, "doc_id").select("doc_id", "text", "starts", "copy")
    return clean.unionByName(rest).mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept_text string")


def digests(result: DataFrame) -> DataFrame:
    """The result with the hash of the kept words in place of their text."""
    return result.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
