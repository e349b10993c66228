"""Documents that hold a benchmark item, exactly or with edits.

Texts are words, lower-cased; ASCII punctuation parts words like white space.
An item of n words is held where some run of words, of whatever length, is within
n // 4 word edits of it.

Candidates come from the CGK embedding.  A walk over words reads the word it
stands on at each step and goes on or stays, as a random bit of the step and the
word says; walks over like sequences fall into step, so edits become differing
steps.  Items are embedded in parts of at most PART words, of which one has no
more than its share of the edits.  Windows of a document are embedded from each
word at which an item can be held at all: an edit spends at most two of the item's
n - 1 word pairs, so that many less must stand there, which is counted exactly.
In each of REPEATS walks a part and a window meet when they agree on SAMPLES
steps, drawn over the whole walk of the part's size; two samples are few enough
that windows with the most edits meet (the tests measure recall against all
windows, for edits of every kind and place; README has the figures), and the
regions that they open are dropped by exact counts of pairs and words, then
verified by exact edit distance.

Null or empty documents hold nothing, and null or empty items are held nowhere.
Items with equal words are found each.  A repeated row of a document gives
repeated rows; a null doc_id gives rows with none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .text import U

#: Items of one pass over the documents; places of parts, and words of items, that are looked up at a time.
BLOCK, HITS = 20_000, 1 << 20
#: Windows that are embedded at a time.
STARTS = 1 << 13
#: Words of a part, walks of each, and steps on which a part and a window must agree.
PART, REPEATS, SAMPLES = 24, 16, 2


def split(col: pa.Array) -> Iterator[T.Words]:
    return T.chunks(pc.utf8_lower(col), blank=T.PUNCT)


def budget(n: int) -> int:
    """Most word edits of an item of n words."""
    return n // 4


def scores(a: np.ndarray, b: np.ndarray, free: bool) -> Iterator[int]:
    """Edit distance of a to b[:1], b[:2] and so on, or where free to the nearest run that ends there; columns of the table as bits of whole numbers."""
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    up, down, score = full, 0, len(a)
    for y in b.tolist():
        here = places.get(y, 0)
        flat = (((here & up) + up) ^ up) | here
        rise, fall = down | ~(flat | up) & full, up & flat
        score += bool(rise & last) - bool(fall & last)
        yield score
        rise = (rise << 1 | (not free)) & full
        up, down = (fall << 1) & full | ~(here | down | rise) & full, rise & (here | down)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences, or most + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not len(a):
        return len(b)
    left, score = len(b), len(a)
    for score in scores(a, b, False):
        left -= 1
        if score - left > most:
            return most + 1
    return score


def nearest(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """Edits and start of the run of text nearest to the item, if it is within most edits: the first to end, and of those the longest."""
    best, end = most + 1, 0
    for k, score in enumerate(scores(item, text, True), 1):
        if score < best:
            best, end = score, k
    if best > most:
        return None
    back = scores(item[::-1], text[max(0, end - len(item) - best) : end][::-1], False)
    return best, end - max(k for k, score in enumerate(back, 1) if score == best)


def parts(n: int) -> list[tuple[int, int]]:
    """Start and length of the parts of an item of n words."""
    k = -(-n // PART)
    at = [n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(at[:-1], at[1:], strict=True)]


def drawn(size: int) -> np.ndarray:
    """The sampled steps of each walk, for parts of so many words: a walk passes about one word in two steps."""
    steps = max(1, size * 19 // 10)
    rng = np.random.default_rng(size)
    return np.sort(np.array([rng.choice(steps, min(SAMPLES, steps), replace=False) for _ in range(REPEATS)]), axis=1)


def embedded(word: np.ndarray, bits: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size of parts, the sampled words of each walk from each start, up to its end, as one number (walks, starts).

    word: places in the vocabulary, the last of bits for other words and for what
    lies beyond the end; bits: each walk's random bits of each word, one a step.
    """
    want = {size: drawn(size) for size in sizes}
    out = {size: np.zeros((len(bits), len(start)), np.int64) for size in sizes}
    none, flat = bits.shape[1] - 1, bits.ravel()
    row = (np.arange(len(bits)) * bits.shape[1])[:, None]
    word = np.append(word, none)
    at = np.broadcast_to(start, (len(bits), len(start))).copy()
    for step in range(1 + max(int(x.max()) for x in want.values())):
        here = np.where(at < end, word[np.minimum(at, len(word) - 1)], none)
        for size, steps in want.items():
            if len(r := np.flatnonzero((steps == step).any(1))):
                out[size][r] = out[size][r] * (none + 1) + here[r]
        at += (flat[row + here] >> U(step) & U(1)).astype(np.int64)
    return out


class Items:
    """Benchmark items as words, word pairs and embedded parts; items of equal words are one."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        self.ids: list[list[int]] = []
        self.items: list[np.ndarray] = []
        known: dict[bytes, int] = {}
        for w in split(pa.array([t for _, t in rows], pa.string())):
            h = w.hashes()
            for k, (a, b) in enumerate(zip(w.of[:-1], w.of[1:], strict=True)):
                if b > a:
                    if (i := known.setdefault(h[a:b].tobytes(), len(self.items))) == len(self.items):
                        self.items.append(h[a:b].copy())
                        self.ids.append([])
                    self.ids[i].append(rows[w.first + k][0])
        self.sizes = np.array([len(h) for h in self.items], np.int64)
        self.edits = np.array([budget(n) for n in self.sizes], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        every = np.concatenate([np.zeros(0, U), *self.items])
        self.vocab = np.unique(every)
        self.words = self.number(every)
        inner = np.ones(max(0, len(every) - 1), bool)
        inner[self.at[1:-1] - 1] = False
        walk = np.arange(1, REPEATS + 1).astype(U)[:, None] * U(0x9E3779B97F4A7C15)
        self.bits = T.mix(walk + np.append(self.vocab, U(0)))
        self.pairs = np.unique((self.words[:-1] * len(self.vocab) + self.words[1:])[inner])
        rows_of: dict[int, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.sizes.tolist()):
            for a, size in parts(n):
                rows_of.setdefault(size, []).append((i, a))
        #: By size: each walk's hashes of the parts, sorted, their items, and their starts in them.
        self.parts = {}
        for size, rows_ in rows_of.items():
            which, start = np.array(rows_, np.int64).T
            keys = embedded(self.words, self.bits, self.at[which] + start, self.at[which + 1], [size])[size]
            by = np.argsort(keys, axis=1, kind="stable")
            self.parts[size] = (np.take_along_axis(keys, by, 1), which[by], start[by])
        #: Items of like size together: the pairs that a region must have at least, the most words and edits, and where parts of each size begin.
        self.kinds: list[tuple[int, int, int, dict[int, tuple[int, int]]]] = []
        like: dict[tuple[int, int], list[int]] = {}
        for n in sorted(set(self.sizes.tolist())):
            like.setdefault((n.bit_length(), n >> max(0, n.bit_length() - 4)), []).append(n)
        for sizes in like.values():
            begin: dict[int, tuple[int, int]] = {}
            for n in sizes:
                for a, size in parts(n):
                    lo, hi = begin.get(size, (a, a))
                    begin[size] = min(a, lo), max(a, hi)
            self.kinds.append((min(n - 1 - 2 * budget(n) for n in sizes), sizes[-1], budget(sizes[-1]), begin))

    def number(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, -1 for others."""
        if not len(self.vocab):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at, -1)

    def regions(self, h: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Documents, items, and bounds in h of all regions that may hold the item."""
        n = len(h)
        word = self.number(h)
        pair = np.zeros(n, bool)
        both = np.flatnonzero((word[:-1] >= 0) & (word[1:] >= 0))
        if len(both) and len(self.pairs):
            code = word[both] * len(self.vocab) + word[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            pair[both] = self.pairs[at] == code
        sums = np.concatenate(([0], np.cumsum(pair)))
        doc_of = np.repeat(np.arange(len(of) - 1), np.diff(of))
        seen = np.flatnonzero(word >= 0)
        places = np.sort(word[seen] * n + seen)
        near, known_word = self.near(sums, n), np.where(word < 0, len(self.vocab), word)
        p = np.flatnonzero(np.any(list(near.values()), axis=0)) if near else np.zeros(0, np.int64)
        for k in range(0, len(p), STARTS):
            some = p[k : k + STARTS]
            for size, keys in embedded(known_word, self.bits, some, of[doc_of[some] + 1], list(near)).items():
                mine, (known, which, start) = near[size][some], self.parts[size]
                for r in range(REPEATS):
                    lo, hi = np.searchsorted(known[r], keys[r][mine], "left"), np.searchsorted(known[r], keys[r][mine], "right")
                    for part in T.slices(hi - lo, HITS):
                        row, k2 = T.spread(lo[part], hi[part])
                        at = some[mine][part][row]
                        i, first = which[r][k2], at - start[r][k2]
                        doc, most = doc_of[at], self.edits[i]
                        # a window may begin that many words off its part's place, and that off the item's
                        a, b = np.maximum(of[doc], first - 2 * most), np.minimum(of[doc + 1], first + self.sizes[i] + 2 * most)
                        ok = (b - a >= self.sizes[i] - most) & (sums[np.maximum(b - 1, a)] - sums[a] >= self.sizes[i] - 1 - 2 * most)
                        doc, i, a, b = np.unique(np.stack((doc[ok], i[ok], a[ok], b[ok])), axis=1)
                        for few in T.slices(self.sizes[i], HITS):
                            ok = self.covered(i[few], a[few], b[few], places, n)
                            yield tuple(x[few][ok] for x in (doc, i, a, b))

    def near(self, sums: np.ndarray, n: int) -> dict[int, np.ndarray]:
        """For each size of parts, at which words its windows may begin: an item is about there, as far as word pairs tell."""
        out: dict[int, np.ndarray] = {}
        wide = 2 * max((size + edits for _, size, edits, _ in self.kinds), default=0) + 1
        padded = lambda x: np.concatenate((np.zeros(wide, np.int32), x, np.full(wide, x[-1]))).astype(np.int32)
        sums = padded(sums)
        for need, size, edits, begin in self.kinds:
            ok = sums[wide + size + edits :][:n] - sums[wide - edits :][:n] >= need
            if ok.any():
                reached = padded(np.concatenate(([0], np.cumsum(ok))))
                for part, (lo, hi) in begin.items():
                    here = reached[wide - lo + edits + 1 :][:n] > reached[wide - hi - edits :][:n]
                    out[part] = out[part] | here if part in out else here
        return out

    def covered(self, i: np.ndarray, a: np.ndarray, b: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """Whether all but the edits of an item's words occur in the region; places: word * n + place, sorted."""
        row, k = T.spread(self.at[i], self.at[i + 1])
        key = self.words[k] * n
        at = np.minimum(np.searchsorted(places, key + a[row]), len(places) - 1)
        there = (places[at] >= key + a[row]) & (places[at] < key + b[row])
        return np.bincount(row[there], minlength=len(i)) >= self.sizes[i] - self.edits[i]

    def search(self, h: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item id, start, item size, edits) of the nearest run, for words h of documents with bounds of."""
        if not len(h) or not self.items:
            return
        found = [np.stack(x) for x in self.regions(h, of)]
        if not found:
            return
        merged: list[list[int]] = []
        for doc, i, a, b in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist():
            if merged and merged[-1][:2] == [doc, i] and a <= merged[-1][3]:
                merged[-1][3] = max(b, merged[-1][3])
            else:
                merged.append([doc, i, a, b])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, i, a, b in merged:
            item, key = self.items[i], (doc, i)
            most = best[key][0] - 1 if key in best else budget(len(item))
            if most >= 0 and (run := nearest(item, h[a:b], most)):
                best[key] = (run[0], a + run[1])
        for (doc, i), (d, p) in best.items():
            for item_id in self.ids[i]:
                yield doc, item_id, p - int(of[doc]), len(self.items[i]), d


def contaminated(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start (in words), n_words of the item and its edits, for each item that a document holds.

    Items are a query set: a block of them at a time comes to the driver and is
    broadcast, and further blocks take further passes over docs.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text").where("item_id is not null")
    passes = max(1, -(-items.count() // block))
    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else items
        known = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.collect()])
        found = docs.select("doc_id", "text").where("text is not null").mapInArrow(_scan(known), "doc_id long, item_id long, start int, n_words int, edits int")
        out = found if out is None else out.unionByName(found)
    return out


def _scan(known):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(known.value)
        for b in batches:
            ids, rows = b.column("doc_id"), []
            for w in split(b.column("text")):
                rows += [(ids[w.first + d].as_py(), *rest) for d, *rest in items.search(w.hashes(), w.of)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "start", "n_words", "edits"])

    return each


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns; few are dropped, so Spark may broadcast their ids."""
    return docs.join(contaminated(docs, items).select("doc_id").distinct(), "doc_id", "left_anti")
