"""Ranked lexical search over an index of shards, by Block-Max MaxScore.

``index`` writes one row a shard: documents of some two million terms, their
sizes, the shard's terms in order, and for each term a list of postings in
blocks of 128.  A block holds gaps and term frequencies in as few bytes as its
largest needs; beside it stand its first and last document, greatest frequency
and least document size, which bound any score in it whatever the corpus
statistics become, so an index needs one pass and may grow.

``search`` takes items in blocks of bounded size, gets document frequencies from
the index, and passes over the shards once.  A task keeps each item's best
documents from shard to shard.  In a shard, lists in the order of their bounds
are split: those whose bounds together stay below the item's worst kept score
are not essential, and no document of them alone can enter.  Documents of the
essential lists are scored; then the bounds of their blocks in the other lists
turn most of them away before such a block is unpacked; the rest are scored in
full, greatest bounds first.  The tasks' heaps are merged by Spark.

Terms are maximal runs of ASCII letters and digits and all that is not ASCII,
with A-Z as a-z, known by 64-bit hashes.  Scores are integers (``impact``), so
ties are exact, and are broken by the lesser doc_id.  Null text, and text without
a term, counts nowhere.  Rows without doc_id are left out.  Repeated rows are
documents of their own.  Rows of one item_id are one item, with the terms of
all its rows; an item without terms has no result.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .cut import cut
from .text import U

#: Documents kept for an item.
TOP = 50
#: Terms of a shard, beyond which the next one begins; postings of a block; terms of the items that are searched at once.
SHARD, BLOCK, ASKED = 1 << 21, 128, 1 << 20
#: Bytes that part terms.
NO_TERM = np.isin(np.arange(256), [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Arrays of a shard, and their types.
ARRAYS = {"ids": np.int64, "sizes": np.uint32, "terms": np.uint64, "df": np.uint32, "first": np.uint32, "last": np.uint32, "most": np.uint32, "least": np.uint32, "widths": np.uint8, "data": np.uint8}
INDEX = "n_docs long, n_terms long, " + ", ".join(f"{c} binary" for c in ARRAYS)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_norm(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents of n terms, where docs documents have total terms."""
    if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
        return np.array([100 - 50 + 50 * int(x) * docs // total for x in n], np.int64)
    return 100 - 50 + 50 * n.astype(np.int64) * docs // total


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _bytes_needed(x: np.ndarray, none: int) -> np.ndarray:
    """0 (all are none), 1, 2 or 4 bytes for values up to x."""
    return np.select([x <= none, x < 1 << 8, x < 1 << 16], [0, 1, 2], 4)


def pack(ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """A shard of documents with so many terms each, whose hashes follow one another."""
    terms, rank = np.unique(hashes, return_inverse=True)
    code = rank.astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes)
    code.sort()
    head = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    tf, of, doc = np.diff(np.append(head, len(code))), code[head] // len(ids), code[head] % len(ids)
    df = np.bincount(of, minlength=len(terms))
    begins = np.cumsum(df) - df
    # blocks: each BLOCK postings of a list
    head = np.flatnonzero((np.arange(len(doc)) - begins[of]) % BLOCK == 0)
    count = np.diff(np.append(head, len(doc)))
    block, place = T.spread(np.zeros_like(count), count)
    gap = np.append(0, np.diff(doc))
    gap[head] = 0
    wide = [_bytes_needed(np.maximum.reduceat(x, head), none) for x, none in ((gap, 0), (tf, 1))]
    size = count * (wide[0] + wide[1])
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for x, w, start in ((gap, wide[0], at), (tf, wide[1], at + count * wide[0])):
        for lane in range(4):
            some = np.flatnonzero(w[block] > lane)
            b = block[some]
            data[start[b] + place[some] * w[b] + lane] = (x[some] >> 8 * lane) & 255
    arrays = {
        "ids": ids, "sizes": sizes, "terms": terms, "df": df, "first": doc[head], "last": doc[head + count - 1], "most": np.maximum.reduceat(tf, head),
        "least": np.minimum.reduceat(sizes[doc], head), "widths": wide[0] * 8 + wide[1], "data": data,
    }
    made = [pa.array([arrays[c].astype(kind).tobytes()], pa.binary()) for c, kind in ARRAYS.items()]
    return pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([int(sizes.sum())]), *made], names=["n_docs", "n_terms", *ARRAYS])


class Shard:
    """Lists of one row of the index, unpacked a block at a time."""

    def __init__(self, row: dict) -> None:
        for c, kind in ARRAYS.items():
            setattr(self, c, np.frombuffer(row[c].as_buffer(), kind))
        df = self.df.astype(np.int64)
        self.blocks = np.concatenate(([0], np.cumsum(-(-df // BLOCK))))
        self.count = np.full(self.blocks[-1], BLOCK)
        self.count[self.blocks[1:] - 1] = (df - 1) % BLOCK + 1
        self.gap_bytes, self.tf_bytes = self.widths.astype(np.int64) // 8, self.widths.astype(np.int64) % 8
        size = self.count * (self.gap_bytes + self.tf_bytes)
        self.at = np.cumsum(size) - size

    def unpack(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings of these blocks: the number of each one's block among them, its document and its frequency."""
        count = self.count[blocks]
        of, place = T.spread(np.zeros_like(count), count)
        out = []
        for width, start in ((self.gap_bytes[blocks], self.at[blocks]), (self.tf_bytes[blocks], self.at[blocks] + count * self.gap_bytes[blocks])):
            x = np.zeros(len(of), np.int64)
            w = width[of]
            for lane in range(int(width.max()) if len(width) else 0):
                some = np.flatnonzero(w > lane)
                x[some] |= self.data[start[of[some]] + place[some] * w[some] + lane].astype(np.int64) << 8 * lane
            out.append(x)
        ends = np.cumsum(out[0])
        begin = np.cumsum(count) - count
        doc = ends - ends[begin][of] + self.first[blocks][of] if len(of) else ends
        return of, doc, np.where(self.tf_bytes[blocks][of] == 0, 1, out[1])


class Heap:
    """The best documents of one item so far."""

    def __init__(self, top: int) -> None:
        self.top, self.scores, self.ids, self.least = top, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        best = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.top:
            self.least = max(1, int(self.scores[-1]))


def best_in(shard: Shard, norms: np.ndarray, lists: np.ndarray, weights: np.ndarray, bound: np.ndarray, most: np.ndarray, heap: Heap) -> None:
    """Put the shard's documents that belong there into an item's heap; lists: the item's terms in the shard; bound, most: of each block and list, for weight 1."""
    most = most[lists] * weights
    order = np.argsort(most, kind="stable")
    rest = int(np.searchsorted(np.cumsum(most[order]), heap.least))
    if rest == len(order):  # all lists together stay below the heap's least score
        return
    spans = [slice(shard.blocks[x], shard.blocks[x + 1]) for x in lists]
    score = np.zeros(len(norms), np.int64)
    essential = np.concatenate([np.arange(spans[k].start, spans[k].stop) for k in order[rest:]])
    of, doc, tf = shard.unpack(essential)
    np.add.at(score, doc, np.repeat(weights[order[rest:]], [spans[k].stop - spans[k].start for k in order[rest:]])[of] * impact(tf, norms[doc]))
    found = np.flatnonzero(np.bincount(doc, minlength=len(norms)))
    # blocks of the other lists that may hold what was found, and what these can add
    others = order[:rest][::-1]
    block, adds = np.zeros((rest, len(found)), np.int64), np.zeros((rest, len(found)), np.int64)
    for i, k in enumerate(others):
        b = spans[k].start + np.searchsorted(shard.last[spans[k]], found)
        there = b < spans[k].stop
        there[there] = shard.first[b[there]] <= found[there]
        block[i], adds[i, there] = b, weights[k] * bound[b[there]]
    left = adds.sum(0)
    for i, k in enumerate(others):
        keep = score[found] + left >= heap.least
        found, left, block, adds = found[keep], left[keep], block[:, keep], adds[:, keep]
        some = adds[i] > 0
        if some.any():
            of, doc, tf = shard.unpack(np.unique(block[i, some]))
            at = np.minimum(np.searchsorted(doc, found[some]), len(doc) - 1)
            hit = doc[at] == found[some]
            score[found[some][hit]] += weights[k] * impact(tf[at[hit]], norms[doc[at[hit]]])
        left = left - adds[i]
    found = found[score[found] >= heap.least]
    heap.add(score[found], shard.ids[found])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, sizes, hashes, total = [], [], [], 0
    for b in batches:
        own = np.asarray(b.column("doc_id"))
        for w in T.chunks(b.column("text"), lower=True, blank=NO_TERM):
            n = np.diff(w.of)
            ids.append(own[w.first : w.first + len(n)][n > 0])
            sizes.append(n[n > 0])
            hashes.append(w.hashes())
            total += len(hashes[-1])
            if total >= SHARD:
                yield pack(*map(np.concatenate, (ids, sizes, hashes)))
                ids, sizes, hashes, total = [], [], [], 0
    if total:
        yield pack(*map(np.concatenate, (ids, sizes, hashes)))


def index(docs: DataFrame) -> DataFrame:
    """The index of all documents, as a table in the shared folder."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return cut(own.mapInArrow(_shards, INDEX), "lexical-index")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in T.chunks(b.column("text"), lower=True, blank=NO_TERM):
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(w.first + w.doc())), pa.array(w.hashes().view(np.int64))], names=["item_id", "term"])


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Items with their terms, so many at a time as have ASKED terms; one with more is alone."""
    terms = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_terms, "item_id long, term long").distinct()
    block, total = [], 0
    for r in terms.groupBy("item_id").agg(F.collect_list("term").alias("terms")).toLocalIterator():
        if block and total + len(r.terms) > ASKED:
            yield block
            block, total = [], 0
        block.append((r.item_id, np.array(r.terms, np.int64).view(U)))
        total += len(r.terms)
    if block:
        yield block


def _frequencies(index: DataFrame, asked: np.ndarray) -> np.ndarray:
    """The number of documents of each asked term."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for b in batches:
            for t, n in zip(b.column("terms"), b.column("df"), strict=True):
                t, n = np.frombuffer(t.as_buffer(), U), np.frombuffer(n.as_buffer(), np.uint32)
                at = np.minimum(np.searchsorted(t, asked), len(t) - 1)
                total += np.where(t[at] == asked, n[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "df"])

    out = np.zeros(len(asked), np.int64)
    for r in index.select("terms", "df").mapInArrow(each, "k long, df long").groupBy("k").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.k] = r.df
    return out


def _search(index: DataFrame, block: list[tuple[int | None, np.ndarray]], docs: int, total: int, top: int) -> DataFrame:
    asked = np.unique(np.concatenate([t for _, t in block]))
    weights = np.array([weight(docs, int(n)) if n else 0 for n in _frequencies(index, asked)], np.int64)
    items = [(i, np.searchsorted(asked, t)) for i, t in block]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(top) for _ in items]
        for b in batches:
            for k in range(b.num_rows):
                shard = Shard({c: b.column(c)[k] for c in ARRAYS})
                norms = length_norm(shard.sizes, docs, total)
                bound = impact(shard.most.astype(np.int64), length_norm(shard.least, docs, total))
                most = np.maximum.reduceat(bound, shard.blocks[:-1])
                at = np.minimum(np.searchsorted(shard.terms, asked), len(shard.terms) - 1)
                there = (shard.terms[at] == asked) & (weights > 0)
                for (_, t), heap in zip(items, heaps, strict=True):
                    own = t[there[t]]
                    if len(own):
                        best_in(shard, norms, at[own], weights[own], bound, most, heap)
        for (i, _), heap in zip(items, heaps, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(heap.ids), pa.int64()), pa.array(heap.ids), pa.array(heap.scores)], names=["item_id", "doc_id", "score"])

    return cut(index.select(*ARRAYS).mapInArrow(each, "item_id long, doc_id long, score long"), "lexical-heaps")


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of each item (item_id, text)."""
    spark: SparkSession = index.sparkSession
    known = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("total")).first()
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    if known.docs:
        for block in _blocks(items):
            found = found.unionByName(_search(index, block, known.docs, known.total, top))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
