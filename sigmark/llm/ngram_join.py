"""Near copies by the exact Jaccard join of 5-word shingle sets, as a metric-space join.

The pivots of the first split are the shingles themselves, as one-member sets,
ranked by rarity: a document belongs to the Voronoi region of its first one and,
since a partner may lack a quarter of its shingles, its window takes in the
regions of the next quarter.  Regions are split by document pivots and windows
of the triangle inequality on Jaccard distance, again and again until settled
(``setjoin``).  Random document pivots can't make the first split, because
unrelated texts are all at distance 1 of one another.

A-Z count as a-z.  Null or empty text, or one without words, has an empty set
and is linked with nothing; one to four words make one shingle.  Documents with
equal sets are one class, which the join knows by its least doc_id.  Repeated
rows of one doc_id count as one document, and each gets the result's row.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from . import text as T
from .cut import cut, small
from .text import U

SHINGLE, SIMILAR = 5, (75, 100)


def _sets(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[T.Words, np.ndarray, np.ndarray]]:
    for w in T.chunks(batch.column(text), lower=True):
        yield (w, *T.shingle_sets(w, SHINGLE))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set size and set hash, and the counts of shingles that the task has seen."""
    counts = setjoin.Counts()
    for b in batches:
        n, names = [], []
        for _, at, members in _sets(b):
            counts.add(members)
            n += np.diff(at).tolist()
            names += [T.set_hash(members[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=["id", "n", "name", "part", "counts"])
    rows = counts.rows()
    k = len(rows["part"])
    yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(rows["part"], pa.int32()), pa.array(rows["counts"], pa.binary())], names=["id", "n", "name", "part", "counts"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w, at, members in _sets(b):
            ids = b.column("id").slice(w.first, len(at) - 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array([members[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["id", "members"])


def near_copies(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: documents that link, directly or through others, share it."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    seen = cut(docs.mapInArrow(_classes, "id long, n long, name binary, part int, counts binary"), "shingle-sizes")
    counts = setjoin.summed(seen.where("part is not null").select("part", "counts"))
    order, common = setjoin.ranks(counts), counts > max(setjoin.HOT, 8 * int(np.median(counts)))
    sizes = seen.where("part is null").select("id", "n", "name")
    buckets = max(16, int(sizes.agg(F.sum(F.expr("n div 4 + 1"))).first()[0] or 0) // setjoin.ENTRIES)
    same = sizes.where("n > 0").groupBy("name").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    alike = cut(sizes.where("n > 0").join(same.where("rep < last"), "name").where("id > rep").select("id", "rep").distinct(), "shingle-copies")

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column("id"))
            for w, at, members in _sets(b):
                heads = [setjoin.prefix(members[x:y], order, similar) for x, y in zip(at[:-1], at[1:], strict=True)]
                k = np.array([len(x) for x in heads], np.int64)
                if k.sum():
                    key = np.concatenate(heads)
                    pos = np.arange(len(key)) - np.repeat(np.cumsum(k) - k, k)
                    hot = common[(key & U(setjoin.BUCKETS - 1)).astype(np.int64)]
                    yield setjoin.entries(ids[w.first : w.first + len(k)], np.diff(at), setjoin.signature(members, at), np.repeat(np.arange(len(k)), k), key, pos, hot, buckets)

    own = setjoin.without(docs.withColumnRenamed("doc_id", "id"), alike.select("id"))
    first = cut(setjoin.first_split(own.mapInArrow(regions, setjoin.PACKED), np.dtype(np.int64), "long", similar, setjoin.FEW), "shingle-regions")
    sets_of = lambda ids: docs.withColumnRenamed("doc_id", "id").join(small(ids), "id", "left_semi").mapInArrow(_members, "id long, members binary")
    links = cut(setjoin.region_links(first, sets_of, similar, "shingle", wide=True), "shingle-links")
    least = setjoin.components(links, "shingle") if links.limit(1).count() else links.select(F.col("a").alias("id"), F.col("b").alias("least"))
    known = sizes.select("id", "n").join(alike, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    return known.join(least.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "rep").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are the least doc_id of their component, with all their columns."""
    lead = near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(lead, "doc_id", "left_anti")
