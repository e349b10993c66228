"""Near copies by SimHash fingerprints, found with multi-index hashing.

A fingerprint has 64 bits, in two segments of 32.  Of two fingerprints at most
two bits apart, either the first segments differ in at most one bit or the
second segments are the same, so the first index is asked for the Hamming ball
of radius 1 around a segment and the second for the segment itself.  Of two
first segments that differ in one bit one has that bit set, so only bits that
are set are flipped, and each pair is met once.

* Documents with one fingerprint are one node, so exact copies leave the
  mapper as one row.
* A bucket is a segment's value with the fingerprints that ask for it.  Buckets
  are counted before anything is sent: those of one fingerprint end there, and
  those of two are their least and greatest fingerprint.
* Larger buckets are split by the ball in the other segment, within what is left
  of the radius.  All that meet there are within one bit of one 64-bit value, so
  at most 65 fingerprints meet, whatever the bucket held, and each is linked
  with the least of them.
* Every link is verified by the whole distance.  Components come from rounds
  that halve the paths.

A-Z count as a-z.  Null or empty text, or one without words, has the
fingerprint zero, which links like any other; one or two words make one
shingle.  Repeated rows get a row each; a row without doc_id gets the component
of its fingerprint, which is null if no row in it has a doc_id.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setjoin
from . import text as T
from .cut import cut, release, small
from .text import U

#: Words of a shingle, seed of its hash, bits by which linked fingerprints may differ.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Bits of a segment.
SEGMENT = 32
#: Shingles whose bits are counted at a time.
ROWS = 1 << 16


def shingle_hashes(words: T.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each run of k words, joined by one space: the hashes, and the bounds of each document's.

    A document of one to k-1 words has its whole sequence as its one shingle.
    """
    size = words.end - words.start
    # the words once more with one blank after each
    begin = np.cumsum(size + 1) - size - 1
    joined = np.full(int(begin[-1] + size[-1] + 1) if len(size) else 0, 32, np.uint8)
    of, at = T.spread(words.start, words.end)
    joined[at - words.start[of] + begin[of]] = words.data[at]
    n = np.diff(words.of)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc, first = T.spread(words.of[:-1], words.of[:-1] + count)
    last = first + np.minimum(n[doc], k) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin[first].tolist(), (begin[last] + size[last]).tolist(), strict=True)), U, len(first))
    return h, np.concatenate(([0], np.cumsum(count)))


def majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits set in over half the hashes of each document, whose bounds are at."""
    ones = np.zeros((len(at) - 1, 64), np.int64)
    for a in range(0, len(h), ROWS):
        b = min(len(h), a + ROWS)
        bits = np.unpackbits(h[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        lo, hi = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b, "left")
        heads = np.clip(at[lo:hi], a, b) - a
        some = np.flatnonzero(np.diff(np.append(heads, b - a)))
        ones[lo + some] += np.add.reduceat(bits, heads[some], axis=0, dtype=np.int32)
    return np.packbits(2 * ones > np.diff(at)[:, None], axis=1).view(">u8").reshape(-1).astype(U)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in T.chunks(b.column("text"), lower=True):
            fp = majority(*shingle_hashes(w))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(w.first, len(fp)), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints, "doc_id long, fp long")


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << SEGMENT) - 1))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, SEGMENT)


def _flip(x: Column, k: Column) -> Column:
    return x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))


def _ball(x: Column) -> Column:
    """The values of a segment at most one bit from x."""
    return F.concat(F.array(x), F.transform(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), lambda k: _flip(x, k)))


def probes(nodes: DataFrame) -> DataFrame:
    """(segment, key, left, fp): the buckets that each fingerprint asks for, and the bits that the rest of it may still differ by."""
    high, low = _high(F.col("fp")), _low(F.col("fp"))
    bits = F.sequence(F.lit(0), F.lit(SEGMENT - 1))
    cleared = F.transform(F.filter(bits, lambda k: F.call_function("shiftrightunsigned", high, k).bitwiseAND(F.lit(1)) == 1), lambda k: _flip(high, k))
    row = lambda segment, key, left: F.struct(F.lit(segment).alias("segment"), key.alias("key"), F.lit(left).alias("left"))
    asked = F.concat(F.array(row(0, high, 1), row(1, low, 1)), F.transform(cleared, lambda v: row(0, v, 0)))
    return nodes.select("fp", F.explode(asked).alias("p")).select("p.*", "fp")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b), a before b: enough of the pairs of distinct fingerprints within the radius to connect whatever they connect."""
    asked = probes(nodes)
    counted = cut(asked.groupBy("segment", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "simhash-buckets")
    pairs = counted.where("n = 2").select("a", "b")
    large = asked.join(small(counted.where("n > 2").select("segment", "key")), ["segment", "key"])
    other = F.when(F.col("segment") == 0, _low(F.col("fp"))).otherwise(_high(F.col("fp")))
    split = large.withColumn("near", F.explode(F.when(F.col("left") == 1, _ball(other)).otherwise(F.array(other))))
    # no more than 65 fingerprints are within one bit of a value
    met = split.groupBy("segment", "key", "near").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    return pairs.unionByName(stars).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row: rows whose fingerprints link, directly or through others, share it."""
    rows = cut(fingerprints(docs), "simhash-prints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    found = cut(links(nodes.select("fp")), "simhash-links")
    label = setjoin.components(found, "simhash") if found.limit(1).count() else found.select(F.col("a").alias("id"), F.col("b").alias("least"))
    named = nodes.join(label.withColumnsRenamed({"id": "fp", "least": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = cut(named.join(roots, "root").select("fp", "component_id"), "simhash-components")
    release(found, label)
    return rows.join(small(known), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
