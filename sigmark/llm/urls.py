"""URL rules and blocklists in one sorted digest array.

The array holds the 64-bit xxhash of every entry (``host/path``), in order, in a
file that each task memory-maps; so are the entries' strings, one after another,
where each begins, and what they say.  Spark hashes and sorts the entries; the
driver streams them into the files, without holding them.  A url's candidate
keys are its host and the host's parents, each with the prefixes of its path that
are as long as some entry's path.  All candidates of a batch are probed with one
binary search; hits are confirmed on the stored string, so digests that collide
do no harm.

Explicit rules come first: the longest that fits gives rule and verdict.  Other
urls are blocked where a listed host or page fits, else allowed.  A null url or
one without ``://`` has an empty host and path, fits nothing and is allowed.
Repeated rows get equal results; extra columns are ignored; a null page_id keeps
its row.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_published: dict[tuple[str, str], str] = {}
ALLOW, BLOCK, LISTED = b"ABL"
#: Spark's seed of xxhash64.
SEED = 42

# Hosts of adult, gambling, pharmacy, spam and tracking pages, with all their subdomains.
BAD_HOSTS = [f"{name}.example.{tld}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org")]


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host.translate(_LOWER), tail[:stop]


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def publish(spark: SparkSession, rules: list[tuple[str, str, str]], listed: list[str] | DataFrame) -> str:
    """Write the digest array and hand it to all executors; the name under which they find it.

    rules: (verdict, host, path); listed: hosts, or hosts with a path, as a list
    or as the first column of a table.  A rule goes before a listed entry.
    """
    known = spark.createDataFrame([(h + p, ALLOW if v == "allow" else BLOCK) for v, h, p in rules], "entry string, kind int")
    more = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(x,) for x in listed], "entry string")
    more = more.toDF(*["entry", *more.columns[1:]]).select(F.when(F.contains("entry", F.lit("/")), F.col("entry")).otherwise(F.concat("entry", F.lit("/"))).alias("entry"), F.lit(LISTED).alias("kind"))
    every = known.unionByName(more.where("entry is not null")).groupBy("entry").agg(F.min_by("kind", F.col("kind") == LISTED).alias("kind"))
    every = every.withColumn("h", F.xxhash64("entry"))
    mark = every.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h", "kind")).alias("x")).first()
    name, app = f"digests-{mark.n}-{(mark.x or 0) & (1 << 64) - 1:016x}", spark.sparkContext.applicationId
    if (app, name) in _published:
        return name
    folder = tempfile.mkdtemp(prefix="spark-")
    lengths: set[int] = set()
    with contextlib.ExitStack() as files:
        keys, at, kinds, text = (files.enter_context(open(os.path.join(folder, f"{name}.{x}"), "wb")) for x in ("keys", "at", "kinds", "text"))
        at.write(np.int64(0).tobytes())
        for r in every.orderBy("h", "entry").toLocalIterator():
            keys.write(np.int64(r.h).tobytes())
            kinds.write(bytes([r.kind]))
            text.write(r.entry.encode())
            at.write(np.int64(text.tell()).tobytes())
            lengths.add(len(r.entry) - r.entry.index("/"))
    np.array(sorted(lengths), np.int64).tofile(os.path.join(folder, f"{name}.lengths"))
    for part in ("keys", "at", "kinds", "text", "lengths"):
        spark.sparkContext.addFile(os.path.join(folder, f"{name}.{part}"))
    _published[app, name] = folder
    return name


class Digests:
    def __init__(self, name: str) -> None:
        read = lambda part, kind: np.memmap(path, kind, "r") if os.path.getsize(path := SparkFiles.get(f"{name}.{part}")) else np.zeros(0, kind)
        self.keys, self.at, self.kinds, self.text = read("keys", np.int64), read("at", np.int64), read("kinds", np.uint8), read("text", np.uint8)
        #: Lengths that the paths of entries have.
        self.lengths = read("lengths", np.int64).tolist()

    def entry(self, k: int) -> str:
        return self.text[self.at[k] : self.at[k + 1]].tobytes().decode()

    def candidates(self, host: str, path: str) -> list[str]:
        labels = host.split(".")
        hosts = [".".join(labels[i:]) for i in range(len(labels))]
        paths = [path[:n] for n in self.lengths if n <= len(path)] or []
        if not path and 1 in self.lengths:
            paths = ["/"]  # a bare host is its own root for listed hosts
        return [h + p for h in hosts if h for p in paths]

    def probe(self, wanted: list[str]) -> list[int | None]:
        """What each string's entry says, None if there is none."""
        if not wanted or not len(self.keys):
            return [None] * len(wanted)
        h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in wanted), np.uint64, len(wanted)).view(np.int64)
        at = np.searchsorted(self.keys, h)
        out: list[int | None] = [None] * len(wanted)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == h):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == h[i]:
                if self.entry(k) == wanted[i]:
                    out[i] = int(self.kinds[k])
                k += 1
        return out

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        parts = [split_url(u) for u in urls]
        keys = [self.candidates(h, p) if h else [] for h, p in parts]
        said = iter(self.probe([k for ks in keys for k in ks]))
        out = []
        for (host, path), ks in zip(parts, keys, strict=True):
            hits = [(len(k), k, v) for k, v in zip(ks, said) if v]
            rules = [(n, k, v) for n, k, v in hits if v in (ALLOW, BLOCK) and (path or not k.endswith("/"))]
            if rules:
                _, rule, verdict = max(rules)
                out.append((host, path, rule, "allow" if verdict == ALLOW else "block"))
            else:
                out.append((host, path, None, "block" if any(v == LISTED for _, _, v in hits) else "allow"))
        return out


@lru_cache(maxsize=4)
def _opened(name: str) -> Digests:
    return Digests(name)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: list[str] | DataFrame = BAD_HOSTS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    name = publish(pages.sparkSession, rules, listed)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _opened(name)
        for b in batches:
            cols = list(zip(*table.judge(b.column("url").to_pylist()), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, pa.string()) for c in cols)], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(each, "page_id long, host string, path string, rule string, verdict string")
