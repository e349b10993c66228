"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased; runs of non-letters become one space; its n-grams of one
to three characters are counted.  A language's profile is the ranked list of the
most frequent n-grams of its training documents.  A text goes to the language
with the least out-of-place distance: for each of the text's own most frequent
n-grams, how far its rank is from the rank in the profile, or the most possible
where the profile lacks it.  The whole text is counted.

Null text, or one without a letter, is ``und`` with score 0; so is every text
when nothing can be learned.  Ties go to the first language in order.  Each row
is judged alone, so repeated rows get equal results.  Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: n-grams of a profile; training documents a language at most, those with the least hash of their id.
RANKS, SAMPLE = 300, 500
SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """At each code point 2 for letters, 1 for the marks within words, else 0."""
    return np.array(["-ML".find(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.int8).clip(0)


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of non-letters as one space, with a space at either end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kind = _letters()[c]
    c = np.where(kind > 0, c, SPACE) if (kind == 2).any() else c[:0]
    c = np.concatenate(([SPACE], c, [SPACE]))
    keep = np.append(True, (c[1:] != SPACE) | (c[:-1] != SPACE))
    return c[keep].astype(np.uint64)


def ngrams(c: np.ndarray) -> np.ndarray:
    """All n-grams as numbers: 21 bits a character."""
    s = np.uint64(21)
    two = c[:-1] << s | c[1:]
    return np.concatenate((c, two, two[:-1] << s | c[2:]))


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order and their counts; none if there is no letter."""
    c = symbols(text or "")
    if len(c) <= 2:
        return c[:0], np.zeros(0, np.int64)
    g = np.sort(ngrams(c))
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    g, n = g[at], np.diff(np.append(at, len(g)))
    words = g != SPACE
    return g[words], n[words]


def top(g: np.ndarray, n: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent n-grams, ties in order of the n-gram."""
    if len(n) > ranks:  # only those that can be among them
        least = np.partition(n, len(n) - ranks)[len(n) - ranks]
        g, n = g[n >= least], n[n >= least]
    return g[np.argsort(-n, kind="stable")[:ranks]]


@dataclass
class Profiles:
    langs: list[str]
    grams: np.ndarray
    #: rank of each gram in each language; ranks where the language lacks it.
    place: np.ndarray
    ranks: int

    def judge(self, text: str | None) -> tuple[str, float]:
        g, n = counted(text)
        if not len(g) or not self.langs:
            return "und", 0.0
        t = top(g, n, self.ranks)
        at = np.minimum(np.searchsorted(self.grams, t), len(self.grams) - 1)
        known = self.grams[at] == t
        off = np.where(known, self.place[:, at], self.ranks)
        far = np.where(off >= self.ranks, self.ranks, np.abs(off - np.arange(len(t)))).sum(1)
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - float(far[best]) / (self.ranks * len(t))


def learn(train: DataFrame, ranks: int = RANKS, sample: int = SAMPLE) -> Profiles:
    """Profiles from (doc_id, text, lang); counting is a Spark job, ranks n-grams a language reach the driver."""
    known = train.where("lang is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # a share of each language's documents that holds its sample, so that no task gets all of a language
    size = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.col("h").cast("double") / 2.0**64 + 0.5
    chosen = known.join(F.broadcast(size), "lang").where(share * F.col("n") <= sample + 6 * sample**0.5 + 20).drop("n")
    chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= sample).select("doc_id", "lang")
    texts = train.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, gram, n = [], [], []
            for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                g, k = counted(t)
                lang += [x] * len(g)
                gram.append(g)
                n.append(k)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "gram": pa.array(np.concatenate(gram).view(np.int64) if gram else [], pa.int64()), "n": pa.array(np.concatenate(n) if n else [], pa.int64())})

    sums = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = sums.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= ranks)
    rows = first.select("lang", "gram", "r").collect()
    langs = sorted({r.lang for r in rows})
    grams = np.array(sorted({r.gram for r in rows}), np.uint64)
    place = np.full((len(langs), len(grams)), ranks, np.int64)
    for r in rows:
        place[langs.index(r.lang), np.searchsorted(grams, np.uint64(r.gram))] = r.r - 1
    return Profiles(langs, grams, place, ranks)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out as given, lang_pred and score."""
    known = docs.sparkSession.sparkContext.broadcast(profiles)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [known.value.judge(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(each, "doc_id long, held_out boolean, lang_pred string, score double")
