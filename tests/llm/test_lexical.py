"""Lexical search against brute force over all documents, and its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sigmark.llm import lexical
from sigmark.llm.queries import QUERIES, SQL
from tests.conftest import DATA

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def best(docs: list[tuple], items: list[tuple], top: int = 50) -> list[tuple]:
    own = [(d, c) for d, t in docs if d is not None and (c := Counter(terms(t)))]
    total = sum(c.total() for _, c in own)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in asked.items():
        scores = Counter()
        for t in words:
            if df := sum(t in c for _, c in own):
                w = math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df + 1)))
                for k, (_, c) in enumerate(own):
                    if t in c:
                        scores[k] += w * (1000000000 * c[t] // (1000 * c[t] + 20 * (100 - 50 + 50 * c.total() * len(own) // total)))
        ranked = sorted((-s, own[k][0]) for k, s in scores.items() if s > 0)[:top]
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(ranked)]
    return sorted(out, key=str)


def corpus(seed: int, n: int) -> tuple[list, list]:
    """Documents of a skewed vocabulary with many ties, and items of rare and frequent terms."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 3000}"
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(int(5 * rng.paretovariate(0.9)) % 2000))) for k in range(n)]
    docs += [(n + k, docs[7][1]) for k in range(150)] + [(2 * n, "Ünder ünder ÜNDER"), (2 * n + 1, None), (2 * n + 2, "?! --"), (None, "w1 w2"), (3, docs[3][1])]
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 40, 300])))) for k in range(40)]
    return docs, items + [(40, docs[7][1]), (41, None), (42, "neverseen"), (43, "W1,w2;w1 ünder"), (None, "w5 w6"), (43, "w3")]


@pytest.mark.parametrize(("seed", "shard"), [(1, 1 << 21), (2, 20_000), (3, 1000)])
def test_search(spark, monkeypatch, seed, shard):
    """One shard, some, and many: thresholds carry over, and lists of many blocks are skipped."""
    docs, items = corpus(seed, 1500)
    monkeypatch.setattr(lexical, "SHARD", shard)
    every = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as ids").repartition(2)
    got = lexical.search(lexical.index(every), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as rank"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == best(docs, items)


def test_items_in_blocks(spark, monkeypatch):
    docs, items = corpus(4, 300)
    monkeypatch.setattr(lexical, "ASKED", 200)
    got = lexical.search(lexical.index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"), 7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == best(docs, items, 7)


def test_empty(spark, none, docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(lexical.index(none), items).collect() == []
    assert lexical.search(lexical.index(docs), items.limit(0)).collect() == []


def test_awkward(spark, docs, rows):
    items = [(k, r[1]) for k, r in enumerate(rows)]
    got = lexical.search(lexical.index(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == best([(r[0], r[1]) for r in [*rows, rows[6]]], items)


def test_blocks_are_skipped(monkeypatch):
    """Blocks of frequent terms stay packed once the heap is full."""
    rng = np.random.default_rng(1)
    sizes = np.full(40_000, 3)
    hashes = np.stack([np.full(40_000, 1), rng.integers(2, 4, 40_000), np.arange(40_000) // 8 + 10], 1).reshape(-1).astype(np.uint64)
    batch = lexical.pack(np.arange(40_000), sizes, hashes)
    shard = lexical.Shard({c: batch.column(c)[0] for c in lexical.ARRAYS})
    of, doc, tf = shard.unpack(np.arange(shard.blocks[1]))
    assert (doc == np.arange(40_000)).all() and (tf == 1).all() and of[-1] == shard.blocks[1] - 1
    norms, bound = lexical.length_norm(shard.sizes, 40_000, 120_000), lexical.impact(shard.most.astype(np.int64), lexical.length_norm(shard.least, 40_000, 120_000))
    most, heap, seen, unpack = np.maximum.reduceat(bound, shard.blocks[:-1]), lexical.Heap(5), [], lexical.Shard.unpack
    monkeypatch.setattr(lexical.Shard, "unpack", lambda self, b: seen.append(len(b)) or unpack(self, b))
    for _ in range(2):
        seen.clear()
        lexical.best_in(shard, norms, np.array([0, 1, 3]), np.array([5, 700, 9000]), bound, most, heap)
    assert sum(seen) < 10 < shard.blocks[1] and heap.scores.shape == (5,)


def test_long_text(spark):
    """A document of more terms than a shard, and frequencies of four bytes."""
    docs = [(1, "a b " * 70_000 + "c"), (2, "a " * 300 + "c"), (3, "c d")]
    got = lexical.search(lexical.index(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame([(1, "a c"), (2, "d b")], "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == best(docs, [(1, "a c"), (2, "d b")])


def test_norm_beyond_64_bits():
    n = np.array([1, 10**9])
    assert lexical.length_norm(n, 10**9, 10**12).tolist() == [50 + 50 * int(x) * 10**9 // 10**12 for x in n]
    assert lexical.length_norm(n, 10**10, 10**13).tolist() == [50 + 50 * int(x) * 10**10 // 10**13 for x in n]


def test_shards_keep_all(spark):
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7]), pa.array(["x y x", None, "..."])], names=["doc_id", "text"])
    made = list(lexical._shards(iter([batch])))
    assert [(b.column("n_docs")[0].as_py(), b.column("n_terms")[0].as_py()) for b in made] == [(1, 3)]


def test_registered(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = QUERIES["op11_lexical_search"](spark, DATA).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select item_id, rank, doc_id, score from ({SQL['op11_lexical_search']})").fetchall())
