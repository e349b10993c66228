"""SimHash near copies against brute force over all pairs of fingerprints."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sigmark.llm import setjoin, simhash
from sigmark.llm.queries import QUERIES
from tests.conftest import DATA

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(t: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    ones = [0] * 64
    for x in runs:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(runs))


def roots(prints: set[int], radius: int = 2) -> dict[int, int]:
    above = {x: x for x in prints}

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    every = sorted(prints)
    for i, x in enumerate(every):
        for y in every[:i]:
            if (x ^ y).bit_count() <= radius:
                p, q = sorted((find(x), find(y)))
                above[q] = p
    return {x: find(x) for x in prints}


def expected(rows: list[tuple]) -> list[tuple]:
    prints = [(d, fingerprint(t)) for d, t in rows]
    root = roots({x for _, x in prints})
    least: dict[int, int] = {}
    for d, x in prints:
        if d is not None:
            least[root[x]] = min(d, least.get(root[x], d))
    return sorted(((d, f"{x:016x}", least.get(root[x])) for d, x in prints), key=str)


def test_awkward(spark, docs, rows):
    every = [*rows, rows[6], (None, rows[6][1]), (None, "nothing else says this")]
    extra = docs.unionByName(spark.createDataFrame([(None, t, None, None, None, None, None) for _, t in every[-2:]], docs.schema))
    got = sorted((tuple(r) for r in simhash.near_copies(extra).collect()), key=str)
    assert got == expected([(r[0], r[1]) for r in every])


def test_empty(spark, none):
    assert simhash.near_copies(none).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_links(spark, seed):
    """Dense groups around few values, chains, lone pairs and noise: components equal those of all pairs."""
    rng = random.Random(seed)
    prints = {0, (1 << 64) - 1}
    for spread in (1, 2, 3, 5):
        middle = rng.getrandbits(64)
        bits = rng.sample(range(64), 14)
        prints |= {middle ^ sum(1 << b for b in rng.sample(bits, rng.randrange(spread + 1))) for _ in range(150)}
        x = middle ^ rng.getrandbits(64)
        for _ in range(20):
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(x)
        prints |= {x := rng.getrandbits(64), x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)}
    signed = lambda x: x - (1 << 64) * (x >> 63)
    nodes = spark.createDataFrame([(signed(x),) for x in prints], "fp long").repartition(5)
    found = simhash.links(nodes)
    assert not found.where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2) | (F.col("a") >= F.col("b"))).count()
    label = {r.id: r.least for r in setjoin.components(found, "test").collect()}
    want = roots(prints)
    by: dict[int, set] = {}
    for x in prints:
        by.setdefault(want[x], set()).add(signed(x))
    for group in by.values():
        assert {label.get(x, x) for x in group} == {min(group)}


def test_long_text(spark):
    """One document of many chunks, and words of many bytes."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(150_000))
    rows = [(1, long), (2, "é" * 300 + " \x0b ß\n" + "日本" * 40), (3, "A  b\r\nC"), (4, "a B c")]
    got = sorted(tuple(r) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == expected(rows)


def test_registered(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_simhash_near_dedup"](spark, DATA).collect()), key=str) == expected(rows)
