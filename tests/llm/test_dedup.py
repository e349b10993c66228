"""Near copies, repeated lines and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from sigmark.llm import line_dedup, ngram_join, setjoin, substring_dedup
from sigmark.llm import text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    before = None
    while before != least:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (len(s), least[i]) for i, s in sets.items()}


def test_near_copies(docs, rows):
    got = ngram_join.near_copies(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows)
    assert len(got) == len(rows) + 1  # the repeated row keeps its row


def test_one_of_each_keeps_columns(docs, rows):
    want = {i for i, (_, c) in components(rows).items() if i == c}
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == want


def test_near_copies_of_nothing(none):
    assert ngram_join.near_copies(none).collect() == []


def repeated_lines(rows):
    seen, out = [], set()
    for i, t, *_ in rows:
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(line.translate(LOWER)))
            if s:
                if any(100 * len(s & x) >= 75 * len(s | x) for x in seen):
                    out.add((i, k))
                seen.append(s)
    return out


def test_repeated_lines(docs, rows):
    got = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == repeated_lines(rows)


def test_lines_of_hot_words(spark):
    """Many short lines of few frequent words: keys of two and three tokens, many regions of one token."""
    import itertools

    words = [f"w{i}" for i in range(9)]
    lines = [" ".join(c) for n in (4, 5) for c in itertools.combinations(words, n)]
    rows = [(i, "\n".join(lines[i * 10 : i * 10 + 10])) for i in range(len(lines) // 10)]
    line_dedup.FREQUENT, before = 10, line_dedup.FREQUENT
    try:
        got = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        line_dedup.FREQUENT = before
    assert got == repeated_lines(rows)


def test_drop_lines(docs, rows, none):
    gone = repeated_lines(rows)
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    for i, t, *_ in rows:
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone)
        if not kept.strip() and (t or "").strip():
            assert i not in got
        else:
            assert got[i].text == (None if t is None else kept)
            if t is not None:
                assert got[i].n_chars == len(kept)
    assert line_dedup.without_repeats(none).collect() == []


def passages(rows, width=50):
    words = {r[0]: WORD.findall(r[1] or "") for r in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings(docs, rows, none):
    got = substring_dedup.digests(substring_dedup.remove_repeats(docs)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == passages(rows)
    assert substring_dedup.remove_repeats(none).collect() == []


def test_substrings_of_runs_and_shifts(spark):
    """Runs of equal words, alternations and shifted copies are the hard cases of recompression."""
    a, b = ["a"] * 70, [f"w{i % 2}" for i in range(90)]
    c = [f"c{i}" for i in range(80)]
    rows = [(0, " ".join(a)), (1, " ".join(["x"] * 3 + ["a"] * 55)), (2, " ".join(b)), (3, " ".join(["y", *b[1:61]])), (4, " ".join(c)), (5, " ".join(["z"] * 7 + c[13:63] + ["q"])), (6, " ".join(c[13:62]))]
    got = substring_dedup.digests(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == passages(rows)


def test_signature_bounds_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 30).astype(np.uint64)
        y = np.concatenate((x[:25], rng.integers(0, 1 << 63, 4).astype(np.uint64)))
        s, t = (int(setjoin.signature(v, np.array([0, len(v)]))[0]) for v in (x, y))
        assert ((s ^ t) & (1 << 64) - 1).bit_count() <= 9


def test_word_table_matches_regex():
    import pyarrow as pa

    texts = ["a\x0bb c", None, "", "é\u00a0f  g\n", " lead", "end "]
    for w in T.chunks(pa.array(texts, pa.string())):
        got = [[bytes(w.data[w.start[k] : w.end[k]]).decode() for k in range(w.of[i], w.of[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]


@pytest.mark.parametrize("wide", [False, True])
def test_regions_of_unlinked_sets_take_few_rounds(spark, monkeypatch, wide):
    """A member that many sets share which are far from each other: no pivot settles them."""
    rng = np.random.default_rng(3)
    sets = {i: np.unique(np.append(rng.integers(0, 1 << 63, 19), 7)).astype(np.uint64) for i in range(300)}
    for i in range(0, 60, 3):
        sets[300 + i] = np.unique(np.append(sets[i][:-1], np.uint64(rng.integers(0, 1 << 63))))
    rounds, plain = [], setjoin.cut
    monkeypatch.setattr(setjoin, "cut", lambda df, name: rounds.append(name) or plain(df, name))
    monkeypatch.setattr(setjoin, "BLOCK", 100, raising=False)
    first = spark.createDataFrame([(None, None, None, None, 7, i, len(s), 0, int(setjoin.signature(s, np.array([0, len(s)]))[0])) for i, s in sets.items()], "a long, an int, b long, bn int, key long, id long, n int, pos int, sig long")
    every = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "id long, members binary")
    got = {tuple(r) for r in setjoin.region_links(first, lambda ids: every.join(ids, "id", "left_semi"), (75, 100), "t", wide=wide).collect()}
    common = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in sets for b in sets if a < b}
    assert got == {(a, b) for (a, b), c in common.items() if 175 * c >= 75 * (len(sets[a]) + len(sets[b]))}
    assert len(got) == 20
    assert sum("-pairs" in x for x in rounds) <= 3


@pytest.mark.parametrize("earlier", [False, True])
def test_large_groups_are_settled_by_pivots(spark, monkeypatch, earlier):
    """A chain of near copies, each linked with its neighbours only, and a group whose members all link: whole results, few pairs."""
    rng = np.random.default_rng(4)
    fresh = lambda k: rng.integers(1 << 20, 1 << 63, k).astype(np.uint64)
    every, walk, base = {}, fresh(30), fresh(40)
    for i in range(60):
        walk = np.concatenate((walk[2:], fresh(2)))
        every[i] = np.unique(np.append(walk, np.uint64(7)))
    for i in range(60, 260):
        drop = rng.choice(40, 3, replace=False)
        every[i] = np.unique(np.concatenate((np.delete(base, drop), fresh(2), [np.uint64(7)])))
    order = rng.permutation(260).tolist()
    every = {i: every[k] for i, k in enumerate(order)}
    asked, plain = [], setjoin.verified
    monkeypatch.setattr(setjoin, "verified", lambda df: asked.append(df) or plain(df))
    monkeypatch.setattr(setjoin, "BLOCK", 100)
    first = spark.createDataFrame([(None, None, None, None, 7, i, len(x), 0, int(setjoin.signature(x, np.array([0, len(x)]))[0])) for i, x in every.items()], "a long, an int, b long, bn int, key long, id long, n int, pos int, sig long")
    members = spark.createDataFrame([(i, x.tobytes()) for i, x in every.items()], "id long, members binary")
    got = setjoin.region_links(first, lambda ids: members.join(ids, "id", "left_semi"), (75, 100), "t", wide=True, earlier=earlier)
    true = {(a, b) for a in every for b in every if a < b and 175 * len(np.intersect1d(every[a], every[b])) >= 75 * (len(every[a]) + len(every[b]))}
    found = {tuple(r) for r in got.collect()}
    assert found <= true
    assert len(found) < len(true) / 2
    if earlier:
        assert {b for _, b in found} == {b for _, b in true}
    else:
        least = setjoin.components(got, "t").collect()
        edges = spark.createDataFrame(sorted(true), "a long, b long")
        assert sorted(map(tuple, least)) == sorted(map(tuple, setjoin.components(edges, "t").collect()))


def thue_morse(n, one="a", two="b"):
    return "".join(one if i.bit_count() % 2 == 0 else two for i in range(n))


def test_words_of_like_structure_differ(spark):
    """Words and sequences on which polynomial hashes modulo 2**64 agree."""
    import pyarrow as pa

    words = [f(n) for n in (32, 1024, 2048, 4096) for f in (thue_morse, lambda n: thue_morse(n, "b", "a"))]
    (w,) = T.chunks(pa.array([" ".join(words)]), limit=1 << 20)
    assert len(set(w.hashes().tolist())) == len(words)
    for k in (5, 32, 50):
        runs = [thue_morse(64).replace("a", "a ").replace("b", "b ")[: 2 * k], thue_morse(64, "b", "a").replace("a", "a ").replace("b", "b ")[: 2 * k]]
        hashes = [T.windows(next(T.chunks(pa.array([r]))).hashes(), k)[0] for r in runs]
        assert hashes[0] != hashes[1]
    docs = spark.createDataFrame([(k, " ".join(f(1024 + i) for i in range(60))) for k, f in enumerate((thue_morse, lambda n: thue_morse(n, "b", "a")))], "doc_id long, text string")
    assert line_dedup.repeated_lines(docs).count() == 0
    assert {r.component_id for r in ngram_join.near_copies(docs).collect()} == {0, 1}
    assert {r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {0}


def test_hot_entries_are_dealt_by_set(spark, docs, rows, monkeypatch):
    """Members that the counts know as hot go on as rows, with the same links."""
    monkeypatch.setattr(setjoin, "HOT", 1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(docs).collect()} == components(rows)
    assert {(r.doc_id, r.line) for r in line_dedup.repeated_lines(docs).collect()} == repeated_lines(rows)


def test_windows_with_equal_words_pick_equal_names():
    """Whatever stands around them, with runs and alternations of few words."""
    import random

    import pyarrow as pa

    rng = random.Random(3)

    def words(n, size):
        out = []
        while len(out) < n:
            out += [f"w{rng.randrange(size)}"] * (rng.choice([2, 3, 20, 60]) if rng.random() < 0.1 else 1)
        return out[:n]

    for size in (1, 2, 3, 5, 50, 5000) * 10:
        window = words(50, size)
        docs = [" ".join(words(rng.randrange(40), size) + window + words(rng.randrange(40), size)) for _ in range(3)]
        (w,), (own,) = T.chunks(pa.array(docs)), T.chunks(pa.array([" ".join(window)]))
        starts, names = substring_dedup.picks(w.hashes(), w.doc(), w.of)
        here = T.windows(w.hashes(), 50)[starts] == T.windows(own.hashes(), 50)[0]
        assert here.sum() >= 3
        assert len(set(names[here].tolist())) == 1
