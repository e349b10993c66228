"""Quality rules, language id, decontamination and packing."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigmark.llm import decontam, langid, packing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def measured(t):
    t = t or ""
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    twice = {k for i, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice)


def test_measurements(docs, rows, none):
    got = quality.apply_policy(quality.ledger(docs)).collect()
    for r in got:
        want = measured(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert len(got) == len(rows) + 1
    assert quality.ledger(none).collect() == []


def test_policies_and_ablation(docs):
    led = quality.ledger(docs).cache()
    rows = led.collect()
    for r in quality.ablation(led, "v2").collect():
        bit = 1 << [n for n, _ in quality.RULES].index(r.rule)
        assert r.failed == sum(bool(x.failed & bit) for x in rows)
        assert r.only == sum(x.failed & quality.POLICIES["v2"] == bit for x in rows)
    assert quality.keep_good(docs).columns == docs.columns


def test_language_profiles(spark):
    rng = random.Random(2)
    make = {"aa": ["kala", "maku", "tali"], "bb": ["schön", "grün", "weiß"]}
    rows = [(i, " ".join(rng.choice(make[x]) for _ in range(40)), x) for i, x in enumerate(["aa", "bb"] * 20)]
    rows += [(100, None, "aa"), (101, "12 34 !", "bb"), (102, "", None), (103, "kala maku", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.col("doc_id") % 4 == 2)
    got = {r.doc_id: r for r in langid.identify(d, langid.learn(d.where("not held_out"))).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[:40])
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.learn(d.where("false"))
    assert {r.lang_pred for r in langid.identify(d, nothing).collect()} == {"und"}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(500):
        a, b, m = [rng.randrange(4) for _ in range(rng.randrange(12))], [rng.randrange(4) for _ in range(rng.randrange(12))], rng.randrange(8)
        assert decontam.distance(np.array(a, int), np.array(b, int), m) == min(lev(a, b), m + 1)


def test_decontamination(spark, docs, none):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randrange(20, 40)))) for i in range(30)] + [(90, None), (91, "")]
    texts, want = [], set()
    for i, t in items[:30]:
        w = t.split()
        edits = rng.randrange(0, len(w) // 8 + 1)
        for k in rng.sample(range(len(w)), edits):
            w[k] = word()
        texts.append((1000 + i, " ".join([word() for _ in range(30)] + [x.capitalize() + "," for x in w] + [word() for _ in range(30)])))
        want.add((1000 + i, i))
    texts += [(2000 + k, " ".join(word() for _ in range(200))) for k in range(20)] + [(3000, None), (3001, "")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert got == want
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b, block=7).collect()} == want
    assert {r.doc_id for r in decontam.clean(d, b).collect()} == {i for i, _ in texts} - {i for i, _ in want}
    assert decontam.contaminated(none, b).collect() == []
    assert decontam.clean(docs, b.where("false")).count() == docs.count()


def edited(rng, item, kind, new):
    """The item with n // 4 edits of one kind."""
    x, e = list(item), len(item) // 4
    if kind in ("front", "middle", "back"):
        a = {"front": 0, "middle": (len(x) - e) // 2, "back": len(x) - e}[kind]
        x[a : a + e] = [new() for _ in range(e)]
    for _ in range(e if kind in ("changed", "left out", "put in", "mixed") else 0):
        k, what = rng.randrange(len(x)), kind if kind != "mixed" else rng.choice(["changed", "left out", "put in"])
        x[k : k + (what != "put in")] = [] if what == "left out" else [new()]
    return x[e:] if kind == "cut in front" else x[: len(x) - e] if kind == "cut behind" else x


@pytest.mark.parametrize("n", [8, 12, 15, 24, 25, 33, 40, 63, 120, 200])
def test_recall_at_the_whole_budget(n):
    """Against every item that brute force finds, for edits of each kind and place, as many as are allowed."""
    rng = random.Random(n)
    new = lambda: f"n{rng.randrange(10**9)}"
    items = [[f"v{rng.randrange(3000)}" for _ in range(n)] for _ in range(40)]
    known = decontam.Items([(i, " ".join(x)) for i, x in enumerate(items)])
    for kind in ("front", "middle", "back", "changed", "left out", "put in", "mixed", "cut in front", "cut behind"):
        docs = [" ".join([new() for _ in range(20)] + edited(rng, x, kind, new) + [new() for _ in range(20)]) for x in items]
        got = set()
        for w in decontam.split(pa.array(docs)):
            for d, i, _, _, edits in known.search(w.hashes(), w.of):
                assert edits <= n // 4
                got.add((w.first + d, i))
        assert sum((i, i) in got for i in range(40)) >= 37, kind


def test_best_fit_is_tight():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 700, 3000)
    bins, offset, fill = packing.best_fit(n, 2048)
    assert fill.max() <= 2048 and fill.sum() == n.sum() and len(fill) <= -(-n.sum() // 2048) + 1
    for b in range(len(fill)):
        at = 0
        for i in sorted(np.flatnonzero(bins == b), key=lambda i: offset[i]):
            assert offset[i] == at
            at += n[i]


def test_packing_round_trip(docs, rows, none):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(TOKENIZER)
    slow.encode_special_tokens = True
    got = packing.pack(docs.repartition(6), TOKENIZER, with_ids=True).collect()
    pieces, bins = defaultdict(dict), defaultdict(list)
    for r in got:
        pieces[r.doc_id].setdefault(r.piece, []).append(r)
        bins[r.sequence_id].append(r)
    for i, t, *_ in rows:
        ids = slow.encode(t or "", add_special_tokens=False).ids + [0]
        assert [x for k in sorted(pieces[i]) for x in np.frombuffer(pieces[i][k][0].ids, "<u4")] == ids
        assert all(p.length == 2048 for k, ps in pieces[i].items() for p in ps if k)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(pieces[6][0]) == 2  # a repeated row is packed twice
    assert packing.pack(none, TOKENIZER).collect() == []


@pytest.mark.parametrize("text", ["a  b", "don't  stop\n\n x", "é ñ\u3000中文", "<|endoftext|>", "  ", "1234 5!?\t"])
def test_encoder_equals_tokenizers(text):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(TOKENIZER)
    slow.encode_special_tokens = True
    assert packing.encoder(TOKENIZER)(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_pair_filter_is_needed_only_above_one_word():
    found = decontam.Items([(1, "solo"), (2, None)])
    w = next(iter(decontam.split(pa.array(["we saw Solo."]))))
    assert [x[1] for x in found.search(w.hashes(), w.of)] == [1]


def held(pairs):
    """Edits by (document, item) that the search finds, documents and items as lists of numbers."""
    docs, items = zip(*pairs, strict=True)
    text = lambda x: " ".join(f"w{k}" for k in x)
    found = decontam.Items([(i, text(x)) for i, x in enumerate(items)])
    return {(w.first + r[0], r[1]): r[4] for w in decontam.split(pa.array([text(x) for x in docs])) for r in found.search(w.hashes(), w.of)}


@pytest.mark.parametrize("n", [4, 7, 8, 15, 16, 20, 25, 31, 40, 63, 64, 130])
def test_edited_words_are_found_wherever_they_are(n):
    rng = random.Random(n)
    most, pairs = n // 4, []
    for place in ("head", "middle", "tail", "spread") * 5:
        item = [rng.randrange(10**6) for _ in range(n)]
        at = {"head": range(most), "middle": range((n - most) // 2, (n - most) // 2 + most), "tail": range(n - most, n), "spread": rng.sample(range(n), most)}[place]
        doc = [x + 10**6 if k in at else x for k, x in enumerate(item)]
        pairs.append(([rng.randrange(10**6) for _ in range(9)] + doc + [rng.randrange(10**6) for _ in range(9)], item))
    got = held(pairs)
    assert set(got) == {(i, i) for i in range(len(pairs))}
    assert all(d <= most for d in got.values())


@pytest.mark.parametrize(("n", "k"), [(4, 1), (15, 2), (15, 3), (20, 3), (31, 4), (59, 8), (130, 32)])
@pytest.mark.parametrize("more", [False, True])
def test_dropped_and_added_words_cost_one_edit_each(n, k, more):
    rng = random.Random(n)
    item = [rng.randrange(10**6) for _ in range(n)]
    at = set(rng.sample(range(1, n - 1), k) if n > k + 2 else range(1, 1 + k))
    doc = [y for i, x in enumerate(item) for y in ([x + 10**6, x] if more and i in at else [x] if more or i not in at else [])]
    around = [rng.randrange(10**6) for _ in range(9)]
    assert held([(doc, item)]) == {(0, 0): k}
    assert held([(around + doc + around, item)]) == {(0, 0): k}


def test_search_equals_all_runs():
    rng = random.Random(8)
    for _ in range(400):
        n, vocab = rng.randrange(1, 17), rng.choice([3, 6, 30])
        item = [rng.randrange(vocab) for _ in range(n)]
        doc = [rng.randrange(vocab) for _ in range(rng.randrange(1, 30))]
        if rng.random() < 0.7:
            doc[(p := rng.randrange(len(doc))) : p] = [x for x in item if rng.random() < 0.9]
        near = min(lev(item, doc[p:q]) for p in range(len(doc)) for q in range(p + 1, len(doc) + 1))
        assert held([(doc, item)]) == ({(0, 0): near} if near <= n // 4 else {})
