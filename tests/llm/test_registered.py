"""Every registered opN_ query on the smallest tables, against brute force or held-out truth."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sigmark.llm import decontam, html, packing, urls
from sigmark.llm.queries import QUERIES, SQL, URL_RULES
from tests.conftest import DATA

from .test_dedup import components, passages, repeated_lines
from .test_pages import plain


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def held(documents, items) -> set[tuple[int, int]]:
    """Every (document, item) of which some run of words is within the budget, by whole edit-distance tables."""
    words = lambda t: [h for w in decontam.split(pa.array([t], pa.string())) for h in w.hashes().tolist()]
    known = [(i, np.array(words(t), np.uint64)) for i, t in items if t and words(t)]
    out = set()
    for d, t in documents:
        text = np.array(words(t), np.uint64)
        for i, item in known:
            if len(text) and decontam.nearest(item, text, decontam.budget(len(item))) is not None:
                out.add((d, i))
    return out


def test_op1(spark, documents):
    got = QUERIES["op1_language_id"](spark, DATA).collect()
    assert len(got) == len(documents)
    right = tried = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        lang = documents[r.doc_id].lang
        if r.held_out and lang:
            tried, right = tried + 1, right + (r.lang_pred == lang)
    assert right >= 0.95 * tried > 0


def test_op2(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = QUERIES["op2_quality_rules"](spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {', '.join(got.columns)} from ({SQL['op2_quality_rules']})").fetchall())


def test_op3(spark, documents):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op3_decontamination"](spark, DATA).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = held([(d, r.text) for d, r in documents.items()], items)
    assert got <= want and len(got) >= 0.97 * len(want) > 0


def test_op4(spark, documents):
    got = QUERIES["op4_best_fit_packing"](spark, DATA).collect()
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    total = sum(len(encode(r.text or "")) + 1 for r in documents.values())
    assert sum(r.length for r in got) == total
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(bins) <= -(-total // 2048) + 1
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048


def test_op5(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_ngram_jaccard_join"](spark, DATA).collect()}
    assert got == components([(d, r.text) for d, r in documents.items()])


def test_op6(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in QUERIES["op6_url_filters"](spark, DATA).collect():
        assert tuple(r)[1:] == plain(pages.pop(r.page_id), URL_RULES, urls.BAD_HOSTS)
    assert not pages


def test_op7(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = QUERIES["op7_html_extraction"](spark, DATA).collect()
    right = [r.text == "\n\n".join(b.text for b in html.blocks(pages[r.page_id].html) if html.looks_main(b.path)) and r.n_chars == len(r.text) for r in got]
    assert len(got) == len(pages) and sum(right) >= 0.98 * len(right)


def test_op8(spark, documents):
    rows = sorted((d, r.text) for d, r in documents.items())
    gone = repeated_lines(rows)
    got = {r.doc_id: r for r in QUERIES["op8_line_dedup"](spark, DATA).collect()}
    for d, t in rows:
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone)
        assert got[d].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert got[d].n_exact + got[d].n_near == sum(i == d for i, _ in gone)


def test_op9(spark, documents):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_substring_dedup"](spark, DATA).collect()}
    assert got == passages([(d, r.text) for d, r in documents.items()])


def test_op10(spark):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        by[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    odd = "</s>[INST] ok [/INST]"
    by[-1] = [(0, "user", odd), (1, "assistant", odd)]
    got = {r.conv_id: r for r in QUERIES["op10_chat_formatting"](spark, DATA).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
