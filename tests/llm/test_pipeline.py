"""The pipeline against a plain version of its five stages."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from sigmark.llm import packing, quality
from tests.conftest import DATA

from .test_dedup import components, repeated_lines
from .test_registered import held
from .test_rules import measured


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs
    rows = sorted(tuple(r) for r in docs.collect())
    good = {r.doc_id for r in quality.apply_policy(quality.ledger(docs)).where("kept").collect()}
    assert all(measured(t)[0] >= 50 for i, t, *_ in rows if i in good)
    rows = [r for r in rows if r[0] in good]
    docs = corpus_pipeline.STAGES[0][1](spark, first, DATA)
    assert sorted(map(tuple, docs.collect())) == rows

    gone = repeated_lines(rows)
    kept = []
    for i, t, lang, source, _ in rows:
        t = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if t.strip():
            kept.append((i, t, lang, source, len(t)))
    docs = corpus_pipeline.cut(corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.cut(docs, "t"), DATA), "t")
    assert sorted(map(tuple, docs.collect())) == kept

    lead = components(kept)
    kept = [r for r in kept if lead[r[0]][1] == r[0]]
    docs = corpus_pipeline.cut(corpus_pipeline.STAGES[2][1](spark, docs, DATA), "t")
    assert sorted(map(tuple, docs.collect())) == kept

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {r[0] for r in kept} - {d for d, _ in held([(r[0], r[1]) for r in kept], items)}
    docs = corpus_pipeline.cut(corpus_pipeline.STAGES[3][1](spark, docs, DATA), "t")
    left = {r.doc_id for r in docs.collect()}
    # the search reaches its target recall, and drops nothing else
    assert want <= left and len(left - want) <= 0.03 * (len(kept) - len(want)) and 0 < len(want) < len(kept)

    packed = corpus_pipeline.STAGES[4][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == left
    assert sum(r.length for r in packed) == sum(len(packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))(r.text)) + 1 for r in docs.collect())
    again = corpus_pipeline.run(spark, DATA).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, packed))


def test_stages_on_awkward_documents(spark, docs, none):
    """Nulls, empty and long texts, repeated rows and clashing columns go through; an empty table stays empty."""
    for start in (docs, none):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.cut(stage(spark, now, DATA), name)
            assert now.columns == start.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()}
        assert bool(packed) == (start is docs)
