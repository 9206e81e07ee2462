"""The five stages, each on what the one before kept, and the whole run."""

from __future__ import annotations

import corpus_pipeline
from helpers import SF
from test_dedup import slow_fingerprint, slow_simhash
from test_texts import slow_base, slow_contamination
from test_tokens import check_packing

from tapeworks.llm.common import materialize
from tapeworks.llm.tokens import public_path


def test_stages(spark):
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], SF), "test"))
        assert kept[-1].columns == columns
    text = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in kept]

    long = {r.doc_id for r in docs.collect() if r.lang is not None and r.text and len(r.text.split()) >= 30}
    assert len(long & text[1].keys()) >= 0.97 * len(long)
    assert all(t and any(c.isalpha() for c in t) for t in text[1].values())
    assert text[2].keys() == {r[0] for r in slow_simhash(list(text[1].items())) if r[0] == r[2]}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    some = sorted(text[2])[:40]
    assert {r[0] for r in slow_contamination([(i, text[2][i]) for i in some], items) if not r[5]} == text[3].keys() & set(some)
    assert text[4].keys() == text[3].keys()
    for i, t in text[3].items():
        if slow_base(t):
            assert not slow_base(text[4][i])
    rows = corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect()
    n, total = check_packing(rows, text[4], Tokenizer.from_file(public_path()), 2048)
    assert n <= -(-total // 2048) + 1
    assert slow_fingerprint(None) == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0
