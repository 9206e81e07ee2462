"""Token files, packing and the encoder against the tokenizers library."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import DOCUMENT, SF, clashing, documents, empty, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeworks.llm import packing, pfor, registry, token_files
from tapeworks.llm.tokens import Encoder, public_path

HARD = [None, "", " ", "\n", "a", " a", "a ", "a\n\nb", "a \n b", "it's he'll I'd", "x1y2 3.14!! ...", "äö 你好 \U0001f600", "<|endoftext|> </s>", "a b  c", "tab\tb", "\r\nq", "end.\nNew (one) \"two\"", "w" * 200 + " z"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path())


def slow_ids(library, text):
    return np.append(np.array(library.encode(text or "", add_special_tokens=False).ids, np.uint32), 0).astype("<u4")


@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.floats(0, 1))
@settings(max_examples=40, deadline=None)
def test_blocks_round_trip(values, percentile):
    ids = np.array(values, np.uint32)
    data, starts = pfor.write(ids, percentile)
    assert pfor.read(data, starts).tolist() == values
    if starts:
        assert pfor.read_block(data, starts[-1]).tolist() == values[(len(starts) - 1) * pfor.BLOCK :]


def test_blocks_are_smaller_with_outliers():
    ids = np.random.default_rng(1).integers(0, 900, 5000).astype(np.uint32)
    ids[::100] = 2**31
    assert len(pfor.write(ids)[0]) < 0.5 * 4 * len(ids)


@given(st.lists(st.text(alphabet=st.sampled_from("ab Z1.'\n\té你,! "), max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_encoder_equals_library(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(public_path()).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_hard_texts(library):
    ours = Encoder(public_path()).encode(HARD)
    for text, ids in zip(HARD, ours):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_token_files_query(spark, library):
    at, want = 0, []
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = slow_ids(library, r.text)
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = registry.QUERIES["op8_token_files"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_token_file_edges(spark, tmp_path, library):
    rows = [(3, None), (1, ""), (2, prose(40_000, 3)), (2, "again"), (None, "no id"), (9, " \n ")]
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(clashing(documents(spark, rows)), path, public_path())
    files = token_files.read_files(spark, path)
    got = sorted((r.doc_id or -1, r.ids) for r in token_files.read_ids(files).collect())
    assert got == sorted((i or -1, slow_ids(library, t).tolist()) for i, t in rows)
    starts = sorted((r.start, r.n_tokens) for r in token_files.with_starts(files).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    path = f"file://{tmp_path}/none"
    token_files.write_tokens(empty(spark, DOCUMENT), path, public_path())
    assert token_files.digests(token_files.read_files(spark, path)).count() == 0


def check_packing(rows, texts, library, capacity):
    """rows: of pack_documents; every id once, in order, no sequence too long or with gaps."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, text in texts.items():
        ids, at = slow_ids(library, text), 0
        for k, r in enumerate(sorted(by_doc.pop(doc_id), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        assert k == 0 or len(ids) > capacity
    assert not by_doc
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), sum(r.length for r in rows)


def test_packing_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n, total = check_packing(registry.QUERIES["op4_best_fit_packing"](spark, SF).collect(), texts, library, 2048)
    assert n <= -(-total // 2048) + 1


def test_packing_edges(spark, library):
    texts = {1: None, 2: "", 3: prose(5000, 1), 4: "a b c", 5: "a b c"}
    rows = packing.pack_documents(clashing(documents(spark, list(texts.items()))), public_path(), 64).collect()
    check_packing(rows, texts, library, 64)
    again = packing.pack_documents(documents(spark, [(4, "a b c")] * 50), public_path(), 64).collect()
    assert len(again) == 50 and len({(r.sequence_id, r.offset) for r in again}) == 50
    assert packing.pack_documents(empty(spark, DOCUMENT), public_path()).count() == 0


@given(st.dictionaries(st.integers(1, 24), st.integers(1, 5), min_size=1, max_size=7))
@settings(max_examples=60, deadline=None)
def test_fullest_is_the_best_combination(counts):
    best = packing.fullest(counts, 24)
    first = max(counts)
    totals = {first}
    for length, n in counts.items():
        totals |= {t + k * length for t in totals for k in range(n - (length == first) + 1) if t + k * length <= 24}
    assert best[first] >= 1 and all(n <= counts[k] for k, n in best.items())
    assert sum(k * n for k, n in best.items()) == max(totals)
