"""Substring dedup, SimHash and components against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
import xxhash
from helpers import DOCUMENT, SF, clashing, documents, empty, groups, prose

from tapeworks.llm import registry, simhash, substring_dedup
from tapeworks.llm.components import components


def slow_fingerprint(text: str | None) -> int:
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    ws, w = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            ws += [w] * bool(w)
            w = ""
        else:
            w += c
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode("utf-8", "replace"), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_simhash(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4]
    top = groups(len(rows), links)
    least: dict[int, int] = {}
    for (i, _), g in zip(rows, top):
        least[g] = min(i, least.get(g, i))
    return sorted((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fps, top))


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = registry.QUERIES["op5_simhash_dedup"](spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "fingerprint", "component_id").collect())) == slow_simhash([tuple(r) for r in docs])


def test_simhash_edges(spark):
    rows = [(5, None), (4, ""), (9, " \t\n"), (1, "A b"), (2, "a B"), (3, "one two three four"), (7, "one two three four"), (3, "one two three four"), (8, "Ä ä naïve x y z"), (10, prose(30_000, 1))]
    assert sorted(map(tuple, simhash.simhash_groups(clashing(documents(spark, rows))).collect())) == slow_simhash(rows)
    assert simhash.simhash_groups(empty(spark, DOCUMENT)).count() == 0
    kept = simhash.drop_near_copies(documents(spark, [*rows, (None, "a b")]))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 3, 4, 8, 10] and kept.count() == 7


@pytest.mark.parametrize("cell_rows", [3, 2000])
def test_chains_of_close_fingerprints(spark, cell_rows):
    """Links by 4 bits across any blocks, in hot buckets that are split into cells, lose nothing."""
    pick = random.Random(2)
    fps = [pick.getrandbits(64) for _ in range(40)]
    for _ in range(120):
        x = pick.choice(fps)
        for b in pick.sample(range(64), pick.randint(1, 6)):
            x ^= 1 << b
        fps.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    from tapeworks.llm.common import materialize

    prints = materialize(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long"), "test")
    got = [r.component_id for r in simhash.near_groups(prints, cell_rows=cell_rows).orderBy("doc_id").collect()]
    assert got == groups(len(fps), [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])


def test_components(spark):
    pick = random.Random(4)
    links = [(i, i + 1) for i in range(100)] + [(200 + pick.randrange(80), 200 + pick.randrange(80)) for _ in range(60)] + [(500, 500), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    top = groups(600, [(a, b) for a, b in links if a is not None])
    assert got == {i: top[i] for i in {x for a, b in links if a is not None and a != b for x in (a, b)}}
    assert components(empty(spark, "a long, b long")).count() == 0


def removed_words(found, doc_id):
    return sum(r.n_words for r in found if r.doc_id == doc_id and r.removed)


def test_shared_passages(spark):
    """A passage of 60 words in different surroundings is found in every later document, near copies too."""
    passage = prose(60, 99).split()
    near = list(passage)
    near[30] = "changed"
    texts = [
        " ".join([prose(50, 1), *passage, prose(40, 2)]),
        prose(33, 3) + "\n" + " ".join(passage) + "\n" + prose(20, 4),
        " ".join([prose(17, 5), *near, prose(21, 6)]),
        prose(200, 7),
        prose(200, 8),
    ]
    found = substring_dedup.passages(clashing(documents(spark, [*texts, None, "", "one two"]))).collect()
    assert removed_words(found, 0) == removed_words(found, 3) == removed_words(found, 4) == 0
    assert removed_words(found, 1) >= 35 and removed_words(found, 2) >= 20
    for r in found:
        assert r.first_doc_id == 0 and texts[r.doc_id][r.start : r.end].split()[0] in [*passage, "changed"]
    clean = {r.doc_id: r.text for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
    assert clean[0] == texts[0] and clean[3] == texts[3] and clean[4] == texts[4]
    assert len(clean[1].split()) <= 33 + 20 + 25


def test_paragraph_links_against_all_pairs(spark):
    """Clusters agree with an exact Jaccard comparison of all pairs of the distinct paragraphs, but for few missed ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    p = substring_dedup.Paragraphs(texts)
    sets = {}
    for i in range(len(p.first)):
        sets.setdefault(int(p.content[i]), frozenset(p.shingles(i)[k : k + 4] for k in range(0, len(p.shingles(i)), 4)))
    by_shingle: dict[bytes, list[int]] = {}
    for c, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(c)
    pairs = {(a, b) for cs in by_shingle.values() for a, b in combinations(sorted(set(cs)), 2)}
    close = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    ids = {c: i for i, c in enumerate(sorted(sets))}
    top = groups(len(ids), [(ids[a], ids[b]) for a, b in close])
    docs_of: dict[int, set] = {}
    for i in range(len(p.first)):
        docs_of.setdefault(top[ids[int(p.content[i])]], set()).add(int(p.text[i]))
    want = sum(len(docs_of[top[ids[int(c)]]]) > 1 for c in p.content)
    got = substring_dedup.repeated_paragraphs(docs).count()
    assert 0.98 * want <= got <= want


def test_substring_edges(spark):
    twice = prose(40, 12)
    rows = [(1, twice), (1, twice), (2, twice), (None, twice), (3, None), (4, "")]
    found = substring_dedup.passages(documents(spark, rows)).collect()
    assert {r.doc_id for r in found if r.removed} == {2}
    assert substring_dedup.passages(empty(spark, DOCUMENT)).count() == 0
    assert substring_dedup.remove_repeats(empty(spark, DOCUMENT)).count() == 0
    kept = substring_dedup.remove_repeats(documents(spark, rows))
    assert kept.count() == 6 and kept.columns == documents(spark, rows).columns


def test_passages_of_short_lines_and_in_one_document(spark):
    """Verses of at most four words a line are found, and so is a passage that one document repeats."""
    ws, passage = prose(120, 41).split(), prose(60, 42)
    verse = "\n".join(" ".join(ws[i : i + 3]) for i in range(0, len(ws), 3))
    texts = [verse, prose(60, 43) + "\n" + verse, "\n".join([passage, prose(50, 44), passage, prose(50, 45), passage]), prose(80, 46)]
    found = substring_dedup.passages(documents(spark, texts)).collect()
    assert removed_words(found, 0) == removed_words(found, 3) == 0
    assert removed_words(found, 1) >= 100 and removed_words(found, 2) == 120
    clean = {r.doc_id: r.text for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
    assert clean[2].count(passage) == 1 and clean[0] == texts[0] and clean[3] == texts[3]


def test_near_passages_inside_lines(spark):
    """A passage of 100 words with a changed one is found in a line of its own surroundings, and most of it goes."""
    rows, place = [], {}
    for i in range(40):
        p = prose(100, 900 + i).split()
        q = [*p[:45], "changed", *p[46:]]
        a, b, c, d = (prose(60, 5000 + 10 * i + k) for k in range(4))
        rows += [(2 * i, " ".join([a, *p, b])), (2 * i + 1, " ".join([c, *q, d]))]
        place[2 * i + 1] = (len(c) + 1, len(c) + 1 + len(" ".join(q)))
    share = dict.fromkeys(place, 0.0)
    for r in substring_dedup.passages(documents(spark, rows), 50).collect():
        if r.removed:
            start, end = place[r.doc_id]
            assert all(start <= c.start and c.end <= end for c in r.cuts)
            share[r.doc_id] += sum(c.end - c.start for c in r.cuts) / (end - start)
    assert sum(x > 0 for x in share.values()) >= 36 and sum(share.values()) / 40 >= 0.7
