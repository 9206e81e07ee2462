"""Decisions by row (null and repeated ids, clashing columns, empty tables), and plain-Python versions of what SQL can't express."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from helpers import DOCUMENT, SF, clashing, documents, empty, groups, prose
from test_tokens import check_packing, slow_ids

from tapeworks.llm import embedding_dedup, html_text, language, packing, registry, secret_scan, simhash, substring_dedup, token_files
from tapeworks.llm.tokens import Encoder, public_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path())


def test_near_copies_go_by_row(spark):
    """A text of its own stays though it shares its doc_id with a copy that goes, or has none."""
    copy, own, third = prose(40, 71), prose(40, 72), prose(40, 73)
    docs = clashing(documents(spark, [(1, copy), (2, copy), (2, own), (None, third), (None, copy), (3, None), (4, "")]))
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, copy), (2, own), (None, third), (None, copy), (3, None)], key=repr)


@pytest.mark.parametrize("blocks", [5, 6, 7, 8, None])
def test_more_blocks_find_the_same_links(spark, blocks):
    from tapeworks.llm.common import materialize

    pick = np.random.default_rng(7)
    fps = [int(x) for x in pick.integers(0, 2**63, 30)]
    fps += [fps[i % 30] ^ sum(1 << int(b) for b in pick.choice(64, pick.integers(1, 6), replace=False)) for i in range(90)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    prints = materialize(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long"), "test")
    want = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [r.component_id for r in simhash.near_groups(prints, blocks=blocks).orderBy("doc_id").collect()] == want


def test_blocks_follow_the_rows():
    assert [simhash.enough_blocks(10**k) for k in (0, 6, 7, 8, 9, 11, 13)] == [6, 6, 7, 8, 8, 8, 8]
    assert all(len(simhash.block_masks(4, simhash.enough_blocks(10**k))) <= 70 for k in range(14))


def test_repeats_go_by_row(spark):
    """Texts that share a doc_id keep their own words; columns of any name pass through."""
    passage, a, b = prose(60, 81), prose(70, 82), prose(70, 83)
    rows = [(1, a + "\n" + passage), (1, b), (None, passage + "\n" + prose(30, 84)), (2, None), (2, "")]
    docs = clashing(documents(spark, rows))
    got = substring_dedup.remove_repeats(docs)
    assert got.columns == docs.columns
    text = sorted((r.text for r in got.collect()), key=repr)
    assert text == sorted([a + "\n" + passage, b, "\n" + prose(30, 84), None, ""], key=repr)


def windows(texts: list[str], size: int) -> list[set[int]]:
    """Per text the words inside some run of `size` words that occurs elsewhere too, by comparing all runs."""
    words = [substring_dedup.Words([t]).h.tolist() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    return [{k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(i, i + size)} for w in words]


def test_passages_against_all_windows(spark):
    """Words of verbatim passages pasted anywhere are covered to their edges, others aren't (without near copies of whole lines)."""
    pick = np.random.default_rng(9)
    shared = [prose(int(n), 900 + i) for i, n in enumerate(pick.integers(51, 140, 12))]
    texts = []
    for i in range(60):
        parts = [prose(int(pick.integers(5, 60)), 1000 + i)]
        for _ in range(int(pick.integers(0, 3))):
            parts += [shared[int(pick.integers(12))], prose(int(pick.integers(5, 60)), 2000 + 7 * i + len(parts))]
        texts.append("".join(p + (" ", "\n")[int(pick.integers(2))] for p in parts))
    want, found = windows(texts, 50), [set() for _ in texts]
    for r in substring_dedup.passages(documents(spark, texts), 50, similarity=1.01).collect():
        w = substring_dedup.Words([texts[r.doc_id]])
        found[r.doc_id] |= {k for k in range(len(w.h)) if r.start <= w.start[k] and w.end[k] <= r.end}
        assert r.n_words >= 50
    assert sum(len(w & f) for w, f in zip(want, found)) >= 0.99 * sum(map(len, want))
    assert sum(len(f - w) for w, f in zip(want, found)) <= 0.01 * sum(map(len, want))
    clean = [r.text for r in sorted(substring_dedup.remove_repeats(documents(spark, texts), 50, similarity=1.01).collect(), key=lambda r: r.doc_id)]
    assert all(sum(s in t for t in clean) == any(s in t for t in texts) for s in shared)


def test_near_paragraphs_recall(spark):
    """Of the paragraphs that have one of similarity 0.8 or more, nearly all are found."""
    pick = np.random.default_rng(10)
    texts = []
    for i in range(120):
        ws = prose(60, 3000 + i).split()
        other = list(ws)
        for k in pick.choice(60, 1 + i % 2, replace=False):
            other[k] = "changed"
        texts += [" ".join(ws), " ".join(other)]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    close = {i for k in range(0, 240, 2) if len(shingles[k] & shingles[k + 1]) >= 0.8 * len(shingles[k] | shingles[k + 1]) for i in (k, k + 1)}
    got = {r.doc_id for r in substring_dedup.repeated_paragraphs(documents(spark, texts)).collect()}
    assert got <= close and len(got) >= 0.97 * len(close) and len(close) > 60


SPECIAL = ["<|endoftext|>", "a<|endoftext|>b", "x <|endoftext|>  y\n<|endoftext|>", "<|endoftext", "|endoftext|>", "say <|endoftext|> " + prose(30, 5)]


def test_added_tokens_are_the_library_s(spark, library, tmp_path):
    """A text with the string of an added token has the ids that the library gives it by default."""
    for text, ids in zip(SPECIAL, Encoder(public_path()).encode(SPECIAL)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert library.encode(SPECIAL[0], add_special_tokens=False).ids != library.encode("<|endoftext", add_special_tokens=False).ids
    docs = documents(spark, list(enumerate(SPECIAL)))
    check_packing(packing.pack_documents(docs, public_path(), 32).collect(), dict(enumerate(SPECIAL)), library, 32)
    token_files.write_tokens(docs, f"file://{tmp_path}/t", public_path())
    got = {r.doc_id: r.ids for r in token_files.read_ids(token_files.read_files(spark, f"file://{tmp_path}/t")).collect()}
    assert got == {i: slow_ids(library, t).tolist() for i, t in enumerate(SPECIAL)}


def test_rows_of_one_id_fill_several_files(spark, tmp_path):
    rows = [(7, prose(50, i)) for i in range(400)] + [(1, "first"), (9, "last")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        token_files.write_tokens(documents(spark, rows).repartition(4), f"file://{tmp_path}/t", public_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = token_files.with_starts(token_files.read_files(spark, f"file://{tmp_path}/t")).orderBy("start").collect()
    assert len({r.shard for r in files if r.doc_id == 7}) > 1
    assert [r.doc_id for r in files] == sorted(r.doc_id for r in files)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(files, files[1:]))


def letters(text: str) -> list[str]:
    """Runs of letters, with the marks that follow letters, by category of each character."""
    out, word = [], ""
    for c in text + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or kind == "M" and word:
            word += c
        else:
            out += [word] * bool(word)
            word = ""
    return out


def slow_predict(model, text: str | None) -> tuple[str, float]:
    """The definition, word by word, without tables of scores."""
    ws = letters((text or "").lower())
    if not ws or not model.languages:
        return "und", 0.0
    total = [0.0] * len(model.languages)
    for w in ws:
        if w in model.words:
            rows = [model.words[w]]
        else:
            marked = f" {w} "
            hits = (next((model.grams[marked[i : i + n]] for n in (4, 3, 2, 1) if i + n <= len(marked) and marked[i : i + n] in model.grams), None) for i in range(len(w) + 1))
            rows = [h for h in hits if h is not None]
        for k in range(len(total)):
            total[k] += sum(float(model.logs[r][k]) for r in rows) / max(1, len(rows)) / len(ws)
    best = max(range(len(total)), key=total.__getitem__)
    return model.languages[best], 1 / sum(math.exp((t - total[best]) * min(len(ws), 30)) for t in total)


def test_language_against_plain_scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))
    text = {r.doc_id: r.text for r in docs.collect()} | {-1: "½ ② Ⅷ ３", -2: "हिन्दी में लिखा", -3: None, -4: "x²"}
    rows = documents(spark, list(text.items()))
    for r in language.predict(rows, model).collect():
        lang, score = slow_predict(model, text[r.doc_id])
        assert r.score == pytest.approx(score, abs=1e-4) and (r.lang_pred == lang or abs(score - 0.5) < 1e-3 or score < 0.3)
    got = {r.doc_id: r for r in language.predict(rows, model).collect()}
    assert got[-1].lang_pred == "und" and got[-1].score == 0 and got[-4].lang_pred != "und"
    assert language.LETTERS.findall("हिन्दी में") == ["हिन्दी", "में"]


def test_language_learns_each_text_once_and_keeps_rare_languages(spark):
    many = [("the same words again and again", "en")] * 500 + [(f"the cat number {prose(3, i)} and the dog", "en") for i in range(50)] + [("einmal", "de")]
    model = language.fit(spark.createDataFrame(many, "text string, lang string"), 1000)
    assert model.languages == ["de", "en"] and "again" in model.words and model.languages == sorted(model.languages)
    tied = language.Model([("b", 0, "w", 5), ("a", 0, "w", 5)])
    assert language.Scorer(tied).predict("w w") == ("a", 0.5)


def slow_formats(text: str, formats) -> list[tuple[int, int]]:
    """Format spans by scoring every token of a text by its two likelihoods in full."""
    base = secret_scan.base_spans(text)
    out = []
    for m in secret_scan.TOKEN.finditer(text):
        a, b = m.span()
        if any(x <= a and b <= y for x, y, _ in base):
            continue
        kind = secret_scan.ordinary(m[0])
        if any(formats.score(automaton, m[0]) >= least[kind] for automaton, least in formats.kinds):
            out.append((a, b))
    return out


def test_format_spans_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    formats = secret_scan.fit(docs)
    assert formats.kinds
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs, formats).collect()}
    found = 0
    for r in docs.collect():
        want = slow_formats(r.text or "", formats)
        found += len(want)
        assert [tuple(map(int, s.split(":")[1:])) for s in got[r.doc_id].split(",") if s.startswith("format:")] == want
    again = secret_scan.fit(docs.repartition(3))
    assert sorted(got.items()) == sorted((r.doc_id, r.spans) for r in secret_scan.scan(docs, again).collect())


def test_doubles_are_compared_as_doubles(spark):
    vs = [[1e60, 2e60], [1e60, 2e60], [1e300, 2e300], [1.0, 2.0000001], [1e-200, -1e-200], [3e-310, -3e-310], [0.0, 0.0]]
    table = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(clashing(table)).collect()}
    assert [got[i] for i in range(7)] == [(3, 0)] * 4 + [(1, 4)] * 2 + [(0, 6)]
    ints = spark.createDataFrame([(1, [1, 2]), (2, [2, 4]), (3, [2, -1])], "vec_id long, embedding array<int>")
    assert sorted((r.vec_id, r.n_links) for r in embedding_dedup.near_vectors(ints).collect()) == [(1, 1), (2, 1), (3, 0)]


PROSE = "The long text of this part goes on for quite a while, so that it is clearly prose and no menu. " * 4


@pytest.mark.parametrize("name, kept", [
    ("share-price", True), ("related-work", True), ("comment-on-policy", True), ("lead-widget", True), ("post-content", True), ("ad-slot", False), ("cookie-notice", False),
    ("comment-list", False), ("sidebar left", False), ("site-header", False), ("main-menu", False), ("newsletter-signup", False),
])
def test_names_of_furniture(name, kept):
    """Elements whose names consist of furniture and structure words go; those that hold such a word among others stay."""
    got = html_text.main_text(f"<body><article><p>{PROSE}</p><div class='{name}'><p>Inner words. {PROSE}</p></div><p>{PROSE}</p></article></body>")
    assert ("Inner words." in got) == kept


def test_article_text_under_common_names():
    got = html_text.main_text(f"<article><h2 class='header'>Head</h2><p class='social'>Note.</p><p>{PROSE}<math><mi>x</mi><mo>+</mo><mn>1</mn></math></p><table><tr><td>Cell</td></tr></table></article>")
    assert got.startswith("Head Note. The long") and got.endswith("x+1 Cell")


@pytest.mark.parametrize("html", [
    "<ol class='comment-list'><li>Inner words. {}</li></ol>", "<div id='user-comments'><p>Inner words. {}</p></div>", "<p class='notice'>Inner words. {}</p>", "<ul class='menu'><li>Inner words. {}</li></ul>", "<nav><p>Inner words. {}</p></nav>",
    "<footer><p>Inner words. {}</p></footer>", "<aside>Inner words. {}</aside>", "<form><p>Inner words. {}</p></form>", "<script>Inner words. {}</script>", "<style>Inner words. {}</style>", "<div class='ad'>Inner words. {}</div>",
    "<div class='sidebar'>Inner words. {}</div>", "<title>Inner words.</title>", "<ul class='related'><li>Inner words.</li></ul>", "<section class='reader-comments'><p>Inner words. {}</p></section>",
])
@pytest.mark.parametrize("place", ["<body><article><p>{0}</p>{1}<p>{0}</p></article></body>", "<body><div><p>{0}</p>{1}<p>{0}</p></div></body>", "<body>{1}<div><p>{0}</p></div></body>"])
def test_furniture_goes_wherever_it_stands(html, place):
    got = html_text.main_text(place.format(PROSE, html.format(PROSE)))
    assert "Inner words." not in got and "The long text" in got


BARE = """<body><div>{links}</div><div><p>An introduction of some thirty words that stands in a block of its own, before the text that it introduces,
and that is short beside it, but prose all the same, as any reader can see.</p></div><div><h2>Head</h2><p>{prose}</p><p>Short.</p><p>{prose}</p></div><div>{links}</div><div>&copy; 2024 Imprint</div></body>"""


def test_regions_without_article_or_names(monkeypatch):
    """Nothing is named, so only the clusters can tell the link lists and the imprint from the text."""
    links = "".join(f"<a href='/{i}'>Link {i}</a><br>" if i % 2 else f"<p><a href='/{i}'>Link number {i}</a></p>" for i in range(12))
    page = BARE.format(links=links, prose=PROSE)
    got = html_text.main_text(page)
    assert got.startswith("An introduction") and " Head The long" in got and " Short. The long" in got and got.endswith("menu.")
    assert "Link" not in got and "Imprint" not in got
    monkeypatch.setattr(html_text, "threshold", lambda values: -1.0)  # no clustering: all lines are content
    assert "Imprint" in html_text.main_text(page)


def test_siblings_of_a_region_stay():
    words = lambda n: " ".join(f"word{i}" for i in range(n)) + "."
    got = html_text.main_text(f"<div><p>Intro {words(35)}</p></div><div><p>{words(60)}</p></div>")
    assert got == f"Intro {words(35)} {words(60)}"


def paragraphs_of(page: str) -> list[str]:
    """Headings and paragraphs of the given tables' pages, cut out by their tags as written."""
    import html
    import re

    body = re.search(r"<article>(.*?)</article>", page or "", re.S)
    found = re.split(r"</?(?:h1|p)>|(?<=<p>)|<p>", body[1]) if body else []
    return [t for x in found if (t := " ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()))]


def test_article_words_of_the_pages(spark):
    """All words of the pages' articles come out, in order, and no others."""
    want = {r.page_id: " ".join(paragraphs_of(r.html)) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in registry.QUERIES["op10_html_extraction"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert sum(got[k].split() == want[k].split() for k in want) >= 0.99 * len(want)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_tables(spark, stage):
    """Null, repeated and missing ids, null and long texts, clashing columns, an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(docs[0].doc_id, docs[1].text), (None, docs[2].text), (None, None), (5, None), (5, ""), (6, prose(20_000, 1)), (6, "½ ②")]
    table = clashing(documents(spark, rows))
    got = stage(spark, table, SF)
    assert got.columns == table.columns and 0 < got.count() <= len(rows)
    assert stage(spark, empty(spark, DOCUMENT), SF).count() == 0


def test_run_on_odd_tables(spark, tmp_path, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    rows += [(rows[0][0], rows[1][1]), (None, rows[2][1]), (None, None), (5000, None), (5001, "")]
    for name, table in (("odd", clashing(documents(spark, rows))), ("none", empty(spark, DOCUMENT))):
        table.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"file://{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/odd").count() > 0
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
