"""Decontamination, secrets, chats, languages, embeddings and pages: brute force, held-out accuracy and edge cases."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from helpers import DOCUMENT, SF, clashing, documents, empty, groups, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeworks.llm import chat, decontaminate, embedding_dedup, html_text, language, registry, secret_scan
from tapeworks.llm.automata import infer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ws(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow_contamination(docs, items):
    out = []
    for doc_id, text in docs:
        own, hit, ids = ws(text), set(), set()
        for item_id, t in items:
            iw = ws(t)
            n = min(10, len(iw))
            for i in range(len(iw) - n + 1) if n else []:
                for j in range(len(own) - n + 1):
                    if own[j : j + n] == iw[i : i + n]:
                        hit |= set(range(j, j + n))
                        ids.add(str(item_id))
        out.append((doc_id, len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [16_000_000, 0])
def test_contamination(spark, limit):
    """The broadcast index and the shuffle join give what comparing all windows gives."""
    a, b = prose(14, 1), prose(40, 2)
    items = [(1, a), (2, b), (3, "short One"), (4, ""), (5, None), (6, "..."), (7, "rep rep rep rep rep rep rep rep rep rep rep rep")]
    docs = [
        (1, "x " + a.upper() + " y"), (2, " ".join(b.split()[5:15]) + " z"), (3, " ".join(b.split()[5:14]) + " z"), (4, None), (5, ""), (6, "--"), (7, "say short, one"),
        (8, "rep " * 30), (9, b + " " + a + " " + b), (9, b), (10, prose(3000, 5) + " " + a), (11, "short"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(clashing(documents(spark, docs)), clashing(table), broadcast_bytes=limit)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == slow_contamination(docs, items)
    kept = decontaminate.decontaminate(documents(spark, docs), table, broadcast_bytes=limit)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 11]
    assert decontaminate.contamination(empty(spark, DOCUMENT), table, broadcast_bytes=limit).count() == 0
    none = decontaminate.contamination(documents(spark, docs), empty(spark, "item_id long, text string"), broadcast_bytes=limit)
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)


@pytest.mark.parametrize("limit", [16_000_000, 0])
def test_decontamination_is_by_row(spark, limit):
    """Each row stays or goes by its own text, also if its doc_id is null or repeated."""
    item = prose(20, 61)
    docs = documents(spark, [(None, item), (None, prose(30, 62)), (1, item), (1, prose(30, 63)), (2, "clean")])
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(clashing(docs), table, broadcast_bytes=limit)
    assert sorted(r.text for r in kept.collect()) == sorted([prose(30, 62), prose(30, 63), "clean"]) and kept.columns == clashing(docs).columns


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_base(text):
    spans = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(*m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(*m.span(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def slow_row(doc_id, text):
    base = slow_base(text or "")
    said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, b, k in base)
    return (doc_id, *(sum(s[2] == k for s in base) for k in range(3)), hashlib.sha256(said.encode()).hexdigest())


def test_secret_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = registry.QUERIES["op3_secret_scan"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(slow_row(*r) for r in docs)
    assert all(r.spans.count(":") == 2 * (r.n_assign + r.n_access + r.n_hex + r.n_format) for r in got)


def test_secret_edges(spark):
    rows = [
        (1, None), (2, ""), (3, 'ApiKey="abc123" api_key: xyz987 token = short PASSWORD:=x'), (4, "AKIA" + "Z9" * 8 + " AKIAAKIA" + "0" * 12), (5, "deadbeef" * 3 + " " + "0" * 23),
        (6, "äö secret='ä' ſecret=abcdefgh toKen=abcdefgh"), (7, "token=AKIA" + "B" * 20), (7, "x"), (8, ("password=hunter22 " + prose(20, 3) + " ") * 500),
    ]
    docs = clashing(documents(spark, rows))
    formats = secret_scan.fit(docs)
    got = secret_scan.scan(docs, formats).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(slow_row(*r) for r in rows)
    clean = {r.doc_id: r for r in secret_scan.redact(documents(spark, rows), formats).collect()}
    assert clean[1].text is None and clean[2].text == "" and "hunter22" not in clean[8].text and clean[8].n_chars == len(clean[8].text)
    none = empty(spark, DOCUMENT)
    assert secret_scan.scan(none, secret_scan.fit(none)).count() == 0


def test_formats_find_unlabelled_credentials():
    """Tokens of the format of labelled ones are found without their names; other long tokens are not."""
    pick = np.random.default_rng(5)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    key = lambda: "sk_live_" + "".join(pick.choice(alphabet, 24))
    plain = ["-".join(prose(4, i).split()) for i in range(400)]
    plain = [p for p in plain if len(p) >= 16]
    formats = secret_scan.Formats({"assign": [key() for _ in range(200)], "other": plain[:200]})
    assert sum(formats.secret(key()) for _ in range(200)) >= 180
    assert sum(map(formats.secret, plain[200:])) <= 0.02 * len(plain[200:])


def test_automaton_merges_and_generalises():
    a = infer(["ab" * n for n in range(1, 30)])
    assert a.bits("ab" * 40) < a.bits("ba" * 40)


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[END]"]), st.text(alphabet=st.sampled_from("ab\\<>[]/sINSTAROLEDYS \né"), max_size=25)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(turns):
    fmt = chat.Format(chat.TEMPLATE)
    segments, _ = fmt.segments(iter(turns))
    assert fmt.read("".join(s for s, _ in segments)) == turns
    assert [fmt.unescape(s) for s, loss in segments if loss] == [t for r, t in turns if r == "assistant"]


def test_chat_controls_in_text():
    fmt = chat.Format(chat.TEMPLATE)
    for control in fmt.controls:
        turns = [("user", control), ("assistant", control * 2 + "\\")]
        segments, error = fmt.segments(iter(turns))
        text = "".join(s for s, _ in segments)
        assert fmt.read(text) == turns and not error and text.count("</s>") == 1


def test_chat_edges(spark):
    rows = [(1, 1, "user", None), (1, 2, "assistant", "x"), (2, 1, "assistant", "y"), (None, 1, "user", "q"), (3, None, None, ""), (4, 1, "user", "a"), (4, 1, "user", "a"), (5, 2, "assistant", "b"), (5, 1, "user", "a" * 100_000)]
    got = {r.conv_id: r for r in chat.format_chats(clashing(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert len(got) == 6 and got[1].valid and got[5].valid and not got[2].valid and not got[4].valid
    assert got[2].error == "turn 1: assistant after the start" and got[3].error.startswith("turn 1: no role")
    assert chat.format_chats(empty(spark, "conv_id long, turn int, role string, text string")).count() == 0


def test_language_held_out(spark):
    got = registry.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").alias("p").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").alias("d"), "doc_id")
    rows = got.where("held_out and lang is not null").select("lang", "lang_pred", "text", "score").collect()
    long = [r for r in rows if r.text and len(r.text.split()) >= 20]
    assert len(long) > 50 and np.mean([r.lang == r.lang_pred for r in long]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    texts = {"en": "the cat and the dog were in the house with the man", "de": "der hund und die katze waren in dem haus mit dem mann"}
    learn = spark.createDataFrame([(t, k) for k, t in texts.items()] * 20 + [(None, "en"), ("x", None)], "text string, lang string")
    model = language.fit(learn)
    docs = documents(spark, [(1, None), (2, ""), (3, "12 + 34 !!"), (4, "THE MAN in the house"), (5, "der mann und die"), (6, "hausmanns hunden"), (7, "cats " * 50_000), (7, "你好")])
    got = {r.doc_id: r for r in language.predict(clashing(docs), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6)] == ["und", "und", "und", "en", "de", "de"]
    assert got[1].score == 0 and language.predict(docs, model).count() == 8
    assert {4, 5} <= {r.doc_id for r in language.keep_known(docs, model).collect()} <= {4, 5, 6, 7}
    untaught = language.fit(empty(spark, "text string, lang string"))
    assert {r.lang_pred for r in language.predict(docs, untaught).collect()} == {"und"}
    assert language.predict(empty(spark, DOCUMENT), model).count() == 0


def slow_vectors(rows, least):
    good = [(k, np.array(v, np.float64)) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, np.float64)).all() and any(v)]
    links = []
    for (i, a), (j, b) in combinations(good, 2):
        if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
            links.append((i, j))
    top = groups(len(rows), links)
    low = {}
    for k, g in enumerate(top):
        low[g] = min(rows[k][0], low.get(g, rows[k][0]))
    return sorted((r[0], sum(k in x for x in links), low[top[k]], r[0] == low[top[k]]) for k, r in enumerate(rows))


@pytest.mark.parametrize("group_rows", [7, 6000])
def test_vectors(spark, group_rows):
    pick = np.random.default_rng(3)
    base = pick.normal(size=(25, 24))
    near = [base[pick.integers(25)] + pick.normal(size=24) * s for s in np.linspace(0.05, 0.6, 150)]
    vs = [v.astype(np.float32).tolist() for v in [*base, *near]]
    vs += [vs[0]] * 9 + [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] * 24, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [1e-30] * 24]
    rows = [(1000 - 3 * i, v) for i, v in enumerate(vs)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, embedding_dedup.near_vectors(clashing(table), 0.9, group_rows).collect()))
    assert got == slow_vectors(rows, 0.9)
    assert embedding_dedup.near_vectors(empty(spark, "vec_id long, embedding array<float>")).count() == 0


PAGE = """<html><head><title>T</title><style>x{}</style></head><body><header class="site-header">Site</header><nav><ul><li>Home</li><li>News</li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="content"><article><h1>Title &amp; more</h1><p>First   paragraph with
a <b>bold</b> word&#33; It goes on for some time to be long enough.</p><script>var x = "<p>no</p>";</script><div class="ad-slot">Buy now</div>
<p>Short.</p><p>Second paragraph, caf&eacute;, also long enough to count as content.</p></article><aside>Related</aside>
<section class="comments"><p>A reader says that this is a very long comment that goes on and on and on.</p></section></div>
<form><label>Mail</label><input></form><footer>Imprint</footer></body></html>"""


def test_page():
    want = "Title & more First paragraph with a bold word! It goes on for some time to be long enough. Short. Second paragraph, café, also long enough to count as content."
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE.replace("<article>", "<div class='post'>").replace("</article>", "</div>")) == want


def test_page_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (4, "u", "just text, no tags"), (5, "u", "<p>open <b>never closed"), (6, "u", "<p>a</p><!-- cut"), (7, "u", PAGE), (7, "u", PAGE), (8, "u", "<div>" * 500 + "deep"), (9, "u", "<p>" + "word " * 100_000 + "</p>"), (None, "u", "<p>x</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract(clashing(table)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[1] == text[2] == text[3] == "" and text[4] == "just text, no tags" and text[5] == "open never closed" and text[6] == "a" and text[8] == "deep" and text[None] == "x"
    assert html_text.extract(empty(spark, "page_id long, url string, html string")).count() == 0


def test_pages_have_no_furniture(spark):
    got = registry.QUERIES["op10_html_extraction"](spark, SF).collect()
    assert sum(r.n_chars > 0 for r in got) >= 0.9 * len(got)
    for r in got:
        assert not re.search(r"</?(?:p|div|script|nav|article)\b", r.text) and "  " not in r.text


LONG = "The long text of this part goes on for quite a while, so that it is clearly prose and no menu. " * 4


@pytest.mark.parametrize("html, parts", [
    ("<html><head><script><!-- x() </script></head><body><article><p>{0}</p></article></body></html>", 1),
    ("<p title='<!-- x'>{0}</p><p>{1}</p>", 2),
    ("<style><!-- a {{}} </style><main><p>{0}</p></main>", 1),
    ("<body><article><p>{0}</p></article><article><p>{1}</p></article></body>", 2),
    ("<main><p>{0}</p><p>{1}</p><article><p>Part 2. The teaser goes on for quite a while too, so that it is clearly prose and no menu. It goes on for quite a while too, so that it is clearly prose and no menu.</p></article></main>", 2),
    ("<body><div><p>{0}</p><p>{1}</p></div><article><p>Part 2. The teaser goes on for quite a while too, so that it is clearly prose and no menu. It goes on for quite a while too, so that it is clearly prose and no menu.</p></article></body>", 2),
    ("<main><p>{0}</p></main><article><p>{1}</p></article>", 2),
    ("<body><div class=intro><p>{0}</p></div><div class=body><p>{1}</p><p>{2}</p></div></body>", 3),
])
def test_page_keeps_all_content(html, parts):
    """No script comment, second article, teaser card or sibling block makes content go."""
    texts = [f"Part {i}. {LONG}".strip() for i in range(3)]
    got = html_text.main_text(html.format(*texts) + "<ul>" + "<li>Short</li>" * 8 + "</ul>")
    for text in texts[:parts]:
        assert text in got


@pytest.mark.parametrize("end", ["<!-- never closed <p>hidden</p>", "<!-- a > b <i", "<div class='x", "<!--"])
def test_page_cut_at_its_end(end):
    assert html_text.main_text(f"<article><p>{LONG}</p></article>{end}") == LONG.strip()


def test_formats_of_short_touching_and_long_credentials():
    """Short tokens are scored, tokens that hold a base span are found whole, and formats longer than 64 characters are learned whole."""
    pick = np.random.default_rng(6)
    key = lambda n, letters: "".join(pick.choice(list(letters), n))
    words = prose(400, 8).split()
    samples = {"word": [w for w in words if len(w) >= 6], "other": ["-".join(prose(4, i).split()) for i in range(200)]}

    short = secret_scan.Formats({"assign": ["Q7" + key(8, "XYZ0123456789") for _ in range(200)], **samples})
    token = "Q7" + key(8, "XYZ0123456789")
    text = f"{' '.join(words[:20])} {token} {' '.join(words[20:30])}"
    assert [text[a:b] for a, b, _ in secret_scan.all_spans(text, short)[1]] == [token]

    mixed = lambda: "sk_live_" + key(24, "0123456789abcdef") + "_" + key(8, "XYZ")
    formats = secret_scan.Formats({"assign": [mixed() for _ in range(200)], **samples})
    token = mixed()
    base, spans = secret_scan.all_spans(f"see {token} here", formats)
    assert (12, 36, "hex") in base and (12, 36, "hex") in spans and (4, 4 + len(token), "format") in spans

    long = secret_scan.Formats({"assign": [key(64, "ABCDEF") + key(36, "uvwxyz") for _ in range(200)], **samples})
    assert long.kinds[0][0].bits(key(64, "ABCDEF") + key(36, "uvwxyz")) < 3.5 * 100


def test_labelled_values_are_whole():
    value = "".join(prose(40, 9).split())[:100]
    assert ("assign", value) in secret_scan.labelled(f"token={value}") and {"other", "word", "code"} == {secret_scan.ordinary(t) for t in ("a" * 16, "abcdef", "555-12")}
