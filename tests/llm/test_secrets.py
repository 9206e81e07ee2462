"""False alarms on ordinary prose, and credentials of labelled formats without their context."""

from __future__ import annotations

import random
import string

from helpers import documents, prose

from tapeworks.llm import secret_scan


def test_no_word_of_the_corpus_is_a_secret(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = secret_scan.scan(docs, secret_scan.fit(docs)).where("n_format > 0").join(docs, "doc_id").select("spans", "text").collect()
    words = [r.text[int(a) : int(b)] for r in rows for kind, a, b in (s.split(":") for s in r.spans.split(",")) if kind == "format"]
    assert not [w for w in words if w.isalpha()]


def test_credentials_without_context(spark):
    """Nine of ten planted ones of each labelled format are found, and no other token of those documents."""
    pick = random.Random(5)
    of = lambda chars, n: "".join(pick.choice(chars) for _ in range(n))
    made = {
        "assign": lambda: "sk_" + of(string.ascii_letters + string.digits, 28),
        "access": lambda: "AKIA" + of(string.ascii_uppercase + string.digits, 16),
        "hex": lambda: of("0123456789abcdef", 40),
    }
    said = {"assign": 'api_key = "{}"', "access": "id {}", "hex": "sum {}"}
    texts = [f"{prose(30, i)} {said[kind].format(make())} {prose(20, 1000 + i)}" for kind, make in made.items() for i in range(60)]
    # long tokens that are no secrets: compounds, paths, card numbers
    texts += [prose(300, 2000 + i) + " " + " ".join("-".join(prose(4, 5000 + 20 * i + j).split()) + " " + "/".join(prose(5, 6000 + 20 * i + j).split()) + f" {pick.randrange(10**15, 10**16)}" for j in range(20)) for i in range(20)]
    planted = [(kind, make()) for kind, make in made.items() for _ in range(50)]
    hidden = [f"{prose(20, 3000 + i)} {value} {prose(20, 4000 + i)}" for i, (_, value) in enumerate(planted)]
    formats = secret_scan.fit(documents(spark, texts))
    found, extra = dict.fromkeys(made, 0), []
    for (kind, value), text in zip(planted, hidden):
        tokens = [text[a:b] for a, b, _ in secret_scan.all_spans(text, formats)[1]]
        found[kind] += value in tokens
        extra += [t for t in tokens if t not in value]
    assert all(n >= 45 for n in found.values()) and not extra


def test_a_kind_judges_only_classes_that_it_knows():
    pick = random.Random(6)
    keys = ["".join(pick.choice("0123456789abcdef") for _ in range(40)) for _ in range(100)]
    words = [w for i in range(40) for w in prose(30, i).split() if len(w) >= 6]
    formats = secret_scan.Formats({"hex": keys, "word": words[:200], "other": [w * 3 for w in words[:200]]}, {"word": words[200:], "other": []})
    assert formats.judged == {"other"} and not formats.secret("bebepf") and formats.secret(keys[0][::-1])


def test_all_values_teach_and_set_the_scores(spark):
    """Every different credential and token is counted, over any partitions, as by one process; so is every one behind a score to reach."""
    pick = random.Random(8)
    texts = [f"{prose(25, 7000 + i)} token={''.join(pick.choice('0123456789ABCDEF') for _ in range(20))} {pick.randrange(10**15, 10**16)}" for i in range(900)]
    formats = secret_scan.fit(documents(spark, texts + texts[:50]).repartition(5))
    values = {}
    for kind, value in {v for t in texts for v in secret_scan.labelled(t)}:
        values.setdefault(kind, []).append(value)
    assert len(values["assign"]) == 900 and len(values["word"]) > 3300
    [(keys, reach)] = formats.kinds
    for automaton, kind in ((keys, "assign"), *((formats.other[c], c) for c in ("word", "other"))):
        one = secret_scan.infer(values[kind])
        assert sum(automaton.ends) == len(values[kind]) and (automaton.next, automaton.seen, automaton.ends) == (one.next, one.seen, one.ends)
    own = sorted(formats.score(keys, v) for v in values["assign"])
    chance = sorted(((formats.other["other"].bits_without(v) - keys.bits(v)) / (len(v) + 1) for v in values["other"]), reverse=True)
    want = max(secret_scan.MARGIN, own[int(secret_scan.QUANTILE * len(own))], chance[int(secret_scan.RATE * len(chance))] + secret_scan.MARGIN)
    assert want - 0.01 <= reach["other"] <= want and reach["word"] == reach["code"] == float("inf")


def test_an_example_is_judged_without_its_own_counts():
    examples = ["".join(random.Random(i).choice("abc") for _ in range(i % 7)) for i in range(60)] + ["xyz"]
    whole = secret_scan.infer(examples)
    assert all(whole.bits_without(t) > whole.bits(t) for t in examples)
    assert whole.bits_without("xyz") - whole.bits("xyz") > 10
