"""Secret scans: base patterns, and formats inferred from the credentials that they find.

The base patterns label credentials. From all different ones of each kind a probabilistic automaton
is inferred (see automata); three more learn all other tokens: long ones, and short ones without and with digits. A candidate, any token
as long as the shortest credential that is not within one base span, is a secret if its likelihood under a kind's
automaton exceeds that of ordinary tokens by as many bits a character as nearly all labelled ones do, and by clearly more
than nearly all ordinary tokens do, each judged by the counts of the others. A kind judges only classes of tokens of which it has labelled ones.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from math import floor, inf

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton, Steps, arrivals, infer, infer_all
from .common import claim, keeps, materialize, slices, with_column

ASSIGN = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of the shortest labelled credential, and of a long token.
LEAST, LONG = 6, 16
TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{LEAST},}}")
KINDS = ("assign", "access", "hex")
#: Classes of tokens that are no credentials: long ones, short ones without digits, short ones with digits.
ORDINARY = ("other", "word", "code")
#: Share of the ordinary tokens of a class that may reach a score by chance (or are secrets without a label); labelled credentials
#: of a class that a kind must have to judge it.
RATE, EVIDENCE = 0.001, 5
#: Share of the labelled credentials whose score a candidate must reach, and bits a character it must exceed.
QUANTILE, MARGIN = 0.02, 0.75
SLACK = 1e-6
#: Parts of a bit in which scores are counted.
PARTS = 100

#: Tokens that a Python worker knows to be no secrets, or to be handed on already, before it starts again; longer ones than KEPT aren't kept.
VERDICTS, KEPT = 400_000, 40

Span = tuple[int, int, str]
#: Harmless tokens by the formats' id.
_harmless: dict[str, set[str]] = {}
keeps("secrets", _harmless.clear)


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) in code points, by start, then kind."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def ordinary(token: str) -> str:
    return "other" if len(token) >= LONG else "code" if any("0" <= c <= "9" for c in token) else "word"


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int, str, bool]]:
    """Tokens that are not within one base span, and whether they touch one."""
    for m in TOKEN.finditer(text):
        a, b = m.span()
        near = [(x, y) for x, y, _ in base if x < b and a < y]
        if not any(x <= a and b <= y for x, y in near):
            yield a, b, m[0], bool(near)


def marked(text: str) -> tuple[list[tuple[str, str]], set[str]]:
    """The credentials with their kinds, and the tokens that touch none of them."""
    if not (base := base_spans(text)):
        return [], set(TOKEN.findall(text))
    own = [(kind, ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]) for a, b, kind in base]
    return own, {token for _, _, token, near in candidates(text, base) if not near}


def labelled(text: str) -> list[tuple[str, str]]:
    """What the automata learn from a text: (kind or class, value)."""
    own, others = marked(text)
    return own + [(ordinary(t), t) for t in others]


def ranked(counts: dict[float, int], rank: int) -> float:
    """The score of a rank, from 0 for the least, by how often the scores come."""
    for score in sorted(counts):
        if (rank := rank - counts[score]) < 0:
            return score
    raise IndexError


def least(own: dict[float, int], others: dict[float, int]) -> float:
    """What nearly all labelled ones reach, but MARGIN above what all but RATE of the ordinary tokens do; infinity without evidence."""
    n, m = sum(own.values()), sum(others.values())
    if n < EVIDENCE:
        return inf
    return max(MARGIN, ranked(own, int(QUANTILE * n)), ranked(others, m - 1 - int(RATE * m)) + MARGIN if m else 0.0)


class Formats:
    """Automata of the kinds, with the score that a token of each class must reach, and those of other tokens.

    samples: credentials by kind and other tokens by class; held: further other tokens by class.
    """

    def __init__(self, samples: dict[str, list[str]], held: dict[str, list[str]] | None = None):
        self.take({k: infer(v) for k, v in samples.items() if v})
        own = {k: Counter((ordinary(t), self.score(a, t)) for t in samples[k]) for k, a in self.named.items()}
        chance = {k: Counter((c, self.score(a, t)) for c, tokens in (held or {}).items() for t in tokens) for k, a in self.named.items()}
        self.judge(own, chance)

    @classmethod
    def learned(cls, values: DataFrame) -> Formats:
        """From rows (kind, value), credentials by kind and other tokens by class: all of them teach, and all of them set the scores to reach."""
        self = cls.__new__(cls)
        self.take({k: a for k, a in infer_all((*KINDS, *ORDINARY), lambda steps: followed(values, steps)).items() if a.visits[0]})
        counts = {True: {}, False: {}}
        if self.named:
            for kind, token, credential, score, n in scores(values, self):
                counts[credential].setdefault(kind, {})[token, score / PARTS] = n
        self.judge(counts[True], counts[False])
        return self

    def take(self, automata: dict[str, Automaton]) -> None:
        self.id = uuid.uuid4().hex
        long = automata.get("other") or infer([])
        self.other = {c: automata.get(c, long) for c in ORDINARY}
        self.named = {k: automata[k] for k in KINDS if k in automata}

    def judge(self, own: dict[str, dict[tuple[str, float], int]], chance: dict[str, dict[tuple[str, float], int]]) -> None:
        """Set the scores to reach by how often credentials of each kind, and other tokens under it, have a class and score."""
        of = lambda counts, c: {score: n for (token, score), n in counts.items() if token == c}
        self.kinds = [(a, {c: least(of(own.get(k, {}), c), of(chance.get(k, {}), c)) for c in ORDINARY}) for k, a in self.named.items()]
        self.judged = {c for c in ORDINARY if any(reach[c] < inf for _, reach in self.kinds)}

    def score(self, automaton, token: str) -> float:
        return (self.other[ordinary(token)].bits(token) - automaton.bits(token)) / (len(token) + 1)

    def secret(self, token: str) -> bool:
        """Whether the score under some kind reaches what the kind's own credentials of the token's class have."""
        kind, n = ordinary(token), len(token) + 1
        if kind not in self.judged:
            return False
        plain = self.other[kind].bits(token)
        return any(plain - a.bits(token, plain - n * reach[kind] + SLACK) >= n * reach[kind] for a, reach in self.kinds)

    def secrets(self, tokens: set[str]) -> set[str]:
        """Those of the tokens that are secrets."""
        if not self.judged:
            return set()
        known = _harmless.setdefault(self.id, set())
        if len(known) > VERDICTS:
            known.clear()
        new = tokens.difference(known)
        found = set(filter(self.secret, new))
        known.update(t for t in new if len(t) <= KEPT and t not in found)
        return found


def followed(values: DataFrame, steps: dict[str, Steps]) -> list:
    """A round's sums of `arrivals` for kinds of values; there are at most as many as the automata's arcs have pairs of next symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: {} for k in steps}
        for batch in slices(batches, 4096):
            for kind in steps:
                arrivals(batch.column(1).filter(pc.equal(batch.column(0), kind)).to_pylist(), steps[kind], counts[kind])
        rows = [(kind, *key, n) for kind, found in counts.items() for key, n in found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["kind", "state", "symbol", "next", "n"])

    some = values.where(F.col("kind").isin(*steps)).mapInArrow(run, "kind string, state long, symbol string, next string, n long")
    return some.groupBy("kind", "state", "symbol", "next").agg(F.sum("n")).collect()


def scores(values: DataFrame, formats: Formats) -> list:
    """(kind, class, whether of its credentials, score in parts of a bit, n) of all values, other tokens by the counts of the others."""
    shared = values.sparkSession.sparkContext.broadcast(formats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, formats = Counter(), shared.value
        for batch in slices(batches, 4096):
            for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                token = ordinary(value)
                if kind in KINDS:
                    counts[kind, token, True, floor(PARTS * formats.score(formats.named[kind], value))] += 1
                else:
                    plain = formats.other[token].bits_without(value)
                    for k, automaton in formats.named.items():
                        counts[k, token, False, floor(PARTS * (plain - automaton.bits(value)) / (len(value) + 1))] += 1
        if counts:
            columns = [pa.array(c) for c in zip(*((*key, n) for key, n in counts.items()))]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "class", "credential", "score", "n"])

    some = values.mapInArrow(run, "kind string, class string, credential boolean, score long, n long")
    return some.groupBy("kind", "class", "credential", "score").agg(F.sum("n")).collect()


def fit(docs: DataFrame) -> Formats:
    """Infer the formats from the labelled credentials and the other tokens of all documents.

    All different credentials of each kind, and all different other tokens, are one table in the shared folder. Spark counts them for each round of the inference and
    for the scores to reach; only sums, by states and symbols or by scores, reach the driver. Tables without
    credentials give no formats, so nothing is added; null and empty texts have none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("secrets")
        seen = set()
        for batch in slices(batches):
            own, tokens = set(), set()
            for text in batch.column(0).to_pylist():
                if text:
                    credentials, others = marked(text)
                    own.update(credentials)
                    tokens |= others
            new = tokens.difference(seen)
            if len(seen) > VERDICTS:
                seen.clear()
            seen.update(t for t in new if len(t) <= KEPT)
            rows = [*own, *((ordinary(t), t) for t in new)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["kind", "value"])

    return Formats.learned(materialize(docs.select("text").mapInArrow(run, "kind string, value string").distinct(), "credentials"))


def all_spans(text: str, formats: Formats) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those of the inferred formats (kind "format")."""
    base = base_spans(text)
    secrets = formats.secrets(set(TOKEN.findall(text)))
    if not secrets:
        return base, base
    more = [(a, b, "format") for a, b, token, _ in candidates(text, base) if token in secrets]
    return base, sorted(base + more, key=lambda s: (s[0], (*KINDS, "format").index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """One row per document row: counts of each kind, digest of the base spans, all spans.

    Null and empty texts have none. Spans count code points, ends exclusive, of the whole text however long; of spans
    that start together the kinds come in their order. Repeated rows and ids each get a row, null ids too; an empty
    table gives an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("secrets")
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, spans = all_spans(text or "", shared.value)
                kinds = [s[2] for s in base]
                out.append((doc_id, *map(kinds.count, KINDS), sum(s[2] == "format" for s in spans), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")


def redact(docs: DataFrame, formats: Formats, mark: str = "[secret]") -> DataFrame:
    """The documents with each secret replaced by a mark, and n_chars counted again if there is such a column.

    Overlapping spans become one mark. Documents without a secret are unchanged, null and empty texts stay as they are;
    no row goes, whatever its ids, and every other column stays as it was; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for a, b, _ in all_spans(text, shared.value)[1]:
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("secrets")
        for batch in slices(batches):
            old = batch.column(at).to_pylist()
            new = [clean(t) for t in old]
            batch = with_column(batch, "text", pa.array(new, batch.column(at).type))
            if "n_chars" in batch.schema.names:
                was = batch.column(batch.schema.get_field_index("n_chars"))
                batch = with_column(batch, "n_chars", pa.array([len(b) if a != b else n for a, b, n in zip(old, new, was.to_pylist())], was.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3_secret_scan: all `documents`, with formats inferred from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, fit(docs))
