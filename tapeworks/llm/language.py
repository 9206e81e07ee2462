"""Language identification, words first.

A word seen in training scores its log frequency in each language; any other word is scored by the
longest character n-grams of it that training has, position by position.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, keeps, materialize, slices
from .words import MEMO_ENTRIES

#: Training documents of each language, about: different texts whose hash is in the share that leaves so many.
DOCS_PER_LANGUAGE = 1500
#: Longest n-gram, and times that a word or n-gram must occur in the sample.
NGRAM, LEAST = 4, 2
UNKNOWN = "und"
#: A word: letters of any script, with the marks (vowel signs, accents) on them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Words that count in full towards the score; longer texts are no surer.
SURE_WORDS = 30


class Model:
    """Log frequencies of words and n-grams in each language (columns in the order of `languages`)."""

    def __init__(self, counts: list[tuple[str, int, str, int]], languages: Iterable[str] = ()):
        """counts: language, length of the n-gram (0: word), item, times. languages: others that were learned from."""
        self.id = uuid.uuid4().hex
        self.languages = sorted({c[0] for c in counts} | set(languages))
        at = {lang: i for i, lang in enumerate(self.languages)}
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        kind, times = [], []
        for lang, n, item, k in counts:
            table = self.grams if n else self.words
            if (row := table.get(item)) is None:
                row = table[item] = len(kind)
                kind.append(n)
            times.append((row, at[lang], k))
        log = np.full((len(kind), len(at)), 0.1)
        if times:
            row, column, k = (np.array(c) for c in zip(*times))
            np.add.at(log, (row, column), k)
        kind = np.array(kind, np.int64)
        for n in range(NGRAM + 1):
            log[kind == n] /= log[kind == n].sum(axis=0)
        self.logs = np.log(log).astype(np.float32)

    def word(self, word: str) -> np.ndarray:
        """Log score of a word in each language."""
        if (known := self.words.get(word)) is not None:
            return self.logs[known]
        rows, marked, find = [], f" {word} ", self.grams.get
        for i in range(len(word) + 1):
            for n in range(min(NGRAM, len(marked) - i), 0, -1):
                if (row := find(marked[i : i + n])) is not None:
                    rows.append(row)
                    break
        return self.logs[rows].mean(axis=0) if rows else np.zeros(len(self.languages), np.float32)


class Scorer:
    """Scores texts; words' scores are kept in a bounded table."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, max(1, len(model.languages))), np.float32)

    def row(self, word: str) -> int:
        i = self.rows[word] = len(self.rows)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[i] = self.model.word(word)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text else []
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        if len(self.rows) > MEMO_ENTRIES:
            self.rows.clear()
        rows = self.rows
        for w in {w for w in words if w not in rows}:
            self.row(w)
        at = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
        mean = self.table[at].mean(axis=0, dtype=np.float64)
        best = int(mean.argmax())
        return self.model.languages[best], 1 / float(np.exp((mean - mean[best]) * min(len(words), SURE_WORDS)).sum())


_scorers: dict[str, Scorer] = {}
keeps("language", _scorers.clear)


def scorer(model: Model) -> Scorer:
    claim("language")
    if model.id not in _scorers:
        _scorers.clear()
        _scorers[model.id] = Scorer(model)
    return _scorers[model.id]


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of the id's text, modulo 5, is 0 (null ids are not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learn from (text, lang) rows; rows with a null text or language are left out.

    Of a language with more than docs_per_language rows, the texts whose hash is in the share that leaves about so many
    are taken, whole; a text counts once, however many copies there are. Words and n-grams that occur once in a
    language's sample are not kept, but the language is. An empty table gives a model that says und.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", "text")
    sizes = rows.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return Model([])
    share = F.coalesce(*[F.when(F.col("lang") == r[0], F.lit(min(1.0, docs_per_language / r[1]))) for r in sizes])
    taken = rows.where((F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            for lang, own in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["lang", "item", "times"])

    words = taken.mapInArrow(run, "lang string, item string, times long").groupBy("lang", "item").agg(F.sum("times").alias("times"))
    words = materialize(words, "words")
    # the n-grams of the distinct words, as often as the words occur
    marked = words.select("lang", F.concat(F.lit(" "), "item", F.lit(" ")).alias("m"), "times")
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.lit(NGRAM), F.length("m")))).alias("n")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.length("m") - F.col("n") + 1), lambda i: F.substr("m", i, F.col("n")))).alias("item")
    grams = marked.select("lang", "m", lengths, "times").select("lang", "n", cut, "times").groupBy("lang", "n", "item").agg(F.sum("times").alias("times"))
    counted = words.select("lang", F.lit(0).alias("n"), "item", "times").union(grams).where(F.col("times") >= LEAST)
    return Model([tuple(r) for r in counted.collect()], [r[0] for r in sizes])  # bounded by the sample


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document row from its whole text; und for null texts and those without letters.

    The score is the probability of the predicted language among those learned. Ties go to the language first
    in order. Repeated rows and ids each get a row, null ids too; texts are read whole, however long; an empty table gives
    an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(shared.value)
        for batch in slices(batches):
            lang, score = zip(*map(s.predict, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents with a predicted language and a score of `least` or more, all columns as they were.

    Each row is judged by its own whole text, whatever its ids; null, empty and letterless texts go; ties of two languages
    have a score of 0.5 and stay at the default. An empty table gives an empty one, and so does a model that has learned nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(shared.value)
        for batch in slices(batches):
            said = map(s.predict, batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in said], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7_language_id: all `documents`, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
