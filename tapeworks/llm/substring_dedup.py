"""Substring dedup: MinHash banding over paragraphs, exact Jaccard, components; anchors for passages inside paragraphs.

Paragraphs are lines (neighbouring ones shorter than a shingle are one). Different paragraphs meet if one of their
MinHash bands agrees, and are linked if the Jaccard similarity of their five-word shingles is high enough; of each
component the first paragraph stays.

A passage that is pasted into a line, or into several, is no paragraph of its own. So paragraphs are also cut into chunks where
the text itself says so: at a word whose hash is the least of its neighbourhood. Chunks that occur twice or more are
anchors; runs of them are extended word by word to both sides, into the chunk beyond, as far as another occurrence
of the anchor has the same words. Of equal chunks the first stays. Runs and near paragraphs that touch are one passage.

Words, chunks and shingles are compared by hashes (64 bits; 32 for the shingles' sets).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import compare, deal
from .common import materialize, numbered, private, with_column
from .common import slices as small
from .components import components
from .words import WORD_BYTES, encode, kgrams, mix, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of two MinHash values each: paragraphs of similarity 0.8 share one with probability 0.994.
BANDS = 5
#: A chunk begins at the least word hash of this many words to both sides, so it has about twice as many words.
REACH = 6
#: Words of the shortest passage that is reported; the query reports those that the corpus should not repeat.
LEAST_WORDS, QUERY_WORDS = 10, 50
#: Rows of a lookup table of hashes or ids that is sent to every task; a longer one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Words that may differ between pieces of one passage: a changed word, or two.
GAP = 2
CHUNK, PARAGRAPH = 0, 1

_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ONE = np.uint64(1)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """common.slices, after each of which what Arrow has freed goes back to the system: two workers and their JVM share an executor's memory."""
    for batch in small(batches, rows):
        yield batch
        pa.default_memory_pool().release_unused()


class Words:
    """Words of some texts as arrays: hash, text, number of the line block, code points of both ends."""

    def __init__(self, texts: list[str | None], shingle: int = SHINGLE):
        raw = [encode(t) for t in texts]
        flat = b"\n".join(raw)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        begins = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        plain = flat.translate(WORD_BYTES)
        byte = np.frombuffer(flat, np.uint8)
        inside = np.concatenate(([False], np.frombuffer(plain, np.uint8) != 32, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        self.h = word_hashes(plain.split())
        self.text = np.searchsorted(begins, starts, "right") - 1
        line = np.concatenate(([0], np.cumsum(byte == 10)))[starts] if len(starts) else starts
        self.block = self._blocks(line, self.text, shingle)
        #: the first word of each text
        self.base = np.searchsorted(self.text, np.arange(len(texts)))
        point = np.concatenate(([0], np.cumsum((byte & 0xC0) != 0x80)))
        zero = point[begins[self.text]] if len(starts) else starts
        self.start, self.end = point[starts] - zero, point[ends] - zero

    @staticmethod
    def _blocks(line: np.ndarray, owner: np.ndarray, shingle: int) -> np.ndarray:
        """Numbers of the words' lines, where neighbouring lines of fewer than `shingle` words in a text have one."""
        n = len(line)
        if not n:
            return line
        head = np.concatenate(([True], line[1:] != line[:-1]))
        at = np.flatnonzero(head)
        short = np.diff(np.append(at, n)) < shingle
        new = np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))
        new[1:] |= ~(short[1:] & short[:-1])
        return np.repeat(np.cumsum(new), np.diff(np.append(at, n)))

    def cuts(self, shingle: int, reach: int) -> np.ndarray:
        """Whether a chunk begins at each word: at a block's first, and at local minima away from the block's ends."""
        h, line, n = self.h, self.block, len(self.h)
        head = np.ones(n, bool)
        head[1:] = line[1:] != line[:-1]
        if not n:
            return head
        pair = h.copy()
        pair[:-1] = np.where(line[1:] == line[:-1], mix(h[:-1] + (h[1:] << _ONE)), h[:-1])
        low = np.ones(n, bool)
        for d in range(1, min(reach, n - 1) + 1):
            same = line[d:] == line[:-d]
            low[:-d] &= ~same | (pair[:-d] < pair[d:])
            low[d:] &= ~same | (pair[d:] < pair[:-d])
        at = np.flatnonzero(head)
        begin = np.repeat(at, np.diff(np.append(at, n)))
        end = np.repeat(np.append(at[1:], n), np.diff(np.append(at, n)))
        i = np.arange(n)
        return head | low & (i - begin >= shingle) & (end - i >= shingle)


class Units:
    """Runs of words: text, number in it, range of words, content hash, number of the block in the text."""

    def __init__(self, words: Words, cut: np.ndarray, least: int = 1):
        h, n = words.h, len(words.h)
        first = np.flatnonzero(cut)
        last = np.append(first[1:], n)
        if n:
            place = (np.arange(n) - np.repeat(first, last - first)).astype(np.uint64)
            sums = np.add.reduceat(mix(h ^ mix(place + _ONE)), first)
            content = mix(sums ^ (last - first).astype(np.uint64)).view(np.int64)
        else:
            content = np.empty(0, np.int64)
        keep = last - first >= least if n else np.empty(0, bool)
        self.words, self.first, self.last, self.content = words, first[:n][keep], last[:n][keep], content[keep]
        self.text = words.text[self.first]
        # the words' ranges and numbers inside their texts
        self.at = self.first - words.base[self.text]
        self.number = np.arange(len(self.first)) - np.searchsorted(self.text, self.text)
        self.block = words.block[self.first] - words.block[words.base[self.text]] if n else self.first

    def columns(self) -> list[np.ndarray]:
        w = self.words
        return [self.block.astype(np.int32), self.at.astype(np.int32), (self.last - self.first).astype(np.int32), w.start[self.first], w.end[self.last - 1], self.content]


class Paragraphs(Units):
    """The paragraphs of at least a shingle's words, with the hashes of all shingles."""

    def __init__(self, texts: list[str | None] | Words, shingle: int = SHINGLE):
        words = texts if isinstance(texts, Words) else Words(texts, shingle)
        head = np.ones(len(words.h), bool)
        head[1:] = words.block[1:] != words.block[:-1]
        super().__init__(words, head, shingle)
        self.shingle, self.kgrams = shingle, kgrams(words.h, shingle)

    def bands(self, bands: int) -> list[np.ndarray]:
        """Hashes of two least shingle hashes of each paragraph, under other hash functions in every band."""
        if not len(self.first):
            return [np.empty(0, np.int64)] * bands
        at = np.stack([self.first, self.last - self.shingle + 1], axis=1).ravel()
        grams = np.append(self.kgrams, np.uint64(0))
        low = [np.minimum.reduceat(mix(grams ^ _SEEDS[k]), at)[::2] for k in range(2 * bands)]
        return [mix(mix(low[2 * k] + _SEEDS[k]) ^ low[2 * k + 1]).view(np.int64) for k in range(bands)]

    def shingles(self, i: int) -> bytes:
        own = self.kgrams[self.first[i] : self.last[i] - self.shingle + 1]
        return np.unique((own >> np.uint64(32)).astype("<u4")).tobytes()


def _units(rows: DataFrame, shingle: int, bands: int, reach: int) -> DataFrame:
    """A row for each chunk and each paragraph of rows (n, doc_id, text), a written table.

    number counts a text's chunks, block its paragraphs; at is the first word; before and after are the words of the
    neighbouring chunks; paragraphs have the keys k0.. of their bands.
    """
    keys = [f"k{k}" for k in range(bands)]
    names = ["n", "doc_id", "level", "number", "before", "after", "block", "at", "n_words", "start", "end", "content", *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column(2).to_pylist(), shingle)
            if not len(words.h):
                continue
            c, p = Units(words, words.cuts(shingle, reach)), Paragraphs(words, shingle)
            size, same = c.last - c.first, c.text[1:] == c.text[:-1]
            before, after = np.zeros(len(size), np.int32), np.zeros(len(size), np.int32)
            before[1:], after[:-1] = np.where(same, size[:-1], 0), np.where(same, size[1:], 0)
            for level, u, own in ((CHUNK, c, [c.number.astype(np.int32), before, after]), (PARAGRAPH, p, [np.zeros(len(p.first), np.int32)] * 3)):
                count = len(u.first)
                if count:
                    ids = [batch.column(k).take(pa.array(u.text)) for k in (0, 1)]
                    mins = p.bands(bands) if level else [pa.nulls(count, pa.int64())] * bands
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(np.full(count, level, np.int8)), *map(pa.array, own), *map(pa.array, u.columns()), *(pa.array(m) if level else m for m in mins)], names)

    schema = "n long, doc_id long, level tinyint, number int, before int, after int, block int, at int, n_words int, start long, end long, content long"
    return rows.select("n", "doc_id", "text").mapInArrow(run, schema + "".join(f", {k} long" for k in keys))


def _bounded(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few enough rows; df is a written table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _near(rows: DataFrame, paras: DataFrame, similarity: float, shingle: int, bands: int, cell_rows: int) -> DataFrame:
    """(content, cluster): the paragraph contents that are similar to others, and the least one that each is connected to."""
    keyed = paras.select("n", "content", F.explode(F.array(*[F.xxhash64(F.lit(k), f"k{k}") for k in range(bands)])).alias("key"))
    meet = materialize(keyed.groupBy("key").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo < hi").select("key"), "meet")
    met = materialize(keyed.join(_bounded(meet), "key").groupBy("key", "content").agg(F.min("n").alias("n")), "met")
    which = _bounded(materialize(met.select("n").distinct(), "which"))
    wanted = _bounded(materialize(met.select("content").distinct(), "wanted"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = Paragraphs(batch.column(1).to_pylist(), shingle)
            if len(p.first):
                yield pa.RecordBatch.from_arrays([pa.array(p.content), pa.array([p.shingles(i) for i in range(len(p.first))], pa.binary())], ["content", "sh"])

    texts = rows.select("n", "text").join(which, "n", "left_semi").mapInArrow(shingles, "content long, sh binary")
    # the values of a content hash are equal, so any will do
    sets = materialize(texts.join(wanted, "content", "left_semi").groupBy("content").agg(F.first("sh").alias("sh")), "shingles")
    dealt = deal(met.select("key", "content"), "key", "content", cell_rows).join(sets, "content")

    def check(table: pa.Table):
        sh = [frozenset(np.frombuffer(x, "<u4").tolist()) for x in table.column(0).to_pylist()]

        def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            both = np.fromiter((len(sh[a] & sh[b]) for a, b in zip(i.tolist(), j.tolist())), np.int64, len(i))
            size = np.fromiter((len(sh[a]) + len(sh[b]) for a, b in zip(i.tolist(), j.tolist())), np.int64, len(i))
            return both >= similarity * (size - both)

        return linked

    found = components(compare(dealt, ["sh"], check, "content"))
    return materialize(found.select(F.col("node").alias("content"), F.col("component").alias("cluster")), "near")


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, cell_rows: int = 2000) -> DataFrame:
    """(doc_id, block, start, end, n_words, cluster): all paragraphs that two documents or more share, as they are or nearly.

    Null and short texts have none; rows with a null doc_id are left out; an empty table gives an empty one.
    """
    rows = numbered(docs.where("doc_id is not null").select("doc_id", "text"), "n")
    paras = materialize(_units(rows, shingle, bands, REACH).where(F.col("level") == PARAGRAPH), "paragraphs")
    near = _near(rows, paras, similarity, shingle, bands, cell_rows)
    kinds = materialize(paras.groupBy("content").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "kinds")
    named = materialize(kinds.join(near, "content", "left").withColumn("cluster", F.coalesce("cluster", "content")), "named")
    shared = materialize(named.groupBy("cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("cluster"), "shared")
    table = _bounded(materialize(named.join(shared, "cluster").select("content", "cluster"), "clusters"))
    return paras.join(table, "content").select("doc_id", "block", "start", "end", "n_words", "cluster")


def _removed(keep: str) -> Column:
    """Whether a row isn't the one that stays; rows that repeat its doc_id count as the same document."""
    k = F.col(keep)
    here = k["n"] == F.col("n")
    return ~k["gone"] & ~(here & (k["number"] == F.col("number"))) & (here | (k["doc_id"] != F.col("doc_id")))


PIECE = ["n", "doc_id", "at", "n_words", "start", "end", "cluster", "first_doc_id", "removed"]


def _near_pieces(rows: DataFrame, paras: DataFrame, *options) -> DataFrame:
    near = _near(rows, paras, *options)
    close = materialize(paras.join(_bounded(near), "content").withColumn("number", F.col("block")).drop("before", "after"), "close")
    keep = close.groupBy("cluster").agg(F.min(F.struct(F.lit(False).alias("gone"), "doc_id", "n", "number")).alias("keep"))
    out = close.join(_bounded(materialize(keep, "keep")), "cluster")
    return materialize(out.select(*PIECE[:7], F.col("keep.doc_id").alias("first_doc_id"), _removed("keep").alias("removed"), "block"), "near")


def _anchors(chunks: DataFrame, near: DataFrame) -> DataFrame:
    """The chunks that occur twice or more, and which of the occurrences stays: one whose paragraph isn't removed, if any."""
    repeated = materialize(chunks.groupBy("content").count().where("count > 1").select("content"), "repeated")
    gone = materialize(near.where("removed").select("n", "block", F.lit(True).alias("gone")).distinct(), "gone")
    found = chunks.join(_bounded(repeated), "content").join(_bounded(gone), ["n", "block"], "left")
    found = materialize(found.withColumn("gone", F.coalesce("gone", F.lit(False))), "anchors")
    keep = found.groupBy("content").agg(F.min(F.struct("gone", "doc_id", "n", "number")).alias("keep"))
    return found.join(_bounded(materialize(keep, "keep")), "content")


def _edges(rows: DataFrame, anchors: DataFrame, near: DataFrame, least_words: int) -> DataFrame:
    """Pieces of the chunks before and after the runs of anchors: as many words as another occurrence of the run's outer chunk has."""
    run = F.col("number") - F.row_number().over(Window.partitionBy("n").orderBy("number"))
    own = Window.partitionBy("n", "run")
    inner = own.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reach = F.sum("n_words").over(own) + F.first("before").over(inner) + F.last("after").over(inner)
    # an occurrence that shares a long passage with another has a run that reaches as far, so others can't have the same edges
    of_run = {"reach": reach, "first": F.first("number").over(inner), "last": F.last("number").over(inner), "prev": F.lag("content").over(own.orderBy("number")), "next": F.lead("content").over(own.orderBy("number"))}
    able = anchors.withColumn("run", run).withColumns(of_run).where(F.col("reach") >= least_words)
    able = materialize(able.select("n", "doc_id", "number", "at", "n_words", "before", "after", "start", "end", "content", "first", "last", "prev", "next"), "able")

    def side(which: int, end: str, beside: str, room: str, at: Column, point: str) -> DataFrame:
        """Chunks that begin (or end) some run, wherever they occur; inside runs one occurrence for each chunk beside it will do."""
        ends = materialize(able.where((F.col("number") == F.col(end)) & (F.col(room) > 0)).select("content").distinct(), "ends")
        rows = able.where(F.col(room) > 0).join(_bounded(ends), "content")
        e = F.struct("doc_id", "n", "number", F.lit(which).alias("side"), at.alias("at"), F.col(room).alias("room"), "content", F.col(point).alias("point"))
        inside = rows.where(F.col(beside).isNotNull()).groupBy("content", beside).agg(F.min(e).alias("e")).select("e")
        return rows.where(F.col(beside).isNull()).select(e.alias("e")).union(inside).select("e.n", "e.doc_id", "e")

    a = side(0, "first", "prev", "before", F.col("at"), "start")
    z = side(1, "last", "next", "after", F.col("at") + F.col("n_words"), "end")
    # the edges of one text
    wanted = materialize(a.union(z).groupBy("n", "doc_id").agg(F.collect_list("e").alias("edges")), "wanted")
    names = ["n", "doc_id", "number", "side", "at", "point", "content", "words", "far", "hash"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            w = Words(batch.column(2).to_pylist())
            lists = batch.column(3)
            text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            e = {f.name: lists.flatten().field(i).to_numpy() for i, f in enumerate(lists.type.value_type)}
            room = e["room"].astype(np.int64)
            own = np.repeat(np.arange(len(room)), room)
            step = np.arange(len(own)) - np.repeat(np.cumsum(room) - room, room)
            after = e["side"][own] == 1
            word = w.base[text[own]] + np.where(after, e["at"][own] + step, e["at"][own] - 1 - step)
            # hashes of the words so far, from sums that start anew at every edge
            count = (step + 1).astype(np.uint64)
            sums = np.cumsum(mix(w.h[word] ^ mix(count)))
            sums = sums - np.repeat(np.concatenate((np.zeros(1, np.uint64), sums))[np.cumsum(room) - room], room)
            value = mix(sums ^ mix(e["content"].view(np.uint64)[own] + (count << _ONE) + after.astype(np.uint64)))
            far = np.where(after, w.end[word], w.start[word])
            ids = [batch.column(k).take(pa.array(text[own])) for k in (0, 1)]
            cols = [e[k][own] for k in ("number", "side", "at", "point", "content")]
            yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, cols), pa.array(step + 1), pa.array(far), pa.array(value.view(np.int64))], names)

    schema = "n long, doc_id long, number int, side int, at int, point long, content long, words long, far long, hash long"
    steps = materialize(rows.select("n", "text").join(wanted, "n").select("n", "doc_id", "text", "edges").mapInArrow(walk, schema), "steps")
    touched = materialize(near.where("removed").select("n", F.lit(True).alias("gone")).distinct(), "touched")
    steps = steps.join(_bounded(touched), "n", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    agree = steps.groupBy("hash").agg(F.count("*").alias("c"), F.min(F.struct("gone", "doc_id", "n", "number")).alias("keep")).where("c > 1").drop("c")
    best = steps.join(agree, "hash").groupBy("n", "doc_id", "number", "side", "at", "point", "content").agg(F.max("words").cast("int").alias("n_words"), F.max_by(F.struct("far", "keep"), "words").alias("b"))
    best = best.withColumn("keep", F.col("b.keep")).withColumn("far", F.col("b.far"))
    before = F.col("side") == 0
    return best.select(
        "n", "doc_id", F.when(before, F.col("at") - F.col("n_words")).otherwise(F.col("at")).alias("at"), "n_words", F.least("point", "far").alias("start"), F.greatest("point", "far").alias("end"),
        F.col("content").alias("cluster"), F.col("keep.doc_id").alias("first_doc_id"), _removed("keep").alias("removed"),
    )


def _joined(pieces: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number the groups of pieces of a text whose words overlap or follow each other, but for GAP words."""
    order = Window.partitionBy(*keys).orderBy("at", "n_words")
    reach = F.max(F.col("at") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return pieces.withColumn("_new", F.coalesce((F.col("at") > reach + GAP).cast("int"), F.lit(1))).withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _passages(rows: DataFrame, least_words: int, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, reach: int = REACH, cell_rows: int = 2000) -> DataFrame:
    """passages() of rows (n, doc_id, text), a written table with a different n in each row and no null ids."""
    units = materialize(_units(rows, shingle, bands, reach), "units")
    near = _near_pieces(rows, units.where(F.col("level") == PARAGRAPH), similarity, shingle, bands, cell_rows)
    anchors = materialize(_anchors(units.where(F.col("level") == CHUNK), near), "kept")
    edges = _edges(rows, anchors, near, least_words)
    runs = anchors.select(*PIECE[:6], F.col("content").alias("cluster"), F.col("keep.doc_id").alias("first_doc_id"), _removed("keep").alias("removed"))
    pieces = _joined(runs.union(near.select(*PIECE)).union(edges.select(*PIECE)), ["n"], "isle")
    whole = Window.partitionBy("n", "isle")
    words = F.max(F.col("at") + F.col("n_words")).over(whole) - F.min("at").over(whole)
    long = _joined(pieces.withColumn("words", words).where(F.col("words") >= least_words), ["n", "isle", "removed"], "cut")
    cuts = long.groupBy("n", "doc_id", "isle", "words", "removed", "cut").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"), F.collect_set("cluster").alias("clusters"))
    return cuts.groupBy("n", "doc_id", "isle", "words").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"), F.max("removed").alias("removed"),
        F.array_sort(F.collect_list(F.when(F.col("removed"), F.struct("start", "end")))).alias("cuts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("clusters")))).alias("clusters"),
    ).select("doc_id", "start", "end", F.col("words").cast("long").alias("n_words"), "first_doc_id", "removed", "cuts", "clusters")


def passages(docs: DataFrame, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id, removed, cuts, clusters): passages that occur twice or more, in one document or several.

    start and end are code points of the text, the end exclusive. cuts are the parts that go because another occurrence
    stays (the first by doc_id, then place, of each chunk or cluster of paragraphs); a passage that has some is `removed`.
    first_doc_id is the least document with an occurrence that stays, clusters are the hashes of the chunks and paragraphs.
    Null and short texts have none, rows with a null doc_id are left out; rows that repeat a doc_id count as one document
    (none loses what another row of the id keeps) but each have their own passages; texts are read whole, however long;
    an empty table gives an empty one; other columns are ignored.
    """
    return _passages(numbered(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "n"), least_words, **options)


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """The documents without the parts of passages that other rows keep, all columns as they were; no row goes.

    Each row is a document of its own here, whatever its doc_id (null or repeated), and of equal chunks and similar paragraphs
    the one in the row that is read first stays. Null and empty texts stay as they are; an empty table gives an empty one.
    """
    row = private(docs, "row")
    rows = numbered(docs, row)
    found = _passages(rows.select(F.col(row).alias("n"), F.col(row).alias("doc_id"), "text"), least_words, **options)
    cuts = materialize(found.where("removed").groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("cuts"))).alias("cuts")), "cuts")
    name, at = private(docs, "cuts"), docs.columns.index("text")
    cuts = cuts.select(F.col("doc_id").alias(row), F.col("cuts").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if text and spans:
                    keep, end = [], 0
                    for s in spans:
                        keep.append(text[end : max(end, s["start"])])
                        end = max(end, s["end"])
                    text = "".join([*keep, text[end:]])
                new.append(text)
            batch = with_column(batch, "text", pa.array(new, batch.column(at).type))
            yield batch.select(batch.schema.names[:-1])

    return rows.join(cuts, row, "left").select(*docs.columns, name).mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1_substring_dedup: the passages of 50 words or more that `documents` repeat."""
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_WORDS)
