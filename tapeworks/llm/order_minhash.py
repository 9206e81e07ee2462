"""Order MinHash document fingerprints: minimal numbered k-mers in text order, by DataFrame functions only.

A text's k-mers are its runs of `k` words, each numbered by its occurrence in the text, so (k-mer, number) is different
for every position. A hash deals them out to `width` circles and puts them on the circle. Sketch i takes from each circle the
numbered k-mer that follows point i of `sketches` equally spaced points: the minimal one under the order that starts there.
They are put back into text order and hashed as a tuple, so a sketch is equal in two texts if they share these k-mers
and their order. The share of equal sketches is the texts' likeness; it falls with both changed words and moved ones.

The documents are dealt into ranges of their order, so that a document and the next one meet in a task; the first of a
range is copied to the range before. Words, k-mers, their numbers and the selection all stay in that one shuffle's partitions:
sorts and aggregates that spill, not arrays, hold the k-mers of long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Words of a k-mer, k-mers of a sketch, sketches of a fingerprint (the last two powers of two).
K, WIDTH, SKETCHES = 5, 2, 64
#: Code points of text that a task takes, about: its k-mers are sorted in the task's memory (50 bytes for a word).
TASK_CHARS = 4_000_000
#: Ranges for a task.
RANGES = 4


def order_of(doc_id: str, text: Column) -> Column:
    """Ascending in this struct is descending in doc_id, nulls last; equal ids by a hash of their text."""
    known = F.col(doc_id).isNotNull()
    return F.struct((~known).cast("int").alias("none"), F.coalesce(F.bitwise_not(F.col(doc_id)), F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("h"))


def _bounds(keys: DataFrame, ranges: int) -> DataFrame:
    """One row: the least key of each of about `ranges` equal ranges of the written table `keys` (column o), ascending."""
    dealt = keys.repartitionByRange(ranges, "o.none", "o.id", "o.h").groupBy(F.spark_partition_id().alias("p")).agg(F.min("o").alias("o"))
    return dealt.agg(F.sort_array(F.collect_list("o")))  # as many as ranges


def _range(bounds: str, key: str, most: int) -> Column:
    """Index from 0 of the last of the sorted `bounds` that is at most the key, by halving steps."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(most.bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.size(bounds)) & (F.get(F.col(bounds), n + s - 1) <= F.col(key)), n + s).otherwise(n))
    return at - 1


def with_next(docs: DataFrame, task_chars: int = TASK_CHARS) -> DataFrame:
    """(range, place, halo, doc_id, text, next_text) of each document row, in descending order of doc_id within ranges.

    The next of the last one is the first. Rows of equal doc_id follow each other by a hash of their text. halo: the copy
    of the next range's first row, which ends a range. The result is partitioned by range.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("o", order_of("doc_id", F.col("text")))
    keys = materialize(texts.select("o", F.length("text").alias("n")), "keys")
    chars = keys.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // task_chars)
    ranges = RANGES * tasks
    at = texts.withColumn("bounds", _bounds(keys, ranges).scalar())
    at = at.withColumn("range", _range("bounds", "o", ranges))
    first = F.get(F.col("bounds"), F.col("range")) == F.col("o")
    own = F.struct(F.col("range"), F.lit(0).alias("halo"))
    copy = F.struct(F.pmod(F.col("range") - 1, F.size("bounds")).alias("range"), F.lit(1).alias("halo"))
    at = at.select("doc_id", "text", "o", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))).alias("at"))
    at = at.select("doc_id", "text", "o", "at.range", "at.halo").repartition(tasks, "range")
    row = Window.partitionBy("range").orderBy("halo", "o")
    return at.select("range", F.row_number().over(row).alias("place"), "halo", "doc_id", "text", F.lead("text").over(row).alias("next_text"))


def numbered_kmers(texts: DataFrame, text: str, by: list[str], facts: dict[str, Column], k: int) -> DataFrame:
    """A row for each k-mer of each text: pos from 0, value (the k-mer's hash) and number from 1.

    by: columns that name a text, the first of which the table is partitioned by. A text of fewer words, but not none, is one k-mer.
    The long values `facts` of a text are carried along as rows with pos -1, -2 and so on.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    last = F.when(F.size("words") == 0, -1).otherwise(F.greatest(F.size("words") - k, F.lit(0)))
    rows = texts.withColumns({"words": words} | facts).select(*by, *facts, "words", F.explode(F.sequence(F.lit(-len(facts)), last)).alias("pos"))
    value = F.xxhash64(*[F.get("words", F.col("pos") + i) for i in range(k)])
    for i, c in enumerate(facts):
        value = F.when(F.col("pos") == -1 - i, F.col(c)).otherwise(value)
    rows = rows.select(*by, "pos", value.alias("value"))
    # the hash comes first in the sort, for it tells most rows apart
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("value", *reversed(by)).orderBy("pos")))


def selected(kmers: DataFrame, by: list[str], width: int, sketches: int) -> DataFrame:
    """Of numbered_kmers the first of each arc between points of each circle: slot, h and pos; facts have their pos as slot."""
    bits = (width * sketches - 1).bit_length()
    h = F.when(F.col("pos") < 0, F.col("value")).otherwise(F.xxhash64("value", "number"))
    slot = F.when(F.col("pos") < 0, F.col("pos")).otherwise(F.shiftrightunsigned("h", 64 - bits).cast("int"))
    rows = kmers.select(*by, "pos", h.alias("h")).withColumn("slot", slot)
    return rows.groupBy(*by, "slot").agg(F.min("h").alias("h"), F.min_by("pos", "h").alias("pos"))


def sketched(rows: DataFrame, names: list[str], width: int, sketches: int) -> DataFrame:
    """The columns `names`, arrays of the selected (slot, h, pos) of a text, replaced by fingerprints: arrays of ints, zeros for no entry.

    The steps are columns of their own that a later one names twice, so that none is evaluated again for every sketch.
    """
    circle = lambda c, w: f"{c}_{w}"
    every = [(c, w) for c in names for w in range(width)]
    on = lambda w: lambda v: F.shiftright(v["slot"], sketches.bit_length() - 1) == w
    own = {circle(c, w): F.sort_array(F.filter(c, on(w))) for c, w in every}
    rows = rows.withColumns(own).withColumns({circle(c, w): _after_points(F.col(circle(c, w)), w * sketches, sketches) for c, w in every})

    def tuples(c: str) -> Column:
        entries = lambda i: F.filter(F.array(*[F.get(F.col(circle(c, w)), i) for w in range(width)]), lambda v: v.isNotNull())
        one = lambda i: F.xxhash64(F.transform(F.array_sort(entries(i)), lambda v: v["h"])).bitwiseAND(0x7FFFFFFF).cast("int")
        if width == 2:  # the same without a sort
            one = lambda i: _pair(F.get(F.col(circle(c, 0)), i), F.get(F.col(circle(c, 1)), i))
        made = F.transform(F.sequence(F.lit(0), F.lit(sketches - 1)), one)
        return F.when(F.greatest(*[F.size(circle(c, w)) for w in range(width)]) > 0, made).otherwise(F.array_repeat(F.lit(0), sketches))

    return rows.withColumns({c: tuples(c) for c in names}).drop(*[circle(c, w) for c, w in every])


def _pair(a: Column, b: Column) -> Column:
    first = b.isNull() | (a["pos"] < b["pos"])
    return F.xxhash64(F.when(first, a["h"]).otherwise(b["h"]), F.when(first, b["h"]).otherwise(a["h"])).bitwiseAND(0x7FFFFFFF).cast("int")


def _after_points(e: Column, first: int, sketches: int) -> Column:
    """For each point of a circle the first of its sorted entries at or after it, around the circle, as (pos, h); empty if there is none."""
    before = lambda j: F.when(j > 0, F.get(e, j - 1)["slot"]).otherwise(first - 1)
    entry = lambda v: F.struct(v["pos"].alias("pos"), v["h"].alias("h"))
    reached = F.flatten(F.transform(e, lambda v, j: F.array_repeat(entry(v), v["slot"] - before(j))))
    return F.concat(reached, F.array_repeat(entry(F.get(e, F.lit(0))), F.coalesce(first + sketches - 1 - F.get(e, F.size(e) - 1)["slot"], F.lit(0))))


def likeness(a: Column, b: Column, sketches: int) -> Column:
    """The share of equal sketches of two fingerprints."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(sketches))


def digits(fingerprint: Column) -> Column:
    """Eight hexadecimal digits for each sketch."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def fingerprints_with_next(docs: DataFrame, k: int = K, width: int = WIDTH, sketches: int = SKETCHES, task_chars: int = TASK_CHARS) -> DataFrame:
    """One row per document row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points (rounded down) replaced by the first as many, or all, of the next document in
    descending order of doc_id; null ids come last, rows of equal id by a hash of their text, and the first follows the last. Null texts
    are empty; texts without words have a fingerprint of zeros, so they are all alike; texts are read whole, however
    long. Repeated rows and ids each get a row; other columns are ignored; an empty table gives an empty one.
    """
    if min(width, sketches) < 1 or (width & (width - 1)) or (sketches & (sketches - 1)):
        raise ValueError("the numbers of circles and sketches must be powers of two")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    pairs = with_next(docs, task_chars)
    edited = F.when(F.col("halo") == 0, F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    pairs = pairs.withColumn("edited", edited)
    version = lambda odd, body, halo: F.struct((F.col("place") * 2 + odd).alias("version"), F.col(body).alias("body"), F.col("doc_id"), halo.alias("halo"))
    versions = F.array(version(0, "text", F.col("halo")), version(1, "edited", F.lit(0)))
    bodies = pairs.select("range", F.explode(versions).alias("v")).select("range", "v.*").where("body is not null")
    quarter = {f"sha{i}": F.conv(F.substring(F.sha2("body", 256), 1 + 16 * i, 16), 16, -10).cast("long") for i in range(4)}
    facts = {"id": F.col("doc_id"), "copy": F.col("halo").cast("long"), "chars": F.length("body").cast("long")} | quarter
    rows = selected(numbered_kmers(bodies, "body", ["range", "version"], facts, k), ["range", "version"], width, sketches)
    odd = F.col("version") % 2
    entries = lambda at: F.collect_list(F.when((F.col("slot") >= 0) & (odd == at), F.struct("slot", "h", "pos")))
    value = lambda at, name: F.max(F.when((odd == at) & (F.col("slot") == -1 - list(facts).index(name)), F.col("h")))
    docs_of = rows.groupBy("range", F.shiftright("version", 1).alias("place")).agg(
        entries(0).alias("own"), entries(1).alias("changed"), value(0, "id").alias("doc_id"), value(0, "copy").alias("halo"), value(0, "chars").alias("n_chars"), *[value(1, c).alias(c) for c in quarter]
    )
    prints = sketched(docs_of, ["own", "changed"], width, sketches)
    prints = prints.withColumn("after", F.lead("own").over(Window.partitionBy("range").orderBy("place"))).where("halo = 0")
    return prints.select(
        "doc_id", "n_chars", F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in quarter]).alias("edited_sha256"), digits(F.col("own")).alias("fingerprint"), digits(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), sketches).alias("near_edited"), likeness(F.col("own"), F.col("after"), sketches).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op12_document_fingerprints: all `documents`."""
    return fingerprints_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
