"""A trie of conversations' beginnings: which turns they share, how many continue each, and what sharing saves.

A beginning of d turns is named by a key: 128 bits summed over its turns' own hashes, in which each turn's place counts, so
a running sum gives all the keys of a conversation. Every partition of conversations combines its rows to a table of nodes,
a partial trie; rounds of merges by key add up members of more and more partitions' tables. Lists of the conversations
that end at a node are kept in pieces by ranges of ids, which are joined in order only inside the running hash. Totals of
subtrees go up by doubling: a node hands its total to the ancestor 1, 2, 4, ... levels above, so a trie of depth d takes
log2(d) rounds. Only nodes with several members take part: below a node with one member there is one path and nothing is saved.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import scan
from .common import materialize

ROOT = "root"
#: First turns that conversations share with their block's first one: at most HEADS - 1; conversations of a block.
HEADS, BLOCK = 6, 100
#: Ids of a piece of an end list at most; partial tries that a merge takes together.
PIECE, FAN = 4096, 32
#: Turns of a slice of a conversation: a long one is numbered and summed up in as many tasks as it has slices.
SLICE = 1000
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, k, content, chars): each turn's place from 1, a hash of its role and text, and its text's code points.

    In order of turn, null first; turns of one number by role, the text's first 64 code points and its hash, so that the
    shuffle moves hashes, not texts.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("content"), F.length(text).cast("long").alias("chars"),
    )
    rows = scan(materialize(rows, "turns"), ["conv"], ["turn", "role", "head", "content"], F.floor(F.col("turn") / SLICE), {"k": F.lit(1).cast("long")})
    return materialize(rows.select("conv", "k", "content", "chars"), "turns")


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv, d, content, chars, last) of the rebuilt conversations of turns(): a row for each turn and one with d 0.

    The first h turns are those of the block's first conversation (as many as there are), the rest the conversation's own after its first h.
    """
    convs = rows.groupBy("conv").agg(F.max("k").alias("n")).withColumns({"h": F.crc32(F.col("conv").cast("string")) % HEADS, "base": F.col("conv") - F.col("conv") % BLOCK})
    convs = materialize(convs, "conversations")
    bases = convs.where(F.col("conv") % BLOCK == 0).select(F.col("conv").alias("base"), F.col("n").alias("m"))
    convs = convs.join(bases, "base", "left").withColumn("b", F.least("h", F.coalesce("m", F.lit(0))))
    convs = materialize(convs.select("conv", "base", "h", "b", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    heads = rows.where((F.col("conv") % BLOCK == 0) & (F.col("k") < HEADS)).select(F.col("conv").alias("base"), "k", "content", "chars")
    last = F.col("d") == F.col("length")
    top = convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit("").alias("content"), F.lit(0).cast("long").alias("chars"), (F.col("length") == 0).alias("last"))
    shared = convs.join(heads, "base").where("k <= h").select("conv", F.col("k").alias("d"), "content", "chars", "length")
    own = rows.join(convs, "conv").where("k > h").select("conv", (F.col("b") + F.col("k") - F.col("h")).alias("d"), "content", "chars", "length")
    return top.union(shared.union(own).select("conv", "d", "content", "chars", last.alias("last")))


def paths(rows: DataFrame) -> DataFrame:
    """rebuilt(), a written table, with the key of each beginning and of the one before (null for the root)."""
    halves = {}
    for seed in (1, 2):
        hashed = F.xxhash64(F.lit(seed), "d", "content")
        halves |= {f"a{seed}": F.shiftrightunsigned(hashed, 32), f"b{seed}": hashed.bitwiseAND(0xFFFFFFFF)}
    rows = scan(rows, ["conv"], ["d"], F.floor(F.col("d") / SLICE), {f"sum_{n}": h for n, h in halves.items()})

    def key(d, sums):
        return F.when(d == 0, ROOT).otherwise(F.md5(F.concat_ws(",", d.cast("string"), *[s.cast("string") for s in sums])))

    own = key(F.col("d"), [F.col(f"sum_{n}") for n in halves])
    parent = F.when(F.col("d") > 0, key(F.col("d") - 1, [F.col(f"sum_{n}") - h for n, h in halves.items()]))
    return rows.select("conv", "d", "chars", "last", own.alias("key"), parent.alias("parent"))


def merged(rows: DataFrame, partitions: int) -> DataFrame:
    """Nodes (key, parent, conv, d, n, chars) of paths(): partial tries of the partitions, merged FAN at a time."""
    part = F.pmod(F.xxhash64("conv"), F.lit(partitions))
    tables = rows.withColumns({"part": part, "n": F.lit(1).cast("long")})
    parts = partitions
    while True:
        tables = tables.groupBy("key", "part").agg(F.min("parent").alias("parent"), F.min("conv").alias("conv"), F.min("d").alias("d"), F.sum("n").alias("n"), F.min("chars").alias("chars"))
        if parts == 1:
            return materialize(tables.drop("part"), "trie")
        parts = math.ceil(parts / FAN)
        tables = tables.withColumn("part", F.floor(F.col("part") / FAN) if parts > 1 else F.lit(0).cast("long"))


def end_lists(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes at which conversations end: the hash of their ids, ascending, joined by commas."""
    ends = rows.where("last").select("key", "conv", F.floor(F.col("conv") / PIECE).alias("piece"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = materialize(ends.groupBy("key", "piece").agg(joined.alias("ids")), "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            keys, shas = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        shas.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(shas, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(run, "key string, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(key, n_leaves, saved) of the nodes of merged() with several members: totals over their subtrees.

    A round adds to each node the totals of its descendants 1, 2, 4, ... levels below, until no node has such an ancestor.
    """
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("alone"))
    shared = nodes.where("n > 1").join(children, "key", "left")
    own = F.when(F.col("n_children").isNull(), 1).otherwise(F.col("alone")).cast("long")
    rows = materialize(shared.select("key", F.col("parent").alias("up"), own.alias("n_leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved")), "rollup")
    while rows.where("up is not null").limit(1).count():
        below = rows.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        above = rows.select(F.col("key").alias("up"), F.col("up").alias("next"))
        more = rows.join(materialize(below, "below"), "key", "left").join(above, "up", "left")
        rows = materialize(more.select("key", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "rollup")
    return rows.select("key", "n_leaves", "saved")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id are left out; a null turn comes first, a null role or text is empty; turns of one number are ordered by role,
    beginning and hash of their text, and repeated rows are turns of their own. Other columns are ignored. A conversation whose block
    has no first one and that has no turns after its own first h has none: it is a member of the root alone. An empty table gives an empty one.
    """
    spark = conversations.sparkSession
    rows = materialize(paths(materialize(rebuilt(turns(conversations)), "rebuilt")), "paths")
    nodes = merged(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    of_nodes = nodes.select("key", "parent", "conv", "d", "n", *none("long", "n_children", "n_leaves", "saved"), *none("string", "ends_sha256"))
    of_parents = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    facts = of_nodes.unionByName(of_parents, True).unionByName(rolled_up(nodes), True).unionByName(end_lists(rows), True)
    # a key has at most four rows, so no join by key is needed
    full = facts.groupBy("key").agg(*[F.max(c).alias(c) for c in facts.columns if c != "key"])
    full = materialize(full, "nodes")
    parents = nodes.where("n > 1 or parent is null").select(F.col("key").alias("parent"), F.col("conv").alias("above"))
    # below a node with one member its only child has the same one
    parent = F.when(F.col("d") > 0, F.coalesce("above", "conv"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return full.join(parents, "parent", "left").select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), zero("n_children").alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), zero("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op11_conversation_prefix_trie: all `conversations`."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda s, i: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end)), 4294967295)"""
ORACLE = f"""
with t as (
  select conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) k
  from conversations where conv_id is not null
), c as (
  select conv_id, count(*) n, {_CRC} % 6 h, conv_id - conv_id % 100 base from t group by conv_id
), b as (
  select c.*, least(c.h, coalesce(o.n, 0)) b from c left join c o on o.conv_id = c.base
), p as (
  select conv_id, 0 d, '' r, '' x from b
  union all select b.conv_id, k, r, x from b join t on t.conv_id = b.base and k <= h
  union all select b.conv_id, b.b + k - h, r, x from b join t on t.conv_id = b.conv_id and k > h
), q as (
  select conv_id, d, length(x) chars, md5(list(md5(r || chr(1) || x)) over (partition by conv_id order by d)::varchar) key,
    d = max(d) over (partition by conv_id) ends from p
), e as (
  select *, lag(key) over (partition by conv_id order by d) parent from q
), nodes as (
  select key, d, min(conv_id) conv_id, count(*) n, any_value(chars) chars, any_value(parent) parent,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') ids from e group by key, d
), kids as (
  select parent, count(*) n from nodes where parent is not null group by parent
), under as (
  select distinct a.key top, z.key from e a join e z on z.conv_id = a.conv_id and z.d >= a.d
), totals as (
  select top, count(*) filter (kids.n is null) leaves, sum((nodes.n - 1) * chars) saved from under join nodes using (key) left join kids on kids.parent = nodes.key group by top
)
select nodes.conv_id, nodes.d::bigint as depth, up.conv_id parent_conv_id, nodes.n::bigint n_convs, coalesce(kids.n, 0)::bigint n_children, leaves::bigint n_leaves, saved::bigint saved_tokens, sha256(nodes.ids) ends_sha256
from nodes join totals on top = nodes.key left join kids on kids.parent = nodes.key left join nodes up on up.key = nodes.parent
"""
