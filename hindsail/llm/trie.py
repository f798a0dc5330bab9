"""A prefix trie of conversations, aggregated by ROLLUP over positional turn columns.

A turn is told by 128 bits of its role and text. A conversation's turns stand
in rows of BLOCK columns t1..t8, one row a block of eight turns; longer ones go
on in further blocks, each keyed by the node that the block before ends in. One
`GROUP BY <block, node before>, ROLLUP (t1, ..., t8)` thus aggregates all
prefixes of all lengths together, and grouping_id tells a rolled-up column from
one that a short conversation leaves empty. A node is named by the exclusive or
of 128-bit hashes of its (place, turn) pairs, so all blocks are aggregated in
one job, whatever the longest conversation is.

Sums over subtrees need no walk down the trie. A conversation is the smallest
member of all its prefixes from some depth on, its first own one; every other
node is counted by its smallest member:

- leaves below a node are its members that end in a leaf of their own;
- children of a node are conversations whose first own prefix hangs on it, and
  the node's own smallest member if it goes on;
- what a member shares with smaller ones are the bytes before its first own
  prefix; members' sums of these, less what stands above the node, are the
  bytes that the subtree saves.

So a first ROLLUP finds the smallest member of each node, one row a
conversation tells where its own prefixes begin, and a second one adds up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch
from .turns import numbered, spoken

BLOCK = 8
#: Conversation ids that share all but so many bits are joined to one text before it is hashed.
RUN_BITS = 12
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_ids(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, size) of conversations(conv_id, turn, role, text): a and b are the 128 bits of role and text, size the text's UTF-8 bytes. Rows without conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    plain = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), spoken(role, text).alias("said"), F.octet_length(text).cast("long").alias("size"))
    half = lambda lo: F.conv(F.substring("said", lo, 16), 16, -10).cast("long")
    return numbered(plain, ["said"]).select("conv_id", "pos", half(1).alias("a"), half(17).alias("b"), "size")


def grafted(own: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, pos, a, b, size, len) of conversations rebuilt on a shared head: the first crc32(conv_id) % heads turns of conversation c - c % family, then c's own turns after as many. Turnless ones have one row whose pos is null."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    asked = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shape = asked.join(of_base, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    shape = shape.withColumn("len", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "head", "len")
    first = own.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    front = shape.where("h > 0").join(first, "base").where("pos <= h").select("conv_id", "pos", "a", "b", "size", "len")
    back = own.where(F.col("pos") > h).join(shape, "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "a", "b", "size", "len")
    none = [F.lit(None).cast("long").alias(c) for c in ("pos", "a", "b", "size")]
    return front.union(back).union(shape.where("len = 0").select("conv_id", *none, "len"))


def _mixed(pos: Column, a: Column, b: Column) -> list[Column]:
    """Two hashes of a turn at its place."""
    return [F.xxhash64(F.lit(seed), pos, *ids) for seed, ids in ((1, (a, b)), (2, (b, a)))]


def blocks_of(turns: DataFrame) -> DataFrame:
    """One row per conversation and block of turns(conv_id, pos, a, b, size, len): block; pa, pb, above: name and bytes of the node before it; ea, eb: name of the node it ends in; len; t1..t8, each a struct of a, b, size or null."""
    place = F.col("pos") - 1
    at = lambda i, c: F.max(F.when(place % BLOCK == i, F.col(c))).alias(f"{c}{i + 1}")
    xa, xb = _mixed(F.col("pos"), F.col("a"), F.col("b"))
    told = F.col("pos").isNotNull()
    wide = turns.groupBy("conv_id", F.coalesce(F.floor(place / BLOCK), F.lit(0)).alias("block")).agg(
        *[at(i, c) for i in range(BLOCK) for c in ("a", "b", "size")],
        F.bit_xor(F.when(told, xa).otherwise(F.lit(0).cast("long"))).alias("xa"), F.bit_xor(F.when(told, xb).otherwise(F.lit(0).cast("long"))).alias("xb"),
        F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.max("len").alias("len"),
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    named = wide.select("*", *[F.coalesce(f(c).over(before), F.lit(0)).cast("long").alias(n) for f, c, n in ((F.bit_xor, "xa", "pa"), (F.bit_xor, "xb", "pb"), (F.sum, "bytes", "above"))])
    t = [F.when(F.col(f"a{i}").isNotNull(), F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"size{i}").alias("size"))).alias(f"t{i}") for i in range(1, BLOCK + 1)]
    return named.select("conv_id", F.col("block").cast("long"), "pa", "pb", "above", F.col("pa").bitwiseXOR(F.col("xa")).alias("ea"), F.col("pb").bitwiseXOR(F.col("xb")).alias("eb"), (F.col("above") + F.col("bytes")).alias("upto"), "len", *t)


def _rolled(blocks: DataFrame, measures: str) -> DataFrame:
    """measures of every node: depth, its name (na, nb) and its parent's (ua, ub), above (bytes of the texts before its last one), size (of its last text)."""
    names = ", ".join(f"t{i}" for i in range(1, BLOCK + 1))
    rolled = blocks.sparkSession.sql(f"SELECT block, pa, pb, above, {names}, {BLOCK} - bit_count(grouping_id()) AS level, {measures} FROM {{blocks}} GROUP BY block, pa, pb, above, ROLLUP ({names})", blocks=blocks)
    last = lambda part: F.coalesce(*[F.when(F.col("level") == i, part(i)) for i in range(1, BLOCK + 1)])
    mix = lambda i, k: F.when(F.col(f"t{i}").isNotNull(), _mixed(F.col("block") * BLOCK + i, F.col(f"t{i}.a"), F.col(f"t{i}.b"))[k])
    kept = rolled.where((last(lambda i: F.col(f"t{i}.size")).isNotNull()) | ((F.col("level") == 0) & (F.col("block") == 0)))
    name = {k: F.col(p) for k, p in enumerate(("pa", "pb"))}
    for k in name:
        for i in range(1, BLOCK + 1):
            name[k] = name[k].bitwiseXOR(F.coalesce(mix(i, k), F.lit(0).cast("long")))
    size = F.coalesce(last(lambda i: F.col(f"t{i}.size")), F.lit(0))
    passed = sum((F.coalesce(F.col(f"t{i}.size"), F.lit(0)) for i in range(1, BLOCK + 1)), F.col("above"))
    up = lambda k: F.coalesce(last(lambda i: mix(i, k)), F.lit(0).cast("long"))
    own = [c for c in rolled.columns if c not in ("block", "pa", "pb", "above", "level") and not c.startswith("t")]
    return kept.select(
        (F.col("block") * BLOCK + F.col("level")).alias("depth"), name[0].alias("na"), name[1].alias("nb"), name[0].bitwiseXOR(up(0)).alias("ua"), name[1].bitwiseXOR(up(1)).alias("ub"),
        (passed - size).alias("above"), size.alias("size"), *own,
    )


def digests(ends: DataFrame) -> DataFrame:
    """(ea, eb, ends_sha256) of ends(ea, eb, conv_id): SHA-256 of a node's ids in ascending order, joined by commas.

    Ids are joined to texts of at most 4,096 of them first; a node's texts then
    pass through one hash, in order, so no node is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for *at, text in zip(*(batch.column(c).to_pylist() for c in ("ea", "eb", "ids"))):
                if at != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["ea", "eb", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()))], ["ea", "eb", "ends_sha256"])

    runs = ends.groupBy("ea", "eb", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return runs.repartition("ea", "eb").sortWithinPartitions("ea", "eb", "run").mapInArrow(run, "ea long, eb long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row per node of the trie of turns(conv_id, pos, a, b, size, len), as turn_ids() and grafted() make them: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (bytes of texts that members repeat, in the subtree), ends_sha256, all but the last long.

    Conversations of the same turns are members of the same nodes. A table
    without conversations has no nodes.
    """
    tables = Scratch(turns.sparkSession)
    blocks = tables.put("blocks", blocks_of(turns))
    first = _rolled(blocks, "min(conv_id) AS conv_id, max(len) AS longest")
    owners = tables.put("owners", first.groupBy("conv_id").agg(
        F.min("depth").alias("own"), F.min_by("above", "depth").alias("shared"), F.min_by("ua", "depth").alias("ua"), F.min_by("ub", "depth").alias("ub"),
        F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"),
    ))
    last = blocks.where(f"len = 0 or len between block * {BLOCK} + 1 and (block + 1) * {BLOCK}")
    # a conversation without prefixes of its own shares all of its bytes
    whole = last.select("conv_id", F.col("upto").alias("total"))
    shares = whole.join(owners.select("conv_id", "shared", "leaf"), "conv_id", "left").select("conv_id", F.coalesce("shared", "total").alias("w"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"))
    second = _rolled(blocks.join(shares, "conv_id"), "min(conv_id) AS conv_id, count(*) AS n_convs, sum(w) AS w, min_by(w, conv_id) AS own_w, sum(leaf) AS n_leaves, min_by(len, conv_id) AS own_len")
    nodes = tables.put("nodes", second.select("na", "nb", "conv_id", "depth", "n_convs", "n_leaves", "own_len", (F.col("w") - F.col("own_w") - (F.col("n_convs") - 1) * F.col("above")).alias("saved_tokens")))
    hung = owners.where("own > 0")
    counts = hung.groupBy(F.col("ua").alias("na"), F.col("ub").alias("nb")).agg(F.count("*").alias("hung"))
    named = nodes.select(F.col("na").alias("ua"), F.col("nb").alias("ub"), F.col("conv_id").alias("parent"))
    parents = hung.join(named, ["ua", "ub"]).select("conv_id", F.col("own").alias("depth"), "parent")
    ends = digests(last.select("ea", "eb", "conv_id")).withColumnsRenamed({"ea": "na", "eb": "nb"})
    full = nodes.join(counts, ["na", "nb"], "left").join(ends, ["na", "nb"], "left").join(parents, ["conv_id", "depth"], "left")
    goes_on = (F.col("own_len") > F.col("depth")).cast("long")
    return full.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", (F.coalesce("hung", F.lit(0)) + goes_on).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
