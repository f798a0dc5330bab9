"""SimHash near-duplicates over a byte-position inverted index.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles. Two fingerprints that differ in at most 4 of 64 bits agree in at
least 4 of their 8 bytes; that is the guaranteed minimum. The index posts a
fingerprint under `width` byte positions at a time together with the bytes
there. width grows with the number of fingerprints, so that lists of unlike
ones stay short (a list of single bytes would hold 1/256 of all fingerprints),
and never exceeds the minimum, so no pair is missed. For pairs that meet, the
shared positional bytes are tallied; pairs reaching the guaranteed minimum are
retained and verified by their Hamming distance.

Equal fingerprints are one node. A list longer than SHORT is never expanded
into pairs: its members are linked to the list's hub, the fingerprint of most
documents, where verification allows; after those links are closed into
components, only members outside the hub's component are compared, with
members of other components. What is skipped joins fingerprints that are
connected already, so components are exact.

near_copies() finds texts by the similarity of their shingle sets. Sets at 0.8
are too far apart for 64 bits, so there the postings are shingles, and counts
of shared ones filter with a minimum that is guaranteed for such sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, counted, if_few, slices
from .components import component_labels

MAX_BITS = 4
#: Bytes that fingerprints at most MAX_BITS apart share at least.
MINIMUM = 8 - MAX_BITS
#: Longest list that is expanded into pairs.
SHORT = 32
#: (byte positions that a posting joins, fingerprints up to which it does). Of unlike
#: ones, lists of two positions then hold a sixteenth on average and lists of three
#: four at most; up to there the tally has pairs to reject. Beyond, it is implied.
WIDTHS = ((2, 1 << 12), (3, 1 << 26))
SEED = 42
#: Share of a text's shingles that near_copies() posts beyond those that have to be.
SPARE = 0.1
#: Shingle hashes that are held at once, besides those of one text.
PART = 1 << 20


def _hashes(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """Big-endian XXH64 of a text's word shingles in order, in parts: A-Z lower-cased, words parted by ASCII white space. Fewer words than width are one shingle; no words give nothing."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[-n:] - 1).tolist() if n > 1 else [len(joined)]
    digest = xxhash.xxh64_digest
    for lo in range(0, n, 65_536):
        yield np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + 65_536], stops[lo : lo + 65_536])]), ">u8")


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Signed 64-bit SimHash of UTF-8 bytes, repeated shingles counting each time. No words: 0."""
    total, n = np.zeros(64, np.int64), 0
    for part in _hashes(text, width):
        total += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(total * 2 > n).view(">i8")[0])


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes as signed longs. Texts without words hold one and the same shingle."""
    parts = list(_hashes(text, width)) or [np.zeros(1, ">u8")]
    return np.unique(np.concatenate(parts).astype("<u8").view("<i8"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row; whole texts, null as empty. Other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(x, width) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


def width_for(n: int) -> int:
    """How many byte positions a posting joins for n fingerprints."""
    return next((k for k, most in WIDTHS if n <= most), MINIMUM)


def _positions(width: int) -> list[tuple[int, int]]:
    """(number, mask as a signed long) of every `width` byte positions of 8."""
    masks = [sum(0xFF << 8 * p for p in chosen) for chosen in itertools.combinations(range(8), width)]
    return [(k, m - (1 << 64) if m >> 63 else m) for k, m in enumerate(masks)]


def _tally(xor: Column) -> Column:
    """How many positional bytes two fingerprints share, from their xor."""
    return sum((F.shiftrightunsigned(xor, 8 * p).bitwiseAND(0xFF) == 0).cast("int") for p in range(8))


def _near(xor: Column) -> Column:
    """Whether a pair's tally reaches the guaranteed minimum and verification finds few enough bits."""
    return (_tally(xor) >= MINIMUM) & (F.bit_count(xor) <= MAX_BITS)


def postings(nodes: DataFrame, width: int) -> DataFrame:
    """Index of nodes(fp, n): (at, bytes, fp, n, listed, hub), one row per fingerprint and position set, lists of one left out. listed: the list's length; hub: its fingerprint of most documents."""
    sets = F.explode(F.array(*[F.struct(F.lit(k).alias("at"), F.lit(m).alias("mask")) for k, m in _positions(width)]))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = nodes.repartition(parts, "fp").select("fp", "n", sets.alias("p")).select(F.col("p.at").alias("at"), F.col("fp").bitwiseAND(F.col("p.mask")).alias("bytes"), "fp", "n")
    lists = spread.groupBy("at", "bytes").agg(F.count("*").alias("listed"), F.max_by("fp", "n").alias("hub")).where("listed > 1")
    # Spark takes the rows of spread for as few as the nodes, and would broadcast them
    return spread.join(lists.hint("merge"), ["at", "bytes"]).select("at", "bytes", "fp", "n", "listed", "hub")


def links(index: DataFrame) -> DataFrame:
    """Verified links (a, b) from the lists of at most SHORT, each pair once, and from each longer list's hub to its members."""
    short = index.where(F.col("listed") <= SHORT).select("at", "bytes", "fp")
    pairs = short.alias("x").join(counted(short).alias("y"), (F.col("x.at") == F.col("y.at")) & (F.col("x.bytes") == F.col("y.bytes")) & (F.col("x.fp") < F.col("y.fp")))
    near = pairs.where(_near(F.col("x.fp").bitwiseXOR(F.col("y.fp"))))
    star = index.where((F.col("listed") > SHORT) & (F.col("fp") != F.col("hub")) & _near(F.col("fp").bitwiseXOR(F.col("hub"))))
    return near.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).union(star.select("hub", "fp")).distinct()


def _named(df: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """df with the label of each of these columns beside it; what has none is its own label."""
    n = labels.count()
    for c in columns:
        own = labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        df = df.join(counted(own, n), c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))
    return df


def cross_links(index: DataFrame, labels: DataFrame) -> DataFrame:
    """Verified links inside long lists between different components, of which one is not the hub's. labels(node, label); a fingerprint without one is its own component."""
    long = _named(index.where(F.col("listed") > SHORT), labels, "fp", "hub")
    outside = long.where("fp_label <> hub_label").select("at", "bytes", "fp", "fp_label")
    ends = long.select("at", "bytes", F.col("fp").alias("to"), F.col("fp_label").alias("to_label"))
    apart = (F.col("fp_label") != F.col("to_label")) & _near(F.col("fp").bitwiseXOR(F.col("to")))
    return outside.join(ends, ["at", "bytes"]).where(apart).select(F.col("fp").alias("a"), F.col("to").alias("b")).distinct()


def components(prints: DataFrame, width: int | None = None) -> DataFrame:
    """prints(doc_id, fp) -> (fp, label): label is the smallest id of the fingerprint's component. Null ids are never the smallest. width: positions a posting joins, by default width_for() the number of fingerprints; links are the same at every width."""
    tables = Scratch(prints.sparkSession)
    nodes = tables.put("nodes", prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")))
    index = tables.put("postings", postings(nodes, width or width_for(nodes.count())))
    found = tables.put("found", links(index))
    labels, step = component_labels(found), 0
    while not (more := tables.put(f"more{step}", cross_links(index, labels))).isEmpty():
        labels, step = component_labels(found := found.union(more)), step + 1
    tables.drop("postings")
    named = nodes.join(counted(labels), nodes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("part"))
    smallest = named.groupBy("part").agg(F.min("first").alias("label"))
    return named.join(smallest, "part").select("fp", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fingerprint string of 16 hex digits, component_id) for every row of docs.

    component_id: the smallest doc_id reachable over links. Repeated rows each
    get a row; texts without words share fingerprint zero; an empty table gives
    no rows; a row with a null id belongs to its text's component.
    """
    prints = Scratch(docs.sparkSession).put("prints", fingerprints(docs, id_col, text_col, width))
    named = components(prints)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp", "left").select("doc_id", hexed.alias("fingerprint"), F.col("label").alias("component_id"))


def _longs(arrays: list[np.ndarray | None]) -> pa.Array:
    """A list<long> column."""
    ends = np.cumsum([0, *(0 if a is None else len(a) for a in arrays)])
    flat = np.concatenate([a for a in arrays if a is not None] or [np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()), mask=pa.array([a is None for a in arrays]))


def _each_once(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches whose last two columns are key and text, each with the shingle sets of the partition's first row of a key and None for others; cut where sets have come to PART hashes."""
    seen: set[str] = set()
    for batch in slices(batches):
        keys, texts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)
        lo, size, made = 0, 0, []
        for k, key in enumerate(keys):
            made.append(None if key in seen else shingle_set(texts[k].as_py(), width))
            size += 0 if made[-1] is None else len(made[-1])
            seen.add(key)
            if size >= PART or k == len(keys) - 1:
                yield batch.slice(lo, len(made)), made
                lo, size, made = k + 1, 0, []


def posted(z: int, similarity: float, spare: float = SPARE) -> int:
    """How many of a set's z shingles, first in any common order, are posted.

    Sets of Jaccard similarity t share at least a = t / (1 + t) (z + z')
    shingles, no less than t of either, and the smaller set is no less than t
    of the larger. Their l first common ones stand among the first z - a + l of
    each. So if each posts with l = 1 + spare z, they share at least the
    smaller set's l of what both have posted; see needed().
    """
    return min(z, z - int(np.ceil(z * similarity - 1e-6)) + 1 + int(spare * z))


def needed(z: Column, similarity: float, spare: float = SPARE) -> Column:
    """How many posted shingles a set of z shares with every set that is similar to it."""
    return 1 + F.floor(z * (similarity * spare) - 1e-6)


def suspects(rows: DataFrame, similarity: float) -> DataFrame:
    """(key) of rows(key, node, z, p) that can have a similar text: enough of the posted shingles p stand in another row's."""
    single = rows.select("node", F.explode("p").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    own = single.groupBy("node").agg(F.count("*").alias("own"))
    shared = F.size("p") - F.coalesce("own", F.lit(0))
    return rows.where("p is not null").join(own, "node", "left").where(shared >= needed(F.col("z"), similarity)).select("key").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets(node, s) that have at least this Jaccard similarity."""
    # sets of like texts are far smaller as files than in memory
    ends = [sets.select(F.col("node").alias(end), F.col("s").alias(s)).hint("merge") for end, s in (("a", "x"), ("b", "y"))]
    both = pairs.join(ends[0], "a").join(ends[1], "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(h, at, node, z, own) from sets(node, s): the shingles h by which a text can meet a similar one.

    All shingles are put in one order, by the number of texts that hold them,
    then by hash. Two sets of similarity t share at least t of either, so they
    share one of the first z - ceil(t z) + 1 of each. at: the shingle's place
    in the text's order; z: the set's size; own: the text's shingles that no
    other text holds, which come first and lead nowhere.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt once, for the count and for the join
    spread = sets.select("node", F.size("s").alias("z"), F.explode("s").alias("h")).repartition(parts, "h")
    common = spread.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    # rounding may only lengthen a prefix
    length = F.col("z") - F.ceil(F.col("z") * similarity - 1e-6) + 1
    held = spread.join(common.hint("merge"), "h").groupBy("node").agg(F.first("z").alias("z"), F.sort_array(F.collect_list(F.struct("n", "h"))).alias("c"))
    held = held.withColumn("own", F.col("z") - F.size("c")).withColumn("asked", (length - F.col("own")).cast("int")).where("asked > 0")
    first = F.posexplode(F.slice("c", F.lit(1), F.col("asked"))).alias("i", "p")
    return held.select("node", "z", "own", first).select(F.col("p.h").alias("h"), (F.col("own") + F.col("i") + 1).alias("at"), "node", "z", "own")


def similar_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, label) for the nodes of sets(node, s) that are linked to another, label being one node of the component over all pairs of at least this similarity.

    A list is what _prefixes() puts under one shingle. Each member is verified
    against the list's hub, the text with the smallest share of shingles of its
    own; after those links are closed into components, only members outside the
    hub's component are compared, with members of other components, until
    nothing is found. Set sizes and places in the common order rule out only
    pairs that cannot reach the similarity; all others are verified.
    """
    tables = Scratch(sets.sparkSession)
    members = tables.put("members", _prefixes(sets, similarity))
    lists = members.groupBy("h").agg(F.count("*").alias("listed"), F.min(F.struct((F.col("own") / F.col("z")).alias("share"), "node", "at", "z")).alias("hub")).where("listed > 1")
    index = tables.put("index", members.join(counted(lists, members.count()), "h").select("h", "at", "node", "z", F.col("hub.node").alias("hub"), F.col("hub.at").alias("hub_at"), F.col("hub.z").alias("hub_z")))
    tables.drop("members")

    def alike(at: str, z: str, other_at: str, other_z: str) -> Column:
        """Whether two sets that meet first at these places can reach the similarity."""
        least = similarity / (1 + similarity) * (F.col(z) + F.col(other_z)) - 1e-6
        rest = F.least(F.col(z) - F.col(at), F.col(other_z) - F.col(other_at))
        return (F.least(z, other_z) >= similarity * F.greatest(z, other_z) - 1e-6) & (rest + 1 >= least)

    ordered = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    star = index.where((F.col("node") != F.col("hub")) & alike("at", "z", "hub_at", "hub_z"))
    tried = tables.put("star", ordered(star, "node", "hub"))
    found, step = tables.put("found", _verified(tried, sets, similarity)), 0
    while True:
        labels = component_labels(found)
        named = tables.put(f"named{step}", _named(index.select("h", "at", "node", "z", "hub"), labels, "node", "hub"))
        x, y = counted(named.where("node_label <> hub_label")).alias("x"), named.alias("y")
        meet = (F.col("x.h") == F.col("y.h")) & (F.col("x.node_label") != F.col("y.node_label")) & alike("x.at", "x.z", "y.at", "y.z")
        # a pair of which both are outside is met from one side
        side = (F.col("y.node_label") == F.col("y.hub_label")) | (F.col("x.node") < F.col("y.node"))
        again = tables.put(f"tried{step}", ordered(x.join(y, meet & side), "x.node", "y.node").join(counted(tried), ["a", "b"], "left_anti"))
        tables.drop(f"named{step}")
        more = tables.put(f"more{step}", _verified(again, sets, similarity))
        if more.isEmpty():
            tables.drop("index")
            return labels
        found, tried, step = found.union(more), tried.union(again), step + 1


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(key string, component_id) for every distinct text of docs, key being its MD5 (of the empty text for null): component_id is the smallest id reachable over texts of at least this Jaccard similarity of word shingles.

    No pair is missed. First every text posts its smallest shingle hashes, and
    only texts that share the guaranteed number of those with others go on
    (suspects); of these alone whole sets are made, listed and compared
    (similar_sets). Texts of equal words are one component, and so are texts
    without words; null ids are never the smallest. An empty table gives no
    rows; other columns are left out.
    """
    tables = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.md5(text.cast("binary")).alias("key"), text.cast("binary").alias("text"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _each_once(batches, width):
            first = [None if s is None else s[: posted(len(s), similarity)] for s in sets]
            z = pa.array([None if s is None else len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z, _longs(first)], ["doc_id", "key", "z", "p"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _each_once(batches, width):
            kept = [k for k, s in enumerate(sets) if s is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), _longs([sets[k] for k in kept])], ["key", "s"])

    numbered = lambda df: df.withColumn("node", F.monotonically_increasing_id())
    posts = tables.put("posts", numbered(keyed.mapInArrow(post, f"doc_id {kind}, key string, z int, p array<long>")))
    rows = tables.put("rows", posts.select("doc_id", "key"))
    chosen = tables.put("suspects", suspects(posts, similarity))
    tables.drop("posts")
    near = keyed.select("key", "text").join(if_few(chosen), "key", "left_semi")
    # copies in different partitions have equal sets, so they are one component
    sets = tables.put("sets", numbered(near.mapInArrow(whole, "key string, s array<long>")))
    labels = similar_sets(sets.select("node", "s"), similarity)
    texts = tables.put("texts", rows.groupBy("key").agg(F.min("doc_id").alias("first")))
    tables.drop("rows", "suspects")
    parts = _named(sets.select("key", "node").groupBy("key").agg(F.min("node").alias("node")), labels, "node").join(counted(texts), "key")
    smallest = parts.groupBy("node_label").agg(F.min("first").alias("label"))
    moved = tables.put("moved", parts.join(smallest, "node_label").select("key", F.col("label").alias("component_id")))
    # a table, so that Spark can split a text's rows where they are joined to it
    copies = tables.put("copies", texts.join(counted(moved), "key", "left").select("key", F.coalesce("component_id", "first").alias("component_id")))
    tables.drop("sets", "texts", "moved")
    return copies
