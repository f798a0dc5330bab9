"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are quantised to integers and dealt into blocks of fixed size. A block
is indexed once, in a table: its postings (dimension, row, value) stand in
segments by impact, the bit length of a value's magnitude, highest first. A
block of queries is scored segment by segment: after each one, what is left of
a score is bounded by the norms of what is left of the vectors
(Cauchy-Schwarz). A query stops on proof only: when at most `members` vectors
can still reach its bound, the k-th best lower bound found here or brought
along. Those possible members are scored again in exact integers, and ties go
to the smaller id. A query that never stops early has seen all segments.

The first block is searched by all queries first, and the k-th best score there
is what they bring to all other blocks. Queries go to the blocks in broadcast
waves of bounded size; index blocks stay where they are, so nothing is shuffled
but the vectors, once, and at most k rows of a query and block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

K = 20
SCALE = 64
BLOCK = 8192
QUERY_BLOCK = 512
#: Query blocks that are broadcast at once.
WAVE = 64
POSTINGS = "block int, id array<long>, row array<long>, ends array<long>, dim array<int>, at array<int>, value array<long>"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of vectors without null or non-finite components; other rows take no part."""
    x = F.col(vector_col)
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return vectors.where(x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, bad)).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Rows as an int64 matrix; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array(column.value_lengths(), np.int64)
    flat, width = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


@dataclass
class Block:
    """ids and rows of a block's vectors, ordered by id, then row; postings (dim, at, value) of all segments, at being the vector's place; ends: where each segment ends."""

    ids: np.ndarray
    rows: np.ndarray
    ends: np.ndarray
    dim: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def segments(self) -> list[slice]:
        return [slice(a, b) for a, b in zip([0, *self.ends[:-1]], self.ends)]


def indexed(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> Block:
    """A block's postings by impact, highest first, then by dimension; zeros have none."""
    order = np.lexsort((rows, ids))
    vectors = vectors[order]
    at, dim = np.nonzero(vectors)
    value = vectors[at, dim]
    impact = np.frexp(np.abs(value).astype(float))[1]
    by = np.lexsort((at, dim, -impact))
    ends = np.append(np.flatnonzero(np.diff(impact[by])) + 1, len(by)) if len(by) else np.zeros(0, int)
    return Block(ids[order], rows[order], ends.astype(np.int64), dim[by], at[by], value[by])


def search(queries: np.ndarray, query_rows: np.ndarray, floors: np.ndarray, block: Block, k: int = K, members: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places in the block, exact scores) of each query's best k of the block that reach its floor, its own row left out, best first, ties by id."""
    n, parts = len(block.ids), block.segments()
    width = max(queries.shape[1], int(block.dim.max(initial=-1)) + 1)
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    whole = np.zeros((n, width), np.int64)
    whole[block.at, block.dim] = block.value
    left = [np.zeros(n)]
    for part in reversed(parts):
        left.append(left[-1] + np.bincount(block.at[part], block.value[part].astype(float) ** 2, n))
    rest = [np.sqrt(x) for x in reversed(left)]  # rest[s]: norms of what is left before segment s
    norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    place = {row: i for i, row in enumerate(block.rows.tolist())}
    own = np.array([place.get(row, -1) for row in query_rows.tolist()], int)
    live, partial = np.arange(len(queries)), np.zeros((len(queries), n))
    for s in range(len(parts) + 1):
        # floats of integers: exact below 2^53; the slack covers what is not
        slack = norms[live, None] * (rest[s] + 1e-12 * rest[0])[None]
        low, high = partial - slack, partial + slack
        mine = np.flatnonzero(own[live] >= 0)
        low[mine, own[live][mine]] = high[mine, own[live][mine]] = -np.inf
        bound = floors[live]
        if n > k:
            bound = np.maximum(bound, np.partition(low, n - k, axis=1)[:, n - k])
        possible = (high >= bound[:, None]) & (high > -np.inf)
        proved = np.flatnonzero((possible.sum(axis=1) <= members) | (s == len(parts)))
        for row in proved.tolist():
            at = np.flatnonzero(possible[row])
            scores = whole[at] @ queries[live[row]]
            best = np.lexsort((at, -scores))[:k]
            yield int(live[row]), at[best], scores[best]
        going = np.setdiff1d(np.arange(len(live)), proved)
        if not len(going) or s == len(parts):
            return
        live, partial = live[going], partial[going]
        dim, at = block.dim[parts[s]], block.at[parts[s]]
        dims, dim = np.unique(dim, return_inverse=True)
        seen, at = np.unique(at, return_inverse=True)
        segment = np.zeros((len(seen), len(dims)))
        segment[at, dim] = block.value[parts[s]]
        partial[:, seen] += queries[live][:, dims].astype(float) @ segment.T


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """POSTINGS of vectors(row, vec_id, v), one row per block: rows are dealt by the hash of their number, so blocks are even whatever the ids."""

    def run(part: pa.Table) -> pa.Table:
        b = indexed(*(part.column(c).to_numpy() for c in ("vec_id", "row")), _matrix(part.column("v")))
        made = [part.column("block")[0].as_py(), b.ids, b.rows, b.ends, b.dim, b.at, b.value]
        types = [pa.int32(), *[pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())]]
        return pa.table([pa.array([x], t) for x, t in zip(made, types)], names=[f.split(" ")[0] for f in POSTINGS.split(", ")])

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return dealt.repartition(blocks, "block").groupBy("block").applyInArrow(run, POSTINGS)


def ask(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_row, query_id, vec_id, score): each query's best k of each block. asked(asked array of row, vec_id, v, floor) is broadcast, its size being bounded by WAVE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {name: batch.column(name).slice(i, 1).flatten() for name in batch.schema.names}
                plain = lambda name: one[name].to_numpy(zero_copy_only=False)  # noqa: E731, B023
                block = Block(*(plain(name) for name in ("id", "row", "ends", "dim", "at", "value")))
                rows, ids, floors = (one["asked"].field(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "floor"))
                found = list(search(_matrix(one["asked"].field("v")), rows, floors.astype(float), block, k))
                sizes = [len(x[1]) for x in found]
                which = np.repeat(np.array([x[0] for x in found], int), sizes)
                at, score = (np.concatenate([x[j] for x in found]) if found else np.zeros(0, np.int64) for j in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rows[which], ids[which], block.ids[at], score)], ["query_row", "query_id", "vec_id", "score"])

    return index.drop("block").crossJoin(F.broadcast(asked)).mapInArrow(run, "query_row long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK, wave: int = WAVE) -> DataFrame:
    """(query_id, rank int from 1, vec_id, score long): the k highest inner products of each row of vectors(vec_id, v) that is_query marks with all other rows.

    All, if fewer; ties go to the smaller vec_id. A row is itself, whatever its
    id: rows that repeat an id are each a candidate for the other, and each
    such query has a list of its own. Other columns are left out, an empty
    table gives no rows. A block's size is bounded by the parameters, and so is
    what is broadcast.
    """
    tables = Scratch(vectors.sparkSession)
    plain = vectors.select("vec_id", "v", is_query.alias("asks")).withColumn("row", F.monotonically_increasing_id())
    plain = tables.put("vectors", plain)
    n, m = plain.count(), plain.where("asks").count()
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(m / query_block))
    index = tables.put("index", build_index(plain, blocks))

    def asked(queries: DataFrame, turn: int) -> DataFrame:
        part = queries.withColumn("part", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(query_blocks))).where(F.col("part").between(turn, turn + wave - 1))
        return part.groupBy("part").agg(F.collect_list(F.struct("row", "vec_id", "v", "floor")).alias("asked")).select("asked")

    def answers(tag: str, where: str, queries: DataFrame) -> DataFrame:
        spread = index.where(where).repartition(blocks, "block")
        turns = [tables.put(f"{tag}{t}", ask(spread, asked(queries, t), k)) for t in range(0, query_blocks, wave)]
        return tables.spark.read.schema(turns[0].schema).parquet(*[f"{tables.folder}/{tag}{t}" for t in range(0, query_blocks, wave)])

    queries = plain.where("asks").select("row", "vec_id", "v", F.lit(-math.inf).alias("floor"))
    first = answers("first", "block = 0", queries)
    reached = first.groupBy(F.col("query_row").alias("row")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k)
    queries = tables.put("queries", queries.drop("floor").join(reached, "row", "left").select("row", "vec_id", "v", F.coalesce("least", F.lit(-math.inf)).alias("floor")))
    near = first.union(answers("others", "block > 0", queries)) if blocks > 1 else first
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    tables.drop("index")
    return ranked.select("query_id", "rank", "vec_id", "score")
