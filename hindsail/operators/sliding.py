"""Nearest neighbours of every row among the newest rows before it.

History rows are numbered per key in time order and cut into blocks of `block`
numbers, each with a copy of the `pool` rows before it. So a query finds its
whole pool in one block, and a block with some `block` of its queries is one
NumPy call: a long key is many tasks, memory is a block and `block` * `pool`
distances, and no (query, pool row) pair is ever a row. Queries of one time and
equal features are one question, asked once and joined to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import micros
from .timejoin import PIECE, _numbered

BLOCK = 1024


def sliding_neighbours(queries: DataFrame, history: DataFrame, key: Sequence[str], weights: Mapping[str, float], k: int, ts: str = "ts", row_id: str = "id", carry: str | None = None, pool: int = 300, min_values: int = 5, digits: int = 9, block: int = BLOCK, piece: int = PIECE, told: Mapping[str, Column] | None = None) -> DataFrame:
    """(row, pool, neighbours): every query row as a struct, the size of its pool and the k rows of it that are nearest, (id, dist, carry) each.

    A pool is the newest `pool` history rows of the key strictly before the
    query's time. Distances are Euclidean over the features in weights, scaled
    by their deviation in the pool; a feature with fewer than min_values values
    there, or missing in the query, is not used at all, one missing in a row
    adds nothing to its distance, and a query without usable features has no
    neighbours. Equal distances keep the newest first, equal times the larger
    row_id. NaN counts as missing. Null times and null keys have an empty pool;
    repeated queries each get a row. carry: a number of the history row. told: columns
    made of pool and neighbours, in whose stead they come; lists are then not
    shuffled to the query rows.
    """
    keys, names = list(key), list(weights)
    width = max(block, pool)
    x = F.array(*[F.col(f).cast("double") for f in names])
    at = micros(F.col(ts))
    rows = history.select(*keys, at.alias("_t"), F.lit(True).alias("_row"), F.col(row_id).cast("long").alias("_id"), x.alias("_x"), (F.col(carry).cast("double") if carry else F.lit(None).cast("double")).alias("_c")).where("_t is not null")
    asks = queries.select(*keys, (at - 1).alias("_t"), F.lit(False).alias("_row"), x.alias("_x")).distinct()
    both = _numbered(rows.unionByName(asks, allowMissingColumns=True), keys, piece)
    tied = F.row_number().over(Window.partitionBy(*keys, "_piece", "_t").orderBy(F.desc("_id")))
    n, own = F.col("_n"), F.floor((F.col("_n") - 1) / width)
    ahead = F.when(n > (own + 1) * width - pool, F.array(own, own + 1)).otherwise(F.array(own))
    held = both.where("_row").withColumn("_n", F.col("_seen") - tied + 1).withColumn("_block", F.explode(ahead))
    blocks = held.groupBy(*keys, "_block").agg(F.collect_list(F.struct(n.alias("n"), F.col("_id").alias("id"), F.col("_x").alias("x"), F.col("_c").alias("c"))).alias("items"))
    asked = both.where("not _row").withColumn("_block", F.floor((F.greatest("_seen", F.lit(1)) - 1) / width))
    # questions of a block in parts of some `block`, however many are asked after the last history row
    sizes = asked.groupBy(*keys, "_block").agg(F.ceil(F.count("*") / block).alias("_parts")).withColumnsRenamed({c: f"_s{c}" for c in [*keys, "_block"]})
    same = [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in [*keys, "_block"]]
    dealt = asked.join(sizes, same).withColumn("_part", F.pmod(F.xxhash64("_t", "_x"), F.col("_parts")))
    parts = dealt.groupBy(*keys, "_block", "_part").agg(F.collect_list(F.struct(F.col("_seen").alias("seen"), F.col("_x").alias("x"), F.struct(*keys, "_t", "_x").alias("row"))).alias("asked"))
    pairs = parts.join(blocks, [*keys, "_block"], "left").select("asked", "items")
    scale = [float(weights[f]) for f in names]

    def table(part: pa.StructArray) -> np.ndarray:
        return part.field("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), len(scale))

    def nearest(seen: np.ndarray, q: np.ndarray, first: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in h of each query's pool by rank, their distances (infinite: none) and the pool's size."""
        number = seen[:, None] - np.arange(pool)
        valid = (number >= 1) & (number >= first)
        at = np.where(valid, number - first, 0)
        total, usable = np.zeros(at.shape), np.zeros(len(q), bool)
        for f, weight in enumerate(scale):
            v = h[at, f]
            there = valid & ~np.isnan(v)
            v, count = np.where(there, v, 0.0), there.sum(axis=1)
            mean = v.sum(axis=1) / np.maximum(count, 1)
            std = np.sqrt((np.where(there, v - mean[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(count, 1))
            flat = np.where(there, v, -np.inf).max(axis=1) == np.where(there, v, np.inf).min(axis=1)
            can = (count >= min_values) & ~np.isnan(q[:, f])
            gap = (q[:, f, None] - v) / np.where(flat | (std == 0), 1.0, std)[:, None]
            total += np.where(can[:, None] & there, weight * gap * gap, 0.0)
            usable |= can
        dist = np.where(valid & usable[:, None], np.round(np.sqrt(total), digits), np.inf)
        top = np.argsort(dist, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(at, top, axis=1), np.take_along_axis(dist, top, axis=1), valid.sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asking, items = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                items = items.take(pa.array(np.argsort(items.field("n").to_numpy(zero_copy_only=False), kind="stable")))
                seen, q, h = asking.field("seen").to_numpy(zero_copy_only=False), table(asking), table(items)
                for lo in range(0, len(asking), block):
                    part = asking.slice(lo, block)
                    if len(items):
                        place, dist, size = nearest(seen[lo : lo + block], q[lo : lo + block], items.field("n")[0].as_py(), h)
                    else:
                        place, dist, size = np.zeros((len(part), 0), np.int64), np.zeros((len(part), 0)), np.zeros(len(part), np.int64)
                    hit = np.isfinite(dist)
                    ends = np.concatenate(([0], np.cumsum(hit.sum(axis=1))))
                    chosen = items.take(pa.array(place[hit]))
                    found = pa.StructArray.from_arrays([chosen.field("id"), pa.array(dist[hit]), chosen.field("c")], ["id", "dist", "carry"])
                    yield pa.RecordBatch.from_arrays([part.field("row"), pa.array(size, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], ["row", "pool", "neighbours"])

    kind = parts.schema["asked"].dataType.elementType["row"].dataType.simpleString()
    answers = pairs.mapInArrow(run, f"row {kind}, pool int, neighbours array<struct<id: long, dist: double, carry: double>>")
    made = told if told is not None else {c: F.col(c) for c in ("pool", "neighbours")}
    answered = answers.select(*[F.col(f"row.{c}").alias(f"_a{i}") for i, c in enumerate([*keys, "_t", "_x"])], *[c.alias(n) for n, c in made.items()])
    asking = queries.select(*[F.col(c).alias(f"_q{i}") for i, c in enumerate(keys)], (at - 1).alias(f"_q{len(keys)}"), x.alias(f"_q{len(keys) + 1}"), F.struct(*queries.columns).alias("row"))
    return asking.join(answered, [F.col(f"_q{i}").eqNullSafe(F.col(f"_a{i}")) for i in range(len(keys) + 2)]).select("row", *made)


def conditional_calibration_each(queries: DataFrame, history: DataFrame, key: Sequence[str], weights: Mapping[str, float], k: int = 30, min_neighbors: int = 20, pool: int = 300, ts: str = "ts", row_id: str = "id", y: str = "realized_up", block: int = BLOCK) -> DataFrame:
    """queries with p_up_conditional and n_neighbors: for every row, the share of ups among the k rows of its own pool that are most like it; null under min_neighbors or without usable features. Any number of queries a key; see sliding_neighbours()."""
    known = F.filter(F.transform("neighbours", lambda n: n["carry"]), lambda c: c.isNotNull())
    share = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, c: a + c), F.size(known))
    n = F.size("neighbours")
    told = {"p_up_conditional": F.when(n >= min_neighbors, share), "n_neighbors": F.when(n >= min_neighbors, n.cast("long"))}
    near = sliding_neighbours(queries, history, key, weights, k, ts, row_id, y, pool, block=block, told=told)
    return near.select(*[F.col(f"row.{c}").alias(c) for c in queries.columns if c not in told], *told)
