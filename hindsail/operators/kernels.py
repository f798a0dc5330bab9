"""Blocked comparison of each row of a series with all earlier rows.

A series is cut into blocks of `block` row numbers. Every pair (query block,
candidate block not after it) is one row of an equi-join and one NumPy call, so
a long series is many small tasks; each returns at most k rows per query, and a
window merges them. Memory is two blocks, whatever the series' length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 1024


def prior_top_k(rows: DataFrame, key: Sequence[str], rn: str, features: Sequence[str], k: int, scales: Sequence[str] | None = None, carry: str | None = None, digits: int = 9, block: int = BLOCK, first_query: str | None = None) -> DataFrame:
    """(key, rn, cand_rn, dist, carry): each row's k nearest strictly earlier rows of its series.

    rn: row numbers from 1 in time order. dist: Euclidean over features, each
    difference divided by the query row's scale, rounded to `digits`; ties go to
    the earlier row. carry: a double column of the candidate. first_query: a
    column with the smallest row number to ask for. Rows with a null feature
    take no part.
    """
    names, n = list(key), len(features)
    scale = [F.col(c).cast("double") for c in scales] if scales else [F.lit(1.0)] * n
    item = F.struct(
        F.col(rn).cast("long").alias("rn"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        F.array(*scale).alias("s"),
        (F.col(carry).cast("double") if carry else F.lit(None).cast("double")).alias("c"),
        (F.col(rn) >= F.col(first_query) if first_query else F.lit(True)).alias("asks"),
    )
    whole = rows.where(" and ".join(f"`{f}` is not null" for f in features))
    blocks = whole.groupBy(*names, F.floor((F.col(rn) - 1) / block).cast("int").alias("b")).agg(F.collect_list(item).alias("items"))
    asks = blocks.where(F.exists("items", lambda i: i["asks"])).select(*names, F.col("items").alias("asked"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("b"))
    pairs = asks.join(blocks, [*names, "b"]).select(F.struct(*names).alias("k"), "asked", "items")

    def arrays(part: pa.StructArray) -> tuple[np.ndarray, ...]:
        get = lambda name: part.field(name).to_numpy(zero_copy_only=False)
        flat = lambda name: part.field(name).flatten().to_numpy(zero_copy_only=False).reshape(len(part), n)
        order = np.argsort(get("rn"), kind="stable")
        return get("rn")[order], flat("x")[order], flat("s")[order], get("c")[order], get("asks").astype(bool)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_rn, q_x, q_s, _, asking = arrays(batch.column(1).slice(i, 1).flatten())
                c_rn, c_x, _, c_c, _ = arrays(batch.column(2).slice(i, 1).flatten())
                q_rn, q_x, q_s = q_rn[asking], q_x[asking], q_s[asking]
                total = np.zeros((len(q_rn), len(c_rn)))
                for f in range(n):
                    total += ((q_x[:, f, None] - c_x[None, :, f]) / q_s[:, f, None]) ** 2
                dist = np.where(c_rn[None] < q_rn[:, None], np.round(np.sqrt(total), digits), np.inf)
                top = np.argsort(dist, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(dist, top, axis=1)
                row, col = np.nonzero(np.isfinite(best))
                at = top[row, col]
                keys = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(row), np.int64)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(q_rn[row]), pa.array(c_rn[at]), pa.array(best[row, col]), pa.array(c_c[at], pa.float64(), from_pandas=True)], ["k", "rn", "cand_rn", "dist", "carry"])

    kind = pairs.schema["k"].dataType.simpleString()
    near = pairs.repartition(*[F.col(f"k.{c}") for c in names], F.xxhash64(F.col("asked.rn")), F.xxhash64(F.col("items.rn"))).mapInArrow(run, f"k {kind}, rn long, cand_rn long, dist double, carry double")
    order = Window.partitionBy(*names, "rn").orderBy("dist", "cand_rn")
    return near.select("k.*", "rn", "cand_rn", "dist", "carry").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def closest_prior(rows: DataFrame, key: Sequence[str], rn: str, features: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(key, rn, closest): each row's distance to the nearest earlier row; the first row of a series has none."""
    return prior_top_k(rows, key, rn, features, 1, block=block).select(*key, "rn", F.col("dist").alias("closest"))
