"""Greedy thinning of times as a parallel scan.

A time is kept if it lies more than a tolerance after the last one kept, so all
that the past tells is that last time. The times of a key are cut into blocks
of BLOCK_TOLERANCES tolerances. What a block does is a step function, last time
kept on entry to last time kept on exit, and as every entry lies before the
block, only its first tolerance of rows can tell entries apart. These functions
are made in any task; only they, a fraction of the rows, pass along a key in
order, one at a time; each block then knows its entry and thins its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK_TOLERANCES = 16


def _exits(times: np.ndarray, tol: int) -> np.ndarray:
    """For each of a block's distinct times in order: the last one kept if it is kept."""
    after = np.searchsorted(times, times + tol, "right")
    last = np.where(after == len(times), np.arange(len(times)), after)
    while not np.array_equal(further := last[last], last):
        last = further
    return times[last]


def step_function(times: np.ndarray, start: int, tol: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, exit): an entry e before start leaves at exit[k], k being the first with upto[k] > e + tol; if there is none, at e."""
    exits = _exits(times, tol)
    n = min(len(times), int(np.searchsorted(times, start + tol, "right")) + 1)
    ends = np.flatnonzero(np.append(exits[1:n] != exits[: n - 1], True))
    return times[ends], exits[ends]


def kept_times(times: np.ndarray, entry: int | None, tol: int) -> np.ndarray:
    """Places of the times that are kept, given the last one kept before."""
    found, at = [], 0 if entry is None else int(np.searchsorted(times, entry + tol, "right"))
    while at < len(times):
        found.append(at)
        at = int(np.searchsorted(times, times[at] + tol, "right"))
    return np.array(found, int)


def thinned(rows: DataFrame, keys: Sequence[str], tol: int, time: str = "t", row_id: str = "id") -> DataFrame:
    """(keys, time, id) of the rows that greedy thinning keeps: in order of (time, id) within keys, those more than tol after the last one kept. time and tol are longs; rows without a time are left out, equal keys may be null."""
    names = list(keys)
    width = max(1, tol) * BLOCK_TOLERANCES
    first = rows.where(F.col(time).isNotNull()).groupBy(*names, F.col(time).alias("_t")).agg(F.min(row_id).alias("_id"))
    cut = first.withColumn("_block", F.floor(F.col("_t") / F.lit(width)))
    blocks = cut.groupBy(F.struct(*names).alias("_k"), "_block").agg(F.array_sort(F.collect_list(F.struct("_t", "_id"))).alias("_rows"))
    key, id_kind = blocks.schema["_k"].dataType.simpleString(), first.schema["_id"].dataType.simpleString()

    def times_of(column: pa.ListArray, i: int) -> np.ndarray:
        return column.slice(i, 1).flatten().field("_t").to_numpy(zero_copy_only=False)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [step_function(times_of(batch.column(2), i), b * width, tol) for i, b in enumerate(batch.column(1).to_pylist())]
            steps = [pa.array([m[k].tolist() for m in made], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *steps], ["_k", "_block", "_upto", "_exit"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for batch in batches:
            entries = []
            flat = lambda c, i: batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False)  # noqa: E731, B023
            for i, own in enumerate(batch.column(0).to_pylist()):
                if own != at:
                    at, last = own, None
                entries.append(last)
                upto, out = flat(2, i), flat(3, i)
                k = 0 if last is None else int(np.searchsorted(upto, last + tol, "right"))
                last = int(out[k]) if k < len(out) else last
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.int64())], ["_k", "_block", "_entry"])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, entry in enumerate(batch.column(2).to_pylist()):
                own = batch.column(1).slice(i, 1).flatten()
                kept = pa.array(kept_times(times_of(batch.column(1), i), entry, tol))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(kept), int))), own.field("_t").take(kept), own.field("_id").take(kept)], ["_k", time, row_id])

    ordered = blocks.mapInArrow(functions, f"_k {key}, _block long, _upto array<long>, _exit array<long>").repartition("_k").sortWithinPartitions("_k", "_block")
    entries = ordered.mapInArrow(scan, f"_k {key}, _block long, _entry long").withColumnsRenamed({"_k": "_ek", "_block": "_eb"})
    known = blocks.join(entries, (blocks["_k"] == entries["_ek"]) & (blocks["_block"] == entries["_eb"])).select("_k", "_rows", "_entry")
    return known.mapInArrow(thin, f"_k {key}, {time} long, {row_id} {id_kind}").select("_k.*", time, row_id)
