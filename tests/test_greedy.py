"""Greedy thinning against the fold over each key."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindsail.operators import catalysts, greedy


def fold(rows, tol):
    """Rows (key, time, id) kept, in order of time and id."""
    kept, last = [], {}
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if k not in last or t - last[k] > tol:
            kept.append((k, t, i))
            last[k] = t
    return sorted(kept, key=str)


def test_blocks_hand_on_the_last_time():
    """Step functions of all blocks in turn, against thinning them as one."""
    rng = np.random.default_rng(2)
    for tol, spread in ((0, 5), (1, 40), (7, 60), (7, 2000), (100, 900)):
        times = np.unique(rng.integers(-spread, spread, 300))
        whole = times[greedy.kept_times(times, None, tol)]
        width, last, got = max(1, tol) * 3, None, []
        for b in np.unique(times // width):
            own = times[times // width == b]
            got += own[greedy.kept_times(own, last, tol)].tolist()
            upto, out = greedy.step_function(own, int(b) * width, tol)
            k = 0 if last is None else int(np.searchsorted(upto, last + tol, "right"))
            last = int(out[k]) if k < len(out) else last
            assert last == got[-1]
        assert got == whole.tolist()


@pytest.mark.parametrize("tol", [0, 3, 50, 100_000])
def test_thinned_against_fold(spark, tol):
    r = random.Random(tol)
    rows = [(r.choice(["a", "b", None]), r.randrange(-3000, 3000), i) for i in range(3000)] + [("long", t * 3, 10_000 + t) for t in range(4000)] + [("a", 5, 1)] * 3
    df = spark.createDataFrame([*rows, ("a", None, 7)], "k string, t long, id long").repartition(6)
    assert sorted((tuple(x) for x in greedy.thinned(df, ["k"], tol).collect()), key=str) == fold(set(rows), tol)


def test_one_long_key_is_many_tasks(spark):
    """300,000 rows of one key: no task but the scan of step functions holds the key, and that holds a fraction of it."""
    n, hour = 300_000, 3_600_000_000
    df = spark.range(n).select(F.lit("c").alias("coin"), F.lit("x").alias("category"), F.timestamp_micros(F.col("id") * (hour // 20) + F.pmod(F.xxhash64("id"), F.lit(hour))).alias("ts"), "id")
    empty = df.limit(0)
    got = {r.id for r in catalysts.drop_fuzzy_duplicates(df, empty, within_batch=True).select("id").collect()}
    rows = [(r.coin, r.t, r.id) for r in df.select("coin", F.unix_micros("ts").alias("t"), "id").collect()]
    assert got == {i for *_, i in fold(rows, 6 * hour)}


def test_rows_without_time_or_key_stay(spark):
    rows = spark.createDataFrame([(1, "a", "x", None), (2, "a", "x", None), (3, None, "x", 0), (4, None, "x", 10), (5, "a", "x", 0), (5, "a", "x", 0)], "id long, coin string, category string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.id for r in catalysts.drop_fuzzy_duplicates(rows, rows.limit(0), within_batch=True).collect()) == [1, 2, 3, 5]
