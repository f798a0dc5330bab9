"""Time joins without a key deal one day's rows into parts."""

from __future__ import annotations

import bisect
import random

from pyspark.sql import functions as F

from hindsail.operators.timejoin import SALTS, asof_join_keyless, dealt, enrich


def test_asof_is_the_newest_before(spark):
    r = random.Random(2)
    left = [(i, None if i % 50 == 0 else r.randrange(400_000)) for i in range(600)] + [(7, 1000)] * 3
    right = [(j, r.randrange(400_000) // 7 * 7) for j in range(40)]
    named = lambda rows, i, t: spark.createDataFrame(rows, f"{i} long, s long").select(i, F.timestamp_seconds("s").alias(t))
    L = named(left, "id", "ts").withColumn("features", F.create_map(F.lit("a"), F.lit(1.0))).repartition(4)
    got = sorted((x.id, x.d_rid is None, x.d_rid or 0) for x in asof_join_keyless(L, named(right, "rid", "rts"), "ts", "rts", "rid", ["rid"], prefix="d_").collect())
    order = sorted((t, -j) for j, t in right)

    def newest(t):
        n = 0 if t is None else bisect.bisect_right(order, (t, 1))
        return -order[n - 1][1] if n else None

    assert got == sorted((i, newest(t) is None, newest(t) or 0) for i, t in left)


def test_nothing_to_join(spark):
    left = spark.range(3).select("id", F.timestamp_seconds("id").alias("ts"))
    right = left.select(F.col("id").alias("rid"), F.col("ts").alias("rts"))
    assert [x.rid for x in asof_join_keyless(left, right.limit(0), "ts", "rts", "rid", ["rid"]).collect()] == [None] * 3
    assert asof_join_keyless(left.limit(0), right, "ts", "rts", "rid", ["rid"]).count() == 0


def test_one_day_of_many_series_is_many_parts(spark):
    """1,000 series at one instant: no part holds over twice its share."""
    rows = spark.range(1000).select("id", F.timestamp_seconds(F.lit(0)).alias("ts"))
    sizes = [r["count"] for r in dealt(rows).groupBy("_part").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 2 * 1000 / SALTS


def test_rows_with_maps(spark):
    """A record's features are a map, which has no hash; context joins all the same."""
    rows = spark.range(20).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.create_map(F.lit("a"), F.lit(1.0)).alias("features"))
    context = spark.range(1).select(F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit(4.0).alias("score"))
    out = enrich(rows, context, ["score"], 2 * 3_600_000_000, {"score": 50.0}).collect()
    assert len(out) == 20 and sorted((r.id, r.context_imputed) for r in out) == [(i, int(i > 2)) for i in range(20)] and {r.score for r in out} == {4.0}
