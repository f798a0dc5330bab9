"""Trailing features in pieces against one window over each series."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hindsail.functions import windows as W

FEATURES = {"momentum": (lambda df, key: W.momentum_score(df, key), 30), "before": (lambda df, key: W.momentum_score(df, key, include_current=False), 30), "volatility": (W.trailing_volatility, 14), "trend": (W.trend_strength, 21), "regime": (W.regime_magnitude, 21)}


@pytest.fixture(scope="module")
def prices(spark):
    """Even, bursty and sparse series, ties, null times, a null series, short ones, and a column named as a piece's own."""
    r = random.Random(4)
    rows, i = [], 0
    for name, n, step in (("even", 700, lambda: 60), ("bursts", 900, lambda: r.choice([1, 1, 1, 1, 100_000])), ("sparse", 80, lambda: r.choice([1, 10**7])), ("ties", 300, lambda: r.choice([0, 0, 30])), (None, 60, lambda: 5), ("short", 3, lambda: 9)):
        t = 0
        for k in range(n):
            t += step()
            i += 1
            rows.append((name, i, None if name == "ties" and k % 90 == 0 else t, 100 + r.gauss(0, 5), "x"))
    return spark.createDataFrame(rows, "series_id string, obs_id long, s long, price double, piece string").withColumn("ts", F.timestamp_seconds("s")).repartition(5)


@pytest.mark.parametrize("name", FEATURES)
@pytest.mark.parametrize("rows", [7, 50, 4096])
def test_pieces_change_nothing(prices, name, rows, monkeypatch):
    monkeypatch.setattr(W, "WHOLE", 0)
    feature, before = FEATURES[name]
    plain = sorted(map(str, feature(prices, ["series_id"]).collect()))
    assert sorted(map(str, W.in_pieces(prices, feature, before, rows=rows).collect())) == plain


def test_a_long_series_is_many_tasks(spark):
    """400,000 rows of one series: the last stage's partitions hold a small part of them each."""
    one = spark.range(400_000).select(F.lit("a").alias("series_id"), F.col("id").alias("obs_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.rand(3) + 1).alias("price"))
    conf = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    old = [spark.conf.get(c) for c in conf]
    try:
        spark.conf.set(conf[0], "32")
        spark.conf.set(conf[1], "false")
        sizes = W.in_pieces(one, W.momentum_score, 30).select(F.spark_partition_id().alias("p"), "technical_score").groupBy("p").agg(F.count("technical_score").alias("n")).collect()
    finally:
        for c, v in zip(conf, old):
            spark.conf.set(c, v)
    assert sum(r["n"] for r in sizes) == 400_000 and len(sizes) > 20 and max(r["n"] for r in sizes) < 60_000


def test_nothing(spark, prices):
    assert W.in_pieces(prices.limit(0), W.momentum_score, 30).count() == 0
