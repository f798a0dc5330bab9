"""Ranks and quantiles by parts of distinct values against sorting, and the plan's windows."""

from __future__ import annotations

import bisect
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hindsail.functions import ranks

#: No parts, few parts, one part a value or so.
CUTS = [{}, {"parts": 4, "whole": 0}, {"parts": 64, "whole": 10}]


@pytest.fixture(scope="module")
def rows(spark):
    """A smooth key, one with a value of two thirds of its rows, heavy tails, a null key, a single row, only nulls, and a column of an inner name."""
    r = random.Random(7)
    out = [("even", r.gauss(0, 1)) for _ in range(800)] + [("hot", 5.0 if r.random() < 0.67 else r.uniform(0, 10)) for _ in range(900)]
    out += [("tails", r.choice([-1, 1]) * 10 ** r.uniform(-9, 9)) for _ in range(500)] + [(None, float(r.randrange(20))) for _ in range(200)]
    out += [("one", 1.5), ("nulls", None), ("nulls", None), ("even", None)]
    r.shuffle(out)
    return [(k, v, (i % 7 + 1) / 8, i) for i, (k, v) in enumerate(out)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v double, w double, _part int").repartition(5)


def by_key(rows):
    held = defaultdict(list)
    for k, v, w, _ in rows:
        held[k].append((v, w))
    return held


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.999, 1.0])
def test_floor_quantile(table, rows, cut, p):
    expected = {}
    for k, held in by_key(rows).items():
        if known := sorted(v for v, _ in held if v is not None):
            expected[k] = known[min(len(known) - 1, int(len(known) * p))]
    assert {r.k: r.quantile for r in ranks.floor_quantile(table, ["k"], "v", p, **cut).collect()} == expected


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("p", [0.1, 0.5, 1.0])
def test_weighted_quantile(table, rows, cut, p):
    """Weights are eighths, so that sums are exact; null values come first and only weigh."""
    expected = {}
    for k, held in by_key(rows).items():
        total, running, best = sum(w for _, w in held), 0.0, None
        for v, w in sorted(held, key=lambda x: (x[0] is not None, x[0] or 0)):
            running += w
            if best is None and v is not None and running / total >= p:
                best = v
        expected[k] = best
    assert {r.k: r.quantile for r in ranks.weighted_quantile(table, ["k"], "v", "w", p, **cut).collect()} == expected


def test_weights_of_nothing(spark):
    df = spark.createDataFrame([(1, 3.0, 0.0), (1, 4.0, 0.0), (2, 1.0, None)], "k int, v double, w double")
    assert {r.k: r.quantile for r in ranks.weighted_quantile(df, ["k"], "v", "w", 0.5).collect()} == {1: 4.0, 2: 1.0}


@pytest.mark.parametrize("cut", CUTS)
def test_rank_in_reference(spark, table, rows, cut):
    refs = table.where("_part % 3 = 0").select("k", F.col("v").alias("ref"))
    known = {k: sorted(v for v, _ in held if v is not None) for k, held in by_key([x for x in rows if x[3] % 3 == 0]).items()}

    def share(k, v):
        held = known.get(k, [])
        return None if v is None or len(held) < 10 else bisect.bisect_right(held, v) / len(held)

    got = ranks.rank_in_reference(table, refs, ["k"], "v", **cut)
    assert got.columns == [*table.columns, "percentile"]
    assert sorted((r._part, r.percentile) for r in got.collect()) == sorted((i, share(k, v)) for k, v, _, i in rows)


def test_rank_of_one_is_the_rank(spark, table):
    refs = table.select("k", F.col("v").alias("ref"))
    values = spark.createDataFrame([("even", 0.3), ("hot", 5.0), ("tails", None), (None, 7.0), ("one", 1.5), ("absent", 1.0)], "k string, value double")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(ranks.rank_of_one(values, refs, ["k"])) == as_set(ranks.rank_in_reference(values, refs, ["k"]))


def test_nothing(table):
    none = table.limit(0)
    assert ranks.floor_quantile(none, ["k"], "v", 0.5).count() == ranks.weighted_quantile(none, ["k"], "v", "w", 0.5).count() == ranks.rank_in_reference(none, none, ["k"], "v", "v").count() == 0


def test_a_long_key_is_sorted_in_parts(spark):
    """200,000 distinct values of one key: every window over values is one of a part, and no part is much larger than its share."""
    one = spark.range(200_000).select(F.lit(1).alias("k"), F.exp(F.randn(5) * 5).alias("v"))
    cut, sums = ranks._cut(ranks._named(one, ["k"], "v", F.lit(1)), ["_k0"], 64, 4096)
    sizes = [r["_s"] for r in sums.collect()]
    assert sum(sizes) == 200_000 and len(sizes) > 50 and max(sizes) < 3 * 200_000 / 64
    plan = ranks.rank_in_reference(one, one, ["k"], "v", "v")._jdf.queryExecution().optimizedPlan().toString()
    over_values = [line for line in plan.splitlines() if "Window [" in line and "_v#" in line.split("windowspecdefinition")[-1]]
    assert over_values and all("_part#" in line for line in over_values)
