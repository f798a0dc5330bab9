"""Distances of nine places that lie at a half of the sixth round alike in query and SQL."""

import duckdb
from pyspark.sql import functions as F

from hindsail.plans import oracle, queries

#: As doubles their sum is 3.1074014999999995.
FIVE = [0.213119887, 0.74034219, 0.998071356, 0.177941624, 0.977926443]


def test_sum_of_five(spark):
    kind = "array<struct<obs_id long, date string, dist double>>"
    rows = spark.createDataFrame([([(i, "d", x) for i, x in enumerate(FIVE)],)], f"closest {kind}")
    ours = queries.rounded(queries.with_closest(rows)).first()
    total = f"list_sum(list_transform({FIVE}::DOUBLE[], lambda x: {oracle.nanos('x')}))"
    assert ours.closest_dist == 3.107402 == duckdb.connect().execute(f"SELECT {oracle.six_places(total)}").fetchone()[0]


def test_single_distances(spark):
    whole = [k * 1000 + 500 for k in range(1_000_000, 1_003_000)]
    ours = spark.createDataFrame([(k / 1e9,) for k in whole], "x double").select(queries.six_places(queries.nanos(F.col("x"))))
    theirs = duckdb.connect().execute(f"SELECT {oracle.six_places(oracle.nanos('w / 1e9'))} FROM (SELECT unnest({whole})::DOUBLE AS w)").fetchall()
    assert sorted(r[0] for r in ours.collect()) == sorted(r[0] for r in theirs) == [(k + 500) // 1000 / 1e6 for k in whole]


def test_sql_rounds_whole_numbers():
    for name in ("analog_forecast", "analog_context", "regime_anomaly"):
        assert "+ 500) // 1000" in oracle.ORACLE[name], name
