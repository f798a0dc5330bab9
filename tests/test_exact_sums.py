"""Results at ties do not rest on the order or rounding of sums."""

import datetime

import pytest

from hindsail.functions import ranks, windows
from hindsail.operators import evaluate

DAY = datetime.datetime(2024, 1, 1)


def prices_of(spark, values):
    rows = [(1, i, DAY + datetime.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id long, obs_id long, ts timestamp_ntz, price double")


def test_momentum_rounds_an_exact_half_up(spark):
    from hindsail.streaming.jobs import TickScores

    values = [5.0, 5.1, 5.31, 5.45, 5.48, 5.46, 5.3, 5.33, 5.44]
    assert windows.momentum_score(prices_of(spark, values)).orderBy("obs_id").collect()[-1].technical_score == 78.0 == TickScores.score(values)


def test_a_flat_price_is_not_above_its_mean(spark):
    rows = prices_of(spark, [0.13] * 25)
    assert {r.ma_up for r in evaluate.ma_baseline(rows, rows).where("obs_id >= 19").collect()} == {0}


def test_half_of_the_weight_is_reached(spark):
    rows = spark.createDataFrame([(1, float(i), w) for i, w in enumerate([0.6, 0.7, 0.5, 0.8])], "k long, v double, w double")
    assert ranks.weighted_quantile(rows, ["k"], "v", "w", 0.5).first().quantile == 1.0


@pytest.mark.parametrize("name", ["challenger_calibrated", "prediction_columns"])
def test_sql_goes_on_with_unrounded_values(name):
    from hindsail.plans.oracle import ORACLE

    assert "THEN p END AS p_up," in ORACLE[name] if name == "prediction_columns" else "ELSE f END)), 6)" not in ORACLE[name]
