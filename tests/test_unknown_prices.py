"""Prices that are null or 0: queries and SQL state the same rules for returns and averages that are unknown."""

import compare
import pytest

from hindsail.plans.oracle import ORACLE
from hindsail.plans.queries import QUERIES

NAMES = [
    "regime_anomaly",
    "regime_magnitude",
    "trend_strength",
    "analog_forecast",
    "analog_weighted",
    "prediction_record",
    "analog_context",
    "forward_returns",
    "trailing_volatility",
    "backtest_combined",
    "backtest_momentum",
    "backtest_regime_split",
    "backtest_single",
    "challenger_calibrated",
    "challenger_forecast",
    "prediction_columns",
]


@pytest.fixture(scope="module")
def gaps(small, tmp_path_factory):
    """The small tables with a null price in 23 and a price of 0 in 29 events."""
    folder = tmp_path_factory.mktemp("gaps")
    con = compare.connect(small)
    for name in compare.TABLES:
        value = "CASE WHEN event_id % 23 = 5 THEN NULL WHEN event_id % 29 = 7 THEN -1.0 ELSE value END AS value"
        con.execute(f"COPY (SELECT * {f'REPLACE ({value})' if name == 'events' else ''} FROM {name}) TO '{folder}/{name}.parquet'")
    return str(folder), compare.connect(str(folder))


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal(spark, gaps, name):
    folder, con = gaps
    assert compare.differences(QUERIES[name](spark, folder), ORACLE[name], con) == []
