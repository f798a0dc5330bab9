"""Walk-forward backtests: every row forecast from strictly earlier ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import exact_sum, mean_of, or_one
from ..functions.windows import next_return
from . import kernels


def walk_forward(rows: DataFrame, features: Sequence[str], k: int, warmup: Column, key: Sequence[str] = ("series_id",), ts: str = "ts", tie: str = "obs_id", price: str = "price", stats: str = "none", block: int = kernels.BLOCK) -> DataFrame:
    """(key, tie, ts, p_up, realized_up): each row after the warm-up but the last, forecast by the next-row returns of its k nearest earlier rows.

    warmup: how many rows of a series ask for nothing, an expression over
    `_size`, its row count. stats: "none" compares values as they are, "prior"
    divides by the deviation of strictly earlier rows. A row with fewer than k
    earlier rows is not forecast. A return that is unknown, by a null price or
    one of 0, is left out of p_up, and a row's own one is no outcome: null.
    """
    w = Window.partitionBy(*key)
    order = w.orderBy(ts, tie)
    numbered = next_return(rows, key, ts, price, tie, "_ret").withColumn("_rn", F.row_number().over(order)).withColumn("_size", F.count("*").over(w)).withColumn("_from", warmup + 1)
    scales = None
    if stats == "prior":
        for i, f in enumerate(features):
            numbered = numbered.withColumn(f"_s{i}", or_one(F.stddev_pop(f).over(order.rowsBetween(Window.unboundedPreceding, -1))))
        scales = [f"_s{i}" for i in range(len(features))]
    asks = numbered.withColumn("_from", F.when(F.col("_rn") < F.col("_size"), F.col("_from")).otherwise(F.col("_size") + 1))
    near = kernels.prior_top_k(asks, key, "_rn", features, k, scales, carry="_ret", block=block, first_query="_from")
    by = near.groupBy(*key, F.col("rn").alias("_rn")).agg(F.count("*").alias("_k"), F.avg((F.col("carry") > 0).cast("int")).alias("p_up")).where(F.col("_k") >= k)
    return numbered.join(by, [*key, "_rn"]).select(*key, tie, ts, "p_up", (F.col("_ret") > 0).cast("int").alias("realized_up"))


def single_warmup() -> Column:
    return F.greatest(F.lit(10), F.floor(F.col("_size") * 0.15))


def combined_warmup() -> Column:
    return F.greatest(F.lit(15), F.floor(F.col("_size") * 0.2))


def backtest_summary(preds: DataFrame, key: Sequence[str] = ("series_id",), ts: str = "ts", digits: int = 3) -> DataFrame:
    """(key, n_predictions, accuracy, brier_score, historical_up_rate, naive_baseline_brier, beats_naive_baseline, date_range_start, date_range_end), to so many digits, of the rows that have a forecast and an outcome. Squares are summed exactly to 12 decimals."""
    hit = ((F.col("p_up") >= 0.5) == (F.col("realized_up") == 1)).cast("int")
    s = preds.where("p_up is not null and realized_up is not null").groupBy(*key).agg(F.count("*").alias("n_predictions"), F.avg(hit).alias("a"), mean_of(exact_sum((F.col("p_up") - F.col("realized_up")) ** 2), F.count("*")).alias("b"), F.avg("realized_up").alias("u"), F.min(ts).alias("date_range_start"), F.max(ts).alias("date_range_end"))
    naive = F.least(F.lit(0.25), F.col("u") * (1 - F.col("u")))
    return s.select(*key, "n_predictions", F.round("a", digits).alias("accuracy"), F.round("b", digits).alias("brier_score"), F.round("u", digits).alias("historical_up_rate"), F.round(naive, digits).alias("naive_baseline_brier"), (F.col("b") < naive).alias("beats_naive_baseline"), "date_range_start", "date_range_end")


def regime_split(preds: DataFrame, by: str, key: Sequence[str] = ("series_id",), digits: int = 3) -> DataFrame:
    """backtest_summary() of the rows at or above, and below, the floor(n / 2)-th smallest value of `by` of each key."""
    w = Window.partitionBy(*key)
    ranked = preds.withColumn("_n", F.row_number().over(w.orderBy(by))).withColumn("_size", F.count("*").over(w))
    middle = F.max(F.when(F.col("_n") == F.floor(F.col("_size") / 2) + 1, F.col(by))).over(w)
    return backtest_summary(ranked.withColumn("_middle", middle).withColumn("side", F.when(F.col(by) >= F.col("_middle"), "high").otherwise("low")), [*key, "side"], digits=digits)
