"""Recalibration of probabilities by equal-count runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expressions import exact_sum, mean_of, ratio

#: Parts of the value range that a key's rows are ranked in; a long key is so many window partitions.
PARTS = 1000


def ranked(df: DataFrame, key: Sequence[str], value: str, tie: str, parts: int = PARTS) -> DataFrame:
    """df with `_rank` (from 1, by value then tie) and `_size` of its key, for values from 0 to 1.

    Rows are ranked inside equal parts of the value range; the counts of lower
    parts, at most `parts` rows a key, are added. No key is sorted in one task.
    """
    cut = df.withColumn("_part", F.least(F.floor(F.col(value) * parts), F.lit(parts)))
    sums = cut.groupBy(*key, "_part").agg(F.count("*").alias("_count"))
    w = Window.partitionBy(*key)
    below = sums.select(*key, "_part", F.coalesce(F.sum("_count").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"), F.sum("_count").over(w).alias("_size"))
    inner = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(value, tie))
    return cut.withColumn("_in", inner).join(below, [*key, "_part"]).withColumn("_rank", F.col("_in") + F.col("_below")).drop("_part", "_in", "_below")


def _runs(df: DataFrame, key: Sequence[str], p: str, y: str, tie: str, bins: int = 10, min_n: int = 10) -> DataFrame:
    """(key, decile, sum_p, sum_y, n_samples) of the runs that a curve consists of, sums as decimals."""
    known = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    decile = F.floor((F.col("_rank") - 1) / F.ceil(F.col("_size") / bins)).cast("int")
    by = ranked(known, key, p, tie).groupBy(*key, decile.alias("decile"))
    return by.agg(exact_sum(F.col(p)).alias("sum_p"), exact_sum(F.col(y)).alias("sum_y"), F.count("*").alias("n_samples")).where(F.col("n_samples") >= min_n)


def calibration_curve(df: DataFrame, key: Sequence[str], p: str = "p_up", y: str = "realized_up", tie: str = "id", bins: int = 10, min_n: int = 10) -> DataFrame:
    """(key, decile, predicted_p_up_mid, empirical_up_rate, n_samples): runs of ceil(n / bins) rows by p; runs under min_n are dropped. Rows without p or outcome take no part."""
    n = F.col("n_samples")
    return _runs(df, key, p, y, tie, bins, min_n).select(*key, "decile", mean_of(F.col("sum_p"), n).alias("predicted_p_up_mid"), ratio(F.col("sum_y"), n).alias("empirical_up_rate"), "n_samples")


def apply_calibration(df: DataFrame, curve: DataFrame, key: Sequence[str], p: str = "p_up", min_n: int = 10, name: str = "p_up_calibrated") -> DataFrame:
    """df with the rate of the curve's nearest run (ties: the lower decile); p itself if the key has no curve, the run is thin or p lies outside [0, 1].

    The curve has at most ten rows a key, gathered into one array and joined on the key.
    """
    runs = curve.groupBy(*key).agg(F.collect_list(F.struct("predicted_p_up_mid", "decile", "empirical_up_rate", "n_samples")).alias("_curve"))
    best = F.array_min(F.transform("_curve", lambda r: F.struct(F.abs(r["predicted_p_up_mid"] - F.col(p)).alias("gap"), r["decile"].alias("decile"), r["empirical_up_rate"].alias("rate"), r["n_samples"].alias("n"))))
    joined = df.join(runs, list(key), "left").withColumn("_best", best)
    use = F.col(p).between(0, 1) & (F.col("_best.n") >= min_n)
    return joined.withColumn(name, F.when(use, F.col("_best.rate")).otherwise(F.col(p))).drop("_curve", "_best")


def refresh_curves(ledger: DataFrame, key: Sequence[str], computed_ts, min_rows: int = 20, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(curve rows stamped computed_ts, status per key): keys under min_rows resolved rows get no curve and the status insufficient_data."""
    y = columns.get("y", "realized_up")
    sizes = ledger.groupBy(*key).agg(F.count(y).alias("n_resolved"))
    enough = sizes.where(F.col("n_resolved") >= min_rows).select(*key)
    curve = calibration_curve(ledger.join(enough, list(key), "left_semi"), key, **columns).withColumn("computed_ts", F.lit(computed_ts))
    return curve, sizes.withColumn("status", F.when(F.col("n_resolved") >= min_rows, "ok").otherwise("insufficient_data"))


def latest_batch(df: DataFrame, key: Sequence[str], ts_col: str = "computed_ts") -> DataFrame:
    """Rows of each key's newest batch."""
    return df.withColumn("_newest", F.max(ts_col).over(Window.partitionBy(*key))).where(F.col(ts_col) == F.col("_newest")).drop("_newest")


def newest(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest n rows of each key, by the order columns descending."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def calibration_gaps(df: DataFrame, key: Sequence[str], p: str = "p_up", y: str = "realized_up", tie: str = "id") -> DataFrame:
    """(key, gap, gap_n): the sum over the runs of |sum of p - sum of outcomes|, as a decimal, and the runs' rows. gap / gap_n is the calibration error."""
    return _runs(df, key, p, y, tie).groupBy(*key).agg(F.sum(F.abs(F.col("sum_p") - F.col("sum_y"))).alias("gap"), F.sum("n_samples").alias("gap_n"))


def calibration_error(df: DataFrame, key: Sequence[str], p: str = "p_up", y: str = "realized_up", tie: str = "id", min_rows: int = 20) -> DataFrame:
    """(key, calibration_error): the runs' mean distance between prediction and rate, by size; null under min_rows rows or without a run."""
    sizes = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*key).agg(F.count("*").alias("_n"))
    return sizes.join(calibration_gaps(df, key, p, y, tie), list(key), "left").select(*key, F.when(F.col("_n") >= min_rows, ratio(F.col("gap"), F.col("gap_n"))).alias("calibration_error"))
