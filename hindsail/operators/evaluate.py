"""Scores, reports and drift of a ledger of forecasts, and its resolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import HOUR, confidence, correct, exact_sum, log_loss, micros, percent_return, preferred, ratio, rounded_ratio, trend_regime, units, volatility_regime, went_up
from .calibration import calibration_gaps
from .prefix import running
from .timejoin import asof_join, nearest_join

KEY = ("coin", "horizon_hours")


def _sums(df: DataFrame, key: Sequence[str], p: str, y: str, tie: str = ">=") -> DataFrame:
    """(key, n, hits, squares, losses, ups, sum_p) over rows with p and outcome: what scores are made of, in decimals, so that neither partitions nor order show."""
    known = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    off = F.col(p) - F.col(y)
    parts = {"hits": correct(F.col(p), F.col(y), tie).cast("int"), "squares": off * off, "losses": log_loss(F.col(p), F.col(y)), "ups": F.col(y), "sum_p": F.col(p)}
    return known.groupBy(*key).agg(F.count("*").alias("n"), *[exact_sum(c).alias(name) for name, c in parts.items()])


SCORES = {"accuracy": "hits", "brier": "squares", "log_loss": "losses", "up_rate": "ups", "avg_p": "sum_p"}


def score(df: DataFrame, key: Sequence[str], p: str = "p_up", y: str = "realized_up", tie: str = ">=") -> DataFrame:
    """(key, n, accuracy, brier, log_loss, up_rate, avg_p) over rows with p and outcome."""
    return _sums(df, key, p, y, tie).select(*key, "n", *[ratio(F.col(total), F.col("n")).alias(name) for name, total in SCORES.items()])


def summarize(df: DataFrame, key: Sequence[str], p: str = "p_up", y: str = "realized_up", tie: str = "id", min_sample: int = 20) -> DataFrame:
    """score() and the calibration error, rounded half up to 4 places from exact sums, with status; under min_sample rows only n and insufficient_data."""
    both = _sums(df, key, p, y).join(calibration_gaps(df, key, p, y, tie), list(key), "left")
    ok = F.col("n") >= min_sample
    numbers = {"accuracy": ("hits", "n"), "brier_score": ("squares", "n"), "log_loss": ("losses", "n"), "calibration_error": ("gap", "gap_n"), "realized_up_rate": ("ups", "n"), "avg_predicted_p_up": ("sum_p", "n")}
    return both.select(*key, F.when(ok, "ok").otherwise("insufficient_data").alias("status"), "n", *[F.when(ok, rounded_ratio(F.col(total), F.col(n))).alias(name) for name, (total, n) in numbers.items()])


def calibration_summary(ledger: DataFrame, key: Sequence[str] = KEY, p: str = "p_up") -> DataFrame:
    """(key, n_resolved, accuracy, brier, up_rate, brier_base_rate, best_naive, beats_naive): the naive forecasts are one half and the base rate."""
    s = score(ledger, key, p)
    base = F.col("up_rate") * (1 - F.col("up_rate"))
    best = F.least(F.lit(0.25), base)
    return s.select(*key, F.col("n").alias("n_resolved"), "accuracy", "brier", "up_rate", base.alias("brier_base_rate"), best.alias("best_naive"), (F.col("brier") < best).alias("beats_naive"))


def compare_variants(ledger: DataFrame, key: Sequence[str] = KEY, a: str = "p_up", b: str = "p_up_experimental", y: str = "realized_up", min_n: int = 20) -> DataFrame:
    """(key, n_paired, brier_a, brier_b, b_wins) on the rows where both variants exist; null scores under min_n of them."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    known = ledger.where(F.col(y).isNotNull())
    mean = lambda c: F.avg(F.when(both, (F.col(c) - F.col(y)) ** 2))
    out = known.groupBy(*key).agg(F.count_if(both).alias("n_paired"), mean(a).alias("ma"), mean(b).alias("mb"))
    ok = F.col("n_paired") >= min_n
    return out.select(*key, "n_paired", F.when(ok, F.col("ma")).alias("brier_a"), F.when(ok, F.col("mb")).alias("brier_b"), F.when(ok, F.col("mb") < F.col("ma")).alias("b_wins"))


def unpivot_variants(ledger: DataFrame, variants: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """Long form: (keep, variant, p) for each variant's probability column, nulls kept."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(c).alias("p")) for v, c in variants.items()])).alias("_v")
    return ledger.select(*keep, pairs).select(*keep, "_v.variant", "_v.p")


def expanding_history(ledger: DataFrame, variants: Mapping[str, str], key: Sequence[str] = KEY, order: Sequence[str] = ("resolved_ts", "id"), y: str = "realized_up", carry: bool = True) -> DataFrame:
    """Per resolved row and variant: n so far, brier_so_far (4 places), accuracy_so_far (3 places, calls above one half are up).

    A row without the variant's probability repeats its running values, or has
    nulls with carry off. Days are the buckets of the running sums.
    """
    long = unpivot_variants(ledger.where(F.col(y).isNotNull()), variants, [*key, *order, y])
    has = F.col("p").isNotNull()
    sums = {"_n": has.cast("int"), "_b": (F.col("p") - F.col(y)) ** 2, "_a": correct(F.col("p"), F.col(y), ">").cast("int")}
    out = running(long, [*key, "variant"], order, F.to_date(order[0]), sums)
    show = F.lit(True) if carry else has
    value = lambda s, d: F.when(show & (F.col("_n") > 0), F.round(F.col(s) / F.col("_n"), d))
    return out.select(*key, *order, "variant", F.col("_n").cast("long").alias("n_so_far"), value("_b", 4).alias("brier_so_far"), value("_a", 3).alias("accuracy_so_far"))


def ma_baseline(rows: DataFrame, prices: DataFrame, key: Sequence[str] = ("series_id",), n: int = 20, min_n: int = 10, price: str = "price") -> DataFrame:
    """rows(key, ts, price) with ma_up: 1 if the price lies above the mean of the last n series prices up to ts, else 0; null under min_n of them. Of rows of one time the smallest obs_id is the last. Prices are taken to 12 decimals and compared exactly."""
    w = Window.partitionBy(*key).orderBy("ts", F.desc("obs_id")).rowsBetween(1 - n, 0)
    own = units(F.col("price"))
    sums = prices.select(*key, "ts", "obs_id", F.sum(own).over(w).cast("decimal(32,0)").alias("_sum"), F.count(own).over(w).cast("decimal(4,0)").alias("_held"))
    seen = asof_join(rows, sums, key, "ts", "ts", "obs_id", ["_sum", "_held"])
    above = units(F.col(price)) * F.col("_held") > F.col("_sum")
    return seen.withColumn("ma_up", F.when((F.col("_held") >= min_n) & (F.col(price) != 0), above.cast("int"))).drop("_sum", "_held")


def evaluate_challenger(rows: DataFrame, key: Sequence[str] = KEY, flat: str = "p_up_flat", tilted: str = "p_up_tilted", y: str = "realized_up", min_n: int = 5, min_ma: int = 5) -> DataFrame:
    """Per key of resolved challenger rows (with ma_up and driver_agreement): accuracies (calls above one half are up), Briers, naive and moving-average baselines, flags and driver counts, to 3 places; only n under min_n rows."""
    known = rows.where(F.col(y).isNotNull())
    acc = lambda c: F.avg(correct(F.col(c), F.col(y), ">").cast("int"))
    brier = lambda c: F.avg((F.col(c) - F.col(y)) ** 2)
    drivers = {"agree": F.col("driver_agreement") == "agree", "disagree": F.col("driver_agreement") == "disagree", "uncovered": F.col("driver_agreement") == "uncovered", "no_driver_applied": F.col("driver_agreement").isNull()}
    s = known.groupBy(*key).agg(F.count("*").alias("n_resolved"), F.avg(y).alias("_up"), acc(flat).alias("_af"), acc(tilted).alias("_at"), brier(flat).alias("_bf"), brier(tilted).alias("_bt"), F.count("ma_up").alias("n_ma"), F.avg((F.col("ma_up") == F.col(y)).cast("int")).alias("_ma"), *[F.count_if(c).alias(f"drivers_{k}") for k, c in drivers.items()])
    ok, naive = F.col("n_resolved") >= min_n, F.greatest(F.col("_up"), 1 - F.col("_up"))
    ma = F.when(F.col("n_ma") >= min_ma, F.col("_ma"))
    numbers = {"historical_up_rate": F.col("_up"), "accuracy_flat": F.col("_af"), "accuracy_tilted": F.col("_at"), "brier_flat": F.col("_bf"), "brier_tilted": F.col("_bt"), "naive_baseline_accuracy": naive, "brier_baseline_up_rate": F.col("_up") * (1 - F.col("_up")), "ma_crossover_accuracy": ma}
    flags = {"beats_naive_flat": F.col("_af") > naive, "beats_naive_tilted": F.col("_at") > naive, "beats_ma_crossover_flat": F.col("_af") > ma, "beats_ma_crossover_tilted": F.col("_at") > ma}
    return s.select(*key, "n_resolved", *[F.when(ok, F.round(v, 3)).alias(k) for k, v in numbers.items()], *[F.when(ok, v).alias(k) for k, v in flags.items()], *[f"drivers_{k}" for k in drivers])


# Lower bounds of the confidence buckets; the last has no upper one.
BOUNDS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)


def bucket_of(conf: Column) -> Column:
    """Index of a confidence's bucket, null under one half."""
    at = F.lit(None).cast("int")
    for k, lo in enumerate(BOUNDS):
        at = F.when(conf >= lo, F.lit(k)).otherwise(at)
    return at


def confidence_buckets(df: DataFrame, key: Sequence[str] = KEY, p: str = "p_up", y: str = "realized_up") -> DataFrame:
    """(key, range, n, accuracy, overconfident_flag) for each bucket, empty ones with n 0 and nulls; the flag marks a midpoint over 0.05 above the accuracy."""
    known = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    tops = [*BOUNDS[1:], 1.0]
    names = [f"{lo:.2f}-{hi:.2f}" for lo, hi in zip(BOUNDS, tops)][:-1] + [f"{BOUNDS[-1]:.2f}+"]
    frame = F.explode(F.array(*[F.struct(F.lit(k).alias("bucket"), F.lit(n).alias("range"), F.lit((lo + hi) / 2).alias("mid")) for k, (n, lo, hi) in enumerate(zip(names, BOUNDS, tops))])).alias("_b")
    by = known.withColumn("bucket", bucket_of(confidence(F.col(p)))).groupBy(*key, "bucket").agg(F.count("*").alias("n"), F.avg(correct(F.col(p), F.col(y)).cast("int")).alias("acc"))
    every = known.select(*key).distinct().select(*key, frame).select(*key, "_b.*")
    return every.join(by, [*key, "bucket"], "left").select(*key, "range", F.coalesce("n", F.lit(0)).alias("n"), F.round("acc", 3).alias("accuracy"), (F.col("mid") - F.col("acc") > 0.05).alias("overconfident_flag"))


def confident_mistakes(df: DataFrame, key: Sequence[str] = KEY, n: int = 5, p: str = "p_up", y: str = "realized_up", ts: str = "ts", row_id: str = "id") -> DataFrame:
    """The n wrong calls of highest confidence of each key, ties by time and id."""
    wrong = df.where(F.col(p).isNotNull() & F.col(y).isNotNull() & ~correct(F.col(p), F.col(y))).withColumn("confidence", F.round(confidence(F.col(p)), 3))
    order = Window.partitionBy(*key).orderBy(F.desc("confidence"), ts, row_id)
    return wrong.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(*key, "place", row_id, F.round(p, 3).alias("p"), "confidence", y)


def by_regime(df: DataFrame, key: Sequence[str] = KEY, **columns) -> DataFrame:
    """summarize() of each trend, volatility and anomaly regime; every row counts in three."""
    tags = F.array(F.concat(F.lit("trend:"), trend_regime(F.col("trend_strength"))), F.concat(F.lit("volatility:"), volatility_regime(F.col("volatility_percentile"))), F.when(F.col("is_regime_anomaly") == 1, "anomaly:yes").otherwise("anomaly:no"))
    return summarize(df.withColumn("regime", F.explode(tags)), [*key, "regime"], **columns)


WINDOWS = {"last_24h": 24, "last_7d": 7 * 24, "last_30d": 30 * 24, "full_history": None}


def drift(df: DataFrame, now: Column, key: Sequence[str] = KEY, threshold: float = 0.15, **columns) -> DataFrame:
    """summarize() over four windows before now, by resolved_ts, every key and window present; drift_flag on full_history if its accuracy and that of the last 7 days, both with enough rows, differ by more than threshold."""
    known = df.where(F.col("realized_up").isNotNull() & F.col("resolved_ts").isNotNull())
    age = micros(now) - micros(F.col("resolved_ts"))
    labels = F.array_compact(F.array(*[F.when(age <= h * HOUR if h else F.lit(True), F.lit(w)) for w, h in WINDOWS.items()]))
    by = summarize(known.withColumn("window", F.explode(labels)), [*key, "window"], **columns)
    every = known.select(*key).distinct().withColumn("window", F.explode(F.array(*[F.lit(w) for w in WINDOWS])))
    out = every.join(by, [*key, "window"], "left").withColumn("status", F.coalesce("status", F.lit("insufficient_data"))).withColumn("n", F.coalesce("n", F.lit(0)))
    week = F.max(F.when(F.col("window") == "last_7d", F.col("accuracy"))).over(Window.partitionBy(*key))
    return out.withColumn("drift_flag", F.when(F.col("window") == "full_history", F.coalesce(F.abs(week - F.col("accuracy")) > threshold, F.lit(False))))


def resolved(ledger: DataFrame, raw: str = "p_up", calibrated: str | None = None, coin: str | None = None, horizon_hours: int | None = None, since: Column | None = None) -> DataFrame:
    """Resolved rows, optionally of one series, horizon and time, with p: the calibrated probability where there is one, else the raw."""
    out = ledger.where(F.col("realized_up").isNotNull())
    for test in (coin and F.col("coin") == coin, horizon_hours and F.col("horizon_hours") == horizon_hours):
        out = out.where(test) if test is not None else out
    out = out.where(F.col("resolved_ts") >= since) if since is not None else out
    return out.withColumn("p", preferred(F.col(calibrated), F.col(raw)) if calibrated else F.col(raw))


def dataset_health(ledger: DataFrame, since: Column, until: Column, key: Sequence[str] = ("coin",)) -> DataFrame:
    done = F.col("realized_up").isNotNull()
    return ledger.groupBy(*key).agg(F.count("*").alias("total"), F.count_if(~done).alias("unresolved"), F.count_if(done & (F.col("resolved_ts") >= since) & (F.col("resolved_ts") < until)).alias("resolved_in_period"))


def resolve(ledger: DataFrame, prices: DataFrame, as_of: Column, tol: int, key: Sequence[str] = ("series_id",)) -> DataFrame:
    """Outcomes of due, unresolved rows of ledger(id, key, target_ts, price): the price nearest to target_ts within tol microseconds, its return and direction. Append them; the ledger is never changed."""
    due = ledger.where(F.col("target_ts") <= as_of)
    out = nearest_join(due, prices, key, "target_ts", "ts", tol, "obs_id", ["price", "ts"], prefix="_r_")
    ret = percent_return(F.col("price"), F.col("_r_price"))
    return out.select(F.col("id").alias("prediction_id"), F.col("_r_price").alias("realized_price"), ret.alias("realized_return"), went_up(ret).alias("realized_up"), as_of.alias("resolved_ts"))


def with_outcomes(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger as read: each row with its outcome, if it has one."""
    return ledger.join(outcomes.withColumnRenamed("prediction_id", "id"), "id", "left")


def resolve_bias(analyses: DataFrame, prices: DataFrame, as_of: Column, tol: int, key: Sequence[str] = ("series_id",), hours: int = 24) -> DataFrame:
    """Analyses(id, key, ts, price, bias) older than `hours` with return_pct and bias_correct: bullish up, bearish down, neutral under 1 percent either way. Those without a bias or with a price of zero stay unresolved and are left out."""
    due = analyses.where(micros(F.col("ts")) <= micros(as_of) - hours * HOUR)
    out = nearest_join(due, prices, key, F.col("ts") + F.expr(f"interval {hours} hour"), "ts", tol, "obs_id", ["price"], prefix="_r_")
    ret = F.col("return_pct")
    right = F.when(F.col("bias") == "bullish", ret > 0).when(F.col("bias") == "bearish", ret < 0).when(F.col("bias") == "neutral", F.abs(ret) < 1)
    known = F.col("bias").isNotNull() & (F.col("price") != 0)
    return out.where(known).withColumn("return_pct", percent_return(F.col("price"), F.col("_r_price"))).withColumn("bias_correct", right.cast("int")).drop("_r_price", "_diff")


def daily_report(ledger: DataFrame, now: Column, day: str | None = None, challenger: DataFrame | None = None, catalysts: DataFrame | None = None, min_sample: int = 20) -> DataFrame:
    """Long table (section, coin, key, metric, value): summaries by series and by horizon, confidence buckets with their worst mistakes, regimes, ten mistakes a series, drift, health, production beside challenger, catalysts, and one status row.

    With day (YYYY-MM-DD) only rows resolved on that UTC day count, in health
    and drift windows too, still measured against now. The confidence section
    of a series with fewer than min_sample rows is its number alone.
    challenger(coin, horizon_hours, resolved_ts, p, realized_up, id) is compared
    for the series it has; catalysts(id, coin, ts) are the newest 100 of the
    day, or of all days. The status is YELLOW if every series is short of data
    or any drifts, else GREEN.
    """
    inside = (lambda c: F.to_date(c) == F.lit(day).cast("date")) if day else (lambda c: F.lit(True))
    rows = resolved(ledger).where(inside("resolved_ts"))

    def long(df: DataFrame, section: str, key: Column, metrics: Sequence[str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")
        return df.select(F.lit(section).alias("section"), F.col("coin"), key.cast("string").alias("key"), each).select("section", "coin", "key", "_m.metric", "_m.value")

    metrics = ["n", "accuracy", "brier_score", "log_loss", "calibration_error"]
    series, moved = summarize(rows, ["coin"], min_sample=min_sample), drift(rows, now, ["coin"])
    enough = series.where(F.col("status") == "ok").select("coin")
    mistakes = confident_mistakes(rows, ["coin"], n=10)
    done = F.col("realized_up").isNotNull()
    health = ledger.groupBy("coin").agg(F.count("*").alias("total"), F.count_if(~done).alias("unresolved"), F.count_if(done & (inside("resolved_ts") if day else F.col("resolved_ts") < now)).alias("resolved_in_period"))
    parts = [
        long(series, "series", F.lit("all"), metrics),
        long(summarize(rows, ["coin", "horizon_hours"], min_sample=min_sample), "horizon", F.col("horizon_hours"), metrics),
        long(confidence_buckets(rows, ["coin"]).join(enough, "coin", "left_semi"), "confidence", F.col("range"), ["n", "accuracy"]),
        long(mistakes.where("place <= 5").join(enough, "coin", "left_semi"), "confident_mistake", F.col("place"), ["id", "p", "confidence"]),
        long(series.where(F.col("status") != "ok"), "confidence", F.lit("insufficient_data"), ["n"]),
        long(by_regime(rows, ["coin"]), "regime", F.col("regime"), ["n", "accuracy", "brier_score"]),
        long(mistakes, "mistake", F.col("place"), ["id", "p", "confidence"]),
        long(moved.withColumn("drift", F.col("drift_flag").cast("int")), "drift", F.col("window"), ["n", "accuracy", "drift"]),
        long(health, "health", F.lit("all"), ["total", "unresolved", "resolved_in_period"]),
    ]
    if challenger is not None:
        other = challenger.where(F.col("realized_up").isNotNull() & inside("resolved_ts"))
        own = series.join(challenger.select("coin").distinct(), "coin", "left_semi")
        parts += [long(own, "comparison", F.lit("production"), metrics), long(summarize(other, ["coin"], p="p", min_sample=min_sample), "comparison", F.lit("challenger"), metrics)]
    if catalysts is not None:
        newest = catalysts.where(inside("ts")).orderBy(F.desc("ts"), F.desc("id")).limit(100)
        parts.append(long(newest, "catalyst", F.col("id"), ["id"]))
    out = reduce(DataFrame.unionByName, parts)
    short = series.agg(F.coalesce(F.bool_and(F.col("status") != "ok"), F.lit(True)).alias("_short"))
    drifted = moved.agg(F.coalesce(F.bool_or("drift_flag"), F.lit(False)).alias("_drift"))
    state = short.crossJoin(drifted)  # one row each
    return out.unionByName(state.select(F.lit("status").alias("section"), F.lit(None).cast("string").alias("coin"), F.when(F.col("_short") | F.col("_drift"), "YELLOW").otherwise("GREEN").alias("key"), F.lit("status").alias("metric"), F.lit(1.0).alias("value")))


def compact(report: DataFrame) -> DataFrame:
    """The report's headline rows: series and horizon summaries, comparison, drift flags, mistakes, catalysts, health and status."""
    flags = (F.col("section") == "drift") & (F.col("metric") == "drift") & F.col("value").isNotNull()
    return report.where(F.col("section").isin("series", "horizon", "comparison", "mistake", "catalyst", "health", "status") | flags)
