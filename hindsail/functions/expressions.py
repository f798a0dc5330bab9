"""Column expressions: returns, probabilities, regimes, normalisers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOUR = 3_600_000_000  # microseconds


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (UTC sessions)."""
    return F.unix_micros(ts.cast("timestamp"))


#: Decimal places in which shares, probabilities and losses are summed, so that no sum depends on its order.
PLACES = 12


def exact_sum(value: Column) -> Column:
    """The sum of doubles below a million, each taken to PLACES decimals, as a decimal: the same in whatever order and partitions rows come. Values that are no such number are left out."""
    return F.sum(value.try_cast(f"decimal(18,{PLACES})"))


def units(value: Column, places: int = PLACES) -> Column:
    """value in whole units of 10^-places, as a decimal without places, so that sums and comparisons of sums are exact. Null for what is no number below 10^16."""
    return F.round(value * float(10**places)).try_cast("decimal(28,0)")


def unit_ratio(a: Column, b: Column) -> Column:
    """a / b of two whole decimals as a double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def mean_of(total: Column, n: Column) -> Column:
    """The mean of n values that exact_sum() has summed: whole units / n / 10^PLACES as doubles, so that equal sums are equal means in any engine."""
    whole = (total.cast(f"decimal(26,{PLACES})") * F.lit(10**PLACES).cast(f"decimal({PLACES + 1},0)")).cast("decimal(38,0)")
    return unit_ratio(whole, n) / float(10**PLACES)


def ratio(total: Column, n: Column) -> Column:
    """total / n as a double; null for no rows."""
    return F.try_divide(total.cast("double"), n)


def rounded_ratio(total: Column, n: Column, digits: int = 4) -> Column:
    """total / n, neither negative, rounded half up by whole numbers; null for no rows."""
    unit = F.lit(10 ** (PLACES - digits)).cast("decimal(20,0)")
    whole = (total.cast(f"decimal(38,{PLACES})") * F.lit(10**PLACES).cast("decimal(13,0)")).cast("decimal(38,0)")
    per = (n.cast("decimal(18,0)") * unit).cast("decimal(37,0)")
    return F.when(n > 0, F.call_function("div", (whole * 2 + per).cast("decimal(38,0)"), (per * 2).cast("decimal(38,0)")) / F.lit(float(10**digits)))


def or_one(std: Column) -> Column:
    """A standard deviation, 1 where it is 0."""
    return F.when(std == 0, F.lit(1.0)).otherwise(std)


def percent_return(old: Column, new: Column) -> Column:
    return F.try_divide(new - old, old) * 100


def went_up(change: Column) -> Column:
    """1 for a positive return, else 0; zero counts as down."""
    return (change > 0).cast("int")


def clamp(p: Column, low: float = 0.05, high: float = 0.95) -> Column:
    """p within [low, high]; null where p is null or not finite."""
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
    return F.when(finite, F.greatest(F.lit(low), F.least(F.lit(high), p)))


def trend_guardrail(p: Column, trend: Column) -> Column:
    """Halve the lean of p where a trend beyond 0.5 contradicts it; a null trend changes nothing."""
    against = ((p < 0.5) & (trend > 0.5)) | ((p > 0.5) & (trend < -0.5))
    return F.when(against, 0.5 + (p - 0.5) * 0.5).otherwise(p)


def confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def called_up(p: Column, tie: str = ">=") -> Column:
    """The call's direction. At exactly one half summaries count a call as up (>=), histories as down (>)."""
    return p >= 0.5 if tie == ">=" else p > 0.5


def correct(p: Column, realized_up: Column, tie: str = ">=") -> Column:
    return called_up(p, tie) == (realized_up == 1)


def preferred(calibrated: Column, raw: Column) -> Column:
    return F.coalesce(calibrated, raw)


def log_loss(p: Column, realized_up: Column) -> Column:
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return -(realized_up * F.log(q) + (1 - realized_up) * F.log(1 - q))


def trend_regime(trend: Column) -> Column:
    return F.when(trend > 0.15, "bullish").when(trend < -0.15, "bearish").otherwise("neutral")


def volatility_regime(percentile: Column) -> Column:
    return F.when(percentile >= 0.85, "high_volatility").when(percentile <= 0.15, "low_volatility").otherwise("normal_volatility")


def normalize_bias(value: Column) -> Column:
    """bullish, bearish or neutral by prefix after trim and lower case, else null."""
    v = F.lower(F.trim(value))
    return F.when(v.startswith("bull"), "bullish").when(v.startswith("bear"), "bearish").when(v.startswith("neutral"), "neutral")


def normalize_risk(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("low", "medium", "high"), v)


def order_statistic(values: Column, p: float) -> Column:
    """The floor(n p)-th element of an array in ascending order, counted from 0, at most the last; null for an empty one."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.least(n, F.floor(n * F.lit(p)).cast("int") + 1)))
