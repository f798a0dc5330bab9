"""Trailing-window features of price series.

A feature alone is one window on the series key. in_pieces() applies features
to long series piece by piece, each piece with the few rows before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .expressions import micros, or_one, percent_return, unit_ratio, units

KEY = ("series_id",)


def ordered(key: Sequence[str], ts: str = "ts", tie: str = "obs_id"):
    return Window.partitionBy(*key).orderBy(ts, tie)


#: Rows of a piece of a series, on average, and pieces up to which a series is left whole.
PIECE_ROWS, WHOLE = 4096, 16


def in_pieces(df: DataFrame, feature: Callable[[DataFrame, list[str]], DataFrame], before: int, key: Sequence[str] = KEY, ts: str = "ts", tie: str = "obs_id", rows: int = PIECE_ROWS) -> DataFrame:
    """feature(df, key) for a feature of a row and up to `before` rows before it, the same rows without a window over a whole series.

    feature takes a table and a key and adds columns. The time of a series is
    cut into pieces of `rows` rows on average; a piece also gets the `before`
    rows that precede it, from as many earlier pieces as hold them, and these
    are dropped afterwards. Rows that precede a piece are found by their number:
    the counts of pieces, one row each, and the last `before` rows of each. Rows
    without a time come first. A table whose series, counted, all have WHOLE *
    rows rows or less is left as it is: each is one small window.
    """
    keys, t = list(key), micros(F.col(ts))
    if df.groupBy(*keys).count().where(F.col("count") > WHOLE * rows).isEmpty():
        return feature(df, keys)
    spans = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).alias("_parts"), F.min(t).alias("_lo"), F.max(t).alias("_hi")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    # divided and multiplied as doubles, which keeps the order
    piece = F.coalesce(F.floor((t - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * F.col("_parts")), F.lit(0)).cast("long")
    cut = df.join(spans, [df[k].eqNullSafe(spans[f"_k_{k}"]) for k in keys]).select(*[df[c] for c in df.columns], piece.alias("_piece"), (F.col("_parts") > 1).alias("_long"))
    long = cut.where("_long").drop("_long")
    own = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = long.groupBy(*keys, "_piece").agg(F.count("*").alias("_size")).withColumn("_start", F.coalesce(F.sum("_size").over(own), F.lit(0)))
    back = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(F.desc(ts), F.desc(tie)))
    tails = long.withColumn("_back", back).where(F.col("_back") <= before)

    def named(table: DataFrame, tag: str, *columns: str) -> DataFrame:
        return table.select(*[F.col(k).alias(f"_{tag}_{k}") for k in keys], *columns)

    same = lambda tag: [F.col(k).eqNullSafe(F.col(f"_{tag}_{k}")) for k in keys]
    at = named(sizes, "a", F.col("_piece").alias("_from"), "_size", "_start")
    placed = tails.join(at, [*same("a"), F.col("_piece") == F.col("_from")]).withColumn("_n", F.col("_start") + F.col("_size") - F.col("_back") + 1).select(*df.columns, "_n", F.floor(F.col("_n") / before).alias("_bin"))
    first = F.floor(F.col("_start") / before)
    to = named(sizes.where("_start > 0"), "b", "_piece", F.col("_start").alias("_upto"), F.explode(F.array(first, first - 1)).alias("_at"))
    halo = placed.join(to, [*same("b"), F.col("_bin") == F.col("_at")]).where((F.col("_n") <= F.col("_upto")) & (F.col("_n") > F.col("_upto") - before))
    whole = cut.select(*df.columns, "_piece", F.lit(False).alias("_halo")).union(halo.select(*df.columns, "_piece", F.lit(True)))
    return feature(whole, [*keys, "_piece"]).where("not _halo").drop("_piece", "_halo")


def momentum_score(prices: DataFrame, key: Sequence[str] = KEY, ts: str = "ts", price: str = "price", n: int = 30, include_current: bool = True, tie: str = "obs_id", name: str = "technical_score") -> DataFrame:
    """RSI-like score 0 to 100 of the last n prices, the current one among them or not; fewer than 6 prices, or no change at all, give 50, no loss gives 100.

    Prices are taken to 12 decimals and gains and losses summed and rounded half
    up by whole numbers, so that no score depends on the order of a sum. A price
    that is no number below 10^16 makes no change.
    """
    w = ordered(key, ts, tie)
    last = 0 if include_current else -1
    held = F.least(F.row_number().over(w) + last, F.lit(n))
    frame = w.rowsBetween(last - n + 2, last)
    change, none = F.col("_change"), F.lit(0).cast("decimal(1,0)")
    total = lambda c: F.sum(F.greatest(c, none)).over(frame).cast("decimal(32,0)")
    gain, loss = F.col("_gain"), F.col("_loss")
    # floor(100 - 100 / (1 + gain / loss) + 0.5)
    whole = F.call_function("div", gain * F.lit(201).cast("decimal(3,0)") + loss, (gain + loss) * F.lit(2).cast("decimal(1,0)"))
    score = F.when((F.col("_held") < 6) | ((gain == 0) & (loss == 0)), 50.0).otherwise(whole.cast("double"))
    moved = prices.withColumn("_units", units(F.col(price))).withColumn("_change", F.col("_units") - F.lag("_units").over(w))
    summed = moved.withColumns({"_held": held, "_gain": total(change), "_loss": total(-change)})
    return summed.withColumn(name, score).drop("_units", "_change", "_held", "_gain", "_loss")


def trailing_volatility(prices: DataFrame, key: Sequence[str] = KEY, ts: str = "ts", price: str = "price", lookback: int = 14, tie: str = "obs_id", name: str = "volatility") -> DataFrame:
    """Population deviation of the percent returns inside the last `lookback` rows; null before the fourth row, 1 for a flat window."""
    w = ordered(key, ts, tie)
    moved = prices.withColumn("_ret", percent_return(F.lag(price).over(w), F.col(price)))
    spread = or_one(F.stddev_pop("_ret").over(w.rowsBetween(2 - lookback, 0)))
    return moved.withColumn(name, F.when(F.row_number().over(w) >= 4, spread)).drop("_ret")


def _apart(prices: DataFrame, key: Sequence[str], ts: str, price: str, tie: str, short: int, long: int) -> DataFrame:
    """prices with `_row`, the row's number, and `_apart`: the short average's distance from the long one as a share of it, null where that is 0. Sums are exact, of prices to 12 decimals."""
    w = ordered(key, ts, tie)
    summed = prices.withColumn("_units", units(F.col(price))).withColumn("_row", F.row_number().over(w))
    for name, n in (("short", short), ("long", long)):
        frame = w.rowsBetween(1 - n, 0)
        summed = summed.withColumns({f"_{name}": F.sum("_units").over(frame).cast("decimal(32,0)"), f"_n_{name}": F.count("_units").over(frame).cast("decimal(4,0)")})
    whole = F.col("_long") * F.col("_n_short")
    return summed.withColumn("_apart", unit_ratio(F.col("_short") * F.col("_n_long") - whole, whole)).drop("_units", "_short", "_long", "_n_short", "_n_long")


def trend_strength(prices: DataFrame, key: Sequence[str] = KEY, ts: str = "ts", price: str = "price", short: int = 8, long: int = 21, tie: str = "obs_id", name: str = "trend_strength") -> DataFrame:
    """20 times the short average's distance from the long one, within [-1, 1]; 0 before row long + 1 or where the long average is 0."""
    slope = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_apart") * 20))
    held = F.when((F.col("_row") >= long + 1) & F.col("_apart").isNotNull(), slope).otherwise(0.0)
    return _apart(prices, key, ts, price, tie, short, long).withColumn(name, held).drop("_row", "_apart")


def regime_magnitude(prices: DataFrame, key: Sequence[str] = KEY, ts: str = "ts", price: str = "price", short: int = 8, long: int = 21, tie: str = "obs_id", name: str = "regime_mag") -> DataFrame:
    """The same distance in percent, not capped; null before row `long` or where the long average is 0."""
    return _apart(prices, key, ts, price, tie, short, long).withColumn(name, F.when(F.col("_row") >= long, F.col("_apart") * 100)).drop("_row", "_apart")


def next_return(prices: DataFrame, key: Sequence[str] = KEY, ts: str = "ts", price: str = "price", tie: str = "obs_id", name: str = "next_return") -> DataFrame:
    return prices.withColumn(name, percent_return(F.col(price), F.lead(price).over(ordered(key, ts, tie))))
