"""Ranks and quantiles of long keys without a window over a key.

Rows are summed by distinct value first, so a value that many rows share is one
row. The distinct values of a long key are cut into PARTS parts of about equal
size at their approximate quantiles, whose error has a bound, so parts are
balanced whatever the values' distribution. Sums of parts, at most PARTS rows a
key, say how much lies below each part. A rank is looked up in its own part; a
quantile refines only the part that holds it. Results are exact: the quantiles
only decide where to cut. A key has one column or more; null keys are a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .expressions import unit_ratio, units

#: Parts of a long key, and distinct values up to which a key is one part.
PARTS, WHOLE = 256, 4096


def _keys(key: Sequence[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(key))]


def _named(df: DataFrame, key: Sequence[str], value: str, weight: Column) -> DataFrame:
    """(_k0, ..., _v, _w) of df."""
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(value).alias("_v"), weight.alias("_w"))


def _cut(rows: DataFrame, ks: Sequence[str], parts: int, whole: int) -> tuple[DataFrame, DataFrame]:
    """(distinct values, parts): the first has rows' weights `_w` by (key, _v) and the number `_part` of the part, rising with the value; the second has each part's weight `_s`, the weight `_below` it and the key's `_total`."""
    distinct = rows.groupBy(*ks, "_v").agg(F.sum("_w").alias("_w"))
    at = F.percentile_approx("_v", [i / parts for i in range(1, parts)], 16 * parts)
    splits = distinct.groupBy(*ks).agg(F.when(F.count("*") > whole, at).alias("_at")).withColumnsRenamed({k: f"_s{k}" for k in ks})
    lower = F.size(F.filter("_at", lambda s: s < F.col("_v")))
    cut = distinct.join(splits, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in ks]).select(*ks, "_v", "_w", F.when(F.col("_at").isNull(), 0).otherwise(lower).alias("_part"))
    w = Window.partitionBy(*ks).orderBy("_part")
    sums = cut.groupBy(*ks, "_part").agg(F.sum("_w").alias("_s"))
    before = F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return cut, sums.withColumn("_below", F.coalesce(before, F.lit(0))).withColumn("_total", total)


def _inside(cut: DataFrame, sums: DataFrame, ks: Sequence[str]) -> DataFrame:
    """cut's rows of the parts in sums, with `_upto`: the weight of the key's values that are not above the row's."""
    named = sums.select(*[F.col(c).alias(f"_p{c}") for c in [*ks, "_part"]], "_below", "_total")
    inner = F.sum("_w").over(Window.partitionBy(*ks, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(k).eqNullSafe(F.col(f"_p{k}")) for k in ks] + [F.col("_part") == F.col("_p_part")]
    return cut.join(named, same).withColumn("_upto", F.col("_below") + F.coalesce(inner, F.lit(0)))


def _first(rows: DataFrame, key: Sequence[str], reached: Callable[[Column, Column], Column], name: str, parts: int, whole: int) -> DataFrame:
    """(key, name): each key's smallest value at which reached(weight up to it, total) holds, else its largest."""
    ks = _keys(key)
    cut, sums = _cut(rows, ks, parts, whole)
    goal = F.min(F.when(reached(F.col("_below") + F.col("_s"), F.col("_total")), F.col("_part"))).over(Window.partitionBy(*ks))
    last = F.max("_part").over(Window.partitionBy(*ks))
    chosen = sums.withColumn("_goal", F.coalesce(goal, last)).where("_part = _goal")
    hit = F.min(F.when(reached(F.col("_upto"), F.col("_total")), F.col("_v")))
    found = _inside(cut, chosen, ks).groupBy(*ks).agg(F.coalesce(hit, F.max("_v")).alias("_q"))
    return found.select(*[F.col(k).alias(own) for k, own in zip(ks, key)], F.col("_q").alias(name))


def rank_in_reference(values: DataFrame, refs: DataFrame, key: Sequence[str], value: str = "value", ref: str = "ref", min_refs: int = 10, parts: int = PARTS, whole: int = WHOLE) -> DataFrame:
    """values with `percentile`: the share of the key's non-null refs that are at most the value; null under min_refs of them or for a null value.

    Distinct values and refs are ranked together, part by part; the rank is
    joined to the rows of its value.
    """
    ks = _keys(key)
    known = _named(refs, key, ref, F.lit(1)).where("_v is not null").unionByName(_named(values, key, value, F.lit(0)).where("_v is not null"))
    ranks = _inside(*_cut(known, ks, parts, whole), ks).select(*[F.col(k).alias(f"_r{k}") for k in ks], F.col("_v").alias("_rv"), F.when(F.col("_total") >= min_refs, F.col("_upto") / F.col("_total")).alias("percentile"))
    same = [F.col(own).eqNullSafe(F.col(f"_r{k}")) for k, own in zip(ks, key)] + [F.col(value) == F.col("_rv")]
    kept = [c for c in values.columns if c != "percentile"]
    return values.select(*kept).join(ranks, same, "left").select(*kept, "percentile")


def rank_of_one(values: DataFrame, refs: DataFrame, key: Sequence[str], value: str = "value", ref: str = "ref", min_refs: int = 10) -> DataFrame:
    """rank_in_reference() for values of one row a key: refs meet it and are counted, none is ranked."""
    known = refs.where(F.col(ref).isNotNull()).select(*[F.col(k).alias(f"_r_{k}") for k in key], F.col(ref).alias("_ref"))
    met = values.join(known, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key], "left")
    shares = met.groupBy(*key).agg(F.first(F.struct(*values.columns)).alias("_row"), F.count_if(F.col("_ref") <= F.col(value)).alias("_at"), F.count("_ref").alias("_n"))
    return shares.select("_row.*", F.when((F.col("_n") >= min_refs) & F.col(f"_row.{value}").isNotNull(), F.col("_at") / F.col("_n")).alias("percentile"))


def weighted_quantile(df: DataFrame, key: Sequence[str], value: str, weight: str, p: float, name: str = "quantile", parts: int = PARTS, whole: int = WHOLE) -> DataFrame:
    """(key, name): the smallest value up to which the running weight reaches share p of the key's total, the largest value where none does or the total is 0. Weights are taken to 12 decimals and summed exactly; one that is no number below 10^16 counts as none."""
    return _first(_named(df, key, value, F.coalesce(units(F.col(weight)), F.lit(0).cast("decimal(28,0)"))), key, lambda upto, total: unit_ratio(upto, total) >= p, name, parts, whole)


def floor_quantile(df: DataFrame, key: Sequence[str], value: str, p: float, name: str = "quantile", parts: int = PARTS, whole: int = WHOLE) -> DataFrame:
    """(key, name): the floor(n p)-th smallest value of each key, counted from 0, at most the last. Null values take no part."""
    known = _named(df, key, value, F.lit(1)).where("_v is not null")
    return _first(known, key, lambda upto, n: upto >= F.least(n, F.floor(n * F.lit(p)) + 1), name, parts, whole)


def order_statistics(df: DataFrame, key: Sequence[str], value: str, places: Sequence[int], weight: str, parts: int = PARTS, whole: int = WHOLE) -> DataFrame:
    """(key, at): each key's values at the places, counted from 0 in ascending order, as an array; a row counts `weight` times, a whole number. A place beyond the last row is null. Null values take no part."""
    ks = _keys(key)
    upto = _inside(*_cut(_named(df, key, value, F.col(weight)).where("_v is not null"), ks, parts, whole), ks)
    found = upto.groupBy(*ks).agg(F.array(*[F.min(F.when(F.col("_upto") > p, F.col("_v"))) for p in places]).alias("at"))
    return found.select(*[F.col(k).alias(own) for k, own in zip(ks, key)], "at")
