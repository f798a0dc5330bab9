"""Running totals over long keys without one window partition per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def running(df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column, totals: Mapping[str, Column]) -> DataFrame:
    """df with a running sum column for each of totals, in the given order within key.

    bucket must rise with the order. Sums run inside a (key, bucket); what
    earlier buckets sum to, one row per bucket, is joined in and added.
    """
    keys = list(key)
    cut = df.withColumn("_bucket", bucket)
    for name, value in totals.items():
        cut = cut.withColumn(f"_v_{name}", F.coalesce(value.cast("double"), F.lit(0.0)))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    offsets = sums.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0.0)).alias(f"_o_{n}") for n in totals])
    local = cut.select("*", *[F.sum(f"_v_{n}").over(inner).alias(f"_r_{n}") for n in totals])
    return local.join(offsets, [*keys, "_bucket"]).select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in totals])
