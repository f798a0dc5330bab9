"""Landed JSON files and ticks to price rows; append-only writes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.windows import in_pieces, momentum_score
from ..operators.timejoin import tolerance_anti_join


def finite(value: Column) -> Column:
    """value as double, null where it is no finite number."""
    number = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def read_candles(spark: SparkSession, path: str, series: str = "series_id") -> DataFrame:
    """(series, ts, price) from files of {series_id, candles: [{t: epoch milliseconds, c: number as text}]}; candles without a finite close are dropped."""
    raw = spark.read.schema(f"{series} string, candles array<struct<t:bigint,c:string>>").json(path)
    rows = raw.select(series, F.explode("candles").alias("c")).select(series, F.timestamp_millis("c.t").cast("timestamp_ntz").alias("ts"), finite(F.col("c.c")).alias("price"))
    return rows.where("price is not null and ts is not null")


def read_parallel_arrays(spark: SparkSession, path: str, series: str = "series_id") -> DataFrame:
    """(series, ts, price) from files of {series_id, timestamp: [epoch seconds], close: [number or null]}; nulls are dropped."""
    raw = spark.read.schema(f"{series} string, timestamp array<bigint>, close array<double>").json(path)
    rows = raw.select(series, F.explode(F.arrays_zip("timestamp", "close")).alias("z")).select(series, F.timestamp_seconds("z.timestamp").cast("timestamp_ntz").alias("ts"), F.col("z.close").alias("price"))
    return rows.where("price is not null and ts is not null")


def read_quotes(spark: SparkSession, path: str, names: Sequence[str], funding_floor: float = 0.0) -> DataFrame:
    """(name, price, funding_adj) from files of {universe: [{name}], ctxs: [{markPx, funding}]}, matched by position; quotes without a finite price are dropped, funding is less its floor."""
    raw = spark.read.schema("universe array<struct<name:string>>, ctxs array<struct<markPx:string,funding:string>>").json(path)
    rows = raw.select(F.explode(F.arrays_zip("universe", "ctxs")).alias("z")).select(F.col("z.universe.name").alias("name"), finite(F.col("z.ctxs.markPx")).alias("price"), (finite(F.col("z.ctxs.funding")) - funding_floor).alias("funding_adj"))
    return rows.where(F.col("name").isin(*names) & F.col("price").isNotNull())


def append_ticks(prices: DataFrame, ticks: DataFrame, n: int = 30, key: Sequence[str] = ("series_id",)) -> DataFrame:
    """Ticks as price rows with technical_score from the n rows logged before them, themselves left out."""
    both = prices.select(*key, "obs_id", "ts", "price").withColumn("_new", F.lit(False)).unionByName(ticks.select(*key, "obs_id", "ts", "price").withColumn("_new", F.lit(True)))
    return in_pieces(both, lambda df, part: momentum_score(df, part, n=n, include_current=False), n, key).where("_new").drop("_new")


def backfill(prices: DataFrame, candles: DataFrame, tol: int, n: int = 30, key: Sequence[str] = ("series_id",)) -> DataFrame:
    """Candles as price rows with technical_score of the n candles up to them, duplicates included, without those that a row of prices lies within tol microseconds of (strictly)."""
    scored = in_pieces(candles, lambda df, part: momentum_score(df, part, n=n), n, key)
    return tolerance_anti_join(scored, prices, key, "ts", tol, "obs_id")


def append(df: DataFrame, path: str, partition: Sequence[str] = ("series_id",)) -> None:
    """Immutable append to a Parquet table."""
    df.write.mode("append").partitionBy(*partition).parquet(path)


#: A table's record of its batches: which attempt to write a batch counts.
COMMITS = "batch_id string, attempt string, at timestamp"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, attempt) of a table's batches, the first commit of each; none for a table that is not there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    rows = spark.read.schema(COMMITS).parquet(f"{path}/commits") if there else spark.createDataFrame([], COMMITS)
    return rows.groupBy("batch_id").agg(F.min_by("attempt", F.struct("at", "attempt")).alias("attempt"))


def append_once(df: DataFrame, path: str, batch_id: str, partition: Sequence[str] = ("series_id",)) -> bool:
    """Appends df as the batch of this id, unless it has been; tells whether it did.

    Rows go to a folder of this attempt, and then one row to the commit record;
    readers take committed attempts only. So a job that is killed at any point
    and run again, or run twice at once, leaves each row once: of several
    commits of a batch the first counts.
    """
    spark = df.sparkSession
    if not _commits(spark, path).where(F.col("batch_id") == batch_id).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    df.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt", *partition).parquet(f"{path}/rows")
    spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return True


def committed(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of a table's committed batches. schema: its columns, those of the partition among them."""
    told = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(StructType([*told.fields, StructField("attempt", StringType())])).parquet(f"{path}/rows")
    return rows.join(_commits(spark, path).select("attempt"), "attempt", "left_semi").select(*told.names)


def coverage(df: DataFrame, key: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def chart_extract(prices: DataFrame, ledger: DataFrame, horizon_hours: int) -> DataFrame:
    """One table with a `kind` column: the price series and the forecasts of one horizon."""
    left = prices.select(F.lit("price").alias("kind"), F.col("series_id").cast("string").alias("series"), "ts", F.col("price").alias("value"))
    right = ledger.where(F.col("horizon_hours") == horizon_hours).select(F.lit("forecast").alias("kind"), F.col("coin").alias("series"), "ts", F.col("p_up").alias("value"))
    return left.unionByName(right)


def json_columns(df: DataFrame, *names: str) -> DataFrame:
    """Nested columns as JSON text."""
    return df.withColumns({c: F.to_json(c) for c in names})
