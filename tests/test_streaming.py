"""Streams over landed files give what the batch jobs give."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hindsail.functions.windows import momentum_score
from hindsail.operators.catalysts import drop_fuzzy_duplicates
from hindsail.streaming import jobs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def landed(spark, tmp_path, name, df, parts=3):
    path = str(tmp_path / name)
    df.repartitionByRange(parts, *[c for c in ("due_order", "ts", "target_ts") if c in df.columns][:1]).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()


def ticks(spark, n=60):
    return spark.range(n).select((F.col("id") % 2).alias("series_id"), F.col("id").alias("obs_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("ts"), ((F.col("id") * 37) % 11 + 1).cast("double").alias("price"))


def shuffled(rows, spark, seed):
    """Rows in parts that come in any order, some of each part's late by up to two hours."""
    return rows.withColumn("due_order", F.floor(F.unix_timestamp("ts") / 3600) + F.pmod(F.hash("obs_id", F.lit(seed)), F.lit(3)))


def test_ticks_equal_batch(spark, tmp_path):
    """All ticks that the watermark has passed, repeated ones once, late and unordered ones in their place."""
    rows = ticks(spark)
    want = {r.obs_id: r.technical_score for r in momentum_score(rows, include_current=False).collect()}
    got = drain(jobs.stream_ticks(landed(spark, tmp_path, "t", rows.union(rows.where("obs_id < 5")), 1)), tmp_path, "ticks")
    assert {r.obs_id: r.technical_score for r in got} == {i: s for i, s in want.items() if i <= 58} and len(got) == 59
    late = shuffled(rows, spark, 7)
    path = str(tmp_path / "late")
    for lo in range(0, 64, 8):
        late.where(F.col("due_order").between(lo + 473352, lo + 473359)).drop("due_order").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.obs_id: r.technical_score for r in drain(jobs.stream_ticks(stream, late="3 hours"), tmp_path, "late_ticks")}
    assert got == {i: s for i, s in want.items() if i <= 56}


def test_every_prediction_comes_out_once(spark, tmp_path):
    """Prices stop for a day: predictions aimed there come out unresolved once the watermark has closed their interval. The stream is stopped and goes on from its checkpoint."""
    prices = ticks(spark, 200).where("obs_id not between 60 and 90")
    asked = ticks(spark, 200).select(F.col("obs_id").alias("id"), "series_id", "price", (F.col("ts") + F.expr("interval 6 hour")).alias("target_ts"))
    paths = {n: str(tmp_path / n) for n in ("asked", "seen", "out", "state")}
    got = []
    for lo in range(0, 200, 50):
        asked.where(F.col("id").between(lo, lo + 49)).coalesce(1).write.mode("append").parquet(paths["asked"])
        prices.where(F.col("obs_id").between(lo, lo + 49)).coalesce(1).write.mode("append").parquet(paths["seen"])
        one, two = (spark.readStream.schema(df.schema).parquet(paths[n]) for df, n in ((asked, "asked"), (prices, "seen")))
        query = jobs.stream_resolve(one, two, tolerance="90 minutes", late="1 minute").writeStream.option("checkpointLocation", paths["state"]).option("path", paths["out"]).trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(paths["out"]).collect()
    by = {r.prediction_id: r.status for r in got}
    assert len(got) == len(by) and set(range(180)) <= set(by)
    # a series has a price every two hours, so a missing one is 60 to 90, its parity's neighbours are two hours off
    assert {i for i, status in by.items() if status == "no_price"} == set(range(54, 85))


def test_resolve_waits_and_takes_nearest(spark, tmp_path):
    prices = ticks(spark)
    asked = prices.select(F.col("obs_id").alias("id"), "series_id", "price", (F.col("ts") + F.expr("interval 6 hour")).alias("target_ts")).where("id < 20")
    out = jobs.stream_resolve(landed(spark, tmp_path, "a", asked, 1), landed(spark, tmp_path, "p", prices, 1), tolerance="90 minutes", late="1 minute")
    got = {r.prediction_id: r.realized_price for r in drain(out, tmp_path, "resolved")}
    by = {r.obs_id: r.price for r in prices.collect()}
    # the series has a price every two hours, so the one at target + 0 exists
    assert got and all(got[i] == by[i + 6] for i in got)


def test_scores(spark, tmp_path):
    rows = spark.createDataFrame([("c", 1, "v", 0.8, 1, T0), ("c", 1, "v", 0.6, 0, T0), ("c", 1, "v", None, 0, T0)], "coin string, horizon_hours int, variant string, p double, realized_up int, ts timestamp")
    (row,) = drain(jobs.stream_scores(landed(spark, tmp_path, "s", rows, 1)), tmp_path, "scores", "complete")
    assert row.n == 2 and row.accuracy == 0.5 and abs(row.brier - 0.2) < 1e-9


def test_dedupe(spark, tmp_path):
    """One rule for stream and batch: of rows every five hours, those more than six hours after the last one kept."""
    hour = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(i, "A", "X", hour(5 * i)) for i in range(8)] + [(20, "A", "Y", hour(1)), (21, "A", "X", hour(10)), (30, "B", "X", hour(90))]
    df = spark.createDataFrame(rows[::-1], "id long, coin string, category string, ts timestamp")
    batch = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    kept = sorted(r.id for r in drop_fuzzy_duplicates(batch, batch.limit(0), within_batch=True).collect())
    assert kept == [0, 2, 4, 6, 20, 30]
    assert sorted(r.id for r in drain(jobs.stream_dedupe(landed(spark, tmp_path, "d", df, 1)), tmp_path, "kept")) == [i for i in kept if i != 30]  # the watermark has not passed the last


def test_budget_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = spark.createDataFrame([("a", 9.0, T0), ("b", 8.0, T0)], "coin string, priority double, request_ts timestamp")
    spark.createDataFrame([], "coin string, priority double, request_ts timestamp, place int, decision string, batch_id long").write.parquet(path)
    run = jobs.stream_budget(path)
    run(batch, 1)
    run(batch, 1)
    run(batch, 2)
    rows = spark.read.parquet(path).collect()
    assert sorted((r.batch_id, r.coin, r.decision) for r in rows) == [(1, "a", "selected"), (1, "b", "deferred"), (2, "a", "deferred"), (2, "b", "deferred")]


def test_restarts_go_on_from_the_checkpoint(spark, tmp_path):
    """Ticks and catalysts land in four parts, some late; each part is read by a query of its own, from the same checkpoint, and the whole is what the batch jobs give."""
    rows = shuffled(ticks(spark, 80), spark, 3)
    news = rows.select(F.col("obs_id").alias("id"), F.lit("BTC").alias("coin"), F.concat(F.lit("k"), (F.col("obs_id") % 2).cast("string")).alias("category"), "ts", "due_order")
    jobs_of = {"ticks": (rows, lambda s: jobs.stream_ticks(s, late="3 hours")), "news": (news, lambda s: jobs.stream_dedupe(s, late="3 hours"))}
    for name, (table, job) in jobs_of.items():
        landing, out, state = (str(tmp_path / f"{name}_{x}") for x in ("in", "out", "state"))
        plain = table.drop("due_order")
        for lo in range(0, 84, 21):
            table.where(F.col("due_order").between(lo + 473352, lo + 473372)).drop("due_order").coalesce(1).write.mode("append").parquet(landing)
            job(spark.readStream.schema(plain.schema).parquet(landing)).writeStream.option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(out).collect()
        if name == "ticks":
            want = {r.obs_id: r.technical_score for r in momentum_score(plain, include_current=False).collect()}
            assert len(got) == len({r.obs_id for r in got}) >= 76 and all(want[r.obs_id] == r.technical_score for r in got)
        else:
            want = sorted(r.id for r in drop_fuzzy_duplicates(plain, plain.limit(0), within_batch=True).collect())
            seen = sorted(r.id for r in got)
            assert seen == [i for i in want if i <= 76]
