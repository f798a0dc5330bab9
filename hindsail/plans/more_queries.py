"""Further registered queries: landed files, streams over landed tables, records, audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixtures import view
from ..functions.expressions import went_up
from ..operators import analog, audit, calibration, catalysts, evaluate, selection
from ..operators.timejoin import enrich, forward_returns
from ..session import shared_dir
from ..sources import ingest
from ..streaming import jobs
from .queries import LEDGER_KEY, TOL, VARIANTS, WEIGHTS, core, decisions, features, ledger, newest_time, registered, rounded, series, whole_report, with_closest

BY = ["series_id", "horizon_hours"]


def landing(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/hindsail-{uuid.uuid4().hex}"


def streamed(df: DataFrame) -> DataFrame:
    """A stream of a table's rows, landed as files."""
    path = landing(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """What an append stream has written when all there is has been read."""
    path, spark = landing(stream.sparkSession), stream.sparkSession
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def zoned(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp") for n in names})


# ---- sources


@registered
def candle_files(spark, sf_dir):
    """S3: prices landed as candle files of a series and day, every eleventh close unreadable, and read again."""
    rows, path = series(spark, sf_dir), landing(spark)
    close = F.when(F.col("obs_id") % 11 == 0, "NaN").otherwise(F.col("price").cast("string"))
    candle = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), close.alias("c"))
    rows.groupBy(F.col("series_id").cast("string").alias("series_id"), F.to_date("ts").alias("day")).agg(F.collect_list(candle).alias("candles")).drop("day").write.json(path)
    return rounded(ingest.read_candles(spark, path))


@registered
def array_files(spark, sf_dir):
    """Prices landed as parallel arrays of a series and day, every seventh close missing, and read again."""
    rows, path = series(spark, sf_dir), landing(spark)
    both = F.collect_list(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.when(F.col("obs_id") % 7 != 0, F.col("price")).alias("c")))
    by = rows.groupBy(F.col("series_id").cast("string").alias("series_id"), F.to_date("ts").alias("day")).agg(both.alias("b"))
    by.select("series_id", F.col("b.t").alias("timestamp"), F.col("b.c").alias("close")).write.option("ignoreNullFields", "false").json(path)
    return rounded(ingest.read_parallel_arrays(spark, path))


@registered
def quote_files(spark, sf_dir):
    """A snapshot of quotes an hour, matched by position, and read again for two of three names."""
    rows, path = view(spark, sf_dir, "v_catalyst"), landing(spark)
    quote = F.struct(F.struct(F.col("coin").alias("name")).alias("u"), F.struct(F.when(F.col("id") % 9 == 0, "oops").otherwise(F.col("id").cast("string")).alias("markPx"), (F.col("id") % 4 / 4).cast("string").alias("funding")).alias("x"))
    by = rows.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.collect_list(quote).alias("q"))
    by.select(F.col("q.u").alias("universe"), F.col("q.x").alias("ctxs")).write.json(path)
    return rounded(ingest.read_quotes(spark, path, ["BTC", "ETH"], 0.25))


@registered
def ledger_append(spark, sf_dir):
    """The ledger appended in two batches, partitioned by series, each by a job that runs twice, and read again."""
    rows, path = ledger(spark, sf_dir), landing(spark)
    for part in (0, 1, 0, 1):
        ingest.append_once(rows.where(F.col("id") % 2 == part), path, f"part {part}", ["coin"])
    return ingest.committed(spark, path, rows.schema).select("id", "coin", "ts", "p_up", "realized_up")


@registered
def outcomes_on_read(spark, sf_dir):
    """Forecasts of 24 h joined to the outcomes that resolution appended."""
    rows = series(spark, sf_dir)
    due = rows.select(F.col("obs_id").alias("id"), "series_id", "price", (F.col("ts") + F.expr("interval 24 hour")).alias("target_ts"))
    return rounded(evaluate.with_outcomes(due, evaluate.resolve(due, rows, newest_time(rows, "ts"), TOL)).select("id", "realized_price", "realized_return", "realized_up"))


@registered
def json_errors(spark, sf_dir):
    """Errors of responses as JSON text."""
    out = catalysts.normalize_responses(view(spark, sf_dir, "v_response"))
    return ingest.json_columns(out.select("id", "errors"), "errors")


# ---- forecasts


@registered
def analog_context(spark, sf_dir):
    """Series of even id compare momentum and trend, those of odd id momentum and context, in one job; neighbours on imputed context are counted."""
    sets = {"trend": ("technical_score", "regime_mag"), "context": ("technical_score", "score")}
    rows = enrich(features(spark, sf_dir), view(spark, sf_dir, "v_context"), ["score"], TOL, {"score": 50.0})
    named = rows.withColumn("feature_set", F.when(F.col("series_id") % 2 == 0, "trend").otherwise("context"))
    cfg = analog.AnalogConfig(features=("technical_score", "regime_mag", "score"), sets=sets)
    return rounded(with_closest(analog.analog_forecast(named, series(spark, sf_dir), cfg)))


def past_outcomes(spark, sf_dir) -> DataFrame:
    """Rows of all series with features, a probability from the momentum score, and the outcome of each horizon."""
    rows = features(spark, sf_dir).withColumn("horizon_hours", F.explode(F.array(F.lit(12), F.lit(24))))
    done = forward_returns(rows, series(spark, sf_dir), ["series_id"], 24)
    return done.select(*BY, F.col("obs_id").alias("id"), "ts", (F.col("technical_score") / 100).alias("p_up"), went_up(F.col("return_pct")).alias("realized_up"), "technical_score", "regime_mag")


@registered
def prediction_columns(spark, sf_dir):
    """The record's challenger, calibrated and conditional probabilities."""
    past = past_outcomes(spark, sf_dir)
    curve = calibration.calibration_curve(past, BY, bins=5)
    out = analog.prediction_record(features(spark, sf_dir), series(spark, sf_dir), curve=curve, history=past, weights=WEIGHTS)
    return rounded(out.select(*BY, "p_up_flat", "calibrated_p_up", "p_up_conditional"), 4)


@registered
def challenger_calibrated(spark, sf_dir):
    """The challenger's own curve, from the outcomes of its own past."""
    rows, prices = core(spark, sf_dir), series(spark, sf_dir)
    past = forward_returns(analog.challenger_forecast(rows, prices), prices, ["series_id"], 24).withColumn("realized_up", went_up(F.col("return_pct")))
    curve = calibration.calibration_curve(past, BY, p="p_up_flat", tie="obs_id", bins=5)
    return rounded(analog.challenger_forecast(rows, prices, curve=curve).select("series_id", "obs_id", "calibrated_p_up_flat"))


@registered
def driver_tilts(spark, sf_dir):
    """A10: daily digests with a mapped, an unmapped or a broken driver, some without a transcript."""
    day = F.dayofmonth("ts")
    texts = ('{"dominant_driver":"macro","macro":{"lean":"bullish"}}', '{"dominant_driver":"tradfi","tradfi":{"lean":"bearish"}}', '{"dominant_driver":"micro"}', "{broken")
    news = view(spark, sf_dir, "v_context").select(F.col("ts").alias("published_ts"), F.when(day % 5 == 0, "failed").otherwise("ok").alias("transcript_status"), F.element_at(F.array(*[F.lit(t) for t in texts]), (day % 4 + 1).cast("int")).alias("summary_json"))
    out = analog.challenger_forecast(core(spark, sf_dir), series(spark, sf_dir), digests=news)
    return rounded(out.select("series_id", "obs_id", "p_up_tilted", "driver_used", "driver_agreement"))


# ---- scores and selection


@registered
def preferred_scores(spark, sf_dir):
    """Resolved rows of one series and horizon since a time, scored by the calibrated probability where there is one."""
    rows = evaluate.resolved(ledger(spark, sf_dir), calibrated="p_up_experimental", coin="BTC", horizon_hours=24, since=F.lit("1995-01-01").cast("timestamp_ntz"))
    return rounded(evaluate.score(rows, LEDGER_KEY, p="p"))


@registered
def history_gaps(spark, sf_dir):
    """E4 without carrying: rows that lack a variant have no running values, and one variant begins late."""
    rows = ledger(spark, sf_dir).withColumn("p_late", F.when(F.col("resolved_ts") >= "1996-06-01", F.col("p_up_experimental")))
    return evaluate.expanding_history(rows, {**VARIANTS, "late": "p_late"}, carry=False).drop("resolved_ts")


@registered
def report_compact(spark, sf_dir):
    return rounded(evaluate.compact(whole_report(spark, sf_dir)))


@registered
def challenger_selection(spark, sf_dir):
    """V1: variants of a second ledger, which one series lacks, compete with those of the first."""
    rows = ledger(spark, sf_dir)
    lean = F.col("p_up") - 0.5
    other = rows.where("coin <> 'ETH'").select(*LEDGER_KEY, "id", "ts", "realized_up", (0.5 - lean * 0.5).alias("p_flat"), F.when(F.col("id") % 3 != 1, 0.5 + lean * 0.9).alias("p_tilted"))
    return rounded(decisions(selection.select_variant(rows, VARIANTS, list(WEIGHTS), challenger=other, challenger_variants={"challenger_flat": "p_flat", "challenger_tilted": "p_tilted"})))


# ---- catalysts and audits


@registered
def catalyst_batch_dedupe(spark, sf_dir):
    """K4: all catalysts as one batch, each compared with those kept before it."""
    rows = view(spark, sf_dir, "v_catalyst")
    return catalysts.drop_fuzzy_duplicates(rows, rows.limit(0), within_batch=True).select("id", "coin", "category")


@registered
def catalysts_known(spark, sf_dir):
    """K7: for each price the newest catalyst of a coin by the series that was public, and whether it was so at once."""
    rows = series(spark, sf_dir).select("obs_id", "ts", F.element_at(F.array(*[F.lit(c) for c in ("BTC", "ETH", "LINK")]), (F.col("series_id") % 3 + 1).cast("int")).alias("coin"))
    known = catalysts.newest_available(rows, view(spark, sf_dir, "v_catalyst"), take=("id", "ts", "first_public_ts"))
    return known.select("obs_id", "catalyst_id", catalysts.is_available(F.col("catalyst_first_public_ts"), F.col("catalyst_ts")).alias("in_time"))


@registered
def response_catalysts(spark, sf_dir):
    """One catalyst for each entry and asset of the valid responses."""
    rows, _ = catalysts.ingest_responses(view(spark, sf_dir, "v_response"), stored_catalysts(spark))
    return rows.select("investigation", "coin", "category", "source_url", "n_sources")


@registered
def response_attempts(spark, sf_dir):
    """One record for each response, whatever came of it."""
    _, attempts = catalysts.ingest_responses(view(spark, sf_dir, "v_response"), stored_catalysts(spark))
    return attempts.select("id", "status", "n_sources", "catalysts_written", F.size("errors").alias("n_errors"))


def stored_catalysts(spark) -> DataFrame:
    return spark.createDataFrame([], "id long, coin string, category string, ts timestamp_ntz")


@registered
def grounded_sources(spark, sf_dir):
    """K6: catalysts whose source is among the pages that grounding names, or not."""
    page = F.when(F.col("id") % 2 == 0, F.col("source_url")).otherwise("https://example.org/other")
    meta = F.when(F.col("id") % 7 != 0, F.concat(F.lit('{"webSearchQueries":["q"],"groundingChunks":[{"web":{"uri":"'), page, F.lit('","title":"t"}},{"web":{}}]}')))
    out = catalysts.grounding(view(spark, sf_dir, "v_catalyst").withColumn("grounding_json", meta))
    return out.select("id", F.size("search_queries").alias("n_queries"), F.size("grounded_sources").alias("n_sources"), "is_grounded")


@registered
def trigger_rule(spark, sf_dir):
    """Reasons by fixed thresholds, and what limits leave, for a signal from each resolved forecast."""
    rows = ledger(spark, sf_dir).where("realized_up is not null")
    signal = rows.select("id", (F.col("trend_strength") * 10).alias("price_move_pct"), F.greatest("p_up", 1 - F.col("p_up")).alias("confidence"), ((F.col("p_up") >= 0.5) != (F.col("realized_up") == 1)).alias("was_wrong"), (F.col("id") % 5).cast("int").alias("correlated_failures"))
    limit = catalysts.rate_limit_reason((F.col("id") % 4).cast("int"), (F.col("id") % 3).cast("int"), per_day=2, per_hour=2)
    return catalysts.trigger_reasons(signal).select("id", "trigger", F.array_join("reasons", ";").alias("reasons"), limit.alias("limited"))


@registered
def investigation_chain(spark, sf_dir):
    """Requests about all resolved forecasts, with their catalysts, the forecast found and the decision before."""
    rows = ledger(spark, sf_dir)
    done = rows.where("realized_up is not null")
    asked = done.select("id", *LEDGER_KEY, (F.col("resolved_ts") + F.expr("interval 30 minute")).alias("request_ts"), F.greatest("p_up", 1 - F.col("p_up")).alias("confidence"), ((F.col("p_up") >= 0.5) != (F.col("realized_up") == 1)).alias("was_wrong"), F.when(F.col("id") % 5 != 0, (F.col("id") % 3).cast("long")).alias("catalysts_written"))
    logged = done.select(F.col("id").alias("investigation"), F.explode(F.sequence(F.lit(0), (F.col("id") % 4).cast("int")))).select("investigation")
    out = audit.audit_chain(asked, logged, rows, rows.where("id % 10 = 0"))
    return out.select("id", F.col("catalyst_check.status").alias("catalysts"), F.col("prediction_check.status").alias("prediction"), F.col("decision_check.status").alias("decision"), "result")


@registered
def duplicate_summary(spark, sf_dir):
    return audit.duplicate_status(view(spark, sf_dir, "v_investigation"), ["investigation_id"])


@registered
def version_lineage(spark, sf_dir):
    """Versions of the ledger's second half."""
    rows = ledger(spark, sf_dir).withColumn("git_commit_sha", F.when(F.col("id") % 9 == 0, "unknown").when(F.col("id") % 9 != 1, F.concat(F.lit("c"), F.year("ts"))))
    return audit.versions_since(rows, F.lit("1996-01-01").cast("timestamp_ntz"))


@registered
def masked_rows(spark, sf_dir):
    """Secrets of every row masked by name, at the top, in a struct and in a map."""
    i = F.col("id").cast("string")
    rows = view(spark, sf_dir, "v_catalyst").select("id", i.alias("api_key"), F.struct(i.alias("Authorization"), F.col("coin").alias("coin")).alias("head"), F.create_map(F.lit("password"), i, F.lit("note"), F.col("category")).alias("extra"))
    out = audit.mask_secrets(rows)
    return out.select("id", "api_key", F.col("head")["Authorization"].alias("authorization"), F.col("head")["coin"].alias("coin"), F.col("extra")["password"].alias("password"), F.col("extra")["note"].alias("note"))


@registered
def history_leakage(spark, sf_dir):
    """Curves stamped with the newest outcome of their series, used by every later forecast and some earlier ones; statistics cut off at their query or a day later."""
    rows = ledger(spark, sf_dir)
    newest = rows.where("realized_up is not null").groupBy(*LEDGER_KEY).agg(F.max("resolved_ts").alias("newest_resolved_ts"))
    curves = rows.join(newest, LEDGER_KEY).select("newest_resolved_ts", F.when(F.col("id") % 20 == 0, F.col("newest_resolved_ts") - F.expr("interval 1 day")).otherwise(F.col("newest_resolved_ts")).alias("computed_ts"), F.col("ts").alias("used_ts"))
    stats = rows.select(F.col("ts").alias("query_ts"), F.when(F.col("id") % 30 == 0, F.col("ts") + F.expr("interval 1 day")).otherwise(F.col("ts")).alias("cutoff_ts"))
    return audit.leakage_checks(rows, curves=curves, stats=stats)


# ---- streams


@registered
def stream_tick_scores(spark, sf_dir):
    """All prices as a stream; those that the watermark has passed are scored."""
    return drained(jobs.stream_ticks(streamed(zoned(series(spark, sf_dir), "ts")))).select("series_id", "obs_id", "technical_score")


def _resolution(spark, sf_dir):
    rows = series(spark, sf_dir)
    asked = rows.select(F.col("obs_id").alias("id"), "series_id", "price", (F.col("ts") + F.expr("interval 24 hour")).alias("target_ts"))
    decided = asked.where(F.col("target_ts") <= newest_time(rows, "ts") - F.expr("interval 12 hour")).select(F.col("id").alias("prediction_id"))
    out = drained(jobs.stream_resolve(streamed(zoned(asked, "target_ts")), streamed(zoned(rows, "ts"))))
    return out.join(decided, "prediction_id", "left_semi")


@registered
def stream_resolution(spark, sf_dir):
    """Forecasts of 24 h resolved from a stream of prices. Told are those half a day before its end; what comes later waits for the watermark."""
    return rounded(_resolution(spark, sf_dir).where("status = 'resolved'").drop("status"))


@registered
def stream_resolution_status(spark, sf_dir):
    """Every forecast of the same stream, once, with whether a price resolved it."""
    return _resolution(spark, sf_dir).select("prediction_id", "series_id", "status")


@registered
def stream_running_scores(spark, sf_dir):
    """The ledger's variants as a stream, their scores as of its end."""
    long = evaluate.unpivot_variants(ledger(spark, sf_dir), VARIANTS, [*LEDGER_KEY, "realized_up"])
    path = landing(spark)
    stream = jobs.stream_scores(streamed(long))
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(stream.schema).parquet(path))


@registered
def stream_new_catalysts(spark, sf_dir):
    """T4: all catalysts as a stream without fuzzy duplicates, as far as the watermark has come."""
    return drained(jobs.stream_dedupe(streamed(zoned(view(spark, sf_dir, "v_catalyst").select("id", "coin", "category", "ts"), "ts")))).select("id", "coin", "category")


@registered
def stream_budget_log(spark, sf_dir):
    """T5: the assets' priorities as a stream of requests, two an hour of which are selected."""
    log = view(spark, sf_dir, "v_investigation")
    ranked = log.groupBy(F.col("asset_no").cast("string").alias("coin")).agg((F.count("*") / 10 + F.max("asset_no")).alias("priority"), F.max("request_ts").alias("request_ts"))
    path = landing(spark)
    spark.createDataFrame([], "coin string, priority double, request_ts timestamp, place int, decision string, batch_id long").write.parquet(path)
    run = jobs.stream_budget(path, per_day=60, per_hour=2)
    streamed(zoned(ranked.coalesce(1), "request_ts")).writeStream.foreachBatch(run).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(path).select("coin", "priority", "place", "decision"))


