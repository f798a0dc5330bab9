"""The registered queries of the forecasting operators, over the fixtures' views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..fixtures import view
from ..functions import ranks, windows
from ..functions.expressions import HOUR, units
from ..operators import analog, audit, backtest, calibration, catalysts, evaluate, selection
from ..operators.sliding import conditional_calibration_each as calibration_of_each
from ..operators.timejoin import asof_join, enrich, forward_return, nearest_join, tolerance_anti_join
from ..sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOL = int(4.8 * HOUR)
LEDGER_KEY = ["coin", "horizon_hours"]
VARIANTS = {"original": "p_up", "experimental": "p_up_experimental"}
WEIGHTS = {"technical_score": 1.0, "regime_mag": 1.5}


def registered(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to `digits` places, minus zero as zero."""
    return df.select(*[(F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_series")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_ledger")


def newest_time(df: DataFrame, ts: str):
    """The newest time of a table as a literal: one aggregate."""
    return F.lit(df.agg(F.max(ts)).first()[0]).cast("timestamp_ntz")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.in_pieces(series(spark, sf_dir), lambda df, key: windows.regime_magnitude(windows.momentum_score(df, key), key), 30)


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with stand-ins for a core model's output, derived from their ids."""
    i = F.col("obs_id")
    return series(spark, sf_dir).select("series_id", "obs_id", "ts", "price", F.lit(24).alias("horizon_hours"), ((i % 101) / 100).alias("p_up"), (i % 10 == 0).cast("int").alias("is_regime_anomaly"), ((i % 41) / 20 - 1).alias("trend_strength"))


@registered
def momentum_score(spark, sf_dir):
    return windows.in_pieces(series(spark, sf_dir), windows.momentum_score, 30).select("series_id", "obs_id", "technical_score")


@registered
def trailing_volatility(spark, sf_dir):
    return rounded(windows.in_pieces(series(spark, sf_dir), windows.trailing_volatility, 14).select("series_id", "obs_id", "volatility"))


@registered
def trend_strength(spark, sf_dir):
    return rounded(windows.in_pieces(series(spark, sf_dir), windows.trend_strength, 21).select("series_id", "obs_id", "trend_strength"))


@registered
def regime_magnitude(spark, sf_dir):
    return rounded(windows.in_pieces(series(spark, sf_dir), windows.regime_magnitude, 21).select("series_id", "obs_id", "regime_mag"))


@registered
def nearest_rows(spark, sf_dir):
    """Each price's nearest price 12 h on, within 4.8 h."""
    rows = series(spark, sf_dir)
    out = nearest_join(rows, rows, ["series_id"], F.col("ts") + F.expr("interval 12 hour"), "ts", TOL, "obs_id", ["obs_id"], how="left", prefix="near_")
    return out.select("series_id", "obs_id", "near_obs_id", F.col("_diff").alias("diff_us"))


QUERIES["nearest_join"] = QUERIES.pop("nearest_rows")


@registered
def backward_asof(spark, sf_dir):
    rows = series(spark, sf_dir)
    back = rows.withColumn("back_ts", F.col("ts") - F.expr("interval 24 hour"))
    return asof_join(back, rows, ["series_id"], "back_ts", "ts", "obs_id", ["obs_id"], lookback=200, fallback=True, upto="ts", prefix="old_").select("series_id", "obs_id", "old_obs_id")


@registered
def tolerance_antijoin(spark, sf_dir):
    rows = series(spark, sf_dir)
    return tolerance_anti_join(rows.where("obs_id % 2 = 1"), rows.where("obs_id % 2 = 0"), ["series_id"], "ts", 6 * HOUR, "obs_id").select("series_id", "obs_id")


@registered
def context_enrich(spark, sf_dir):
    out = enrich(series(spark, sf_dir), view(spark, sf_dir, "v_context"), ["score", "regime_mag", "bottom_score"], TOL, {"score": 50.0, "regime_mag": 0.0, "bottom_score": 25.0})
    return rounded(out.select("series_id", "obs_id", "score", "regime_mag", "bottom_score", "context_imputed"), 4)


@registered
def forward_returns(spark, sf_dir):
    rows = series(spark, sf_dir)
    return rounded(forward_return(rows, rows, ["series_id"], 24).select("series_id", "obs_id", "return_pct"))


def nanos(dist: Column) -> Column:
    """A distance of nine places in whole units of 10^-9."""
    return units(dist, 9).cast("long")


def six_places(whole: Column) -> Column:
    """Units of 10^-9 to six places, half up by whole numbers: every thousandth distance is a half, and rounded as a double falls either way."""
    return F.call_function("div", whole + 500, F.lit(1000)) / 1e6


def with_closest(forecast: DataFrame) -> DataFrame:
    """The five closest analogs as text, and their distances' sum."""
    named = F.transform("closest", lambda c: F.concat_ws(":", c["obs_id"].cast("string"), c["date"]))
    total = F.aggregate(F.transform("closest", lambda c: nanos(c["dist"])), F.lit(0).cast("long"), lambda a, x: a + x)
    return forecast.withColumn("closest_dist", six_places(total)).withColumn("closest", F.array_join(named, ","))


@registered
def analog_forecast(spark, sf_dir):
    return rounded(with_closest(analog.analog_forecast(features(spark, sf_dir), series(spark, sf_dir))))


@registered
def analog_weighted(spark, sf_dir):
    return rounded(analog.analog_weighted(features(spark, sf_dir), series(spark, sf_dir)))


@registered
def regime_anomaly(spark, sf_dir):
    return rounded(analog.regime_anomaly(features(spark, sf_dir)).withColumn("closest_dist", six_places(nanos(F.col("closest_dist")))))


@registered
def conditional_calibration(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    newest = calibration.newest(rows, LEDGER_KEY, ["ts", "id"], 1).select(*LEDGER_KEY, "ts", *WEIGHTS)
    return rounded(analog.conditional_calibration(newest, rows.where("realized_up is not null"), LEDGER_KEY, WEIGHTS))


@registered
def conditional_calibration_each(spark, sf_dir):
    """A8 for every ledger row, among the 300 resolved rows before it."""
    rows = ledger(spark, sf_dir)
    asked = rows.select(*LEDGER_KEY, "id", "ts", *WEIGHTS)
    out = calibration_of_each(asked, rows.where("realized_up is not null"), LEDGER_KEY, WEIGHTS)
    return rounded(out.select("id", "p_up_conditional", "n_neighbors"))


@registered
def challenger_forecast(spark, sf_dir):
    out = analog.challenger_forecast(core(spark, sf_dir), series(spark, sf_dir))
    return rounded(out.select("series_id", "obs_id", "trailing_return_pct", "p_up_flat"))


@registered
def calibration_curve(spark, sf_dir):
    return rounded(calibration.calibration_curve(ledger(spark, sf_dir), LEDGER_KEY))


@registered
def calibration_apply(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return rounded(calibration.apply_calibration(rows, calibration.calibration_curve(rows, LEDGER_KEY), LEDGER_KEY).select("id", "p_up_calibrated"))


@registered
def calibration_error(spark, sf_dir):
    return rounded(calibration.calibration_error(ledger(spark, sf_dir), LEDGER_KEY))


@registered
def calibration_summary(spark, sf_dir):
    return rounded(evaluate.calibration_summary(ledger(spark, sf_dir)))


@registered
def variant_comparison(spark, sf_dir):
    return rounded(evaluate.compare_variants(ledger(spark, sf_dir)))


@registered
def expanding_history(spark, sf_dir):
    return evaluate.expanding_history(ledger(spark, sf_dir), VARIANTS).drop("resolved_ts")


@registered
def ma_baseline(spark, sf_dir):
    return evaluate.ma_baseline(core(spark, sf_dir), series(spark, sf_dir)).select("series_id", "obs_id", "ma_up")


@registered
def confidence_buckets(spark, sf_dir):
    return evaluate.confidence_buckets(ledger(spark, sf_dir))


@registered
def confident_mistakes(spark, sf_dir):
    return evaluate.confident_mistakes(ledger(spark, sf_dir))


@registered
def regime_summary(spark, sf_dir):
    return evaluate.by_regime(ledger(spark, sf_dir), ["coin"])


@registered
def drift_windows(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return evaluate.drift(rows, newest_time(rows, "resolved_ts"), ["coin"])


@registered
def dataset_health(spark, sf_dir):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return evaluate.dataset_health(ledger(spark, sf_dir), day("1995-01-01"), day("1996-01-01"))


@registered
def outcome_resolution(spark, sf_dir):
    rows = series(spark, sf_dir)
    due = rows.select(F.col("obs_id").alias("id"), "series_id", "price", (F.col("ts") + F.expr("interval 24 hour")).alias("target_ts"))
    return rounded(evaluate.resolve(due, rows, newest_time(rows, "ts"), TOL).drop("resolved_ts"))


@registered
def bias_resolution(spark, sf_dir):
    rows = series(spark, sf_dir)
    bias = F.element_at(F.array(*[F.lit(b) for b in ("bullish", "bearish", "neutral")]), (F.col("obs_id") % 3 + 1).cast("int"))
    said = rows.select(F.col("obs_id").alias("id"), "series_id", "ts", "price", bias.alias("bias"))
    return rounded(evaluate.resolve_bias(said, rows, newest_time(rows, "ts"), TOL).select("id", "bias", "return_pct", "bias_correct"))


def long_variants(spark, sf_dir):
    return evaluate.unpivot_variants(ledger(spark, sf_dir), VARIANTS, [*LEDGER_KEY, "id", "ts", "realized_up"])


@registered
def variant_eligibility(spark, sf_dir):
    return selection.eligible(long_variants(spark, sf_dir))


@registered
def variant_lca(spark, sf_dir):
    long = long_variants(spark, sf_dir)
    near = selection.condition_neighbourhood(ledger(spark, sf_dir), list(WEIGHTS))
    return rounded(selection.lca(long, near, selection.current_calls(long)))


def decisions(out: DataFrame) -> DataFrame:
    """Decision records with the neighbourhood as text, and its distances' sum."""
    total = F.aggregate(F.transform("neighborhood", lambda n: n["dist"]), F.lit(0.0), lambda a, x: a + x)
    hours = F.array_join(F.transform("neighborhood", lambda n: F.date_format(n["ts"], "yyyy-MM-dd HH")), ",")
    return out.withColumn("neighborhood_dist", F.round(total, 2)).withColumn("neighborhood", hours)


@registered
def variant_choice(spark, sf_dir):
    out = selection.select_variant(ledger(spark, sf_dir), VARIANTS, list(WEIGHTS))
    return rounded(decisions(out))


@registered
def backtest_momentum(spark, sf_dir):
    """The score of the last 30 prices, 60 rows of warm-up, 15 neighbours."""
    preds = backtest.walk_forward(windows.momentum_score(series(spark, sf_dir)), ["technical_score"], 15, F.lit(60))
    return rounded(preds.select("series_id", "obs_id", "p_up", "realized_up"))


@registered
def backtest_single(spark, sf_dir):
    preds = backtest.walk_forward(windows.momentum_score(series(spark, sf_dir)), ["technical_score"], 10, backtest.single_warmup())
    return backtest.backtest_summary(preds, digits=9)


@registered
def backtest_combined(spark, sf_dir):
    complete = features(spark, sf_dir).where("regime_mag is not null")
    preds = backtest.walk_forward(complete, ["technical_score", "regime_mag"], 15, backtest.combined_warmup(), stats="prior")
    return rounded(preds.select("series_id", "obs_id", "p_up", "realized_up"))


@registered
def backtest_regime_split(spark, sf_dir):
    rows = windows.momentum_score(series(spark, sf_dir))
    sentiment = enrich(rows, view(spark, sf_dir, "v_context"), ["score"], TOL, {"score": 50.0}).select("obs_id", "score")
    preds = backtest.walk_forward(rows, ["technical_score"], 10, backtest.single_warmup()).join(sentiment, "obs_id")
    return backtest.regime_split(preds, "score", digits=9)


@registered
def catalyst_validate(spark, sf_dir):
    return catalysts.validate_catalysts(view(spark, sf_dir, "v_catalyst")).select("id", "valid", F.array_join("errors", "; ").alias("errors"))


@registered
def catalyst_dedupe(spark, sf_dir):
    rows = view(spark, sf_dir, "v_catalyst")
    return catalysts.drop_fuzzy_duplicates(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), tol=2 * HOUR).select("id", "coin", "category")


@registered
def catalyst_availability(spark, sf_dir):
    rows = view(spark, sf_dir, "v_catalyst")
    return rows.groupBy("coin", "category", catalysts.availability(F.col("first_public_ts"), F.col("ts")).alias("available")).agg(F.count("*").alias("n"))


@registered
def response_parse(spark, sf_dir):
    return catalysts.normalize_responses(view(spark, sf_dir, "v_response")).select("id", "parse_status", "valid", F.array_join("errors", "; ").alias("errors"))


@registered
def investigation_rank(spark, sf_dir):
    """K9 and K10 for each coin as of the newest resolution, prices of the coin from the catalysts' view of events."""
    rows = ledger(spark, sf_dir)
    events = view(spark, sf_dir, "v_catalyst").select("coin", F.col("id").alias("obs_id"), "ts", (F.col("id") % 997 + 1).cast("double").alias("price"))
    as_of = newest_time(rows.where("realized_up is not null"), "resolved_ts")
    signals = catalysts.candidate_signals(rows, events, as_of, hours=24 * 30)
    return rounded(catalysts.priority(signals))


@registered
def budget_audit(spark, sf_dir):
    out = audit.check_budget(view(spark, sf_dir, "v_investigation"), 2, 40, key=["asset_no"])
    return out.select("id", F.col("in_hour").cast("long"), F.col("in_day").cast("long"), "hourly", "daily", "violation")


@registered
def duplicate_audit(spark, sf_dir):
    return audit.duplicate_keys(view(spark, sf_dir, "v_investigation"), ["investigation_id"])


@registered
def status_rollup(spark, sf_dir):
    rows = view(spark, sf_dir, "v_catalyst")
    result = audit.check_order(F.col("first_public_ts"), F.col("ts"))
    return audit.rollup(rows.select("coin", "category", F.to_date("ts").alias("day"), result.alias("c")).select("coin", "category", "day", F.col("c.status").alias("status")), ["coin", "category", "day"])


@registered
def immutability_audit(spark, sf_dir):
    before = ledger(spark, sf_dir)
    after = before.withColumn("realized_up", F.coalesce("realized_up", F.lit(0))).withColumn("p_up", F.when(F.col("id") % 1001 == 0, F.col("p_up") + 0.5).otherwise(F.col("p_up"))).where("id % 1500 <> 7")
    return audit.immutability(before, after, "id", ["realized_up", "resolved_ts"])


@registered
def leakage_audit(spark, sf_dir):
    near = analog.candidates(features(spark, sf_dir), analog.AnalogConfig()).select("ts", F.col("_last.ts").alias("query_ts"), "horizon_hours")
    return audit.leakage_checks(ledger(spark, sf_dir), near)


def whole_report(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    other = rows.where("coin <> 'ETH'").select(*LEDGER_KEY, "id", "resolved_ts", "realized_up", F.coalesce("p_up_experimental", "p_up").alias("p"))
    return evaluate.daily_report(rows, newest_time(rows, "resolved_ts"), challenger=other, catalysts=view(spark, sf_dir, "v_catalyst"))


@registered
def daily_report(spark, sf_dir):
    return rounded(whole_report(spark, sf_dir))


@registered
def series_coverage(spark, sf_dir):
    return ingest.coverage(series(spark, sf_dir), ["series_id"])


@registered
def newest_rows(spark, sf_dir):
    return calibration.newest(series(spark, sf_dir), ["series_id"], ["ts", "obs_id"], 5).select("series_id", "obs_id")


@registered
def tick_scores(spark, sf_dir):
    """The last tenth of ids as ticks on top of the rest."""
    rows = series(spark, sf_dir)
    return ingest.append_ticks(rows.where("obs_id % 10 <> 9"), rows.where("obs_id % 10 = 9")).select("series_id", "obs_id", "technical_score")


@registered
def series_backfill(spark, sf_dir):
    """Odd ids as candles over even ids as stored prices, half an hour of tolerance."""
    rows = series(spark, sf_dir)
    return ingest.backfill(rows.where("obs_id % 2 = 0"), rows.where("obs_id % 2 = 1"), 30 * 60_000_000).select("series_id", "obs_id", "technical_score")


@registered
def chain_audit(spark, sf_dir):
    """Requests about all resolved forecasts, half an hour after each, matched back to them."""
    rows = ledger(spark, sf_dir).where("realized_up is not null")
    asked = rows.select("id", "coin", (F.col("resolved_ts") + F.expr("interval 30 minute")).alias("request_ts"), F.greatest("p_up", 1 - F.col("p_up")).alias("confidence"), ((F.col("p_up") >= 0.5) != (F.col("realized_up") == 1)).alias("was_wrong"))
    return audit.reconcile(asked, ledger(spark, sf_dir)).select("id", "prediction_id")


@registered
def prediction_record(spark, sf_dir):
    out = analog.prediction_record(features(spark, sf_dir), series(spark, sf_dir), model_version="v1")
    return rounded(out.select("series_id", "horizon_hours", "obs_id", "price", "p_up", "median_return", "p_up_experimental", "volatility_percentile", "is_regime_anomaly", "trend_strength", F.col("features")["regime_mag"].alias("regime_mag"), "model_version"))


@registered
def percentile_rank(spark, sf_dir):
    """each odd price among the even prices of its series."""
    rows = series(spark, sf_dir)
    values = rows.where("obs_id % 2 = 1").select("series_id", "obs_id", F.col("price").alias("value"))
    refs = rows.where("obs_id % 2 = 0").select("series_id", F.col("price").alias("ref"))
    return rounded(ranks.rank_in_reference(values, refs, ["series_id"]).select("series_id", "obs_id", "percentile"))


@registered
def weighted_quantile(spark, sf_dir):
    rows = series(spark, sf_dir).withColumn("weight", 1 / (F.col("obs_id") % 7 + 1))
    return rounded(ranks.weighted_quantile(rows, ["series_id"], "price", "weight", 0.5))


@registered
def order_statistic(spark, sf_dir):
    return rounded(ranks.floor_quantile(series(spark, sf_dir), ["series_id"], "price", 0.75))


@registered
def challenger_evaluation(spark, sf_dir):
    """E5 over the ledger: the experimental column as the tilted variant, a moving-average call and a driver from the id."""
    i = F.col("id")
    rows = ledger(spark, sf_dir).select(*LEDGER_KEY, "realized_up", F.col("p_up").alias("p_up_flat"), F.coalesce("p_up_experimental", "p_up").alias("p_up_tilted"), F.when(i % 4 != 0, (i % 2).cast("int")).alias("ma_up"), F.when(i % 5 == 0, "agree").when(i % 5 == 1, "disagree").when(i % 5 == 2, "uncovered").alias("driver_agreement"))
    return evaluate.evaluate_challenger(rows)


@registered
def preceding_decision(spark, sf_dir):
    """The newest forecast of an id divisible by 10, as a decision, at most an hour after each other forecast."""
    rows = ledger(spark, sf_dir)
    asked = rows.where("id % 10 <> 0").select("id", *LEDGER_KEY, F.col("ts").alias("request_ts"))
    return audit.preceding_decision(asked, rows.where("id % 10 = 0"), LEDGER_KEY).select("id", F.col("decision_ts"))


@registered
def latest_curve_batch(spark, sf_dir):
    """A batch of curves of all rows, then one that leaves a series out; the newer of each key."""
    rows = ledger(spark, sf_dir)
    stamp = lambda t: F.lit(t).cast("timestamp_ntz")
    old, _ = calibration.refresh_curves(rows, LEDGER_KEY, stamp("2024-01-01"))
    new, _ = calibration.refresh_curves(rows.where("coin <> 'ETH'"), LEDGER_KEY, stamp("2024-01-02"))
    return rounded(calibration.latest_batch(old.unionByName(new), LEDGER_KEY).select(*LEDGER_KEY, "decile", "empirical_up_rate", "n_samples", "computed_ts"))


@registered
def chart_extract(spark, sf_dir):
    return rounded(ingest.chart_extract(series(spark, sf_dir), ledger(spark, sf_dir), 24))


@registered
def catalyst_provenance(spark, sf_dir):
    """K5: a reported confidence from the id, some of it no allowed value."""
    rows = view(spark, sf_dir, "v_catalyst").withColumn("confidence", F.element_at(F.array(*[F.lit(c) for c in ("HIGH", "LOW", "sure")]), (F.col("id") % 3 + 1).cast("int")))
    return catalysts.provenance(rows).select("id", "timestamp_source", "timestamp_confidence")


@registered
def catalysts_of_period(spark, sf_dir):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return catalysts.catalysts_between(view(spark, sf_dir, "v_catalyst"), day("2024-01-05"), day("2024-01-12")).select("id")


@registered
def budget_pick(spark, sf_dir):
    """Assets ranked by their requests' number, three slots a day of which the newest request's day has used some."""
    log = view(spark, sf_dir, "v_investigation")
    ranked = log.groupBy(F.col("asset_no").alias("coin")).agg((F.count("*") / 10 + F.col("asset_no")).alias("priority"))
    left = catalysts.remaining_budget(log, newest_time(log, "request_ts"), per_day=60, per_hour=2)
    return rounded(catalysts.pick_within_budget(ranked, left))


@registered
def narrative_parse(spark, sf_dir):
    """K13 over texts built from the events: a bias, a risk and a score behind a section."""
    rows = view(spark, sf_dir, "v_catalyst")
    word = lambda *w: F.element_at(F.array(*[F.lit(x) for x in w]), (F.col("id") % len(w) + 1).cast("int"))
    text = F.concat(F.lit("Day. MACRO: calm ANALYSIS_JSON: {\"bias_short\":\""), word("Bullish", " bear", "none"), F.lit("\",\"macro_risk\":\""), word("LOW", "odd"), F.lit("\",\"macro_score\":"), (F.col("id") % 5 - 2).cast("string"), F.lit("}"))
    out = catalysts.parse_narratives(rows.select("id", text.alias("text")), ["MACRO"])
    return out.select("id", "narrative", "bias_short", "macro_risk", "macro_score")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: features, analogs, outcomes and a forecast for every series and horizon."""
    return analog_forecast(spark, sf_dir)


