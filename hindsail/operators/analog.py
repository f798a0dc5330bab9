"""Forecasts from the nearest historical analogs of each series' last row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import HOUR, clamp, micros, or_one, order_statistic, percent_return, trend_guardrail, unit_ratio, units
from ..functions.ranks import rank_of_one
from ..functions.windows import trailing_volatility, trend_strength
from . import kernels
from .calibration import apply_calibration
from .timejoin import asof_join, asof_join_keyless, forward_returns


@dataclass(frozen=True)
class AnalogConfig:
    """features: columns compared; min_rows: gate on rows of a series; horizons in hours; tolerance: share of the horizon.

    sets: names of feature sets and the features of each, for jobs whose series
    do not all compare the same; the column set_col of a row names its series'
    set. features then lists all of them.
    """

    features: Sequence[str] = ("technical_score", "regime_mag")
    horizons: Sequence[int] = (12, 24)
    min_rows: int = 30
    min_resolved: int = 5
    tolerance: float = 0.2
    max_k: int = 15
    digits: int = 9
    sets: Mapping[str, Sequence[str]] | None = None
    set_col: str = "feature_set"

    def uses(self, feature: str) -> Column:
        """Whether a row's series compares this feature."""
        return F.col(self.set_col).isin(*[name for name, own in self.sets.items() if feature in own]) if self.sets else F.lit(True)

    def complete(self) -> Column:
        """Whether a row has all features that its series compares."""
        return reduce(lambda a, b: a & b, [F.coalesce(~self.uses(f), F.lit(False)) | F.col(f).isNotNull() for f in self.features])


def scaled(rows: DataFrame, cfg: AnalogConfig) -> DataFrame:
    """Complete rows of each series with z-scaled features `_z`, row number `_rn`, size `_rows` and the last row's features `_last_z`, time and id."""
    w = Window.partitionBy("series_id")
    complete = rows.where(cfg.complete())
    scale = lambda f: F.col(f) / or_one(F.stddev_pop(f).over(w))
    z = F.array(*[F.when(cfg.uses(f), scale(f)).otherwise(0.0) if cfg.sets else scale(f) for f in cfg.features])
    ordered = complete.withColumn("_z", z).withColumn("_rn", F.row_number().over(w.orderBy("ts", "obs_id"))).withColumn("_rows", F.count("*").over(w))
    last = F.max_by(F.struct("_z", "ts", "obs_id", "price"), F.struct("ts", "obs_id")).over(w)
    return ordered.withColumn("_last", last)


def candidates(rows: DataFrame, cfg: AnalogConfig) -> DataFrame:
    """Every (series, horizon, earlier row) with its distance to the series' last row, rank `_rank` by (distance, time) and count `_n`.

    Candidates are counted before they are ranked, so that a filter on the rank
    alone can end the ranking early.
    """
    w = Window.partitionBy("series_id")
    latest = {h: micros(F.col("_last.ts")) - int(h * HOUR * (1 + cfg.tolerance)) for h in cfg.horizons}
    old = lambda h: (micros(F.col("ts")) <= latest[h]) & (F.col("obs_id") != F.col("_last.obs_id"))
    counted = scaled(rows, cfg).select("*", *[F.count_if(old(h)).over(w).alias(f"_n{h}") for h in cfg.horizons])
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_n{h}").alias("n"), old(h).alias("old")) for h in cfg.horizons])).alias("_h")
    spread = counted.select("*", each).where("_h.old").withColumn("horizon_hours", F.col("_h.h")).withColumn("_n", F.col("_h.n")).drop("_h", *[f"_n{h}" for h in cfg.horizons])
    squares = F.aggregate(F.zip_with("_z", "_last._z", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    far = spread.withColumn("dist", F.round(F.sqrt(squares), cfg.digits))
    return far.withColumn("_rank", F.row_number().over(Window.partitionBy("series_id", "horizon_hours").orderBy("dist", "ts", "obs_id")))


def neighbour_count(n):
    """min(15, max(5, floor(n / 3)))."""
    return F.least(F.lit(15), F.greatest(F.lit(5), F.floor(n / 3)))


def with_outcomes(neighbours: DataFrame, prices: DataFrame, cfg: AnalogConfig) -> DataFrame:
    """Neighbours that have a price near their time plus horizon, with return_pct. One whose return is unknown, by a null price or one of 0, has no outcome."""
    return forward_returns(neighbours, prices, ["series_id"], max(cfg.horizons), share=cfg.tolerance).where("return_pct is not null")


def keys_of(rows: DataFrame, cfg: AnalogConfig) -> DataFrame:
    """(series_id, horizon_hours, n_complete): every series of rows, gated or not."""
    return rows.groupBy("series_id").agg(F.count("*").alias("n_rows"), F.count_if(cfg.complete()).alias("n_complete")).withColumn("horizon_hours", F.explode(F.array(*[F.lit(h) for h in cfg.horizons])))


def _status(cfg: AnalogConfig):
    return F.when((F.col("n_rows") < cfg.min_rows) | (F.col("n_complete") < cfg.min_rows), "insufficient_data").when(F.coalesce("n_resolved", F.lit(0)) < cfg.min_resolved, "insufficient_resolved_analogs").otherwise("ok")


def analog_forecast(rows: DataFrame, prices: DataFrame, cfg: AnalogConfig = AnalogConfig()) -> DataFrame:
    """One row per series and horizon: status, n_neighbors, n_resolved, p_up, median, p25 and p75 of the analogs' returns, and the five closest analogs that have one.

    rows(series_id, obs_id, ts, price, features); the last row of a series is
    its query. A gated series still has a row, with nulls for a forecast. Rows
    with a column context_imputed also have n_imputed: how many neighbours
    stand on imputed context.
    """
    imputed = "context_imputed" in rows.columns
    near = candidates(rows, cfg).where(F.col("_rank") <= cfg.max_k).where(F.col("_rank") <= neighbour_count(F.col("_n")))
    near = near.select("series_id", "horizon_hours", "obs_id", "ts", "price", "dist", "_rank", *(["context_imputed"] if imputed else []))
    resolved = with_outcomes(near, prices, cfg)
    returns = F.collect_list("return_pct")
    by = resolved.groupBy("series_id", "horizon_hours").agg(
        F.count("*").alias("n_resolved"), F.avg((F.col("return_pct") > 0).cast("int")).alias("p_up"), returns.alias("_returns"),
        F.slice(F.array_sort(F.collect_list(F.struct("_rank", "obs_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), "dist", "return_pct"))), 1, 5).alias("closest"),
    )
    counted = near.groupBy("series_id", "horizon_hours").agg(F.count("*").alias("n_neighbors"), *([F.sum(F.col("context_imputed").cast("long")).alias("n_imputed")] if imputed else []))
    out = keys_of(rows, cfg).join(counted, ["series_id", "horizon_hours"], "left").join(by, ["series_id", "horizon_hours"], "left").withColumn("status", _status(cfg))
    ok = lambda c: F.when(F.col("status") == "ok", c)
    seen = lambda c: F.when(F.col("status") != "insufficient_data", F.coalesce(c, F.lit(0)))
    return out.select("series_id", "horizon_hours", "status", seen("n_neighbors").alias("n_neighbors"), seen("n_resolved").alias("n_resolved"), *([seen("n_imputed").alias("n_imputed")] if imputed else []), ok(F.col("p_up")).alias("p_up"), *[ok(order_statistic(F.col("_returns"), p)).alias(name) for name, p in (("median_return", 0.5), ("p25_return", 0.25), ("p75_return", 0.75))], ok(F.col("closest")).alias("closest"))


def analog_weighted(rows: DataFrame, prices: DataFrame, cfg: AnalogConfig = AnalogConfig()) -> DataFrame:
    """The adaptive variant per series and horizon: volatility_percentile, k_adaptive, weighted p_up and weighted median return; null under min_resolved analogs.

    The last row's volatility is ranked among the candidates'; a wild day takes
    fewer analogs, a calm one more; weights are 1 / (distance + 0.05),
    taken to 12 decimals and summed exactly.
    """
    by = ["series_id", "horizon_hours"]
    complete = rows.where(cfg.complete())
    today = trailing_volatility(complete).groupBy("series_id").agg(F.max_by("volatility", F.struct("ts", "obs_id")).alias("_today"))
    w = Window.partitionBy(*by)
    near = trailing_volatility(candidates(rows, cfg).select(*by, "obs_id", "ts", "price", "dist", "_rank", "_n").join(today, "series_id"), key=by)
    known = F.count("volatility").over(w)
    vp = F.when((known >= 10) & F.col("_today").isNotNull(), F.count_if(F.col("volatility") <= F.col("_today")).over(w) / known)
    k, p = neighbour_count(F.col("_n")), F.col("volatility_percentile")
    adaptive = F.when(p >= 0.66, F.greatest(F.lit(5), F.floor(k * 0.6))).when(p <= 0.33, F.least(F.col("_n"), F.floor(k * 1.4))).otherwise(k).cast("long")
    ranked = near.withColumn("volatility_percentile", vp).withColumn("k_adaptive", adaptive)
    heads = ranked.where("_rank = 1").select(*by, "volatility_percentile", "k_adaptive")
    widest = int(cfg.max_k * 1.4)
    picked = ranked.where((F.col("_rank") <= widest) & (F.col("_rank") <= F.col("k_adaptive"))).select(*by, "obs_id", "ts", "price", "dist")
    weights = with_outcomes(picked, prices, cfg).withColumn("weight", units(1 / (F.col("dist") + 0.05)))
    share = unit_ratio(F.sum("weight").over(w.orderBy("return_pct").rangeBetween(Window.unboundedPreceding, 0)), F.sum("weight").over(w))
    up = unit_ratio(F.coalesce(F.sum(F.when(F.col("return_pct") > 0, F.col("weight"))), F.lit(0)), F.sum("weight"))
    sums = weights.withColumn("_share", share).groupBy(*by).agg(F.count("*").alias("n_resolved"), up.alias("p"), F.min(F.when(F.col("_share") >= 0.5, F.col("return_pct"))).alias("q"))
    out = keys_of(rows, cfg).where((F.col("n_rows") >= cfg.min_rows) & (F.col("n_complete") >= cfg.min_rows)).select(*by).join(heads, by, "left").join(sums, by, "left")
    ok = F.col("n_resolved") >= cfg.min_resolved
    return out.select(*by, "volatility_percentile", "k_adaptive", F.when(ok, F.col("p")).alias("p_up_experimental"), F.when(ok, F.col("q")).alias("median_return_experimental"))


def regime_anomaly(rows: DataFrame, cfg: AnalogConfig = AnalogConfig(), block: int = kernels.BLOCK) -> DataFrame:
    """Per series and horizon: closest distance of the last row, its percentile among the candidates' closest distances to earlier candidates, and is_regime_anomaly at 0.9 or more."""
    by = ["series_id", "horizon_hours"]
    near = candidates(rows, cfg)
    flat = near.select(*by, "ts", "obs_id", "_rn", *[F.element_at("_z", i + 1).alias(f"_z{i}") for i in range(len(cfg.features))])
    # candidates of a shorter horizon begin with those of a longer one: one pass serves all
    every = flat.where(F.col("horizon_hours") == min(cfg.horizons))
    prior = kernels.closest_prior(every, ["series_id"], "_rn", [f"_z{i}" for i in range(len(cfg.features))], block)
    refs = flat.select(*by, "_rn").join(prior.withColumnRenamed("rn", "_rn"), ["series_id", "_rn"]).select(*by, F.col("closest").alias("ref"))
    values = near.groupBy(*by).agg(F.min("dist").alias("value"))
    ranked = rank_of_one(values, refs, by)
    return ranked.select(*by, F.col("value").alias("closest_dist"), F.col("percentile").alias("closest_dist_percentile"), F.coalesce(F.col("percentile") >= 0.9, F.lit(False)).cast("int").alias("is_regime_anomaly"))


def prediction_record(rows: DataFrame, prices: DataFrame, cfg: AnalogConfig = AnalogConfig(), model_version: str = "unversioned", git_commit_sha: str = "unknown", curve: DataFrame | None = None, history: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """One ledger row per series and horizon that has a forecast: the headline and weighted forecasts, the anomaly flag, the trend, the challenger's flat probability, the query row's features as a map, its time, target time and price, and the versions. Append it with sources.ingest.append_once().

    With curve(series_id, horizon_hours, ...) also calibrated_p_up, with
    history(series_id, horizon_hours, id, ts, realized_up, features) also
    p_up_conditional, its features weighted by weights.
    """
    by = ["series_id", "horizon_hours"]
    complete = rows.where(cfg.complete())
    order = F.struct("ts", "obs_id")
    features = F.map_from_arrays(F.array(*[F.lit(f) for f in cfg.features]), F.array(*[F.col(f).cast("double") for f in cfg.features]))
    last = trend_strength(complete).groupBy("series_id").agg(F.max_by(F.struct("ts", "obs_id", "price", "trend_strength", features.alias("features")), order).alias("_q")).select("series_id", "_q.*")
    made = analog_forecast(rows, prices, cfg).where("status = 'ok'")
    out = challenger_flat(made.join(analog_weighted(rows, prices, cfg), by).join(regime_anomaly(rows, cfg), by).join(last, "series_id"))
    more = ["p_up_flat"]
    if curve is not None:
        out, more = apply_calibration(out, curve, by, name="calibrated_p_up"), [*more, "calibrated_p_up"]
    if history is not None:
        asked = out.select(*by, "ts", *[F.col("features")[f].alias(f) for f in (weights or CALIBRATION_WEIGHTS)])
        told = conditional_calibration(asked, history, by, weights)
        out, more = out.join(told.select(*by, "p_up_conditional"), by, "left"), [*more, "p_up_conditional"]
    target = (F.col("ts") + F.expr("make_dt_interval(0, horizon_hours)")).alias("target_ts")
    return out.select(*by, "obs_id", "ts", target, "price", "p_up", "median_return", "p25_return", "p75_return", "n_resolved", "p_up_experimental", "median_return_experimental", "volatility_percentile", "closest_dist", "is_regime_anomaly", "trend_strength", *more, "features", F.lit(model_version).alias("model_version"), F.lit(git_commit_sha).alias("git_commit_sha"))


# Feature weights of the neighbourhood calibration.
CALIBRATION_WEIGHTS = {"score": 1.0, "technical_score": 1.0, "regime_mag": 1.5, "bottom_score": 0.3}


def neighbourhood(queries: DataFrame, history: DataFrame, key: Sequence[str], weights: dict[str, float], ts: str = "ts", pool: int = 300, min_values: int = 5, digits: int = 9, strictly_before: bool = True, row_id: str = "id") -> DataFrame:
    """Each query with its key's newest `pool` history rows ranked by weighted z-distance: `_dist`, `_rank`, `_pool`; columns of history with prefix h_.

    Stats come from the pool; a feature with fewer than min_values values, or
    missing in the query, is not used at all, one missing in a row adds nothing
    to its distance, and a query without usable features has null distances.
    Equal distances keep the newest first. There is one query per key.
    """
    before = F.col(f"h_{ts}") < F.col(ts) if strictly_before else F.lit(True)
    old = history.select([F.col(c).alias(f"h_{c}") for c in history.columns])
    joined = queries.join(old, [queries[k] == old[f"h_{k}"] for k in key]).where(before)
    w = Window.partitionBy(*key)
    recent = joined.withColumn("_new", F.row_number().over(w.orderBy(F.desc(f"h_{ts}"), F.desc(f"h_{row_id}")))).where(F.col("_new") <= pool)
    total, usable = F.lit(0.0), F.lit(False)
    for f, weight in weights.items():
        can = (F.count(f"h_{f}").over(w) >= min_values) & F.col(f).isNotNull()
        gap = (F.col(f) - F.col(f"h_{f}")) / or_one(F.stddev_pop(f"h_{f}").over(w))
        total = total + F.when(can & F.col(f"h_{f}").isNotNull(), weight * gap * gap).otherwise(0.0)
        usable = usable | can
    far = recent.withColumn("_dist", F.when(usable, F.round(F.sqrt(total), digits))).withColumn("_pool", F.count("*").over(w))
    return far.withColumn("_rank", F.row_number().over(w.orderBy("_dist", "_new")))


def conditional_calibration(queries: DataFrame, history: DataFrame, key: Sequence[str], weights: dict[str, float] | None = None, k: int = 30, min_neighbors: int = 20, pool: int = 300) -> DataFrame:
    """(key, p_up_conditional, n_neighbors): the share of ups among the k pool rows most like the query; null under min_neighbors or without usable features."""
    near = neighbourhood(queries, history, key, weights or CALIBRATION_WEIGHTS, pool=pool).where((F.col("_rank") <= k) & F.col("_dist").isNotNull())
    found = near.groupBy(*key).agg(F.count("*").alias("n"), F.avg("h_realized_up").alias("p"))
    ok = F.col("n") >= min_neighbors
    return queries.select(*key).join(found, list(key), "left").select(*key, F.when(ok, F.col("p")).alias("p_up_conditional"), F.when(ok, F.col("n")).alias("n_neighbors"))


def challenger_flat(core: DataFrame, p: str = "p_up", anomaly: str = "is_regime_anomaly", trend: str = "trend_strength", name: str = "p_up_flat") -> DataFrame:
    """core with the challenger's flat probability: halved lean on an anomaly, clamped, guarded against the trend, clamped."""
    shrunk = F.when(F.col(anomaly) == 1, 0.5 + (F.col(p) - 0.5) * 0.5).otherwise(F.col(p))
    return core.withColumn(name, clamp(trend_guardrail(clamp(shrunk), F.col(trend))))


def driver_tilt(flat: DataFrame, digests: DataFrame, ts: str = "ts", max_age_hours: int = 30) -> DataFrame:
    """flat(…, ts, p_up_flat, is_regime_anomaly, trailing_return_pct) with p_up_tilted, driver_used and driver_agreement.

    digests(published_ts, transcript_status, summary_json): the newest one not
    after ts counts, if its status is ok and it is fresh. Only anomalies with a
    known trailing return are tilted. Digests have no key: every part of flat
    gets a copy of them.
    """
    from ..schemas import DIGEST

    news = digests.select("published_ts", "transcript_status", "summary_json").withColumn("_did", F.xxhash64("published_ts", "summary_json"))
    seen = asof_join_keyless(flat, news, ts, "published_ts", "_did", ["published_ts", "transcript_status", "summary_json"], prefix="_d_")
    fresh = (F.col("_d_transcript_status") == "ok") & (micros(F.col(ts)) - micros(F.col("_d_published_ts")) <= max_age_hours * HOUR)
    live = F.coalesce((F.col("is_regime_anomaly") == 1) & F.col("trailing_return_pct").isNotNull() & fresh, F.lit(False))
    told = seen.withColumn("_s", F.from_json(F.coalesce("_d_summary_json", F.lit("{}")), DIGEST)).withColumn("_broken", F.coalesce(F.try_parse_json(F.coalesce("_d_summary_json", F.lit("{}"))).isNull(), F.lit(True)))
    drivers = F.filter(F.array("_s.dominant_driver", "_s.secondary_driver"), lambda d: d.isNotNull() & (d != "") & (d != "none"))
    leans = F.create_map(F.lit("macro"), F.col("_s.macro.lean"), F.lit("tradfi"), F.col("_s.tradfi.lean"))
    told = told.withColumn("_drivers", drivers).withColumn("_leans", leans)
    told = told.withColumn("_driver", F.try_element_at(F.filter("_drivers", lambda d: F.try_element_at("_leans", d).isNotNull()), F.lit(1))).withColumn("_lean", F.try_element_at("_leans", F.col("_driver")))
    way = F.when(F.col("trailing_return_pct") > 0, "bullish").when(F.col("trailing_return_pct") < 0, "bearish").otherwise("neutral")
    mapped, micro = F.col("_driver").isNotNull(), F.array_contains("_drivers", "micro")
    agreement = F.when(live & F.col("_broken"), "lookup_error").when(live & mapped, F.when(F.col("_lean") == way, "agree").when((F.col("_lean") != "neutral") & (way != "neutral"), "disagree").otherwise("na")).when(live & micro, "uncovered")
    p = F.col("p_up_flat")
    out = told.withColumn("driver_agreement", agreement).withColumn("driver_used", F.when(live & ~F.col("_broken"), F.when(mapped, F.col("_driver")).when(micro, F.lit("micro"))))
    tilted = F.when(F.col("driver_agreement") == "agree", p + F.when(p >= 0.5, 0.10).otherwise(-0.10)).when(F.col("driver_agreement") == "disagree", 0.5 + (p - 0.5) * 0.5).otherwise(p)
    return out.withColumn("p_up_tilted", clamp(tilted)).select(*flat.columns, "p_up_tilted", "driver_used", "driver_agreement")


def challenger_forecast(core: DataFrame, prices: DataFrame, key: Sequence[str] = ("series_id",), digests: DataFrame | None = None, lookback: int = 200, curve: DataFrame | None = None) -> DataFrame:
    """core(key, ts, price, horizon_hours, p_up, is_regime_anomaly, trend_strength) with trailing_return_pct and p_up_flat, with digests the tilted variant, and with curve (of the challenger's own past, by key and horizon_hours) calibrated_p_up_flat.

    The trailing return looks back one horizon, to the newest price at or
    before that time among the newest `lookback` prices, else their oldest.
    """
    back = F.col("ts") - F.expr("make_dt_interval(0, horizon_hours)")
    seen = asof_join(core.withColumn("_back", back), prices, key, "_back", "ts", "obs_id", ["price"], lookback=lookback, fallback=True, upto="ts", prefix="_old_")
    flat = challenger_flat(seen.withColumn("trailing_return_pct", F.when(F.col("_old_price") != 0, percent_return(F.col("_old_price"), F.col("price"))))).drop("_old_price", "_back")
    if curve is not None:
        flat = apply_calibration(flat, curve, [*key, "horizon_hours"], p="p_up_flat", name="calibrated_p_up_flat")
    return driver_tilt(flat, digests) if digests is not None else flat
