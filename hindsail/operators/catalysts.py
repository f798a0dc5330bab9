"""Explanatory events: response texts, validation, duplicates, ranking, budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import HOUR, clamp, confidence, correct, micros, normalize_bias, normalize_risk, percent_return, preferred
from ..schemas import GROUNDING, RESPONSE
from .greedy import thinned
from .timejoin import asof_join, nearest_join

# The allowed categories, classifications and confidences, and the priority weights.
CATEGORIES = ("MACRO", "FED_RATES", "INFLATION", "EMPLOYMENT", "USD", "ETF_FLOWS", "REGULATION", "EXCHANGE", "STABLECOIN", "LIQUIDATION", "LEVERAGE", "TECHNICAL", "ON_CHAIN", "GEOPOLITICAL", "SECURITY", "PROTOCOL", "OTHER")
CLASSIFICATIONS = ("MARKET_WIDE", "SECTOR_SPECIFIC", "ASSET_SPECIFIC", "NO_CLEAR_CATALYST")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW", "UNKNOWN")
WEIGHTS = {"price_move": 0.5, "confident_error": 3.0, "correlated": 2.0, "anomaly": 1.5, "failures": 0.5, "regime_change": 2.0}
HIGH_PRIORITY = 4.0
URL = r"^https?://\S+$"


# The messages of failed checks are results that users compare.
MESSAGES = {
    "no_sources": "catalyst has no sources", "no_url": "] missing url", "bad_source": "] url is not well-formed: ", "source": "source[",
    "no_assets": "missing or invalid assets array", "bad_class": "invalid market_classification: ", "no_array": "catalysts must be an array", "no_object": "response is not a JSON object",
    "no_coin": "missing coin", "no_category": "missing category", "bad_category": "invalid category: ", "bad_url": "source_url is not a well-formed http(s) URL",
    "early_public": "first_public_timestamp is implausibly before event_timestamp", "early_discovery": "discovery_timestamp is implausibly before first_public_timestamp",
}


def _messages(*tests: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), message if isinstance(message, Column) else F.lit(message)) for bad, message in tests]))


def strip_fences(text: Column) -> Column:
    trimmed = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"```\s*$", "")
    return F.trim(trimmed)


def normalize_responses(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with `parsed` (RESPONSE, null if malformed), parse_status (ok or malformed_response), errors array and valid boolean. Bad JSON is a status, never an error."""
    clean = strip_fences(F.col(text))
    parsed = texts.withColumn("_clean", clean).withColumn("_variant", F.try_parse_json(F.col("_clean"))).withColumn("parsed", F.when(F.col("_variant").isNotNull(), F.from_json("_clean", RESPONSE)))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_variant", path, "variant"))
    whole = F.schema_of_variant("_variant")
    is_object = whole.startswith("OBJECT") | whole.startswith("ARRAY")  # an array lacks its assets
    is_array = lambda path: F.coalesce(kind(path).startswith("ARRAY"), F.lit(False))
    label, found = F.col("parsed.market_classification"), F.coalesce(F.col("parsed.catalysts"), F.array())
    no_source = lambda c: F.coalesce(F.size(c["sources"]) < 1, F.lit(True))
    source_errors = F.flatten(F.transform(found, lambda c: F.when(no_source(c), F.array(F.lit(MESSAGES["no_sources"]))).otherwise(F.array_compact(F.transform(c["sources"], lambda s, i: F.when(F.coalesce(s["url"], F.lit("")) == "", F.concat(F.lit(MESSAGES["source"]), i, F.lit(MESSAGES["no_url"]))).when(~s["url"].rlike(URL), F.concat(F.lit(MESSAGES["source"]), i, F.lit(MESSAGES["bad_source"]), s["url"])))))))
    own = _messages(
        (~is_array("$.assets"), MESSAGES["no_assets"]),
        (label.isNotNull() & ~label.isin(*CLASSIFICATIONS), F.concat(F.lit(MESSAGES["bad_class"]), label)),
        (F.coalesce(~kind("$.catalysts").isin("VOID") & ~is_array("$.catalysts"), F.lit(False)), MESSAGES["no_array"]),
    )
    errors = F.when(F.col("_variant").isNull(), F.array().cast("array<string>")).when(~is_object, F.array(F.lit(MESSAGES["no_object"]))).otherwise(F.concat(own, source_errors))
    out = parsed.withColumn("parse_status", F.when(F.col("_variant").isNull(), "malformed_response").otherwise("ok")).withColumn("errors", errors)
    return out.withColumn("valid", (F.col("parse_status") == "ok") & (F.size("errors") == 0)).drop("_clean", "_variant")


def validate_catalysts(df: DataFrame, coin: str = "coin", category: str = "category", classification: str | None = None, url: str = "source_url", event_ts: str = "ts", public_ts: str = "first_public_ts", discovery_ts: str = "discovery_ts") -> DataFrame:
    """df with errors array and valid boolean: series and category present and allowed, URL well formed, times in order with an hour's tolerance."""
    c = F.col
    early = lambda later, earlier: micros(c(later)) < micros(c(earlier)) - HOUR
    missing = lambda name: F.coalesce(c(name), F.lit("")) == ""
    errors = _messages(
        (missing(coin), MESSAGES["no_coin"]),
        (missing(category), MESSAGES["no_category"]),
        (~missing(category) & ~c(category).isin(*CATEGORIES), F.concat(F.lit(MESSAGES["bad_category"]), c(category))),
        ((c(classification).isNotNull() & ~c(classification).isin(*CLASSIFICATIONS, "")) if classification else F.lit(False), F.concat(F.lit(MESSAGES["bad_class"]), c(classification)) if classification else ""),
        (c(url).isNotNull() & ~c(url).rlike(URL), MESSAGES["bad_url"]),
        (early(public_ts, event_ts), MESSAGES["early_public"]),
        (early(discovery_ts, public_ts), MESSAGES["early_discovery"]),
    )
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def drop_fuzzy_duplicates(new: DataFrame, stored: DataFrame, keys: Sequence[str] = ("coin", "category"), ts: str = "ts", tol: int = 6 * HOUR, row_id: str = "id", within_batch: bool = False) -> DataFrame:
    """New rows with no stored row of the same keys within tol microseconds, inclusive. within_batch: nor one of the new rows kept before, by (time, id), that close.

    Rows without a time are never duplicates; of rows with equal keys, time and
    id one is kept. What within_batch keeps depends on what was kept before: a
    parallel scan, see operators.greedy, so that a long key is many tasks.
    """
    kept = nearest_join(new, stored, list(keys), ts, ts, tol, row_id, [ts], how="anti")
    if not within_batch:
        return kept
    at = micros(F.col(ts))
    chosen = thinned(kept.select(*keys, at.alias("_t"), F.col(row_id).alias("_id")), keys, tol, "_t", "_id")
    chosen = chosen.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_t").alias("_kt"), F.col("_id").alias("_kid"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [at == F.col("_kt"), F.col(row_id).eqNullSafe(F.col("_kid"))]
    one = Window.partitionBy("_kt", *[f"_k{i}" for i in range(len(keys))], "_kid").orderBy("_kt")
    timed = kept.join(chosen, same).withColumn("_place", F.row_number().over(one)).where("_place = 1")
    return timed.select(*kept.columns).union(kept.where(at.isNull()))


def provenance(df: DataFrame, public_ts: str = "first_public_ts", reported: str = "confidence") -> DataFrame:
    """df with timestamp_source (unknown, reported) and timestamp_confidence."""
    known = F.col(public_ts).isNotNull()
    return df.withColumn("timestamp_source", F.when(known, "reported").otherwise("unknown")).withColumn("timestamp_confidence", F.when(known & F.col(reported).isin(*CONFIDENCES), F.col(reported)).otherwise("UNKNOWN"))


def grounding(df: DataFrame, metadata: str = "grounding_json", url: str = "source_url") -> DataFrame:
    """df with search_queries, grounded_sources (url, title) and is_grounded: whether url is exactly one of them."""
    g = F.from_json(F.col(metadata), GROUNDING)
    sources = F.filter(F.transform(F.coalesce(g["groundingChunks"], F.array()), lambda c: F.struct(c["web"]["uri"].alias("url"), c["web"]["title"].alias("title"))), lambda s: s["url"].isNotNull())
    out = df.withColumn("search_queries", F.coalesce(g["webSearchQueries"], F.array().cast("array<string>"))).withColumn("grounded_sources", sources)
    return out.withColumn("is_grounded", F.coalesce(F.array_contains(F.transform("grounded_sources", lambda s: s["url"]), F.col(url)), F.lit(False)))


def is_available(public_ts: Column, prediction_ts: Column) -> Column:
    """Whether a catalyst was public no later than a prediction; null if either time is missing."""
    return public_ts <= prediction_ts


def availability(public_ts: Column, prediction_ts: Column) -> Column:
    """is_available() as a label: 'unknown', 'true' or 'false'."""
    return F.coalesce(is_available(public_ts, prediction_ts).cast("string"), F.lit("unknown"))


def newest_available(predictions: DataFrame, catalysts: DataFrame, key: Sequence[str] = ("coin",), take: Sequence[str] = ("id",), prefix: str = "catalyst_") -> DataFrame:
    """predictions(key, ts) with the columns take of the newest catalyst that was public no later: nulls if there was none. Catalysts without a public time never are."""
    return asof_join(predictions, catalysts, key, "ts", "first_public_ts", "id", take, prefix=prefix)


def catalysts_between(df: DataFrame, since: Column, until: Column, n: int = 100, ts: str = "ts", row_id: str = "id") -> DataFrame:
    """The newest n catalysts in [since, until)."""
    return df.where((F.col(ts) >= since) & (F.col(ts) < until)).orderBy(F.desc(ts), F.desc(row_id)).limit(n)


def candidate_signals(ledger: DataFrame, prices: DataFrame, as_of: Column, coin: str = "coin", calibrated: str | None = None, hours: float = 3.5, newest: int = 5) -> DataFrame:
    """One row per series with a row resolved in the trailing window: signals of its newest one, its failures, the number of series with any, and the series' price move.

    ledger(coin, id, resolved_ts, p_up, realized_up, is_regime_anomaly);
    prices(coin, ts, obs_id, price).
    """
    start = micros(as_of) - int(hours * HOUR)
    p = preferred(F.col(calibrated), F.col("p_up")) if calibrated else F.col("p_up")
    w = Window.partitionBy(coin).orderBy(F.desc("resolved_ts"), F.desc("id"))
    recent = ledger.where(F.col("realized_up").isNotNull() & (micros(F.col("resolved_ts")) >= start) & (F.col("resolved_ts") <= as_of)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= newest)
    marked = recent.withColumn("_p", p).withColumn("_wrong", ~correct(F.col("_p"), F.col("realized_up")))
    first = lambda c: F.min_by(c, "_n")
    by = marked.groupBy(coin).agg(first("_wrong").alias("was_wrong"), first(confidence(F.col("_p"))).alias("confidence"), (first("is_regime_anomaly") == 1).alias("is_anomaly"), F.count_if("_wrong").alias("recent_failures"))
    failed = by.agg(F.count_if(F.col("recent_failures") > 0).alias("correlated_failures"))
    seen = prices.where(F.col("ts") <= as_of)
    order = F.struct("ts", "obs_id")
    moves = seen.groupBy(coin).agg(F.min_by("price", F.when(micros(F.col("ts")) >= start, order)).alias("_old"), F.max_by("price", order).alias("_new"))
    out = by.crossJoin(F.broadcast(failed)).join(moves, coin, "left")  # one row of counts
    return out.select(coin, F.coalesce(percent_return(F.col("_old"), F.col("_new")), F.lit(0.0)).alias("price_move_pct"), "was_wrong", "confidence", "correlated_failures", "is_anomaly", "recent_failures", F.lit(False).alias("is_regime_change"))


def priority(df: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Signals with priority (3 places) and is_high. Confidence counts only where the call was wrong."""
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    error = F.when(F.col("was_wrong").cast("boolean") & F.col("confidence").isNotNull(), F.greatest(F.lit(0.0), (F.col("confidence") - 0.5) * 2)).otherwise(0.0)
    total = weights["price_move"] * F.abs(number("price_move_pct")) + weights["confident_error"] * error + weights["correlated"] * F.greatest(F.lit(0), number("correlated_failures") - 1) + weights["anomaly"] * flag("is_anomaly") + weights["failures"] * number("recent_failures") + weights["regime_change"] * flag("is_regime_change")
    return df.withColumn("priority", F.round(total, 3)).withColumn("is_high", F.col("priority") >= HIGH_PRIORITY)


def remaining_budget(log: DataFrame, as_of: Column, per_day: int = 1, per_hour: int = 1, ts: str = "request_ts") -> DataFrame:
    """One row: what the trailing 24 hours and the trailing hour leave of their limits, and the smaller of both as `budget`."""
    age = micros(as_of) - micros(F.col(ts))
    used = log.where(age >= 0).agg(F.count_if(age <= 24 * HOUR).alias("day"), F.count_if(age <= HOUR).alias("hour"))
    return used.select(F.greatest(F.lit(0), F.lit(per_day) - F.col("day")).alias("day_left"), F.greatest(F.lit(0), F.lit(per_hour) - F.col("hour")).alias("hour_left")).withColumn("budget", F.least("day_left", "hour_left"))


def pick_within_budget(ranked: DataFrame, budget: DataFrame, order: Sequence[str] = ("coin",), threshold: float = HIGH_PRIORITY) -> DataFrame:
    """ranked with place (priority descending, then order) and decision: selected for the first `budget` rows at threshold or more, else deferred."""
    w = Window.orderBy(F.desc("priority"), *order)  # one row per series: the ranking is global by definition
    placed = ranked.withColumn("place", F.row_number().over(w)).crossJoin(F.broadcast(budget.select("budget")))  # one row
    return placed.withColumn("decision", F.when((F.col("priority") >= threshold) & (F.col("place") <= F.col("budget")), "selected").otherwise("deferred")).drop("budget")


def trigger_reasons(df: DataFrame, move_pct: float = 3.0, confidence_at: float = 0.85, assets: int = 3) -> DataFrame:
    """The older rule: reasons array by fixed thresholds on price_move_pct, confidence (of a failure) and correlated_failures, and trigger."""
    move = F.col("price_move_pct")
    reasons = F.array_compact(F.array(
        F.when(F.abs(move) >= move_pct, F.concat(F.when(move >= 0, "price_move_up_").otherwise("price_move_down_"), F.format_string("%.1f", F.abs(move)), F.lit("pct"))),
        F.when(F.col("was_wrong").cast("boolean") & (F.col("confidence") >= confidence_at), F.concat(F.lit("high_confidence_failure_"), F.format_string("%.2f", "confidence"))),
        F.when(F.col("correlated_failures") >= assets, F.concat(F.lit("correlated_failures_"), F.col("correlated_failures"), F.lit("_assets"))),
    ))
    return df.withColumn("reasons", reasons).withColumn("trigger", F.size("reasons") > 0)


def rate_limit_reason(day: Column, hour: Column, per_day: int = 1, per_hour: int = 1) -> Column:
    return F.when(day >= per_day, "daily_limit_reached").when(hour >= per_hour, "hourly_limit_reached")


NARRATIVE = "bias_short string, bias_medium string, bias_long string, support_pct_below double, resistance_pct_above double, macro_risk string, geopolitical_risk string, macro_score double, liquidity_bias double, cross_asset_stress double"


def parse_narratives(texts: DataFrame, sections: Sequence[str], label: str = "ANALYSIS_JSON", text: str = "text") -> DataFrame:
    """texts with narrative and the fields of NARRATIVE: a trailing `label: {…}` is taken out and parsed (bad JSON leaves nulls), each section label gets a blank line before it, fields are normalised and clamped."""
    body, tail = F.trim(text), rf"{label}:\s*(\{{[\s\S]*\}})\s*$"
    parsed = texts.withColumn("_json", F.from_json(F.regexp_extract(body, tail, 1), NARRATIVE))
    narrative = F.trim(F.regexp_replace(body, tail, ""))
    narrative = reduce(lambda t, s: F.regexp_replace(t, rf"(?i)\s*({s}:)", "\n\n$1"), sections, narrative)
    trimmed = F.regexp_replace(F.regexp_replace(narrative, r"^\s+", ""), r"\s+$", "")
    j = lambda c: F.col(f"_json.{c}")
    ranges = {"support_pct_below": None, "resistance_pct_above": None, "macro_score": (-1.0, 1.0), "liquidity_bias": (-1.0, 1.0), "cross_asset_stress": (0.0, 1.0)}
    out = parsed.withColumn("narrative", trimmed)
    for c in ("bias_short", "bias_medium", "bias_long"):
        out = out.withColumn(c, normalize_bias(j(c)))
    for c in ("macro_risk", "geopolitical_risk"):
        out = out.withColumn(c, normalize_risk(j(c)))
    for c, r in ranges.items():
        out = out.withColumn(c, clamp(j(c), *(r or (float("-1e308"), float("1e308")))))
    return out.drop("_json")


def ingest_responses(texts: DataFrame, stored: DataFrame, own_assets: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalysts, investigations) from response texts(id, request_ts, text): one catalyst per valid entry and asset (the entry's assets, else the response's, else own_assets) that is no duplicate of stored; one investigation per text, in every outcome.

    Times in texts are epoch milliseconds; an entry without one has the request's time.
    """
    read = normalize_responses(texts)
    entries = read.where("valid").select("id", "request_ts", "parsed", F.posexplode(F.coalesce("parsed.catalysts", F.array())).alias("_pos", "_c"))
    millis = lambda c: F.timestamp_millis(c).cast("timestamp_ntz")
    assets = F.coalesce(F.when(F.size("_c.assets") > 0, F.col("_c.assets")), F.when(F.size("parsed.assets") > 0, F.col("parsed.assets")), own_assets if own_assets is not None else F.array().cast("array<string>"))
    rows = entries.select(F.col("id").alias("investigation"), "request_ts", "_pos", F.explode(assets).alias("coin"), F.col("_c.category").alias("category"), F.coalesce(millis(F.col("_c.event_timestamp")), F.col("request_ts")).alias("ts"), millis(F.col("_c.first_public_timestamp")).alias("first_public_ts"), F.col("request_ts").alias("discovery_ts"), F.col("_c.sources")[0]["url"].alias("source_url"), F.col("_c.confidence").alias("confidence"), F.col("_c.description").alias("description"), F.size("_c.sources").alias("n_sources"))
    good = provenance(validate_catalysts(rows.withColumn("id", F.xxhash64("investigation", "_pos", "coin")))).where("valid").drop("errors", "valid")
    catalysts = drop_fuzzy_duplicates(good, stored).drop("_pos")
    written = catalysts.groupBy("investigation").agg(F.count("*").alias("n_written"))
    sources = F.aggregate(F.coalesce("parsed.catalysts", F.array()), F.lit(0), lambda s, c: s + F.greatest(F.lit(0), F.coalesce(F.size(c["sources"]), F.lit(0))))
    status = F.when(F.col("parse_status") != "ok", F.col("parse_status")).when(~F.col("valid"), "invalid_structure").when(F.size(F.coalesce("parsed.catalysts", F.array())) == 0, "no_clear_catalyst").otherwise("ok")
    attempts = read.join(written.withColumnRenamed("investigation", "id"), "id", "left").select("id", "request_ts", status.alias("status"), sources.alias("n_sources"), F.coalesce("n_written", F.lit(0)).alias("catalysts_written"), "errors")
    return catalysts, attempts
