"""Small vectors: the cases that fix each operator's rules."""

from __future__ import annotations

import bisect
import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from hindsail.functions import expressions as E, ranks, windows as W
from hindsail.operators import analog, audit, backtest, calibration, catalysts, evaluate, kernels, selection
from hindsail.operators.timejoin import asof_join, enrich, nearest_join, tolerance_anti_join
from hindsail.sources import ingest

T0 = dt.datetime(2024, 1, 1)
HOUR = 3_600_000_000


def at(hours: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=hours)


def prices_of(spark, prices, step=1.0, series=1):
    return spark.createDataFrame([(series, i, at(i * step), float(p)) for i, p in enumerate(prices)], "series_id long, obs_id long, ts timestamp_ntz, price double")


# ---- windows


def momentum(window):
    if len(window) < 6:
        return 50.0
    changes = [b - a for a, b in zip(window, window[1:])]
    gain, loss = sum(max(c, 0) for c in changes), sum(max(-c, 0) for c in changes)
    return 50.0 if gain == loss == 0 else 100.0 if loss == 0 else float(math.floor(100 - 100 / (1 + gain / loss) + 0.5))


def test_momentum_against_loop(spark):
    r = random.Random(3)
    p = [r.randint(1, 9) for _ in range(80)]
    rows = prices_of(spark, p)
    now = {x.obs_id: x.technical_score for x in W.momentum_score(rows).collect()}
    before = {x.obs_id: x.technical_score for x in W.momentum_score(rows, include_current=False).collect()}
    assert now == {i: momentum(p[max(0, i - 29) : i + 1]) for i in range(80)}
    assert before == {i: momentum(p[max(0, i - 30) : i]) for i in range(80)}


@pytest.mark.parametrize(("prices", "test"), [([100] * 15, lambda v: v is None), ([100] * 13 + [100 + 20 * i for i in range(1, 9)], lambda v: v > 0), ([1000] * 13 + [1000 - 20 * i for i in range(1, 9)], lambda v: v < 0), ([100] * 21, lambda v: v == 0)])
def test_regime_magnitude_sign_and_gate(spark, prices, test):
    last = W.regime_magnitude(prices_of(spark, prices)).orderBy(F.desc("obs_id")).first()
    assert test(last.regime_mag)


def test_trend_needs_one_row_more(spark):
    rows = W.trend_strength(prices_of(spark, range(100, 123))).orderBy("obs_id").collect()
    assert rows[20].trend_strength == 0.0 and rows[21].trend_strength > 0


def test_flat_volatility_is_one(spark):
    rows = W.trailing_volatility(prices_of(spark, [5] * 6)).orderBy("obs_id").collect()
    assert [r.volatility for r in rows] == [None, None, None, 1.0, 1.0, 1.0]


def test_order_statistic_is_not_percentile_disc(spark):
    row = spark.range(1).select(E.order_statistic(F.array(*[F.lit(float(i)) for i in range(100)]), 0.5).alias("x")).first()
    assert row.x == 50.0
    assert ranks.floor_quantile(spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("v")), ["k"], "v", 0.5).first().quantile == 50


def test_rank_in_reference(spark):
    refs = spark.createDataFrame([(1, float(i)) for i in range(10)] + [(1, None), (2, 1.0)], "k int, ref double")
    values = spark.createDataFrame([(1, 4.0), (1, -1.0), (1, None), (2, 1.0)], "k int, value double")
    got = {(r.k, r.value): r.percentile for r in ranks.rank_in_reference(values, refs, ["k"]).collect()}
    assert got == {(1, 4.0): 0.5, (1, -1.0): 0.0, (1, None): None, (2, 1.0): None}


def test_weighted_quantile(spark):
    rows = spark.createDataFrame([(1, 3.0, 1.0), (1, 1.0, 1.0), (1, 2.0, 5.0)], "k int, v double, w double")
    assert ranks.weighted_quantile(rows, ["k"], "v", "w", 0.5).first().quantile == 2.0


def test_expressions(spark):
    bull = spark.createDataFrame([(" Bullish!",), ("BEAR",), ("neutral-ish",), ("up",), (None,)], "v string")
    assert [r[0] for r in bull.select(E.normalize_bias(F.col("v"))).collect()] == ["bullish", "bearish", "neutral", None, None]
    row = spark.range(1).select(E.clamp(F.lit(1.5)), E.clamp(F.lit(float("nan"))), E.trend_guardrail(F.lit(0.3), F.lit(0.9)), E.trend_guardrail(F.lit(0.3), F.lit(None).cast("double")), E.trend_regime(F.lit(None).cast("double")), E.volatility_regime(F.lit(0.85))).first()
    assert list(row) == [0.95, None, 0.4, 0.3, "neutral", "high_volatility"]


# ---- time joins


@pytest.mark.parametrize("strict", [False, True])
def test_nearest_join_brute_force(spark, strict):
    r = random.Random(5)
    left = [(r.choice("ab"), i, at(r.randint(0, 400) / 4)) for i in range(300)] + [("a", 998, None), ("c", 999, at(1))]
    right = [(r.choice("ab"), i, at(r.randint(0, 400) / 4)) for i in range(200)] + [("a", 997, None)]
    L = spark.createDataFrame(left, "k string, id long, ts timestamp_ntz")
    R = spark.createDataFrame(right, "k string, rid long, rts timestamp_ntz")
    tol = 2 * HOUR
    got = {x.id: x.rid for x in nearest_join(L, R, ["k"], "ts", "rts", tol, "rid", ["rid"], strict=strict, how="left").collect()}
    want = {}
    for k, i, t in left:
        near = [] if t is None else sorted((abs((s - t).total_seconds()), s, j) for q, j, s in right if q == k and s is not None and (abs((s - t).total_seconds()) < 7200 or (not strict and abs((s - t).total_seconds()) == 7200)))
        want[i] = near[0][2] if near else None
    assert got == want
    gone = {x.id for x in nearest_join(L, R, ["k"], "ts", "rts", tol, "rid", ["rid"], strict=strict, how="anti").collect()}
    assert gone == {i for i, v in want.items() if v is None}


def test_nearest_join_repeated_rows_and_empty(spark):
    L = spark.createDataFrame([("a", 1, T0)] * 2, "k string, id long, ts timestamp_ntz")
    R = spark.createDataFrame([("a", 7, T0), ("a", 3, T0)], "k string, rid long, rts timestamp_ntz")
    assert [x.rid for x in nearest_join(L, R, ["k"], "ts", "rts", 1, "rid", ["rid"]).collect()] == [3, 3]
    assert nearest_join(L, R.limit(0), ["k"], "ts", "rts", 1, "rid", ["rid"]).count() == 0


def test_asof_fallback(spark):
    prices = prices_of(spark, range(1, 6), step=10)
    probes = prices.withColumn("back", F.col("ts") - F.expr("interval 15 hour"))
    got = lambda **k: {x.obs_id: x.o_obs_id for x in asof_join(probes, prices, ["series_id"], "back", "ts", "obs_id", ["obs_id"], upto="ts", prefix="o_", **k).collect()}
    assert got() == {0: None, 1: None, 2: 0, 3: 1, 4: 2}
    assert got(lookback=2, fallback=True) == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def test_asof_brute_force(spark):
    """Ties, null times and keys, repeated rows, pieces of time that are empty, and one key that holds nearly all rows."""
    r = random.Random(15)
    when = lambda: at(r.choice([r.randint(0, 40) / 4, r.randint(0, 4000) / 4]))
    left = [(r.choice("aaaab"), i, when()) for i in range(300)] + [("a", 998, None), (None, 997, at(1)), ("c", 999, at(1))]
    left += left[:5]
    right = [(r.choice("aaaab"), i, when()) for i in range(150)] + [("a", 900, None), (None, 901, at(0))]
    L, R = spark.createDataFrame(left, "k string, id long, ts timestamp_ntz"), spark.createDataFrame(right, "k string, rid long, rts timestamp_ntz")
    for lookback, fallback in ((None, False), (7, False), (7, True)):
        back = F.col("ts") - F.expr("interval 30 hour") if lookback else F.col("ts")
        got = sorted((x.id, -1 if x.rid is None else x.rid) for x in asof_join(L, R, ["k"], back, "rts", "rid", ["rid"], lookback=lookback, fallback=fallback, upto="ts").collect())
        want = []
        for k, i, t in left:
            old = sorted(((s, -j) for q, j, s in right if t is not None and k is not None and q == k and s is not None and s <= t), reverse=True)
            near = old[:lookback] if lookback else old
            hit = [x for x in near if not lookback or x[0] <= t - dt.timedelta(hours=30)]
            pick = hit[0] if hit else near[-1] if fallback and near else None
            want.append((i, -pick[1] if pick else -1))
        assert got == sorted(want), (lookback, fallback)


def test_one_long_series(spark):
    """20,000 rows of one series, skewed in time: joins, ranks and the backtest are cut into many tasks and give what a plain pass gives."""
    n = 20_000
    rows = spark.range(n).select(F.lit(1).alias("series_id"), F.col("id").alias("obs_id"), (F.lit(T0) + F.expr("make_dt_interval(0, 0, cast(if(id < 15000, id, 15000 + (id - 15000) * 30) as int))")).alias("ts"), ((F.col("id") * 7919) % 1009 + 1).cast("double").alias("price"))
    times = [(i if i < 15_000 else 15_000 + (i - 15_000) * 30) for i in range(n)]
    hit = {x.obs_id: x.near_obs_id for x in nearest_join(rows, rows, ["series_id"], F.col("ts") + F.expr("interval 2 hour"), "ts", HOUR // 2, "obs_id", ["obs_id"], how="left", prefix="near_").collect()}
    old = {x.obs_id: x.old_obs_id for x in asof_join(rows, rows, ["series_id"], F.col("ts") - F.expr("interval 3 hour"), "ts", "obs_id", ["obs_id"], prefix="old_").collect()}
    assert len(hit) == len(old) == n
    for i in range(0, n, 97):
        k = bisect.bisect_left(times, times[i] + 120)
        near = min(((abs(times[j] - times[i] - 120), times[j], j) for j in (k - 1, k) if j < n), default=None)
        assert hit[i] == (near[2] if near and near[0] <= 30 else None), i
        k = bisect.bisect_right(times, times[i] - 180)
        assert old[i] == (k - 1 if k else None), i
    preds = backtest.walk_forward(rows, ["price"], 5, F.lit(19_000))
    price = [(i * 7919) % 1009 + 1.0 for i in range(n)]
    got = {x.obs_id: x.p_up for x in preds.collect()}
    assert len(got) == n - 19_001
    for i in range(19_000, n - 1, 211):
        near = sorted(range(i), key=lambda j: (abs(price[j] - price[i]), j))[:5]
        assert got[i] == pytest.approx(sum(price[j + 1] > price[j] for j in near) / 5), i


def test_anti_join_is_strict(spark):
    a, b = prices_of(spark, [1, 1], step=6), prices_of(spark, [1])
    assert [x.obs_id for x in tolerance_anti_join(a, b, ["series_id"], "ts", 6 * HOUR, "obs_id").collect()] == [1]


def test_enrich_fills_with_mean_of_matches(spark):
    prices = prices_of(spark, [1, 1, 1], step=24)
    context = spark.createDataFrame([(T0, 10.0), (at(24), 20.0)], "ts timestamp_ntz, score double")
    rows = enrich(prices, context, ["score"], 4 * HOUR, {"score": 50.0}).orderBy("obs_id").collect()
    assert [(r.score, r.context_imputed) for r in rows] == [(10.0, 0), (20.0, 0), (15.0, 1)]
    assert {r.score for r in enrich(prices, context.limit(0), ["score"], 4 * HOUR, {"score": 50.0}).collect()} == {50.0}


# ---- kernels and backtests


@pytest.mark.parametrize("block", [7, 1024])
def test_prior_top_k_brute_force(spark, block):
    r = random.Random(9)
    rows = [(s, i, float(r.randint(0, 6)), float(r.randint(0, 6)), r.choice([1.0, 2.0])) for s in (1, 2) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "s int, rn long, x double, y double, w double")
    got = {(g.s, g.rn, g.cand_rn): g.dist for g in kernels.prior_top_k(df, ["s"], "rn", ["x", "y"], 4, ["w", "w"], block=block).collect()}
    want = {}
    for s, i, x, y, w in rows:
        near = sorted((round(math.hypot((x - a) / w, (y - b) / w), 9), j) for q, j, a, b, _ in rows if q == s and j < i)[:4]
        want |= {(s, i, j): d for d, j in near}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_blocked_backtest_equals_unblocked(spark):
    r = random.Random(2)
    rows = W.momentum_score(prices_of(spark, [r.randint(5, 30) for _ in range(120)]))
    one, two = ({(x.obs_id): (x.p_up, x.realized_up) for x in backtest.walk_forward(rows, ["technical_score"], 10, backtest.single_warmup(), block=b).collect()} for b in (16, 1024))
    assert one == two and min(one) == 18 and max(one) == 118


# ---- calibration


def curve_rows(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "k int, decile int, predicted_p_up_mid double, empirical_up_rate double, n_samples long")


def test_curve_fallbacks(spark):
    p = spark.createDataFrame([(1, 0.7), (1, 1.2), (1, None)], "k int, p_up double")
    got = lambda rows: [r.p_up_calibrated for r in calibration.apply_calibration(p, curve_rows(spark, rows), ["k"]).orderBy(F.desc("p_up")).collect()]
    assert got([]) == [1.2, 0.7, None] and got([(6, 0.7, 0.9, 3)]) == [1.2, 0.7, None] and got([(6, 0.7, 0.55, 25)]) == [1.2, 0.55, None]


@pytest.mark.parametrize(("n", "runs"), [(90, []), (91, [10] * 9), (100, [10] * 10), (101, [11] * 9)])
def test_curve_drops_short_runs(spark, n, runs):
    df = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") / n).alias("p_up"), (F.col("id") % 2).cast("int").alias("realized_up"))
    assert [r.n_samples for r in calibration.calibration_curve(df, ["k"]).orderBy("decile").collect()] == runs


def test_calibration_error_gate(spark):
    df = lambda n: spark.range(n).select(F.lit(1).alias("k"), "id", F.lit(0.8).alias("p_up"), (F.col("id") % 5 != 0).cast("int").alias("realized_up"))
    assert calibration.calibration_error(df(5), ["k"]).first().calibration_error is None
    assert calibration.calibration_error(df(150), ["k"]).first().calibration_error < 0.1


def test_conditional_calibration_separates(spark):
    rows = [(1, i, at(i), 0.05 + i % 5 / 100, int(i % 5 == 0)) for i in range(40)] + [(1, 100 + i, at(100 + i), -0.85 - i % 5 / 100, int(i % 5 != 0)) for i in range(40)]
    history = spark.createDataFrame(rows, "k int, id long, ts timestamp_ntz, regime_mag double, realized_up int")
    ask = lambda v, h=history: analog.conditional_calibration(spark.createDataFrame([(1, at(999), v)], "k int, ts timestamp_ntz, regime_mag double"), h, ["k"], {"regime_mag": 1.5}).first().p_up_conditional
    assert ask(0.06) < 0.35 and ask(-0.87) > 0.65 and ask(None) is None and ask(0.06, history.limit(10)) is None


# ---- evaluation


def test_scores(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.5, 0), (1, 3, 0.2, 0)], "k int, id long, p_up double, realized_up int")
    row = evaluate.score(df, ["k"]).first()
    assert row.n == 3 and abs(row.brier - (0.01 + 0.25 + 0.04) / 3) < 1e-12 and abs(row.accuracy - 2 / 3) < 1e-12
    assert evaluate.score(df, ["k"], tie=">").first().accuracy == 1.0
    assert evaluate.summarize(df, ["k"]).first().status == "insufficient_data"


def test_confidence_buckets(spark):
    df = spark.createDataFrame([("c", 1, 0.2, i % 2) for i in range(4)], "coin string, horizon_hours int, p_up double, realized_up int")
    rows = {r.range: r for r in evaluate.confidence_buckets(df).collect()}
    assert len(rows) == 7 and rows["0.80+"].n == 4 and rows["0.80+"].overconfident_flag and rows["0.50-0.55"].accuracy is None


def test_history_carries_or_not(spark):
    df = spark.createDataFrame([("c", 1, i, at(i * 20), p, 1) for i, p in enumerate([None, 0.5, None])], "coin string, horizon_hours int, id long, resolved_ts timestamp_ntz, p double, realized_up int")
    got = lambda c: [r.brier_so_far for r in evaluate.expanding_history(df, {"v": "p"}, carry=c).orderBy("id").collect()]
    assert got(True) == [None, 0.25, 0.25] and got(False) == [None, 0.25, None]


def test_drift_has_every_window(spark):
    df = spark.createDataFrame([("c", 1, at(0), 0.7, 1)], "coin string, id long, resolved_ts timestamp_ntz, p_up double, realized_up int")
    rows = evaluate.drift(df, F.lit(at(10)), ["coin"]).collect()
    assert {r.window for r in rows} == set(evaluate.WINDOWS) and all(r.status == "insufficient_data" for r in rows) and [r.drift_flag for r in rows if r.window == "full_history"] == [False]


def test_running_totals_equal_window(spark):
    from hindsail.operators.prefix import running

    rows = spark.range(50).select(F.lit(1).alias("k"), "id", (F.col("id") % 7).alias("v"))
    got = running(rows, ["k"], ["id"], F.floor(F.col("id") / 9), {"total": F.col("v")})
    assert [r.total for r in got.orderBy("id").collect()] == list(itertools.accumulate(i % 7 for i in range(50)))


def test_resolve_bias(spark):
    prices = prices_of(spark, [100, 103], step=24)
    said = spark.createDataFrame([(i, 1, T0, 100.0, b) for i, b in enumerate(["bullish", "bearish", "neutral"])], "id long, series_id long, ts timestamp_ntz, price double, bias string")
    assert [r.bias_correct for r in evaluate.resolve_bias(said, prices, F.lit(at(48)), HOUR).orderBy("id").collect()] == [1, 0, 0]


# ---- selection


def test_lca_same_direction(spark):
    calls = spark.createDataFrame([("c", 1, "v", True)], "coin string, horizon_hours int, variant string, call_up boolean")
    near = spark.createDataFrame([("c", 1, at(i * 10)) for i in range(4)], "coin string, horizon_hours int, ts timestamp_ntz")
    rows = lambda ups: spark.createDataFrame([("c", 1, "v", i, at(i * 10 + 1), 0.7 if i < 3 else 0.2, u) for i, u in enumerate(ups)], "coin string, horizon_hours int, variant string, id long, ts timestamp_ntz, p double, realized_up int")
    assert [(r.lca, r.n_matched) for r in selection.lca(rows([1, 1, 1, 0]), near, calls).collect()] == [(1.0, 3)]
    assert [(r.lca, r.n_matched) for r in selection.lca(rows([0, 0, 0, 0]), near, calls).collect()] == [(0.0, 3)]
    assert selection.lca(rows([1, 1]), near, calls).count() == 0


def test_gate(spark):
    scores = lambda *s: spark.createDataFrame([("k", f"v{i}", float(a), b) for i, (a, b) in enumerate(s)], "k string, variant string, lca double, n_matched int")
    pick = lambda *s: selection.decide(scores(*s), ["k"]).first()
    assert pick((0.85, 20), (0.55, 20)).chosen == "v0" and pick((0.6, 5)).chosen == "original"
    assert pick((0.75, 10)).required_margin < pick(*[(0.75, 10)] * 6).required_margin


# ---- catalysts and audit


def test_priority_examples(spark):
    rows = [(0.4, True, 0.5, 1, False, 0, False), (4.0, True, 0.9, 1, False, 4, False), (12.0, True, 0.65, 3, True, 2, False)]
    df = spark.createDataFrame(rows, "price_move_pct double, was_wrong boolean, confidence double, correlated_failures int, is_anomaly boolean, recent_failures int, is_regime_change boolean")
    assert [(r.priority, r.is_high) for r in catalysts.priority(df).collect()] == [(0.2, False), (6.4, True), (13.4, True)]


def test_budget_pick(spark):
    ranked = spark.createDataFrame([("a", 9.0), ("b", 5.0), ("c", 1.0)], "coin string, priority double")
    got = lambda n: {r.coin: r.decision for r in catalysts.pick_within_budget(ranked, spark.range(1).select(F.lit(n).alias("budget"))).collect()}
    assert got(1) == {"a": "selected", "b": "deferred", "c": "deferred"} and got(5) == {"a": "selected", "b": "selected", "c": "deferred"}


def test_trigger_reasons(spark):
    df = spark.createDataFrame([(-4.26, True, 0.9, 3), (1.0, False, 0.9, 1)], "price_move_pct double, was_wrong boolean, confidence double, correlated_failures int")
    got = [r.reasons for r in catalysts.trigger_reasons(df).collect()]
    assert got == [["price_move_down_4.3pct", "high_confidence_failure_0.90", "correlated_failures_3_assets"], []]


def test_fuzzy_duplicates(spark):
    rows = lambda *t: spark.createDataFrame([(i, c, k, at(h)) for i, (c, k, h) in enumerate(t)], "id long, coin string, category string, ts timestamp_ntz")
    stored = rows(("A", "X", 0))
    new = rows(("A", "X", 6), ("A", "X", 6.1), ("A", "Y", 0), ("B", "X", 0), ("A", "X", 7))
    assert sorted(r.id for r in catalysts.drop_fuzzy_duplicates(new, stored).collect()) == [1, 2, 3, 4]
    assert sorted(r.id for r in catalysts.drop_fuzzy_duplicates(new, stored, within_batch=True).collect()) == [1, 2, 3]
    assert catalysts.drop_fuzzy_duplicates(new, stored.limit(0)).count() == 5


def test_responses(spark):
    good = '{"assets":["BTC"],"market_classification":"ASSET_SPECIFIC","catalysts":[{"category":"MACRO","sources":[{"url":"https://x.org/1"}]}]}'
    texts = [good, f"```json\n{good}\n```", "nope {", '{"catalysts":[]}', '{"assets":[],"catalysts":[{"sources":[]}]}', '{"assets":[],"catalysts":[{"sources":[{"url":"ftp://x"},{}]}]}', "[1]", None]
    rows = catalysts.normalize_responses(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()
    assert [(r.parse_status, r.valid, len(r.errors)) for r in rows] == [("ok", True, 0), ("ok", True, 0), ("malformed_response", False, 0), ("ok", False, 1), ("ok", False, 1), ("ok", False, 2), ("ok", False, 1), ("malformed_response", False, 0)]


def test_ingest_responses(spark):
    text = '{"assets":["BTC","ETH"],"catalysts":[{"category":"MACRO","event_timestamp":1704067200000,"sources":[{"url":"https://x.org/1"}]}]}'
    texts = spark.createDataFrame([(1, at(0), text), (2, at(0), "{"), (3, at(0), '{"assets":[],"catalysts":[]}')], "id long, request_ts timestamp_ntz, text string")
    stored = spark.createDataFrame([(9, "ETH", "MACRO", at(2))], "id long, coin string, category string, ts timestamp_ntz")
    rows, attempts = catalysts.ingest_responses(texts, stored)
    assert [(r.coin, r.ts) for r in rows.collect()] == [("BTC", at(0))]
    assert {(r.id, r.status, r.n_sources, r.catalysts_written) for r in attempts.collect()} == {(1, "ok", 1, 1), (2, "malformed_response", 0, 0), (3, "no_clear_catalyst", 0, 0)}


def test_narratives(spark):
    text = 'Intro. MACRO: calm ANALYSIS_JSON: {"bias_short":"Bullish","macro_risk":"HIGH","macro_score":3,"cross_asset_stress":-1}'
    row, bad = catalysts.parse_narratives(spark.createDataFrame([(text,), ("x ANALYSIS_JSON: {oops}",)], "text string"), ["MACRO"]).collect()
    assert (row.narrative, row.bias_short, row.macro_risk, row.macro_score, row.cross_asset_stress) == ("Intro.\n\nMACRO: calm", "bullish", "high", 1.0, 0.0)
    assert bad.bias_short is None


def test_grounding(spark):
    meta = '{"webSearchQueries":["q"],"groundingChunks":[{"web":{"uri":"https://a"}},{"web":{}}]}'
    rows = catalysts.grounding(spark.createDataFrame([(meta, "https://a"), (meta, "https://b"), (None, None)], "grounding_json string, source_url string")).collect()
    assert [(r.is_grounded, len(r.grounded_sources)) for r in rows] == [(True, 1), (False, 1), (False, 0)]


def test_driver_tilt(spark):
    flat = spark.createDataFrame([(1, T0, 0.6, 1, 2.0), (2, T0, 0.6, 0, 2.0), (3, at(40), 0.6, 1, 2.0)], "id long, ts timestamp_ntz, p_up_flat double, is_regime_anomaly int, trailing_return_pct double")
    news = lambda s: spark.createDataFrame([(at(-1), "ok", s)], "published_ts timestamp_ntz, transcript_status string, summary_json string")
    got = lambda s: {r.id: (round(r.p_up_tilted, 3), r.driver_used, r.driver_agreement) for r in analog.driver_tilt(flat, news(s)).collect()}
    assert got('{"dominant_driver":"macro","macro":{"lean":"bullish"}}') == {1: (0.7, "macro", "agree"), 2: (0.6, None, None), 3: (0.6, None, None)}
    assert got('{"dominant_driver":"macro","macro":{"lean":"bearish"}}')[1] == (0.55, "macro", "disagree")
    assert got('{"dominant_driver":"micro"}')[1] == (0.6, "micro", "uncovered")
    assert got("{broken")[1] == (0.6, None, "lookup_error")


def test_rollup_and_order(spark):
    df = spark.createDataFrame([(1, "PASS"), (1, "NOT_APPLICABLE"), (2, "PASS"), (2, "FAIL"), (3, "UNAVAILABLE"), (4, "NOT_APPLICABLE")], "k int, status string")
    assert {r.k: r.result for r in audit.rollup(df, ["k"]).collect()} == {1: "PASS", 2: "FAIL", 3: "UNVERIFIED", 4: "UNVERIFIED"}
    times = spark.createDataFrame([(T0, at(1)), (at(1), T0), (None, T0)], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0].status for r in times.select(audit.check_order(F.col("a"), F.col("b"))).collect()] == ["PASS", "FAIL", "UNAVAILABLE"]


def test_mask_secrets(spark):
    df = spark.sql("SELECT 'k' AS api_key, named_struct('Token', 't', 'deep', array(named_struct('password', 'p', 'x', 1))) AS s, map('secret', 'm', 'ok', 'n') AS m, 'a token inside' AS note")
    row = audit.mask_secrets(df).first().asDict(recursive=True)
    assert row == {"api_key": "[REDACTED]", "s": {"Token": "[REDACTED]", "deep": [{"password": "[REDACTED]", "x": 1}]}, "m": {"secret": "[REDACTED]", "ok": "n"}, "note": "a token inside"}


def test_audit_chain(spark):
    asked = spark.createDataFrame([(1, "c", 24, at(30), 0.7, True, 1), (2, "c", 24, at(90), 0.9, True, None)], "id long, coin string, horizon_hours int, request_ts timestamp_ntz, confidence double, was_wrong boolean, catalysts_written long")
    found = spark.createDataFrame([(1,)], "investigation long")
    led = spark.createDataFrame([(5, "c", 24, at(4), at(28), 0.7, 0)], "id long, coin string, horizon_hours int, ts timestamp_ntz, resolved_ts timestamp_ntz, p_up double, realized_up int")
    made = spark.createDataFrame([(8, "c", 24, at(30.5))], "id long, coin string, horizon_hours int, ts timestamp_ntz")
    rows = {r.id: (r.prediction_id, r.decision_id, r.result) for r in audit.audit_chain(asked, found, led, made).collect()}
    assert rows == {1: (5, 8, "PASS"), 2: (None, 8, "UNVERIFIED")}


def test_versions(spark):
    df = spark.createDataFrame([(T0, "a"), (at(1), "b"), (at(2), "unknown"), (at(3), None)], "ts timestamp_ntz, git_commit_sha string")
    assert [r[0] for r in audit.versions_since(df, F.lit(at(1))).collect()] == ["b"]


# ---- sources


def test_landed_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"series_id":"a","candles":[{"t":1704067200000,"c":"1.5"},{"t":1704067200000,"c":"NaN"},{"t":1,"c":"x"}]}')
    (tmp_path / "p.json").write_text('{"series_id":"a","timestamp":[1704067200,1704153600],"close":[2.5,null]}')
    (tmp_path / "q.json").write_text('{"universe":[{"name":"A"},{"name":"B"}],"ctxs":[{"markPx":"3","funding":"0.5"},{"markPx":"oops","funding":"1"}]}')
    assert [tuple(r) for r in ingest.read_candles(spark, str(tmp_path / "c.json")).collect()] == [("a", T0, 1.5)]
    assert [tuple(r) for r in ingest.read_parallel_arrays(spark, str(tmp_path / "p.json")).collect()] == [("a", T0, 2.5)]
    assert [tuple(r) for r in ingest.read_quotes(spark, str(tmp_path / "q.json"), ["A", "B"], 0.1).collect()] == [("A", 3.0, 0.4)]


def test_append_and_chart(spark, tmp_path):
    rows = prices_of(spark, [1, 2])
    ingest.append(rows, str(tmp_path / "t"))
    ingest.append(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    led = spark.createDataFrame([("c", 24, T0, 0.5), ("c", 12, T0, 0.5)], "coin string, horizon_hours int, ts timestamp_ntz, p_up double")
    assert sorted(r.kind for r in ingest.chart_extract(rows, led, 24).collect()) == ["forecast", "price", "price"]


def test_refresh_and_latest(spark):
    led = spark.range(200).select((F.col("id") % 2).alias("k"), "id", (F.col("id") / 200).alias("p_up"), F.when((F.col("id") % 2 == 0) | (F.col("id") < 30), (F.col("id") % 3 == 0).cast("int")).alias("realized_up"))
    curve, status = calibration.refresh_curves(led, ["k"], at(1))
    assert {r.k: r.status for r in status.collect()} == {0: "ok", 1: "insufficient_data"} and {r.k for r in curve.collect()} == {0}
    both = curve.unionByName(curve.withColumn("computed_ts", F.lit(at(2))))
    assert {r.computed_ts for r in calibration.latest_batch(both, ["k"]).collect()} == {at(2)}


def test_challenger_evaluation(spark):
    rows = spark.createDataFrame([("c", 1, 0.6, 0.4, i % 2, 1 if i < 8 else None, "agree" if i else None) for i in range(10)], "coin string, horizon_hours int, p_up_flat double, p_up_tilted double, realized_up int, ma_up int, driver_agreement string")
    row = evaluate.evaluate_challenger(rows).first()
    assert (row.n_resolved, row.accuracy_flat, row.n_ma if hasattr(row, "n_ma") else 8, row.drivers_agree, row.drivers_no_driver_applied) == (10, 0.5, 8, 9, 1)


def test_summaries_do_not_depend_on_order(spark):
    """Sums that sit on a half at the fourth place, in several partitionings and orders."""
    from hindsail.operators.evaluate import summarize

    # 20 rows of 0.09625 off on average: half of them hit, p in steps that binary fractions miss
    rows = [(k, "a", round(0.1 + 0.00025 * k, 5), 0) for k in range(400)] + [(400 + k, "b", 0.09625, 0) for k in range(100)]
    seen = set()
    for parts in (2, 8, 200):
        for order in ("id", "p_up", "-id"):
            df = spark.createDataFrame(rows, "id long, coin string, p_up double, realized_up int").orderBy(F.expr(order)).repartition(parts)
            seen.add(tuple(sorted(tuple(r) for r in summarize(df, ["coin"]).collect())))
    assert len(seen) == 1
    b = dict((r[0], r) for r in next(iter(seen)))["b"]
    assert b[6] == 0.0963 and b[8] == 0.0963 and b[4] == 0.0093  # half up: 0.09625, its square is 0.0092640625
