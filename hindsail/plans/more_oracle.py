"""DuckDB SQL for the further queries."""

from __future__ import annotations

from .oracle import APART, CHANGED, CONTEXT, FEATURES, HOUR, K, LONG, ORACLE, PAST, S, SCORE, TOL, add, curve, forward, r

S_TICK = f"""
ticked AS (SELECT series_id, obs_id, ts, {SCORE} AS technical_score FROM (
  SELECT *, least(row_number() OVER ({S}) - 1, 30) AS held, sum(greatest(c, 0)) OVER ({S} {PAST}) AS g, sum(greatest(-c, 0)) OVER ({S} {PAST}) AS l FROM ({CHANGED})))"""

add("candle_files", f"SELECT CAST(series_id AS VARCHAR) AS series_id, date_trunc('millisecond', ts) AS ts, {r('price')} AS price FROM v_series WHERE obs_id % 11 <> 0", "v_series")
add("array_files", f"SELECT CAST(series_id AS VARCHAR) AS series_id, date_trunc('second', ts) AS ts, {r('price')} AS price FROM v_series WHERE obs_id % 7 <> 0", "v_series")
add("quote_files", "SELECT coin AS name, CAST(id AS DOUBLE) AS price, id % 4 / 4.0E0 - 0.25 AS funding_adj FROM v_catalyst WHERE coin IN ('BTC', 'ETH') AND id % 9 <> 0", "v_catalyst")
add("ledger_append", "SELECT id, coin, ts, p_up, realized_up FROM v_ledger", "v_ledger")
add("outcomes_on_read", f"""
SELECT s.obs_id AS id, {r("rp")} AS realized_price, {r("(rp - s.price) / s.price * 100")} AS realized_return, CASE WHEN rp IS NOT NULL THEN CASE WHEN rp > s.price THEN 1 ELSE 0 END END AS realized_up FROM v_series s LEFT JOIN hits h USING (obs_id)
""", "v_series", ctes=f"""
hits AS (SELECT l.obs_id, r.price AS rp FROM v_series l JOIN v_series r ON l.series_id = r.series_id AND abs(epoch_us(r.ts) - epoch_us(l.ts) - 24 * {HOUR}) <= {TOL} WHERE l.ts <= (SELECT max(ts) FROM v_series) - INTERVAL 24 HOUR
  QUALIFY row_number() OVER (PARTITION BY l.obs_id ORDER BY abs(epoch_us(r.ts) - epoch_us(l.ts) - 24 * {HOUR}), r.ts, r.obs_id) = 1)""")  # fmt: skip
add("json_errors", f"""SELECT id, CASE WHEN errors = '' THEN '[]' ELSE '["' || errors || '"]' END AS errors FROM ({ORACLE["response_parse"]})""")

text = ORACLE["analog_forecast"]
for old, new in (
    ("features AS (SELECT series_id", "plain AS (SELECT series_id"),
    (",\ncomplete AS (", f""",
{CONTEXT.strip()},
features AS (SELECT p.series_id, p.obs_id, p.ts, p.price, p.technical_score, CASE WHEN p.series_id % 2 = 0 THEN p.regime_mag ELSE coalesce(h.score, ms, 50) END AS regime_mag, CASE WHEN h.score IS NULL THEN 1 ELSE 0 END AS imputed
  FROM plain p JOIN hits h USING (obs_id) CROSS JOIN means),
complete AS ("""),
    ("c.rn, c.technical_score / s1 AS z1", "c.rn, c.imputed, c.technical_score / s1 AS z1"),
    ("count(*) AS n_neighbors FROM near", "count(*) AS n_neighbors, sum(imputed) AS n_imputed FROM near"),
    ("SELECT series_id, horizon_hours, status, CASE", "SELECT series_id, horizon_hours, status, CASE WHEN status <> 'insufficient_data' THEN CAST(coalesce(n_imputed, 0) AS BIGINT) END AS n_imputed, CASE"),
):
    assert old in text, old
    text = text.replace(old, new, 1)
context_head, rest = ORACLE["context_enrich"].split("v_context AS (", 1)[1], text.removeprefix("WITH ")
depth, end = 1, 0
while depth:  # the view's text, up to its closing bracket
    depth += {"(": 1, ")": -1}.get(context_head[end], 0)
    end += 1
ORACLE["analog_context"] = f"WITH v_context AS ({context_head[:end]},\n{rest}"

FLAT = "greatest(0.05, least(0.95, CASE WHEN (f < 0.5 AND trend > 0.5) OR (f > 0.5 AND trend < -0.5) THEN 0.5 + (f - 0.5) * 0.5 ELSE f END))"


def exactly(text: str, *exprs: str) -> str:
    """A query's text with these expressions not rounded, for queries that go on with them."""
    for expr in exprs:
        end = " END AS p_up," if expr == "p" else ""
        assert r(expr) + end in text, expr
        text = text.replace(r(expr) + end, expr + end)
    return text


PAST_ROWS = f"""
wide AS (SELECT f.*, horizon_hours FROM features f CROSS JOIN (SELECT unnest([12, 24]) AS horizon_hours)),
past AS (SELECT series_id, horizon_hours, obs_id AS id, ts, technical_score / 100 AS p_up, CASE WHEN return_pct > 0 THEN 1 WHEN return_pct <= 0 THEN 0 END AS realized_up, technical_score, regime_mag
  FROM ({forward("wide", "l.*", "l.horizon_hours", extra=", l.horizon_hours")}))"""
BY = "series_id, horizon_hours"
add("prediction_columns", f"""
SELECT q.series_id, q.horizon_hours, {r("greatest(0.05, least(0.95, CASE WHEN (f < 0.5 AND trend_strength > 0.5) OR (f > 0.5 AND trend_strength < -0.5) THEN 0.5 + (f - 0.5) * 0.5 ELSE f END))", 4)} AS p_up_flat,
  {r("coalesce((SELECT arg_min(rate, ROW(abs(mid - q.p_up), decile)) FROM curve c WHERE c.series_id = q.series_id AND c.horizon_hours = q.horizon_hours), q.p_up)", 4)} AS calibrated_p_up, {r("near.p", 4)} AS p_up_conditional
FROM (SELECT *, greatest(0.05E0, least(0.95E0, CASE WHEN is_regime_anomaly = 1 THEN 0.5 + (p_up - 0.5) * 0.5 ELSE p_up END)) AS f FROM asked) q LEFT JOIN near USING (series_id, horizon_hours)
""", "v_series", ctes=FEATURES + "," + PAST_ROWS + "," + curve("past", BY).replace("10.0E0", "5.0E0") + f""",
asked AS (SELECT a.series_id, a.horizon_hours, a.p_up, a.is_regime_anomaly, a.trend_strength, f.ts, f.technical_score, f.regime_mag FROM ({exactly(ORACLE["prediction_record"], "p", f"greatest(-1, least(1, {APART} * 20))")}) a JOIN features f ON f.obs_id = a.obs_id),
pool AS (SELECT h.*, q.technical_score AS q1, q.regime_mag AS q2 FROM asked q JOIN past h USING (series_id, horizon_hours) WHERE h.ts < q.ts QUALIFY row_number() OVER (PARTITION BY series_id, horizon_hours ORDER BY h.ts DESC, h.id DESC) <= 300),
spread AS (SELECT {BY}, count(technical_score) >= 5 AS u1, count(regime_mag) >= 5 AS u2, CASE WHEN stddev_pop(technical_score) = 0 THEN 1 ELSE stddev_pop(technical_score) END AS s1, CASE WHEN stddev_pop(regime_mag) = 0 THEN 1 ELSE stddev_pop(regime_mag) END AS s2 FROM pool GROUP BY ALL),
placed AS (SELECT p.*, row_number() OVER (PARTITION BY series_id, horizon_hours ORDER BY ROUND(sqrt(CASE WHEN u1 THEN ((q1 - technical_score) / s1) * ((q1 - technical_score) / s1) ELSE 0 END + CASE WHEN u2 AND regime_mag IS NOT NULL THEN 1.5E0 * ((q2 - regime_mag) / s2) * ((q2 - regime_mag) / s2) ELSE 0 END), 9), ts DESC, id DESC) AS rnk
  FROM pool p JOIN spread USING (series_id, horizon_hours) WHERE u1 OR u2),
near AS (SELECT {BY}, avg(realized_up) AS p FROM placed WHERE rnk <= 30 GROUP BY ALL HAVING count(*) >= 20)""")  # fmt: skip

add("challenger_calibrated", f"""
SELECT series_id, obs_id, {r("coalesce((SELECT arg_min(rate, ROW(abs(mid - f.p_up), decile)) FROM curve c WHERE c.series_id = f.series_id), f.p_up)")} AS calibrated_p_up_flat FROM flat f
""", "v_series", ctes=f"""
flat AS (SELECT s.*, c.p_up_flat AS p_up FROM ({exactly(ORACLE["challenger_forecast"], FLAT)}) c JOIN v_series s USING (series_id, obs_id)),
past AS (SELECT series_id, obs_id AS id, p_up, CASE WHEN return_pct > 0 THEN 1 WHEN return_pct <= 0 THEN 0 END AS realized_up FROM ({forward("flat", "l.*")})),""" + curve("past", "series_id").replace("10.0E0", "5.0E0"))  # fmt: skip

add("driver_tilts", f"""
SELECT series_id, obs_id, {r("greatest(0.05, least(0.95, CASE agreement WHEN 'agree' THEN p_up_flat + CASE WHEN p_up_flat >= 0.5 THEN 0.1 ELSE -0.1 END WHEN 'disagree' THEN 0.5 + (p_up_flat - 0.5) * 0.5 ELSE p_up_flat END))")} AS p_up_tilted,
  CASE WHEN live THEN ['macro', 'tradfi', 'micro', NULL][kind + 1] END AS driver_used, agreement AS driver_agreement
FROM (SELECT *, CASE WHEN live THEN CASE kind WHEN 0 THEN CASE WHEN trailing_return_pct > 0 THEN 'agree' WHEN trailing_return_pct < 0 THEN 'disagree' ELSE 'na' END
    WHEN 1 THEN CASE WHEN trailing_return_pct < 0 THEN 'agree' WHEN trailing_return_pct > 0 THEN 'disagree' ELSE 'na' END WHEN 2 THEN 'uncovered' ELSE 'lookup_error' END END AS agreement
  FROM (SELECT *, coalesce(obs_id % 10 = 0 AND trailing_return_pct IS NOT NULL AND told <= 30 * {HOUR} AND day % 5 <> 0, false) AS live, day % 4 AS kind FROM (
    SELECT f.*, n.day, epoch_us(s.ts) - epoch_us(n.ts) AS told FROM ({ORACLE["challenger_forecast"]}) f JOIN v_series s USING (series_id, obs_id)
    ASOF LEFT JOIN (SELECT ts, day(ts) AS day FROM v_context) n ON s.ts >= n.ts)))
""", "v_series", "v_context")  # fmt: skip

add("preferred_scores", f"""
SELECT {K}, count(*) AS n, {r("avg(CASE WHEN (p >= 0.5) = (realized_up = 1) THEN 1.0E0 ELSE 0.0E0 END)")} AS accuracy, {r("avg((p - realized_up) * (p - realized_up))")} AS brier,
  {r("avg(-(realized_up * ln(greatest(1e-9, least(1 - 1e-9, p))) + (1 - realized_up) * ln(1 - greatest(1e-9, least(1 - 1e-9, p)))))")} AS log_loss, {r("avg(realized_up)")} AS up_rate, {r("avg(p)")} AS avg_p
FROM (SELECT *, coalesce(p_up_experimental, p_up) AS p FROM v_ledger WHERE realized_up IS NOT NULL AND coin = 'BTC' AND horizon_hours = 24 AND resolved_ts >= TIMESTAMP '1995-01-01') GROUP BY ALL
""", "v_ledger")  # fmt: skip
W = "OVER (PARTITION BY coin, horizon_hours, variant ORDER BY resolved_ts, id ROWS UNBOUNDED PRECEDING)"
add("history_gaps", f"""
SELECT {K}, id, variant, n AS n_so_far, CASE WHEN n > 0 AND p IS NOT NULL THEN ROUND(b / n, 4) END AS brier_so_far, CASE WHEN n > 0 AND p IS NOT NULL THEN ROUND(a / n, 3) END AS accuracy_so_far FROM (
  SELECT *, count(p) {W} AS n, sum((p - realized_up) * (p - realized_up)) {W} AS b, sum(CASE WHEN p IS NULL THEN 0.0E0 WHEN (p > 0.5) = (realized_up = 1) THEN 1.0E0 ELSE 0.0E0 END) {W} AS a FROM long WHERE realized_up IS NOT NULL)
""", "v_ledger", ctes=LONG.rstrip().removesuffix("))") + " UNION ALL SELECT *, 'late' AS variant, CASE WHEN resolved_ts >= TIMESTAMP '1996-06-01' THEN p_up_experimental END AS p FROM v_ledger))")  # fmt: skip
add("report_compact", f"""
SELECT * FROM ({ORACLE["daily_report"]}) WHERE section IN ('series', 'horizon', 'comparison', 'mistake', 'catalyst', 'health', 'status') OR (section = 'drift' AND metric = 'drift' AND value IS NOT NULL)
""")  # fmt: skip
ORACLE["challenger_selection"] = ORACLE["variant_choice"].replace(
    "UNION ALL SELECT *, 'experimental' AS variant, p_up_experimental AS p FROM v_ledger",
    """UNION ALL SELECT *, 'experimental' AS variant, p_up_experimental AS p FROM v_ledger
  UNION ALL SELECT *, 'challenger_flat' AS variant, 0.5 - (p_up - 0.5) * 0.5 AS p FROM v_ledger WHERE coin <> 'ETH'
  UNION ALL SELECT *, 'challenger_tilted' AS variant, CASE WHEN id % 3 <> 1 THEN 0.5 + (p_up - 0.5) * 0.9E0 END AS p FROM v_ledger WHERE coin <> 'ETH'""",
)

GREEDY = """
times AS (
  SELECT coin, category, min(ts) AS t FROM v_catalyst GROUP BY ALL
  UNION ALL
  SELECT k.coin, k.category, min(v.ts) FROM times k JOIN v_catalyst v ON v.coin = k.coin AND v.category = k.category AND v.ts > k.t + INTERVAL 6 HOUR GROUP BY k.coin, k.category),
kept AS (SELECT min(v.id) AS id, v.coin, v.category, v.ts FROM times k JOIN v_catalyst v ON v.coin = k.coin AND v.category = k.category AND v.ts = k.t GROUP BY ALL)"""
recursive = lambda name: ORACLE.update({name: ORACLE[name].replace("WITH ", "WITH RECURSIVE ", 1)})
add("catalyst_batch_dedupe", "SELECT id, coin, category FROM kept", "v_catalyst", ctes=GREEDY)
recursive("catalyst_batch_dedupe")
add("catalysts_known", """
SELECT s.obs_id, c.id AS catalyst_id, c.first_public_ts <= c.ts AS in_time FROM (SELECT obs_id, ts, ['BTC', 'ETH', 'LINK'][series_id % 3 + 1] AS coin FROM v_series) s
LEFT JOIN v_catalyst c ON c.coin = s.coin AND c.first_public_ts <= s.ts QUALIFY row_number() OVER (PARTITION BY s.obs_id ORDER BY c.first_public_ts DESC, c.id) = 1
""", "v_series", "v_catalyst")  # fmt: skip
add("response_catalysts", "SELECT id AS investigation, 'BTC' AS coin, 'MACRO' AS category, 'https://example.org/' || id AS source_url, CAST(1 AS INTEGER) AS n_sources FROM v_response WHERE id % 17 <> 0 AND id % 7 <> 0 AND id % 3 <> 0", "v_response")
add("response_attempts", """
SELECT id, CASE WHEN id % 17 = 0 THEN 'malformed_response' WHEN id % 7 = 0 THEN 'invalid_structure' WHEN id % 3 = 0 THEN 'no_clear_catalyst' ELSE 'ok' END AS status,
  CASE WHEN id % 17 = 0 OR id % 3 = 0 THEN 0 ELSE 1 END AS n_sources, CASE WHEN id % 17 <> 0 AND id % 7 <> 0 AND id % 3 <> 0 THEN 1 ELSE 0 END AS catalysts_written, CASE WHEN id % 17 <> 0 AND id % 7 = 0 THEN 1 ELSE 0 END AS n_errors FROM v_response
""", "v_response")  # fmt: skip
add("grounded_sources", "SELECT id, CASE WHEN id % 7 <> 0 THEN 1 ELSE 0 END AS n_queries, CASE WHEN id % 7 <> 0 THEN 1 ELSE 0 END AS n_sources, id % 7 <> 0 AND id % 2 = 0 AS is_grounded FROM v_catalyst", "v_catalyst")
add("trigger_rule", """
SELECT id, m OR c OR n AS trigger, concat_ws(';', CASE WHEN m THEN CASE WHEN move >= 0 THEN 'price_move_up_' ELSE 'price_move_down_' END || CAST(ROUND(CAST(abs(move) AS DECIMAL(12, 4)), 1) AS VARCHAR) || 'pct' END,
  CASE WHEN c THEN 'high_confidence_failure_' || CAST(ROUND(CAST(conf AS DECIMAL(12, 4)), 2) AS VARCHAR) END, CASE WHEN n THEN 'correlated_failures_' || (id % 5) || '_assets' END) AS reasons,
  CASE WHEN id % 4 >= 2 THEN 'daily_limit_reached' WHEN id % 3 >= 2 THEN 'hourly_limit_reached' END AS limited
FROM (SELECT *, abs(move) >= 3 AS m, wrong AND conf >= 0.85 AS c, id % 5 >= 3 AS n FROM (
  SELECT id, trend_strength * 10 AS move, greatest(p_up, 1 - p_up) AS conf, (p_up >= 0.5) <> (realized_up = 1) AS wrong FROM v_ledger WHERE realized_up IS NOT NULL))
""", "v_ledger")  # fmt: skip
add("investigation_chain", f"""
SELECT id, catalysts, prediction, decision, CASE WHEN 'FAIL' IN (catalysts, prediction, decision) THEN 'FAIL' WHEN catalysts = 'PASS' AND prediction = 'PASS' AND decision = 'PASS' THEN 'PASS' ELSE 'UNVERIFIED' END AS result
FROM (SELECT a.id, CASE WHEN a.id % 5 = 0 THEN 'UNAVAILABLE' WHEN a.id % 3 = a.id % 4 + 1 THEN 'PASS' ELSE 'FAIL' END AS catalysts,
    CASE WHEN p.ts IS NULL THEN 'UNAVAILABLE' WHEN p.ts <= a.request_ts THEN 'PASS' ELSE 'FAIL' END AS prediction,
    CASE WHEN EXISTS (SELECT 1 FROM v_ledger d WHERE d.id % 10 = 0 AND d.coin = a.coin AND d.horizon_hours = a.horizon_hours AND d.ts <= a.request_ts + INTERVAL 1 HOUR) THEN 'PASS' ELSE 'UNAVAILABLE' END AS decision
  FROM (SELECT *, resolved_ts + INTERVAL 30 MINUTE AS request_ts FROM v_ledger WHERE realized_up IS NOT NULL) a JOIN ({ORACLE["chain_audit"]}) f ON f.id = a.id LEFT JOIN v_ledger p ON p.id = f.prediction_id)
""", "v_ledger")  # fmt: skip
add("duplicate_summary", f"SELECT CASE WHEN count(*) > 0 THEN 'YES' ELSE 'NO' END AS status, count(*) AS n_keys FROM ({ORACLE['duplicate_audit']})")
add("version_lineage", "SELECT DISTINCT 'c' || year(ts) AS git_commit_sha FROM v_ledger WHERE ts >= TIMESTAMP '1996-01-01' AND id % 9 > 1", "v_ledger")
add("masked_rows", "SELECT id, '[REDACTED]' AS api_key, '[REDACTED]' AS \"authorization\", coin, '[REDACTED]' AS password, category AS note FROM v_catalyst", "v_catalyst")
add("history_leakage", f"""
SELECT 'resolved_before_target' AS rule, count(*) FILTER (realized_up IS NOT NULL AND epoch_us(resolved_ts) < epoch_us(ts) + horizon_hours * {HOUR}) AS violations FROM v_ledger
UNION ALL SELECT 'resolved_before_prediction', count(*) FILTER (realized_up IS NOT NULL AND resolved_ts <= ts) FROM v_ledger
UNION ALL SELECT 'curve_of_later_outcomes', count(*) FILTER (id % 20 = 0) FROM v_ledger
UNION ALL SELECT 'curve_used_before_its_time', count(*) FILTER (l.ts < n - CASE WHEN id % 20 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END) FROM v_ledger l JOIN (SELECT {K}, max(resolved_ts) AS n FROM v_ledger WHERE realized_up IS NOT NULL GROUP BY ALL) USING (coin, horizon_hours)
UNION ALL SELECT 'statistics_past_query', count(*) FILTER (id % 30 = 0) FROM v_ledger
""", "v_ledger")  # fmt: skip

add("stream_tick_scores", "SELECT series_id, obs_id, technical_score FROM ticked WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) FROM v_series) - INTERVAL 1 HOUR", "v_series", ctes=S_TICK)
add("stream_resolution", f"""
SELECT obs_id AS prediction_id, series_id, {r("rp")} AS realized_price, {r("(rp - price) / price * 100")} AS realized_return, CASE WHEN rp > price THEN 1 ELSE 0 END AS realized_up FROM (
  SELECT l.obs_id, l.series_id, l.price, r.price AS rp FROM v_series l JOIN v_series r ON l.series_id = r.series_id AND abs(epoch_us(r.ts) - epoch_us(l.ts) - 24 * {HOUR}) <= {TOL}
  WHERE l.ts + INTERVAL 24 HOUR <= (SELECT max(ts) FROM v_series) - INTERVAL 12 HOUR QUALIFY row_number() OVER (PARTITION BY l.obs_id ORDER BY abs(epoch_us(r.ts) - epoch_us(l.ts) - 24 * {HOUR}), r.ts, r.obs_id) = 1)
""", "v_series")  # fmt: skip
add("stream_resolution_status", f"""
SELECT obs_id AS prediction_id, series_id, CASE WHEN EXISTS (SELECT 1 FROM v_series r WHERE l.series_id = r.series_id AND abs(epoch_us(r.ts) - epoch_us(l.ts) - 24 * {HOUR}) <= {TOL}) THEN 'resolved' ELSE 'no_price' END AS status
FROM v_series l WHERE l.ts + INTERVAL 24 HOUR <= (SELECT max(ts) FROM v_series) - INTERVAL 12 HOUR
""", "v_series")  # fmt: skip
add("stream_running_scores", f"""
SELECT {K}, variant, count(*) AS n, {r("avg((p - realized_up) * (p - realized_up))")} AS brier, {r("avg(CASE WHEN (p > 0.5) = (realized_up = 1) THEN 1.0E0 ELSE 0.0E0 END)")} AS accuracy FROM long WHERE p IS NOT NULL AND realized_up IS NOT NULL GROUP BY ALL
""", "v_ledger", ctes=LONG)  # fmt: skip
add("stream_new_catalysts", "SELECT id, coin, category FROM kept WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) FROM v_catalyst) - INTERVAL 1 HOUR", "v_catalyst", ctes=GREEDY)
recursive("stream_new_catalysts")
add("stream_budget_log", f"""
SELECT coin, {r("priority")} AS priority, CAST(place AS INTEGER) AS place, CASE WHEN priority >= 4 AND place <= 2 THEN 'selected' ELSE 'deferred' END AS decision FROM (
  SELECT *, row_number() OVER (ORDER BY priority DESC, coin) AS place FROM (SELECT CAST(asset_no AS VARCHAR) AS coin, count(*) / 10.0E0 + asset_no AS priority FROM v_investigation GROUP BY asset_no))
""", "v_investigation")  # fmt: skip
