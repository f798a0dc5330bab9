"""DuckDB SQL for the registered queries: plain definitions, brute force where the jobs are not."""

from __future__ import annotations

from ..fixtures import duckdb_text

ORACLE: dict[str, str] = {}


def add(name: str, body: str, *views: str, ctes: str = "") -> None:
    heads = [f"{v} AS ({duckdb_text(v)})" for v in views] + ([ctes.strip().rstrip(",")] if ctes.strip() else [])
    ORACLE[name] = ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body


def r(expr: str, digits: int = 6) -> str:
    return f"ROUND({expr}, {digits}) + 0.0"


def units(expr: str) -> str:
    """A number in whole units of 1e-12."""
    return f"CAST(round(({expr}) * 1e12) AS HUGEINT)"


def nanos(expr: str) -> str:
    """A distance of nine places in whole units of 1e-9."""
    return f"CAST(round(({expr}) * 1e9) AS BIGINT)"


def six_places(whole: str) -> str:
    """Units of 1e-9 to six places, half up by whole numbers."""
    return f"CAST(({whole} + 500) // 1000 AS DOUBLE) / 1e6"


def mean_of(total: str, n: str) -> str:
    """The mean of n values whose sum in units is total."""
    return f"CAST({total} AS DOUBLE) / {n} / 1e12"


def change(old: str, new: str) -> str:
    """The percent return from old to new; null where old is 0."""
    return f"CASE WHEN {old} <> 0 THEN ({new} - {old}) / {old} * 100 END"


S = "PARTITION BY series_id ORDER BY ts, obs_id"
#: Gains g and losses l are whole units: floor(100 - 100 / (1 + g / l) + 0.5) by whole numbers.
SCORE = "CASE WHEN held < 6 OR (g = 0 AND l = 0) THEN 50.0E0 ELSE CAST((201 * g + l) // (2 * (g + l)) AS DOUBLE) END"
#: Sums a of the last 8 rows' prices and b of the last 21, in whole units, of na and nb prices: how far the averages are apart, as a share of the long one.
APART = "CAST(nb * a - na * b AS DOUBLE) / CAST(na * b AS DOUBLE)"
SUMS = ", ".join(f"sum({units('price')}) OVER w{n} AS {n}, count(price) OVER w{n} AS n{n}".replace(f"w{n}", f"({S} ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)") for n, back in (("a", 7), ("b", 20)))
CHANGED = f"SELECT *, u - lag(u) OVER ({S}) AS c FROM (SELECT *, {units('price')} AS u FROM v_series)"
MOMENTUM = f"""
changed AS ({CHANGED}),
summed AS (
  SELECT *, least(row_number() OVER ({S}), 30) AS held,
    sum(greatest(c, 0)) OVER ({S} ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) AS g,
    sum(greatest(-c, 0)) OVER ({S} ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) AS l FROM changed),
momentum AS (
  SELECT series_id, obs_id, ts, price, {SCORE} AS technical_score FROM summed)"""
FEATURES = (
    MOMENTUM
    + f""",
averaged AS (
  SELECT *, row_number() OVER ({S}) AS n, {SUMS} FROM momentum),
features AS (SELECT series_id, obs_id, ts, price, technical_score, CASE WHEN n >= 21 AND b <> 0 THEN {APART} * 100 END AS regime_mag FROM averaged)"""
)

add("momentum_score", "SELECT series_id, obs_id, technical_score FROM momentum", "v_series", ctes=MOMENTUM)

add("trailing_volatility", f"""
SELECT series_id, obs_id, CASE WHEN n >= 4 THEN {r("CASE WHEN s = 0 THEN 1 ELSE s END")} END AS volatility FROM (
  SELECT series_id, obs_id, row_number() OVER ({S}) AS n, stddev_pop(ret) OVER ({S} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS s FROM (
    SELECT *, {change(f'lag(price) OVER ({S})', 'price')} AS ret FROM v_series))
""", "v_series")  # fmt: skip

MA = f"SELECT series_id, obs_id, row_number() OVER ({S}) AS n, {SUMS} FROM v_series"
add("trend_strength", f"SELECT series_id, obs_id, CASE WHEN n >= 22 AND b <> 0 THEN {r(f'greatest(-1, least(1, {APART} * 20))')} ELSE 0.0E0 END AS trend_strength FROM ({MA})", "v_series")
add("regime_magnitude", f"SELECT series_id, obs_id, CASE WHEN n >= 21 AND b <> 0 THEN {r(f'{APART} * 100')} END AS regime_mag FROM ({MA})", "v_series")


def nearest(probe: str, probe_cols: str, at: str, rows: str, key: str, tol: str, strict: bool = False, outer: bool = False, rows_id: str = "obs_id", rows_ts: str = "ts", take: str = "r.obs_id AS near_obs_id") -> str:
    """Brute force: all rows within tolerance, the nearest by distance, time and id."""
    gap = f"abs(epoch_us(r.{rows_ts}) - epoch_us({at}))"
    on = " AND ".join(f"l.{k} = r.{k}" for k in key.split()) or "true"
    return f"""
SELECT {probe_cols}, {take}, epoch_us(r.{rows_ts}) - epoch_us({at}) AS diff_us FROM {probe} l
{"LEFT" if outer else ""} JOIN {rows} r ON {on} AND {gap} {"<" if strict else "<="} {tol}
QUALIFY row_number() OVER (PARTITION BY {probe_cols} ORDER BY {gap}, r.{rows_ts}, r.{rows_id}) = 1"""


TOL, HOUR = "17280000000", "3600000000"
add("nearest_join", nearest("v_series", "l.series_id, l.obs_id", "l.ts + INTERVAL 12 HOUR", "v_series", "series_id", TOL, outer=True), "v_series")

add("backward_asof", """
SELECT l.series_id, l.obs_id, coalesce(
  (SELECT arg_max(r.obs_id, r.ts) FROM newest r WHERE r.series_id = l.series_id AND r.probe = l.obs_id AND r.ts <= l.ts - INTERVAL 24 HOUR),
  (SELECT arg_min(r.obs_id, r.ts) FROM newest r WHERE r.series_id = l.series_id AND r.probe = l.obs_id)) AS old_obs_id
FROM v_series l
""", "v_series", ctes="""
newest AS (SELECT l.obs_id AS probe, r.* FROM v_series l JOIN v_series r ON l.series_id = r.series_id AND r.ts <= l.ts
  QUALIFY row_number() OVER (PARTITION BY l.obs_id ORDER BY r.ts DESC, r.obs_id) <= 200)""")  # fmt: skip

add("tolerance_antijoin", f"""
SELECT series_id, obs_id FROM v_series l WHERE obs_id % 2 = 1 AND NOT EXISTS (
  SELECT 1 FROM v_series r WHERE r.obs_id % 2 = 0 AND r.series_id = l.series_id AND abs(epoch_us(r.ts) - epoch_us(l.ts)) < 6 * {HOUR})
""", "v_series")  # fmt: skip

mean9 = lambda c: f"CAST(sum(CAST(round({c} * 1e9) AS HUGEINT)) AS DOUBLE) / count({c}) / 1e9"
CONTEXT = f"""
hits AS (
  SELECT l.series_id, l.obs_id, r.score, r.regime_mag, r.bottom_score FROM v_series l
  LEFT JOIN v_context r ON abs(epoch_us(r.ts) - epoch_us(l.ts)) <= {TOL}
  QUALIFY row_number() OVER (PARTITION BY l.obs_id ORDER BY abs(epoch_us(r.ts) - epoch_us(l.ts)), r.ts) = 1),
means AS (SELECT {mean9("score")} AS ms, {mean9("regime_mag")} AS mr, {mean9("bottom_score")} AS mb FROM hits)"""
add("context_enrich", f"""
SELECT series_id, obs_id, {r("coalesce(score, ms, 50)", 4)} AS score, {r("coalesce(regime_mag, mr, 0)", 4)} AS regime_mag, {r("coalesce(bottom_score, mb, 25)", 4)} AS bottom_score,
  CAST(score IS NULL OR regime_mag IS NULL OR bottom_score IS NULL AS INTEGER) AS context_imputed FROM hits CROSS JOIN means
""", "v_series", "v_context", ctes=CONTEXT)  # fmt: skip


def forward(probe: str, cols: str, hours: str = "24", share: str = "0.2", extra: str = "") -> str:
    gap = f"abs(epoch_us(r.ts) - epoch_us(l.ts) - {hours} * {HOUR})"
    part = "l.series_id, l.obs_id" + extra
    return f"""
  SELECT {cols}, {change('l.price', 'r.price')} AS return_pct FROM {probe} l JOIN v_series r ON l.series_id = r.series_id AND {gap} <= {hours} * {HOUR} * {share}
  QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY {gap}, r.ts, r.obs_id) = 1"""


add("forward_returns", f"SELECT series_id, obs_id, {r('return_pct')} AS return_pct FROM ({forward('v_series', 'l.series_id, l.obs_id')})", "v_series")

CANDIDATES = (
    FEATURES
    + f""",
complete AS (SELECT *, row_number() OVER ({S}) AS rn, count(*) OVER (PARTITION BY series_id) AS n_complete FROM features WHERE regime_mag IS NOT NULL),
stats AS (SELECT series_id, CASE WHEN stddev_pop(technical_score) = 0 THEN 1 ELSE stddev_pop(technical_score) END AS s1, CASE WHEN stddev_pop(regime_mag) = 0 THEN 1 ELSE stddev_pop(regime_mag) END AS s2 FROM complete GROUP BY 1),
last_rows AS (SELECT * FROM complete WHERE rn = n_complete),
horizons AS (SELECT unnest([12, 24]) AS horizon_hours),
candidates AS (
  SELECT c.series_id, h.horizon_hours, c.obs_id, c.ts, c.price, c.rn, c.technical_score / s1 AS z1, c.regime_mag / s2 AS z2,
    ROUND(sqrt((c.technical_score / s1 - q.technical_score / s1) * (c.technical_score / s1 - q.technical_score / s1) + (c.regime_mag / s2 - q.regime_mag / s2) * (c.regime_mag / s2 - q.regime_mag / s2)), 9) AS dist
  FROM complete c JOIN last_rows q USING (series_id) JOIN stats USING (series_id) CROSS JOIN horizons h
  WHERE c.obs_id <> q.obs_id AND epoch_us(c.ts) <= epoch_us(q.ts) - CAST(h.horizon_hours * {HOUR} * 1.2 AS BIGINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, horizon_hours ORDER BY dist, ts, obs_id) AS rnk, count(*) OVER (PARTITION BY series_id, horizon_hours) AS n FROM candidates),
keys AS (SELECT series_id, horizon_hours, n_rows, n_complete FROM (SELECT series_id, count(*) AS n_rows, count(regime_mag) AS n_complete FROM features GROUP BY 1) CROSS JOIN horizons)"""
)
add("analog_forecast", f"""
SELECT series_id, horizon_hours, status, CASE WHEN status <> 'insufficient_data' THEN coalesce(n_neighbors, 0) END AS n_neighbors,
  CASE WHEN status <> 'insufficient_data' THEN coalesce(n_resolved, 0) END AS n_resolved,
  CASE WHEN status = 'ok' THEN {r("p")} END AS p_up,
  CASE WHEN status = 'ok' THEN {r("rets[least(n_resolved, CAST(floor(n_resolved * 0.5E0) AS BIGINT) + 1)]")} END AS median_return,
  CASE WHEN status = 'ok' THEN {r("rets[least(n_resolved, CAST(floor(n_resolved * 0.25E0) AS BIGINT) + 1)]")} END AS p25_return,
  CASE WHEN status = 'ok' THEN {r("rets[least(n_resolved, CAST(floor(n_resolved * 0.75E0) AS BIGINT) + 1)]")} END AS p75_return,
  CASE WHEN status = 'ok' THEN close END AS closest, CASE WHEN status = 'ok' THEN {six_places("close_dist")} END AS closest_dist
FROM (SELECT *, CASE WHEN n_rows < 30 OR n_complete < 30 THEN 'insufficient_data' WHEN coalesce(n_resolved, 0) < 5 THEN 'insufficient_resolved_analogs' ELSE 'ok' END AS status
  FROM keys LEFT JOIN (SELECT series_id, horizon_hours, count(*) AS n_neighbors FROM near GROUP BY ALL) USING (series_id, horizon_hours)
  LEFT JOIN (SELECT series_id, horizon_hours, count(*) AS n_resolved, avg(CASE WHEN return_pct > 0 THEN 1.0E0 ELSE 0.0E0 END) AS p, list_sort(list(return_pct)) AS rets,
    array_to_string(list(CAST(obs_id AS VARCHAR) || ':' || strftime(made_at, '%Y-%m-%d') ORDER BY rnk)[1:5], ',') AS close, list_sum(list({nanos('dist')} ORDER BY rnk)[1:5]) AS close_dist FROM resolved GROUP BY ALL) USING (series_id, horizon_hours))
""", "v_series", ctes=CANDIDATES + f""",
near AS (SELECT * FROM ranked WHERE rnk <= least(15, greatest(5, floor(n / 3.0E0)))),
resolved AS (SELECT * FROM ({forward("near", "l.series_id, l.horizon_hours, l.obs_id, l.rnk, l.dist, l.ts AS made_at", "l.horizon_hours", extra=", l.horizon_hours")}) WHERE return_pct IS NOT NULL)""")  # fmt: skip

H = "PARTITION BY series_id, horizon_hours ORDER BY ts, obs_id"
add("analog_weighted", f"""
SELECT series_id, horizon_hours, {r("vp")} AS volatility_percentile, k AS k_adaptive, CASE WHEN n_resolved >= 5 THEN {r("p")} END AS p_up_experimental, CASE WHEN n_resolved >= 5 THEN {r("q")} END AS median_return_experimental
FROM (SELECT series_id, horizon_hours FROM keys WHERE n_rows >= 30 AND n_complete >= 30) LEFT JOIN adaptive USING (series_id, horizon_hours) LEFT JOIN (
  SELECT series_id, horizon_hours, count(*) AS n_resolved, CAST(sum(CASE WHEN return_pct > 0 THEN w ELSE 0 END) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS p, min(CASE WHEN share >= 0.5 THEN return_pct END) AS q
  FROM (SELECT *, CAST(sum(w) OVER (PARTITION BY series_id, horizon_hours ORDER BY return_pct) AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY series_id, horizon_hours) AS DOUBLE) AS share FROM (SELECT *, {units('1 / (dist + 0.05E0)')} AS w FROM resolved)) GROUP BY ALL) USING (series_id, horizon_hours)
""", "v_series", ctes=CANDIDATES + f""",
vols AS (SELECT series_id, horizon_hours, CASE WHEN row_number() OVER ({H}) >= 4 THEN CASE WHEN stddev_pop(ret) OVER ({H} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 0 THEN 1 ELSE stddev_pop(ret) OVER ({H} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) END END AS v
  FROM (SELECT *, {change(f'lag(price) OVER ({H})', 'price')} AS ret FROM candidates)),
today AS (SELECT series_id, arg_max(v, rn) AS v FROM (SELECT series_id, rn, CASE WHEN s = 0 THEN 1 ELSE s END AS v FROM (SELECT series_id, rn, stddev_pop(ret) OVER ({S} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS s FROM (SELECT *, {change(f'lag(price) OVER ({S})', 'price')} AS ret FROM complete)) WHERE rn >= 4) GROUP BY 1),
ranks AS (SELECT k.series_id, k.horizon_hours, max(k.n) AS n, max(least(15, greatest(5, floor(k.n / 3.0E0)))) AS k0, (SELECT CASE WHEN count(v.v) >= 10 THEN count(CASE WHEN v.v <= t.v THEN 1 END) / count(v.v) END FROM vols v, today t WHERE v.series_id = k.series_id AND v.horizon_hours = k.horizon_hours AND t.series_id = k.series_id AND v.v IS NOT NULL) AS vp FROM ranked k GROUP BY ALL),
adaptive AS (SELECT series_id, horizon_hours, vp, CAST(CASE WHEN vp >= 0.66 THEN greatest(5, floor(k0 * 0.6E0)) WHEN vp <= 0.33 THEN least(n, floor(k0 * 1.4E0)) ELSE k0 END AS BIGINT) AS k FROM ranks),
picked AS (SELECT r.* FROM ranked r JOIN adaptive USING (series_id, horizon_hours) WHERE rnk <= k),
resolved AS (SELECT * FROM ({forward("picked", "l.series_id, l.horizon_hours, l.obs_id, l.dist", "l.horizon_hours", extra=", l.horizon_hours")}) WHERE return_pct IS NOT NULL)""")  # fmt: skip

add("regime_anomaly", f"""
SELECT v.series_id, v.horizon_hours, {six_places(nanos('v.d'))} AS closest_dist, {r("p")} AS closest_dist_percentile, CAST(coalesce(p >= 0.9, false) AS INTEGER) AS is_regime_anomaly
FROM (SELECT series_id, horizon_hours, min(dist) AS d FROM candidates GROUP BY ALL) v LEFT JOIN LATERAL (
  SELECT CASE WHEN count(*) >= 10 THEN count(CASE WHEN c.closest <= v.d THEN 1 END) / count(*) END AS p FROM closest c WHERE c.series_id = v.series_id AND c.horizon_hours = v.horizon_hours) ON true
""", "v_series", ctes=CANDIDATES + """,
closest AS (SELECT a.series_id, a.horizon_hours, a.rn, min(ROUND(sqrt((a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2)), 9)) AS closest
  FROM candidates a JOIN candidates b ON a.series_id = b.series_id AND a.horizon_hours = b.horizon_hours AND b.rn < a.rn GROUP BY ALL)""")  # fmt: skip

K = "coin, horizon_hours"
POOL = f"""
newest AS (SELECT * FROM v_ledger QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY ts DESC, id DESC) = 1),
pool AS (SELECT h.* FROM newest q JOIN v_ledger h USING (coin, horizon_hours) WHERE h.realized_up IS NOT NULL AND h.ts < q.ts
  QUALIFY row_number() OVER (PARTITION BY h.coin, h.horizon_hours ORDER BY h.ts DESC, h.id DESC) <= 300),
spread AS (SELECT {K}, count(*) AS n, CASE WHEN stddev_pop(technical_score) = 0 THEN 1 ELSE stddev_pop(technical_score) END AS s1, CASE WHEN stddev_pop(regime_mag) = 0 THEN 1 ELSE stddev_pop(regime_mag) END AS s2 FROM pool GROUP BY ALL)"""


def near_pool(w1: str, w2: str) -> str:
    d = lambda f, s: f"(q.{f} - p.{f}) / {s}"
    a, b = d("technical_score", "s1"), d("regime_mag", "s2")
    return f""",
distances AS (SELECT p.coin, p.horizon_hours, p.id, p.ts, p.realized_up, n, ROUND(sqrt({w1} * ({a}) * ({a}) + {w2} * ({b}) * ({b})), 9) AS dist FROM pool p JOIN newest q USING (coin, horizon_hours) JOIN spread USING (coin, horizon_hours)),
placed AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY dist, ts DESC, id DESC) AS rnk FROM distances)"""


add("conditional_calibration", f"""
SELECT {K}, CASE WHEN n >= 20 THEN {r("p")} END AS p_up_conditional, CASE WHEN n >= 20 THEN n END AS n_neighbors FROM newest LEFT JOIN (
  SELECT {K}, count(*) AS n, avg(realized_up) AS p FROM placed WHERE rnk <= 30 GROUP BY ALL) USING (coin, horizon_hours)
""", "v_ledger", ctes=POOL + near_pool("1.0E0", "1.5E0"))  # fmt: skip

add("conditional_calibration_each", f"""
SELECT id, CASE WHEN n >= 20 THEN {r("p")} END AS p_up_conditional, CASE WHEN n >= 20 THEN n END AS n_neighbors FROM v_ledger LEFT JOIN (
  SELECT qid AS id, count(*) AS n, avg(realized_up) AS p FROM placed_each WHERE rnk <= 30 GROUP BY ALL) USING (id)
""", "v_ledger", ctes=f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY ts, id) AS n FROM v_ledger WHERE realized_up IS NOT NULL),
asked AS (SELECT *, count(realized_up) OVER (PARTITION BY {K} ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS seen FROM v_ledger),
pools AS (SELECT q.id AS qid, q.technical_score AS q1, q.regime_mag AS q2, h.id, h.ts, h.technical_score AS h1, h.regime_mag AS h2, h.realized_up
  FROM asked q JOIN numbered h ON q.coin = h.coin AND q.horizon_hours = h.horizon_hours AND h.n > q.seen - 300 AND h.n <= q.seen),
spreads AS (SELECT qid, count(h1) AS c1, count(h2) AS c2, CASE WHEN stddev_pop(h1) = 0 THEN 1 ELSE stddev_pop(h1) END AS s1, CASE WHEN stddev_pop(h2) = 0 THEN 1 ELSE stddev_pop(h2) END AS s2 FROM pools GROUP BY 1),
apart AS (SELECT qid, id, ts, realized_up, c1 >= 5 AND q1 IS NOT NULL AS use1, c2 >= 5 AND q2 IS NOT NULL AS use2,
  CASE WHEN use1 AND h1 IS NOT NULL THEN (q1 - h1) / s1 ELSE 0 END AS g1, CASE WHEN use2 AND h2 IS NOT NULL THEN (q2 - h2) / s2 ELSE 0 END AS g2 FROM pools JOIN spreads USING (qid)),
placed_each AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ROUND(sqrt(g1 * g1 + 1.5E0 * g2 * g2), 9), ts DESC, id DESC) AS rnk FROM apart WHERE use1 OR use2)""")  # fmt: skip

CORE = """
core AS (SELECT *, (obs_id % 101) / 100.0E0 AS p_up, CASE WHEN obs_id % 10 = 0 THEN 1 ELSE 0 END AS anomaly, (obs_id % 41) / 20.0E0 - 1 AS trend FROM v_series)"""
add("challenger_forecast", f"""
SELECT series_id, obs_id, {r(change('old', 'price'))} AS trailing_return_pct,
  {r("greatest(0.05, least(0.95, CASE WHEN (f < 0.5 AND trend > 0.5) OR (f > 0.5 AND trend < -0.5) THEN 0.5 + (f - 0.5) * 0.5 ELSE f END))")} AS p_up_flat
FROM (SELECT c.*, (SELECT price FROM v_series x WHERE x.obs_id = o.old_obs_id) AS old, greatest(0.05E0, least(0.95E0, CASE WHEN anomaly = 1 THEN 0.5 + (p_up - 0.5) * 0.5 ELSE p_up END)) AS f FROM core c JOIN old_rows o USING (obs_id))
""", "v_series", ctes=CORE + """,
newest AS (SELECT l.obs_id AS probe, r.* FROM v_series l JOIN v_series r ON l.series_id = r.series_id AND r.ts <= l.ts
  QUALIFY row_number() OVER (PARTITION BY l.obs_id ORDER BY r.ts DESC, r.obs_id) <= 200),
old_rows AS (SELECT l.obs_id, coalesce(arg_max(r.obs_id, r.ts) FILTER (r.ts <= l.ts - INTERVAL 24 HOUR), arg_min(r.obs_id, r.ts)) AS old_obs_id FROM v_series l JOIN newest r ON r.probe = l.obs_id GROUP BY 1)""")  # fmt: skip


def half_up(total: str, n: str) -> str:
    """total (in units) / n to four places, by whole numbers."""
    return f"CAST((2 * ({total}) + {n} * CAST(100000000 AS HUGEINT)) // (2 * {n} * CAST(100000000 AS HUGEINT)) AS DOUBLE) / 10000"


def curve(source: str, key: str, name: str = "curve") -> str:
    return f"""
{name} AS (SELECT {key}, CAST(floor((rn - 1) / ceil(sz / 10.0E0)) AS INTEGER) AS decile, {mean_of('sum(' + units('p_up') + ')', 'count(*)')} AS mid, avg(realized_up) AS rate, count(*) AS n, sum({units("p_up")}) AS sp, sum({units("realized_up")}) AS sy FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY p_up, id) AS rn, count(*) OVER (PARTITION BY {key}) AS sz FROM {source} WHERE realized_up IS NOT NULL AND p_up IS NOT NULL)
  GROUP BY ALL HAVING count(*) >= 10)"""


add("calibration_curve", f"SELECT {K}, decile, {r('mid')} AS predicted_p_up_mid, {r('rate')} AS empirical_up_rate, n AS n_samples FROM curve", "v_ledger", ctes=curve("v_ledger", K))
add("calibration_apply", f"""
SELECT id, {r("coalesce(rate, p_up)")} AS p_up_calibrated FROM v_ledger l LEFT JOIN curve c ON l.coin = c.coin AND l.horizon_hours = c.horizon_hours AND p_up BETWEEN 0 AND 1
QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(mid - p_up), decile) = 1
""", "v_ledger", ctes=curve("v_ledger", K))  # fmt: skip
add("calibration_error", f"""
SELECT {K}, CASE WHEN s >= 20 THEN {r("e")} END AS calibration_error FROM (SELECT {K}, count(*) AS s FROM v_ledger WHERE realized_up IS NOT NULL GROUP BY ALL)
LEFT JOIN (SELECT {K}, CAST(sum(abs(sp - sy)) AS DOUBLE) / 1e12 / sum(n) AS e FROM curve GROUP BY ALL) USING (coin, horizon_hours)
""", "v_ledger", ctes=curve("v_ledger", K))  # fmt: skip

HIT = "CASE WHEN (p_up >= 0.5) = (realized_up = 1) THEN 1.0E0 ELSE 0.0E0 END"
BRIER = "(p_up - realized_up) * (p_up - realized_up)"
CLIP = "greatest(1e-9, least(1 - 1e-9, p_up))"
LOSS = f"-(realized_up * ln({CLIP}) + (1 - realized_up) * ln(1 - {CLIP}))"
add("calibration_summary", f"""
SELECT {K}, n AS n_resolved, {r("a")} AS accuracy, {r("b")} AS brier, {r("u")} AS up_rate, {r("u * (1 - u)")} AS brier_base_rate, {r("least(0.25, u * (1 - u))")} AS best_naive, b < least(0.25, u * (1 - u)) AS beats_naive
FROM (SELECT {K}, count(*) AS n, avg({HIT}) AS a, avg({BRIER}) AS b, avg(realized_up) AS u FROM v_ledger WHERE realized_up IS NOT NULL GROUP BY ALL)
""", "v_ledger")  # fmt: skip
add("variant_comparison", f"""
SELECT {K}, count(*) AS n_paired, CASE WHEN count(*) >= 20 THEN {r(f"avg({BRIER})")} END AS brier_a, CASE WHEN count(*) >= 20 THEN {r("avg((p_up_experimental - realized_up) * (p_up_experimental - realized_up))")} END AS brier_b,
  CASE WHEN count(*) >= 20 THEN avg((p_up_experimental - realized_up) * (p_up_experimental - realized_up)) < avg({BRIER}) END AS b_wins
FROM v_ledger WHERE realized_up IS NOT NULL AND p_up_experimental IS NOT NULL GROUP BY ALL
""", "v_ledger")  # fmt: skip

LONG = """
long AS (SELECT coin, horizon_hours, id, ts, resolved_ts, realized_up, variant, p FROM (
  SELECT *, 'original' AS variant, p_up AS p FROM v_ledger UNION ALL SELECT *, 'experimental' AS variant, p_up_experimental AS p FROM v_ledger))"""
W = "OVER (PARTITION BY coin, horizon_hours, variant ORDER BY resolved_ts, id ROWS UNBOUNDED PRECEDING)"
add("expanding_history", f"""
SELECT {K}, id, variant, n AS n_so_far, CASE WHEN n > 0 THEN ROUND(b / n, 4) END AS brier_so_far, CASE WHEN n > 0 THEN ROUND(a / n, 3) END AS accuracy_so_far FROM (
  SELECT *, count(p) {W} AS n, sum((p - realized_up) * (p - realized_up)) {W} AS b, sum(CASE WHEN p IS NULL THEN 0.0E0 WHEN (p > 0.5) = (realized_up = 1) THEN 1.0E0 ELSE 0.0E0 END) {W} AS a FROM long WHERE realized_up IS NOT NULL)
""", "v_ledger", ctes=LONG)  # fmt: skip

add("ma_baseline", f"""
SELECT series_id, obs_id, CAST(CASE WHEN held >= 10 AND price <> 0 THEN CASE WHEN {units('price')} * held > total_upto THEN 1 ELSE 0 END END AS INTEGER) AS ma_up FROM (
  SELECT *, first_value(total) OVER same AS total_upto, first_value(n) OVER same AS held FROM (
    SELECT *, sum({units('price')}) OVER w AS total, count(price) OVER w AS n FROM v_series WINDOW w AS (PARTITION BY series_id ORDER BY ts, obs_id DESC ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  WINDOW same AS (PARTITION BY series_id, ts ORDER BY obs_id))
""", "v_series")  # fmt: skip

add("confidence_buckets", f"""
SELECT k.coin, k.horizon_hours, b.range, count(l.id) AS n, ROUND(avg({HIT.replace("p_up", "l.p_up").replace("realized_up", "l.realized_up")}) FILTER (l.id IS NOT NULL), 3) AS accuracy,
  b.mid - avg({HIT.replace("p_up", "l.p_up").replace("realized_up", "l.realized_up")}) FILTER (l.id IS NOT NULL) > 0.05 AS overconfident_flag
FROM (SELECT DISTINCT {K} FROM v_ledger WHERE realized_up IS NOT NULL) k CROSS JOIN buckets b
LEFT JOIN v_ledger l ON l.coin = k.coin AND l.horizon_hours = k.horizon_hours AND l.realized_up IS NOT NULL AND greatest(l.p_up, 1 - l.p_up) >= b.lo AND greatest(l.p_up, 1 - l.p_up) < b.hi
GROUP BY k.coin, k.horizon_hours, b.range, b.mid
""", "v_ledger", ctes="""
buckets AS (SELECT * FROM (VALUES ('0.50-0.55', 0.50E0, 0.55E0, 0.525E0), ('0.55-0.60', 0.55E0, 0.60E0, 0.575E0), ('0.60-0.65', 0.60E0, 0.65E0, 0.625E0), ('0.65-0.70', 0.65E0, 0.70E0, 0.675E0),
  ('0.70-0.75', 0.70E0, 0.75E0, 0.725E0), ('0.75-0.80', 0.75E0, 0.80E0, 0.775E0), ('0.80+', 0.80E0, 1.001E0, 0.9E0)) t(range, lo, hi, mid))""")  # fmt: skip

add("confident_mistakes", f"""
SELECT {K}, CAST(row_number() OVER (PARTITION BY {K} ORDER BY c DESC, ts, id) AS INTEGER) AS place, id, ROUND(p_up, 3) AS p, c AS confidence, realized_up
FROM (SELECT *, ROUND(greatest(p_up, 1 - p_up), 3) AS c FROM v_ledger WHERE realized_up IS NOT NULL AND (p_up >= 0.5) <> (realized_up = 1)) QUALIFY place <= 5
""", "v_ledger")  # fmt: skip


def summary(source: str, key: str) -> str:
    """summarize() of a table by key, as two CTEs."""
    return (
        curve(source, key, "runs")
        + f""",
summary AS (SELECT {key}, CASE WHEN n >= 20 THEN 'ok' ELSE 'insufficient_data' END AS status, n, CASE WHEN n >= 20 THEN {half_up("a", "n")} END AS accuracy, CASE WHEN n >= 20 THEN {half_up("b", "n")} END AS brier_score,
  CASE WHEN n >= 20 THEN {half_up("l", "n")} END AS log_loss, CASE WHEN n >= 20 THEN {half_up("e", "en")} END AS calibration_error, CASE WHEN n >= 20 THEN {half_up("u", "n")} END AS realized_up_rate, CASE WHEN n >= 20 THEN {half_up("ap", "n")} END AS avg_predicted_p_up
  FROM (SELECT {key}, count(*) AS n, sum({units(HIT)}) AS a, sum({units(BRIER)}) AS b, sum({units(LOSS)}) AS l, sum({units("realized_up")}) AS u, sum({units("p_up")}) AS ap FROM {source} WHERE realized_up IS NOT NULL GROUP BY ALL)
  LEFT JOIN (SELECT {key}, sum(abs(sp - sy)) AS e, sum(n) AS en FROM runs GROUP BY ALL) USING ({key}))"""
    )


TAGGED = """
tagged AS (
  SELECT *, 'trend:' || CASE WHEN trend_strength > 0.15 THEN 'bullish' WHEN trend_strength < -0.15 THEN 'bearish' ELSE 'neutral' END AS regime FROM v_ledger UNION ALL
  SELECT *, 'volatility:' || CASE WHEN volatility_percentile >= 0.85 THEN 'high_volatility' WHEN volatility_percentile <= 0.15 THEN 'low_volatility' ELSE 'normal_volatility' END FROM v_ledger UNION ALL
  SELECT *, CASE WHEN is_regime_anomaly = 1 THEN 'anomaly:yes' ELSE 'anomaly:no' END FROM v_ledger),"""
add("regime_summary", "SELECT * FROM summary", "v_ledger", ctes=TAGGED + summary("tagged", "coin, regime"))

add("drift_windows", """
SELECT coin, k."window", coalesce(status, 'insufficient_data') AS status, coalesce(n, 0) AS n, accuracy, brier_score, log_loss, calibration_error, realized_up_rate, avg_predicted_p_up,
  CASE WHEN k."window" = 'full_history' THEN coalesce(abs((SELECT s2.accuracy FROM summary s2 WHERE s2.coin = k.coin AND s2."window" = 'last_7d') - accuracy) > 0.15, false) END AS drift_flag
FROM (SELECT DISTINCT coin, w."window" FROM v_ledger CROSS JOIN spans w WHERE realized_up IS NOT NULL) k LEFT JOIN summary USING (coin, "window")
""", "v_ledger", ctes="""
spans AS (SELECT * FROM (VALUES ('last_24h', 24), ('last_7d', 168), ('last_30d', 720), ('full_history', NULL)) t("window", hours)),
windowed AS (SELECT l.*, w."window" FROM v_ledger l CROSS JOIN spans w WHERE w.hours IS NULL OR epoch_us((SELECT max(resolved_ts) FROM v_ledger)) - epoch_us(l.resolved_ts) <= w.hours * 3600000000),"""
    + summary("windowed", 'coin, "window"'))

add("dataset_health", """
SELECT coin, count(*) AS total, count(*) FILTER (realized_up IS NULL) AS unresolved,
  count(*) FILTER (realized_up IS NOT NULL AND resolved_ts >= TIMESTAMP '1995-01-01' AND resolved_ts < TIMESTAMP '1996-01-01') AS resolved_in_period FROM v_ledger GROUP BY coin
""", "v_ledger")  # fmt: skip

RESOLVED = f"""
due AS (SELECT * FROM v_series WHERE ts <= (SELECT max(ts) FROM v_series) - INTERVAL 24 HOUR),
hits AS (
  SELECT l.obs_id, l.price, r.price AS rp FROM due l JOIN v_series r ON l.series_id = r.series_id AND abs(epoch_us(r.ts) - epoch_us(l.ts) - 24 * {HOUR}) <= {TOL}
  QUALIFY row_number() OVER (PARTITION BY l.obs_id ORDER BY abs(epoch_us(r.ts) - epoch_us(l.ts) - 24 * {HOUR}), r.ts, r.obs_id) = 1)"""
add("outcome_resolution", f"SELECT obs_id AS prediction_id, {r('rp')} AS realized_price, {r('(rp - price) / price * 100')} AS realized_return, CASE WHEN rp > price THEN 1 ELSE 0 END AS realized_up FROM hits", "v_series", ctes=RESOLVED)
add("bias_resolution", f"""
SELECT id, bias, {r("ret")} AS return_pct, CAST(CASE bias WHEN 'bullish' THEN ret > 0 WHEN 'bearish' THEN ret < 0 ELSE abs(ret) < 1 END AS INTEGER) AS bias_correct
FROM (SELECT obs_id AS id, CASE obs_id % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS bias, (rp - price) / price * 100 AS ret FROM hits)
""", "v_series", ctes=RESOLVED)  # fmt: skip

ELIGIBLE = f"""
known AS (SELECT * FROM long WHERE p IS NOT NULL AND realized_up IS NOT NULL),
eligible AS (SELECT {K}, variant, count(*) AS n FROM known GROUP BY ALL HAVING count(*) >= 50)"""
add("variant_eligibility", f"SELECT {K}, variant, n FROM eligible", "v_ledger", ctes=LONG + "," + ELIGIBLE)
LCA = (
    POOL
    + near_pool("1", "1")
    + f""",
around AS (SELECT * FROM placed WHERE n >= 15 AND rnk <= least(15, greatest(7, floor(n / 10.0E0)))),
calls AS (SELECT {K}, variant, arg_max(p, ROW(ts, id)) >= 0.5 AS call_up, arg_max(p, ROW(ts, id)) AS call_p FROM known GROUP BY ALL),
matched AS (
  SELECT a.coin, a.horizon_hours, c.variant, c.call_up, a.ts AS near_ts, a.id AS near_id, v.p, v.realized_up FROM around a JOIN calls c USING (coin, horizon_hours)
  JOIN known v ON v.coin = a.coin AND v.horizon_hours = a.horizon_hours AND v.variant = c.variant AND abs(epoch_us(v.ts) - epoch_us(a.ts)) <= 6 * {HOUR}
  QUALIFY row_number() OVER (PARTITION BY a.coin, a.horizon_hours, c.variant, a.id ORDER BY abs(epoch_us(v.ts) - epoch_us(a.ts)), v.ts, v.id) = 1),
scores AS (SELECT {K}, variant, avg(CASE WHEN (p >= 0.5) = (realized_up = 1) THEN 1.0E0 ELSE 0.0E0 END) AS lca, count(*) AS n_matched FROM matched WHERE (p >= 0.5) = call_up GROUP BY ALL HAVING count(*) >= 3)"""
)
add("variant_lca", f"SELECT {K}, variant, {r('lca')} AS lca, n_matched FROM scores", "v_ledger", ctes=LONG + "," + ELIGIBLE + "," + LCA)
RANKED = "list_position(['original', 'experimental', 'challenger_flat', 'challenger_tilted'], variant)"
add("variant_choice", f"""
SELECT {K}, CASE WHEN NOT EXISTS (SELECT 1 FROM eligible e WHERE e.coin = k.coin AND e.horizon_hours = k.horizon_hours) THEN 'no_eligible_variants' WHEN k_sel IS NULL THEN 'insufficient_meta_history' WHEN variant IS NULL THEN 'no_scorable_variants' ELSE 'ok' END AS status,
  CASE WHEN lca - 0.5 > margin THEN variant ELSE 'original' END AS chosen_variant, variant AS winner, {r("lca")} AS winner_lca, n_matched, {r("margin")} AS required_margin, coalesce(lca - 0.5 > margin, false) AS cleared_gate, k_sel,
  CAST(m AS INTEGER) AS comparison_count, {r("0.05 / m")} AS corrected_alpha, hours AS neighborhood, ROUND(hours_dist, 2) AS neighborhood_dist,
  (SELECT {r("call_p")} FROM calls JOIN eligible USING (coin, horizon_hours, variant) WHERE coin = k.coin AND horizon_hours = k.horizon_hours AND variant = CASE WHEN k_won.variant IS NULL THEN NULL WHEN lca - 0.5 > margin THEN k_won.variant ELSE 'original' END) AS chosen_p_up,
  CASE WHEN NOT EXISTS (SELECT 1 FROM eligible e WHERE e.coin = k.coin AND e.horizon_hours = k.horizon_hours) THEN 'no_eligible_variants' WHEN k_sel IS NULL THEN 'insufficient_meta_history' WHEN variant IS NULL THEN 'no_scorable_variants'
    WHEN lca - 0.5 > margin THEN variant || ' did better locally' ELSE 'no local edge cleared the significance bar' END AS reason
FROM (SELECT DISTINCT {K} FROM v_ledger) k LEFT JOIN (SELECT {K}, CAST(max(least(15, greatest(7, floor(n / 10.0E0)))) AS INTEGER) AS k_sel,
  string_agg(strftime(ts, '%Y-%m-%d %H'), ',' ORDER BY rnk) AS hours, sum(ROUND(dist, 3)) AS hours_dist FROM around GROUP BY ALL) USING (coin, horizon_hours)
LEFT JOIN (SELECT *, [1.6449, 1.96, 2.128, 2.2414, 2.3263, 2.394][least(6, m)] * sqrt(0.25 / n_matched) AS margin FROM (
  SELECT s.*, count(*) OVER (PARTITION BY {K}) AS m FROM scores s JOIN eligible USING (coin, horizon_hours, variant)) QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY lca DESC, {RANKED}) = 1) k_won USING (coin, horizon_hours)
""", "v_ledger", ctes=LONG + "," + ELIGIBLE + "," + LCA)  # fmt: skip


def walk(source: str, dist: str, k: int, warmup: str, extra: str = "") -> str:
    return f"""
numbered AS (SELECT *, row_number() OVER ({S}) AS rn, count(*) OVER (PARTITION BY series_id) AS sz, {change('price', f'lead(price) OVER ({S})')} AS ret{extra} FROM {source}),
pairs AS (SELECT q.series_id, q.obs_id, q.ts, q.rn, q.ret AS own, c.ret AS ret, row_number() OVER (PARTITION BY q.series_id, q.obs_id ORDER BY ROUND({dist}, 9), c.rn) AS place
  FROM numbered q JOIN numbered c ON q.series_id = c.series_id AND c.rn < q.rn WHERE q.rn >= {warmup} + 1 AND q.rn < q.sz),
preds AS (SELECT series_id, obs_id, ts, avg(CASE WHEN ret > 0 THEN 1.0E0 WHEN ret <= 0 THEN 0.0E0 END) AS p_up, CASE WHEN max(own) > 0 THEN 1 WHEN max(own) <= 0 THEN 0 END AS realized_up FROM pairs WHERE place <= {k} GROUP BY ALL HAVING count(*) >= {k})"""


def graded(key: str, source: str) -> str:
    return f"""
SELECT {key}, n AS n_predictions, ROUND(a, 9) AS accuracy, ROUND(b, 9) AS brier_score, ROUND(u, 9) AS historical_up_rate, ROUND(least(0.25, u * (1 - u)), 9) AS naive_baseline_brier, b < least(0.25, u * (1 - u)) AS beats_naive_baseline, date_range_start, date_range_end
FROM (SELECT {key}, min(ts) AS date_range_start, max(ts) AS date_range_end, count(*) AS n, avg({HIT}) AS a, {mean_of('sum(' + units(BRIER) + ')', 'count(*)')} AS b, avg(realized_up) AS u FROM {source} WHERE p_up IS NOT NULL AND realized_up IS NOT NULL GROUP BY ALL)"""


ONE = "abs(q.technical_score - c.technical_score)"
WARM = "greatest(10, floor(q.sz * 0.15E0))"
add("backtest_momentum", f"SELECT series_id, obs_id, {r('p_up')} AS p_up, realized_up FROM preds", "v_series", ctes=MOMENTUM + "," + walk("momentum", ONE, 15, "60"))
add("backtest_single", graded("series_id", "preds"), "v_series", ctes=MOMENTUM + "," + walk("momentum", ONE, 10, WARM))
PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
add("backtest_combined", f"SELECT series_id, obs_id, {r('p_up')} AS p_up, realized_up FROM preds", "v_series", ctes=FEATURES + """,
complete AS (SELECT * FROM features WHERE regime_mag IS NOT NULL),""" + walk("complete", "sqrt(((q.technical_score - c.technical_score) / q.s1) ** 2 + ((q.regime_mag - c.regime_mag) / q.s2) ** 2)", 15, "greatest(15, floor(q.sz * 0.2E0))", f""",
  CASE WHEN stddev_pop(technical_score) OVER ({S} {PRIOR}) = 0 THEN 1 ELSE stddev_pop(technical_score) OVER ({S} {PRIOR}) END AS s1,
  CASE WHEN stddev_pop(regime_mag) OVER ({S} {PRIOR}) = 0 THEN 1 ELSE stddev_pop(regime_mag) OVER ({S} {PRIOR}) END AS s2"""))  # fmt: skip
add("backtest_regime_split", graded("series_id, side", "sided"), "v_series", "v_context", ctes=CONTEXT + "," + MOMENTUM + "," + walk("momentum", ONE, 10, WARM) + """,
felt AS (SELECT p.*, coalesce(h.score, ms, 50) AS score FROM preds p JOIN hits h USING (obs_id) CROSS JOIN means),
middle AS (SELECT series_id, list_sort(list(score))[CAST(floor(count(*) / 2.0E0) AS BIGINT) + 1] AS m FROM felt GROUP BY 1),
sided AS (SELECT f.*, CASE WHEN score >= m THEN 'high' ELSE 'low' END AS side FROM felt f JOIN middle USING (series_id))""")  # fmt: skip

add("catalyst_validate", f"""
SELECT id, e = '' AS valid, e AS errors FROM (SELECT id, concat_ws('; ', CASE WHEN category = 'NOT_A_CATEGORY' THEN 'invalid category: ' || category END,
  CASE WHEN NOT regexp_matches(source_url, '^https?://\\S+$') THEN 'source_url is not a well-formed http(s) URL' END,
  CASE WHEN epoch_us(first_public_ts) < epoch_us(ts) - {HOUR} THEN 'first_public_timestamp is implausibly before event_timestamp' END,
  CASE WHEN epoch_us(discovery_ts) < epoch_us(first_public_ts) - {HOUR} THEN 'discovery_timestamp is implausibly before first_public_timestamp' END) AS e FROM v_catalyst)
""", "v_catalyst")  # fmt: skip
add("catalyst_dedupe", f"""
SELECT id, coin, category FROM v_catalyst n WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM v_catalyst s WHERE s.id % 2 = 1 AND s.coin = n.coin AND s.category = n.category AND abs(epoch_us(s.ts) - epoch_us(n.ts)) <= 2 * {HOUR})
""", "v_catalyst")  # fmt: skip
add("catalyst_availability", "SELECT coin, category, CASE WHEN first_public_ts IS NULL THEN 'unknown' WHEN first_public_ts <= ts THEN 'true' ELSE 'false' END AS available, count(*) AS n FROM v_catalyst GROUP BY ALL", "v_catalyst")
add("response_parse", """
SELECT id, CASE WHEN bad THEN 'malformed_response' ELSE 'ok' END AS parse_status, NOT bad AND label <> 'NOPE' AS valid, CASE WHEN NOT bad AND label = 'NOPE' THEN 'invalid market_classification: NOPE' ELSE '' END AS errors
FROM (SELECT id, NOT json_valid(t) AS bad, CASE WHEN json_valid(t) THEN json_extract_string(t, '$.market_classification') END AS label FROM (SELECT id, trim(replace(replace(text, '```json', ''), '```', ''), ' ' || chr(10)) AS t FROM v_response))
""", "v_response")  # fmt: skip

add("investigation_rank", f"""
SELECT coin, {r("coalesce((new - old) / old * 100, 0)")} AS price_move_pct, w AS was_wrong, {r("c")} AS confidence, failed AS correlated_failures, anomaly AS is_anomaly, fails AS recent_failures, false AS is_regime_change,
  ROUND(score, 3) + 0.0 AS priority, ROUND(score, 3) >= 4 AS is_high
FROM (SELECT *, 0.5 * abs(coalesce((new - old) / old * 100, 0)) + 3 * CASE WHEN w THEN greatest(0, (c - 0.5) * 2) ELSE 0 END + 2 * greatest(0, failed - 1) + 1.5 * CASE WHEN anomaly THEN 1 ELSE 0 END + 0.5 * fails AS score
  FROM (SELECT coin, arg_min(wrong, n) AS w, arg_min(conf, n) AS c, arg_min(is_regime_anomaly, n) = 1 AS anomaly, count(*) FILTER (wrong) AS fails FROM recent GROUP BY 1)
  CROSS JOIN (SELECT count(DISTINCT coin) AS failed FROM recent WHERE wrong) LEFT JOIN moves USING (coin))
""", "v_ledger", "v_catalyst", ctes="""
now_ts AS (SELECT max(resolved_ts) AS t FROM v_ledger WHERE realized_up IS NOT NULL),
recent AS (SELECT coin, is_regime_anomaly, greatest(p_up, 1 - p_up) AS conf, (p_up >= 0.5) <> (realized_up = 1) AS wrong, row_number() OVER (PARTITION BY coin ORDER BY resolved_ts DESC, id DESC) AS n
  FROM v_ledger, now_ts WHERE realized_up IS NOT NULL AND resolved_ts >= t - INTERVAL 720 HOUR AND resolved_ts <= t QUALIFY n <= 5),
moves AS (SELECT coin, arg_min(CAST(id % 997 + 1 AS DOUBLE), ROW(ts, id)) FILTER (ts >= t - INTERVAL 720 HOUR) AS old, arg_max(CAST(id % 997 + 1 AS DOUBLE), ROW(ts, id)) AS new FROM v_catalyst, now_ts WHERE ts <= t GROUP BY 1)""")  # fmt: skip

add("budget_audit", """
SELECT id, h AS in_hour, d AS in_day, CASE WHEN h <= 2 THEN 'PASS' ELSE 'FAIL' END AS hourly, CASE WHEN d <= 40 THEN 'PASS' ELSE 'FAIL' END AS daily, CASE WHEN h > 2 OR d > 40 THEN 'YES' ELSE 'NO' END AS violation
FROM (SELECT id, count(*) OVER (PARTITION BY asset_no ORDER BY request_ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS h, count(*) OVER (PARTITION BY asset_no ORDER BY request_ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS d FROM v_investigation)
""", "v_investigation")  # fmt: skip
add("duplicate_audit", "SELECT investigation_id, count(*) AS n FROM v_investigation GROUP BY 1 HAVING count(*) > 1", "v_investigation")
add("status_rollup", """
SELECT coin, category, day, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (status = 'PASS') = count(*) THEN 'PASS' ELSE 'UNVERIFIED' END AS result
FROM (SELECT coin, category, CAST(ts AS DATE) AS day, CASE WHEN first_public_ts IS NULL THEN 'UNAVAILABLE' WHEN first_public_ts <= ts THEN 'PASS' ELSE 'FAIL' END AS status FROM v_catalyst) GROUP BY ALL
""", "v_catalyst")  # fmt: skip
add("immutability_audit", "SELECT id, CASE WHEN id % 1500 = 7 THEN 'missing' ELSE 'changed' END AS change FROM v_ledger WHERE id % 1500 = 7 OR id % 1001 = 0", "v_ledger")
add("leakage_audit", f"""
SELECT 'resolved_before_target' AS rule, count(*) FILTER (realized_up IS NOT NULL AND epoch_us(resolved_ts) < epoch_us(ts) + horizon_hours * {HOUR}) AS violations FROM v_ledger
UNION ALL SELECT 'resolved_before_prediction', count(*) FILTER (realized_up IS NOT NULL AND resolved_ts <= ts) FROM v_ledger
UNION ALL SELECT 'neighbour_outcome_after_query', count(*) FILTER (epoch_us(c.ts) + CAST(c.horizon_hours * {HOUR} * 1.2 AS BIGINT) > epoch_us(q.ts)) FROM candidates c JOIN last_rows q USING (series_id)
""", "v_series", "v_ledger", ctes=CANDIDATES)  # fmt: skip

METRICS = ("n", "accuracy", "brier_score", "log_loss", "calibration_error")
by_metric = lambda section, key, table, names: " UNION ALL ".join(f"SELECT '{section}' AS section, coin, CAST({key} AS VARCHAR) AS key, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {table}" for m in names)
renamed = lambda text, to: text.replace("runs", f"runs_{to}").replace("summary AS", f"summary_{to} AS")
MISTAKES = "row_number() OVER (PARTITION BY coin ORDER BY c DESC, ts, id)"
BUCKETS = ORACLE["confidence_buckets"].split("buckets AS (", 1)[1].rsplit("mid))", 1)[0]
CONF = HIT.replace("p_up", "l.p_up").replace("realized_up", "l.realized_up")
add("daily_report", f"""
{by_metric("series", "'all'", "summary", METRICS)} UNION ALL {by_metric("horizon", "horizon_hours", "summary_h", METRICS)}
UNION ALL {by_metric("health", "'all'", "health", ("total", "unresolved", "resolved_in_period"))}
UNION ALL {by_metric("confidence", "range", "conf", ("n", "accuracy"))} UNION ALL {by_metric("confidence", "'insufficient_data'", "short", ("n",))}
UNION ALL {by_metric("confident_mistake", "place", "(SELECT * FROM wrong WHERE place <= 5 AND coin IN (SELECT coin FROM summary WHERE status = 'ok'))", ("id", "p", "confidence"))}
UNION ALL {by_metric("regime", "regime", "summary_g", ("n", "accuracy", "brier_score"))}
UNION ALL {by_metric("mistake", "place", "wrong", ("id", "p", "confidence"))}
UNION ALL {by_metric("drift", '"window"', "moved", ("n", "accuracy", "drift"))}
UNION ALL {by_metric("comparison", "'production'", "(SELECT * FROM summary WHERE coin <> 'ETH')", METRICS)} UNION ALL {by_metric("comparison", "'challenger'", "summary_c", METRICS)}
UNION ALL SELECT 'catalyst', coin, CAST(id AS VARCHAR), 'id', CAST(id AS DOUBLE) FROM (SELECT * FROM v_catalyst ORDER BY ts DESC, id DESC LIMIT 100)
UNION ALL SELECT 'status', NULL, CASE WHEN (SELECT count(*) FROM summary WHERE status = 'ok') = 0 OR (SELECT bool_or(drift = 1) FROM moved) THEN 'YELLOW' ELSE 'GREEN' END, 'status', 1.0E0
""", "v_ledger", "v_catalyst", ctes=summary("v_ledger", "coin") + "," + renamed(summary("v_ledger", "coin, horizon_hours"), "h") + "," + TAGGED + renamed(summary("tagged", "coin, regime"), "g") + """,
other AS (SELECT * REPLACE (coalesce(p_up_experimental, p_up) AS p_up) FROM v_ledger WHERE coin <> 'ETH'),""" + renamed(summary("other", "coin"), "c") + """,
spans AS (SELECT * FROM (VALUES ('last_24h', 24), ('last_7d', 168), ('last_30d', 720), ('full_history', NULL)) t("window", hours)),
windowed AS (SELECT l.*, w."window" FROM v_ledger l CROSS JOIN spans w WHERE w.hours IS NULL OR epoch_us((SELECT max(resolved_ts) FROM v_ledger)) - epoch_us(l.resolved_ts) <= w.hours * 3600000000),""" + renamed(summary("windowed", 'coin, "window"'), "w") + f""",
moved AS (SELECT coin, k."window", coalesce(n, 0) AS n, accuracy, CASE WHEN k."window" = 'full_history' THEN CAST(coalesce(abs((SELECT s2.accuracy FROM summary_w s2 WHERE s2.coin = k.coin AND s2."window" = 'last_7d') - accuracy) > 0.15, false) AS INTEGER) END AS drift
  FROM (SELECT DISTINCT coin, w."window" FROM v_ledger CROSS JOIN spans w WHERE realized_up IS NOT NULL) k LEFT JOIN summary_w USING (coin, "window")),
wrong AS (SELECT coin, id, ROUND(p_up, 3) AS p, c AS confidence, {MISTAKES} AS place FROM (SELECT *, ROUND(greatest(p_up, 1 - p_up), 3) AS c FROM v_ledger WHERE realized_up IS NOT NULL AND (p_up >= 0.5) <> (realized_up = 1)) QUALIFY place <= 10),
buckets AS ({BUCKETS}mid)),
conf AS (SELECT k.coin, b.range, count(l.id) AS n, ROUND(avg({CONF}) FILTER (l.id IS NOT NULL), 3) AS accuracy FROM (SELECT coin FROM summary WHERE status = 'ok') k CROSS JOIN buckets b
  LEFT JOIN v_ledger l ON l.coin = k.coin AND l.realized_up IS NOT NULL AND greatest(l.p_up, 1 - l.p_up) >= b.lo AND greatest(l.p_up, 1 - l.p_up) < b.hi GROUP BY k.coin, b.range),
short AS (SELECT coin, n FROM summary WHERE status <> 'ok'),
health AS (SELECT coin, count(*) AS total, count(*) FILTER (realized_up IS NULL) AS unresolved, count(*) FILTER (realized_up IS NOT NULL AND resolved_ts < (SELECT max(resolved_ts) FROM v_ledger)) AS resolved_in_period FROM v_ledger GROUP BY 1)""")  # fmt: skip

add("series_coverage", "SELECT series_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM v_series GROUP BY 1", "v_series")
add("newest_rows", "SELECT series_id, obs_id FROM v_series QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, obs_id DESC) <= 5", "v_series")

PAST = "ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING"
add("tick_scores", f"""
SELECT series_id, obs_id, {SCORE} AS technical_score FROM (
  SELECT *, least(row_number() OVER ({S}) - 1, 30) AS held, sum(greatest(c, 0)) OVER ({S} {PAST}) AS g, sum(greatest(-c, 0)) OVER ({S} {PAST}) AS l FROM ({CHANGED})) WHERE obs_id % 10 = 9
""", "v_series")  # fmt: skip
add("series_backfill", """
SELECT series_id, obs_id, technical_score FROM momentum m WHERE NOT EXISTS (SELECT 1 FROM v_series r WHERE r.obs_id % 2 = 0 AND r.series_id = m.series_id AND abs(epoch_us(r.ts) - epoch_us(m.ts)) < 30 * 60000000)
""", "v_series", ctes=MOMENTUM.replace("FROM v_series", "FROM v_series WHERE obs_id % 2 = 1"))  # fmt: skip
add("chain_audit", f"""
SELECT a.id, arg_min(l.id, l.n) AS prediction_id FROM asked a LEFT JOIN LATERAL (
  SELECT * FROM (SELECT l.*, row_number() OVER (ORDER BY resolved_ts DESC, id DESC) AS n FROM v_ledger l WHERE l.coin = a.coin AND realized_up IS NOT NULL AND resolved_ts <= a.request_ts AND epoch_us(resolved_ts) >= epoch_us(a.request_ts) - CAST(3.5 * {HOUR} AS BIGINT))
  WHERE n <= 10 AND abs(greatest(p_up, 1 - p_up) - a.confidence) < 1e-9 AND ((p_up >= 0.5) <> (realized_up = 1)) = a.was_wrong) l ON true GROUP BY a.id
""", "v_ledger", ctes="""
asked AS (SELECT id, coin, resolved_ts + INTERVAL 30 MINUTE AS request_ts, greatest(p_up, 1 - p_up) AS confidence, (p_up >= 0.5) <> (realized_up = 1) AS was_wrong FROM v_ledger WHERE realized_up IS NOT NULL)""")  # fmt: skip

add("prediction_record", f"""
SELECT a.series_id, a.horizon_hours, q.obs_id, {r("q.price")} AS price, a.p_up, a.median_return, b.p_up_experimental, b.volatility_percentile, c.is_regime_anomaly, q.trend_strength, {r("q.regime_mag")} AS regime_mag, 'v1' AS model_version
FROM ({ORACLE["analog_forecast"]}) a JOIN ({ORACLE["analog_weighted"]}) b USING (series_id, horizon_hours) JOIN ({ORACLE["regime_anomaly"]}) c USING (series_id, horizon_hours)
JOIN (SELECT *, CASE WHEN n >= 22 AND b <> 0 THEN {r(f"greatest(-1, least(1, {APART} * 20))")} ELSE 0.0E0 END AS trend_strength FROM (
  SELECT *, row_number() OVER ({S}) AS n, {SUMS} FROM features WHERE regime_mag IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, obs_id DESC) = 1) q USING (series_id)
WHERE a.status = 'ok'
""", "v_series", ctes=FEATURES)  # fmt: skip

add("percentile_rank", f"""
SELECT v.series_id, v.obs_id, CASE WHEN count(r.obs_id) >= 10 THEN {r("count(r.obs_id) FILTER (r.price <= v.price) / count(r.obs_id)")} END AS percentile
FROM v_series v LEFT JOIN v_series r ON r.series_id = v.series_id AND r.obs_id % 2 = 0 WHERE v.obs_id % 2 = 1 GROUP BY v.series_id, v.obs_id
""", "v_series")  # fmt: skip
add("weighted_quantile", f"""
SELECT series_id, {r("min(price) FILTER (share >= 0.5)")} AS quantile FROM (
  SELECT *, CAST(sum(w) OVER (PARTITION BY series_id ORDER BY price) AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY series_id) AS DOUBLE) AS share FROM (SELECT *, {units('1.0E0 / (obs_id % 7 + 1)')} AS w FROM v_series)) GROUP BY 1
""", "v_series")  # fmt: skip
add("order_statistic", f"SELECT series_id, {r('list_sort(list(price))[least(count(*), CAST(floor(count(*) * 0.75E0) AS BIGINT) + 1)]')} AS quantile FROM v_series GROUP BY 1", "v_series")

FLAT, TILT = "p_up", "coalesce(p_up_experimental, p_up)"
strict = lambda p: f"avg(CASE WHEN ({p} > 0.5) = (realized_up = 1) THEN 1.0E0 ELSE 0.0E0 END)"
square = lambda p: f"avg(({p} - realized_up) * ({p} - realized_up))"
add("challenger_evaluation", f"""
SELECT {K}, n AS n_resolved, ROUND(u, 3) AS historical_up_rate, ROUND(af, 3) AS accuracy_flat, ROUND(att, 3) AS accuracy_tilted, ROUND(bf, 3) AS brier_flat, ROUND(bt, 3) AS brier_tilted,
  ROUND(greatest(u, 1 - u), 3) AS naive_baseline_accuracy, ROUND(u * (1 - u), 3) AS brier_baseline_up_rate, ROUND(ma, 3) AS ma_crossover_accuracy,
  af > greatest(u, 1 - u) AS beats_naive_flat, att > greatest(u, 1 - u) AS beats_naive_tilted, af > ma AS beats_ma_crossover_flat, att > ma AS beats_ma_crossover_tilted,
  d0 AS drivers_agree, d1 AS drivers_disagree, d2 AS drivers_uncovered, n - d0 - d1 - d2 AS drivers_no_driver_applied
FROM (SELECT {K}, count(*) AS n, avg(realized_up) AS u, {strict(FLAT)} AS af, {strict(TILT)} AS att, {square(FLAT)} AS bf, {square(TILT)} AS bt,
    avg(CASE WHEN id % 2 = realized_up THEN 1.0E0 ELSE 0.0E0 END) FILTER (id % 4 <> 0) AS ma, count(*) FILTER (id % 5 = 0) AS d0, count(*) FILTER (id % 5 = 1) AS d1, count(*) FILTER (id % 5 = 2) AS d2
  FROM v_ledger WHERE realized_up IS NOT NULL GROUP BY ALL)
""", "v_ledger")  # fmt: skip

add("preceding_decision", """
SELECT a.id, max(d.ts) AS decision_ts FROM v_ledger a LEFT JOIN v_ledger d ON d.coin = a.coin AND d.horizon_hours = a.horizon_hours AND d.id % 10 = 0 AND d.ts <= a.ts + INTERVAL 1 HOUR WHERE a.id % 10 <> 0 GROUP BY a.id
""", "v_ledger")  # fmt: skip
add("latest_curve_batch", f"""
SELECT {K}, decile, {r("rate")} AS empirical_up_rate, n AS n_samples, TIMESTAMP '2024-01-02' AS computed_ts FROM newer UNION ALL
SELECT {K}, decile, {r("rate")}, n, TIMESTAMP '2024-01-01' FROM older o WHERE NOT EXISTS (SELECT 1 FROM newer e WHERE e.coin = o.coin AND e.horizon_hours = o.horizon_hours)
""", "v_ledger", ctes="part_b AS (SELECT * FROM v_ledger WHERE coin <> 'ETH')," + curve("v_ledger", K, "older") + "," + curve("part_b", K, "newer"))  # fmt: skip
add("chart_extract", """
SELECT 'price' AS kind, CAST(series_id AS VARCHAR) AS series, ts, ROUND(price, 6) + 0.0 AS value FROM v_series
UNION ALL SELECT 'forecast', coin, ts, ROUND(p_up, 6) + 0.0 FROM v_ledger WHERE horizon_hours = 24
""", "v_series", "v_ledger")  # fmt: skip
add("catalyst_provenance", """
SELECT id, CASE WHEN first_public_ts IS NULL THEN 'unknown' ELSE 'reported' END AS timestamp_source, CASE WHEN first_public_ts IS NULL OR id % 3 = 2 THEN 'UNKNOWN' WHEN id % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS timestamp_confidence FROM v_catalyst
""", "v_catalyst")  # fmt: skip
add("catalysts_of_period", "SELECT id FROM v_catalyst WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' ORDER BY ts DESC, id DESC LIMIT 100", "v_catalyst")
add("budget_pick", f"""
SELECT coin, {r("priority")} AS priority, CAST(row_number() OVER (ORDER BY priority DESC, coin) AS INTEGER) AS place, CASE WHEN priority >= 4 AND row_number() OVER (ORDER BY priority DESC, coin) <= budget THEN 'selected' ELSE 'deferred' END AS decision
FROM (SELECT asset_no AS coin, count(*) / 10.0E0 + asset_no AS priority FROM v_investigation GROUP BY 1) CROSS JOIN (
  SELECT least(greatest(0, 60 - count(*) FILTER (request_ts >= t - INTERVAL 24 HOUR)), greatest(0, 2 - count(*) FILTER (request_ts >= t - INTERVAL 1 HOUR))) AS budget FROM v_investigation, (SELECT max(request_ts) AS t FROM v_investigation))
""", "v_investigation")  # fmt: skip
add("narrative_parse", """
SELECT id, 'Day.' || chr(10) || chr(10) || 'MACRO: calm' AS narrative, CASE id % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' END AS bias_short, CASE WHEN id % 2 = 0 THEN 'low' END AS macro_risk, CAST(greatest(-1, least(1, id % 5 - 2)) AS DOUBLE) AS macro_score FROM v_catalyst
""", "v_catalyst")  # fmt: skip
