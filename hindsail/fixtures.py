"""Views over the driver's tables in the shapes that the operators take.

Each text runs unchanged in Spark and in DuckDB and gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed texts: the fixture definitions.
VIEWS = {
    "v_series": "SELECT user_id AS series_id, event_id AS obs_id, ts, value + 1.0 AS price FROM events",
    "v_context": """
SELECT CAST(ts AS {ntz}) AS ts, score, regime_mag, bottom_score FROM (
  SELECT date_trunc('day', ts) AS ts, ROUND(AVG(value), 6) AS score,
         ROUND(2 * AVG(CASE WHEN event_type = 'purchase' THEN 1.0E0 ELSE 0.0E0 END) - 1, 6) AS regime_mag,
         CAST(COUNT(DISTINCT user_id) AS DOUBLE) AS bottom_score
  FROM events GROUP BY date_trunc('day', ts)) d
WHERE extract(day FROM ts) > 10""",
    "v_ledger": """
SELECT id, coin, horizon_hours, ts, ts + horizon_hours * INTERVAL '1' HOUR AS resolved_ts, p_up,
       CASE WHEN id % 3 <> 0 THEN 0.5E0 + (p_up - 0.5E0) * 0.8E0 END AS p_up_experimental,
       CASE WHEN id % 50 = 49 THEN NULL WHEN u < 20 + 60 * p_up THEN 1 ELSE 0 END AS realized_up,
       v AS volatility_percentile, t AS trend_strength, a AS is_regime_anomaly,
       f1 AS technical_score, f2 AS regime_mag
FROM (SELECT o_orderkey AS id,
             CASE o_orderstatus WHEN 'F' THEN 'BTC' WHEN 'O' THEN 'LINK' ELSE 'ETH' END AS coin,
             CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 24 END AS horizon_hours,
             o_orderdate + CAST(o_orderkey % 24 AS INT) * INTERVAL '1' HOUR AS ts,
             CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) % 1001 AS DOUBLE) / 1000.0E0 AS p_up,
             (o_custkey * 37 + o_orderkey) % 100 AS u,
             CAST(o_custkey % 101 AS DOUBLE) / 100.0E0 AS v,
             CAST(o_custkey % 41 AS DOUBLE) / 20.0E0 - 1.0E0 AS t,
             CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS a,
             CAST(o_orderkey % 101 AS DOUBLE) AS f1,
             CAST(o_custkey % 201 AS DOUBLE) / 100.0E0 - 1.0E0 AS f2
      FROM orders) o""",
    "v_catalyst": """
SELECT event_id AS id, ts,
       CASE event_type WHEN 'click' THEN 'BTC' WHEN 'view' THEN 'ETH' ELSE 'LINK' END AS coin,
       CASE event_id % 6 WHEN 0 THEN 'MACRO' WHEN 1 THEN 'REGULATION' WHEN 2 THEN 'SECURITY'
                         WHEN 3 THEN 'ETF_FLOWS' WHEN 4 THEN 'TECHNICAL' ELSE 'NOT_A_CATEGORY' END AS category,
       CASE WHEN event_id % 11 = 0 THEN NULL
            ELSE ts + CAST(event_id % 301 - 150 AS INT) * INTERVAL '1' MINUTE END AS first_public_ts,
       ts + CAST(event_id % 121 AS INT) * INTERVAL '1' MINUTE AS discovery_ts,
       CASE WHEN event_id % 13 = 0 THEN 'ftp://bad'
            ELSE 'https://example.org/' || CAST(event_id AS VARCHAR(20)) END AS source_url
FROM events""",
    "v_investigation": """
SELECT event_id AS id, 'MI-' || CAST(event_id - event_id % 40 AS VARCHAR(20)) AS investigation_id,
       ts AS request_ts, user_id % 3 AS asset_no FROM events WHERE event_type = 'signup'""",
    "v_response": """
SELECT event_id AS id, ts AS request_ts,
       CASE WHEN event_id % 17 = 0 THEN 'not json {{'
            ELSE (CASE WHEN event_id % 5 = 0 THEN '```json' || chr(10) ELSE '' END)
              || '{{"assets":["BTC"],"market_classification":"'
              || (CASE WHEN event_id % 7 = 0 THEN 'NOPE' ELSE 'ASSET_SPECIFIC' END)
              || '","catalysts":[' || (CASE WHEN event_id % 3 = 0 THEN '' ELSE
                 '{{"category":"MACRO","sources":[{{"url":"https://example.org/'
                 || CAST(event_id AS VARCHAR(20)) || '"}}]}}' END) || ']}}'
              || (CASE WHEN event_id % 5 = 0 THEN chr(10) || '```' ELSE '' END) END AS text
FROM events WHERE event_type = 'error'""",
}
SOURCES = {"v_series": "events", "v_context": "events", "v_ledger": "orders", "v_catalyst": "events", "v_investigation": "events", "v_response": "events"}


def duckdb_text(name: str) -> str:
    return VIEWS[name].format(ntz="TIMESTAMP")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the tables of sf_dir."""
    source = SOURCES[name]
    return spark.sql(VIEWS[name].format(ntz="TIMESTAMP_NTZ").replace(f"FROM {source}", f"FROM {{{source}}}") if "{{" not in VIEWS[name] else VIEWS[name].replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: table(spark, sf_dir, source)})
