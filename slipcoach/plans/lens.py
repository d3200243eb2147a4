"""The driver's star-schema tables seen as rail tables: canonical ones, and feed-shaped ones with text columns.

ORACLE holds the same formulas as common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slipcoach.plans.schemas import Tables

_SQL = {
    "operators": """
      SELECT CAST(s_suppkey + 1 AS INT) AS operator_id, s_name AS name, n_name AS country,
             CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'https://op' || s_suppkey || '.example' END AS website, r_name AS source_name
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "stations": """
      SELECT CAST(c_custkey + 1 AS INT) AS station_id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS city, n_name AS country,
             CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 35 + ((c_custkey * 37) % 30000) / CAST(1000 AS DOUBLE) END AS latitude,
             CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE -10 + ((c_custkey * 53) % 40000) / CAST(1000 AS DOUBLE) END AS longitude,
             CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 'uic_' || c_custkey END AS uic_code, r_name AS source_name
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "trains": """
      SELECT CAST(p_partkey + 1 AS INT) AS train_id, 'tpch_' || p_partkey AS train_number, operator_id,
             CASE WHEN p_size % 5 = 0 THEN 'night' ELSE 'day' END AS train_type,
             CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS category, p_name AS route_name,
             CASE p_partkey % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'heuristic' WHEN 2 THEN 'ml_support' END AS classification_method,
             CASE p_partkey % 4 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(0.85 AS DOUBLE) WHEN 2 THEN CAST(0.75 AS DOUBLE) END AS classification_confidence,
             p_partkey % 4 = 3 AS needs_manual_review, CAST(p_partkey % 100 AS DOUBLE) AS night_percentage, 'tpch' AS source_name
      FROM part JOIN (SELECT l_partkey, CAST(min(l_suppkey) + 1 AS INT) AS operator_id FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""",
    "schedules": """
      SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS schedule_id, CAST(l_partkey + 1 AS INT) AS train_id,
             CAST(o_custkey + 1 AS INT) AS origin_id, CAST(1 + (o_custkey * 7 + l_suppkey * 13) % (SELECT count(*) + 1 FROM customer) AS INT) AS destination_id,
             {departure} AS departure_time, {arrival} AS arrival_time, CAST(20 + (l_partkey * 31 + l_orderkey) % 1000 AS INT) AS duration_min,
             CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE CAST(30 + (l_partkey * 17 + l_orderkey * 3) % 1600 AS DOUBLE) END AS distance_km,
             CASE WHEN l_orderkey % 2 = 0 THEN 'daily' END AS frequency, 'tpch' AS source_name
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "stop_times": """
      SELECT CAST(l_orderkey AS {text}) AS trip_id, CAST(l_partkey AS {text}) AS stop_id, CAST(l_linenumber AS {text}) AS stop_sequence, t_min,
             lpad(CAST({hours} AS {text}), 2, '0') || ':' || lpad(CAST(t_min % 60 AS {text}), 2, '0') || ':00' AS departure_time,
             lpad(CAST({hours} AS {text}), 2, '0') || ':' || lpad(CAST(t_min % 60 AS {text}), 2, '0') || ':00' AS arrival_time
      FROM (SELECT l_orderkey, l_partkey, l_linenumber, (l_orderkey * 97) % 1440 + l_linenumber * (15 + l_orderkey % 140) AS t_min FROM lineitem)""",
    "trips": """
      SELECT CAST(o_orderkey AS {text}) AS trip_id, 'R' || (o_orderkey % 40) AS route_id,
             CASE WHEN o_orderkey % 50 = 0 THEN 'Nightjet' WHEN o_orderkey % 50 = 1 THEN 'IC Nuit' ELSE o_orderpriority END AS trip_headsign
      FROM orders""",
    "routes": """
      SELECT DISTINCT 'R' || (o_orderkey % 40) AS route_id, 'A' || (o_orderkey % 40 % 5) AS agency_id, ' Line ' || (o_orderkey % 40) || ' ' AS route_short_name,
             CASE WHEN o_orderkey % 40 % 6 = 0 THEN NULL ELSE 'Corridor ' || (o_orderkey % 40) END AS route_long_name,
             CAST(CASE WHEN o_orderkey % 40 = 7 THEN 105 WHEN o_orderkey % 40 IN (3, 4) THEN 3 ELSE 2 END AS {text}) AS route_type
      FROM orders""",
    "agencies": """
      SELECT DISTINCT 'A' || (s_suppkey % 5) AS agency_id, ' Agency ' || (s_suppkey % 5) AS agency_name, 'https://a' || (s_suppkey % 5) || '.example' AS agency_url FROM supplier""",
    "stops": """
      SELECT CAST(p_partkey AS {text}) AS stop_id, ' ' || p_name || ' ' AS stop_name,
             CASE WHEN p_partkey % 19 = 0 THEN 'n/a' ELSE CAST((p_partkey * 37) % 120 - 10 AS {text}) END AS stop_lat, CAST((p_partkey * 53) % 400 - 200 AS {text}) AS stop_lon
      FROM part""",
}
_SHIP = "(l_orderkey * 97 + l_linenumber * 13) % 1440"
_RIDE = "20 + (l_partkey * 31 + l_orderkey) % 1000"
_SPARK = {
    "text": "STRING", "hours": "t_min div 60",
    "departure": f"timestampadd(MINUTE, CAST({_SHIP} AS INT), CAST(l_shipdate AS TIMESTAMP_NTZ))",
    "arrival": f"timestampadd(MINUTE, CAST({_SHIP} + {_RIDE} AS INT), CAST(l_shipdate AS TIMESTAMP_NTZ))",
}
_DUCK = {
    "text": "VARCHAR", "hours": "t_min // 60",
    "departure": f"l_shipdate + to_minutes(CAST({_SHIP} AS INT))",
    "arrival": f"l_shipdate + to_minutes(CAST({_SHIP} + {_RIDE} AS INT))",
}
ORACLE = ",\n".join(f"{name} AS ({sql.format(**_DUCK)})" for name, sql in _SQL.items())
_BASE = "region nation customer supplier part orders lineitem".split()


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in _BASE}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the lens."""
    base = _views(spark, sf_dir)
    text = _SQL[name].format(**_SPARK)
    for n in _BASE:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    used = {n: df for n, df in base.items() if f"{{{n}}}" in text}
    return spark.sql(text, **used)


def canonical(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(*(table(spark, sf_dir, n) for n in Tables._fields))


def feed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """agency, stops, routes, trips and stop_times as a feed holds them: text."""
    names = {"agency": "agencies", "stops": "stops", "routes": "routes", "trips": "trips", "stop_times": "stop_times"}
    return {k: table(spark, sf_dir, v).drop("t_min") for k, v in names.items()}
