"""DuckDB SQL for the registered queries, over the same lens."""

from slipcoach.plans import lens
from slipcoach.plans.schemas import BERTH_WORDS, NIGHT_WORDS, OTHER_TYPES, RAIL_TYPES

_BASE = """
base AS (
  SELECT t.train_id, o.name AS operator, o.country AS operator_country, o.website, t.train_type AS kind, t.classification_method, t.classification_confidence, t.needs_manual_review,
         so.name AS dep, sd.name AS arr, so.name || ' -> ' || sd.name AS route, s.departure_time, s.arrival_time, s.duration_min, s.distance_km, s.distance_km * 0.215 - s.distance_km * 0.005 AS co2,
         CASE WHEN distance_km < 200 THEN '0-200' WHEN distance_km < 400 THEN '200-400' WHEN distance_km < 600 THEN '400-600' WHEN distance_km < 800 THEN '600-800'
              WHEN distance_km < 1200 THEN '800-1200' WHEN distance_km >= 1200 THEN '1200+' END AS segment
  FROM trains t JOIN operators o ON o.operator_id = t.operator_id JOIN schedules s ON s.train_id = t.train_id
  LEFT JOIN stations so ON so.station_id = s.origin_id LEFT JOIN stations sd ON sd.station_id = s.destination_id),
served AS (
  SELECT s.*, t.train_number, t.train_type, t.category, o.name AS operator_name, so.name AS origin, so.city AS ocity, so.country AS ocountry, sd.name AS destination, sd.city AS dcity, sd.country AS dcountry,
         coalesce(so.city, so.name) AS origin_city, coalesce(so.country, 'EU') AS origin_country, coalesce(sd.city, sd.name) AS destination_city, coalesce(sd.country, 'EU') AS destination_country
  FROM schedules s JOIN trains t ON s.train_id = t.train_id JOIN operators o ON o.operator_id = t.operator_id JOIN stations so ON so.station_id = s.origin_id JOIN stations sd ON sd.station_id = s.destination_id)"""
_SAYS = " OR ".join(f"contains(txt, '{w}')" for w in dict.fromkeys((*NIGHT_WORDS, *BERTH_WORDS)))
_RAIL = ", ".join(map(str, RAIL_TYPES))
_LABEL = " ".join(f"WHEN {k} THEN '{v}'" for k, v in (RAIL_TYPES | OTHER_TYPES).items())
_F = "((floor(({x}) / 1440)) * 480 + least(({x}) % 1440, 300) + greatest(0, ({x}) % 1440 - 1260))"
_NIGHT = f"({_F.format(x='d // 60 % 1440 + floor(m)')} - {_F.format(x='d // 60 % 1440')})"
_FEED = f"""
calls AS (
  SELECT trip_id, stop_id, CAST(stop_sequence AS INT) AS seq, departure_time, arrival_time,
         CAST(split_part(departure_time, ':', 1) AS BIGINT) * 3600 + CAST(split_part(departure_time, ':', 2) AS BIGINT) * 60 + CAST(split_part(departure_time, ':', 3) AS BIGINT) AS secs FROM stop_times),
ends AS (SELECT trip_id, arg_min(secs, (seq, stop_id)) AS d, arg_max(secs, (seq, stop_id)) AS a FROM calls GROUP BY trip_id),
rides AS (SELECT *, CASE WHEN (a - d) / 60.0 <= 0 THEN (a - d) / 60.0 + 1440 ELSE (a - d) / 60.0 END AS m FROM ends),
metrics AS (
  SELECT trip_id, round_even(CAST(m AS DOUBLE) / 60, 3) AS duration_hours, CAST(round_even({_NIGHT} * 100.0 / CAST(m AS DOUBLE), 2) AS DOUBLE) AS night_percentage,
         CAST(d // 3600 % 24 AS BIGINT) AS departure_hour, CAST(a // 3600 % 24 AS BIGINT) AS arrival_hour, CASE WHEN a >= 86400 OR a <= d THEN 1 ELSE 0 END AS overnight_flag FROM rides),
evidence AS (
  SELECT t.trip_id, r.route_type, m.* EXCLUDE (trip_id), concat_ws(' ', lower(trim(r.route_short_name)), lower(trim(r.route_long_name)), lower(trim(t.trip_headsign))) AS txt
  FROM trips t LEFT JOIN routes r ON t.route_id = r.route_id LEFT JOIN metrics m ON t.trip_id = m.trip_id),
ruled AS (
  SELECT *, CASE WHEN {_SAYS} OR route_type = '105' THEN 'night' WHEN coalesce(duration_hours, 0) <= 2.5 AND coalesce(night_percentage, 0) < 15 THEN 'day' END AS train_type_rule,
         CASE WHEN (coalesce(duration_hours, 0) < 3.5 AND coalesce(night_percentage, 0) < 35 AND coalesce(overnight_flag, 0) = 0) OR (coalesce(duration_hours, 0) < 6 AND coalesce(night_percentage, 0) < 20) THEN 'day'
              WHEN (duration_hours >= 4 AND night_percentage >= 50) OR (duration_hours >= 6 AND departure_hour >= 20 AND (coalesce(arrival_hour, -1) <= 9 OR overnight_flag = 1)) THEN 'night' END AS train_type_heuristic
  FROM evidence),
final AS (
  SELECT trip_id, train_type_rule, train_type_heuristic, night_percentage, coalesce(train_type_rule, train_type_heuristic, 'day') AS train_type,
         CASE WHEN train_type_rule IS NOT NULL THEN 'rule' WHEN train_type_heuristic IS NOT NULL THEN 'heuristic' ELSE 'default_day' END AS classification_method,
         CASE WHEN train_type_rule = 'night' THEN 'explicit_night_signal' WHEN train_type_rule = 'day' THEN 'explicit_day_short_service' WHEN train_type_heuristic = 'night' THEN 'night_share_threshold'
              WHEN train_type_heuristic = 'day' THEN 'low_night_share' ELSE 'insufficient_night_evidence' END AS classification_reason,
         CAST(CASE WHEN train_type_rule = 'night' THEN 1.0 WHEN train_type_rule = 'day' THEN 0.95 WHEN train_type_heuristic = 'night' THEN 0.85 WHEN train_type_heuristic = 'day' THEN 0.75 ELSE 0.5 END AS DOUBLE) AS classification_confidence,
         train_type_rule IS NULL AND coalesce(train_type_heuristic, 'x') <> 'night' AS needs_manual_review
  FROM ruled),
rail_routes AS (SELECT * FROM routes WHERE CAST(route_type AS INT) IN ({_RAIL})),
rail_trips AS (SELECT * FROM trips WHERE route_id IN (SELECT route_id FROM rail_routes)),
-- the feed as two sources
sources AS (SELECT 'renfe' AS source_name, 0 AS pr UNION ALL SELECT 'sncb', 1),
feed_trips AS (SELECT t.*, source_name, pr FROM trips t, sources),
merged_ops AS (
  SELECT row_number() OVER (ORDER BY agency_id) AS operator_id, 'renfe_' || agency_id AS agency_id, agency_name, agency_url, 'renfe' AS source_name FROM agencies),
merged_trains AS (
  SELECT f.source_name || '_' || f.trip_id AS trip_id, f.trip_id AS bare, o.operator_id, r.route_short_name, r.route_long_name, f.source_name, f.pr FROM feed_trips f JOIN routes r ON f.route_id = r.route_id JOIN merged_ops o ON f.source_name || '_' || r.agency_id = o.agency_id),
merged_ends AS (SELECT trip_id, arg_min(stop_id, (seq, stop_id)) AS o, arg_max(stop_id, (seq, stop_id)) AS e, arg_min(secs, (seq, stop_id)) AS d, arg_max(secs, (seq, stop_id)) AS a FROM calls GROUP BY trip_id),
numbered_stops AS (SELECT row_number() OVER (ORDER BY pr, source_name || '_' || stop_id) AS station_id, source_name || '_' || stop_id AS stop_id FROM stops, sources),
merged_rides AS (
  SELECT t.bare AS trip_id, t.source_name, CAST((CASE WHEN a - d < 0 THEN a - d + 86400 ELSE a - d END) / 60 AS BIGINT) AS duration_min FROM merged_trains t JOIN merged_ends m ON t.bare = m.trip_id
  JOIN part po ON CAST(po.p_partkey AS VARCHAR) = o JOIN part pe ON CAST(pe.p_partkey AS VARCHAR) = e WHERE o <> e AND a <> d)"""


def _sql(text: str, extra: str = _BASE) -> str:
    return f"WITH {lens.ORACLE},{extra}\n{text}"


_OP = "FROM operators o LEFT JOIN trains t ON o.operator_id = t.operator_id LEFT JOIN schedules s ON t.train_id = s.train_id"
_DAY, _NIGHT_N = "count(DISTINCT CASE WHEN t.train_type = 'day' THEN t.train_id END)", "count(DISTINCT CASE WHEN t.train_type = 'night' THEN t.train_id END)"
_AVG = "round(avg(s.duration_min), 0) AS avg_duration_min, round(avg(s.distance_km), 0) AS avg_distance_km"
_DN = f"SELECT o.country, t.train_type, count(DISTINCT t.train_id) AS nb_trains, count(s.schedule_id) AS nb_schedules, {_AVG}, min(s.duration_min) AS min_duration, max(s.duration_min) AS max_duration FROM trains t JOIN operators o ON t.operator_id = o.operator_id LEFT JOIN schedules s ON t.train_id = s.train_id {{where}} GROUP BY ALL"
_SHOWN = "schedule_id, train_number, {0}origin, origin_city, origin_country, destination, destination_city, destination_country, departure_time, arrival_time, duration_min, distance_km"
_OK = "dep IS NOT NULL AND arr IS NOT NULL"
_QUALITY = "SELECT 'operators' AS table_name, count(*) AS total_records, count(name) AS name_complete, count(country) AS country_complete, count(website) AS website_complete FROM operators UNION ALL SELECT 'stations', count(*), count(name), count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL), count(uic_code) FROM stations UNION ALL SELECT 'trains', count(*), count(train_number), count(train_type), count(category) FROM trains UNION ALL SELECT 'schedules', count(*), count(departure_time), count(arrival_time), count(distance_km) FROM schedules"
_COUNTS = "SELECT 'operators' AS table_name, count(*) AS rows FROM operators UNION ALL SELECT 'stations', count(*) FROM stations UNION ALL SELECT 'trains', count(*) FROM trains UNION ALL SELECT 'schedules', count(*) FROM schedules"
_CODE = "CASE {id} % 4 WHEN 0 THEN 'FR' WHEN 1 THEN 'ESP' WHEN 2 THEN country END AS country"
_CODED_OPERATORS, _CODED_STATIONS = (f"(SELECT * REPLACE ({_CODE.format(id=k)}) FROM {n})" for n, k in (("operators", "operator_id"), ("stations", "station_id")))
_PLAIN = {
    "v_operator_summary": f"SELECT o.operator_id, o.name AS operator_name, o.country, count(DISTINCT t.train_id) AS total_trains, {_DAY} AS day_trains, {_NIGHT_N} AS night_trains, count(s.schedule_id) AS total_schedules, {_AVG} {_OP} GROUP BY ALL",
    "v_country_stats": f"SELECT o.country, count(DISTINCT o.operator_id) AS nb_operators, count(DISTINCT t.train_id) AS nb_trains, {_DAY} AS day_trains, {_NIGHT_N} AS night_trains, count(DISTINCT s.origin_id) AS nb_origin_stations, count(DISTINCT s.destination_id) AS nb_destination_stations, {_AVG} {_OP} GROUP BY ALL",
    "stats_by_country": f"SELECT o.country, count(DISTINCT o.operator_id) AS nb_operators, count(DISTINCT t.train_id) AS nb_trains, {_DAY} AS day_trains, {_NIGHT_N} AS night_trains, count(DISTINCT s.origin_id) AS nb_stations, count(s.schedule_id) AS nb_schedules, {_AVG} {_OP} GROUP BY ALL",
    "v_day_night_comparison": _DN.format(where=""),
    "day_night_comparison": _DN.format(where="WHERE o.country = 'NATION_11'"),
    "v_schedules_detailed": "SELECT s.schedule_id, t.train_id, t.train_number, t.train_type, t.category, o.operator_id, o.name AS operator_name, o.country AS operator_country, so.station_id AS origin_id, so.name AS origin_name, so.city AS origin_city, so.country AS origin_country, sd.station_id AS destination_id, sd.name AS destination_name, sd.city AS destination_city, sd.country AS destination_country, s.departure_time, s.arrival_time, s.duration_min, s.distance_km, s.frequency FROM schedules s JOIN trains t ON s.train_id = t.train_id JOIN operators o ON t.operator_id = o.operator_id JOIN stations so ON s.origin_id = so.station_id JOIN stations sd ON s.destination_id = sd.station_id",
    "count_trains_by_type": "SELECT train_type, count(*) AS count FROM trains GROUP BY 1",
    "count_trains_by_country": "SELECT o.country, count(*) AS total, count(*) FILTER (t.train_type = 'day') AS day_count, count(*) FILTER (t.train_type = 'night') AS night_count FROM trains t JOIN operators o ON t.operator_id = o.operator_id GROUP BY 1",
    "count_stations_by_country": "SELECT country, count(*) AS count FROM stations GROUP BY 1",
    "count_operators_by_country": "SELECT country, count(*) AS count FROM operators GROUP BY 1",
    "summary": "SELECT (SELECT count(*) FROM operators) AS operators, (SELECT count(*) FROM stations) AS stations, (SELECT count(*) FROM trains) AS trains, (SELECT count(*) FROM schedules) AS schedules, (SELECT count(*) FROM trains WHERE train_type = 'day') AS day_trains, (SELECT count(*) FROM trains WHERE train_type = 'night') AS night_trains",
    "v_data_quality": _QUALITY,
    "data_quality": _QUALITY,
    "missing_values": "SELECT *, round_even(missing_count * 100.0 / total_count, 2) AS missing_pct FROM (SELECT 'stations' AS table_name, 'coordinates' AS field, count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS missing_count, count(*) AS total_count FROM stations UNION ALL SELECT 'stations', 'uic_code', count(*) FILTER (uic_code IS NULL), count(*) FROM stations UNION ALL SELECT 'trains', 'category', count(*) FILTER (category IS NULL), count(*) FROM trains UNION ALL SELECT 'schedules', 'distance_km', count(*) FILTER (distance_km IS NULL), count(*) FROM schedules)",
    "map_countries": "SELECT DISTINCT country FROM stations WHERE country IS NOT NULL AND latitude IS NOT NULL",
    "map_stations": "SELECT name, city, country, latitude, longitude FROM stations WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
    "table_counts": _COUNTS,
    "list_trains": "SELECT t.train_id, t.train_number, o.name AS operator_name, t.train_type, t.category, t.route_name FROM trains t JOIN operators o ON t.operator_id = o.operator_id WHERE train_type = 'night' AND category ILIKE '%standard%' ORDER BY t.train_id LIMIT 50 OFFSET 5",
    "train_detail": "SELECT t.train_id, t.train_number, o.name AS operator_name, o.country, t.train_type, t.category, t.route_name, t.classification_method AS method FROM trains t JOIN operators o ON t.operator_id = o.operator_id WHERE t.train_id = 3".replace(", t.category, t.route_name", ""),
    "train_schedules": "SELECT schedule_id, origin, ocity AS origin_city, destination, dcity AS destination_city, departure_time, arrival_time, duration_min, distance_km FROM served WHERE train_id = 8 ORDER BY departure_time, schedule_id LIMIT 100",
    "list_schedules": f"SELECT {_SHOWN.format('train_type, ')} FROM served WHERE ocity ILIKE '%build%' AND (ocountry = 'NATION_7' OR dcountry = 'NATION_7') ORDER BY departure_time, schedule_id LIMIT 40 OFFSET 2",
    "search_schedules": f"SELECT {_SHOWN.format('operator_name, train_type, category, ')} FROM served WHERE (ocity ILIKE '%machin%' OR origin ILIKE '%machin%') AND (dcity ILIKE '%AUTO%' OR destination ILIKE '%AUTO%') AND train_type = 'night'",
    "schedule_detail": f"SELECT {_SHOWN.format('train_type, ')}, frequency FROM served WHERE schedule_id = (SELECT min(schedule_id) FROM schedules)",
    "list_stations": "SELECT station_id, name, city, country, latitude, longitude, uic_code FROM stations WHERE country = 'NATION_4' AND city ILIKE '%furn%' ORDER BY name, station_id LIMIT 60",
    "station_detail": "SELECT station_id, name, city, country, latitude, longitude, uic_code FROM stations WHERE station_id = 12",
    "station_departures": "SELECT s.schedule_id, t.train_number, t.train_type, d.name AS destination, d.city AS destination_city, s.departure_time, s.arrival_time, s.duration_min FROM schedules s JOIN trains t ON s.train_id = t.train_id JOIN stations d ON s.destination_id = d.station_id WHERE s.origin_id = 12 AND train_type = 'day' ORDER BY departure_time, schedule_id LIMIT 50",
    "station_arrivals": "SELECT s.schedule_id, t.train_number, t.train_type, d.name AS origin, d.city AS origin_city, s.departure_time, s.arrival_time, s.duration_min FROM schedules s JOIN trains t ON s.train_id = t.train_id JOIN stations d ON s.origin_id = d.station_id WHERE s.destination_id = 12 ORDER BY arrival_time, schedule_id LIMIT 50",
    "list_operators": "SELECT o.operator_id, o.name, o.country, o.website, count(DISTINCT t.train_id) AS train_count FROM operators o LEFT JOIN trains t ON o.operator_id = t.operator_id WHERE o.name ILIKE '%supplier#0000000%' GROUP BY ALL ORDER BY o.name, o.operator_id LIMIT 30",
    "operator_detail": "SELECT o.operator_id, o.name, o.country, o.website, o.source_name, count(DISTINCT t.train_id) AS train_count FROM operators o LEFT JOIN trains t ON o.operator_id = t.operator_id WHERE o.operator_id = 4 GROUP BY ALL",
    "operator_trains": "SELECT train_id, train_number, train_type, category, route_name FROM trains WHERE operator_id = 4 AND train_type = 'day' ORDER BY train_number, train_id LIMIT 20",
    "top_routes": "SELECT so.name AS origin, so.city AS origin_city, sd.name AS destination, sd.city AS destination_city, count(*) AS frequency, round(avg(s.duration_min), 0) AS avg_duration, round(avg(s.distance_km), 0) AS avg_distance FROM schedules s JOIN stations so ON s.origin_id = so.station_id JOIN stations sd ON s.destination_id = sd.station_id GROUP BY ALL ORDER BY frequency DESC, origin, origin_city, destination, destination_city LIMIT 20",
    "cmp_basic_counts": "SELECT t.train_type, count(DISTINCT t.train_id) AS nb_trains, count(s.schedule_id) AS nb_schedules, round(avg(s.duration_min), 2) AS avg_duration_min, round(avg(s.distance_km), 2) AS avg_distance_km FROM trains t LEFT JOIN schedules s ON s.train_id = t.train_id GROUP BY 1",
    "cmp_frequency": "SELECT country, train_type, count(*) AS nb_unique_routes, CAST(sum(n) AS BIGINT) AS total_services, round(avg(n), 2) AS avg_services_per_route, round(avg(n) / 7.0, 2) AS services_per_day FROM (SELECT o.country, t.train_type, s.origin_id, s.destination_id, count(*) AS n FROM schedules s JOIN trains t ON t.train_id = s.train_id JOIN operators o ON o.operator_id = t.operator_id GROUP BY ALL) GROUP BY 1, 2",
    "cmp_distance_segment": "SELECT train_type, distance_segment, count(*) AS nb_services, round(avg(distance_km), 2) AS avg_distance_km, round(avg(speed), 2) AS avg_speed_kmh FROM (SELECT t.train_type, CASE WHEN distance_km IS NULL THEN 'Inconnue' WHEN distance_km < 200 THEN '< 200 km' WHEN distance_km < 500 THEN '200-499 km' WHEN distance_km < 800 THEN '500-799 km' ELSE '800+ km' END AS distance_segment, CASE WHEN duration_min > 0 THEN distance_km / (duration_min / CAST(60 AS DOUBLE)) END AS speed, distance_km FROM schedules s JOIN trains t ON t.train_id = s.train_id) GROUP BY 1, 2",
    "cmp_international": "SELECT t.train_type, count(DISTINCT s.origin_id || '->' || s.destination_id) AS international_routes, count(*) AS total_services, round(avg(s.distance_km), 2) AS avg_distance_km FROM schedules s JOIN trains t ON t.train_id = s.train_id JOIN stations so ON so.station_id = s.origin_id JOIN stations sd ON sd.station_id = s.destination_id WHERE so.country <> sd.country GROUP BY 1",
    "cmp_connectivity": "SELECT t.train_type, count(DISTINCT s.origin_id) AS origin_stations, count(DISTINCT s.destination_id) AS destination_stations, count(DISTINCT s.origin_id || '->' || s.destination_id) AS unique_connections FROM schedules s JOIN trains t ON t.train_id = s.train_id GROUP BY 1",
    "analytics_base": "SELECT train_id, operator, operator_country, kind AS train_type_normalized, dep AS departure_station, arr AS arrival_station, departure_time, arrival_time, duration_min, round(duration_min / 60, 6) AS duration_hours, distance_km, round(co2, 6) AS co2 FROM base",
    "overview_kpis": "SELECT count(DISTINCT train_id) AS total_trains, (SELECT count(DISTINCT x) FROM (SELECT dep AS x FROM base UNION ALL SELECT arr FROM base)) AS total_stations, count(DISTINCT operator) AS total_operators, count(*) AS total_schedules FROM base",
    "train_type_counts": "SELECT kind AS train_type, count(DISTINCT train_id) AS count FROM base GROUP BY 1",
    "country_train_counts": "SELECT operator_country AS country, count(DISTINCT train_id) AS nb_trains FROM base WHERE operator_country IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "top_operators_summary": "SELECT operator, operator_country AS country, count(DISTINCT train_id) AS trains, count(*) AS services, count(DISTINCT train_id) FILTER (kind = 'day') AS day, count(DISTINCT train_id) FILTER (kind = 'night') AS night FROM base GROUP BY 1, 2 ORDER BY trains DESC, operator, country LIMIT 15",
    "day_night_country_summary": "SELECT kind AS train_type, operator_country AS country, count(DISTINCT train_id) AS nb_trains, count(*) AS nb_schedules, round_even(avg(duration_min), 0) AS avg_duration, round_even(avg(distance_km), 0) AS avg_distance FROM base GROUP BY 1, 2",
    "operator_summary": "SELECT b.operator AS operator_name, b.operator_country AS country, b.website, count(DISTINCT train_id) AS nb_trains, min(d) AS day_trains, min(n) AS night_trains, count(*) AS nb_schedules, round_even(avg(duration_min), 0) AS avg_duration, round_even(avg(distance_km), 0) AS avg_distance FROM base b JOIN (SELECT operator, operator_country, count(DISTINCT train_id) FILTER (kind = 'day') AS d, count(DISTINCT train_id) FILTER (kind = 'night') AS n FROM base GROUP BY 1, 2) x ON b.operator = x.operator AND b.operator_country = x.operator_country WHERE website IS NOT NULL GROUP BY 1, 2, 3",
    "routes_df": f"SELECT route, count(*) AS rows FROM base WHERE {_OK} GROUP BY 1",
    "network_kpis": f"SELECT count(*) FILTER (d AND NOT n) AS only_day, count(*) FILTER (n AND NOT d) AS only_night, count(*) FILTER (d AND n) AS both, coalesce(sum(dk), 0) AS day_km, coalesce(sum(nk), 0) AS night_km FROM (SELECT route, bool_or(kind = 'day') AS d, bool_or(kind = 'night') AS n, sum(distance_km) FILTER (kind = 'day') AS dk, sum(distance_km) FILTER (kind = 'night') AS nk FROM base WHERE {_OK} GROUP BY 1)",
    "od_coverage": f"SELECT kind AS train_type_normalized, count(DISTINCT route) AS nb_routes, CASE kind WHEN 'day' THEN 'Day' ELSE 'Night' END AS label FROM base WHERE {_OK} GROUP BY 1",
    "service_km": "SELECT kind AS train_type_normalized, coalesce(sum(distance_km), 0) AS total_km, CASE kind WHEN 'day' THEN 'Day' ELSE 'Night' END AS label FROM base GROUP BY 1",
    "top_operators_by_type": "SELECT operator, kind AS train_type_normalized, count(*) AS count FROM base GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, operator) <= 5",
    "country_breakdown": "SELECT operator_country AS country, kind AS train_type, count(*) AS count FROM base WHERE operator_country IN (SELECT operator_country FROM base GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20) GROUP BY 1, 2",
    "long_distance_base": "SELECT train_id, dep AS departure_station, arr AS arrival_station, distance_km, duration_min FROM base WHERE distance_km >= 500",
    "long_distance_kpis": "SELECT count(*) AS services, round_even(count(*) FILTER (kind = 'night') * 100.0 / count(*), 1) AS night_pct, round_even(count(*) FILTER (kind = 'day') * 100.0 / count(*), 1) AS day_pct, round_even(avg(co2) FILTER (kind = 'night'), 1) AS avg_co2_night, round_even(avg(co2) FILTER (kind = 'day'), 1) AS avg_co2_day FROM base WHERE distance_km >= 500",
    "distance_segments": "SELECT segment, count(*) FILTER (kind = 'day') AS day, count(*) FILTER (kind = 'night') AS night, round(count(*) FILTER (kind = 'night') * 100.0 / count(*), 4) AS night_pct FROM base WHERE segment IS NOT NULL GROUP BY 1",
    "long_distance_co2": "SELECT kind AS train_type, round(avg(co2), 4) AS avg_co2, round(sum(co2), 4) AS total_co2 FROM base WHERE distance_km >= 500 GROUP BY 1",
    "night_corridors": f"SELECT route, count(train_id) AS services, round(avg(co2), 4) AS avg_co2, round(avg(distance_km), 4) AS avg_distance FROM base WHERE kind = 'night' AND distance_km >= 500 AND duration_min >= 360 AND {_OK} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "night_shift_candidates": f"SELECT route, count(train_id) AS services, round(avg(distance_km), 4) AS avg_dist, round(avg(co2), 4) AS avg_co2 FROM base WHERE kind = 'day' AND distance_km >= 400 AND duration_min >= 240 AND {_OK} AND route NOT IN (SELECT route FROM base WHERE kind = 'night' AND distance_km >= 400 AND {_OK}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "total_co2": "SELECT round(sum(co2), 4) AS total_co2_kg FROM base",
    "classification_summary": "SELECT classification_method, method_count, total_trains, review_count, round(mean_confidence, 4) AS mean_confidence, median_confidence, min_confidence, max_confidence, round_even(review_count * 100.0 / total_trains, 1) AS review_pct FROM (SELECT classification_method, count(*) AS method_count FROM (SELECT DISTINCT train_id, classification_method FROM base) WHERE classification_method IS NOT NULL GROUP BY 1), (SELECT count(*) AS total_trains, count(*) FILTER (needs_manual_review) AS review_count, avg(classification_confidence) AS mean_confidence, median(classification_confidence) AS median_confidence, min(classification_confidence) AS min_confidence, max(classification_confidence) AS max_confidence FROM (SELECT DISTINCT train_id, needs_manual_review, classification_confidence FROM base))",
    "segment_type_counts": "SELECT segment, kind AS train_type_normalized, count(*) AS count FROM base WHERE segment IS NOT NULL GROUP BY 1, 2",
    "segment_night_share": "SELECT segment, round(count(*) FILTER (kind = 'night') * 100.0 / count(*), 4) AS night_pct FROM base WHERE segment IS NOT NULL GROUP BY 1",
    "day_night_pair": "SELECT count(DISTINCT train_id) FILTER (kind = 'day') AS day, count(DISTINCT train_id) FILTER (kind = 'night') AS night, round_even(count(DISTINCT train_id) FILTER (kind = 'night') * 100.0 / count(DISTINCT train_id), 1) AS night_pct FROM base",
    "trains_by_country_top10": "SELECT operator_country, kind AS train_type_normalized, count(DISTINCT train_id) AS trains FROM base WHERE operator_country IN (SELECT operator_country FROM base GROUP BY 1 ORDER BY count(DISTINCT train_id) DESC, 1 LIMIT 10) GROUP BY 1, 2",
    "operators_top10": "SELECT operator, kind AS train_type_normalized, count(DISTINCT train_id) AS trains FROM base WHERE operator IN (SELECT operator FROM base GROUP BY 1 ORDER BY count(DISTINCT train_id) DESC, 1 LIMIT 10) GROUP BY 1, 2",
    "top_links": f"SELECT route, count(DISTINCT train_id) FILTER (kind = 'day') AS day, count(DISTINCT train_id) FILTER (kind = 'night') AS night, count(DISTINCT train_id) AS total FROM base WHERE {_OK} GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 10",
    "filter_options": "SELECT DISTINCT operator_country AS country, (SELECT max(distance_km) FROM base) AS max_distance FROM base",
    "apply_dashboard_filters": "SELECT train_id, count(*) AS rows FROM base WHERE operator_country = 'NATION_11' AND kind = 'night' AND (distance_km IS NULL OR distance_km BETWEEN 100 AND 900) GROUP BY 1",
    "filter_zero_or_range": "SELECT train_id, count(*) AS rows FROM base WHERE distance_km IS NULL OR distance_km = 0 OR distance_km BETWEEN 200 AND 700 GROUP BY 1",
    "filter_by_country": "SELECT train_id, count(*) AS rows FROM base WHERE operator_country = 'NATION_11' GROUP BY 1",
    "front_day_night_counts": "SELECT count(*) FILTER (train_type = 'day') AS day, count(*) FILTER (train_type = 'night') AS night FROM trains",
    "fill_distances": "SELECT schedule_id, origin_id, destination_id, coalesce(distance_km, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(d.latitude) - radians(o.latitude)) / 2), 2) + cos(radians(o.latitude)) * cos(radians(d.latitude)) * pow(sin((radians(d.longitude) - radians(o.longitude)) / 2), 2)))), 1)) AS distance_km FROM schedules s LEFT JOIN stations o ON o.station_id = s.origin_id LEFT JOIN stations d ON d.station_id = s.destination_id",
    "haversine_km": "SELECT station_id, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(48.85) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(48.85)) * pow(sin((radians(2.35) - radians(longitude)) / 2), 2)))), 3) AS km FROM stations",
    "co2_columns": "SELECT schedule_id, round(distance_km * CAST(0.005 AS DOUBLE), 6) AS emitted, round(distance_km * CAST(0.215 AS DOUBLE) - distance_km * CAST(0.005 AS DOUBLE), 6) AS saved FROM schedules",
    "classify_train_type_sql": "SELECT schedule_id, CASE WHEN hour(departure_time) BETWEEN 6 AND 21 THEN 'day' ELSE 'night' END AS train_type FROM schedules",
    "calculate_duration_sql": "SELECT schedule_id, CAST(round(epoch(arrival_time - departure_time) / 60) AS INT) AS minutes FROM schedules",
    "ml_dataset": "SELECT t.train_type, CAST(hour(departure_time) AS INT) AS departure_hour, CASE WHEN category ILIKE '%couchette%' OR category ILIKE '%sleeper%' THEN 1 ELSE 0 END AS has_couchette, count(*) AS rows, CAST(sum(duration_min) AS BIGINT) AS minutes FROM trains t JOIN schedules s ON t.train_id = s.train_id WHERE duration_min IS NOT NULL GROUP BY 1, 2, 3",
    "validate_operators": f"SELECT operator_id, name, country FROM {_CODED_OPERATORS} WHERE name IS NOT NULL AND trim(name) <> '' AND (country IS NULL OR trim(country) = '' OR regexp_full_match(trim(country), '[A-Z]{{2}}'))",
    "validate_stations": f"SELECT station_id, name, country, latitude, longitude FROM {_CODED_STATIONS} WHERE trim(name) <> '' AND (latitude IS NULL OR latitude BETWEEN -90 AND 90) AND (longitude IS NULL OR longitude BETWEEN -180 AND 180) AND (country IS NULL OR trim(country) = '' OR regexp_full_match(trim(country), '[A-Z]{{2,3}}'))",
    "validate_trains": "SELECT train_id, train_number, operator_id, train_type FROM trains WHERE trim(train_number) <> '' AND operator_id > 0 AND lower(trim(train_type)) IN ('day', 'night')",
    "validate_schedules": "SELECT schedule_id, train_id, origin_id, destination_id, duration_min FROM schedules WHERE train_id > 0 AND origin_id > 0 AND destination_id > 0 AND origin_id <> destination_id AND duration_min > 0 AND duration_min < 2880 AND departure_time IS NOT NULL AND arrival_time IS NOT NULL",
    "rejection_reasons": "SELECT 'origine = destination' AS reason, count(*) AS rows FROM schedules WHERE origin_id = destination_id",
    "split_valid_rejected": "SELECT schedule_id, 'origine = destination' AS reasons FROM schedules WHERE origin_id = destination_id",
    "dedup_keep_first": "SELECT trip_id, stop_sequence, min(stop_id) AS stop_id FROM stop_times GROUP BY 1, 2",
    "drop_missing_required": "SELECT * FROM routes WHERE route_long_name IS NOT NULL",
    "missing_required": "SELECT 'route_id' AS column_name, count(*) FILTER (route_id IS NULL) AS missing_count FROM routes UNION ALL SELECT 'route_long_name', count(*) FILTER (route_long_name IS NULL) FROM routes",
    "clean_routes": "SELECT route_id, agency_id, trim(route_short_name) AS route_short_name, trim(route_long_name) AS route_long_name, route_type FROM routes",
    "clean_stations": "SELECT stop_id, trim(stop_name) AS stop_name, CASE WHEN bad THEN NULL ELSE lat END AS stop_lat, CASE WHEN bad THEN NULL ELSE lon END AS stop_lon FROM (SELECT *, TRY_CAST(stop_lat AS DOUBLE) AS lat, TRY_CAST(stop_lon AS DOUBLE) AS lon, coalesce(TRY_CAST(stop_lat AS DOUBLE) NOT BETWEEN -90 AND 90, false) OR coalesce(TRY_CAST(stop_lon AS DOUBLE) NOT BETWEEN -180 AND 180, false) AS bad FROM stops)",
    "clean_stop_times": "SELECT DISTINCT trip_id, stop_id, CAST(stop_sequence AS INT) AS stop_sequence, departure_time, arrival_time FROM stop_times",
    "cleaning_stats": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM routes)) AS duplicates_removed, count(*) FILTER (route_long_name IS NULL) AS missing_values, count(*) FILTER (route_long_name IS NULL) AS rows_removed FROM routes",
    "normalize_station_codes": "SELECT upper(trim(stop_name)) AS stop_id FROM stops",
    "normalize_coordinates": "SELECT stop_id, stop_name, CASE WHEN TRY_CAST(stop_lat AS DOUBLE) BETWEEN -90 AND 90 THEN TRY_CAST(stop_lat AS DOUBLE) END AS stop_lat, CASE WHEN TRY_CAST(stop_lon AS DOUBLE) BETWEEN -180 AND 180 THEN TRY_CAST(stop_lon AS DOUBLE) END AS stop_lon FROM stops",
    "add_country_code": "SELECT *, 'FR' AS country_code FROM agencies",
    "standardize_route_types": f"SELECT route_id, route_type, CASE CAST(route_type AS INT) {_LABEL} ELSE 'Unknown' END AS route_type_label FROM routes",
    "country_timezone": "SELECT agency_id, CASE WHEN agency_id = 'A1' THEN 'Europe/Paris' END AS timezone FROM agencies",
    "default_day_labels": "SELECT trip_id, 'day' AS train_type, 'missing_stop_times' AS classification_reason, true AS needs_manual_review FROM trips",
    "reference_night_labels": "SELECT trip_id, 'night' AS train_type, 'rule' AS classification_method, CAST(100 AS DOUBLE) AS night_percentage FROM trips",
    "coalesce_columns": "SELECT route_id, coalesce(route_long_name, route_short_name) AS shown FROM routes",
    "endpoint_row_counts": "SELECT 'agencies' AS endpoint, count(*) AS rows FROM agencies UNION ALL SELECT 'routes', count(*) FROM routes UNION ALL SELECT 'stops', count(*) FROM stops UNION ALL SELECT 'trip_stop', count(*) FROM (SELECT DISTINCT trip_id, stop_id, stop_sequence FROM stop_times) UNION ALL SELECT 'trips', count(*) FROM trips",
    "write_canonical_upsert": "SELECT row_number() OVER (ORDER BY name, country, source_name) AS station_id, name, CASE WHEN source_name IN ('ASIA', 'EUROPE') THEN 'new' ELSE city END AS city, country, source_name FROM stations",
    "catalog_summary": "SELECT count(*) AS total_feeds, count(*) FILTER (e) AS european_feeds, count(DISTINCT c) AS countries, count(DISTINCT CASE WHEN e THEN c END) AS european_countries FROM (SELECT *, c <> 'US' AND operator_id % 5 <> 0 AS e FROM (SELECT operator_id, ['FR', 'DE', 'US', 'UK'][operator_id % 4 + 1] AS c FROM operators))",
    "replace_source_slice": "SELECT station_id, name, city, country, source_name FROM stations WHERE source_name <> 'ASIA' OR city IS NOT NULL",
}
_FEEDS = {
    "normalize_clock_time": "SELECT trip_id, stop_id, CAST(seq AS VARCHAR) AS stop_sequence, lpad(CAST(CAST(split_part(departure_time, ':', 1) AS INT) % 24 AS VARCHAR), 2, '0') || substr(departure_time, length(departure_time) - 5) AS departure_time FROM calls",
    "normalize_stop_times": "SELECT trip_id, stop_id, CAST(seq AS VARCHAR) AS stop_sequence, secs AS departure_time, secs AS arrival_time FROM calls",
    "filter_rail_routes": "SELECT route_id, route_type FROM rail_routes",
    "filter_rail_trips": "SELECT * FROM rail_trips",
    "filter_rail_stop_times": "SELECT trip_id, stop_id, stop_sequence, departure_time FROM stop_times WHERE trip_id IN (SELECT trip_id FROM rail_trips)",
    "removed_route_types": "SELECT route_type, count(*) AS count, (SELECT count(*) FROM routes) - (SELECT count(*) FROM rail_routes) AS removed, round_even(((SELECT count(*) FROM routes) - (SELECT count(*) FROM rail_routes)) * 100.0 / (SELECT count(*) FROM routes), 1) AS removed_pct FROM routes WHERE route_id NOT IN (SELECT route_id FROM rail_routes) GROUP BY 1",
    "trip_endpoints": "SELECT trip_id, d AS departure_s, a AS arrival_s FROM ends",
    "trip_metrics": "SELECT * FROM metrics",
    "night_percentage": "SELECT trip_id, night_percentage FROM metrics",
    "classify_simple_hour": "SELECT trip_id, CASE WHEN departure_hour >= 5 AND departure_hour < 21 THEN 'day' ELSE 'night' END AS train_type FROM metrics",
    "classify_from_clock": "SELECT trip_id, stop_id, CAST(seq AS VARCHAR) AS stop_sequence, departure_time, CASE WHEN secs // 3600 % 24 BETWEEN 5 AND 20 THEN 'day' ELSE 'night' END AS train_type FROM calls",
    "metadata_text": "SELECT trip_id, txt AS metadata_text FROM evidence",
    "rule_engine": "SELECT trip_id, train_type_rule, CASE train_type_rule WHEN 'night' THEN 'explicit_night_signal' WHEN 'day' THEN 'explicit_day_short_service' END AS rule_reason, CAST(CASE train_type_rule WHEN 'night' THEN 1.0 WHEN 'day' THEN 0.95 END AS DOUBLE) AS rule_confidence FROM ruled",
    "heuristic_engine": "SELECT trip_id, train_type_heuristic, CASE train_type_heuristic WHEN 'night' THEN 'night_share_threshold' WHEN 'day' THEN 'low_night_share' END AS heuristic_reason, CAST(CASE train_type_heuristic WHEN 'night' THEN 0.85 WHEN 'day' THEN 0.75 END AS DOUBLE) AS heuristic_confidence FROM ruled",
    "finalize_classification": "SELECT * FROM final",
    "classification_stats": "SELECT count(*) FILTER (train_type = 'day') AS day, count(*) FILTER (train_type = 'night') AS night, count(*) FILTER (classification_method = 'rule') AS rule_based, count(*) FILTER (classification_method = 'heuristic') AS heuristic_based, 0 AS ml_supported, count(*) FILTER (needs_manual_review) AS manual_review FROM final",
    "process_source": "SELECT f.trip_id, route_id, train_type, classification_method, classification_reason, night_percentage FROM final f JOIN rail_trips t ON f.trip_id = t.trip_id",
    "parse_duration_minutes": "SELECT trip_id, stop_id, CAST(seq AS VARCHAR) AS stop_sequence, secs / CAST(60 AS DOUBLE) AS minutes FROM calls",
    "merge_operators": "SELECT * EXCLUDE (agency_url) FROM merged_ops",
    "merge_stations": "SELECT row_number() OVER (ORDER BY pr, source_name || '_' || stop_id) AS station_id, source_name || '_' || stop_id AS stop_id, CASE pr WHEN 0 THEN 'ES' ELSE 'BE' END AS country, source_name FROM stops, sources",
    "merge_trains": "SELECT row_number() OVER (ORDER BY pr, trip_id) AS train_id, trip_id, operator_id, 'day' AS train_type, source_name FROM merged_trains",
    "merge_schedules": "SELECT trip_id, source_name, duration_min FROM merged_rides",
}
_LONG = {
    "basic_counts": ("cmp_basic_counts", "NULL", "nb_trains nb_schedules avg_duration_min avg_distance_km"),
    "frequency": ("cmp_frequency", "country", "nb_unique_routes total_services avg_services_per_route services_per_day"),
    "distance": ("cmp_distance_segment", "distance_segment", "nb_services avg_distance_km avg_speed_kmh"),
    "international": ("cmp_international", "NULL", "international_routes total_services avg_distance_km"),
    "connectivity": ("cmp_connectivity", "NULL", "origin_stations destination_stations unique_connections"),
}
_PLAIN["cmp_all"] = " UNION ALL ".join(f"SELECT '{a}' AS analysis, train_type, CAST({part} AS VARCHAR) AS part, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM ({_PLAIN[q]})" for a, (q, part, ms) in _LONG.items() for m in ms.split())
_PLAIN["validate_all"] = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM ({_PLAIN[f'validate_{n}']})" for n in ("operators", "stations", "trains", "schedules"))
_HOURLY = f"({_F.format(x='h * 60 + m')} - {_F.format(x='h * 60')}) * 100.0 / m"
_PLAIN["night_pct_hourly"] = f"SELECT train_id, h AS departure_hour, m AS duration_min, round(CAST(CASE WHEN m > 0 THEN {_HOURLY} ELSE 0 END AS DOUBLE), 6) AS night_percentage FROM (SELECT s.train_id, CAST(hour(departure_time) AS INT) AS h, duration_min AS m FROM schedules s JOIN trains t ON s.train_id = t.train_id)"
_PLAIN["touch_updated_at"] = "SELECT name, source_name, source_name IN ('ASIA', 'EUROPE') AS touched FROM stations"
_PLAIN["read_analytics_csv"] = "SELECT CAST(train_id AS VARCHAR) AS train_id, kind AS train_type_normalized, round(CAST(duration_min AS DOUBLE), 6) AS duration_min, distance_km, round(co2, 6) AS co2, operator, website, dep AS departure_station, arr AS arrival_station FROM base"
_PLAIN["export_csv"] = "SELECT CAST(train_id AS VARCHAR) AS train_id, kind AS train_type, CAST(CAST(distance_km AS BIGINT) AS VARCHAR) AS distance_km, operator, website, dep AS departure_station, arr AS arrival_station FROM base"

_CATALOG = "(SELECT CAST(operator_id AS VARCHAR) AS mdb_source_id, CASE WHEN operator_id % 5 = 0 THEN 'gtfs-rt' ELSE 'gtfs' END AS data_type, name AS provider, website AS urls_direct_download, ['FR', 'DE', 'US', 'UK'][operator_id % 4 + 1] AS location_country_code FROM operators)"
_PLAIN["read_feed_catalog"] = f"SELECT * FROM {_CATALOG}"
_PLAIN["catalog_european_feeds"] = f"SELECT * FROM {_CATALOG} WHERE data_type = 'gtfs' AND location_country_code <> 'US'"
_PLAIN["catalog_feeds_by_country"] = f"SELECT * FROM {_CATALOG} WHERE data_type = 'gtfs' AND location_country_code = 'DE'"
_PLAIN["catalog_feeds_by_operator"] = f"SELECT * FROM {_CATALOG} WHERE contains(lower(provider), 'supplier#00000001')"
_row = lambda columns: " || '|' || ".join(f"coalesce({c}, '\\N')" for c in sorted(columns))
_COLUMNS = (
    ("agency_id", "agency_name", "agency_url"), ("stop_id", "stop_name", "stop_lat", "stop_lon"), ("route_id", "agency_id", "route_short_name", "route_long_name", "route_type"),
    ("trip_id", "route_id", "trip_headsign"), ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"),
)
_FILES = {"agency": "agencies", "stops": "stops", "routes": "routes", "trips": "trips", "stop_times": "stop_times"}
_SAYS_ANY = lambda words: "(" + " OR ".join(f"contains(txt, '{w}')" for w in words) + ")"
_BERTH, _SLEEPER = _SAYS_ANY(BERTH_WORDS), "coalesce(route_type = '105', false)"
_FEEDS |= {
    "read_gtfs_feed": " UNION ALL ".join(
        f"SELECT '{k}' AS endpoint, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5({_row(columns)}), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM {v}"
        for (k, v), columns in zip(_FILES.items(), _COLUMNS, strict=True)
    ),
    "gtfs_feed_info": "SELECT min(agency_name) AS feed_publisher_name FROM agencies",
    "classify_gtfs_trips": "SELECT *, CAST(NULL AS VARCHAR) AS train_type_ml, CAST(NULL AS DOUBLE) AS ml_night_probability FROM final",
    "gtfs_validate": " UNION ALL ".join(f"SELECT '{k}' AS file, true AS present, count(*) = 0 AS empty, count(*) > 0 AS ok FROM {v}" for k, v in _FILES.items()),
    "read_keyed_json": " UNION ALL ".join(
        f"SELECT '{name}' AS endpoint, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5({_row((*columns, 'id_from_key'))}), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM (SELECT DISTINCT {', '.join(columns)}, {key} AS id_from_key FROM {of})"
        for (of, name, key), columns in zip((("agencies", "agencies", "agency_id"), ("stops", "stops", "stop_id"), ("routes", "routes", "route_id"), ("trips", "trips", "trip_id"), ("stop_times", "trip_stop", "concat_ws('-', trip_id, stop_id, stop_sequence)")), _COLUMNS, strict=True)
    ),
    "keyed_json_validate": "SELECT *, n_agencies > 0 AND n_routes > 0 AND n_stops > 0 AND n_trips > 0 AS valid FROM (SELECT (SELECT count(*) FROM routes WHERE agency_id NOT IN (SELECT agency_id FROM agencies)) AS orphan_agencies, (SELECT count(DISTINCT stop_id) FROM stop_times WHERE stop_id NOT IN (SELECT stop_id FROM stops)) AS orphan_stops, (SELECT count(*) FROM agencies) AS n_agencies, (SELECT count(*) FROM routes) AS n_routes, (SELECT count(*) FROM stops) AS n_stops, (SELECT count(*) FROM trips) AS n_trips)",
    "ml_features": "SELECT trip_id, " + ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS f_{c}" for c in ("duration_hours", "night_percentage", "departure_hour", "arrival_hour", "overnight_flag"))
    + f", CAST({_BERTH} AS DOUBLE) AS f_has_couchette, CAST({_BERTH} OR {_SLEEPER} AS DOUBLE) AS f_has_sleeper, CAST({_SLEEPER} AS DOUBLE) AS f_is_sleeper_route, CAST({_SAYS_ANY(NIGHT_WORDS)} AS DOUBLE) AS f_has_keyword_night FROM evidence",
    "merge_summary": " UNION ALL ".join(f"SELECT '{k}' AS entity, count(*) AS sources FROM sources WHERE EXISTS (SELECT 1 FROM {v})" for k, v in (("operators", "agencies"), ("stations", "stops"), ("routes", "routes"))),
    "night_schedules_rebuild": "SELECT * FROM (SELECT CAST(substring(t.route_id, 2) AS BIGINT) AS train_id, CAST(o AS BIGINT) AS origin_id, CAST(e AS BIGINT) AS destination_id, CAST((CASE WHEN a % 86400 <= d % 86400 THEN a % 86400 - d % 86400 + 86400 ELSE a % 86400 - d % 86400 END) // 60 AS INT) AS duration_min FROM merged_ends m JOIN trips t ON m.trip_id = t.trip_id WHERE o IN (SELECT stop_id FROM stops) AND e IN (SELECT stop_id FROM stops)) WHERE origin_id <> destination_id AND duration_min > 0",
}
#: The tables with nulls planted in them.
_PLANTED = {
    "operators": f"(SELECT * REPLACE (CASE WHEN operator_id % 3 <> 0 THEN source_name END AS source_name) FROM {_CODED_OPERATORS})", "stations": f"(SELECT * REPLACE (CASE WHEN station_id % 50 <> 0 THEN name END AS name) FROM {_CODED_STATIONS})", "trains": "trains",
    "schedules": "(SELECT * REPLACE (CASE WHEN schedule_id % 7 <> 0 THEN duration_min END AS duration_min, CASE WHEN schedule_id % 11 <> 0 THEN departure_time END AS departure_time, CASE WHEN schedule_id % 13 <> 0 THEN source_name END AS source_name) FROM schedules)",
}
#: Of each table: its rows, the columns that must not be null, and whether a country is filled.
_ENTITIES = (
    ("operators", _CODED_OPERATORS, ("name",), True), ("stations", _CODED_STATIONS, ("name",), True),
    ("trains", "trains", ("train_number", "train_type"), False), ("schedules", "schedules", ("departure_time", "arrival_time", "duration_min"), False),
)


def _quality(entity: str, rows: str, strict: tuple[str, ...], country: bool) -> str:
    key = {"operators": "operator_id", "stations": "station_id", "trains": "train_id", "schedules": "schedule_id"}[entity]
    nulls = " + ".join(f"({c} IS NULL)::BIGINT" for c in strict)
    valid = _PLAIN[f"validate_{entity}"].replace(f"FROM {rows} ", f"FROM {_PLANTED[entity]} ")
    return (
        f"SELECT source_name, '{entity}' AS entity, CAST(sum(n) AS BIGINT) AS extracted, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(n * ({nulls})) AS BIGINT) AS nulls, {'count(*) FILTER (country IS NULL)' if country else '0'} AS filled, "
        f"count(*) FILTER (NOT ok) AS rejected, count(*) FILTER (ok) AS attempted, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS loaded "
        f"FROM (SELECT *, {key} IN (SELECT {key} FROM ({valid})) AS ok FROM (SELECT *, count(*) AS n FROM {_PLANTED[entity]} GROUP BY ALL)) GROUP BY source_name"
    )


_METRICS = " UNION ALL ".join(f"({_quality(*e)})" for e in _ENTITIES)
_PLAIN["quality_report_table"] = f"SELECT source_name, entity, extracted, duplicates, nulls, rejected, loaded, round_even(loaded * 100.0 / extracted, 0) AS load_rate_pct FROM ({_METRICS})"
_PLAIN["quality_summary"] = f"SELECT count(DISTINCT source_name) AS total_sources, count(*) AS total_entities, " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {n}" for c, n in (("extracted", "total_extracted"), ("duplicates", "total_duplicates_removed"), ("nulls", "total_nulls_found"), ("filled", "total_nulls_filled"), ("rejected", "total_rows_rejected"), ("loaded", "total_rows_loaded"), ("greatest(attempted - loaded, 0)", "total_rows_failed"), ("0", "total_null_violations"), ("0", "total_type_mismatches"))) + f" FROM ({_METRICS})"
_STEPS = {
    "extraction": {"rows_extracted": "extracted"}, "cleaning": {"duplicates_removed": "duplicates", "nulls_found": "nulls", "rows_after": "extracted - duplicates"},
    "transformation": {"rows_before": "extracted - duplicates", "nulls_filled": "filled", "rows_rejected": "rejected", "rows_after": "attempted"},
    "loading": {"rows_attempted": "attempted", "rows_loaded": "loaded", "rows_failed": "greatest(attempted - loaded, 0)"}, "validation": {"null_violations": "0", "type_mismatches": "0"},
}
_PLAIN["quality_metrics_record"] = " UNION ALL ".join(f"SELECT source_name, entity, '{stage}' AS stage, '{m}' AS metric, CAST({x} AS BIGINT) AS value FROM ({_METRICS})" for stage, ms in _STEPS.items() for m, x in ms.items())

#: Of each table: missing and extra columns of the lens, and those whose nulls are against the schema; written down apart from it.
_SHAPES = (
    ("operators", "source_agency_id", "operator_id", ("name",)), ("stations", "timezone", "station_id", ("name",)),
    ("trains", "classification_reason,ml_night_probability,train_type_heuristic,train_type_ml,train_type_rule", "train_id", ("operator_id", "train_number", "train_type")),
    ("schedules", "", "schedule_id", ("arrival_time", "departure_time", "destination_id", "duration_min", "origin_id", "train_id")),
)
_broken = lambda columns: "concat_ws(',', " + ", ".join(f"CASE WHEN count(*) > count({c}) THEN '{c}=' || (count(*) - count({c})) END" for c in columns) + ")"
_PLAIN["schema_report"] = " UNION ALL ".join(
    f"SELECT '{n}' AS schema_name, count(*) AS row_count, '{missing}' = '' AND {_broken(strict)} = '' AS valid, '{missing}' AS missing_columns, '{extra}' AS extra_columns, '' AS type_mismatches, {_broken(strict)} AS null_violations FROM {_PLANTED[n]}" for n, missing, extra, strict in _SHAPES
)
#: What is stored after two loads: ids are dealt by key, those of the first source before the others.
_LOADED = f"""{_FEED},
loaded_ops AS (SELECT row_number() OVER (ORDER BY name, country, source_name) AS operator_id, * FROM (SELECT trim(agency_name) AS name, 'EU' AS country, agency_url || '/2' AS website, source_name, operator_id AS merged_id FROM merged_ops)),
named_stops AS (
  SELECT source_name, source_name || '_' || stop_id AS code, stop_id, trim(stop_name) AS name, CASE pr WHEN 0 THEN 'ES' ELSE 'BE' END AS country, TRY_CAST(stop_lat AS DOUBLE) AS lat, TRY_CAST(stop_lon AS DOUBLE) AS lon FROM stops, sources),
loaded_stations AS (
  SELECT row_number() OVER (ORDER BY source_name <> 'renfe', name, country, source_name) AS station_id, * FROM (
    SELECT name, 'second' AS city, country, first(lat ORDER BY code) AS latitude, first(lon ORDER BY code) AS longitude, min(code) AS uic_code, source_name FROM named_stops GROUP BY name, country, source_name)),
loaded_trains AS (
  SELECT row_number() OVER (ORDER BY t.trip_id, o.operator_id) AS train_id, trip_id AS train_number, o.operator_id, 'day' AS train_type, route_short_name AS category, route_long_name || ' (2)' AS route_name, t.source_name, bare
  FROM merged_trains t JOIN loaded_ops o ON o.merged_id = t.operator_id),
loaded_schedules AS (
  SELECT row_number() OVER (ORDER BY train_id, origin_id, destination_id, departure_time) AS schedule_id, * FROM (
    SELECT train_id, so.station_id AS origin_id, se.station_id AS destination_id, CAST('2025-01-15' AS TIMESTAMP) + to_seconds(d) AS departure_time, CAST('2025-01-15' AS TIMESTAMP) + to_seconds(d + 60 * duration_min) AS arrival_time, duration_min, 'daily' AS frequency, r.source_name
    FROM merged_rides r JOIN loaded_trains t ON t.bare = r.trip_id AND t.source_name = r.source_name JOIN merged_ends m ON m.trip_id = r.trip_id
    JOIN named_stops a ON a.stop_id = o AND a.source_name = r.source_name JOIN loaded_stations so ON so.name = a.name AND so.country = a.country AND so.source_name = a.source_name
    JOIN named_stops b ON b.stop_id = e AND b.source_name = r.source_name JOIN loaded_stations se ON se.name = b.name AND se.country = b.country AND se.source_name = b.source_name WHERE so.station_id <> se.station_id))"""
_SUMMARY = "count(DISTINCT t.train_id) AS total_trains, count(DISTINCT CASE WHEN t.train_type = 'day' THEN t.train_id END) AS day_trains, count(DISTINCT CASE WHEN t.train_type = 'night' THEN t.train_id END) AS night_trains"
_LOADS = {
    "load_operators": "SELECT * EXCLUDE (merged_id) FROM loaded_ops", "load_stations": "SELECT * FROM loaded_stations", "load_trains": "SELECT * EXCLUDE (bare) FROM loaded_trains", "load_schedules": "SELECT * FROM loaded_schedules",
    "loaded_operator_summary": f"SELECT o.operator_id, o.name AS operator_name, o.country, {_SUMMARY}, count(s.schedule_id) AS total_schedules, round(avg(s.duration_min), 0) AS avg_duration_min, CAST(NULL AS DOUBLE) AS avg_distance_km FROM loaded_ops o LEFT JOIN loaded_trains t ON t.operator_id = o.operator_id LEFT JOIN loaded_schedules s ON s.train_id = t.train_id GROUP BY ALL",
}
_KM = "round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))), 1)"
_CHAIN = f"""{_FEED},
stored_ops AS (SELECT row_number() OVER (ORDER BY trim(agency_name)) AS operator_id, trim(agency_name) AS name, 'ES' AS country, agency_id FROM agencies),
placed AS (SELECT stop_id, trim(stop_name) AS name, lat, lon FROM (SELECT *, CASE WHEN TRY_CAST(stop_lat AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(stop_lon AS DOUBLE) BETWEEN -180 AND 180 THEN TRY_CAST(stop_lat AS DOUBLE) END AS lat, CASE WHEN coalesce(TRY_CAST(stop_lat AS DOUBLE) BETWEEN -90 AND 90, true) AND TRY_CAST(stop_lon AS DOUBLE) BETWEEN -180 AND 180 THEN TRY_CAST(stop_lon AS DOUBLE) END AS lon FROM stops)),
stored_stations AS (SELECT name, first(lat ORDER BY stop_id) AS lat, first(lon ORDER BY stop_id) AS lon FROM placed GROUP BY name),
stored_trains AS (SELECT t.trip_id AS train_id, o.operator_id, f.train_type FROM rail_trips t JOIN rail_routes r ON r.route_id = t.route_id JOIN stored_ops o ON o.agency_id = r.agency_id JOIN final f ON f.trip_id = t.trip_id),
stored_rides AS (
  SELECT t.train_id, duration_min, {_KM} AS km FROM stored_trains t JOIN merged_rides r ON r.trip_id = t.train_id AND r.source_name = 'renfe' JOIN merged_ends m ON m.trip_id = t.train_id
  JOIN placed x ON x.stop_id = o JOIN stored_stations a ON a.name = x.name JOIN placed y ON y.stop_id = e JOIN stored_stations b ON b.name = y.name WHERE a.name <> b.name)
SELECT o.operator_id, o.name AS operator_name, o.country, {_SUMMARY}, count(s.train_id) AS total_schedules, round(avg(s.duration_min), 0) AS avg_duration_min, round(avg(s.km), 0) AS avg_distance_km
FROM stored_ops o LEFT JOIN stored_trains t ON t.operator_id = o.operator_id LEFT JOIN stored_rides s ON s.train_id = t.train_id GROUP BY ALL"""
_PLAIN["quality_metrics_observed"] = _PLAIN["quality_metrics_record"]
_PLAIN |= {f"clustered_{k}": _PLAIN[k] for k in ("station_departures", "station_arrivals", "train_schedules")}
_PLAIN["bucketed_operator_summary"] = _PLAIN["v_operator_summary"]
ORACLE = {k: _sql(v) for k, v in _PLAIN.items()} | {k: _sql(v, _FEED) for k, v in _FEEDS.items()} | {k: _sql(v, _LOADED) for k, v in _LOADS.items()} | {"chain_operator_summary": f"WITH {lens.ORACLE},{_CHAIN}"}
