"""Classifier vectors, cleaning, merging, loading and reading on small hand-made tables."""

import random

import pytest

from pyspark.sql import functions as F

from slipcoach.functions import timetable as tt
from slipcoach.operators import classify, cleaning, compare, dashboard, merge, ml, observed, routes, validate, views
from slipcoach.plans import lens, schemas
from slipcoach.sources import feeds, store

CALLS = "trip_id string, stop_id string, stop_sequence string, arrival_time string, departure_time string"


def classified(spark, dep, arr, headsign="IC", route_type="2", source="db_fernverkehr"):
    calls = spark.createDataFrame([("T", "a", "9", dep, dep), ("T", "b", "10", arr, arr)], CALLS)
    trips = spark.createDataFrame([("T", "R", headsign)], "trip_id string, route_id string, trip_headsign string")
    routes = spark.createDataFrame([("R", headsign, route_type)], "route_id string, route_short_name string, route_type string")
    return classify.classify_gtfs_trips(calls, trips, routes, source, enable_ml=False).first()


def test_classifier_vectors(spark):
    night = classified(spark, "22:00:00", "30:30:00", "Nightjet", "105")
    assert (night.train_type, night.classification_method, night.night_percentage) == ("night", "rule", 82.35)
    heuristic = classified(spark, "21:30:00", "29:45:00")
    assert (heuristic.train_type, heuristic.classification_method, heuristic.night_percentage, heuristic.classification_reason) == ("night", "heuristic", 90.91, "night_share_threshold")
    day = classified(spark, "08:00:00", "09:30:00")
    assert (day.train_type, day.classification_reason, day.classification_confidence) == ("day", "explicit_day_short_service", 0.95)
    unsure = classified(spark, "18:30:00", "23:00:00")
    assert (unsure.classification_method, unsure.night_percentage, unsure.needs_manual_review) == ("default_day", 44.44, True)
    assert classified(spark, "08:00:00", "14:00:00", "Elite").train_type == "night"  # "lit" inside another word
    assert classified(spark, "22:00:00", "30:30:00", source="back_on_track").classification_reason == "explicit_night_signal"


def test_no_times_count_as_a_short_day_service(spark):
    row = classified(spark, "x", "9:30")
    assert (row.train_type, row.classification_method, row.night_percentage) == ("day", "rule", None)


def test_equal_times_are_a_whole_day(spark):
    calls = spark.createDataFrame([("T", "a", "1", "10:00:00", "10:00:00"), ("T", "b", "2", "10:00:00", "10:00:00")], CALLS)
    assert classify.trip_metrics(calls).first().duration_hours == 24.0


def test_night_share_by_the_minute(spark):
    rng = random.Random(1)
    rides = [(float(rng.randrange(2000)), float(rng.randrange(1, 2000))) for _ in range(300)]
    df = spark.createDataFrame(rides, "s double, n double").select("s", "n", tt.night_minutes(F.col("s"), F.col("n")).alias("m"))
    for s, n, m in df.collect():
        assert m == sum(not 300 <= (int(s) + k) % 1440 < 1260 for k in range(int(n)))


def test_model_support(spark):
    rows = [(f"d{k}", 1.0 + k / 20, 0.0, 9, 11, 0, None, "day") for k in range(20)] + [(f"n{k}", 8.0 + k / 20, 90.0, 22, 6, 1, None, "night") for k in range(20)] + [("x", 8.2, 88.0, 22, 6, 1, None, None)]
    trips = spark.createDataFrame(rows, "trip_id string, duration_hours double, night_percentage double, departure_hour int, arrival_hour int, overnight_flag int, train_type_rule string, train_type_heuristic string").withColumns({"metadata_text": F.lit(""), "route_type": F.lit("2")})
    out = {r.trip_id: r for r in ml.support(trips).collect()}
    assert out["x"].train_type_ml == "night" and out["x"].ml_night_probability > 0.75 and out["d3"].ml_night_probability < 0.25
    assert ml.ml_support_fit(trips.limit(25)) is None


def ladder(spark, **values):
    base = {"train_type_rule": None, "rule_reason": None, "rule_confidence": None, "train_type_heuristic": None, "heuristic_reason": "h", "heuristic_confidence": None, "train_type_ml": None, "ml_night_probability": None} | values
    kinds = "train_type_rule string, rule_reason string, rule_confidence double, train_type_heuristic string, heuristic_reason string, heuristic_confidence double, train_type_ml string, ml_night_probability double"
    row = classify.finalize_classification(spark.createDataFrame([tuple(base.values())], kinds)).first()
    return row.train_type, row.classification_method, row.classification_confidence, row.needs_manual_review


def test_ladder(spark):
    assert ladder(spark, train_type_heuristic="night", heuristic_confidence=0.85, train_type_ml="night", ml_night_probability=0.9) == ("night", "heuristic_ml_consensus", 0.9, False)
    assert ladder(spark, train_type_heuristic="night", heuristic_confidence=0.85, train_type_ml="day", ml_night_probability=0.1) == ("night", "heuristic_priority", 0.75, True)
    assert ladder(spark, train_type_heuristic="day", heuristic_confidence=0.75, train_type_ml="night", ml_night_probability=0.8) == ("night", "ml_support", 0.8, True)
    assert ladder(spark, train_type_heuristic="day", heuristic_confidence=0.75, train_type_ml="night", ml_night_probability=0.6) == ("day", "heuristic", 0.75, True)
    assert ladder(spark, train_type_ml="day", ml_night_probability=0.1) == ("day", "ml_support", 0.9, False)
    assert ladder(spark) == ("day", "default_day", 0.5, True)


def test_cleaning(spark):
    stops = spark.createDataFrame([("s1", " A ", "91", "10"), ("s1", " A ", "91", "10"), ("s2", "B", "x", "20")], "stop_id string, stop_name string, stop_lat string, stop_lon string")
    both = {r.stop_id: (r.stop_name, r.stop_lat, r.stop_lon) for r in cleaning.clean_stations(stops).collect()}
    assert both == {"s1": ("A", None, None), "s2": ("B", None, 20.0)}
    each = {r.stop_id: r.stop_lon for r in cleaning.normalize_coordinates(stops.dropDuplicates()).collect()}
    assert each["s1"] == 10.0
    clocks = spark.createDataFrame([("7:05",), ("25:30:10",), ("bad",), (None,)], "departure_time string")
    assert [r[0] for r in cleaning.normalize_clock_time(clocks).collect()] == ["07:05:00", "01:30:10", None, None]
    assert [r[0] for r in clocks.select(tt.clock_seconds("departure_time")).collect()] == [None, 91810, None, None]


def feed(spark, name="North", lon="1"):
    make = spark.createDataFrame
    return {
        "agency": make([("1", name, "https://x.example")], "agency_id string, agency_name string, agency_url string"),
        "stops": make([("a", "A", "1", lon), ("b", "B", "2", lon)], "stop_id string, stop_name string, stop_lat string, stop_lon string"),
        "routes": make([("r", "1", "IC", None, "2"), ("bus", "1", "B", None, "3")], "route_id string, agency_id string, route_short_name string, route_long_name string, route_type string"),
        "trips": make([("t", "r", "x"), ("u", "bus", "x"), ("v", "r", "x")], "trip_id string, route_id string, trip_headsign string"),
        "stop_times": make([("t", "a", "9", "22:00:00", "22:00:00"), ("t", "b", "10", "05:00:00", "05:00:00"), ("v", "a", "1", "10:00:00", "10:00:00"), ("v", "b", "2", "10:00:00", "10:00:00"), ("u", "a", "1", "1:00:00", "1:00:00")], CALLS),
    }


def merged(spark):
    two = {"renfe": merge.process_source("renfe", feed(spark), "ES", enable_ml=False), "sncb": merge.process_source("sncb", feed(spark, "South"), "BE", enable_ml=False)}
    operators, stations = merge.merge_operators(two), merge.merge_stations(two)
    trains = merge.merge_trains(two, operators)
    return operators, stations, trains, merge.merge_schedules(two, trains, stations)


def test_merge_two_sources(spark):
    operators, stations, trains, schedules = merged(spark)
    assert sorted(r.stop_id for r in stations.collect()) == ["renfe_a", "renfe_b", "sncb_a", "sncb_b"]
    assert sorted(r.station_id for r in stations.collect()) == [1, 2, 3, 4]
    assert sorted(r.trip_id for r in trains.collect()) == ["renfe_t", "renfe_v", "sncb_t", "sncb_v"]
    rides = schedules.collect()  # equal times are dropped here; 22:00 to 05:00 is seven hours and ends on the next day
    assert [(r.duration_min, str(r.arrival_time)) for r in rides] == [(420, "2025-01-16 05:00:00")] * 2
    assert merge.merge_summary({"x": feed(spark)}) == {"total_sources": 1, "operators": 1, "stations": 1, "routes": 1}


def test_operators_are_one_by_name(spark):
    two = {"renfe": feed(spark), "sncb": feed(spark)}
    operators = merge.merge_operators(two)
    assert [(r.agency_id, r.operator_id) for r in operators.collect()] == [("renfe_1", 1)]
    assert {r.source_name for r in merge.merge_trains(two, operators).collect()} == {"renfe"}


def test_loads_are_idempotent(spark, tmp_path):
    tables = dict(zip(schemas.SCHEMAS, merged(spark), strict=True))
    for _ in range(2):
        counts = [store.load(name, df, f"file://{tmp_path}/{name}").count() for name, df in tables.items()]
        assert counts == [2, 4, 4, 2]


def test_upsert_with_null_keys(spark):
    kinds = "k string, v int, w int"
    old, new = spark.createDataFrame([(None, 1, 1), ("a", 1, 1)], kinds), spark.createDataFrame([(None, 2, 2), ("b", 2, 2)], kinds)
    rows = sorted(map(tuple, store.upserted(old, new, ["k"], ["v"]).collect()), key=str)
    assert rows == sorted([(None, 2, 1), ("a", 1, 1), ("b", 2, 2)], key=str)
    assert sorted(map(tuple, store.upserted(old, new, ["k"]).collect()), key=str) == sorted([(None, 1, 1), ("a", 1, 1), ("b", 2, 2)], key=str)


def test_gtfs_files(spark, tmp_path):
    (tmp_path / "stops.txt").write_bytes(b'stop_id,stop_name  ,stop_lat,junk \r\na:1,"NA, x",,1\r\n')
    (tmp_path / "trips.txt").write_text("trip_id,route_id\n")
    (tmp_path / "feed_info.txt").write_text("feed_publisher_name\nme\n")
    got = feeds.read_gtfs_feed(spark, str(tmp_path), "x")
    assert set(got) == {"stops", "trips"} and got["stops"].columns == ["stop_id", "stop_name", "stop_lat"]
    assert tuple(got["stops"].first()) == ("a:1", "NA, x", None)
    report = {r.file: (r.present, r.ok) for r in feeds.gtfs_validate(spark, got).collect()}
    assert report["stops"] == (True, True) and report["trips"] == (True, False) and report["agency"] == (False, False)
    assert feeds.gtfs_feed_info(feeds.read_gtfs_feed(spark, str(tmp_path), "x", include_optional_files=True)).first()[0] == "me"


def test_keyed_json(spark, tmp_path):
    (tmp_path / "calendar.json").write_text('{"1": {"service_id": "1", "monday": 1, "x": ""}, "2": {"service_id": "2", "monday": 1.0}}')
    rows = {r.id_from_key: (r.service_id, r.monday, r.x) for r in feeds.read_keyed_json(spark, str(tmp_path))["calendar"].collect()}
    assert rows == {"1": ("1", "1", ""), "2": ("2", "1.0", None)}


def test_validation(spark):
    rows = [(1, 1, 2, 2880, "x", "y"), (1, 1, 1, 10, "x", "y"), (0, None, 2, 10, None, "y"), (1, 1, 2, 2879, "x", "y")]
    df = spark.createDataFrame(rows, "train_id long, origin_id long, destination_id long, duration_min long, departure_time string, arrival_time string")
    good, bad = validate.validate_schedules(df)
    assert good.count() == 1 and bad.count() == 3
    assert {r.reason: r.rows for r in validate.rejection_reasons(df, "schedules").collect()} == {"durée invalide": 1, "origine = destination": 1, "train_id invalide": 1, "origin_id invalide": 1, "departure_time manquant": 1}
    report = validate.schema_report(df, "schedules").first()
    assert not report.valid and report.missing_columns == ["distance_km", "frequency", "source_name"] and report.null_violations == {"origin_id": 1, "departure_time": 1}


def test_dashboard_rows_without_keys(spark):
    kinds = "train_id long, operator string, operator_country string, website string, train_type_normalized string, departure_station string, arrival_station string, duration_min long, distance_km double, co2_saving_kg double"
    df = spark.createDataFrame([(1, "o", "FR", None, "day", "A", "10:30", 10, None, None), (2, "o", "FR", "w", "night", "A", "B", 400, 600.0, 126.0)], kinds)
    assert dashboard.operator_summary(df).count() == 1
    assert dashboard.routes_df(df).count() == 1
    assert [r.segment for r in dashboard.distance_segments(df).filter("night > 0").collect()] == ["600-800"]
    assert dashboard.distance_segments(df).count() == 6
    empty = df.limit(0)
    assert tuple(dashboard.overview_kpis(empty).first()) == (0, 0, 0, 0) and dashboard.total_co2(empty).first()[0] == 0.0


def test_plans_hold_no_python_and_no_single_task_window(spark):
    from slipcoach.plans import lens

    t = lens.canonical(spark, "/root/testdata/sf0.001")
    f = lens.feed(spark, "/root/testdata/sf0.001")
    for df in (dashboard.top_operators_by_type(dashboard.analytics_base(t)), classify.classify_gtfs_trips(f["stop_times"], f["trips"], f["routes"], enable_ml=False)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "SinglePartition" not in plan.split("Window")[0]


def test_merge_summary_table_counts_sources_with_rows(spark):
    full, empty = spark.createDataFrame([("a",)], "stop_id string"), spark.createDataFrame([], "stop_id string")
    found = merge.merge_summary_table({"x": {"stops": full, "agency": full}, "y": {"stops": empty, "agencies": full}})
    assert {r.entity: r.sources for r in found.collect()} == {"stations": 1, "operators": 2}


def test_upsert_touches_only_what_the_batch_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").withColumn("updated_at", F.lit("2000-01-01").cast("timestamp"))
    store.write_canonical_upsert(rows, str(tmp_path), conflict_columns=["id"], update_columns=["v"])
    out = store.write_canonical_upsert(rows.filter("id = 2"), str(tmp_path), conflict_columns=["id"], update_columns=["v"])
    assert {r.id: r.updated_at.year > 2000 for r in out.collect()} == {1: False, 2: True}


def test_pages_have_bounds(spark):
    from slipcoach.operators import views
    from slipcoach.plans import lens

    t = lens.canonical(spark, "/root/testdata/sf0.001")
    bad = [
        lambda: views.list_trains(t, limit=0), lambda: views.list_trains(t, limit=1001), lambda: views.list_schedules(t, offset=-1), lambda: views.list_stations(t, limit=1001), lambda: views.list_operators(t, limit=-5),
        lambda: views.top_routes(t, limit=51), lambda: views.station_departures(t, 1, limit=501), lambda: views.train_schedules(t, 1, limit=1001),
    ]
    for make in bad:
        with pytest.raises(ValueError):
            make()
    assert views.list_trains(t, limit=1000).count() <= 1000 and views.top_routes(t, limit=50).count() <= 50
    assert views.list_trains(t, limit=None).count() == t.trains.count()


def test_parameters_of_listings_find_rows():
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    for name in ("day_night_comparison", "list_trains", "list_schedules", "list_stations", "apply_dashboard_filters", "filter_by_country", "search_schedules", "validate_operators", "validate_stations"):
        assert con.execute(f"SELECT count(*) FROM ({entry.oracle_sql()[name]})").fetchone()[0] > 0, name


def test_cells_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\\d\n', 2.0, True), (2, None, 2.5, None)], "k long, t string, x double, b boolean")
    feeds.export_csv(df.coalesce(1), str(tmp_path / "out"), quote_json=True)
    lines = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")).splitlines()
    assert lines == ["k,t,x,b", '1,"a \\"b\\", c\\\\d\\n",2,true', '2,"",2.5,""']


def test_keyed_json_in_many_files(spark, tmp_path):
    for part, text in (("a", '{"1": {"trip_id": "1"}}'), ("b/c", '{"2": {"trip_id": "2"}, "3": {}}')):
        (tmp_path / "trips.json" / part).mkdir(parents=True)
        (tmp_path / "trips.json" / part / "part-0.txt").write_text(text)
    assert sorted(r.id_from_key for r in feeds.read_keyed_json(spark, str(tmp_path))["trips"].collect()) == ["1", "2", "3"]


def test_quality_record_has_five_stages(spark):
    rows = [("a", "FR", "s"), ("a", "FR", "s"), ("b", "FRA", "s"), ("c", None, "s"), ("d", "DE", "t")]
    df = spark.createDataFrame(rows, "name string, country string, source_name string")
    record = validate.quality_metrics_record({"operators": df}, {"operators": validate.validate(df.dropDuplicates(), "operators")[0]})
    got = {(r.source_name, r.stage, r.metric): r.value for r in record.collect()}
    assert {k[1] for k in got} == {"extraction", "cleaning", "transformation", "loading", "validation"}
    want = {"rows_extracted": 4, "duplicates_removed": 1, "nulls_filled": 1, "rows_rejected": 1, "rows_attempted": 2, "rows_loaded": 2, "rows_failed": 0, "null_violations": 0, "type_mismatches": 0}
    assert {k: next(v for (s, _, m), v in got.items() if s == "s" and m == k) for k in want} == want
    assert validate.quality_summary(record).first().total_rows_loaded == 3


def test_validation_rows_are_dealt_by_class(spark):
    rows = [(k, 1, "night" if k % 10 == 0 else "day") for k in range(2000)]
    trains = spark.createDataFrame(rows, "train_id long, operator_id long, train_type string").withColumn("category", F.lit("x"))
    rides = trains.select("train_id", F.lit(1).alias("origin_id"), F.lit(2).alias("destination_id"), F.lit("2025-01-01 22:00:00").cast("timestamp_ntz").alias("departure_time"), (F.col("train_id") % 700 + 20).alias("duration_min"), F.lit(100.0).alias("distance_km"))
    _, metrics, _ = ml.ml_validate(schemas.Tables(None, None, trains, rides), trees=3)
    support = {r.train_type: r.support for r in metrics.collect()}
    assert abs(support["day"] - 360) <= 4 and abs(support["night"] - 40) <= 2


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from slipcoach.plans import shared

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://far:7077")
    with pytest.raises(ValueError):
        shared.folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_the_lens_and_the_ladder_give_the_counts_found_by_hand(spark):
    """Counts taken from the tables by separate SQL when the lens was drawn up; no constant of the package goes into them."""
    from slipcoach.operators import views
    from slipcoach.plans import lens

    t = lens.canonical(spark, "/root/testdata/sf0.01")
    assert {r.table_name: r.rows for r in views.table_counts(t).collect()} == {"operators": 100, "stations": 1500, "trains": 2000, "schedules": 60000}
    assert t.schedules.filter("origin_id = destination_id").count() == 41
    assert t.schedules.join(t.stations, t.schedules.destination_id == t.stations.station_id, "left_anti").count() == 47
    f = lens.feed(spark, "/root/testdata/sf0.01")
    trips = classify.classify_gtfs_trips(f["stop_times"], cleaning.filter_rail_trips(f["trips"], cleaning.filter_rail_routes(f["routes"])), f["routes"], enable_ml=False)
    found = {(r.classification_method, r.train_type): r["count"] for r in trips.filter("night_percentage is not null").groupBy("classification_method", "train_type").count().collect()}  # trips with calls
    assert found == {("rule", "night"): 959, ("rule", "day"): 1685, ("heuristic", "night"): 2748, ("heuristic", "day"): 2313, ("default_day", "day"): 6295}


def test_fixed_values_as_they_are_published():
    assert schemas.RAIL_TYPES[2] == "Rail" and schemas.RAIL_TYPES[105] == "Sleeper Rail" and len(schemas.RAIL_TYPES) == 19 and schemas.OTHER_TYPES[3] == "Bus"
    assert (schemas.CO2_TRAIN, schemas.CO2_PLANE, schemas.SLEEPER_TYPE, schemas.REFERENCE_DATE) == (0.005, 0.215, 105, "2025-01-15")
    assert [b[2] for b in schemas.BINS] == ["0-200", "200-400", "400-600", "600-800", "800-1200", "1200+"] and {"nightjet", "couchette", "lit"} <= set(schemas.NIGHT_WORDS)
    assert schemas.SCHEMAS["stations"]["latitude"].dataType.simpleString() == "decimal(10,8)" and not schemas.SCHEMAS["trains"]["train_type"].nullable


def test_columns_that_must_not_be_null():
    """Written down apart from the schemas."""
    strict = {name: [f.name for f in fields if not f.nullable] for name, fields in schemas.SCHEMAS.items()}
    assert strict == {
        "operators": ["operator_id", "name"], "stations": ["station_id", "name"], "trains": ["train_id", "train_number", "operator_id", "train_type"],
        "schedules": ["schedule_id", "train_id", "origin_id", "destination_id", "departure_time", "arrival_time", "duration_min"],
    }
    assert schemas.SCHEMAS["trains"]["train_number"].metadata["role"] == "source_id"


def test_route_figures_by_ids_are_those_by_names(spark):
    t = lens.canonical(spark, "/root/testdata/sf0.001")
    # stations that share names, that have none or a clock for a name, and that are not there
    odd = F.when(F.col("station_id") % 7 == 0, "twin").when(F.col("station_id") % 11 == 0, " twin ").when(F.col("station_id") % 13 == 0, "12:30").when(F.col("station_id") % 17 != 0, F.col("name"))
    t = t._replace(stations=t.stations.withColumn("name", odd).filter("station_id % 19 <> 0"), trains=t.trains.withColumn("operator_id", F.when(F.col("train_id") % 5 == 0, -1).otherwise(F.col("operator_id"))))
    base = dashboard.analytics_base(t)
    shown = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in (r[c] for c in sorted(df.columns))]) for r in df.collect())
    for name, more in (("network_kpis", {}), ("od_coverage", {}), ("overview_kpis", {}), ("top_links", {"limit": 400}), ("night_corridors", {"limit": 400}), ("night_shift_candidates", {"limit": 4000})):
        by_id, by_name = getattr(routes, name)(t, **more), getattr(dashboard, name)(base, **more)
        assert shown(by_id) == shown(by_name.select(by_id.columns)), name


def test_no_fact_row_is_expanded_and_names_come_last(spark):
    t = lens.canonical(spark, "/root/testdata/sf0.001")
    base = dashboard.analytics_base(t)
    plans = {f.__name__: f(t) for f in (routes.network_kpis, routes.od_coverage, routes.overview_kpis, routes.top_links, routes.night_corridors, views.v_country_stats, views.stats_by_country)}
    plans |= {f.__name__: f(base) for f in (dashboard.top_operators_summary, dashboard.operator_summary)}
    for name, df in plans.items():
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Expand" not in text and "Generate" not in text, name
    # the sums by station are under the names: the first join with a name stands above the first aggregate
    lines = plans["network_kpis"]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    sums = next(k for k, x in enumerate(lines) if "Aggregate [origin_id" in x)
    assert not any("c_name" in x and "Relation" not in x for x in lines[sums + 1 : next((k for k in range(sums + 1, len(lines)) if depth(lines[k]) <= depth(lines[sums])), len(lines))])


def test_quality_figures_on_the_way(spark):
    rows = [(1, "A", "FR", "x"), (1, "A", "FR", "x"), (2, None, "FR", "x"), (3, "B", "long", "y"), (4, "C", None, None), (5, " ", "FR", "y")]
    operators = spark.createDataFrame(rows, "operator_id long, name string, country string, source_name string")
    stored, record = observed.process({"operators": operators}, ["x", "y", "z", None])
    assert sorted(r.operator_id for r in stored["operators"].collect()) == [1, 4]
    got = {(r.source_name, r.stage, r.metric): r.value for r in record.collect()}
    assert {r[0] for r in got} == {"x", "y", None} and len(got) == 3 * 13
    of = lambda s, *names: [got[s, *n.split(".")] for n in names]
    assert of("x", "extraction.rows_extracted", "cleaning.duplicates_removed", "cleaning.nulls_found", "transformation.rows_rejected", "loading.rows_loaded") == [3, 1, 1, 1, 1]
    assert of("y", "extraction.rows_extracted", "transformation.rows_rejected", "loading.rows_loaded") == [2, 2, 0] and of(None, "transformation.nulls_filled", "loading.rows_loaded") == [1, 1]
    by_hand = validate.quality_metrics_record({"operators": operators}, {"operators": stored["operators"]})
    assert got == {(r.source_name, r.stage, r.metric): r.value for r in by_hand.collect()}
    with pytest.raises(ValueError):
        observed.process({"operators": operators}, ["x", None])


def test_observed_tables_are_read_once(spark, tmp_path):
    spark.range(10).selectExpr("id AS operator_id", "'n' AS name", "'s' AS source_name").write.parquet(f"{tmp_path}/o")
    plan = observed._flow(spark.read.parquet(f"{tmp_path}/o"), "operators", observed._Steps(["s"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("CollectMetrics") == 3


def test_clocks_of_rides_are_read_once_a_trip(spark):
    """Above the aggregate of the calls a filter on the minutes took a copy of each clock's parser for each place it is used in."""
    two = {"renfe": feed(spark), "sncb": feed(spark, "South")}
    trains = spark.createDataFrame([(1, "renfe_t"), (2, "sncb_t")], "train_id long, trip_id string")
    stations = spark.createDataFrame([(1, "renfe_a"), (2, "renfe_b"), (3, "sncb_a"), (4, "sncb_b")], "station_id long, stop_id string")
    rides = merge.merge_schedules(two, trains, stations)
    assert sorted((r.train_id, r.origin_id, r.destination_id, r.duration_min) for r in rides.collect()) == [(1, 1, 2, 420), (2, 3, 4, 420)]
    assert rides._jdf.queryExecution().optimizedPlan().toString().count("[0-5]?\\d$)") == 2


def test_clocks_that_are_numbers_or_timestamps(spark):
    calls = [("t", "a", "1", "600", "600"), ("t", "b", "2", "4200", "4200"), ("u", "a", "1", "2025-01-01T22:00:00", "2025-01-01T22:00:00"), ("u", "b", "2", "23:30:00", "23:30:00"), ("v", "a", "1", "x", "x"), ("v", "b", "2", "10:00:00", "10:00:00")]
    trains = spark.createDataFrame([(1, "renfe_t"), (2, "renfe_u"), (3, "renfe_v")], "train_id long, trip_id string")
    stations = spark.createDataFrame([(1, "renfe_a"), (2, "renfe_b")], "station_id long, stop_id string")
    rides = merge.merge_schedules({"renfe": {"stop_times": spark.createDataFrame(calls, CALLS)}}, trains, stations)
    assert sorted((r.train_id, r.duration_min) for r in rides.collect()) == [(1, 60), (2, 90)]


def test_comparisons_in_one_table_are_those_by_themselves(spark):
    t = lens.canonical(spark, "/root/testdata/sf0.001")
    # trains of no operator, without rides and without a type, stations that are not there, rides that have no station
    t = t._replace(
        trains=t.trains.withColumns({"operator_id": F.when(F.col("train_id") % 5 == 0, -1).otherwise(F.col("operator_id")), "train_type": F.when(F.col("train_id") % 7 != 0, F.col("train_type"))}),
        stations=t.stations.filter("station_id % 19 <> 0").withColumn("country", F.when(F.col("station_id") % 11 != 0, F.col("country"))),
        schedules=t.schedules.filter("train_id % 3 <> 0").withColumns({"origin_id": F.when(F.col("schedule_id") % 13 != 0, F.col("origin_id")), "duration_min": F.when(F.col("schedule_id") % 17 != 0, F.col("duration_min"))}),
    )
    shown = lambda df: [str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect()]
    alone = {"basic_counts": compare.cmp_basic_counts, "frequency": compare.cmp_frequency, "distance": compare.cmp_distance_segment, "international": compare.cmp_international, "connectivity": compare.cmp_connectivity}
    for name, df in compare.cmp_all(t).items():
        assert df.columns == alone[name](t).columns and shown(df) == shown(alone[name](t)), name
        assert "lineitem" not in df._jdf.queryExecution().optimizedPlan().toString() and "l_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString(), name


def test_a_forest_on_groups_is_one_on_rows(spark):
    """The fit reads a row a group, and its draws add up to the rows of a bootstrap."""
    rows = [("night" if k % 3 == 0 else "day", 600 if k % 3 == 0 else 60 + k % 5, 22 if k % 3 == 0 else 9, 0) for k in range(3000)] + [("day", 600, 22, 0)] * 200
    trips = spark.createDataFrame(rows, "train_type string, duration_min int, departure_hour int, has_couchette int")
    by = trips.columns
    groups = trips.groupBy(*by).agg(F.count("*").alias("n"))
    assert groups.count() == 7
    model = ml.forest(groups, by, 5, 42)
    assert len(model.trees) == 5 and abs(sum(model.featureImportances) - 1) < 1e-9
    out = model.transform(ml._simple(groups))
    assert {(r.train_type, r.duration_min): r.prediction for r in out.collect()} == {("night", 600): 1.0, ("day", 600): 1.0} | {("day", 60 + k): 0.0 for k in range(5)}
    again = ml.forest(groups.repartition(3), by, 5, 42)
    assert [m.featureImportances for m in again.trees] == [m.featureImportances for m in model.trees]


def test_model_support_reads_its_evidence_once(spark):
    f = lens.feed(spark, "/root/testdata/sf0.001")
    out = ml.support(classify.evidence(f["stop_times"], f["trips"], f["routes"]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and out.count() == f["trips"].count()


def test_known_night_trains_by_a_forest_on_groups(spark):
    trains = spark.range(300).select(F.col("id").alias("train_id"), F.lit(1).alias("operator_id"), F.when(F.col("id") % 3 == 0, "night").otherwise("day").alias("train_type"), F.lit("couchette").alias("category"), F.when(F.col("id") % 6 == 0, "back_on_track").otherwise("x").alias("source_name"))
    night = F.col("train_id") % 3 == 0
    rides = trains.select("train_id", F.when(night, F.lit("2025-01-01 22:00:00")).otherwise(F.lit("2025-01-01 09:00:00")).cast("timestamp_ntz").alias("departure_time"), F.when(night, 480).otherwise(60).alias("duration_min"), F.lit(100.0).alias("distance_km"))
    t = schemas.Tables(None, None, trains, rides)
    model = ml.ml_validate(t, trees=3)[0]
    assert isinstance(model, ml.Forest) and tuple(ml.ml_validate_known_night(t, model).first()) == (50, 50, 100.0)
