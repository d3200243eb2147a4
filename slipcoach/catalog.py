"""Registered queries over the lens, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipcoach.functions import timetable as tt
from slipcoach.operators import classify, cleaning, compare, dashboard, geo, merge, ml, observed, routes, validate, views
from slipcoach.oracles import ORACLE
from slipcoach.plans import chain, lens, schemas
from slipcoach.plans.shared import place, remove, save
from slipcoach.sources import bucketed, feeds, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _register(name: str, make: Callable[[schemas.Tables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(lens.canonical(spark, sf_dir))


_PLAIN = (
    "v_operator_summary v_country_stats v_schedules_detailed v_day_night_comparison count_trains_by_type count_trains_by_country count_stations_by_country "
    "count_operators_by_country summary stats_by_country v_data_quality missing_values map_countries map_stations table_counts"
).split()
for _name in _PLAIN:
    _register(_name, getattr(views, _name))
for _name in "cmp_basic_counts cmp_frequency cmp_distance_segment cmp_international cmp_connectivity".split():
    _register(_name, getattr(compare, _name))
_register("cmp_all", compare.cmp_table)
_BASE = (
    "overview_kpis train_type_counts country_train_counts top_operators_summary day_night_country_summary operator_summary network_kpis od_coverage service_km "
    "top_operators_by_type country_breakdown long_distance_kpis distance_segments long_distance_co2 night_corridors night_shift_candidates total_co2 "
    "classification_summary segment_type_counts segment_night_share day_night_pair trains_by_country_top10 operators_top10 top_links filter_options"
).split()
for _name in _BASE:
    _register(_name, lambda t, f=getattr(dashboard, _name): f(dashboard.analytics_base(t)))


def _rounded(make: Callable[[DataFrame], DataFrame], *columns: str) -> Callable[[schemas.Tables], DataFrame]:
    """Sums of fractions depend on their order in the last digits."""
    return lambda t: make(dashboard.analytics_base(t)).withColumns({c: F.round(c, 4) for c in columns})


_register("total_co2", _rounded(dashboard.total_co2, "total_co2_kg"))
_register("long_distance_co2", _rounded(dashboard.long_distance_co2, "avg_co2", "total_co2"))
for _name in "overview_kpis network_kpis od_coverage top_links".split():
    _register(_name, getattr(routes, _name))
_register("night_corridors", lambda t: routes.night_corridors(t).withColumns({c: F.round(c, 4) for c in ("avg_co2", "avg_distance")}))
_register("night_shift_candidates", lambda t: routes.night_shift_candidates(t).withColumns({c: F.round(c, 4) for c in ("avg_co2", "avg_dist")}))
_register("classification_summary", _rounded(dashboard.classification_summary, "mean_confidence"))
_register("segment_night_share", _rounded(dashboard.segment_night_share, "night_pct"))
_register("distance_segments", _rounded(dashboard.distance_segments, "night_pct"))
_register("day_night_comparison", lambda t: views.day_night_comparison(t, country="NATION_11"))
_register("data_quality", views.data_quality)
_register("list_trains", lambda t: views.list_trains(t, train_type="night", category="STANDARD", limit=50, offset=5))
_register("train_detail", lambda t: views.train_detail(t, 3).select("train_id", "train_number", "operator_name", "country", "train_type", F.col("classification.classification_method").alias("method")))
_register("train_schedules", lambda t: views.train_schedules(t, 8))
_register("list_schedules", lambda t: views.list_schedules(t, origin="build", country="NATION_7", limit=40, offset=2))
_register("search_schedules", lambda t: views.search_schedules(t, "machin", "AUTO", train_type="night"))
_register("schedule_detail", lambda t: views.schedule_detail(t, t.schedules.agg(F.min("schedule_id")).first()[0]))
_register("list_stations", lambda t: views.list_stations(t, country="NATION_4", city="FURN", limit=60))
_register("station_detail", lambda t: views.station_detail(t, 12))
_register("station_departures", lambda t: views.station_departures(t, 12, "day"))
_register("station_arrivals", lambda t: views.station_arrivals(t, 12))
_register("list_operators", lambda t: views.list_operators(t, name="supplier#0000000", limit=30))
_register("operator_detail", lambda t: views.operator_detail(t, 4))
_register("operator_trains", lambda t: views.operator_trains(t, 4, "day", limit=20))
_register("top_routes", lambda t: views.top_routes(t, limit=20))
_register("analytics_base", lambda t: dashboard.analytics_base(t).select("train_id", "operator", "operator_country", dashboard.TYPE, "departure_station", "arrival_station", "departure_time", "arrival_time", "duration_min", F.round("duration_hours", 6).alias("duration_hours"), "distance_km", F.round("co2_saving_kg", 6).alias("co2")))
_register("routes_df", lambda t: dashboard.routes_df(dashboard.analytics_base(t)).groupBy("route").agg(F.count("*").alias("rows")))
_register("long_distance_base", lambda t: dashboard.long_distance_base(dashboard.analytics_base(t)).select("train_id", "departure_station", "arrival_station", "distance_km", "duration_min"))
_register("apply_dashboard_filters", lambda t: dashboard.apply_dashboard_filters(dashboard.analytics_base(t), "NATION_11", "Nuit", 100, 900).groupBy("train_id").agg(F.count("*").alias("rows")))
_register("filter_zero_or_range", lambda t: dashboard.filter_zero_or_range(dashboard.analytics_base(t), 200, 700).groupBy("train_id").agg(F.count("*").alias("rows")))
_register("filter_by_country", lambda t: dashboard.filter_by_country(dashboard.analytics_base(t), "NATION_11").groupBy("train_id").agg(F.count("*").alias("rows")))
_register("front_day_night_counts", lambda t: dashboard.front_day_night_counts(t.trains))
_register("fill_distances", lambda t: geo.fill_distances(t.schedules, t.stations).select("schedule_id", "origin_id", "destination_id", "distance_km"))
_register("haversine_km", lambda t: t.stations.select("station_id", F.round(tt.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(48.85), F.lit(2.35)), 3).alias("km")))
_register("co2_columns", lambda t: tt.with_co2(t.schedules).select("schedule_id", F.round("co2_emission_kg", 6).alias("emitted"), F.round("co2_saving_kg", 6).alias("saved")))
_register("classify_train_type_sql", lambda t: t.schedules.select("schedule_id", tt.train_type_of(F.hour("departure_time")).alias("train_type")))
_register("calculate_duration_sql", lambda t: t.schedules.select("schedule_id", tt.duration_minutes("departure_time", "arrival_time").alias("minutes")))
_register("ml_dataset", lambda t: ml.ml_dataset(t).groupBy("train_type", "departure_hour", "has_couchette").agg(F.count("*").alias("rows"), F.sum("duration_min").alias("minutes")))
_register("night_pct_hourly", lambda t: ml.night_pct_hourly(ml.ml_dataset(t)).select("train_id", "departure_hour", "duration_min", F.round("night_percentage", 6).alias("night_percentage")))
_VALID = {
    "operators": ("operator_id", "name", "country"), "stations": ("station_id", "name", "country", "latitude", "longitude"),
    "trains": ("train_id", "train_number", "operator_id", "train_type"), "schedules": ("schedule_id", "train_id", "origin_id", "destination_id", "duration_min"),
}


def _coded(t: schemas.Tables) -> schemas.Tables:
    """Countries as codes, good and bad ones and none; what is checked of a country needs all three."""
    code = lambda c: F.when(F.col(c) % 4 == 0, "FR").when(F.col(c) % 4 == 1, "ESP").when(F.col(c) % 4 == 2, F.col("country"))
    return t._replace(operators=t.operators.withColumn("country", code("operator_id")), stations=t.stations.withColumn("country", code("station_id")))


for _table in schemas.SCHEMAS:
    _register(f"validate_{_table}", lambda t, n=_table: getattr(validate, f"validate_{n}")(getattr(_coded(t), n))[0].select(*_VALID[n]))
_register("rejection_reasons", lambda t: validate.rejection_reasons(t.schedules, "schedules"))
_register("split_valid_rejected", lambda t: validate.validate(t.schedules, "schedules")[1].select("schedule_id", F.array_join("reasons", "|").alias("reasons")))
_register("validate_all", lambda t: views.table_counts(validate.validate_all(_coded(t))))


def _planted(t: schemas.Tables) -> schemas.Tables:
    """Nulls in columns that may be null and in some that may not."""
    none = lambda c, by, n: F.when(F.col(by) % n != 0, F.col(c)).alias(c)
    return t._replace(
        operators=t.operators.withColumn("source_name", none("source_name", "operator_id", 3)), stations=t.stations.withColumn("name", none("name", "station_id", 50)),
        schedules=t.schedules.withColumns({"duration_min": none("duration_min", "schedule_id", 7), "departure_time": none("departure_time", "schedule_id", 11), "source_name": none("source_name", "schedule_id", 13)}),
    )


def _reports(t: schemas.Tables) -> DataFrame:
    each = [validate.schema_report(df, name) for name, df in _planted(t)._asdict().items()]
    joined = lambda c: F.array_join(c, ",").alias(c)
    broken = F.array_join(F.transform(F.array_sort(F.map_entries("null_violations")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("null_violations")
    return each[0].union(each[1]).union(each[2]).union(each[3]).select("schema_name", "row_count", "valid", *(joined(c) for c in ("missing_columns", "extra_columns", "type_mismatches")), broken)


_register("schema_report", _reports)


def _metrics(t: schemas.Tables) -> DataFrame:
    tables = _planted(_coded(t))._asdict()
    return validate.quality_metrics_record(tables, {k: validate.validate(v, k)[0] for k, v in tables.items()})


_register("quality_metrics_record", _metrics)
_register("quality_metrics_observed", lambda t: observed.process(_planted(_coded(t))._asdict(), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "tpch", None])[1])
_register("quality_summary", lambda t: validate.quality_summary(_metrics(t)))
_register("quality_report_table", lambda t: validate.quality_report_table(_metrics(t)))


def _ml_validate(t: schemas.Tables) -> DataFrame:
    return ml.ml_validate(t)[1].select("train_type", "support", F.round("recall", 6).alias("recall"))


_register("ml_validate", _ml_validate)


def _known_night(t: schemas.Tables) -> DataFrame:
    """A third of the night trains are those of the night catalogue; the model is grown on all trains."""
    night = F.when((F.col("train_type") == "night") & (F.col("train_id") % 3 == 0), classify.NIGHT_SOURCE).otherwise(F.col("source_name"))
    return ml.ml_validate_known_night(t._replace(trains=t.trains.withColumn("source_name", night)), ml.ml_validate(t)[0])


_register("ml_validate_known_night", _known_night)


# ---- feed-shaped tables


def _feed(name: str, make: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(lens.feed(spark, sf_dir))


_feed("dedup_keep_first", lambda f: cleaning.dedup_keep_first(f["stop_times"], ["trip_id", "stop_sequence"], ["stop_id"]).select("trip_id", "stop_sequence", "stop_id"))
_feed("drop_missing_required", lambda f: cleaning.drop_missing_required(f["routes"], ["route_id", "route_long_name"]))
_feed("missing_required", lambda f: cleaning.missing_required(f["routes"], ["route_id", "route_long_name"]))
_feed("clean_stations", lambda f: cleaning.clean_stations(f["stops"]))
_feed("clean_routes", lambda f: cleaning.clean_routes(f["routes"]))
_feed("clean_stop_times", lambda f: cleaning.clean_stop_times(f["stop_times"]).select("trip_id", "stop_id", "stop_sequence", "departure_time", "arrival_time"))
_feed("cleaning_stats", lambda f: cleaning.cleaning_stats(f["routes"], cleaning.drop_missing_required(f["routes"], ["route_long_name"]), ["route_long_name"]))
_feed("normalize_station_codes", lambda f: cleaning.normalize_station_codes(f["stops"].select(F.col("stop_name").alias("stop_id"))))
_feed("normalize_clock_time", lambda f: cleaning.normalize_clock_time(f["stop_times"].select("trip_id", "stop_id", "stop_sequence", "departure_time")))
_feed("normalize_stop_times", lambda f: cleaning.normalize_stop_times(f["stop_times"]).select("trip_id", "stop_id", "stop_sequence", "departure_time", "arrival_time"))
_feed("add_country_code", lambda f: cleaning.add_country_code(f["agency"], "FR"))
_feed("normalize_coordinates", lambda f: cleaning.normalize_coordinates(f["stops"]))
_feed("standardize_route_types", lambda f: cleaning.standardize_route_types(f["routes"]).select("route_id", "route_type", "route_type_label"))
_feed("filter_rail_routes", lambda f: cleaning.filter_rail_routes(f["routes"]).select("route_id", "route_type"))
_feed("removed_route_types", lambda f: cleaning.removed_route_types(f["routes"]))
_feed("filter_rail_trips", lambda f: cleaning.filter_rail_trips(f["trips"], cleaning.filter_rail_routes(f["routes"])))
_feed("filter_rail_stop_times", lambda f: cleaning.filter_rail_stop_times(f["stop_times"], cleaning.filter_rail_trips(f["trips"], cleaning.filter_rail_routes(f["routes"]))).select("trip_id", "stop_id", "stop_sequence", "departure_time"))
_feed("country_timezone", lambda f: cleaning.country_timezone(f["agency"].withColumn("country", F.when(F.col("agency_id") == "A1", "FR").otherwise("XX"))).select("agency_id", "timezone"))
_feed("trip_endpoints", lambda f: classify.trip_endpoints(f["stop_times"]))
_feed("trip_metrics", lambda f: classify.trip_metrics(f["stop_times"]))
_feed("night_percentage", lambda f: classify.trip_metrics(f["stop_times"]).select("trip_id", "night_percentage"))
_feed("classify_simple_hour", lambda f: classify.trip_metrics(f["stop_times"]).select("trip_id", tt.day_or_night(F.col("departure_hour")).alias("train_type")))
_feed("classify_from_clock", lambda f: classify.classify_from_clock(f["stop_times"].select("trip_id", "stop_id", "stop_sequence", "departure_time")))
_feed("metadata_text", lambda f: schemas.with_missing(f["trips"].join(f["routes"], "route_id"), *classify.TEXTS).select("trip_id", classify.metadata_text().alias("metadata_text")))
_feed("rule_engine", lambda f: _evidence(f).select("trip_id", "train_type_rule", "rule_reason", "rule_confidence"))
_feed("heuristic_engine", lambda f: _evidence(f).select("trip_id", "train_type_heuristic", "heuristic_reason", "heuristic_confidence"))
_feed("finalize_classification", lambda f: classify.classify_gtfs_trips(f["stop_times"], f["trips"], f["routes"], enable_ml=False).drop("train_type_ml", "ml_night_probability"))
_feed("classification_stats", lambda f: classify.classification_stats(classify.classify_gtfs_trips(f["stop_times"], f["trips"], f["routes"], enable_ml=False)))
_feed("classify_gtfs_trips", lambda f: classify.classify_gtfs_trips(f["stop_times"], f["trips"], f["routes"], enable_ml=False))
_feed("classify_gtfs_trips_ml", lambda f: classify.classify_gtfs_trips(f["stop_times"], f["trips"], f["routes"]).select("trip_id", "train_type", "classification_method"))
_feed("ml_features", lambda f: ml.ml_features(_evidence(f)).select("trip_id", *(f"f_{c}" for c in ml.FEATURES)))
_feed("ml_support_predict", lambda f: ml.support(_evidence(f)).select("trip_id", "train_type_ml", "ml_night_probability"))
_feed("ml_support_fit", lambda f: _fitted(_evidence(f)))
_feed("reference_night_labels", lambda f: classify.reference_night_labels(f["routes"], f["trips"])[1].select("trip_id", "train_type", "classification_method", "night_percentage"))
_feed("default_day_labels", lambda f: classify.default_day_labels(f["trips"]).select("trip_id", "train_type", "classification_reason", "needs_manual_review"))


def _evidence(f: dict[str, DataFrame]) -> DataFrame:
    return classify.evidence(f["stop_times"], f["trips"], f["routes"])


def _fitted(trips: DataFrame) -> DataFrame:
    """What the forest's features weigh; no rows if there is no forest."""
    model = ml.ml_support_fit(trips)
    return ml.importances(model, trips, ml.FEATURES) if model else trips.sparkSession.createDataFrame([], "feature string, importance double")


def _two(f: dict[str, DataFrame]) -> merge.Feeds:
    """The feed as two sources that name everything alike: only their prefixes tell the rows apart."""
    return {"renfe": f, "sncb": f}


def _merged(f: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    two = _two(f)
    operators = merge.merge_operators(two)
    stations, trains = merge.merge_stations(two), merge.merge_trains(two, operators)
    return operators, stations, trains, merge.merge_schedules(two, trains, stations)


_feed("merge_operators", lambda f: merge.merge_operators(_two(f)).select("operator_id", "agency_id", "agency_name", "source_name"))
_feed("merge_stations", lambda f: merge.merge_stations(_two(f)).select("station_id", "stop_id", "country", "source_name"))
_feed("merge_trains", lambda f: _merged(f)[2].select("train_id", "trip_id", "operator_id", "train_type", "source_name"))
_feed("merge_schedules", lambda f: _merged(f)[3].select("trip_id", "source_name", "duration_min").withColumn("duration_min", F.col("duration_min").cast("long")))
_feed("merge_summary", lambda f: merge.merge_summary_table(_two(f)))
_feed("coalesce_columns", lambda f: merge.coalesce_columns(f["routes"], "shown", ["route_long_name", "route_short_name", "absent"]).select("route_id", "shown"))
_feed("parse_duration_minutes", lambda f: f["stop_times"].select("trip_id", "stop_id", "stop_sequence", merge.parse_duration_minutes("departure_time").alias("minutes")))
_feed("process_source", lambda f: merge.process_source("renfe", f, "ES", enable_ml=False)["trips"].select("trip_id", "route_id", "train_type", "classification_method", "classification_reason", "night_percentage"))


def _night_rebuild(f: dict[str, DataFrame]) -> DataFrame:
    source = classify.NIGHT_SOURCE
    trips = f["trips"].select("trip_id", F.substring("route_id", 2, 5).alias("route_id"), F.lit("100").alias("distance"))
    trains = trips.select(F.concat(F.lit(f"{source}_"), "route_id").alias("train_number"), F.col("route_id").cast("long").alias("train_id"), F.lit(source).alias("source_name")).distinct()
    stations = f["stops"].select(F.concat(F.lit(f"{source}_"), "stop_id").alias("uic_code"), F.col("stop_id").cast("long").alias("station_id"), F.lit(source).alias("source_name"))
    clock = lambda c: F.concat(F.lit("1899-12-30T"), F.format_string("%02d", F.pmod(F.split(c, ":")[0].cast("int"), F.lit(24))), F.substring(c, 3, 6), F.lit(".000Z"))
    calls = f["stop_times"].withColumns({c: clock(c) for c in ("departure_time", "arrival_time")})
    return merge.night_schedules_rebuild(trips, calls, trains, stations).select("train_id", "origin_id", "destination_id", "duration_min")


_feed("night_schedules_rebuild", _night_rebuild)


# ---- sources and sinks: the lens written as files, read again


def _files(name: str, write: Callable[[SparkSession, str, str], None], read: Callable[[SparkSession, str], DataFrame]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = place(spark, name)
        write(spark, sf_dir, path)
        return read(spark, path)

    QUERIES[name] = query


#: With a header, and blanks at the ends of cells as they are.
_AS_IS = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _write_feed(spark: SparkSession, sf_dir: str, path: str) -> None:
    for name, df in lens.feed(spark, sf_dir).items():
        df.withColumn("unknown", F.lit("x")).withColumnRenamed("stop_name", "stop_name  ").write.options(**_AS_IS).csv(f"{path}/{name}.txt")


def _write_json(spark: SparkSession, sf_dir: str, path: str) -> None:
    f = lens.feed(spark, sf_dir)
    calls = f["stop_times"].distinct().withColumn("call", F.concat_ws("-", "trip_id", "stop_id", "stop_sequence"))
    for name, df, key in (("agencies", f["agency"], "agency_id"), ("routes", f["routes"], "route_id"), ("trips", f["trips"], "trip_id"), ("stops", f["stops"], "stop_id"), ("trip_stop", calls, "call")):
        # an object in a file holds some thousand records, whatever the table's size
        files = -(-df.count() // 5000) or 1
        rows = df.select(F.struct(F.col(key), F.struct(*(c for c in df.columns if c != "call"))).alias("entry"), F.pmod(F.xxhash64(key), F.lit(files)).alias("file"))
        rows.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list("entry"))).alias("value")).write.partitionBy("file").text(f"{path}/{name}.json")


def _write_catalog(spark: SparkSession, sf_dir: str, path: str) -> None:
    t = lens.canonical(spark, sf_dir)
    code = F.element_at(F.array(*map(F.lit, ("FR", "DE", "US", "UK"))), (F.col("operator_id") % 4 + 1).cast("int"))
    rows = t.operators.select(F.col("operator_id").alias("mdb_source_id"), F.when(F.col("operator_id") % 5 == 0, "gtfs-rt").otherwise("gtfs").alias("data_type"), F.col("name").alias("provider"), F.col("website").alias("urls.direct_download"), code.alias("location.country_code"))
    rows.write.option("header", True).csv(path)


def _digests(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table, and a sum over hashes of their whole rows that no order changes."""
    parts = []
    for name, df in tables.items():
        row = F.concat_ws("|", *(F.coalesce(c, F.lit("\\N")) for c in sorted(df.columns)))
        parts.append(df.agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")).alias("digest")).select(F.lit(name).alias("endpoint"), "rows", "digest"))
    return reduce(DataFrame.union, parts)


_files("read_gtfs_feed", _write_feed, lambda s, p: _digests(feeds.read_gtfs_feed(s, p, "lens")))
_files("gtfs_validate", _write_feed, lambda s, p: feeds.gtfs_validate(s, feeds.read_gtfs_feed(s, p, "lens")))
_files("gtfs_feed_info", lambda s, d, p: lens.feed(s, d)["agency"].agg(F.min("agency_name").alias("feed_publisher_name")).write.options(**_AS_IS).csv(f"{p}/feed_info.txt"), lambda s, p: feeds.gtfs_feed_info(feeds.read_gtfs_feed(s, p, "lens", include_optional_files=True)))
_files("read_keyed_json", _write_json, lambda s, p: _digests(feeds.read_keyed_json(s, p)))
_files("keyed_json_validate", _write_json, lambda s, p: feeds.keyed_json_validate(feeds.read_keyed_json(s, p)))
_files("endpoint_row_counts", _write_json, lambda s, p: feeds.endpoint_row_counts(feeds.read_keyed_json(s, p)))
_files("read_feed_catalog", _write_catalog, lambda s, p: feeds.read_feed_catalog(s, p))
_files("catalog_european_feeds", _write_catalog, lambda s, p: feeds.catalog_european_feeds(feeds.read_feed_catalog(s, p)))
_files("catalog_feeds_by_country", _write_catalog, lambda s, p: feeds.catalog_feeds_by_country(feeds.read_feed_catalog(s, p), "DE"))
_files("catalog_feeds_by_operator", _write_catalog, lambda s, p: feeds.catalog_feeds_by_operator(feeds.read_feed_catalog(s, p), "SUPPLIER#00000001"))
_files("catalog_summary", _write_catalog, lambda s, p: feeds.catalog_summary(feeds.read_feed_catalog(s, p)))


_AGAIN = ["ASIA", "EUROPE"]


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stations, then those of two regions with new cities."""
    path, rows = place(spark, "upsert"), lens.canonical(spark, sf_dir).stations.drop("station_id")
    store.write_canonical_upsert(rows, path, "stations", id_column="station_id")
    out = store.write_canonical_upsert(rows.filter(F.col("source_name").isin(_AGAIN)).withColumn("city", F.lit("new")), path, "stations", id_column="station_id")
    return out.select("station_id", "name", "city", "country", "source_name")


QUERIES["write_canonical_upsert"] = _upsert


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stations' updated_at the second of two batches, of two regions, has set."""
    path, old = place(spark, "touched"), F.lit("2000-01-01").cast("timestamp")
    rows = lens.canonical(spark, sf_dir).stations.drop("station_id").withColumn("updated_at", old)
    store.write_canonical_upsert(rows, path, "stations")
    out = store.write_canonical_upsert(rows.filter(F.col("source_name").isin(_AGAIN)), path, "stations")
    return out.select("name", "source_name", (F.col("updated_at") > old).alias("touched"))


QUERIES["touch_updated_at"] = _touched


_LOADED = {
    "operators": ("operator_id", "name", "country", "website", "source_name"), "stations": ("station_id", "name", "city", "country", "latitude", "longitude", "uic_code", "source_name"),
    "trains": ("train_id", "train_number", "operator_id", "train_type", "category", "route_name", "source_name"),
    "schedules": ("schedule_id", "train_id", "origin_id", "destination_id", "departure_time", "arrival_time", "duration_min", "frequency", "source_name"),
}


def _loaded(spark: SparkSession, sf_dir: str, until: str) -> schemas.Tables:
    """The merged tables loaded twice: first those rows that the first source has, then all of them with other websites, cities, route names and frequencies."""
    merged = {k: save(df, k) for k, df in zip(schemas.SCHEMAS, _merged(lens.feed(spark, sf_dir)), strict=True)}
    folder = place(spark, "loaded")
    store.load_all({k: df.filter("source_name = 'renfe'") for k, df in merged.items()}, folder, until)
    merged["operators"] = merged["operators"].withColumn("agency_url", F.concat("agency_url", F.lit("/2")))
    merged["stations"] = merged["stations"].withColumn("city", F.lit("second"))
    merged["trains"] = merged["trains"].withColumn("route_long_name", F.concat("route_long_name", F.lit(" (2)")))
    merged["schedules"] = merged["schedules"].withColumn("frequency", F.lit("daily"))
    return store.load_all(merged, folder, until)


def _loads(table: str) -> Query:
    return lambda spark, sf_dir: getattr(_loaded(spark, sf_dir, table), table).select(*_LOADED[table])


for _table in schemas.SCHEMAS:
    QUERIES[f"load_{_table}"] = _loads(_table)
QUERIES["loaded_operator_summary"] = lambda spark, sf_dir: views.v_operator_summary(_loaded(spark, sf_dir, "schedules"))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's files through the whole chain; what the stored tables then say of each operator."""
    path, folder = place(spark, "feed"), place(spark, "chain")
    _write_feed(spark, sf_dir, path)
    return views.v_operator_summary(chain.run(spark, {"renfe": (path, "ES")}, folder))


QUERIES["chain_operator_summary"] = _chain


def _slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = place(spark, "slice"), lens.canonical(spark, sf_dir).stations
    store.replace_source_slice(rows, path)
    store.replace_source_slice(rows.filter("source_name = 'ASIA' and city is not null"), path)
    return store.read_table(spark, path).select("station_id", "name", "city", "country", "source_name")


QUERIES["replace_source_slice"] = _slice


#: By which the schedules are looked up, and files of the clustered table.
_LOOKED_UP, _CLUSTERED = ("train_id", "origin_id", "destination_id"), 64


def _clustered(look: Callable[[schemas.Tables, Callable[..., DataFrame]], DataFrame]) -> Query:
    """A detail query on the schedules written in a clustered layout: of 64 files those are read that may hold the id."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, path = lens.canonical(spark, sf_dir), place(spark, "clustered")
        store.write_clustered(t.schedules, path, _LOOKED_UP, _CLUSTERED)
        return look(t, lambda **values: store.lookup(spark, path, **values))

    return query


QUERIES["clustered_station_departures"] = _clustered(lambda t, look: views.station_departures(t._replace(schedules=look(origin_id=12)), 12, "day"))
QUERIES["clustered_station_arrivals"] = _clustered(lambda t, look: views.station_arrivals(t._replace(schedules=look(destination_id=12)), 12))
QUERIES["clustered_train_schedules"] = _clustered(lambda t, look: views.train_schedules(t._replace(schedules=look(train_id=8)), 8))


#: Buckets of the tables by train: one task each on both sides of a join.
_BUCKETED = 64


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operators' summary from trains and schedules bucketed by train: their sums and their join shuffle nothing by train."""
    t, path = lens.canonical(spark, sf_dir), place(spark, "bucketed")
    label = path.rpartition("-")[2]
    made = {k: bucketed.write_bucketed(getattr(t, k), f"{k}_{label}", f"{path}/{k}", "train_id", _BUCKETED) for k in ("trains", "schedules")}
    return views.v_operator_summary(t._replace(**made))


QUERIES["bucketed_operator_summary"] = _bucketed


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = dashboard.analytics_base(lens.canonical(spark, sf_dir))
    return base.select("train_id", F.col("train_type_raw").alias("train_type"), "duration_hours", "distance_km", "operator", "website", "departure_station", "arrival_station")


def _analytics(spark: SparkSession, path: str) -> DataFrame:
    out = feeds.read_analytics_csv(spark, path)
    return out.select("train_id", "train_type_normalized", F.round("duration_min", 6).alias("duration_min"), "distance_km", F.round("co2_saving_kg", 6).alias("co2"), "operator", "website", "departure_station", "arrival_station")


_files("read_analytics_csv", lambda s, d, p: feeds.export_csv(_frame(s, d), p), _analytics)
_files("export_csv", lambda s, d, p: feeds.export_csv(_frame(s, d).drop("duration_hours"), p, quote_json=True), lambda s, p: s.read.csv(p, header=True, escape="\\"))
QUERIES = dict(sorted(QUERIES.items()))
ORACLES = {name: sql for name, sql in ORACLE.items() if name in QUERIES}
__all__ = ["ORACLES", "QUERIES", "remove"]
