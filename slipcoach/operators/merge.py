"""Merging feeds of several sources into the canonical tables.

A feed is a dict of tables, several are a dict of feeds in order of priority. Each table of all sources becomes one
DataFrame with a source_name column; ids get the source's name as prefix, the first row by (priority, id) is kept, and
dense numbers are dealt after the last de-duplication.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipcoach.functions.timetable import anchored, clock_seconds, iso_seconds, ride_minutes
from slipcoach.operators import classify, cleaning
from slipcoach.plans.schemas import with_missing
from slipcoach.plans.shared import numbered

Feeds = Mapping[str, Mapping[str, DataFrame]]
#: Countries of known sources.
COUNTRIES = {"sncf_intercites": "FR", "db_fernverkehr": "DE", "renfe": "ES", "trenitalia": "IT", "cff_sbb": "CH", "sncb": "BE"}
CLASSIFIED = ("train_type", "train_type_rule", "train_type_heuristic", "train_type_ml", "classification_method", "classification_reason", "classification_confidence", "ml_night_probability", "night_percentage", "needs_manual_review")
_KINDS = {"classification_confidence": "double", "ml_night_probability": "double", "night_percentage": "double", "needs_manual_review": "boolean"}


def coalesce_columns(df: DataFrame, target: str, candidates: Sequence[str]) -> DataFrame:
    """target is the first of the candidates present that is not null; without any, the table stays as it is."""
    there = [F.col(c) for c in candidates if c in df.columns]
    return df.withColumn(target, F.coalesce(*there)) if there else df


def parse_duration_minutes(text: str) -> Column:
    """Minutes of an ISO timestamp's clock, or of HH:MM:SS."""
    return F.coalesce(iso_seconds(text), clock_seconds(text)) / 60.0


def _united(feeds: Feeds, *names: str) -> DataFrame | None:
    """The first of the named tables of each source, one below the other, with source_name and priority."""
    out = None
    for k, (source, feed) in enumerate(feeds.items()):
        name = next((n for n in names if n in feed), None)
        if name:
            part = feed[name].withColumns({"source_name": F.lit(source), "__priority": F.lit(k)})
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _prefixed(column: str) -> Column:
    return F.concat_ws("_", "source_name", F.col(column).cast("string"))


def _dense(df: DataFrame, name: str, key: str) -> DataFrame:
    """Numbers 1, 2, ... by priority of the source and key."""
    return numbered(df, [F.col("__priority"), F.col(key)], name).drop("__priority")


def merge_operators(feeds: Feeds, dedup_keys: Sequence[str] = ("agency_name",)) -> DataFrame | None:
    """Agencies of all sources, one for each name, the first source's first."""
    rows = _united(feeds, "agency", "agencies")
    if rows is None:
        return None
    rows = rows.withColumns({"source_agency_id": F.col("agency_id").cast("string"), "agency_id": _prefixed("agency_id")})
    return _dense(cleaning.dedup_keep_first(rows, dedup_keys, ["__priority", "agency_id"]), "operator_id", "agency_id")


def merge_stations(feeds: Feeds) -> DataFrame | None:
    """Stops of all sources, one for each prefixed id; a missing country comes from the source."""
    named = {s: ({**f, "stops": f["stops"] if "country" in f["stops"].columns else f["stops"].withColumn("country", F.lit(COUNTRIES.get(s)))} if "stops" in f else f) for s, f in feeds.items()}
    rows = _united(named, "stops")
    if rows is None:
        return None
    rows = rows.withColumns({"source_stop_id": F.col("stop_id").cast("string"), "stop_id": _prefixed("stop_id")})
    return _dense(cleaning.dedup_keep_first(rows, ["stop_id"], ["__priority"]), "station_id", "stop_id")


def _source_trains(feed: Mapping[str, DataFrame]) -> DataFrame:
    """Trips with their route; the trip's classification goes first, the route's agency does. Routes alone are night trains."""
    if "trips" not in feed:
        return feed["routes"].withColumns({"trip_id": F.col("route_id"), "train_type": F.lit("night")})
    trips = feed["trips"]
    if "routes" not in feed:
        return coalesce_columns(with_missing(trips, "train_type"), "train_type", ["train_type"])
    routes = feed["routes"]
    both = [c for c in routes.columns if c in trips.columns and c != "route_id"]
    out = trips.withColumnsRenamed({c: f"{c}_trip" for c in both}).join(routes.withColumnsRenamed({c: f"{c}_route" for c in both}), "route_id", "left")
    out = coalesce_columns(out, "agency_id", ["agency_id_route", "agency_id_trip", "agency_id"])
    for c in (*CLASSIFIED, *(x for x in both if x != "agency_id" and x not in CLASSIFIED)):
        out = coalesce_columns(out, c, [f"{c}_trip", f"{c}_route", c])
    return out.drop(*(f"{c}_{side}" for c in both for side in ("trip", "route")))


def merge_trains(feeds: Feeds, operators: DataFrame) -> DataFrame | None:
    """Trips of all sources with the operator of their agency; those whose agency has none are dropped."""
    held = {s: {"trains": _source_trains(f)} for s, f in feeds.items() if "routes" in f or "trips" in f}
    rows = _united(held, "trains")
    if rows is None:
        return None
    rows = with_missing(rows, "agency_id")
    for c in CLASSIFIED:
        rows = with_missing(rows, c, kind=_KINDS.get(c, "string"))
    rows = rows.withColumns({"source_trip_id": F.col("trip_id").cast("string"), "source_route_id": F.col("route_id").cast("string"), "source_agency_id": F.col("agency_id").cast("string")})
    rows = rows.withColumns({"trip_id": _prefixed("trip_id"), "route_id": _prefixed("route_id"), "agency_id": _prefixed("agency_id"), "train_type": F.coalesce("train_type", F.lit("day"))})
    rows = rows.join(operators.select("agency_id", "operator_id"), "agency_id")
    return _dense(cleaning.dedup_keep_first(rows, ["trip_id"], ["__priority", "route_id"]), "train_id", "trip_id")


def merge_schedules(feeds: Feeds, trains: DataFrame, stations: DataFrame) -> DataFrame | None:
    """First and last call of each trip, with the train and both stations; rides that cannot be are dropped."""
    calls = _united(feeds, "stop_times", "trip_stop")
    if calls is None:
        return None
    # a try_cast of text that is no number costs forty times a clock, so clocks go first; a text is one of both at most
    seconds = lambda c: F.coalesce(iso_seconds(c), clock_seconds(c), c.try_cast("long"))
    calls = calls.select("source_name", "trip_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("at"), *(F.col(c).cast("string").alias(c) for c in ("departure_time", "arrival_time")))
    at = lambda pick, c: pick(F.when(F.col(c).isNotNull(), F.struct("at", "stop_id", F.col(c).alias("of"))))["of"]
    # clocks are read in the aggregate, once a trip: a projection over it would be pushed down with every filter on the minutes
    ends = calls.groupBy("source_name", "trip_id").agg(
        at(F.min, "stop_id").alias("origin_uic"), at(F.max, "stop_id").alias("destination_uic"), seconds(at(F.min, "departure_time")).alias("departure_s"), seconds(at(F.max, "arrival_time")).alias("arrival_s")
    )
    more = with_missing(trains, "duration", "distance")
    more = more.select(F.col("trip_id").alias("__trip"), "train_id", F.col("duration").cast("string").alias("duration"), F.col("distance").try_cast("double").alias("distance_km"))
    out = ends.withColumn("__trip", _prefixed("trip_id")).join(more, "__trip")
    for end in ("origin", "destination"):
        out = out.withColumn("__stop", _prefixed(f"{end}_uic")).join(stations.select(F.col("stop_id").alias("__stop"), F.col("station_id").alias(f"{end}_id")), "__stop").drop("__stop")
    minutes = F.coalesce((F.col("arrival_s") - F.col("departure_s")) / 60.0, parse_duration_minutes("duration"))
    out = out.withColumn("duration_min", F.bround(F.when(minutes < 0, minutes + 1440).otherwise(minutes)).cast("long"))
    out = out.filter("duration_min > 0 and origin_id <> destination_id")
    out = out.withColumns({"departure_time": anchored(F.col("departure_s")), "arrival_time": anchored(F.col("departure_s") + F.col("duration_min") * 60), "frequency": F.lit(None).cast("string")})
    return out.select("train_id", "origin_id", "destination_id", "departure_time", "arrival_time", "duration_min", "distance_km", "frequency", "source_name", "trip_id")


def merge_summary(feeds: Feeds) -> dict[str, int]:
    has = lambda *names: sum(any(n in f for n in names) for f in feeds.values())
    return {"total_sources": len(feeds), "operators": has("agency", "agencies"), "stations": has("stops"), "routes": has("routes")}


def merge_summary_table(feeds: Feeds) -> DataFrame:
    """How many sources have rows of each entity."""
    names = {"operators": ("agency", "agencies"), "stations": ("stops",), "routes": ("routes",)}
    held = [f[n].agg(F.count("*").alias("n")).select(F.lit(kind).alias("entity"), F.lit(source).alias("source"), "n") for source, f in feeds.items() for kind, own in names.items() for n in own if n in f]
    return reduce(DataFrame.union, held).filter("n > 0").groupBy("entity").agg(F.countDistinct("source").alias("sources"))


def process_source(source: str, feed: Mapping[str, DataFrame], country: str | None = None, enable_ml: bool = True) -> dict[str, DataFrame]:
    """Cleaning, rail filter and classification of one feed; the night catalogue's trains are night trains."""
    out: dict[str, DataFrame] = {}
    if "stops" in feed:
        out["stops"] = cleaning.normalize_coordinates(cleaning.clean_stations(feed["stops"]))
    if source == classify.NIGHT_SOURCE:
        if "agencies" in feed:
            out["agencies"] = cleaning.clean_routes(feed["agencies"]).withColumn("country", F.lit(None).cast("string"))
        if "routes" in feed and "trips" in feed:
            out["routes"], out["trips"] = classify.reference_night_labels(feed["routes"], feed["trips"])
        if "trip_stop" in feed:
            out["stop_times"] = feed["trip_stop"]
        return out
    if "agency" in feed:
        out["agency"] = cleaning.add_country_code(feed["agency"], country).withColumn("country", F.lit(country))
    if "routes" in feed:
        out["routes"] = cleaning.filter_rail_routes(cleaning.standardize_route_types(feed["routes"]))
    if "trips" in feed:
        out["trips"] = cleaning.filter_rail_trips(feed["trips"], out["routes"]) if "routes" in out else feed["trips"]
    if "stop_times" in feed:
        out["stop_times"] = cleaning.filter_rail_stop_times(feed["stop_times"], out["trips"]) if "trips" in out else feed["stop_times"]
    if "trips" in out:
        if "stop_times" in out:
            out["trips"] = out["trips"].join(classify.classify_gtfs_trips(out["stop_times"], out["trips"], out.get("routes"), source, enable_ml), "trip_id", "left")
        else:
            out["trips"] = classify.default_day_labels(out["trips"])
    return out


def night_schedules_rebuild(trips: DataFrame, trip_stop: DataFrame, trains: DataFrame, stations: DataFrame, source: str = classify.NIGHT_SOURCE) -> DataFrame:
    """The night catalogue's schedules anew: trains found by route, stations by code, clocks on the reference day."""
    at = F.struct(F.col("stop_sequence").try_cast("int"), "stop_id")
    known = lambda c: F.when(F.col(c).isNotNull(), at)
    ends = trip_stop.groupBy("trip_id").agg(*(F.min_by(c, known(c)).alias(n) for c, n in (("stop_id", "origin"), ("departure_time", "dep"))), *(F.max_by(c, known(c)).alias(n) for c, n in (("stop_id", "destination"), ("arrival_time", "arr"))))
    meta = trips.select("trip_id", F.col("route_id").try_cast("double").cast("long").cast("string").alias("route"), F.col("distance").try_cast("double").alias("distance_km"))
    own = lambda df: df.filter(F.col("source_name") == source)
    code = lambda c: F.concat(F.lit(f"{source}_"), F.col(c).cast("string"))
    out = ends.join(meta, "trip_id").withColumn("train_number", code("route")).join(own(trains).select("train_number", "train_id"), "train_number")
    for end in ("origin", "destination"):
        side = own(stations).filter("uic_code is not null").select(F.col("uic_code").alias("__code"), F.col("station_id").alias(f"{end}_id"))
        out = out.withColumn("__code", code(end)).join(side, "__code").drop("__code")
    dep, arr = F.coalesce(iso_seconds("dep"), clock_seconds("dep")), F.coalesce(iso_seconds("arr"), clock_seconds("arr"))
    out = out.withColumns({"__d": dep, "__m": F.floor(ride_minutes(dep, arr)).cast("int"), "__r": ride_minutes(dep, arr)}).filter("__m > 0 and origin_id <> destination_id")
    out = out.withColumns({"departure_time": anchored(F.col("__d")), "arrival_time": anchored(F.col("__d") + F.round(F.col("__r") * 60).cast("long"))})
    return out.select("train_id", "origin_id", "destination_id", "departure_time", "arrival_time", F.col("__m").alias("duration_min"), "distance_km", F.lit(None).cast("string").alias("frequency"), F.lit(source).alias("source_name"))
