"""Cleaning and normalising feed tables: keep-first, required columns, coordinates, clocks, rail filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipcoach.functions.timetable import clock_of_day, clock_seconds, label_of
from slipcoach.plans.schemas import OTHER_TYPES, RAIL_TYPES

#: IANA zones by country.
ZONES = {"FR": "Europe/Paris", "DE": "Europe/Berlin", "IT": "Europe/Rome", "ES": "Europe/Madrid", "CH": "Europe/Zurich", "AT": "Europe/Vienna", "BE": "Europe/Brussels", "NL": "Europe/Amsterdam", "UK": "Europe/London"}


def dedup_keep_first(df: DataFrame, subset: Sequence[str] | None = None, order: Sequence[str | Column] = ()) -> DataFrame:
    """The first row of each key in the given order, ties by all columns; without a subset, distinct rows.

    A null is a key like any other. The smallest row of a key is an aggregate with map-side combine, not a window; the row
    is read off the columns that it is ordered by, so it is carried once.
    """
    if subset is None:
        return df.dropDuplicates()
    part = lambda x, name: F.struct(x.isNull().alias("none"), x.alias("value")).alias(name)
    by = [part(F.col(x) if isinstance(x, str) else x, f"o{k}") for k, x in enumerate(order)]
    row = [part(F.col(f"`{c}`"), f"c{k}") for k, c in enumerate(df.columns)]
    best = df.groupBy(*(F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(subset))).agg(F.min(F.struct(*by, *row)).alias("row"))
    return best.select(*(F.col(f"row.c{k}.value").alias(c) for k, c in enumerate(df.columns)))


def drop_missing_required(df: DataFrame, required_columns: Sequence[str], strategy: str = "drop") -> DataFrame:
    """Rows with all required columns that the table has."""
    if strategy != "drop":
        raise ValueError(f"strategy {strategy!r} is not available")
    return df.dropna(subset=[c for c in required_columns if c in df.columns])


def missing_required(df: DataFrame, required_columns: Sequence[str]) -> DataFrame:
    """Nulls of each required column, in one pass."""
    names = [c for c in required_columns if c in df.columns]
    counts = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("column_name", "missing_count"))


def _degrees(name: str) -> Column:
    return F.col(name).try_cast("double")


def clean_stations(stops: DataFrame) -> DataFrame:
    """Keep-first by stop, trimmed name, numeric coordinates; both go if either is out of range."""
    out = dedup_keep_first(stops, ["stop_id"])
    lat, lon = _degrees("stop_lat"), _degrees("stop_lon")
    bad = ~lat.between(-90, 90) | ~lon.between(-180, 180)
    kept = lambda x: F.when(F.coalesce(bad, F.lit(False)), None).otherwise(x)
    return out.withColumns({"stop_name": F.trim("stop_name"), "stop_lat": kept(lat), "stop_lon": kept(lon)})


def clean_routes(routes: DataFrame) -> DataFrame:
    """Keep-first by route (a table without route_id: distinct rows), trimmed names."""
    out = dedup_keep_first(routes, ["route_id"]) if "route_id" in routes.columns else dedup_keep_first(routes)
    return out.withColumns({c: F.trim(c) for c in ("route_short_name", "route_long_name") if c in routes.columns})


def clean_stop_times(stop_times: DataFrame) -> DataFrame:
    out = dedup_keep_first(stop_times, ["trip_id", "stop_id", "stop_sequence"])
    return out.withColumn("stop_sequence", F.col("stop_sequence").try_cast("int"))


def cleaning_stats(before: DataFrame, after: DataFrame, required_columns: Sequence[str]) -> DataFrame:
    """Duplicates that keep-first removed, nulls in required columns, rows removed."""
    gone = sum((F.count(F.when(F.col(c).isNull(), 1)) for c in required_columns), F.lit(0))
    left = before.agg(F.count("*").alias("n"), gone.alias("missing_values"))
    distinct = before.dropDuplicates().agg(F.count("*").alias("d"))
    kept = after.agg(F.count("*").alias("k"))
    return left.crossJoin(distinct).crossJoin(kept).select((F.col("n") - F.col("d")).alias("duplicates_removed"), "missing_values", (F.col("n") - F.col("k")).alias("rows_removed"))  # single rows


def normalize_station_codes(df: DataFrame, code_column: str = "stop_id") -> DataFrame:
    return df.withColumn(code_column, F.upper(F.trim(code_column)))


def normalize_clock_time(df: DataFrame, column: str = "departure_time") -> DataFrame:
    return df.withColumn(column, clock_of_day(column))


def normalize_stop_times(stop_times: DataFrame) -> DataFrame:
    """Arrival and departure as seconds of the service day."""
    return stop_times.withColumns({c: clock_seconds(c) for c in ("arrival_time", "departure_time") if c in stop_times.columns})


def add_country_code(df: DataFrame, source_country: str, agency_df: DataFrame | None = None) -> DataFrame:
    """The source's country as country_code; agency_df is accepted and not used."""
    return df.withColumn("country_code", F.lit(source_country))


def normalize_coordinates(df: DataFrame, lat: str = "stop_lat", lon: str = "stop_lon") -> DataFrame:
    """Each coordinate out of range goes by itself."""
    keep = lambda c, most: F.when(_degrees(c).between(-most, most), _degrees(c))
    return df.withColumns({lat: keep(lat, 90), lon: keep(lon, 180)})


def standardize_route_types(routes: DataFrame) -> DataFrame:
    code = F.col("route_type").try_cast("int")
    return routes.withColumn("route_type_label", label_of(code, RAIL_TYPES | OTHER_TYPES, "Unknown"))


def _is_rail() -> Column:
    return F.coalesce(F.col("route_type").try_cast("int").isin(list(RAIL_TYPES)), F.lit(False))


def filter_rail_routes(routes: DataFrame) -> DataFrame:
    return routes.filter(_is_rail())


def removed_route_types(routes: DataFrame, limit: int = 5) -> DataFrame:
    """The most frequent types that the rail filter removes, with what it removes in all."""
    whole = routes.agg(F.count(F.when(~_is_rail(), 1)).alias("removed"), F.bround(F.count(F.when(~_is_rail(), 1)) * 100.0 / F.nullif(F.count("*"), F.lit(0)), 1).alias("removed_pct"))
    top = routes.filter(~_is_rail()).groupBy("route_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_last("route_type")).limit(limit)
    return top.crossJoin(whole)  # a single row


def filter_rail_trips(trips: DataFrame, rail_routes: DataFrame) -> DataFrame:
    return trips.join(rail_routes.select("route_id").distinct(), "route_id", "left_semi")


def filter_rail_stop_times(stop_times: DataFrame, rail_trips: DataFrame) -> DataFrame:
    return stop_times.join(rail_trips.select("trip_id"), "trip_id", "left_semi")


def country_timezone(df: DataFrame, country: str = "country") -> DataFrame:
    table = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))
    return df.withColumn("timezone", F.try_element_at(table, F.col(country)))
