"""Readers of timetable feeds, keyed JSON catalogues, the feed catalogue and the denormalised analytics file."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipcoach.functions.timetable import normalized_type
from slipcoach.plans import shared
from slipcoach.plans.schemas import CO2_PLANE, CO2_TRAIN, with_missing
from slipcoach.sources import splits

#: The columns that are read of each file.
GTFS = {
    "agency": ["agency_id", "agency_name", "agency_url", "agency_timezone", "agency_lang", "agency_phone"],
    "stops": ["stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon", "stop_timezone", "location_type", "parent_station", "platform_code"],
    "routes": ["route_id", "agency_id", "route_short_name", "route_long_name", "route_desc", "route_type", "route_color", "route_text_color"],
    "trips": ["route_id", "service_id", "trip_id", "trip_headsign", "trip_short_name", "direction_id", "block_id", "shape_id", "wheelchair_accessible", "bikes_allowed"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence", "stop_headsign", "pickup_type", "drop_off_type"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
}
OPTIONAL = ("shapes", "transfers", "feed_info")
REQUIRED = ("agency", "stops", "routes", "trips", "stop_times")
#: The night catalogue's endpoints, and countries of European feeds.
ENDPOINTS = ("agencies", "calendar", "calendar_dates", "classes", "routes", "stops", "translations", "trip_stop", "trips")
EUROPE = ["FR", "DE", "IT", "ES", "CH", "AT", "BE", "NL", "UK", "SE", "NO", "DK", "FI", "IE", "PT", "PL", "CZ", "HU", "RO", "BG", "HR", "SI", "SK", "LT", "LV", "EE", "LU"]
CATALOG_COLUMNS = ("mdb_source_id", "data_type", "provider", "location_country_code")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


#: How cells are read: quotes are doubled inside of quotes, blanks at the ends stay.
_CELLS = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, names trimmed, empty cells null; 'NA' stays text. A file is read by many tasks, also with line breaks in quotes."""
    names = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, encoding="UTF-8", recursiveFileLookup=True, **_CELLS).columns  # of the first file's first record
    rows = splits.records(spark, path, splits.CSV).filter("not first").select(F.regexp_replace(F.regexp_replace("record", "\r$", ""), "\r\n", "\n").alias("record")).filter("record <> ''")
    cells = rows.select(F.from_csv("record", ", ".join(f"c{k} string" for k in range(len(names))), _CELLS).alias("row")).select("row.*")
    return cells.toDF(*(c.strip().lstrip("﻿") for c in names))


def read_gtfs_feed(spark: SparkSession, path: str, source_name: str, country_code: str | None = None, include_optional_files: bool = False) -> dict[str, DataFrame]:
    """The feed's files that are there: {name: table of text columns}; core files keep only the allowed columns."""
    out = {}
    for name in (*GTFS, *(OPTIONAL if include_optional_files else ())):
        file = f"{path}/{name}.txt"
        if _exists(spark, file):
            df = _csv(spark, file)
            allowed = [c for c in GTFS[name] if c in df.columns] if name in GTFS else df.columns
            out[name] = df.select(*(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in allowed))
    return out


def gtfs_validate(spark: SparkSession, feed: Mapping[str, DataFrame]) -> DataFrame:
    """One row for each required file: present, empty, ok."""
    rows = None
    for name in REQUIRED:
        held = feed[name].limit(1).agg(F.count("*").alias("n")) if name in feed else spark.range(1).select(F.lit(0).alias("n"))
        row = held.select(F.lit(name).alias("file"), F.lit(name in feed).alias("present"), (F.col("n") == 0).alias("empty"), (F.col("n") > 0).alias("ok"))
        rows = row if rows is None else rows.union(row)
    return rows


def gtfs_feed_info(feed: Mapping[str, DataFrame]) -> DataFrame | None:
    return feed["feed_info"].limit(1) if "feed_info" in feed else None


def read_keyed_json(spark: SparkSession, path: str, endpoints: Sequence[str] = ENDPOINTS) -> dict[str, DataFrame]:
    """{endpoint: table} of files that hold one object of records by id; values as text, the id as id_from_key.

    <endpoint>.json is a file, or a folder of files (also below it) with one object each; a large object is read by many tasks.
    The names of the records' fields come from the data: distinct keys, as many as a record has fields.
    """
    out = {}
    for name in endpoints:
        file = f"{path}/{name}.json"
        if _exists(spark, file):
            # a record without its last brace, and before it what stands between records; the end of the object is no record
            texts = splits.records(spark, file, splits.JSON).select(F.expr(r"ltrim('{, \n\r\t', ltrim('\ufeff', record))").alias("text")).filter(F.col("text").startswith('"'))
            # saved, since the names of the fields are asked for before any column is: a file is not read and parsed for each of both
            records = shared.save(texts.select(F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}}")), "map<string,map<string,string>>")).alias("id_from_key", "record")), name, batch_rows=10_000)
            fields = sorted(r["f"] for r in records.select(F.explode(F.map_keys("record")).alias("f")).distinct().collect())
            out[name] = records.select("id_from_key", *(F.col("record")[f].alias(f or "_") for f in fields))
    return out


def keyed_json_validate(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row: the required tables' rows, and ids of routes' agencies and calls' stops that are not there."""
    orphans = lambda left, right, key, name: left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti").agg(F.count("*").alias(name))
    out = orphans(tables["routes"].filter("agency_id is not null"), tables["agencies"], "agency_id", "orphan_agencies")
    out = out.crossJoin(orphans(tables["trip_stop"].filter("stop_id is not null"), tables["stops"], "stop_id", "orphan_stops"))  # single rows
    for name in ("agencies", "routes", "stops", "trips"):
        out = out.crossJoin(tables[name].agg(F.count("*").alias(f"n_{name}")))
    return out.withColumn("valid", F.least(*(F.col(f"n_{n}") for n in ("agencies", "routes", "stops", "trips"))) > 0)


def endpoint_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("endpoint"), "rows")
        out = row if out is None else out.union(row)
    return out


def read_feed_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue, dots in names as underscores; a missing required column is an error."""
    df = _csv(spark, path)
    df = df.toDF(*(c.replace(".", "_") for c in df.columns))
    if gone := [c for c in CATALOG_COLUMNS if c not in df.columns]:
        raise ValueError(f"the catalogue lacks {', '.join(gone)}")
    return df


def _gtfs() -> Column:
    return F.col("data_type") == "gtfs"


def catalog_european_feeds(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("location_country_code").isin(EUROPE) & _gtfs())


def catalog_feeds_by_country(catalog: DataFrame, country_code: str) -> DataFrame:
    return catalog.filter((F.col("location_country_code") == country_code) & _gtfs())


def catalog_feeds_by_operator(catalog: DataFrame, operator_name: str) -> DataFrame:
    return catalog.filter(F.lower("provider").contains(operator_name.lower()))


def catalog_summary(catalog: DataFrame) -> DataFrame:
    country, european = F.col("location_country_code"), F.col("location_country_code").isin(EUROPE) & _gtfs()
    return catalog.agg(F.count("*").alias("total_feeds"), F.count(F.when(european, 1)).alias("european_feeds"), F.countDistinct(country).alias("countries"), F.countDistinct(F.when(european, country)).alias("european_countries"))


def read_analytics_csv(spark: SparkSession, path: str) -> DataFrame:
    """The fallback file: type, minutes and CO2 from the columns that are there; missing ones as null."""
    df = _csv(spark, path)
    kind = next((c for c in ("day_night_classification", "train_type") if c in df.columns), None)
    df = df.withColumn("train_type_normalized", normalized_type(kind) if kind else F.lit("day"))
    df = df.withColumns({c: F.col(c).try_cast("double") for c in ("duration_hours", "duration_min", "distance_km", "co2_vs_plane_kg", "co2_saving_kg") if c in df.columns})
    if "duration_hours" in df.columns and "duration_min" not in df.columns:
        df = df.withColumn("duration_min", F.col("duration_hours") * 60)
    if "co2_saving_kg" not in df.columns:
        if "co2_vs_plane_kg" in df.columns:
            df = df.withColumn("co2_saving_kg", F.col("co2_vs_plane_kg"))
        elif "distance_km" in df.columns:
            df = df.withColumn("co2_saving_kg", F.col("distance_km") * CO2_PLANE - F.col("distance_km") * CO2_TRAIN)
    return with_missing(df, "operator_country", "operator", "website", "departure_station", "arrival_station", "train_id", "train_number")


def _json_cell(df: DataFrame, name: str) -> Column:
    """A cell as JSON: text with its escapes in quotes, a whole number without a fraction, null as empty text."""
    c, kind = F.col(f"`{name}`"), dict(df.dtypes)[name]
    if kind in ("double", "float"):
        shown = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    elif kind in ("int", "bigint", "smallint", "tinyint", "boolean") or kind.startswith("decimal"):
        shown = c.cast("string")
    else:
        text = F.to_json(F.array(c.cast("string")))
        shown = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(c.isNull(), F.lit('""')).otherwise(shown)


def export_csv(df: DataFrame, path: str, quote_json: bool = False) -> None:
    """UTF-8 with a header in each file; quote_json writes every cell as JSON (read it with a backslash as escape)."""
    if not quote_json:
        df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
        return
    # whole lines as one cell: no separator or quote of the writer's own stands in them, since JSON escapes control characters
    lines = df.select(F.concat_ws(",", *(_json_cell(df, c) for c in df.columns)).alias(",".join(df.columns)))
    plain = {"header": True, "sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "encoding": "UTF-8"}
    lines.write.mode("overwrite").options(**plain).csv(path)
