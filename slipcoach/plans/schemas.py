"""Canonical tables: types, nullability, roles and the constants that results depend on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns, types, nullability and roles.
SCHEMAS = {
    "operators": T.StructType([
        T.StructField("operator_id", T.LongType(), False, {"role": "technical_id"}),
        T.StructField("name", T.StringType(), False, {"role": "business_attr"}),
        T.StructField("country", T.StringType(), True, {"role": "business_attr"}),
        T.StructField("website", T.StringType(), True, {"role": "business_attr"}),
        T.StructField("source_agency_id", T.StringType(), True, {"role": "source_id"}),
        T.StructField("source_name", T.StringType(), True, {"role": "source_id"}),
    ]),
    "stations": T.StructType([
        T.StructField("station_id", T.LongType(), False, {"role": "technical_id"}),
        T.StructField("name", T.StringType(), False, {"role": "business_attr"}),
        T.StructField("city", T.StringType(), True, {"role": "business_attr"}),
        T.StructField("country", T.StringType(), True, {"role": "business_attr"}),
        T.StructField("latitude", T.DecimalType(10, 8), True, {"role": "business_attr"}),
        T.StructField("longitude", T.DecimalType(11, 8), True, {"role": "business_attr"}),
        T.StructField("uic_code", T.StringType(), True, {"role": "source_id"}),
        T.StructField("timezone", T.StringType(), True, {"role": "business_attr"}),
        T.StructField("source_name", T.StringType(), True, {"role": "source_id"}),
    ]),
    "trains": T.StructType([
        T.StructField("train_id", T.LongType(), False, {"role": "technical_id"}),
        T.StructField("train_number", T.StringType(), False, {"role": "source_id"}),
        T.StructField("operator_id", T.LongType(), False, {"role": "foreign_key"}),
        T.StructField("train_type", T.StringType(), False, {"role": "business_attr"}),
        T.StructField("category", T.StringType(), True, {"role": "business_attr"}),
        T.StructField("route_name", T.StringType(), True, {"role": "business_attr"}),
        T.StructField("train_type_rule", T.StringType(), True, {"role": "business_attr"}),
        T.StructField("train_type_heuristic", T.StringType(), True, {"role": "business_attr"}),
        T.StructField("train_type_ml", T.StringType(), True, {"role": "business_attr"}),
        T.StructField("classification_method", T.StringType(), True, {"role": "business_attr"}),
        T.StructField("classification_reason", T.StringType(), True, {"role": "business_attr"}),
        T.StructField("classification_confidence", T.DecimalType(4, 2), True, {"role": "business_attr"}),
        T.StructField("ml_night_probability", T.DecimalType(4, 2), True, {"role": "business_attr"}),
        T.StructField("night_percentage", T.DecimalType(5, 2), True, {"role": "business_attr"}),
        T.StructField("needs_manual_review", T.BooleanType(), True, {"role": "business_attr"}),
        T.StructField("source_name", T.StringType(), True, {"role": "source_id"}),
    ]),
    "schedules": T.StructType([
        T.StructField("schedule_id", T.LongType(), False, {"role": "technical_id"}),
        T.StructField("train_id", T.LongType(), False, {"role": "foreign_key"}),
        T.StructField("origin_id", T.LongType(), False, {"role": "foreign_key"}),
        T.StructField("destination_id", T.LongType(), False, {"role": "foreign_key"}),
        T.StructField("departure_time", T.TimestampNTZType(), False, {"role": "business_attr"}),
        T.StructField("arrival_time", T.TimestampNTZType(), False, {"role": "business_attr"}),
        T.StructField("duration_min", T.LongType(), False, {"role": "business_attr"}),
        T.StructField("distance_km", T.DecimalType(10, 2), True, {"role": "business_attr"}),
        T.StructField("frequency", T.StringType(), True, {"role": "business_attr"}),
        T.StructField("source_name", T.StringType(), True, {"role": "source_id"}),
    ]),
}

#: Keys by which rows are the same, and the columns that an update takes over.
UPSERT = {
    "operators": (["name", "country", "source_name"], ["website"]),
    "stations": (["name", "country", "source_name"], ["latitude", "longitude", "uic_code", "city"]),
    "trains": (
        ["train_number", "operator_id", "source_name"],
        ["train_type", "category", "route_name", "train_type_rule", "train_type_heuristic", "train_type_ml", "classification_method", "classification_reason", "classification_confidence", "ml_night_probability", "night_percentage", "needs_manual_review"],
    ),
    "schedules": (["train_id", "origin_id", "destination_id", "departure_time"], ["arrival_time", "duration_min", "distance_km", "frequency"]),
}

IDS = {"operators": "operator_id", "stations": "station_id", "trains": "train_id", "schedules": "schedule_id"}

#: Rail route types and others, by code.
RAIL_TYPES = {
    2: "Rail", 100: "Railway Service", 101: "High Speed Rail", 102: "Long Distance Rail", 103: "Inter Regional Rail", 104: "Car Transport Rail",
    105: "Sleeper Rail", 106: "Regional Rail", 107: "Tourist Railway", 108: "Rail Shuttle", 109: "Suburban Railway", 110: "Replacement Rail",
    111: "Special Rail", 112: "Truck Transport Rail", 113: "All Rail Services", 114: "Cross-Country Rail", 115: "Vehicle Transport Rail",
    116: "Rack and Pinion Railway", 117: "Additional Rail",
}
OTHER_TYPES = {0: "Tram", 1: "Subway", 3: "Bus", 4: "Ferry", 5: "Cable Tram", 6: "Aerial Lift", 7: "Funicular", 11: "Trolleybus", 12: "Monorail"}
#: Words in a trip's texts that mark a night service.
NIGHT_WORDS = ("nightjet", "intercites de nuit", "couchette", "couchettes", "sleeper", "sleeping car", "overnight", "train de nuit", "nuit", "nacht", "lit")
BERTH_WORDS = ("couchette", "sleeper", "sleeping car", "lit")
SLEEPER_TYPE = 105
#: Kg of CO2 per km by train and by plane.
CO2_TRAIN, CO2_PLANE = 0.005, 0.215
#: Left-closed distance bins.
BINS = ((0, 200, "0-200"), (200, 400, "200-400"), (400, 600, "400-600"), (600, 800, "600-800"), (800, 1200, "800-1200"), (1200, None, "1200+"))
EARTH_KM = 6371.0
REFERENCE_DATE = "2025-01-15"


class Tables(NamedTuple):
    """The four canonical tables."""

    operators: DataFrame
    stations: DataFrame
    trains: DataFrame
    schedules: DataFrame


def with_missing(df: DataFrame, *names: str, kind: str = "string") -> DataFrame:
    """df with the named columns added as nulls where they are absent."""
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the canonical columns, cast; values that do not fit become null."""
    out = with_missing(df, *SCHEMAS[table].names)
    return out.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name, metadata=f.metadata) for f in SCHEMAS[table]))
