"""Distances from coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipcoach.functions.timetable import haversine_km


def fill_distances(schedules: DataFrame, stations: DataFrame, source_name: str | None = None) -> DataFrame:
    """Missing distances from the stations' coordinates, one digit; others, and those without all four, stay. source_name is ignored."""
    out = schedules
    for end in ("origin", "destination"):
        side = stations.select(F.col("station_id").alias(f"{end}_id"), F.col("latitude").cast("double").alias(f"__{end}_lat"), F.col("longitude").cast("double").alias(f"__{end}_lon"))
        out = out.join(side, f"{end}_id", "left")
    km = F.round(haversine_km(F.col("__origin_lat"), F.col("__origin_lon"), F.col("__destination_lat"), F.col("__destination_lon")), 1)
    filled = out.withColumn("distance_km", F.coalesce(F.col("distance_km").cast("double"), km))
    return filled.select(schedules.columns)
