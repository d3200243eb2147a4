"""Column expressions for clocks, night shares, distances and emissions; all native, none with a Python function."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipcoach.plans.schemas import BINS, CO2_PLANE, CO2_TRAIN, EARTH_KM, REFERENCE_DATE

CLOCK_LIKE = r"^\d{1,2}:\d{2}(:\d{2})?$"


def clock_seconds(text: str | Column) -> Column:
    """'HH:MM:SS' as seconds since midnight of the service day; hours may pass 24. Anything else, 'H:MM' too, is null."""
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    part = F.split(text, ":")
    seconds = part[0].cast("long") * 3600 + part[1].cast("long") * 60 + part[2].cast("long")
    return F.when(text.rlike(r"^\d{1,9}:[0-5]?\d:[0-5]?\d$"), seconds)


def clock_of_day(text: str) -> Column:
    """'H:MM' or 'H:MM:SS' as 'HH:MM:SS' with the hour modulo 24; anything else is null."""
    text = F.trim(F.col(text))
    part = F.split(text, ":")
    shown = F.format_string("%02d:%02d:%02d", part[0].cast("int") % 24, part[1].cast("int"), F.coalesce(F.get(part, 2).cast("int"), F.lit(0)))
    return F.when(text.rlike(r"^\d{1,9}:[0-5]?\d(:[0-5]?\d)?$"), shown)


def iso_seconds(text: str | Column) -> Column:
    """The clock of an ISO timestamp, as seconds of the day (UTC)."""
    text = F.col(text) if isinstance(text, str) else text
    at = F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-"), text))
    return (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).cast("long")


def anchored(seconds: Column, day: str = REFERENCE_DATE) -> Column:
    """A timestamp without zone: seconds after the start of the reference day."""
    return F.timestamp_add("SECOND", seconds.cast("int"), F.lit(day).cast("timestamp_ntz"))


def ride_minutes(departure: Column, arrival: Column) -> Column:
    """Minutes between two clock readings in seconds; not after the departure means the day after."""
    minutes = (arrival - departure) / 60
    return F.when(minutes <= 0, minutes + 1440).otherwise(minutes)


def night_minutes(start: Column, length: Column) -> Column:
    """Whole minutes of [start, start + length) that lie in 21:00 - 05:00; start in minutes since any midnight."""

    def until(x: Column) -> Column:
        of_day = F.pmod(x, F.lit(1440))
        return F.floor(x / 1440) * 480 + F.least(of_day, F.lit(300)) + F.greatest(F.lit(0), of_day - 1260)

    begin = F.pmod(F.floor(start), F.lit(1440))
    return until(begin + F.floor(length)) - until(begin)


def night_percentage(start: Column, length: Column) -> Column:
    """Share of a ride at night, in percent with two digits; 0 without times."""
    return F.coalesce(F.when(length > 0, F.bround(night_minutes(start, length) * 100.0 / length, 2)), F.lit(0.0))


def day_or_night(hour: Column) -> Column:
    """The classifier's clock: 5 to 20 is day."""
    return F.when((hour >= 5) & (hour < 21), "day").otherwise("night")


def train_type_of(hour: Column) -> Column:
    """The database function's clock: 6 to 21 is day, and no hour is night."""
    return F.when(hour.between(6, 21), "day").otherwise("night")


def duration_minutes(start: str, end: str) -> Column:
    return F.round((F.unix_timestamp(F.col(end).cast("timestamp")) - F.unix_timestamp(F.col(start).cast("timestamp"))) / 60).cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the argument of asin cannot pass 1."""
    half = lambda x: F.sin(x / 2) * F.sin(x / 2)
    a = half(F.radians(lat2) - F.radians(lat1)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(F.radians(lon2) - F.radians(lon1))
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def with_co2(df: DataFrame, distance: str = "distance_km") -> DataFrame:
    emitted = F.col(distance) * CO2_TRAIN
    return df.withColumns({"co2_emission_kg": emitted, "co2_saving_kg": F.col(distance) * CO2_PLANE - emitted})


def normalized_type(kind: str) -> Column:
    return F.when(F.lower(F.trim(kind)).contains("night"), "night").otherwise("day")


def valid_station(name: str) -> Column:
    """Names that are there and do not look like a clock."""
    return F.col(name).isNotNull() & ~F.trim(name).rlike(CLOCK_LIKE)


def route(departure: str = "departure_station", arrival: str = "arrival_station") -> Column:
    return F.concat(F.trim(departure), F.lit(" -> "), F.trim(arrival))


def distance_bin(distance: str = "distance_km") -> Column:
    out = F.lit(None).cast("string")
    for low, high, label in reversed(BINS):
        inside = F.col(distance) >= low
        out = F.when(inside if high is None else inside & (F.col(distance) < high), label).otherwise(out)
    return out


def label_of(code: Column, labels: Mapping[int, str], default: str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), F.lit(default))
