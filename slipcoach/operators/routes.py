"""Network figures from the canonical tables by ids; the frame versions in dashboard.py serve files that have names only.

Schedules are added up by the ids of their stations, and by train where trains count, before any name is joined: the large table
meets the trains once and carries numbers only. Names come to the distinct pairs of stations, and pairs whose stations share
their names, one more small aggregate, are one route. No aggregate counts several distinct things at once, so no row is expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipcoach.functions.timetable import normalized_type, route, valid_station, with_co2
from slipcoach.operators.dashboard import TYPE, label_of_type
from slipcoach.plans.schemas import Tables

_PAIR = ("origin_id", "destination_id")


def _trains(t: Tables) -> DataFrame:
    """Trains with an operator that is there."""
    held = t.trains.join(t.operators.select("operator_id"), "operator_id", "left_semi")
    return held.select("train_id", "operator_id", normalized_type("train_type").alias(TYPE))


def rides(t: Tables) -> DataFrame:
    """Schedules of trains with an operator, by ids."""
    rows = t.schedules.select("train_id", *_PAIR, "duration_min", F.col("distance_km").cast("double").alias("distance_km"))
    return with_co2(rows.join(_trains(t).drop("operator_id"), "train_id"))


def _named(pairs: DataFrame, t: Tables) -> DataFrame:
    """Rows with both ids and the route that their stations' names make; those without two proper names go."""
    out = pairs
    for end, shown in zip(_PAIR, ("departure_station", "arrival_station"), strict=True):
        out = out.join(t.stations.select(F.col("station_id").alias(end), F.col("name").alias(shown)).filter(valid_station(shown)), end)
    return out.withColumn("route", route()).drop("departure_station", "arrival_station")


def _sum(name: str, of: Column | str = "*", when: Column | None = None) -> tuple[Column, Column]:
    """(in each pair of stations, in each route)"""
    inner = F.count(when if when is not None else F.lit(1)) if of == "*" else F.sum(F.when(when, F.col(of)) if when is not None else F.col(of))
    return inner.alias(name), F.sum(name).alias(name)


def by_route(rows: DataFrame, t: Tables, *sums: tuple[Column, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """(route, keys, sums): added up by pair of stations, then by route."""
    pairs = rows.groupBy(*_PAIR, *keys).agg(*(inner for inner, _ in sums))
    return _named(pairs, t).groupBy("route", *keys).agg(*(outer for _, outer in sums))


def network_kpis(t: Tables) -> DataFrame:
    """Routes served by day only, by night only and by both; km of each type."""
    is_ = lambda kind: F.when(F.col(TYPE) == kind, 1)
    served = by_route(rides(t), t, _sum("d", when=is_("day")), _sum("n", when=is_("night")), _sum("dk", "distance_km", F.col(TYPE) == "day"), _sum("nk", "distance_km", F.col(TYPE) == "night"))
    count = lambda c, name: F.count(F.when(F.expr(c), 1)).alias(name)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0.0)).alias(name)
    return served.agg(count("d > 0 and n = 0", "only_day"), count("n > 0 and d = 0", "only_night"), count("d > 0 and n > 0", "both"), total("dk", "day_km"), total("nk", "night_km"))


def od_coverage(t: Tables) -> DataFrame:
    """Distinct routes of each type."""
    return by_route(rides(t), t, _sum("rides"), keys=(TYPE,)).groupBy(TYPE).agg(F.count("*").alias("nb_routes")).select("*", label_of_type())


def _mean(total: str, of: str) -> Column:
    return F.col(total) / F.nullif(F.col(of), F.lit(0))


def night_corridors(t: Tables, min_distance_km: float = 500, min_minutes: float = 360, limit: int = 10) -> DataFrame:
    rows = rides(t).filter((F.col(TYPE) == "night") & (F.col("distance_km") >= min_distance_km) & (F.col("duration_min") >= min_minutes))
    out = by_route(rows, t, _sum("services"), _sum("co2", "co2_saving_kg"), _sum("km", "distance_km"))
    out = out.select("route", "services", _mean("co2", "services").alias("avg_co2"), _mean("km", "services").alias("avg_distance"))
    return out.orderBy(F.desc("services"), "route").limit(limit)


def night_shift_candidates(t: Tables, min_distance_km: float = 400, min_minutes: float = 240, limit: int = 10) -> DataFrame:
    """Long day routes that no long night service runs."""
    rows = rides(t).filter(F.col("distance_km") >= min_distance_km)
    long_day = (F.col(TYPE) == "day") & (F.col("duration_min") >= min_minutes)
    out = by_route(rows, t, _sum("services", when=F.when(long_day, 1)), _sum("night", when=F.when(F.col(TYPE) == "night", 1)), _sum("km", "distance_km", long_day), _sum("co2", "co2_saving_kg", long_day))
    out = out.filter("services > 0 and night = 0").select("route", "services", _mean("km", "services").alias("avg_dist"), _mean("co2", "services").alias("avg_co2"))
    return out.orderBy(F.desc("services"), "route").limit(limit)


def top_links(t: Tables, limit: int = 10) -> DataFrame:
    """The routes with most distinct trains, fewest of them first."""
    runs = t.schedules.select("train_id", *_PAIR).distinct()
    # pairs of one name are one route, known by the least of them until names are shown
    pairs = _named(runs.select(*_PAIR).distinct(), t)
    one = pairs.groupBy("route").agg(F.min(F.struct(*_PAIR)).alias("as"))
    known = pairs.join(one, "route").select(*_PAIR, F.col("as.origin_id").alias("o"), F.col("as.destination_id").alias("d"))
    counts = runs.join(known, list(_PAIR)).select("o", "d", "train_id").distinct().join(_trains(t).drop("operator_id"), "train_id")
    is_ = lambda kind: F.count(F.when(F.col(TYPE) == kind, 1)).alias(kind)
    sums = counts.groupBy("o", "d").agg(is_("day"), is_("night")).withColumn("total", F.col("day") + F.col("night"))
    shown = sums.join(one.select("route", F.col("as.origin_id").alias("o"), F.col("as.destination_id").alias("d")), ["o", "d"])
    top = shown.select("route", "day", "night", "total").orderBy(F.desc("total"), "route").limit(limit)
    return top.orderBy("total", F.desc("route"))


def overview_kpis(t: Tables) -> DataFrame:
    """Distinct trains, stations of either end by name, operators by name, and schedules."""
    runs = t.schedules.groupBy("train_id", *_PAIR).agg(F.count("*").alias("rides")).join(_trains(t).drop(TYPE), "train_id")
    trains = runs.groupBy("train_id").agg(F.sum("rides").alias("rides")).agg(F.count("*").alias("total_trains"), F.coalesce(F.sum("rides"), F.lit(0)).cast("long").alias("total_schedules"))
    names = lambda ids, of, key, as_: ids.distinct().join(of.select(key, "name"), key).agg(F.countDistinct("name").alias(as_))
    ends = runs.select(F.col("origin_id").alias("station_id")).distinct().union(runs.select("destination_id").distinct())
    stations = names(ends, t.stations, "station_id", "total_stations")
    operators = names(runs.select("operator_id"), t.operators, "operator_id", "total_operators")
    return trains.crossJoin(stations).crossJoin(operators).select("total_trains", "total_stations", "total_operators", "total_schedules")  # single rows
