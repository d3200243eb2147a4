"""Day and night services compared: counts, frequency, distance, international reach and connectivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipcoach.operators.views import _mean, _total, by_train
from slipcoach.plans import shared
from slipcoach.plans.schemas import Tables

#: Labels of the distance bands, in order.
BANDS = ("< 200 km", "200-499 km", "500-799 km", "800+ km", "Inconnue")


def cmp_basic_counts(t: Tables) -> DataFrame:
    trains = t.trains.select("train_id", "train_type").join(by_train(t.schedules), "train_id", "left")
    return _counted(trains.groupBy("train_type").agg(F.count("*").alias("nb_trains"), _total("rides").alias("nb_schedules"), *_means("minutes", "timed", "km", "measured")))


def _means(minutes: str, timed: str, km: str, measured: str) -> tuple[Column, Column]:
    return _mean(minutes, timed, 2).alias("avg_duration_min"), _mean(km, measured, 2).alias("avg_distance_km")


def _counted(out: DataFrame) -> DataFrame:
    return out.orderBy(F.asc_nulls_last("train_type"))


def _basic_counts(trains: DataFrame, served: DataFrame) -> DataFrame:
    """As cmp_basic_counts, from trains and the rides of all of them."""
    rides = served.groupBy(F.col("train_type").alias("of")).agg(
        F.count("*").alias("rides"), F.sum("duration_min").alias("minutes"), F.count("duration_min").alias("timed"), F.sum("distance_km").alias("km"), F.count("distance_km").alias("measured")
    )
    held = trains.groupBy("train_type").agg(F.count("*").alias("trains")).join(rides, F.col("train_type").eqNullSafe(F.col("of")), "left")
    return _counted(held.groupBy("train_type").agg(F.sum("trains").alias("nb_trains"), _total("rides").alias("nb_schedules"), *_means("minutes", "timed", "km", "measured")))


def cmp_frequency(t: Tables) -> DataFrame:
    """Routes of each country and type, and services per route."""
    trains = t.trains.select("train_id", "operator_id", "train_type").join(t.operators.select("operator_id", "country"), "operator_id")
    rides = t.schedules.groupBy("train_id", "origin_id", "destination_id").agg(F.count("*").alias("n"))
    return _frequency(rides.join(trains, "train_id").groupBy("country", "train_type", "origin_id", "destination_id").agg(F.sum("n").alias("n")))


def _frequency(routes: DataFrame) -> DataFrame:
    out = routes.groupBy("country", "train_type").agg(F.count("*").alias("nb_unique_routes"), F.sum("n").alias("total_services"), F.round(F.avg("n"), 2).alias("avg_services_per_route"), F.round(F.avg("n") / 7.0, 2).alias("services_per_day"))
    return out.orderBy(F.asc_nulls_last("country"), F.asc_nulls_last("train_type"))


def cmp_distance_segment(t: Tables) -> DataFrame:
    """Services, distance and speed by type and distance band."""
    return _distance_segment(t.schedules.select("train_id", "distance_km", "duration_min").join(t.trains.select("train_id", "train_type"), "train_id"))


def _distance_segment(served: DataFrame) -> DataFrame:
    km = F.col("distance_km")
    band = F.when(km.isNull(), BANDS[4]).when(km < 200, BANDS[0]).when(km < 500, BANDS[1]).when(km < 800, BANDS[2]).otherwise(BANDS[3])
    out = served.select("train_type", km, band.alias("distance_segment"), F.when((F.col("duration_min") > 0) & km.isNotNull(), km / (F.col("duration_min") / 60.0)).alias("speed")).groupBy("train_type", "distance_segment")
    out = out.agg(F.count("*").alias("nb_services"), F.round(F.avg("distance_km"), 2).alias("avg_distance_km"), F.round(F.avg("speed"), 2).alias("avg_speed_kmh"))
    return out.orderBy(F.array_position(F.array(*map(F.lit, BANDS)), F.col("distance_segment")), F.asc_nulls_last("train_type"))


def _abroad(rides: DataFrame, stations: DataFrame) -> DataFrame:
    """Rides between stations of different countries."""
    for end in ("origin", "destination"):
        rides = rides.join(stations.select(F.col("station_id").alias(f"{end}_id"), F.col("country").alias(f"{end}_country")), f"{end}_id")
    return rides.filter("origin_country <> destination_country")


def cmp_international(t: Tables) -> DataFrame:
    """Routes and services between stations of different countries."""
    pairs = t.schedules.groupBy("train_id", "origin_id", "destination_id").agg(F.count("*").alias("n"), F.sum("distance_km").alias("km"), F.count("distance_km").alias("measured"))
    return _reach(_links(_abroad(pairs, t.stations).join(t.trains.select("train_id", "train_type"), "train_id")))


def _reach(links: DataFrame) -> DataFrame:
    out = links.groupBy("train_type").agg(F.count("*").alias("international_routes"), F.sum("n").alias("total_services"), _mean("km", "measured", 2).alias("avg_distance_km"))
    return out.orderBy(F.asc_nulls_last("train_type"))


def cmp_connectivity(t: Tables) -> DataFrame:
    """Distinct origins, destinations and connections of each type, from one distinct set of connections."""
    pairs = t.schedules.select("train_id", "origin_id", "destination_id").distinct().join(t.trains.select("train_id", "train_type"), "train_id")
    return _connectivity(pairs.select("train_type", "origin_id", "destination_id").distinct())


def _connectivity(links: DataFrame) -> DataFrame:
    out = links.groupBy("train_type").agg(F.countDistinct("origin_id").alias("origin_stations"), F.countDistinct("destination_id").alias("destination_stations"), F.count(F.when(F.col("origin_id").isNotNull() & F.col("destination_id").isNotNull(), 1)).alias("unique_connections"))
    return out.orderBy(F.asc_nulls_last("train_type"))


def _links(routes: DataFrame) -> DataFrame:
    """Rides of each type between two stations, from those of each country's operators."""
    return routes.groupBy("train_type", "origin_id", "destination_id").agg(*(F.sum(c).alias(c) for c in ("n", "km", "measured")))


def cmp_all(t: Tables) -> dict[str, DataFrame]:
    """The five comparisons, of tables that they share: each is saved, so that the shuffle that made it is not made again for others.

    Schedules meet trains and operators once. What is asked for by route is added up from the rides of a route, and these from
    those of a route and country. Ids of trains and operators stand once in their tables.
    """
    operators = t.operators.select("operator_id", "country", F.lit(True).alias("known"))
    trains = shared.save(t.trains.select("train_id", "train_type", "operator_id").join(operators, "operator_id", "left").drop("operator_id"), "compared_trains")
    served = shared.save(t.schedules.select("train_id", "origin_id", "destination_id", "duration_min", "distance_km").join(trains, "train_id").drop("train_id"), "compared_rides")
    by_route = served.groupBy("country", "known", "train_type", "origin_id", "destination_id")
    routes = shared.save(by_route.agg(F.count("*").alias("n"), F.sum("distance_km").alias("km"), F.count("distance_km").alias("measured")), "compared_routes")
    links = shared.save(_links(routes), "compared_links")
    return {"basic_counts": _basic_counts(trains, served), "frequency": _frequency(routes.filter("known")), "distance": _distance_segment(served), "international": _reach(_abroad(links, t.stations)), "connectivity": _connectivity(links)}


def cmp_table(t: Tables) -> DataFrame:
    """The five comparisons in one long table: analysis, train_type, part (country or distance band), measure and value."""
    out = None
    for name, df in cmp_all(t).items():
        part = next((F.col(c) for c in ("country", "distance_segment") if c in df.columns), F.lit(None).cast("string"))
        measures = [c for c in df.columns if c not in ("train_type", "country", "distance_segment")]
        wide = df.select(F.lit(name).alias("analysis"), "train_type", part.alias("part"), *(F.col(c).cast("double").alias(c) for c in measures))
        long = wide.unpivot(["analysis", "train_type", "part"], measures, "measure", "value")
        out = long if out is None else out.union(long)
    return out
