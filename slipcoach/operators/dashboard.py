"""Aggregations of the denormalised analytics frame.

Groups drop null keys, sums of nothing are 0, and rounding is half to even, as the dashboards do. Distinct trains are
counted from distinct (group, train) rows, so one shuffle serves all counts of an aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipcoach.functions.timetable import distance_bin, normalized_type, route, valid_station, with_co2
from slipcoach.plans.schemas import BINS, Tables

TYPE = "train_type_normalized"
_CLASSIFIED = ("train_type_rule", "train_type_heuristic", "train_type_ml", "classification_method", "classification_reason", "classification_confidence", "ml_night_probability", "night_percentage", "needs_manual_review")


def analytics_base(t: Tables) -> DataFrame:
    """One row per schedule of a train with an operator: both stations (if known), hours, type, CO2. Cache it for several KPIs."""
    trains = t.trains.select("train_id", "train_number", "operator_id", F.col("train_type").alias("train_type_raw"), *(c for c in _CLASSIFIED if c in t.trains.columns))
    out = t.schedules.select("train_id", "origin_id", "destination_id", "departure_time", "arrival_time", "duration_min", F.col("distance_km").cast("double").alias("distance_km"), F.col("source_name").alias("data_source")).join(trains, "train_id")
    out = out.join(t.operators.select("operator_id", F.col("name").alias("operator"), F.col("country").alias("operator_country"), "website"), "operator_id")
    for end, shown in (("origin", "departure_station"), ("destination", "arrival_station")):
        out = out.join(t.stations.select(F.col("station_id").alias(f"{end}_id"), F.col("name").alias(shown)), f"{end}_id", "left")
    out = out.drop("operator_id", "origin_id", "destination_id")
    return with_co2(out.withColumn("duration_hours", F.col("duration_min") / 60).withColumn(TYPE, normalized_type("train_type_raw")))


def _per_train(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct (keys, train, type) rows with their number of services."""
    return df.groupBy(*keys, "train_id", TYPE).agg(F.count("*").alias("rides"), F.sum("duration_min").alias("minutes"), F.count("duration_min").alias("timed"), F.sum("distance_km").alias("km"), F.count("distance_km").alias("measured"))


def _distinct() -> Column:
    return F.countDistinct("train_id")


def _trains_of(df: DataFrame, *keys: str) -> DataFrame:
    """Trains, day trains, night trains and services of each group: one row for each of its trains, then sums, so nothing is expanded."""
    is_ = lambda kind: F.max((F.col(TYPE) == kind).cast("long")).alias(kind)
    each = df.groupBy(*keys, "train_id").agg(F.count("*").alias("rides"), is_("day"), is_("night")).groupBy(*keys)
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(F.count("train_id").alias("trains"), whole("rides").alias("services"), whole("day").alias("day"), whole("night").alias("night"))


def _mean(total: str, of: str, digits: int = 0) -> Column:
    return F.bround(F.sum(total).cast("double") / F.nullif(F.sum(of), F.lit(0)), digits)


def overview_kpis(df: DataFrame) -> DataFrame:
    """Distinct trains, stations of either end, operators, and schedules."""
    # one pass: each row says four things, counted once for each distinct one
    said = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("name")) for k, c in (("train", "train_id"), ("operator", "operator"), ("station", "departure_station"), ("station", "arrival_station"))))
    names = df.select(F.posexplode(said).alias("at", "said")).select("said.*", (F.col("at") == 0).cast("long").alias("ride"))
    each = names.groupBy("kind", "name").agg(F.sum("ride").alias("rides"))
    count = lambda kind, name: F.count(F.when(F.col("kind") == kind, F.col("name"))).alias(name)
    return each.agg(count("train", "total_trains"), count("station", "total_stations"), count("operator", "total_operators"), F.coalesce(F.sum("rides"), F.lit(0)).cast("long").alias("total_schedules"))


def train_type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col(TYPE).alias("train_type")).agg(F.countDistinct("train_id").alias("count"))


def country_train_counts(df: DataFrame, limit: int = 10) -> DataFrame:
    out = df.filter("operator_country is not null").groupBy(F.col("operator_country").alias("country")).agg(_distinct().alias("nb_trains"))
    return out.orderBy(F.desc("nb_trains"), "country").limit(limit)


def top_operators_summary(df: DataFrame, limit: int = 15) -> DataFrame:
    out = _trains_of(df.dropna(subset=["operator", "operator_country"]), "operator", "operator_country").withColumnRenamed("operator_country", "country")
    return out.orderBy(F.desc("trains"), "operator", "country").limit(limit)


def day_night_country_summary(df: DataFrame) -> DataFrame:
    each = _per_train(df.dropna(subset=["operator_country", TYPE]), "operator_country").groupBy(F.col(TYPE).alias("train_type"), F.col("operator_country").alias("country"))
    return each.agg(_distinct().alias("nb_trains"), F.sum("rides").alias("nb_schedules"), _mean("minutes", "timed").alias("avg_duration"), _mean("km", "measured").alias("avg_distance")).orderBy("country", "train_type")


def operator_summary(df: DataFrame) -> DataFrame:
    """By operator, country and website; operators without a website vanish. Day and night trains are those of operator and country."""
    each = _per_train(df.dropna(subset=["operator", "operator_country", "website"]), "operator", "operator_country", "website")
    whole = each.groupBy("operator", "operator_country", "website").agg(_distinct().alias("nb_trains"), F.sum("rides").alias("nb_schedules"), _mean("minutes", "timed").alias("avg_duration"), _mean("km", "measured").alias("avg_distance"))
    types = _trains_of(df.dropna(subset=["operator", "operator_country"]), "operator", "operator_country").select("operator", "operator_country", F.col("day").alias("day_trains"), F.col("night").alias("night_trains"))
    out = whole.join(types, ["operator", "operator_country"], "left").withColumnsRenamed({"operator": "operator_name", "operator_country": "country"})
    return out.select("operator_name", "country", "website", "nb_trains", "day_trains", "night_trains", "nb_schedules", "avg_duration", "avg_distance").orderBy(F.desc("nb_trains"), "operator_name", "country", "website")


def routes_df(df: DataFrame) -> DataFrame:
    """Rows with two proper station names, and their route."""
    return df.filter(valid_station("departure_station") & valid_station("arrival_station")).withColumn("route", route())


def _km(kind: str, name: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col(TYPE) == kind, F.col("km"))), F.lit(0.0)).alias(name)


def network_kpis(df: DataFrame) -> DataFrame:
    """Routes served by day only, by night only and by both; km of each type."""
    routes = routes_df(df).groupBy("route", TYPE).agg(F.sum("distance_km").alias("km"))
    served = routes.groupBy("route").agg(F.max(F.col(TYPE) == "day").alias("d"), F.max(F.col(TYPE) == "night").alias("n"), F.sum(F.when(F.col(TYPE) == "day", F.col("km"))).alias("dk"), F.sum(F.when(F.col(TYPE) == "night", F.col("km"))).alias("nk"))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0.0)).alias(name)
    return served.agg(count(F.expr("d and not n"), "only_day"), count(F.expr("n and not d"), "only_night"), count(F.expr("d and n"), "both"), total("dk", "day_km"), total("nk", "night_km"))


def label_of_type() -> Column:
    return F.when(F.col(TYPE) == "day", "Day").when(F.col(TYPE) == "night", "Night").alias("label")


def od_coverage(df: DataFrame) -> DataFrame:
    return routes_df(df).filter(F.col(TYPE).isNotNull()).groupBy(TYPE).agg(F.countDistinct("route").alias("nb_routes")).select("*", label_of_type())


def service_km(df: DataFrame) -> DataFrame:
    return df.filter(F.col(TYPE).isNotNull()).groupBy(TYPE).agg(F.coalesce(F.sum("distance_km"), F.lit(0.0)).alias("total_km")).select("*", label_of_type())


def top_operators_by_type(df: DataFrame, top_n: int = 5) -> DataFrame:
    """The operators with most services by day, and those by night."""
    counts = df.filter("operator is not null").groupBy("operator", TYPE).agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy(TYPE).orderBy(F.desc("count"), "operator"))
    return counts.filter(F.col(TYPE).isin("day", "night")).withColumn("rank", rank).filter(F.col("rank") <= top_n).drop("rank")


def country_breakdown(df: DataFrame, top_n: int = 20) -> DataFrame:
    counts = df.dropna(subset=["operator_country", TYPE]).groupBy(F.col("operator_country").alias("country"), F.col(TYPE).alias("train_type")).agg(F.count("*").alias("count"))
    top = counts.groupBy("country").agg(F.sum("count").alias("all")).orderBy(F.desc("all"), "country").limit(top_n)
    return counts.join(top, "country", "left_semi")


def long_distance_base(df: DataFrame, min_distance_km: float = 500) -> DataFrame:
    return df.dropna(subset=["distance_km", TYPE]).filter(F.col("distance_km") >= min_distance_km)


def long_distance_kpis(df: DataFrame, min_distance_km: float = 500) -> DataFrame:
    is_ = lambda kind: F.col(TYPE) == kind
    part = lambda kind: F.coalesce(F.bround(F.count(F.when(is_(kind), 1)) * 100.0 / F.nullif(F.count(F.when(F.col(TYPE).isin("day", "night"), 1)), F.lit(0)), 1), F.lit(0.0))
    co2 = lambda kind: F.coalesce(F.bround(F.avg(F.when(is_(kind), F.col("co2_saving_kg"))), 1), F.lit(0.0))
    services = F.count(F.when(F.col(TYPE).isin("day", "night"), 1))
    return long_distance_base(df, min_distance_km).agg(services.alias("services"), part("night").alias("night_pct"), part("day").alias("day_pct"), co2("night").alias("avg_co2_night"), co2("day").alias("avg_co2_day"))


def _binned(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["distance_km", TYPE]).withColumn("segment", distance_bin()).filter("segment is not null")


def distance_segments(df: DataFrame) -> DataFrame:
    """Day and night services and the night share of every bin, empty ones too."""
    bins = df.sparkSession.createDataFrame([(label,) for _, _, label in BINS], "segment string")
    counts = _binned(df).groupBy("segment").agg(F.count(F.when(F.col(TYPE) == "day", 1)).alias("day"), F.count(F.when(F.col(TYPE) == "night", 1)).alias("night"))
    out = bins.join(counts, "segment", "left").na.fill(0, ["day", "night"])
    return out.withColumn("night_pct", F.coalesce(F.col("night") * 100.0 / F.nullif(F.col("day") + F.col("night"), F.lit(0)), F.lit(0.0)))


def long_distance_co2(df: DataFrame, min_distance_km: float = 500) -> DataFrame:
    return long_distance_base(df, min_distance_km).groupBy(F.col(TYPE).alias("train_type")).agg(F.avg("co2_saving_kg").alias("avg_co2"), F.coalesce(F.sum("co2_saving_kg"), F.lit(0.0)).alias("total_co2"))


def night_corridors(df: DataFrame, min_distance_km: float = 500, min_minutes: float = 360, limit: int = 10) -> DataFrame:
    rides = routes_df(df.filter((F.col(TYPE) == "night") & (F.col("distance_km") >= min_distance_km) & (F.col("duration_min") >= min_minutes)))
    out = rides.groupBy("route").agg(F.count("train_id").alias("services"), F.avg("co2_saving_kg").alias("avg_co2"), F.avg("distance_km").alias("avg_distance"))
    return out.orderBy(F.desc("services"), "route").limit(limit)


def night_shift_candidates(df: DataFrame, min_distance_km: float = 400, min_minutes: float = 240, limit: int = 10) -> DataFrame:
    """Long day routes that no long night service runs."""
    routes = routes_df(df).filter(F.col("distance_km") >= min_distance_km)
    night = routes.filter(F.col(TYPE) == "night").select("route").distinct()
    day = routes.filter((F.col(TYPE) == "day") & (F.col("duration_min") >= min_minutes))
    out = day.groupBy("route").agg(F.count("train_id").alias("services"), F.avg("distance_km").alias("avg_dist"), F.avg("co2_saving_kg").alias("avg_co2"))
    return out.join(night, "route", "left_anti").orderBy(F.desc("services"), "route").limit(limit)


def total_co2(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum("co2_saving_kg"), F.lit(0.0)).alias("total_co2_kg"))


def classification_summary(df: DataFrame) -> DataFrame:
    """On distinct trains: counts by method, reviews, and the spread of confidence. One row per method, the rest repeated."""
    # one aggregate by train, one of the few distinct verdicts; the median is read off their running counts
    names = ("classification_method", "needs_manual_review", "classification_confidence")
    trains = df.groupBy("train_id").agg(*(F.min(c).alias(c) for c in names))
    kinds = trains.groupBy(*names).agg(F.count("*").alias("n")).withColumn("sure", F.col("classification_confidence").cast("double"))
    every = kinds.agg(
        F.sum("n").alias("total_trains"), F.coalesce(F.sum(F.when(F.col("needs_manual_review"), F.col("n"))), F.lit(0)).alias("review_count"), (F.sum(F.col("sure") * F.col("n")) / F.sum(F.when(F.col("sure").isNotNull(), F.col("n")))).alias("mean_confidence"),
        F.expr("percentile(sure, 0.5, n)").alias("median_confidence"), F.min("sure").alias("min_confidence"), F.max("sure").alias("max_confidence"), F.collect_list(F.struct("classification_method", "n")).alias("verdicts"),
    )
    every = every.withColumn("review_pct", F.bround(F.col("review_count") * 100.0 / F.nullif("total_trains", F.lit(0)), 1))
    out = every.select("*", F.explode("verdicts").alias("v")).select("v.*", *(c for c in every.columns if c != "verdicts")).filter("classification_method is not null")
    shown = ("total_trains", "review_count", "mean_confidence", "median_confidence", "min_confidence", "max_confidence", "review_pct")
    return out.groupBy("classification_method", *shown).agg(F.sum("n").alias("method_count")).select("classification_method", "method_count", *shown)


def segment_type_counts(df: DataFrame) -> DataFrame:
    return _binned(df).groupBy("segment", TYPE).agg(F.count("*").alias("count"))


def segment_night_share(df: DataFrame) -> DataFrame:
    return _binned(df).groupBy("segment").agg((F.count(F.when(F.col(TYPE) == "night", 1)) * 100.0 / F.count("*")).alias("night_pct"))


def day_night_pair(df: DataFrame) -> DataFrame:
    """Distinct day and night trains, and the night trains' share."""
    out = df.select("train_id", TYPE).distinct().agg(F.count(F.when(F.col(TYPE) == "day", 1)).alias("day"), F.count(F.when(F.col(TYPE) == "night", 1)).alias("night"))
    return out.withColumn("night_pct", F.coalesce(F.bround(F.col("night") * 100.0 / F.nullif(F.col("day") + F.col("night"), F.lit(0)), 1), F.lit(0.0)))


def _top_by(df: DataFrame, key: str, limit: int) -> DataFrame:
    counts = df.dropna(subset=[key, TYPE]).groupBy(key, TYPE).agg(F.countDistinct("train_id").alias("trains"))
    top = counts.groupBy(key).agg(F.sum("trains").alias("all")).orderBy(F.desc("all"), key).limit(limit)
    return counts.join(top.select(key), key, "left_semi")


def trains_by_country_top10(df: DataFrame, limit: int = 10) -> DataFrame:
    return _top_by(df, "operator_country", limit)


def operators_top10(df: DataFrame, limit: int = 10) -> DataFrame:
    return _top_by(df, "operator", limit)


def top_links(df: DataFrame, limit: int = 10) -> DataFrame:
    """The routes with most distinct trains, fewest of them first."""
    counts = routes_df(df).select("route", TYPE, "train_id").distinct().groupBy("route").pivot(TYPE, ["day", "night"]).count().na.fill(0)
    top = counts.withColumn("total", F.col("day") + F.col("night")).orderBy(F.desc("total"), "route").limit(limit)
    return top.orderBy("total", F.desc("route"))


def filter_by_country(df: DataFrame, country: str = "all") -> DataFrame:
    return df if country == "all" else df.filter(F.col("operator_country") == country)


def apply_dashboard_filters(df: DataFrame, country: str = "Tous", train_type: str = "Tous", distance_min: float = 0, distance_max: float = 5000) -> DataFrame:
    """Rows without a distance stay."""
    if country != "Tous":
        df = df.filter(F.col("operator_country") == country)
    if train_type != "Tous":
        df = df.filter(F.col(TYPE) == {"Jour": "day", "Nuit": "night"}[train_type])
    return df.filter(F.col("distance_km").isNull() | F.col("distance_km").between(distance_min, distance_max))


def filter_zero_or_range(df: DataFrame, distance_min: float = 0, distance_max: float = 5000) -> DataFrame:
    """Rows with no distance or distance 0 stay."""
    return df.filter(F.col("distance_km").isNull() | (F.col("distance_km") == 0) | F.col("distance_km").between(distance_min, distance_max))


def filter_options(df: DataFrame) -> DataFrame:
    """Countries in order, each with the largest distance of all rows."""
    most = df.agg(F.max("distance_km").alias("max_distance"))
    return df.filter("operator_country is not null").select(F.col("operator_country").alias("country")).distinct().crossJoin(most).orderBy("country")  # a single row


def front_day_night_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.when(F.col("train_type") == "day", 1)).alias("day"), F.count(F.when(F.col("train_type") == "night", 1)).alias("night"))
