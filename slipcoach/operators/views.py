"""Views over the canonical tables and the listing, detail and count queries.

Averages over schedules of wider groups come from sums by train, taken before the joins: schedules, the one large table,
is shuffled once by train (or not at all, when its map-side sums suffice) and never carries names along. Every listing has a
unique last sort key, and nulls sort last in ascending and first in descending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipcoach.plans.schemas import Tables


def by_train(schedules: DataFrame) -> DataFrame:
    """What wider averages need of each train's schedules."""
    return schedules.groupBy("train_id").agg(
        F.count("*").alias("rides"), F.sum("duration_min").alias("minutes"), F.count("duration_min").alias("timed"), F.sum("distance_km").alias("km"),
        F.count("distance_km").alias("measured"), F.min("duration_min").alias("shortest"), F.max("duration_min").alias("longest"),
    )


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("long")


def _mean(total: str, of: str, digits: int = 0) -> Column:
    return F.round(F.sum(total).cast("double") / F.nullif(F.sum(of), F.lit(0)), digits)


def _of_type(kind: str) -> Column:
    return F.count(F.when(F.col("train_type") == kind, F.lit(1)))


def _trains(t: Tables) -> DataFrame:
    return t.trains.select("train_id", "operator_id", "train_type")


def v_operator_summary(t: Tables) -> DataFrame:
    """Trains, day and night trains, schedules and averages of every operator, with or without trains."""
    trains = _trains(t).join(by_train(t.schedules), "train_id", "left")
    each = trains.groupBy("operator_id").agg(F.count("*").alias("trains"), _of_type("day").alias("day"), _of_type("night").alias("night"), *(F.sum(c).alias(c) for c in ("rides", "minutes", "timed", "km", "measured")))
    return (
        t.operators.select("operator_id", F.col("name").alias("operator_name"), "country").join(each, "operator_id", "left").groupBy("operator_id", "operator_name", "country")
        .agg(_total("trains").alias("total_trains"), _total("day").alias("day_trains"), _total("night").alias("night_trains"), _total("rides").alias("total_schedules"), _mean("minutes", "timed").alias("avg_duration_min"), _mean("km", "measured").alias("avg_distance_km"))
        .orderBy(F.desc_nulls_first("total_trains"), "operator_id")
    )


def _by_country(t: Tables, **ends: str) -> DataFrame:
    """Sums over every operators' country; ends: name of a count and the station column whose distinct values it counts.

    One aggregate of the schedules by train and the stations asked for serves all sums and counts of theirs; trains are
    counted from their own table.
    """
    rides = t.schedules.groupBy("train_id", *ends.values()).agg(
        F.count("*").alias("rides"), F.sum("duration_min").alias("minutes"), F.count("duration_min").alias("timed"), F.sum("distance_km").alias("km"), F.count("distance_km").alias("measured")
    )
    trains = _trains(t).join(t.operators.select("operator_id", F.col("country").alias("of")), "operator_id")
    held = trains.groupBy("of").agg(F.count("*").alias("trains"), _of_type("day").alias("day"), _of_type("night").alias("night"))
    of_country = rides.join(trains.select("train_id", "of"), "train_id")
    ridden = of_country.groupBy("of").agg(*(F.sum(c).alias(c) for c in ("rides", "minutes", "timed", "km", "measured")))
    # each distinct count from rows of its own: several in one aggregate would copy every row for each of them
    counted = [of_country.select("of", end).distinct().groupBy("of").agg(F.count(end).alias(name)) for name, end in ends.items()]
    out = t.operators.groupBy("country").agg(F.count("*").alias("nb_operators"))
    for part in (held, ridden, *counted):
        out = out.join(part, F.col("country").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in ends})


def _country_columns(*ends: str) -> list[Column]:
    whole = lambda c, alias: F.coalesce(c, F.lit(0)).cast("long").alias(alias)
    mean = lambda a, b, alias: F.round(F.col(a).cast("double") / F.nullif(b, F.lit(0)), 0).alias(alias)
    return [F.col("country"), F.col("nb_operators"), whole("trains", "nb_trains"), whole("day", "day_trains"), whole("night", "night_trains"), *map(F.col, ends), mean("minutes", "timed", "avg_duration_min"), mean("km", "measured", "avg_distance_km")]


def v_country_stats(t: Tables) -> DataFrame:
    """Operators, trains, stations at both ends and averages of every operators' country."""
    out = _by_country(t, nb_origin_stations="origin_id", nb_destination_stations="destination_id")
    return out.select(*_country_columns("nb_origin_stations", "nb_destination_stations")).orderBy(F.desc_nulls_first("nb_trains"), F.asc_nulls_last("country"))


def stats_by_country(t: Tables) -> DataFrame:
    out = _by_country(t, nb_stations="origin_id").withColumn("nb_schedules", F.coalesce("rides", F.lit(0)).cast("long"))
    return out.select(*_country_columns("nb_stations", "nb_schedules")).orderBy(F.desc_nulls_first("nb_trains"), F.asc_nulls_last("country"))


def day_night_comparison(t: Tables, country: str | None = None) -> DataFrame:
    """Trains, schedules and durations by country and type."""
    operators = t.operators if country is None else t.operators.filter(F.col("country") == country)
    trains = _trains(t).join(operators.select("operator_id", "country"), "operator_id").join(by_train(t.schedules), "train_id", "left")
    return (
        trains.groupBy("country", "train_type")
        .agg(F.count("*").alias("nb_trains"), _total("rides").alias("nb_schedules"), _mean("minutes", "timed").alias("avg_duration_min"), _mean("km", "measured").alias("avg_distance_km"), F.min("shortest").alias("min_duration"), F.max("longest").alias("max_duration"))
        .orderBy(F.asc_nulls_last("country"), F.asc_nulls_last("train_type"))
    )


v_day_night_comparison = day_night_comparison


def _ends(t: Tables, *columns: str, how: str = "inner") -> DataFrame:
    """Schedules with both stations' columns as origin_* and destination_*."""
    out = t.schedules
    for end in ("origin", "destination"):
        side = t.stations.select(F.col("station_id").alias(f"{end}_id"), *(F.col(c).alias(f"{end}_{c}") for c in columns))
        out = out.join(side, f"{end}_id", how)
    return out


def v_schedules_detailed(t: Tables) -> DataFrame:
    """Schedules with train, operator and both stations."""
    trains = t.trains.select("train_id", "train_number", "train_type", "category", "operator_id")
    operators = t.operators.select("operator_id", F.col("name").alias("operator_name"), F.col("country").alias("operator_country"))
    out = _ends(t, "name", "city", "country").join(trains, "train_id").join(operators, "operator_id")
    return out.select(
        "schedule_id", "train_id", "train_number", "train_type", "category", "operator_id", "operator_name", "operator_country", "origin_id", "origin_name", "origin_city", "origin_country",
        "destination_id", "destination_name", "destination_city", "destination_country", "departure_time", "arrival_time", "duration_min", "distance_km", "frequency",
    )


def _like(column: str, part: str) -> Column:
    return F.col(column).ilike(f"%{part}%")


#: The largest pages of listings, of a station's calls, and of the routes with most services.
MOST, MOST_CALLS, MOST_ROUTES = 1000, 500, 50


def _page(df: DataFrame, limit: int | None, offset: int = 0, most: int = MOST) -> DataFrame:
    """Rows offset+1 to offset+limit; None is no limit. Other limits than 1 to most, or an offset below 0, are errors."""
    if limit is not None and not 1 <= limit <= most:
        raise ValueError(f"limit {limit} is not within 1 and {most}")
    if offset < 0:
        raise ValueError(f"offset {offset} is below 0")
    out = df.offset(offset) if offset else df
    return out if limit is None else out.limit(limit)


def list_trains(t: Tables, train_type: str | None = None, operator: str | None = None, category: str | None = None, country: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    out = t.trains.join(t.operators.select("operator_id", F.col("name").alias("operator_name"), "country"), "operator_id")
    if train_type:
        out = out.filter(F.col("train_type") == train_type)
    if operator:
        out = out.filter(_like("operator_name", operator))
    if category:
        out = out.filter(_like("category", category))
    if country:
        out = out.filter(F.col("country") == country)
    return _page(out.select("train_id", "train_number", "operator_name", "train_type", "category", "route_name").orderBy("train_id"), limit, offset)


def train_detail(t: Tables, train_id: int) -> DataFrame:
    """One train with its operator, and a struct of its classification, null if it has no method."""
    parts = [c for c in ("train_type_rule", "train_type_heuristic", "train_type_ml", "classification_method", "classification_reason", "classification_confidence", "ml_night_probability", "night_percentage", "needs_manual_review") if c in t.trains.columns]
    out = t.trains.filter(F.col("train_id") == train_id).join(t.operators.select("operator_id", F.col("name").alias("operator_name"), "country"), "operator_id")
    return out.select("train_id", "train_number", "operator_id", "operator_name", "country", "train_type", "category", "route_name", F.when(F.col("classification_method").isNotNull(), F.struct(*parts)).alias("classification"))


def train_schedules(t: Tables, train_id: int, limit: int | None = 100) -> DataFrame:
    own = t._replace(schedules=t.schedules.filter(F.col("train_id") == train_id))
    out = _ends(own, "name", "city").orderBy(F.asc_nulls_last("departure_time"), "schedule_id")
    return _page(out.select("schedule_id", F.col("origin_name").alias("origin"), "origin_city", F.col("destination_name").alias("destination"), "destination_city", "departure_time", "arrival_time", "duration_min", "distance_km"), limit)


def count_trains_by_type(t: Tables) -> DataFrame:
    return t.trains.groupBy("train_type").agg(F.count("*").alias("count"))


def count_trains_by_country(t: Tables) -> DataFrame:
    out = _trains(t).join(t.operators.select("operator_id", "country"), "operator_id").groupBy("country")
    return out.agg(F.count("*").alias("total"), _of_type("day").alias("day_count"), _of_type("night").alias("night_count")).orderBy(F.desc_nulls_first("total"), F.asc_nulls_last("country"))


def _served(t: Tables) -> DataFrame:
    """Schedules with train and stations; a missing city shows the name, a missing country EU."""
    out = _ends(t, "name", "city", "country").join(t.trains.select("train_id", "train_number", "train_type", "category", "operator_id"), "train_id")
    shown = {}
    for end in ("origin", "destination"):
        shown |= {f"{end}_shown_city": F.coalesce(f"{end}_city", f"{end}_name"), f"{end}_shown_country": F.coalesce(f"{end}_country", F.lit("EU"))}
    return out.withColumns(shown)


def _shown(*before: str) -> list[Column]:
    ends = [c for end in ("origin", "destination") for c in (F.col(f"{end}_name").alias(end), F.col(f"{end}_shown_city").alias(f"{end}_city"), F.col(f"{end}_shown_country").alias(f"{end}_country"))]
    return [F.col("schedule_id"), F.col("train_number"), *map(F.col, before), *ends, *map(F.col, ("departure_time", "arrival_time", "duration_min", "distance_km"))]


def list_schedules(t: Tables, origin: str | None = None, destination: str | None = None, train_type: str | None = None, country: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    out = _served(t)
    if origin:
        out = out.filter(_like("origin_city", origin))
    if destination:
        out = out.filter(_like("destination_city", destination))
    if train_type:
        out = out.filter(F.col("train_type") == train_type)
    if country:
        out = out.filter((F.col("origin_country") == country) | (F.col("destination_country") == country))
    return _page(out.select(*_shown("train_type")).orderBy(F.asc_nulls_last("departure_time"), "schedule_id"), limit, offset)


def search_schedules(t: Tables, from_city: str, to_city: str, travel_date: str | None = None, train_type: str | None = None, on_date: bool = False) -> DataFrame:
    """travel_date counts only with on_date: by default it is accepted and ignored."""
    out = _served(t).join(t.operators.select("operator_id", F.col("name").alias("operator_name")), "operator_id")
    out = out.filter(_like("origin_city", from_city) | _like("origin_name", from_city)).filter(_like("destination_city", to_city) | _like("destination_name", to_city))
    if train_type:
        out = out.filter(F.col("train_type") == train_type)
    if travel_date and on_date:
        out = out.filter(F.to_date("departure_time") == F.lit(travel_date).cast("date"))
    return out.select(*_shown("operator_name", "train_type", "category")).orderBy(F.asc_nulls_last("duration_min"), "schedule_id")


def schedule_detail(t: Tables, schedule_id: int) -> DataFrame:
    own = _served(t._replace(schedules=t.schedules.filter(F.col("schedule_id") == schedule_id)))
    return own.select(*_shown("train_type"), "frequency")


_STATION = ("station_id", "name", "city", "country", "latitude", "longitude", "uic_code")


def list_stations(t: Tables, country: str | None = None, city: str | None = None, name: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    out = t.stations
    if country:
        out = out.filter(F.col("country") == country)
    if city:
        out = out.filter(_like("city", city))
    if name:
        out = out.filter(_like("name", name))
    return _page(out.select(*_STATION).orderBy("name", "station_id"), limit, offset)


def station_detail(t: Tables, station_id: int) -> DataFrame:
    return t.stations.filter(F.col("station_id") == station_id).select(*_STATION)


def _calls(t: Tables, station_id: int, here: str, there: str, at: str, train_type: str | None, limit: int | None) -> DataFrame:
    trains = t.trains if train_type is None else t.trains.filter(F.col("train_type") == train_type)
    side = t.stations.select(F.col("station_id").alias(f"{there}_id"), F.col("name").alias(there), F.col("city").alias(f"{there}_city"))
    out = t.schedules.filter(F.col(f"{here}_id") == station_id).join(trains.select("train_id", "train_number", "train_type"), "train_id").join(side, f"{there}_id")
    return _page(out.select("schedule_id", "train_number", "train_type", there, f"{there}_city", "departure_time", "arrival_time", "duration_min").orderBy(F.asc_nulls_last(at), "schedule_id"), limit, most=MOST_CALLS)


def station_departures(t: Tables, station_id: int, train_type: str | None = None, limit: int | None = 50) -> DataFrame:
    return _calls(t, station_id, "origin", "destination", "departure_time", train_type, limit)


def station_arrivals(t: Tables, station_id: int, train_type: str | None = None, limit: int | None = 50) -> DataFrame:
    return _calls(t, station_id, "destination", "origin", "arrival_time", train_type, limit)


def count_stations_by_country(t: Tables) -> DataFrame:
    return t.stations.groupBy("country").agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_last("country"))


def _operators(t: Tables, rows: DataFrame, *columns: str) -> DataFrame:
    held = t.trains.groupBy("operator_id").agg(F.count("*").alias("train_count"))
    return rows.select(*columns).join(held, "operator_id", "left").withColumn("train_count", F.coalesce("train_count", F.lit(0)).cast("long"))


def list_operators(t: Tables, country: str | None = None, name: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    rows = t.operators
    if country:
        rows = rows.filter(F.col("country") == country)
    if name:
        rows = rows.filter(_like("name", name))
    return _page(_operators(t, rows, "operator_id", "name", "country", "website").orderBy("name", "operator_id"), limit, offset)


def operator_detail(t: Tables, operator_id: int) -> DataFrame:
    return _operators(t, t.operators.filter(F.col("operator_id") == operator_id), "operator_id", "name", "country", "website", "source_name")


def operator_trains(t: Tables, operator_id: int, train_type: str | None = None, limit: int | None = 100) -> DataFrame:
    out = t.trains.filter(F.col("operator_id") == operator_id)
    if train_type:
        out = out.filter(F.col("train_type") == train_type)
    return _page(out.select("train_id", "train_number", "train_type", "category", "route_name").orderBy("train_number", "train_id"), limit)


def count_operators_by_country(t: Tables) -> DataFrame:
    return t.operators.groupBy("country").agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc_nulls_last("country"))


def summary(t: Tables) -> DataFrame:
    """Six counts in one row."""
    trains = t.trains.agg(F.count("*").alias("trains"), _of_type("day").alias("day_trains"), _of_type("night").alias("night_trains"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(t.operators, "operators").crossJoin(count(t.stations, "stations")).crossJoin(trains).crossJoin(count(t.schedules, "schedules"))  # single rows
    return one.select("operators", "stations", "trains", "schedules", "day_trains", "night_trains")


def top_routes(t: Tables, limit: int | None = 10) -> DataFrame:
    """The station pairs with most schedules. Schedules are summed by station ids first, so names join few rows."""
    pairs = t.schedules.groupBy("origin_id", "destination_id").agg(F.count("*").alias("rides"), F.sum("duration_min").alias("minutes"), F.count("duration_min").alias("timed"), F.sum("distance_km").alias("km"), F.count("distance_km").alias("measured"))
    named = _ends(t._replace(schedules=pairs), "name", "city").groupBy(F.col("origin_name").alias("origin"), "origin_city", F.col("destination_name").alias("destination"), "destination_city")
    out = named.agg(F.sum("rides").alias("frequency"), _mean("minutes", "timed").alias("avg_duration"), _mean("km", "measured").alias("avg_distance"))
    return _page(out.orderBy(F.desc("frequency"), "origin", F.asc_nulls_last("origin_city"), "destination", F.asc_nulls_last("destination_city")), limit, most=MOST_ROUTES)


def v_data_quality(t: Tables) -> DataFrame:
    """Completeness counts; the columns of later tables stand under the first table's names, by place."""
    there = lambda c: F.count(c)
    row = lambda df, name, a, b, c: df.agg(F.count("*").alias("total_records"), a.alias("name_complete"), b.alias("country_complete"), c.alias("website_complete")).select(F.lit(name).alias("table_name"), "*")
    out = row(t.operators, "operators", there("name"), there("country"), there("website"))
    out = out.union(row(t.stations, "stations", there("name"), F.count(F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), 1)), there("uic_code")))
    out = out.union(row(t.trains, "trains", there("train_number"), there("train_type"), there("category")))
    return out.union(row(t.schedules, "schedules", there("departure_time"), there("arrival_time"), there("distance_km")))


data_quality = v_data_quality


def missing_values(t: Tables) -> DataFrame:
    row = lambda df, name, field, gone: df.agg(F.count(F.when(gone, 1)).alias("missing_count"), F.count("*").alias("total_count")).select(F.lit(name).alias("table_name"), F.lit(field).alias("field"), "*")
    out = row(t.stations, "stations", "coordinates", F.col("latitude").isNull() | F.col("longitude").isNull())
    for df, name, field in ((t.stations, "stations", "uic_code"), (t.trains, "trains", "category"), (t.schedules, "schedules", "distance_km")):
        out = out.union(row(df, name, field, F.col(field).isNull()))
    return out.withColumn("missing_pct", F.bround(F.col("missing_count") * 100.0 / F.nullif("total_count", F.lit(0)), 2))


def map_countries(t: Tables) -> DataFrame:
    return t.stations.filter("country is not null and latitude is not null").select("country").distinct().orderBy("country")


def map_stations(t: Tables, country: str | None = None) -> DataFrame:
    out = t.stations.filter("latitude is not null and longitude is not null")
    if country:
        out = out.filter(F.col("country") == country)
    return out.select("name", "city", "country", "latitude", "longitude").orderBy("name", "latitude", "longitude")


def table_counts(t: Tables) -> DataFrame:
    out = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in t._asdict().items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])
