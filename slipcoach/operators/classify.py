"""Day or night: rules, then heuristics, then a fitted model for what is left, as column expressions.

All clocks are seconds of the service day. The whole chain is one projection behind one aggregate of the stop times; night
shares have a closed form, so nothing runs by the minute or by the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipcoach.functions.timetable import clock_seconds, day_or_night, night_percentage, ride_minutes
from slipcoach.plans.schemas import BERTH_WORDS, NIGHT_WORDS, SLEEPER_TYPE, with_missing

NIGHT_SOURCE = "back_on_track"
TEXTS = ("route_short_name", "route_long_name", "trip_headsign", "trip_short_name", "category", "service_name")
#: The model's sure sides, and the least rows and rows by class to fit one.
NIGHT_SURE, DAY_SURE = 0.75, 0.25
OUT = ("trip_id", "train_type", "train_type_rule", "train_type_heuristic", "train_type_ml", "classification_method", "classification_reason", "classification_confidence", "ml_night_probability", "night_percentage", "needs_manual_review")


def trip_endpoints(stop_times: DataFrame, *keys: str) -> DataFrame:
    """First departure and last arrival of each trip by numeric sequence, nulls left out, ties by stop."""
    at = F.struct(F.col("stop_sequence").try_cast("int"), "stop_id")
    dep, arr = clock_seconds("departure_time"), clock_seconds("arrival_time")
    return stop_times.groupBy(*keys, "trip_id").agg(F.min_by(dep, F.when(dep.isNotNull(), at)).alias("departure_s"), F.max_by(arr, F.when(arr.isNotNull(), at)).alias("arrival_s"))


def with_metrics(ends: DataFrame) -> DataFrame:
    """Adds duration_hours, night_percentage, departure_hour, arrival_hour and overnight_flag."""
    dep, arr = F.col("departure_s"), F.col("arrival_s")
    known = dep.isNotNull() & arr.isNotNull()
    minutes = ride_minutes(dep, arr)
    hour = lambda x: F.pmod(F.floor(x / 3600), F.lit(24))
    return ends.withColumns({
        "duration_hours": F.bround(minutes / 60, 3),
        "night_percentage": F.when(known, night_percentage(dep / 60, minutes)),
        "departure_hour": F.when(known, hour(dep)),
        "arrival_hour": F.when(known, hour(arr)),
        "overnight_flag": F.coalesce(((arr >= 86400) | (arr <= dep)).cast("int"), F.lit(0)),
    })


def trip_metrics(stop_times: DataFrame, *keys: str) -> DataFrame:
    return with_metrics(trip_endpoints(stop_times, *keys)).drop("departure_s", "arrival_s")


def metadata_text() -> Column:
    return F.concat_ws(" ", *(F.lower(F.trim(c)) for c in TEXTS))


def with_rules(trips: DataFrame, source: Column) -> DataFrame:
    """Adds train_type_rule, rule_reason and rule_confidence. Words count anywhere in the text, also inside others."""
    out = with_missing(trips, *TEXTS, "route_type").withColumn("metadata_text", metadata_text())
    spoken = F.lit(False)
    for word in dict.fromkeys((*NIGHT_WORDS, *BERTH_WORDS)):
        spoken = spoken | F.col("metadata_text").contains(word)
    sleeper = F.coalesce(F.col("route_type").try_cast("double") == SLEEPER_TYPE, F.lit(False))
    night = (source == NIGHT_SOURCE) | sleeper | spoken
    short = ~night & (F.coalesce("duration_hours", F.lit(0.0)) <= 2.5) & (F.coalesce("night_percentage", F.lit(0.0)) < 15)
    pick = lambda a, b: F.when(night, a).when(short, b)
    return out.withColumns({"train_type_rule": pick("night", "day"), "rule_reason": pick("explicit_night_signal", "explicit_day_short_service"), "rule_confidence": pick(1.0, 0.95)})


def with_heuristics(trips: DataFrame) -> DataFrame:
    """Adds train_type_heuristic, heuristic_reason and heuristic_confidence. Where both sides hold, day does."""
    hours, share = F.coalesce("duration_hours", F.lit(0.0)), F.coalesce("night_percentage", F.lit(0.0))
    dep, arr, over = F.coalesce("departure_hour", F.lit(-1)), F.coalesce("arrival_hour", F.lit(-1)), F.coalesce("overnight_flag", F.lit(0)) == 1
    night = ((hours >= 4.0) & (share >= 50.0)) | ((hours >= 6.0) & (dep >= 20) & ((arr <= 9) | over))
    day = ((hours < 3.5) & (share < 35) & ~over) | ((hours < 6.0) & (share < 20))
    pick = lambda a, b: F.when(day, a).when(night, b)
    return trips.withColumns({"train_type_heuristic": pick("day", "night"), "heuristic_reason": pick("low_night_share", "night_share_threshold"), "heuristic_confidence": pick(0.75, 0.85)})


def finalize_classification(trips: DataFrame) -> DataFrame:
    """The ladder: rule; heuristic with or against the model; heuristic alone; model alone; day for lack of evidence."""
    rule, heur, ml, p = F.col("train_type_rule"), F.col("train_type_heuristic"), F.col("train_type_ml"), F.col("ml_night_probability").cast("double")
    sure = F.when(ml == "night", p).otherwise(1 - p)
    decided = (p >= NIGHT_SURE) | (p <= DAY_SURE)
    modelled, level = ml.isNotNull() & p.isNotNull(), F.col("heuristic_confidence")

    def verdict(kind: Column, method: str, reason: Column, confidence: Column, review: Column) -> Column:
        return F.struct(kind.alias("t"), F.lit(method).alias("m"), reason.alias("r"), confidence.cast("double").alias("c"), review.alias("v"))

    no, yes = F.lit(False), F.lit(True)
    with_suffix = lambda x: F.concat("heuristic_reason", F.lit(x))
    out = (
        F.when(rule.isNotNull(), verdict(rule, "rule", F.col("rule_reason"), F.col("rule_confidence"), no))
        .when(heur.isNotNull() & modelled & (ml == heur), verdict(heur, "heuristic_ml_consensus", F.col("heuristic_reason"), F.bround(F.greatest(level, sure), 2), no))
        .when(heur.isNotNull() & modelled & (level >= 0.8), verdict(heur, "heuristic_priority", with_suffix("|ml_conflict"), F.bround(F.greatest(F.lit(0.55), level - 0.1), 2), yes))
        .when(heur.isNotNull() & modelled & decided, verdict(ml, "ml_support", with_suffix("|ml_support"), F.bround(sure, 2), sure < 0.85))
        .when(heur.isNotNull(), verdict(heur, "heuristic", F.col("heuristic_reason"), F.bround(level, 2), level < 0.8))
        .when(modelled & decided, verdict(ml, "ml_support", F.lit("ml_resolved_ambiguous_case"), F.bround(sure, 2), sure < 0.85))
        .otherwise(verdict(F.lit("day"), "default_day", F.lit("insufficient_night_evidence"), F.lit(0.5), yes))
    )
    names = {"train_type": "t", "classification_method": "m", "classification_reason": "r", "classification_confidence": "c", "needs_manual_review": "v"}
    return trips.withColumn("__v", out).withColumns({k: F.col(f"__v.{v}") for k, v in names.items()}).drop("__v")


def evidence(stop_times: DataFrame, trips: DataFrame, routes: DataFrame | None = None, source_name: str | Column = "unknown") -> DataFrame:
    """Trips with metrics, rules and heuristics, before any model."""
    base = trips
    if routes is not None:
        held = [c for c in ("route_short_name", "route_long_name", "route_type", "route_type_label") if c in routes.columns and c not in trips.columns]
        base = base.join(routes.select("route_id", *held), "route_id", "left")
    source = F.lit(source_name) if isinstance(source_name, str) else source_name
    return with_heuristics(with_rules(base.join(trip_metrics(stop_times), "trip_id", "left"), source))


def classify_gtfs_trips(stop_times: DataFrame, trips: DataFrame, routes: DataFrame | None = None, source_name: str | Column = "unknown", enable_ml: bool = True) -> DataFrame:
    """The eleven classification columns of each trip."""
    out = evidence(stop_times, trips, routes, source_name)
    if enable_ml:
        from slipcoach.operators import ml

        out = ml.support(out)
    else:
        out = with_missing(with_missing(out, "train_type_ml"), "ml_night_probability", kind="double")
    return finalize_classification(out).select(*OUT)


def classification_stats(classified: DataFrame) -> DataFrame:
    method = F.col("classification_method")
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return classified.agg(
        count(F.col("train_type") == "day", "day"), count(F.col("train_type") == "night", "night"), count(method == "rule", "rule_based"),
        count(method.isin("heuristic", "heuristic_priority", "heuristic_ml_consensus"), "heuristic_based"), count(method == "ml_support", "ml_supported"), count(F.col("needs_manual_review"), "manual_review"),
    )


def classify_from_clock(df: DataFrame, timedelta_column: str = "departure_time", output_column: str = "train_type") -> DataFrame:
    hour = F.pmod(F.floor(clock_seconds(timedelta_column) / 3600), F.lit(24))
    return df.withColumn(output_column, F.when(hour.isNull(), "day").otherwise(day_or_night(hour)))


def _labels(df: DataFrame, **values: object) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def reference_night_labels(routes: DataFrame, trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The night catalogue's routes and trips are night services by definition."""
    fixed = {"train_type": "night", "train_type_rule": "night", "classification_method": "rule", "classification_reason": "back_on_track_reference", "classification_confidence": 1.0, "night_percentage": 100.0, "needs_manual_review": False}
    unknown = {"train_type_ml": F.lit(None).cast("string"), "ml_night_probability": F.lit(None).cast("double")}
    nothing = F.lit(None).cast("string")
    return (
        _labels(routes, **fixed).withColumns(unknown | {"train_type_heuristic": F.lit("night")}),
        _labels(trips, **fixed).withColumns(unknown | {"train_type_heuristic": nothing}),
    )


def default_day_labels(trips: DataFrame) -> DataFrame:
    """Trips of a feed without stop times."""
    gone = {c: F.lit(None).cast("string") for c in ("train_type_rule", "train_type_heuristic", "train_type_ml")} | {c: F.lit(None).cast("double") for c in ("ml_night_probability", "night_percentage")}
    fixed = _labels(trips, train_type="day", classification_method="default_day", classification_reason="missing_stop_times", classification_confidence=0.5, needs_manual_review=True)
    return fixed.withColumns(gone)
