"""The whole chain on feeds as files: read, clean, classify, merge, load, fill distances."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from slipcoach.operators import classify, geo, merge
from slipcoach.plans import shared
from slipcoach.plans.schemas import Tables
from slipcoach.sources import feeds, store


def extract(spark: SparkSession, source: str, path: str, country: str | None) -> dict:
    """A feed's tables; the night catalogue is keyed JSON, all others are timetable feeds."""
    return feeds.read_keyed_json(spark, path) if source == classify.NIGHT_SOURCE else feeds.read_gtfs_feed(spark, path, source, country)


def merged(feed_of: Mapping[str, tuple[dict, str | None]], enable_ml: bool = False) -> dict:
    """{table: rows} of all feeds, each cleaned and classified by itself. Trains and stations are saved: schedules refer to their ids."""
    ready = {source: merge.process_source(source, feed, country, enable_ml) for source, (feed, country) in feed_of.items()}
    operators, stations = shared.save(merge.merge_operators(ready), "operators"), shared.save(merge.merge_stations(ready), "stations")
    trains = shared.save(merge.merge_trains(ready, operators), "trains")
    return {"operators": operators, "stations": stations, "trains": trains, "schedules": merge.merge_schedules(ready, trains, stations)}


def run(spark: SparkSession, sources: Mapping[str, tuple[str, str | None]], folder: str, enable_ml: bool = False) -> Tables:
    """Reads {source: (path, country)}, loads everything into the folder's tables and returns them, with distances where they can be known.

    A second run on the same or changed feeds updates what is there; ids stay.
    """
    rows = merged({source: (extract(spark, source, path, country), country) for source, (path, country) in sources.items()}, enable_ml)
    stored = store.load_all(rows, folder)
    far = geo.fill_distances(stored.schedules, stored.stations).filter("distance_km is not null").join(stored.schedules.filter("distance_km is null").select("schedule_id"), "schedule_id", "left_semi")
    kinds = {f.name: f.dataType for f in stored.schedules.schema}
    filled = far.select(*(F.col(c).cast(kinds[c]) for c in stored.schedules.columns))
    return stored._replace(schedules=store.write_canonical_upsert(filled, f"{folder}/schedules", "schedules", update_columns=["distance_km"], id_column="schedule_id"))
