"""Writing canonical tables: upserts by key, loads of merged tables with ids of their own, and slices by source.

A table is a folder of numbered versions (see versions.py). Its keys are dealt over buckets by a hash. An upsert reads the buckets
that its batch names, writes a row for each key of the batch and makes a version that puts these rows over the others, so what it
writes grows with the batch. A bucket with many such layers is written anew. Of writers side by side none loses a batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipcoach.functions.timetable import anchored
from slipcoach.operators.cleaning import dedup_keep_first
from slipcoach.plans import shared
from slipcoach.plans.schemas import IDS, UPSERT, Tables, with_missing
from slipcoach.sources import versions

#: Buckets of a new table, and layers over a bucket after which it is written anew.
BUCKETS, LAYERS = 32, 8


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version, or none."""
    version = versions.latest(spark, path)
    return versions.read(spark, path, version) if version else None


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`"))
    return same


def upserted(current: DataFrame | None, batch: DataFrame, conflict_columns: Sequence[str], update_columns: Sequence[str] | None = None) -> DataFrame:
    """current with the batch's rows: new keys are added, the update columns of known keys are taken over.

    Keys are equal also when null, so a second run changes nothing; the batch's first row of a key counts, ties by all
    columns. Without update columns known keys stay as they are. updated_at, if the table has it, is set on what changes.
    """
    rows = dedup_keep_first(batch, list(conflict_columns))
    if current is None:
        return rows
    rows = with_missing(rows, *(c for c in current.columns if c not in rows.columns)).select(current.columns)
    old, new = current.select(F.struct("*").alias("o")), rows.select(F.struct("*").alias("n"))
    both = old.join(new, _same("o", "n", conflict_columns), "full_outer")
    taken = set(update_columns or ())

    def pick(c: str):
        if c == "updated_at":
            return F.when(F.col("n").isNull(), F.col(f"o.{c}")).when(F.col("o").isNull() | F.lit(bool(taken)), F.current_timestamp()).otherwise(F.col(f"o.{c}"))
        old_first = F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        new_first = F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return new_first if c in taken else old_first

    return both.select(*(pick(c).alias(c) for c in current.columns))


def _over(rows: DataFrame, current: DataFrame, keys: Sequence[str], update_columns: Sequence[str] | None) -> DataFrame:
    """A row for each key of the batch, as upserted() gives it: one join, since neither side has a key twice.

    Without update columns what is known stays as it is, and only new keys are left.
    """
    if not update_columns:
        new = rows.alias("n").join(current.alias("c"), _same("n", "c", keys), "left_anti").select("n.*")
        return new.withColumn("updated_at", F.current_timestamp()) if "updated_at" in rows.columns else new
    both = rows.alias("n").join(current.withColumn("__old", F.lit(True)).alias("c"), _same("n", "c", keys), "left")
    known, taken = F.col("c.__old").isNotNull(), set(update_columns)

    def pick(c: str) -> Column:
        if c == "updated_at":
            return F.current_timestamp()
        new = F.col(f"n.`{c}`")
        return new if c in taken or c in keys else F.when(known, F.col(f"c.`{c}`")).otherwise(new)

    return both.select(*(pick(c).alias(c) for c in rows.columns))


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(buckets)).cast("string")


def _with_ids(rows: DataFrame, keys: Sequence[str], id_column: str | None, start: int) -> tuple[DataFrame, int]:
    """Rows without an id get the next ones, dense and in the order of their keys; also the first id that is still free."""
    if not id_column:
        return rows, start
    held = shared.save(rows, "upsert")
    new = held.filter(F.col(id_column).isNull())
    count = new.count()
    if not count:
        return held, start
    dealt = shared.numbered(new.drop(id_column), [F.col(f"`{k}`") for k in keys], id_column, start).select(rows.columns)
    return held.filter(F.col(id_column).isNotNull()).union(dealt), start + count


def _all_new(rows: DataFrame, keys: Sequence[str], id_column: str | None) -> tuple[DataFrame, int]:
    """The saved rows of a new table, numbered from 1."""
    if not id_column:
        return rows, 1
    return shared.numbered(rows.drop(id_column), [F.col(f"`{k}`") for k in keys], id_column).select(rows.columns), rows.count() + 1


def _fits(spark: SparkSession, batch: DataFrame, version: versions.Version | None, id_column: str | None) -> DataFrame:
    """The batch with the table's columns and types; a new table gets its id column first."""
    if version:
        schema = version.struct()
        batch = with_missing(batch, *(f.name for f in schema if f.name not in batch.columns))
        return batch.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
    if id_column:
        batch = batch.select(F.lit(None).cast("long").alias(id_column), *(F.col(f"`{c}`") for c in batch.columns if c != id_column))
    return batch


def write_canonical_upsert(batch: DataFrame, path: str, table_name: str | None = None, conflict_columns: Sequence[str] | None = None, update_columns: Sequence[str] | None = None, id_column: str | None = None, buckets: int = BUCKETS, layers: int = LAYERS) -> DataFrame:
    """Upserts into the table at path and returns it; a known table's name gives key and update columns.

    id_column: a column of the table's own ids. Known keys keep theirs; new keys are numbered on from the largest, without gaps.
    buckets: those of a table that is new.
    """
    spark = batch.sparkSession
    if table_name:
        conflict_columns, update_columns = conflict_columns or UPSERT[table_name][0], update_columns or UPSERT[table_name][1]
    keys = list(conflict_columns)
    rows = shared.save(dedup_keep_first(batch, keys), "batch")  # attempts and passes see the same rows

    def attempt(before: versions.Version | None) -> tuple[versions.Version | None, list[versions.Rows]]:
        fitted = _fits(spark, rows, before, id_column)
        if before is None:
            whole, next_id = _all_new(fitted, keys, id_column)
            own = versions.write_rows(whole.withColumn("__bucket", _bucket(keys, buckets)), path, "__bucket", False)
            return versions.Version(0, whole.schema.json(), keys, "key", buckets, next_id, own), own
        if before.keys != keys:
            raise ValueError(f"the table at {path} has the keys {before.keys}")
        named = [r[0] for r in fitted.select(_bucket(keys, before.buckets).alias("b")).distinct().collect()]  # as many as there are buckets
        current = versions.read(spark, path, before, named).alias("c")
        merged = _over(fitted, current, keys, update_columns)
        merged, next_id = _with_ids(merged, keys, id_column, before.next_id)
        own = versions.write_rows(merged.withColumn("__bucket", _bucket(keys, before.buckets)), path, "__bucket", True)
        return (before._replace(number=before.number + 1, next_id=next_id, rows=before.rows + own), own) if own else (None, own)

    version = versions.retried(spark, path, attempt)
    deep = [part for part, n in Counter(r.part for r in version.rows if r.delta).items() if n >= layers]
    if deep:
        version = compact(spark, path, deep)
    return versions.read(spark, path, version)


def compact(spark: SparkSession, path: str, parts: Sequence[str] | None = None) -> versions.Version:
    """Writes the parts' rows without layers; all parts if none are named. Readers see the same rows before and after."""

    def attempt(before: versions.Version) -> tuple[versions.Version | None, list[versions.Rows]]:
        over = {r.part for r in before.rows if r.delta and (parts is None or r.part in set(parts))}
        if not over:
            return None, []
        rows = versions.read(spark, path, before, sorted(over)).withColumn("__bucket", _bucket(before.keys, before.buckets))
        own = versions.write_rows(rows, path, "__bucket", False)
        return before._replace(number=before.number + 1, rows=[r for r in before.rows if r.part not in over] + own), own

    return versions.retried(spark, path, attempt)


def replace_source_slice(df: DataFrame, path: str) -> None:
    """The rows of each source in df replace that source's rows in the table at path; other sources stay.

    All slices change in one step. A null source is a slice of its own; without rows nothing is replaced.
    """
    spark = df.sparkSession
    own = versions.write_rows(df.withColumn("__slice", F.col("source_name")), path, "__slice", False)
    new = {r.part for r in own}
    while True:
        before = versions.latest(spark, path) or versions.Version(-1, df.schema.json(), [], "slice", 0, 1, [])
        kept = [r for r in before.rows if r.part not in new]
        if versions.commit(spark, path, before._replace(number=before.number + 1, rows=kept + own)):  # else others were faster; the rows serve again
            return


#: Bits of a column's rank in a clustered table.
RANK_BITS = 6


def _ranks(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Each column's place among its own quantiles, in RANK_BITS bits; a fixed number of quantiles reaches the driver."""
    shares = [k / (1 << RANK_BITS) for k in range(1, 1 << RANK_BITS)]
    found = df.approxQuantile(list(columns), shares, 0.004)

    def rank(column: str, bounds: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(column))) if bounds else F.lit(0)

    return [rank(c, bounds) for c, bounds in zip(columns, found, strict=True)]


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int) -> DataFrame:
    """Writes the table so that rows near in any of the numeric columns stand together, and returns it.

    Rows are dealt over so many files by the interleaved bits of the columns' ranks (a Z-order); the version keeps the range of
    each column in each file, so that lookup() opens few of them.
    """
    ranks = _ranks(df, columns)
    bits = [F.shiftleft(F.shiftright(rank, j).bitwiseAND(F.lit(1)), j * len(columns) + k) for k, rank in enumerate(ranks) for j in range(RANK_BITS)]
    place = bits[0]
    for b in bits[1:]:
        place = place.bitwiseOR(b)
    dealt = df.withColumn("__place", place).repartitionByRange(files, "__place", *columns).sortWithinPartitions("__place", *columns)
    own = versions.write_rows(dealt.drop("__place").withColumn("__file", F.spark_partition_id()), path, "__file", False, dealt=True)
    spark = df.sparkSession
    jobs = {r.job for r in own}
    if own:
        each = spark.read.parquet(*(f"{path}/data/{job}" for job in jobs)).groupBy("__file").agg(*(x for c in columns for x in (F.min(c).alias(f"least {c}"), F.max(c).alias(f"most {c}"))))
        ranges = {str(r["__file"]): {c: [r[f"least {c}"], r[f"most {c}"]] for c in columns} for r in each.collect()}  # a row for each file
        own = [r._replace(ranges=ranges[r.part]) for r in own]

    def attempt(before: versions.Version | None) -> tuple[versions.Version, list[versions.Rows]]:
        return versions.Version(before.number + 1 if before else 0, df.schema.json(), [], "range", files, 1, own), []

    return versions.read(spark, path, versions.retried(spark, path, attempt))


def lookup(spark: SparkSession, path: str, **values: int | str) -> DataFrame:
    """The rows that have these values; files whose ranges exclude one of them are not opened."""
    out = versions.read(spark, path, versions.latest(spark, path), values=values)
    for c, v in values.items():
        out = out.filter(F.col(c) == v)
    return out


def _named(df: DataFrame) -> DataFrame:
    """Default country, trimmed names, no row without a name."""
    df = with_missing(df, "country")
    country = F.coalesce(F.nullif(F.trim("country"), F.lit("")), F.lit("EU"))
    return df.withColumns({"country": country, "name": F.trim("name")}).filter("name is not null and name <> ''")


def _operators(merged: DataFrame) -> DataFrame:
    out = with_missing(merged.withColumnsRenamed({"agency_name": "name", "agency_url": "website"}), "website")
    return _named(out)


def operators_to_load(merged: DataFrame) -> DataFrame:
    return _operators(merged).select("name", "country", "website", "source_name")


def _stations(merged: DataFrame) -> DataFrame:
    out = merged.withColumnsRenamed({"stop_name": "name", "stop_lat": "latitude", "stop_lon": "longitude", "stop_id": "uic_code"})
    out = with_missing(out, "city", "latitude", "longitude", "uic_code", "timezone")
    return _named(out.withColumns({c: F.col(c).try_cast("double") for c in ("latitude", "longitude")}))


def stations_to_load(merged: DataFrame) -> DataFrame:
    """One row for each name, country and source: that with the smallest code."""
    out = _stations(merged).select("name", "city", "country", "latitude", "longitude", "uic_code", "timezone", "source_name")
    return dedup_keep_first(out, ["name", "country", "source_name"], ["uic_code"])


def _trains(merged: DataFrame) -> DataFrame:
    return merged.withColumnsRenamed({"trip_id": "train_number", "route_short_name": "category", "route_long_name": "route_name"})


def trains_to_load(merged: DataFrame) -> DataFrame:
    keys, updates = UPSERT["trains"]
    return with_missing(_trains(merged), *updates).select(*keys[:2], *updates, "source_name")


def schedules_to_load(merged: DataFrame) -> DataFrame:
    """Times as timestamps; an arrival not after the departure is one on the next day; rides that cannot be are dropped."""
    def stamp(c: str):
        return F.col(c) if dict(merged.dtypes)[c].startswith("timestamp") else F.coalesce(F.col(c).try_cast("timestamp_ntz"), anchored(F.col(c).try_cast("long")))

    out = merged.withColumns({"departure_time": stamp("departure_time"), "arrival_time": stamp("arrival_time"), "duration_min": F.col("duration_min").try_cast("long"), "distance_km": F.col("distance_km").try_cast("double")})
    out = out.withColumn("arrival_time", F.when(F.col("arrival_time") <= F.col("departure_time"), F.col("arrival_time") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("arrival_time")))
    out = out.dropna(subset=["train_id", "origin_id", "destination_id", "departure_time", "arrival_time", "duration_min"]).filter("origin_id <> destination_id and duration_min > 0")
    return with_missing(out, "frequency").select("train_id", "origin_id", "destination_id", "departure_time", "arrival_time", "duration_min", "distance_km", "frequency", "source_name")


_LOADS = {"operators": operators_to_load, "stations": stations_to_load, "trains": trains_to_load, "schedules": schedules_to_load}
_ROWS = {"operators": _operators, "stations": _stations, "trains": _trains}


def load(table: str, merged: DataFrame, path: str) -> DataFrame:
    """Prepares a merged table and upserts it; the stored rows have ids of their own."""
    return write_canonical_upsert(_LOADS[table](merged), path, table, id_column=IDS[table])


def _renumbered(table: str, merged: DataFrame, stored: DataFrame) -> DataFrame:
    """(merged_id, stored_id): the merged ids of a table with the ids under which its rows are stored."""
    keys = UPSERT[table][0]
    rows = _ROWS[table](merged).select(F.col(IDS[table]).alias("merged_id"), *keys).alias("m")
    return rows.join(stored.alias("s"), _same("m", "s", keys)).select("m.merged_id", F.col(f"s.{IDS[table]}").alias("stored_id"))


def _referring(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """df with the stored ids in a column; rows that refer to nothing stored are dropped."""
    return df.join(ids, F.col(column) == F.col("merged_id")).drop(column, "merged_id").withColumnRenamed("stored_id", column)


def load_all(merged: Mapping[str, DataFrame], folder: str, until: str = "schedules") -> Tables:
    """Loads the merged tables in the order of their references and returns the stored ones, up to the one named.

    Every stored table numbers its own rows; trains refer to the stored operators, schedules to the stored trains and stations,
    whatever ids the merge gave them.
    """
    out: dict[str, DataFrame] = {}
    steps = list(Tables._fields)
    for table in steps[: steps.index(until) + 1]:
        rows = merged[table]
        if table == "trains":
            rows = _referring(rows, "operator_id", _renumbered("operators", merged["operators"], out["operators"]))
        elif table == "schedules":
            trains = _referring(merged["trains"], "operator_id", _renumbered("operators", merged["operators"], out["operators"]))
            rows = _referring(rows, "train_id", _renumbered("trains", trains, out["trains"]))
            stations = _renumbered("stations", merged["stations"], out["stations"])
            for column in ("origin_id", "destination_id"):
                rows = _referring(rows, column, stations)
        out[table] = load(table, rows, f"{folder}/{table}")
    return Tables(*(out.get(t) for t in steps))
