"""Validation rules with reasons for each rejected row, reports on schemas, and a table of quality metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipcoach.plans.schemas import SCHEMAS, Tables

Rules = dict[str, Column]


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def _not_positive(c: str) -> Column:
    value = F.col(c).try_cast("double")
    return value.isNull() | (value <= 0)


def _outside(c: str, most: float) -> Column:
    return ~F.col(c).try_cast("double").between(-most, most)


def _country(letters: str) -> Column:
    return ~_blank("country") & ~F.trim("country").rlike(f"^[A-Z]{{{letters}}}$")


#: The reasons. For each table: reason and the condition under which a row is rejected, with the columns that it reads.
RULES: dict[str, dict[str, tuple[tuple[str, ...], object]]] = {
    "operators": {"nom vide ou manquant": (("name",), lambda: _blank("name")), "code pays invalide": (("country",), lambda: _country("2"))},
    "stations": {
        "nom vide ou manquant": (("name",), lambda: _blank("name")),
        "latitude hors limites": (("latitude",), lambda: _outside("latitude", 90)),
        "longitude hors limites": (("longitude",), lambda: _outside("longitude", 180)),
        "code pays invalide": (("country",), lambda: _country("2,3")),
    },
    "trains": {
        "numéro de train vide": (("train_number",), lambda: _blank("train_number")),
        "operator_id invalide": (("operator_id",), lambda: _not_positive("operator_id")),
        "type de train invalide": (("train_type",), lambda: ~F.coalesce(F.lower(F.trim("train_type")).isin("day", "night"), F.lit(False))),
    },
    "schedules": {
        **{f"{c} invalide": ((c,), lambda c=c: _not_positive(c)) for c in ("train_id", "origin_id", "destination_id")},
        "origine = destination": (("origin_id", "destination_id"), lambda: F.col("origin_id").try_cast("double") == F.col("destination_id").try_cast("double")),
        "durée invalide": (("duration_min",), lambda: F.coalesce(~((F.col("duration_min").try_cast("double") > 0) & (F.col("duration_min").try_cast("double") < 2880)), F.lit(True))),
        **{f"{c} manquant": ((c,), lambda c=c: F.col(c).isNull()) for c in ("departure_time", "arrival_time")},
    },
}


def with_reasons(df: DataFrame, table: str) -> DataFrame:
    """Adds reasons: an array of why the row is rejected, empty for a valid one. Rules on absent columns do not count."""
    tests = [F.when(F.coalesce(test(), F.lit(False)), F.lit(reason)) for reason, (needs, test) in RULES[table].items() if all(c in df.columns for c in needs)]
    return df.withColumn("reasons", F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))


def split_valid_rejected(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return flagged.filter(F.size("reasons") == 0).drop("reasons"), flagged.filter(F.size("reasons") > 0)


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reasons)"""
    return split_valid_rejected(with_reasons(df, table))


def validate_operators(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validate(df, "operators")


def validate_stations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validate(df, "stations")


def validate_trains(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validate(df, "trains")


def validate_schedules(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validate(df, "schedules")


def rejection_reasons(df: DataFrame, table: str) -> DataFrame:
    """Rows by reason; a row may count for several."""
    return with_reasons(df, table).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def validate_all(t: Tables) -> Tables:
    return Tables(*(validate(df, name)[0] for name, df in t._asdict().items()))


def _mismatches(df: DataFrame, schema_name: str) -> list[str]:
    """Columns whose type is of another family than the canonical one."""
    family = lambda kind: "number" if kind.split("(")[0] in ("int", "bigint", "smallint", "tinyint", "float", "double", "decimal") else "time" if kind.startswith("timestamp") else kind
    have = dict(df.dtypes)
    return [f.name for f in SCHEMAS[schema_name] if f.name in have and family(have[f.name]) != family(f.dataType.simpleString())]


def schema_report(df: DataFrame, schema_name: str, exclude_technical_ids: bool = True) -> DataFrame:
    """One row: valid, row_count, missing and extra columns, null violations and type mismatches."""
    fields = [f for f in SCHEMAS[schema_name] if not (exclude_technical_ids and f.metadata["role"] == "technical_id")]
    have = dict(df.dtypes)
    missing, extra = sorted({f.name for f in fields} - set(have)), sorted(set(have) - {f.name for f in fields})
    wrong = [c for c in _mismatches(df, schema_name) if c in {f.name for f in fields}]
    strict = [f.name for f in fields if f.name in have and not f.nullable]
    nulls = [F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in strict]
    counted = df.agg(F.count("*").alias("row_count"), *(x.alias(f"__{c}") for x, c in zip(nulls, strict, strict=True)))
    held = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, strict)), F.array(*(F.col(f"__{c}") for c in strict))), lambda _, n: n > 0) if strict else F.create_map().cast("map<string,bigint>")
    texts = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    out = counted.select(F.lit(schema_name).alias("schema_name"), "row_count", texts(missing).alias("missing_columns"), texts(extra).alias("extra_columns"), held.alias("null_violations"), texts(wrong).alias("type_mismatches"))
    return out.withColumn("valid", F.lit(not missing and not wrong) & (F.size("null_violations") == 0))


METRICS = "source_name string, entity string, stage string, metric string, value long"


def quality_metrics_record(extracted: Mapping[str, DataFrame], loaded: Mapping[str, DataFrame]) -> DataFrame:
    """A long table (source_name, entity, stage, metric, value) of what each table lost on the way.

    extracted: tables as read, with source_name; loaded: as stored. Five stages: extraction, cleaning (distinct rows stay),
    transformation (rows that break a rule go, a missing country is filled), loading and validation (of what is loaded,
    against the canonical schema). One aggregate for each table and side.
    """
    out = None
    for entity, df in extracted.items():
        strict = [f.name for f in SCHEMAS[entity] if f.name in df.columns and not f.nullable]
        flagged = with_reasons(df, entity)
        nulls = sum((F.count(F.when(F.col(c).isNull(), 1)) for c in strict), F.lit(0))
        # equal rows side by side, so that the distinct ones and all of them are counted together
        each = flagged.groupBy(*df.columns).agg(F.count("*").alias("__n"), F.first(F.size("reasons")).alias("__reasons"), nulls.alias("cleaning.nulls_found"))
        filled = F.sum(F.col("country").isNull().cast("long")) if "country" in df.columns else F.lit(0)
        first = each.groupBy("source_name").agg(
            F.sum("__n").alias("extraction.rows_extracted"), F.sum(F.col("__n") - 1).alias("cleaning.duplicates_removed"), F.sum("`cleaning.nulls_found`").alias("cleaning.nulls_found"), F.count("*").alias("cleaning.rows_after"),
            F.count("*").alias("transformation.rows_before"), filled.alias("transformation.nulls_filled"), F.sum((F.col("__reasons") > 0).cast("long")).alias("transformation.rows_rejected"), F.sum((F.col("__reasons") == 0).cast("long")).alias("transformation.rows_after"),
        )
        held = [f.name for f in SCHEMAS[entity] if f.name in loaded[entity].columns and not f.nullable]
        broken = sum((F.count(F.when(F.col(c).isNull(), 1)) for c in held), F.lit(0))
        stored = loaded[entity].groupBy("source_name").agg(F.count("*").alias("loading.rows_loaded"), broken.alias("validation.null_violations"))
        stored = stored.withColumnRenamed("source_name", "__of")
        wide = first.join(stored, F.col("source_name").eqNullSafe(F.col("__of")), "left").drop("__of").na.fill(0).withColumns({
            "loading.rows_attempted": F.col("`transformation.rows_after`"), "loading.rows_failed": F.greatest(F.col("`transformation.rows_after`") - F.col("`loading.rows_loaded`"), F.lit(0)),
            "validation.type_mismatches": F.lit(len(_mismatches(loaded[entity], entity))),
        })
        names = [c for c in wide.columns if c != "source_name"]
        pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(f"`{c}`").cast("long") for c in names)))).alias("name", "value")
        part = wide.select("source_name", pairs).select("source_name", F.lit(entity).alias("entity"), F.split_part("name", F.lit("."), F.lit(1)).alias("stage"), F.split_part("name", F.lit("."), F.lit(2)).alias("metric"), "value")
        out = part if out is None else out.union(part)
    return out


def quality_summary(metrics: DataFrame) -> DataFrame:
    """Totals over sources and entities."""
    total = lambda m: F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("value"))), F.lit(0)).cast("long")
    return metrics.agg(
        F.countDistinct("source_name").alias("total_sources"), F.countDistinct(F.struct("source_name", "entity")).alias("total_entities"), total("rows_extracted").alias("total_extracted"), total("duplicates_removed").alias("total_duplicates_removed"),
        total("nulls_found").alias("total_nulls_found"), total("nulls_filled").alias("total_nulls_filled"), total("rows_rejected").alias("total_rows_rejected"), total("rows_loaded").alias("total_rows_loaded"),
        total("rows_failed").alias("total_rows_failed"), total("null_violations").alias("total_null_violations"), total("type_mismatches").alias("total_type_mismatches"),
    )


def quality_report_table(metrics: DataFrame) -> DataFrame:
    """By source and entity: extracted, duplicates, nulls, rejected, loaded and the load rate in percent."""
    names = {"rows_extracted": "extracted", "duplicates_removed": "duplicates", "nulls_found": "nulls", "rows_rejected": "rejected", "rows_loaded": "loaded"}
    wide = metrics.groupBy("source_name", "entity").pivot("metric", list(names)).sum("value").na.fill(0).withColumnsRenamed(names)
    return wide.withColumn("load_rate_pct", F.bround(F.col("loaded") * 100.0 / F.nullif("extracted", F.lit(0)), 0)).orderBy("source_name", "entity")
