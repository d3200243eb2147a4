"""Cleaning, validation and saving of tables whose quality figures are gathered on the way, by Spark's observed metrics.

quality_metrics_record() counts tables that are there already and reads each again for it. Here the rows are counted as they pass
from one step to the next, in the one job that saves them: each table is read once, and the record costs no pass of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from slipcoach.operators import validate
from slipcoach.plans import shared
from slipcoach.plans.schemas import SCHEMAS

#: In the order of the stages; `of` is what a step has seen: rows read, distinct rows, rows that are saved.
_STAGES = {
    "extraction": {"rows_extracted": lambda of: of["read"]},
    "cleaning": {"duplicates_removed": lambda of: of["read"] - of["distinct"], "nulls_found": lambda of: of["nulls"], "rows_after": lambda of: of["distinct"]},
    "transformation": {"rows_before": lambda of: of["distinct"], "nulls_filled": lambda of: of["filled"], "rows_rejected": lambda of: of["distinct"] - of["attempted"], "rows_after": lambda of: of["attempted"]},
    "loading": {"rows_attempted": lambda of: of["attempted"], "rows_loaded": lambda of: of["saved"], "rows_failed": lambda of: max(0, of["attempted"] - of["saved"])},
    "validation": {"null_violations": lambda of: of["broken"], "type_mismatches": lambda of: of["mismatches"]},
}


class _Steps:
    """Counts by source at several steps of one plan."""

    def __init__(self, sources: Sequence[str | None]) -> None:
        self.sources, self.seen = list(sources), []

    def __call__(self, df: DataFrame, **counts: Column) -> DataFrame:
        """df, of which each count adds up a number of every row, by source."""
        of = lambda s: F.col("source_name").eqNullSafe(F.lit(s))
        other = ~F.coalesce(F.col("source_name").isin([s for s in self.sources if s is not None]), F.lit(None in self.sources))
        sums = [F.sum(F.when(of(s), x).otherwise(0)).alias(f"{k} {name}") for k, s in enumerate(self.sources) for name, x in counts.items()]
        self.seen.append((list(counts), Observation()))
        return df.observe(self.seen[-1][1], F.sum(other.cast("long")).alias("other"), *sums)

    def results(self) -> dict[str | None, dict[str, int]]:
        """To be asked after the job."""
        out: dict[str | None, dict[str, int]] = {s: {} for s in self.sources}
        for names, seen in self.seen:
            got = seen.get
            if got.get("other"):
                raise ValueError(f"{got['other']} rows of sources that are not among {self.sources}")
            for k, s in enumerate(self.sources):
                out[s] |= {n: int(got.get(f"{k} {n}") or 0) for n in names}
        return out


def _flow(df: DataFrame, entity: str, steps: _Steps) -> DataFrame:
    """Distinct, valid rows; the steps count what passes."""
    one = F.lit(1).cast("long")
    nulls = lambda columns: sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0).cast("long"))
    strict = [f.name for f in SCHEMAS[entity] if f.name in df.columns and not f.nullable]
    filled = F.col("country").isNull().cast("long") if "country" in df.columns else F.lit(0).cast("long")
    rows = steps(df, read=one, nulls=nulls(strict)).dropDuplicates()
    flagged = validate.with_reasons(rows, entity)
    flagged = steps(flagged, distinct=one, filled=filled, attempted=(F.size("reasons") == 0).cast("long"))
    valid, _ = validate.split_valid_rejected(flagged)
    return steps(valid, saved=one, broken=nulls(strict))


def process(tables: Mapping[str, DataFrame], sources: Sequence[str | None]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables of distinct, valid rows as saved; the record of quality figures), one job a table.

    sources: those that rows may have, None for rows without one; a row of another is an error.
    """
    stored, record = {}, []
    for entity, df in tables.items():
        steps = _Steps(sources)
        stored[entity] = shared.save(_flow(df, entity, steps), entity)
        wrong = len(validate._mismatches(df, entity))
        for source, of in steps.results().items():
            if of["read"]:
                of = of | {"mismatches": wrong}
                record += [(source, entity, stage, metric, value(of)) for stage, metrics in _STAGES.items() for metric, value in metrics.items()]
        spark = df.sparkSession
    return stored, spark.createDataFrame(record, validate.METRICS)
