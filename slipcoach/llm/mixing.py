"""Mixing sources to target weights: word totals by source, repetition rates, then whole copies and one hash-seeded draw.

A source's target is its weight's part of all words, but at most `cap` times what it holds; what is over is shared
again by weight among the others until none is above. A document is emitted floor(rate) times, and once more when the
hash of its id falls below the rate's fraction, so a rerun draws the same.

Defined results: a null or blank text has size 0; a null source is a source, the last one; a source without words has
target 0 and is taken 0 times; a null id draws as the empty id, rows with equal ids draw alike; an empty table gives an
empty one; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipcoach.plans import shared as scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP, SEED = (1, 2, 3), 3, "mix"


def size(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) with weight, target and rate. Only sums over the sources reach the driver, one row a round."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = scratch.save(scratch.numbered(totals, [F.col("source").asc_nulls_last()], "__rank", 0).withColumn("weight", weight).drop("__rank"), "sources")
    exact = lambda x: F.col(x).cast("decimal(38,0)")
    words, shares = ranked.agg(F.sum(exact("source_size")), F.sum(exact("weight"))).first()
    left, held, capped = words or 0, shares or 1, F.lit(False)
    count = 0
    while True:
        capped = exact("weight") * F.lit(left).cast("decimal(38,0)") > exact("source_size") * F.lit(cap * held).cast("decimal(38,0)")
        over, of, n = ranked.filter(capped).agg(F.coalesce(F.sum(exact("source_size")), F.lit(0)), F.coalesce(F.sum(exact("weight")), F.lit(0)), F.count("*")).first()
        if n == count:
            break
        left, held, count = words - cap * over, shares - of, n
    target = F.when(capped, F.col("source_size") * F.lit(float(cap))).otherwise(F.col("weight") * F.lit(float(left)) / F.lit(float(held)))
    return ranked.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def copies(identity: str, rate: str, seed: str = SEED) -> Column:
    """How often a document is emitted."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(identity).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return (F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per document: id, size, source_size, target, rate, copies, taken. The texts are read once; only sizes are kept."""
    sizes = scratch.save(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), size(F.col(f"`{text_col}`")).alias("size")), "sizes")
    rates = scratch.save(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "rates")
    out = sizes.join(rates.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    out = out.withColumn("copies", copies("id", "rate"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; the columns stay as they are."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), size(F.col(f"`{text_col}`")).alias("size"))
    totals = whole.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = scratch.save(targets(totals, weights, cap).select(F.col("source").alias("of"), "rate"), "rates")
    joined = whole.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies("id", "rate"))
    return joined.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
