"""Sharding by rendezvous hashing of stable keys over weighted shards; DataFrame functions only.

Every shard draws a number in (0, 1) for a key from the hash of both, and the shard with the smallest -ln(number)/weight
holds the key. A shard more or less moves only the keys that it gains or gives up, and nothing else is remembered.

Defined results: the key is the id as text; a null id has a key of its own, so all such rows share a shard; rows with
equal ids share a shard whatever their texts, and rows alike in id, size and checksum follow one another in any order; a
null text has no bytes (checksum 0); shards that draw the same score: the lower number holds the key; an empty table gives
an empty one; other columns pass through `assign`, one that has the name of the
new column, in any case, under that name with `_` added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipcoach.plans import shared as scratch

SHARDS, OVERHEAD, SEED = 40, 16, "shard"


def _draw(key: Column, shard: int, seed: str) -> Column:
    """52 bits of a hash, as a number in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{shard}:"), key)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def _score(key: Column, shard: int, weight: float, seed: str) -> Column:
    return F.struct((-F.log(_draw(key, shard, seed)) / float(weight)).alias("score"), F.lit(shard).alias("shard"))


def _best(key: Column, weights: Sequence[float], seed: str) -> Column:
    """(score, shard) of the shard that holds the key; weights: one positive number a shard."""
    scores = [_score(key, k, w, seed) for k, w in enumerate(weights)]
    return F.least(*scores) if len(scores) > 1 else scores[0]


def shard_of(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """The number of the shard that holds the key."""
    return _best(key, weights, seed)["shard"]


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\\N"))


def text_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")


def assign(docs: DataFrame, id_col: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, seed: str = SEED, name: str = "shard") -> DataFrame:
    """The rows with their shard in the column `name`."""
    shard = shard_of(_key(id_col), weights, seed).cast("int").alias(name)
    taken = {c.lower() for c in docs.columns}  # names are the same to Spark whatever their case
    other = name
    while other.lower() in taken:
        other += "_"
    return docs.select(*(F.col(f"`{c}`").alias(other if c.lower() == name.lower() else c) for c in docs.columns), shard)


def slots(rows: DataFrame, order: Sequence[str], shard: str = "shard") -> DataFrame:
    """Gapless numbers from 0 within each shard, in the given order.

    All rows are numbered through, by ranges of shard and order that grow in number with the rows; a shard's slots count from
    its first number. Rows alike are told apart by where they stood, so that many of them do not share one range.
    """
    placed = scratch.save(rows.withColumn("_at", F.monotonically_increasing_id()), "placed")
    through = scratch.save(scratch.numbered(placed, [F.col(c) for c in (shard, *order, "_at")], "_number", 0), "numbers")
    first = through.groupBy(F.col(shard).alias("_shard")).agg(F.min("_number").alias("_first"))  # a row a shard
    return through.join(F.broadcast(first), F.col(shard) == F.col("_shard")).withColumn("slot", F.col("_number") - F.col("_first")).drop("_number", "_shard", "_first", "_at")


def manifest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, weights: Sequence[float] | None = None, seed: str = SEED) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, and the shard it would have with one shard more (of weight 1)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (text_bytes(text_col) + OVERHEAD).alias("size"), F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_best", _best(_key("id"), weights or (1.0,) * shards, seed))
    # a new shard can only win keys for itself: one more draw tells
    grown = F.least("_best", _score(_key("id"), shards, 1.0, seed))["shard"].cast("int")
    rows = rows.withColumn("grown_shard", grown).withColumn("shard", F.col("_best.shard").cast("int")).withColumn("law", F.lit("key")).drop("_best")
    return slots(rows, ["id", "text_crc32", "size"]).withColumnRenamed("id", id_col)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, seed: str = SEED) -> None:
    """Writes one folder of Parquet files a shard; every task writes what it has, so no shard goes through one task."""
    assign(docs, id_col, weights, seed).write.partitionBy("shard").mode("overwrite").parquet(path)
