"""Exact duplicates by deterministic block naming; DataFrame functions only.

A text without its white space is cut into blocks of a fixed number of bytes. Sorting all blocks gives every distinct block an
integer name (the place at which its run begins); then adjacent names are paired and the pairs are sorted and named likewise,
until each document has one name. Names are given by comparing contents, never by a hash of them, so two documents have the
same name at the same level exactly if their texts are equal (Karp, Miller and Rosenberg, 1972).

The keys that most rows have, at most HOT of them, are sorted in PARTS parts each, and their few names are made one afterwards;
of all others none has more than 1/HOT of the rows. A hash only deals rows out and finds those keys.

Defined results: a null text counts as empty; all empty texts are equal; of equal texts the row with the most code points stays,
then the smallest id, a null id last, and of rows alike in both any one; an empty table gives an empty one; other columns are
not looked at, and `keep` passes them through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipcoach.plans import shared as scratch

BLOCK, HOT, PARTS = 1024, 256, 64
SPACES = " \t\n\x0b\x0c\r"


def _blocks(docs: DataFrame, text: Column, size: int) -> DataFrame:
    """(row, n, pos, block, head): the blocks of each text, n of them; head has id, points and sha with the first block, else null."""
    rows = docs.select("row", "id", F.coalesce(text, F.lit("")).alias("text")).withColumn("bare", F.translate("text", SPACES, ""))
    rows = rows.select("row", F.struct("id", F.length("text").cast("long").alias("points"), F.sha2("bare", 256).alias("sha")).alias("head"), F.col("bare").cast("binary").alias("bare"))
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("bare") / size).cast("int")))
    cut = F.expr(f"transform(sequence(0, n - 1), i -> substring(bare, i * {size} + 1, {size}))")
    rows = rows.select("row", "n", "head", F.posexplode(cut).alias("pos", "block"))
    return rows.withColumn("head", F.when(F.col("pos") == 0, F.col("head")))


def _frequent(rows: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys that most rows have, at most HOT of them."""
    counts = rows.groupBy(F.xxhash64(*keys).alias("hash")).count()
    return [r["hash"] for r in counts.filter("count > 1").orderBy(F.desc("count"), "hash").limit(HOT).collect()]


def named(rows: DataFrame, keys: Sequence[str], rest: Sequence[str], label: str) -> DataFrame:
    """(rest, name): a saved table in which rows have the same integer name exactly if they are alike in the keys; rows has `row`."""
    hot = F.xxhash64(*keys).isin(_frequent(rows, keys))
    placed = rows.withColumn("part", F.when(hot, F.pmod(F.hash("row"), F.lit(PARTS)) + 1).otherwise(0))
    placed = placed.repartition(*keys, "part").sortWithinPartitions(*keys, "part").withColumn("at", F.monotonically_increasing_id())
    begun = placed.withColumn("name", F.min("at").over(Window.partitionBy(*keys, "part")))
    first = F.when((F.col("part") > 0) & (F.col("at") == F.col("name")), F.struct(*keys))
    saved = scratch.save(begun.select(*rest, "name", first.alias("first")), label)
    parts = saved.filter("first is not null").select("first", "name")  # at most HOT * PARTS rows
    one = parts.groupBy("first").agg(F.min("name").alias("to")).join(parts, "first").filter("name <> to").select("name", "to")
    out = saved.drop("first").join(F.broadcast(one), "name", "left").select(*rest, F.coalesce("to", "name").alias("name"))
    out._scratch_path = saved._scratch_path
    return out


def identities(docs: DataFrame, text: Column, size: int = BLOCK) -> DataFrame:
    """(row, id, points, sha, level, name): a row for each row of docs (row, id and text); level and name tell texts apart."""
    rows = named(_blocks(docs, text, size), ["block"], ["row", "n", "pos", "head"], "blocks")
    heads = rows.filter("pos = 0").select("row", "head.*")
    most = rows.agg(F.max("n")).first()[0] or 1
    found, level = rows.filter("n = 1").select("row", F.lit(0).alias("level"), "name"), 0
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        left = F.col("pos") % 2 == 0
        pairs = rows.filter("n > 1").groupBy("row", "n", F.shiftright("pos", 1).alias("half")).agg(F.max(F.when(left, F.col("name"))).alias("a"), F.max(F.when(~left, F.col("name"))).alias("b"))
        pairs = pairs.select("row", F.shiftright(F.col("n") + 1, 1).alias("n"), F.col("half").alias("pos"), "a", "b")
        rows = named(scratch.save(pairs, "pairs"), ["a", "b"], ["row", "n", "pos"], "names")
        found = found.union(rows.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
    return heads.join(found, "row")


def _classes(docs: DataFrame, text: Column, size: int) -> DataFrame:
    """(row, id, keep_id, group_size, kept, text_sha256)"""
    rows = scratch.save(identities(docs, text, size), "identities")
    stays = F.min(F.struct(-F.col("points"), F.col("id").isNull().alias("none"), "id", "row")).alias("stays")
    groups = scratch.save(rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), stays), "groups")
    out = rows.join(groups, ["level", "name"])
    return out.select("row", "id", F.col("stays.id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """One row per document: id, keep_id (the row that stays of its equals), group_size, kept, text_sha256 (of the text without white space)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return _classes(rows, F.col("text"), size).drop("row").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    held = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")
    rows = held.select("row", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))
    stay = _classes(rows, F.col("text"), size).filter("kept").select("row")
    return held.join(stay, "row", "left_semi").select("doc.*")
