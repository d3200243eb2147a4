"""Benchmark decontamination by greedy string tiling (Wise, 1993) with running Karp-Rabin matching.

Words are runs of 0-9, letters and non-ASCII characters, lower-cased. Seeds are runs of `match` words. The longest match of
words that no tile holds yet becomes a tile, again and again, so passages count in any order; the search runs over hashes of
windows whose length only shrinks, and every match is verified word by word. A text leaks an item if its tiles cover at least
`coverage` of the item's words.

Texts and items meet in a join by seed. A text gives only the words of the seeds that pass a filter of a bounded size, built
from all items' seeds, so one pass over the texts serves a benchmark of any size. An item of n words that is covered shares at
least ceil(coverage * n) / match of its places with the text, so its most frequent seeds, fewer places than that, need
not be joined: a phrase that very many texts and items have brings no pairs.

Items of fewer words than a seed are matched whole where `short` asks for it: such an item is its own seed, and a text leaks it
if all its words stand there in a row. `clean` does not ask for it unless told to, since a phrase of one to three words stands in
many texts that have nothing to do with a benchmark.

Defined results: a null or empty text leaks nothing; an item of fewer words than a seed is found whole or, without
`short`, not at all; an item without words is never found; repeated rows, of
texts or of items, are judged each by itself, and null ids stay null; of matches of one length the one that begins first
in the item, then in the text, is the tile; an empty table of texts or items gives an empty result (and drops nothing);
other columns are ignored by `leaks` and pass through `clean`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipcoach.llm import tokens
from slipcoach.plans import shared as scratch

MATCH, COVERAGE = 4, 0.6
#: Bits of the filter of seeds: a sixteenth of them set, and no more than 2^27 (16 MB) however many seeds there are.
LEAST_BITS, MOST_BITS = 16, 27
#: Bits of the table of leaking texts (1 MB).
LEAKY_BITS = 23
_U = np.uint64
_BASE = 0xD1342543DE82EF95


def _windows(words: np.ndarray, free: np.ndarray, length: int, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the windows of free words."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    start = np.flatnonzero(taken[length:] == taken[:-length])
    total = np.concatenate([np.zeros(1, _U), np.cumsum(words * powers[: len(words)])])
    return (total[start + length] - total[start]) * powers[len(words) - start], start


def tiles(item: np.ndarray, text: np.ndarray, match: int) -> list[int]:
    """Lengths of the tiles of two sequences of words; a 0 in the text is a gap that nothing matches."""
    powers = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(max(len(item), len(text)) + 1, _U(_BASE))]))
    # windows of both sides are brought to the same power of the base
    shift = max(len(item), len(text))
    item_free, text_free, out = np.ones(len(item), bool), text != 0, []

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, at = _windows(item, item_free, length, powers)
        b, place = _windows(text, text_free, length, powers)
        return a * powers[shift - len(item)], at, b * powers[shift - len(text)], place

    def any_common(length: int) -> bool:
        a, _, b, _ = common(length)
        return bool(np.isin(a, b).any())

    most = min(len(item), len(text))
    while most >= match and any_common(match):
        least, over = match, most + 1
        while over - least > 1:  # the longest window that both have
            middle = (least + over) // 2
            least, over = (middle, over) if any_common(middle) else (least, middle)
        a, at, b, place = common(least)
        order = np.lexsort((place, b))
        b, place = b[order], place[order]
        following = {}
        for k in np.flatnonzero(np.isin(a, b)):
            i = at[k]
            if not (item_free[i] and item_free[i + least - 1]):  # a tile is no shorter than a window: it holds one of its ends
                continue
            j = following.get(a[k], int(np.searchsorted(b, a[k])))
            while j < len(b) and b[j] == a[k] and not (text_free[place[j]] and text_free[place[j] + least - 1]):
                j += 1
            if j < len(b) and b[j] == a[k] and np.array_equal(item[i : i + least], text[place[j] : place[j] + least]):
                item_free[i : i + least] = text_free[place[j] : place[j] + least] = False
                out.append(least)
                j += 1
            following[a[k]] = j
        most = least - 1
    return out


def _sequences(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, words) of texts; no word is 0."""
    for w in tokens.words(pc.utf8_lower(column), tokens.NON_ALNUM):
        bound, hashes = w.bounds(), np.maximum(w.hash, _U(1))
        for r in range(w.rows):
            yield w.first + r, hashes[bound[r] : bound[r + 1]]


def _blobs(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, _U)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _itemised(match: int, least: int) -> Callable:
    """(item, item_id, n, words, seeds: of every place) of the items of that many words at least"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(r, w) for r, w in _sequences(batch.column("text")) if len(w) >= least]
            at = pa.array([r for r, _ in got], pa.int64())
            seeds = _lists([tokens.grams(w, min(match, len(w))) for _, w in got])
            yield pa.RecordBatch.from_arrays([batch.column("item").take(at), batch.column("item_id").take(at), pa.array([len(w) for _, w in got], pa.int64()), _blobs([w for _, w in got]), seeds], names=["item", "item_id", "n", "words", "seeds"])

    return run


def _probed(lengths: list[int], shared) -> Callable:
    """(id, digest, words, seeds) of the texts with seeds of these lengths that pass the filter: the words of such seeds, with a 0 between runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, flags = shared.value
        for batch in batches:
            at, words, seeds = [], [], []
            for r, w in _sequences(batch.column("text")):
                kept, passed = np.zeros(len(w) + 1, bool), []
                for length in lengths:
                    if len(w) < length:
                        continue
                    grams = tokens.grams(w, length)
                    slot = (grams >> _U(64 - bits)).astype(np.int64)
                    hit = np.flatnonzero(flags[slot >> 3] >> (slot & 7) & 1)
                    for k in range(length):
                        kept[hit + k] = True
                    passed.append(grams[hit])
                if not kept.any():
                    continue
                gap = np.flatnonzero(kept[:-1] & ~kept[1:]) + 1  # behind each run
                held = np.where(kept, np.append(w, _U(0)), _U(0))
                kept[gap] = True
                at.append(r)
                words.append(held[kept])
                seeds.append(np.unique(np.concatenate(passed)))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("digest").take(rows), _blobs(words), _lists(seeds)], names=["id", "digest", "words", "seeds"])

    return run


def _tiled(match: int, coverage: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, made = [], []
            for k, (x, y) in enumerate(zip(batch.column("item_words"), batch.column("text_words"), strict=True)):
                item, text = (np.frombuffer(v.as_buffer(), _U) for v in (x, y))
                seed = min(match, len(item))
                both = np.isin(tokens.grams(item, seed), tokens.grams(text, seed)) if len(text) >= seed else np.zeros(1, bool)
                near = np.zeros(len(item), bool)
                for j in range(seed):
                    near[np.flatnonzero(both) + j] = True
                if near.sum() < coverage * len(item):  # no tile holds a word outside the seeds
                    continue
                found = tiles(item, text, seed)
                if found and sum(found) >= coverage * len(item):
                    keep.append(k)
                    made.append((sum(found) / len(item), len(found), max(found)))
            at = pa.array(keep, pa.int64())
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("id", "digest", "item_id", "n")), *columns], names=["id", "digest", "item_id", "item_words", "coverage", "n_tiles", "longest_tile"])

    return run


def _flags(spark: SparkSession, hashes: DataFrame, bits: int, column: str) -> np.ndarray:
    """A bit for each hash by its leading bits; 2^bits of them, whatever the input."""
    slot = F.shiftrightunsigned(column, 64 - bits)
    words = hashes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    got = words.toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def _matches(docs: DataFrame, benchmark: DataFrame, id_col: Column, text_col: str, item_col: str, item_text: str, match: int, coverage: float, short: bool) -> DataFrame:
    """(id, digest, item_id, item_words, coverage, n_tiles, longest_tile) of every text and item that it leaks."""
    spark = docs.sparkSession
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    of_item, of_text = dict(items.dtypes)["item_id"], docs.select(id_col.alias("id")).dtypes[0][1]
    items = scratch.save(items.mapInArrow(_itemised(match, 1 if short else match), f"item long, item_id {of_item}, n long, words binary, seeds array<long>"), "items")
    seeds = items.select("item", "n", F.explode("seeds").alias("seed")).groupBy("seed", "item", "n").agg(F.count("*").alias("places"))
    seeds = scratch.save(seeds, "seeds")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * seeds.count()).bit_length()))
    shared = spark.sparkContext.broadcast((bits, _flags(spark, seeds, bits, "seed")))
    # lengths of seeds that items have: at most `match` of them
    lengths = [r.length for r in items.select(F.least("n", F.lit(match)).alias("length")).distinct().orderBy("length").collect()]
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(id_col.alias("id"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    probed = rows.mapInArrow(_probed(lengths, shared), f"id {of_text}, digest string, words binary, seeds array<long>")
    hits = scratch.save(probed.withColumn("row", F.monotonically_increasing_id()), "hits")
    said = hits.select("row", F.explode("seeds").alias("seed"))
    often = said.groupBy("seed").agg(F.count("*").alias("texts"))
    # of each item the rarest seeds, all but fewer places than a covered item must share
    spare = F.ceil(F.ceil(F.lit(coverage) * F.col("n")) / match) - 1
    ranked = seeds.join(often, "seed").selectExpr("*", "sum(places) OVER (PARTITION BY item ORDER BY texts DESC, seed) AS places_before")
    wanted = ranked.filter(F.col("places_before") > spare).select("seed", "item")
    pairs = scratch.save(said.join(wanted, "seed").select("row", "item").distinct(), "pairs")
    full = pairs.join(hits.select("row", "id", "digest", F.col("words").alias("text_words")), "row").join(items.select("item", "item_id", "n", F.col("words").alias("item_words")), "item")
    schema = f"id {of_text}, digest string, item_id {of_item}, item_words long, coverage double, n_tiles long, longest_tile long"
    out = scratch.save(full.select("id", "digest", "item_id", "n", "item_words", "text_words").mapInArrow(_tiled(match, coverage), schema), "leaks", batch_rows=100)
    shared.destroy()
    scratch.drop(items, seeds, hits, pairs)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", match: int = MATCH, coverage: float = COVERAGE, short: bool = False) -> DataFrame:
    """One row per document and item that it leaks: id, item_id, item_words, coverage, n_tiles, longest_tile."""
    found = _matches(docs, benchmark, F.col(f"`{id_col}`"), text_col, item_col, item_text, match, coverage, short)
    return found.select(F.col("id").alias(id_col), "item_id", "item_words", "coverage", "n_tiles", "longest_tile")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", match: int = MATCH, coverage: float = COVERAGE, short: bool = False) -> DataFrame:
    """The documents that leak no item, as they are.

    A table of bits of a fixed size tells most texts that they are clean, so that only those that may leak are shuffled.
    """
    leaky = _matches(docs, benchmark, F.lit(0), text_col, item_col, item_text, match, coverage, short).select(F.col("digest").alias("leaky")).distinct()
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << LEAKY_BITS))
    set_ = leaky.select(slot("leaky").alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.md5(F.col(f"`{text_col}`").cast("string").cast("binary")).alias("digest"))
    whole = whole.withColumn("slot", F.coalesce(slot("digest"), F.lit(0)))
    # at most 2^17 rows of 64 bits
    told = whole.join(F.broadcast(set_), F.shiftright("slot", 6) == F.col("at"), "left").withColumn("may", F.coalesce(F.getbit("bits", F.col("slot").bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1)
    checked = told.filter("may").join(leaky, F.col("digest") == F.col("leaky"), "left_anti")
    return told.filter(~F.col("may")).select("row.*").union(checked.select("row.*"))
