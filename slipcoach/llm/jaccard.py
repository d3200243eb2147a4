"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents are rows, shingles columns; two rows link when their overlap reaches the share `percent` of their union. Of a
pair of sizes (na, nb) at least alpha = ceil(percent * (na + nb) / (100 + percent)) columns must meet, so only part of the
product can count, and only that part is formed:

1. The cells. Columns are ordered from rare to common, and the rows of a cell that can reach alpha share a column among the
   first na - alpha + 1 and nb - alpha + 1 of theirs. These leading entries are joined by column; a cell whose sizes, places
   or parity sketches (which differ in no more bits than the sets in shingles) leave less than alpha is discarded.
2. The counts. The columns of the rows that are left are cut into blocks by their leading bits, so that a block of a row
   holds about 2^BLOCK_BITS columns at most. Each block adds its overlap to its cell, and a cell whose sum stays below alpha
   is discarded. Columns are hashes of 64 bits, in the blocks too: that two different ones of a cell of a thousand columns
   a side are taken for one has a chance below 10^-13.

Equal rows are one row from the start. Large groups of near copies are contracted before cells are listed: in each column
every row first meets the row with the fewest rarer columns; what links is one component, and only then cells of different
components are listed. A column with many rows left is cut into squares of SQUARE x SQUARE rows, dealt over tasks, so no
task holds all rows of a column; cells that the bounds exclude never leave the join.

Defined results: a null or empty text has no shingles and is linked with nothing; a text of fewer words
than the shingle length has one shingle, its whole sequence; rows that repeat an id keep one row each, and
rows with a null id take part but never name a component (a component of such rows alone has a null id); an id that
cannot be read as a number counts as null; other columns are ignored by `cluster` and pass through `keep_one`, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipcoach.llm import dense, tokens
from slipcoach.llm.components import components
from slipcoach.plans import shared as scratch

SHINGLE, PERCENT = 4, 85
#: Cells of the column-frequency sketch (4 MB as a broadcast), and bits of the filter of wanted rows (1 MB): both fixed sizes.
SKETCH_BITS, WANTED_BITS = 20, 23
SLICES = 64
LANES = 8
#: Columns of a block of one row, about; rows on each side of a square of cells.
BLOCK_BITS, SQUARE = 12, 1024
#: Sets that a task remembers so as to hand on equal ones once; forgetting them costs rows, not results.
REMEMBERED = 1 << 16
_U = np.uint64


def _sets(batch: pa.RecordBatch, column: str, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a batch."""
    for w in tokens.words(batch.column(column)):
        at = w.bounds()
        for r in range(w.rows):
            yield w.first + r, np.unique(tokens.grams(w.hash[at[r] : at[r + 1]], shingle))


def _node(grams: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of the set."""
    high, low = (int(tokens.mix(grams ^ _U(seed)).sum()) for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    return high ^ len(grams), low


def _lanes(grams: np.ndarray) -> np.ndarray:
    """Parity sketch: bit k tells whether an odd number of shingles fall on k. It differs in no more bits than the sets in shingles."""
    bits = np.bincount((tokens.mix(grams) >> _U(64 - 9)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _level(n: int, bits: int) -> int:
    """2 to this power blocks hold the columns of a row of n, about 2^bits each."""
    return ((n - 1) >> bits).bit_length()


def _profile(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.uint32)
        heap, held = [], 0
        for batch in batches:
            n, high, low = np.zeros(len(batch), np.int64), np.zeros(len(batch), _U), np.zeros(len(batch), _U)
            lanes = np.zeros((len(batch), LANES), np.int64)
            for row, grams in _sets(batch, "text", shingle):
                n[row], (high[row], low[row]), lanes[row] = len(grams), _node(grams), _lanes(grams)
                heap.append((grams >> _U(64 - SKETCH_BITS)).astype(np.int32))
                held += len(grams)
                if held > 1 << 19:
                    cells += np.bincount(np.concatenate(heap), minlength=len(cells)).astype(np.uint32)
                    heap, held = [], 0
            none = pa.nulls(len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n), tokens.binary16(high, low), pa.array(low.view(np.int64)), *(pa.array(lanes[:, k]) for k in range(LANES)), none.cast(pa.int32()), none.cast(pa.binary())], names=_PROFILE
            )
        if held:
            cells += np.bincount(np.concatenate(heap), minlength=len(cells)).astype(np.uint32)
        blobs = dense.parts(cells, SLICES)
        gone = pa.nulls(len(blobs), pa.int64())
        yield pa.RecordBatch.from_arrays([gone, gone, pa.nulls(len(blobs), pa.binary()), gone, *[gone] * LANES, *blobs.columns], names=_PROFILE)

    return run


_LANE = [f"lane{k}" for k in range(LANES)]
_PROFILE = ["id", "n", "node", "key", *_LANE, "slice", "cells"]
_PROFILE_TYPES = "id long, n long, node binary, key long, " + "".join(f"{x} long, " for x in _LANE) + "slice int, cells binary"


def _frequencies(blobs: DataFrame) -> np.ndarray:
    """The sketch summed over all documents; its size is fixed, whatever the input."""
    return np.minimum(dense.total(blobs, 1 << SKETCH_BITS, SLICES), 2**32 - 1).astype(np.uint32)


def _leading(shingle: int, percent: int, sketch) -> Callable:
    """The first columns of each row from rare to common, so many as a partner of any size may need; copies within a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = sketch.value, set()
        for batch in batches:
            out: list[tuple[np.ndarray, int, int]] = []
            held = 0
            for _, grams in _sets(batch, "text", shingle):
                if not len(grams) or (key := _node(grams)[1]) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                n = len(grams)
                order = np.argsort(cells[(grams >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(_U) << _U(32) | grams >> _U(32), kind="stable")
                out.append((grams[order[: n - -(-percent * n // 100) + 1]], key, n))
                held += len(out[-1][0])
                if held > 1 << 16:
                    yield _postings(out)
                    out, held = [], 0
            if out:
                yield _postings(out)

    return run


def _postings(rows: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
    each = [len(x[0]) for x in rows]
    place = np.concatenate([np.arange(x, dtype=np.int32) for x in each])
    keys = np.repeat(np.array([x[1] for x in rows], _U).view(np.int64), each)
    sizes = np.repeat(np.array([x[2] for x in rows], np.int32), each)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in rows]).view(np.int64)), pa.array(keys), pa.array(sizes), pa.array(place)], names=["gram", "key", "n", "place"])


def _alpha(a: Column | str, b: Column | str, percent: int) -> Column:
    return F.ceil(percent * (F.col(a) + F.col(b)) / F.lit(float(100 + percent)) - 1e-9)


def _sized(percent: int) -> Column:
    """A cell (na, nb, pa, pb) can reach alpha: by the sizes, and by places that the partner's size asks for."""
    alpha = _alpha("na", "nb", percent)
    return (F.least("na", "nb") >= alpha) & (F.col("pa") <= F.col("na") - alpha) & (F.col("pb") <= F.col("nb") - alpha)


def _near(percent: int) -> Column:
    """A cell can reach alpha by its parity sketches."""
    apart = sum((F.bit_count(F.col(f"a_{k}").bitwiseXOR(F.col(f"b_{k}"))) for k in _LANE), F.lit(0))
    return apart <= F.col("na") + F.col("nb") - 2 * _alpha("na", "nb", percent)


def _labelled(nodes: DataFrame) -> DataFrame:
    """Adds label: whether the id is null, the id with its sign turned, the node, as bytes in this order.

    Labels sort as (id, node), null ids last, so the least label of a component tells its id and no join has to look for it.
    """
    turned = F.unhex(F.lpad(F.hex(F.coalesce("id", F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return nodes.withColumn("label", F.concat(F.unhex(F.when(F.col("id").isNull(), "01").otherwise("00")), turned, F.col("node")))


def _labels(ids: list, nodes: list[tuple[int, int]]) -> list[bytes]:
    return [bytes([x is None]) + ((x or 0) + (1 << 63)).to_bytes(8) + high.to_bytes(8) + low.to_bytes(8) for x, (high, low) in zip(ids, nodes, strict=True)]


def _id_of(label: Column) -> Column:
    number = F.conv(F.hex(F.substring(label, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.substring(label, 1, 1) == F.unhex(F.lit("00")), number.cast("long"))


def _side(rows: DataFrame, x: str, *more: Column) -> DataFrame:
    """Columns of one side of a cell."""
    return rows.select(F.col("label").alias(x), F.col("n").alias(f"n{x}"), *(F.col(k).alias(f"{x}_{k}") for k in _LANE), *more)


_CELL = ["a", "b", "na", "nb"]


def _packed(grams: np.ndarray) -> bytes:
    """Sorted, distinct columns without loss: the first, then gaps of seven bytes, with the places and top bytes of wider gaps before them.

    Where that saves nothing, as in short sets, all columns are written as they are.
    """
    gaps = np.diff(grams)
    top = (gaps >> _U(56)).astype(np.uint8)
    wide = np.flatnonzero(top)
    if 3 * len(wide) >= len(gaps) or len(gaps) >= 1 << 16:
        return b"\x08" + grams.astype("<u8").tobytes()
    low = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
    return b"\x07" + len(wide).to_bytes(2, "little") + grams[:1].astype("<u8").tobytes() + wide.astype("<u2").tobytes() + top[wide].tobytes() + low.tobytes()


def _unpacked(blob: pa.Buffer) -> np.ndarray:
    data = np.frombuffer(blob, np.uint8)
    if data[0] == 8:
        return np.frombuffer(data[1:].tobytes(), "<u8").astype(_U)
    n = int(data[1]) | int(data[2]) << 8
    first, wide, top, low = np.split(data[3:], np.cumsum([8, 2 * n, n]))
    out = np.zeros((len(low) // 7, 8), np.uint8)
    out[:, :7] = low.reshape(-1, 7)
    out[np.frombuffer(wide.tobytes(), "<u2"), 7] = top
    return np.cumsum(np.concatenate([np.frombuffer(first.tobytes(), "<u8"), out.view("<u8").ravel()]).astype(_U))


def _wanted_blocks(shingle: int, percent: int, flags, block_bits: int) -> Callable:
    """(label, level, block, columns) of the rows that flags lets through, at each level that a partner may ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = flags.value
        for batch in batches:
            slot = batch.column("slot").to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.flatnonzero(bits[slot >> 3] >> (slot & 7) & 1)))
            ids, rows, held = batch.column("id").to_pylist(), [], 0
            for row, grams in _sets(batch, "text", shingle):
                if not len(grams):
                    continue
                node, n = _node(grams), len(grams)
                for level in range(_level(n, block_bits), _level(100 * n // percent, block_bits) + 1):
                    block = (grams >> _U(64 - level)).astype(np.int64) if level else np.zeros(n, np.int64)
                    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                    rows += [(ids[row], node, level, int(block[b]), _packed(grams[b:e])) for b, e in zip(first, [*first[1:], n], strict=True)]
                    held += n
                    if held > 1 << 18:
                        yield _block_rows(rows)
                        rows, held = [], 0
            if rows:
                yield _block_rows(rows)

    return run


def _block_rows(rows: list) -> pa.RecordBatch:
    labels = pa.array(_labels([x[0] for x in rows], [x[1] for x in rows]), pa.binary())
    levels, blocks, grams = (pa.array([x[k] for x in rows], t) for k, t in ((2, pa.int32()), (3, pa.int32()), (4, pa.binary())))
    return pa.RecordBatch.from_arrays([labels, levels, blocks, grams], names=["label", "level", "block", "columns"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many columns of a block meet in each cell."""
    for batch in batches:
        met = np.zeros(len(batch), np.int64)
        for k, (x, y) in enumerate(zip(batch.column("ca"), batch.column("cb"), strict=True)):
            both = np.sort(np.concatenate([_unpacked(v.as_buffer()) for v in (x, y)]))
            met[k] = int((both[1:] == both[:-1]).sum())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb", "block")), pa.array(met)], names=["a", "b", "na", "nb", "block", "met"])


def _links(cells: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The cells (a, b) that reach alpha, by the sum of the overlaps of their blocks."""
    spark = cells.sparkSession
    cells = scratch.save(cells.select(_CELL), "cells")
    # the filter only spares work: rows it lets through by chance find no cell in the join below
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << WANTED_BITS))
    words = cells.select(F.explode(F.array(slot(_id_of(F.col("a"))), slot(_id_of(F.col("b"))))).alias("slot"))
    words = words.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    flags = np.zeros((1 << WANTED_BITS) // 64, np.int64)
    got = words.toArrow()  # at most 2^17 rows
    flags[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(flags.view(np.uint8))
    blocks = texts.select("id", "text", slot("id").alias("slot")).mapInArrow(_wanted_blocks(shingle, percent, shared, BLOCK_BITS), "label binary, level int, block int, columns binary")
    blocks = scratch.save(blocks, "blocks")
    over = lambda n: F.when(F.col(n) > 1 << BLOCK_BITS, F.length(F.bin(F.shiftright(F.col(n) - 1, BLOCK_BITS)))).otherwise(0)
    asked = cells.withColumn("level", F.greatest(over("na"), over("nb"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, level) - 1"))))
    part = lambda x: blocks.select(F.col("label").alias(x), "level", "block", F.col("columns").alias(f"c{x}"))
    full = asked.join(part("a"), ["a", "level", "block"]).join(part("b"), ["b", "level", "block"])
    met = full.select("a", "b", "na", "nb", "block", "ca", "cb").mapInArrow(_met, "a binary, b binary, na long, nb long, block int, met long")
    met = met.groupBy("a", "b", "na", "nb", "block").agg(F.max("met").alias("met"))  # a row that repeats its id counts once
    out = met.groupBy("a", "b", "na", "nb").agg(F.sum("met").alias("met")).filter(100 * F.col("met") >= percent * (F.col("na") + F.col("nb") - F.col("met")))
    out = scratch.save(out.select("a", "b"), "links", batch_rows=256)
    shared.destroy()
    scratch.drop(cells, blocks)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").try_cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _heads(postings: DataFrame) -> DataFrame:
    """The columns that more than one row leads with (gram), and of each the row with the fewest rarer columns."""
    # rows of one place are told apart by 44 bits of their keys, so that all three of a head are of one row
    turn = F.shiftleft(F.least("place", F.lit((1 << 20) - 1)).cast("long"), 44).bitwiseOR(F.shiftrightunsigned("key", 20))
    first = lambda c: F.min_by(c, turn)
    each = postings.groupBy("gram").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("held"), first("key").alias("head"), first("n").alias("head_n"), first("place").alias("head_place"))
    return each.filter("low != high")


def _listed(blocks: DataFrame, nodes: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Cells of different components in columns of more than two rows (the only cell of two rows has met)."""
    rooted = nodes.join(joined.withColumnRenamed("node", "label"), "label", "left").withColumn("root", F.xxhash64(F.coalesce("root", "label")))
    wide = blocks.filter("held > 2").select("gram", "third", "key", "place")
    labelled = wide.join(rooted.select("key", "root"), "key")
    mixed = labelled.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("third").alias("third"), F.count("*").alias("held"))
    mixed = scratch.save(mixed.filter("x != y AND third").select("gram", F.ceil(F.col("held") / SQUARE).cast("int").alias("stripes")), "mixed")
    rows = wide.select("gram", "key", "place").join(mixed, "gram").distinct().join(rooted, "key")
    rows = scratch.save(rows.withColumn("stripe", F.pmod(F.xxhash64("label"), F.col("stripes")).cast("int")), "open")
    place = lambda x: (F.col("place").alias(f"p{x}"), F.col("root").alias(f"r{x}"), F.col("stripe").alias(f"s{x}"))
    down = _side(rows, "a", *place("a"), "gram", F.explode(F.expr("sequence(stripe, stripes - 1)")).alias("other"))
    across = _side(rows, "b", *place("b"), "gram", F.explode(F.expr("sequence(0, stripe)")).alias("other"))
    # the square of stripes (sa, sb), sa <= sb: a is dealt to every later stripe, b to every earlier one
    at = [down["gram"] == across["gram"], F.col("sa") == across["other"], down["other"] == F.col("sb")]
    once = (F.col("sa") < F.col("sb")) | (F.col("a") < F.col("b"))
    met = down.join(across, [*at, once, F.col("ra") != F.col("rb"), _sized(percent), _near(percent)])
    turned = F.col("a") > F.col("b")
    swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    return met.select(swap("a", "b"), swap("b", "a"), swap("na", "nb"), swap("nb", "na")).distinct()


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), group (name of the component), node (of its set)."""
    spark = docs.sparkSession
    texts = _rows(docs, id_col, text_col)
    both = scratch.save(texts.mapInArrow(_profile(shingle), _PROFILE_TYPES), "profile")
    profile = both.filter("slice is null")
    sketch = spark.sparkContext.broadcast(_frequencies(both.filter("slice is not null").select("slice", "cells")))
    nodes = profile.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), *(F.first(x).alias(x) for x in ("n", "key", *_LANE)))
    nodes = scratch.save(_labelled(nodes), "nodes")

    # keys are 64 bits of the rows' names; a cell of keys stands for the cells of all rows with them
    postings = texts.mapInArrow(_leading(shingle, percent, sketch), "gram long, key long, n int, place int").repartition("gram")
    third = (F.col("key") != F.col("low")) & (F.col("key") != F.col("high"))
    blocks = scratch.save(postings.join(_heads(postings), "gram").withColumn("third", third).drop("low", "high"), "columns")
    met = blocks.filter("key != head").select(F.col("key").alias("ka"), F.col("head").alias("kb"), F.col("n").alias("na"), F.col("head_n").alias("nb"), F.col("place").alias("pa"), F.col("head_place").alias("pb"))
    met = met.filter(_sized(percent)).select("ka", "kb").distinct()
    first = met.join(_side(nodes, "a", F.col("key").alias("ka")), "ka").join(_side(nodes, "b", F.col("key").alias("kb")), "kb").filter(_near(percent))
    links = _links(first, texts, shingle, percent)
    joined = scratch.save(components(links), "joined")
    more = _links(_listed(blocks, nodes, joined, percent), texts, shingle, percent)
    scratch.drop(blocks, links)
    roots = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    # components of nodes, a row each; documents meet their node last, and a node with very many of them is split by the skew join
    named = nodes.select("node", "label").join(roots.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("group"))
    found = profile.select("id", "n", "node").join(named, "node", "left")
    component = F.when(F.col("n") > 0, _id_of(F.col("group"))).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), "group", F.when(F.col("n") > 0, F.col("node")).alias("node"))


def _named(shingle: int) -> Callable:
    """(id, digest, node) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = np.zeros(len(batch), _U), np.zeros(len(batch), _U)
            for row, grams in _sets(batch, "text", shingle):
                high[row], low[row] = _node(grams)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), tokens.binary16(high, low)], names=["id", "digest", "node"])

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without all but one of each component: that with the smallest id stays, as it is.

    Documents without words stay. Where several rows have that id, one row of the component stays: of the set of shingles,
    then of the text, with the smallest hash; the other rows of that id stand for their own components. A component without
    any id keeps one row in the same way.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").try_cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = scratch.save(cluster(whole, "id", "text", shingle, percent).filter("n_shingles > 0"), "found")
    chosen = found.filter(F.col("component_id").eqNullSafe(F.col("id"))).groupBy("id", "group").agg(F.min("node").alias("node"))
    total = found.groupBy(F.col("id").alias("of")).agg(F.count("*").alias("total"))
    chosen = scratch.save(chosen.join(total.hint("merge"), F.col("id").eqNullSafe(F.col("of"))).select("of", "node", "total"), "chosen")
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # the same plan at every size: a table of ids grows with the documents, so it is merged, not broadcast
    stay = chosen.filter("total = 1").select("of", F.lit(True).alias("stays")).hint("merge")
    out = whole.join(stay, F.col("id").eqNullSafe(F.col("of")), "left").filter(~words | F.col("stays")).select("row.*")
    again = chosen.filter("total > 1")
    if again.isEmpty():
        return out
    # ids of several rows: which of their texts has the set that was chosen
    digest = F.md5(F.col("text").cast("binary"))
    twice = whole.filter(words).join(again.select("of").distinct(), F.col("id").eqNullSafe(F.col("of"))).select("id", "text", digest.alias("digest"))
    named = scratch.save(twice.mapInArrow(_named(shingle), "id long, digest string, node binary"), "named")
    named = named.join(again.withColumnRenamed("node", "_node"), F.col("id").eqNullSafe(F.col("of")) & (F.col("node") == F.col("_node")))
    texts = named.groupBy("of", "node").agg(F.min("digest").alias("digest")).select("of", F.col("digest").alias("_digest"))
    rows = whole.withColumn("digest", digest).filter(words).join(texts, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("_digest")))
    return out.union(rows.dropDuplicates(["id", "digest"]).select("row.*"))
