"""The prefix trie of conversations, by range minima over sorted common prefixes.

Distinct sequences of turns are sorted; each has the length of the prefix that it shares with the one before it (its gap). The
members of a prefix are a run of that order, and a sparse table of minima over the gaps lets every candidate prefix find both
ends of its run by a binary search of its own, without a stack. Sums over the run then give members, children, leaves and bytes.

The order is cut into segments of SEGMENT sequences, each with a table of its own. A run that reaches over a border is left
open there, under the first or last sequence of its segment. Those border sequences, two a segment, and the gaps between them
are the same problem again, SEGMENT / 2 times smaller; so its runs are found level by level, and the open parts are added up
under them. Nothing but two counts reaches the driver.

Turns are told apart by 128 bits of SHA-256 over role and text. A conversation is held in one row by 24 bytes a turn, never by
its texts; equal conversations are one sequence, and the list of those that end at a node is hashed as a stream of pieces.

Defined results: a null role or text counts as empty; a null turn comes first; turns alike in their number follow one another
by role and text; rows that repeat are turns each; a row whose conv_id is null or no whole number is left out; without any
conversation there is no node, not even a root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipcoach.plans import shared as scratch

SEGMENT, PIECE, AT_ONCE = 512, 1 << 16, 1 << 17
WIDTH = 16
_NOTHING = hashlib.sha256().hexdigest()
_OUTSIDE = -9


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, pos, print, bytes) of every turn, pos from 0; and (conv, own), the number of turns of each conversation."""
    rows = conversations.select(F.col(f"`{conv_col}`").try_cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    rows = rows.filter("conv is not null").withColumn("bytes", F.octet_length("text").cast("long"))
    rows = rows.withColumn("print", F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * WIDTH))
    through = scratch.numbered(rows, [F.col(c) for c in ("conv", "turn", "role", "text")], "number", 0, keep=["conv", "print", "bytes"])
    convs = scratch.save(through.groupBy("conv").agg(F.count("*").alias("own"), F.min("number").alias("first")), "conversations")
    return through.join(convs, "conv").select("conv", (F.col("number") - F.col("first")).alias("pos"), "print", "bytes"), convs.select("conv", "own")


def rebuilt(rows: DataFrame, convs: DataFrame, near: int = 5, most: int = 9) -> DataFrame:
    """turns() with the first h turns of each conversation replaced by those of conversation c - c % near; h is crc32(c) % most."""
    plan = convs.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % most).withColumn("base", F.col("conv") - F.col("conv") % near)
    plan = plan.join(convs.select(F.col("conv").alias("base"), F.col("own").alias("there")), "base", "left")
    plan = scratch.save(plan.select("conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("lead")), "plan")
    tail = rows.join(plan.select("conv", "h", "lead"), "conv").filter("pos >= h").select("conv", (F.col("lead") + F.col("pos") - F.col("h")).alias("pos"), "print", "bytes")
    lead = rows.filter(F.col("pos") < most - 1).withColumnRenamed("conv", "base").join(plan.filter("lead > 0").select("conv", "base", "h"), "base").filter("pos < h")
    return tail.union(lead.select("conv", "pos", "print", "bytes"))


def sequences(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, seq, sizes): a conversation's prints one after another, and the bytes of its texts; also for those without turns."""
    listed = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "print", "bytes"))).alias("t"))
    prints, sizes = F.unhex(F.array_join(F.col("t.print"), "")), F.col("t.bytes")
    return convs.select("conv").join(listed, "conv", "left").select("conv", F.coalesce(prints, F.lit(b"")).alias("seq"), F.coalesce(sizes, F.array().cast("array<long>")).alias("sizes"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most PIECE conversations alike; the rows come sorted by seq and conv."""
    names, held, ids, first = ["seq", "sizes", "at", "ids", "n", "low"], None, [], 0

    def piece() -> pa.RecordBatch:
        seq, sizes = held
        return pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([sizes], pa.list_(pa.int64())), pa.array([first], pa.int64()), pa.array([",".join(map(str, ids)).encode()], pa.binary()), pa.array([len(ids)], pa.int64()), pa.array([ids[0]], pa.int64())], names=names)

    for batch in batches:
        at, seqs, convs, sizes = (batch.column(c) for c in ("at", "seq", "conv", "sizes"))
        for k in range(batch.num_rows):
            seq = seqs[k].as_py()
            if held is None or seq != held[0] or len(ids) == PIECE:
                if held is not None:
                    yield piece()
                held, ids, first = (seq, sizes[k].as_py()), [], at[k].as_py()
            ids.append(convs[k].as_py())
    if held is not None:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each seq from its pieces in order: bytes before each turn and in all, members, smallest member, hash of the list."""
    held, joined = None, []

    def done() -> pa.RecordBatch:
        seq, sizes, n, low, digest = held
        upto = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)
        columns = [pa.array([seq], pa.binary()), pa.array([upto], pa.list_(pa.int64())), pa.array([n], pa.int64()), pa.array([low], pa.int64()), pa.array([digest.digest()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["seq", "upto", "n", "low", "ends"])

    for batch in batches:
        seqs, ids = batch.column("seq"), batch.column("ids")
        for k in range(batch.num_rows):
            seq = seqs[k].as_py()
            if held is None or seq != held[0]:
                if held is not None:
                    joined.append(done())
                held = [seq, batch.column("sizes")[k].as_py(), 0, batch.column("low")[k].as_py(), hashlib.sha256()]
            else:
                held[4].update(b",")
            held[4].update(memoryview(ids[k].as_buffer()))
            held[2] += batch.column("n")[k].as_py()
        yield from joined
        joined.clear()
    if held is not None:
        yield done()


def items(seqs: DataFrame) -> DataFrame:
    """Distinct sequences in order: uid (dense, from 0), len, upto, n, low, ends, and the gaps before (lcp) and after (nxt), -1 at the ends."""
    placed = seqs.repartitionByRange("seq", "conv").sortWithinPartitions("seq", "conv").withColumn("at", F.monotonically_increasing_id())
    runs = scratch.save(placed.mapInArrow(_runs, "seq binary, sizes array<long>, at long, ids binary, n long, low long"), "runs")
    whole = runs.repartition("seq").sortWithinPartitions("seq", "at").mapInArrow(_hashed, "seq binary, upto array<long>, n long, low long, ends binary")
    rows = scratch.save(scratch.numbered(whole, [F.col("seq")], "uid", 0), "sequences").withColumn("len", F.size("upto") - 1)
    before = rows.select((F.col("uid") + 1).alias("uid"), F.col("seq").alias("before"))
    unlike = f"transform(sequence(1, most), k -> substring(seq, {WIDTH} * k - {WIDTH - 1}, {WIDTH}) <> substring(before, {WIDTH} * k - {WIDTH - 1}, {WIDTH}))"
    both = rows.join(before, "uid", "left").withColumn("most", F.least("len", F.floor(F.octet_length("before") / WIDTH).cast("int")))
    lcp = F.expr(f"CASE WHEN before IS NULL THEN -1 WHEN most = 0 THEN 0 ELSE coalesce(nullif(array_position({unlike}, true), 0) - 1, most) END").cast("int")
    gaps = scratch.save(both.select("uid", "len", "upto", "n", "low", "ends", lcp.alias("lcp")), "gaps")
    after = gaps.select((F.col("uid") - 1).alias("uid"), F.col("lcp").alias("nxt"))
    return gaps.join(after, "uid", "left").withColumn("nxt", F.coalesce("nxt", F.lit(-1)))


class Minima:
    """Sparse table: the least of every run of 2^k numbers."""

    def __init__(self, of: np.ndarray) -> None:
        self.levels = [of]
        while 2 << (len(self.levels) - 1) <= len(of):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        k = np.log2(last - first + 1).astype(np.int64)
        out = np.empty(len(first), self.levels[0].dtype)
        for j in np.unique(k):
            at = k == j
            out[at] = np.minimum(self.levels[j][first[at]], self.levels[j][last[at] - (1 << j) + 1])
        return out

    def ends(self, at: np.ndarray, depth: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The run of places around `at` whose gaps between are all `depth` or more; the gap before place i is number i of m + 1."""
        left, right = at.copy(), at.copy()
        for k in reversed(range(len(self.levels))):
            row, step = self.levels[k], 1 << k
            start = left - step + 1
            left -= step * ((start >= 1) & (row[np.clip(start, 0, len(row) - 1)] >= depth))
            start = right + 1
            right += step * ((right + step < m) & (row[np.clip(start, 0, len(row) - 1)] >= depth))
        return left, right


class Segment:
    """Gaps of one segment; runs at its borders are open if the gap there is deep enough."""

    def __init__(self, uid: np.ndarray, lcp: np.ndarray, last: int) -> None:
        self.m, self.uid, self.first, self.last = len(uid), uid, int(lcp[0]), last
        gaps = np.full(self.m + 1, _OUTSIDE, np.int64)
        gaps[1 : self.m] = lcp[1:]
        self.gaps = Minima(gaps)

    def runs(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, open to the left, open, name) of the run of each candidate."""
        left, right = self.gaps.ends(at, depth, self.m)
        before, after = (left == 0) & (self.first >= depth), (right == self.m - 1) & (self.last >= depth)
        return left, right, before, before | after, np.where(after, self.uid[-1], np.where(before, self.uid[0], self.uid[left]))

    def borders(self, number: int) -> dict[str, list]:
        """The first and the last sequence, for the next level."""
        if self.m == 1:
            return {"uid": [self.uid[0]], "number": [2 * number], "lcp": [self.first], "nxt": [self.last]}
        inner = int(self.gaps.levels[0][1 : self.m].min())
        return {"uid": [self.uid[0], self.uid[-1]], "number": [2 * number, 2 * number + 1], "lcp": [self.first, inner], "nxt": [inner, self.last]}


def _candidates(start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, depth) of count[i] depths from start[i] on, AT_ONCE at a time."""
    upto = np.concatenate([[0], np.cumsum(count)])
    for a in range(0, int(upto[-1]), AT_ONCE):
        k = np.arange(a, min(a + AT_ONCE, int(upto[-1])))
        at = np.searchsorted(upto, k, "right") - 1
        yield at, start[at] + k - upto[at]


_PARTS = "open boolean, uid long, depth long, n long, low long, kids long, leaves long, worth long, ends binary, parent long, parent_low long"
_BORDERS = "number long, lcp long, nxt long"
_NODES = f"border boolean, {_PARTS}, {_BORDERS}"
_MAPS = f"border boolean, open boolean, uid long, depth long, to long, {_BORDERS}"


def _batch(schema: str, rows: int, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([columns[n] if isinstance(columns.get(n), pa.Array) else pa.array(columns[n], kinds[k]) if n in columns else pa.nulls(rows, kinds[k]) for n, k in named], names=[n for n, _ in named])


def _segment_nodes(number: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The nodes that begin in a segment, or the parts of them that lie in it."""
    get = lambda c: rows.column(c).to_numpy().astype(np.int64)
    uid, length, lcp, nxt, n, low, total, fresh = map(get, ("uid", "len", "lcp", "nxt", "n", "low", "total", "fresh"))
    ends, seg, m = rows.column("ends").combine_chunks(), Segment(uid, lcp, int(nxt[-1])), len(uid)
    lows, sums = Minima(low), lambda x: np.concatenate([[0], np.cumsum(x)])
    upto_n, upto_leaves, upto_total, upto_fresh = sums(n), sums(nxt < length), sums(n * total), sums(fresh)
    begins = np.sort((lcp + 1) * (m + 1) + np.arange(m))
    start = np.concatenate([[0], lcp[1:] + 1])
    for at, depth in _candidates(start, length - start + 1):
        left, right, before, is_open, name = seg.runs(at, depth)
        kids = np.searchsorted(begins, (depth + 1) * (m + 1) + right, "right") - np.searchsorted(begins, (depth + 1) * (m + 1) + left, "right")
        kids += np.where(before, seg.first == depth, length[left] > depth)
        worth = upto_total[right + 1] - upto_total[left] - (upto_fresh[right + 1] - upto_fresh[left + 1]) - np.where(before, fresh[left], total[left])
        up_left, up_right, _, up_open, up_name = seg.runs(at, depth - 1)
        above, rooted = lows.least(up_left, up_right), depth == 0
        yield _batch(
            _NODES, len(at), border=np.zeros(len(at), bool), open=is_open, uid=name, depth=depth, n=upto_n[right + 1] - upto_n[left], low=lows.least(left, right), kids=kids,
            leaves=upto_leaves[right + 1] - upto_leaves[left], worth=worth, ends=ends.take(pa.array(left, mask=depth != length[left])),
            parent=pa.array(up_name, mask=~up_open | rooted), parent_low=pa.array(above, mask=up_open | rooted),
        )
    held = seg.borders(number)
    yield _batch(_NODES, len(held["uid"]), border=[True] * len(held["uid"]), **held)


def _segment_maps(number: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The run in which each prefix of a border sequence lies, under its name on this level."""
    uid, lcp, nxt = (rows.column(c).to_numpy().astype(np.int64) for c in ("uid", "lcp", "nxt"))
    seg = Segment(uid, lcp, int(nxt[-1]))
    for at, depth in _candidates(np.zeros(len(uid), np.int64), np.maximum(lcp, nxt) + 1):
        _, _, _, is_open, name = seg.runs(at, depth)
        yield _batch(_MAPS, len(at), border=np.zeros(len(at), bool), open=is_open, uid=uid[at], depth=depth, to=name)
    held = seg.borders(number)
    yield _batch(_MAPS, len(held["uid"]), border=[True] * len(held["uid"]), **held)


def _by_segment(of_one: Callable[[int, pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments come whole and one after another in a partition; one at a time is held."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for batch in batches:
            of = batch.column("segment").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
            for a, b in zip(cuts, cuts[1:]) if len(of) else ():
                if held and of[a] != number:
                    yield from of_one(number, pa.Table.from_batches(held))
                    held = []
                number = int(of[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from of_one(number, pa.Table.from_batches(held))

    return through


def _segments(rows: DataFrame, number: str, segment: int, of_one: Callable, schema: str, label: str) -> DataFrame:
    placed = rows.withColumn("segment", F.floor(F.col(number) / segment)).repartition("segment").sortWithinPartitions("segment", number)
    return scratch.save(placed.mapInArrow(_by_segment(of_one), schema), label)


def trie(seqs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each distinct prefix of sequences(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    segment: sequences that are searched by one table, at least 4.
    """
    rows = scratch.save(items(seqs), "items")
    total = F.element_at("upto", -1)
    fresh = total - F.element_at("upto", F.greatest("lcp", F.lit(0)) + 1)
    flat = rows.select("uid", "len", "lcp", "nxt", "n", "low", "ends", total.alias("total"), fresh.alias("fresh"))
    parts_of = [c.split()[0] for c in _PARTS.split(", ")]
    level = _segments(flat, "uid", segment, _segment_nodes, _NODES, "nodes")
    left = -(-rows.count() // segment)  # segments on this level
    parts, borders = level.filter("not border and open").select(parts_of), level.filter("border")
    done, trail = level.filter("not border and not open").select(parts_of), parts.select("uid", "depth", F.col("uid").alias("to"))
    joined = []
    while left > 1:
        maps = _segments(borders.select("uid", "number", "lcp", "nxt"), "number", segment, _segment_maps, _MAPS, "maps")
        left = -(-2 * left // segment)
        to = maps.filter("not border").select("uid", "depth", "to", F.col("open").alias("on"))
        added = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "worth")] + [F.min("low").alias("low"), F.max("ends").alias("ends"), F.max("parent").alias("parent"), F.lit(None).cast("long").alias("parent_low")]
        merged = parts.drop("open").join(to, ["uid", "depth"]).groupBy(F.col("to").alias("uid"), "depth", F.col("on").alias("open")).agg(*added).select(parts_of)
        merged = scratch.save(merged, "merged")
        trail = scratch.save(trail.join(to.select(F.col("uid").alias("to"), "depth", F.col("to").alias("next")), ["to", "depth"], "left").select("uid", "depth", F.coalesce("next", "to").alias("to")), "trail")
        joined.append(merged.filter("not open"))
        parts, borders = merged.filter("open"), maps.filter("border")
    for more in joined:
        done = done.union(more)
    if joined:
        # the smallest members of the nodes that reach over borders, under the names that their children know them by
        wide = joined[0]
        for more in joined[1:]:
            wide = wide.union(more)
        above = trail.join(wide.select(F.col("uid").alias("to"), "depth", "low"), ["to", "depth"]).select(F.col("uid").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("low").alias("found"))
        known = done.filter("parent is not null").join(above, ["parent", "depth"]).withColumn("parent_low", F.col("found")).select(parts_of)
        done = done.filter("parent is null").union(known)
    # bytes before the last turn count once for each member but one
    bytes_before = rows.select("uid", F.posexplode("upto").alias("k", "before")).select("uid", (F.col("k") + 1).cast("long").alias("depth"), "before")
    done = done.withColumn("many", (F.col("n") > 1) & (F.col("depth") > 1))
    paid = done.filter("many").join(bytes_before, ["uid", "depth"]).withColumn("worth", F.col("worth") - (F.col("n") - 1) * F.col("before")).drop("before")
    out = done.filter("not many").unionByName(paid)
    return out.select(F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("worth").alias("saved_tokens"), F.coalesce(F.lower(F.hex("ends")), F.lit(_NOTHING)).alias("ends_sha256"))


def nodes(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The trie of conversations as they are."""
    return trie(sequences(*turns(conversations)), segment)


def rebuilt_nodes(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The trie of conversations rebuilt by rebuilt()."""
    rows, convs = turns(conversations)
    return trie(sequences(rebuilt(rows, convs), convs), segment)
