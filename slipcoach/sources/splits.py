"""Records that contain their own separator, read from one file by many tasks.

Spark splits a file at a separator; a line break in quotes or a brace in a string is one too. Whether a split begins inside a
record depends on all that stands before it. So each split is summed up first: the state in which it ends if it begins outside
of quotes, and if it begins inside, and by how much it changes the depth. These sums, one small row a split, are put one after
the other on the driver; then each task cuts its split into records, and what lies across borders is joined by file and place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Grammar(NamedTuple):
    """sep: where files are split; step(piece, inside quotes) gives the state after the piece and its separator, and the change of depth.

    A record is complete after a piece that ends outside of quotes at the depth `rest`. plain: pieces that change nothing.
    bulk: what step gives for each of many pieces from one side, without Python by the piece.
    """

    sep: str
    rest: int
    step: Callable[[str, bool], tuple[bool, int]]
    plain: Callable[[pa.Array], np.ndarray]
    bulk: Callable[[pa.Array, bool], tuple[np.ndarray, np.ndarray]] | None = None


def csv_step(line: str, inside: bool) -> tuple[bool, int]:
    """Quotes count at the begin of a cell only; a quote that no comma follows makes the rest of the cell plain."""
    at, end = 0, len(line)
    while at < end or inside:
        if not inside and line[at] == '"':
            inside, at = True, at + 1
        if inside:
            close = line.find('"', at)
            while close >= 0 and line[close + 1 : close + 2] == '"':
                close = line.find('"', close + 2)
            if close < 0:
                return True, 0
            inside, at = False, close + 1
        comma = line.find(",", at)
        if comma < 0:
            return False, 0
        at = comma + 1
    return False, 0


_STRING, _REST = re.compile(r'"(?:[^"\\]|\\.)*"', re.S), re.compile(r'(?:[^"\\]|\\.)*"', re.S)


def json_step(piece: str, inside: bool) -> tuple[bool, int]:
    """A piece of JSON that a closing brace ends."""
    at = 0
    if inside:
        ended = _REST.match(piece)
        if not ended:
            return True, 0
        at = ended.end()
    outside = _STRING.sub("", piece[at:])
    opened = outside.find('"')
    return (True, outside.count("{", 0, opened)) if opened >= 0 else (False, outside.count("{") - 1)


def json_bulk(pieces: pa.Array, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """json_step of each piece; from inside of quotes a quote before the piece opens the string that it stands in."""
    outside = pc.replace_substring_regex(pc.binary_join_element_wise('"', pieces, "") if inside else pieces, r'(?s)"(?:[^"\\]|\\.)*"', "")
    ends = pc.match_substring(outside, '"').to_numpy(zero_copy_only=False)
    if ends.any():
        outside = pc.replace_substring_regex(outside, '(?s)".*', "")
    return ends, pc.count_substring(outside, "{").to_numpy(zero_copy_only=False).astype(np.int64) - ~ends


def _walk(g: Grammar, pieces: pa.Array, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """The state after each piece, and by how much the depth has changed until then, from the state before the first."""
    steps: dict[bool, tuple[np.ndarray, np.ndarray]] = {}
    before, change, at = np.empty(len(pieces) + 1, bool), np.zeros(len(pieces), np.int64), 0
    while at < len(before):
        if inside not in steps:
            steps[inside] = g.bulk(pieces, inside)
        ends, own = steps[inside]
        turn = at + int(np.argmax(ends[at:] != inside)) if (ends[at:] != inside).any() else len(pieces)  # after which the other side goes on
        before[at : turn + 1], change[at : turn + 1] = inside, own[at : turn + 1]
        inside, at = not inside, turn + 1
    return before[1:], np.cumsum(change)


CSV = Grammar("\n", 0, csv_step, lambda values: ~pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
JSON = Grammar("}", 1, json_step, lambda values: np.zeros(len(values), bool), json_bulk)

_PLACE = ("file", "start")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array, bool]]:
    """((file, start), pieces, whether the split is a whole file) of consecutive pieces of one split."""
    for batch in batches:
        file, start = (batch.column(c).to_numpy() for c in _PLACE)
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1), len(file)]
        for a, b in zip(cuts, cuts[1:]) if len(file) else ():
            yield (int(file[a]), int(start[a])), batch.column("value").slice(a, b - a), batch.column("alone")[int(a)].as_py()


def _summed(g: Grammar) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for place, values, _ in _runs(batches):
            state = sums.setdefault(place, [[False, 0], [True, 0]])
            if g.bulk:
                for s in state:
                    after, depth = _walk(g, values, s[0])
                    s[0], s[1] = bool(after[-1]), s[1] + int(depth[-1])
                continue
            for k in np.flatnonzero(~g.plain(values)):
                piece = values[int(k)].as_py()
                for s in state:
                    s[0], change = g.step(piece, s[0])
                    s[1] += change
        rows = [(*place, *out, *inner) for place, (out, inner) in sums.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "out_inside", "out_depth", "in_inside", "in_depth"])

    return through


WHOLE, HEAD, MIDDLE, TAIL = range(4)


class _Split:
    """The records of one split, whose pieces come in order, some at a time."""

    def __init__(self, g: Grammar, place: tuple[int, int], inside: bool, depth: int, last: bool) -> None:
        self.g, self.place, self.inside, self.depth, self.last = g, place, inside, depth, last
        self.cut = place[1] > 0 and (inside or depth != g.rest)  # the first piece goes on with a record of an earlier split
        self.held: list[str] = []
        self.fresh = place[1] == 0  # the next record that begins is the file's first

    def _done(self, values: pa.Array) -> np.ndarray:
        """After which pieces a record is complete."""
        if self.g.bulk:
            inside, change = _walk(self.g, values, self.inside)
            depth = self.depth + change
            self.inside, self.depth = bool(inside[-1]), int(depth[-1])
            return ~inside & (depth == self.g.rest)
        done = np.full(len(values), not self.inside and self.depth == self.g.rest)
        for k in np.flatnonzero(~self.g.plain(values)):
            self.inside, change = self.g.step(values[int(k)].as_py(), self.inside)
            self.depth += change
            done[k:] = not self.inside and self.depth == self.g.rest
        return done

    def take(self, values: pa.Array) -> Iterator[tuple[int, bool, pa.Array | list[str]]]:
        """(kind, first, records): pieces that are a record each stay as they are."""
        done = self._done(values)
        alone = 0 if self.held or self.cut or self.fresh else int(np.argmin(done)) if not done.all() else len(done)
        if alone:
            yield WHOLE, False, values.slice(0, alone)
        texts, begin = values.slice(alone).to_pylist(), 0
        for end in np.flatnonzero(done[alone:]):
            text = self.g.sep.join([*self.held, *texts[begin : end + 1]])
            self.held, begin = [], int(end) + 1
            yield (HEAD if self.cut else WHOLE), self.fresh, [text]
            self.fresh = self.fresh and self.cut
            self.cut = False
        self.held += texts[begin:]

    def rest(self) -> Iterator[tuple[int, bool, list[str]]]:
        """What the split's last pieces begin; at the file's end nothing follows, and it is all there is of its record."""
        if self.held:
            yield (MIDDLE if self.cut else WHOLE if self.last else TAIL), self.fresh, [self.g.sep.join(self.held)]


def _cut(g: Grammar, states, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records that lie in one split, or what lies across borders."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = states.value, None

        def rows(place: tuple[int, int], found: list[tuple[int, bool, pa.Array | list[str]]]) -> Iterator[pa.RecordBatch]:
            found = [x for x in found if (x[0] == WHOLE) == whole]
            if found:
                each = lambda k, kind: pa.array(np.repeat([x[k] for x in found], [len(x[2]) for x in found]), kind)
                texts = pa.concat_arrays([pa.array(x[2], pa.string()).cast(pa.string()) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array([place[0]] * len(texts), pa.int64()), pa.array([place[1]] * len(texts), pa.int64()), each(0, pa.int32()), each(1, pa.bool_()), texts], names=["file", "start", "kind", "first", "record"])

        for place, values, alone in _runs(batches):
            if split is None or split.place != place:
                if split is not None:
                    yield from rows(split.place, list(split.rest()))
                if not alone and place not in known:
                    raise ValueError("the file is split in another way than when it was summed up; read it again")
                split = _Split(g, place, *((False, 0, True) if alone else known[place]))
            yield from rows(place, list(split.take(values)))
        if split is not None:
            yield from rows(split.place, list(split.rest()))

    return through


def _states(sums: list, rest: int) -> dict[tuple[int, int], tuple[bool, int, bool]]:
    """The state at the begin of each split, from the sums of those before it in its file, and whether it is the file's last."""
    out, file, inside, depth = {}, None, False, 0
    rows = sorted(sums, key=lambda r: (r["file"], r["start"]))
    for r, after in zip(rows, [*rows, None][1:], strict=True):
        if r["file"] != file:
            file, inside, depth = r["file"], False, 0
        out[r["file"], r["start"]] = (inside, depth, after is None or after["file"] != file)
        depth += r["in_depth"] if inside else r["out_depth"]
        inside = r["in_inside"] if inside else r["out_inside"]
    return out


def records(spark: SparkSession, path: str, g: Grammar) -> DataFrame:
    """(record, first): the records of the file, or of the files in the folder; first tells the first one of a file.

    A file of several splits is read three times: summed up, cut into records that lie in one split, and for what lies across.
    Every such split gives one row to the driver. A file that is one split needs the cut only; nothing stands before it.
    """
    pieces = spark.read.option("lineSep", g.sep).option("recursiveFileLookup", True).text(path)
    start, alone = F.col("_metadata.file_block_start"), (F.col("_metadata.file_block_start") == 0) & (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size"))
    pieces = pieces.select(F.xxhash64("_metadata.file_path").alias("file"), start.alias("start"), alone.alias("alone"), "value")
    sums = pieces.filter("not alone").mapInArrow(_summed(g), "file long, start long, out_inside boolean, out_depth long, in_inside boolean, in_depth long").collect()
    states = spark.sparkContext.broadcast(_states(sums, g.rest))
    cut = lambda rows, whole: rows.mapInArrow(_cut(g, states, whole), "file long, start long, kind int, first boolean, record string")
    whole = cut(pieces, True).select("record", "first")
    if not sums:
        return whole
    # two fragments a split at most; a tail begins a record, and what follows up to the next tail belongs to it
    order = Window.partitionBy("file").orderBy("start", "kind")
    parts = cut(pieces.filter("not alone"), False).withColumn("of", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    each = parts.groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"), F.max("first").alias("first"))
    return whole.union(each.select(F.array_join("parts.record", g.sep).alias("record"), "first"))
