"""Class-based n-gram language model (Brown et al., 1992) with classes by exchange clustering (Martin et al., 1998).

log P(text) = sum over tokens of log P(class | class before) + log P(word | class). Counts and classes of every word of
every training text are kept exactly, in a table that grows with the vocabulary.

First classes come from a fixed number of units: the most frequent words are units of their own, every other word belongs
to the unit of its last letters and length; an exchange on the driver moves one unit at a time to the class that most
raises the likelihood. Then sweeps over the whole vocabulary, as Spark jobs, move every word by itself: the classes before
and after all its occurrences are counted, and it goes to the class in which the model of the other words finds them most
likely (all words of a sweep at once, as Uszkoreit and Brants, 2008). Only words that no training text has get the class
that most training words of their last letters and length have.

Counts and classes of the frequent words go along with the tasks (a table of at most HEAD rows). What stands beside the other
words is gathered once, a row a word (such a word has at most about 1/HEAD of all tokens); in a sweep that row tells the words
beside it the class of its own. Only contexts among frequent words are counted over the texts in each sweep, and added
up by slices of the frequent words. For the scores, each occurrence of another word meets the table in a join by word, and
comes back to its document.

Probabilities are smoothed and sum to 1: an unseen word takes one place in its class, a class before another is mixed
with the classes' own shares.

Defined results: a null or empty text is one token, the end; a null id counts as the empty id when texts are dealt into
training and held out; repeated rows count and are scored each; without any training text, every count is 0 and every
word has the same small probability; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipcoach.llm import dense, tokens
from slipcoach.plans import shared as scratch

#: Most words whose counts go along with the tasks (16 bytes each), most words that are units, units of other words, classes.
HEAD, OWN_UNITS, TAIL_UNITS, CLASSES = 1 << 18, 512, 256, 48
ROUNDS, PRIOR, ADD = 6, 5.0, 0.5
#: Sweeps over all words; codes of a context: the class before, CLASSES + the class after, then the word itself.
SWEEPS = 2
SELF = 2 * CLASSES
_CONTEXT = np.dtype([("code", "u1"), ("n", "<u4")])
#: Beside a word that is not frequent: 2 * place of a frequent word + side, or the word itself; any other word. Side: 0 before, 1 after.
_NEAR, _FAR, OWN = np.dtype("<u4"), np.dtype([("word", "<u8"), ("side", "u1")]), 2**32 - 1
_STATE, _STATE_SCHEMA = ["word", "tail", "n", "class", "near", "far"], "word long, tail int, n long, class int, near binary, far binary"
#: Parts of it on their way to one another; mark: tail, n and class, in one part of each word.
_PART, _PART_SCHEMA = ["word", "contexts", "mark", "near", "far"], "word long, contexts binary, mark binary, near binary, far binary"
_MARK = np.dtype([("tail", "<i4"), ("n", "<i8"), ("class", "<i4")])
#: Contexts of frequent words, in slices of 64 words: 128 * place in the slice + code, and how often.
SLICE, _CELL, _CELLS = 64 * 128, np.dtype([("key", "<u2"), ("n", "<u4")]), "slice int, cells binary"
FOLDS, HELD_OUT = 5, 1
#: The end of a text: a token with its own unit and class.
END = tokens.word_hash("\n")
SLICES = 8
_U = np.uint64


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _tails(w: tokens.Words) -> np.ndarray:
    """The unit, among TAIL_UNITS, of each word's last two bytes and length."""
    last = w.data[w.end - 1].astype(np.int64) | 0x20
    before = w.data[np.maximum(w.end - 2, w.start)].astype(np.int64) | 0x20
    long = np.minimum((w.end - w.start) // 4, 3)
    return ((last * 31 + before) * 4 + long) * 2654435761 % (1 << 32) * TAIL_UNITS >> 32


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, tail, n): how often each word stands in what a task reads, with the end of each text."""
    parts, held, ends = [], 0, 0

    def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        return word, np.concatenate([p[1] for p in parts])[first], np.bincount(inverse, np.concatenate([p[2] for p in parts]), len(word)).astype(np.int64)

    def rows(word: np.ndarray, tail: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(n)], names=["word", "tail", "n"])

    for batch in batches:
        ends += len(batch)
        for w in tokens.words(batch.column("text")):
            if len(w.hash):
                word, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                parts.append((word, _tails(w)[first], n))
                held += len(word)
        if held > 1 << 20:
            parts = [added()]
            held = len(parts[0][0])
            if held > 1 << 19:  # a bounded share of memory: what is full goes out, the shuffle adds it up
                yield rows(*parts[0])
                parts, held = [], 0
    if parts:
        yield rows(*added())
    if ends:
        yield rows(np.array([END], _U), np.zeros(1, np.int64), np.array([ends]))


def _step(n: str = "n") -> Column:
    """Counts in steps of a sixteenth of an octave: a thousand steps at most."""
    return F.floor(F.log2(n) * 16)


def _head(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent words, at most so many, sorted by hash, with their counts; and the least step that is among them."""
    held, least = 0, 1 << 20
    for row in sorted(words.groupBy(_step().alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        if held + row["words"] > most:
            break
        held, least = held + row["words"], row["step"]
    got = words.filter(_step() >= least).select("word", "n").toArrow()
    word, n = got.column("word").to_numpy().view(_U), got.column("n").to_numpy()
    order = np.argsort(word)
    return word[order], n[order], least


def _units(w: tokens.Words, own: np.ndarray) -> np.ndarray:
    """Units of words: place in `own`, or behind it that of the tail."""
    if not len(own):
        return _tails(w)
    at = np.minimum(np.searchsorted(own, w.hash), len(own) - 1)
    return np.where(own[at] == w.hash, at, len(own) + _tails(w))


def _with_ends(w: tokens.Words, units: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, unit) of all tokens of a chunk, each row closed by its end."""
    row = np.concatenate([w.doc, np.arange(w.rows)])
    unit = np.concatenate([units, np.full(w.rows, end)])
    order = np.argsort(row, kind="stable")
    return row[order], unit[order]


def _before(row: np.ndarray, unit: np.ndarray, end: int) -> np.ndarray:
    """The unit before each token; a text begins after an end."""
    out = np.concatenate([[end], unit[:-1]])
    out[np.concatenate([[True], np.diff(row) != 0])] = end
    return out


def _bigrams(own, total: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = -(-total * total // SLICES) * SLICES
        cells = np.zeros(size, np.uint32)
        for batch in batches:
            for w in tokens.words(batch.column("text")):
                row, unit = _with_ends(w, _units(w, own.value), total - 1)
                cells += np.bincount(_before(row, unit, total - 1) * total + unit, minlength=size).astype(np.uint32)
        yield dense.parts(cells, SLICES)

    return run


def exchange(counts: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of units by their bigram counts; the last unit is the end and keeps class 0 to itself."""
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    counts = counts.astype(float)
    n = len(counts)
    order = np.argsort(-(counts.sum(0) + counts.sum(1))[: n - 1], kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(n - 1) % (classes - 1)
    one = np.zeros((n, classes))
    one[np.arange(n), of] = 1
    table = one.T @ counts @ one
    for _ in range(rounds):
        moved = 0
        for u in order:
            old, own = of[u], counts[u, u]
            right, left = counts[u] @ one, counts[:, u] @ one
            right[old] -= own
            left[old] -= own
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            row_sum, col_sum = table.sum(1), table.sum(0)
            after, before = table + right, table + left[:, None]
            gain = (f(after) - f(table)).sum(1) + (f(before) - f(table)).sum(0)
            diagonal = np.diag(table)
            both = diagonal + right + left + own
            gain += f(both) - f(diagonal + right) - f(diagonal + left) + f(diagonal)
            gain -= f(row_sum + right.sum() + own) - f(row_sum) + f(col_sum + left.sum() + own) - f(col_sum)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            table[new] += right
            table[:, new] += left
            table[new, new] += own
            if new != old:
                one[u, old], one[u, new], of[u] = 0, 1, new
                moved += 1
        if not moved:
            break
    return of


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many, but for the last one."""
    parts, held = [], 0
    for batch in batches:
        if len(batch):
            parts.append(batch)
            held += len(batch)
        if held >= rows:
            yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            parts, held = [], 0
    if held:
        yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Words of bounded runs of whole texts in order; each text ends with END, so that the one after it begins after an end."""
    parts, held = [], 0
    for batch in batches:
        for w in tokens.words(batch.column("text")):
            line = np.full(len(w.hash) + w.rows, END, _U)
            line[np.arange(len(w.hash)) + w.doc] = w.hash
            parts.append(line)
            held += len(line)
            if held > 1 << 20:
                yield np.concatenate(parts)
                parts, held = [], 0
    if held:
        yield np.concatenate(parts)


def _known(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted words, whether it is there) of each hash."""
    if not len(words):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return at, words[at] == hashes


def _pairs(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before each word of a run; and the places of both among the frequent words, or -1."""
    before = np.concatenate([[_U(END)], line[:-1]])
    ends = np.concatenate([line, [_U(END)]]).view(np.int64)
    place = pc.index_in(pa.array(ends), value_set=pa.array(words.view(np.int64))).fill_null(-1).to_numpy()
    return before, np.concatenate([place[-1:], place[:-2]]), place[:-1]


def _summed(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their n (of ones, if there is no n)."""
    if n is None:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    if not len(key):
        return key, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.diff(np.concatenate([first, [len(key)]])) if n is None else np.add.reduceat(n, first)


def _blobs(offsets: np.ndarray, entries: np.ndarray) -> pa.Array:
    """A binary column: row r has the entries offsets[r] .. offsets[r+1]-1."""
    at = (offsets * entries.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(entries.tobytes())])


def _entries(blobs: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) of a binary column of such entries."""
    _, offsets, data = blobs.buffers()
    at = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1] // kind.itemsize
    n = int(at[-1] - at[0])
    return np.repeat(np.arange(len(blobs)), np.diff(at)), np.frombuffer(data, kind, n, int(at[0]) * kind.itemsize) if n else np.zeros(0, kind)


def _contexts_of(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, n) of packed contexts."""
    row, entry = _entries(blobs, _CONTEXT)
    return row, entry["code"].astype(np.int64), entry["n"].astype(np.int64)


def _packed(key: np.ndarray, n: np.ndarray, rows: int) -> pa.Array:
    """Contexts of each row from distinct sorted keys 128 * row + code."""
    out = np.empty(len(key), _CONTEXT)
    out["code"], out["n"] = key & 127, n
    return _blobs(np.searchsorted(key >> 7, np.arange(rows + 1)), out)


def _nothing(rows: int) -> pa.Array:
    """A binary column of empty values."""
    return _blobs(np.zeros(rows + 1, np.int64), np.zeros(0, _NEAR))


def _cells() -> tuple[Callable, Callable]:
    """add(keys) for contexts of frequent words, 128 * place + code, and rest() at the end: both yield sums by slices of the words."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def together() -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def sliced(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        used, first = np.unique(key // SLICE, return_index=True)
        out = np.empty(len(key), _CELL)
        out["key"], out["n"] = key % SLICE, n
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), _blobs(np.concatenate([first, [len(key)]]), out)], names=["slice", "cells"])

    def add(key: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts.append(_summed(key.astype(np.uint32)))
        if sum(len(p[0]) for p in parts) > 1 << 21:
            parts[:] = [together()]
            if len(parts[0][0]) > 1 << 20:
                yield sliced(*parts.pop())

    def rest() -> Iterator[pa.RecordBatch]:
        if parts:
            yield sliced(*together())

    return add, rest


def _contexts(shared) -> Callable:
    """Classes before and after each frequent word, of the frequent words beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, *_, of = shared.value
        add, rest = _cells()
        for line in _in_turn(batches):
            _, before, at = _pairs(words, line)
            both = (before >= 0) & (at >= 0)
            before, at = before[both], at[both]
            other = before != at
            own, before, at = at[~other], before[other], at[other]
            yield from add(np.concatenate([at * 128 + of[before], before * 128 + CLASSES + of[at], own * 128 + SELF]))
        yield from rest()

    return run


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the other words are to the frequent words beside them."""
    add, rest = _cells()
    for batch in _larger(batches, 1 << 16):
        row, near = _entries(batch.column("near"), _NEAR)
        row, near = row[near != OWN], near[near != OWN].astype(np.int64)
        yield from add((near >> 1) * 128 + (1 - (near & 1)) * CLASSES + batch.column("class").to_numpy()[row])
    yield from rest()


def _frequent_words(shared) -> Callable:
    """Frequent words with their contexts, from rows sorted by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail, counts, of = shared.value

        def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            used, at = np.unique(key >> 7, return_inverse=True)
            cols = [pa.array(x) for x in (words[used].view(np.int64), tail[used], counts[used], of[used].astype(np.int32))]
            return pa.RecordBatch.from_arrays([*cols, _nothing(len(used)), _nothing(len(used)), _packed(at * 128 + (key & 127), n, len(used))], names=[*_STATE, "contexts"])

        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if len(batch):
                at = batch.column("slice").to_numpy().astype(np.int64) * SLICE
                row, cell = _entries(batch.column("cells"), _CELL)
                key, n = _summed(np.concatenate([key, at[row] + cell["key"]]), np.concatenate([n, cell["n"].astype(np.int64)]))
                over = int(np.searchsorted(key, at[-1]))
                yield rows(key[:over], n[:over])
                key, n = key[over:], n[over:]
        if len(key):
            yield rows(key, n)

    return run


def _beside(shared) -> Callable:
    """What stands beside each occurrence of a word that is not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in _in_turn(batches):
            before, before_at, at = _pairs(shared.value, line)
            left, right = np.flatnonzero(at < 0), np.flatnonzero((before_at < 0) & (before != line))
            word = np.concatenate([line[left], before[right]])
            order = np.argsort(word)
            word = word[order]
            other, place = np.concatenate([before[left], line[right]])[order], np.concatenate([before_at[left], at[right]])[order]
            side = np.repeat([0, 1], [len(left), len(right)])[order]
            own = word == other
            is_far = (place < 0) & ~own
            far = np.empty(int(is_far.sum()), _FAR)
            far["word"], far["side"] = other[is_far], side[is_far]
            near = np.where(own, OWN, place.astype(np.int64) * 2 + side)[~is_far].astype(_NEAR)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            edges = np.concatenate([first, [len(word)]])
            n_far = np.concatenate([[0], np.cumsum(is_far)])[edges]
            nothing = _nothing(len(first))
            yield pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), nothing, nothing, _blobs(edges - n_far, near), _blobs(n_far, far)], names=_PART)

    return run


def _marks(batch: pa.RecordBatch, kind: np.ndarray) -> pa.Array:
    out = np.empty(len(batch), _MARK)
    out["tail"], out["n"], out["class"] = batch.column("tail").to_numpy(), batch.column("n").to_numpy(), kind
    return _blobs(np.arange(len(batch) + 1), out)


def _whole_words(rows: Callable) -> Callable:
    """rows(batch, first) for batches of rows sorted by word, each with all rows of its words; first: where each word begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _larger(batches):
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            word = batch.column("word").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            if len(first) > 1:
                yield rows(batch.slice(0, int(first[-1])), first[:-1])
            rest = batch.slice(int(first[-1]))
        if rest is not None:
            yield rows(rest, np.zeros(1, np.int64))

    return run


def _spread(shared, more: bool) -> Callable:
    """Each word that is not frequent with its contexts by frequent words, and what it is itself to the others beside it.

    more: whether another sweep needs what stands beside the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *_, of = shared.value
        for batch in _larger(batches):
            kind = batch.column("class").to_numpy().astype(np.int64)
            row, near = _entries(batch.column("near"), _NEAR)
            own = near == OWN
            code = np.where(own, SELF, (near & 1) * CLASSES + of[np.where(own, 0, near >> 1)]) if len(of) else np.full(len(near), SELF)
            beside = [batch.column("near"), batch.column("far")] if more else [_nothing(len(batch))] * 2
            yield pa.RecordBatch.from_arrays([batch.column("word"), _packed(*_summed(row * 128 + code), len(batch)), _marks(batch, kind), *beside], names=_PART)
            row, far = _entries(batch.column("far"), _FAR)
            other, at = np.unique(far["word"], return_inverse=True)
            contexts = _packed(*_summed(at * 128 + (1 - far["side"].astype(np.int64)) * CLASSES + kind[row]), len(other))
            yield pa.RecordBatch.from_arrays([pa.array(other.view(np.int64)), contexts, *[_nothing(len(other))] * 3], names=_PART)

    return run


def _merged(batch: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
    """State and contexts of each word, of which one row has the mark."""
    edges = np.concatenate([first, [len(batch)]])
    _, mark = _entries(batch.column("mark"), _MARK)
    beside = []
    for name, kind in (("near", _NEAR), ("far", _FAR)):
        row, entry = _entries(batch.column(name), kind)
        beside.append(_blobs(np.searchsorted(row, edges), entry))
    row, code, n = _contexts_of(batch.column("contexts"))
    contexts = _packed(*_summed(np.repeat(np.arange(len(first)), np.diff(edges))[row] * 128 + code, n), len(first))
    known = [pa.array(np.ascontiguousarray(mark[c])) for c in ("tail", "n", "class")]
    return pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(first)), *known, *beside, contexts], names=[*_STATE, "contexts"])


def _class_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in _larger(batches):
        of = batch.column("class").to_numpy()
        row, code, n = _contexts_of(batch.column("contexts"))
        before = np.where(code == SELF, of[row], code)
        use = (code < CLASSES) | (code == SELF)
        cells += np.bincount((before * CLASSES + of[row])[use], n[use], len(cells)).astype(np.int64)
    yield dense.parts(cells, SLICES)


def moves(table: np.ndarray, of: np.ndarray, row: np.ndarray, code: np.ndarray, n: np.ndarray, home: np.ndarray | None = None) -> np.ndarray:
    """The class in which the smoothed model without the word finds its occurrences most likely; table: class bigrams, with the word in it.

    home: the class that each word's tail tells; any other has to be named, which costs log(classes) as in a description
    length, so that a word that occurs once does not go wherever its two neighbours fit a little better.
    The parameters stay as they are during a sweep: a class with few words draws nobody, whereas the gain of an exchange
    (a word for itself in an empty class) would draw all words of a sweep at once.
    """
    size, every = len(table), np.arange(len(of))
    share = PRIOR * (table.sum(0) + ADD) / (table.sum() + ADD * size)
    left, right, own = np.zeros((len(of), size)), np.zeros((len(of), size)), np.zeros((len(of), 1))
    for side, use in ((left, code < size), (right, (code >= size) & (code < 2 * size)), (own, code == 2 * size)):
        side[row[use], code[use] % size] = n[use]
    gain = np.zeros((len(of), size))
    for side, other, cells in ((right, left, table.T), (left, right, table)):
        at, c = np.nonzero(side)
        if not len(at):
            continue
        x, old, entry = side[at, c], of[at], np.arange(len(at))
        hit = c == old
        base = cells[c]
        base[hit] -= other[at[hit]]
        base[entry, old] = cells[c, old] - x - np.where(hit, other[at, old] + own[at, 0], 0)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        base += share[c][:, None] if side is right else share
        gain[at[first]] += np.add.reduceat(x[:, None] * np.log(base), first, axis=0)
    diagonal = np.repeat(np.diag(table)[None, :], len(of), 0)
    diagonal[every, of] -= right[every, of] + left[every, of] + own[:, 0]
    gain += own * np.log(diagonal + share)
    for side, sums, more in ((right, table.sum(1), PRIOR), (left, table.sum(0), ADD)):
        mine = side.sum(1, keepdims=True) + own
        without = np.repeat(sums[None, :], len(of), 0)
        without[every, of] -= mine[:, 0]
        gain -= mine * np.log(without + more)
    if home is not None:
        gain[every, home] += np.log(size - 1)
    gain[:, 0] = -np.inf
    best = np.argmax(gain, 1)
    return np.where((of > 0) & (gain[every, best] > gain[every, of] + 1e-9), best, of)


def _moved(table: np.ndarray, tails: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _larger(batches, 2000):
            of = moves(table, batch.column("class").to_numpy().astype(np.int64), *_contexts_of(batch.column("contexts")), tails[batch.column("tail").to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)) if c == "class" else batch.column(c) for c in _STATE], names=_STATE)

    return run


def _first_classes(own: np.ndarray, of: np.ndarray, marked: bool) -> Callable:
    """States of words, or marks, without what stands beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column("word").to_numpy().view(_U)
            at, known = _known(own, word)
            unit = np.where(known, at, len(own) + batch.column("tail").to_numpy())
            kind = np.where(word == _U(END), 0, of[unit]).astype(np.int32)
            nothing = _nothing(len(batch))
            if marked:
                yield pa.RecordBatch.from_arrays([batch.column("word"), nothing, _marks(batch, kind), nothing, nothing], names=_PART)
            else:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "tail", "n")), pa.array(kind), nothing, nothing], names=_STATE)

    return run


def _frequent(classed: DataFrame, least: int, names: tuple[str, ...] = ("word", "n", "class")) -> tuple[np.ndarray, ...]:
    """Words of the steps from least, sorted by hash, with their counts and classes, or other columns."""
    got = classed.filter(_step() >= least).select(*names).toArrow()
    order = np.argsort(got.column("word").to_numpy().view(_U))
    return tuple(got.column(c).to_numpy().astype({"word": _U, "tail": np.int32}.get(c, np.int64))[order] for c in names)


def _together(parts: DataFrame) -> DataFrame:
    """One row per word: state and contexts."""
    return parts.repartition("word").sortWithinPartitions("word").mapInArrow(_whole_words(_merged), f"{_STATE_SCHEMA}, contexts binary")


def classes(words: DataFrame, texts: DataFrame, least: int, sweeps: int = SWEEPS) -> DataFrame:
    """(word, tail, n, class) of all words (word, tail, n) of the texts; those of the steps from least go along with the tasks."""
    context = words.sparkSession.sparkContext
    own, _, _ = _head(words.filter(F.col("word") != _signed(END)), OWN_UNITS)
    units = len(own) + TAIL_UNITS + 1
    size = -(-units * units // SLICES) * SLICES
    bigrams = dense.total(scratch.save(texts.mapInArrow(_bigrams(context.broadcast(own), units), dense.SCHEMA), "bigrams"), size, SLICES)
    of = exchange(bigrams[: units * units].reshape(units, units), CLASSES)
    state = words.mapInArrow(_first_classes(own, of, False), _STATE_SCHEMA)
    if sweeps:
        (frequent,) = _frequent(words, least, ("word",))
        beside = texts.mapInArrow(_beside(context.broadcast(frequent)), _PART_SCHEMA)
        rare = words.filter(_step() < least).mapInArrow(_first_classes(own, of, True), _PART_SCHEMA).union(beside)
        state = state.filter(_step() >= least).union(_together(rare).drop("contexts"))
    state = scratch.save(state, "classes")
    for sweep in range(sweeps):
        shared = context.broadcast(_frequent(state, least, ("word", "tail", "n", "class")))
        rare = state.filter(_step() < least)
        cells = texts.mapInArrow(_contexts(shared), _CELLS).union(rare.select("class", "near").mapInArrow(_given, _CELLS))
        frequent = cells.repartition("slice").sortWithinPartitions("slice").mapInArrow(_frequent_words(shared), f"{_STATE_SCHEMA}, contexts binary")
        merged = scratch.save(frequent.union(_together(rare.mapInArrow(_spread(shared, sweep < sweeps - 1), _PART_SCHEMA))), "contexts")
        table = dense.total(merged.mapInArrow(_class_bigrams, dense.SCHEMA), CLASSES * CLASSES, SLICES).reshape(CLASSES, CLASSES).astype(float)
        new = scratch.save(merged.mapInArrow(_moved(table, of[len(own) : -1]), _STATE_SCHEMA), "classes")
        scratch.drop(merged, state)
        state = new
    return state.select("word", "tail", "n", "class")


class Model:
    """What a task needs to tell classes: the frequent words with counts and classes, and the class of unseen words by tail; of fixed size."""

    def __init__(self, words: DataFrame, texts: DataFrame) -> None:
        """words: (word, tail, n) of the training texts."""
        self.tokens, self.types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        _, _, self.least = _head(words, HEAD)
        self.classed = classes(words, texts, self.least)
        self.frequent = _frequent(self.classed, self.least)
        self.seen, types = np.zeros(CLASSES), np.zeros((TAIL_UNITS, CLASSES))
        ends = self.classed.filter(F.col("word") == _signed(END)).select("n").first()
        self.ends = ends["n"] if ends else 0
        for r in self.classed.filter(F.col("word") != _signed(END)).groupBy("tail", "class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
            self.seen[r["class"]] += r["n"]
            types[r["tail"], r["class"]] += r["types"]
        self.seen[0] = self.ends
        every = types.sum(0)
        # a tail that no training word has: the class of most words
        self.unseen = np.where(types.sum(1) > 0, types[:, 1:].argmax(1), every[1:].argmax()) + 1
        every[0] = self.ends > 0
        self.room = np.log10(self.seen + ADD * (every + 1))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _classed(shared) -> Callable:
    """(row, id, held_out, learnt, n_tokens, seen: logs of counts of frequent words, known, kinds: a class a token, rest: the other words)

    The byte of one of the rest is 128 and the class that it has if no training text has the word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, counts, of), unseen, ends = shared.value
        counted = np.log10(counts + ADD)
        for batch in batches:
            for w in tokens.words(batch.column("text")):
                at, known = _known(words, w.hash)
                seen = np.bincount(w.doc[known], counted[at[known]], w.rows) + np.log10(ends + ADD)
                n_known = np.bincount(w.doc[known], minlength=w.rows) + int(ends > 0)
                kind = 128 + unseen[_tails(w)]
                kind[known] = of[at[known]]
                row, kind = _with_ends(w, kind, 0)
                others, whose = w.hash[~known], w.doc[~known]
                cut = np.searchsorted(whose, np.arange(w.rows + 1)).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(cut), pa.array(others.view(np.int64)))
                ends_at = np.searchsorted(row, np.arange(w.rows + 1)).astype(np.int32)
                kinds = pa.BinaryArray.from_buffers(pa.binary(), w.rows, [None, pa.py_buffer(ends_at), pa.py_buffer(kind.astype(np.uint8).tobytes())])
                part = batch.slice(w.first, w.rows)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("row", "id", "held_out", "learnt")), pa.array(np.diff(ends_at).astype(np.int64)), pa.array(seen), pa.array(n_known), kinds, rest],
                    names=["row", "id", "held_out", "learnt", "n_tokens", "seen", "known", "kinds", "rest"],
                )

    return run


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the classes found, 256 * place among the rest + class, into kinds; what is not found is unseen."""
    for batch in batches:
        out = []
        for kinds, found in zip(batch.column("kinds"), batch.column("found"), strict=True):
            kind = np.frombuffer(kinds.as_buffer(), np.uint8)
            gaps = np.flatnonzero(kind >= 128)
            kind = kind & 127
            if found.is_valid and len(found.values):
                found = found.values.to_numpy()
                kind[gaps[found >> 8]] = found & 255
            out.append(kind.tobytes())
        cols = [c for c in batch.schema.names if c not in ("kinds", "found")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(out, pa.binary())], names=[*cols, "kinds"])


def _kinds(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(class before, class) of all tokens of whole texts; class 0 is the end."""
    kind = np.frombuffer(b"".join(batch.column("kinds").to_pylist()), np.uint8).astype(np.int64)
    return np.concatenate([[0], kind[:-1]]), kind


def _learnt_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in batches:
        if len(batch):
            before, kind = _kinds(batch)
            cells += np.bincount(before * CLASSES + kind, minlength=len(cells))
    yield dense.parts(cells, SLICES)


def _paths(transitions: np.ndarray, room: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                before, kind = _kinds(batch)
                first = np.concatenate([[0], np.cumsum(batch.column("n_tokens").to_numpy())[:-1]])
                path = np.add.reduceat(transitions[before, kind] - room[kind], first)
                cols = [c for c in batch.schema.names if c != "kinds"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(path)], names=[*cols, "path"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams), score (the class model).

    train: which documents to learn from; by default those of the other folds.
    """
    spark = docs.sparkSession
    choice = ~held_out(id_col) if train is None else train
    learnt = docs.filter(choice)
    counted = _texts(learnt, text_col).mapInArrow(_counted, "word long, tail int, n long")
    words = scratch.save(counted.groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n")), "words")
    model = Model(words, _texts(learnt, text_col))
    rare = model.classed.filter((_step() < model.least) & (F.col("word") != _signed(END))).select("word", "n", "class")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), held_out(id_col).alias("held_out"), F.coalesce(choice, F.lit(False)).alias("learnt"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    shared = spark.sparkContext.broadcast((model.frequent, model.unseen, model.ends))
    fixed = f"row long, id {docs.select(f"`{id_col}`").dtypes[0][1]}, held_out boolean, learnt boolean, n_tokens long, seen double, known long"
    local = scratch.save(rows.mapInArrow(_classed(shared), f"{fixed}, kinds binary, rest array<long>"), "scored")
    met = local.select("row", F.posexplode("rest").alias("at", "word")).join(rare, "word", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + ADD)
    sums = met.groupBy(F.col("row").alias("of")).agg(F.sum(log).alias("more"), F.count("n").alias("more_known"), F.collect_list(F.col("at").cast("long") * 256 + F.col("class")).alias("found"))
    found = local.drop("rest").join(sums, F.col("row") == F.col("of"), "left").drop("of")
    fixed += ", more double, more_known long"
    found = scratch.save(found.select("row", "id", "held_out", "learnt", "n_tokens", "seen", "known", "more", "more_known", "kinds", "found").mapInArrow(_filled, f"{fixed}, kinds binary"), "filled")
    scratch.drop(local)
    table = dense.total(found.filter("learnt").select("kinds").mapInArrow(_learnt_bigrams, dense.SCHEMA), CLASSES * CLASSES, SLICES).reshape(CLASSES, CLASSES).astype(float)
    share = (table.sum(0) + ADD) / (table.sum() + ADD * CLASSES)
    transitions = np.log10((table + PRIOR * share) / (table.sum(1, keepdims=True) + PRIOR))
    out = found.mapInArrow(_paths(transitions, model.room), f"{fixed}, path double")
    logs = F.col("seen") + F.coalesce("more", F.lit(0.0))
    room = float(np.log10(model.tokens + ADD * (model.types + 1)))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(room)).alias("base_score"), (F.col("path") + logs).alias("score"),
    )
