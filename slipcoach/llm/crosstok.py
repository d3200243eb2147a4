"""Alignment of the tokens that two tokenizers give one text, by pointer jumping.

Both encode space + text: a byte-level BPE (A, a tokenizers JSON file) and a piece BPE with byte fallback (B, a sentencepiece
model). Every token points to the farthest-right token of the other side that it overlaps; doubling the successors of all tokens
at once leads each to the terminal token of its component, the one that ends where a token of the other side ends. Tokens with
one terminal are a group, and the two tokens that end there together are a link.

The links of the whole corpus are counted by id pair. Counts that are high enough for at most HEAD pairs to have them are handed
to all tasks; links of rarer pairs are joined to their counts by a shuffle. Both ways give the same.

A text of more than PIECE bytes is cut between two ASCII letters or digits with one space between them, where no token of either
side crosses; pieces go through one at a time.

Defined results: texts null, empty, or that either side does not give back byte by byte (say, with a U+2581 in them) have no
tokens, zeros and an empty hash; special tokens in a text are plain text; rows that repeat are rows each, counted each; equal
ids stay apart; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipcoach.plans import shared as scratch

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
HEAD, PIECE, PACK, HELD = 1 << 19, 1 << 20, 1 << 20, 1 << 21
# fixed values: the split of byte-level BPE into words, and the bytes that it shows as themselves
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Tokens(NamedTuple):
    """One side of a pack of pieces: ids, the bytes of each, the piece of each."""

    ids: np.ndarray
    sizes: np.ndarray
    piece: np.ndarray


class Side:
    """A tokenizer and what its ids stand for."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], entries: list[bytes]) -> None:
        self.encode, self.count = encode, len(entries)
        self.entries, self.sizes = pa.array(entries, pa.large_binary()), np.array([len(x) for x in entries], np.int64)

    def tokens(self, texts: list[str]) -> Tokens:
        ids = [np.array(x, np.int64) for x in self.encode(texts)]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        return Tokens(flat, self.sizes[flat], np.repeat(np.arange(len(ids)), [len(x) for x in ids]))

    def same(self, got: Tokens, texts: list[bytes]) -> np.ndarray:
        """Whether the tokens of each text are its bytes."""
        joined = memoryview(self.entries.take(pa.array(got.ids)).buffers()[2] or b"").cast("B")
        ends = np.cumsum(np.bincount(got.piece, got.sizes, len(texts)).astype(np.int64))
        return np.array([joined[(ends[k - 1] if k else 0) : ends[k]] == x for k, x in enumerate(texts)], bool)


def side_a(path: str) -> Side:
    """Byte-level BPE. Its entries, in the order of their ids, are the order of its merges, which is what tiktoken asks for."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {x["id"] for x in held["added_tokens"]}
    of = {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(SHOWN))}
    entries = {i: bytes(of[c] for c in w) for w, i in held["model"]["vocab"].items() if i not in special}
    coder = tiktoken.Encoding("side a", pat_str=WORDS, mergeable_ranks={w: i for i, w in entries.items()}, special_tokens={})
    return Side(lambda texts: [coder.encode_ordinary(" " + x) for x in texts], [entries.get(i, b"") for i in range(max(entries) + 1)])


def side_b(path: str) -> Side:
    """Piece BPE; it puts the space before the text itself."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)

    def entry(i: int) -> bytes:
        piece = coder.id_to_piece(i)
        if coder.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return b"" if coder.is_control(i) or coder.is_unknown(i) else piece.replace("▁", " ").encode()

    return Side(lambda texts: coder.encode(texts, num_threads=1), [entry(i) for i in range(coder.get_piece_size())])


class Pair:
    """Two sides, and every id in decimal with what may follow it in a list of groups."""

    def __init__(self, folder: str) -> None:
        self.a, self.b = side_a(f"{folder}/{A_FILE}"), side_b(f"{folder}/{B_FILE}")
        self.decimal = pa.array([f"{i}{c}" for i in range(self.a.count) for c in ",|"] + [f"{i}{c}" for i in range(self.b.count) for c in ",;"], pa.large_string())


@functools.cache
def pair(folder: str) -> Pair:
    """Read once in a worker."""
    return Pair(folder)


def terminals(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terminal of each A token, of each B token, A token that ends with each B token or -1); terminals are B tokens.

    Both sides cover the same bytes with tokens of a byte or more.
    """
    na, nb = len(size_a), len(size_b)
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    of_a = np.repeat(np.arange(nb), size_b)[end_a - 1]  # the other side's token at the last byte is the farthest that overlaps
    of_b = np.repeat(np.arange(na), size_a)[end_b - 1]
    together = end_a[of_b] == end_b
    successor = np.concatenate([na + of_a, np.where(together, na + np.arange(nb), of_b)])
    going = np.arange(na + nb)
    while len(going):
        farther = successor[successor[going]]
        moved = farther != successor[going]
        going = going[moved]
        successor[going] = farther[moved]
    return successor[:na] - na, successor[na:] - na, np.where(together, of_b, -1)


def _firsts(of: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), of[1:] != of[:-1]]))


class Aligned(NamedTuple):
    """Of each piece: tokens of both sides, groups; ends of its links and of its text in what follows."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray
    link_ends: np.ndarray
    text: memoryview
    text_ends: np.ndarray


def aligned(p: Pair, a: Tokens, b: Tokens, pieces: int) -> Aligned:
    to_a, to_b, with_b = terminals(a.sizes, b.sizes)
    ends = np.flatnonzero(with_b >= 0)  # one a group, in order
    group = np.full(len(b.ids), -1)
    group[ends] = np.arange(len(ends))
    group_a, group_b = group[to_a], group[to_b]
    n_a, n_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
    start = np.cumsum(n_a + n_b) - n_a - n_b
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    at_a, at_b = np.arange(len(a.ids)) - first_a[group_a], np.arange(len(b.ids)) - first_b[group_b]
    shown = np.empty(len(a.ids) + len(b.ids), np.int64)
    shown[start[group_a] + at_a] = 2 * a.ids + (at_a == n_a[group_a] - 1)
    shown[start[group_b] + n_a[group_b] + at_b] = 2 * (p.a.count + b.ids) + (at_b == n_b[group_b] - 1)
    texts = p.decimal.take(pa.array(shown))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(shown) + 1] if len(shown) else np.zeros(1, np.int64)
    count = lambda x: np.bincount(x, minlength=pieces)
    of_piece = b.piece[ends]
    tokens_a, tokens_b, groups = count(a.piece), count(b.piece), count(of_piece)
    links = a.ids[with_b[ends]] * p.b.count + b.ids[ends]
    return Aligned(tokens_a, tokens_b, groups, links, np.cumsum(groups), memoryview(texts.buffers()[2] or b""), offsets[np.cumsum(tokens_a + tokens_b)])


_PLACE = re.compile("(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut at spaces that both sides begin a token with, after about `size` characters each; those spaces are left out."""
    out, at = [], 0
    while len(text) - at > size and (found := _PLACE.search(text, at + size)):
        out.append(text[at : found.start()])
        at = found.end()
    return [*out, text[at:]]


def _packs(texts: list[str | None], size: int) -> Iterator[tuple[list[int], list[str]]]:
    """(row of each piece, pieces): rows of one piece come together, a row of several alone."""
    rows, held, room = [], [], PACK
    for row, text in enumerate(texts):
        if not text:
            continue
        cut = pieces(text, size)
        if held and (len(cut) > 1 or len(text) > room):
            yield rows, held
            rows, held, room = [], [], PACK
        if len(cut) > 1:
            yield [row] * len(cut), cut
        else:
            rows, held, room = [*rows, row], [*held, text], room - len(text)
    if held:
        yield rows, held


def _of_long(p: Pair, cut: list[str]) -> tuple[int, int, int, str, np.ndarray] | None:
    """One text of several pieces; its groups are hashed and its links gathered piece by piece."""
    digest, n, links = hashlib.sha256(), np.zeros(3, np.int64), []
    for k, piece in enumerate(cut):
        a, b, whole = p.a.tokens([piece]), p.b.tokens([piece]), [b" " + piece.encode()]
        if not (p.a.same(a, whole)[0] and p.b.same(b, whole)[0]):
            return None
        got = aligned(p, a, b, 1)
        digest.update(got.text[: int(got.text_ends[0]) - (k == len(cut) - 1)])
        n += (got.n_a[0], got.n_b[0], got.n_groups[0])
        links.append(got.links.astype(np.int32 if p.a.count * p.b.count < 2**31 else np.int64))
    return int(n[0]), int(n[1]), int(n[2]), digest.hexdigest(), np.concatenate(links)


def _kept(x: Tokens, good: np.ndarray) -> Tokens:
    at = good[x.piece]
    return Tokens(x.ids[at], x.sizes[at], (np.cumsum(good) - 1)[x.piece[at]])


def encoded(p: Pair, texts: list[str | None], size: int = PIECE) -> Iterator[tuple[np.ndarray, list, list, list, list[str], list[np.ndarray]]]:
    """(rows, n_a, n_b, n_groups, groups_sha256, links) of the rows that have tokens, some at a time."""
    for rows, cut in _packs(texts, size):
        if len(cut) > 1 and rows[0] == rows[-1]:
            if got := _of_long(p, cut):
                yield np.array(rows[:1]), [got[0]], [got[1]], [got[2]], [got[3]], [got[4]]
            continue
        a, b, whole = p.a.tokens(cut), p.b.tokens(cut), [b" " + x.encode() for x in cut]
        good = p.a.same(a, whole) & p.b.same(b, whole)
        if good.any():
            got = aligned(p, _kept(a, good), _kept(b, good), int(good.sum()))
            starts = [0, *got.text_ends[:-1].tolist()]
            digests = [hashlib.sha256(got.text[s : e - 1]).hexdigest() for s, e in zip(starts, got.text_ends.tolist(), strict=True)]
            yield np.array(rows)[good], got.n_a.tolist(), got.n_b.tolist(), got.n_groups.tolist(), digests, np.split(got.links, got.link_ends[:-1])


_COUNTS = "n_a long, n_b long, n_groups long, groups_sha256 string"


def _encode(folder: str, link: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, kind = pair(folder), np.dtype(np.int32 if link == "int" else np.int64)

        def batch(places: pa.Array, ids: pa.Array, n: list[list], digests: list[str], links: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in links])]).astype(np.int32)
            flat = np.concatenate(links).astype(kind) if links else np.zeros(0, kind)
            columns = [places, ids, *(pa.array(x, pa.int64()) for x in n), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            return pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

        for held in batches:
            places, ids, texts = held.column("row"), held.column("id"), held.column("text").to_pylist()
            bare = np.ones(len(texts), bool)
            for rows, n_a, n_b, n_groups, digests, links in encoded(p, texts, size):
                bare[rows] = False
                at = pa.array(rows)
                yield batch(places.take(at), ids.take(at), [n_a, n_b, n_groups], digests, links)
            at = pa.array(np.flatnonzero(bare))
            yield batch(places.take(at), ids.take(at), [[0] * len(at)] * 3, [""] * len(at), [np.zeros(0, kind)] * len(at))

    return through


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links counted by pair; handed on whenever HELD different ones are held."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for k in range(0, len(codes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(codes[k : k + (1 << 16)]), pa.array(counts[k : k + (1 << 16)])], names=["pair", "n"])

    waiting: list[np.ndarray] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate(waiting), return_counts=True)
        every, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
        return every, np.bincount(at, np.concatenate([counts, n]), len(every)).astype(np.int64)

    for batch in batches:
        waiting.append(batch.column("links").flatten().to_numpy().astype(np.int64))
        if sum(map(len, waiting)) >= HELD:
            codes, counts = merged()
            waiting.clear()
            if len(codes) >= HELD:
                yield from out()
                codes, counts = codes[:0], counts[:0]
    if waiting:
        codes, counts = merged()
    yield from out()


def _look_up(head) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over each row's links with a count in head; the other links are handed on."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = head.value
        for batch in batches:
            links = batch.column("links")
            flat, sizes = links.flatten().to_numpy(), pa.compute.list_value_length(links).to_numpy()
            at = np.minimum(np.searchsorted(codes, flat), max(0, len(codes) - 1))
            hit = codes[at] == flat if len(codes) else np.zeros(len(flat), bool)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            counted, top = (sums(np.where(hit, of[at], 0)) if len(codes) else np.zeros(len(sizes), np.int64) for of in (n, best))
            left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sums(~hit))]).astype(np.int32)), pa.array(flat[~hit]))
            kept = [batch.column(c) for c in ("row", "id", "n_a", "n_b", "n_groups", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(top.astype(np.int64)), pa.array(counted.astype(np.int64)), left], names=["row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum", "rest"])

    return through


def _head(counts: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """The pairs of the highest counts, at most `most`, and the power of two from which on a count is among them."""
    bits = {r["bits"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).agg(F.count("*").alias("pairs")).collect()}
    least, held = 63, 0
    while least > 0 and held + bits.get(least - 1, 0) <= most:
        least -= 1
        held += bits.get(least, 0)
    top = counts.filter(F.floor(F.log2("n")) >= least).toArrow().sort_by("pair")
    return (top.column("pair").to_numpy(), top.column("n").to_numpy(), top.column("best").cast(pa.int64()).to_numpy()), least


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, head: int = HEAD, size: int = PIECE) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    folder: where the two tokenizer files are, on every machine; head: the most pairs whose counts go to all tasks.
    """
    spark, p = docs.sparkSession, pair(folder)
    link = "int" if p.a.count * p.b.count < 2**31 else "long"
    kind, id_type = f"array<{link}>", docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    links = scratch.save(rows.mapInArrow(_encode(folder, link, size), f"row long, id {id_type}, {_COUNTS}, links {kind}"), "links", 200)
    counted = links.select("links").mapInArrow(_tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = scratch.save(counted, "pairs")
    of_b = F.col("pair") % p.b.count
    most = counted.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B at most
    counts = scratch.save(counted.withColumn("b", of_b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")
    known, least = _head(counts, head)
    looked = links.mapInArrow(_look_up(spark.sparkContext.broadcast(known)), f"row long, id {id_type}, {_COUNTS}, n_best long, count_sum long, rest {kind}")
    looked = scratch.save(looked, "sums")
    rest = looked.select("row", F.explode("rest").alias("pair")).join(counts.filter(F.floor(F.log2("n")) < least), "pair")
    more = rest.groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("more_best"), F.sum("n").alias("more_sum"))
    out = looked.drop("rest").join(more, "row", "left")
    added = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), added("n_best", "more_best"), added("count_sum", "more_sum"), "groups_sha256")
