"""Block names, the prefix trie and the alignment of tokens against brute force; odd rows."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from slipcoach.llm import blocknames, crosstok, oracles, prefixtrie

SF = "/root/testdata/sf0.001"
CLASHES = ("row", "id", "n", "name", "part", "at", "text", "pos", "conv", "print", "bytes", "seq", "pair", "links", "level", "first")


# ---- exact duplicates


def classes_by_hand(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = Counter()
    for bare, members in groups.items():
        keep = rows[min(members)[3]][0]
        for at, m in enumerate(sorted(members)):
            out[(rows[m[3]][0], keep, len(members), at == 0, hashlib.sha256(bare.encode()).hexdigest())] += 1
    return out


def classed(df, **more):
    return Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in blocknames.classes(df, **more).collect())


@pytest.mark.parametrize("size", [1024, 3])
def test_block_names(spark, size, monkeypatch):
    monkeypatch.setattr(blocknames, "HOT", 4)
    monkeypatch.setattr(blocknames, "PARTS", 3)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \né") for _ in range(rng.randrange(14))) for _ in range(150)] + [None, "", " \t\r\n\x0b\x0c", "ab" * 3000, "ab " * 3000, "ab" * 3000 + "c", " ", "x\x00y", "xy"]
    rows = [(rng.choice([None, 3, 8, *range(100, 900)]), t) for t in texts] + [(5, "same"), (5, "same"), (None, "same"), (2, " same ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert classed(docs, size=size) == classes_by_hand(rows)


def test_block_names_of_all_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert classed(docs, size=64) == classes_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_rows_that_stay_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab  "), (3, "c"), (3, "c"), (None, None)], "`doc.id` long, text string").withColumns({c: F.lit(f"own {c}") for c in CLASHES if c != "text"})
    got = blocknames.keep(docs, "doc.id")
    assert got.columns == docs.columns and Counter((r[0], r.text) for r in got.collect()) == Counter([(2, "ab  "), (3, "c"), (None, None)])
    assert all(r["name"] == "own name" for r in got.collect())
    assert blocknames.keep(docs.limit(0), "doc.id").count() == 0 and blocknames.classes(docs.limit(0), "doc.id").count() == 0


def test_naming_needs_no_python_and_one_exchange(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = blocknames.classes(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- the prefix trie

TRIE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def tries(rows):
    """The nodes by a dictionary of prefixes."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    import zlib

    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 * (1 if c >= 0 else -1))
        built[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    out = Counter()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out[(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("segment", [512, 4, 7])
def test_prefix_trie(spark, segment, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 3)
    monkeypatch.setattr(prefixtrie, "AT_ONCE", 11)
    rng = random.Random(segment)
    rows = []
    for c in range(-7, 80):
        for t in range(rng.randrange(0, 14)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["u", "a", None]), rng.choice(["x", "", "yy", None, "zzz é"]) if t > 1 else "same"))
    rows += [(c, t, "u", "hot") for c in range(100, 140) for t in range(3)] + [(None, 0, "u", "lost")] + [(200, t, "u", "long") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in CLASHES if c != "text"}).repartition(4)
    got = Counter(tuple(r[c] for c in TRIE) for r in prefixtrie.rebuilt_nodes(df, segment).collect())
    assert got == tries(rows)
    if segment == 4:
        assert prefixtrie.rebuilt_nodes(df.limit(0), segment).count() == 0


def test_conversations_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "a", "b"), (2, 0, "u", "a"), (2, 1, "a", "c"), (3, 0, "u", "a")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.depth): (r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in prefixtrie.nodes(df).collect()}
    assert got == {(1, 0): (3, 1, 2, 2), (1, 1): (3, 2, 2, 2), (1, 2): (1, 0, 1, 0), (2, 2): (1, 0, 1, 0)}


def test_trie_by_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = Counter(con.execute(f"SELECT {', '.join(TRIE)} FROM ({oracles.PREFIX_TRIE})").fetchall())
    got = prefixtrie.rebuilt_nodes(spark.read.parquet(f"{SF}/conversations.parquet"), 5).collect()
    assert Counter(tuple(r[c] for c in TRIE) for r in got) == want


def test_runs_around_a_place():
    rng = np.random.default_rng(3)
    for m in (1, 2, 3, 8, 13, 64):
        lcp = rng.integers(0, 4, m)
        seg = prefixtrie.Segment(np.arange(m), lcp, -1)
        for at in range(m):
            for depth in range(5):
                left = right = at
                while left > 0 and lcp[left] >= depth:
                    left -= 1
                while right + 1 < m and lcp[right + 1] >= depth:
                    right += 1
                got = seg.gaps.ends(np.array([at]), np.array([depth]), m)
                assert (got[0][0], got[1][0]) == (left, right)


# ---- tokens of two tokenizers


def aligned_by_hand(texts):
    """Ends of tokens by sets; the byte-level side by the library that the file is made for."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(f"{crosstok.FOLDER}/{crosstok.A_FILE}"), sentencepiece.SentencePieceProcessor(model_file=f"{crosstok.FOLDER}/{crosstok.B_FILE}")
    one.encode_special_tokens = True
    with open(f"{crosstok.FOLDER}/{crosstok.A_FILE}", encoding="utf-8") as f:
        shown = {i: w for w, i in json.load(f)["model"]["vocab"].items()}
    byte = {chr(b): b for b in crosstok.SHOWN} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(crosstok.SHOWN)))}
    bytes_a = lambda i: bytes(byte[c] for c in shown[i])
    bytes_b = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
    rows, counts = [], Counter()
    for t in texts:
        a, b = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if not t or b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
            rows.append(None)
            continue
        ends = [], []
        for side, ids, of in ((0, a, bytes_a), (1, b, bytes_b)):
            for i in ids:
                ends[side].append((ends[side][-1] if ends[side] else 0) + len(of(i)))
        groups, links, p, q = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            r, s = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, a[p:r])) + "|" + ",".join(map(str, b[q:s])))
            links.append((a[r - 1], b[s - 1]))
            p, q = r, s
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(r[0], r[1], r[2], r[2], sum(counts[x] == most[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) if r else (0, 0, 0, 0, 0, 0, "") for r in rows]


ODD = [None, "", " ", "<s></s><|endoftext|> a ▁ b", "<s></s><|endoftext|> x", "​日本語 テキスト \U0001f389\U0001f389  \n\n\t x\x00y", "▁", "a" * 900, " " * 900, "it's I'LL don't " * 50, "it's I'LL don't " * 50, "é́ x1 2y " * 40]


@pytest.mark.parametrize("more", [{}, {"head": 60, "size": 64}, {"head": 0, "size": 7}])
def test_token_alignment(spark, more):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = [(None if k == 5 else k // 2, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHES if c != "text"})
    got = Counter(tuple(r) for r in crosstok.align(docs, **more).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, aligned_by_hand(texts), strict=True))
    if not more:
        assert crosstok.align(docs.limit(0)).count() == 0


def test_both_libraries_give_the_same_ids():
    from tokenizers import Tokenizer

    one, own = Tokenizer.from_file(f"{crosstok.FOLDER}/{crosstok.A_FILE}"), crosstok.pair(crosstok.FOLDER).a
    points = [c for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}. {chr(c)} b" for c in points]
    assert [e.ids for e in one.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)] == own.encode(texts)


def test_successors_reach_the_terminal_of_their_component():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        cut = lambda: np.diff(np.concatenate([[0], np.sort(rng.choice(np.arange(1, n), min(n - 1, int(rng.integers(0, n))), replace=False)) if n > 1 else [], [n]])).astype(int)  # noqa: B023, E731
        a, b = cut(), cut()
        to_a, to_b, with_b = crosstok.terminals(a, b)
        joint = sorted(set(np.cumsum(a)) & set(np.cumsum(b)))
        of = lambda sizes: [np.searchsorted(joint, e) for e in np.cumsum(sizes)]  # noqa: B023, E731
        ends = [int(np.flatnonzero(np.cumsum(b) == e)[0]) for e in joint]
        assert to_a.tolist() == [ends[k] for k in of(a)] and to_b.tolist() == [ends[k] for k in of(b)]
        assert [k for k in range(len(b)) if with_b[k] >= 0] == ends


def test_cut_texts_are_encoded_alike():
    text = "Lorem ipsum d'olor  sit 12 3 amet, é a b\nc d " * 400
    p = crosstok.pair(crosstok.FOLDER)
    parts = crosstok.pieces(text, 50)
    assert len(parts) > 100 and " ".join(parts) == text
    for side in (p.a, p.b):
        assert sum(side.encode(parts), []) == side.encode([text])[0]
