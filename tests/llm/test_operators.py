"""The text operators against brute force on small tables, with nulls, empty and repeated rows and clashing columns."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from slipcoach.llm import brown, jaccard, langid, licenses, mixing, quality, sharding, tiling, tokens, urlrules, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_docs(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    near = base.copy()
    near[7] = "Other"
    far = base[:30] + [rng.choice(words) for _ in range(30)]
    texts = [None, "", " \t\n", "one", "one two", "ONE two", " ".join(base), " ".join(near), " ".join(far), "a b \U0001f600 Été", "same line\nsame line\n\nsame line", "x " * 30000, " ".join(base) + "\n"]
    rows = [(k, t, None if k == 3 else "en", None if k % 4 == 0 else f"s{k % 3}", None, 1, "r") for k, t in enumerate(texts)]
    rows += [(6, " ".join(base), "en", "s0", None, 1, "r"), (None, "one two", "en", "s1", None, 1, "r")]
    return spark.createDataFrame(rows, DOCS)


def test_words_are_those_of_the_regex():
    texts = ["", None, "Ab ab\x0bAB x y  ", "Éé z", "ab"]
    got = [[] for _ in texts]
    for w in tokens.words(pa.array(texts), at_once=4):
        for d, s, e in zip(w.doc, w.start, w.end, strict=True):
            got[w.first + d].append(bytes(w.data[s:e]).decode())
    assert got == [WORD.findall(t or "") for t in texts]
    hashes = np.concatenate([w.hash for w in tokens.words(pa.array(["Ab ab AB b"]))])
    assert len(set(hashes.tolist())) == 2 and tokens.word_hash("ab") == hashes[0]


def components(sets, percent=85):
    root = {k: k for k in range(len(sets))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))]


def shingles(text, n=4):
    w = WORD.findall(low(text))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def check_components(docs):
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in rows]
    of = components(sets)
    least = {}
    for r, c in zip(rows, of, strict=True):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, len(s), least.get(c) if s else r.doc_id) for r, s, c in zip(rows, sets, of, strict=True))
    got = Counter(tuple(r) for r in jaccard.cluster(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == want


def test_jaccard_join(spark):
    check_components(odd_docs(spark))
    rng = random.Random(7)
    base = [f"v{rng.randrange(9999)}" for _ in range(120)]
    family = []
    for k in range(60):  # near copies of one text, some too far from the others
        own = base.copy()
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(9999)}"
        family.append((k, " ".join(own), "en", "s", None, 1, "r"))
    check_components(spark.createDataFrame(family, DOCS))


def test_jaccard_join_of_nothing(spark):
    assert jaccard.cluster(odd_docs(spark).limit(0)).count() == 0
    kept = [r.doc_id for r in jaccard.keep_one(odd_docs(spark)).collect()]
    assert Counter(kept)[6] == 1 and 7 not in kept and 12 not in kept and {0, 1, 2, 3, 8} <= set(kept)


def test_mixing(spark):
    docs = odd_docs(spark)
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    assert len(rows) == docs.count() and {r.source_size for r in rows} == set(sizes.values())
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in rows)
    targets = {s: {r.target for r in rows if r.source_size == n} for s, n in sizes.items()}
    assert math.isclose(sum(min(t) for t in targets.values()), sum(sizes.values()))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    emitted = Counter(r.doc_id for r in mixing.emit(docs).collect())
    assert emitted == Counter({k: v for k, v in Counter(r.doc_id for r in rows for _ in range(r.copies)).items() if v})
    assert mixing.emit(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def base_metrics(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for docs in (odd_docs(spark), documents):
        want = Counter((r.doc_id, *base_metrics(r.text)) for r in docs.collect())
        rows = quality.score(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
        assert not any(r.kept and r.base_failed for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
    kept = quality.keep(documents)
    assert kept.columns == documents.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert quality.score(documents.limit(0)).count() == 0


def test_quality_at_the_border_of_a_text(spark):
    body = "one two three four five six seven eight nine ten"
    texts = ["for all of", "f", "fff", "\fa b\f", "\f", "f\f", f"of {body} if", f"f {body} f", f"\x0b\f\r\n\t {body}\f", f"of all of that of if {body} of all of that of if", "off f off"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.score(docs).collect()}
    assert got == {(k, *base_metrics(t)) for k, t in enumerate(texts)}


def test_quality_distance(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([3, 1, 0], [0.25, 0.25, 0.5]), ([0, 0, 0], [0.5, 0.5, 0.0])], "c array<int>, s array<double>")
    got = [r[0] for r in df.select(quality.distance("c", "s")).collect()]
    p, q = [0.75, 0.25, 0.0], [0.25, 0.25, 0.5]
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert math.isclose(got[0], math.sqrt((kl(p) + kl(q)) / 2)) and got[1] == 0.0
    assert df.select(F.size("c")).count() == 2


def test_licenses(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(-1, "X. Licensed under CC BY-NC 4.0."), (-2, None), (-3, "gnu General\nPublic-License gnu general public license"), (-4, "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (-5, "permission hereby of is any software and free")]
    docs = documents.union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for d in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(d.text))
        places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = rows[d.doc_id]
        at = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert rows[-1].labels == "cc-by,cc-by-nc-4.0" and rows[-3].labels == "gpl" and rows[-3].n_base == 2
    assert rows[-4].labels == "mit" and rows[-4].n_base == 0 and rows[-5].labels == "" and rows[-5].score == 0.0


def test_several_licenses_in_a_file(spark):
    rng = random.Random(13)
    three = "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License."
    passages = [p for _, p, _ in licenses.TEMPLATES]
    vocabulary = [w for p in passages for w in p.split()]
    scattered = lambda n: " ".join(rng.choice(vocabulary) + " and so x" for _ in range(n))
    texts = [three, f"{passages[1]}. {passages[10]}. Licensed under CC BY-SA 4.0.", ". ".join(passages)]
    texts += [f"{scattered(3000)} {p} {scattered(3000)}" for p in passages] + [passages[5][6:], passages[2] + " x", "license version " + passages[3][8:], scattered(500), "common words of a file"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for k, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        want = {label for phrase, label in licenses.PHRASES for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split()}
        for label, passage, key in licenses.TEMPLATES:
            body, key = passage.split(), key.split()
            at = next(j for j in range(len(body)) if body[j : j + len(key)] == key)
            for j in range(len(w)):
                if w[j] == key[0] and w[j : j + len(key)] == key:
                    same = sum(0 <= j - at + i < len(w) and w[j - at + i] == b for i, b in enumerate(body))
                    if same >= licenses.IN_PLACE * len(body):
                        want.add(label)
        assert rows[k].labels == ",".join(sorted(want))
    assert rows[0].labels == "apache,apache-2.0,gpl,gpl-3.0,mit" and rows[1].labels == "bsd,cc-by,cc-by-sa-4.0,mit"


def test_sharding(spark):
    docs = odd_docs(spark)
    rows = sharding.manifest(docs).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})
    assert all(r.grown_shard in (r.shard, 40) and r.law == "key" for r in rows)
    many = spark.range(3000).selectExpr("id AS doc_id", "'x' AS text")
    rows = sharding.manifest(many).collect()
    for shard in range(40):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and 40 <= len(slots) <= 120
    assert 30 <= sum(r.grown_shard == 40 for r in rows) <= 130
    uneven = Counter(r.shard for r in sharding.assign(many, weights=(1.0, 3.0)).collect())
    assert 2.5 < uneven[1] / uneven[0] < 3.6
    assert sharding.manifest(docs.limit(0)).count() == 0


def test_language_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = langid.identify(pages, model).collect()
    path = {r.page_id: re.search(r"/(en|fr|de|es)/", r.url) for r in pages.collect()}
    known = [(r.lang, path[r.page_id][1]) for r in rows if path[r.page_id]]
    assert len(rows) == pages.count() and sum(a == b for a, b in known) >= 0.9 * len(known)
    odd = spark.createDataFrame([(1, None, None), (2, "http://a.example.com/", "<html lang='FR'><p>et les deux</p>"), (2, "http://a.example.com/", "")], "page_id long, url string, html string")
    got = langid.identify(odd, model).collect()
    assert len(got) == 3 and all(0 < r.confidence <= 1 for r in got) and langid.identify(odd.limit(0), model).count() == 0
    assert langid.visible("<p>a &amp; b<script>var t='</p>'</script><!-- c --></p>").split() == ["a", "&", "b"]


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "é" * 3000), (None, "http://f/", "same"), (2, "http://b/", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(tuple(r) for r in warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = Counter()
    for page_id, _, text in rows:
        payload = (text or "").encode()
        first = max(p for p, _, t in rows if (t or "").encode() == payload and p is not None)
        kind = ("response", None) if page_id == first else ("revisit", first)
        want[(page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), *kind)] += 1
    assert got == want
    folder = f"file://{tmp_path}/warc"
    index = warc.write(pages.limit(0), folder)
    assert index.count() == 0 and warc.read(spark, index, folder).count() == 0


def test_ranges_are_coalesced():
    reads = list(warc.ranges([("a", 0, 10), ("a", 12, 5), ("a", 500, 5), ("b", 0, 5)], read_bytes=100, gap_bytes=20))
    assert reads == [("a", 0, 17, [(0, 10), (12, 5)]), ("a", 500, 505, [(500, 5)]), ("b", 0, 5, [(0, 5)])]


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (None, "the of")], "doc_id long, text string"))
    rows = docs.collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter()
    for r in rows:
        if not held(r.doc_id):
            counts.update([*WORD.findall(low(r.text)), "\n"])
    total, types = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        w = [*WORD.findall(low(r.text)), "\n"]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w)
        want[(r.doc_id, held(r.doc_id), len(w), sum(counts[x] > 0 for x in w), total, round(base, 5))] += 1
    small = brown.HEAD
    try:
        brown.HEAD = 300  # most words take the way through the join
        got = brown.score(docs).collect()
    finally:
        brown.HEAD = small
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert math.isclose(sum(r.score for r in got), sum(r.score for r in brown.score(docs).collect()), rel_tol=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(1)
    kinds = np.arange(30) % 3
    counts = np.zeros((31, 31), np.int64)
    for a in range(30):
        for b in range(30):
            counts[a, b] = rng.poisson(20 if (kinds[a] + 1) % 3 == kinds[b] else 1)
    of = brown.exchange(counts, 4)
    assert of[30] == 0 and len({(int(k), int(c)) for k, c in zip(kinds, of, strict=False)}) == 3


def test_every_word_is_clustered(spark):
    rng = random.Random(11)
    kind = {f"{k:05d}zzzz": k % 3 for k in range(1500)}  # one tail for all of them
    of = [[w for w in kind if kind[w] == c] for c in range(3)]
    texts = [" ".join(of[(k + j) % 3][int(500 * rng.random() ** 2)] for j in range(60)) for k in range(1200)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    words = docs.mapInArrow(brown._counted, "word long, tail int, n long").groupBy("word").agg({"tail": "first", "n": "sum"}).toDF("word", "tail", "n")
    for most in (100, brown.HEAD):  # with and without the join
        _, _, least = brown._head(words, most)
        got = {r["word"] % 2**64: r["class"] for r in brown.classes(words, docs, least).collect()}
        assert len(got) == words.count() and got[brown.END] == 0
        held = {w: got[tokens.word_hash(w)] for w in kind if tokens.word_hash(w) in got}
        share = Counter((c, kind[w]) for w, c in held.items())
        assert sum(max(share[c, k] for k in range(3)) for c in set(held.values())) >= 0.95 * len(held) > 1400


def test_a_sweep_by_brute_force_and_what_it_shuffles(spark, monkeypatch):
    rng = random.Random(5)
    texts = [None, ""]
    for k in range(150):
        a, b = f"r{2 * k}x{k % 7}", f"r{2 * k + 1}x{k % 5}"
        texts.append(" ".join(w for _ in range(60) for w in ("ab", a, "cd", *((a, b) if rng.random() < 0.1 else (b,)), *rng.choice([["ef"], ["ef", "ef"], [b]]))))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).cache()
    words = docs.mapInArrow(brown._counted, "word long, tail int, n long").groupBy("word").agg({"tail": "first", "n": "sum"}).toDF("word", "tail", "n").cache()
    lines = [[brown._signed(tokens.word_hash(w)) for w in [*(t or "").split(), "\n"]] for t in texts]
    end, size, table = lines[0][0], brown.CLASSES, {r["word"]: r for r in words.collect()}
    place = {w: k for k, w in enumerate(sorted(table))}
    monkeypatch.setattr(brown, "exchange", lambda counts, classes: np.append(1 + np.arange(len(counts) - 1) % (classes - 1), 0))
    first_of = 1 + np.arange(brown.OWN_UNITS + brown.TAIL_UNITS) % (size - 1)
    tails = first_of[len(table) - 1 :][: brown.TAIL_UNITS]  # all words but the end are units of their own

    def shuffled():
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        none = jvm.java.util.ArrayList()
        stages, total = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none).iterator(), 0
        while stages.hasNext():
            total += stages.next().shuffleWriteRecords()
        return total

    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
    try:
        for most in (0, 2, 3, brown.HEAD):
            _, _, least = brown._head(words, most)
            first = {r["word"]: r["class"] for r in brown.classes(words, docs, least, 0).collect()}
            before = shuffled()
            got = {r["word"]: r["class"] for r in brown.classes(words, docs, least, 1).collect()}
            if most == 3:
                assert sum(r["n"] for r in table.values() if r["n"] < 200) > 18_000 > 9000 > shuffled() - before
            of = np.array([first[w] for w in place])
            wide, pairs = np.zeros((len(place), 2 * size + 1), np.int64), np.zeros((size, size))
            for line in lines:
                for a, b in itertools.pairwise([place[end], *(place[w] for w in line)]):
                    pairs[of[a], of[b]] += 1
                    if a == b:
                        wide[a, 2 * size] += 1
                    else:
                        wide[a, size + of[b]] += 1
                        wide[b, of[a]] += 1
            row, code = np.nonzero(wide)
            want = brown.moves(pairs, of, row, code, wide[row, code], tails[[table[w]["tail"] for w in place]])
            assert got == dict(zip(place, want.tolist(), strict=True)) and got != first
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)


def test_moves_are_the_likeliest():
    rng = np.random.default_rng(2)
    counts, size = rng.poisson(2, (21, 21)), 5
    of = np.concatenate([1 + np.arange(20) % (size - 1), [0]])
    one = np.eye(size)[of]
    table = one.T @ counts @ one
    rest = counts - np.diag(np.diag(counts))
    wide = np.concatenate([rest.T @ one, rest @ one, np.diag(counts)[:, None]], 1).astype(np.int64)
    row, code = np.nonzero(wide)
    got = brown.moves(table, of, row, code, wide[row, code])
    share = brown.PRIOR * (table.sum(0) + brown.ADD) / (table.sum() + brown.ADD * size)

    def likelihood(u, k):
        less = counts.copy()
        less[u], less[:, u] = 0, 0
        t = one.T @ less @ one
        # what a word before it or after it loses is its own, whatever class it goes to
        rows, cols = table.sum(1) - (of[u] == np.arange(size)) * counts[u].sum(), table.sum(0) - (of[u] == np.arange(size)) * counts[:, u].sum()
        pair = lambda a, b: math.log((t[a, b] + share[b]) / (rows[a] + brown.PRIOR))
        # rows of the classes before are the same for every k
        before = lambda a, b: math.log(t[a, b] + share[b])
        out = sum(counts[u, v] * pair(k, of[v]) for v in range(21) if v != u) + sum(counts[v, u] * before(of[v], k) for v in range(21) if v != u)
        return out + counts[u, u] * pair(k, k) - counts[:, u].sum() * math.log(cols[k] + brown.ADD)

    for u in range(20):
        at = [likelihood(u, k) for k in range(1, size)]
        assert math.isclose(at[got[u] - 1], max(at))
    assert got[20] == 0 and (got != of).any()


def test_url_rules(spark):
    urls = [None, "no scheme", "http://www.Example.com/en/x?q#f", "http://example.com/en/", "http://example.com/english", "https://a.b.net/es/1", "http://net/fr/", "http://notexample.com/en/", "http://x.org/", "http://example.com", "ftp://evil.com?x=/en/", "http://www.example.com/en/http://a/", "http:///en/", "http://com./"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(2, urls[2], "h")], "page_id long, url string, host string")
    rules = urlrules.rule_table(spark)

    def judged(url, table):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = low(re.match("[^/?#]*", rest)[0]), re.match("[^/?#]*([^?#]*)", rest)[1]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in table if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")

    want = Counter((k, *judged(u, urlrules.RULES)) for k, u in [*enumerate(urls), (2, urls[2])])
    assert Counter(tuple(r) for r in urlrules.judge(pages, rules).collect()) == want
    nested = (("com", "/a", "block"), ("com", "/a/b", "allow"), ("com", "/ab", "block"), ("x.com", "/", "block"), ("y.x.com", "/a/b/c", "allow"), ("com", "", "allow"))
    more = spark.createDataFrame([(k, u) for k, u in enumerate(["http://x.com/a/b/c", "http://y.x.com/a/b/c", "http://z.com/a/b", "http://z.com/abc", "http://z.com/", "http://y.x.com"])], "page_id long, url string")
    assert Counter(tuple(r) for r in urlrules.judge(more, urlrules.rule_table(spark, nested)).collect()) == Counter((r.page_id, *judged(r.url, nested)) for r in more.collect())
    assert urlrules.judge(pages.limit(0), rules).count() == 0 and {r.verdict for r in urlrules.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_tiling(spark, monkeypatch):
    rng = random.Random(5)
    item = [f"q{k}" for k in range(40)]
    noise = lambda n: [f"n{rng.randrange(9999)}" for _ in range(n)]
    texts = {
        1: [*noise(50), *item, *noise(50)], 2: [*item[20:], *noise(9), *item[:20]], 3: noise(200), 4: [*item[:12], *noise(30)], 5: [w.upper() + "," for w in item], 6: [x for k in range(0, 40, 3) for x in (*item[k : k + 3], "zz")], 7: item * 3,
    }
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()] + [(8, None), (9, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "q1 q2"), (12, None)], "item_id long, text string")
    for bits in (1, tiling.MOST_BITS):  # a filter of 64 bits lets much else pass
        monkeypatch.setattr(tiling, "MOST_BITS", max(bits, 6))
        monkeypatch.setattr(tiling, "LEAST_BITS", max(min(bits, 16), 6))
        got = {(r.doc_id, r.item_id): r for r in tiling.leaks(docs, bench).collect()}
        assert set(got) == {(k, 10) for k in (1, 2, 5, 7)}
    assert got[(2, 10)].n_tiles == 2 and got[(2, 10)].coverage == 1.0 and got[(1, 10)].longest_tile == 40 and got[(7, 10)].n_tiles == 1
    assert sorted(r.doc_id for r in tiling.clean(docs, bench).collect()) == [3, 4, 6, 8, 9]
    assert tiling.leaks(docs, bench.limit(0)).count() == 0 and tiling.clean(docs, bench.limit(0)).count() == 9 and tiling.leaks(docs.limit(0), bench).count() == 0


def test_items_shorter_than_a_seed(spark):
    rng = random.Random(8)
    items = {10: "q1 q2", 11: "q3", 12: "q1 q2 q3", 13: "", 14: None, 15: "Q2, q2!", 16: "q1 q2 q3 q1", 17: "q1 q2 q3 q1 q2 q9"}
    texts = [[f"q{rng.randrange(1, 4)}" if rng.random() < 0.5 else f"n{k}" for k in range(rng.randrange(30))] for _ in range(120)] + [["q3"], ["q1", "q2"], []]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in tiling.leaks(docs, bench, short=True).collect()}
    want = set()
    for k, w in enumerate(texts):
        for i, item in {10: "q1 q2", 11: "q3", 12: "q1 q2 q3", 15: "q2 q2", 16: "q1 q2 q3 q1"}.items():
            n = len(item.split())
            if any(" ".join(w[j : j + n]) == item for j in range(len(w) - n + 1)):
                want.add((k, i))
    assert {k for k in got if k[1] != 17} == want and len({i for _, i in want}) == 5
    assert all((r.coverage, r.n_tiles, r.longest_tile) == (1.0, 1, r.item_words) for r in got.values() if r.item_id < 17)
    long_ones = {(r.doc_id, r.item_id) for r in tiling.leaks(docs, bench).collect()}
    assert long_ones == {k for k in got if k[1] > 15}
    assert {r.doc_id for r in tiling.clean(docs, bench, short=True).collect()} == {-1, *range(len(texts))} - {k for k, _ in got}


def test_tiles_are_greedy():
    def plain(a, b, least):
        used_a, used_b, out = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            if best[0] < least:
                return sum(out)
            out.append(best[0])
            used_a |= set(range(best[1], best[1] + best[0]))
            used_b |= set(range(best[2], best[2] + best[0]))

    rng = random.Random(9)
    for _ in range(40):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(6, 20))] for _ in range(2))
        made = tiling.tiles(np.array(a, np.uint64) + np.uint64(7), np.array(b, np.uint64) + np.uint64(7), 3)
        assert sum(made) == plain(a, b, 3)


def test_tiles_of_periodic_texts():
    word = np.uint64(99)
    begin = time.process_time()
    for n, m in ((200, 2_000), (800, 200_000)):
        assert tiling.tiles(np.full(n, word), np.full(m, word), 4) == [n]
    item = np.tile(np.arange(1, 8, dtype=np.uint64), 100)
    text = np.concatenate([np.tile(np.append(item[:5], np.uint64(0)), 3000), item[:30]])
    made = tiling.tiles(item, text, 4)
    assert made[0] == 30 and set(made[1:]) == {5} and len(made) > 90
    assert time.process_time() - begin < 5
