"""Clashing names, nulls, repeated rows, empty tables, long texts and small blocks; SQL against Spark where there is SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slipcoach.llm import brown, jaccard, langid, licenses, mixing, oracles, quality, queries, sharding, tiling, tokens, urlrules, warc
from tests.llm.test_operators import SF, WORD, check_components, components, low, shingles

TABLES = "documents pages benchmark conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_says_the_same(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in cur.description]
    shown = lambda x: round(x, 9) if isinstance(x, float) else x
    want = Counter(tuple(map(shown, r)) for r in cur.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(shown(r[c]) for c in columns) for r in df.collect()) == want


def test_words_longer_than_what_is_taken_at_once():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab A\né") for _ in range(rng.randrange(60))) for _ in range(200)] + ["x" * 500, " " * 300, "y" * 90 + " " + "z" * 90]
    cut = lambda k: [
        (w.first + int(d), int(h), bytes(w.data[s:e])) for w in tokens.words(pa.array(texts), at_once=k) for d, h, s, e in zip(w.doc, w.hash, w.start, w.end, strict=True)
    ]
    assert cut(1 << 20) == cut(64) == cut(7) == cut(1)
    assert [x.decode() for _, _, x in cut(16)] == [x for t in texts for x in WORD.findall(t)]


def test_a_long_text_in_little_memory():
    import resource
    import subprocess
    import sys

    code = (
        "import pyarrow as pa, sys; sys.path.insert(0, '.'); from slipcoach.llm import tokens\n"
        "print(sum(len(w.hash) for w in tokens.words(pa.array(['lorem ipsum dolor sit amet ' * 3_700_000]))))"
    )
    most = 3 << 30
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, preexec_fn=lambda: resource.setrlimit(resource.RLIMIT_AS, (most, most)), timeout=120)
    assert run.stdout.strip() == str(5 * 3_700_000), run.stderr[-500:]


CLASHES = ("__source", "__rate", "__copies", "__copy", "shard", "__id", "__rows", "row", "id", "of", "digest", "slot", "size", "rate", "copies", "n", "node", "total", "stays", "n_words", "kept", "__t", "__w", "__lang", "may", "at", "bits")


def odd(spark, clashing=True):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    body = lambda: " ".join(rng.choice(words) for _ in range(60))
    a, b = body(), body()
    rows = [(1, a, "en", "s0"), (2, a + " end", "en", "s1"), (3, b, None, None), (3, b, None, None), (None, body(), "fr", "s0"), (None, None, None, None), (4, "", "en", "s0"), (5, body() * 3, "de", "s2"), (6, body(), "en", "s0"), (6, body(), "en", "s1"), (7, a, "en", "s2")]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if clashing:
        docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).withColumn("a b.c", F.lit(1))
    return docs


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_clashing_names_change_no_stage(spark, name):
    plain, clash = odd(spark, False), odd(spark)
    run = lambda docs: STAGES[name](spark, docs, SF)
    got = run(clash)
    want = Counter((r.doc_id, r.text, r.source) for r in run(plain).collect())
    rows = got.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == want and sum(want.values()) > 0
    for c in CLASHES:
        if name != "sharding" or c != "shard":
            assert {r[c] for r in rows} == {f"own {c}"}
    if name == "sharding":
        assert {r["shard_"] for r in rows} == {"own shard"} and all(0 <= r["shard"] < 40 for r in rows)
    else:
        assert got.columns == clash.columns
    assert run(clash.limit(0)).count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    odd(spark).drop("shard").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["id"] == "own id" for r in rows) and not {4} & {r.doc_id for r in rows}
    odd(spark).limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_of_each_component_stays_whatever_its_ids(spark):
    docs = odd(spark, False)
    kept = jaccard.keep_one(docs).collect()
    sets = [shingles(r.text) for r in docs.collect()]
    of = components(sets)
    assert sum(bool(shingles(r.text)) for r in kept) == len({c for c, s in zip(of, sets, strict=True) if s})
    assert Counter(r.doc_id for r in kept if r.text) == {1: 1, 3: 1, None: 1, 5: 1, 6: 2}


def test_small_blocks_and_squares_give_the_same_links(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(jaccard, "BLOCK_BITS", 4)
    monkeypatch.setattr(jaccard, "SQUARE", 3)
    shared = [f"s{k}" for k in range(70)]
    texts = []
    for k in range(40):  # one passage that all share, with own words before it, and near copies of some
        own = [f"o{k // 2}x{j}" for j in range(rng.randrange(6, 40))]
        texts.append(" ".join([*own, *shared]))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    check_components(docs)


def test_ids_of_any_sign(spark):
    text, most = "one two three four five six", (1 << 63) - 1
    docs = spark.createDataFrame([(k, text) for k in (None, 7, -5, 0, most, -most - 1)] + [(k, f"{text} seven eight {k}") for k in (most, None)], "doc_id long, text string")
    check_components(docs)
    assert {r.component_id for r in jaccard.cluster(docs).filter("n_shingles = 3").collect()} == {-most - 1}


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("a", "one two three four five"), ("b", "one two three four five"), ("7", "one two three four five")], "doc_id string, text string")
    got = jaccard.cluster(docs).select("doc_id", "component_id").collect()
    assert Counter(map(tuple, got)) == {(None, 7): 2, (7, 7): 1}
    bench = spark.createDataFrame([("q", "one two three four five")], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in tiling.leaks(docs, bench).collect()} == {("a", "q"), ("b", "q"), ("7", "q")}


def test_phrases_that_all_items_have(spark):
    rng = random.Random(6)
    stem = "which of the following is the best answer to".split()
    items = [[*stem, *(f"i{k}x{j}" for j in range(20))] for k in range(30)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(None, " ".join(items[3]))], "item_id long, text string")
    texts = [(k, " ".join([*(f"n{rng.randrange(999)}" for _ in range(50)), *stem, *(items[k] if k % 3 == 0 else [])])) for k in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in tiling.leaks(docs, bench).collect()}
    assert got == {(k, k) for k in range(0, 30, 3)} | {(3, None)}
    assert {r.doc_id for r in tiling.clean(docs, bench).collect()} == {k for k in range(30) if k % 3}


def test_hosts_hot_and_not(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    pages = pages.union(spark.createDataFrame([(-1, None), (-2, "no scheme"), (-3, "http://EXAMPLE.com"), (-4, "http://a.example.com:80/en/x"), (-4, "http://a.example.com:80/en/x")], "page_id long, url string"))
    rules = urlrules.rule_table(spark)
    hot = Counter(map(tuple, urlrules.judge(pages, rules).collect()))
    monkeypatch.setattr(urlrules, "HOT", 0)
    assert Counter(map(tuple, urlrules.judge(pages, rules).collect())) == hot and sum(hot.values()) == pages.count()


def test_urls_and_folders_of_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x y\nz", "p" * 300_000), (2, None, None)], "page_id long, url string, html string")
    index = warc.write(pages, f"file:{tmp_path}/w")
    rows = {r.page_id: r for r in index.collect()}
    assert rows[1].url == "http://a/x y\nz" and rows[2].url == ""
    data = (tmp_path / "w" / rows[1].archive).read_bytes()[rows[1].offset : rows[1].offset + rows[1].length]
    headers, block = warc.parse(data)
    assert headers["WARC-Target-URI"] == "http://a/x%20y%0Az" and block.endswith(b"p" * 300_000)
    assert {r.page_id: r.payload_bytes for r in warc.read(spark, index, f"file://{tmp_path}/w").collect()} == {1: 300_000, 2: 0}
    from pyarrow import fs

    try:
        store, at = warc._store("s3a://bucket/folder")
        assert isinstance(store, fs.S3FileSystem) and at == "bucket/folder"
    except (OSError, AttributeError, pa.ArrowException):
        pytest.skip("this build has no such store")


def test_declared_codes_and_domains(spark):
    assert [langid.declared_code(f"<html lang={x}>") for x in ("est", "spa", "ger", "fr-CA", "EN")] == ["est", "es", "de", "fr", "en"]
    assert langid.declared_code("<html>") is None
    hosts = {"user@a.example.de:8080": ("example.de", "de"), "a.b.co.uk": ("b.co.uk", "uk"), "x.example.com": ("example.com", "com"), "localhost": ("localhost", "localhost"), "10.0.0.1:99": ("10.0.0.1", ""), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string").withColumn("host", langid._bare(F.col("h")))
    got = {r.h: (r.d, r.s) for r in df.select("h", *(c.alias(n) for c, n in zip(langid.places("host"), "ds", strict=True))).collect()}
    assert got == hosts


def test_posterior_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows += [(-1, None, None), (-2, "http://u@de.example.de:8080/", "<html lang='deu'><p>der und die</p>"), (-2, "http://u@de.example.de:8080/", "<html lang='deu'><p>der und die</p>"), (-3, "http://x.co.uk/", "<html lang=xx>" + "the of and " * 20000)]
    got = langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), langid.fit(docs)).collect()

    def buckets(text):
        data = text.lower().encode()
        return [((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 2654435761 & 0xFFFFFFFF) >> 18 for k in range(len(data) - 2)]

    counts = {x: Counter() for x in langid.LANGS}
    for d in docs.collect():
        if d.lang in counts:
            counts[d.lang].update(buckets(d.text or ""))
    log = lambda x, b: math.log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * langid.BUCKETS))
    pages = []
    for _, url, page in rows:
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split(r"[/?#]", (url or "").partition("://")[2])[0])
        host = re.sub(r":\d*$", "", re.sub(r"^.*@", "", host))
        labels = host.split(".")
        domain = ".".join(labels[-3:] if len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3 else labels[-2:])
        code = langid.declared_code(page or "")
        text = [sum(n * log(x, b) for b, n in Counter(buckets(langid.visible(page or ""))).items()) / 3 for x in langid.LANGS]
        text = [x - max(text) for x in text]
        soft = [math.exp(x) for x in text]
        pages.append((host, domain, labels[-1], code if code in langid.LANGS else "", text, [x / sum(soft) for x in soft]))
    every = [sum(p[5][k] for p in pages) for k in range(4)]
    share = [(x + 1) / (sum(every) + 4) for x in every]
    sums = [Counter() for _ in range(4)]
    for p in pages:
        for at in range(4):
            for k in range(4):
                sums[at][p[at], k] += p[5][k]
    want = []
    for host, domain, suffix, code, text, soft in pages:
        total = []
        for k in range(4):
            less = lambda at, of, j: max(0.0, sums[at][of, j] - soft[j])  # noqa: B023, E731
            d = (less(1, domain, k) + 20 * share[k]) / (sum(less(1, domain, j) for j in range(4)) + 20)
            h = (less(0, host, k) + 5 * d) / (sum(less(0, host, j) for j in range(4)) + 5)
            told = sum(math.log((less(at, of, k) + 10 * (sum(less(at, of, j) for j in range(4)) + 0.5) / sum(every)) / (max(0.0, every[k] - soft[k]) + 10)) for at, of in ((2, suffix), (3, code)))
            total.append(text[k] + told + math.log(h))
        odds = [math.exp(x - max(total)) for x in total]
        best = max(odds) / sum(odds)
        want.append((host, code or None, langid.LANGS[odds.index(max(odds))] if best >= 0.5 else "und", round(best, 4)))
    assert Counter((r.host, r.declared, r.lang, round(r.confidence, 4)) for r in got) == Counter(want)


def test_class_scores_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "quite unheard words")], "doc_id long, text string"))
    learnt = docs.filter(~brown.held_out("doc_id"))
    words = learnt.select("text").mapInArrow(brown._counted, "word long, tail int, n long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))
    model = brown.Model(words, learnt.select("text"))
    table = {r.word: (r["class"], r.n) for r in model.classed.collect()}
    name = lambda x: brown._signed(tokens.word_hash(x))
    end = brown._signed(brown.END)

    def classes(text):
        held = next(tokens.words(pa.array([text or ""])))
        tails = brown._tails(held)
        return [(table[h][0], table[h][1]) if h in table else (int(model.unseen[t]), 0) for h, t in zip(map(int, held.hash.view(np.int64)), tails, strict=True)] + [(0, table[end][1])]

    rows, out = docs.collect(), {d.doc_id for d in docs.filter(brown.held_out("doc_id")).collect()}
    assert name("the") in table
    pairs, sizes, types = np.zeros((brown.CLASSES, brown.CLASSES)), Counter(), Counter()
    for r in rows:
        if r.doc_id not in out:
            line = [k for k, _ in classes(r.text)]
            for a, b in zip([0, *line], line, strict=False):
                pairs[a, b] += 1
    for w, (k, n) in table.items():
        sizes[k] += n
        types[k] += 1
    share = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * brown.CLASSES)
    got = {r.doc_id: r.score for r in brown.score(docs).collect()}
    for r in rows:
        line, before, total = classes(r.text), 0, 0.0
        for k, n in line:
            step = (pairs[before, k] + brown.PRIOR * share[k]) / (pairs[before].sum() + brown.PRIOR)
            total += math.log10(step) + math.log10((n + 0.5) / (sizes[k] + 0.5 * (types[k] + 1)))
            before = k
        assert math.isclose(got[r.doc_id], total, rel_tol=1e-9), r.doc_id


def test_nothing_to_learn_from_and_nothing_at_all(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = brown.score(docs, train=F.lit(False)).collect()
    assert len(none) == 2 and all(r.n_known == 0 and r.score < 0 for r in none)
    empty = docs.limit(0)
    assert brown.score(empty).count() == licenses.scan(empty).count() == tiling.clean(empty, docs.toDF("item_id", "text")).count() == 0
    assert mixing.emit(odd(spark).limit(0)).count() == sharding.assign(empty).count() == quality.keep(odd(spark).limit(0)).count() == 0


def test_long_texts(spark):
    long = "lorem ipsum dolor sit amet " * 60_000
    key = licenses.TEMPLATES[1][1]
    item = " ".join(f"q{k}" for k in range(40))
    docs = spark.createDataFrame([(1, long + key + " " + long, "en", "s"), (2, long + item, "en", "s"), (3, "x" * 2_000_000, "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.labels for r in licenses.scan(docs).collect()} == {1: "mit", 2: "", 3: ""}
    assert [r.doc_id for r in tiling.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [2]
    assert {r.doc_id: r.n_tokens for r in brown.score(docs).collect()} == {1: 600_000 + len(key.split()) + 1, 2: 300_041, 3: 2}
    assert {r.doc_id: r.n_words for r in quality.score(docs).collect()} == {1: 600_000 + len(key.split()), 2: 300_040, 3: 1}
    assert {r.doc_id: r.n_shingles for r in jaccard.cluster(docs).collect()}[3] == 1


def test_limits_are_those_of_the_sql():
    assert low("AbÉ") == "abÉ" and "0.23" in oracles.QUALITY and str(quality.WORD_LIMIT) in oracles.QUALITY


def test_a_column_of_the_new_name_in_another_case(spark, tmp_path):
    docs = odd(spark, False).withColumn("SHARD", F.lit("own"))
    got = sharding.assign(docs)
    assert got.columns == [*docs.columns[:-1], "shard_", "shard"] and {r["shard_"] for r in got.collect()} == {"own"}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "never said")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_ids_with_a_dot_in_their_name(spark):
    docs = odd(spark, False).withColumnRenamed("doc_id", "doc.id")
    n = docs.count()
    for got in (mixing.mix(docs, "doc.id"), licenses.scan(docs, "doc.id"), jaccard.cluster(docs, "doc.id"), sharding.manifest(docs, "doc.id"), quality.score(docs, "doc.id"), brown.score(docs, "doc.id")):
        assert got.columns[0] == "doc.id" and got.count() == n


def test_pages_of_unended_markup(spark):
    import time

    began = time.time()
    for tag in ("<script ", "<!--", "<html ", "<style>", "</script", "<"):
        page = tag * (5_000_000 // len(tag))
        langid.visible(page), langid.declared_code(page)
    assert time.time() - began < 20
    assert langid.visible("a<!-- b>c<p>d") .split() == ["a", "c", "d"] and langid.visible("a<script>b") .split() == ["a", "b"] and langid.visible("a <b").split() == ["a", "<b"]
    assert langid.visible("<!-- x --><STYLE>y</Style >z<!-- q").split() == ["z<!--", "q"]
    assert langid.declared_code("<html <html lang=fr>") == "fr" and langid.declared_code("<html><html lang=de") == "de" and langid.declared_code("<html><p lang=de>") is None


def test_a_long_page_in_little_memory():
    import resource
    import subprocess
    import sys

    code = (
        "import pyarrow as pa, sys, resource; sys.path.insert(0, '.'); from slipcoach.llm import langid\n"
        "import numpy as np; cells = np.zeros(langid.BUCKETS, np.int64); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "texts = pa.array(['lorem <b>ipsum dolor sit</b> amet ' * 1_200_000])\n"
        "for row, bucket in langid._trigrams(pa.array([langid.visible(texts[0].as_py())])): cells += np.bincount(bucket, minlength=len(cells))\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    )
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert int(run.stdout) < 500_000, run.stderr[-500:]
    assert resource


def test_languages_come_from_the_documents(spark):
    docs = spark.createDataFrame([("gatto cane e casa " * 30, "it"), ("the cat and the dog " * 30, "en"), ("x", None)], "text string, lang string")
    langs = langid.languages(docs)
    page = spark.createDataFrame([(1, "http://a.it/", "<p>" + "gatto e casa " * 9)], "page_id long, url string, html string")
    assert langs == ["en", "it"] and langid.identify(page, langid.fit(docs, langs=langs), langs=langs).first().lang == "it"


def test_columns_are_packed_without_loss():
    rng = np.random.default_rng(2)
    for n in (1, 2, 40, 300, 3000, 70_000):
        for level in (0, 5):
            grams = np.unique(rng.integers(0, 2**64, n, np.uint64) >> np.uint64(level))
            assert (jaccard._unpacked(pa.py_buffer(jaccard._packed(grams))) == grams).all()
    assert len(jaccard._packed(np.unique(rng.integers(0, 2**64, 3000, np.uint64)))) < 7.01 * 3000
    # alike in their leading 48 bits: two of one set stay two, two of different sets do not meet
    near = np.array([5 << 16, (5 << 16) + 1, 9 << 40], np.uint64)
    assert len(jaccard._unpacked(pa.py_buffer(jaccard._packed(near)))) == 3
    pairs = {"a": [b"a"] * 2, "b": [b"b"] * 2, "na": [3] * 2, "nb": [2] * 2, "block": [0] * 2, "ca": [jaccard._packed(near)] * 2, "cb": [jaccard._packed(near[1:]), jaccard._packed(near[1:] + np.uint64(1))]}
    got = next(jaccard._met(iter([pa.RecordBatch.from_pydict(pairs)])))
    assert got.column("met").to_pylist() == [2, 0]


def test_identifiers_and_versions(spark):
    texts = {
        "SPDX-License-Identifier: LGPL-3.0": "lgpl-3.0", "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0", "licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa-4.0",
        "See the GNU General Public License v3.": "gpl,gpl-3.0", "the GNU Lesser General Public License, version 3": "lgpl-3.0", "SPDX-License-Identifier: MIT": "mit", "spdx license": "", "license identifier": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(docs).collect()} == dict(enumerate(texts.values()))


def test_templates_that_no_file_names_cost_nothing():
    index = licenses.Index([("x", f"rare{k} word of a licence", f"rare{k} word") for k in range(5000)] + [("y", "a b c", "b c")])
    index.post(np.array([float(w.startswith("rare")) for w in index.words]))
    number = index.numbers(np.array([tokens.word_hash(w) for w in "a b c rare7 word of a licence a".split()], np.uint64))
    tried = []
    index.bodies = type("Watched", (list,), {"__getitem__": lambda self, k: tried.append(k) or list.__getitem__(self, k)})(index.bodies)
    got = licenses._candidates(index, number, np.zeros(len(number), np.int64), np.array([0, len(number)]))
    assert got == [{"x": 1.0, "y": 1.0}] and sorted(tried) == [7, 5000]
