"""The corpus pipeline against brute force, stage by stage."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
from slipcoach.llm import mixing, quality, sharding
from tests.llm.test_operators import WORD, components, shingles

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import duckdb

    rows = corpus_pipeline.run(spark, SF).collect()
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.score(documents).collect() if r.kept}
    docs = [r for r in documents.orderBy("doc_id").collect() if r.doc_id in kept]
    of = components([shingles(r.text) for r in docs])
    docs = [r for k, r in enumerate(docs) if of[k] == k]
    normal = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    items = [normal(r[0]) for r in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    docs = [r for r in docs if not any(x in normal(r.text) for x in items)]
    sizes = Counter()
    for r in docs:
        sizes[r.source] += len(WORD.findall(r.text))
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes))}
    capped: set = set()
    while True:
        left, held = sum(sizes.values()) - 3 * sum(sizes[s] for s in capped), sum(weight[s] for s in weight if s not in capped)
        over = {s for s in sizes if weight[s] * left > 3 * sizes[s] * held}
        if over == capped:
            break
        capped = over
    want = Counter()
    for r in docs:
        rate = 3.0 if r.source in capped else weight[r.source] * left / held / sizes[r.source]
        draw = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        n = math.floor(rate) + (draw < rate - math.floor(rate))
        score = {k: int(hashlib.md5(f"{sharding.SEED}:{k}:{r.doc_id}".encode()).hexdigest()[:13], 16) for k in range(40)}
        if n:
            want[(r.doc_id, r.text, min(score, key=lambda k: (-score[k], k)))] += n
    assert Counter((r.doc_id, r.text, r.shard) for r in rows) == want
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_near_copies_by_five_words(spark):
    words = [f"v{k}" for k in range(300)]
    pairs = [(n, m) for n in (40, 46, 47, 48, 49, 54, 95, 99, 120) for m in (1, 2)]  # texts of n words, the copy with m words changed
    rows = []
    for k, (n, m) in enumerate(pairs):
        text = [f"{k}{w}" for w in words[:n]]
        copy = text.copy()
        for j in range(m):
            copy[n // 3 * (j + 1)] = "changed"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    of = components([shingles(t, 5) for _, t in rows], 80)
    want = {k for k, _ in rows if of[k] == k}
    assert got == want != {k for k, _ in rows if components([shingles(t) for _, t in rows])[k] == k}
