"""Language identification by Bayesian evidence fusion.

Four pieces of evidence on a web page, each a log-likelihood or log-prior by language, are added up:

* text: byte trigrams of the visible text under a naive Bayes model, fitted on all documents with a known language;
* declared markup language: the lang attribute, with P(declared | language) from grouped soft counts over all pages;
* address suffix: the last label of the host (without user and port), likewise;
* host prior: the language shares of the page's host, smoothed towards those of its domain, those towards all pages'.

A page's own soft count is taken out of all four tables first, so it does not vote for itself.


Soft counts are the text posteriors, summed by host, domain, suffix and declared language (aggregates with map-side
combine; the hot host is one row of them). Only small columns move; the pages' html is read once and stays where it is.

Defined results: a null or empty page has no text evidence and gets its language from the rest; a null url has an empty
host; no declaration, or one of no language of `langs`, is a value of its own; a page whose best posterior is below SURE is
"und"; ties go to the language first in `langs`; repeated rows count and are judged each; an unended comment, script or style
is a tag and an unended tag is text; training rows with another or no language are not used; without training rows the text says
nothing; an empty table of pages gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipcoach.llm import dense, tokens
from slipcoach.llm.urlrules import host_and_path
from slipcoach.plans import shared as scratch

#: The languages told apart; their number bounds the model's size (128 KB each).
LANGS = ("en", "fr", "de", "es")
BUCKETS, SLICES, ADD = 1 << 14, 4, 0.5
#: Every byte stands in three trigrams: each counts as a third of an independent one.
OVERLAP = 3
#: Least posterior of a language that is named; below it the page is UNSURE.
SURE, UNSURE = 0.5, "und"
#: Two-letter codes of three-letter ones.
CODES = {"eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es"}
#: Weight of the domain's shares against a host's own pages, of all pages against a domain's, and of the shares in the evidence tables.
HOST_PRIOR, DOMAIN_PRIOR, EVIDENCE_PRIOR = 5.0, 20.0, 10.0
#: Bytes whose trigrams are held at once, and bytes of pages taken together.
AT_ONCE, TOGETHER = 1 << 20, 4 << 20
_TAG = re.compile(r"<(?:(!--)|(script|style)\b)?", re.I)
_CLOSE = {"!--": re.compile("-->"), "script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)


def _trigrams(texts: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every byte trigram of lower-cased texts that lies in one row, those of some bytes at a time."""
    at, data = tokens.buffers(pc.utf8_lower(texts))
    for begin in range(int(at[0]), int(at[-1]) - 2, at_once):
        part = data[begin : min(begin + at_once + 2, int(at[-1]))].astype(np.uint32)
        bucket = ((part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]) * np.uint32(2654435761)) >> np.uint32(18)
        row = np.searchsorted(at, np.arange(begin, begin + len(part)), "right") - 1
        same = row[:-2] == row[2:]
        yield row[:-2][same], bucket[same].astype(np.int64)


def _together(texts: pa.Array, rows: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of so many rows, or of TOGETHER bytes, at most; a longer text comes alone."""
    at, _ = tokens.buffers(texts)
    begin = 0
    while begin < len(at) - 1:
        stop = min(begin + rows, max(begin + 1, int(np.searchsorted(at, at[begin] + TOGETHER, "right")) - 1))
        yield begin, stop - begin
        begin = stop


def _counted(langs: Sequence[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(len(langs) * BUCKETS, np.uint32)
        for batch in batches:
            for begin, count in _together(batch.column("text"), 500):
                part = batch.slice(begin, count)
                lang = part.column("lang").to_numpy()
                for row, bucket in _trigrams(part.column("text")):
                    cells += np.bincount(lang[row] * BUCKETS + bucket, minlength=len(cells)).astype(np.uint32)
        yield dense.parts(cells, SLICES * len(langs))

    return run


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", langs: Sequence[str] = LANGS) -> np.ndarray:
    """log P(trigram bucket | language), a row for each language, from all documents in one of them."""
    number = F.array_position(F.array(*map(F.lit, langs)), F.col(lang_col)) - 1
    rows = docs.select(number.cast("long").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("lang >= 0")
    blobs = scratch.save(rows.mapInArrow(_counted(langs), dense.SCHEMA), "trigrams")
    counts = dense.total(blobs, len(langs) * BUCKETS, SLICES * len(langs)).reshape(len(langs), BUCKETS).astype(float) + ADD
    return np.log(counts / counts.sum(1, keepdims=True))


def languages(docs: DataFrame, lang_col: str = "lang") -> list[str]:
    """The languages that documents are in, in the order of their codes; a row for each reaches the driver."""
    return [r["lang"] for r in docs.select(F.col(f"`{lang_col}`").alias("lang")).filter("lang is not null").distinct().orderBy("lang").collect()]


def visible(page: str) -> str:
    """The text of a page, without markup, scripts, styles and comments, by one pass forward.

    A comment, script or style that nothing ends counts as a tag; a tag that nothing ends counts as text.
    """
    out, at, unended = [], 0, set()
    while found := _TAG.search(page, at):
        kind, end = (found[1] or found[2] or "").lower(), 0
        if kind and kind not in unended:  # what is not found from here on is not found later either
            closed = _CLOSE[kind].search(page, found.end())
            end = closed.end() if closed else unended.add(kind) or 0
        end = end or page.find(">", found.start()) + 1
        if not end:
            break
        out.append(page[at : found.start()])
        at = end
    return html.unescape(" ".join([*out, page[at:]]))


def declared_code(page: str) -> str | None:
    """The primary code of the lang attribute, in two letters where there is a two-letter one."""
    at = 0
    while tag := _HTML.search(page, at):
        end = page.find(">", tag.end())  # what stands before it belongs to this tag, other tags that begin there too
        if found := _LANG.search(page, tag.end(), end if end >= 0 else len(page)):
            return CODES.get(found[1].lower(), found[1].lower())
        if end < 0:
            break
        at = end + 1
    return None


def _bare(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def _domain(labels: Column) -> Column:
    """The last two labels, or three where the last two are a short label under a two-letter one, as in co.uk."""
    last, before = F.try_element_at(labels, F.lit(-1)), F.try_element_at(labels, F.lit(-2))
    deep = (F.size(labels) > 2) & (F.length(last) == 2) & (F.length(before) <= 3)
    n = F.when(deep, 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def places(host: str) -> tuple[Column, Column]:
    """(domain, suffix) of a host; an address in numbers has no suffix and is a domain of its own."""
    labels, address = F.split(host, r"\."), F.col(host).rlike(r"^[0-9.]+$|^\[")
    return F.when(address, F.col(host)).otherwise(_domain(labels)), F.when(address, "").otherwise(F.element_at(labels, -1))


def _evidence(shared) -> Callable:
    """(id, host, declared, text0, text1, ...): the text's log-likelihoods, less the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for begin, count in _together(batch.column("html"), 200):
                part = batch.slice(begin, count)
                pages = [x or "" for x in part.column("html").to_pylist()]
                logs = np.zeros((len(model), count))
                for row, bucket in _trigrams(pa.array([visible(x) for x in pages], pa.string())):
                    logs += np.stack([np.bincount(row, m[bucket], count) / OVERLAP for m in model])
                logs -= logs.max(0)
                declared = [declared_code(x) for x in pages]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("host"), pa.array(declared, pa.string()), *map(pa.array, logs)], names=["id", "host", "declared", *(f"text{k}" for k in range(len(model)))])

    return run


def _posterior(logs: Sequence[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    total = sum((F.exp(x - top) for x in logs[1:]), F.exp(logs[0] - top))
    return [F.exp(x - top) / total for x in logs]


def identify(pages: DataFrame, model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", langs: Sequence[str] = LANGS) -> DataFrame:
    """One row per page: id, host, suffix, declared, text_lang (by the text alone), lang, confidence (posterior of lang)."""
    spark, n = pages.sparkSession, range(len(langs))
    kind = pages.select(F.col(f"`{id_col}`")).dtypes[0][1]
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), _bare(host_and_path(url_col)[0]).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = f"id {kind}, host string, declared string, " + ", ".join(f"text{k} double" for k in n)
    seen = scratch.save(rows.mapInArrow(_evidence(spark.sparkContext.broadcast(model)), schema), "evidence")
    domain, suffix = places("host")
    seen = seen.withColumns({"domain": domain, "suffix": suffix})
    seen = seen.withColumn("declared", F.coalesce(F.when(F.col("declared").isin(list(langs)), F.col("declared")), F.lit("")))
    seen = seen.select("*", *(p.alias(f"p{k}") for k, p in zip(n, _posterior([F.col(f"text{k}") for k in n]), strict=True)))

    sums = lambda by, short: seen.groupBy(F.col(by).alias(f"{short}_of")).agg(*(F.sum(f"p{k}").alias(f"{short}{k}") for k in n))
    every = seen.agg(*(F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) for k in n)).first()
    share = [(x + 1) / (sum(every) + len(langs)) for x in every]
    tables = {short: scratch.save(sums(by, short), short) for by, short in (("host", "h"), ("domain", "d"), ("suffix", "s"), ("declared", "m"))}
    out = seen
    for by, short in (("host", "h"), ("domain", "d"), ("suffix", "s"), ("declared", "m")):
        out = out.join(tables[short], F.col(by) == F.col(f"{short}_of"))

    less = lambda short, k: F.greatest(F.lit(0.0), F.col(f"{short}{k}") - F.col(f"p{k}"))
    total = lambda short: sum((less(short, k) for k in n), F.lit(0.0))
    logs = []
    for k in n:
        domain = (less("d", k) + DOMAIN_PRIOR * share[k]) / (total("d") + DOMAIN_PRIOR)
        host = (less("h", k) + HOST_PRIOR * domain) / (total("h") + HOST_PRIOR)
        evidence = F.lit(0.0)
        for short in ("s", "m"):
            part = (total(short) + 0.5) / F.lit(max(sum(every), 1.0))
            evidence = evidence + F.log((less(short, k) + EVIDENCE_PRIOR * part) / (F.greatest(F.lit(0.0), F.lit(every[k]) - F.col(f"p{k}")) + EVIDENCE_PRIOR))
        logs.append(F.col(f"text{k}") + evidence + F.log(host))
    out = out.select("id", "host", "suffix", "declared", *(F.col(f"text{k}") for k in n), *(x.alias(f"log{k}") for k, x in enumerate(logs)))
    best = lambda name: F.array(*map(F.lit, langs))[F.array_position(F.array(*(F.col(f"{name}{k}") for k in n)), F.greatest(*(F.col(f"{name}{k}") for k in n))).cast("int") - 1]
    sure = F.greatest(*_posterior([F.col(f"log{k}") for k in n]))
    return out.select(F.col("id").alias(id_col), "host", "suffix", F.nullif("declared", F.lit("")).alias("declared"), best("text").alias("text_lang"), F.when(sure >= SURE, best("log")).otherwise(UNSURE).alias("lang"), F.round(sure, 6).alias("confidence"))
