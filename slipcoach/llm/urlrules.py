"""URL rules by a sort-merge range join; DataFrame functions only.

A host written backwards, label by label, turns "this host and all its subdomains" into an interval of sorted keys,
and "a path that starts so" is an interval as well. Rules nest in one another or lie apart, so a sweep over rules and
urls in key order needs a stack of the rules that are open: one for each depth, the last one seen at that depth, which
is still open if its key begins the url's key. The sweep is a range-partitioned sort; each partition starts with the
stack that the ones before it leave. It runs once over the distinct hosts and once over the distinct paths under each
rule host that a url's host belongs to, so a host with a third of all pages is one row of it.

Defined results: a null url, or one without `://`, has an empty host and path, and no rule; a repeated rule counts once,
and of rules alike but for their verdict block wins; of rules that fit, the one with the longest host and path wins,
then the longer host; no rule gives the default verdict; an empty table of pages or rules gives an empty one, or the
default; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipcoach.plans import shared as scratch

#: Host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"
#: A host with more than this part of all urls is a hot one: there are no more than 1000 of them.
HOT = 1000
#: Between a host's key and a path; no host has it.
GAP = "\u0001"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """The rules as a table, made by expressions."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    table = spark.range(1).select(F.inline(F.array(*rows)) if rows else F.inline(F.array().cast("array<struct<host:string,path:string,verdict:string>>")))
    return table.toDF("host", "path", "verdict")


def host_and_path(url: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(url), F.lit(""))
    begin = F.locate("://", text)
    after = F.when(begin > 0, F.substr(text, begin + 3)).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def _key(host: str) -> Column:
    """com.example.www. for www.example.com"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points (key), distinct; intervals (start, depth), distinct, each standing for the keys that begin with start.

    Intervals of one depth lie apart, and one that holds another has the smaller depth. Returns (key, start), one row for
    each interval that holds the key.
    """
    depths = [row["depth"] for row in intervals.select("depth").distinct().orderBy("depth").collect()]  # labels of a host, or rules in one another
    if not depths:
        return points.select("key", F.lit(None).cast("string").alias("start")).limit(0)
    events = points.select("key", F.lit(None).cast("int").alias("depth")).union(intervals.select("start", F.col("depth").cast("int")))
    dealt = scratch.save(events.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "events")
    opened = [F.max(F.when(F.col("depth") == d, F.col("key"))).alias(f"d{d}") for d in depths]
    left = dealt.groupBy("part").agg(*opened)  # the stack that each partition leaves, a row each
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    carried = left.selectExpr("part AS of", *(f"max(d{d}) OVER (ORDER BY part {earlier}) AS c{d}" for d in depths))
    order = "PARTITION BY part ORDER BY key, depth IS NULL ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    walked = dealt.selectExpr("*", *(f"last(if(depth = {d}, key, NULL)) IGNORE NULLS OVER ({order}) AS d{d}" for d in depths)).filter("depth IS NULL")
    stack = F.array(*(F.coalesce(f"d{d}", f"c{d}") for d in depths))
    full = walked.join(F.broadcast(carried), F.col("part") == F.col("of")).withColumn("stack", stack)
    return full.select("key", F.explode(F.filter("stack", lambda s: F.col("key").startswith(s))).alias("start"))


def _path_depths(rules: DataFrame) -> DataFrame:
    """rules (node, path, ...) with depth: how many rules of the same host begin its path, itself included."""
    begun = rules.select("node", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("k")).withColumn("begin", F.expr("substring(path, 1, k)"))
    inner = begun.join(rules.select(F.col("node").alias("n"), F.col("path").alias("p")), (F.col("node") == F.col("n")) & (F.col("begin") == F.col("p")))
    return rules.join(inner.groupBy("node", "path").agg(F.count("*").alias("depth")), ["node", "path"])


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per page: id, host, path, rule (host and path, or null), verdict."""
    host, path = host_and_path(url_col)
    rows = pages.select(F.col(f"`{id_col}`").alias(id_col), host.alias("host"), path.alias("path"))
    known = rules.groupBy(F.lower("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    known = scratch.save(_path_depths(known.withColumn("node", _key("rule_host"))), "rules")

    urls = scratch.save(rows.select("host", "path").distinct(), "urls")
    hosts = urls.select("host").distinct().withColumn("key", _key("host"))
    nodes = known.select(F.col("node").alias("start")).distinct().withColumn("depth", F.size(F.split("start", r"\.")) - 1)
    under = hosts.join(sweep(hosts.select("key"), nodes), "key").select("host", F.col("start").alias("node"))

    # the urls of hot hosts stay where they are: what those hosts lie under is a table of at most HOT times its labels rows
    many = urls.count()
    hot = scratch.save(urls.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") * HOT > many).select("host"), "hot")
    split = urls.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "host", "left")
    under = scratch.save(under, "under")
    met = split.filter("hot is null").drop("hot").join(under, "host").union(split.filter("hot").drop("hot").join(F.broadcast(under.join(F.broadcast(hot), "host", "left_semi")), "host").select("host", "path", "node"))
    tried = scratch.save(met.withColumn("key", F.concat("node", F.lit(GAP), "path")), "tried")
    spans = known.select(F.concat("node", F.lit(GAP), "path").alias("start"), "depth", "verdict", F.concat("rule_host", "path").alias("rule"), F.length("rule_host").alias("of_host"))
    fits = sweep(tried.select("key").distinct(), spans.select("start", "depth")).join(spans, "start")
    # on one host the longest path wins before the pages come back in
    fits = fits.groupBy("key").agg(F.max(F.struct(F.length("rule").alias("long"), "of_host", "rule", "verdict")).alias("best"))
    best = tried.join(fits, "key").groupBy("host", "path").agg(F.max("best").alias("best"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    out = rows.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return out.select(f"`{id_col}`", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """The pages whose verdict is allow, by their id."""
    good = judge(pages, rules, id_col, url_col, default).filter("verdict = 'allow'").select(F.col(f"`{id_col}`").alias("__id")).distinct()
    return pages.join(good, pages[f"`{id_col}`"].eqNullSafe(F.col("__id")), "left_semi")
