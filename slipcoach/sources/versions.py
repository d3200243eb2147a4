"""Numbered versions of a table in a folder.

A version is a small file that lists the folders of Parquet files that make the table up. Its name is its number and it is made
only if no file of that name is there, so of two writers that both saw version n one makes n + 1 and the other starts again from
it. Readers take the highest number; a job that dies before its version is there changes nothing.

A folder of rows belongs to one part of the table (a bucket of keys, or a slice). A part has base rows, and rows that replace
those of the same key (a delta), later ones first. The store must know an exclusive way to make a file: hard links on local and
mounted folders, a rename that does not overwrite on others (HDFS has it; object stores that lack it need a committer).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPTS = 20


class Rows(NamedTuple):
    """Some rows of a part: the job's folder, the part, the folder in it, whether they replace others of their key, and their ranges.

    ranges: for some columns the least and the largest value, none of both where all are null.
    """

    job: str
    part: str
    folder: str
    delta: bool
    ranges: dict[str, list] | None = None

    def may_hold(self, values: Mapping[str, int | str]) -> bool:
        return all(held[0] is not None and held[0] <= v <= held[1] for c, v in values.items() if (held := (self.ranges or {}).get(c)))


class Version(NamedTuple):
    number: int
    schema: str
    keys: list[str]
    parts_by: str  # "key", "slice", "range"
    buckets: int
    next_id: int
    rows: list[Rows]

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, store = _store(spark, path)
    return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes the file with this text, unless it is there already."""
    at, store = _store(spark, path)
    draft = at.suffix(f".{uuid.uuid4().hex}")
    out = store.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if store.getScheme() == "file":
            whole = lambda p: spark._jvm.java.nio.file.Path.of(store.makeQualified(p).toUri().getPath(), spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0))
            spark._jvm.java.nio.file.Files.createLink(whole(at), whole(draft))
        else:
            hadoop = spark._jvm.org.apache.hadoop.fs
            hadoop.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, at, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        store.delete(draft, False)


def _file(path: str, number: int) -> str:
    return f"{path}/_versions/{number:012d}.json"


def latest(spark: SparkSession, path: str) -> Version | None:
    numbers = [int(n[:12]) for n in _names(spark, f"{path}/_versions") if len(n) == 17 and n.endswith(".json") and n[:12].isdigit()]
    if not numbers:
        return None
    at, store = _store(spark, _file(path, max(numbers)))
    stream = store.open(at)
    held = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    return Version(**held | {"number": max(numbers), "rows": [Rows(*r) for r in held["rows"]]})


def write_rows(df: DataFrame, path: str, part: str, delta: bool, dealt: bool = False) -> list[Rows]:
    """Writes df, a folder for each value of the column `part`, which is not kept in the files; makes no version.

    dealt: the rows stand in the tasks that are to write them.
    """
    job = uuid.uuid4().hex
    (df if dealt else df.hint("rebalance", F.col(part))).write.partitionBy(part).parquet(f"{path}/data/{job}")
    return [Rows(job, n.partition("=")[2], f"{job}/{n}", delta) for n in sorted(_names(df.sparkSession, f"{path}/data/{job}")) if n.startswith(f"{part}=")]


def forget(spark: SparkSession, path: str, rows: Sequence[Rows]) -> None:
    """Deletes what a lost attempt has written."""
    for job in {r.job for r in rows}:
        at, store = _store(spark, f"{path}/data/{job}")
        store.delete(at, True)


def commit(spark: SparkSession, path: str, version: Version) -> bool:
    """Makes the version if its number is still free."""
    return _create(spark, _file(path, version.number), json.dumps(version._asdict() | {"number": version.number}))


def retried(spark: SparkSession, path: str, attempt: Callable[[Version | None], tuple[Version | None, list[Rows]]]) -> Version:
    """attempt(the latest version) gives the next one, and the rows that only it needs; it is asked again when another writer was faster."""
    for _ in range(ATTEMPTS):
        before = latest(spark, path)
        after, own = attempt(before)
        if after is None:
            return before
        if commit(spark, path, after):
            return after
        forget(spark, path, own)
    raise RuntimeError(f"{path}: {ATTEMPTS} attempts, and each time another writer was faster")


def _without(base: DataFrame, replaced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base without the rows whose keys stand in replaced, as k0, k1, ..."""
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & base[f"`{k}`"].eqNullSafe(replaced[f"k{n}"])
    return base.join(replaced, same, "left_anti")


def read(spark: SparkSession, path: str, version: Version, parts: Sequence[str] | None = None, values: Mapping[str, int | str] | None = None) -> DataFrame:
    """The rows of a version, or of some of its parts; with values, what is known to hold none of them is not read."""
    held = [r for r in version.rows if (parts is None or r.part in set(parts)) and r.may_hold(values or {})]
    schema = version.struct()

    def of(rows: list[Rows]) -> DataFrame:
        return spark.read.schema(schema).parquet(*(f"{path}/data/{r.folder}" for r in rows)) if rows else spark.createDataFrame([], schema)

    base, jobs = of([r for r in held if not r.delta]), list(dict.fromkeys(r.job for r in held if r.delta))
    if not jobs:
        return base
    if len(jobs) == 1:  # an upsert writes one row a key
        new = of([r for r in held if r.delta])
        return _without(base, new.select(*(F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(version.keys))), version.keys).union(new)
    new = None
    for at, job in enumerate(jobs):
        rows = of([r for r in held if r.job == job]).select(F.lit(at).alias("at"), F.struct("*").alias("row"))
        new = rows if new is None else new.union(rows)
    # one row for each key: of the last delta that has it, else the base's
    last = new.groupBy(*(F.col(f"row.{k}").alias(f"k{n}") for n, k in enumerate(version.keys))).agg(F.max_by("row", "at").alias("row"))
    replaced = last.select(*(f"k{n}" for n in range(len(version.keys))))
    return _without(base, replaced, version.keys).union(last.select("row.*"))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes the folders that none of the last `keep` versions reads, those of unfinished writers too: run it while nobody writes."""
    numbers = sorted(int(n[:12]) for n in _names(spark, f"{path}/_versions") if len(n) == 17 and n.endswith(".json"))
    live: set[str] = set()
    for number in numbers[-keep:]:
        at, store = _store(spark, _file(path, number))
        stream = store.open(at)
        live |= {r[0] for r in json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["rows"]}
        stream.close()
    for job in set(_names(spark, f"{path}/data")) - live:
        at, store = _store(spark, f"{path}/data/{job}")
        store.delete(at, True)
