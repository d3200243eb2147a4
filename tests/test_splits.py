"""Records across splits: the same rows as when a file is read by one task."""

import csv
import io
import json
import random
from collections import Counter

import pytest

from slipcoach.sources import feeds, splits


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "97b" if "max" in k else "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def one_task(spark, path):
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.toDF(*(c.strip() for c in df.columns))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_cells_across_splits(spark, tmp_path, small_splits, end):
    rng = random.Random(len(end))
    cells = ["", "x", "a b", "é\U0001f389", "two\nlines", 'say ""hi""', '","', "\n\n\n", "long " * 60, "NA", " blank ", ",", '"']
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    rows = [[str(k), *(rng.choice(cells) for _ in range(3))] for k in range(300)]
    writer.writerows([["id", "b ", "c", "d"], *rows])
    (tmp_path / "f.txt").write_text(out.getvalue(), newline="")
    got = feeds._csv(spark, str(tmp_path / "f.txt"))
    assert spark.read.text(str(tmp_path / "f.txt")).rdd.getNumPartitions() > 20
    assert Counter(map(tuple, got.collect())) == Counter(tuple(x or None for x in r) for r in rows) or Counter(tuple(x or None for x in r) for r in got.collect()) == Counter(tuple(x or None for x in r) for r in rows)
    assert got.columns == ["id", "b", "c", "d"]


def test_quotes_inside_of_cells_and_bad_lines(spark, tmp_path, small_splits):
    text = 'id,v\n1,5" pipe\n2,"a"b,c\n\n3\n4,x,y\n5,"open ""\n6,"" z"\n7,""\n8,a "quoted" word\n' + "".join(f'{k},"row {k}\nsecond"\n' for k in range(9, 60))
    (tmp_path / "f.txt").write_text(text)
    rows = lambda df: Counter(tuple(x or None for x in r) for r in df.collect())
    assert rows(feeds._csv(spark, str(tmp_path / "f.txt"))) == rows(one_task(spark, str(tmp_path / "f.txt")))


def test_several_files_and_none_with_rows(spark, tmp_path, small_splits):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_text('id,v\n' + "".join(f'{k}{n},"a\n{n}"\n' for n in range(k * 20)))
    assert feeds._csv(spark, str(tmp_path / "in")).count() == 60
    (tmp_path / "e.csv").write_text("id,v\n")
    assert feeds._csv(spark, str(tmp_path / "e.csv")).count() == 0


@pytest.mark.parametrize("indent", [None, 2])
def test_one_object_across_splits(spark, tmp_path, small_splits, indent):
    rng = random.Random(3)
    values = ["x", "}", "{", "{\"a\": {", "back\\slash", "\\", "quote \" }", "é } \U0001f389", "", "line\nbreak", None]
    held = {f"id {k} }}" if k % 7 == 0 else str(k): {c: rng.choice(values) for c in "abc"[: rng.randrange(4)]} for k in range(200)}
    held["null"] = None
    (tmp_path / "trips.json").write_text(json.dumps(held, indent=indent, ensure_ascii=False))
    got = feeds.read_keyed_json(spark, str(tmp_path), ["trips"])["trips"]
    assert got.columns == ["id_from_key", "a", "b", "c"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {k: tuple((v or {}).get(c) for c in "abc") for k, v in held.items()}
    (tmp_path / "stops.json").write_text("{}")
    assert feeds.read_keyed_json(spark, str(tmp_path), ["stops"])["stops"].count() == 0


def test_tasks_grow_with_bytes(spark, tmp_path):
    row = "1,2,\"a\nb\",some words that fill a line of the file\n"
    (tmp_path / "f.txt").write_text("a,b,c,d\n" + row * 400_000)
    df = splits.records(spark, str(tmp_path / "f.txt"), splits.CSV)
    assert df.count() == 400_001
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert feeds._csv(spark, str(tmp_path / "f.txt")).rdd.getNumPartitions() > 15
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_states_by_hand():
    assert splits.csv_step('a,"b', False) == (True, 0) and splits.csv_step('b",c', True) == (False, 0)
    assert splits.csv_step('5" x,"a""', False) == (True, 0) and splits.csv_step('x"y,"z"w', False) == (False, 0) and splits.csv_step('""', True) == (True, 0)
    assert splits.json_step('{"a": {"b": "c"', False) == (False, 1) and splits.json_step('x\\"', True) == (True, 0) and splits.json_step('", "k": "{', True) == (True, 0) and splits.json_step("", False) == (False, -1)


def test_pieces_of_json_in_bulk():
    """The same as piece by piece, from outside of quotes and from inside, over any run of pieces."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    pieces = ["".join(rng.choice('{{""\\ax,:é\n') for _ in range(rng.randrange(9))) for _ in range(3000)]
    for inside in (False, True):
        after, change = splits._walk(splits.JSON, pa.array(pieces), inside)
        state, depth = inside, 0
        for k, piece in enumerate(pieces):
            state, more = splits.json_step(piece, state)
            depth += more
            assert (bool(after[k]), int(change[k])) == (state, depth), (k, piece)
    assert len(splits._walk(splits.JSON, pa.array([], pa.string()), True)[0]) == 0 and np.asarray(after).dtype == bool


def test_files_of_one_split_are_cut_once_and_parsed_once(spark, tmp_path):
    (tmp_path / "trips.json").mkdir()
    for k in range(3):
        (tmp_path / "trips.json" / f"{k}.json").write_text(json.dumps({f"{k}-{n}": {"trip_id": str(n)} for n in range(50)}))
    assert splits.records(spark, str(tmp_path / "trips.json"), splits.JSON)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    trips = feeds.read_keyed_json(spark, str(tmp_path), ["trips"])["trips"]
    assert "MapInArrow" not in trips._jdf.queryExecution().optimizedPlan().toString() and trips.count() == 150


def test_a_csv_file_of_one_split_is_cut_once(spark, tmp_path):
    (tmp_path / "f.txt").write_text('id,v\n1,"a\nb"\n2,"open')
    df = feeds._csv(spark, str(tmp_path / "f.txt"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.id, r.v) for r in df.collect()) == sorted((r.id, r.v) for r in one_task(spark, str(tmp_path / "f.txt")).collect())


def test_endpoints_are_counted_without_parsing(spark, tmp_path):
    for name in ("trips", "stops"):
        (tmp_path / f"{name}.json").write_text(json.dumps({str(n): {"a": "}"} for n in range(7)}))
    counts = feeds.endpoint_row_counts(feeds.read_keyed_json(spark, str(tmp_path)))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "from_json" not in plan and {r.endpoint: r.rows for r in counts.collect()} == {"trips": 7, "stops": 7}
