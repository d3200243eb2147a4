"""Versioned tables: ids of their own, layers over buckets, writers side by side, slices that change at once, the whole chain."""

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from slipcoach.operators import views
from slipcoach.plans import chain, schemas
from slipcoach.sources import store, versions
from tests.test_rail import feed, merged

KINDS = "k string, v int"


def upsert(spark, path, rows, **more):
    return store.write_canonical_upsert(spark.createDataFrame(rows, KINDS), path, conflict_columns=["k"], update_columns=["v"], **more)


def size_of(spark, path, rows):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return sum(at(f"{path}/data/{r.folder}").getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at(f"{path}/data/{r.folder}")).getLength() for r in rows)


def test_ids_stay_and_go_on(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = upsert(spark, path, [("b", 1), ("a", 1), (None, 1)], id_column="id")
    assert {r.k: r.id for r in first.collect()} == {None: 1, "a": 2, "b": 3}
    second = upsert(spark, path, [("c", 2), ("b", 2), ("aa", 2)], id_column="id")
    assert {r.k: (r.id, r.v) for r in second.collect()} == {None: (1, 1), "a": (2, 1), "b": (3, 2), "aa": (4, 2), "c": (5, 2)}
    assert {r.k: r.id for r in upsert(spark, path, [("c", 3), ("c", 4)], id_column="id").collect()}["c"] == 5
    assert upsert(spark, path, [], id_column="id").count() == 5
    with pytest.raises(ValueError):
        store.write_canonical_upsert(spark.createDataFrame([("x", 1)], KINDS), path, conflict_columns=["v"])


def test_known_rows_stay_without_update_columns(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write = lambda rows: store.write_canonical_upsert(spark.createDataFrame(rows, KINDS), path, conflict_columns=["k"])
    write([("a", 1)])
    assert sorted(map(tuple, write([("a", 2), ("b", 2)]).collect())) == [("a", 1), ("b", 2)]
    assert versions.latest(spark, path).number == 1 and write([("a", 3)]).count() == 2
    assert versions.latest(spark, path).number == 1  # nothing to write, no version


def test_what_is_written_follows_the_batch(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(40_000).select(F.concat(F.lit("key "), "id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    store.write_canonical_upsert(rows, path, conflict_columns=["k"], update_columns=["v"])
    base = versions.latest(spark, path).rows
    out = store.write_canonical_upsert(rows.filter("k in ('key 7', 'key 39999')").withColumn("v", F.lit("new")), path, conflict_columns=["k"], update_columns=["v"])
    added = [r for r in versions.latest(spark, path).rows if r not in base]
    assert len(added) <= 2 and size_of(spark, path, added) < 0.01 * size_of(spark, path, base)
    assert set(base) < set(versions.latest(spark, path).rows)
    assert out.count() == 40_000 and {r.k for r in out.filter("v = 'new'").collect()} == {"key 7", "key 39999"}


def test_layers_are_put_together(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in range(5):
        out = upsert(spark, path, [("a", n), (f"b{n}", n)], id_column="id", buckets=2, layers=3)
    assert {r.k: r.v for r in out.collect()} == {"a": 4} | {f"b{n}": n for n in range(5)}
    held = versions.latest(spark, path)
    assert max(Counter(r.part for r in held.rows if r.delta).values(), default=0) < 3
    before = sorted(map(tuple, out.collect()))
    store.compact(spark, path)
    assert not any(r.delta for r in versions.latest(spark, path).rows)
    versions.vacuum(spark, path, keep=1)
    assert sorted(map(tuple, store.read_table(spark, path).collect())) == before


def test_two_writers_lose_nothing(spark, tmp_path):
    path, failed = f"file://{tmp_path}/t", []
    upsert(spark, path, [("a", 0)], id_column="id")

    def write(who):
        try:
            for n in range(3):
                upsert(spark, path, [("a", n), (f"{who}{n}", n)], id_column="id")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write, args=(w,)) for w in "xyz"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    rows = store.read_table(spark, path).collect()
    assert not failed and {r.k for r in rows} == {"a"} | {f"{w}{n}" for w in "xyz" for n in range(3)}
    assert sorted(r.id for r in rows) == list(range(1, 11))  # no id twice, none left out
    assert versions.latest(spark, path).number >= 9


def test_a_version_is_made_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one = versions.Version(0, schemas.SCHEMAS["operators"].json(), ["name"], "key", 4, 1, [])
    won = []
    makers = [threading.Thread(target=lambda n=n: won.append(versions.commit(spark, path, one._replace(next_id=n)))) for n in range(8)]
    for m in makers:
        m.start()
    for m in makers:
        m.join()
    assert sorted(won) == [False] * 7 + [True]
    assert store.read_table(spark, path).count() == 0


def test_slices_change_at_once(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    make = lambda rows: spark.createDataFrame(rows, "v int, source_name string")
    store.replace_source_slice(make([(1, "x"), (2, "x"), (3, "y / é=1"), (4, None)]), path)
    held = lambda: sorted(map(tuple, store.read_table(spark, path).collect()), key=str)
    before = held()
    assert before == [(1, "x"), (2, "x"), (3, "y / é=1"), (4, None)]

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            store.replace_source_slice(make([(9, "x"), (9, "y / é=1")]), path)
    assert held() == before
    store.replace_source_slice(make([(9, "y / é=1"), (8, None)]), path)
    assert held() == [(1, "x"), (2, "x"), (8, None), (9, "y / é=1")]
    store.replace_source_slice(make([]), path)
    assert len(held()) == 4
    writers = [threading.Thread(target=store.replace_source_slice, args=(make([(n, f"s{n}")]), path)) for n in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert {r.source_name for r in store.read_table(spark, path).collect()} == {"x", "y / é=1", None, "s0", "s1", "s2", "s3"}


def test_loads_refer_to_stored_ids(spark, tmp_path):
    folder = f"file://{tmp_path}/all"
    tables = dict(zip(schemas.SCHEMAS, merged(spark), strict=True))
    # ids of the merge that no stored table has
    shifted = tables | {
        "operators": tables["operators"].withColumn("operator_id", F.col("operator_id") + 70), "stations": tables["stations"].withColumn("station_id", F.col("station_id") * -5),
        "trains": tables["trains"].withColumns({"operator_id": F.col("operator_id") + 70, "train_id": F.col("train_id") + 900}),
        "schedules": tables["schedules"].withColumns({"train_id": F.col("train_id") + 900, "origin_id": F.col("origin_id") * -5, "destination_id": F.col("destination_id") * -5}),
    }
    first = store.load_all(shifted, folder)
    assert [sorted(r[0] for r in t.select(i).collect()) for t, i in zip(first, schemas.IDS.values(), strict=True)] == [[1, 2], [1, 2, 3, 4], [1, 2, 3, 4], [1, 2]]
    names = {r.station_id: (r.name, r.country) for r in first.stations.collect()}
    assert {(names[r.origin_id], names[r.destination_id]) for r in first.schedules.collect()} == {(("A", "ES"), ("B", "ES")), (("A", "BE"), ("B", "BE"))}
    summary = [tuple(r) for r in views.v_operator_summary(first).collect()]
    assert summary == [(1, "North", "ES", 2, 1, 1, 1, 420.0, None), (2, "South", "BE", 2, 1, 1, 1, 420.0, None)] or Counter(r[3] for r in summary) == {2: 2}
    second = store.load_all(tables, folder)
    for a, b in zip(first, second, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_chain_twice(spark, tmp_path):
    for name, df in feed(spark).items():
        df.coalesce(1).write.option("header", True).csv(f"{tmp_path}/in/{name}.txt")
    run = lambda: chain.run(spark, {"renfe": (f"{tmp_path}/in", "ES")}, f"file://{tmp_path}/out")
    first = run()
    ride = first.schedules.first()
    assert first.schedules.count() == 1 and ride.duration_min == 420 and ride.distance_km == pytest.approx(111.2, abs=0.1)
    again = run()
    assert [t.count() for t in again] == [1, 2, 2, 1] and again.schedules.first().schedule_id == ride.schedule_id
    assert again.schedules.first().distance_km == ride.distance_km


def test_lookups_open_few_files(spark, tmp_path):
    path = f"file://{tmp_path}/z"
    rows = spark.range(20_000).select(F.col("id"), (F.col("id") * 7919 % 500).alias("a"), (F.col("id") * 104729 % 300).alias("b"), F.when(F.col("id") % 3 > 0, F.col("id") % 90).alias("c"))
    out = store.write_clustered(rows, path, ["a", "b"], 64)
    assert out.count() == 20_000 and sorted(out.columns) == ["a", "b", "c", "id"]
    for values in ({"a": 17}, {"b": 250}, {"a": 17, "b": 250}, {"a": 499}, {"c": 5}):
        got, want = store.lookup(spark, path, **values), rows
        for k, v in values.items():
            want = want.filter(F.col(k) == v)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    opened = lambda **values: len(store.lookup(spark, path, **values).inputFiles())
    assert len(out.inputFiles()) >= 60 and opened(a=17) <= 16 and opened(b=250) <= 16 and opened(a=17, b=250) <= 4 and opened(a=9999) == 0
    assert opened(c=5) == len(out.inputFiles())  # a column without ranges
    empty = store.write_clustered(rows.limit(0), f"file://{tmp_path}/e", ["a"], 4)
    assert empty.count() == 0 and store.lookup(spark, f"file://{tmp_path}/e", a=1).count() == 0


def test_one_layer_is_read_without_an_aggregate(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1, 1), ("a", 1, 1), ("b", 1, 1)], "k string, v int, w int")
    store.write_canonical_upsert(rows, str(tmp_path), conflict_columns=["k"], update_columns=["v"])
    out = store.write_canonical_upsert(spark.createDataFrame([(None, 2, 2), ("c", 2, 2)], "k string, v int, w int"), str(tmp_path), conflict_columns=["k"], update_columns=["v"])
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, 2, 1), ("a", 1, 1), ("b", 1, 1), ("c", 2, 2)], key=str)
