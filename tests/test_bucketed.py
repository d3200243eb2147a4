"""Bucketed tables: equal rows, no exchange by the key, and a hot key's table read as plain files."""

import re

import pytest
from pyspark.sql import functions as F

from slipcoach.operators import views
from slipcoach.plans.schemas import Tables
from slipcoach.sources import bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def tables(spark, tmp_path, train):
    operators = spark.createDataFrame([(1, "North", "ES"), (2, "South", "BE")], "operator_id long, name string, country string")
    trains = spark.range(200).select(F.col("id").alias("train_id"), (F.col("id") % 2 + 1).alias("operator_id"), F.when(F.col("id") % 3 > 0, "day").otherwise("night").alias("train_type"))
    schedules = spark.range(6_000).select(F.col("id").alias("schedule_id"), train.alias("train_id"), (F.col("id") % 90).alias("duration_min"), (F.col("id") % 70).cast("double").alias("distance_km"))
    plain = Tables(operators=operators, stations=None, trains=trains, schedules=schedules)
    made = {k: bucketed.write_bucketed(getattr(plain, k), f"bucketed_{k}", f"file://{tmp_path}/{k}", "train_id", 8) for k in ("trains", "schedules")}
    return plain, plain._replace(**made)


def test_sums_and_joins_by_train_shuffle_nothing(spark, tmp_path, no_broadcast):
    plain, made = tables(spark, tmp_path, F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 200))
    joined = views.by_train(made.schedules).join(made.trains, "train_id")
    assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
    assert "Exchange" in plan(views.by_train(plain.schedules).join(plain.trains, "train_id"))
    by_train = re.findall(r"Exchange hashpartitioning\(train_id", plan(views.v_operator_summary(made)))
    assert not by_train
    assert views.v_operator_summary(made).collect() == views.v_operator_summary(plain).collect()
    assert sorted(map(str, made.schedules.collect())) == sorted(map(str, plain.schedules.collect()))


def test_a_hot_key_is_no_single_task(spark, tmp_path, no_broadcast):
    plain, made = tables(spark, tmp_path, F.when(F.col("id") % 3 > 0, F.lit(17)).otherwise(F.col("id") % 200))
    files = made.schedules.inputFiles()
    assert len(files) > 8  # the hot bucket is written by several tasks
    rows = [r["count"] for r in made.schedules.groupBy(F.input_file_name()).count().collect()]
    assert max(rows) <= 6_000 / 8 * 3
    assert "Exchange hashpartitioning(train_id" in plan(views.by_train(made.schedules))
    assert "Exchange" not in plan(views.by_train(made.trains.withColumns({"duration_min": F.lit(1), "distance_km": F.lit(1)})))
    assert views.v_operator_summary(made).collect() == views.v_operator_summary(plain).collect()


def test_odd_tables(spark, tmp_path):
    make = lambda rows: bucketed.write_bucketed(spark.createDataFrame(rows, "`a.b` long, `Other one` string"), "bucketed_odd", f"file://{tmp_path}/odd", "a.b", 4)
    assert make([]).count() == 0
    rows = [(None, "x"), (1, None), (1, None), (2, "y")]
    assert sorted(map(tuple, make(rows).collect()), key=str) == sorted(rows, key=str)
    assert bucketed.read_bucketed(spark, "bucketed_odd").columns == ["a.b", "Other one"]
