"""The classifier's model support and its validation, with Spark ML random forests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipcoach.functions.timetable import night_minutes
from slipcoach.plans import shared
from slipcoach.plans.schemas import BERTH_WORDS, NIGHT_WORDS, SLEEPER_TYPE, Tables

FEATURES = ("duration_hours", "night_percentage", "departure_hour", "arrival_hour", "overnight_flag", "has_couchette", "has_sleeper", "is_sleeper_route", "has_keyword_night")
MIN_ROWS, MIN_BY_CLASS = 30, 10
SIMPLE = ("duration_hours", "night_percentage", "has_couchette")


def ml_features(trips: DataFrame) -> DataFrame:
    """Adds the nine features, null as 0, to trips with metrics and metadata_text."""
    says = lambda words: sum((F.col("metadata_text").contains(w).cast("int") for w in words), F.lit(0)) > 0
    berth, sleeper = says(BERTH_WORDS), F.coalesce(F.col("route_type").try_cast("double") == SLEEPER_TYPE, F.lit(False))
    flags = {"f_has_couchette": berth, "f_has_sleeper": sleeper | berth, "f_is_sleeper_route": sleeper, "f_has_keyword_night": says(NIGHT_WORDS)}
    numbers = {f"f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES[:5]}
    return trips.withColumns(numbers | {k: v.cast("double") for k, v in flags.items()})


def _vector(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(df)


def ml_support_fit(trips: DataFrame) -> RandomForestClassificationModel | None:
    """A forest on rule labels, else heuristic ones; none with too few rows, one class, or a class with too few."""
    labelled = ml_features(trips).withColumn("target", F.coalesce("train_type_rule", "train_type_heuristic")).filter("target is not null")
    counts = {r["target"]: r["n"] for r in labelled.groupBy("target").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(counts.values())
    if len(counts) < 2 or total < MIN_ROWS or min(counts.values()) < MIN_BY_CLASS:
        return None
    weight = F.when(F.col("target") == "night", total / (2.0 * counts["night"])).otherwise(total / (2.0 * counts["day"]))
    rows = _vector(labelled.withColumns({"label": (F.col("target") == "night").cast("double"), "weight": weight}), tuple(f"f_{c}" for c in FEATURES))
    return RandomForestClassifier(numTrees=200, minInstancesPerNode=2, weightCol="weight", seed=42, maxDepth=8).fit(rows.select("features", "label", "weight"))


def ml_support_predict(trips: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Adds train_type_ml and ml_night_probability (four digits), null without a model."""
    if model is None:
        return trips.withColumns({"train_type_ml": F.lit(None).cast("string"), "ml_night_probability": F.lit(None).cast("double")})
    rows = model.transform(_vector(ml_features(trips), tuple(f"f_{c}" for c in FEATURES)))
    p = vector_to_array("probability")[1]
    out = rows.withColumns({"ml_night_probability": F.bround(p, 4), "train_type_ml": F.when(p >= 0.5, "night").otherwise("day")})
    return out.drop("features", "rawPrediction", "probability", "prediction", *(f"f_{c}" for c in FEATURES))


def support(trips: DataFrame) -> DataFrame:
    """The trips are saved, for counting, fitting and predicting read them again and again."""
    trips = shared.save(trips, "evidence")
    return ml_support_predict(trips, ml_support_fit(trips))


def ml_dataset(t: Tables) -> DataFrame:
    """Trains with schedules: durations, departure hour and a couchette flag."""
    flag = F.coalesce(F.col("category").ilike("%couchette%") | F.col("category").ilike("%sleeper%"), F.lit(False)).cast("int")
    rides = t.schedules.filter("duration_min is not null").select("train_id", "duration_min", "distance_km", F.hour("departure_time").alias("departure_hour"))
    return rides.join(t.trains.select("train_id", "train_type", "category", flag.alias("has_couchette")), "train_id")


def night_pct_hourly(df: DataFrame) -> DataFrame:
    """Adds duration_hours and night_percentage, counted from the whole departure hour."""
    minutes = F.col("duration_min").cast("double")
    share = F.coalesce(F.when(minutes > 0, night_minutes(F.col("departure_hour") * 60, minutes) * 100.0 / minutes), F.lit(0.0))
    return df.withColumns({"duration_hours": minutes / 60, "night_percentage": share})


def _simple(df: DataFrame) -> DataFrame:
    rows = night_pct_hourly(df).na.fill(0.0, ["duration_hours", "night_percentage"])
    return _vector(rows.withColumn("label", (F.col("train_type") == "night").cast("double")), SIMPLE)


class Forest(NamedTuple):
    """Trees grown one by one; like a forest of Spark's, it takes the mean of their leaves' shares, and of their importances."""

    trees: list[RandomForestClassificationModel]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for k, tree in enumerate(self.trees):
            out = tree.copy().setProbabilityCol(f"__p{k}").setRawPredictionCol("").setPredictionCol("").transform(out)
        night = sum((vector_to_array(f"__p{k}")[1] for k in range(len(self.trees))), F.lit(0.0)) / len(self.trees)
        return out.withColumn("prediction", (night > 0.5).cast("double")).drop(*(f"__p{k}" for k in range(len(self.trees))))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  as Spark's models name it
        return DenseVector(np.mean([tree.featureImportances.toArray() for tree in self.trees], axis=0))


#: Trees that are grown side by side.
SIDE_BY_SIDE = 8


def forest(groups: DataFrame, by: Sequence[str], trees: int, seed: int) -> Forest:
    """A forest on groups of equal rows: how often each of the n rows of a group is in a tree's bootstrap is a draw from Poisson(1), and their sum one from Poisson(n).

    A tree sees each group once, with its draw as the weight. The draws hang on seed, group and tree alone. Rides have whole
    minutes and hours, so there are at most as many groups as minutes and hours go together, whatever the rows.
    """
    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(drawn=[np.random.default_rng((seed, key)).poisson(n, trees).tolist() for key, n in zip(frame["key"], frame["n"], strict=True)])

    keyed = groups.withColumn("key", F.pmod(F.xxhash64(*by), F.lit(1 << 62)))
    rows = _simple(keyed.mapInPandas(drawn, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in keyed.schema)}, drawn array<int>")).select("features", "label", "drawn").persist()

    # a bootstrap may miss a class, so its label says that there are two
    label = F.col("label").alias("label", metadata={"ml_attr": {"type": "nominal", "name": "label", "vals": ["day", "night"]}})

    def grow(k: int) -> RandomForestClassificationModel:
        own = rows.select("features", label, F.col("drawn")[k].cast("double").alias("weight")).filter("weight > 0")
        return RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed + k).fit(own)

    with ThreadPool(SIDE_BY_SIDE) as pool:
        grown = pool.map(inheritable_thread_target(rows.sparkSession)(grow), range(trees))
    rows.unpersist()
    return Forest(grown)


def ml_validate(t: Tables, trees: int = 100, test_share: float = 0.2, seed: int = 42) -> tuple[Forest, DataFrame, DataFrame]:
    """(model, metrics by class, importances) of a forest on four fifths of each class.

    The rows of a class with the least hashes are its test rows: the class's own quantile of the hashes is the border. Rows
    that are equal in class and features are a group, counted once; all that follows works on groups.
    """
    by = ("train_type", "duration_min", "departure_hour", "has_couchette")
    draw = F.pmod(F.xxhash64(F.lit(seed), "train_id", "duration_min", "distance_km", "departure_hour"), F.lit(1 << 30)) / float(1 << 30)
    dealt = shared.save(ml_dataset(t).select(*by, draw.alias("draw")), "dealt")
    night = (F.col("train_type") == "night").cast("double")
    border = dealt.groupBy(night.alias("of")).agg(F.percentile_approx("draw", test_share, 10_000).alias("border"))  # a row a class
    dealt = dealt.join(F.broadcast(border), night == F.col("of"))
    groups = shared.save(dealt.groupBy(*by, (F.col("draw") < F.col("border")).alias("test")).agg(F.count("*").alias("n")), "groups")
    model = forest(groups.filter("not test"), by, trees, seed)
    pairs = model.transform(_simple(groups.filter("test"))).groupBy("label", "prediction").agg(F.sum("n").alias("n"))
    return model, class_metrics(pairs), importances(model, groups)


def class_metrics(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, and the confusion counts, from (label, prediction, n)."""
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    parts = []
    for value, name in ((0.0, "day"), (1.0, "night")):
        is_, said = F.col("label") == value, F.col("prediction") == value
        parts.append(pairs.agg(count(is_ & said).alias("hit"), count(is_ & ~said).alias("missed"), count(~is_ & said).alias("wrong")).select(F.lit(name).alias("train_type"), "*"))
    out = parts[0].union(parts[1])
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0))
    out = out.withColumns({"precision": share("hit", "wrong"), "recall": share("hit", "missed"), "support": F.col("hit") + F.col("missed")})
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def importances(model: RandomForestClassificationModel | Forest, like: DataFrame, names: tuple[str, ...] = SIMPLE) -> DataFrame:
    values = [float(x) for x in model.featureImportances.toArray()]
    return like.sparkSession.createDataFrame(list(zip(names, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"))


def ml_validate_known_night(t: Tables, model: Forest, source: str = "back_on_track", limit: int = 100) -> DataFrame:
    """How many of at most `limit` rides of the night catalogue the model calls night."""
    known = ml_dataset(t).join(t.trains.filter(F.col("source_name").contains(source)).select("train_id"), "train_id", "left_semi").orderBy("train_id", "departure_hour").limit(limit)
    out = model.transform(_simple(known.withColumn("has_couchette", F.lit(1))))
    out = out.agg(F.count("*").alias("tested"), F.coalesce(F.sum("prediction"), F.lit(0.0)).cast("long").alias("night"))
    return out.withColumn("night_pct", F.coalesce(F.bround(F.col("night") * 100.0 / F.nullif("tested", F.lit(0)), 1), F.lit(0.0)))
