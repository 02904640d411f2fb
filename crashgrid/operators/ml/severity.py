"""Severity model: random forest over the report features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from crashgrid import fixed_values as fv
from crashgrid.functions.bands import lookup
from crashgrid.operators.ml.features import FEATURES, GRAPH_FEATURES, record_features

MIN_ROWS, SPLIT_ROWS, TREES, SEED = 5, 10, 100, 42


@dataclass
class SeverityModel:
    model: PipelineModel
    accuracy: float
    training_samples: int
    feature_importance: list[tuple[str, float]]

    def metrics(self, spark) -> DataFrame:
        row = (self.accuracy, self.training_samples, self.feature_importance)
        return spark.createDataFrame(
            [row], "accuracy double, training_samples long, feature_importance array<struct<feature:string,importance:double>>")


def train_severity(df: DataFrame, max_depth: int = 10) -> SeverityModel:
    """Train on 80 % of the reports, balanced by class weight; accuracy is that on the others.

    Below ten reports all train the model, and there is no accuracy.
    """
    n = df.count()
    if n < MIN_ROWS:
        raise ValueError(f"need at least {MIN_ROWS} reports, got {n}")
    slot = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(5))
    train, test = (df.filter(slot != 0), df.filter(slot == 0)) if n >= SPLIT_ROWS else (df, None)
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}  # at most three classes
    total = sum(sizes.values())
    weight = lookup(F.col("label"), {k: total / (len(sizes) * c) for k, c in sizes.items()}, 1.0)
    # each row keeps its node in every tree, so that a level does not walk all trees from their roots again
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        RandomForestClassifier(
            labelCol="label", weightCol="weight", numTrees=TREES, seed=SEED, maxDepth=max_depth, cacheNodeIds=True, checkpointInterval=-1),
    ]
    model = Pipeline(stages=stages).fit(train.withColumn("weight", weight))
    hits = None
    if test is not None:
        hits = model.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    importance = zip(FEATURES, model.stages[-1].featureImportances.toArray())
    ranked = sorted(((f, round(float(v), 4)) for f, v in importance), key=lambda p: (-p[1], p[0]))
    return SeverityModel(model, None if hits is None else round(hits, 4), total, ranked)


def predict_severity(model: PipelineModel, records: DataFrame, key: str) -> DataFrame:
    """Severity of new records (date_time, cause, victims, vehicles); graph features are 0."""
    known = record_features(F.col("date_time"), F.col("cause"))
    rows = records.select(
        key, *[F.lit(0.0).alias(f) for f in GRAPH_FEATURES], F.size("victims").alias("num_victims"),
        F.size("vehicles").alias("num_vehicles"), *[c.alias(n) for n, c in known.items()])
    scored = model.transform(rows).select(key, "prediction", vector_to_array("probability").alias("_p"))
    names = F.array(*[F.lit(fv.LABEL_SEVERITY[i]) for i in sorted(fv.LABEL_SEVERITY)])
    return scored.select(
        key, lookup(F.col("prediction").cast("int"), fv.LABEL_SEVERITY, "Unknown").alias("predicted_severity"),
        F.round(F.array_max("_p"), 3).alias("confidence"),
        F.map_from_arrays(F.slice(names, 1, F.size("_p")), F.transform("_p", lambda p: F.round(p, 3))).alias("class_probabilities"))
