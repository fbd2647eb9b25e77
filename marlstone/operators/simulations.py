"""Simulation runs: features of exploded agents, outcome columns, a stored pipeline and batch predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def agent_features(runs: DataFrame, keys: list[str], agents: str = "agents") -> DataFrame:
    """Per key: mean and deviation of the agents' positions, highest speed, number of agents.

    ``agents`` is an array of (id, position (x, y, z), velocity (x, y, z)). Only the parts used are read and exploded, and the sums
    are combined before the shuffle. A key whose rows have no agents counts 0 and has null features.
    """
    parts = F.transform(agents, lambda a: F.struct(a["id"].alias("id"), *[a["position"][c].cast("double").alias(c) for c in AXES],
                                                   F.sqrt(sum((F.pow(a["velocity"][c], 2) for c in AXES), F.lit(0.0))).alias("speed")))
    each = runs.select(*keys, F.explode_outer(parts).alias("a")).select(*keys, "a.*")
    return each.groupBy(*keys).agg(*[F.avg(c).alias(f"avg_pos_{c}") for c in AXES], *[F.stddev(c).alias(f"std_pos_{c}") for c in AXES],
                                   F.max("speed").alias("max_speed"), F.count("id").alias("num_agents"))


def flat_features(runs: DataFrame, keys: list[str], structs: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Named fields of struct columns as ``prefix_field``: {"parameters": ("param", ["gravity"]), ...}; fields a struct lacks are null."""
    def field(column, name):
        known = {f.name for f in runs.schema[column].dataType.fields}
        return F.col(column)[name] if name in known else F.lit(None).cast("double")
    return runs.select(*keys, *[field(c, n).alias(f"{prefix}_{n}") for c, (prefix, names) in structs.items() for n in names])


def fit_outcome(train: DataFrame, features: list[str], label: str, components: int = 0, seed: int = 42):
    """Pipeline of assembler, scaler, principal components (if asked for) and boosted trees; rows with a missing value are left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    stages = [VectorAssembler(inputCols=features, outputCol="assembled", handleInvalid="skip"), StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True)]
    if components:
        stages.append(PCA(k=components, inputCol="scaled", outputCol="components"))
    stages.append(GBTRegressor(featuresCol="components" if components else "scaled", labelCol=label, maxIter=20, maxDepth=5, seed=seed))
    return Pipeline(stages=stages).fit(train.dropna(subset=[*features, label]))


def batch_predict(spark: SparkSession, model_path: str, rows: DataFrame, output: str, keep: list[str]) -> DataFrame:
    """Predictions of a stored pipeline, written to ``output`` (a repeated run replaces them) and read back: kept columns and prediction.

    Rows the pipeline cannot score, for want of a feature, stay with a null prediction.
    """
    from pyspark.ml import PipelineModel
    model = PipelineModel.load(model_path)
    model.stages[0].setHandleInvalid("keep")  # missing values become NaN, so every row stays
    needed = model.stages[0].getInputCols()
    complete = F.lit(True)
    for c in needed:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    scored = model.transform(rows).withColumn("prediction", F.when(complete, F.col("prediction"))).select(*keep, "prediction")
    scored.write.mode("overwrite").parquet(output)
    return spark.read.schema(scored.schema).parquet(output)
