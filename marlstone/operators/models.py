"""Model training with pyspark.ml, evaluation, federated rounds and privacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import null_safe_join
from marlstone.operators.windows import numbered, rows_frame, running


def _assemble(features: list[str], scale: bool = False):
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    a = VectorAssembler(inputCols=features, outputCol="assembled" if scale else "features", handleInvalid="skip")
    return [a, StandardScaler(inputCol="assembled", outputCol="features", withMean=True)] if scale else [a]


def time_split(df: DataFrame, ts: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Older share for training, newer rows for the test, at one time cut."""
    from marlstone.functions.columns import micros
    cut = df.agg(F.percentile_approx(micros(ts), share, 10_000)).scalar()
    return df.filter(micros(ts) <= cut), df.filter(micros(ts) > cut)


def fit_regression(train: DataFrame, features: list[str], label: str, kind: str = "forest", folds: int = 0, seed: int = 42):
    """Forest, boosted trees or linear model; with ``folds`` a small grid is cross-validated."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    if kind == "linear":
        m = LinearRegression(featuresCol="features", labelCol=label, regParam=0.01)
        grid = ParamGridBuilder().addGrid(m.regParam, [0.01, 0.1]).build()
    elif kind == "boosted":
        m = GBTRegressor(featuresCol="features", labelCol=label, maxIter=10, maxDepth=4, seed=seed)
        grid = ParamGridBuilder().addGrid(m.maxDepth, [3, 5]).build()
    else:
        m = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=20, maxDepth=6, subsamplingRate=0.8, seed=seed)
        grid = ParamGridBuilder().addGrid(m.maxDepth, [4, 6]).build()
    p = Pipeline(stages=[*_assemble(features, kind == "linear"), m])
    if folds > 1:
        return CrossValidator(estimator=p, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, seed=seed).fit(train).bestModel
    return p.fit(train)


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight n / (2 x class size) for a 0/1 label."""
    share = df.agg(F.avg(F.col(label).cast("double"))).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))


def fit_classifier(train: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 20, seed: int = 42):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    m = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=6, seed=seed)
    if weight:
        m = m.setWeightCol(weight)
    return Pipeline(stages=[*_assemble(features), m]).fit(train)


def with_confidence(predictions: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return predictions.withColumn("confidence", F.array_max(vector_to_array("probability")))


def importances(model, features: list[str], spark) -> DataFrame:
    """Importance per feature, from the model's own vector."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def threshold_metrics(scored: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """Precision and recall at each threshold, in one aggregation."""
    rows = F.array(*[F.struct(F.lit(float(x)).alias("threshold"), (F.col(score) >= x).cast("int").alias("p")) for x in thresholds])
    d = scored.select(F.col(label).cast("int").alias("y"), F.inline(rows)).groupBy("threshold").agg(
        F.sum(F.col("p") * F.col("y")).alias("tp"), F.sum("p").alias("pp"), F.sum("y").alias("ap"))
    return d.select("threshold", (F.col("tp") / F.nullif(F.col("pp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("ap"), F.lit(0))).alias("recall"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    e = F.col(prediction) - F.col(label)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(F.var_pop(label) * F.count(label), F.lit(0.0))).alias("r2"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve: the share of (positive, negative) pairs in order, ties half, by counts per score."""
    from marlstone.operators.windows import value_slices
    c = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    one = value_slices(c.withColumn("_one", F.lit(1)), ["_one"], "s")
    run = running(one, ["_one"], "s", [], {"below": ("sum", F.col("n"))}, include_current=False, slice_by=F.col("_cut"))
    good = F.sum(F.col("p") * (F.coalesce("below", F.lit(0)) + F.col("n") / 2))
    return run.agg((good / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


# -- federated rounds ---------------------------------------------------------------------------------------

def federated_average(updates: DataFrame, participant: str, name: str, vector: str, samples: str, previous: DataFrame | None = None,
                      mu: float = 0.0, expected: int | None = None, quorum: float = 0.8) -> DataFrame:
    """Sample-weighted mean of the parameter vectors by (name, position); optionally blended with the last round.

    A round counts once ``quorum`` of the expected participants have sent their update, else it yields no row.
    """
    flat = updates.select(participant, name, samples, F.posexplode(vector).alias("i", "w"))
    mean = flat.groupBy(name, "i").agg((F.sum(F.col("w") * F.col(samples)) / F.sum(samples)).alias("w"))
    if previous is not None and mu:
        old = previous.select(name, F.posexplode(vector).alias("i", "_old"))
        mean = mean.join(old, [name, "i"], "left").withColumn("w", F.coalesce((1 - mu) * F.col("w") + mu * F.col("_old"), F.col("w"))).drop("_old")
    if expected is not None:
        seen = updates.agg(F.countDistinct(participant)).scalar()
        mean = mean.filter(seen >= quorum * expected)
    return mean.groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias(vector))


def round_convergence(current: DataFrame, previous: DataFrame, name: str, vector: str) -> DataFrame:
    """L2 distance of two rounds, relative to the norm of the previous one, and 1 / (1 + distance)."""
    a = current.select(name, F.posexplode(vector).alias("i", "x"))
    b = previous.select(name, F.posexplode(vector).alias("i", "y"))
    d = a.join(b, [name, "i"]).agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("distance"), F.sqrt(F.sum(F.pow("y", 2))).alias("_n"))
    rel = F.col("distance") / F.nullif(F.col("_n"), F.lit(0.0))
    return d.select("distance", rel.alias("relative_change"), (1 / (1 + F.coalesce(rel, F.col("distance")))).alias("convergence"))


def _uniform(ident: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id only: the same after a retry."""
    return (F.pmod(F.xxhash64(ident, F.lit(seed)), F.lit(2 ** 40)) + 0.5) / float(2 ** 40)


def laplace_noise(df: DataFrame, ident: str, bounds: dict[str, tuple[float, float]], epsilon: float, seed: int = 42) -> DataFrame:
    """Values clipped to their bounds plus Laplace noise of scale (high - low) / epsilon."""
    out = {}
    for k, (c, (lo, hi)) in enumerate(sorted(bounds.items())):
        u = _uniform(F.col(ident), seed + k) - 0.5
        noise = -((hi - lo) / epsilon) * F.signum(u) * F.log(1 - 2 * F.abs(u))
        out[c] = F.greatest(F.least(F.col(c), F.lit(float(hi))), F.lit(float(lo))) + noise
    return df.withColumns(out)


def secret_shares(df: DataFrame, ident: str, value: str, parties: int, spread: float = 1000.0, seed: int = 42) -> DataFrame:
    """One share per party; all but the last depend on the id's hash, the last one completes the sum."""
    first = [(2 * _uniform(F.col(ident), seed + i) - 1) * spread for i in range(parties - 1)]
    last = F.col(value)
    for s in first:
        last = last - s
    rows = F.array(*[F.struct(F.lit(i).alias("party"), s.alias("share")) for i, s in enumerate([*first, last])])
    return df.select(ident, F.inline(rows))


# -- retraining ---------------------------------------------------------------------------------------------

def retrain_triggers(predictions: DataFrame, model: str, ts: str, ident: str, correct: Column, every: int = 100, low: float = 0.8, high: float = 0.7) -> DataFrame:
    """At each ``every`` labelled predictions: the accuracy so far, when below 0.8 (HIGH below 0.7)."""
    d = numbered(predictions, [model], ts, [ident])
    d = running(d, [model], ts, [ident], {"_ok": ("sum", correct.cast("int"))})
    acc = F.col("_ok") / F.col("_rn")
    return d.filter((F.col("_rn") % every == 0) & (acc < low)).select(
        model, F.col("_rn").alias("labelled"), acc.alias("accuracy"), F.when(acc < high, "HIGH").otherwise("MEDIUM").alias("priority"))


def simulation_triggers(steps: DataFrame, key: str, ts: str, ident: str, convergence: str, stability: str, min_steps: int = 500,
                        cooldown_seconds: float = 3600, every: int = 10_000) -> DataFrame:
    """Steps that call for retraining: at least 500 steps, poor convergence or stability or every 10,000, one an hour."""
    from marlstone.operators.folds import cooldown
    d = numbered(steps, [key], ts, [ident])
    poor = (F.col(convergence) < 0.3) | (F.col(stability) < 0.5) | (F.col("_rn") % every == 0)
    able = d.filter((F.col("_rn") >= min_steps) & poor).withColumnRenamed("_rn", "step")
    return cooldown(able, [key], ts, ident, cooldown_seconds).filter("accepted").drop("accepted")


def load_forecast(df: DataFrame, service: str, ts: str, value: str, ahead: int = 6, lags: int = 5, min_points: int = 100, seed: int = 42) -> DataFrame:
    """Value ``ahead`` rows later per service by one forest over all services, from lags and time of day."""
    counts = df.groupBy(service).agg(F.count(F.lit(1)).alias("_n"))
    d = null_safe_join(df, counts, [service]).filter(F.col("_n") >= min_points).drop("_n")
    d = rows_frame(d, [service], ts, [], lambda w: {
        **{f"lag_{i}": F.lag(value, i).over(w) for i in range(1, lags + 1)}, "mean_5": F.avg(value).over(w.rowsBetween(-4, 0)),
        "target": F.lead(value, ahead).over(w)}, before=lags, after=ahead, slice_seconds=30 * 86_400)
    d = d.withColumns({"hour": F.hour(ts), "weekday": F.dayofweek(ts)}).dropna(subset=[f"lag_{i}" for i in range(1, lags + 1)])
    features = [value, *[f"lag_{i}" for i in range(1, lags + 1)], "mean_5", "hour", "weekday"]
    model = fit_regression(d.filter("target is not null"), features, "target", seed=seed)
    return model.transform(d.filter("target is null")).select(service, ts, F.col("prediction").alias("forecast"))
