"""Exact quantiles by a bracket around the approximate ones.

``percentile`` keeps every distinct value of a group in one buffer. Here an approximate pass finds a
narrow value interval that must hold the wanted ranks, and only the rows inside it are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.columns import null_safe_join

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, probs: dict[str, float],
                    accuracy: int = ACCURACY, few_keys: bool = False) -> DataFrame:
    """One row per key with the linearly interpolated quantile ``probs[name]`` in each column ``name``.

    ``few_keys`` says that the keys are few whatever the table, such as names of columns: their brackets are broadcast and no
    row moves before the brackets have picked it.
    """
    base = df.select(*keys, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    keyed = base if keys else base.withColumn("_all", F.lit(1))
    ks = keys or ["_all"]
    eps = 3.0 / accuracy
    few = F.col("_n") * eps < 3  # too few rows for the margin to span whole ranks: order all of them
    names = list(probs)
    cuts = [c for n in names for c in (max(probs[n] - eps, 0.0), min(probs[n] + eps, 1.0))]
    sketch = keyed.groupBy(*ks).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", cuts, accuracy).alias("_cuts"))
    brackets = []
    for i, n in enumerate(names):
        low = F.when(few | F.lit(cuts[2 * i] <= 0), F.col("_min")).otherwise(F.col("_cuts")[2 * i])
        high = F.when(few | F.lit(cuts[2 * i + 1] >= 1), F.col("_max")).otherwise(F.col("_cuts")[2 * i + 1])
        brackets.append(F.struct(F.lit(n).alias("name"), low.alias("low"), high.alias("high"),
                                 (F.lit(float(probs[n])) * (F.col("_n") - 1)).alias("pos")))
    plan = sketch.select(*ks, F.array(*brackets).alias("_b"))
    if few_keys or not keys:  # a join by few keys would sort all rows in as many tasks
        plan = F.broadcast(plan)
    rows = (null_safe_join(keyed, plan, ks)
            .select(*ks, "_v", F.explode("_b").alias("_b"))
            .filter(F.col("_v") <= F.col("_b.high")))
    counted = (rows.withColumn("_v", F.when(F.col("_v") >= F.col("_b.low"), F.col("_v")))
               .groupBy(*ks, F.col("_b.name").alias("_name"), F.col("_b.pos").alias("_pos"), "_v")
               .agg(F.count(F.lit(1)).alias("_c")))
    w = Window.partitionBy(*ks, "_name", "_pos").orderBy(F.col("_v").asc_nulls_first())
    ordered = counted.withColumn("_cum", F.sum("_c").over(w))
    at = lambda rank: F.min(F.when((F.col("_cum") > rank) & F.col("_v").isNotNull(), F.col("_v")))
    picked = ordered.groupBy(*ks, "_name", "_pos").agg(
        at(F.floor("_pos")).alias("_lo"), at(F.ceil("_pos")).alias("_hi"),
        F.max(F.when(F.col("_v").isNull(), F.col("_c"))).alias("_below"))
    missed = F.col("_hi").isNull() | (F.coalesce(F.col("_below"), F.lit(0)) > F.floor("_pos"))
    value_at = F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank"))).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos")))
    out = picked.withColumn("_q", value_at.cast("double")).groupBy(*ks).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in names])
    return out if keys else out.drop("_all")
