"""Feature engineering: point-in-time sets, online views, pivots and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import ladder


def user_features(df: DataFrame, user: str, amount: str, day: str, as_of: Column, risk=(1000, 500)) -> DataFrame:
    """Transaction count, mean amount, days since the last one and a risk step on the mean."""
    out = df.groupBy(user).agg(F.count(F.lit(1)).alias("transactions"), F.avg(amount).alias("mean_amount"),
                               F.datediff(as_of, F.max(day)).alias("days_since"))
    return out.withColumn("risk", ladder([(F.col("mean_amount") > risk[0], "high"), (F.col("mean_amount") > risk[1], "medium")], "low"))


def compute_group(source: DataFrame, keys: list[str], ts: str, start=None, end=None, transforms: list[tuple[str, dict]] = (),
                  columns: list[str] | None = None) -> DataFrame:
    """A feature group: the source inside [start, end), named transforms, the declared columns."""
    from marlstone.operators.lake import run_steps
    kind = source.schema[ts].dataType
    out = source
    if start is not None:
        out = out.filter(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        out = out.filter(F.col(ts) < F.lit(end).cast(kind))
    out = run_steps(out, list(transforms))
    return out.select(*keys, ts, *columns) if columns else out


def online_view(features: DataFrame, keys: list[str], ts: str, columns: list[str], now: Column, ttl_seconds: float | None = None,
                defaults: dict | None = None) -> DataFrame:
    """Newest values per entity; values older than the time to live, and nulls, fall back to the defaults."""
    from marlstone.functions.columns import micros
    newest = features.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(ts, *columns)).alias("v"), F.max(ts).alias("feature_time"))
    fresh = F.lit(True) if ttl_seconds is None else micros(now) - micros("feature_time") <= int(ttl_seconds * 1_000_000)
    return newest.select(*keys, "feature_time", *[
        F.coalesce(F.when(fresh, F.col(f"v.{c}")), F.lit((defaults or {}).get(c))).alias(c) for c in columns])


def long_to_wide(values: DataFrame, keys: list[str], name: str, value: str, ts: str, names: list[str], at: Column | None = None) -> DataFrame:
    """Newest value per feature name at a time, one column per name."""
    v = values.filter(F.col(ts) <= at) if at is not None else values
    order = F.struct(ts, value)
    return v.groupBy(*keys).agg(*[F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, order)).alias(n) for n in names])


def numeric_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, nulls, mean, deviation, range, exact quartiles and distinct values per column."""
    from marlstone.functions.quantiles import exact_quantiles
    from marlstone.operators.quality import long_numeric
    long = long_numeric(df, columns)
    s = long.groupBy("column_name").agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.avg("value").alias("mean"),
                                        F.stddev("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.countDistinct("value").alias("distinct"))
    return s.join(exact_quantiles(long, ["column_name"], F.col("value"), {"q25": 0.25, "q50": 0.5, "q75": 0.75}, few_keys=True), "column_name", "left")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Rows per equal-width bin between the minimum and the maximum; the maximum belongs to the last bin."""
    from marlstone.functions.columns import one_row
    s = one_row(df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
    width = F.nullif((s["hi"] - s["lo"]) / bins, F.lit(0.0))
    b = F.coalesce(F.least(F.floor((F.col(column) - s["lo"]) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.filter(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def registry_search(registry: DataFrame, text: str | None = None, tags: list[str] | None = None, owner: str | None = None) -> DataFrame:
    out = registry
    if text:
        out = out.filter(F.lower(F.concat_ws(" ", "name", "description")).contains(text.lower()))
    if tags:
        out = out.filter(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags])))
    return out.filter(F.col("owner") == owner) if owner else out


def feature_popularity(usage: DataFrame, feature: str, consumer: str) -> DataFrame:
    return usage.groupBy(feature).agg(F.count(F.lit(1)).alias("uses"), F.countDistinct(consumer).alias("consumers"))


def metadata_features(df: DataFrame, maps: list[str], arrays: list[str]) -> DataFrame:
    """Number of entries of map and array columns; 0 for null."""
    sizes = {f"{c}_size": F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)) for c in [*maps, *arrays]}
    return df.withColumns(sizes)


def select_features(df: DataFrame, features: list[str], label: str, top: int) -> DataFrame:
    """Chi-square statistic of each (discrete) feature against the label, the ``top`` best marked."""
    from pyspark.sql import Window
    long = df.select(F.col(label).cast("string").alias("y"), F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("x")) for f in features])))
    cell = long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("o"))
    rows = cell.groupBy("feature", "x").agg(F.sum("o").alias("rx"))
    cols = cell.groupBy("feature", "y").agg(F.sum("o").alias("cy"))
    n = cell.groupBy("feature").agg(F.sum("o").alias("n"))
    grid = rows.join(cols, "feature").join(n, "feature").join(cell, ["feature", "x", "y"], "left")
    e = F.col("rx") * F.col("cy") / F.col("n")
    s = grid.groupBy("feature").agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - e, 2) / e).alias("statistic"),
                                    ((F.countDistinct("x") - 1) * (F.countDistinct("y") - 1)).alias("df"))
    # one row per feature is left
    return s.withColumn("selected", F.row_number().over(Window.orderBy(F.col("statistic").desc(), "feature")) <= top)


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.covar_samp(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"p{i}").alias("covariance")) for i, (a, b) in enumerate(pairs)])))
