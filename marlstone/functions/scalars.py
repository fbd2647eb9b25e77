"""Scalar function families: strings, dates, masking, bucketing, filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import clamp, col, ladder, one_row
from marlstone.operators.windows import rows_frame


def blank(c: str | Column) -> Column:
    return F.trim(col(c)) == ""


def not_finite(c: str | Column) -> Column:
    return F.isnan(col(c)) | (F.abs(col(c)) == F.lit(float("inf")))


def parse_date(c: str | Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd")) -> Column:
    return F.coalesce(*[F.try_to_date(col(c), f) for f in formats])


def tenant_of_topic(topic: str | Column) -> Column:
    """``persistent://<owner>/<tenant>/<name>`` -> tenant; null when the shape differs."""
    return F.nullif(F.regexp_extract(col(topic), r"^persistent://[^/]+/([^/]+)/", 1), F.lit(""))


def stable_id(*columns: str | Column) -> Column:
    """Deterministic id from column values, in place of a random uuid that a retry would change."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def masked(c: str | Column, method: str) -> Column:
    """mask: constant; shape: letters and digits replaced; tokenize: stable token; encrypt: tagged digest."""
    text = col(c).cast("string")
    if method == "shape":
        return F.mask(text)
    if method == "tokenize":
        return F.concat(F.lit("tok_"), F.sha2(text, 256))
    if method == "encrypt":
        return F.concat(F.lit("enc:"), F.sha2(text, 256))
    if method == "mask":
        return F.when(text.isNotNull(), F.lit("***MASKED***"))
    raise ValueError(f"unknown method {method!r}")


#: Error categories by the first matching pattern.
ERROR_PATTERNS = (
    ("timeout", "timeout|timed out"), ("connection", "connection|connect|network"),
    ("serialization", "serializ|deserializ|json|parse"), ("validation", "validat|invalid|required"),
    ("authorization", "auth|forbidden|unauthorized"), ("rate_limit", "rate|limit|throttl"),
    ("resource", "resource|memory|disk|cpu"), ("database", "database|db|sql|cassandra|mongo"),
    ("service", "service|unavailable|503"))


def error_category(message: str | Column, patterns=ERROR_PATTERNS) -> Column:
    text = F.lower(col(message))
    found = ladder([(text.rlike(p), name) for name, p in patterns], "other")
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise(found)


def one_hot(df: DataFrame, column: str, categories: list) -> DataFrame:
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in categories})


def hash_bucket(c: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(col(c)), F.lit(buckets))


def value_bucket(c: str | Column, low: float, high: float, buckets: int) -> Column:
    return F.width_bucket(col(c), F.lit(float(low)), F.lit(float(high)), F.lit(buckets))


def fill_missing(df: DataFrame, column: str, method: str, constant=None) -> DataFrame:
    """Fill by mean, median, mode or a constant, with the statistic as a scalar subquery."""
    if method == "constant":
        return df.withColumn(column, F.coalesce(F.col(column), F.lit(constant)))
    if method == "mode":
        counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        stat = counts.agg(F.max_by(F.col(column), F.struct("n", column)).alias("s")).scalar()
    elif method == "mean":
        stat = df.agg(F.avg(column).alias("s")).scalar()
    elif method == "median":
        from marlstone.functions.quantiles import exact_quantiles
        stat = exact_quantiles(df, [], F.col(column), {"s": 0.5}).scalar()
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.withColumn(column, F.coalesce(F.col(column), stat.cast(df.schema[column].dataType)))


def hash_sample(df: DataFrame, key: str | Column, fraction: float, seed: int = 42) -> DataFrame:
    """Sample by the hash of a key: the same rows on every run and every retry."""
    return df.filter(F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))
