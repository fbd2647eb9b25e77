"""Versioned tables as snapshot folders with a small manifest: time travel, history, rollback, retention.

Every snapshot has a folder of its own below ``<table>/data``; ``<table>/manifest`` has one small JSON row per published version
with the name of its folder. A version counts only once its manifest row is written, so a failed write is never read. Of two
writers that publish the same number at once, the folder first in name order keeps it, and the other publishes itself anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version bigint, committed_at timestamp, operation string, source_version bigint, expired boolean, folder string, batch bigint"


def _manifest(spark: SparkSession, table: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).json(f"{table}/manifest")
    except Exception as e:  # the table does not exist yet
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], MANIFEST)
        raise


def history(spark: SparkSession, table: str) -> DataFrame:
    """Published versions, newest first; expired ones are marked."""
    m = _manifest(spark, table)
    return m.groupBy("version").agg(F.min("committed_at").alias("committed_at"), F.first("operation", ignorenulls=True).alias("operation"),
                                    F.first("source_version", ignorenulls=True).alias("source_version"), F.bool_or(F.coalesce("expired", F.lit(False))).alias("expired"),
                                    F.min("folder").alias("folder"), F.max("batch").alias("batch")) \
        .orderBy(F.col("version").desc())


def _log(spark, table, version, operation, source=None, at=None, expired=False, folder=None, batch=None):
    row = spark.range(1).select(F.lit(version).cast("bigint").alias("version"), (F.lit(at).cast("timestamp") if at else F.current_timestamp()).alias("committed_at"),
                                F.lit(operation).alias("operation"), F.lit(source).cast("bigint").alias("source_version"), F.lit(expired).alias("expired"), F.lit(folder).cast("string").alias("folder"), F.lit(batch).cast("bigint").alias("batch"))
    row.coalesce(1).write.mode("append").json(f"{table}/manifest")


def current_version(spark: SparkSession, table: str, at: str | None = None) -> int:
    """Newest version, or the newest one committed by a time; 0 for none."""
    h = history(spark, table).filter("not expired")
    if at:
        h = h.filter(F.col("committed_at") <= F.lit(at).cast("timestamp"))
    return h.agg(F.max("version").alias("v")).first()["v"] or 0


def publish(df: DataFrame, table: str, operation: str = "overwrite", at: str | None = None, batch: int | None = None) -> int:
    """Write a snapshot into a new folder and make it the current version; ``batch`` is noted in the manifest."""
    spark, folder = df.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/data/{folder}")
    while True:
        version = (_manifest(spark, table).agg(F.max("version").alias("v")).first()["v"] or 0) + 1
        _log(spark, table, version, operation, at=at, folder=folder, batch=batch)
        if history(spark, table).filter(F.col("version") == version).first()["folder"] == folder:
            return version


def read(spark: SparkSession, table: str, version: int | None = None, at: str | None = None) -> DataFrame:
    v = version or current_version(spark, table, at)
    if not v:
        raise ValueError("the table has no version at that time")
    source = history(spark, table).filter(F.col("version") == v).first()
    if source is None or source["expired"]:
        raise ValueError(f"version {v} is not readable")
    if source["source_version"]:
        source = history(spark, table).filter(F.col("version") == source["source_version"]).first()
    return spark.read.parquet(f"{table}/data/{source['folder']}")


def rollback(spark: SparkSession, table: str, version: int) -> int:
    """Make an old version current again; its snapshot is referred to, not copied."""
    row = history(spark, table).filter(F.col("version") == version).first()
    if row is None or row["expired"]:
        raise ValueError(f"version {version} is not readable")
    new = current_version(spark, table) + 1
    _log(spark, table, new, "rollback", row["source_version"] or version)
    return new


def expire(spark: SparkSession, table: str, before: str, keep: int = 3) -> list[int]:
    """Mark versions older than a time as unreadable, except the newest ``keep`` and what they refer to."""
    rows = history(spark, table).filter("not expired").collect()  # one row per version
    kept = {r["version"] for r in rows[:keep]} | {r["source_version"] for r in rows[:keep] if r["source_version"]}
    cut = spark.range(1).select(F.lit(before).cast("timestamp").alias("t")).first()["t"]
    old = [r["version"] for r in rows if r["version"] not in kept and r["committed_at"] < cut]
    for v in old:
        _log(spark, table, v, None, expired=True)
    return old
