"""Writers: modes, layout choice, compaction and export."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType

from marlstone.operators.lake import to_bronze

TARGET_BYTES = 128 * 1024 * 1024
USER_BUCKETS = 32


def write_table(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None,
                fmt: str = "parquet", max_records_per_file: int | None = None) -> None:
    """Append, overwrite or create (which fails on an existing table)."""
    writer = df.write.format(fmt).mode({"create": "errorifexists"}.get(mode, mode))
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def ingest_to_bronze(df: DataFrame, path: str, tenant: str, source: str = "dataframe",
                     partition_by: list[str] | None = None) -> DataFrame:
    out = to_bronze(df, tenant, source)
    write_table(out, path, "append", partition_by)
    return out


def choose_partitioning(schema: StructType) -> dict[str, Column]:
    """Partition columns by schema: tenant and day, else hour of a timestamp, else the date; users in buckets."""
    names = {f.name: f.dataType for f in schema.fields}
    stamps = [n for n, d in names.items() if isinstance(d, (TimestampType, TimestampNTZType))]
    dates = [n for n, d in names.items() if isinstance(d, DateType)]
    out: dict[str, Column] = {}
    if "tenant_id" in names and "created_at" in names:
        out["_day"] = F.date_format("created_at", "yyyy-MM-dd")
    elif stamps:
        out["_hour"] = F.date_format(stamps[0], "yyyy-MM-dd-HH")
    elif dates:
        out["_day"] = F.date_format(dates[0], "yyyy-MM-dd")
    if "user_id" in names:
        out["_user_bucket"] = F.pmod(F.hash("user_id"), F.lit(USER_BUCKETS))
    return out


def partition_names(schema: StructType) -> list[str]:
    cols = list(choose_partitioning(schema))
    return (["tenant_id"] if "tenant_id" in schema.names and "_day" in cols else []) + cols


def _size(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def compact(spark: SparkSession, path: str, target: str, target_bytes: int = TARGET_BYTES) -> int:
    """Rewrite small files into about ``target_bytes`` each, at a new path; returns the file count asked for.

    A task reads the files it puts together as they are, without a shuffle; only files larger than the target are dealt out by rows.
    """
    files = max(1, math.ceil(_size(spark, path) / target_bytes))
    rows = spark.read.parquet(path)
    rows = rows.coalesce(files) if rows.rdd.getNumPartitions() >= files else rows.repartition(files)
    rows.write.mode("errorifexists").parquet(target)
    return files


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result export; CSV gets a header."""
    options = {"header": True} if fmt == "csv" else {}
    df.write.format(fmt).options(**options).mode("errorifexists").save(path)
