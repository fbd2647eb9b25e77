"""Readers: files, JDBC, JSON payloads, incremental loads and several sources under one SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv", "avro")


def read_dataset(spark: SparkSession, path, fmt: str = "parquet", schema: StructType | str | None = None,
                 **options) -> DataFrame:
    """Files of one format, from any path Spark can reach (object stores included).

    Give a schema for CSV and JSON: inferring one reads the data twice. Avro needs the spark-avro package.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    if fmt == "csv":
        options = {"header": True, **({} if schema is not None else {"inferSchema": True}), **options}
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def jdbc_options(url: str, table: str | None = None, query: str | None = None, partition_column: str | None = None,
                 lower: int | None = None, upper: int | None = None, partitions: int | None = None,
                 fetch_size: int = 10_000, **extra) -> dict[str, str]:
    """Reader options; with a partition column the read runs in ``partitions`` parallel ranges."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    out = {"url": url, "fetchsize": str(fetch_size), **{k: str(v) for k, v in extra.items()}}
    if partition_column:
        if None in (lower, upper, partitions):
            raise ValueError("a partition column needs lower, upper and partitions")
        # Spark partitions only tables, so a query becomes a derived table
        out["dbtable"] = table or f"({query}) source"
        out.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                   numPartitions=str(partitions))
    elif table:
        out["dbtable"] = table
    else:
        out["query"] = query
    return out


def read_jdbc(spark: SparkSession, **config) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**config)).load()


def records_from_json(df: DataFrame, column: str, record: str) -> DataFrame:
    """Rows of a JSON payload that is a list, an object with a ``data`` list, or one record."""
    text = F.trim(F.col(column))
    as_list = F.when(text.startswith("["), F.from_json(text, f"array<{record}>"))
    wrapped = F.from_json(text, f"struct<data:array<{record}>>")["data"]
    single = F.array(F.from_json(text, record))
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(F.coalesce(as_list, wrapped, single)).alias("_r")).select(*others, "_r.*")


def incremental_load(df: DataFrame, ts_col: str, last: str | Column | None) -> DataFrame:
    """Rows newer than the stored high-water mark; the filter reaches the scan."""
    if last is None:
        return df
    mark = F.lit(last).cast(df.schema[ts_col].dataType) if isinstance(last, str) else last
    return df.filter(F.col(ts_col) > mark)


def high_water(df: DataFrame, ts_col: str) -> DataFrame:
    """The next mark, as a one-row frame to store."""
    return df.agg(F.max(ts_col).alias("last_ts"))


def federated_sql(spark: SparkSession, sources: dict[str, DataFrame], sql: str) -> DataFrame:
    """One SQL text over frames of any origin."""
    for name, df in sources.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def read_table(df: DataFrame, columns: list[str] | None = None, where: str | Column | None = None,
               limit: int | None = None) -> DataFrame:
    """Projection, predicate and limit; all three reach the scan."""
    out = df.filter(where) if where is not None else df
    out = out.select(*columns) if columns else out
    return out.limit(limit) if limit is not None else out


def read_published(spark: SparkSession, table: str, columns: list[str] | None = None, where: str | Column | None = None, limit: int | None = None,
                   version: int | None = None, as_of: str | None = None) -> DataFrame:
    """:func:`read_table` over a published table, as it is now, at a version, or as of a time."""
    from marlstone.sources import snapshots
    return read_table(snapshots.read(spark, table, version, as_of), columns, where, limit)


def graph_tables(vertices: DataFrame, edges: DataFrame, tenant: str | None = None,
                 labels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of one tenant; with labels, the vertices that have one of them and the edges between those."""
    for c in ([F.col("tenant_id") == tenant] if tenant else []):
        vertices, edges = vertices.filter(c), edges.filter(c)
    if labels:
        vertices = vertices.filter(F.col("label").isin(labels))
        for end in ("src", "dst"):
            edges = edges.join(vertices.select(F.col("id").alias("_end")).distinct(), F.col(end) == F.col("_end"), "left_semi")
    return vertices, edges


def flatten_properties(df: DataFrame, names: list[str], props: str = "props") -> DataFrame:
    """Named keys of a property map as columns."""
    return df.withColumns({n: F.col(props)[n] for n in names}).drop(props)
