"""Stream sources with declared schemas, and a run over what is there now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from marlstone.operators.windows import latest
from marlstone.session import scratch


def file_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", max_files: int | None = None,
                **options) -> DataFrame:
    """Files of a folder as a stream; a schema must be given, so that no batch has to infer one."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def kafka_options(servers: str, topics: list[str], starting: str = "earliest", max_offsets: int | None = None) -> dict[str, str]:
    """Options of a topic stream (needs the Kafka connector on the class path)."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": starting, "failOnDataLoss": "true"}
    return {**out, "maxOffsetsPerTrigger": str(max_offsets)} if max_offsets else out


def topic_stream(spark: SparkSession, servers: str, topics: list[str], record: str, **options) -> DataFrame:
    """JSON records of topics, parsed to the declared record type."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topics, **options)).load()
    return raw.select("topic", F.from_json(F.col("value").cast("string"), record).alias("r")).select("topic", "r.*")


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Process everything that is there in micro-batches and stop; a restart goes on after the last finished batch."""
    checkpoint = checkpoint or scratch(stream.sparkSession, "stream")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch overwrites its own folder, so a repeated batch leaves the same rows (exactly once)."""
    return lambda df, batch: df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def collected(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, checkpoint: str | None = None) -> DataFrame:
    """Rows a stream has written; with ``keys`` only the newest row per key (update mode)."""
    spark = stream.sparkSession
    path = scratch(spark, "sink")
    schema = stream.schema
    run_available(stream, batch_writer(path), mode, checkpoint)
    out = spark.read.schema(StructType([*schema.fields]).add("_batch", IntegerType())).parquet(path + "/batch=*")
    return (latest(out, keys, [F.col("_batch").desc()]) if keys else out).drop("_batch")
