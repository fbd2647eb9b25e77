"""Change capture: a snapshot and then changes for several tables of one log, polled sources, streams into bronze, late rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from marlstone.operators.lake import to_bronze
from marlstone.session import scratch
from marlstone.sources import snapshots


# -- several tables from one log ------------------------------------------------------------------------------

def take_snapshot(tables: dict[str, tuple[DataFrame, list[str]]], root: str, position: int) -> None:
    """Publish the first version of each captured table: its rows as of log position ``position``."""
    for name, (df, _) in tables.items():
        snapshots.publish(df.withColumns({"_position": F.lit(position).cast("long"), "_deleted": F.lit(False)}), f"{root}/{name}", "snapshot")


def capture_writer(root: str, tables: dict[str, tuple[str, list[str]]]) -> Callable[[DataFrame, int], None]:
    """A batch of change rows (``table``, ``op``, ``position``, ``before`` and ``after`` as JSON) merged into the published tables.

    ``tables`` has the columns (DDL) and the keys of each table; rows of other tables are left out. Every row of a table knows
    the log position it is from, a deleted key stays as a marked row, and only a later position replaces it. So changes that the
    snapshot already holds, repeated files, repeated batches and late changes leave the table as it is. What a key was deleted or
    changed to before the snapshot is left out by the position of the table's first version.
    """
    def write(df: DataFrame, batch: int) -> None:
        spark, kept = df.sparkSession, df.filter(F.col("table").isin(*tables)).persist()
        try:
            present = {r["table"] for r in kept.select("table").distinct().collect()}  # one row per captured table at most
            for name in sorted(present):
                columns, keys = tables[name]
                merge_changes(spark, kept.filter(F.col("table") == name), f"{root}/{name}", columns, keys, batch)
        finally:
            kept.unpersist()
    return write


def merge_changes(spark: SparkSession, changes: DataFrame, table: str, columns: str, keys: list[str], batch: int) -> None:
    deleted = F.col("op") == "DELETE"
    row = F.from_json(F.when(deleted, F.col("before")).otherwise(F.col("after")), columns)
    flat = changes.select(F.col("position").cast("long").alias("_position"), deleted.alias("_deleted"), row.alias("r")).select("r.*", "_position", "_deleted")
    version = snapshots.current_version(spark, table)
    old = snapshots.read(spark, table, version) if version else None
    if old is not None:
        first = snapshots.history(spark, table).filter("operation = 'snapshot'").first()
        if first is not None:
            start = spark.read.parquet(f"{table}/data/{first['folder']}").agg(F.max("_position")).first()[0]
            flat = flat.filter(F.col("_position") > F.lit(start if start is not None else -1))
        flat = flat.unionByName(old)
    rest = [c for c in flat.columns if c not in keys]
    # The key of a state row and of its changes: of equal positions either, they are the same change.
    state = flat.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_position").alias("s")).select(*keys, "s.*")
    snapshots.publish(state, table, "changes", batch=batch)


def captured(spark: SparkSession, root: str, name: str, version: int | None = None, at: str | None = None) -> DataFrame:
    """The rows of a captured table, without deleted ones; ``version`` or ``at`` read an earlier state."""
    return snapshots.read(spark, f"{root}/{name}", version, at).filter(~F.col("_deleted")).drop("_deleted", "_position")


# -- polling --------------------------------------------------------------------------------------------------

POLLS = "poll long, mark string"


def poll(spark: SparkSession, read: Callable[[], DataFrame], modified: str, sink: str, state: str, settle: str = "0 seconds") -> int | None:
    """Write the rows changed since the last poll to ``<sink>/poll=<n>`` and note the new mark in ``state``; gives n, or None without news.

    The mark is the newest ``modified`` that was taken, less ``settle`` for rows that become visible late. A poll that breaks off before
    its mark is noted is done again with the same number and overwrites its folder, so every change arrives once.
    """
    done = marks(spark, state).agg(F.max_by("mark", "poll").alias("mark"), F.max("poll").alias("poll")).first()
    df = read()
    kind = df.schema[modified].dataType
    new = df.filter(F.col(modified) > F.lit(done["mark"]).cast(kind)) if done["mark"] is not None else df.filter(F.col(modified).isNotNull())
    upto = new.agg((F.max(modified) - F.expr(f"interval {settle}")).cast(kind).cast("string").alias("m")).first()["m"]
    if upto is None or done["mark"] is not None and new.filter(F.col(modified) <= F.lit(upto).cast(kind)).isEmpty():
        return None
    number = (done["poll"] or 0) + 1
    new.filter(F.col(modified) <= F.lit(upto).cast(kind)).write.mode("overwrite").parquet(f"{sink}/poll={number}")
    spark.range(1).select(F.lit(number).cast("long").alias("poll"), F.lit(upto).alias("mark")).coalesce(1).write.mode("append").json(state)
    return number


def marks(spark: SparkSession, state: str) -> DataFrame:
    try:
        return spark.read.schema(POLLS).json(state)
    except Exception as e:  # nothing has been polled yet
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], POLLS)
        raise


def poll_every(spark: SparkSession, read: Callable[[], DataFrame], modified: str, sink: str, state: str, seconds: float, polls: int, **options) -> list[int | None]:
    """``polls`` polls, ``seconds`` apart."""
    out = []
    for k in range(polls):
        if k:
            time.sleep(seconds)
        out.append(poll(spark, read, modified, sink, state, **options))
    return out


# -- bronze ---------------------------------------------------------------------------------------------------

def bronze_writer(path: str, tenant: str, source: str, partition_by: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """Micro-batches into bronze with metadata and record hash; a repeated batch overwrites its folder. How large a batch gets is
    up to the source (files or offsets per trigger), how long it waits up to the trigger."""
    def write(df: DataFrame, batch: int) -> None:
        writer = to_bronze(df, tenant, source).write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/batch={batch}")
    return write


def stream_to_bronze(stream: DataFrame, path: str, tenant: str, source: str, checkpoint: str, seconds: int | None = 60, partition_by: list[str] | None = None):
    """Start the stream with a batch every ``seconds``, or over what is there now and then stop (None); gives the running query."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(bronze_writer(path, tenant, source, partition_by))
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


# -- late rows ------------------------------------------------------------------------------------------------

class LateRows(StreamingQueryListener):
    """Rows that the watermark dropped, by name of the query, from the progress of its stateful operators.

    Exact for operators that see rows one by one (deduplication, keyed state, joins); windowed aggregations count groups that were
    already added up within a task.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.dropped[p.name] = self.dropped.get(p.name, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def run_counting_late(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> int:
    """As :func:`run_available`, giving the number of rows that came too late."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch(spark, "stream")
    listener, name = LateRows(), scratch(spark, "late").rsplit("/", 1)[1].replace("-", "_")
    spark.streams.addListener(listener)
    try:
        q = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
        q.awaitTermination()
        seen = {p.batchId: sum(s.numRowsDroppedByWatermark for s in p.stateOperators) for p in q.recentProgress}
        deadline = time.time() + 10  # progress reaches listeners a moment later
        while listener.dropped.get(name, 0) < sum(seen.values()) and time.time() < deadline:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(listener)
    return listener.dropped.get(name, 0)
