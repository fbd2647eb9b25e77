"""Alerts with the history of their entity: keyed state, ordered by event time behind the watermark."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marlstone.functions.columns import ladder, micros
from marlstone.operators.windows import numbered, rows_frame
from marlstone.session import ship_package
from marlstone.streaming.jobs import timed

#: Alerts looked back at, and how close an alert of the same pattern makes a repeat.
RECENT, REPEAT_US = 10, 3_600_000_000
HOUR_US = 3_600_000_000


@contextmanager
def state_on_disk(spark: SparkSession):
    """Stream state in RocksDB, which list state and timers need; the setting of the session is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def alert_context(alerts: DataFrame, key: str, ts: str, ident: str, pattern: str) -> DataFrame:
    """Per alert: its number within the entity, the trend of the hourly counts of the ten alerts before it, and whether
    one of these has the same pattern and is less than an hour older. Order is (time, id)."""
    d = numbered(alerts.withColumn("_us", micros(ts)), [key], ts, [ident], out="total_alerts")
    d = rows_frame(d, [key], ts, [ident], lambda w: {"_recent": F.collect_list(F.struct("_us", F.col(pattern).alias("p"))).over(w.rowsBetween(-RECENT, -1))}, before=RECENT)
    hours = F.transform("_recent", lambda r: F.floor(r["_us"] / HOUR_US))
    counts = F.transform(F.array_distinct(hours), lambda h: F.size(F.filter(hours, lambda x: x == h)))
    back = lambda i: F.try_element_at(F.col("_counts"), F.lit(-i))
    repeat = F.exists("_recent", lambda r: r["p"].eqNullSafe(F.col(pattern)) & (F.col("_us") - r["_us"] < REPEAT_US))
    d = d.withColumn("_counts", counts)
    trend = ladder([((back(1) > back(2)) & (back(2) > back(3)), "INCREASING"), ((back(1) < back(2)) & (back(2) < back(3)), "DECREASING")], "STABLE")
    return d.withColumns({"trend": trend, "is_repeat": repeat, "total_alerts": F.col("total_alerts").cast("long")}).drop("_us", "_recent", "_counts")


class History(StatefulProcessor):
    """Rows wait until the watermark has passed them and are then taken in (time, id) order."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, pattern string")
        self.known = handle.getValueState("known", "n long, us array<long>, patterns array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for pdf in rows:
            names = [None if p is None or p != p else str(p) for p in pdf["pattern"]]
            self.waiting.appendList([(int(u), int(i), p) for u, i, p in zip(pdf["us"], pdf["id"], names)])
            due.add(int(pdf["us"].min()) // 1000 + 1)
            due.add(int(pdf["us"].max()) // 1000 + 1)
        for at in due:  # the first row due wakes the key, the last one ends its wait
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        if not ready:
            return
        n, us, patterns = self.known.get() if self.known.exists() else (0, [], [])
        recent = list(zip(us, patterns))
        out = []
        for u, i, p in ready:
            n += 1
            out.append((key[0], i, n, self.trend(recent), any(q == p and u - v < REPEAT_US for v, q in recent)))
            recent = [*recent, (u, p)][-RECENT:]
        self.known.update((n, [v for v, _ in recent], [q for _, q in recent]))
        self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "id", "total_alerts", "trend", "is_repeat"])

    @staticmethod
    def trend(recent) -> str:
        counts: dict[int, int] = {}
        for v, _ in recent:
            counts[v // HOUR_US] = counts.get(v // HOUR_US, 0) + 1
        last = list(counts.values())[-3:]
        if len(last) == 3 and last[0] < last[1] < last[2]:
            return "INCREASING"
        return "DECREASING" if len(last) == 3 and last[0] > last[1] > last[2] else "STABLE"

    def close(self) -> None:
        pass


def alert_context_stream(stream: DataFrame, key: str, ts: str, ident: str, pattern: str, watermark: str = "10 seconds") -> DataFrame:
    """As :func:`alert_context`, over a stream: (key, id, total_alerts, trend, is_repeat) of each alert the watermark has passed.

    Files may come in any order within the watermark; later rows are dropped. Start it inside :func:`state_on_disk`.
    The state of a key is its count, ten alerts and the rows still ahead of the watermark. Ids are whole numbers.
    """
    ship_package(stream.sparkSession)
    rows = timed(stream, ts, watermark).select(ts, F.col(key).alias("key"), micros(ts).alias("us"), F.col(ident).cast("long").alias("id"), F.col(pattern).cast("string").alias("pattern"))
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(History(), f"key {kind}, id long, total_alerts long, trend string, is_repeat boolean", "Append", "EventTime")


def graph_edges(stream: DataFrame, mapping: dict[str, tuple[str, Column, str, Column]], kind: str, ts: str) -> DataFrame:
    """Typed edges of activity events as a running table (update mode), as the edges of ``build_graph``: one row per
    (src, dst, label) with its first time and count. The state is the graph; absolute values make repeated upserts harmless."""
    edge = None
    for name, (source, src, spec, dst) in mapping.items():
        label, target = spec.split(":")
        one = F.struct(F.concat_ws(":", F.lit(source), src.cast("string")).alias("src"), F.concat_ws(":", F.lit(target), dst.cast("string")).alias("dst"), F.lit(label).alias("label"))
        edge = F.when(F.col(kind) == name, one) if edge is None else edge.when(F.col(kind) == name, one)
    rows = stream.select(edge.alias("e"), F.col(ts).alias("_ts")).filter("e is not null").select("e.*", "_ts")
    return rows.groupBy("src", "dst", "label").agg(F.min("_ts").alias("created_at"), F.count(F.lit(1)).alias("events"))
