"""Streaming operators: stream in, stream out; the batch operators of the same meaning are their twins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import micros
from marlstone.operators.cep import Pattern
from marlstone.session import ship_package

#: How far events may be out of order.
LATENESS = {"activity": "5 seconds", "pattern": "10 seconds"}


def timed(stream: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Event time as a timestamp with its watermark (a watermark needs the type with a time zone)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def windowed(stream: DataFrame, ts: str, keys: list[str], window: str, aggs: list[Column], watermark: str = "10 seconds",
             slide: str | None = None) -> DataFrame:
    """Event-time windows, tumbling or sliding; rows later than the watermark are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    g = timed(stream, ts, watermark).groupBy(w.alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in g.columns if c != "w"])


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str, aggs: list[Column], watermark: str = "10 seconds") -> DataFrame:
    g = timed(stream, ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in g.columns if c != "w"])


def arrival_windows(stream: DataFrame, keys: list[str], window: str, aggs: list[Column]) -> DataFrame:
    """Windows over the arrival time of the micro-batch instead of the event time."""
    arrived = stream.withColumn("_arrived", F.current_timestamp())
    return windowed(arrived, "_arrived", keys, window, aggs, "0 seconds")


def deduplicated(stream: DataFrame, ident: list[str], ts: str, watermark: str = "10 seconds") -> DataFrame:
    """One row per id; ids are forgotten once the watermark has passed them."""
    return timed(stream, ts, watermark).dropDuplicatesWithinWatermark(ident)


def interval_joined(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, seconds: float,
                    watermark: str = "10 seconds") -> DataFrame:
    """Stream-stream join within +/- ``seconds``; both watermarks bound the state."""
    r = timed(right, right_ts, watermark).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    span = F.make_dt_interval(secs=F.lit(float(seconds)))
    on = (F.col(right_ts) >= F.col(left_ts) - span) & (F.col(right_ts) <= F.col(left_ts) + span)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return timed(left, left_ts, watermark).join(r, on).drop(*[f"_r_{k}" for k in keys])


def enriched(stream: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Stream-static join; a file table is listed anew in every micro-batch."""
    return stream.join(table, keys, how)


def unified_activity(sources: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Several streams in one schema, with the partition columns of the lake.

    ``sources[name] = (stream, {tenant_id, event_timestamp, event_id, user_id, event_type, entity_type, entity_id, details})``.
    """
    names = ("tenant_id", "event_timestamp", "event_id", "user_id", "event_type", "entity_type", "entity_id", "details")
    out = None
    for source, (df, columns) in sources.items():
        one = df.select(F.lit(source).alias("event_source"), *[columns[n].alias(n) for n in names])
        out = one if out is None else out.unionByName(one)
    t = F.col("event_timestamp")
    return out.withColumns({"year": F.date_format(t, "yyyy"), "month": F.date_format(t, "MM"), "day": F.date_format(t, "dd"), "hour": F.date_format(t, "HH")})


def lake_writer(path: str, hot: str | None = None, max_records: int = 1_000_000,
                by: tuple[str, ...] = ("tenant_id", "year", "month", "day", "hour")):
    """Cold path partitioned by tenant and hour, and optionally the same batch for fast reads (fan-out).

    The rebalance hint gathers the rows of a partition folder and splits a large one.
    """
    def write(df: DataFrame, batch: int) -> None:
        kept = df.persist()
        try:
            kept.hint("rebalance", *by).write.mode("overwrite").option("maxRecordsPerFile", max_records).partitionBy(*by).parquet(f"{path}/batch={batch}")
            if hot:
                kept.write.mode("overwrite").parquet(f"{hot}/batch={batch}")
        finally:
            kept.unpersist()
    return write


def upsert_writer(path: str, keys: list[str], order: list[str]):
    """Keep a keyed table up to date: each batch merges into the newest published snapshot and is published as the next one.

    Only a table without any version starts from the batch alone; every other error ends the stream. A repeated batch merges the
    same rows once more, which changes nothing, and a new stream on an old table goes on from what the table holds.
    """
    def write(df: DataFrame, batch: int) -> None:
        from marlstone.operators.merge import upsert
        from marlstone.sources import snapshots
        rest = [c for c in df.columns if c not in keys]
        new = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(*keys, "s.*")
        version = snapshots.current_version(df.sparkSession, path)
        if version:
            old = snapshots.read(df.sparkSession, path, version)
            kinds = {f.name: f.dataType for f in old.schema.fields}
            changed = [f.name for f in new.schema.fields if f.name in kinds and f.dataType != kinds[f.name]]
            if changed:
                raise ValueError(f"the type of {changed} differs from the table's")
            new = upsert(old, new, keys)
        snapshots.publish(new, path, "upsert", batch=batch)
    return write


def routed_writer(path: str, routes: dict[str, str]):
    """Side outputs: every route takes the rows of its condition into its own folder."""
    def write(df: DataFrame, batch: int) -> None:
        kept = df.persist()
        try:
            for name, condition in routes.items():
                kept.filter(condition).write.mode("overwrite").parquet(f"{path}/route={name}/batch={batch}")
        finally:
            kept.unpersist()
    return write


def threshold_alerts(stream: DataFrame, value: str, limit: float) -> DataFrame:
    return stream.filter(F.col(value) > limit).withColumn("alert", F.lit(f"{value} above {limit}"))


def scores(stream: DataFrame, entity: str, ident: str, impact: Column, start: float = 0.5, alpha: float = 0.1) -> DataFrame:
    """Trust score after each event, the score being the keyed state. Rows of a batch are taken in time order."""
    t = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    rows = stream.select(entity, F.col(ident).alias("_id"), micros("ts").alias("_us"), impact.cast("double").alias("_impact"))

    def update(key, batches: Iterator[pd.DataFrame], state):
        pdf = pd.concat(list(batches)).sort_values(["_us", "_id"])
        s = state.get[0] if state.exists else start
        out = []
        for i in pdf["_impact"]:
            s = s + alpha * i * ((1 - s) if i > 0 else s)
            out.append(s)
        state.update((s,))
        yield pd.DataFrame({entity: key[0], ident: pdf["_id"].to_numpy(), "trust_score": out})

    return rows.groupBy(entity).applyInPandasWithState(update, f"{entity} {t[entity]}, {ident} {t[ident]}, trust_score double", "score double", "append", "NoTimeout")


def position_risk(stream: DataFrame, market: str, ident: str) -> DataFrame:
    """Connected streams by a tag: positions (tag 0) set the state of a market, trades (tag 1) are judged against it."""
    t = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def update(key, batches, state):
        pdf = pd.concat(list(batches)).sort_values(["us", "tag", ident])
        position, entry = state.get if state.exists else (None, None)
        out = []
        for r in pdf.itertuples(index=False):
            if r.tag == 0:
                position, entry = int(getattr(r, ident)), float(r.price)
            elif position is not None and entry:
                out.append((key[0], int(getattr(r, ident)), position, r.price / entry - 1))
        if position is not None:
            state.update((position, entry))
        yield pd.DataFrame(out, columns=[market, ident, "position_id", "change"])

    return stream.groupBy(market).applyInPandasWithState(
        update, f"{market} {t[market]}, {ident} {t[ident]}, position_id long, change double", "position long, entry double", "append", "NoTimeout")


def silences(stream: DataFrame, key: str, ts: str, limit_seconds: float, watermark: str = "10 seconds") -> DataFrame:
    """Keys without an event for longer than the limit, by an event-time timer."""
    t = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    limit_ms = int(limit_seconds * 1000)
    rows = timed(stream, ts, watermark).select(key, ts, micros(ts).alias("_us"))

    def update(k, batches, state):
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_us": [last]})
            return
        last = max([int(p["_us"].max()) for p in batches] + ([state.get[0]] if state.exists else []))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + limit_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [], "last_us": []}).astype({"last_us": "int64"})

    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {t[key]}, last_us long", "last long", "append", "EventTimeTimeout")


def _completed(us, flags, starts, pattern: Pattern):
    """What the matches begun so far come to over more rows of a key, in order: the places in ``starts`` of the done ones and the rows
    that complete them, then the places of the ones still open and the unit each waits for.

    ``us`` and ``flags`` (a mask per step) belong to the rows, ``starts`` holds (time, row it stands at or -1, next unit). An open match
    has seen all these rows; one whose time is over is in neither list.
    """
    units = [(k, (s.strict and j == 0) or (s.consecutive and j > 0)) for k, s in enumerate(pattern.steps) for j in range(s.times)]
    since, at, unit = starts
    at, alive, waits = at.copy(), np.ones(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
    for u in range(1, len(units)):
        k, strict = units[u]
        here = np.flatnonzero(alive & ~waits & (unit <= u))
        if strict:
            following = at[here] + 1
        else:
            hits = np.append(np.flatnonzero(flags[k]), len(us))
            following = hits[np.searchsorted(hits, at[here], "right")]
        there = following < len(us)
        waits[here[~there]], unit[here[~there]] = True, u
        here, following = here[there], following[there]
        alive[here] = flags[k][following] & (us[following] < since[here] + int(pattern.within * 1_000_000))
        at[here] = following
    done, still = np.flatnonzero(alive & ~waits), np.flatnonzero(waits)
    return done, at[done], still, unit[still]


def pattern_stream(stream: DataFrame, key: str, ts: str, ident: str, pattern: Pattern, watermark: str = "10 seconds") -> DataFrame:
    """Matches of a pattern per key, the same as in a batch, once the watermark has passed their last row.

    The conditions run as Spark expressions. The state of a key is (time, id, next unit) of the matches that have begun and may still be
    completed, and (time, id, which conditions hold) of the rows that the watermark has not passed, packed in arrays: a row that it has
    passed is looked at once and forgotten. Late rows inside the watermark take their place by time; a timer settles or clears the rows
    of a key that gets no more. A task holds the rows that one key has in a micro-batch, some 20 bytes each.
    """
    ship_package(stream.sparkSession)
    t = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    marks = [f"_m{i}" for i in range(len(pattern.steps))]
    rows = timed(stream, ts, watermark).select(key, ts, micros(ts).alias("_us"), F.col(ident).alias("_id"),
                                               *[F.coalesce(F.expr(s.when), F.lit(False)).alias(m) for s, m in zip(pattern.steps, marks)])
    within, names = int(pattern.within * 1_000_000), [key, "start_id", "start_us", "end_id", "end_us"]
    if not any(s.strict or (s.consecutive and s.times > 1) for s in pattern.steps):
        # rows that meet no condition count for nothing; as it asks for the time, too, this filter stays behind the watermark
        rows = rows.filter(reduce(Column.__or__, [F.col(m) for m in marks]) | F.col(ts).isNull())

    def update(k, batches, state):
        us, ids, masks, since, begun, unit = (np.frombuffer(bytes(x), dtype="?" if i == 2 else "<i8") for i, x in enumerate(state.get if state.exists else [b""] * 6))
        held, masks = len(us), masks.reshape(len(marks), -1)
        parts = [(us, ids, masks)]
        for p in () if state.hasTimedOut else batches:
            parts.append((p["_us"].astype("int64").to_numpy(), p["_id"].astype("int64").to_numpy(), np.stack([p[c].to_numpy(dtype=bool) for c in marks])))
        us, ids, masks = (np.concatenate(c, axis=-1) for c in zip(*parts))
        del parts
        order = np.lexsort((ids, us))
        us, ids, masks = us[order], ids[order], masks[:, order]
        if len(us):  # a row that is held already has come again
            first = np.flatnonzero(np.append(True, (us[1:] != us[:-1]) | (ids[1:] != ids[:-1])))
            seen = np.repeat(order[first] < held, np.diff(np.append(first, len(us))))
            fresh = (order < held) | ~seen
            us, ids, masks = us[fresh], ids[fresh], masks[:, fresh]
        mark = state.getCurrentWatermarkMs()
        passed = mark * 1000
        n = int(np.searchsorted(us, passed, "right"))
        new = np.flatnonzero(masks[0, :n])
        since, begun = np.concatenate([since, us[new]]), np.concatenate([begun, ids[new]])
        at, unit = np.concatenate([np.full(len(unit), -1), new]), np.concatenate([unit, np.ones(len(new), dtype="int64")])
        done, end, still, unit = _completed(us[:n], masks[:, :n], (since, at, unit), pattern)
        for s in range(0, len(done), 1 << 16):
            d, e = done[s:s + (1 << 16)], end[s:s + (1 << 16)]
            yield pd.DataFrame(dict(zip(names, ([k[0]] * len(d), begun[d], since[d], ids[e], us[e]))))
        more = since[still] + within > passed
        since, begun, unit = since[still][more], begun[still][more], unit[more]
        us, ids, masks = us[n:], ids[n:], masks[:, n:]
        if len(us) or len(since):
            state.update(tuple(a.astype(a.dtype.newbyteorder("<")).tobytes() for a in (us, ids, masks, since, begun, unit)))
            due = int(us[0]) if len(us) else int(since.max()) + within
            state.setTimeoutTimestamp(max(due // 1000 + 1, mark + 1))
        elif state.exists:
            state.remove()
        if not len(done):
            yield pd.DataFrame([], columns=names)

    return rows.groupBy(key).applyInPandasWithState(
        update, f"{key} {t[key]}, start_id {t[ident]}, start_us long, end_id {t[ident]}, end_us long",
        "us binary, id binary, masks binary, since binary, begun binary, unit binary", "append", "EventTimeTimeout")
