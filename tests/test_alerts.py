"""Alert history of a stream against its batch twin: files out of order, restarts, late rows, missing values."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marlstone.operators import graph
from marlstone.streaming import alerts
from marlstone.streaming.sources import collected, file_stream

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, who string, ts timestamp, pattern string"


def rows_of(n, seed=2):
    rng = random.Random(seed)
    who = ["a", "a", "a", "b", None]
    return [(i, rng.choice(who), T0 + timedelta(seconds=rng.randrange(0, 200_000) // 7 * 7), rng.choice(["x", "y", "z", None])) for i in range(n)]


def plain(rows):
    """Python loop over (time, id) per key."""
    out, state = set(), {}
    for i, who, ts, p in sorted(rows, key=lambda r: (r[2], r[0])):
        n, recent = state.get(who, (0, []))
        hours = {}
        for t, _ in recent:
            h = t.replace(minute=0, second=0)
            hours[h] = hours.get(h, 0) + 1
        c = list(hours.values())[-3:]
        trend = "INCREASING" if len(c) == 3 and c[0] < c[1] < c[2] else "DECREASING" if len(c) == 3 and c[0] > c[1] > c[2] else "STABLE"
        out.add((who, i, n + 1, trend, any(q == p and ts - t < timedelta(hours=1) for t, q in recent)))
        state[who] = (n + 1, [*recent, (ts, p)][-10:])
    return out


def as_set(df):
    return {tuple(r) for r in df.select("key", "id", "total_alerts", "trend", "is_repeat").collect()}


def test_batch_equals_a_loop(spark):
    rows = rows_of(300)
    got = alerts.alert_context(spark.createDataFrame(rows, SCHEMA), "who", "ts", "id", "pattern").withColumnRenamed("who", "key")
    assert as_set(got) == plain(rows)
    assert alerts.alert_context(spark.createDataFrame([], SCHEMA), "who", "ts", "id", "pattern").count() == 0


def test_stream_in_any_order_and_after_a_restart(spark, tmp_path):
    rows = sorted(rows_of(300), key=lambda r: r[2])
    rng = random.Random(4)
    near = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(0, 1500)))  # out of order, within the watermark
    end = (9999, "b", T0 + timedelta(days=9), "x")
    late = (7777, "a", T0, "x")
    files = [near[:120], near[120:240], [*near[240:], end], [late, (10_000, "b", T0 + timedelta(days=10), "x")]]
    path, marks = str(tmp_path / "in"), str(tmp_path / "marks")

    def run():
        s = file_stream(spark, path + "/*", SCHEMA, max_files=1)
        with alerts.state_on_disk(spark):
            return as_set(collected(alerts.alert_context_stream(s, "who", "ts", "id", "pattern", "30 minutes"), checkpoint=marks))

    write = lambda i: spark.createDataFrame(files[i], SCHEMA).coalesce(1).write.parquet(f"{path}/{i}")
    write(0)
    write(1)
    first = run()
    write(2)
    second = run()
    write(3)
    third = run()
    assert first and not first & second
    # the rows of the first runs and those up to the last but one mark; the late row is dropped
    assert first | second | third == plain([*rows, end])


def test_graph_stream_equals_its_batch_twin(spark, tmp_path):
    schema = "who string, what string, kind string, ts timestamp"
    rows = [("u1", "p", "buy", T0 + timedelta(hours=5)), ("u1", "p", "buy", T0), ("u2", "p", "view", T0), ("u2", None, "view", T0), ("u3", "q", "other", T0), (None, "p", "buy", T0)]
    for i in range(3):
        spark.createDataFrame(rows[2 * i:2 * i + 2], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    spec = {"buy": ("user", F.col("who"), "bought:asset", F.col("what")), "view": ("user", F.col("who"), "viewed:asset", F.col("what"))}
    s = file_stream(spark, f"{tmp_path}/in/*", schema, max_files=1)
    got = collected(alerts.graph_edges(s, spec, "kind", "ts"), "update", ["src", "dst", "label"])
    twin = graph.build_graph(spark.createDataFrame(rows, schema), spec, "kind", "ts")[1]
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in twin.select(got.columns).collect()}
