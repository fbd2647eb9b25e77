"""Sliced windows, folds and quantiles against the plain window or a small loop, with one hot key."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.quantiles import exact_quantiles
from marlstone.operators import folds
from marlstone.operators import windows as wd

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(900):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        data.append((i, key, START + timedelta(seconds=rng.choice([rng.randrange(400_000), 86_400 * rng.randrange(4)])), None if rng.random() < 0.1 else round(rng.uniform(-5, 50), 2)))
    return spark.createDataFrame(data, "id long, k string, ts timestamp, x double").cache()


def as_map(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None and y is None) or x == pytest.approx(y, abs=1e-9), (k, a[k], b[k])


def test_numbered(rows):
    plain = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")))
    close(as_map(wd.numbered(rows, ["k"], "ts", ["id"]), "_rn"), as_map(plain, "_rn"))


@pytest.mark.parametrize("chunk", [4, 50, 10_000])
def test_rows_frame(rows, chunk):
    make = lambda w: {"m": F.avg("x").over(w.rowsBetween(-3, -1)), "n": F.lead("x", 2).over(w), "p": F.lag("ts").over(w).cast("double")}
    plain = rows.withColumns(make(Window.partitionBy("k").orderBy("ts", "id")))
    got = wd.rows_frame(rows, ["k"], "ts", ["id"], make, before=3, after=2, chunk_rows=chunk)
    close(as_map(got, "m", "n", "p"), as_map(plain, "m", "n", "p"))


def test_range_frame(rows):
    us = F.unix_micros("ts")
    plain = rows.withColumn("c", F.count("x").over(Window.partitionBy("k").orderBy(us).rangeBetween(-3_600_000_000, 1_800_000_000)))
    got = wd.range_frame(rows, ["k"], "ts", lambda w: {"c": F.count("x").over(w.rangeBetween(-3_600_000_000, 1_800_000_000))}, before=3600, after=1800)
    close(as_map(got, "c"), as_map(plain, "c"))


@pytest.mark.parametrize("current", [True, False])
def test_running(rows, current):
    frame = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    plain = rows.withColumns({"s": F.sum("x").over(frame), "c": F.count("x").over(frame), "lo": F.min("x").over(frame), "hi": F.max("x").over(frame)})
    x = F.col("x")
    got = wd.running(rows, ["k"], "ts", ["id"], {"s": ("sum", x), "c": ("count", x), "lo": ("min", x), "hi": ("max", x)}, current)
    close(as_map(got, "s", "c", "lo", "hi"), as_map(plain, "s", "c", "lo", "hi"))


def test_forward_fill(rows):
    plain = rows.withColumn("x", F.last("x", True).over(Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)))
    close(as_map(wd.fill_series(rows, ["k"], "ts", ["id"], "x"), "x"), as_map(plain, "x"))


def test_affine_scan_over_many_chunks(rows):
    got = as_map(folds.ema(rows, ["k"], "ts", ["id"], F.coalesce("x", F.lit(0.0)), "e", 0.9, None, chunk_rows=7, maps=3), "e")
    want = {}
    for key in ("hot", "a", "b", None):
        s = None
        for r in sorted((r for r in rows.collect() if r["k"] == key), key=lambda r: (r["ts"], r["id"])):
            v = r["x"] or 0.0
            s = v if s is None else 0.9 * s + 0.1 * v
            want[r["id"]] = (s,)
    close(got, want)


def test_sliding_totals(rows):
    got = as_map(folds.sliding_totals(rows, ["k"], "ts", "id", 7200, {"n": F.lit(1), "s": F.coalesce("x", F.lit(0.0))}), "n", "s")
    data = rows.collect()
    want = {r["id"]: [q for q in data if q["k"] == r["k"] and timedelta(0) <= r["ts"] - q["ts"] <= timedelta(hours=2)] for r in data}
    close(got, {i: (float(len(q)), sum(x["x"] or 0.0 for x in q)) for i, q in want.items()})


def test_cooldown(rows):
    got = {r["id"] for r in folds.cooldown(rows, ["k"], "ts", "id", 3000).filter("accepted").collect()}
    want = set()
    for key in ("hot", "a", "b", None):
        last = None
        for r in sorted((r for r in rows.collect() if r["k"] == key), key=lambda r: (r["ts"], r["id"])):
            if last is None or (r["ts"] - last).total_seconds() >= 3000:
                last = r["ts"]
                want.add(r["id"])
    assert got == want


@pytest.mark.parametrize("accuracy", [10_000, 60])
def test_quantiles(spark, accuracy):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=1500), np.full(700, 0.25), rng.exponential(50, 300)])
    df = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(v)], "k int, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.993, "e": 1.0}
    for r in exact_quantiles(df, ["k"], F.col("v"), probs, accuracy).collect():
        part = v[r["k"]::2]
        for n, p in probs.items():
            assert r[n] == pytest.approx(np.percentile(part, 100 * p))


def test_empty_input(rows):
    none = rows.filter("id < 0")
    assert wd.rows_frame(none, ["k"], "ts", ["id"], lambda w: {"m": F.lag("x").over(w)}, before=1).count() == 0
    assert wd.running(none, ["k"], "ts", ["id"], {"s": ("sum", F.col("x"))}).count() == 0
    assert exact_quantiles(none, ["k"], F.col("x"), {"m": 0.5}).count() == 0


def _series(spark, values):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([("k", t0 + timedelta(minutes=13 * i), i, float(v)) for i, v in enumerate(values)], "k string, ts timestamp_ntz, i int, v double")


def test_moving_average_with_any_decay(spark):
    values = [(i * 37) % 101 for i in range(3200)]
    df = _series(spark, values)
    for keep in (0.0, 1e-200, 0.3, 0.5, 0.6, 0.9, 1.0):
        got = [r["x"] for r in folds.ema(df, ["k"], "ts", ["i"], F.col("v"), "x", keep=keep, maps=3).orderBy("i").collect()]
        x, want = 0.0, []
        for v in values:
            x = keep * x + (1 - keep) * v
            want.append(x)
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9), keep


def test_running_deviation_far_from_zero(spark):
    from statistics import pstdev
    values = [1e9 + (i * 7) % 5 for i in range(400)]
    got = [r["h_std"] for r in wd.running_moments(_series(spark, values), ["k"], "ts", ["i"], F.col("v"), "h").orderBy("i").collect()]
    assert got == pytest.approx([pstdev([v - 1e9 for v in values[:i + 1]]) for i in range(400)], rel=1e-6, abs=1e-6)
