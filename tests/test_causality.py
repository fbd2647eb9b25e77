"""Lagged causality against a least-squares fit per pair in numpy."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from marlstone.operators import timeseries as ts

T0 = datetime(2024, 1, 1)


def panel(n_series, n, seed=1, missing=0.03):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, n_series)) + 50
    for t in range(1, n):
        x[t, 1:] += 0.5 * (x[t - 1, :-1] - 50)  # each series drives the next one
    x[rng.random(x.shape) < missing] = np.nan
    return x


def frame(spark, x):
    rows = [(f"s{j}", T0 + timedelta(hours=t), float(x[t, j])) for t in range(len(x)) for j in range(x.shape[1]) if not np.isnan(x[t, j])]
    return spark.createDataFrame(rows, "e string, h timestamp, v double")


def fits(x, i, j, lag, max_lag):
    """(F, n) of the effect j on lags of the cause i, over buckets at which all lags up to ``max_lag`` of both are known."""
    n = len(x)
    part = lambda c, k: x[max_lag - k:n - k, c]
    known = np.all([np.isfinite(part(c, k)) for c in (i, j) for k in range(max_lag + 1)], axis=0)
    y = part(j, 0)[known]
    own = np.column_stack([np.ones(known.sum())] + [part(j, k)[known] for k in range(1, lag + 1)])
    both = np.column_stack([own] + [part(i, k)[known] for k in range(1, lag + 1)])
    rss = lambda a: ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum()
    small, large, m = rss(own), rss(both), int(known.sum())
    return (small - large) / lag / (large / (m - 2 * lag - 1)), m


@pytest.mark.parametrize("block,width", [(64, 4096), (2, 16)])
def test_granger_equals_least_squares(spark, monkeypatch, block, width):
    monkeypatch.setattr(ts, "SERIES_BLOCK", block)
    monkeypatch.setattr(ts, "BUCKET_SLICE", width)
    x = panel(5, 700 if width < 100 else 120)
    got = {(r["cause"], r["effect"], r["lag"]): r for r in ts.granger(frame(spark, x), "e", "h", "v", max_lag=3).collect()}
    assert len(got) == 5 * 4 * 3
    for (c, e, lag), r in got.items():
        f, n = fits(x, int(c[1:]), int(e[1:]), lag, 3)
        assert r["points"] == n and r["f_statistic"] == pytest.approx(f, rel=1e-6, abs=1e-9) and r["significant"] == (f > 3.84)
    assert all(got[f"s{j}", f"s{j + 1}", 1]["significant"] for j in range(4))


def test_causality_of_odd_series(spark):
    x = panel(2, 60, missing=0)
    rows = frame(spark, x).collect() + [("flat", T0 + timedelta(hours=t), 1.0) for t in range(60)] + [("short", T0, 1.0), (None, T0, 1.0), ("s0", None, 4.0), ("bad", T0, float("nan"))]
    df = spark.createDataFrame(rows, "e string, h timestamp, v double")
    pairs = {(r["cause"], r["effect"]) for r in ts.granger(df, "e", "h", "v", max_lag=2).collect()}
    assert {("s0", "s1"), ("s1", "s0")} <= pairs and not any("short" in p or "bad" in p or None in p for p in pairs)
    assert not any(e == "flat" for _, e in pairs)
    assert ts.granger(df.limit(0), "e", "h", "v").count() == 0
    only = ts.lagged_partial_correlations(df, "e", "h", "v", ["s0", "s1"], 1, significant_only=True).collect()
    assert ("s0", "s1") in {(r["cause"], r["effect"]) for r in only} and all(r["significant"] for r in only)


@pytest.mark.parametrize("tile,values", [(2, 40), (1, 1 << 20)])
def test_short_series_are_solved_where_they_meet(spark, monkeypatch, tile, values):
    """series of one slice of time left sums for every pair of series and copies for every 64 of them."""
    monkeypatch.setattr(ts, "TILE", tile, raising=False)
    monkeypatch.setattr(ts, "BLOCK_VALUES", values, raising=False)
    x = panel(9, 40, seed=3, missing=0.05)
    x[:, 8] = x[:, 2] * 3  # one series is another's multiple
    df = frame(spark, x)
    every = ts.granger(df, "e", "h", "v", max_lag=2)
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "moments" not in plan and "Join" not in plan
    got = {(r["cause"], r["effect"], r["lag"]): r for r in every.collect()}
    assert len(got) == len(every.collect())
    for c in range(8):
        for e in range(8):
            for lag in (1, 2):
                if c == e:
                    assert (f"s{c}", f"s{e}", lag) not in got
                    continue
                f, n = fits(x, c, e, lag, 2)
                r = got[f"s{c}", f"s{e}", lag]
                assert r["points"] == n and r["f_statistic"] == pytest.approx(f, rel=1e-6, abs=1e-9)
    only = {(r["cause"], r["effect"], r["lag"]) for r in ts.granger(df, "e", "h", "v", max_lag=2, significant_only=True).collect()}
    assert only == {k for k, r in got.items() if r["significant"]}


@pytest.mark.parametrize("name", ["granger", "lagged_partial_correlations"])
def test_significant_pairs_are_found_among_few(spark, monkeypatch, name):
    """Every pair was measured whole, and blocks were shuffled once per block they meet."""
    x = panel(60, 12, seed=4, missing=0.1)
    x[:, 50], x[:, 51], x[:, 52] = 7.0, x[:, 3] * -2, x[:, 4] + 1e-7 * np.arange(12)
    x[:, 53], x[:, 54], x[4:, 55] = x[:, 5] * 1e9, x[:, 6] * 1e-9, np.nan
    df, op = frame(spark, x), getattr(ts, name)
    columns = ["cause", "effect", "lag", "f_statistic", "points"] if name == "granger" else ["cause", "effect", "lag", "strength"]
    only = op(df, "e", "h", "v", max_lag=1, significant_only=True)
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Generate" not in plan
    got = sorted(map(tuple, only.select(columns).collect()))
    every = op(df, "e", "h", "v", max_lag=1)
    assert got == sorted(map(tuple, every.filter("significant").select(columns).collect())) and 100 < len(got) < every.count() / 3
    seen, found = [], ts._candidates
    monkeypatch.setattr(ts, "_candidates", lambda *a: seen.append(found(*a)) or seen[-1])
    both = (ts._lagged(np.vstack([np.full(60, np.nan), x - np.nanmean(x, axis=0)])[:, s], 12, 1) for s in (slice(30), slice(30, 60)))
    a, b = both
    limits = []
    monkeypatch.setattr(ts, "_pair_rows", lambda *args: limits.append(args[7:]) or df)
    op(df, "e", "h", "v", max_lag=1, significant_only=True)
    measure, _, limit = limits[0]
    n, cov = ts._pair_covariances(ts._products(*a, *b, np.triu_indices(2)), 30, 30, 1)
    assert sum(len(r[2]) for r in ts._measured(n, cov, False, 1, measure, True, limit)) <= sum(s.sum() for s in seen) < 900
