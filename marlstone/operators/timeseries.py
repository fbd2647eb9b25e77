"""Time-series operators: resampling, trends, change points, seasonality, forecasts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.columns import clamp, ladder, micros, null_safe_join, ratio
from marlstone.operators.joins import block_pairs
from marlstone.operators.windows import fill_series, numbered, rows_frame, running, running_moments
from marlstone.session import cut_lineage, ship_package


def maintenance_features(df: DataFrame, keys: list[str], ts: str, value: str, errors: str, rows: int = 24) -> DataFrame:
    """Rolling mean and deviation, value relative to the mean, and errors above twice their rolling mean."""
    def make(w):
        f = w.rowsBetween(-(rows - 1), 0)
        return {"rolling_mean": F.avg(value).over(f), "rolling_std": F.stddev(value).over(f), "_err": F.avg(errors).over(f)}
    out = rows_frame(df, keys, ts, [], make, before=rows - 1)
    return out.withColumns({"efficiency": ratio(value, "rolling_mean"), "error_spike": F.col(errors) > 2 * F.col("_err")}).drop("_err")


def resample(df: DataFrame, keys: list[str], ts: str, value: str, step: str = "1 hour", trunc: str = "hour") -> DataFrame:
    """Regular grid of bucket means between the first and last bucket of a key, gaps interpolated in time."""
    means = df.groupBy(*keys, F.date_trunc(trunc, ts).alias(ts)).agg(F.avg(value).alias(value))
    span = means.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}"))).alias(ts))
    full = null_safe_join(grid, means, [*keys, ts], "left")
    return fill_series(full, keys, ts, [], value, "linear", 30 * 86_400)


def linear_trend(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: str) -> DataFrame:
    """Least squares over the row index: slope, intercept, r2, exponential rate, direction and strength."""
    d = numbered(df.filter(F.col(value).isNotNull()), keys, ts, ties).withColumns(
        {"_x": (F.col("_rn") - 1).cast("double"), "_y": F.col(value).cast("double")})
    log = F.when(F.col("_y") > 0, F.log("_y"))
    out = d.groupBy(*keys).agg(
        F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r_squared"), F.regr_slope(log, F.col("_x")).alias("_rate"), F.min("_y").alias("_low"),
        F.avg("_y").alias("mean"), F.stddev_pop("_y").alias("std"), F.min("_y").alias("min"), F.max("_y").alias("max"), F.count("_y").alias("points"))
    direction = F.when(F.col("slope") < 0, "decreasing").when(F.col("slope") > 0, "increasing").otherwise("flat")
    strength = F.when(F.col("r_squared") > 0.7, "strong").when(F.col("r_squared") > 0.3, "moderate").otherwise("weak")
    return out.withColumns({"exponential_rate": F.when(F.col("_low") > 0, F.col("_rate")).otherwise(0.0), "trend_direction": direction,
                            "trend_strength": strength, "change_rate": ratio("slope", "mean")}).drop("_rate", "_low")


def zscore_anomalies(df: DataFrame, keys: list[str], value: str, threshold: float = 3.0, min_rows: int = 10) -> DataFrame:
    """Rows further than ``threshold`` population deviations from the mean of their key, with the expected range."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(value).alias("_n"))
    z = F.abs(F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    return null_safe_join(df, s, keys).withColumns({
        "z_score": z, "expected_low": F.col("_m") - threshold * F.col("_s"), "expected_high": F.col("_m") + threshold * F.col("_s")}) \
        .filter((F.col("_n") >= min_rows) & (F.col("z_score") > threshold)).drop("_m", "_s", "_n")


def mean_shift_points(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: str, margin: int = 10,
                      critical: float = 2.576) -> DataFrame:
    """Split positions where the means before and after differ by a pooled two-sample t above ``critical``."""
    v = F.col(value).cast("double")
    d = running(df, keys, ts, ties, {"_n1": ("count", v), "_s1": ("sum", v), "_q1": ("sum", v * v)}, include_current=False)
    total = df.groupBy(*keys).agg(F.count(v).alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
    d = null_safe_join(d, total, keys)
    n1, n2 = F.col("_n1"), F.col("_n") - F.col("_n1")
    m1, m2 = F.col("_s1") / F.nullif(n1, F.lit(0)), (F.col("_s") - F.col("_s1")) / F.nullif(n2, F.lit(0))
    ss = (F.col("_q1") - n1 * m1 * m1) + (F.col("_q") - F.col("_q1") - n2 * m2 * m2)
    t = (m1 - m2) / F.nullif(F.sqrt(ss / (F.col("_n") - 2) * (1 / n1 + 1 / n2)), F.lit(0.0))
    inside = (n1 >= margin) & (n1 < F.col("_n") - margin) & (F.col("_n") > 2 * margin)
    return d.withColumns({"index": n1, "before_mean": m1, "after_mean": m2, "t": t}).filter(inside & (F.abs("t") > critical)) \
        .drop("_n1", "_s1", "_q1", "_n", "_s", "_q")


def local_shifts(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: str, side: int = 10) -> DataFrame:
    """Mean of up to ``side`` rows before and from each row on, the magnitude and the type of the change."""
    out = rows_frame(df, keys, ts, ties, lambda w: {
        "before_mean": F.avg(value).over(w.rowsBetween(-side, -1)), "after_mean": F.avg(value).over(w.rowsBetween(0, side - 1)),
        "_k": F.count(value).over(w.rowsBetween(-side, -1))}, before=side, after=side)
    kind = ladder([(F.col("after_mean") < F.col("before_mean") * 0.5, "improvement"),
                   (F.col("after_mean") > F.col("before_mean") * 1.5, "degradation")], "shift")
    return out.filter(F.col("_k") > 0).withColumns({"magnitude": F.abs(F.col("after_mean") - F.col("before_mean")), "change_type": kind}).drop("_k")


def seasonality(df: DataFrame, keys: list[str], ts: str, value: str, period: int = 24) -> DataFrame:
    """Additive decomposition of a regular series: strength = deviation of the seasonal part over that of the rest.

    Centred moving average (half weights at both ends of an even period), phase means made to sum to zero.
    """
    half = period // 2
    even = period % 2 == 0

    def make(w):
        inner = F.sum(value).over(w.rowsBetween(-(half - 1 if even else half), half - 1 if even else half))
        trend = ((inner + 0.5 * (F.lag(value, half).over(w) + F.lead(value, half).over(w))) / period) if even else inner / period
        full = F.count(value).over(w.rowsBetween(-half, half)) == 2 * half + 1
        return {"_trend": F.when(full, trend)}

    d = rows_frame(df, keys, ts, [], make, before=half, after=half, slice_seconds=30 * 86_400)
    d = cut_lineage(d)  # read for the row numbers, the phases and the rest
    d = numbered(d, keys, ts, [], 30 * 86_400).withColumns({"_phase": (F.col("_rn") - 1) % period, "_off": F.col(value) - F.col("_trend")})
    phase = d.groupBy(*keys, "_phase").agg(F.avg("_off").alias("_mean"))
    centre = phase.groupBy(*keys).agg(F.avg("_mean").alias("_centre"))
    s = null_safe_join(null_safe_join(d, phase, [*keys, "_phase"]), centre, keys).withColumn("_seasonal", F.col("_mean") - F.col("_centre"))
    out = s.groupBy(*keys).agg(F.stddev("_seasonal").alias("seasonal_amplitude"), F.stddev(F.col("_off") - F.col("_seasonal")).alias("_rest"),
                               F.count(F.lit(1)).alias("points"))
    strength = F.coalesce(F.col("seasonal_amplitude") / F.nullif(F.col("_rest"), F.lit(0.0)), F.lit(0.0))
    return out.withColumns({"seasonality_strength": strength, "has_seasonality": (strength > 0.5) & (F.col("points") >= period)}).drop("_rest")


def dominant_period(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: str, periods: list[int], top: int = 1) -> DataFrame:
    """Strongest of the candidate periods by spectral power, as sums of cosines and sines in one aggregation."""
    from marlstone.operators.windows import ranked_top
    d = numbered(df, keys, ts, ties, 30 * 86_400)
    means = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    d = null_safe_join(d, means, keys)
    angle = lambda p: 2 * math.pi / p * (F.col("_rn") - 1)
    dev = F.col(value) - F.col("_m")
    aggs = [a for p in periods for a in (F.sum(dev * F.cos(angle(p))).alias(f"c{p}"), F.sum(dev * F.sin(angle(p))).alias(f"s{p}"))]
    one = d.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(p).alias("period"), F.sqrt(F.pow(f"c{p}", 2) + F.pow(f"s{p}", 2)).alias("strength")) for p in periods])
    return ranked_top(one.select(*keys, F.inline(rows)), keys, [F.col("strength").desc(), F.col("period")], top).drop("rank")


def convergence(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: str) -> DataFrame:
    """Rate statistics of a falling series, its acceleration, and the pattern it shows."""
    def make(w):
        prev, prev2 = F.lag(value).over(w), F.lag(value, 2).over(w)
        return {"_rate": F.when(prev > 0, (prev - F.col(value)) / prev), "_d1": F.col(value) - prev, "_d0": prev - prev2}

    d = cut_lineage(rows_frame(df.filter(F.col(value).isNotNull()), keys, ts, ties, make, before=2, slice_seconds=30 * 86_400))
    rates = numbered(d.filter(F.col("_rate").isNotNull()), keys, ts, ties, 30 * 86_400, out="_k")
    count = d.groupBy(*keys).agg(F.count("_rate").alias("_m"))
    r = null_safe_join(rates, count, keys)
    stats = r.groupBy(*keys).agg(
        F.avg("_rate").alias("average_rate"), F.stddev_pop("_rate").alias("rate_std"), F.min("_rate").alias("min_rate"), F.max("_rate").alias("max_rate"),
        F.avg(F.when(F.col("_k") <= 5, F.col("_rate"))).alias("_head"), F.avg(F.when(F.col("_k") > F.col("_m") - 5, F.col("_rate"))).alias("_tail"),
        F.max("_m").alias("_m"))
    turns = d.groupBy(*keys).agg(F.count_if(F.signum("_d1") != F.signum("_d0")).alias("_turns"), F.count("_d1").alias("_diffs"))
    trend = linear_trend(d, keys, ts, ties, value).select(*keys, "slope", "exponential_rate", "points")
    out = null_safe_join(null_safe_join(stats, turns, keys), trend, keys)
    pattern = ladder([
        (F.col("points") < 5, "unknown"), (F.col("exponential_rate") < -0.1, "exponential"),
        ((F.col("slope") < 0) & (F.col("rate_std") < 0.1), "linear"), (F.col("_turns") > F.col("_diffs") * 0.3, "oscillatory"),
        (F.col("average_rate") < 0.01, "stagnant"), (F.col("slope") > 0, "diverging")], "irregular")
    return out.withColumns({
        "is_accelerating": (F.col("_m") > 10) & (F.col("_tail") > F.col("_head")),
        "rate_trend": F.when(F.col("_tail") > F.col("average_rate"), "improving").otherwise("worsening"), "pattern": pattern}) \
        .drop("_head", "_tail", "_m", "_turns", "_diffs", "points")


def compare_series(conv: DataFrame, key: str) -> DataFrame:
    """Number of series per pattern, with the best and worst mean rate over all series."""
    best = conv.agg(F.max_by(key, F.struct("average_rate", key)).alias("b")).scalar()
    worst = conv.agg(F.min_by(key, F.struct("average_rate", key)).alias("w")).scalar()
    return conv.groupBy("pattern").agg(F.count(F.lit(1)).alias("series")).withColumns({"best": best, "worst": worst})


def stationarity(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: str) -> DataFrame:
    """Dickey-Fuller t of the change regressed on the previous value, against the fixed 5 % critical value."""
    d = rows_frame(df, keys, ts, ties, lambda w: {"_x": F.lag(value).over(w)}, before=1, slice_seconds=30 * 86_400) \
        .filter(F.col("_x").isNotNull()).withColumn("_y", F.col(value) - F.col("_x"))
    out = d.groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("gamma"), F.regr_sxx("_y", "_x").alias("_sxx"),
                               F.regr_syy("_y", "_x").alias("_syy"), F.regr_sxy("_y", "_x").alias("_sxy"), F.count("_y").alias("points"))
    rss = F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.nullif(F.col("_sxx"), F.lit(0.0))
    se = F.sqrt(rss / (F.col("points") - 2) / F.nullif(F.col("_sxx"), F.lit(0.0)))
    stat = F.col("gamma") / F.nullif(se, F.lit(0.0))
    return out.select(*keys, stat.alias("statistic"), (stat < -2.86).alias("is_stationary"), "points")


def running_zscores(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: str, threshold: float = 3.0, min_rows: int = 10) -> DataFrame:
    """Rows beyond ``threshold`` deviations of all earlier rows of the key, once more than ``min_rows`` are known."""
    d = running_moments(df, keys, ts, ties, F.col(value), "_h", include_current=False)
    z = F.abs((F.col(value) - F.col("_h_mean")) / (F.col("_h_std") + 1e-6))
    return d.withColumns({"z_score": z, "expected_low": F.col("_h_mean") - 3 * F.col("_h_std"), "expected_high": F.col("_h_mean") + 3 * F.col("_h_std")}) \
        .filter((F.col("_h_n") > min_rows) & (F.col("z_score") > threshold)).drop("_h_n", "_h_mean", "_h_std")


def confidence_anomalies(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: str, history: int = 1000, min_rows: int = 50,
                         threshold: float = 3.0) -> DataFrame:
    """z against the last ``history`` rows of the key, with more than ``min_rows`` known.

    Frame sums are differences of running sums, so the cost does not depend on the frame.
    """
    v = F.col(value).cast("double")
    d = running(df, keys, ts, ties, {"_c": ("count", v), "_s": ("sum", v), "_q": ("sum", v * v)})
    d = rows_frame(d, keys, ts, ties, lambda w: {
        "_c1": F.lag("_c").over(w), "_s1": F.lag("_s").over(w), "_q1": F.lag("_q").over(w), "_c0": F.lag("_c", history + 1).over(w),
        "_s0": F.lag("_s", history + 1).over(w), "_q0": F.lag("_q", history + 1).over(w)}, before=history + 1)
    z0 = F.lit(0.0)
    n = F.col("_c1") - F.coalesce(F.col("_c0"), F.lit(0))
    mean = (F.col("_s1") - F.coalesce(F.col("_s0"), z0)) / F.nullif(n, F.lit(0))
    var = F.greatest((F.col("_q1") - F.coalesce(F.col("_q0"), z0)) / F.nullif(n, F.lit(0)) - mean * mean, z0)
    z = F.abs(F.col(value) - mean) / F.nullif(F.sqrt(var), z0)
    return d.withColumns({"expected": mean, "z_score": z}).filter((n > min_rows) & (F.col("z_score") > threshold)) \
        .drop(*[f"_{a}{b}" for a in "csq" for b in ("", "0", "1")])


def failure_indicators(df: DataFrame, key: str, ts: str, ident: str, kind: str, value: str, now: Column) -> DataFrame:
    """Errors per day over 7 days and 1 - (last 10 / first 10) of the performance values."""
    from marlstone.operators.windows import latest
    week = F.col(ts) > now - F.expr("interval 7 days")
    errors = df.groupBy(key).agg((F.count_if((F.col(kind) == "error") & week) / 7.0).alias("error_rate"))
    perf = df.filter(F.col(kind) == "performance")
    head = latest(perf, [key], [F.col(ts), F.col(ident)], 10).groupBy(key).agg(F.avg(value).alias("_first"))
    tail = latest(perf, [key], [F.col(ts).desc(), F.col(ident).desc()], 10).groupBy(key).agg(F.avg(value).alias("_last"))
    out = errors.join(head, key, "left").join(tail, key, "left")
    drop = F.when(F.col("_first") > 0, 1 - F.col("_last") / F.col("_first")).otherwise(F.lit(0.0))
    return out.withColumn("performance_degradation", drop).drop("_first", "_last")


def failure_probability(error_rate: Column, degradation: Column, hours: float) -> Column:
    """1 - (1 - p)^days with p = 1 % stepped up by the error rate and the degradation."""
    p = F.lit(0.01) * ladder([(error_rate > 10, 5.0), (error_rate > 5, 2.0)], 1.0) * ladder([(degradation > 0.3, 3.0), (degradation > 0.1, 1.5)], 1.0)
    return F.least(F.lit(1.0), 1 - F.pow(1 - p, F.lit(hours / 24)))


def health_score(is_anomalous: Column, failure: Column, low_efficiency: Column) -> Column:
    s = 100.0 - F.when(is_anomalous, 20.0).otherwise(0.0) - F.coalesce(failure, F.lit(0.0)) * 50 \
        - F.when(F.coalesce(low_efficiency < 0.7, F.lit(False)), 15.0).otherwise(0.0)
    return clamp(s, 0.0, 100.0)


def urgency(failure: Column) -> Column:
    return ladder([(failure > 0.8, "critical"), (failure > 0.5, "high"), (failure > 0.3, "medium"), (failure > 0.1, "low")], "none")


def fleet_health(components: DataFrame) -> DataFrame:
    """One row over the fleet: counts by urgency, mean health, backlog and status."""
    u = F.col("urgency")
    out = components.agg(F.count(F.lit(1)).alias("components"), F.avg("health").alias("mean_health"),
                         F.count_if(F.col("failure_probability") > 0.5).alias("at_risk"), F.count_if(u == "critical").alias("critical"),
                         F.count_if(u == "high").alias("high"), F.count_if(u.isin("critical", "high")).alias("backlog"))
    status = ladder([(F.col("components") == 0, "unknown"), ((F.col("critical") > 0) | (F.col("mean_health") < 50), "critical"),
                     ((F.col("high") > 2) | (F.col("mean_health") < 70), "warning")], "healthy")
    return out.withColumn("fleet_status", status)


def feature_importance(current: DataFrame, history: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Share of each feature in the absolute z-scores of a row against the history."""
    from marlstone.functions.columns import one_row
    s = one_row(history.agg(*[a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]))
    z = {f: F.coalesce(F.abs(F.col(f) - s[f"m_{f}"]) / F.nullif(s[f"s_{f}"], F.lit(0.0)), F.lit(0.0)) for f in features}
    total = None
    for c in z.values():
        total = c if total is None else total + c
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), c.alias("z"), F.coalesce(c / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("importance")) for f, c in z.items()])
    return current.select(key, F.inline(rows))


def risk_profiles(alerts: DataFrame, entity: str, ts: str, score: str, pattern: str) -> DataFrame:
    """Alerts per entity: totals over daily figures, most patterns in a day, level and trend of the daily counts."""
    daily = alerts.groupBy(entity, F.date_trunc("day", ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("a"), F.max(score).alias("m"), F.countDistinct(pattern).alias("p"))
    out = daily.groupBy(entity).agg(F.sum("n").alias("alerts"), F.avg("a").alias("avg_risk"), F.max("m").alias("max_risk"), F.max("p").alias("patterns"))
    level = ladder([((F.col("max_risk") > 0.8) | (F.col("alerts") > 50), "CRITICAL"), ((F.col("avg_risk") > 0.6) | (F.col("alerts") > 20), "HIGH"),
                    ((F.col("avg_risk") > 0.4) | (F.col("alerts") > 10), "MEDIUM")], "LOW")
    trend = linear_trend(daily, [entity], "day", [], "n").select(entity, F.col("slope").alias("daily_slope"))
    return out.withColumn("risk_level", level).join(trend, entity, "left")


def resource_anomalies(df: DataFrame, keep: list[str], cpu: Column, memory: Column, requests: Column, errors: Column, p99: Column) -> DataFrame:
    """One row per exceeded resource threshold with its 0-1 severity."""
    row = lambda kind, severity, value: F.struct(F.lit(kind).alias("anomaly_type"), F.least(F.lit(1.0), severity).alias("severity"), value.cast("double").alias("value"))
    share = errors / F.nullif(requests, F.lit(0.0))
    rows = F.array_compact(F.array(
        F.when(cpu > 80, row("high_cpu", (cpu - 80) / 20, cpu)), F.when(memory > 85, row("high_memory", (memory - 85) / 15, memory)),
        F.when(share > 0.05, row("high_error_rate", share * 10, errors)), F.when(p99 > 1000, row("slow_response", (p99 - 1000) / 4000, p99))))
    return df.select(*keep, F.inline(rows))


def damped_forecast(df: DataFrame, key: str, ts: str, value: str, steps: int = 10) -> DataFrame:
    """Damped-trend exponential smoothing per series with a 95 % band; parameters from a small fixed grid by squared error.

    For many bounded series (say daily values): one series is one Arrow group. Long raw series are to be
    aggregated first.
    """
    import numpy as np
    import pandas as pd
    schema = f"{key} {df.schema[key].dataType.simpleString()}, step int, forecast double, lower double, upper double, alpha double, beta double, phi double"
    grid = [(a, b, p) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.05, 0.2) for p in (0.8, 0.9, 0.98)]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(ts)[value].to_numpy(dtype=float)
        y = y[~np.isnan(y)]
        if len(y) < 10:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        alpha, beta, phi = (np.array(c) for c in zip(*grid))
        level, trend = np.full(len(grid), y[0]), np.full(len(grid), y[1] - y[0])
        errors = []
        for v in y[1:]:
            guess = level + phi * trend
            errors.append(v - guess)
            new = alpha * v + (1 - alpha) * guess
            trend = beta * (new - level) + (1 - beta) * phi * trend
            level = new
        resid = np.array(errors)
        i = int(np.argmin((resid ** 2).sum(axis=0)))
        sd = resid[:, i].std()
        n = min(steps, len(y) // 2)
        damp = np.cumsum(phi[i] ** np.arange(1, n + 1))
        f = level[i] + damp * trend[i]
        return pd.DataFrame({key: pdf[key].iloc[0], "step": np.arange(1, n + 1, dtype="int32"), "forecast": f, "lower": f - 1.96 * sd,
                             "upper": f + 1.96 * sd, "alpha": alpha[i], "beta": beta[i], "phi": phi[i]})

    return df.select(key, ts, value).groupBy(key).applyInPandas(fit, schema)


# -- lagged causality ---------------------------------------------------------------------------------------

#: Series of one block and buckets of one time slice: a pair of blocks and a slice is one matrix product in a task.
SERIES_BLOCK, BUCKET_SLICE = 64, 4096
#: Values of one block, and cells of its matrix, where all series fit one slice; series of one product there.
BLOCK_VALUES, BLOCK_CELLS, TILE = 1 << 20, 1 << 22, 128
#: Rows given out at a time.
ROWS_OUT = 1 << 16


def _pair_rows(df: DataFrame, entity: str, bucket: str, value: str, entities: list | None, lags: int, name: str, measure, only: bool, limit=None) -> DataFrame:
    """Rows (cause, effect, lag, statistic, significant, points) of ``measure(n, cov, cause, effect, lag)`` for all ordered pairs of
    series, with ``only`` the significant ones. A pair counts the buckets at which both series and all their lags are known.
    ``limit(points, lag)``: the squared partial correlation that is significant, for :func:`_candidates`.

    Series of one slice of time meet in large blocks, whose sums of products stay in the task. Longer ones meet in small blocks, slice
    by slice.
    """
    ship_package(df.sparkSession)
    order, means, centre = _known_values(df, entity, bucket, value, entities)
    schema = "cause {0}, effect {0}, lag int, {1} double, significant boolean, points long".format(df.schema[entity].dataType.simpleString(), name)
    series, values = means.groupBy("e").agg(F.count("x").alias("n")).agg(F.count("n"), F.sum("n")).first()
    buckets = order.count()
    if buckets + lags <= BUCKET_SLICE:
        out = _short_pairs(means, order, centre, series, values or 0, buckets, lags, schema, measure, only, limit)
    else:
        out = _per_pair(_block_moments(means, order, centre, series, lags), schema, lags, measure)
    return out.filter("significant") if only else out


def _known_values(df: DataFrame, entity: str, bucket: str, value: str, entities: list | None) -> tuple[DataFrame, ...]:
    """The order of the known buckets, the mean per series and bucket, and the mean of each series."""
    finite = F.abs(F.col(value)) < F.lit(float("inf"))
    d = df.filter(F.col(bucket).isNotNull()).select(F.col(entity).alias("e"), F.col(bucket).alias("b"), F.when(finite, F.col(value).cast("double")).alias("x"))
    # a lag is one known bucket back, whatever series made the bucket known
    order = numbered(d.select("b").distinct().withColumn("_one", F.lit(1)), ["_one"], "b", [], out="t").select("b", F.col("t").cast("long").alias("t"))
    d = d.filter("e is not null" if entities is None else F.col("e").isin(entities))
    means = cut_lineage(d.groupBy("e", "b").agg(F.avg("x").alias("x")).filter("x is not null"))
    return cut_lineage(order), means, means.groupBy("e").agg(F.avg("x").alias("c"))


def _short_pairs(means: DataFrame, order: DataFrame, centre: DataFrame, series: int, values: int, buckets: int, lags: int, schema: str, measure, only: bool, limit) -> DataFrame:
    """All pairs of series that lie in one slice of time.

    A block is as large as its values and its matrix may be; there are some blocks at least, for a task per pair of blocks, which reads
    both from shared storage. A task multiplies and solves tile by tile and gives out rows only.
    """
    import numpy as np
    import pyarrow as pa
    at_least = math.ceil(math.sqrt(8 * means.sparkSession.sparkContext.defaultParallelism))
    n_blocks = max(1, min(series, max(at_least, -(-values // BLOCK_VALUES), -(-series * (buckets + lags) // BLOCK_CELLS))))
    block = F.pmod(F.xxhash64("e"), F.lit(n_blocks)).cast("int")
    rows = means.join(centre, "e").join(order, "b").groupBy("e").agg(F.collect_list(F.col("t").cast("short")).alias("t"), F.collect_list(F.col("x") - F.col("c")).alias("x"))
    packed = rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("e", "t", "x")).alias("r")) \
        .select("block", F.col("r.e").alias("names"), F.transform("r.t", F.size).alias("sizes"), F.flatten("r.t").alias("t"), F.flatten("r.x").alias("x"))
    upper, columns = np.triu_indices(lags + 1), [c.split()[0] for c in schema.split(", ")]

    def tiles(row, end=""):
        """Names, known masks and lags of a block, tile by tile."""
        names, sizes, t, x = (row[c + end].values for c in ("names", "sizes", "t", "x"))
        sizes = np.asarray(sizes)
        full = np.full((buckets + lags, len(sizes)), np.nan)  # buckets count from 1
        full[np.asarray(t).astype(int) - 1 + lags, np.repeat(np.arange(len(sizes)), sizes)] = np.asarray(x)
        return [(names.slice(s, TILE), *_lagged(full[:, s:s + TILE], buckets, lags)) for s in range(0, len(sizes), TILE)]

    def solved(a, b, same):
        n, cov = _pair_covariances(_products(a[1], a[2], b[1], b[2], upper), len(a[0]), len(b[0]), lags)
        for forward, lag, i, j, stat, strong, points in _measured(n, cov, same, lags, measure, only, limit):
            first, second = a[0].take(pa.array(i)), b[0].take(pa.array(j))
            yield [first if forward else second, second if forward else first, pa.array(np.full(len(i), lag, dtype="int32")), pa.array(stat), pa.array(strong), pa.array(points)]

    def met(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                left = tiles(row)
                right = left if row["block"] == row["block_b"] else tiles(row, "_b")
                for i, a in enumerate(left):
                    for b in right[i:] if right is left else right:
                        yield from solved(a, b, a is b)

    def solve(batches):
        parts, held = [], 0
        for part in met(batches):
            parts.append(part)
            held += len(part[0])
            if held >= ROWS_OUT:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], columns)
                parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], columns)

    return block_pairs(packed, n_blocks, 16 * values).mapInArrow(solve, schema)


def _lagged(full, buckets: int, lags: int):
    """Known mask (buckets x series) and zero-filled lags (buckets x width x series) of a matrix with ``lags`` rows before the first bucket."""
    import numpy as np
    view = np.stack([full[lags - k:lags - k + buckets] for k in range(lags + 1)], axis=1)
    known = np.isfinite(view).all(axis=1)
    return known.astype(float), np.where(known[:, None], view, 0.0)


def _products(va, xa, vb, xb, upper) -> list:
    """Counts, sums, squares and products of all pairs of two sets of series and their lags."""
    flat = lambda m: m.reshape(len(m), -1)
    squares = lambda m: flat(m[:, upper[0]] * m[:, upper[1]])
    return [va.T @ vb, flat(xa).T @ vb, va.T @ flat(xb), squares(xa).T @ vb, va.T @ squares(xb), flat(xa).T @ flat(xb)]


def _block_moments(means: DataFrame, order: DataFrame, centre: DataFrame, series: int, lags: int) -> DataFrame:
    """Sums of products of every pair of series and their lags, per pair of blocks: (lo, hi, moments, names_lo, names_hi).

    Series are dealt into blocks, time into slices with a halo of ``lags`` buckets. A pair of blocks meets slice by slice; the sums
    of the slices are added 32 at a time.
    """
    import numpy as np
    import pandas as pd
    n_blocks = -(-max(1, series) // SERIES_BLOCK)
    names = centre.groupBy(F.pmod(F.xxhash64("e"), F.lit(n_blocks)).cast("int").alias("block")).agg(F.sort_array(F.collect_list("e")).alias("names"))
    rows = means.join(centre, "e").join(order, "b").select("e", (F.col("x") - F.col("c")).alias("x"), "t", F.pmod(F.xxhash64("e"), F.lit(n_blocks)).cast("int").alias("block"))
    at = lambda c: F.floor(c / BUCKET_SLICE).cast("int")
    rows = rows.withColumn("slice", F.explode(F.array_distinct(F.array(at(F.col("t")), at(F.col("t") + lags)))))
    packed = rows.groupBy("block", "slice").agg(F.collect_list(F.struct("e", "t", "x")).alias("r")).join(names, "block") \
        .select("block", "slice", "names", F.transform("r", lambda r: F.array_position("names", r["e"]) - 1).alias("s"), F.col("r.t").alias("t"), F.col("r.x").alias("x"))
    packed = cut_lineage(packed)
    last = F.lit(n_blocks - 1)
    left = packed.withColumn("lo", F.col("block")).withColumn("hi", F.explode(F.sequence("block", last))) \
        .select("lo", "hi", "slice", *[F.col(c).alias(f"{c}_lo") for c in ("names", "s", "t", "x")])
    right = packed.withColumn("hi", F.col("block")).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("block")))) \
        .select("lo", "hi", "slice", *[F.col(c).alias(f"{c}_hi") for c in ("names", "s", "t", "x")])
    width = lags + 1
    upper = np.triu_indices(width)

    def lagged(start, s, t, x, n):
        full = np.full((BUCKET_SLICE + lags, n), np.nan)
        full[t - (start - lags), s] = x
        return _lagged(full, BUCKET_SLICE, lags)

    def products(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                side = lambda names, s, t, x: lagged(r.slice * BUCKET_SLICE, s.astype(int), t, x, len(names))
                (va, xa), (vb, xb) = side(r.names_lo, r.s_lo, r.t_lo, r.x_lo), side(r.names_hi, r.s_hi, r.t_hi, r.x_hi)
                parts = _products(va, xa, vb, xb, upper)
                yield pd.DataFrame({"lo": np.array([r.lo], dtype="int32"), "hi": np.array([r.hi], dtype="int32"), "slice": np.array([r.slice], dtype="int32"),
                                    "moments": [np.concatenate([p.ravel() for p in parts])]})

    schema = "lo int, hi int, slice int, moments array<double>"
    sums = left.join(right.hint("merge"), ["lo", "hi", "slice"]).mapInPandas(products, schema)

    def add(pdf):
        return pd.DataFrame({"lo": pdf["lo"][:1], "hi": pdf["hi"][:1], "slice": pdf["slice"][:1], "moments": [np.sum(list(pdf["moments"]), axis=0)]})

    left_over = packed.agg(F.max("slice")).first()[0] or 0
    while left_over > 0:
        sums = sums.withColumn("slice", F.floor(F.col("slice") / 32).cast("int")).groupBy("lo", "hi", "slice").applyInPandas(add, schema)
        left_over //= 32
    return sums.drop("slice").join(names.toDF("lo", "names_lo"), "lo").join(names.toDF("hi", "names_hi"), "hi")


def _pair_covariances(moments, na: int, nb: int, lags: int):
    """Counts (na, nb) and, for two places p, q of [lags of the first series, lags of the second], covariances (na, nb) ``cov(p, q)``."""
    import numpy as np
    w = lags + 1
    at = {(p, q): k for k, (p, q) in enumerate(zip(*np.triu_indices(w)))}
    n, sa, sb, qa, qb, c = (p.reshape(z) for p, z in zip(moments, [(na, nb), (w, na, nb), (na, w, nb), (len(at), na, nb), (na, len(at), nb), (w, na, w, nb)]))
    means, known = {}, {}

    def mean(p):
        if p not in means:
            means[p] = (sa[p] if p < w else sb[:, p - w]) / n
        return means[p]

    def cov(p, q):
        p, q = (int(p), int(q)) if p <= q else (int(q), int(p))
        if (p, q) not in known:
            raw = qa[at[p, q]] if q < w else qb[:, at[p - w, q - w]] if p >= w else c[p, :, q - w]
            with np.errstate(divide="ignore", invalid="ignore"):
                known[p, q] = raw / n - mean(p) * mean(q)
        return known[p, q]

    return n, cov


def _candidates(n, cov, x: int, y: int, z: int, limit):
    """Pairs whose squared partial correlation of ``x`` and ``y`` given ``z`` reaches ``limit``, or is too ill-conditioned to tell.

    Some products a pair, without a root or a quotient: the few that are left are measured.
    """
    import numpy as np
    vx, vy, vz, xy, xz, yz = cov(x, x), cov(y, y), cov(z, z), cov(x, y), cov(x, z), cov(y, z)
    both, one, other = xy * vz - xz * yz, vx * vz, vy * vz
    a, b = one - xz * xz, other - yz * yz
    clear = (a > 1e-3 * one) & (b > 1e-3 * other) & (a > 1e-9 * (vx + vz) ** 2)
    return (limit < np.inf) & ~(clear & (both * both < (limit * (1 - 1e-6)) * (a * b)))


def _measured(n, cov, same: bool, lags: int, measure, only: bool = False, limit=None):
    """(forward, lag, i, j, statistic, significant, points) of the pairs with a statistic, both ways unless the two sets are the ``same``."""
    import numpy as np
    w = lags + 1
    counts = n.astype("int64")
    for forward in (True,) if same else (True, False):
        cause, effect = (np.arange(w), w + np.arange(w)) if forward else (w + np.arange(w), np.arange(w))
        for lag in range(1, w):
            with np.errstate(all="ignore"):
                table = limit(np.arange(counts.max(initial=0) + 1), lag) if only and limit else None
                if table is None:
                    i, j = np.indices(n.shape).reshape(2, -1)
                else:
                    i, j = np.nonzero(_candidates(n, cov, cause[lag], effect[0], effect[1], table[counts]))
                of = lambda m: m.ravel() if table is None else m[i, j]
                stat, strong = measure(of(n), lambda p, q: of(cov(p, q)), cause, effect, lag)
            good = np.isfinite(stat) & strong if only else np.isfinite(stat)
            if same:
                good &= i != j
            if good.any():
                yield forward, lag, i[good], j[good], stat[good], strong[good], counts[i[good], j[good]]


def _per_pair(sums: DataFrame, schema: str, lags: int, measure) -> DataFrame:
    """Rows of ``schema`` for all ordered pairs of the series of every pair of blocks."""
    import numpy as np
    import pandas as pd
    columns = [c.split()[0] for c in schema.split(", ")]

    def solve(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a, b = list(r.names_lo), list(r.names_hi)
                w, na, nb = lags + 1, len(a), len(b)
                h = w * (w + 1) // 2
                moments = np.split(np.asarray(r.moments, dtype=float), np.cumsum([1, w, w, h, h]) * na * nb)
                n, cov = _pair_covariances(moments, na, nb, lags)
                for forward, lag, i, j, stat, strong, points in _measured(n, cov, r.lo == r.hi, lags, measure):
                    first, second = [a[k] for k in i], [b[k] for k in j]
                    yield pd.DataFrame(dict(zip(columns, (first if forward else second, second if forward else first, np.full(len(i), lag, dtype="int32"), stat, strong, points))))

    return sums.mapInPandas(solve, schema)


def _inverse(a):
    """Pseudo-inverses of symmetric matrices (..., k, k): directly where one or two unknowns are well conditioned."""
    import numpy as np
    k = a.shape[-1]
    if k == 1:
        return np.where(a != 0, 1 / a, 0.0)
    if k > 2:
        return np.linalg.pinv(a, 1e-12, True)
    p, q, r = a[..., 0, 0], a[..., 1, 1], a[..., 0, 1]
    det = p * q - r * r
    good = (det > 1e-4 * p * q) & (det > 1e-10 * (p + q) ** 2) & (p > 0)
    out = np.empty_like(a)
    out[..., 0, 0], out[..., 1, 1], out[..., 0, 1], out[..., 1, 0] = q / det, p / det, -r / det, -r / det
    out[~good] = np.linalg.pinv(a[~good], 1e-12, True)
    return out


def granger(df: DataFrame, entity: str, bucket: str, value: str, entities: list | None = None, max_lag: int = 5, f_critical: float = 3.84,
            significant_only: bool = False) -> DataFrame:
    """F statistic of adding the cause's lags to a regression on the effect's own lags, for all ordered pairs of series.

    Sums of products are block matrix products, the normal equations (at most 2 x max_lag unknowns) are solved in tasks, pair block by
    pair block; the driver holds nothing. Pairs without enough common buckets or with a perfect fit have no row.
    """
    import numpy as np

    def measure(n, cov, cause, effect, lag):
        y = effect[0]

        def rss(xs):
            a, b = np.stack([np.stack([cov(p, q) for q in xs], axis=-1) for p in xs], axis=-2), np.stack([cov(p, y) for p in xs], axis=-1)
            usable = np.isfinite(a).all(axis=(-2, -1))
            inverse = _inverse(np.where(usable[..., None, None], a, 0.0))
            return (cov(y, y) - np.einsum("...k,...kl,...l->...", b, inverse, b)) * n

        own = effect[1:lag + 1]
        small, large = rss(own), rss(np.concatenate([own, cause[1:lag + 1]]))
        dof = n - 2 * lag - 1
        f = (small - large) / lag / (large / dof)
        f = np.where((dof > 0) & (large > 1e-10 * n * cov(y, y)), f, np.nan)
        return f, f > f_critical

    def limit(points, lag):  # F = s^2 / (1 - s^2) * (n - 3)
        return np.where(points > 3, f_critical / (f_critical + points - 3.0), np.inf) if lag == 1 and f_critical > 0 else None

    return _pair_rows(df, entity, bucket, value, entities, max_lag, "f_statistic", measure, significant_only, limit)


def lagged_partial_correlations(df: DataFrame, entity: str, bucket: str, value: str, entities: list | None = None, max_lag: int = 5, z_critical: float = 1.96,
                                significant_only: bool = False) -> DataFrame:
    """Partial correlation of each effect with each lagged cause, given the effect's own first lag (Fisher z test); pairs with more
    than four common buckets."""
    import numpy as np

    def measure(n, cov, cause, effect, lag):
        y, z, x = effect[0], effect[1], cause[lag]
        sd = {p: np.sqrt(np.maximum(cov(p, p), 0)) for p in (x, y, z)}
        r = lambda p, q: cov(p, q) / (sd[p] * sd[q])
        p = (r(x, y) - r(x, z) * r(y, z)) / np.sqrt((1 - r(x, z) ** 2) * (1 - r(y, z) ** 2))
        p = np.where(n > 4, p, np.nan)
        return p, np.abs(0.5 * np.log((1 + p) / (1 - p)) * np.sqrt(n - 4)) > z_critical

    def limit(points, lag):
        return np.where(points > 4, np.tanh(z_critical / np.sqrt(np.maximum(points - 4.0, 1e-9))) ** 2, np.inf) if z_critical > 0 else None

    return _pair_rows(df, entity, bucket, value, entities, max_lag, "strength", measure, significant_only, limit).drop("points")
