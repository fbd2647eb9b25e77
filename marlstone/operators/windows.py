"""Window functions that hold when one key owns a large share of the rows.

``Window.partitionBy(key)`` sends every row of a key to one task. The functions here cut each key's
ordered rows into slices (a time bucket, or a run of consecutive row numbers), work inside
(key, slice), and bring what a slice needs from its neighbours in one of two ways:

* carry: one aggregate row per (key, slice), folded over the slices of a key (running totals);
* halo: copies of the few rows next to a slice border (bounded ROWS and RANGE frames).

The result equals that of the plain window; only the unit of work changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.columns import micros, null_safe_join

#: Rows of one key handled by one window group in ROWS frames.
CHUNK_ROWS = 200_000
DAY = 86_400


def _slice_of(ts: str | Column, width_seconds: float) -> Column:
    return F.floor(micros(ts) / F.lit(int(width_seconds * 1_000_000)))


def numbered(df: DataFrame, keys: list[str], ts: str, ties: list[str],
             slice_seconds: float = DAY, out: str = "_rn", slice_by: Column | None = None) -> DataFrame:
    """1-based row number per key in (ts, ties) order, without one task per key.

    Row numbers inside (key, slice) plus the number of rows in earlier slices. ``slice_by`` replaces the
    time slice by any expression that never decreases along the order.
    """
    base = df.withColumn("_slice", _slice_of(ts, slice_seconds) if slice_by is None else slice_by)
    per_slice = base.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(F.col("_slice").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(*keys, "_slice",
                               F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*keys, "_slice").orderBy(ts, *ties)
    local = base.withColumn(out, F.row_number().over(inner))
    return (null_safe_join(local, offsets, [*keys, "_slice"], "left")
            .withColumn(out, F.col(out) + F.col("_offset")).drop("_slice", "_offset"))


def rows_frame(df: DataFrame, keys: list[str], ts: str, ties: list[str],
               make: Callable[[Window], dict[str, Column]], before: int = 0, after: int = 0,
               slice_seconds: float = DAY, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Window columns whose frames reach at most ``before`` rows back and ``after`` rows ahead.

    ``make(w)`` gets the ordered window and returns the columns to add; it may use ``lag``, ``lead``
    and ``rowsBetween`` inside the declared reach. Chunks of ``chunk_rows`` consecutive rows of a key
    are independent once the rows next to a border are copied over.
    """
    size = max(chunk_rows, before, after, 1)
    pos = (F.col("_rn") - 1) % size
    home = F.floor((F.col("_rn") - 1) / F.lit(size))
    chunked = numbered(df, keys, ts, ties, slice_seconds).withColumn("_home", home)
    copies = [F.col("_home")]
    if before:
        copies.append(F.when(pos >= size - before, F.col("_home") + 1))
    if after:
        copies.append(F.when(pos < after, F.col("_home") - 1))
    spread = chunked.withColumn("_chunk", F.explode(F.array_compact(F.array(*copies))))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_rn")
    return _with_layers(spread, make, w).filter("_chunk = _home").drop("_chunk", "_home", "_rn")


def _with_layers(df: DataFrame, make, w) -> DataFrame:
    """``make`` returns one dict, or a list of dicts whose later ones use columns of earlier ones."""
    layers = make(w)
    for layer in layers if isinstance(layers, list) else [layers]:
        df = df.withColumns(layer)
    return df


def _with_halo(df: DataFrame, ts: str, before: float, after: float, slice_seconds: float | None = None) -> DataFrame:
    """Rows in their time slice (``_chunk`` = ``_home``) and, near a border, in the neighbouring one as well; null times share a slice."""
    width = max(slice_seconds or 0, 4 * max(before, after), 60)
    us = int(width * 1_000_000)
    base = df.withColumn("_us", micros(ts)).withColumn("_home", F.floor(F.col("_us") / us))
    offset = F.pmod(F.col("_us"), F.lit(us))
    copies = [F.col("_home")]
    if before:
        copies.append(F.when(offset >= us - int(before * 1_000_000), F.col("_home") + 1))
    if after:
        copies.append(F.when(offset <= int(after * 1_000_000), F.col("_home") - 1))
    targets = F.coalesce(F.nullif(F.array_compact(F.array(*copies)), F.array().cast("array<bigint>")),
                         F.array(F.lit(None).cast("bigint")))
    return base.withColumn("_chunk", F.explode(targets))


def range_frame(df: DataFrame, keys: list[str], ts: str,
                make: Callable[[Window], dict[str, Column]], before: float = 0, after: float = 0,
                ties: list[str] | None = None, slice_seconds: float | None = None) -> DataFrame:
    """Window columns whose frames reach at most ``before`` / ``after`` seconds from the row's time.

    The window handed to ``make`` is ordered by epoch microseconds (``rangeBetween`` counts in them),
    or by (microseconds, ties) when ``ties`` is given, for ROWS frames bounded in time.
    """
    spread = _with_halo(df, ts, before, after, slice_seconds)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_us", *(ties or []))
    return (_with_layers(spread, make, w)
            .filter(F.col("_chunk").eqNullSafe(F.col("_home"))).drop("_chunk", "_home", "_us"))


def sliding_summaries(df: DataFrame, keys: list[str], ts: str, value: str, measures: dict[str, tuple[str, float]], keep: list[str]) -> DataFrame:
    """``keep`` and per measure ``{out: (mean | min | max | median, seconds)}`` of the known values up to and with the row's time.

    Spark computes such a frame anew at every row. Here the frame of a (key, time slice) slides: values enter and leave running
    sums, queues and an ordered list, so a row costs the logarithm of its frame at most. Rows of one time share their frame.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from pandas.api.indexers import BaseIndexer

    class Frame(BaseIndexer):
        def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
            return self.start, self.end

    def plain(kind, v):
        """One frame with infinite or NaN values, NaN above all others."""
        if not len(v):
            return 0.0
        v = np.sort(v)
        a, b = v[(len(v) - 1) // 2], v[len(v) // 2]
        return {"mean": v.mean(), "min": v[0], "max": v[-1], "median": a if a == b else 0.5 * a + 0.5 * b}[kind]

    def slide(table):
        table = table.sort_by("_us")
        us = table["_us"].fill_null(0).to_numpy()
        known = table["_x"].is_valid().to_numpy()
        x = table["_x"].fill_null(0.0).to_numpy()
        here = table["_here"].to_numpy()
        end, seen = np.searchsorted(us, us, "right"), np.concatenate([[0], np.cumsum(known)])
        finite = np.isfinite(x).all()
        series = pd.Series(np.where(known, x, np.nan))
        out = table.select(keep).filter(pa.array(here))
        for name, (kind, seconds) in measures.items():
            start = np.searchsorted(us, us - int(seconds * 1_000_000), "left")
            if finite:
                got = getattr(series.rolling(Frame(start=start, end=end), min_periods=1), kind)().to_numpy()
            else:
                with np.errstate(invalid="ignore"):
                    got = np.array([plain(kind, x[a:b][known[a:b]]) for a, b in zip(start, end)], dtype=float)
            out = out.append_column(name, pa.array(got[here], mask=(seen[end] == seen[start])[here]))
        return out

    spread = _with_halo(df, ts, max(s for _, s in measures.values()), 0)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} double" for n in measures])
    # keys under names of their own, as they may be kept too
    groups = [F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]
    rows = spread.select(*groups, "_chunk", *keep, "_us", F.col(value).cast("double").alias("_x"), F.col("_chunk").eqNullSafe(F.col("_home")).alias("_here"))
    return rows.groupBy(*[f"_g{i}" for i in range(len(keys))], "_chunk").applyInArrow(slide, schema)


_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _merge_two(kind: str, a: Column, b: Column) -> Column:
    if kind == "min":
        return F.least(a, b)
    if kind == "max":
        return F.greatest(a, b)
    return F.coalesce(a + b, a, b)


def running(df: DataFrame, keys: list[str], ts: str, ties: list[str],
            measures: dict[str, tuple[str, Column]], include_current: bool = True,
            slice_seconds: float = DAY, slice_by: Column | None = None) -> DataFrame:
    """Running sum / count / min / max per key: ``measures = {out: (kind, column)}``.

    One partial row per (key, slice) carries the totals of earlier slices.
    """
    base = df.withColumn("_slice", _slice_of(ts, slice_seconds) if slice_by is None else slice_by)
    partial = base.groupBy(*keys, "_slice").agg(
        *[_FIRST[k](c).alias(f"_c_{n}") for n, (k, c) in measures.items()])
    earlier = Window.partitionBy(*keys).orderBy(F.col("_slice").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = partial.select(*keys, "_slice", *[
        _MERGE[k](f"_c_{n}").over(earlier).alias(f"_c_{n}") for n, (k, _) in measures.items()])
    inner = Window.partitionBy(*keys, "_slice").orderBy(ts, *ties) \
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    local = base.withColumns({f"_l_{n}": _FIRST[k](c).over(inner) for n, (k, c) in measures.items()})
    joined = null_safe_join(local, carry, [*keys, "_slice"], "left")
    merged = {n: _merge_two(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in measures.items()}
    helpers = [f"_{p}_{n}" for p in "cl" for n in measures]
    return joined.withColumns(merged).drop("_slice", *helpers)


def running_moments(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: Column,
                    prefix: str, include_current: bool = True, slice_seconds: float = DAY) -> DataFrame:
    """Running count, mean and population deviation of ``value``: ``{prefix}_n/_mean/_std``.

    Count, mean and sum of squared deviations are merged, not raw squares, so values far from zero keep their deviation: slices
    are measured around the mean of all earlier and later ones, and a row merges its slice so far with the slices before.
    """
    v = value.cast("double")
    base = df.withColumn("_slice", _slice_of(ts, slice_seconds))
    partial = base.groupBy(*keys, "_slice").agg(F.count(v).alias("_n"), F.avg(v).alias("_m"), (F.var_pop(v) * F.count(v)).alias("_q"))
    every = Window.partitionBy(*keys)
    centred = partial.withColumn("_c", F.sum(F.col("_n") * F.col("_m")).over(every) / F.sum("_n").over(every)).withColumn("_d", F.col("_m") - F.col("_c"))
    earlier = every.orderBy(F.col("_slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    n1, s1 = F.sum("_n").over(earlier), F.sum(F.col("_n") * F.col("_d")).over(earlier)
    between = F.greatest(F.sum(F.col("_n") * F.col("_d") * F.col("_d")).over(earlier) - s1 * s1 / F.nullif(n1, F.lit(0)), F.lit(0.0))
    carry = centred.select(*keys, "_slice", n1.alias("_n1"), (F.col("_c") + s1 / F.nullif(n1, F.lit(0))).alias("_m1"), (F.sum("_q").over(earlier) + between).alias("_q1"))
    inner = Window.partitionBy(*keys, "_slice").orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    local = base.withColumns({"_n2": F.count(v).over(inner), "_m2": F.avg(v).over(inner), "_q2": F.var_pop(v).over(inner) * F.count(v).over(inner)})
    joined = null_safe_join(local, carry, [*keys, "_slice"], "left")
    n1, n2 = F.coalesce("_n1", F.lit(0)), F.coalesce("_n2", F.lit(0))
    n = n1 + n2
    whole = F.nullif(n, F.lit(0))
    step = F.col("_m2") - F.col("_m1")
    mean = F.when(n1 == 0, F.col("_m2")).when(n2 == 0, F.col("_m1")).otherwise(F.col("_m1") + step * n2 / whole)
    squares = F.coalesce("_q1", F.lit(0.0)) + F.coalesce("_q2", F.lit(0.0)) + F.when((n1 > 0) & (n2 > 0), step * step * n1 * n2 / whole).otherwise(0.0)
    return (joined.withColumns({f"{prefix}_n": n, f"{prefix}_mean": mean, f"{prefix}_std": F.sqrt(squares / whole)})
            .drop("_slice", "_n1", "_m1", "_q1", "_n2", "_m2", "_q2"))


def value_slices(df: DataFrame, keys: list[str], value: str, slices: int = 64, out: str = "_cut") -> DataFrame:
    """Add a slice number that grows with ``value`` and holds about 1/slices of a key's rows."""
    probs = [i / slices for i in range(1, slices)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, probs, 1000).alias("_cuts"))
    return (null_safe_join(df, cuts, keys, "left")
            .withColumn(out, F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts"))


def latest(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per key in the given order.

    ``row_number() <= k`` is pushed below the shuffle (window group limit), so at most ``k`` rows per
    key leave a map task whatever the size of the key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def ranked_top(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """As :func:`latest`, keeping the rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def fill_series(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: str, method: str = "forward",
                slice_seconds: float = DAY) -> DataFrame:
    """Forward fill, or linear interpolation in time between the known neighbours (ends stay null).

    The last known (time, value) of each slice is carried over the slices of a key, in both directions.
    """
    base = df.withColumns({"_us": micros(ts), "_slice": _slice_of(ts, slice_seconds)})
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_us").alias("t"), F.col(value).alias("v")))
    base = base.withColumn("_known", known)
    per = base.groupBy(*keys, "_slice").agg(F.max("_known").alias("_last"), F.min("_known").alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_slice")
    carry = per.select(
        *keys, "_slice",
        F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_first", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    up = Window.partitionBy(*keys, "_slice").orderBy(F.col("_us"), *ties).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "_slice").orderBy(F.col("_us").desc(), *[F.col(c).desc() for c in ties]) \
        .rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({"_p": F.last("_known", ignorenulls=True).over(up), "_n": F.last("_known", ignorenulls=True).over(down)})
    out = null_safe_join(local, carry, [*keys, "_slice"], "left")
    p, n = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    if method == "forward":
        filled = F.coalesce(F.col(value), p["v"])
    else:
        share = (F.col("_us") - p["t"]) / F.nullif((n["t"] - p["t"]).cast("double"), F.lit(0.0))
        filled = F.coalesce(F.col(value), p["v"] + (n["v"] - p["v"]) * share)
    return out.withColumn(value, filled).drop("_us", "_slice", "_known", "_p", "_n", "_before", "_after")
