"""Ordered folds per key that do not pass a whole key through one task.

* :func:`affine_scan`: recurrences ``x = a * x + b`` (moving averages, trust scores, baselines). Maps of
  this form compose to one map of the same form, so chunks of rows are reduced on their own and only the
  chunk maps are folded in order.
* :func:`sliding_totals`: sums over a trailing time range, as a running total of entering and leaving rows.
* :func:`cooldown`: accept a row only when the last accepted one lies far enough back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.columns import micros, null_safe_join
from marlstone.operators.windows import DAY, numbered, range_frame, rows_frame, running
from marlstone.session import cut_lineage

#: Rows per chunk, chunk maps per group, and how far the product of factors may fall within a segment, as a logarithm.
CHUNK, MAPS, FALL = 2000, 1000, 200.0


def _running_fold(maps: str, start: Column) -> Column:
    """(idx, value before the map) for each map of an ordered array."""
    zero = F.struct(start.cast("double").alias("x"),
                    F.array().cast("array<struct<idx:bigint,x:double>>").alias("out"))
    step = lambda acc, m: F.struct(
        (m["a"] * acc["x"] + m["b"]).alias("x"),
        F.concat(acc["out"], F.array(F.struct(m["idx"].alias("idx"), acc["x"].alias("x")))).alias("out"))
    return F.aggregate(maps, zero, step, lambda acc: acc["out"])


def _collapse(maps: str) -> Column:
    zero = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(maps, zero, lambda acc, m: F.struct((acc["a"] * m["a"]).alias("a"),
                                                           (m["a"] * acc["b"] + m["b"]).alias("b")))


def _carry_in(chunks: DataFrame, keys: list[str], start: float, maps: int) -> DataFrame:
    """Value before each segment, from the (key, idx, a, b) maps of the segments, in two ordered levels."""
    ordered = lambda idx: F.array_sort(F.collect_list(F.struct(F.col(idx).alias("idx"), "a", "b")))
    groups = chunks.withColumn("_sup", F.floor(F.col("idx") / maps)).groupBy(*keys, "_sup").agg(ordered("idx").alias("_maps"))
    whole = groups.select(*keys, "_sup", _collapse("_maps").alias("_m")).select(*keys, "_sup", "_m.a", "_m.b")
    top = whole.groupBy(*keys).agg(ordered("_sup").alias("_maps"))
    before = top.select(*keys, F.inline(_running_fold("_maps", F.lit(start)))).withColumnsRenamed({"idx": "_sup", "x": "_x0"})
    return (null_safe_join(groups, before, [*keys, "_sup"])
            .select(*keys, F.inline(_running_fold("_maps", F.col("_x0")))))


def affine_scan(df: DataFrame, keys: list[str], ts: str, ties: list[str], a: Column, b: Column, out: str,
                start: float = 0.0, slice_seconds: float = DAY, chunk_rows: int = CHUNK, maps: int = MAPS,
                has_rn: bool = False) -> DataFrame:
    """Add ``out`` = a * (previous out) + b in (ts, ties) order; a in [0, 1]; ``_rn`` may be used in a and b.

    A chunk is cut into segments, so that the product of factors after a segment's first row stays above exp(-2 * FALL); a row whose
    factor is 0 or that small begins a segment. Inside one, with P the running product after the first row, the solution is
    P * (a1 * x0 + b1 + sum(b / P)). The solved segments are read twice (their last rows make the maps), hence the checkpoint.
    With ``has_rn`` the frame already holds the row number ``_rn``, which then stays.
    """
    d = (df if has_rn else numbered(df, keys, ts, ties, slice_seconds)).withColumns({"_a": a.cast("double"), "_b": b.cast("double")}) \
        .withColumn("_chunk", F.floor((F.col("_rn") - 1) / chunk_rows))
    # Segments count the falls so far and the factors that are too small; their number grows with the rows of the chunk.
    w = Window.partitionBy(*keys, "_chunk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    low = F.col("_a") < F.exp(F.lit(-FALL))
    fallen = F.sum(F.when(low, 0.0).otherwise(F.greatest(-F.log("_a"), F.lit(0.0)))).over(w)
    d = d.withColumn("_chunk", F.col("_chunk") * (2 * chunk_rows + 1) + F.floor(fallen / FALL) + F.sum(low.cast("long")).over(w))
    part = Window.partitionBy(*keys, "_chunk").orderBy("_rn")
    w = part.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(part) == 1
    d = d.withColumn("_log", F.sum(F.when(first, 0.0).otherwise(F.log("_a"))).over(w)).withColumn("_a1", F.first("_a").over(w))
    d = cut_lineage(d.withColumn("_s", F.sum(F.col("_b") * F.exp(-F.col("_log"))).over(w)))
    ends = d.groupBy(*keys, "_chunk").agg(F.max_by(F.struct("_log", "_s", "_a1"), "_rn").alias("_e"))
    chunks = ends.select(*keys, F.col("_chunk").alias("idx"), (F.exp("_e._log") * F.col("_e._a1")).alias("a"),
                         (F.exp("_e._log") * F.col("_e._s")).alias("b"))
    carry = _carry_in(chunks, keys, start, maps * (2 * chunk_rows + 1)).withColumnsRenamed({"idx": "_chunk", "x": "_x0"})
    return (null_safe_join(d, carry, [*keys, "_chunk"])
            .withColumn(out, F.exp("_log") * (F.col("_a1") * F.col("_x0") + F.col("_s")))
            .drop("_a", "_b", "_a1", "_chunk", "_log", "_s", "_x0", *([] if has_rn else ["_rn"])))


def ema(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: Column, out: str, keep: float = 0.9,
        start: float | None = 0.0, **options) -> DataFrame:
    """Exponential moving average keep * old + (1 - keep) * value; ``start=None`` begins at the first value."""
    a, b = F.lit(keep), value * (1 - keep)
    if start is None:
        a, b = F.when(F.col("_rn") == 1, F.lit(1.0)).otherwise(a), F.when(F.col("_rn") == 1, value).otherwise(b)
    return affine_scan(df, keys, ts, ties, a, b, out, start or 0.0, **options)


def sliding_totals(df: DataFrame, keys: list[str], ts: str, ident: str, seconds: float,
                   measures: dict[str, Column], slice_seconds: float = DAY) -> DataFrame:
    """Sums over [ts - seconds, ts] of the key (rows of equal time included), one per measure.

    Each row enters at its time and leaves just after the range: the sum is a running total over both, so
    the cost does not depend on how many rows a range holds. Sums run in decimals to stay exact.
    """
    dec = {n: c.cast("decimal(28,6)") for n, c in measures.items()}
    base = df.withColumns({"_row": F.struct(*df.columns), "_us": micros(ts), **{f"_m_{n}": c for n, c in dec.items()}})
    names = [f"_m_{n}" for n in measures]
    enter = base.select(*keys, "_us", F.lit(1).alias("_kind"), F.col(ident).alias("_id"), "_row", *names)
    leave = base.select(*keys, (F.col("_us") + int(seconds * 1_000_000)).alias("_us"), F.lit(2).alias("_kind"),
                        F.col(ident).alias("_id"), *[(-F.col(n)).alias(n) for n in names])
    both = enter.unionByName(leave, allowMissingColumns=True)
    # leaving rows sort after the entering ones of the same microsecond: the range is closed
    slices = F.floor(F.col("_us") / int(slice_seconds * 1_000_000))
    total = running(both, keys, "_us", ["_kind", "_id"], {f"_t_{n}": ("sum", F.col(f"_m_{n}")) for n in measures},
                    slice_by=slices).filter(F.col("_kind") == 1)
    # rows that share a time all see the last of them
    peers = total.groupBy(*keys, "_us").agg(*[F.max_by(f"_t_{n}", "_id").alias(f"_p_{n}") for n in measures])
    return null_safe_join(total, peers, [*keys, "_us"]).select(
        "_row.*", *[F.col(f"_p_{n}").cast("double").alias(n) for n in measures])


def cooldown(df: DataFrame, keys: list[str], ts: str, ident: str, seconds: float, out: str = "accepted") -> DataFrame:
    """Mark the rows a cooldown lets through: the first, then each first row at least ``seconds`` after it.

    Each row points to the first row at or after its time plus the cooldown. A row without another one in
    the cooldown before it is accepted in any case; the rest follows along the pointers, whose reach doubles
    every round. ``ident`` must be unique.
    """
    us = int(seconds * 1_000_000)
    base = df.select(*keys, F.col(ident).alias("_id"), micros(ts).alias("_us"))
    probes = base.select(*keys, F.col("_id").alias("_probe"), (F.col("_us") + us).alias("_us"), F.lit(1).alias("_tag"))
    rows = base.select(*keys, "_id", "_us", F.lit(0).alias("_tag"))
    width = 4 * us
    at = lambda d: d.withColumn("_slice", F.floor(F.col("_us") / width))
    # a row serves the probes of its own slice and, within one cooldown of the border, of the slice before
    spread = rows.withColumn("_slice", F.explode(F.array_compact(F.array(
        F.floor(F.col("_us") / width), F.when(F.col("_us") % width <= us, F.floor(F.col("_us") / width) - 1)))))
    w = Window.partitionBy(*keys, "_slice").orderBy(F.col("_us").desc(), F.col("_tag").asc(), F.col("_id").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    found = at(probes).unionByName(spread, allowMissingColumns=True).withColumn(
        "_next", F.last("_id", ignorenulls=True).over(w)).filter("_tag = 1").select(F.col("_probe").alias("_id"), "_next")
    gap = range_frame(base.withColumn("_t", F.timestamp_micros("_us")), keys, "_t",
                      lambda v: {"_prev": F.lag("_us").over(v)}, before=seconds, ties=["_id"])
    root = F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= us)
    reached = cut_lineage(gap.filter(root).select("_id"))
    jump = cut_lineage(found.filter(F.col("_next").isNotNull()))
    while True:
        step = reached.join(jump, "_id").select(F.col("_next").alias("_id"))
        grown = cut_lineage(reached.unionByName(step).distinct())
        if grown.count() == reached.count() and step.isEmpty():
            break
        reached = grown
        hop = jump.select(F.col("_id").alias("_next"), F.col("_next").alias("_far"))
        jump = cut_lineage(jump.join(hop, "_next").select("_id", F.col("_far").alias("_next")))
        if jump.isEmpty():
            break
    marks = reached.select(F.col("_id").alias(ident), F.lit(True).alias(out))
    return df.join(marks, ident, "left").withColumn(out, F.coalesce(out, F.lit(False)))
