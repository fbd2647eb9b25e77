"""Joins beyond the plain equi-join: as-of, interval, radius, theta and keyless."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.columns import col, micros, null_safe_join
from marlstone.session import cut_lineage

#: Most rows a keyless join may replicate onto the other side.
KEYLESS_LIMIT = 10_000


def point_in_time_join(entities: DataFrame, features: DataFrame, keys: list[str], entity_ts: str,
                       feature_ts: str, columns: list[str], lookback_seconds: float | None = 86_400,
                       slice_seconds: float = 86_400) -> DataFrame:
    """Left as-of join: newest feature row at or before the entity time, no older than the lookback.

    Both sides are cut into (key, time slice). The newest feature of each slice is carried to the slices
    after it, so a window over one slice sees every row it needs: no fan-out, no pair of all versions,
    and no task that holds a whole key. Equal feature times are settled by the feature values.
    """
    width = int(max(slice_seconds, lookback_seconds or 0) * 1_000_000)
    feat = F.struct(micros(feature_ts).alias("_fts"), *[F.col(c) for c in columns])
    f = features.dropna(subset=keys).select(*keys, feat.alias("_f"), F.floor(micros(feature_ts) / width).alias("_slice"))
    e = entities.withColumns({"_e": F.struct(*entities.columns), "_us": micros(entity_ts)}) \
        .withColumn("_slice", F.floor(F.col("_us") / width)).select(*keys, "_e", "_us", "_slice")
    newest = f.groupBy(*keys, "_slice").agg(F.max("_f").alias("_f"))
    if lookback_seconds is not None:
        # the lookback fits into one slice, so the carry is needed one slice on and no further
        carried = newest.withColumn("_slice", F.col("_slice") + 1)
    else:
        marks = newest.unionByName(
            e.select(*keys, "_slice", F.lit(None).cast(newest.schema["_f"].dataType).alias("_f")).distinct())
        per_slice = marks.groupBy(*keys, "_slice").agg(F.max("_f").alias("_f"))
        w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = per_slice.select(*keys, "_slice", F.last("_f", ignorenulls=True).over(w).alias("_f")) \
            .filter(F.col("_f").isNotNull())
    side = lambda d: d.select(*keys, "_slice", "_f", F.col("_f._fts").alias("_us"), F.lit(0).alias("_tag"))
    rows = side(f).unionByName(side(carried)).unionByName(
        e.select(*keys, "_slice", "_us", "_e", F.lit(1).alias("_tag")), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy("_us", "_tag", "_f") \
        .rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_hit", F.last("_f", ignorenulls=True).over(w)).filter(F.col("_tag") == 1)
    keep = F.lit(True) if lookback_seconds is None else \
        F.col("_us") - F.col("_hit._fts") <= int(lookback_seconds * 1_000_000)
    return seen.select("_e.*", *[F.when(keep, F.col(f"_hit.{c}")).alias(c) for c in columns])


def historical_features(entities: DataFrame, groups: list[dict], entity_ts: str) -> DataFrame:
    """Fold several feature groups onto the entities: timed groups as-of, untimed ones by key."""
    out = entities
    for g in groups:
        if g.get("ts"):
            out = point_in_time_join(out, g["df"], g["keys"], entity_ts, g["ts"], g["columns"],
                                     g.get("lookback_seconds", 86_400))
        else:
            out = out.join(g["df"].select(*g["keys"], *g["columns"]), g["keys"], "left")
    return out


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
                  before_seconds: float, after_seconds: float, how: str = "inner") -> DataFrame:
    """Rows of the same key with ``right_ts`` in [left_ts - before, left_ts + after].

    The left row names the one or more time slices its interval meets; the join is then on
    (key, slice), which spreads a hot key over its slices.
    """
    lo, hi = int(before_seconds * 1_000_000), int(after_seconds * 1_000_000)
    width = max(lo + hi, 60_000_000)
    l = left.withColumn("_lus", micros(left_ts)).withColumn("_slice", F.explode_outer(F.sequence(
        F.floor((F.col("_lus") - lo) / width), F.floor((F.col("_lus") + hi) / width))))
    r = right.withColumn("_rus", micros(right_ts)).withColumn("_slice", F.floor(F.col("_rus") / width)) \
        .withColumnsRenamed({k: f"_r_{k}" for k in keys}).withColumnRenamed("_slice", "_r_slice")
    on = (F.col("_slice") == F.col("_r_slice")) & F.col("_rus").between(F.col("_lus") - lo, F.col("_lus") + hi)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return l.join(r, on, how).drop("_lus", "_rus", "_slice", "_r_slice", *[f"_r_{k}" for k in keys])


def next_within(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
                within_seconds: float, out: str = "label") -> DataFrame:
    """0/1 label: does the key have a right row at or after the left row and within the horizon?

    A union and one window per (key, slice), not a join of all pairs.
    """
    width = int(max(within_seconds, 60) * 1_000_000)
    l = left.withColumns({"_row": F.struct(*left.columns), "_us": micros(left_ts)})
    l = l.select(*keys, "_row", "_us", F.floor(F.col("_us") / width).alias("_slice"), F.lit(1).alias("_tag"))
    first = right.select(*keys, micros(right_ts).alias("_us"))
    r = first.withColumn("_slice", F.explode(F.array(F.floor(F.col("_us") / width), F.floor(F.col("_us") / width) - 1))) \
        .select(*keys, "_us", "_slice", F.lit(0).alias("_tag")).distinct()
    w = Window.partitionBy(*keys, "_slice").orderBy(F.col("_us").desc(), F.col("_tag").asc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    rows = l.unionByName(r, allowMissingColumns=True).withColumn(
        "_next", F.last(F.when(F.col("_tag") == 0, F.col("_us")), ignorenulls=True).over(w))
    hit = F.col("_next") - F.col("_us") <= int(within_seconds * 1_000_000)
    return rows.filter(F.col("_tag") == 1).select("_row.*", F.coalesce(hit, F.lit(False)).cast("int").alias(out))


def either_end_join(edges: DataFrame, groups: DataFrame, src: str, dst: str, member: str) -> DataFrame:
    """Edges whose source or target belongs to a group: an OR-join written as one equi-join of both ends."""
    ends = F.when(F.col(src) == F.col(dst), F.array(src)).otherwise(F.array(src, dst))
    ended = edges.withColumn("_end", F.explode(ends))
    j = ended.join(groups, ended["_end"] == groups[member])
    return j.select(*[ended[c] for c in edges.columns], *[groups[c] for c in groups.columns if c != member]).distinct()


def keyless_join(df: DataFrame, small: DataFrame, limit: int = KEYLESS_LIMIT) -> DataFrame:
    """Every row with every row of a small side, which is held as one array and exploded.

    The size is checked in the plan: a small side above ``limit`` rows raises instead of multiplying.
    """
    packed = small.limit(limit + 1).agg(F.collect_list(F.struct(*small.columns)).alias("rows"))
    checked = packed.select(F.when(F.size("rows") > limit, F.raise_error(F.lit("keyless side is too large")))
                            .otherwise(F.col("rows")).alias("rows")).scalar()
    return df.select("*", F.inline(checked))


def radius_pairs(points: DataFrame, ident: str, x: str, y: str, radius: float,
                 group: list[str] | None = None) -> DataFrame:
    """Pairs ``(id_a < id_b)`` no further apart than ``radius``, by grid cells of that size.

    Each point meets its own cell and four of the eight neighbours (the other four meet it), so a pair is
    compared once. The candidates are limited to neighbouring cells; adaptive skew handling splits a
    crowded cell.
    """
    group = group or []
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    base = points.select(*group, F.col(ident).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"),
                         cell(x).alias("cx"), cell(y).alias("cy"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                      for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (-1, 1))])
    a = base.select(*group, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"),
                    F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.explode(steps).alias("s")) \
        .withColumns({"cx": F.col("ox") + F.col("s.dx"), "cy": F.col("oy") + F.col("s.dy")})
    b = base.withColumnsRenamed({"id": "b", "x": "bx", "y": "by"})
    same_cell = (F.col("s.dx") == 0) & (F.col("s.dy") == 0)
    dist = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    pairs = a.join(b, [*group, "cx", "cy"]).filter(~same_cell | (F.col("a") < F.col("b"))) \
        .withColumn("distance", dist).filter(F.col("distance") <= radius)
    return pairs.select(*group, F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "distance")


#: A key with more than this share of the rows counts as hot, so there are fewer than 500 of them.
HOT_SHARE = 1 / 500
#: Keys of fewer rows need no salt.
HOT_ROWS = 100_000
SALTS = 32


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys that own more than ``HOT_SHARE`` of the rows (fewer than 500 values), by one count with map-side combine."""
    if df.count() <= HOT_ROWS:
        return []
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    floor = F.greatest(total * HOT_SHARE, F.lit(HOT_ROWS))
    return [r[0] for r in counts.filter(F.col(key).isNotNull() & (F.col("_n") > floor)).select(key).collect()]


def salted_lookup(left: DataFrame, key: str, table: DataFrame, table_key: str, columns: list, how: str = "inner",
                  hot: list | None = None) -> DataFrame:
    """Join to a table that is unique on its key.

    The rows of the keys in ``hot`` (see :func:`hot_keys`; worth it where the left side is joined many times) are
    dealt out over ``SALTS`` salts, and only their table rows are copied to all salts. Without known hot keys it is
    a plain join, whose skewed partitions adaptive execution splits.
    """
    r = table.select(F.col(table_key).alias("_key"), *columns)
    if not hot:
        return left.join(r, F.col(key) == F.col("_key"), how).drop("_key")
    salt = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("_key").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    l, r = left.withColumn("_salt", salt), r.withColumn("_r_salt", F.explode(salts))
    return l.join(r, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_r_salt")), how).drop("_key", "_salt", "_r_salt")


#: Bytes of one side that a task holds at a time, where blocks meet.
HELD = 1 << 26


def block_pairs(packed: DataFrame, blocks: int, size: int) -> DataFrame:
    """Any two rows of ``packed(block, ...)``, and each with itself, once: the columns of the one, and with ``_b`` those of the other,
    whose ``block`` is no smaller.

    For few, large rows, some ``size`` bytes in all. Every task reads some rows of both sides again from shared storage: nothing is
    shuffled or kept once per pair.
    """
    cores = packed.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(blocks, max(math.ceil(math.sqrt(32 * cores)), -(-size // HELD))))
    held = cut_lineage(packed.repartition(parts))
    other = held.withColumnsRenamed({c: f"{c}_b" for c in held.columns})
    return held.join(other.hint("shuffle_replicate_nl"), F.col("block") <= F.col("block_b"))
