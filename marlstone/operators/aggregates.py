"""Aggregations: OLAP group-bys, rollups, votes, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.columns import clamp, col, ladder, ratio
from marlstone.operators.windows import latest, ranked_top

_AGG = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def dimension_filter(filters: dict | None) -> Column:
    """Equality, or membership when the value is a list."""
    out = F.lit(True)
    for name, value in (filters or {}).items():
        c = F.col(name)
        out = out & (c.isin(value) if isinstance(value, (list, tuple)) else c == value)
    return out


def olap(df: DataFrame, ts: str, metrics: list[str], dimensions: list[str], filters: dict | None = None,
         interval: tuple[str, str] | None = None, granularity: str | None = None, grouping: str = "group") -> DataFrame:
    """Sums of metrics by dimensions and time grain; ``grouping`` may be group, rollup or cube."""
    out = df.filter(dimension_filter(filters))
    if interval:
        kind = df.schema[ts].dataType
        out = out.filter((F.col(ts) >= F.lit(interval[0]).cast(kind)) & (F.col(ts) < F.lit(interval[1]).cast(kind)))
    keys = [F.col(d) for d in dimensions]
    if granularity and granularity != "all":
        keys = [F.date_trunc(granularity, ts).alias("bucket"), *keys]
    grouped = {"group": out.groupBy, "rollup": out.rollup, "cube": out.cube}[grouping](*keys)
    return grouped.agg(*[F.sum(m).alias(m) for m in metrics])


def pivot_cube(df: DataFrame, rows: str, columns: str, values: list, metric: str) -> DataFrame:
    """First dimension as rows, the listed values of the second as columns."""
    return df.groupBy(rows).pivot(columns, values).agg(F.sum(metric))


def timeseries(df: DataFrame, ts: str, metric: str, aggregation: str = "sum", granularity: str = "minute",
               group_by: list[str] | None = None) -> DataFrame:
    return df.groupBy(F.date_trunc(granularity, ts).alias("bucket"), *(group_by or [])) \
        .agg(_AGG[aggregation](metric).alias(metric))


def top_n(df: DataFrame, dimension: str, metric: str, n: int = 10) -> DataFrame:
    """Largest sums; ties are settled by the dimension."""
    return df.groupBy(dimension).agg(F.sum(metric).alias(metric)) \
        .orderBy(F.col(metric).desc_nulls_last(), F.col(dimension)).limit(n)


def distinct_per_window(df: DataFrame, ts: str, window: str, keys: list[str], columns: list[str],
                        approximate: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approximate else F.countDistinct
    return df.groupBy(F.window(ts, window).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("event_count"), *[f(c).alias(f"distinct_{c}") for c in columns]) \
        .select(F.col("w.start").alias("window_start"), *keys, "event_count", *[f"distinct_{c}" for c in columns])


def field_averages(df: DataFrame, keys: list[str], fields: str) -> DataFrame:
    """Mean per key of each entry of a ``map<string,double>`` column, as rows."""
    return df.select(*keys, F.explode(fields).alias("field", "v")).groupBy(*keys, "field").agg(
        F.avg("v").alias("mean"), F.count("v").alias("n"))


def top_values_report(df: DataFrame, keys: list[str], score: str, items: str, k: int = 5) -> DataFrame:
    """Mean score, count and the ``k`` most frequent entries of an array column per key."""
    base = df.groupBy(*keys).agg(F.avg(score).alias("average"), F.count(F.lit(1)).alias("assessments"))
    counts = df.select(*keys, F.explode(items).alias("item")).groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("n"))
    best = ranked_top(counts, keys, [F.col("n").desc(), F.col("item")], k)
    lists = best.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]), ",").alias("top_items"))
    return base.join(lists, keys, "left")


def concentration(df: DataFrame, participant: str, value: str, group: list[str] | None = None) -> DataFrame:
    """Herfindahl index: sum of squares over squared sum of the participants' totals."""
    per = df.groupBy(*(group or []), participant).agg(F.sum(value).alias("v"))
    return per.groupBy(*(group or [])).agg(
        (F.sum(F.col("v") * F.col("v")) / F.nullif(F.sum("v") * F.sum("v"), F.lit(0.0))).alias("hhi"),
        F.count(F.lit(1)).alias("participants"))


def liquidity_score(links: DataFrame, participants: DataFrame, volume: str, active: Column) -> DataFrame:
    """0.3 participants/100 + 0.4 volume/1e6 + 0.3 density, the first two capped at 1."""
    p = participants.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(active, 1)).alias("active"))
    r = links.agg(F.sum(volume).alias("vol"), F.count(F.lit(1)).alias("links"))
    both = p.withColumn("k", F.lit(1)).join(r.withColumn("k", F.lit(1)), "k")
    density = ratio(F.col("links").cast("double"), F.col("n") * (F.col("n") - 1))
    return both.select((0.3 * F.least(F.col("active") / 100, F.lit(1.0)) + 0.4 * F.least(F.col("vol") / 1_000_000, F.lit(1.0))
                        + 0.3 * F.coalesce(density, F.lit(0.0))).alias("liquidity"), "active", "links")


def simple_tally(votes: DataFrame, proposal: str = "proposal", min_power: float = 0) -> DataFrame:
    power = F.when(F.col("voting_power") < min_power, F.lit(0)).otherwise(F.col("voting_power"))
    side = lambda c: F.sum(F.when(c, power).otherwise(F.lit(0)))
    yes, no = F.col("support") == "for", F.col("support") == "against"
    out = votes.groupBy(proposal).agg(side(yes).alias("votes_for"), side(no).alias("votes_against"),
                                      side(~yes & ~no).alias("votes_abstain"), F.countDistinct("voter").alias("unique_voters"))
    total = F.col("votes_for") + F.col("votes_against") + F.col("votes_abstain")
    return out.withColumn("approval_percentage", F.coalesce(ratio(F.col("votes_for"), total) * 100, F.lit(0.0)))


def first_votes(votes: DataFrame, proposal: str, order: list[Column]) -> DataFrame:
    """Only the first vote of a voter counts."""
    return latest(votes, [proposal, "voter"], order)


def quadratic_power(tokens: str | Column, min_tokens: float = 1, scale: float = 1.0) -> Column:
    t = col(tokens)
    return F.when(t < min_tokens, F.lit(0)).otherwise(F.floor(F.sqrt(t) * scale)).cast("long")


def power_bucket(power: Column) -> Column:
    return ladder([(power < 10, "0-10"), (power < 100, "10-100"), (power < 1000, "100-1K"), (power < 10_000, "1K-10K")], "10K+")


def quadratic_tally(votes: DataFrame, proposal: str, order: list[Column], tokens: str = "tokens") -> DataFrame:
    v = first_votes(votes, proposal, order).withColumn("p", quadratic_power(tokens))
    side = lambda name: F.sum(F.when(F.col("support") == name, F.col("p")).otherwise(F.lit(0)))
    return v.groupBy(proposal).agg(side("for").alias("for_votes"), side("against").alias("against_votes"),
                                   F.count(F.lit(1)).alias("total_voters"))


def holding_multiplier(days: Column, min_days: float = 1, max_multiplier: float = 4.0, half_life: float = 365.0,
                       decay_after: float | None = None) -> Column:
    """Saturating growth to half the maximum at the half life; optional later decay; floor 1, 0 below the minimum."""
    base = F.lit(max_multiplier) * (1 - F.exp(-F.log(F.lit(2.0)) / half_life * days))
    if decay_after is not None:
        base = F.when(days > decay_after, base * F.exp(-(days - decay_after) / half_life)).otherwise(base)
    return F.when(days < min_days, F.lit(0.0)).otherwise(F.greatest(F.lit(1.0), base))


def conviction_multiplier(days: Column, maximum: float = 10.0, alpha: float = 0.9, beta: float = 0.5) -> Column:
    grown = F.least(F.lit(maximum) * (1 - F.pow(F.lit(alpha), F.lit(beta) * days)), F.lit(maximum))
    return F.when(days <= 0, F.lit(0.0)).otherwise(grown)


def table_quality(df: DataFrame, name: str, null_when: Column, invalid_when: Column) -> DataFrame:
    """Share of rows without null or invalid values, in percent; 100 for an empty table."""
    out = df.agg(F.count(F.lit(1)).alias("total_records"), F.count(F.when(null_when, 1)).alias("null_count"),
                 F.count(F.when(invalid_when, 1)).alias("invalid_count"))
    bad = (F.col("null_count") + F.col("invalid_count")) / F.nullif(F.col("total_records").cast("double"), F.lit(0.0))
    return out.select(F.lit(name).alias("table_name"), "*", F.coalesce((1 - bad) * 100, F.lit(100.0)).alias("quality_score"))


def sla_compliance(df: DataFrame, keys: list[str], uptime: str, latency: str, performance: str) -> DataFrame:
    """Averages per key, uptime violations and the flag at 99.9 % / 50 ms / 0.95."""
    out = df.groupBy(*keys).agg(F.avg(uptime).alias("avg_uptime"), F.avg(latency).alias("avg_latency"),
                                F.avg(performance).alias("avg_performance"),
                                F.count(F.when(F.col(uptime) < 99.9, 1)).alias("uptime_violations"))
    ok = (F.col("avg_uptime") >= 99.9) & (F.col("avg_latency") <= 50) & (F.col("avg_performance") >= 0.95)
    return out.withColumn("compliance_status", F.when(ok, "COMPLIANT").otherwise("VIOLATION"))


def merge_sources(sources: dict[str, DataFrame], keys: list[str], metrics: list[str]) -> DataFrame:
    """Historical and recent parts of a metric merged to one row per key, with the sources seen."""
    out = None
    for name, df in sources.items():
        one = df.select(*keys, *metrics, F.lit(name).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in metrics], F.countDistinct("source").alias("sources"))


#: Hourly cost rates.
CPU_CORE_HOUR, MEMORY_GB_HOUR, GPU_HOUR, NETWORK_GB, STORAGE_GB_MONTH = 0.05, 0.01, 0.90, 0.09, 0.10


def hourly_cost(cpu: Column, memory_gb: Column, replicas: Column, request_rate: Column, gpu: Column | None = None,
                storage_gb: Column | None = None) -> Column:
    compute = (cpu * CPU_CORE_HOUR + memory_gb * MEMORY_GB_HOUR) * replicas
    if gpu is not None:
        compute = compute + F.when(gpu > 0, replicas * GPU_HOUR).otherwise(F.lit(0.0))
    network = request_rate * 3600 * 1024 / float(1024 ** 3) * NETWORK_GB
    storage = F.lit(0.0) if storage_gb is None else F.coalesce(storage_gb * STORAGE_GB_MONTH / (30 * 24), F.lit(0.0))
    return compute + network + storage


def grouped_counts(df: DataFrame, sets: list[str]) -> DataFrame:
    """Counts by each listed column as (dimension, value, n) rows, in one pass over the data."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in sets])
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
