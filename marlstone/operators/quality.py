"""Data quality: profiles, rules, enforcement, baselines, drift and remediation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as _Window
from pyspark.sql import functions as F


def filled_fields(columns: list[str]) -> Column:
    """Number of non-null fields of a row."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


# -- profiles -----------------------------------------------------------------------------------------------

def _kinds(df: DataFrame) -> dict[str, list[str]]:
    out = {"numeric": [], "string": [], "time": []}
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"):
            out["numeric"].append(f.name)
        elif t == "string":
            out["string"].append(f.name)
        elif t.startswith(("timestamp", "date")):
            out["time"].append(f.name)
    return out


def _as_rows(one: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """A one-row aggregate with ``{column}__{field}`` names as one row per column."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in columns])
    return one.select(F.inline(rows))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, share of null cells and duplicate rows."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in df.columns])
    out = counted.agg(F.sum("_copies").alias("row_count"), F.sum(F.col("_copies") * nulls).alias("_nulls"),
                      F.sum(F.col("_copies") - 1).alias("duplicate_rows"))
    n = len(df.columns)
    return out.select(F.coalesce("row_count", F.lit(0)).alias("row_count"), F.lit(n).alias("column_count"),
                      F.coalesce(100.0 * F.col("_nulls") / F.nullif(F.col("row_count") * n, F.lit(0)), F.lit(0.0)).alias("null_percentage"),
                      F.coalesce("duplicate_rows", F.lit(0)).alias("duplicate_rows"))


def column_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null and distinct counts per column, in one aggregation."""
    cols = columns or df.columns
    aggs = [a for c in cols for a in (F.count_if(F.col(c).isNull()).alias(f"{c}__null_count"),
                                      F.countDistinct(c).alias(f"{c}__unique_count"), F.count(F.lit(1)).alias(f"{c}__row_count"))]
    return _as_rows(df.agg(*aggs), cols, ["row_count", "null_count", "unique_count"])


def long_numeric(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, column_name, value) rows of the numeric columns."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*(keys or []), F.inline(rows))


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Minimum, maximum, mean, deviation, exact quartiles and the outliers beyond 1.5 interquartile ranges."""
    from marlstone.functions.quantiles import exact_quantiles
    cols = columns or _kinds(df)["numeric"]
    long = long_numeric(df, cols)
    stats = long.groupBy("column_name").agg(F.min("value").alias("min"), F.max("value").alias("max"),
                                            F.avg("value").alias("mean"), F.stddev("value").alias("stddev"))
    q = exact_quantiles(long, ["column_name"], F.col("value"), {"q1": 0.25, "median": 0.5, "q3": 0.75}, few_keys=True)
    bounds = stats.join(q, "column_name")
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("value") < F.col("q1") - 1.5 * iqr) | (F.col("value") > F.col("q3") + 1.5 * iqr)
    beyond = long.join(F.broadcast(q), "column_name").groupBy("column_name").agg(F.count_if(out).alias("outlier_count"))
    return bounds.join(beyond, "column_name")


def string_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or _kinds(df)["string"]
    aggs = [a for c in cols for a in (F.min(F.length(c)).alias(f"{c}__min_length"), F.max(F.length(c)).alias(f"{c}__max_length"),
                                      F.avg(F.length(c)).alias(f"{c}__avg_length"))]
    return _as_rows(df.agg(*aggs), cols, ["min_length", "max_length", "avg_length"])


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    from marlstone.operators.windows import ranked_top
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(rows)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return ranked_top(counts, ["column_name"], [F.col("n").desc(), F.col("value").asc_nulls_first()], k)


def time_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or _kinds(df)["time"]
    aggs = [a for c in cols for a in (F.min(c).alias(f"{c}__min_date"), F.max(c).alias(f"{c}__max_date"))]
    return _as_rows(df.agg(*aggs), cols, ["min_date", "max_date"]).withColumn("range_days", F.datediff("max_date", "min_date"))


#: Weights of the quality dimensions.
WEIGHTS = {"completeness": 0.25, "accuracy": 0.20, "consistency": 0.20, "validity": 0.15, "uniqueness": 0.10, "timeliness": 0.10}


def timeliness_score(age_hours: Column) -> Column:
    from marlstone.functions.columns import ladder
    return ladder([(age_hours < 1, 1.0), (age_hours < 24, 0.9), (age_hours < 168, 0.7)], 0.5)


def dimension_scores(df: DataFrame, now: Column, ts: str | None = None, rules: dict[str, Column] | None = None) -> DataFrame:
    """Completeness, uniqueness, validity and timeliness; accuracy and consistency from the given row rules.

    A dimension nobody measured is null and leaves the weight sum of the overall score.
    """
    from marlstone.functions.columns import seconds
    kinds = _kinds(df)
    n = F.count(F.lit(1))
    share = lambda good: F.sum(good.cast("int")) / n
    mean = lambda cs: reduce(lambda a, b: a + b, cs) / len(cs)
    uniq = [F.when(F.countDistinct(c) / n > 0.95, F.lit(1.0)).otherwise(F.countDistinct(c) / n) for c in df.columns]
    valid = [share(~F.coalesce(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), F.lit(False))) for c in kinds["numeric"]]
    valid += [share(~F.coalesce(F.trim(c) == "", F.lit(False))) for c in kinds["string"]]
    aggs = [mean([F.count(c) / n for c in df.columns]).alias("completeness"), mean(uniq).alias("uniqueness"),
            (mean(valid) if valid else F.lit(1.0)).alias("validity")]
    time_col = ts or (kinds["time"][0] if kinds["time"] else None)
    aggs.append((timeliness_score((seconds(now) - seconds(F.max(time_col))) / 3600) if time_col else F.lit(0.5)).alias("timeliness"))
    for d in ("accuracy", "consistency"):
        aggs.append((share(F.coalesce(rules[d], F.lit(False))) if rules and d in rules else F.lit(None).cast("double")).alias(d))
    out = df.agg(*aggs)
    total = reduce(lambda a, b: a + b, [F.when(F.col(d).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for d, w in WEIGHTS.items()])
    got = reduce(lambda a, b: a + b, [F.coalesce(F.col(d) * w, F.lit(0.0)) for d, w in WEIGHTS.items()])
    return out.withColumn("overall", got / total)


# -- rules --------------------------------------------------------------------------------------------------

def rule_ratios(df: DataFrame, rules: list[dict], threshold: float = 0.95) -> DataFrame:
    """Share of rows that pass each row rule, in one aggregation; null values count only for not_null."""
    n = F.count(F.lit(1))

    def part(r):
        c = F.col(r["column"])
        kind = r["type"]
        if kind == "unique":
            return F.countDistinct(c) / F.nullif(F.count(c), F.lit(0))
        ok = {"not_null": lambda: c.isNotNull(), "positive": lambda: c > 0,
              "in_range": lambda: c.between(r.get("min"), r.get("max")),
              "pattern_match": lambda: c.rlike(r.get("pattern", ""))}[kind]()
        base = n if kind == "not_null" else F.count(c)
        return F.count_if(F.coalesce(ok, F.lit(False))) / F.nullif(base, F.lit(0))

    names = [f"{r['column']}_{r['type']}" for r in rules]
    one = df.agg(*[part(r).alias(f"{nm}__ratio") for nm, r in zip(names, rules)])
    limits = {nm: r.get("threshold", threshold) for nm, r in zip(names, rules)}
    rows = F.array(*[F.struct(F.lit(nm).alias("rule"), F.col(f"{nm}__ratio").alias("ratio"), F.lit(float(limits[nm])).alias("limit")) for nm in names])
    return one.select(F.inline(rows)).withColumn("passed", F.col("ratio") >= F.col("limit"))


def reference_ratio(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """Share of non-null keys that exist in the referenced table."""
    keys = ref.select(F.col(ref_column).alias("_ref")).distinct()
    j = df.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_ref"), "left")
    return j.agg((F.count("_ref") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("ratio"))


def run_checks(df: DataFrame, checks: list[dict], now: Column) -> DataFrame:
    """Check table (name, score, threshold, status) over completeness, uniqueness, validity, consistency, timeliness.

    pass at the threshold, warning down to 0.1 below it, else fail; all checks share one aggregation.
    """
    from marlstone.functions.columns import ladder, seconds
    n = F.count(F.lit(1))

    def score(k):
        c = F.col(k["column"]) if "column" in k else None
        kind = k["type"]
        if kind == "completeness":
            return F.count(c) / n
        if kind == "uniqueness":
            return F.countDistinct(c) / F.nullif(F.count(c), F.lit(0))
        if kind == "validity":
            ok = c.rlike(k["pattern"]) if "pattern" in k else c.isin(k["values"]) if "values" in k else c.between(k["min"], k["max"])
            return F.count_if(F.coalesce(ok, F.lit(False))) / F.nullif(F.count(c), F.lit(0))
        if kind == "consistency":
            both = F.col(k["first"]).isNotNull() & F.col(k["second"]).isNotNull()
            return F.count_if(both & (F.col(k["first"]) <= F.col(k["second"]))) / F.nullif(F.count_if(both), F.lit(0))
        age = (seconds(now) - seconds(F.max(c))) / 3600
        return F.when(age <= k["max_age_hours"], F.lit(1.0)).otherwise(F.lit(float(k["max_age_hours"])) / age)

    one = df.agg(*[score(k).cast("double").alias(f"c{i}") for i, k in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(k["name"]).alias("check_name"), F.lit(k["type"]).alias("check_type"), F.col(f"c{i}").alias("score"),
                              F.lit(float(k.get("threshold", 0.95))).alias("threshold")) for i, k in enumerate(checks)])
    status = ladder([(F.col("score") >= F.col("threshold"), "pass"), (F.col("score") >= F.col("threshold") - 0.1, "warning")], "fail")
    return one.select(F.inline(rows)).withColumn("status", status)


def check_rollup(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "warning").alias("warnings"),
                      F.count_if(F.col("status") == "fail").alias("failed"), F.avg("score").alias("mean_score"))


#: Allowed next states by state.
TRANSITIONS = {"pending": ["running", "cancelled"], "running": ["completed", "failed", "paused"],
               "paused": ["running", "cancelled"], "completed": [], "failed": ["pending"], "cancelled": []}


def valid_transition(previous: Column, current: Column, allowed: dict[str, list[str]] = TRANSITIONS) -> Column:
    """A transition with either state unknown cannot be judged and passes."""
    known = F.lit(False)
    for state, nexts in allowed.items():
        if nexts:
            known = known | ((previous == state) & current.isin(nexts))
    return previous.isNull() | current.isNull() | F.coalesce(known, F.lit(False))


def record_rules(data_type: str) -> list[tuple[str, str, Column]]:
    """(rule, severity, violated) for a record type; a missing measure passes its range rule as 0."""
    c = F.col
    zero = lambda n: F.coalesce(c(n), F.lit(0))
    base = [("null_check", "high", c("id").isNull() | c("timestamp").isNull())]
    extra = {
        "simulation_metrics": [("metric_range", "medium", ~zero("convergence_rate").between(0, 1)),
                               ("resource_usage", "high", ~zero("cpu_usage").between(0, 100))],
        "asset_metadata": [("asset_size", "medium", zero("size") <= 0),
                           ("asset_type", "high", ~F.coalesce(c("asset_type").isin("3d_model", "dataset", "document", "image"), F.lit(False)))],
        "workflow_events": [("status_transition", "high", ~valid_transition(c("previous_status"), c("status"))),
                            ("duration_check", "medium", zero("duration") < 0)]}
    return base + extra.get(data_type, [])


def check_records(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Violated rule names, the rules passed as a share, and whether a high-severity rule failed."""
    names = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, _, bad in rules]))
    high = F.lit(False)
    for n, severity, bad in rules:
        if severity == "high":
            high = high | F.coalesce(bad, F.lit(False))
    return df.withColumns({"violations": names, "score": 1 - F.size(names) / len(rules), "action_required": high})


def enforce(df: DataFrame, data_type: str, mode: str) -> DataFrame:
    """Outcome per record: validated, cleaned (clamped), rejected or quarantined, with the changed fields."""
    c = F.col
    checked = check_records(df, record_rules(data_type))
    fixes: dict[str, Column] = {}
    if data_type == "simulation_metrics":
        fixes = {"convergence_rate": F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("convergence_rate"))),
                 "cpu_usage": F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("cpu_usage")))}
    fixable = c("id").isNotNull() & (F.lit(True) if data_type != "asset_metadata" else F.coalesce(c("size"), F.lit(0)) > 0)
    if mode == "reject":
        state = F.when(c("action_required"), "rejected").otherwise("validated")
    elif mode == "quarantine":
        state = F.when(c("action_required"), "quarantined").otherwise("validated")
    elif mode == "clean":
        state = F.when(~c("action_required"), "validated").when(fixable, "cleaned").otherwise("rejected")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    out = checked.withColumn("outcome", state)
    if mode == "clean" and fixes:
        changed = F.array_compact(F.array(*[F.when((c("outcome") == "cleaned") & ~c(n).eqNullSafe(v), F.lit(n)) for n, v in fixes.items()]))
        out = out.withColumn("modified", changed).withColumns(
            {n: F.when(c("outcome") == "cleaned", v).otherwise(c(n)) for n, v in fixes.items()})
    return out


def status_transitions(df: DataFrame, keys: list[str], ts: str, ties: list[str], status: str) -> DataFrame:
    """Rows whose status may not follow the previous one of the key."""
    from marlstone.operators.windows import rows_frame
    out = rows_frame(df, keys, ts, ties, lambda w: {"previous_status": F.lag(status).over(w)}, before=1)
    return out.filter(~valid_transition(F.col("previous_status"), F.col(status)))


# -- event scoring, baselines, trust ------------------------------------------------------------------------

def score_dataset_events(df: DataFrame, key: str, ts: str, ident: str, now: Column) -> DataFrame:
    """Dimensions of a dataset event against the running mean size, weighted score and issues."""
    from marlstone.functions.columns import flagged, seconds
    from marlstone.operators.windows import running
    d = running(df, [key], ts, [ident], {"_n": ("count", F.col("size_bytes")), "_s": ("sum", F.col("size_bytes").cast("double"))},
                include_current=False)
    mean = F.col("_s") / F.nullif(F.col("_n"), F.lit(0))
    deviation = F.abs(F.col("size_bytes") - mean) / F.nullif(mean, F.lit(0.0))
    d = d.withColumns({
        "completeness": F.when(F.col("num_samples") == 0, 0.0).otherwise(1.0),
        "accuracy": F.when(F.coalesce(F.col("format"), F.lit("")) == "", 0.5).otherwise(1.0),
        "consistency": F.when(deviation.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - deviation)),
        "timeliness": F.when(seconds(now) - seconds(ts) > 86_400, 0.5).otherwise(1.0)})
    # validity and uniqueness carry the fixed values 0.9 and 0.95
    d = d.withColumn("overall", 0.2 * F.col("completeness") + 0.2 * F.col("accuracy") + 0.15 * F.col("consistency")
                     + 0.15 * F.col("timeliness") + 0.15 * 0.9 + 0.15 * 0.95)
    issues = flagged((F.col("completeness") < 0.8, "low_completeness"), (F.col("accuracy") < 0.9, "accuracy"),
                     (F.col("consistency") < 0.7, "inconsistent"), (F.col("timeliness") < 0.8, "stale"), (F.col("overall") < 0.7, "below_threshold"))
    return d.withColumn("issues", issues).drop("_n", "_s")


def quality_anomalies(df: DataFrame, keys: list[str], ts: str, ident: str, score: str, keep: float = 0.95) -> DataFrame:
    """Scores more than 2 deviations off an adaptive baseline (both moving averages), with severity and direction.

    Leading zero scores do not start a baseline. The baseline of a row is the one before it.
    """
    from marlstone.functions.columns import ladder, null_safe_join
    from marlstone.operators.folds import affine_scan
    from marlstone.operators.windows import numbered
    begin = df.filter(F.col(score) > 0).groupBy(*keys).agg(F.min(F.struct(ts, ident)).alias("_begin"))
    started = null_safe_join(df, begin, keys).filter(F.struct(ts, ident) >= F.col("_begin")).drop("_begin")
    first = F.col("_rn") == 1
    d = affine_scan(numbered(started, keys, ts, [ident]), keys, ts, [ident], F.when(first, 1.0).otherwise(keep),
                    F.when(first, F.col(score)).otherwise((1 - keep) * F.col(score)), "_mean", has_rn=True)
    # the value before the row, from the value after it; the first row has no baseline
    d = d.withColumn("baseline", (F.col("_mean") - (1 - keep) * F.col(score)) / keep)
    d = d.withColumn("deviation", F.abs(F.col(score) - F.col("baseline")))
    d = affine_scan(d, keys, ts, [ident], F.when(first, 1.0).otherwise(keep),
                    F.when(first, 0.1).otherwise((1 - keep) * F.col("deviation")), "_spread", has_rn=True)
    spread = (F.col("_spread") - (1 - keep) * F.col("deviation")) / keep
    d = d.filter(F.col("_rn") > 1).withColumn("spread", spread)
    severity = ladder([(F.col("deviation") > 4 * F.col("spread"), "CRITICAL"), (F.col("deviation") > 3 * F.col("spread"), "HIGH")], "MEDIUM")
    kind = F.when(F.col(score) < F.col("baseline"), "QUALITY_DEGRADATION").otherwise("QUALITY_IMPROVEMENT")
    return d.filter(F.col("deviation") > 2 * F.col("spread")).withColumns({"severity": severity, "anomaly_type": kind}) \
        .drop("_rn", "_mean", "_spread")


def trust_adjusted(completeness: Column, anomaly_rate: Column, field_quality: Column, trust: Column) -> Column:
    """0.25 completeness + 0.35 (1 - anomalies) + 0.40 field quality, scaled by trust and at most 1.1 x trust."""
    base = completeness * 0.25 + (1 - anomaly_rate) * 0.35 + field_quality * 0.40
    return F.least(trust * 1.1, base * (0.6 + 0.4 * trust))


def profile_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per column: mean shift in old deviations (drift above 2) and distinct-count change (drift above 20 %)."""
    o = old.select("column_name", F.col("mean").alias("o_mean"), F.col("stddev").alias("o_std"), F.col("unique_count").alias("o_unique"))
    j = new.join(o, "column_name")
    shift = F.abs(F.col("mean") - F.col("o_mean")) / F.nullif(F.col("o_std"), F.lit(0.0))
    change = F.abs(F.col("unique_count") - F.col("o_unique")) / F.nullif(F.col("o_unique"), F.lit(0))
    parts = F.array(F.when(shift > 2, F.least(shift / 10, F.lit(1.0))).when(shift.isNotNull(), 0.0), F.when(change > 0.2, F.least(change, F.lit(1.0))))
    return j.select("column_name", shift.alias("mean_shift"), change.alias("cardinality_change"), (shift > 2).alias("mean_drift"),
                    (change > 0.2).alias("cardinality_drift"), F.array_compact(parts).alias("_parts"))


def drift_score(drift: DataFrame) -> DataFrame:
    s = drift.select(F.explode("_parts").alias("p")).agg(F.avg("p").alias("drift_score"))
    return s.select(F.coalesce("drift_score", F.lit(0.0)).alias("drift_score"), (F.coalesce("drift_score", F.lit(0.0)) > 0.1).alias("drift_detected"))


def volume_anomalies(counts: DataFrame, keys: list[str], ts: str, n: str, rows: int = 5) -> DataFrame:
    """Counts more than 3 population deviations off the previous five."""
    from marlstone.operators.windows import rows_frame

    def make(w):
        f = w.rowsBetween(-rows, -1)
        return {"_m": F.avg(n).over(f), "_s": F.stddev_pop(n).over(f), "_k": F.count(n).over(f)}
    d = rows_frame(counts, keys, ts, [], make, before=rows, slice_seconds=30 * 86_400)
    z = F.abs(F.col(n) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    return d.withColumns({"expected": F.col("_m"), "z_score": z}).filter((F.col("_k") == rows) & (z > 3)).drop("_m", "_s", "_k")


def correlations(df: DataFrame, columns: list[str], threshold: float = 0.7) -> DataFrame:
    """All column pairs above the threshold, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows)).filter(F.abs("r") > threshold)


# -- distribution drift -------------------------------------------------------------------------------------

def ks_test(baseline: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact two-sample Kolmogorov-Smirnov statistic per key with its asymptotic p-value.

    Counts per distinct value are cut into value slices of about equal weight; the running counts carry over
    the slices, so no key's values pass through one task.
    """
    from marlstone.operators.windows import running, value_slices
    both = baseline.select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        current.select(*keys, F.col(value).alias("_v"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))).filter(F.col("_v").isNotNull())
    counts = both.groupBy(*keys, "_v").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    sliced = value_slices(counts, keys, "_v")
    run = running(sliced, keys, "_v", [], {"_ca": ("sum", F.col("_a")), "_cb": ("sum", F.col("_b"))}, slice_by=F.col("_cut"))
    total = counts.groupBy(*keys).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    from marlstone.functions.columns import null_safe_join
    j = null_safe_join(run, total, keys)
    gap = F.abs(F.col("_ca") / F.col("_na") - F.col("_cb") / F.col("_nb"))
    out = j.groupBy(*keys).agg(F.max(gap).alias("statistic"), F.max("_na").alias("n_baseline"), F.max("_nb").alias("n_current"))
    effective = F.sqrt(F.col("n_baseline") * F.col("n_current") / (F.col("n_baseline") + F.col("n_current")))
    lam = effective * F.col("statistic")
    series = reduce(lambda x, y: x + y, [(2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 51)])
    p = F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0)))
    return out.withColumn("p_value", p)


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal by a five-term polynomial (error below 7.5e-8)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    # fixed values: coefficients of the polynomial
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def chi_square_test(baseline: DataFrame, current: DataFrame, keys: list[str], value: str, unseen: float = 0.001) -> DataFrame:
    """Chi-square of the current counts against the baseline shares; an unseen category expects 0.1 %.

    The p-value uses the cube-root normal approximation of the chi-square tail.
    """
    from marlstone.functions.columns import null_safe_join
    count = lambda d, n: d.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))
    a, b = count(baseline, "_a"), count(current, "_b")
    total = lambda d, n, m: d.groupBy(*keys).agg(F.sum(n).alias(m))
    j = a.join(b, [*keys, value], "full_outer")
    j = null_safe_join(null_safe_join(j, total(a, "_a", "_na"), keys), total(b, "_b", "_nb"), keys)
    share = F.coalesce(F.col("_a") / F.col("_na"), F.lit(unseen))
    expected = share * F.col("_nb")
    out = j.groupBy(*keys).agg(F.sum(F.pow(F.coalesce(F.col("_b"), F.lit(0)) - expected, 2) / expected).alias("statistic"),
                               (F.count(F.lit(1)) - 1).alias("df"))
    d = F.col("df").cast("double")
    z = (F.pow(F.col("statistic") / d, F.lit(1 / 3)) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d))
    return out.withColumn("p_value", F.when(F.col("df") > 0, normal_tail(z)).otherwise(F.lit(1.0)))


def drift_severity(tests: DataFrame, sensitivity: float = 0.05) -> DataFrame:
    """HIGH / MEDIUM / LOW by the share of drifting features that are significant at 1 %."""
    from marlstone.functions.columns import ladder
    d = tests.agg(F.count_if(F.col("p_value") < sensitivity).alias("drifting"), F.count_if(F.col("p_value") < 0.01).alias("significant"))
    share = F.col("significant") / F.nullif(F.col("drifting"), F.lit(0))
    return d.withColumn("severity", ladder([(share > 0.5, "HIGH"), (share > 0.2, "MEDIUM")], "LOW"))


def baseline_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_numeric(df, columns).groupBy("column_name").agg(
        F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))


# -- remediation --------------------------------------------------------------------------------------------

#: Issue type -> (actions, severity, needs approval).
REMEDIATION = {
    "missing_values": ("fill_missing", "medium", False), "duplicate_records": ("remove_duplicates", "medium", False),
    "schema_violation": ("validate_schema,quarantine_data", "high", True), "outliers": ("clean_data", "low", False),
    "inconsistent_format": ("standardize_format", "medium", False), "data_drift": ("create_derived_dataset,notify_owner", "high", True),
    "critical_corruption": ("rollback_version,request_reupload", "critical", True)}


def quality_issues(dims: DataFrame) -> DataFrame:
    """Issue rows from dimension scores: completeness below 0.95, uniqueness below 0.98, validity below 0.9."""
    c = F.col
    rows = F.array_compact(F.array(
        F.when(c("completeness") < 0.95, F.struct(F.lit("missing_values").alias("issue"), c("completeness").alias("score"))),
        F.when(c("uniqueness") < 0.98, F.struct(F.lit("duplicate_records").alias("issue"), c("uniqueness").alias("score"))),
        F.when(c("validity") < 0.9, F.struct(F.lit("schema_violation").alias("issue"), c("validity").alias("score")))))
    keep = [x for x in dims.columns if x not in ("completeness", "uniqueness", "validity")]
    return dims.select(*keep, F.inline(rows))


def remediation_plan(issues: DataFrame, issue: str = "issue") -> DataFrame:
    from marlstone.functions.columns import constant_map
    pick = lambda i: {k: v[i] for k, v in REMEDIATION.items()}
    return issues.withColumns({"actions": constant_map(pick(0), issue, "notify_owner"), "severity": constant_map(pick(1), issue, "low"),
                               "requires_approval": constant_map(pick(2), issue, True)})


def cap_outliers(df: DataFrame, column: str, low: float = 0.25, high: float = 0.75, factor: float = 1.5) -> DataFrame:
    """Clamp to the quartiles widened by ``factor`` interquartile ranges (factor 0: the quantiles themselves)."""
    from marlstone.functions.columns import one_row
    from marlstone.functions.quantiles import exact_quantiles
    q = one_row(exact_quantiles(df, [], F.col(column), {"lo": low, "hi": high}))
    width = (q["hi"] - q["lo"]) * factor
    return df.withColumn(column, F.greatest(F.least(F.col(column), q["hi"] + width), q["lo"] - width))


def quarantine(df: DataFrame, condition: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows; a null condition is bad."""
    ok = F.coalesce(F.expr(condition), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def remediation_gate(anomalies: DataFrame, keys: list[str], ts: str, ident: str, cooldown_seconds: float = 3600) -> DataFrame:
    """Anomalies that trigger a remediation: not LOW, score at least 0.8, and none triggered in the last hour."""
    from marlstone.operators.folds import cooldown
    able = anomalies.filter((F.col("severity") != "LOW") & (F.col("score") >= 0.8))
    return cooldown(able, keys, ts, ident, cooldown_seconds).filter("accepted").drop("accepted")


def series_quality(df: DataFrame, ts: str, now: Column, hours: int = 24) -> DataFrame:
    """Completeness of hours, consistency of the hourly counts, timeliness, gaps above two hours (.4/.3/.3)."""
    from marlstone.functions.columns import seconds
    recent = df.filter((F.col(ts) > now - F.make_interval(hours=F.lit(hours))) & (F.col(ts) <= now))
    hourly = recent.groupBy(F.date_trunc("hour", ts).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    # at most ``hours`` + 1 rows are left here
    lagged = hourly.withColumn("_p", F.lag("h").over(_Window.orderBy("h")))
    out = lagged.agg(F.count(F.lit(1)).alias("hours_seen"), F.stddev_pop("n").alias("_s"), F.avg("n").alias("_m"), F.max("h").alias("_last"),
                     F.count_if(seconds("h") - seconds("_p") > 7200).alias("gaps"))
    delay = (seconds(now) - seconds("_last")) / 60
    out = out.select((F.col("hours_seen") / hours).alias("completeness"), (1 - F.col("_s") / (F.col("_m") + 1e-9)).alias("consistency"),
                     F.greatest(F.lit(0.0), 1 - delay / 60).alias("timeliness"), "gaps")
    return out.withColumn("overall", 0.4 * F.col("completeness") + 0.3 * F.col("consistency") + 0.3 * F.col("timeliness"))


def suggestions(dims: DataFrame, high_anomalies: Column, drifted: Column) -> DataFrame:
    """Improvement rows (type, priority) from scores, anomaly count and drifted columns."""
    c = F.col
    row = lambda t, p: F.struct(F.lit(t).alias("type"), F.lit(p).alias("priority"))
    rows = F.array_compact(F.array(F.when(c("completeness") < 0.9, row("completeness", "high")), F.when(high_anomalies > 0, row("anomaly", "high")),
                                   F.when(drifted > 0, row("drift", "medium")), F.when(c("validity") < 0.95, row("validity", "medium"))))
    return dims.select(F.inline(rows))


def document_schema(df: DataFrame, column: str) -> DataFrame:
    """Dotted paths of JSON documents with the type of each and the share of documents that hold it.

    One explode per nesting level, until no level holds an object; arrays are one leaf, as their items carry no field names.
    """
    from marlstone.session import cut_lineage

    level = df.select(F.col(column).alias("_v"), F.lit("").alias("path"))
    total = df.agg(F.count(F.lit(1))).scalar()
    found = None
    while True:
        fields = level.select("path", F.explode(F.from_json("_v", "map<string,string>")).alias("k", "v"))
        t = F.trim("v")
        kind = (F.when(F.col("v").isNull(), "null").when(t.startswith("{"), "object").when(t.startswith("["), "array")
                .when(t.isin("true", "false"), "boolean").when(t.rlike(r"^-?[0-9]+$"), "integer")
                .when(t.rlike(r"^-?[0-9]*\.?[0-9]+([eE][+-]?[0-9]+)?$"), "float").otherwise("string"))
        here = cut_lineage(fields.select(F.when(F.col("path") == "", F.col("k")).otherwise(F.concat_ws(".", "path", "k")).alias("path"), "v", kind.alias("type")))
        found = here.select("path", "type") if found is None else found.unionByName(here.select("path", "type"))
        level = here.filter(F.col("type") == "object").select(F.col("v").alias("_v"), "path")
        if level.isEmpty():
            break
    return found.groupBy("path", "type").agg((F.count(F.lit(1)) / total).alias("presence"))
