"""Service levels, dead letters, catalog, access policies and query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import any_of, constant_map, ladder, micros
from marlstone.functions.scalars import error_category, masked
from marlstone.operators.windows import rows_frame, running

#: Default service levels.
SLA = {"uptime": 99.9, "latency": 50.0, "performance": 0.95, "throughput": 1.0, "error_rate": 0.01}


def sla_violations(metrics: DataFrame, keep: list[str], limits: dict = SLA) -> DataFrame:
    """One row per violated measure with the expected and the actual value and whether it is critical."""
    def row(kind, bad, critical):
        actual = F.col(kind).cast("double")
        return F.when(bad, F.struct(F.lit(kind).alias("violation_type"), F.lit(float(limits[kind])).alias("expected"), actual.alias("actual"), critical.alias("critical")))
    c, no = F.col, F.lit(False)
    rows = F.array_compact(F.array(
        row("uptime", c("uptime") < limits["uptime"], c("uptime") < 90), row("latency", c("latency") > limits["latency"], c("latency") > 200),
        row("performance", c("performance") < limits["performance"], c("performance") < 0.5),
        row("throughput", c("throughput") < limits["throughput"], no), row("error_rate", c("error_rate") > limits["error_rate"], no)))
    return metrics.select(*keep, F.inline(rows))


def failover(metrics: DataFrame, key: str, ts: str, ident: str, limits: dict = SLA) -> DataFrame:
    """Decision at each metrics row: critical now, five violations so far, or poor mean uptime so far."""
    c = F.col
    count = (c("uptime") < limits["uptime"]).cast("int") + (c("latency") > limits["latency"]).cast("int") + (c("performance") < limits["performance"]).cast("int") \
        + (c("throughput") < limits["throughput"]).cast("int") + (c("error_rate") > limits["error_rate"]).cast("int")
    d = running(metrics, [key], ts, [ident], {"total_violations": ("sum", count), "_n": ("count", c("uptime")), "_u": ("sum", c("uptime").cast("double"))})
    mean = c("_u") / F.nullif(c("_n"), F.lit(0))
    critical = (c("uptime") < 90) | (c("latency") > 200) | (c("performance") < 0.5)
    reason = ladder([(critical, "critical"), (c("total_violations") >= 5, "too_many"), ((mean < 95) & (c("_n") > 10), "poor_uptime"),
                     ((mean == 0) & (c("_n") > 3), "down")], None)
    return d.withColumns({"average_uptime": mean, "reason": reason, "failover": reason.isNotNull()}).drop("_n", "_u")


def metrics_timeouts(metrics: DataFrame, key: str, ts: str, ident: str, limit_seconds: float, now: Column) -> DataFrame:
    """Times without metrics beyond the limit, the open end included."""
    d = rows_frame(metrics, [key], ts, [ident], lambda w: {"_next": F.lead(ts).over(w)}, after=1)
    until = F.coalesce(F.col("_next"), now)
    gap = (micros(until) - micros(ts)) / 1_000_000.0
    return d.filter(gap > limit_seconds).select(key, F.col(ts).alias("last_metrics"), gap.alias("silent_seconds"), F.col("_next").isNull().alias("still_silent"))


def penalties(violations: DataFrame, settlements: DataFrame, key: str, rate: float = 0.01, critical_rate: float = 0.05, cap: float = 1.0) -> DataFrame:
    """Penalty per settlement: a share of its value per violation, at most ``cap`` of it."""
    v = violations.groupBy(key).agg(F.count(F.lit(1)).alias("violations"), F.count_if("critical").alias("critical_violations"))
    share = F.least(F.lit(cap), rate * (F.col("violations") - F.col("critical_violations")) + critical_rate * F.col("critical_violations"))
    return settlements.join(v, key, "left").fillna(0, ["violations", "critical_violations"]).withColumn("penalty", F.col("value") * share)


def settlement_states(settlements: DataFrame, now: Column) -> DataFrame:
    """provisioning before delivery, active until the delivery time has run, then completed."""
    end = F.col("delivery_start") + F.make_dt_interval(hours=F.col("duration_hours").cast("int"))
    state = ladder([(now < F.col("delivery_start"), "provisioning"), (now < end, "active")], "completed")
    return settlements.withColumns({"expires": end, "state": state})


def regional_quality(metrics: DataFrame, region: str, ts: str) -> DataFrame:
    return metrics.groupBy(region, F.window(ts, "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("uptime").alias("uptime"), F.avg("latency").alias("latency"), F.avg("performance").alias("performance")) \
        .select(region, F.col("w.start").alias("window_start"), "n", "uptime", "latency", "performance")


def recovery_strategy(category: Column, deliveries: Column) -> Column:
    return ladder([(deliveries > 10, "manual"), (category.isin("timeout", "connection", "service"), "retry"),
                   (category.isin("serialization", "validation") & (deliveries > 3), "skip"), (category.isin("serialization", "validation"), "retry"),
                   (category.isin("authorization", "rate_limit"), "manual"), (deliveries <= 3, "retry")], "manual")


def dead_letters(messages: DataFrame, topic: str, published: str, reason: Column, deliveries: Column, now: Column) -> DataFrame:
    """Count, ages and mean deliveries per topic, category and strategy."""
    d = messages.withColumns({"category": error_category(reason), "_age": (micros(now) - micros(published)) / 1_000_000.0, "_d": deliveries})
    d = d.withColumn("strategy", recovery_strategy(F.col("category"), F.col("_d")))
    return d.groupBy(topic, "category", "strategy").agg(F.count(F.lit(1)).alias("messages"), F.max("_age").alias("oldest_seconds"),
                                                        F.min("_age").alias("newest_seconds"), F.avg("_d").alias("mean_deliveries"))


#: Words that classify an asset, in order of precedence.
INDICATORS = (("pii", ("email", "ssn", "phone", "address", "credit_card", "passport")),
              ("phi", ("patient", "medical", "health", "diagnosis", "prescription")),
              ("confidential", ("salary", "revenue", "profit", "financial", "strategic")))


def classify_asset(name: Column, description: Column, tags: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, description))
    words = F.coalesce(tags, F.array().cast("array<string>"))
    return ladder([(any_of([text.contains(w) | F.array_contains(words, w) for w in ws]), kind) for kind, ws in INDICATORS], "internal")


def asset_usage(log: DataFrame, asset: str, user: str, ts: str, now: Column, days: int = 30) -> DataFrame:
    """Accesses, distinct users and last access per asset, over the last days and in total."""
    recent = F.col(ts) >= now - F.make_interval(days=F.lit(days))
    return log.groupBy(asset).agg(F.count(F.lit(1)).alias("accesses"), F.count_if(recent).alias("recent_accesses"),
                                  F.countDistinct(user).alias("users"), F.max(ts).alias("last_access"))


def evaluate_access(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Deny unless a rule allows: ``requests(request_id, user_id, groups, resource_id, action)``.

    ``rules(rule_id, principal, resource, is_prefix, action, effect)``: a principal is a user, a group or ``*``.
    Each request names its principals and each resource its prefixes at ``/``, so both meet by equality. The rules, a policy
    table, go to every task: the requests, many rows each by then, must not, however small their files are.
    """
    parts = F.split("resource_id", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    scope = F.array_union(F.transform(prefixes, lambda p: F.named_struct(F.lit("resource"), p, F.lit("is_prefix"), F.lit(True))),
                          F.array(F.struct(F.col("resource_id").alias("resource"), F.lit(False).alias("is_prefix"))))
    who = F.array_union(F.array(F.col("user_id").cast("string"), F.lit("*")), F.coalesce("groups", F.array().cast("array<string>")))
    ask = requests.select("request_id", "action", F.explode(who).alias("principal"), scope.alias("scope")) \
        .select("request_id", "action", "principal", F.inline("scope"))
    hits = ask.join(F.broadcast(rules), ["principal", "resource", "is_prefix", "action"]).groupBy("request_id").agg(
        F.count_if(F.col("effect") == "allow").alias("_allow"), F.countDistinct("rule_id").alias("applicable_rules"))
    out = requests.join(hits, "request_id", "left")
    return out.withColumns({"decision": F.when(F.coalesce("_allow", F.lit(0)) > 0, "allow").otherwise("deny"),
                            "applicable_rules": F.coalesce("applicable_rules", F.lit(0))}).drop("_allow")


#: What each privacy level does to which columns.
PRIVACY = {"public": (None, ()), "internal": ("mask", ("email", "phone", "ssn")), "confidential": ("encrypt", ("email", "phone", "ssn", "address")),
           "restricted": ("tokenize", ("email", "phone", "ssn", "address", "name"))}


def apply_privacy(df: DataFrame, level: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Treat the sensitive columns of a level; ``columns`` maps sensitive names to those of the frame."""
    if level not in PRIVACY:
        raise ValueError(f"unknown privacy level {level!r}")
    method, names = PRIVACY[level]
    mapped = [(columns or {}).get(n, n) for n in names]
    found = [n for n in mapped if n in df.columns]
    return df.withColumns({n: masked(n, method) for n in found}) if method and found else df


def query_log_report(log: DataFrame, source: str, millis: str, cached: Column, failed: Column, slow_millis: float = 5000) -> DataFrame:
    return log.groupBy(source).agg(F.count(F.lit(1)).alias("queries"), F.avg(millis).alias("mean_millis"), F.max(millis).alias("max_millis"),
                                   F.count_if(F.col(millis) > slow_millis).alias("slow"), (F.count_if(cached) / F.count(F.lit(1))).alias("cache_hit_rate"),
                                   F.count_if(failed).alias("failed"))
