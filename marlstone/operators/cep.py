"""Event patterns over keyed, time-ordered rows.

A pattern is a list of steps. A match starts at each row that satisfies the first step and takes the earliest
qualifying row for every following one; it must end within the pattern's time. Rows are cut into
(key, time slice) groups that also hold the look-ahead rows of the next slice, so a busy key is spread over
its slices.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.columns import constant_map, ladder, micros, null_safe_join
from marlstone.operators.windows import numbered, range_frame, rows_frame, running
from marlstone.session import written


@dataclass(frozen=True)
class Step:
    """``when``: SQL condition; ``times``: least repetitions; ``consecutive``: repetitions with no row between;
    ``strict``: the step must be the very next row after the previous step."""

    when: str
    times: int = 1
    consecutive: bool = False
    strict: bool = False


@dataclass(frozen=True)
class Pattern:
    """``absent``: condition that must not occur after the (single) step within the time."""

    name: str
    severity: str
    within: float
    steps: tuple[Step, ...]
    absent: str | None = None
    actions: tuple[str, ...] = ("manual_review",)
    events: int = field(init=False, default=0)

    def __post_init__(self):
        object.__setattr__(self, "events", sum(s.times for s in self.steps))


def _sliced(df: DataFrame, ts: str, within: float) -> DataFrame:
    """Each row in its own slice and, when it lies in the look-ahead of the slice before, there too."""
    ahead = int(within * 1_000_000)
    width = max(4 * ahead, 60_000_000)
    d = df.withColumn("_us", micros(ts)).withColumn("_home", F.floor(F.col("_us") / width))
    return d.withColumn("_chunk", F.explode(F.array_compact(F.array(
        F.col("_home"), F.when(F.pmod(F.col("_us"), F.lit(width)) <= ahead, F.col("_home") - 1)))))


def match_pattern(df: DataFrame, keys: list[str], ts: str, ident: str, pattern: Pattern,
                  maxima: dict[str, Column] | None = None) -> DataFrame:
    """One row per match: keys, start and end (id, microseconds), and the ``maxima`` over the matched rows.

    Evaluated from the last step to the first: next to each row stands the completion of the steps that
    follow, looked up in windows that all share one partitioning and one order.
    """
    maxima = maxima or {}
    d = _sliced(df, ts, pattern.within)
    part = [*keys, "_chunk"]
    ascending = Window.partitionBy(*part).orderBy("_us", ident)
    later = Window.partitionBy(*part).orderBy(F.col("_us").desc(), F.col(ident).desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    over = f"over (partition by {', '.join(f'`{p}`' for p in part)} order by `_us`, `{ident}`)"
    d = d.withColumns({f"_v_{n}": c.cast("double") for n, c in maxima.items()})
    tops = [F.col(f"_v_{n}").alias(n) for n in maxima]

    if pattern.absent:
        hit = F.expr(pattern.absent)
        d = d.withColumn("_next", F.last(F.when(hit, F.col("_us")), ignorenulls=True).over(later))
        alone = F.col("_next").isNull() | (F.col("_next") - F.col("_us") >= int(pattern.within * 1_000_000))
        return d.filter(F.expr(pattern.steps[0].when) & alone & (F.col("_chunk") == F.col("_home"))).select(
            *keys, F.col(ident).alias("start_id"), F.col("_us").alias("start_us"), F.col(ident).alias("end_id"),
            (F.col("_us") + int(pattern.within * 1_000_000)).alias("end_us"), *tops)

    d = d.withColumn("_after", F.struct(F.col("_us").alias("end_us"), F.col(ident).alias("end_id"), *tops))
    for k in range(len(pattern.steps) - 1, -1, -1):
        s = pattern.steps[k]
        d = d.withColumn("_p", F.coalesce(F.expr(s.when), F.lit(False)))
        if s.times > 1:
            d = d.withColumn("_q", F.when(F.col("_p"), F.struct(F.col("_after").alias("a"), *tops)))
            if s.consecutive:
                run = F.sum(F.col("_p").cast("int")).over(ascending.rowsBetween(0, s.times - 1)) == s.times
                ahead = lambda j: F.lead("_q", j).over(ascending) if j else F.col("_q")
            else:
                run = F.col("_p")
                ahead = lambda j: F.expr(f"lead(_q, {j}) ignore nulls {over}") if j else F.col("_q")
            d = d.withColumn("_last", F.when(run, ahead(s.times - 1)))
            best = {n: F.greatest(F.col(f"_last.a.{n}"), *[ahead(j)[n] for j in range(s.times)]) for n in maxima}
            d = d.withColumns({f"_b_{n}": c for n, c in best.items()})
            done = F.col("_last.a")
            merged = F.struct(F.col("_last.a.end_us").alias("end_us"), F.col("_last.a.end_id").alias("end_id"),
                              *[F.col(f"_b_{n}").alias(n) for n in maxima])
        else:
            done = F.col("_after")
            merged = F.struct(F.col("_after.end_us").alias("end_us"), F.col("_after.end_id").alias("end_id"),
                              *[F.greatest(F.col(f"_after.{n}"), F.col(f"_v_{n}")).alias(n) for n in maxima])
        d = d.withColumn("_whole", F.when(F.col("_p") & done.isNotNull(), merged))
        if k:
            boxed = F.struct(F.col("_whole").alias("w"))
            nxt = F.lead(F.when(F.col("_p"), boxed)).over(ascending) if s.strict else \
                F.last(F.when(F.col("_p"), boxed), ignorenulls=True).over(later)
            d = d.withColumn("_n", nxt).withColumn("_after", F.col("_n.w"))
    fits = F.col("_whole.end_us") - F.col("_us") < int(pattern.within * 1_000_000)
    return d.filter(fits & (F.col("_chunk") == F.col("_home"))).select(
        *keys, F.col(ident).alias("start_id"), F.col("_us").alias("start_us"), "_whole.end_id", "_whole.end_us",
        *[F.col(f"_whole.{n}").alias(n) for n in maxima])


#: Base risk by severity.
SEVERITY_RISK = {"CRITICAL": 1.0, "HIGH": 0.75, "MEDIUM": 0.5, "LOW": 0.25}


def alerts(matches: DataFrame, pattern: Pattern, amount: str | None = None, new_account: str | None = None) -> DataFrame:
    """Match rows as alerts: duration, risk (+0.2 large amount, +0.15 new account, +0.1 many events), actions."""
    risk = F.lit(SEVERITY_RISK.get(pattern.severity, 0.5)) + (0.1 if pattern.events > 10 else 0.0)
    if amount:
        risk = risk + F.when(F.col(amount) > 100_000, 0.2).otherwise(0.0)
    if new_account:
        risk = risk + F.when(F.col(new_account) > 0, 0.15).otherwise(0.0)
    return matches.withColumns({
        "pattern_name": F.lit(pattern.name), "severity": F.lit(pattern.severity), "event_count": F.lit(pattern.events),
        "duration_seconds": (F.col("end_us") - F.col("start_us")) / 1_000_000,
        "risk_score": F.round(F.least(F.lit(1.0), risk), 2), "actions": F.lit(",".join(pattern.actions))})


#: Rows of one block of candidates, and how many times more blocks each round looks at.
BLOCK, WIDEN = 32, 8


def match_from_start(df: DataFrame, keys: list[str], ts: str, ident: str, start: str, steps: list[tuple],
                     within: float, columns: list[str]) -> DataFrame:
    """Matches whose later steps compare with the start row (worse than it, same side, other provider).

    ``steps``: (condition of the columns of a row and of its start, times, consecutive), then, if there are any, the part of the
    condition that needs no start row and the columns in which both are equal. A step ends at its ``times``-th row after the step
    before; ``consecutive`` asks that its rows follow each other without a gap.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    d = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], micros(ts).alias("_us"), F.col(ident).alias("_id"),
                  F.coalesce(F.expr(start), F.lit(False)).alias("_start"), *columns).filter("_us is not null")
    width = max(int(within * 1_000_000) // 8, 1_000_000)
    rows = written(numbered(d, named, "_us", ["_id"], out="_rn", slice_by=F.floor(F.col("_us") / width)))
    found = rows.filter("_start").select(*named, F.col("_rn").alias("_s_rn"), F.col("_rn").alias("_at"), F.struct("_us", "_id", *columns).alias("_s"))
    for step in steps:
        found = _next_of_start(rows, found, named, columns, int(within * 1_000_000), *step)
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, named)], F.col("_s._id").alias("start_id"), F.col("_s._us").alias("start_us"),
                        F.col("_end._id").alias("end_id"), F.col("_end._us").alias("end_us"))


def _next_of_start(rows: DataFrame, found: DataFrame, keys: list[str], columns: list[str], within: int, holds: Callable, times: int,
                   consecutive: bool, alone: Callable | None = None, same: tuple[str, ...] = ()) -> DataFrame:
    """One step: the first ``times`` rows after ``_at`` that fit the start row.

    Rows that can satisfy the step stand in blocks of consecutive ones, per key and values of the ``same`` columns. A start row looks
    at the block it lies in, then at the 8 after it, the 64 after those and so on, until it has its rows or the time is over: it
    takes along the rows it found and no others, so nothing grows with the rows that lie within the time.
    """
    group = [*keys, *[f"_e{i}" for i in range(len(same))]]
    able = rows.filter(alone({c: F.col(c) for c in columns})) if alone else rows
    able = able.select(*keys, *[F.col(c).alias(f"_e{i}") for i, c in enumerate(same)], F.col("_rn").alias("_at"), F.struct("_rn", "_us", "_id", *columns).alias("_r"))
    asked = found.select(*keys, *[F.col("_s")[c].alias(f"_e{i}") for i, c in enumerate(same)], "_at", "_s_rn", "_s")
    both = able.unionByName(asked, allowMissingColumns=True).withColumn("_asks", F.col("_s_rn").isNotNull()).dropna(subset=group[len(keys):])
    placed = written(running(both, group, "_at", ["_asks"], {"_n": ("sum", (~F.col("_asks")).cast("long"))}, slice_by=F.floor(F.col("_at") / 65_536)))
    blocks = placed.filter("not _asks").groupBy(*group, F.floor((F.col("_n") - 1) / BLOCK).alias("_block")).agg(F.sort_array(F.collect_list("_r")).alias("_rows"))
    row, hit = (placed.select(c).dtypes[0][1] for c in ("_r", F.struct("_r._rn", "_r._us", "_r._id").alias("_h")))
    pending = placed.filter("_asks").select(*group, "_at", "_s_rn", "_s", F.floor(F.col("_n") / BLOCK).alias("_from"), F.array().cast(f"array<{hit}>").alias("_hits"))
    done, span = [], 1
    while True:
        looked = null_safe_join(pending.withColumn("_block", F.explode(F.expr(f"sequence(_from, _from + {span - 1})"))), blocks, [*group, "_block"], "left")
        fits = F.filter("_rows", lambda r: (r["_rn"] > F.col("_at")) & (r["_us"] - F.col("_s._us") < within)
                        & holds({c: r[c] for c in columns}, {c: F.col("_s")[c] for c in columns}))
        looked = looked.withColumns({
            "_new": F.transform(F.slice(F.coalesce(fits, F.array().cast(f"array<{row}>")), 1, times), lambda r: F.struct(r["_rn"].alias("_rn"), r["_us"].alias("_us"), r["_id"].alias("_id"))),
            "_seen": F.coalesce(F.size("_rows"), F.lit(0)), "_upto": F.element_at("_rows", -1)["_us"]}).drop("_rows", "_block")
        if span > 1:
            looked = looked.groupBy(*group, "_s_rn").agg(*[F.first(c).alias(c) for c in ("_at", "_s", "_from", "_hits")],
                                                        F.sort_array(F.flatten(F.collect_list("_new"))).alias("_new"), F.sum("_seen").alias("_seen"), F.max("_upto").alias("_upto"))
        looked = written(looked.withColumn("_hits", F.slice(F.concat("_hits", "_new"), 1, times)))
        done.append(looked.filter(F.size("_hits") == times))
        ahead = (F.size("_hits") < times) & (F.col("_seen") == span * BLOCK) & (F.col("_upto") - F.col("_s._us") < within)
        pending = looked.filter(ahead).select(*group, "_at", "_s_rn", "_s", (F.col("_from") + span).alias("_from"), "_hits")
        if pending.isEmpty():
            break
        span *= WIDEN
    out = reduce(DataFrame.unionByName, done)
    if consecutive:
        out = out.filter(F.element_at("_hits", -1)["_rn"] - F.col("_hits")[0]["_rn"] == times - 1)
    return out.select(*keys, "_s_rn", F.element_at("_hits", -1)["_rn"].alias("_at"), "_s", F.element_at("_hits", -1).alias("_end"))


def _p(name, severity, minutes, *steps, absent=None, actions=("manual_review",)):
    return Pattern(name, severity, minutes * 60.0, tuple(steps), absent, tuple(actions))


def _type(*names, extra=""):
    listed = ", ".join(f"'{n}'" for n in names)
    return f"event_type in ({listed})" + (f" and {extra}" if extra else "")


#: Conditions, counts, times and responses of the known patterns.
PATTERNS = {p.name: p for p in (
    _p("velocity_check", "HIGH", 5, Step(_type("TRANSACTION"), 10), actions=("freeze_account", "manual_review", "notify_user")),
    _p("account_takeover", "CRITICAL", 30, Step(_type("LOGIN_FAILED"), 3, True), Step(_type("LOGIN_SUCCESS"), strict=True),
       Step(_type("PASSWORD_CHANGE", "EMAIL_CHANGE", "LARGE_WITHDRAWAL"), strict=True),
       actions=("force_logout", "reset_password", "notify_user", "block_ip")),
    _p("money_laundering", "CRITICAL", 24 * 60, Step(_type("DEPOSIT", extra="amount > 5000")),
       Step(_type("TRANSFER", extra="amount < 1000"), 5), actions=("freeze_account", "file_sar", "compliance_review")),
    _p("pump_and_dump", "HIGH", 48 * 60, Step(_type("ASSET_PROMOTED")), Step(_type("PRICE_UPDATE", extra="change > 50")),
       Step(_type("SELL_ORDER", extra="amount > 10000")), actions=("halt_trading", "investigate_promoters", "notify_exchange")),
    _p("sybil_attack", "HIGH", 60, Step(_type("ACCOUNT_CREATED"), 5), Step(_type("VOTE", "REVIEW", "LIKE"), 5),
       actions=("block_accounts", "invalidate_actions", "ip_analysis")),
    _p("brute_force", "HIGH", 5, Step(_type("LOGIN_FAILED", "API_AUTH_FAILED"), 10), actions=("block_ip", "rate_limit", "captcha_enable")),
    _p("privilege_escalation", "CRITICAL", 10, Step(_type("RESOURCE_ACCESS", extra="level = 'user'")),
       Step(_type("RESOURCE_ACCESS", extra="level = 'admin'")), Step(_type("ACCESS_DENIED"), 3)),
    _p("data_exfiltration", "CRITICAL", 30, Step(_type("DATA_ACCESS", extra="amount > 1000"), 5), Step(_type("EXTERNAL_API_CALL")),
       actions=("revoke_access", "audit_logs", "notify_security")),
    _p("cascading_failure", "CRITICAL", 5, Step(_type("SYSTEM_ERROR")), Step(_type("SYSTEM_ERROR", extra="related is not null"), 3)),
    _p("resource_exhaustion", "HIGH", 10, Step(_type("RESOURCE_METRIC", extra="amount > 80"), 5, True),
       Step(_type("RESOURCE_METRIC", extra="amount > 95"))),
    _p("latency_spike", "MEDIUM", 5, Step(_type("API_RESPONSE", extra="amount < 100")), Step(_type("API_RESPONSE", extra="amount > 1000"), 10)),
    _p("compliance_violation", "HIGH", 30, Step(_type("LARGE_TRANSACTION", "CROSS_BORDER_TRANSFER")),
       absent=_type("COMPLIANCE_CHECK_COMPLETED")),
    _p("trading_manipulation", "HIGH", 240, Step(_type("BUY_ORDER", extra="amount > 50000")),
       Step(_type("PRICE_UPDATE", extra="change > 10")), Step(_type("SELL_ORDER", extra="amount > 50000"))),
    _p("duplicate_submission", "LOW", 1, Step(_type("FORM_SUBMITTED")), Step(_type("FORM_SUBMITTED"), 2)),
    _p("failed_verification_then_success", "HIGH", 30, Step(_type("VERIFICATION_FAILED"), 3, True),
       Step(_type("ASSET_CREATED", "TRANSACTION_COMPLETED"), strict=True)),
    _p("wash_trading", "HIGH", 5, Step(_type("ORDER_PLACED", extra="side = 'buy'")), Step(_type("ORDER_PLACED", extra="side = 'sell'")),
       actions=("freeze_account", "manual_review", "report_to_compliance")),
    _p("spoofing_buy", "HIGH", 1, Step(_type("ORDER_PLACED", extra="side = 'buy' and amount > average * 10")), Step(_type("ORDER_CANCELLED"), 3),
       Step(_type("ORDER_PLACED", extra="side <> 'buy'")), actions=("cancel_orders", "temporary_trading_ban", "increase_monitoring")),
    _p("spoofing_sell", "HIGH", 1, Step(_type("ORDER_PLACED", extra="side = 'sell' and amount > average * 10")), Step(_type("ORDER_CANCELLED"), 3),
       Step(_type("ORDER_PLACED", extra="side <> 'sell'")), actions=("cancel_orders", "temporary_trading_ban", "increase_monitoring")),
    _p("layering", "MEDIUM", 1 / 6, Step(_type("ORDER_PLACED")), Step(_type("ORDER_PLACED"), 4),
       actions=("cancel_orders", "warning_notice", "increase_fees")),
    _p("price_spike", "MEDIUM", 1, Step(_type("PRICE_UPDATE")), Step(_type("PRICE_UPDATE", extra="abs(amount - previous) / previous > 0.05")),
       actions=("temporary_halt", "widen_price_bands", "alert_market_makers")),
    _p("volume_anomaly", "MEDIUM", 1, Step(_type("VOLUME_UPDATE", extra="amount > average * 10"))),
    _p("funding_rate_anomaly", "MEDIUM", 1, Step(_type("FUNDING_RATE_UPDATE", extra="abs(amount - previous) > 0.001"))),
    _p("liquidation_cascade", "CRITICAL", 5, Step(_type("POSITION_LIQUIDATED")), Step(_type("POSITION_LIQUIDATED"), 3),
       actions=("halt_trading", "increase_margin_requirements", "activate_circuit_breakers")),
    _p("position_limit", "HIGH", 1, Step(_type("POSITION_UPDATE", extra="amount > average")),
       actions=("prevent_new_orders", "force_position_reduction", "notify_risk_team")),
    _p("concentration_risk", "HIGH", 1, Step(_type("MARKET_SHARE_UPDATE", extra="amount > 0.25"))),
    _p("rapid_position_change", "MEDIUM", 60, Step(_type("POSITION_UPDATE")), Step(_type("POSITION_UPDATE", extra="abs(amount - previous) / previous > 0.5"))),
    _p("convergence_stall", "LOW", 60, Step(_type("CONVERGENCE_STATUS")), Step(_type("CONVERGENCE_STATUS", extra="change > -0.001"), 5, True)),
    _p("oscillation", "LOW", 5, Step(_type("DOMAIN_METRICS", extra="amount > 0.1")), Step(_type("DOMAIN_METRICS", extra="amount < 0.01")),
       Step(_type("DOMAIN_METRICS", extra="amount > 0.1"))),
    _p("domain_cascade", "HIGH", 5, Step(_type("DOMAIN_METRICS", extra="level = 'failed'")), Step(_type("DOMAIN_METRICS", extra="level = 'failed'"), 2)),
    _p("sustained_low_uptime", "HIGH", 15, Step(_type("UPTIME_CHECK", extra="amount < average * 0.95"), 3, True)),
    _p("critical_uptime_failure", "CRITICAL", 1, Step(_type("UPTIME_CHECK", extra="amount < 90.0"))),
    _p("provider_unresponsive", "CRITICAL", 5, Step(_type("HEARTBEAT")), absent=_type("HEARTBEAT")),
    _p("provider_exhaustion", "HIGH", 10, Step("amount > 85.0 or change > 85.0", 3, True), Step("amount > 95.0 or change > 95.0")),
    _p("intermittent_failure", "MEDIUM", 60, Step("related is not null"), Step("related is null"), Step("related is not null", 3)),
    _p("violation_storm", "HIGH", 5, Step("related is not null", 10)),
)}


def worsening(within: float = 1800.0):
    """Two later checks below 95 % of the first degraded one."""
    return [(lambda r, s: r["amount"] < s["amount"] * 0.95, 2, False, lambda r: r["event_type"] == "PERFORMANCE_CHECK")], within


def recovering(within: float = 1200.0):
    """Three consecutive checks above 110 % of the first low one."""
    return [(lambda r, s: r["amount"] > s["amount"] * 1.1, 3, True, lambda r: r["event_type"] == "PERFORMANCE_CHECK")], within


def correlated_failures(within: float = 900.0):
    """Two later outages of other providers in the region (the key)."""
    return [(lambda r, s: r["provider"] != s["provider"], 2, False, lambda r: r["event_type"] == "PROVIDER_DOWN")], within


def front_running(within: float = 30.0):
    """A large order of somebody else after a small one, then the first user on the opposite side."""
    return [(lambda r, s: r["provider"] != s["provider"], 1, False, lambda r: (r["event_type"] == "ORDER_PLACED") & (r["amount"] > r["average"] * 5)),
            (lambda r, s: r["side"] != s["side"], 1, False, lambda r: r["event_type"] == "ORDER_PLACED", ("provider",))], within


def risk_indicators(event_type: Column, amount: Column, account_age_days: Column, rate_per_minute: Column) -> Column:
    transaction = event_type == "TRANSACTION"
    return F.array_compact(F.array(
        F.when(transaction & (amount > 10_000), "high_value"), F.when(transaction & (amount > 100_000), "very_high_value"),
        F.when(account_age_days < 7, "new_account"), F.when(rate_per_minute > 10, "rapid_actions")))


def alert_trend(alerts_df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Hourly counts and whether the last three rise or fall strictly."""
    hourly = alerts_df.groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    out = rows_frame(hourly, keys, "hour", [], lambda w: {"_a": F.lag("n").over(w), "_b": F.lag("n", 2).over(w)},
                     before=2, slice_seconds=30 * 86_400)
    trend = ladder([((F.col("n") > F.col("_a")) & (F.col("_a") > F.col("_b")), "INCREASING"),
                    ((F.col("n") < F.col("_a")) & (F.col("_a") < F.col("_b")), "DECREASING")], "STABLE")
    return out.withColumn("trend", trend).drop("_a", "_b")


def repeats(alerts_df: DataFrame, keys: list[str], ts: str, ident: str, within_seconds: float) -> DataFrame:
    """Did the same key occur less than ``within_seconds`` before?"""
    out = range_frame(alerts_df, keys, ts, lambda w: {"_prev": F.lag("_us").over(w)}, before=within_seconds, ties=[ident])
    gap = micros(ts) - F.col("_prev")
    return out.withColumn("is_repeat", F.coalesce(gap < int(within_seconds * 1_000_000), F.lit(False))).drop("_prev")
