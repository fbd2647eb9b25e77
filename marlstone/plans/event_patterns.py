"""Event patterns over a denser copy of the events: types and measures derived, time compressed."""

from pyspark.sql import functions as F

from marlstone.functions.columns import micros
from marlstone.operators import cep
from marlstone.operators.cep import PATTERNS
from marlstone.operators.windows import rows_frame
from marlstone.plans.derived import SQL_K, k_of
from marlstone.plans.registry import query

#: Which columns a pattern's stream holds: event types in use, amount scale, time compression, key count.
EPOCH = 1_704_067_200_000_000
STREAMS = {
    "velocity_check": (["TRANSACTION", "OTHER"], "value", 600, 10), "account_takeover": (["LOGIN_FAILED", "LOGIN_FAILED", "LOGIN_SUCCESS", "PASSWORD_CHANGE"], "value", 300, 20),
    "money_laundering": (["DEPOSIT", "TRANSFER"], "value * 100", 10, 20), "pump_and_dump": (["ASSET_PROMOTED", "PRICE_UPDATE", "SELL_ORDER"], "value * 300", 10, 20),
    "sybil_attack": (["ACCOUNT_CREATED", "VOTE"], "value", 60, 10), "brute_force": (["LOGIN_FAILED", "API_AUTH_FAILED", "X"], "value", 600, 10),
    "privilege_escalation": (["RESOURCE_ACCESS", "ACCESS_DENIED"], "value", 200, 20), "data_exfiltration": (["DATA_ACCESS", "EXTERNAL_API_CALL"], "value * 50", 200, 10),
    "cascading_failure": (["SYSTEM_ERROR", "OK"], "value", 600, 10), "resource_exhaustion": (["RESOURCE_METRIC"], "least(value * 3, 100)", 600, 10),
    "latency_spike": (["API_RESPONSE"], "value * 30", 600, 10), "compliance_violation": (["LARGE_TRANSACTION", "COMPLIANCE_CHECK_COMPLETED", "X"], "value", 60, 20),
    "trading_manipulation": (["BUY_ORDER", "PRICE_UPDATE", "SELL_ORDER"], "value * 1500", 60, 10), "duplicate_submission": (["FORM_SUBMITTED", "X"], "value", 3000, 10),
    "failed_verification_then_success": (["VERIFICATION_FAILED", "VERIFICATION_FAILED", "ASSET_CREATED"], "value", 200, 10),
    "wash_trading": (["ORDER_PLACED"], "value", 600, 20), "spoofing_buy": (["ORDER_PLACED", "ORDER_CANCELLED"], "value * value", 6000, 10),
    "spoofing_sell": (["ORDER_PLACED", "ORDER_CANCELLED"], "value * value", 6000, 10), "layering": (["ORDER_PLACED", "X"], "value", 12000, 5),
    "price_spike": (["PRICE_UPDATE"], "value + 100", 2000, 10), "volume_anomaly": (["VOLUME_UPDATE"], "value * value", 1, 10),
    "funding_rate_anomaly": (["FUNDING_RATE_UPDATE"], "value / 50000", 1, 10), "liquidation_cascade": (["POSITION_LIQUIDATED", "X"], "value", 600, 10),
    "position_limit": (["POSITION_UPDATE"], "value", 1, 10), "concentration_risk": (["MARKET_SHARE_UPDATE"], "value / 300", 1, 10),
    "rapid_position_change": (["POSITION_UPDATE"], "value + 30", 60, 10), "convergence_stall": (["CONVERGENCE_STATUS"], "value", 60, 10),
    "oscillation": (["DOMAIN_METRICS"], "value / 500", 600, 10), "domain_cascade": (["DOMAIN_METRICS"], "value", 600, 10),
    "sustained_low_uptime": (["UPTIME_CHECK"], "value", 200, 10), "critical_uptime_failure": (["UPTIME_CHECK"], "100 - value / 10", 1, 10),
    "provider_unresponsive": (["HEARTBEAT", "X"], "value", 600, 10), "provider_exhaustion": (["M"], "least(value * 3, 100)", 600, 10),
    "intermittent_failure": (["M"], "value", 60, 10), "violation_storm": (["M"], "value", 600, 10)}
#: Patterns that compare with the key's previous amount or the mean of its 20 amounts before.
EARLIER = {"spoofing_buy", "spoofing_sell", "price_spike", "volume_anomaly", "funding_rate_anomaly", "position_limit", "rapid_position_change",
           "sustained_low_uptime", "perf"}


def stream_sql(name: str) -> str:
    types, amount, speed, groups = STREAMS.get(name, (["PERFORMANCE_CHECK"], "value", 200, 10))
    kinds = " ".join(f"when {i} then '{x}'" for i, x in enumerate(types))
    rows = f"""select event_id, user_id % {groups} entity, user_id provider, {EPOCH} + (epoch_us(ts) - {EPOCH}) // {speed} us, case {SQL_K} % {len(types)} {kinds} end event_type,
   ({amount})::DOUBLE amount, {SQL_K}::DOUBLE change, case event_id % 3 when 0 then 'user' when 1 then 'admin' else 'failed' end "level",
   case when event_id % 2 = 0 then 'buy' else 'sell' end side, case when event_id % 5 < 2 then 'r' end related from events"""
    if name not in EARLIER:
        return rows
    return f"""select *, lag(amount) over (partition by entity order by us, event_id) previous,
   avg(amount) over (partition by entity order by us, event_id rows between 20 preceding and 1 preceding) average from ({rows}) earlier"""


def stream(t, name):
    types, amount, speed, groups = STREAMS.get(name, (["PERFORMANCE_CHECK"], "value", 200, 10))
    e = t.events
    k = k_of(e)
    kind = F.element_at(F.array(*[F.lit(x) for x in types]), k % len(types) + 1)
    us = F.lit(EPOCH) + F.floor((micros("ts") - EPOCH) / speed)
    rows = e.select(
        "event_id", (F.col("user_id") % groups).alias("entity"), F.col("user_id").alias("provider"), F.timestamp_micros(us).alias("ts"), kind.alias("event_type"),
        F.expr(f"double({amount})").alias("amount"), k.cast("double").alias("change"),
        F.expr("case event_id % 3 when 0 then 'user' when 1 then 'admin' else 'failed' end").alias("level"),
        F.expr("case when event_id % 2 = 0 then 'buy' else 'sell' end").alias("side"), F.expr("case when event_id % 5 < 2 then 'r' end").alias("related"))
    if name not in EARLIER:
        return rows
    return rows_frame(rows, ["entity"], "ts", ["event_id"], lambda w: {"previous": F.lag("amount").over(w), "average": F.avg("amount").over(w.rowsBetween(-20, -1))}, before=20)


def match_sql(p: cep.Pattern) -> str:
    """The chain of next qualifying rows, one lookup per matched row."""
    head = f"""with s as ({stream_sql(p.name)}),
 e as (select *, row_number() over (partition by entity order by us, event_id) rn from s)"""
    us = int(p.within * 1_000_000)
    if p.absent:
        return head + f"""
select a.event_id start_id, a.us start_us, a.event_id end_id, a.us + {us} end_us from e a where ({p.steps[0].when})
 and not exists (select 1 from (select * from e where {p.absent}) b where b.entity = a.entity and b.rn > a.rn and b.us - a.us < {us})"""
    units = [(s.when, (s.strict and j == 0) or (s.consecutive and j > 0)) for s in p.steps for j in range(s.times)]
    ctes = [f"c0 as (select entity, rn start_rn, rn cur from e where {units[0][0]})"]
    for i, (when, strict) in enumerate(units[1:], 1):
        hit = f"h{i} as (select entity, rn from e where {when})"
        cond = "h.rn = c.cur + 1" if strict else "h.rn > c.cur"
        ctes.append(hit)
        ctes.append(f"c{i} as (select c.entity, c.start_rn, min(h.rn) cur from c{i - 1} c join h{i} h on h.entity = c.entity and {cond} group by all)" if strict else
                    f"c{i} as (select c.entity, c.start_rn, h.rn cur from c{i - 1} c asof join h{i} h on h.entity = c.entity and h.rn > c.cur)")
    last = len(units) - 1
    return head + ",\n " + ",\n ".join(ctes) + f"""
select a.event_id start_id, a.us start_us, b.event_id end_id, b.us end_us from c{last} c join e a on a.entity = c.entity and a.rn = c.start_rn
 join e b on b.entity = c.entity and b.rn = c.cur where b.us - a.us < {us}"""


#: Inventory row by pattern.
IDS = {
    "velocity_check": "CEP1", "account_takeover": "CEP2", "money_laundering": "CEP3", "pump_and_dump": "CEP4", "sybil_attack": "CEP5", "brute_force": "CEP6",
    "privilege_escalation": "CEP7", "data_exfiltration": "CEP8", "cascading_failure": "CEP9", "resource_exhaustion": "CEP10", "latency_spike": "CEP11",
    "compliance_violation": "CEP12", "trading_manipulation": "CEP13", "duplicate_submission": "CEP14", "failed_verification_then_success": "CEP15",
    "wash_trading": "CEP16", "spoofing_buy": "CEP17", "spoofing_sell": "CEP17", "layering": "CEP18", "price_spike": "CEP20", "volume_anomaly": "CEP21",
    "funding_rate_anomaly": "CEP21", "liquidation_cascade": "CEP22", "position_limit": "CEP23", "concentration_risk": "CEP23", "rapid_position_change": "CEP23",
    "convergence_stall": "CEP24", "oscillation": "CEP24", "domain_cascade": "CEP24", "sustained_low_uptime": "CEP25", "critical_uptime_failure": "CEP25",
    "provider_unresponsive": "CEP26", "provider_exhaustion": "CEP26", "intermittent_failure": "CEP27", "violation_storm": "CEP27"}


def _register(p: cep.Pattern):
    @query(f"{IDS[p.name].lower()}_{p.name}", IDS[p.name], match_sql(p))
    def _(t):
        return cep.match_pattern(stream(t, p.name), ["entity"], "ts", "event_id", p).drop("entity")


for _pattern in PATTERNS.values():
    _register(_pattern)


@query("cep28_alerts", "CEP28", f"""with m as ({match_sql(PATTERNS['money_laundering'])}),
 a as (select m.*, (select max(x.amount) from ({stream_sql('money_laundering')}) x where x.event_id = m.start_id) top from m)
select start_id, 6 event_count, round((end_us - start_us) / 1e6, 6) duration_seconds, 1.0::DOUBLE risk_score, 'freeze_account,file_sar,compliance_review' actions, round(top, 4) top_amount from a""")
def _(t):
    p = PATTERNS["money_laundering"]
    m = cep.match_pattern(stream(t, p.name), ["entity"], "ts", "event_id", p, {"top_amount": F.col("amount")})
    a = cep.alerts(m, p, "top_amount")
    return a.select("start_id", "event_count", F.round("duration_seconds", 6).alias("duration_seconds"), "risk_score", "actions",
                    F.round("top_amount", 4).alias("top_amount"))


def start_sql(start: str, steps: list[tuple[str, int, bool]], within: float, rows: str | None = None) -> str:
    """Start rows a, then step by step the first rows b that satisfy a condition on both."""
    us = int(within * 1_000_000)
    out = f"""with s as ({rows or stream_sql('perf')}), e as (select *, row_number() over (partition by entity order by us, event_id) rn from s),
 m0 as (select *, rn cur from e where {start})"""
    for i, (when, times, consecutive) in enumerate(steps, 1):
        out += f""",
 h{i} as (select a.entity, a.rn, b.rn hit, row_number() over (partition by a.entity, a.rn order by b.rn) k from m{i - 1} a join e b on b.entity = a.entity and b.rn > a.cur and b.us - a.us < {us} and {when}),
 n{i} as (select entity, rn, min(hit) lo, max(hit) hi, count(*) n from h{i} where k <= {times} group by all),
 m{i} as (select e.*, n.hi cur from n{i} n join e using (entity, rn) where n.n = {times}{f' and hi - lo = {times - 1}' if consecutive else ''})"""
    return out + f"""
select m.entity, m.event_id start_id, m.us start_us, b.event_id end_id, b.us end_us from m{len(steps)} m join e b on b.entity = m.entity and b.rn = m.cur"""


@query("cep25_worsening", "CEP25", start_sql("amount < 50", [("b.amount < a.amount * 0.95", 2, False)], 1800))
def _(t):
    steps, within = cep.worsening()
    return cep.match_from_start(stream(t, "perf"), ["entity"], "ts", "event_id", "amount < 50", steps, within, ["event_type", "amount"])


@query("cep27_recovering", "CEP27", start_sql("amount < 20", [("b.amount > a.amount * 1.1", 3, True)], 1200))
def _(t):
    steps, within = cep.recovering()
    return cep.match_from_start(stream(t, "perf"), ["entity"], "ts", "event_id", "amount < 20", steps, within, ["event_type", "amount"])


@query("cep27_correlated_failures", "CEP27", start_sql("amount > 60", [("b.provider <> a.provider", 2, False)], 900))
def _(t):
    steps, within = cep.correlated_failures()
    s = stream(t, "perf").withColumn("event_type", F.lit("PROVIDER_DOWN"))
    return cep.match_from_start(s, ["entity"], "ts", "event_id", "amount > 60", steps, within, ["event_type", "provider"])


@query("cep19_front_running", "CEP19", start_sql(
    "amount < average * 0.5", [("b.amount > b.average * 5 and b.provider <> a.provider", 1, False), ("b.side <> a.side and b.provider = a.provider", 1, False)], 3600,
    f"select * replace (amount * 3 as amount) from ({stream_sql('perf')})"))
def _(t):
    steps, within = cep.front_running(3600.0)
    s = stream(t, "perf").withColumns({"event_type": F.lit("ORDER_PLACED"), "amount": F.col("amount") * 3})
    return cep.match_from_start(s, ["entity"], "ts", "event_id", "amount < average * 0.5", steps, within,
                                ["event_type", "amount", "average", "provider", "side"])
