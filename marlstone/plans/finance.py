"""Risk, compliance, fraud, trust, marketplace and service-level queries."""

from pyspark.sql import functions as F

from marlstone.functions.columns import micros
from marlstone.operators import compliance as co
from marlstone.operators import operations as op
from marlstone.operators import risk, trust
from marlstone.plans.derived import n_rows, events_now, EVENTS_NOW, SQL_K, k_of
from marlstone.plans.registry import query



def r6(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


# -- portfolios: positions of suppliers in returned goods, daily prices from the events -----------------------

POS_SQL = """pos as (select l_suppkey % 40 user_id, case l_returnflag when 'A' then 'click' when 'N' then 'view' else 'purchase' end market, sum(l_quantity) quantity, sum(l_extendedprice) notional from lineitem group by all),
 px as (select event_type market, date_trunc('day', ts)::TIMESTAMP d, 100 + avg(value) * pi() / 3 price from events group by all),
 val as (select user_id, d, sum(quantity * price) v from pos join px using (market) group by all),
 ret as (select user_id, d, v, v / lag(v) over (partition by user_id order by d) - 1 r from val)"""


def positions(t):
    m = F.when(F.col("l_returnflag") == "A", "click").when(F.col("l_returnflag") == "N", "view").otherwise("purchase")
    return t.lineitem.groupBy((F.col("l_suppkey") % 40).alias("user_id"), m.alias("market")).agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("notional"))


def prices(t):
    return t.events.groupBy(F.col("event_type").alias("market"), F.date_trunc("day", "ts").alias("d")).agg((100 + F.avg("value") * F.pi() / 3).alias("price"))


def returns(t):
    return risk.portfolio_values(positions(t), prices(t), "user_id", "market", "d")


@query("rsk1_portfolio_returns", "RSK1", f"with {POS_SQL} select user_id, epoch_us(d) d, round(v, 3) value, round(r, 6) ret from ret")
def _(t):
    return returns(t).select("user_id", micros("d").alias("d"), F.round("value", 3).alias("value"), F.round("ret", 6).alias("ret"))


@query("rsk2_value_at_risk", "RSK2", f"""with {POS_SQL}, q as (select user_id, count(*) n, quantile_cont(r, 0.05) a, quantile_cont(r, 0.01) b from ret where r is not null group by 1),
 c as (select ret.user_id, avg(r) m from ret join q using (user_id) where r <= a group by 1)
select user_id, n observations, round(abs(a), 6) var_95, round(abs(b), 6) var_99, round(abs(m), 6) cvar_95 from q join c using (user_id)""")
def _(t):
    return r6(risk.value_at_risk(returns(t), ["user_id"], min_rows=20), "var_95", "var_99", "cvar_95")


@query("rsk3_performance_ratios", "RSK3", f"""with {POS_SQL}, g as (select user_id, d, r, exp(sum(ln(1 + r)) over (partition by user_id order by d)) c from ret where r is not null),
 w as (select *, c / max(c) over (partition by user_id order by d) - 1 dd from g),
 s as (select user_id, avg(r) m, stddev(r) sd, stddev(r) filter (r < 0) ds, min(dd) md, arg_max(dd, d) cd from w group by 1)
select user_id, round(sqrt(252) * (m - 0.05 / 252) / sd, 6) sharpe, round(sqrt(252) * (m - 0.05 / 252) / ds, 6) sortino, round((power(1 + m, 252) - 1) / abs(md), 4) calmar, round(md, 6) max_drawdown, round(cd, 6) current_drawdown from s""")
def _(t):
    d = risk.performance_ratios(returns(t), ["user_id"], "d", min_rows=20).withColumn("calmar", F.round("calmar", 4))
    return r6(d, "sharpe", "sortino", "max_drawdown", "current_drawdown")


@query("rsk4_greeks", "RSK4", f"with {POS_SQL} select user_id, round(sum(quantity * 0.5), 4) delta, round(sum(quantity * 0.01), 4) gamma, round(sum(notional * pi() / 3000), 4) vega, 0.0::DOUBLE theta from pos group by 1")
def _(t):
    p = positions(t).withColumn("greeks", F.struct((F.col("quantity") * 0.5).alias("delta"), (F.col("quantity") * 0.01).alias("gamma"),
                                                   (F.col("notional") * F.pi() / 3000).alias("vega"), F.lit(None).cast("double").alias("theta")))
    return r6(risk.greeks_total(p, ["user_id"]), "delta", "gamma", "vega", "theta", places=4)


@query("rsk5_mean_correlation", "RSK5", """
with p as (select event_type m, date_trunc('day', ts) d, avg(value) p from events group by all), r as (select m, d, p / lag(p) over (partition by m order by d) - 1 r from p),
 c as (select a.m a, b.m b, corr(a.r, b.r) c from r a join r b on a.d = b.d and a.m < b.m where a.m in ('click', 'view', 'purchase') and b.m in ('click', 'view', 'purchase') group by all)
select round(avg(c), 6) mean_correlation from c""")
def _(t):
    from marlstone.operators.windows import rows_frame
    p = t.events.groupBy(F.col("event_type").alias("m"), F.date_trunc("day", "ts").alias("d")).agg(F.avg("value").alias("p"))
    r = rows_frame(p, ["m"], "d", [], lambda w: {"r": F.col("p") / F.lag("p").over(w) - 1}, before=1, slice_seconds=30 * 86_400)
    return r6(risk.mean_pairwise_correlation(r, "m", "d", "r", ["click", "view", "purchase"]), "mean_correlation")


@query("rsk6_risk_score", "RSK6", f"""
with c as (select user_id, avg(value) / 200 conc, stddev(value) / 200 vol, max({SQL_K}) / 30.0 lev, -avg(value) / 500 dd, count(*) filter (value < 5) ill from events group by 1),
 s as (select user_id, least(100, least(20, floor(conc * 100)) + least(30, floor(vol * 100)) + least(20, floor(lev * 5)) + least(20, floor(abs(dd) * 100)) + least(10, ill * 2))::INTEGER score from c)
select user_id, score, case when score < 20 then 'Very Low' when score < 40 then 'Low' when score < 60 then 'Medium' when score < 80 then 'High' else 'Very High' end "level" from s""")
def _(t):
    c = t.events.groupBy("user_id").agg((F.avg("value") / 200).alias("conc"), (F.stddev("value") / 200).alias("vol"), (F.max(k_of(t.events)) / 30.0).alias("lev"),
                                        (-F.avg("value") / 500).alias("dd"), F.count_if(F.col("value") < 5).alias("ill"))
    c = c.withColumn("score", risk.risk_score(*[F.col(x) for x in ("conc", "vol", "lev", "dd", "ill")]))
    return c.select("user_id", "score", risk.risk_level(F.col("score")).alias("level"))


SCENARIOS = [{"name": "crash", "all_markets": -0.3}, {"name": "views_only", "shocks": {"view": -0.5, "click": 0.1}}, {"name": "mixed", "all_markets": 0.05, "shocks": {"purchase": -0.6}}]
STRESS_SQL = f"""{POS_SQL}, sh(scenario, market, shock) as (values ('crash', 'click', -0.3), ('crash', 'view', -0.3), ('crash', 'purchase', -0.3), ('views_only', 'click', 0.1), ('views_only', 'view', -0.5), ('views_only', 'purchase', 0),
  ('mixed', 'click', 0.05), ('mixed', 'view', 0.05), ('mixed', 'purchase', -0.55)),
 o as (select user_id, scenario, sum(notional * pi()) original, sum(notional * pi() * (1 + shock::DOUBLE)) shocked from pos join sh using (market) group by all)"""


@query("rsk7_stress_test", "RSK7", f"with {STRESS_SQL} select user_id, scenario, round(original, 2) original, round(shocked, 2) shocked, round(shocked - original, 2) pnl, shocked < 0.8 * original margin_call from o")
def _(t):
    return r6(risk.stress_test(positions(t).withColumn("notional", F.col("notional") * F.pi()), "user_id", "market", "notional", SCENARIOS), "original", "shocked", "pnl", places=2)


@query("rsk7_worst_case", "RSK7", f"""with {STRESS_SQL} select user_id, arg_min(scenario, shocked - original) filter (shocked < original) worst_scenario, round(min(shocked - original) filter (shocked < original), 2) worst_pnl,
 count(*) filter (shocked < 0.8 * original) margin_calls from o group by 1""")
def _(t):
    return r6(risk.worst_case(risk.stress_test(positions(t).withColumn("notional", F.col("notional") * F.pi()), "user_id", "market", "notional", SCENARIOS), "user_id"), "worst_pnl", places=2)


@query("rsk8_beta", "RSK8", f"""with {POS_SQL}, m as (select d, avg(r) mr from ret where r is not null group by 1)
select user_id, round(covar_samp(r, mr) / var_samp(mr), 6) beta from ret join m using (d) where r is not null group by 1""")
def _(t):
    r = returns(t).filter("ret is not null")
    m = r.groupBy("d").agg(F.avg("ret").alias("mr"))
    return r6(risk.beta(r.join(m, "d"), ["user_id"], "ret", "mr"), "beta")


@query("rsk9_liquidation_alerts", "RSK9", f"""
with p as (select event_id, case when event_id % 2 = 0 then 'long' else 'short' end side, value price, 40.0 entry, 10.0 + {SQL_K} / 10.0 liq from events),
 h as (select event_id, case when side = 'long' then (price - liq) / nullif(entry - liq, 0) else (liq - price) / nullif(liq - entry, 0) end::DOUBLE h from p)
select event_id, round(h, 6) health_factor, case when h < 1.05 then 'CRITICAL' else 'WARNING' end severity from h where h < 1.2""")
def _(t):
    side = F.when(F.col("event_id") % 2 == 0, "long").otherwise("short")
    return r6(risk.liquidation_alerts(t.events, ["event_id"], side, F.col("value"), F.lit(40.0), 10.0 + k_of(t.events) / 10.0), "health_factor")


@query("rsk10_limit_utilisation", "RSK10", """
with u as (select o_custkey user_id, round(sum(o_totalprice), 2) cur, c_acctbal * 500 lim from orders join customer on c_custkey = o_custkey group by o_custkey, c_acctbal)
select user_id, round(coalesce(cur / nullif(lim, 0), 0) * 100, 4) utilisation, case when cur >= lim then 'breached' when coalesce(cur / nullif(lim, 0), 0) >= 0.95 then 'critical' when coalesce(cur / nullif(lim, 0), 0) >= 0.8 then 'warning' else 'normal' end status from u""")
def _(t):
    u = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("o_custkey").alias("user_id"), "c_acctbal").agg(
        F.round(F.sum("o_totalprice"), 2).alias("cur")).withColumn("lim", F.col("c_acctbal") * 500)
    return risk.limit_utilisation(u, "cur", "lim").select("user_id", F.round("utilisation", 4).alias("utilisation"), "status")


@query("rsk11_concentration", "RSK11", f"""with {POS_SQL} select round((select max(n) from (select sum(notional) n from pos group by market)) / sum(notional), 6) top_market,
 round((select max(n) from (select sum(notional) n from pos group by user_id)) / sum(notional), 6) top_user from pos""")
def _(t):
    return r6(risk.exposure_concentration(positions(t), "market", "user_id", "notional").drop("id"), "top_market", "top_user")


@query("rsk11_system_risk", "RSK11", f"""
with p as (select value * 100 n, value v, {SQL_K} / 4.0 lev, value > 60 s, value > 120 q from events),
 a as (select sum(n) n, sum(v) v, avg(lev) l, avg(s::INTEGER) s, avg(q::INTEGER) q from p)
select least(100, least(30, floor(v / n * 300)) + case when l > 10 then least(20, floor((l - 10) * 2)) else 0 end + floor(s * 25) + floor(q * 25))::INTEGER risk_score from a""")
def _(t):
    p = t.events.select((F.col("value") * 100).alias("n"), F.col("value").alias("v"), (k_of(t.events) / 4.0).alias("lev"))
    return risk.system_risk(p, "n", "v", "lev", F.col("v") > 60, F.col("v") > 120)


# -- monitoring ---------------------------------------------------------------------------------------------

SMALL = {**co.LIMITS, "hour_count": 1, "day_count": 4, "hour_volume": 1000, "day_volume": 3000, "single_alert": 800, "single_block": 1500, "cumulative": 3000,
         "round_count": 1, "structuring_count": 1, "counterparties": 4, "dormant_days": 2}


def tx(t):
    return t.events.select("event_id", "user_id", "ts", F.round(F.col("value") * 10, 2).alias("amount"), (F.col("event_id") % 97).alias("to_address"))


TX_SQL = "tx as (select event_id, user_id, ts, round(value * 10, 2) amount, event_id % 97 to_address from events)"


@query("aml1_velocity", "AML1", f"""with {TX_SQL},
 w as (select event_id, count(*) over h hc, sum(amount::DECIMAL(18,2)) over h hv, count(*) over d dc, sum(amount::DECIMAL(18,2)) over d dv from tx
  window h as (partition by user_id order by ts range between interval 1 hour preceding and current row), d as (partition by user_id order by ts range between interval 1 day preceding and current row))
select event_id, hc::DOUBLE hour_count, round(hv::DOUBLE, 4) hour_volume, dc::DOUBLE day_count, round(dv::DOUBLE, 4) day_volume,
 concat_ws(',', case when hc > 1 then 'hourly_count' end, case when hv > 1000 then 'hourly_volume' end, case when dc > 4 then 'daily_count' end, case when dv > 3000 then 'daily_volume' end) rules from w""")
def _(t):
    d = co.velocity(tx(t), "user_id", "ts", "event_id", "amount", SMALL)
    return d.select("event_id", "hour_count", F.round("hour_volume", 4).alias("hour_volume"), "day_count", F.round("day_volume", 4).alias("day_volume"), F.array_join("rules", ",").alias("rules"))


@query("aml2_amounts", "AML2", f"""with {TX_SQL},
 w as (select event_id, amount, sum(amount::DECIMAL(18,2)) over (partition by user_id order by ts range between interval 1 day preceding and current row) dv from tx)
select event_id, coalesce(case when amount >= 1500 then 'CRITICAL' when amount >= 800 then 'HIGH' end, 'none') single_severity, round(dv::DOUBLE, 4) total_24h, dv > 3000 cumulative_alert from w""")
def _(t):
    d = co.amount_rules(tx(t), "user_id", "ts", "event_id", "amount", SMALL)
    return d.select("event_id", F.coalesce("single_severity", F.lit("none")).alias("single_severity"), F.round("total_24h", 4).alias("total_24h"), "cumulative_alert")


@query("aml3_structuring", "AML3", f"""with {TX_SQL}, x as (select user_id, ts, floor(amount * 10) amount from tx),
 g as (select user_id, epoch_us(time_bucket(interval 1 hour, ts)) window_start, count(*) filter (amount >= 9000 and amount < 10000) near_threshold, count(*) filter (amount % 1000 = 0 and amount > 0) round_amounts from x group by all)
select * from g where near_threshold >= 1 or round_amounts >= 1""")
def _(t):
    x = tx(t).withColumn("amount", F.floor(F.col("amount") * 10).cast("double"))
    return co.structuring(x, "user_id", "ts", "amount", 10_000, SMALL).withColumn("window_start", micros("window_start"))


@query("aml4_geography", "AML4", """
with x as (select event_id, case event_id % 7 when 0 then 'IR' when 1 then 'DE' when 2 then 'SY' else 'US' end c, event_id % 2 = 0 cb, case event_id % 3 when 0 then 'tier_1' when 1 then 'tier_2' end kyc from events)
select event_id, concat_ws(',', case when c in ('IR', 'SY') then 'high_risk_country' end, case when cb and coalesce(kyc, 'unverified') in ('unverified', 'tier_1') then 'cross_border_kyc' end) rules from x
where c in ('IR', 'SY') or (cb and coalesce(kyc, 'unverified') in ('unverified', 'tier_1'))""")
def _(t):
    x = t.events.select("event_id", F.expr("case event_id % 7 when 0 then 'IR' when 1 then 'DE' when 2 then 'SY' else 'US' end").alias("c"),
                        F.expr("case event_id % 3 when 0 then 'tier_1' when 1 then 'tier_2' end").alias("kyc"))
    return co.geography(x, "c", F.col("event_id") % 2 == 0, "kyc").select("event_id", F.array_join("rules", ",").alias("rules"))


@query("aml5_counterparties", "AML5", f"""with {TX_SQL}
select user_id, epoch_us(date_trunc('day', ts)::TIMESTAMP) "day", count(distinct to_address) counterparties from tx group by all having count(distinct to_address) > 4""")
def _(t):
    return co.many_counterparties(tx(t), "user_id", "ts", "to_address", 4).withColumn("day", micros("day"))


@query("aml5_blacklist", "AML5", f"with {TX_SQL} select event_id, to_address from tx where to_address in (select s_suppkey from supplier where s_acctbal < 500)")
def _(t):
    return co.blacklisted(tx(t), "to_address", t.supplier.filter("s_acctbal < 500"), "s_suppkey").select("event_id", "to_address")


@query("aml6_timing", "AML6", f"""with {TX_SQL}, g as (select event_id, hour(ts) h, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) gap from tx)
select event_id, concat_ws(',', case when h <= 5 then 'unusual_hour' end, case when gap < 300000000 then 'rapid_succession' end, case when gap // 86400000000 > 2 then 'dormant_reactivated' end) rules from g""")
def _(t):
    return co.timing_rules(tx(t), "user_id", "ts", "event_id", SMALL).select("event_id", F.array_join("rules", ",").alias("rules"))


@query("aml7_user_summary", "AML7", f"""with {TX_SQL}, a as (select user_id, count(*) n, count(*) filter (amount > 1000) h from tx where amount > 500 group by 1)
select tx.user_id, count(*) transactions, epoch_us(max(ts)) last_activity, coalesce(any_value(n), 0) alerts, coalesce(any_value(h), 0) high_alerts from tx left join a on a.user_id = tx.user_id group by 1""")
def _(t):
    a = tx(t).filter("amount > 500").withColumn("severity", F.when(F.col("amount") > 1000, "HIGH").otherwise("LOW"))
    return co.user_summary(tx(t), a, "user_id", "ts").withColumn("last_activity", micros("last_activity"))


@query("aml8_composite_risk", "AML8", f"""
with x as (select event_id, case event_id % 3 when 0 then 'tier_1' when 1 then 'tier_2' end kyc, {SQL_K} / 100.0 an, case when event_id % 4 = 0 then ['mixer', 'scam'] else ['exchange'] end ex, value * 1000 am, event_id % 2 = 0 cb, case when event_id % 11 = 0 then 'KP' else 'US' end c from events)
select event_id, round(least(1, case when kyc is null then 0.3 when kyc = 'tier_1' then 0.1 else 0 end + an * 0.4 + case when event_id % 4 = 0 then 0.3 else 0 end + case when am > 100000 then 0.2 when am > 10000 then 0.1 else 0 end
 + case when cb then 0.1 else 0 end + case when c = 'KP' then 0.3 else 0 end), 6)::DOUBLE risk_score,
 concat_ws(',', case when kyc is null then 'unverified_identity' end, case when event_id % 4 = 0 then 'mixer,scam' end, case when am > 100000 then 'very_high_value' end, case when am > 10000 and am <= 100000 then 'high_value' end,
  case when cb then 'cross_border' end, case when c = 'KP' then 'high_risk_jurisdiction' end) risk_factors from x""")
def _(t):
    x = t.events.select("event_id", F.expr("case event_id % 3 when 0 then 'tier_1' when 1 then 'tier_2' end").alias("kyc"), (k_of(t.events) / 100.0).alias("an"),
                        F.expr("case when event_id % 4 = 0 then array('mixer', 'scam') else array('exchange') end").alias("ex"), (F.col("value") * 1000).alias("am"),
                        F.expr("case when event_id % 11 = 0 then 'KP' else 'US' end").alias("c"))
    d = co.composite_risk(x, "kyc", "an", "ex", "am", F.col("event_id") % 2 == 0, "c")
    return d.select("event_id", F.round(F.col("risk_score").cast("double"), 6).alias("risk_score"), F.array_join("risk_factors", ",").alias("risk_factors"))


@query("aml9_name_matching", "AML9", """
with w as (select s_suppkey watch_id, lower(replace(s_name, 'Supplier', 'Customer')) w from supplier), n as (select c_custkey id, lower(c_name) n from customer)
select id, watch_id, round(1 - levenshtein(n, w) / greatest(length(n), length(w))::DOUBLE, 6) similarity from n, w where 1 - levenshtein(n, w) / greatest(length(n), length(w))::DOUBLE >= 0.93""")
def _(t):
    w = t.supplier.withColumn("w", F.regexp_replace("s_name", "Supplier", "Customer"))
    return r6(co.match_names(t.customer, "c_custkey", "c_name", w, "s_suppkey", "w", 0.93), "similarity")


FRD1_SQL = """e as (select distinct event_type token, date_trunc('day', ts)::TIMESTAMP w, user_id a, (event_id * 7 + user_id) % (select max(user_id) + 1 from events) b from events),
 g as (select * from e where a <> b)"""


@query("frd1_wash_trading", "FRD1", f"""
with recursive {FRD1_SQL},
 r as (select token, w, a u, b v, b x from g union select r.token, r.w, r.u, r.v, g.b from r join g on g.token = r.token and g.w = r.w and g.a = r.x and g.b <> r.u)
select distinct r.token, epoch_us(r.w) window_start, r.u address from r join g on g.token = r.token and g.w = r.w and g.a = r.x and g.b = r.u where r.x <> r.v""")
def _(t):
    u, users = F.col("user_id"), t.events.agg(F.max("user_id") + 1).scalar()
    e = t.events.select(F.col("event_type").alias("token"), "ts", u.alias("a"), ((F.col("event_id") * 7 + u) % users).alias("b"))
    return co.trading_cycles(e, "token", "ts", "a", "b").withColumn("window_start", micros("window_start"))


@query("frd3_sybil_windows", "FRD3", """
select user_id % 5 address, epoch_us(time_bucket(interval 6 hour, ts)) window_start, count(*) events, count(distinct event_id % 97) counterparties from events group by all having count(*) > 15 and count(distinct event_id % 97) > 12""")
def _(t):
    e = t.events.select((F.col("user_id") % 5).alias("address"), "ts", (F.col("event_id") % 97).alias("o"))
    return co.sybil_windows(e, "address", "ts", "o", 15, 12, "6 hours").withColumn("window_start", micros("window_start"))


@query("frd5_alert_risk", "FRD5", f"""
with a as (select event_id, user_id, ts, {SQL_K} / 120.0 c from events),
 w as (select *, count(*) over (partition by user_id order by ts, event_id) n, count(*) over (partition by user_id order by ts range between interval 2 day preceding and current row) r from a),
 s as (select *, least(c * (1 + 0.1 * n) * case when r > 3 then 1.2 else 1 end, 1) risk from w)
select event_id, n alert_count, round(risk, 6)::DOUBLE risk_score, n > 5 and risk > 0.8 critical from s""")
def _(t):
    a = t.events.select("event_id", "user_id", "ts", (k_of(t.events) / 120.0).alias("c"))
    d = co.enriched_alert_risk(a, "user_id", "ts", "event_id", "c", 2 * 86_400)
    return d.select("event_id", "alert_count", F.round(F.col("risk_score").cast("double"), 6).alias("risk_score"), "critical")


@query("frd6_activity_indicators", "FRD6", """
with e as (select user_id % 5 g, epoch_us(time_bucket(interval 4 hour, ts)) window_start, ts, event_id, event_type from events),
 p as (select *, (epoch_us(ts) - epoch_us(lag(ts) over (partition by g, window_start order by ts))) / 1000.0 d from e),
 b as (select g, window_start, count(*) events, stddev_pop(d) sd from p group by all), k as (select g, window_start, count(*) filter (n > 10) repetitive from (select g, window_start, event_type, count(*) n from e group by all) group by all)
select g, window_start, events, events > 20 burst, coalesce(events > 5 and sd < 1000, false) automated, repetitive, round(least(1, case when events > 20 then 0.3 else 0 end + 0.2 * repetitive), 6)::DOUBLE fraud_score from b join k using (g, window_start)""")
def _(t):
    e = t.events.withColumn("g", F.col("user_id") % 5)
    d = co.activity_indicators(e, "g", "ts", "event_id", "event_type", "4 hours")
    return d.withColumns({"window_start": micros("window_start"), "fraud_score": F.round("fraud_score", 6)})


@query("frd7_risk_indicators", "FRD7", f"""
with x as (select event_id, event_type = 'purchase' p, value * 1000 a, {SQL_K} g from events)
select event_id, concat_ws(',', case when p and a > 10000 then 'high_value' end, case when p and a > 100000 then 'very_high_value' end, case when g < 7 then 'new_account' end, case when g > 90 then 'rapid_actions' end) indicators from x""")
def _(t):
    from marlstone.operators.cep import risk_indicators
    k = k_of(t.events)
    kind = F.when(F.col("event_type") == "purchase", "TRANSACTION").otherwise("X")
    return t.events.select("event_id", F.array_join(risk_indicators(kind, F.col("value") * 1000, k, F.when(k > 90, 11).otherwise(0)), ",").alias("indicators"))


# -- trust and marketplace ----------------------------------------------------------------------------------

@query("tru1_trust_scores", "TRU1", f"""
with recursive i as (select event_id, user_id, greatest(-1, least(1, case event_type when 'purchase' then 0.06 when 'signup' then 0.1 when 'error' then -0.2 when 'view' then 0.05 else 0 end * (1 + value / 100 * 0.5) * {SQL_K} / 100.0))::DOUBLE im,
  row_number() over (partition by user_id order by ts, event_id) rn from events),
 f as (select user_id, rn, event_id, 0.5::DOUBLE + 0.1 * case when im > 0 then im * 0.5 else im * 0.5 end x from i where rn = 1 union all
  select i.user_id, i.rn, i.event_id, f.x + 0.1::DOUBLE * case when i.im > 0 then i.im * (1 - f.x) else i.im * f.x end from f join i on i.user_id = f.user_id and i.rn = f.rn + 1)
select event_id, round(x::DOUBLE, 6) trust_score from f""")
def _(t):
    kind = F.element_at(F.create_map(*[F.lit(x) for p in (("purchase", "COLLABORATION_COMPLETED"), ("signup", "ASSET_VERIFIED"), ("error", "VERIFICATION_FAILED"), ("view", "ASSET_CREATED"), ("click", "X")) for x in p]), F.col("event_type"))
    e = t.events.withColumn("im", trust.trust_impact(kind, F.col("value") / 100, k_of(t.events) / 100.0))
    return trust.trust_scores(e, "user_id", "ts", "event_id", F.col("im"), chunk_rows=16, maps=2).select("event_id", F.round("trust_score", 6).alias("trust_score"))


DIM_SQL = f"""d as (select user_id, avg({SQL_K}) / 60 completeness, 0.8::DOUBLE accuracy, avg(value) / 60 consistency, 0.6::DOUBLE timeliness, 0.95::DOUBLE validity, max({SQL_K}) / 100.0 uniqueness, avg(value) / 100 trust from events group by 1)"""


def dims(t):
    k = k_of(t.events)
    return t.events.groupBy("user_id").agg((F.avg(k) / 60).alias("completeness"), F.lit(0.8).alias("accuracy"), (F.avg("value") / 60).alias("consistency"), F.lit(0.6).alias("timeliness"),
                                           F.lit(0.95).alias("validity"), (F.max(k) / 100.0).alias("uniqueness"), (F.avg("value") / 100).alias("trust"))


@query("mkt1_quality_score", "MKT1", f"with {DIM_SQL}, s as (select user_id, least(1, greatest(0, 0.2 * completeness + 0.2 * accuracy + 0.15 * (consistency + timeliness + validity + uniqueness))) o, trust from d) select user_id, round(o, 6) overall, round(o * trust, 6) trust_adjusted from s")
def _(t):
    return r6(trust.quality_score(dims(t), "trust").select("user_id", "overall", "trust_adjusted"), "overall", "trust_adjusted")


@query("mkt1_quality_issues", "MKT1", f"""with {DIM_SQL}, u as (select user_id, 'low_' || n issue, f - v gap from (select user_id, unnest(['completeness', 'accuracy', 'consistency', 'timeliness', 'validity', 'uniqueness']) n,
  unnest([completeness, accuracy, consistency, timeliness, validity, uniqueness]) v, unnest([0.8, 0.85, 0.8, 0.7, 0.9, 0.95]::DOUBLE[]) f from d))
select user_id, issue, case when gap > 0.3 then 'CRITICAL' when gap > 0.2 then 'HIGH' when gap > 0.1 then 'MEDIUM' else 'LOW' end severity from u where gap > 0""")
def _(t):
    return trust.quality_floor_issues(dims(t), ["user_id"])


@query("mkt2_access_tiers", "MKT2", f"""
with x as (select event_id, {SQL_K} / 100.0 t, case event_type when 'click' then 'sample' when 'view' then 'filtered' when 'purchase' then 'full' when 'error' then 'aggregated' else 'real_time' end lv from events),
 y as (select *, case when t >= 0.9 then 'platinum' when t >= 0.7 then 'gold' when t >= 0.5 then 'silver' else 'bronze' end tier, case when t >= 0.9 then 5 when t >= 0.7 then 4 when t >= 0.5 then 2 else 1 end b,
  case lv when 'sample' then 1 when 'filtered' then 2 when 'aggregated' then 3 when 'full' then 4 else 5 end q from x)
select event_id, tier, true granted, case least(b, q) when 1 then 'sample' when 2 then 'filtered' when 3 then 'aggregated' when 4 then 'full' else 'real_time' end granted_level from y""")
def _(t):
    lv = F.expr("case event_type when 'click' then 'sample' when 'view' then 'filtered' when 'purchase' then 'full' when 'error' then 'aggregated' else 'real_time' end")
    x = t.events.select("event_id", (k_of(t.events) / 100.0).cast("double").alias("t"), lv.alias("lv"))
    return trust.grant_access(x, "t", "lv").select("event_id", "tier", "granted", "granted_level")


@query("mkt3_dynamic_price", "MKT3", f"""
with x as (select event_id, {SQL_K} / 100.0 t, least(value / 100, 1) q, case when event_id % 2 = 0 then 'full' else 'filtered' end lv, event_id % 2000 v from events),
 y as (select *, case when lv = 'full' and t >= 0.7 then 200.0 when lv = 'filtered' and t >= 0.5 then 50.0 else 10.0 end p, case when lv = 'full' and t >= 0.7 then 1.0 when lv = 'filtered' and t >= 0.5 then 0.8 else 0.5 end m from x)
select event_id, p::DOUBLE base_price, round(p::DECIMAL(38,2) * (q * m)::DECIMAL(9,6) * (1 - least(t * 0.2, 0.15))::DECIMAL(7,6) * (1 - case when v > 1000 then 0.1 when v > 100 then 0.05 else 0 end)::DECIMAL(3,2), 2)::DOUBLE final_price from y""")
def _(t):
    x = t.events.select("event_id", (k_of(t.events) / 100.0).cast("double").alias("t"), F.least(F.col("value") / 100, F.lit(1.0)).alias("q"),
                        F.expr("case when event_id % 2 = 0 then 'full' else 'filtered' end").alias("lv"), (F.col("event_id") % 2000).alias("v"))
    d = trust.dynamic_price(x, "t", "q", "lv", "v")
    return d.select("event_id", F.col("base_price").cast("double").alias("base_price"), F.round("final_price", 2).cast("double").alias("final_price"))


@query("mkt4_quality_rollup", "MKT4", """
with l as (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 100)
select user_id, round(avg(value / 100), 6) average_quality, count(*) assessments, arg_max(value / 100, ts) >= 0.9 premium from l group by 1""")
def _(t):
    e = t.events.withColumn("q", F.col("value") / 100)
    return r6(trust.quality_rollup(e, "user_id", "ts", "event_id", "q"), "average_quality")


@query("mkt4_quality_improvements", "MKT4", "select event_id, p previous from (select *, lag(value) over (partition by user_id order by ts) p from events) where value > p * 1.2")
def _(t):
    return trust.quality_improvements(t.events, "user_id", "ts", "event_id", "value").select("event_id", "previous")


@query("mkt5_quality_trend", "MKT5", """
with r as (select user_id, value / 100 q, row_number() over (partition by user_id order by ts desc, event_id desc) n from events), g as (select user_id, coalesce(avg(q) filter (n <= 5) - avg(q) filter (n between 6 and 10), 0) c from r where n <= 10 group by 1)
select user_id, round(c, 6) change, case when c > 0.05 then 'improving' when c < -0.05 then 'declining' else 'stable' end trend from g""")
def _(t):
    e = t.events.withColumn("q", F.col("value") / 100)
    return r6(trust.quality_trend(e, "user_id", "ts", "event_id", "q"), "change")


@query("gra25_network_bonus", "GRA25", """
with e as (select user_id a, event_id % 150 b from events where event_type = 'purchase'), u as (select a u, b o from e union all select b, a from e)
select u "user", count(distinct o) connections, least(count(distinct o) * 0.02, 0.5)::DOUBLE bonus from u group by 1""")
def _(t):
    e = t.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("a"), (F.col("event_id") % 150).alias("b"))
    return trust.network_bonus(e, "a", "b")


@query("gra26_credential_scores", "GRA26", f"""
with c as (select user_id, event_type, ts, coalesce(least(value * 5 / 100, 5), 1) * 1 * {SQL_K} / 100.0 * case when event_id % 3 = 0 then 1.5 else 1 end v from events)
select user_id, round(least(sum(v * case event_type when 'purchase' then 2.0 when 'signup' then 1.0 else 0.0 end) * power(0.95, avg(date_diff('day', ts, TIMESTAMP '{EVENTS_NOW}') / 30.0)), 100), 6)::DOUBLE trust_score from c group by 1""")
def _(t):
    v = trust.credential_value(F.col("value") * 5, F.lit(1), k_of(t.events), F.col("event_id") % 3 == 0)
    return r6(trust.credential_scores(t.events, "user_id", "event_type", v, "ts", events_now(), {"purchase": 2.0, "signup": 1.0}), "trust_score")


# -- service levels and operations --------------------------------------------------------------------------

def metrics(t):
    k = k_of(t.events)
    return t.events.select("event_id", "user_id", "ts", (100 - F.col("value") * F.pi() / 30).alias("uptime"), (k * 2.5).cast("double").alias("latency"), (1 - k / 150.0).cast("double").alias("performance"),
                           (F.col("value") / 20).alias("throughput"), (k / 5000.0).cast("double").alias("error_rate"))


MET_SQL = f"met as (select event_id, user_id, ts, 100 - value * pi() / 30 uptime, ({SQL_K} * 2.5)::DOUBLE latency, (1 - {SQL_K} / 150.0)::DOUBLE performance, value / 20 throughput, ({SQL_K} / 5000.0)::DOUBLE error_rate from events)"


@query("sla1_violations", "SLA1", f"""with {MET_SQL}
select event_id, 'uptime' violation_type, 99.9::DOUBLE expected, round(uptime, 6) actual, uptime < 90 critical from met where uptime < 99.9 union all select event_id, 'latency', 50, round(latency, 6), latency > 200 from met where latency > 50
union all select event_id, 'performance', 0.95, round(performance, 6), performance < 0.5 from met where performance < 0.95 union all select event_id, 'throughput', 1, round(throughput, 6), false from met where throughput < 1
union all select event_id, 'error_rate', 0.01, round(error_rate, 6), false from met where error_rate > 0.01""")
def _(t):
    return r6(op.sla_violations(metrics(t), ["event_id"]), "actual")


@query("sla2_failover", "SLA2", f"""with {MET_SQL}, v as (select *, (uptime < 99.9)::INTEGER + (latency > 50)::INTEGER + (performance < 0.95)::INTEGER + (throughput < 1)::INTEGER + (error_rate > 0.01)::INTEGER c from met),
 r as (select *, sum(c) over w::BIGINT tv, count(*) over w n, avg(uptime) over w m from v window w as (partition by user_id order by ts, event_id))
select event_id, tv total_violations, round(m, 6) average_uptime, coalesce(case when uptime < 90 or latency > 200 or performance < 0.5 then 'critical' when tv >= 5 then 'too_many' when m < 95 and n > 10 then 'poor_uptime' when m = 0 and n > 3 then 'down' end, 'none') reason from r""".replace("sum(c) over w::BIGINT", "(sum(c) over w)::BIGINT"))
def _(t):
    d = op.failover(metrics(t), "user_id", "ts", "event_id")
    return d.select("event_id", "total_violations", F.round("average_uptime", 6).alias("average_uptime"), F.coalesce("reason", F.lit("none")).alias("reason"))


@query("sla3_timeouts", "SLA3", f"""with g as (select user_id, ts, lead(ts) over (partition by user_id order by ts) nx from events), h as (select *, (epoch_us(coalesce(nx, TIMESTAMP '{EVENTS_NOW}')) - epoch_us(ts)) / 1e6 s from g)
select user_id, epoch_us(ts) last_metrics, round(s, 6) silent_seconds, nx is null still_silent from h where s > 86400""")
def _(t):
    d = op.metrics_timeouts(t.events, "user_id", "ts", "event_id", 86_400, events_now())
    return d.withColumns({"last_metrics": micros("last_metrics"), "silent_seconds": F.round("silent_seconds", 6)})


@query("sla4_penalties", "SLA4", f"""with {MET_SQL}, v as (select user_id, (uptime < 99.9)::INTEGER + (latency > 50)::INTEGER + (performance < 0.95)::INTEGER + (throughput < 1)::INTEGER + (error_rate > 0.01)::INTEGER c,
  (uptime < 90)::INTEGER + (latency > 200)::INTEGER + (performance < 0.5)::INTEGER k from met), g as (select user_id, sum(c)::BIGINT violations, sum(k)::BIGINT critical_violations from v group by 1)
select c_custkey user_id, coalesce(violations, 0) violations, coalesce(critical_violations, 0) critical_violations, round(c_acctbal * pi() * least(1, 0.001 * (coalesce(violations, 0) - coalesce(critical_violations, 0)) + 0.01 * coalesce(critical_violations, 0)), 4) penalty
from customer left join g on g.user_id = c_custkey""")
def _(t):
    v = op.sla_violations(metrics(t), ["user_id"])
    s = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") * F.pi()).alias("value"))
    return r6(op.penalties(v, s, "user_id", 0.001, 0.01).drop("value"), "penalty", places=4)


@query("sla4_settlement_states", "SLA4", f"""
with s as (select event_id, ts d, {SQL_K} h from events) select case when TIMESTAMP '2024-01-20' < d then 'provisioning' when epoch_us(TIMESTAMP '2024-01-20') < epoch_us(d) + h * 3600000000 then 'active' else 'completed' end state, count(*) n from s group by 1""")
def _(t):
    s = t.events.select("event_id", F.col("ts").alias("delivery_start"), k_of(t.events).alias("duration_hours"))
    return op.settlement_states(s, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).groupBy("state").agg(n_rows().alias("n"))


@query("sla5_regional_quality", "SLA5", f"""with {MET_SQL} select user_id % 5 region, epoch_us(time_bucket(interval 1 hour, ts)) window_start, count(*) n, round(avg(uptime), 6) uptime, round(avg(latency * pi()), 6) latency, round(avg(performance), 6) performance from met group by all""")
def _(t):
    m = metrics(t).withColumns({"region": F.col("user_id") % 5, "latency": F.col("latency") * F.pi()})
    d = op.regional_quality(m, "region", "ts").withColumn("window_start", micros("window_start"))
    return r6(d, "uptime", "latency", "performance")


@query("dead_letter_report", "OPS1", f"""
with m as (select event_type topic, ts, case {SQL_K} % 6 when 0 then 'Request TIMEOUT after 5s' when 1 then 'json parse failed' when 2 then 'forbidden' when 3 then 'db down' when 4 then '' else 'mystery' end r, {SQL_K} % 13 dc from events),
 c as (select *, case when r = '' then 'unknown' when r like '%TIMEOUT%' then 'timeout' when r like 'json%' then 'serialization' when r = 'forbidden' then 'authorization' when r = 'db down' then 'database' else 'other' end category from m),
 s as (select *, case when dc > 10 then 'manual' when category = 'timeout' then 'retry' when category = 'serialization' then case when dc > 3 then 'skip' else 'retry' end when category = 'authorization' then 'manual' when dc <= 3 then 'retry' else 'manual' end strategy,
  (epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(ts)) / 1e6 age from c)
select topic, category, strategy, count(*) messages, round(max(age), 6) oldest_seconds, round(min(age), 6) newest_seconds, round(avg(dc), 6) mean_deliveries from s group by all""")
def _(t):
    k = k_of(t.events)
    reasons = F.element_at(F.array(*[F.lit(x) for x in ("Request TIMEOUT after 5s", "json parse failed", "forbidden", "db down", "", "mystery")]), k % 6 + 1)
    d = op.dead_letters(t.events.withColumnRenamed("event_type", "topic"), "topic", "ts", reasons, k % 13, events_now())
    return r6(d, "oldest_seconds", "newest_seconds", "mean_deliveries")


@query("catalog_classification", "OPS2", """
select case when regexp_matches(lower(text), 'email|ssn|phone|address|credit_card|passport') then 'pii' when regexp_matches(lower(text), 'patient|medical|health|diagnosis|prescription') then 'phi'
 when regexp_matches(lower(text), 'salary|revenue|profit|financial|strategic') then 'confidential' when source = 'src3' then 'phi' else 'internal' end kind, count(*) n from documents group by 1""")
def _(t):
    tags = F.when(F.col("source") == "src3", F.array(F.lit("medical"))).otherwise(F.array().cast("array<string>"))
    return t.documents.groupBy(op.classify_asset(F.lit(""), F.col("text"), tags).alias("kind")).agg(n_rows().alias("n"))


@query("asset_usage_report", "OPS3", f"""
select event_type asset, count(*) accesses, count(*) filter (ts >= TIMESTAMP '{EVENTS_NOW}' - interval 7 day) recent_accesses, count(distinct user_id) users, epoch_us(max(ts)) last_access from events group by 1""")
def _(t):
    return op.asset_usage(t.events.withColumnRenamed("event_type", "asset"), "asset", "user_id", "ts", events_now(), 7).withColumn("last_access", micros("last_access"))


@query("access_decisions", "OPS4", """
with q as (select event_id request_id, user_id, case when user_id % 4 = 0 then 'analysts' else 'guests' end grp, 'lake/' || event_type || '/' || (event_id % 3)::VARCHAR res, case when event_id % 2 = 0 then 'read' else 'write' end act from events),
 r(rule_id, principal, resource, is_prefix, act, effect) as (values (1, 'analysts', 'lake', true, 'read', 'allow'), (2, '*', 'lake/view', true, 'read', 'allow'), (3, '7', 'lake/click/1', false, 'write', 'allow'), (4, 'guests', 'lake/error', true, 'read', 'deny')),
 h as (select request_id, count(distinct rule_id) n, bool_or(effect = 'allow') a from q join r on r.act = q.act and (principal = grp or principal = '*' or principal = user_id::VARCHAR) and (res = resource or (is_prefix and starts_with(res, resource || '/'))) group by 1)
select q.request_id, case when a then 'allow' else 'deny' end decision, coalesce(n, 0) applicable_rules from q left join h using (request_id)""")
def _(t):
    q = t.events.select(F.col("event_id").alias("request_id"), "user_id", F.array(F.when(F.col("user_id") % 4 == 0, "analysts").otherwise("guests")).alias("groups"),
                        F.concat(F.lit("lake/"), "event_type", F.lit("/"), (F.col("event_id") % 3).cast("string")).alias("resource_id"),
                        F.when(F.col("event_id") % 2 == 0, "read").otherwise("write").alias("action"))
    rules = t.spark.createDataFrame([(1, "analysts", "lake", True, "read", "allow"), (2, "*", "lake/view", True, "read", "allow"), (3, "7", "lake/click/1", False, "write", "allow"),
                                     (4, "guests", "lake/error", True, "read", "deny")], "rule_id int, principal string, resource string, is_prefix boolean, action string, effect string")
    return op.evaluate_access(q, rules).select("request_id", "decision", "applicable_rules")


@query("privacy_levels", "OPS5", """
select c_custkey, '***MASKED***' masked, 'enc:' || sha256(c_mktsegment) encrypted, 'tok_' || sha256(c_name) tokenized from customer""")
def _(t):
    c = t.customer.select("c_custkey", F.col("c_name").alias("masked"), F.col("c_mktsegment").alias("encrypted"), F.col("c_name").alias("tokenized"))
    c = op.apply_privacy(c, "internal", {"email": "masked"})
    c = op.apply_privacy(c, "confidential", {"address": "encrypted"})
    return op.apply_privacy(c, "restricted", {"name": "tokenized"})


@query("query_log_report", "OPS6", f"""
select event_type source, count(*) queries, round(avg(value * 100), 6) mean_millis, max(value * 100) max_millis, count(*) filter (value * 100 > 5000) slow, round(avg(({SQL_K} < 30)::INTEGER), 6) cache_hit_rate, count(*) filter ({SQL_K} > 95) failed from events group by 1""")
def _(t):
    k = k_of(t.events)
    d = t.events.select(F.col("event_type").alias("source"), (F.col("value") * 100).alias("ms"), (k < 30).alias("c"), (k > 95).alias("f"))
    return r6(op.query_log_report(d, "source", "ms", F.col("c"), F.col("f")), "mean_millis", "cache_hit_rate")
