"""Time-series queries."""

from pyspark.sql import functions as F

from marlstone.functions.columns import micros
from marlstone.operators import timeseries as ts
from marlstone.plans.derived import events_now, DAILY_SQL, EVENTS_NOW, HOURLY_SQL, SQL_K, daily, hourly, k_of
from marlstone.plans.registry import query

SERIES = ["click", "view", "purchase", "signup", "error"]


def r6(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


GRID_SQL = """m as (select user_id % 20 g, date_trunc('hour', ts)::TIMESTAMP h, avg(value) * pi() / 3 v from events group by all),
 s as (select g, unnest(generate_series(min(h), max(h), interval 1 hour)) h from m group by g),
 j as (select s.g, s.h, epoch_us(s.h) us, v from s left join m on m.g = s.g and m.h = s.h),
 n as (select *, last_value(v ignore nulls) over a pv, last_value(case when v is not null then us end ignore nulls) over a pt,
  last_value(v ignore nulls) over b nv, last_value(case when v is not null then us end ignore nulls) over b nt from j window a as (partition by g order by us), b as (partition by g order by us desc)),
 grid as (select g, h, us, coalesce(v, pv + (nv - pv) * (us - pt) / nullif((nt - pt)::DOUBLE, 0)) v from n)"""


def grid(t):
    e = t.events.select((F.col("user_id") % 20).alias("g"), "ts", (F.col("value") * F.pi() / 3).alias("v"))
    return ts.resample(e, ["g"], "ts", "v")


@query("ts1_resample", "TS1", f"with {GRID_SQL} select g, us, round(v, 6) v from grid")
def _(t):
    return grid(t).select("g", micros("ts").alias("us"), F.round("v", 6).alias("v"))


TREND_SQL = """i as (select *, row_number() over (partition by series order by "day") - 1 i from daily)"""


@query("ts2_linear_trend", "TS2 TS3", f"""with {DAILY_SQL}, {TREND_SQL}
select series, round(regr_slope(x, i), 6) slope, round(regr_intercept(x, i), 6) intercept, round(regr_r2(x, i), 6) r_squared, round(regr_slope(ln(x), i), 6) exponential_rate,
 case when regr_slope(x, i) < 0 then 'decreasing' when regr_slope(x, i) > 0 then 'increasing' else 'flat' end trend_direction,
 case when regr_r2(x, i) > 0.7 then 'strong' when regr_r2(x, i) > 0.3 then 'moderate' else 'weak' end trend_strength, round(regr_slope(x, i) / avg(x), 6) change_rate, count(*) points from i group by 1""")
def _(t):
    d = ts.linear_trend(daily(t), ["series"], "day", [], "x").drop("mean", "std", "min", "max")
    return r6(d, "slope", "intercept", "r_squared", "exponential_rate", "change_rate")


@query("ts4_zscore_anomalies", "TS4", """
with s as (select event_type, avg(value) m, stddev_pop(value) d from events group by 1)
select event_id, round(abs(value - m) / d, 6) z_score, round(m - 3 * d, 6) expected_low, round(m + 3 * d, 6) expected_high from events join s using (event_type) where abs(value - m) / d > 3""")
def _(t):
    d = ts.zscore_anomalies(t.events, ["event_type"], "value")
    return r6(d.select("event_id", "z_score", "expected_low", "expected_high"), "z_score", "expected_low", "expected_high")


@query("ts5_mean_shift_points", "TS5", """
with e as (select user_id, event_id, value * pi() / 3 v, row_number() over w - 1 n1, coalesce(sum(value * pi() / 3) over (w rows between unbounded preceding and 1 preceding), 0) s1,
  coalesce(sum(power(value * pi() / 3, 2)) over (w rows between unbounded preceding and 1 preceding), 0) q1, count(*) over p n, sum(value * pi() / 3) over p s, sum(power(value * pi() / 3, 2)) over p q
  from events window w as (partition by user_id order by ts, event_id), p as (partition by user_id)),
 c as (select *, s1 / nullif(n1, 0) m1, (s - s1) / (n - n1) m2 from e),
 d as (select *, (m1 - m2) / sqrt(((q1 - n1 * m1 * m1) + (q - q1 - (n - n1) * m2 * m2)) / (n - 2) * (1.0 / n1 + 1.0 / (n - n1))) t from c where n1 >= 10 and n1 < n - 10 and n > 20)
select user_id, n1 "index", round(m1, 6) before_mean, round(m2, 6) after_mean from d where abs(t) > 2.576""")
def _(t):
    e = t.events.withColumn("v", F.col("value") * F.pi() / 3)
    d = ts.mean_shift_points(e, ["user_id"], "ts", ["event_id"], "v")
    return r6(d.select("user_id", "index", "before_mean", "after_mean"), "before_mean", "after_mean")


@query("ts6_local_shifts", "TS6", f"""with {HOURLY_SQL},
 w as (select market, epoch_us(ts) us, avg(price) over (x rows between 10 preceding and 1 preceding) b, avg(price) over (x rows between current row and 9 following) a from hourly window x as (partition by market order by ts))
select market, us, round(b, 6) before_mean, round(a, 6) after_mean, round(abs(a - b), 6) magnitude, case when a < b * 0.5 then 'improvement' when a > b * 1.5 then 'degradation' else 'shift' end change_type from w where b is not null""")
def _(t):
    d = ts.local_shifts(hourly(t), ["market"], "ts", [], "price")
    return r6(d.select("market", micros("ts").alias("us"), "before_mean", "after_mean", "magnitude", "change_type"), "before_mean", "after_mean", "magnitude")


@query("ts7_seasonality", "TS7", f"""with {GRID_SQL},
 t as (select *, row_number() over w - 1 i, (sum(v) over (w rows between 11 preceding and 11 following) + 0.5 * (lag(v, 12) over w + lead(v, 12) over w)) / 24 tr, count(v) over (w rows between 12 preceding and 12 following) c from grid window w as (partition by g order by us)),
 o as (select *, i % 24 ph, case when c = 25 then v - tr end off from t), p as (select g, ph, avg(off) m from o group by all), q as (select g, avg(m) c from p group by 1),
 z as (select o.g, off, p.m - q.c se from o join p on p.g = o.g and p.ph = o.ph join q on q.g = o.g)
select g, round(stddev(se), 6) seasonal_amplitude, round(stddev(se) / stddev(off - se), 6) seasonality_strength, stddev(se) / stddev(off - se) > 0.5 has_seasonality, count(*) points from z group by g""")
def _(t):
    return r6(ts.seasonality(grid(t), ["g"], "ts", "v"), "seasonal_amplitude", "seasonality_strength")


@query("ts8_dominant_period", "TS8", f"""with {DAILY_SQL}, i as (select *, row_number() over (partition by series order by "day") - 1 i, x - avg(x) over (partition by series) d from daily),
 p as (select unnest([2, 3, 5, 7, 10, 14])::INTEGER period), s as (select series, period, sqrt(power(sum(d * cos(2 * pi() / period * i)), 2) + power(sum(d * sin(2 * pi() / period * i)), 2)) st from i, p group by all)
select series, period, round(st, 6) strength from s qualify row_number() over (partition by series order by st desc, period) <= 2""")
def _(t):
    return r6(ts.dominant_period(daily(t), ["series"], "day", [], "x", [2, 3, 5, 7, 10, 14], 2), "strength")


CONV_SQL = f"""{DAILY_SQL}, w as (select *, lag(x) over z p, lag(x, 2) over z p2, row_number() over z - 1 i from daily window z as (partition by series order by "day")),
 r as (select *, case when p > 0 then (p - x) / p end rate, x - p d1, p - p2 d0 from w),
 k as (select *, row_number() over (partition by series order by "day") k, count(*) over (partition by series) m from r where rate is not null),
 a as (select series, avg(rate) average_rate, stddev_pop(rate) rate_std, min(rate) min_rate, max(rate) max_rate, avg(rate) filter (k <= 5) h, avg(rate) filter (k > m - 5) tl, max(m) m from k group by 1),
 b as (select series, count(*) filter (sign(d1) <> sign(d0)) turns, count(d1) diffs, regr_slope(x, i) slope, regr_slope(ln(x), i) er, count(*) n from r group by 1),
 c as (select *, case when n < 5 then 'unknown' when er < -0.1 then 'exponential' when slope < 0 and rate_std < 0.1 then 'linear' when turns > diffs * 0.3 then 'oscillatory' when average_rate < 0.01 then 'stagnant' when slope > 0 then 'diverging' else 'irregular' end pattern from a join b using (series))"""


@query("ts9_convergence", "TS9", f"""with {CONV_SQL}
select series, round(average_rate, 6) average_rate, round(rate_std, 6) rate_std, round(min_rate, 6) min_rate, round(max_rate, 6) max_rate, round(er, 6) exponential_rate, m > 10 and tl > h is_accelerating,
 case when tl > average_rate then 'improving' else 'worsening' end rate_trend, pattern from c""")
def _(t):
    d = ts.convergence(daily(t), ["series"], "day", [], "x").drop("slope")
    return r6(d, "average_rate", "rate_std", "min_rate", "max_rate", "exponential_rate")


@query("ts10_compare_series", "TS10", f"with {CONV_SQL} select pattern, count(*) series, (select arg_max(series, average_rate) from c) best, (select arg_min(series, average_rate) from c) worst from c group by 1")
def _(t):
    return ts.compare_series(ts.convergence(daily(t), ["series"], "day", [], "x"), "series")


@query("ts11_damped_forecast", "TS11 SRC12")
def _(t):
    return r6(ts.damped_forecast(daily(t), "series", "day", "x"), "forecast", "lower", "upper")


@query("ts12_stationarity", "TS12", f"""with {DAILY_SQL}, w as (select *, lag(x) over (partition by series order by "day") p from daily), r as (select series, x - p y, p from w where p is not null),
 s as (select series, regr_slope(y, p) g, regr_sxx(y, p) sxx, regr_syy(y, p) syy, regr_sxy(y, p) sxy, count(*) n from r group by 1),
 f as (select series, g / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) st, n from s)
select series, round(st, 5) statistic, st < -2.86 is_stationary, n points from f""")
def _(t):
    return r6(ts.stationarity(daily(t), ["series"], "day", [], "x"), "statistic", places=5)


@query("ts13_running_zscores", "TS13", """
with h as (select event_id, event_type, value, count(*) over w n, avg(value) over w m, stddev_pop(value) over w s from events window w as (partition by event_type order by ts, event_id rows between unbounded preceding and 1 preceding))
select event_id, round(abs(value - m) / (s + 1e-6), 5) z_score, round(m - 3 * s, 5) expected_low, round(m + 3 * s, 5) expected_high from h where n > 10 and abs(value - m) / (s + 1e-6) > 3""")
def _(t):
    d = ts.running_zscores(t.events, ["event_type"], "ts", ["event_id"], "value")
    return r6(d.select("event_id", "z_score", "expected_low", "expected_high"), "z_score", "expected_low", "expected_high", places=5)


@query("ts15_confidence_anomalies", "TS15", """
with h as (select event_id, value, count(*) over w n, avg(value) over w m, stddev_pop(value) over w s from events window w as (partition by event_type order by ts, event_id rows between 300 preceding and 1 preceding))
select event_id, round(m, 5) expected, round(abs(value - m) / s, 5) z_score from h where n > 50 and abs(value - m) / s > 3""")
def _(t):
    d = ts.confidence_anomalies(t.events, ["event_type"], "ts", ["event_id"], "value", 300)
    return r6(d.select("event_id", "expected", "z_score"), "expected", "z_score", places=5)


@query("ts16_granger", "TS16")
def _(t):
    return r6(ts.granger(hourly(t), "market", "ts", "price", SERIES), "f_statistic")


@query("ts17_partial_correlations", "TS17", """
with b as (select date_trunc('hour', ts)::TIMESTAMP h, avg(value) filter (event_type = 'click') * pi() / 3 c, avg(value) filter (event_type = 'view') * pi() / 3 v from events group by 1),
 l as (select *, lag(c) over w c1, lag(v) over w v1 from b window w as (order by h)), f as (select * from l where c is not null and v is not null and c1 is not null and v1 is not null),
 r as (select count(*) n, corr(v, c1) a, corr(v, v1) b, corr(c1, v1) d, corr(c, v1) e, corr(c, c1) g, corr(v1, c1) k from f),
 p as (select 'click' cause, 'view' effect, (a - b * d) / sqrt((1 - b * b) * (1 - d * d)) s, n from r union all select 'view', 'click', (e - g * k) / sqrt((1 - g * g) * (1 - k * k)), n from r)
select cause, effect, 1 lag, round(s, 6) strength, abs(0.5 * ln((1 + s) / (1 - s)) * sqrt(n - 4)) > 1.96 significant from p""")
def _(t):
    return r6(ts.lagged_partial_correlations(hourly(t), "market", "ts", "price", ["click", "view"], 1), "strength")


USER_DAYS_SQL = """b as (select user_id e, date_trunc('day', ts)::TIMESTAMP d, avg(value) * pi() / 3 x from events group by all), o as (select d, row_number() over (order by d) t from (select distinct d from b)),
 l as (select a.e, o.t, a.x, p.x x1 from b a join o using (d) join (select b.e, o.t, b.x from b join o using (d)) p on p.e = a.e and p.t = o.t - 1),
 r as (select c.e cause, y.e effect, count(*) n, corr(y.x, c.x1) a, corr(y.x, y.x1) b, corr(c.x1, y.x1) g from l c join l y on c.t = y.t and c.e <> y.e group by all),
 p as (select cause, effect, n, (a - b * g) / sqrt((1 - b * b) * (1 - g * g)) s from r where n > 4)"""


def user_days(t):
    return t.events.select("user_id", F.date_trunc("day", "ts").alias("day"), (F.col("value") * F.pi() / 3).alias("x"))


@query("ts16_user_causes", "TS16", f"""with {USER_DAYS_SQL}, f as (select cause, effect, n, s * s / (1 - s * s) * (n - 3) f from p where abs(s) < 1)
select cause, effect, 1 lag, round(f, 5) f_statistic, true significant, n points from f where f > 3.84""")
def _(t):
    return r6(ts.granger(user_days(t), "user_id", "day", "x", max_lag=1, significant_only=True), "f_statistic", places=5)


@query("ts17_user_edges", "TS17", f"""with {USER_DAYS_SQL} select cause, effect, 1 lag, round(s, 6) strength, true significant from p where abs(0.5 * ln((1 + s) / (1 - s)) * sqrt(n - 4)) > 1.96""")
def _(t):
    return r6(ts.lagged_partial_correlations(user_days(t), "user_id", "day", "x", max_lag=1, significant_only=True), "strength")


@query("ts18_failure_indicators", "TS18", f"""
with k as (select user_id, ts, event_id, value, case when event_type = 'error' then 'error' when event_type = 'view' then 'performance' end kind from events),
 e as (select user_id, count(*) filter (kind = 'error' and ts > TIMESTAMP '{EVENTS_NOW}' - interval 7 day) / 7.0 er from k group by 1),
 h as (select user_id, avg(value) f from (select * from k where kind = 'performance' qualify row_number() over (partition by user_id order by ts, event_id) <= 10) group by 1),
 l as (select user_id, avg(value) z from (select * from k where kind = 'performance' qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 10) group by 1),
 d as (select user_id, er, case when f > 0 then 1 - z / f else 0 end pd from e left join h using (user_id) left join l using (user_id)),
 p as (select *, 0.01 * case when er > 10 then 5 when er > 5 then 2 else 1 end * case when pd > 0.3 then 3 when pd > 0.1 then 1.5 else 1 end b from d)
select user_id, round(er, 6)::DOUBLE error_rate, round(pd, 6) performance_degradation, round(1 - power(1 - b, 3), 6) failure_probability from p""")
def _(t):
    k = t.events.withColumn("kind", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "performance"))
    d = ts.failure_indicators(k, "user_id", "ts", "event_id", "kind", "value", events_now())
    d = d.withColumn("failure_probability", ts.failure_probability(F.col("error_rate"), F.col("performance_degradation"), 72))
    return r6(d, "error_rate", "performance_degradation", "failure_probability")


HEALTH_SQL = f"""c as (select user_id, avg(value) / 100 f, min({SQL_K}) / 100.0 e, max(value) > 200 a from events group by 1),
 h as (select user_id, f, greatest(0, least(100, 100 - case when a then 20 else 0 end - f * 50 - case when e < 0.007 then 15 else 0 end)) health,
  case when f > 0.8 then 'critical' when f > 0.5 then 'high' when f > 0.3 then 'medium' when f > 0.1 then 'low' else 'none' end urgency from c)"""


def components(t):
    c = t.events.groupBy("user_id").agg((F.avg("value") / 100).alias("failure_probability"), (F.min(k_of(t.events)) / 100.0).alias("e"), (F.max("value") > 200).alias("a"))
    low = F.when(F.col("e") < 0.007, F.lit(0.5)).otherwise(F.lit(0.9))
    return c.select("user_id", "failure_probability", ts.health_score(F.col("a"), F.col("failure_probability"), low).alias("health"),
                    ts.urgency(F.col("failure_probability")).alias("urgency"))


@query("ts19_health_scores", "TS19", f"with {HEALTH_SQL} select user_id, round(f, 6) failure_probability, round(health, 6)::DOUBLE health, urgency from h")
def _(t):
    return r6(components(t), "failure_probability", "health")


@query("ts19_fleet_health", "TS19", f"""with {HEALTH_SQL}, s as (select count(*) components, avg(health) m, count(*) filter (f > 0.5) at_risk, count(*) filter (urgency = 'critical') c, count(*) filter (urgency = 'high') g from h)
select components, round(m, 6) mean_health, at_risk, c + g backlog, case when c > 0 or m < 50 then 'critical' when g > 2 or m < 70 then 'warning' else 'healthy' end fleet_status from s""")
def _(t):
    return r6(ts.fleet_health(components(t)).drop("critical", "high"), "mean_health")


@query("ts20_feature_importance", "TS20", """
with s as (select avg(l_quantity) a, stddev_pop(l_quantity) b, avg(l_extendedprice) c, stddev_pop(l_extendedprice) d from lineitem),
 z as (select l_orderkey, l_linenumber, l_partkey, abs(l_quantity - a) / b x, abs(l_extendedprice - c) / d y from lineitem, s)
select l_orderkey * 10 + l_linenumber id, 'l_quantity' feature, round(x, 6) z, round(x / (x + y), 6) importance from z union all select l_orderkey * 10 + l_linenumber, 'l_extendedprice', round(y, 6), round(y / (x + y), 6) from z""")
def _(t):
    cur = t.lineitem.withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return r6(ts.feature_importance(cur, t.lineitem, "id", ["l_quantity", "l_extendedprice"]), "z", "importance")


@query("ts21_risk_profiles", "TS21", """
with d as (select user_id, date_trunc('day', ts) d, count(*) n, avg(least(value / 150, 1)) a, max(least(value / 150, 1)) m, count(distinct event_type) p from events where event_type <> 'view' group by all),
 i as (select *, row_number() over (partition by user_id order by d) - 1 i from d),
 o as (select user_id, sum(n)::BIGINT alerts, avg(a) av, max(m) mx, max(p) patterns, regr_slope(n, i) sl from i group by 1)
select user_id, alerts, round(av, 6) avg_risk, round(mx, 6) max_risk, patterns, case when mx > 0.8 or alerts > 50 then 'CRITICAL' when av > 0.6 or alerts > 20 then 'HIGH' when av > 0.4 or alerts > 10 then 'MEDIUM' else 'LOW' end risk_level,
 round(sl, 6) daily_slope from o""")
def _(t):
    a = t.events.filter("event_type <> 'view'").withColumn("risk", F.least(F.col("value") / 150, F.lit(1.0)))
    return r6(ts.risk_profiles(a, "user_id", "ts", "risk", "event_type"), "avg_risk", "max_risk", "daily_slope")


@query("ts22_resource_anomalies", "TS22", f"""
with m as (select event_id, {SQL_K}::DOUBLE cpu, least(value, 100) mem, 100.0 req, {SQL_K} / 10.0 err, value * 12 p99 from events)
select event_id, 'high_cpu' anomaly_type, round(least(1, (cpu - 80) / 20), 6) severity, round(cpu, 6) "value" from m where cpu > 80
union all select event_id, 'high_memory', round(least(1, (mem - 85) / 15), 6), round(mem, 6) from m where mem > 85
union all select event_id, 'high_error_rate', round(least(1, err / req * 10), 6), round(err, 6) from m where err / req > 0.05
union all select event_id, 'slow_response', round(least(1, (p99 - 1000) / 4000), 6), round(p99, 6) from m where p99 > 1000""")
def _(t):
    k = k_of(t.events)
    d = ts.resource_anomalies(t.events, ["event_id"], k.cast("double"), F.least(F.col("value"), F.lit(100.0)), F.lit(100.0), k / 10.0, F.col("value") * 12)
    return r6(d, "severity", "value")
