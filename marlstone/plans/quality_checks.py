"""Profiles, rules, baselines, drift and remediation."""

from pyspark.sql import functions as F

from marlstone.functions.columns import micros
from marlstone.operators import folds, lake
from marlstone.operators import quality as q
from marlstone.plans.derived import n_rows, events_now, DAILY_SQL, EVENTS_NOW, SQL_K, daily, k_of
from marlstone.plans.registry import query



def r6(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("dq1_dataset_profile", "DQ1", """
with d as (select l_orderkey, l_linenumber, case when l_discount > 0.05 then l_tax end t from lineitem), g as (select *, count(*) c from d group by all)
select sum(c)::BIGINT row_count, 3 column_count, round(100.0 * sum(c) filter (t is null) / (sum(c) * 3), 6) null_percentage, sum(c - 1)::BIGINT duplicate_rows from g""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.expr("case when l_discount > 0.05 then l_tax end").alias("t"))
    return r6(q.dataset_profile(d), "null_percentage")


@query("dq2_numeric_profile", "DQ2", """
with l as (select 'l_quantity' column_name, l_quantity v from lineitem union all select 'l_extendedprice', l_extendedprice from lineitem),
 s as (select column_name, min(v) "min", max(v) "max", avg(v) mean, stddev(v) stddev, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.5) median, quantile_cont(v, 0.75) q3 from l group by 1)
select s.column_name, "min", "max", round(mean, 6) mean, round(stddev, 6) stddev, round(q1, 6) q1, round(median, 6) median, round(q3, 6) q3,
 (select count(*) from l where l.column_name = s.column_name and (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))) outlier_count from s""")
def _(t):
    return r6(q.numeric_profile(t.lineitem, ["l_quantity", "l_extendedprice"]), "mean", "stddev", "q1", "median", "q3")


@query("dq2_column_counts", "DQ2 DQ21", """
select 'c_nationkey' column_name, count(*) row_count, 0::BIGINT null_count, count(distinct c_nationkey) unique_count from customer
union all select 'c_mktsegment', count(*), 0, count(distinct c_mktsegment) from customer""")
def _(t):
    return q.column_counts(t.customer, ["c_nationkey", "c_mktsegment"])


@query("dq3_string_profile", "DQ3", """
select 'lang' column_name, min(length(lang))::INTEGER min_length, max(length(lang))::INTEGER max_length, round(avg(length(lang)), 6) avg_length from documents
union all select 'text', min(length(text))::INTEGER, max(length(text))::INTEGER, round(avg(length(text)), 6) from documents""")
def _(t):
    return r6(q.string_profile(t.documents, ["lang", "text"]), "avg_length")


@query("dq3_top_values", "DQ3", """
with c as (select 'lang' column_name, lang "value", count(*) n from documents group by all union all select 'source', source, count(*) from documents group by all)
select column_name, "value", n, row_number() over (partition by column_name order by n desc, "value")::INTEGER rank from c qualify rank <= 10""")
def _(t):
    return q.top_values(t.documents, ["lang", "source"])


@query("dq4_time_profile", "DQ4", """
select 'ts' column_name, epoch_us(min(ts)) min_date, epoch_us(max(ts)) max_date, date_diff('day', min(ts), max(ts))::INTEGER range_days from events""")
def _(t):
    d = q.time_profile(t.events, ["ts"])
    return d.withColumns({"min_date": micros("min_date"), "max_date": micros("max_date")})


@query("dq5_dimension_scores", "DQ5 DQ6", f"""
with e as (select event_id, ts, event_type, case when event_id % 10 <> 0 then value end v from events),
 s as (select (3 + count(v) / count(*)::DOUBLE) / 4 completeness, (1 + 1 + 5.0 / count(*) + case when count(distinct v) / count(*)::DOUBLE > 0.95 then 1 else count(distinct v) / count(*)::DOUBLE end) / 4 uniqueness,
  1.0::DOUBLE validity, (case when max(ts) > TIMESTAMP '{EVENTS_NOW}' - interval 1 hour then 1.0 when max(ts) > TIMESTAMP '{EVENTS_NOW}' - interval 24 hour then 0.9 else 0.7 end)::DOUBLE timeliness,
  count(*) filter (v < 50) / count(*)::DOUBLE accuracy from e)
select round(completeness, 6) completeness, round(uniqueness, 6) uniqueness, validity, timeliness, round(accuracy, 6) accuracy,
 round((0.25 * completeness + 0.2 * accuracy + 0.15 * validity + 0.1 * uniqueness + 0.1 * timeliness) / 0.8, 6) overall from s""")
def _(t):
    e = t.events.select("event_id", "ts", "event_type", F.expr("case when event_id % 10 <> 0 then value end").alias("v"))
    d = q.dimension_scores(e, events_now(), "ts", {"accuracy": F.col("v") < 50})
    return r6(d.select("completeness", "uniqueness", F.col("validity").cast("decimal(2,1)").cast("double").alias("validity"),
                       F.col("timeliness").cast("double").alias("timeliness"), "accuracy", "overall"), "completeness", "uniqueness", "accuracy", "overall")


@query("dq7_rule_ratios", "DQ7", """
with s as (select count(*) n, count(distinct l_orderkey) u, count(*) filter (l_discount > 0) p, count(*) filter (l_quantity between 5 and 45) r,
 count(*) filter (regexp_matches(l_returnflag, '^[AN]$')) m from lineitem)
select * from (select 'l_tax_not_null' rule, 1.0::DOUBLE ratio, 0.95::DOUBLE "limit", true passed from s union all select 'l_orderkey_unique', round(u / n, 6), 0.95, u / n >= 0.95 from s
 union all select 'l_discount_positive', round(p / n, 6), 0.9, p / n >= 0.9 from s union all select 'l_quantity_in_range', round(r / n, 6), 0.8, r / n >= 0.8 from s
 union all select 'l_returnflag_pattern_match', round(m / n, 6), 0.95, m / n >= 0.95 from s)""")
def _(t):
    return r6(q.rule_ratios(t.lineitem, [
        {"type": "not_null", "column": "l_tax"}, {"type": "unique", "column": "l_orderkey"}, {"type": "positive", "column": "l_discount", "threshold": 0.9},
        {"type": "in_range", "column": "l_quantity", "min": 5, "max": 45, "threshold": 0.8},
        {"type": "pattern_match", "column": "l_returnflag", "pattern": "^[AN]$"}]), "ratio")


@query("dq7_reference_ratio", "DQ7 JON7", """
select round(count(o_orderkey) / count(*)::DOUBLE, 6) ratio from lineitem left join (select o_orderkey from orders where o_orderstatus <> 'P') on o_orderkey = l_orderkey""")
def _(t):
    return r6(q.reference_ratio(t.lineitem, "l_orderkey", t.orders.filter("o_orderstatus <> 'P'"), "o_orderkey"), "ratio")


CHECKS = [{"name": "typed", "type": "completeness", "column": "event_type"}, {"name": "ids", "type": "uniqueness", "column": "event_id"},
          {"name": "kinds", "type": "validity", "column": "event_type", "values": ["click", "view", "purchase", "signup"], "threshold": 0.85},
          {"name": "shape", "type": "validity", "column": "props", "pattern": "^\\{\"k\": [0-9]+\\}$"},
          {"name": "range", "type": "validity", "column": "value", "min": 0, "max": 60},
          {"name": "order", "type": "consistency", "first": "user_id", "second": "event_id"},
          {"name": "fresh", "type": "timeliness", "column": "ts", "max_age_hours": 24}]
CHECKS_SQL = f"""s as (select count(*)::DOUBLE n, count(distinct event_id) u, count(*) filter (event_type <> 'error') k, count(*) filter (value <= 60) r,
  count(*) filter (user_id <= event_id) o, (epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(max(ts))) / 3.6e9 age from events),
 c as (select 'typed' check_name, 'completeness' check_type, 1.0::DOUBLE score, 0.95::DOUBLE threshold from s union all select 'ids', 'uniqueness', u / n, 0.95 from s
  union all select 'kinds', 'validity', k / n, 0.85 from s union all select 'shape', 'validity', 1.0, 0.95 from s union all select 'range', 'validity', r / n, 0.95 from s
  union all select 'order', 'consistency', o / n, 0.95 from s union all select 'fresh', 'timeliness', case when age <= 24 then 1.0 else 24 / age end, 0.95 from s),
 f as (select *, case when score >= threshold then 'pass' when score >= threshold - 0.1 then 'warning' else 'fail' end status from c)"""


@query("dq8_check_runner", "DQ8", f"with {CHECKS_SQL} select check_name, check_type, round(score, 6) score, threshold, status from f")
def _(t):
    return r6(q.run_checks(t.events, CHECKS, events_now()), "score")


@query("dq8_check_rollup", "DQ8", f"""with {CHECKS_SQL} select count(*) filter (status = 'pass') passed, count(*) filter (status = 'warning') warnings,
 count(*) filter (status = 'fail') failed, round(avg(score), 6) mean_score from f""")
def _(t):
    return r6(q.check_rollup(q.run_checks(t.events, CHECKS, events_now())), "mean_score")


def metrics_records(t):
    e = t.events
    return e.select(F.expr("case when event_id % 50 <> 0 then event_id end").alias("id"), F.col("event_id").alias("row_id"), F.col("ts").alias("timestamp"),
                    (F.col("value") / 80).alias("convergence_rate"), (k_of(e) * 1.1).alias("cpu_usage"))


RECORDS_SQL = f"""m as (select event_id row_id, case when event_id % 50 <> 0 then event_id end id, value / 80 conv, {SQL_K} * 1.1 cpu from events),
 v as (select *, id is null b1, conv not between 0 and 1 b2, cpu not between 0 and 100 b3 from m)"""


@query("dq9_record_rules", "DQ9", f"""with {RECORDS_SQL}
select row_id, concat_ws(',', case when b1 then 'null_check' end, case when b2 then 'metric_range' end, case when b3 then 'resource_usage' end) violations,
 round(1 - (b1::INTEGER + b2::INTEGER + b3::INTEGER) / 3.0, 6)::DOUBLE score, b1 or b3 action_required from v""")
def _(t):
    d = q.check_records(metrics_records(t), q.record_rules("simulation_metrics"))
    return d.select("row_id", F.array_join("violations", ",").alias("violations"), F.round("score", 6).alias("score"), "action_required")


@query("dq10_enforce_clean", "DQ10", f"""with {RECORDS_SQL},
 o as (select *, case when not (b1 or b3) then 'validated' when id is not null then 'cleaned' else 'rejected' end outcome from v)
select row_id, outcome, round(case when outcome = 'cleaned' then least(greatest(conv, 0), 1) else conv end, 6) convergence_rate,
 round(case when outcome = 'cleaned' then least(greatest(cpu, 0), 100) else cpu end, 6)::DOUBLE cpu_usage,
 case when outcome = 'cleaned' then concat_ws(',', case when b2 then 'convergence_rate' end, case when b3 then 'cpu_usage' end) else '' end modified from o""")
def _(t):
    d = q.enforce(metrics_records(t), "simulation_metrics", "clean")
    return d.select("row_id", "outcome", F.round("convergence_rate", 6).alias("convergence_rate"), F.round(F.col("cpu_usage").cast("double"), 6).alias("cpu_usage"),
                    F.array_join("modified", ",").alias("modified"))


@query("dq10_enforce_modes", "DQ10", f"""with {RECORDS_SQL}
select 'reject' "mode", case when b1 or b3 then 'rejected' else 'validated' end outcome, count(*) n from v group by all
union all select 'quarantine', case when b1 or b3 then 'quarantined' else 'validated' end, count(*) from v group by all""")
def _(t):
    out = None
    for m in ("reject", "quarantine"):
        one = q.enforce(metrics_records(t), "simulation_metrics", m).groupBy("outcome").agg(n_rows().alias("n")).withColumn("mode", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


STATUS_SQL = "case event_type when 'click' then 'pending' when 'view' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' else 'paused' end"


@query("dq11_status_transitions", "DQ11", f"""
with s as (select event_id, user_id, {STATUS_SQL} status, lag({STATUS_SQL}) over (partition by user_id order by ts) p from events)
select event_id, p previous_status, status from s where p is not null and not ((p = 'pending' and status in ('running', 'cancelled'))
 or (p = 'running' and status in ('completed', 'failed', 'paused')) or (p = 'paused' and status in ('running', 'cancelled')) or (p = 'failed' and status = 'pending'))""")
def _(t):
    e = t.events.withColumn("status", F.expr(STATUS_SQL))
    return q.status_transitions(e, ["user_id"], "ts", ["event_id"], "status").select("event_id", "previous_status", "status")


@query("dq12_score_moving_average", "DQ12", """
with recursive e as (select event_id, event_type, (value < 50)::INTEGER s, row_number() over (partition by event_type order by ts, event_id) rn from events),
 f as (select event_type, rn, event_id, 0.1 * s x from e where rn = 1 union all
  select e.event_type, e.rn, e.event_id, 0.9 * f.x + 0.1 * e.s from f join e on e.event_type = f.event_type and e.rn = f.rn + 1)
select event_id, round(x::DOUBLE, 6) score from f""".replace("0.1 * s x", "(0.1 * s)::DOUBLE x").replace("0.9 * f.x + 0.1 * e.s from", "0.9::DOUBLE * f.x + 0.1::DOUBLE * e.s from"))
def _(t):
    d = folds.ema(t.events, ["event_type"], "ts", ["event_id"], (F.col("value") < 50).cast("int"), "score", chunk_rows=200, maps=4)
    return d.select("event_id", F.round("score", 6).alias("score"))


@query("dq13_dataset_events", "DQ13", f"""
with d as (select event_id, user_id, ts, value size, {SQL_K} ns, case when event_type <> 'error' then event_type end f from events),
 m as (select *, avg(size) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) am from d),
 s as (select *, case when ns = 0 then 0.0 else 1.0 end c, case when f is null then 0.5 else 1.0 end a, case when am is null or am = 0 then 1.0 else greatest(0, 1 - abs(size - am) / am) end k,
  case when epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(ts) > 86400000000 then 0.5 else 1.0 end tl from m),
 o as (select *, 0.2 * c + 0.2 * a + 0.15 * k + 0.15 * tl + 0.15 * 0.9 + 0.15 * 0.95 ov from s)
select event_id, round(k, 6) consistency, round(ov, 6)::DOUBLE overall, concat_ws(',', case when c < 0.8 then 'low_completeness' end, case when a < 0.9 then 'accuracy' end,
 case when k < 0.7 then 'inconsistent' end, case when tl < 0.8 then 'stale' end, case when round(ov, 9) < 0.7 then 'below_threshold' end) issues from o""")
def _(t):
    d = t.events.select("event_id", "user_id", "ts", F.col("value").alias("size_bytes"), k_of(t.events).alias("num_samples"),
                        F.when(F.col("event_type") != "error", F.col("event_type")).alias("format"))
    s = q.score_dataset_events(d, "user_id", "ts", "event_id", events_now())
    return s.select("event_id", F.round("consistency", 6).alias("consistency"), F.round("overall", 6).alias("overall"), F.array_join("issues", ",").alias("issues"))


@query("dq14_quality_anomalies", "DQ14", """
with recursive e as (select event_id, event_type, value * pi() / 3 s, row_number() over (partition by event_type order by ts, event_id) rn from events),
 f as (select event_type, rn, event_id, s, s m, 0.1::DOUBLE d, null::DOUBLE pm, null::DOUBLE pd from e where rn = 1 union all
  select e.event_type, e.rn, e.event_id, e.s, 0.95::DOUBLE * f.m + 0.05::DOUBLE * e.s, 0.95::DOUBLE * f.d + 0.05::DOUBLE * abs(e.s - f.m), f.m, f.d from f join e on e.event_type = f.event_type and e.rn = f.rn + 1)
select event_id, round(pm, 5) baseline, round(abs(s - pm), 5) deviation, case when abs(s - pm) > 4 * pd then 'CRITICAL' when abs(s - pm) > 3 * pd then 'HIGH' else 'MEDIUM' end severity,
 case when s < pm then 'QUALITY_DEGRADATION' else 'QUALITY_IMPROVEMENT' end anomaly_type from f where rn > 1 and abs(s - pm) > 2 * pd""")
def _(t):
    d = q.quality_anomalies(t.events.withColumn("value", F.col("value") * F.pi() / 3), ["event_type"], "ts", "event_id", "value")
    return d.select("event_id", F.round("baseline", 5).alias("baseline"), F.round("deviation", 5).alias("deviation"), "severity", "anomaly_type")


@query("dq15_trust_adjusted_quality", "DQ15", f"""
with m as (select event_id, value * pi() / 1500 c, {SQL_K} / 200.0 a, 0.8 fq, {SQL_K} / 100.0 tr from events)
select event_id, round(least(tr * 1.1, (c * 0.25 + (1 - a) * 0.35 + fq * 0.40) * (0.6 + 0.4 * tr)), 6) adjusted from m""")
def _(t):
    k = k_of(t.events)
    adj = q.trust_adjusted(F.col("value") * F.pi() / 1500, k / 200.0, F.lit(0.8), k / 100.0)
    return t.events.select("event_id", F.round(adj, 6).alias("adjusted"))


def _drift_profiles(t):
    def profile(d):
        return q.numeric_profile(d, ["value", "user_id"]).join(q.column_counts(d, ["value", "user_id"]), "column_name")
    return profile(t.events.filter("ts < '2024-01-05'")), profile(t.events.filter("ts >= '2024-01-05'").withColumn("value", F.col("value") * 4))


@query("dq16_profile_drift", "DQ16", """
with o as (select 'value' column_name, avg(value) m, stddev(value) s, count(distinct value) u from events where ts < TIMESTAMP '2024-01-05' union all select 'user_id', avg(user_id), stddev(user_id), count(distinct user_id) from events where ts < TIMESTAMP '2024-01-05'),
 n as (select 'value' column_name, avg(value * 4) m, count(distinct value * 4) u from events where ts >= TIMESTAMP '2024-01-05' union all select 'user_id', avg(user_id), count(distinct user_id) from events where ts >= TIMESTAMP '2024-01-05')
select n.column_name, round(abs(n.m - o.m) / o.s, 6) mean_shift, round(abs(n.u - o.u) / o.u, 6) cardinality_change, abs(n.m - o.m) / o.s > 2 mean_drift, abs(n.u - o.u) / o.u > 0.2 cardinality_drift
from n join o on o.column_name = n.column_name""")
def _(t):
    d = q.profile_drift(*_drift_profiles(t))
    return r6(d.drop("_parts"), "mean_shift", "cardinality_change")


@query("dq16_drift_score", "DQ16")
def _(t):
    return r6(q.drift_score(q.profile_drift(*_drift_profiles(t))), "drift_score")


@query("dq17_volume_anomalies", "DQ17", """
with c as (select user_id, date_trunc('day', ts)::TIMESTAMP d, count(*) n from events group by all),
 w as (select *, avg(n) over x m, stddev_pop(n) over x s, count(*) over x k from c window x as (partition by user_id order by d rows between 5 preceding and 1 preceding))
select user_id, epoch_us(d) d, n, round(m, 6) expected, round(abs(n - m) / s, 6) z_score from w where k = 5 and s > 0 and abs(n - m) / s > 3""")
def _(t):
    c = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(n_rows().alias("n"))
    return r6(q.volume_anomalies(c, ["user_id"], "d", "n").withColumn("d", micros("d")), "expected", "z_score")


@query("dq18_correlations", "DQ18", """
with c as (select *, l_quantity * 3 + l_tax cost from lineitem),
 p as (select 'l_quantity' "first", 'cost' "second", corr(l_quantity, cost) r from c union all select 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice) from c
  union all select 'cost', 'l_extendedprice', corr(cost, l_extendedprice) from c union all select 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) from c)
select "first", "second", round(r, 6) r from p where abs(r) > 0.7""")
def _(t):
    d = t.lineitem.withColumn("cost", F.col("l_quantity") * 3 + F.col("l_tax"))
    return r6(q.correlations(d, ["l_quantity", "cost", "l_extendedprice", "l_tax"]), "r")


@query("dq20_ks_drift", "DQ20", """
with b as (select event_type, value v, 1 a, 0 c from events where ts < TIMESTAMP '2024-01-16' union all select event_type, value * 1.1, 0, 1 from events where ts >= TIMESTAMP '2024-01-16'),
 g as (select event_type, v, sum(a) a, sum(c) c from b group by all),
 r as (select event_type, sum(a) over w / sum(a) over p - sum(c) over w / sum(c) over p gap, sum(a) over p na, sum(c) over p nc from g window w as (partition by event_type order by v), p as (partition by event_type)),
 k as (select event_type, max(abs(gap)) d, max(na)::BIGINT na, max(nc)::BIGINT nc from r group by 1),
 l as (select *, sqrt(na * nc / (na + nc)::DOUBLE) * d lam from k)
select event_type, round(d, 6) statistic, na n_baseline, nc n_current,
 round(case when lam < 0.2 then 1.0 else least(1, greatest(0, (select sum((case when j % 2 = 1 then 2 else -2 end) * exp(-2.0 * j * j * lam * lam)) from range(1, 51) x(j)))) end, 6) p_value from l""")
def _(t):
    a, b = t.events.filter("ts < '2024-01-16'"), t.events.filter("ts >= '2024-01-16'").withColumn("value", F.col("value") * 1.1)
    return r6(q.ks_test(a, b, ["event_type"], "value"), "statistic", "p_value")


@query("dq20_chi_square_drift", "DQ20", """
with a as (select user_id % 10 g, event_type v, count(*) a from events where ts < TIMESTAMP '2024-01-16' group by all), b as (select user_id % 10 g, event_type v, count(*) b from events where ts >= TIMESTAMP '2024-01-16' group by all),
 j as (select coalesce(a.g, b.g) g, coalesce(a, 0) a, coalesce(b, 0) b, (select sum(a) from a x where x.g = coalesce(a.g, b.g)) na, (select sum(b) from b x where x.g = coalesce(a.g, b.g)) nb from a full join b on a.g = b.g and a.v = b.v),
 s as (select g, sum(power(b - a / na * nb, 2) / (a / na * nb)) x, count(*) - 1 df from j group by 1)
select g, round(x, 6) statistic, df from s""")
def _(t):
    e = t.events.withColumn("g", F.col("user_id") % 10)
    return r6(q.chi_square_test(e.filter("ts < '2024-01-16'"), e.filter("ts >= '2024-01-16'"), ["g"], "event_type"), "statistic").drop("p_value")


@query("dq20_drift_severity", "DQ20")
def _(t):
    a, b = t.events.filter("ts < '2024-01-16'"), t.events.filter("ts >= '2024-01-16'").withColumn("value", F.col("value") * 1.5)
    return q.drift_severity(q.ks_test(a, b, ["event_type"], "value"))


@query("dq21_baseline_statistics", "DQ21", """
select column_name, round(avg(v), 6) mean, round(stddev(v), 6) std, min(v) "min", max(v) "max", count(*) n from (select 'l_quantity' column_name, l_quantity v from lineitem union all select 'l_tax', l_tax from lineitem) group by 1""")
def _(t):
    return r6(q.baseline_statistics(t.lineitem, ["l_quantity", "l_tax"]), "mean", "std")


@query("dq22_remediation_plan", "DQ22", """
with d as (select user_id, count(*) filter (event_id % 10 <> 0) / count(*)::DOUBLE c, count(distinct event_type) / 5.0 u, count(*) filter (value < 60) / count(*)::DOUBLE v from events group by 1)
select user_id, 'missing_values' issue, 'fill_missing' actions, 'medium' severity, false requires_approval from d where c < 0.95
union all select user_id, 'duplicate_records', 'remove_duplicates', 'medium', false from d where u < 0.98
union all select user_id, 'schema_violation', 'validate_schema,quarantine_data', 'high', true from d where v < 0.9""")
def _(t):
    d = t.events.groupBy("user_id").agg((F.count_if(F.col("event_id") % 10 != 0) / n_rows()).alias("completeness"), (F.countDistinct("event_type") / 5.0).alias("uniqueness"),
                                        (F.count_if(F.col("value") < 60) / n_rows()).alias("validity"))
    return q.remediation_plan(q.quality_issues(d)).drop("score")


@query("dq23_cap_outliers", "DQ23", """
with s as (select quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b from events)
select event_id, round(greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 6) value from events, s""")
def _(t):
    return r6(q.cap_outliers(t.events, "value").select("event_id", "value"), "value")


@query("dq23_quarantine_split", "DQ23", """
select 'good' part, count(*) n from lineitem where l_quantity >= 10 and l_discount < 0.08 union all select 'bad', count(*) from lineitem where not (l_quantity >= 10 and l_discount < 0.08)""")
def _(t):
    good, bad = q.quarantine(t.lineitem, "l_quantity >= 10 and l_discount < 0.08")
    return good.agg(F.lit("good").alias("part"), n_rows().alias("n")).unionByName(bad.agg(F.lit("bad").alias("part"), n_rows().alias("n")))


@query("dq24_remediation_gate", "DQ24", """
with recursive a as (select event_id, user_id, epoch_us(ts) us from events where event_type <> 'view' and value >= 8),
 f as (select user_id, min(us) us from a group by 1 union all
  select f.user_id, (select min(us) from a where a.user_id = f.user_id and a.us >= f.us + 36000000000) from f where f.us is not null)
select a.event_id from f join a on a.user_id = f.user_id and a.us = f.us""")
def _(t):
    a = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "view", "LOW").otherwise("HIGH").alias("severity"), (F.col("value") / 10).alias("score"))
    return q.remediation_gate(a, ["user_id"], "ts", "event_id", 36_000).select("event_id")


@query("dq25_series_quality", "DQ25", f"""
with h as (select date_trunc('hour', ts)::TIMESTAMP h, count(*) n from events where ts > TIMESTAMP '{EVENTS_NOW}' - interval 24 hour and ts <= TIMESTAMP '{EVENTS_NOW}' group by 1),
 l as (select *, lag(h) over (order by h) p from h),
 s as (select count(*) / 24.0 completeness, 1 - stddev_pop(n) / (avg(n) + 1e-9) consistency, greatest(0, 1 - (epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(max(h))) / 3.6e9) timeliness, count(*) filter (epoch_us(h) - epoch_us(p) > 7200000000) gaps from l)
select round(completeness, 6)::DOUBLE completeness, round(consistency, 6) consistency, round(timeliness, 6) timeliness, gaps, round(0.4 * completeness + 0.3 * consistency + 0.3 * timeliness, 6) overall from s""")
def _(t):
    return r6(q.series_quality(t.events, "ts", events_now()), "completeness", "consistency", "timeliness", "overall")


@query("dq26_suggestions", "DQ26", """
with d as (select count(*) filter (event_id % 5 <> 0) / count(*)::DOUBLE c, count(*) filter (value < 60) / count(*)::DOUBLE v, count(*) filter (value > 300) a from events)
select 'completeness' type, 'high' priority from d where c < 0.9 union all select 'anomaly', 'high' from d where a > 0 union all select 'validity', 'medium' from d where v < 0.95""")
def _(t):
    d = t.events.agg((F.count_if(F.col("event_id") % 5 != 0) / n_rows()).alias("completeness"), (F.count_if(F.col("value") < 60) / n_rows()).alias("validity"),
                     F.count_if(F.col("value") > 300).alias("a"))
    return q.suggestions(d, F.col("a"), F.lit(0))


@query("dq27_document_schema", "DQ27", """
select 'event' path, 'object' type, 1.0::DOUBLE presence union all select 'event.kind', 'string', 1.0 union all select 'event.k', 'integer', 1.0
union all select 'event.big', 'float', round((select count(*) from events where value > 50 and value <> floor(value)) / (select count(*) from events)::DOUBLE, 6)
union all select 'id', 'integer', 1.0""")
def _(t):
    doc = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("kind"), k_of(t.events).alias("k"),
                                                                     F.when((F.col("value") > 50) & (F.col("value") != F.floor("value")), F.col("value")).alias("big")).alias("event")))
    return r6(q.document_schema(t.events.select(doc.alias("doc")), "doc"), "presence")


@query("dq28_record_completeness", "DQ28", """
select event_id, round(((event_id % 3 <> 0)::INTEGER + (value > 20)::INTEGER + 1) / 3.0, 6)::DOUBLE completeness from events""")
def _(t):
    d = t.events.select("event_id", F.expr("case when event_id % 3 <> 0 then 1 end").alias("a"), F.expr("case when value > 20 then 1 end").alias("b"), "ts")
    return d.select("event_id", F.round(q.filled_fields(["a", "b", "ts"]) / 3, 6).alias("completeness"))
