"""Lake zones, joins, merges, change data capture and time travel."""

from pyspark.sql import functions as F

from marlstone.functions.columns import micros
from marlstone.operators import joins, lake, merge
from marlstone.operators.query import Query
from marlstone.operators.windows import latest, rows_frame
from marlstone.plans.derived import CHANGES_SQL, EVENTS_NOW, ORDERS_NOW, changes
from marlstone.plans.registry import query


@query("src1_bronze_silver_gold_revenue", "SRC1 SRC10 SNK1 PRJ5 JON2 AGG1", """
select c_mktsegment, strftime(o_orderdate, '%Y-%m') order_month, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue_sum,
       count(*) revenue_count, 'month' _aggregation_level, 'orders,lineitem,customer' _source_datasets
from orders join lineitem on l_orderkey = o_orderkey join customer on c_custkey = o_custkey
where o_totalprice is not null group by all""")
def _(t):
    bronze = lake.to_bronze(t.orders, "tenant-1", "orders")
    silver = lake.to_silver(lake.validate(bronze, [{"type": "not_null", "columns": ["o_totalprice"]}]))
    orders = silver.select("o_orderkey", "o_custkey", "o_orderdate")
    lines = t.lineitem.select("l_orderkey", "l_extendedprice", "l_discount").withColumnRenamed("l_orderkey", "o_orderkey")
    people = t.customer.select("c_custkey", "c_mktsegment").withColumnRenamed("c_custkey", "o_custkey")
    joined = lake.join_datasets([("orders", orders), ("lineitem", lines), ("customer", people)], [
        {"keys": ["o_orderkey"], "right_prefix": ""}, {"keys": ["o_custkey"], "right_prefix": ""}])
    priced = lake.add_columns(joined, {"revenue": "l_extendedprice * (1 - l_discount)",
                                       "order_month": "date_format(o_orderdate, 'yyyy-MM')"})
    gold = lake.aggregate(priced, ["c_mktsegment", "order_month"], {"revenue": ["sum", "count"]})
    return lake.to_gold(gold.withColumn("revenue_sum", F.round("revenue_sum", 2)), "month",
                        ["orders", "lineitem", "customer"]).drop("_gold_timestamp")


@query("src5_incremental_load", "SRC5 SRC6", """
select count(*) loaded, max(event_id) top_id, epoch_us(max(ts)) high_water from events where ts > TIMESTAMP '2024-01-20 00:00:00'""")
def _(t):
    from marlstone.sources.readers import incremental_load
    fresh = incremental_load(t.events, "ts", "2024-01-20 00:00:00")
    return fresh.agg(F.count(F.lit(1)).alias("loaded"), F.max("event_id").alias("top_id"),
                     micros(F.max("ts")).alias("high_water"))


@query("snk1_record_hash", "SNK1 FN13", """
select count(*) "rows", count(distinct (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)) hashes, 'tenant-1' tenant from customer""")
def _(t):
    b = lake.to_bronze(t.customer, "tenant-1")
    return b.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("_record_hash").alias("hashes"),
                 F.max("_tenant_id").alias("tenant"))


@query("jon2_silver_join", "JON2 JON6", """
select s_suppkey, s_name, n_n_name, r_r_name from (
  select s_suppkey, s_name, n_name n_n_name, n_regionkey n_n_regionkey, r_name r_r_name
  from supplier join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey)""")
def _(t):
    s = t.supplier.withColumnRenamed("s_nationkey", "nationkey")
    n = t.nation.withColumnsRenamed({"n_nationkey": "nationkey", "n_regionkey": "regionkey"})
    r = t.region.withColumnRenamed("r_regionkey", "regionkey")
    step = lake.join_datasets([("s", s), ("n", n)], [{"keys": ["nationkey"], "right_prefix": "n_"}])
    step = step.withColumnRenamed("n_regionkey", "regionkey")
    return lake.join_datasets([("sn", step), ("r", r)], [{"keys": ["regionkey"], "type": "left", "right_prefix": "r_"}]) \
        .select("s_suppkey", "s_name", "n_n_name", "r_r_name")


@query("jon3_join_on_different_names", "JON3", """
select s_suppkey, c_custkey from supplier join customer on s_nationkey = c_nationkey and s_suppkey = c_custkey""")
def _(t):
    return lake.join_on(t.supplier, t.customer, ["s_nationkey", "s_suppkey"], ["c_nationkey", "c_custkey"]) \
        .select("s_suppkey", "c_custkey")


@query("jon4_keyless_join", "JON4", """
select n_name, count(*) pairs, max(s_acctbal) best from supplier cross join nation group by n_name""")
def _(t):
    return joins.keyless_join(t.supplier, t.nation.select("n_name")).groupBy("n_name").agg(
        F.count(F.lit(1)).alias("pairs"), F.max("s_acctbal").alias("best"))


@query("jon7_referential_integrity", "JON7", """
select l_orderkey, l_linenumber, l_partkey from lineitem where not exists (
  select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P')""")
def _(t):
    kept = t.orders.filter("o_orderstatus <> 'P'")
    return t.lineitem.join(kept, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti") \
        .select("l_orderkey", "l_linenumber", "l_partkey")


PIT_SQL = """
with f as (select user_id, ts fts, event_id feature_id, value feature from events where event_type = 'view'),
 e as (select event_id, user_id, ts from events where event_type = 'purchase'),
 j as (select e.event_id, e.user_id, e.ts, f.fts, f.feature_id, f.feature from e asof left join f on e.user_id = f.user_id and e.ts >= f.fts)
"""


@query("jon9_point_in_time", "JON9", PIT_SQL + """
select event_id, user_id, case when ts - fts <= interval 1 day then feature_id end feature_id,
       case when ts - fts <= interval 1 day then feature end feature from j""")
def _(t):
    e = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    f = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("fts"),
                                                      F.col("event_id").alias("feature_id"), F.col("value").alias("feature"))
    return joins.point_in_time_join(e, f, ["user_id"], "ts", "fts", ["feature_id", "feature"]).drop("ts")


@query("jon10_historical_features", "JON10", PIT_SQL + """
select event_id, j.user_id, feature, c_acctbal from j left join customer on c_custkey = j.user_id""")
def _(t):
    e = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    f = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("fts"), F.col("value").alias("feature"))
    people = t.customer.select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    return joins.historical_features(e, [
        {"df": f, "keys": ["user_id"], "ts": "fts", "columns": ["feature"], "lookback_seconds": None},
        {"df": people, "keys": ["user_id"], "columns": ["c_acctbal"]}], "ts").drop("ts")


@query("jon11_interval_join", "JON11", """
select a.event_id op_id, b.event_id state_id from events a join events b on a.user_id = b.user_id
 and b.ts between a.ts - interval 2 hour and a.ts + interval 2 hour
where a.event_type = 'click' and b.event_type = 'view'""")
def _(t):
    a = t.events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("op_id"))
    b = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("sts"), F.col("event_id").alias("state_id"))
    return joins.interval_join(a, b, ["user_id"], "ts", "sts", 7200, 7200).select("op_id", "state_id")


@query("jon12_event_label", "JON12", """
select a.event_id, exists(select 1 from events b where b.event_type = 'error' and b.user_id = a.user_id
  and b.ts >= a.ts and b.ts <= a.ts + interval 24 hour)::INTEGER liquidated
from events a where a.event_type = 'purchase'""")
def _(t):
    a = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = t.events.filter("event_type = 'error'").select("user_id", F.col("ts").alias("lts"))
    return joins.next_within(a, b, ["user_id"], "ts", "lts", 86_400, "liquidated").select("event_id", "liquidated")


@query("jon14_trades_against_positions", "JON14", """
with p as (select user_id, ts pts, value entry, event_id position_id from events where event_type = 'signup'),
 tr as (select event_id, user_id, ts, value price from events where event_type = 'purchase'),
 j as (select tr.*, p.entry, p.position_id from tr asof join p on tr.user_id = p.user_id and tr.ts >= p.pts)
select event_id, position_id, round(price / entry - 1, 6) change, case when price < 0.8 * entry then 'at_risk' else 'ok' end state
from j where entry > 0""")
def _(t):
    p = t.events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("pts"),
                                                        F.col("value").alias("entry"), F.col("event_id").alias("position_id"))
    tr = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", F.col("value").alias("price"))
    return joins.point_in_time_join(tr, p, ["user_id"], "ts", "pts", ["entry", "position_id"], None) \
        .filter("entry > 0").select(
        "event_id", "position_id", F.round(F.col("price") / F.col("entry") - 1, 6).alias("change"),
        F.when(F.col("price") < 0.8 * F.col("entry"), "at_risk").otherwise("ok").alias("state"))


@query("jon16_quality_with_latest_trust", "JON16", """
with s as (select user_id, ts sts, least(value / 100, 1) trust from events where event_type = 'signup'),
 q as (select event_id, user_id, ts, value from events where event_type = 'view'),
 j as (select q.*, trust from q asof left join s on q.user_id = s.user_id and q.ts >= s.sts)
select event_id, round(value * coalesce(trust, 0.5), 6) weighted, coalesce(trust, 0.5) trust from j""")
def _(t):
    s = t.events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("sts"),
                                                        F.least(F.col("value") / 100, F.lit(1.0)).alias("trust"))
    q = t.events.filter("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    j = joins.point_in_time_join(q, s, ["user_id"], "ts", "sts", ["trust"], None) \
        .withColumn("trust", F.coalesce("trust", F.lit(0.5)))
    return j.select("event_id", F.round(F.col("value") * F.col("trust"), 6).alias("weighted"), "trust")


@query("jon17_or_join_as_union", "JON17", """
with edges as (select distinct l_partkey src, l_suppkey dst from lineitem),
 groups as (select s_suppkey member, s_nationkey community from supplier)
select distinct src, dst, community from edges join groups on src = member or dst = member""")
def _(t):
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    groups = t.supplier.select(F.col("s_suppkey").alias("member"), F.col("s_nationkey").alias("community"))
    return joins.either_end_join(edges, groups, "src", "dst", "member")


@query("jon18_proximity_pairs", "JON18", """
with p as (select c_custkey id, c_nationkey g, c_acctbal x, (c_custkey * 7919 % 10000)::DOUBLE y from customer)
select a.id id_a, b.id id_b, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) distance
from p a join p b on a.g = b.g and a.id < b.id where sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 500""")
def _(t):
    p = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("x"),
                          (F.col("c_custkey") * 7919 % 10000).cast("double").alias("y"))
    return joins.radius_pairs(p, "id", "x", "y", 500.0, ["g"]).select("id_a", "id_b", F.round("distance", 6).alias("distance"))


@query("jon19_federated_sql", "JON19", """
select r_name, count(distinct c_custkey) customers, count(distinct s_suppkey) suppliers
from region join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey
left join supplier on s_nationkey = n_nationkey group by r_name""")
def _(t):
    from marlstone.sources.readers import federated_sql
    return federated_sql(t.spark, {
        "geo_region": t.region, "geo_nation": t.nation, "crm_customer": t.customer, "erp_supplier": t.supplier}, """
        select r_name, coalesce(sum(c), 0) as customers, coalesce(sum(s), 0) as suppliers from geo_region
        join geo_nation on n_regionkey = r_regionkey
        left join (select c_nationkey, count(*) c from crm_customer group by 1) on c_nationkey = n_nationkey
        left join (select s_nationkey, count(*) s from erp_supplier group by 1) on s_nationkey = n_nationkey
        group by r_name""")


@query("jon20_hits_with_metrics", "JON20 AGG6", """
with hits as (select doc_id, n_chars from documents where lower(text) like '%the %'),
 m as (select user_id, count(*) events, round(avg(value), 6) mean_value from events group by user_id)
select doc_id, n_chars, events, mean_value from hits join m on m.user_id = doc_id""")
def _(t):
    hits = t.documents.filter(F.lower("text").contains("the ")).select("doc_id", "n_chars")
    m = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("value"), 6).alias("mean_value"))
    return hits.join(m, F.col("doc_id") == F.col("user_id")).drop("user_id")


@query("win1_keep_last_per_key", "WIN1 DED1 DED2", """
select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc) = 1""")
def _(t):
    return lake.deduplicate(t.events, ["user_id"], "last", ["ts"]).select("user_id", "event_id", "event_type")


@query("ded1_keep_none", "DED1", """
select l_orderkey, l_linenumber, max(l_partkey) l_partkey from lineitem group by all having count(*) = 1""")
def _(t):
    return lake.deduplicate(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], "none")


@query("ded1_whole_row_and_first", "DED1", """
select l_orderkey, min(l_partkey) l_partkey from lineitem group by l_orderkey""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey")
    return lake.deduplicate(lake.deduplicate(rows), ["l_orderkey"], "first", ["l_partkey"])


@query("ded2_keep_most_complete", "DED2", """
with d as (select l_orderkey k, l_partkey, case when l_discount > 0.02 then l_discount end a, case when l_tax > 0.02 then l_tax end b, l_suppkey from lineitem)
select k, max(f) filled from (select k, (a is not null)::INTEGER + (b is not null)::INTEGER f from d) group by k""")
def _(t):
    from marlstone.operators.quality import filled_fields
    d = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey", F.expr("case when l_discount > 0.02 then l_discount end").alias("a"),
                          F.expr("case when l_tax > 0.02 then l_tax end").alias("b"))
    d = d.withColumn("filled", filled_fields(["a", "b"]))
    return latest(d, ["k"], [F.col("filled").desc(), F.col("l_partkey"), F.col("l_suppkey")]).select("k", "filled")


UPSERT_T = "(select o_orderkey id, o_orderstatus status, o_totalprice amount from orders where o_orderkey % 3 <> 0)"
UPSERT_S = "(select o_orderkey id, 'X' status, case when o_orderkey % 4 <> 0 then round(o_totalprice * 2, 2) end amount, o_custkey extra from orders where o_orderkey % 2 = 0)"


@query("mrg1_upsert", "MRG1 SNK5", f"""
select coalesce(s.id, t.id) id, case when s.id is not null then s.status else t.status end status,
       case when s.id is not null then s.amount else t.amount end amount, s.extra
from {UPSERT_T} t full join {UPSERT_S} s on s.id = t.id""")
def _(t):
    o = t.orders
    target = o.filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey id", "o_orderstatus status", "o_totalprice amount")
    source = o.filter("o_orderkey % 2 = 0").selectExpr(
        "o_orderkey id", "'X' status", "case when o_orderkey % 4 <> 0 then round(o_totalprice * 2, 2) end amount", "o_custkey extra")
    return merge.upsert(target, source, ["id"])


@query("mrg1_upsert_some_columns", "MRG1 SNK11", f"""
select coalesce(s.id, t.id) id, case when t.id is not null then t.status else s.status end status,
       case when s.id is not null then s.amount else t.amount end amount
from {UPSERT_T} t full join {UPSERT_S} s on s.id = t.id""")
def _(t):
    o = t.orders
    target = o.filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey id", "o_orderstatus status", "o_totalprice amount")
    source = o.filter("o_orderkey % 2 = 0").selectExpr(
        "o_orderkey id", "'X' status", "case when o_orderkey % 4 <> 0 then round(o_totalprice * 2, 2) end amount")
    return merge.upsert(target, source, ["id"], ["amount"])


@query("mrg2_gold_strategies", "MRG2", """
with a as (select c_nationkey k, count(*) n from customer group by all), b as (select s_nationkey k, count(*) n from supplier group by all)
select 'update' strategy, coalesce(b.k, a.k) k, coalesce(b.n, a.n) n from a full join b on a.k = b.k
union all select 'append', k, n from a union all select 'append', k, n from b
union all select 'replace', k, n from b""")
def _(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for s in ("update", "append", "replace"):
        one = merge.merge_gold(a, b, s, ["k"]).withColumn("strategy", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


@query("mrg3_delete_and_update", "MRG3", """
select o_orderkey, case when o_totalprice > 300000 then 'BIG' else o_orderpriority end o_orderpriority
from orders where not (o_orderstatus = 'F')""")
def _(t):
    kept = merge.delete_where(t.orders, "o_orderstatus = 'F'")
    return merge.update_where(kept, "o_totalprice > 300000", {"o_orderpriority": F.lit("BIG")}) \
        .select("o_orderkey", "o_orderpriority")


@query("cdc1_change_projection", "CDC1 CDC2 SRC9", f"""with {CHANGES_SQL}
select op operation, user_id, event_type, value, ts_ms event_timestamp from changes""")
def _(t):
    return merge.project_changes(changes(t), "user_id", ["event_type", "value"])


@query("cdc2_upserts_only", "CDC2", f"with {CHANGES_SQL} select op, count(*) n, round(sum(value), 4) total from changes where op in ('INSERT', 'UPDATE') group by op")
def _(t):
    return merge.upserts_only(changes(t)).groupBy("op").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("after.value"), 4).alias("total"))


def _flat_log(t):
    c = changes(t)
    return c.select(F.coalesce("before.user_id", "after.user_id").alias("user_id"), F.col("op").alias("operation"),
                    "after.event_type", "after.value", "ts_ms", "event_id")


@query("cdc3_apply_changes", "CDC3", f"""with {CHANGES_SQL}
select user_id, op operation, event_type, value from changes
qualify row_number() over (partition by user_id order by ts_ms desc, event_id desc) = 1 and op <> 'DELETE'""")
def _(t):
    return merge.apply_changes(_flat_log(t), ["user_id"], ["ts_ms", "event_id"]).drop("ts_ms", "event_id")


@query("cdc4_position_history", "CDC4", """
select user_id, event_id, epoch_us(ts) valid_from, epoch_us(lead(ts) over (partition by user_id order by ts)) valid_to from events""")
def _(t):
    h = merge.history(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", ["event_id"])
    return h.select("user_id", "event_id", micros("valid_from").alias("valid_from"), micros("valid_to").alias("valid_to"))


@query("ttr1_state_as_of", "TTR1", f"""with {CHANGES_SQL}
select user_id, event_id, event_type from changes where ts_ms <= epoch_ms(TIMESTAMP '2024-01-15 00:00:00')
qualify row_number() over (partition by user_id order by ts_ms desc, event_id desc) = 1 and op <> 'DELETE'""")
def _(t):
    at = F.unix_millis(F.to_timestamp(F.lit("2024-01-15 00:00:00")))
    return merge.as_of(_flat_log(t), ["user_id"], ["ts_ms", "event_id"], at, "ts_ms").select("user_id", "event_id", "event_type")


@query("ttr3_version_diff", "TTR3", """
with a as (select user_id, max(event_id) top from events where ts < TIMESTAMP '2024-01-10' group by all),
 b as (select user_id, max(event_id) top from events where ts >= TIMESTAMP '2024-01-03' group by all)
select coalesce(a.user_id, b.user_id) user_id, case when a.user_id is null then 'added' when b.user_id is null then 'removed'
 when a.top = b.top then 'same' else 'changed' end status from a full join b on a.user_id = b.user_id""")
def _(t):
    top = lambda c: t.events.filter(c).groupBy("user_id").agg(F.max("event_id").alias("top"))
    return merge.version_diff(top("ts < '2024-01-10'"), top("ts >= '2024-01-03'"), ["user_id"])


@query("evo1_schema_evolution", "EVO1", "select p_partkey part_id, p_name, p_brand, null::INTEGER stock from part")
def _(t):
    return merge.evolve(t.part, {"stock": "int"}, {"p_partkey": "part_id"},
                        ["p_type", "p_size", "p_retailprice"])


@query("evo2_schema_drift", "EVO2", """
select * from (values ('stock', 'added', null, 'int'), ('p_type', 'removed', 'string', null),
 ('p_size', 'type_changed', 'int', 'bigint')) v(column_name, change, old_type, new_type)""")
def _(t):
    new = merge.evolve(t.part, {"stock": "int"}, None, ["p_type"]).withColumn("p_size", F.col("p_size").cast("bigint"))
    return merge.schema_drift(t.part, new)


@query("snk8_layout_choice", "SNK8", """
select strftime(o_orderdate, '%Y-%m-%d-%H') "_hour", count(*) n, true bucket_in_range from orders group by 1""")
def _(t):
    from marlstone.sources.writers import USER_BUCKETS, choose_partitioning
    df = t.orders.withColumnsRenamed({"o_custkey": "user_id"})
    return df.withColumns(choose_partitioning(df.schema)).groupBy("_hour").agg(
        F.count(F.lit(1)).alias("n"), F.max("_user_bucket").between(0, USER_BUCKETS - 1).alias("bucket_in_range"))


@query("snk10_retention", "SNK10", f"""
select user_id, epoch_us(max(ts)) last_access, count(*) accesses from events group by user_id
having max(ts) < TIMESTAMP '{EVENTS_NOW}' - interval 1 day""")
def _(t):
    now = F.lit(EVENTS_NOW).cast("timestamp_ntz")
    return merge.archive_candidates(t.events, ["user_id"], "ts", now, 1) \
        .withColumn("last_access", micros("last_access"))


@query("snk10_expire_rows", "SNK10", f"""
select date_part('year', o_orderdate)::INTEGER order_year, count(*) n from orders
where o_orderdate >= TIMESTAMP '{ORDERS_NOW}' - interval 400 day group by all""")
def _(t):
    kept = merge.expire(t.orders, "o_orderdate", F.lit(ORDERS_NOW).cast("timestamp_ntz"), 400)
    return kept.groupBy(F.year("o_orderdate").alias("order_year")).agg(F.count(F.lit(1)).alias("n"))
