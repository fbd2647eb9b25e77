"""Query-builder, projection and routing queries."""

from pyspark.sql import functions as F

from marlstone.operators import lake
from marlstone.operators.query import Query, and_, describe, or_, predicate, route_predicate, routed, split_by
from marlstone.plans.derived import SQL_K, k_of
from marlstone.plans.registry import query


@query("flt1_filter_suffixes", "FLT1 FLT9", """
select o_orderkey, o_totalprice from orders
where o_orderstatus <> 'P' and o_totalprice between 1000 and 250000 and o_orderpriority in ('1-URGENT', '2-HIGH')
  and o_custkey not in (1, 2, 3) and o_orderpriority like '%-%' and o_orderstatus ilike 'f'
  and o_orderdate is not null and o_orderkey >= 100""")
def _(t):
    return Query(t.orders).filter(
        o_orderstatus__ne="P", o_totalprice__between=(1000, 250000), o_orderpriority__in=["1-URGENT", "2-HIGH"],
        o_custkey__nin=[1, 2, 3], o_orderpriority__like="%-%", o_orderstatus__ilike="f",
        o_orderdate__isnotnull=True, o_orderkey__gte=100).select("o_orderkey", "o_totalprice").to_df()


@query("flt2_exists_and_not_exists", "FLT2 JON8", """
select c_custkey, c_mktsegment from customer c
where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderpriority = '1-URGENT')
  and not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderstatus = 'F')""")
def _(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    done = t.orders.filter("o_orderstatus = 'F'")
    return Query(t.customer).filter(c_custkey__exists=(urgent, "o_custkey"),
                                    c_custkey__notexists=(done, "o_custkey")) \
        .select("c_custkey", "c_mktsegment").to_df()


@query("flt3_where_and_or", "FLT3 FLT4", """
select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem
where l_quantity > 40 and (l_returnflag = 'R' or l_discount >= 0.09) and l_linestatus = 'F'""")
def _(t):
    return (Query(t.lineitem).where("l_quantity", ">", 40)
            .or_where(predicate("l_returnflag", "=", "R"), predicate("l_discount", ">=", 0.09))
            .where("l_linestatus", "=", "F")
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").to_df())


@query("flt5_route_filters", "FLT5", """
select event_id, event_type from events
where event_type <> 'error' and event_type in ('click', 'view', 'purchase')
  and contains(json_extract_string(props, '$.k'), '9') and regexp_matches(event_type, '^(?:c|v)')
  and json_extract_string(props, '$.k') is not null and json_extract_string(props, '$.missing') is null""")
def _(t):
    nested = t.events.withColumn("p", F.from_json("props", "struct<k:string,missing:string>"))
    return nested.filter(route_predicate([
        {"field": "event_type", "operator": "not_equals", "value": "error"},
        {"field": "event_type", "operator": "in", "value": ["click", "view", "purchase"]},
        {"field": "p.k", "operator": "contains", "value": "9"},
        {"field": "event_type", "operator": "regex", "value": "c|v"},
        {"field": "p.k", "operator": "exists"},
        {"field": "p.missing", "operator": "not_exists"}])).select("event_id", "event_type")


@query("flt6_validation_rules", "FLT6 FLT7", """
select distinct c_custkey, c_name, c_acctbal from customer
where c_name is not null and c_acctbal >= 0 and c_acctbal <= 5000 and regexp_matches(c_name, '^Customer#0+[0-9]*7$')
  and c_custkey % 2 = 1""")
def _(t):
    return lake.validate(t.customer, [
        {"type": "not_null", "columns": ["c_name"]}, {"type": "range", "column": "c_acctbal", "min": 0, "max": 5000},
        {"type": "pattern", "column": "c_name", "pattern": "^Customer#0+[0-9]*7$"},
        {"type": "custom", "condition": "c_custkey % 2 = 1"},
        {"type": "unique", "columns": ["c_custkey"]}]).select("c_custkey", "c_name", "c_acctbal")


@query("flt8_router_outputs", "FLT8 SNK6", """
select route, count(*) n, round(sum(value), 4) total from (
  select case when event_type = 'purchase' then 'orders' when event_type = 'error' then 'alerts'
              when value > 100 then 'large' else 'unrouted' end route, value from events) group by route""")
def _(t):
    routes = {"orders": "event_type = 'purchase'", "alerts": "event_type = 'error'", "large": "value > 100"}
    return routed(t.events, routes).groupBy("route").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("flt8_split_streams", "FLT8", """
select 'purchases' output, count(*) n from events where event_type = 'purchase'
union all select 'high', count(*) from events where value > 50""")
def _(t):
    parts = split_by(t.events, {"purchases": "event_type = 'purchase'", "high": "value > 50"})
    out = None
    for name, part in parts.items():
        one = part.agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("prj1_select_distinct", "PRJ1 PRJ2", "select distinct l_returnflag, l_linestatus from lineitem")
def _(t):
    return Query(t.lineitem).select("l_returnflag", "l_linestatus").distinct().to_df()


@query("prj3_rename_cast_derive", "PRJ3 PRJ4 PRJ5", """
select o_orderkey order_id, o_totalprice::BIGINT whole_price, try_cast(o_orderpriority as INTEGER) priority_number,
       round(o_totalprice * 1.1, 4) with_fee, upper(o_orderstatus) || '-' || o_custkey label from orders
where o_totalprice - floor(o_totalprice) <> 0.5""")
def _(t):
    return lake.run_steps(t.orders, [
        ("filter", {"condition": "o_totalprice - floor(o_totalprice) <> 0.5"}),
        ("add_columns", {"computations": {
            "with_fee": "round(o_totalprice * 1.1, 4)", "label": "concat(upper(o_orderstatus), '-', o_custkey)",
            "whole_price": "round(o_totalprice)", "priority_number": "o_orderpriority"}}),
        ("rename", {"mapping": {"o_orderkey": "order_id"}}),
        ("cast", {"types": {"whole_price": "bigint", "priority_number": "int"}}),
    ]).select("order_id", "whole_price", "priority_number", "with_fee", "label")


@query("prj6_categorize", "PRJ6 PRJ9 UDF1", """
select category, tier, count(*) n from (
  select case when p_type = 'PROMO' then 'promotion' when p_size < 10 then 'small' else 'Other' end category,
         case when p_retailprice > 1000 then 'high' when p_retailprice > 950 then 'medium' else 'low' end tier
  from part) group by all""")
def _(t):
    return lake.run_steps(t.part, [
        ("categorize", {"out": "category", "cases": [("p_type = 'PROMO'", "promotion"), ("p_size < 10", "small")]}),
        ("categorize", {"out": "tier", "cases": [("p_retailprice > 1000", "high"), ("p_retailprice > 950", "medium")],
                        "otherwise": "low"}),
    ]).groupBy("category", "tier").agg(F.count(F.lit(1)).alias("n"))


@query("prj7_standard_names", "PRJ7", """
select n_nationkey "NNationkey", n_name "NName", n_regionkey "NRegionkey" from nation""")
def _(t):
    return lake.standardize_names(lake.standardize_names(t.nation, "snake"), "pascal")


@query("prj8_field_mapper", "PRJ8 FN5 FN8", f"""
select event_id, hour(ts)::INTEGER event_hour, strftime(ts, '%Y-%m-%d') event_date,
       (event_type = 'error')::INTEGER is_violation, (event_type = 'signup')::INTEGER is_failover,
       {SQL_K} status from events""")
def _(t):
    raw = t.events.withColumn("timestamp", F.unix_millis(F.col("ts").cast("timestamp")))
    return raw.select(
        "event_id", F.hour(F.timestamp_millis("timestamp")).alias("event_hour"),
        F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd").alias("event_date"),
        F.expr("case when event_type = 'error' then 1 else 0 end").alias("is_violation"),
        F.expr("case when event_type = 'signup' then 1 else 0 end").alias("is_failover"),
        k_of(raw).alias("status"))


@query("prj10_transform_by_type", "PRJ10 SRC4", f"""
select event_id, case when event_type = 'purchase' then upper(event_type) end resource_type,
       case when event_type = 'purchase' then round({SQL_K} * value, 4) end total_value,
       case when event_type = 'error' then ({SQL_K} < 50)::INTEGER end is_violation
from events where event_type in ('purchase', 'error')""")
def _(t):
    p = t.events.filter(F.col("event_type").isin("purchase", "error")) \
        .withColumn("payload", F.from_json("props", "struct<k:double>"))
    order, metric = F.col("event_type") == "purchase", F.col("event_type") == "error"
    return p.select("event_id", F.when(order, F.upper("event_type")).alias("resource_type"),
                    F.when(order, F.round(F.col("payload.k") * F.col("value"), 4)).alias("total_value"),
                    F.when(metric, (F.col("payload.k") < 50).cast("int")).alias("is_violation"))


@query("prj11_metadata_and_lookup", "PRJ11 JON5", """
select c_custkey, 'customers' source_topic, c_custkey::VARCHAR event_id, n_name, n_regionkey
from customer left join nation on n_nationkey = c_nationkey""")
def _(t):
    meta = t.customer.withColumn("_metadata", F.struct(F.col("c_custkey").cast("string").alias("event_id"),
                                                       F.lit("customers").alias("source_topic")))
    names = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    return lake.lookup(meta, names, ["c_nationkey"], ["n_name", "n_regionkey"]) \
        .select("c_custkey", "_metadata.source_topic", "_metadata.event_id", "n_name", "n_regionkey")


@query("prj12_describe_table", "PRJ12", """
select 0 "position", 'c_custkey' column_name, 'bigint' data_type, (select count(*) from customer) row_count
union all select 1, 'c_name', 'string', (select count(*) from customer)
union all select 2, 'c_nationkey', 'int', (select count(*) from customer)
union all select 3, 'c_acctbal', 'double', (select count(*) from customer)
union all select 4, 'c_mktsegment', 'string', (select count(*) from customer)""")
def _(t):
    return describe(t.customer).withColumn("row_count", t.customer.agg(F.count(F.lit(1))).scalar())


@query("prj13_gold_view", "PRJ13", """
select c_custkey, c_acctbal from customer where c_mktsegment = 'BUILDING' and c_acctbal > 9000""")
def _(t):
    lake.gold_view(t.customer, "rich_builders", "c_mktsegment = 'BUILDING' and c_acctbal > 9000",
                   ["c_custkey", "c_acctbal"])
    return t.spark.table("rich_builders")


@query("srt1_order_limit_offset", "SRT1 SRT2", """
select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 20 offset 40""")
def _(t):
    return Query(t.orders).order_by("-o_totalprice").order_by("o_orderkey").page(3, 20) \
        .select("o_orderkey", "o_totalprice").to_df()


@query("srt3_top_k_per_user", "SRT3", """
select user_id, event_id, value, rank from (
  select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id)::INTEGER rank
  from events) where rank <= 3""")
def _(t):
    from marlstone.operators.windows import ranked_top
    return ranked_top(t.events, ["user_id"], [F.col("value").desc(), F.col("event_id")], 3) \
        .select("user_id", "event_id", "value", "rank")


@query("agg2_group_having", "AGG2 JON1", """
select c_mktsegment, o_orderpriority, count(*) orders, round(sum(o_totalprice), 2) total
from orders join customer on o_custkey = c_custkey group by all having count(*) > 10""")
def _(t):
    return (Query(t.orders).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .group_by("c_mktsegment", "o_orderpriority")
            .agg(orders=F.count(F.lit(1)), total=F.round(F.sum("o_totalprice"), 2))
            .having("orders", ">", 10).to_df())


@query("jon1_join_types", "JON1", """
select 'left' kind, count(*) n, count(o_orderkey) matched from customer left join (select * from orders where o_totalprice > 400000) on o_custkey = c_custkey
union all select 'right', count(*), count(c_custkey) from (select * from customer where c_acctbal > 5000) right join orders on o_custkey = c_custkey
union all select 'full', count(*), count(*) filter (c_custkey is not null and o_orderkey is not null)
  from (select * from customer where c_acctbal > 5000) full join (select * from orders where o_totalprice > 400000) on o_custkey = c_custkey""")
def _(t):
    on = F.col("o_custkey") == F.col("c_custkey")
    rich, big = t.customer.filter("c_acctbal > 5000"), t.orders.filter("o_totalprice > 400000")
    both = F.count(F.when(F.col("c_custkey").isNotNull() & F.col("o_orderkey").isNotNull(), 1))
    out = None
    for kind, l, r, m in (("left", t.customer, big, F.count("o_orderkey")), ("right", rich, t.orders, F.count("c_custkey")),
                          ("full", rich, big, both)):
        one = Query(l).join(r, on, kind).to_df().agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), m.alias("matched"))
        out = one if out is None else out.unionByName(one)
    return out
