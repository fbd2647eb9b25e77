"""Scalar function families."""

from pyspark.sql import functions as F

from marlstone.functions import scalars as sc
from marlstone.functions.columns import clamp, micros
from marlstone.operators import lake
from marlstone.plans.derived import SQL_K, k_of
from marlstone.plans.registry import query
from marlstone.sources.readers import records_from_json


@query("fn1_trim_strings", "FN1 FN11", """
select doc_id, length(trim(concat('  ', lang, ' '))) trimmed, length(trim(text, ' ')) text_length, trim(text, ' ') = '' is_blank from documents""")
def _(t):
    d = lake.trim_strings(t.documents.select("doc_id", F.concat(F.lit("  "), "lang", F.lit(" ")).alias("lang"), "text"))
    return d.select("doc_id", F.length("lang").cast("bigint").alias("trimmed"), F.length("text").cast("bigint").alias("text_length"), sc.blank("text").alias("is_blank"))


@query("fn2_standard_dates", "FN2", """
select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') order_date from orders where o_orderkey % 3 < 2
union all select o_orderkey, null from orders where o_orderkey % 3 = 2""")
def _(t):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")) \
        .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise("n/a")
    return lake.standardize_dates(t.orders.select("o_orderkey", raw.alias("order_date")), ["order_date"], "yyyy/MM/dd",
                                  ("yyyy-MM-dd", "dd.MM.yyyy"))


@query("fn3_date_parts", "FN3 DQ18", """
select year(ts)::INTEGER y, month(ts)::INTEGER mo, day(ts)::INTEGER d, hour(ts)::INTEGER h, (dayofweek(ts) + 1)::INTEGER dow, count(*) n from events group by all""")
def _(t):
    return t.events.groupBy(F.year("ts").alias("y"), F.month("ts").alias("mo"), F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"),
                            F.dayofweek("ts").alias("dow")).agg(F.count(F.lit(1)).alias("n"))


@query("fn4_days_since", "FN4 FEA5", """
select o_custkey, count(*) orders, round(avg(o_totalprice), 6) mean_price, date_diff('day', max(o_orderdate), DATE '2001-08-02')::INTEGER days_since,
 case when avg(o_totalprice) > 300000 then 'high' when avg(o_totalprice) > 200000 then 'medium' else 'low' end risk from orders group by 1""")
def _(t):
    from marlstone.operators.features import user_features
    return user_features(t.orders, "o_custkey", "o_totalprice", "o_orderdate", F.lit("2001-08-02").cast("date"), (300_000, 200_000)) \
        .withColumnsRenamed({"transactions": "orders", "mean_amount": "mean_price"}).withColumn("mean_price", F.round("mean_price", 6))


@query("fn7_maps", "FN7 STR3", f"""
select user_id, round(avg(case when event_type <> 'error' then {SQL_K} end), 6) mean_k, count(case when event_type <> 'error' then 1 end) parsed from events group by 1""")
def _(t):
    m = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.when(F.col("event_type") == "error", "n/a").otherwise(F.get_json_object("props", "$.k")))
    d = t.events.select("user_id", m.alias("details"))
    k = F.col("details")["k"].try_cast("double")
    return d.groupBy("user_id").agg(F.round(F.avg(k), 6).alias("mean_k"), F.count(k).alias("parsed"))


@query("fn9_string_functions", "FN9", """
select c_custkey, upper(concat(c_mktsegment, ':', c_nationkey::VARCHAR)) tag, coalesce(case when c_mktsegment like 'B%' then c_name end, 'none') label from customer""")
def _(t):
    return t.customer.select("c_custkey", F.upper(F.concat("c_mktsegment", F.lit(":"), F.col("c_nationkey").cast("string"))).alias("tag"),
                             F.coalesce(F.when(F.col("c_mktsegment").like("B%"), F.col("c_name")), F.lit("none")).alias("label"))


@query("fn10_error_categories", "FN10", """
with d as (select lower(text) x from documents)
select case when x = '' then 'unknown' when regexp_matches(x, 'timeout|timed out') then 'timeout' when regexp_matches(x, 'connection|connect|network') then 'connection'
 when regexp_matches(x, 'serializ|deserializ|json|parse') then 'serialization' when regexp_matches(x, 'validat|invalid|required') then 'validation'
 when regexp_matches(x, 'auth|forbidden|unauthorized') then 'authorization' when regexp_matches(x, 'rate|limit|throttl') then 'rate_limit'
 when regexp_matches(x, 'resource|memory|disk|cpu') then 'resource' when regexp_matches(x, 'database|db|sql|cassandra|mongo') then 'database'
 when regexp_matches(x, 'service|unavailable|503') then 'service' else 'other' end category, count(*) n from d group by 1""")
def _(t):
    return t.documents.groupBy(sc.error_category("text").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("fn12_topic_tenant_and_ids", "FN12 UDF2", """
select event_id, 'team' || (user_id % 7)::VARCHAR tenant, sha256(event_id::VARCHAR || chr(31) || event_type) id from events""")
def _(t):
    topic = F.concat(F.lit("persistent://main/team"), (F.col("user_id") % 7).cast("string"), F.lit("/events"))
    return t.events.select("event_id", sc.tenant_of_topic(topic).alias("tenant"), sc.stable_id("event_id", "event_type").alias("id"))


@query("fn14_array_functions", "FN14", """
select conv_id, count(*) turns, array_to_string(list_sort(list(distinct role)), ',') roles, list_contains(list(role), 'system') has_system from conversations group by 1""")
def _(t):
    d = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.collect_set("role").alias("r"))
    return d.select("conv_id", "turns", F.array_join(F.array_sort("r"), ",").alias("roles"), F.array_contains("r", "system").alias("has_system"))


@query("fn15_exploded_structs", "FN15 UDF3 ML4", f"""
select event_type, count(*) agents, round(avg({SQL_K} + i), 6) mean_energy, max(i)::INTEGER top from events, (select unnest(range(3)) i) group by 1""")
def _(t):
    agents = F.concat(F.lit("["), F.concat_ws(",", *[F.format_string('{"id":%d,"energy":%d}', F.lit(i), k_of(t.events) + i) for i in range(3)]), F.lit("]"))
    rows = records_from_json(t.events.select("event_type", agents.alias("payload")), "payload", "struct<id:int,energy:double>")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("agents"), F.round(F.avg("energy"), 6).alias("mean_energy"), F.max("id").alias("top"))


@query("src4_json_payload_shapes", "SRC4", """
select event_id, id from (select event_id, unnest([1, 2]) id from events where event_id % 3 = 0 union all select event_id, 7 from events where event_id % 3 = 1
 union all select event_id, event_id % 5 from events where event_id % 3 = 2)""".replace("event_id % 5 from", "(event_id % 5)::INTEGER from"))
def _(t):
    payload = F.when(F.col("event_id") % 3 == 0, '[{"id":1},{"id":2}]').when(F.col("event_id") % 3 == 1, '{"data":[{"id":7}]}') \
        .otherwise(F.format_string('{"id":%d}', F.col("event_id") % 5))
    return records_from_json(t.events.select("event_id", payload.alias("payload")), "payload", "struct<id:int>")


@query("fn16_math", "FN16 FN17", """
select event_id, round(sqrt(value), 6) root, round(ln(value), 6) lg, round(exp(-value / 100), 6) decay, round(power(value, 0.3), 6) pw, least(greatest(value, 5), 60) clamped, false odd from events""")
def _(t):
    v = F.col("value")
    return t.events.select("event_id", F.round(F.sqrt(v), 6).alias("root"), F.round(F.log(v), 6).alias("lg"), F.round(F.exp(-v / 100), 6).alias("decay"),
                           F.round(F.pow(v, F.lit(0.3)), 6).alias("pw"), clamp(v, 5.0, 60.0).alias("clamped"), sc.not_finite(v).alias("odd"))


@query("fn18_masking", "FN18", """
select c_custkey, 'tok_' || sha256(c_name) token, '***MASKED***' redacted,
 regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') masked from customer""")
def _(t):
    return t.customer.select("c_custkey", sc.masked("c_name", "tokenize").alias("token"), sc.masked("c_name", "mask").alias("redacted"),
                             sc.masked("c_name", "shape").alias("masked"))


@query("fn19_scaling", "FN19", """
with s as (select min(l_quantity) a, max(l_quantity) b, avg(l_extendedprice) m, stddev(l_extendedprice) d from lineitem)
select l_orderkey, l_linenumber, l_partkey, round((l_quantity - a) / (b - a), 6) l_quantity_normalized, round((l_extendedprice - m) / d, 6) l_extendedprice_normalized from lineitem, s""")
def _(t):
    d = lake.normalize(lake.normalize(t.lineitem, ["l_quantity"]), ["l_extendedprice"], "z_score")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity_normalized", 6).alias("l_quantity_normalized"),
                    F.round("l_extendedprice_normalized", 6).alias("l_extendedprice_normalized"))


@query("fn20_encodings", "FN20", """
select c_custkey, (c_mktsegment = 'BUILDING')::INTEGER "c_mktsegment_BUILDING", (c_mktsegment = 'FURNITURE')::INTEGER "c_mktsegment_FURNITURE",
 (case when c_acctbal < 0 then 0 when c_acctbal >= 10000 then 11 else floor(c_acctbal / 1000) + 1 end)::BIGINT bucket from customer""")
def _(t):
    d = sc.one_hot(t.customer, "c_mktsegment", ["BUILDING", "FURNITURE"])
    return d.select("c_custkey", "c_mktsegment_BUILDING", "c_mktsegment_FURNITURE", sc.value_bucket("c_acctbal", 0, 10_000, 10).alias("bucket"))


@query("fn21_statistic_fills", "FN21", """
with g as (select event_id, case when event_id % 4 <> 0 then value end v, case when event_id % 4 <> 0 then event_type end et from events)
select event_id, round(coalesce(v, (select avg(v) from g)), 6) by_mean, round(coalesce(v, (select median(v) from g)), 6) by_median,
 coalesce(et, (select et from g where et is not null group by et order by count(*) desc, et desc limit 1)) by_mode from g""")
def _(t):
    g = t.events.select("event_id", F.expr("case when event_id % 4 <> 0 then value end").alias("by_mean"), F.expr("case when event_id % 4 <> 0 then value end").alias("by_median"),
                        F.expr("case when event_id % 4 <> 0 then event_type end").alias("by_mode"))
    d = sc.fill_missing(sc.fill_missing(sc.fill_missing(g, "by_mean", "mean"), "by_median", "median"), "by_mode", "mode")
    return d.withColumns({"by_mean": F.round("by_mean", 6), "by_median": F.round("by_median", 6)})


@query("fn21_drop_nulls", "FN21", """
select count(*) n from (select case when c_acctbal > 0 then 1 end a, case when c_nationkey > 5 then 1 end b from customer) where a is not null and b is not null""")
def _(t):
    d = t.customer.select(F.expr("case when c_acctbal > 0 then 1 end").alias("a"), F.expr("case when c_nationkey > 5 then 1 end").alias("b"))
    return lake.remove_nulls(d, how="any").agg(F.count(F.lit(1)).alias("n"))


@query("fn22_hash_sample", "FN22")
def _(t):
    return sc.hash_sample(t.lineitem, "l_orderkey", 0.1).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
