"""Aggregation and OLAP queries."""

from pyspark.sql import functions as F

from marlstone.functions.columns import micros
from marlstone.operators import aggregates as agg
from marlstone.operators import lake, market
from marlstone.plans.derived import (n_rows, DAILY_SQL, EVENTS_NOW, HOURLY_SQL, SQL_K, TRADES_SQL, daily, hourly, k_of, trades)
from marlstone.plans.registry import query



@query("agg1_configured_group", "AGG1", """
select l_returnflag, round(sum(l_quantity), 2) l_quantity_sum, round(avg(l_discount), 6) l_discount_avg,
       count(l_tax) l_tax_count, min(l_shipdate)::VARCHAR l_shipdate_min, max(l_extendedprice) l_extendedprice_max,
       array_to_string(list_sort(list(distinct l_linestatus)), ',') l_linestatus_set from lineitem group by l_returnflag""")
def _(t):
    df = lake.aggregate(t.lineitem, ["l_returnflag"], {
        "l_quantity": "sum", "l_discount": ["avg"], "l_tax": "count", "l_shipdate": "min", "l_extendedprice": "max",
        "l_linestatus": "collect_set"})
    return df.withColumns({"l_quantity_sum": F.round("l_quantity_sum", 2), "l_discount_avg": F.round("l_discount_avg", 6),
                           "l_shipdate_min": F.date_format("l_shipdate_min", "yyyy-MM-dd HH:mm:ss"),
                           "l_linestatus_set": F.array_join("l_linestatus_set", ",")})


@query("agg3_time_buckets", "AGG3 STR2 FN3", """
select event_type, epoch_us(time_bucket(interval 6 hour, ts)) window_start, epoch_us(time_bucket(interval 6 hour, ts)) + 21600000000 window_end,
       round(sum(value), 4) value_sum, count(value) value_count from events group by all""")
def _(t):
    df = lake.time_series(t.events, "ts", "6 hours", ["event_type"], {"value": ["sum", "count"]})
    return df.withColumns({"window_start": micros("window_start"), "window_end": micros("window_end"),
                           "value_sum": F.round("value_sum", 4)})


@query("agg4_olap_group", "AGG4", """
select date_trunc('month', o_orderdate)::VARCHAR bucket, o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) o_totalprice
from orders where o_orderpriority in ('1-URGENT', '5-LOW') and o_orderdate >= TIMESTAMP '1996-01-01' and o_orderdate < TIMESTAMP '1998-01-01' group by all""")
def _(t):
    df = agg.olap(t.orders, "o_orderdate", ["o_totalprice"], ["o_orderstatus", "o_orderpriority"],
                  {"o_orderpriority": ["1-URGENT", "5-LOW"]}, ("1996-01-01 00:00:00", "1998-01-01 00:00:00"), "month")
    return df.withColumns({"bucket": F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"), "o_totalprice": F.round("o_totalprice", 2)})


@query("agg4_olap_rollup", "AGG4", """
select coalesce(l_returnflag, '*') l_returnflag, coalesce(l_linestatus, '*') l_linestatus, round(sum(l_quantity), 2) l_quantity
from lineitem group by rollup (l_returnflag, l_linestatus)""")
def _(t):
    df = agg.olap(t.lineitem, "l_shipdate", ["l_quantity"], ["l_returnflag", "l_linestatus"], grouping="rollup")
    return df.select(F.coalesce("l_returnflag", F.lit("*")).alias("l_returnflag"),
                     F.coalesce("l_linestatus", F.lit("*")).alias("l_linestatus"), F.round("l_quantity", 2).alias("l_quantity"))


@query("agg4_olap_cube", "AGG4", """
select coalesce(c_mktsegment, '*') c_mktsegment, coalesce(c_nationkey, -1) c_nationkey, round(sum(c_acctbal), 2) c_acctbal
from customer group by cube (c_mktsegment, c_nationkey)""")
def _(t):
    df = agg.olap(t.customer, "c_custkey", ["c_acctbal"], ["c_mktsegment", "c_nationkey"], grouping="cube")
    return df.select(F.coalesce("c_mktsegment", F.lit("*")).alias("c_mktsegment"),
                     F.coalesce("c_nationkey", F.lit(-1)).alias("c_nationkey"), F.round("c_acctbal", 2).alias("c_acctbal"))


@query("agg5_pivot", "AGG5", """
select l_returnflag, round(sum(l_quantity) filter (l_linestatus = 'F'), 2) "F", round(sum(l_quantity) filter (l_linestatus = 'O'), 2) "O"
from lineitem group by l_returnflag""")
def _(t):
    df = agg.pivot_cube(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity")
    return df.withColumns({c: F.round(c, 2) for c in ("F", "O")})


@query("agg6_timeseries", "AGG6 FN6", """
select date_trunc('hour', ts)::VARCHAR bucket, event_type, round(avg(value), 6) value from events group by all""")
def _(t):
    df = agg.timeseries(t.events, "ts", "value", "avg", "hour", ["event_type"])
    return df.withColumns({"bucket": F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"), "value": F.round("value", 6)})


@query("agg7_top_n", "AGG7", """
select l_suppkey, round(v, 2) l_quantity from (select l_suppkey, sum(l_quantity) v from lineitem group by 1 order by v desc, l_suppkey limit 10)""")
def _(t):
    return agg.top_n(t.lineitem, "l_suppkey", "l_quantity", 10).withColumn("l_quantity", F.round("l_quantity", 2))


@query("agg8_distinct_per_window", "AGG8 AGG10", """
select epoch_us(time_bucket(interval 1 day, ts)) window_start, event_type, count(*) event_count, count(distinct user_id) distinct_user_id
from events group by all""")
def _(t):
    return agg.distinct_per_window(t.events, "ts", "1 day", ["event_type"], ["user_id"]) \
        .withColumn("window_start", micros("window_start"))


@query("agg9_conditional_counts", "AGG9", """
select user_id, count(case when event_type = 'error' then 1 end) errors, count(case when value > 100 then 1 end) large, count(*) total
from events group by user_id""")
def _(t):
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"),
                                           F.count(F.when(F.col("value") > 100, 1)).alias("large"), n_rows().alias("total"))


@query("agg11_field_averages", "AGG11 UDF4", f"""
select event_type, field, round(avg(v), 6) mean, count(v) n from (
  select event_type, 'k' field, {SQL_K}::DOUBLE v from events union all select event_type, 'value', value from events) group by all""")
def _(t):
    m = t.events.select("event_type", F.create_map(F.lit("k"), k_of(t.events).cast("double"), F.lit("value"), F.col("value")).alias("f"))
    return agg.field_averages(m, ["event_type"], "f").withColumn("mean", F.round("mean", 6))


@query("agg12_ohlcv_bars", "AGG12", f"""with {TRADES_SQL}
select instrument, epoch_us(time_bucket(interval 4 hour, ts)) bar_start, arg_min(price, ts) "open", max(price) high, min(price) low,
       arg_max(price, ts) "close", sum(quantity) volume, count(*) trades, round(sum(price * quantity) / sum(quantity), 6) vwap,
       coalesce(sum(quantity) filter (side = 'buy'), 0) buy_volume, coalesce(sum(quantity) filter (side <> 'buy'), 0) sell_volume
from trades group by all""")
def _(t):
    df = market.ohlcv(trades(t), ["instrument"], "ts", "4h", "trade_id", side="side")
    return df.withColumns({"bar_start": micros("bar_start"), "vwap": F.round("vwap", 6)})


@query("agg12_weekly_and_monthly_bars", "AGG12", f"""with {TRADES_SQL}
select '1w' frame, instrument, epoch_us(date_trunc('week', ts)::TIMESTAMP) bar_start, count(*) trades, max(price) high from trades group by all
union all select '1M', instrument, epoch_us(date_trunc('month', ts)::TIMESTAMP), count(*), max(price) from trades group by all""")
def _(t):
    out = None
    for f in ("1w", "1M"):
        one = market.ohlcv(trades(t), ["instrument"], "ts", f, "trade_id").select(
            F.lit(f).alias("frame"), "instrument", micros("bar_start").alias("bar_start"), "trades", "high")
        out = one if out is None else out.unionByName(one)
    return out


@query("agg13_vwap", "AGG13", f"""with {TRADES_SQL}
select instrument, round(sum(price * quantity) / sum(quantity), 6) vwap, sum(quantity) volume from trades group by all""")
def _(t):
    return market.vwap(trades(t), ["instrument"]).withColumn("vwap", F.round("vwap", 6))


@query("agg14_twap", "AGG14", f"""with {TRADES_SQL},
 p as (select instrument, price, lead(price) over w np, (epoch_us(lead(ts) over w) - epoch_us(ts)) / 1e6 dt from trades window w as (partition by instrument order by ts, trade_id))
select instrument, round(sum((price + np) / 2 * dt) / sum(dt), 6) twap from p where dt is not null group by instrument""")
def _(t):
    return market.twap(trades(t), ["instrument"], "ts", "trade_id").withColumn("twap", F.round("twap", 6))


@query("agg15_volume_profile", "AGG15", f"""with {TRADES_SQL},
 s as (select instrument, min(price) lo, (max(price) - min(price)) / 20 step from trades group by 1),
 g as (select instrument, lo, step, unnest(range(20))::INTEGER "level" from s),
 f as (select t.instrument, least(floor((price - lo) / step), 19)::INTEGER "level", sum(quantity) volume, count(*) n from trades t join s on s.instrument = t.instrument group by all)
select g.instrument, g."level", round(lo + g."level" * step, 6) level_price, coalesce(volume, 0) volume, coalesce(n, 0) trades
from g left join f on f.instrument = g.instrument and f."level" = g."level" """)
def _(t):
    return market.volume_profile(trades(t), ["instrument"], 20).withColumn("level_price", F.round("level_price", 6))


@query("agg16_stats_24h", "AGG16", f"""with {TRADES_SQL},
 r as (select instrument, sum(quantity) volume, count(*) trades, max(price) high, min(price) low, arg_min(price, ts) f, arg_max(price, ts) last_price, sum(price * quantity) v
       from trades where ts > TIMESTAMP '{EVENTS_NOW}' - interval 24 hour group by 1)
select instrument, volume, trades, high, low, last_price, round(last_price / f - 1, 6) price_change, round(v / volume, 6) vwap, round(volume / trades, 6) avg_trade_size from r""")
def _(t):
    df = market.stats_24h(trades(t), ["instrument"], "ts", "trade_id", F.lit(EVENTS_NOW).cast("timestamp_ntz"))
    return df.withColumns({c: F.round(c, 6) for c in ("price_change", "vwap", "avg_trade_size")})


@query("agg17_confusion_matrix", "AGG17 ML9", """
select l.quality actual, (d.n_chars > 500)::INTEGER predicted, count(*) n, round(avg((l.quality = (d.n_chars > 500)::INTEGER)::INTEGER) , 6) hit_rate
from labels l join documents d on d.doc_id = l.doc_id group by all""")
def _(t):
    p = t.labels.join(t.documents, "doc_id").select(F.col("quality").alias("actual"), (F.col("n_chars") > 500).cast("int").alias("predicted"))
    hit = (F.col("actual") == F.col("predicted")).cast("int")
    return p.groupBy("actual", "predicted").agg(n_rows().alias("n"), F.round(F.avg(hit), 6).alias("hit_rate"))


@query("agg18_top_issues", "AGG18", """
with a as (select date_trunc('day', ts)::VARCHAR "day", user_id, value from events),
 items as (select "day", 'large' item from a where value > 100 union all select "day", 'small' from a where value < 10
   union all select "day", 'user' || user_id from a),
 c as (select * from (select "day", item, count(*) n from items group by all) qualify row_number() over (partition by "day" order by n desc, item) <= 5),
 l as (select "day", string_agg(item, ',' order by n desc, item) top_items from c group by 1),
 b as (select "day", round(avg(value), 6) average, count(*) assessments from a group by 1)
select b."day", average, assessments, top_items from b left join l on l."day" = b."day" """)
def _(t):
    a = t.events.select(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss").alias("day"), "value", F.array_compact(F.array(
        F.when(F.col("value") > 100, "large"), F.when(F.col("value") < 10, "small"),
        F.concat(F.lit("user"), "user_id"))).alias("items"))
    return agg.top_values_report(a, ["day"], "value", "items").withColumn("average", F.round("average", 6))


@query("agg19_score_summary", "AGG19", """
select event_type, count(*) n, round(avg(value), 6) mean, min(value) low, max(value) high, round(stddev(value), 6) spread from events group by 1""")
def _(t):
    return t.events.groupBy("event_type").agg(n_rows().alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"),
                                              F.max("value").alias("high"), F.round(F.stddev("value"), 6).alias("spread"))


@query("agg20_hourly_royalties", "AGG20", """
select user_id asset_id, epoch_us(time_bucket(interval 1 hour, ts)) window_start, round(sum(value * 0.05), 6) royalties, count(*) sales
from events where event_type = 'purchase' group by all""")
def _(t):
    sales = t.events.filter("event_type = 'purchase'")
    return sales.groupBy(F.col("user_id").alias("asset_id"), F.window("ts", "1 hour").alias("w")).agg(
        F.round(F.sum(F.col("value") * 0.05), 6).alias("royalties"), n_rows().alias("sales")) \
        .select("asset_id", micros("w.start").alias("window_start"), "royalties", "sales")


@query("agg21_market_imbalance", "AGG21", f"""with {TRADES_SQL},
 w as (select instrument, epoch_us(time_bucket(interval 5 minute, ts)) window_start, coalesce(sum(quantity) filter (side = 'buy'), 0) demand,
   coalesce(sum(quantity) filter (side = 'sell'), 0) supply from trades group by all)
select instrument, window_start, demand, supply, round((demand - supply) / (demand + supply), 6) imbalance from w""")
def _(t):
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("quantity")).otherwise(F.lit(0.0)))
    w = trades(t).groupBy("instrument", F.window("ts", "5 minutes").alias("w")).agg(side("buy").alias("demand"), side("sell").alias("supply"))
    return w.select("instrument", micros("w.start").alias("window_start"), "demand", "supply",
                    F.round((F.col("demand") - F.col("supply")) / (F.col("demand") + F.col("supply")), 6).alias("imbalance"))


@query("agg22_fraud_statistics", "AGG22", """
select event_type, epoch_us(time_bucket(interval 5 minute, ts)) window_start, count(*) n, round(sum(value), 4) total, round(avg(least(value / 100, 1)), 6) risk
from events group by all""")
def _(t):
    return t.events.groupBy("event_type", F.window("ts", "5 minutes").alias("w")).agg(
        n_rows().alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg(F.least(F.col("value") / 100, F.lit(1.0))), 6).alias("risk")) \
        .select("event_type", micros("w.start").alias("window_start"), "n", "total", "risk")


@query("agg23_liquidation_cascade", "AGG23", """
select event_type market, epoch_us(time_bucket(interval 6 hour, ts)) window_start, count(*) liquidations, round(sum(value), 4) total,
       case when count(*) > 20 then 'CRITICAL' else 'WARNING' end severity
from events group by all having count(*) > 10 or sum(value) > 1000000""")
def _(t):
    from marlstone.operators.risk import liquidation_cascades
    return liquidation_cascades(t.events, ["event_type"], "ts", "value", "6 hours").select(
        F.col("event_type").alias("market"), micros("window_start").alias("window_start"), "liquidations",
        F.round("total", 4).alias("total"), "severity")


@query("agg24_running_user_stats", "AGG24", f"""with {TRADES_SQL}
select trade_id, trader, count(*) over w trade_count, round(sum(price * quantity) over w, 4) volume, round(sum(price * quantity * 0.001) over w, 6) fees
from trades window w as (partition by trader order by ts, trade_id)""")
def _(t):
    from marlstone.operators.windows import running
    value = F.col("price") * F.col("quantity")
    out = running(trades(t), ["trader"], "ts", ["trade_id"], {
        "trade_count": ("count", value), "volume": ("sum", value), "fees": ("sum", value * 0.001)})
    return out.select("trade_id", "trader", "trade_count", F.round("volume", 4).alias("volume"), F.round("fees", 6).alias("fees"))


@query("agg25_typed_metrics", "AGG25", f"""
select epoch_us(time_bucket(interval 1 hour, ts)) window_start, count(*) window_event_count,
  round(coalesce(sum(value) filter (event_type = 'view'), 0) / greatest(1, count(*) filter (event_type = 'view')), 6) avg_residual,
  coalesce(min(value) filter (event_type = 'view'), 0) min_residual, coalesce(max(value) filter (event_type = 'view'), 0) max_residual,
  count(*) filter (event_type = 'view') domain_updates, coalesce(sum({SQL_K}) filter (event_type = 'click'), 0)::BIGINT agent_updates,
  count(*) filter (event_type = 'error') anomaly_count from events group by 1""")
def _(t):
    view, zero = F.col("event_type") == "view", F.lit(0.0)
    v = F.when(view, F.col("value"))
    return t.events.groupBy(F.window("ts", "1 hour").alias("w")).agg(
        n_rows().alias("window_event_count"),
        F.round(F.coalesce(F.sum(v), zero) / F.greatest(F.lit(1), F.count(v)), 6).alias("avg_residual"),
        F.coalesce(F.min(v), zero).alias("min_residual"), F.coalesce(F.max(v), zero).alias("max_residual"),
        F.count(v).alias("domain_updates"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "click", k_of(t.events))), F.lit(0)).alias("agent_updates"),
        F.count_if(F.col("event_type") == "error").alias("anomaly_count")) \
        .withColumn("window_start", micros("w.start")).drop("w")


@query("agg26_concentration", "AGG26", """
with s as (select l_returnflag, l_suppkey, sum(l_extendedprice) v from lineitem group by all)
select l_returnflag, round(sum(v * v) / (sum(v) * sum(v)), 9) hhi, count(*) participants from s group by 1""")
def _(t):
    return agg.concentration(t.lineitem, "l_suppkey", "l_extendedprice", ["l_returnflag"]).withColumn("hhi", F.round("hhi", 9))


@query("agg27_liquidity_score", "AGG27", """
with r as (select count(*) links, sum(l_quantity) vol from lineitem), p as (select count(*) n, count(*) filter (s_acctbal > 0) active from supplier)
select round(0.3 * least(active / 100, 1) + 0.4 * least(vol / 1000000, 1) + 0.3 * links / (n * (n - 1)), 6) liquidity, active, links from r, p""")
def _(t):
    return agg.liquidity_score(t.lineitem, t.supplier, "l_quantity", F.col("s_acctbal") > 0).withColumn("liquidity", F.round("liquidity", 6))


VOTES_SQL = f"""votes as (select date_trunc('week', ts)::VARCHAR proposal, user_id voter, ts, event_id, value tokens, value voting_power,
  case when event_type in ('view', 'click') then 'for' when event_type = 'error' then 'against' else 'abstain' end support, {SQL_K} * 10 AS held from events)"""


def votes(t):
    s = F.when(F.col("event_type").isin("view", "click"), "for").when(F.col("event_type") == "error", "against").otherwise("abstain")
    return t.events.select(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd HH:mm:ss").alias("proposal"), F.col("user_id").alias("voter"), "ts", "event_id",
                           F.col("value").alias("tokens"), F.col("value").alias("voting_power"), s.alias("support"), (k_of(t.events) * 10).alias("held"))


@query("agg28_simple_tally", "AGG28", f"""with {VOTES_SQL},
 a as (select proposal, coalesce(sum(voting_power) filter (support = 'for'), 0) f, coalesce(sum(voting_power) filter (support = 'against'), 0) g,
   coalesce(sum(voting_power) filter (support = 'abstain'), 0) h, count(distinct voter) unique_voters from votes group by 1)
select proposal, round(f, 4) votes_for, round(g, 4) votes_against, round(h, 4) votes_abstain, unique_voters, round(f / (f + g + h) * 100, 6) approval_percentage from a""")
def _(t):
    df = agg.simple_tally(votes(t))
    return df.withColumns({**{c: F.round(c, 4) for c in ("votes_for", "votes_against", "votes_abstain")}, "approval_percentage": F.round("approval_percentage", 6)})


@query("agg29_quadratic_tally", "AGG29", f"""with {VOTES_SQL},
 one as (select * from votes qualify row_number() over (partition by proposal, voter order by ts, event_id) = 1),
 p as (select *, case when tokens < 1 then 0 else floor(sqrt(tokens)) end::BIGINT pw from one)
select proposal, coalesce(sum(pw) filter (support = 'for'), 0)::BIGINT for_votes, coalesce(sum(pw) filter (support = 'against'), 0)::BIGINT against_votes, count(*) total_voters from p group by 1""")
def _(t):
    return agg.quadratic_tally(votes(t), "proposal", [F.col("ts"), F.col("event_id")])


@query("agg29_power_buckets", "AGG29", """
with p as (select case when c_acctbal < 1 then 0 else floor(sqrt(c_acctbal)) end power from customer)
select case when power < 10 then '0-10' when power < 100 then '10-100' when power < 1000 then '100-1K' when power < 10000 then '1K-10K' else '10K+' end bucket, count(*) n
from p where power > 0 group by 1""")
def _(t):
    p = t.customer.withColumn("power", agg.quadratic_power("c_acctbal")).filter("power > 0")
    return p.groupBy(agg.power_bucket(F.col("power")).alias("bucket")).agg(n_rows().alias("n"))


@query("agg30_time_weighted_votes", "AGG30", f"""with {VOTES_SQL},
 one as (select * from votes qualify row_number() over (partition by proposal, voter order by ts, event_id) = 1),
 m as (select *, 4.0 * (1 - exp(-ln(2.0) / 365 * held)) * case when held > 700 then exp(-(held - 700) / 365.0) else 1 end g from one)
select proposal, support, round(sum(tokens * case when held < 1 then 0 else greatest(1.0, g) end), 4) weighted, count(*) voters from m group by all""")
def _(t):
    one = agg.first_votes(votes(t), "proposal", [F.col("ts"), F.col("event_id")])
    m = agg.holding_multiplier(F.col("held").cast("double"), decay_after=700.0)
    return one.groupBy("proposal", "support").agg(F.round(F.sum(F.col("tokens") * m), 4).alias("weighted"), n_rows().alias("voters"))


@query("agg31_conviction_votes", "AGG31", f"""with {VOTES_SQL}
select proposal, round(sum(tokens * case when held <= 0 then 0 else least(10 * (1 - power(0.9, 0.5 * held)), 10) end), 4) conviction,
  count(*) filter (held > 0) stakers from votes group by 1""")
def _(t):
    c = agg.conviction_multiplier(F.col("held").cast("double"))
    return votes(t).groupBy("proposal").agg(F.round(F.sum(F.col("tokens") * c), 4).alias("conviction"), F.count_if(F.col("held") > 0).alias("stakers"))


@query("agg33_leaderboard", "AGG33 REC2", """
select user_id, n, rank() over (order by n desc)::INTEGER position from (select user_id, count(*) n from events where event_type = 'purchase' group by 1 order by n desc, user_id limit 25)""")
def _(t):
    from pyspark.sql import Window
    top = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(n_rows().alias("n")).orderBy(F.col("n").desc(), "user_id").limit(25)
    return top.withColumn("position", F.rank().over(Window.orderBy(F.col("n").desc())))


@query("agg34_alert_stats", "AGG34", """
with a as (select event_type, case when value > 80 then 'CRITICAL' when value > 40 then 'HIGH' else 'LOW' end severity, user_id from events)
select 'pattern' dimension, event_type "value", count(*) n from a group by all union all select 'severity', severity, count(*) from a group by all
union all (select 'entity', user_id::VARCHAR, count(*) n from a group by all order by n desc, user_id::VARCHAR limit 10)""")
def _(t):
    a = t.events.select(F.col("event_type").alias("pattern"), F.expr("case when value > 80 then 'CRITICAL' when value > 40 then 'HIGH' else 'LOW' end").alias("severity"),
                        F.col("user_id").alias("entity"))
    counts = agg.grouped_counts(a, ["pattern", "severity"])
    top = a.groupBy(F.col("entity").cast("string").alias("value")).agg(n_rows().alias("n")).orderBy(F.col("n").desc(), "value").limit(10)
    return counts.unionByName(top.withColumn("dimension", F.lit("entity")))


@query("agg35_table_quality", "AGG35", """
select 'events' table_name, count(*) total_records, count(*) filter (event_type is null) null_count, count(*) filter (value < 1) invalid_count,
  round((1 - (count(*) filter (event_type is null) + count(*) filter (value < 1)) / count(*)::DOUBLE) * 100, 6) quality_score from events""")
def _(t):
    return agg.table_quality(t.events, "events", F.col("event_type").isNull(), F.col("value") < 1).withColumn("quality_score", F.round("quality_score", 6))


@query("agg36_sla_compliance", "AGG36", f"""
with m as (select user_id, 99.85 + {SQL_K} / 500.0 uptime, value latency, 0.9 + {SQL_K} / 900.0 perf from events),
 a as (select user_id, avg(uptime) u, avg(latency) l, avg(perf) p, count(*) filter (uptime < 99.9) uptime_violations from m group by 1)
select user_id, round(u, 6) avg_uptime, round(l, 6) avg_latency, round(p, 6) avg_performance, uptime_violations,
  case when u >= 99.9 and l <= 50 and p >= 0.95 then 'COMPLIANT' else 'VIOLATION' end compliance_status from a""")
def _(t):
    m = t.events.select("user_id", (99.85 + k_of(t.events) / 500.0).alias("uptime"), F.col("value").alias("latency"), (0.9 + k_of(t.events) / 900.0).alias("perf"))
    df = agg.sla_compliance(m, ["user_id"], "uptime", "latency", "perf")
    return df.withColumns({c: F.round(c, 6) for c in ("avg_uptime", "avg_latency", "avg_performance")})


@query("agg37_merged_sources", "AGG37", """
with h as (select date_trunc('hour', ts)::VARCHAR bucket, value, 'h' s from events where ts < TIMESTAMP '2024-01-20 12:30:00'),
 r as (select date_trunc('hour', ts)::VARCHAR bucket, value, 'r' s from events where ts >= TIMESTAMP '2024-01-20 12:30:00')
select bucket, round(sum(value), 4) value, count(distinct s) sources from (from h union all from r) group by bucket""")
def _(t):
    def part(c):
        return t.events.filter(c).groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("bucket")).agg(F.sum("value").alias("value"))
    out = agg.merge_sources({"historical": part("ts < '2024-01-20 12:30:00'"), "realtime": part("ts >= '2024-01-20 12:30:00'")}, ["bucket"], ["value"])
    return out.withColumn("value", F.round("value", 4))


@query("agg38_platform_rollup", "AGG38 OPS7", f"""
with s as (select event_type service, count(*) activities, sum({SQL_K}) resources, case when event_type = 'error' then 'error' else 'ok' end status from events group by 1)
select sum(activities)::BIGINT total_platform_activities, sum(resources)::BIGINT total_resource_consumption, round(avg((status <> 'error')::INTEGER), 6) service_health_score from s""")
def _(t):
    s = t.events.groupBy(F.col("event_type").alias("service")).agg(n_rows().alias("activities"), F.sum(k_of(t.events)).alias("resources")) \
        .withColumn("status", F.when(F.col("service") == "error", "error").otherwise("ok"))
    return s.agg(F.sum("activities").alias("total_platform_activities"), F.sum("resources").alias("total_resource_consumption"),
                 F.round(F.avg((F.col("status") != "error").cast("int")), 6).alias("service_health_score"))


@query("agg39_anomaly_pivot", "AGG39", """
select event_type market, count(*) filter (value <= 100) normal, count(*) filter (value > 100) anomalous, round(avg((value > 100)::INTEGER), 6) anomaly_rate
from events group by 1""")
def _(t):
    p = t.events.withColumn("anomaly", (F.col("value") > 100).cast("int")).groupBy(F.col("event_type").alias("market")) \
        .pivot("anomaly", [0, 1]).agg(n_rows()).fillna(0)
    return p.select("market", F.col("0").alias("normal"), F.col("1").alias("anomalous"),
                    F.round(F.col("1") / (F.col("0") + F.col("1")), 6).alias("anomaly_rate"))


FEEDS_SQL = "feeds as (select date_trunc('day', ts)::VARCHAR asset, user_id source, 50 + value price, 0.5 + (user_id % 5) / 10.0 weight from events where event_type = 'purchase')"


def feeds(t):
    return t.events.filter("event_type = 'purchase'").select(
        F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss").alias("asset"), F.col("user_id").alias("source"),
        (50 + F.col("value")).alias("price"), (0.5 + (F.col("user_id") % 5) / 10.0).alias("weight"))


@query("agg40_robust_price", "AGG40", f"""with {FEEDS_SQL},
 m as (select asset, median(price) med, count(*) n from feeds group by 1),
 d as (select f.*, med, n, abs(price - med) dev from feeds f join m on m.asset = f.asset),
 q as (select asset, median(dev) mad from d group by 1),
 k as (select d.* from d join q on q.asset = d.asset where case when n < 4 then true when mad > 0 then 0.6745 * dev / mad < 3.5 else dev / med < 0.02 end),
 a as (select asset, sum(price * weight) / sum(weight) aggregated, count(*) sources, max(n) - count(*) outliers, avg(weight) w from k group by 1),
 s as (select k.asset, avg(abs(price - aggregated) / aggregated) spread from k join a on a.asset = k.asset group by 1)
select a.asset, round(aggregated, 6) aggregated, sources, outliers, round(least(least(sources / 5.0, 1) * greatest(1 - spread * 10, 0) * w, 0.99), 6) confidence
from a join s on s.asset = a.asset""")
def _(t):
    df = market.robust_price(feeds(t))
    return df.withColumns({"aggregated": F.round("aggregated", 6), "confidence": F.round("confidence", 6)})


@query("agg41_weighted_median", "AGG41", f"""with {FEEDS_SQL},
 p as (select asset, price, sum(weight) w from feeds group by all),
 c as (select *, sum(w) over (partition by asset order by price) cum, sum(w) over (partition by asset) total from p)
select asset, min(price) weighted_median from c where round(cum, 6) >= round(total / 2, 6) group by asset""")
def _(t):
    f = feeds(t).withColumn("weight", F.col("weight").cast("decimal(10,4)"))
    return market.weighted_median(f, ["asset"])


@query("agg42_collateral_value", "AGG42", """
with b as (select o_custkey user_id, o_orderstatus asset, round(sum(o_totalprice), 2) balance from orders group by all),
 p(asset, price) as (values ('O', 1), ('F', 2000), ('P', 0.5)), h(asset, haircut) as (values ('O', 0.95), ('F', 0.85), ('P', 0.75))
select user_id, round(sum(balance::DECIMAL(14,2) * price::DECIMAL(6,1) * haircut::DECIMAL(4,2)), 2)::DOUBLE collateral from b join p on p.asset = b.asset join h on h.asset = b.asset group by 1""")
def _(t):
    b = t.orders.groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("asset")).agg(F.round(F.sum("o_totalprice"), 2).alias("balance"))
    p = t.spark.createDataFrame([("O", "1"), ("F", "2000"), ("P", "0.5")], "asset string, price string")
    h = t.spark.createDataFrame([("O", "0.95"), ("F", "0.85"), ("P", "0.75")], "asset string, haircut string")
    return market.collateral_value(b, p, h).withColumn("collateral", F.round("collateral", 2).cast("double"))


@query("agg43_asset_statistics", "AGG43", """
with s as (select p_type, p_brand, p_retailprice from part)
select coalesce(p_type, '*') p_type, coalesce(p_brand, '*') p_brand, count(*) n, round(sum(p_retailprice), 2) total, round(avg(p_retailprice), 6) mean
from s group by grouping sets ((p_type), (p_brand), ())""")
def _(t):
    p = t.part.withColumns({"g_type": F.col("p_type"), "g_brand": F.col("p_brand")})
    g = p.groupingSets([["p_type"], ["p_brand"], []], "p_type", "p_brand").agg(
        n_rows().alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"), F.round(F.avg("p_retailprice"), 6).alias("mean"))
    return g.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("p_type", "p_brand")})


@query("agg44_cost_report", "AGG44", """
with u as (select l_suppkey service, 1 + count(*) % 8 cpu, sum(l_quantity) / 1000 mem, 1 + l_suppkey % 3 replicas, count(*) / 10.0 rate from lineitem group by 1),
 c as (select service, ((cpu * 0.05 + mem * 0.01) * replicas + rate * 3600 * 1024 / 1073741824.0 * 0.09) * 24 cost from u)
select service, round(cost, 6) daily_cost, (cost > 12) over_budget from c""")
def _(t):
    u = t.lineitem.groupBy(F.col("l_suppkey").alias("service")).agg(
        (1 + n_rows() % 8).alias("cpu"), (F.sum("l_quantity") / 1000).alias("mem"), (n_rows() / 10.0).alias("rate")) \
        .withColumn("replicas", 1 + F.col("service") % 3)
    cost = agg.hourly_cost(F.col("cpu"), F.col("mem"), F.col("replicas"), F.col("rate")) * 24
    return u.select("service", F.round(cost, 6).alias("daily_cost"), (cost > 12).alias("over_budget"))
