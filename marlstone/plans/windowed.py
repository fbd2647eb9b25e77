"""Window analytics on hourly and event series."""

from pyspark.sql import functions as F

from marlstone.functions.columns import micros
from marlstone.functions.quantiles import exact_quantiles
from marlstone.operators import market
from marlstone.operators.windows import fill_series, range_frame, rows_frame, sliding_summaries
from marlstone.plans.derived import HOURLY_SQL, SQL_K, TRADES_SQL, hourly, k_of, trades
from marlstone.plans.registry import query


def rounded(df, names, places=6):
    return df.withColumns({c: F.round(c, places) for c in names})


@query("win2_returns_and_volatility", "WIN2 WIN3 WIN4", f"""with {HOURLY_SQL},
 r as (select *, price / lag(price) over w - 1 returns, ln(price / lag(price) over w) log_returns from hourly window w as (partition by market order by ts))
select market, epoch_us(ts) ts, round(returns, 6) returns, round(log_returns, 6) log_returns,
 round(stddev(returns) over (w rows between 24 preceding and 1 preceding) * sqrt(24), 6) volatility_24,
 round(stddev(returns) over (w rows between 168 preceding and 1 preceding) * sqrt(24), 6) volatility_168,
 round(stddev(returns) over (w rows between 1 following and 24 following) * sqrt(24), 6) target_volatility
from r window w as (partition by market order by ts)""")
def _(t):
    df = market.return_volatility(hourly(t), "market", "ts", "price", (24, 168))
    cols = ["returns", "log_returns", "volatility_24", "volatility_168", "target_volatility"]
    return rounded(df.select("market", micros("ts").alias("ts"), *cols), cols)


@query("win5_technical_indicators", "WIN5 WIN6 WIN7 WIN8 WIN9", f"""with {HOURLY_SQL},
 c as (select *, price - lag(price) over (partition by market order by ts) price_change from hourly),
 f as (select market, ts, avg(price) over (w rows between 24 preceding and 1 preceding) ma_24, avg(price) over (w rows between 48 preceding and 1 preceding) ma_48,
  avg(price) over (w rows between 168 preceding and 1 preceding) ma_168,
  avg(case when price_change > 0 then price_change else 0 end) over (w rows between 14 preceding and 1 preceding) g,
  avg(case when price_change < 0 then -price_change else 0 end) over (w rows between 14 preceding and 1 preceding) l,
  avg(price) over (w rows between 20 preceding and 1 preceding) bb, stddev(price) over (w rows between 20 preceding and 1 preceding) sd,
  volume / nullif(avg(volume) over (w rows between 24 preceding and 1 preceding), 0) volume_ratio, trades / nullif(volume, 0) trade_intensity,
  lead(price) over w p1, lead(price, 4) over w p4, lead(price, 24) over w p24 from c window w as (partition by market order by ts))
select market, epoch_us(ts) ts, round(ma_24, 6) ma_24, round(ma_48, 6) ma_48, round(ma_168, 6) ma_168, round(100 - 100 / (1 + g / nullif(l, 0)), 5) rsi,
 round(bb + 2 * sd, 6) bb_upper, round(bb - 2 * sd, 6) bb_lower, round(volume_ratio, 6) volume_ratio, round(trade_intensity, 6) trade_intensity,
 round(p1, 6) price_1h, round(p4, 6) price_4h, round(p24, 6) price_24h from f""")
def _(t):
    df = market.technical_indicators(hourly(t), "market", "ts", "price")
    cols = ["ma_24", "ma_48", "ma_168", "bb_upper", "bb_lower", "volume_ratio", "trade_intensity"]
    return rounded(df.select("market", micros("ts").alias("ts"), *cols, F.round("rsi", 5).alias("rsi"), "price_1h", "price_4h", "price_24h"), [*cols, "price_1h", "price_4h", "price_24h"])


@query("win10_funding_features", "WIN10", f"""with {HOURLY_SQL},
 f as (select market, ts, price mark_price, high + 1 index_price, trades * 3.0 ol, trades + volume os, volume bv, price sv, (price - 50) / 1000 fr from hourly)
select market, epoch_us(ts) ts, round((mark_price - index_price) / index_price, 6) premium_index, round(ol / (ol + os), 6) open_interest_ratio,
 round((bv - sv) / (bv + sv), 6) volume_imbalance, round(avg(fr) over (w rows between 8 preceding and 1 preceding), 6) funding_rate_ma_8h,
 round(avg(fr) over (w rows between 24 preceding and 1 preceding), 6) funding_rate_ma_24h,
 round(stddev(mark_price) over (w rows between 24 preceding and 1 preceding) / avg(mark_price) over (w rows between 24 preceding and 1 preceding), 6) volatility,
 round(lead(fr) over w, 9) next_funding_rate from f window w as (partition by market order by ts)""")
def _(t):
    f = hourly(t).select("market", "ts", F.col("price").alias("mark_price"), (F.col("high") + 1).alias("index_price"),
                         (F.col("trades") * 3.0).alias("open_interest_long"), (F.col("trades") + F.col("volume")).alias("open_interest_short"),
                         F.col("volume").alias("buy_volume"), F.col("price").alias("sell_volume"), ((F.col("price") - 50) / 1000).alias("funding_rate"))
    df = market.funding_features(f, "market", "ts")
    cols = ["premium_index", "open_interest_ratio", "volume_imbalance", "funding_rate_ma_8h", "funding_rate_ma_24h", "volatility"]
    return rounded(df.select("market", micros("ts").alias("ts"), *cols, F.round("next_funding_rate", 9).alias("next_funding_rate")), cols)


@query("win11_rolling_zscores", "WIN11", f"""with {HOURLY_SQL}
select market, epoch_us(ts) ts,
 round((volume - avg(volume) over w) / nullif(round(stddev(volume) over w, 12), 0), 5) volume_zscore,
 round((price - avg(price) over w) / nullif(round(stddev(price) over w, 12), 0), 5) price_zscore
from hourly window w as (partition by market order by ts rows between 168 preceding and 1 preceding)""")
def _(t):
    df = market.rolling_zscores(hourly(t), "market", "ts", ["volume", "price"])
    return rounded(df.select("market", micros("ts").alias("ts"), "volume_zscore", "price_zscore"), ["volume_zscore", "price_zscore"], 5)


@query("win12_range_counts", "WIN12", """
select event_id, count(*) over (partition by user_id order by ts range between interval 5 hour preceding and current row) recent,
 count(*) over (partition by user_id, event_type order by ts range between interval 24 hour preceding and current row) same_type from events""")
def _(t):
    e = range_frame(t.events, ["user_id"], "ts", lambda w: {"recent": F.count(F.lit(1)).over(w.rangeBetween(-5 * 3_600_000_000, 0))}, before=5 * 3600)
    e = range_frame(e, ["user_id", "event_type"], "ts", lambda w: {"same_type": F.count(F.lit(1)).over(w.rangeBetween(-86_400_000_000, 0))}, before=86_400)
    return e.select("event_id", "recent", "same_type")


@query("win13_rolling_maintenance_features", "WIN13", f"""with {HOURLY_SQL},
 r as (select *, avg(price) over w m, stddev(price) over w s, avg(volume) over w ev from hourly window w as (partition by market order by ts rows between 23 preceding and current row))
select market, epoch_us(ts) ts, round(m, 6) rolling_mean, round(s, 6) rolling_std, round(price / m, 6) efficiency, (volume > 2 * ev) error_spike from r""")
def _(t):
    from marlstone.operators.timeseries import maintenance_features
    df = maintenance_features(hourly(t), ["market"], "ts", "price", "volume")
    return rounded(df.select("market", micros("ts").alias("ts"), "rolling_mean", "rolling_std", "efficiency", "error_spike"),
                   ["rolling_mean", "rolling_std", "efficiency"])


@query("win14_horizon_summaries", "WIN14", """
select event_id, round(avg(value) over h1, 6) mean_1h, round(avg(value) over h6, 6) mean_6h, min(value) over h6 low_6h, max(value) over h6 high_6h, median(value) over h6 median_6h
from events window h1 as (partition by event_type order by ts range between interval 1 hour preceding and current row),
 h6 as (partition by event_type order by ts range between interval 6 hour preceding and current row)""")
def _(t):
    h1, h6 = 3600, 6 * 3600
    df = sliding_summaries(t.events, ["event_type"], "ts", "value", {"mean_1h": ("mean", h1), "mean_6h": ("mean", h6), "low_6h": ("min", h6), "high_6h": ("max", h6),
                                                                   "median_6h": ("median", h6)}, ["event_id"])
    return rounded(df.select("event_id", "mean_1h", "mean_6h", "low_6h", "high_6h", "median_6h"), ["mean_1h", "mean_6h"])


@query("win15_drawdown", "WIN15", f"""with {HOURLY_SQL},
 r as (select market, ts, (price - 50) / 500 ret from hourly),
 c as (select market, ts, exp(sum(ln(1 + ret)) over (partition by market order by ts)) cum from r),
 d as (select market, ts, cum / max(cum) over (partition by market order by ts) - 1 dd from c)
select market, round(min(dd), 6) max_drawdown, round(arg_max(dd, ts), 6) current_drawdown from d group by 1""")
def _(t):
    from marlstone.operators.risk import drawdown
    r = hourly(t).select("market", "ts", ((F.col("price") - 50) / 500).alias("ret"))
    return rounded(drawdown(r, ["market"], "ts", "ret"), ["max_drawdown", "current_drawdown"])


@query("win16_price_manipulation", "WIN16 FRD2", """
with r as (select event_id, event_type, value, count(*) over w n, avg(value) over w m from events window w as (partition by event_type order by ts rows between unbounded preceding and 1 preceding))
select event_id, event_type, n prior_count, round(m, 6) prior_mean from r where n > 10 and value > 3 * m""")
def _(t):
    df = market.price_spikes(t.events, ["event_type"], "ts", "event_id", "value")
    return df.select("event_id", "event_type", "prior_count", F.round("prior_mean", 6).alias("prior_mean"))


@query("win17_rapid_transfers", "WIN17 FRD4", """
with b as (select * from events where value > 20),
 r as (select event_id, user_id, value, ts, count(*) over w prior, coalesce(sum(value) over w, 0) + value total, first(ts) over w f
  from b window w as (partition by user_id order by ts, event_id rows between 20 preceding and 1 preceding))
select event_id, user_id, prior, round(total, 4) total_value from r where prior > 2 and total > 100 and epoch_us(ts) - epoch_us(f) < 2 * 86400000000""")
def _(t):
    df = market.rapid_transfers(t.events, ["user_id"], "ts", "event_id", "value", 20, 100, 20, 2, 2 * 86_400)
    return df.select("event_id", "user_id", "prior", F.round("total_value", 4).alias("total_value"))


@query("win18_gaps", "WIN18", """
select event_id, user_id, round((epoch_us(ts) - epoch_us(p)) / 3.6e9, 6) gap_hours from (select *, lag(ts) over (partition by user_id order by ts) p from events)
where epoch_us(ts) - epoch_us(p) > 2 * 3600000000""")
def _(t):
    df = rows_frame(t.events, ["user_id"], "ts", ["event_id"], lambda w: {"p": F.lag("ts").over(w)}, before=1)
    gap = micros("ts") - micros("p")
    return df.filter(gap > 2 * 3_600_000_000).select("event_id", "user_id", F.round(gap / 3.6e9, 6).alias("gap_hours"))


@query("win19_alert_trend", "WIN19 STR13", """
with h as (select user_id, date_trunc('hour', ts)::TIMESTAMP hr, count(*) n from events where event_type in ('error', 'signup') group by all),
 l as (select *, lag(n) over w a, lag(n, 2) over w b from h window w as (partition by user_id order by hr))
select user_id, epoch_us(hr) hr, n, case when n > a and a > b then 'INCREASING' when n < a and a < b then 'DECREASING' else 'STABLE' end trend from l""")
def _(t):
    from marlstone.operators.cep import alert_trend
    a = t.events.filter("event_type in ('error', 'signup')")
    return alert_trend(a, ["user_id"], "ts").select("user_id", micros("hour").alias("hr"), "n", "trend")


@query("win20_repeat_pattern", "WIN20", """
select event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id, event_type order by ts)) < 3600000000, false) is_repeat from events""")
def _(t):
    from marlstone.operators.cep import repeats
    return repeats(t.events, ["user_id", "event_type"], "ts", "event_id", 3600).select("event_id", "is_repeat")


@query("win21_latency_percentiles", "WIN21", """
select event_type, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99 from events group by 1""")
def _(t):
    return rounded(exact_quantiles(t.events, ["event_type"], F.col("value"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, few_keys=True), ["p50", "p95", "p99"])


@query("win22_liquidation_features", "WIN22 RSK9", f"""
with p as (select event_id, case when event_id % 2 = 0 then 'LONG' else 'SHORT' end side, value mark, 40.0 entry, 10.0 + {SQL_K} / 10.0 liq, {SQL_K} / 4.0 leverage, value / 100 vol from events)
select event_id, round(case when side = 'LONG' then (mark - liq) / nullif(entry - liq, 0) else (liq - mark) / nullif(liq - entry, 0) end, 6) health_factor,
 round(abs(mark - liq) / mark, 6) distance_to_liquidation, case when leverage <= 5 then 'low' when leverage <= 20 then 'medium' else 'high' end leverage_bucket,
 round(abs(mark - liq) / mark / vol, 4) volatility_adjusted_distance, round(leverage / 500, 6) position_size_ratio from p""")
def _(t):
    e = t.events
    p = e.select("event_id", F.when(F.col("event_id") % 2 == 0, "LONG").otherwise("SHORT").alias("side"), F.col("value").alias("mark_price"),
                 F.lit(40.0).alias("entry_price"), (10.0 + k_of(e) / 10.0).alias("liquidation_price"), (k_of(e) / 4.0).alias("leverage"),
                 (F.col("value") / 100).alias("market_volatility"), (k_of(e) / 4.0).alias("position_size"), F.lit(500.0).alias("market_open_interest"))
    df = market.liquidation_features(p)
    out = df.select("event_id", "health_factor", "distance_to_liquidation", "leverage_bucket",
                    F.round("volatility_adjusted_distance", 4).alias("volatility_adjusted_distance"), "position_size_ratio")
    return rounded(out, ["health_factor", "distance_to_liquidation", "position_size_ratio"])


@query("ts14_market_anomalies", "TS14", f"""with {TRADES_SQL},
 b as (select instrument, time_bucket(interval 4 hour, ts) bar, arg_min(price, ts) o, max(price) h, min(price) l, arg_max(price, ts) c, sum(quantity) volume from trades group by all),
 r as (select *, h - l spread, count(*) over w n, avg(volume) over w vm, stddev_pop(volume) over w vs, avg(h - l) over w sm, stddev_pop(h - l) over w ss from b
   window w as (partition by instrument order by bar)),
 x as (select instrument, bar, 'VOLUME_SPIKE' anomaly_type from r where n >= 10 and volume > vm + 3 * vs
  union all select instrument, bar, 'PRICE_MOVEMENT' from r where n >= 10 and abs(c - o) / o > 0.1
  union all select instrument, bar, 'SPREAD_WIDENING' from r where n >= 10 and spread > sm + 2.5 * ss)
select instrument, epoch_us(bar) bar_start, anomaly_type from x""")
def _(t):
    bars = market.ohlcv(trades(t), ["instrument"], "ts", "4h", "trade_id")
    return market.market_anomalies(bars, ["instrument"], "bar_start").withColumn("bar_start", micros("bar_start"))


@query("fn21_forward_fill", "FN21", """
select event_id, last_value(case when event_id % 3 = 0 then value end ignore nulls) over (partition by event_type order by ts) filled from events""")
def _(t):
    e = t.events.select("event_id", "event_type", "ts", F.expr("case when event_id % 3 = 0 then value end").alias("filled"))
    return fill_series(e, ["event_type"], "ts", ["event_id"], "filled").select("event_id", "filled")


@query("fn21_interpolate", "FN21", """
with e as (select event_id, event_type, epoch_us(ts) us, case when event_id % 3 = 0 then value end v from events),
 n as (select *, last_value(v ignore nulls) over a pv, last_value(case when v is not null then us end ignore nulls) over a pt,
  last_value(v ignore nulls) over b nv, last_value(case when v is not null then us end ignore nulls) over b nt
  from e window a as (partition by event_type order by us), b as (partition by event_type order by us desc))
select event_id, round(coalesce(v, pv + (nv - pv) * ((us - pt) / nullif((nt - pt)::DOUBLE, 0))), 6) filled from n""")
def _(t):
    e = t.events.select("event_id", "event_type", "ts", F.expr("case when event_id % 3 = 0 then value end").alias("filled"))
    return fill_series(e, ["event_type"], "ts", ["event_id"], "filled", "linear").select("event_id", F.round("filled", 6).alias("filled"))
