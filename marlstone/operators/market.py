"""Market series: bars, weighted prices, indicators, profiles and price aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.columns import ladder, micros, null_safe_join, ratio
from marlstone.functions.quantiles import exact_quantiles
from marlstone.operators.windows import (range_frame, rows_frame, running, running_moments, value_slices)

#: Bar widths by frame name.
FRAMES = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours",
          "1d": "1 day", "1w": "1 week", "1M": "month"}


def bar_start(ts: str, frame: str) -> Column:
    if frame == "1M":
        return F.date_trunc("month", ts)
    offset = "4 days" if frame == "1w" else None  # weeks start on Monday, the epoch was a Thursday
    return F.window(ts, FRAMES[frame], None, offset)["start"] if offset else F.window(ts, FRAMES[frame])["start"]


def ohlcv(trades: DataFrame, keys: list[str], ts: str, frame: str, ident: str, price: str = "price",
          quantity: str = "quantity", side: str | None = None) -> DataFrame:
    """Open, high, low, close, volume, VWAP and trade count per bar; open and close by (time, id)."""
    order = F.struct(F.col(ts), F.col(ident))
    extra = [] if side is None else [
        F.sum(F.when(F.col(side) == "buy", F.col(quantity)).otherwise(F.lit(0.0))).alias("buy_volume"),
        F.sum(F.when(F.col(side) != "buy", F.col(quantity)).otherwise(F.lit(0.0))).alias("sell_volume")]
    return trades.groupBy(*keys, bar_start(ts, frame).alias("bar_start")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(quantity).alias("volume"), F.count(F.lit(1)).alias("trades"),
        (F.sum(F.col(price) * F.col(quantity)) / F.nullif(F.sum(quantity), F.lit(0.0))).alias("vwap"), *extra)


def vwap(trades: DataFrame, keys: list[str], price: str = "price", quantity: str = "quantity") -> DataFrame:
    return trades.groupBy(*keys).agg(
        (F.sum(F.col(price) * F.col(quantity)) / F.nullif(F.sum(quantity), F.lit(0.0))).alias("vwap"),
        F.sum(quantity).alias("volume"))


def twap(samples: DataFrame, keys: list[str], ts: str, ident: str, price: str = "price") -> DataFrame:
    """Time-weighted mean with the trapezoid rule between consecutive samples."""
    pairs = rows_frame(samples, keys, ts, [ident], lambda w: {
        "_next_ts": F.lead(ts).over(w), "_next_price": F.lead(price).over(w)}, after=1)
    dt = (micros("_next_ts") - micros(ts)) / 1_000_000.0
    mid = (F.col(price) + F.col("_next_price")) / 2
    return pairs.groupBy(*keys).agg((F.sum(mid * dt) / F.nullif(F.sum(dt), F.lit(0.0))).alias("twap"))


def volume_profile(trades: DataFrame, keys: list[str], levels: int = 50, price: str = "price",
                   quantity: str = "quantity") -> DataFrame:
    """Volume and trades per price level, empty levels included; the top price falls into the last level."""
    span = trades.groupBy(*keys).agg(F.min(price).alias("_lo"), F.max(price).alias("_hi"))
    span = span.withColumn("_step", (F.col("_hi") - F.col("_lo")) / levels)
    raw = F.floor((F.col(price) - F.col("_lo")) / F.nullif(F.col("_step"), F.lit(0.0)))
    level = F.coalesce(F.least(raw, F.lit(levels - 1)), F.lit(0)).cast("int")
    filled = null_safe_join(trades, span, keys).groupBy(*keys, level.alias("level")).agg(
        F.sum(quantity).alias("volume"), F.count(F.lit(1)).alias("trades"))
    grid = span.select(*keys, "_lo", "_step", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    return null_safe_join(grid, filled, [*keys, "level"], "left").select(
        *keys, "level", (F.col("_lo") + F.col("level") * F.col("_step")).alias("level_price"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("trades", F.lit(0)).alias("trades"))


def stats_24h(trades: DataFrame, keys: list[str], ts: str, ident: str, now: Column, price: str = "price",
              quantity: str = "quantity") -> DataFrame:
    order = F.struct(F.col(ts), F.col(ident))
    recent = trades.filter(F.col(ts) > now - F.expr("interval 24 hours"))
    out = recent.groupBy(*keys).agg(
        F.sum(quantity).alias("volume"), F.count(F.lit(1)).alias("trades"), F.max(price).alias("high"),
        F.min(price).alias("low"), F.min_by(price, order).alias("_first"), F.max_by(price, order).alias("last_price"),
        F.sum(F.col(price) * F.col(quantity)).alias("_value"))
    return out.withColumns({
        "price_change": ratio("last_price", "_first") - 1, "vwap": ratio("_value", "volume"),
        "avg_trade_size": F.col("volume") / F.col("trades")}).drop("_first", "_value")


def return_volatility(bars: DataFrame, key: str, ts: str, close: str, periods=(24, 48, 168), ahead: int = 24) -> DataFrame:
    """Returns, trailing volatilities without the current row, and the realized one of the next rows.

    The first layer needs the previous close, the second the frames over the returns: their reach is
    added up in ``before``.
    """
    year = F.sqrt(F.lit(24.0))

    def make(w):
        prev = F.lag(close).over(w)
        first = {"returns": (F.col(close) - prev) / F.nullif(prev, F.lit(0.0)),
                 "log_returns": F.log(F.nullif(F.col(close), F.lit(0.0)) / F.nullif(prev, F.lit(0.0)))}
        second = {f"volatility_{p}": F.stddev("returns").over(w.rowsBetween(-p, -1)) * year for p in periods}
        second["target_volatility"] = F.stddev("returns").over(w.rowsBetween(1, ahead)) * year
        return [first, second]

    return rows_frame(bars, [key], ts, [], make, before=max(periods) + 1, after=ahead)


def technical_indicators(bars: DataFrame, key: str, ts: str, close: str = "close", volume: str = "volume",
                         trades: str = "trades", horizons=(1, 4, 24)) -> DataFrame:
    """Moving averages, RSI-14, Bollinger bands, volume ratio, trade intensity and lead targets."""

    def make(w):
        change = F.col(close) - F.lag(close).over(w)
        first = {"price_change": change}
        gain = F.when(F.col("price_change") > 0, F.col("price_change")).otherwise(F.lit(0.0))
        loss = F.when(F.col("price_change") < 0, -F.col("price_change")).otherwise(F.lit(0.0))
        second = {f"ma_{p}": F.avg(close).over(w.rowsBetween(-p, -1)) for p in (24, 48, 168)}
        second.update({
            "avg_gain": F.avg(gain).over(w.rowsBetween(-14, -1)), "avg_loss": F.avg(loss).over(w.rowsBetween(-14, -1)),
            "bb_middle": F.avg(close).over(w.rowsBetween(-20, -1)), "bb_std": F.stddev(close).over(w.rowsBetween(-20, -1)),
            "volume_ratio": F.col(volume) / F.nullif(F.avg(volume).over(w.rowsBetween(-24, -1)), F.lit(0.0)),
            "trade_intensity": F.col(trades) / F.nullif(F.col(volume), F.lit(0.0)),
            **{f"price_{h}h": F.lead(close, h).over(w) for h in horizons}})
        return [first, second]

    out = rows_frame(bars, [key], ts, [], make, before=169, after=max(horizons))
    rs = F.col("avg_gain") / F.nullif(F.col("avg_loss"), F.lit(0.0))
    return out.withColumns({"rsi": 100 - 100 / (1 + rs), "bb_upper": F.col("bb_middle") + 2 * F.col("bb_std"),
                            "bb_lower": F.col("bb_middle") - 2 * F.col("bb_std")})


def funding_features(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Premium, open-interest ratio, imbalance, trailing funding means, price variation, next rate."""
    w8, w24 = (-8, -1), (-24, -1)

    def make(w):
        return {
            "funding_rate_ma_8h": F.avg("funding_rate").over(w.rowsBetween(*w8)),
            "funding_rate_ma_24h": F.avg("funding_rate").over(w.rowsBetween(*w24)),
            "volatility": F.stddev("mark_price").over(w.rowsBetween(*w24))
            / F.nullif(F.avg("mark_price").over(w.rowsBetween(*w24)), F.lit(0.0)),
            "next_funding_rate": F.lead("funding_rate").over(w)}

    out = rows_frame(df, [key], ts, [], make, before=24, after=1)
    return out.withColumns({
        "premium_index": ratio(F.col("mark_price") - F.col("index_price"), "index_price"),
        "open_interest_ratio": ratio("open_interest_long", F.col("open_interest_long") + F.col("open_interest_short")),
        "volume_imbalance": ratio(F.col("buy_volume") - F.col("sell_volume"), F.col("buy_volume") + F.col("sell_volume"))})


def rolling_zscores(df: DataFrame, key: str, ts: str, metrics: list[str], rows: int = 168) -> DataFrame:
    """z of each metric against its previous rows; null where their deviation is zero."""
    def make(w):
        f = w.rowsBetween(-rows, -1)
        return {f"{m}_zscore": (F.col(m) - F.avg(m).over(f)) / F.nullif(F.round(F.stddev(m).over(f), 12), F.lit(0.0))
                for m in metrics}
    return rows_frame(df, [key], ts, [], make, before=rows)


def liquidation_features(df: DataFrame) -> DataFrame:
    """Health factor by side, distance, size ratio, leverage bucket and volatility-adjusted distance."""
    distance = F.abs(F.col("mark_price") - F.col("liquidation_price")) / F.nullif(F.col("mark_price"), F.lit(0.0))
    return df.withColumns({
        "health_factor": health_factor(F.col("side"), F.col("mark_price"), F.col("entry_price"), F.col("liquidation_price")),
        "distance_to_liquidation": distance,
        "position_size_ratio": ratio("position_size", "market_open_interest"),
        "leverage_bucket": ladder([(F.col("leverage") <= 5, "low"), (F.col("leverage") <= 20, "medium")], "high"),
        "volatility_adjusted_distance": distance / F.nullif(F.col("market_volatility"), F.lit(0.0))})


def health_factor(side: Column, price: Column, entry: Column, liquidation: Column) -> Column:
    """1 at entry, 0 at liquidation; null when both prices coincide."""
    long = (price - liquidation) / F.nullif(entry - liquidation, F.lit(0.0))
    short = (liquidation - price) / F.nullif(liquidation - entry, F.lit(0.0))
    return F.when(F.upper(side) == "LONG", long).otherwise(short)


def price_spikes(events: DataFrame, keys: list[str], ts: str, ident: str, value: str,
                 min_count: int = 10, factor: float = 3.0) -> DataFrame:
    """Rows whose value exceeds ``factor`` times the running mean of more than ``min_count`` earlier rows."""
    out = running(events, keys, ts, [ident], {"_n": ("count", F.col(value)), "_s": ("sum", F.col(value).cast("double"))},
                  include_current=False)
    mean = F.col("_s") / F.nullif(F.col("_n"), F.lit(0))
    return out.withColumns({"prior_count": F.col("_n"), "prior_mean": mean}).filter(
        (F.col("_n") > min_count) & (F.col(value) > factor * mean)).drop("_n", "_s")


def rapid_transfers(events: DataFrame, keys: list[str], ts: str, ident: str, value: str, min_value: float = 10_000,
                    total: float = 100_000, history: int = 20, min_prior: int = 5, span_seconds: float = 3600) -> DataFrame:
    """High-value rows that, with up to ``history`` earlier ones of the key, exceed ``total`` inside the span."""
    big = events.filter(F.col(value) > min_value)

    def make(w):
        f = w.rowsBetween(-history, -1)
        return {"prior": F.count(F.lit(1)).over(f), "_sum": F.sum(value).over(f), "_first": F.first(ts).over(f)}

    out = rows_frame(big, keys, ts, [ident], make, before=history)
    span = (micros(ts) - micros("_first")) / 1_000_000.0
    return out.withColumn("total_value", F.coalesce("_sum", F.lit(0.0)) + F.col(value)).filter(
        (F.col("prior") > min_prior) & (F.col("total_value") > total) & (span < span_seconds)).drop("_sum", "_first")


def robust_price(feeds: DataFrame, asset: str = "asset", max_z: float = 3.5, pct: float = 0.02,
                 min_sources: int = 4) -> DataFrame:
    """Outlier-free weighted price per asset, with the sources kept and a confidence.

    Modified z by the median absolute deviation; a relative rule where that is 0; no filter below
    ``min_sources`` prices. Confidence: sources/5 x (1 - 10 x mean deviation) x mean weight, at most 0.99.
    """
    med = exact_quantiles(feeds, [asset], F.col("price"), {"_med": 0.5})
    n = feeds.groupBy(asset).agg(F.count(F.lit(1)).alias("_n"))
    base = null_safe_join(null_safe_join(feeds, med, [asset]), n, [asset]) \
        .withColumn("_dev", F.abs(F.col("price") - F.col("_med")))
    mad = exact_quantiles(base, [asset], F.col("_dev"), {"_mad": 0.5})
    base = null_safe_join(base, mad, [asset])
    keep = F.when(F.col("_n") < min_sources, F.lit(True)) \
        .when(F.col("_mad") > 0, 0.6745 * F.col("_dev") / F.col("_mad") < max_z) \
        .otherwise(F.col("_dev") / F.nullif(F.col("_med"), F.lit(0.0)) < pct)
    kept = base.filter(keep)
    price = kept.groupBy(asset).agg(
        (F.sum(F.col("price") * F.col("weight")) / F.sum("weight")).alias("aggregated"),
        F.count(F.lit(1)).alias("sources"), F.avg("weight").alias("_w"), F.max("_n").alias("offered"))
    spread = null_safe_join(kept, price, [asset]).groupBy(asset).agg(
        F.avg(F.abs(F.col("price") - F.col("aggregated")) / F.col("aggregated")).alias("_spread"))
    out = null_safe_join(price, spread, [asset])
    confidence = F.least(F.least(F.col("sources") / 5.0, F.lit(1.0))
                         * F.greatest(1 - F.col("_spread") * 10, F.lit(0.0)) * F.col("_w"), F.lit(0.99))
    return out.select(asset, "aggregated", "sources", (F.col("offered") - F.col("sources")).alias("outliers"),
                      confidence.alias("confidence"))


def weighted_median(feeds: DataFrame, keys: list[str], price: str = "price", weight: str = "weight") -> DataFrame:
    """Lowest price at which the running weight reaches half of the total."""
    per = feeds.groupBy(*keys, price).agg(F.sum(weight).alias("_w"))
    sliced = value_slices(per, keys, price)
    run = running(sliced, keys, price, [], {"_cum": ("sum", F.col("_w"))}, slice_by=F.col("_cut"))
    total = feeds.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    return null_safe_join(run, total, keys).filter(F.col("_cum") >= F.col("_total") / 2) \
        .groupBy(*keys).agg(F.min(price).alias("weighted_median"))


def collateral_value(balances: DataFrame, prices: DataFrame, haircuts: DataFrame, user: str = "user_id") -> DataFrame:
    """Exact decimal sum of balance x price x haircut per user; an unknown haircut counts as 0."""
    dec = lambda c: F.col(c).cast("decimal(20,8)")
    j = balances.join(prices, "asset").join(haircuts, "asset", "left")
    value = (dec("balance") * dec("price")).cast("decimal(38,12)") * F.coalesce(F.col("haircut").cast("decimal(6,4)"), F.lit(0).cast("decimal(6,4)"))
    return j.groupBy(user).agg(F.sum(value).alias("collateral"))


def market_anomalies(bars: DataFrame, keys: list[str], ts: str, min_rows: int = 10) -> DataFrame:
    """Volume above 3 sigma, move above 10 %, spread above 2.5 sigma of the bars so far, as one row each."""
    v = running_moments(bars, keys, ts, [], F.col("volume"), "v")
    s = running_moments(v.withColumn("spread", F.col("high") - F.col("low")), keys, ts, [], F.col("spread"), "s")
    move = F.abs(F.col("close") - F.col("open")) / F.nullif(F.col("open"), F.lit(0.0))
    kinds = F.array_compact(F.array(
        F.when(F.col("volume") > F.col("v_mean") + 3.0 * F.col("v_std"), "VOLUME_SPIKE"),
        F.when(move > 0.1, "PRICE_MOVEMENT"),
        F.when(F.col("spread") > F.col("s_mean") + 2.5 * F.col("s_std"), "SPREAD_WIDENING")))
    return s.filter(F.col("v_n") >= min_rows).select(*keys, ts, F.explode(kinds).alias("anomaly_type"))
