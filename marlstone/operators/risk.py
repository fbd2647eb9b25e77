"""Portfolio, liquidation and limit analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def liquidation_cascades(events: DataFrame, keys: list[str], ts: str, value: str, window: str = "5 minutes",
                         min_count: int = 10, min_value: float = 1_000_000, critical: int = 20) -> DataFrame:
    """Windows with more than ``min_count`` liquidations or more than ``min_value`` in value."""
    g = events.groupBy(*keys, F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("liquidations"), F.sum(value).alias("total"))
    hit = (F.col("liquidations") > min_count) | (F.col("total") > min_value)
    return g.filter(hit).select(*keys, F.col("w.start").alias("window_start"), "liquidations", "total",
                                F.when(F.col("liquidations") > critical, "CRITICAL").otherwise("WARNING").alias("severity"))


def drawdown(returns: DataFrame, keys: list[str], ts: str, value: str, ties: list[str] | None = None) -> DataFrame:
    """Largest and current fall of the compounded return below its running peak."""
    from marlstone.operators.windows import running
    growth = running(returns, keys, ts, ties or [], {"_log": ("sum", F.log1p(F.col(value)))})
    peak = running(growth, keys, ts, ties or [], {"_peak": ("max", F.col("_log"))})
    fall = F.exp(F.col("_log") - F.col("_peak")) - 1
    return peak.groupBy(*keys).agg(F.min(fall).alias("max_drawdown"),
                                   F.max_by(fall, F.struct(ts, *(ties or []))).alias("current_drawdown"))


def portfolio_values(positions: DataFrame, prices: DataFrame, user: str, market: str, ts: str,
                     quantity: str = "quantity", price: str = "price") -> DataFrame:
    """Portfolio value per user and time with the return on the previous time."""
    from marlstone.operators.windows import rows_frame
    v = positions.join(prices, market).groupBy(user, ts).agg(F.sum(F.col(quantity) * F.col(price)).alias("value"))
    out = rows_frame(v, [user], ts, [], lambda w: {"_p": F.lag("value").over(w)}, before=1, slice_seconds=30 * 86_400)
    return out.withColumn("ret", F.col("value") / F.nullif(F.col("_p"), F.lit(0.0)) - 1).drop("_p")


def value_at_risk(returns: DataFrame, keys: list[str], ret: str = "ret", min_rows: int = 30) -> DataFrame:
    """Historical VaR at 95 and 99 % and the mean loss beyond the first; 0 below ``min_rows`` returns."""
    from marlstone.functions.columns import null_safe_join
    from marlstone.functions.quantiles import exact_quantiles
    r = returns.filter(F.col(ret).isNotNull())
    q = exact_quantiles(r, keys, F.col(ret), {"_q5": 0.05, "_q1": 0.01})
    tail = null_safe_join(r, q, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), F.avg(F.when(F.col(ret) <= F.col("_q5"), F.col(ret))).alias("_tail"))
    out = null_safe_join(tail, q, keys)
    enough = lambda c: F.when(F.col("observations") < min_rows, 0.0).otherwise(F.abs(c))
    return out.select(*keys, "observations", enough(F.col("_q5")).alias("var_95"), enough(F.col("_q1")).alias("var_99"),
                      enough(F.col("_tail")).alias("cvar_95"))


def performance_ratios(returns: DataFrame, keys: list[str], ts: str, ret: str = "ret", risk_free: float = 0.05, days: int = 252,
                       min_rows: int = 30) -> DataFrame:
    """Sharpe, Sortino and Calmar; an infinite ratio is null, and the first two are 0 on few returns."""
    from marlstone.functions.columns import null_safe_join
    r = returns.filter(F.col(ret).isNotNull())
    s = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(ret).alias("_m"), F.stddev(ret).alias("_s"),
                             F.stddev(F.when(F.col(ret) < 0, F.col(ret))).alias("_d"))
    s = null_safe_join(s, drawdown(r, keys, ts, ret), keys)
    root, excess = F.sqrt(F.lit(float(days))), F.col("_m") - risk_free / days
    zero = F.lit(0.0)
    few = F.col("_n") < min_rows
    return s.select(*keys, F.when(few, 0.0).otherwise(root * excess / F.nullif(F.col("_s"), zero)).alias("sharpe"),
                    F.when(few, 0.0).otherwise(root * excess / F.nullif(F.col("_d"), zero)).alias("sortino"),
                    ((F.pow(1 + F.col("_m"), F.lit(days)) - 1) / F.nullif(F.abs("max_drawdown"), zero)).alias("calmar"),
                    "max_drawdown", "current_drawdown")


def greeks_total(positions: DataFrame, keys: list[str], greeks: str = "greeks") -> DataFrame:
    return positions.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col(f"{greeks}.{g}"), F.lit(0.0))).alias(g) for g in ("delta", "gamma", "vega", "theta")])


def mean_pairwise_correlation(returns: DataFrame, entity: str, ts: str, ret: str, entities: list) -> DataFrame:
    """Mean correlation over all pairs of a known, short entity list: one column each, one aggregation."""
    wide = returns.groupBy(ts).agg(*[F.avg(F.when(F.col(entity) == e, F.col(ret))).alias(f"e{i}") for i, e in enumerate(entities)])
    pairs = [(i, j) for i in range(len(entities)) for j in range(i + 1, len(entities))]
    one = wide.agg(*[F.corr(f"e{i}", f"e{j}").alias(f"c{i}_{j}") for i, j in pairs])
    return one.select(F.explode(F.array(*[F.col(f"c{i}_{j}") for i, j in pairs])).alias("c")).agg(F.avg("c").alias("mean_correlation"))


def risk_score(concentration: Column, volatility: Column, leverage: Column, drawdown_now: Column, illiquid: Column) -> Column:
    """0-100: concentration 20, annual volatility 30, leverage 20, drawdown 20, illiquid positions 10."""
    cap = lambda c, top: F.least(F.lit(top), F.floor(c)).cast("int")
    return F.least(F.lit(100), cap(concentration * 100, 20) + cap(volatility * 100, 30) + cap(leverage * 5, 20)
                   + cap(F.abs(drawdown_now) * 100, 20) + F.least(F.lit(10), illiquid * 2).cast("int"))


def risk_level(score: Column) -> Column:
    from marlstone.functions.columns import ladder
    return ladder([(score < 20, "Very Low"), (score < 40, "Low"), (score < 60, "Medium"), (score < 80, "High")], "Very High")


def stress_test(positions: DataFrame, user: str, market: str, value: str, scenarios: list[dict]) -> DataFrame:
    """Shocked value and profit per user and scenario: the few scenarios travel with each position as an array.

    ``scenarios``: ``{"name", "all_markets", "shocks": {market: change}}``. A margin call is a value below 80 %.
    """
    from marlstone.functions.columns import ladder
    rows = F.array(*[F.struct(F.lit(s["name"]).alias("scenario"),
                              (F.lit(float(s.get("all_markets", 0.0))) + ladder([(F.col(market) == m, float(x)) for m, x in s.get("shocks", {}).items()], 0.0)).alias("shock"))
                     for s in scenarios])
    per = positions.groupBy(user, market).agg(F.sum(value).alias("_v"))
    out = per.select(user, "_v", F.inline(rows)).groupBy(user, "scenario").agg(
        F.sum("_v").alias("original"), F.sum(F.col("_v") * (1 + F.col("shock"))).alias("shocked"))
    return out.withColumns({"pnl": F.col("shocked") - F.col("original"), "margin_call": F.col("shocked") < 0.8 * F.col("original")})


def worst_case(results: DataFrame, user: str) -> DataFrame:
    """Scenario of the largest loss per user; null where no scenario loses."""
    loss = F.when(F.col("pnl") < 0, F.struct("pnl", "scenario"))
    return results.groupBy(user).agg(F.min(loss).alias("w"), F.count_if("margin_call").alias("margin_calls")) \
        .select(user, F.col("w.scenario").alias("worst_scenario"), F.col("w.pnl").alias("worst_pnl"), "margin_calls")


def beta(returns: DataFrame, keys: list[str], ret: str, market_ret: str) -> DataFrame:
    """Covariance with the market over the market's variance; 1 where the market does not move."""
    return returns.groupBy(*keys).agg(F.coalesce(F.covar_samp(ret, market_ret) / F.nullif(F.var_samp(market_ret), F.lit(0.0)), F.lit(1.0)).alias("beta"))


def liquidation_alerts(df: DataFrame, keep: list[str], side: Column, price: Column, entry: Column, liquidation: Column) -> DataFrame:
    """Positions with a health factor below 1.2; CRITICAL below 1.05."""
    from marlstone.operators.market import health_factor
    d = df.withColumn("health_factor", health_factor(side, price, entry, liquidation)).filter(F.col("health_factor") < 1.2)
    return d.select(*keep, "health_factor", F.when(F.col("health_factor") < 1.05, "CRITICAL").otherwise("WARNING").alias("severity"))


def limit_utilisation(usage: DataFrame, current: str, limit: str, warning: float = 0.8, critical: float = 0.95) -> DataFrame:
    from marlstone.functions.columns import ladder
    share = F.coalesce(F.col(current) / F.nullif(F.col(limit), F.lit(0.0)), F.lit(0.0))
    status = ladder([(F.col(current) >= F.col(limit), "breached"), (share >= critical, "critical"), (share >= warning, "warning")], "normal")
    return usage.withColumns({"utilisation": share * 100, "status": status})


def exposure_concentration(positions: DataFrame, market: str, user: str, notional: str) -> DataFrame:
    """Share of the largest market and of the largest user in the total notional."""
    per_market = positions.groupBy(market).agg(F.sum(F.abs(notional)).alias("n"))
    per_user = positions.groupBy(user).agg(F.sum(F.abs(notional)).alias("n"))
    share = lambda d: d.agg((F.max("n") / F.nullif(F.sum("n"), F.lit(0.0))).alias("s")).scalar()
    return positions.sparkSession.range(1).select(share(per_market).alias("top_market"), share(per_user).alias("top_user"))


def system_risk(positions: DataFrame, notional: str, var: str, leverage: str, stressed: Column, liquidation: Column) -> DataFrame:
    """min(30, 300 VaR ratio) + min(20, 2 (leverage - 10)) + 25 stressed share + 25 liquidation share, at most 100."""
    n = F.count(F.lit(1))
    s = positions.agg(F.sum(notional).alias("_n"), F.sum(var).alias("_v"), F.avg(leverage).alias("_l"),
                      (F.count_if(stressed) / n).alias("_s"), (F.count_if(liquidation) / n).alias("_q"))
    whole = lambda c: F.floor(c).cast("int")
    score = F.least(F.lit(30), whole(F.coalesce(F.col("_v") / F.nullif(F.col("_n"), F.lit(0.0)) * 300, F.lit(0.0)))) \
        + F.when(F.col("_l") > 10, F.least(F.lit(20), whole((F.col("_l") - 10) * 2))).otherwise(0) + whole(F.col("_s") * 25) + whole(F.col("_q") * 25)
    return s.select(F.least(F.lit(100), score).alias("risk_score"))
