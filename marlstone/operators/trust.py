"""Trust scores, credentials and the data marketplace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import clamp, constant_map, ladder
from marlstone.operators.folds import affine_scan
from marlstone.operators.windows import latest, rows_frame

#: Trust impact by event type.
IMPACTS = {"ASSET_CREATED": 0.05, "ASSET_VERIFIED": 0.1, "POSITIVE_REVIEW": 0.08, "NEGATIVE_REVIEW": -0.15, "COLLABORATION_COMPLETED": 0.06,
           "DISPUTE_RAISED": -0.1, "DISPUTE_RESOLVED": 0.03, "FRAUD_DETECTED": -0.5, "VERIFICATION_FAILED": -0.2}


def trust_impact(event_type: str | Column, severity: Column | None = None, confidence: Column | None = None) -> Column:
    out = constant_map(IMPACTS, event_type, 0.0)
    if severity is not None:
        out = out * (1 + F.coalesce(severity, F.lit(0.0)) * 0.5)
    if confidence is not None:
        out = out * F.coalesce(confidence, F.lit(1.0))
    return clamp(out, -1.0, 1.0)


def trust_scores(events: DataFrame, entity: str, ts: str, ident: str, impact: Column, start: float = 0.5, alpha: float = 0.1,
                 **options) -> DataFrame:
    """Score after each event: a gain closes part of the way to 1, a loss takes part of what is there.

    Both are affine maps with factor 1 - alpha x |impact| and stay within [0, 1].
    """
    return affine_scan(events, [entity], ts, [ident], 1 - alpha * F.abs(impact), alpha * F.greatest(impact, F.lit(0.0)),
                       "trust_score", start, **options)


#: Marketplace tiers (least trust, price, quality multiplier, level).
TIERS = (("bronze", 0.0, 10.0, 0.5, 1), ("silver", 0.5, 50.0, 0.8, 2), ("gold", 0.7, 200.0, 1.0, 4), ("platinum", 0.9, 1000.0, 1.2, 5))
LEVELS = {"sample": 1, "filtered": 2, "aggregated": 3, "full": 4, "real_time": 5}
QUALITY_WEIGHTS = {"completeness": 0.20, "accuracy": 0.20, "consistency": 0.15, "timeliness": 0.15, "validity": 0.15, "uniqueness": 0.15}
QUALITY_FLOORS = {"completeness": 0.80, "accuracy": 0.85, "consistency": 0.80, "timeliness": 0.70, "validity": 0.90, "uniqueness": 0.95}


def quality_score(df: DataFrame, trust: str) -> DataFrame:
    """Weighted overall score, scaled by the assessor's trust."""
    total = None
    for d, w in QUALITY_WEIGHTS.items():
        part = F.coalesce(F.col(d), F.lit(0.0)) * w
        total = part if total is None else total + part
    overall = clamp(total, 0.0, 1.0)
    return df.withColumns({"overall": overall, "trust_adjusted": overall * F.col(trust)})


def quality_floor_issues(df: DataFrame, keep: list[str]) -> DataFrame:
    """Dimensions below their floor with the severity of the shortfall."""
    def row(d, floor):
        gap = floor - F.coalesce(F.col(d), F.lit(0.0))
        severity = ladder([(gap > 0.3, "CRITICAL"), (gap > 0.2, "HIGH"), (gap > 0.1, "MEDIUM")], "LOW")
        return F.when(gap > 0, F.struct(F.lit(f"low_{d}").alias("issue"), severity.alias("severity")))
    rows = F.array_compact(F.array(*[row(d, f) for d, f in QUALITY_FLOORS.items()]))
    return df.select(*keep, F.inline(rows))


def eligible_tier(trust: Column) -> Column:
    return ladder([(trust >= t[1], t[0]) for t in reversed(TIERS)], None)


def grant_access(df: DataFrame, trust: str, requested: str) -> DataFrame:
    """Highest tier the trust allows; a request above it is granted at the tier's level."""
    tier = eligible_tier(F.col(trust))
    best = constant_map({t[0]: t[4] for t in TIERS}, tier, 0)
    asked = constant_map(LEVELS, requested, 0)
    names = {v: k for k, v in LEVELS.items()}
    level = F.least(asked, best)
    return df.withColumns({"tier": tier, "granted": tier.isNotNull(), "granted_level": F.when(tier.isNotNull(), constant_map(names, level))})


def dynamic_price(df: DataFrame, trust: str, quality: str, level: str, volume: str) -> DataFrame:
    """Tier price x quality x (1 - trust discount of at most 15 %) x (1 - volume discount), in decimals."""
    asked = constant_map(LEVELS, level, 0)
    fits = [(asked == t[4]) & (F.col(trust) >= t[1]) for t in TIERS]
    price = ladder([(c, t[2]) for c, t in zip(fits, TIERS)], TIERS[0][2])
    multiplier = ladder([(c, t[3]) for c, t in zip(fits, TIERS)], TIERS[0][3])
    discount = F.least(F.col(trust) * 0.2, F.lit(0.15))
    bulk = ladder([(F.col(volume) > 1000, 0.1), (F.col(volume) > 100, 0.05)], 0.0)
    final = price.cast("decimal(8,2)") * (F.col(quality) * multiplier).cast("decimal(9,6)") * (1 - discount).cast("decimal(7,6)") \
        * (1 - bulk).cast("decimal(3,2)")
    return df.withColumns({"base_price": price, "trust_discount": discount, "volume_discount": bulk, "final_price": final})


def quality_rollup(assessments: DataFrame, dataset: str, ts: str, ident: str, score: str, last: int = 100) -> DataFrame:
    """Mean of the last assessments per dataset, with their count and the premium mark of the newest."""
    recent = latest(assessments, [dataset], [F.col(ts).desc(), F.col(ident).desc()], last)
    return recent.groupBy(dataset).agg(F.avg(score).alias("average_quality"), F.count(F.lit(1)).alias("assessments"),
                                       (F.max_by(score, F.struct(ts, ident)) >= 0.9).alias("premium"))


def quality_improvements(assessments: DataFrame, dataset: str, ts: str, ident: str, score: str) -> DataFrame:
    """Assessments more than 20 % above the previous one of the dataset."""
    d = rows_frame(assessments, [dataset], ts, [ident], lambda w: {"previous": F.lag(score).over(w)}, before=1)
    return d.filter(F.col(score) > F.col("previous") * 1.2)


def quality_trend(history: DataFrame, dataset: str, ts: str, ident: str, score: str) -> DataFrame:
    """Mean of the newest five against the five before: improving / declining beyond 0.05."""
    from marlstone.operators.windows import ranked_top
    top = ranked_top(history, [dataset], [F.col(ts).desc(), F.col(ident).desc()], 10)
    g = top.groupBy(dataset).agg(F.avg(F.when(F.col("rank") <= 5, F.col(score))).alias("_new"), F.avg(F.when(F.col("rank") > 5, F.col(score))).alias("_old"))
    change = F.coalesce(F.col("_new") - F.col("_old"), F.lit(0.0))
    return g.select(dataset, change.alias("change"), ladder([(change > 0.05, "improving"), (change < -0.05, "declining")], "stable").alias("trend"))


def credential_value(amount: Column, level: Column, score: Column, anchored: Column) -> Column:
    """amount/100 (at most 5) x level x score/100 x 1.5 when anchored; a missing claim counts as 1."""
    one = F.lit(1.0)
    return F.coalesce(F.least(amount / 100, F.lit(5.0)), one) * F.coalesce(level.cast("double"), one) * F.coalesce(score / 100, one) \
        * F.when(F.coalesce(anchored, F.lit(False)), 1.5).otherwise(1.0)


def credential_scores(creds: DataFrame, user: str, kind: str, value: Column, issued: str, now: Column, weights: dict[str, float],
                      decay: float = 0.95, cap: float = 100.0) -> DataFrame:
    """Weighted sum of credential values, decayed by the mean age in months, at most ``cap``."""
    w = constant_map(weights, kind, 0.0)
    g = creds.groupBy(user).agg(F.sum(w * value).alias("_raw"), F.avg(F.datediff(now, issued) / 30).alias("_age"))
    return g.select(user, F.least(F.col("_raw") * F.pow(F.lit(decay), F.coalesce(F.col("_age"), F.lit(0.0))), F.lit(cap)).alias("trust_score"))


def network_bonus(trusts: DataFrame, src: str, dst: str) -> DataFrame:
    """2 % per distinct trusted neighbour in either direction, at most 50 %."""
    both = trusts.select(F.col(src).alias("user"), F.col(dst).alias("other")).unionByName(trusts.select(F.col(dst).alias("user"), F.col(src).alias("other")))
    return both.groupBy("user").agg(F.countDistinct("other").alias("connections")) \
        .withColumn("bonus", F.least(F.col("connections") * 0.02, F.lit(0.5)))
