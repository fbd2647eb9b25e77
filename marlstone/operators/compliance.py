"""Transaction monitoring, risk scores, name matching and marketplace fraud."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import flagged, ladder, micros
from marlstone.operators.folds import sliding_totals
from marlstone.operators.graph import block_counts, strongly_connected_components
from marlstone.operators.joins import salted_lookup
from marlstone.operators.windows import latest, range_frame, rows_frame, running
from marlstone.session import written

HOUR, DAY = 3600.0, 86_400.0
#: Monitoring limits and high-risk countries.
LIMITS = {"hour_count": 10, "day_count": 50, "hour_volume": 100_000, "day_volume": 500_000, "single_alert": 50_000,
          "single_block": 500_000, "cumulative": 200_000, "structuring_share": 0.9, "structuring_count": 3, "round_count": 5,
          "counterparties": 20, "dormant_days": 180, "rapid_minutes": 5}
HIGH_RISK_COUNTRIES = ("IR", "KP", "SY", "CU", "VE")


def velocity(tx: DataFrame, user: str, ts: str, ident: str, amount: str, limits: dict = LIMITS) -> DataFrame:
    """Transactions and volume of the last hour and day at each transaction, and the limits they exceed."""
    one = F.lit(1)
    d = sliding_totals(tx, [user], ts, ident, HOUR, {"hour_count": one, "hour_volume": F.col(amount)})
    d = sliding_totals(d, [user], ts, ident, DAY, {"day_count": one, "day_volume": F.col(amount)})
    rules = flagged((F.col("hour_count") > limits["hour_count"], "hourly_count"), (F.col("hour_volume") > limits["hour_volume"], "hourly_volume"),
                    (F.col("day_count") > limits["day_count"], "daily_count"), (F.col("day_volume") > limits["day_volume"], "daily_volume"))
    return d.withColumn("rules", rules)


def amount_rules(tx: DataFrame, user: str, ts: str, ident: str, amount: str, limits: dict = LIMITS) -> DataFrame:
    d = sliding_totals(tx, [user], ts, ident, DAY, {"total_24h": F.col(amount)})
    single = ladder([(F.col(amount) >= limits["single_block"], "CRITICAL"), (F.col(amount) >= limits["single_alert"], "HIGH")], None)
    return d.withColumns({"single_severity": single, "cumulative_alert": F.col("total_24h") > limits["cumulative"]})


def structuring(tx: DataFrame, user: str, ts: str, amount: str, threshold: float, limits: dict = LIMITS) -> DataFrame:
    """Hours with several amounts just below the threshold, or with several round amounts, per user."""
    near = F.col(amount).between(limits["structuring_share"] * threshold, threshold) & (F.col(amount) < threshold)
    rounded = (F.col(amount) % 1000 == 0) & (F.col(amount) > 0)
    g = tx.groupBy(user, F.window(ts, "1 hour").alias("w")).agg(F.count_if(near).alias("near_threshold"), F.count_if(rounded).alias("round_amounts"))
    hit = (F.col("near_threshold") >= limits["structuring_count"]) | (F.col("round_amounts") >= limits["round_count"])
    return g.filter(hit).select(user, F.col("w.start").alias("window_start"), "near_threshold", "round_amounts")


def geography(tx: DataFrame, country: str, cross_border: Column, kyc: str, countries=HIGH_RISK_COUNTRIES) -> DataFrame:
    rules = flagged((F.coalesce(F.col(country).isin(*countries), F.lit(False)), "high_risk_country"),
                    (cross_border & F.coalesce(F.col(kyc), F.lit("unverified")).isin("unverified", "tier_1"), "cross_border_kyc"))
    return tx.withColumn("rules", rules).filter(F.size("rules") > 0)


def blacklisted(tx: DataFrame, address: str, blacklist: DataFrame, listed: str) -> DataFrame:
    return tx.join(blacklist.select(F.col(listed).alias("_listed")), F.col(address) == F.col("_listed"), "left_semi")


def many_counterparties(tx: DataFrame, user: str, ts: str, other: str, limit: int = LIMITS["counterparties"]) -> DataFrame:
    return tx.groupBy(user, F.date_trunc("day", ts).alias("day")).agg(F.countDistinct(other).alias("counterparties")) \
        .filter(F.col("counterparties") > limit)


def timing_rules(tx: DataFrame, user: str, ts: str, ident: str, limits: dict = LIMITS) -> DataFrame:
    """Unusual hours (0-5), rapid succession and reactivation after a dormant time."""
    d = rows_frame(tx, [user], ts, [ident], lambda w: {"_p": F.lag(ts).over(w)}, before=1)
    gap = micros(ts) - micros("_p")
    rules = flagged((F.hour(ts) <= 5, "unusual_hour"), (F.coalesce(gap < limits["rapid_minutes"] * 60_000_000, F.lit(False)), "rapid_succession"),
                    (F.coalesce(F.floor(gap / 86_400_000_000) > limits["dormant_days"], F.lit(False)), "dormant_reactivated"))
    return d.withColumn("rules", rules).drop("_p")


def user_summary(tx: DataFrame, alerts: DataFrame, user: str, ts: str) -> DataFrame:
    """Transactions, last activity and alerts by severity per user."""
    a = alerts.groupBy(user).agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity") == "HIGH").alias("high_alerts"))
    t = tx.groupBy(user).agg(F.count(F.lit(1)).alias("transactions"), F.max(ts).alias("last_activity"))
    return t.join(a, user, "left").fillna(0, ["alerts", "high_alerts"])


#: Exposure types that count as high risk.
HIGH_RISK_EXPOSURES = ("darknet", "mixer", "hack", "scam", "terrorism", "ransomware")


def composite_risk(df: DataFrame, kyc: str, analytics: str, exposures: str, amount: str, cross_border: Column, country: str) -> DataFrame:
    """Sum of the risk parts (at most 1) and the list of factors."""
    shared = F.array_sort(F.array_intersect(F.coalesce(F.col(exposures), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in HIGH_RISK_EXPOSURES])))
    level = F.coalesce(F.col(kyc), F.lit("unverified"))
    part = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    bad_country = F.col(country).isin(*HIGH_RISK_COUNTRIES)
    score = part(level == "unverified", 0.3) + part(level == "tier_1", 0.1) + F.coalesce(F.col(analytics) * 0.4, F.lit(0.0)) + part(F.size(shared) > 0, 0.3) \
        + F.when(F.col(amount) > 100_000, 0.2).when(F.col(amount) > 10_000, 0.1).otherwise(0.0) + part(cross_border, 0.1) + part(bad_country, 0.3)
    factors = F.concat(flagged((level == "unverified", "unverified_identity")), shared, flagged(
        (F.col(amount) > 100_000, "very_high_value"), (F.col(amount).between(10_000, 100_000) & (F.col(amount) > 10_000), "high_value"),
        (cross_border, "cross_border"), (bad_country, "high_risk_jurisdiction")))
    return df.withColumns({"risk_score": F.least(score, F.lit(1.0)), "risk_factors": factors})


def match_names(names: DataFrame, ident: str, name: str, watch: DataFrame, watch_id: str, watch_name: str, threshold: float = 0.8) -> DataFrame:
    """Names similar to a watch-list entry: 1 - edits / longer length >= threshold.

    With at most ``d`` edits, one of ``d + 1`` equal pieces of the listed name must occur unchanged near its
    place, so candidates meet on (length, piece number, piece text): exact, and no pair without a shared piece. Where one edit is
    allowed, half a name is a piece, and all names may begin alike: there they meet on what is left without one letter.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"\s+", " "))
    w = watch.select(F.col(watch_id).alias("watch_id"), clean(watch_name).alias("w")).filter(F.length("w") > 0) \
        .groupBy("w").agg(F.collect_set("watch_id").alias("watch_ids"))
    a = names.select(F.col(ident).alias("id"), clean(name).alias("n")).filter(F.length("n") > 0)
    distinct = a.select("n").distinct()
    edits = lambda lw: F.floor((1 - threshold) / threshold * lw + F.lit(1e-9)).cast("int")  # the longer name has at most lw / threshold letters
    listed = w.withColumn("lw", F.length("w")).withColumn("d", edits(F.col("lw")))
    pieces = listed.filter("d <> 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("d"))))
    bounds = lambda k: F.floor(F.col("lw") * k / (F.col("d") + 1)).cast("int")
    pieces = pieces.withColumns({"at": bounds(F.col("k")), "to": bounds(F.col("k") + 1)}) \
        .select("w", "watch_ids", "lw", "d", "k", "at", F.expr("substring(w, at + 1, to - at)").alias("piece"))
    lengths = w.agg(F.collect_set(F.length("w")).alias("s")).scalar()  # as many as there are lengths of names
    near = distinct.withColumn("ln", F.length("n")).select("n", "ln", F.explode(lengths).alias("lw")) \
        .withColumn("d", edits(F.col("lw"))).filter(F.abs(F.col("ln") - F.col("lw")) <= F.col("d"))
    probe = near.filter("d <> 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("d")))).withColumns({"at": bounds(F.col("k")), "to": bounds(F.col("k") + 1)}) \
        .withColumn("shift", F.explode(F.expr("sequence(greatest(-at, -d), least(d, ln - to))"))) \
        .filter((F.col("at") + F.col("shift") >= 0) & (F.col("to") + F.col("shift") <= F.col("ln"))) \
        .select("n", "lw", "k", F.expr("substring(n, at + shift + 1, to - at)").alias("piece")).distinct()
    shorter = lambda c: F.explode(F.expr(f"array_distinct(concat(array({c}), transform(sequence(1, length({c})), i -> concat(substring({c}, 1, i - 1), substring({c}, i + 1)))))"))
    one_edit = near.filter("d = 1").select("n").distinct().select("n", shorter("n").alias("rest")) \
        .join(listed.filter("d = 1").select("w", "watch_ids", shorter("w").alias("rest")).hint("merge"), "rest")  # small files of many keys must not be broadcast
    pairs = probe.join(pieces.hint("merge"), ["lw", "k", "piece"]).select("n", "w", "watch_ids").unionByName(one_edit.select("n", "w", "watch_ids")).dropDuplicates(["n", "w"])
    similarity = 1 - F.levenshtein("n", "w") / F.greatest(F.length("n"), F.length("w"))
    scored = pairs.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold)
    return a.join(scored.hint("merge"), "n").select("id", F.explode("watch_ids").alias("watch_id"), "similarity")


# -- marketplace fraud --------------------------------------------------------------------------------------

def trading_cycles(transfers: DataFrame, token: str, ts: str, src: str, dst: str, window: str = "24 hours") -> DataFrame:
    """Addresses on a directed cycle of three or more addresses, per token and window.

    Cycles stay inside strong components. In one, an address is on such a cycle if and only if it is on an undirected cycle: inside
    a block of three or more addresses every neighbour but a sole one can be left by another way. So the strong components of
    all tokens and windows are found at once, then the blocks inside them; no pairs of addresses are formed.
    """
    w = F.window(ts, window)["start"].alias("window_start")
    k = ["token", "window_start"]
    edges = written(transfers.select(F.col(token).alias("token"), w, F.col(src).alias("a"), F.col(dst).alias("b")).filter(F.col("a") != F.col("b")).distinct())
    ends = edges.select(*k, F.col("a").alias("address")).unionByName(edges.select(*k, F.col("b").alias("address"))).distinct()
    nodes = written(ends.withColumn("id", F.monotonically_increasing_id()))
    as_ = lambda address, id: nodes.select(*k, F.col("address").alias(address), F.col("id").alias(id))
    e = written(edges.join(as_("a", "src"), [*k, "a"]).join(as_("b", "dst"), [*k, "b"]).select("src", "dst"))
    strong = strongly_connected_components(nodes, e)
    one = salted_lookup(e, "src", strong, "id", [F.col("component").alias("cs")])
    inside = written(salted_lookup(one, "dst", strong, "id", [F.col("component").alias("cd")]).filter("cs = cd").select("src", "dst"))
    return nodes.join(block_counts(nodes, inside).filter("cyclic"), "id", "left_semi").select(*k, "address")


def sybil_windows(events: DataFrame, src: str, ts: str, dst: str, min_events: int = 100, min_parties: int = 50, window: str = "1 hour") -> DataFrame:
    return events.groupBy(src, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct(dst).alias("counterparties")) \
        .filter((F.col("events") > min_events) & (F.col("counterparties") > min_parties)) \
        .select(src, F.col("w.start").alias("window_start"), "events", "counterparties")


def enriched_alert_risk(alerts: DataFrame, user: str, ts: str, ident: str, confidence: str, recent_seconds: float = DAY) -> DataFrame:
    """confidence x (1 + 0.1 n) x 1.2 above three recent alerts, at most 1; CRITICAL above five alerts and 0.8."""
    d = running(alerts, [user], ts, [ident], {"alert_count": ("count", F.col(confidence))})
    d = sliding_totals(d, [user], ts, ident, recent_seconds, {"recent": F.lit(1)})
    risk = F.least(F.col(confidence) * (1 + 0.1 * F.col("alert_count")) * F.when(F.col("recent") > 3, 1.2).otherwise(1.0), F.lit(1.0))
    return d.withColumn("risk_score", risk).withColumn(
        "critical", (F.col("alert_count") > 5) & (F.col("risk_score") > 0.8))


def activity_indicators(events: DataFrame, entity: str, ts: str, ident: str, kind: str, window: str = "1 hour") -> DataFrame:
    """Per entity and window: burst above 20, an action above 10 times, intervals with a deviation below one second."""
    keyed = events.withColumn("window_start", F.window(ts, window)["start"])
    gaps = rows_frame(keyed, [entity, "window_start"], ts, [ident], lambda w: {"_p": F.lag(ts).over(w)}, before=1)
    base = gaps.groupBy(entity, "window_start").agg(
        F.count(F.lit(1)).alias("events"), F.stddev_pop((micros(ts) - micros("_p")) / 1000.0).alias("_sd"))
    reps = keyed.groupBy(entity, "window_start", kind).agg(F.count(F.lit(1)).alias("n")).groupBy(entity, "window_start").agg(
        F.count_if(F.col("n") > 10).alias("repetitive"))
    d = base.join(reps, [entity, "window_start"])
    burst, auto = F.col("events") > 20, (F.col("events") > 5) & (F.col("_sd") < 1000)
    score = F.when(burst, 0.3).otherwise(0.0) + F.when(F.coalesce(auto, F.lit(False)), 0.4).otherwise(0.0) + 0.2 * F.col("repetitive")
    return d.select(entity, "window_start", "events", burst.alias("burst"), F.coalesce(auto, F.lit(False)).alias("automated"), "repetitive",
                    F.least(score, F.lit(1.0)).alias("fraud_score"))
