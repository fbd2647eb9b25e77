"""Edge cases and known answers of joins, merges, patterns, quality and market operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators import aggregates, cep, joins, lake, market, merge, quality
from marlstone.operators.query import Query, predicate

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def test_point_in_time_join_edges(spark):
    e = spark.createDataFrame([(1, "a", at(100)), (2, "a", at(100)), (3, "a", at(100_000)), (4, None, at(50)), (5, "b", at(10))], "id int, k string, ts timestamp")
    f = spark.createDataFrame([("a", at(100), 1.0), ("a", at(100), 2.0), ("a", at(99), 9.0), (None, at(1), 5.0), ("b", at(11), 7.0)], "k string, fts timestamp, v double")
    got = {r["id"]: r["v"] for r in joins.point_in_time_join(e, f, ["k"], "ts", "fts", ["v"], 3600, 600).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: None, 4: None, 5: None}
    free = {r["id"]: r["v"] for r in joins.point_in_time_join(e, f, ["k"], "ts", "fts", ["v"], None, 600).collect()}
    assert free[3] == 2.0 and free[5] is None
    assert joins.point_in_time_join(e, f.limit(0), ["k"], "ts", "fts", ["v"]).count() == 5


def test_keyless_join_checks_its_size(spark):
    assert joins.keyless_join(spark.range(3), spark.range(2).toDF("x")).count() == 6
    with pytest.raises(Exception, match="too large"):
        joins.keyless_join(spark.range(3), spark.range(5).toDF("x"), limit=4).collect()


def test_radius_pairs(spark):
    import random
    rng = random.Random(2)
    pts = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(150)] + [(200, 0.0, 0.0), (201, 0.0, 0.0)]
    got = {(r["id_a"], r["id_b"]) for r in joins.radius_pairs(spark.createDataFrame(pts, "id int, x double, y double"), "id", "x", "y", 0.7).collect()}
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.49}
    assert got == want


def test_upsert_overwrites_with_null_and_adds_columns(spark):
    t = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "id int, s string, old double")
    s = spark.createDataFrame([(2, None, 5), (3, "z", 6)], "id int, s string, extra int")
    got = {r["id"]: (r["s"], r["old"], r["extra"]) for r in merge.upsert(t, s, ["id"]).collect()}
    assert got == {1: ("x", 1.0, None), 2: (None, 2.0, 5), 3: ("z", None, 6)}
    assert merge.upsert(t, s.limit(0), ["id"]).count() == 2


def test_deduplicate(spark):
    d = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (None, 5), (None, 6)], "k int, o int")
    rows = lambda x: sorted((r["k"] or -1, r["o"]) for r in x.collect())
    assert rows(lake.deduplicate(d, ["k"], "first", ["o"])) == [(-1, 5), (1, 2), (2, 1)]
    assert rows(lake.deduplicate(d, ["k"], "last", ["o"])) == [(-1, 6), (1, 3), (2, 1)]
    assert rows(lake.deduplicate(d, ["k"], "none")) == [(2, 1)]
    with pytest.raises(ValueError):
        lake.deduplicate(d, ["k"])


def test_builder_none_and_unknown(spark):
    d = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert Query(d).filter(b=None).to_df().count() == 1 and Query(d).filter(b__ne=None).to_df().count() == 1
    assert [r["a"] for r in Query(d).order_by("a", "-").to_df().collect()] == [2, 1]
    with pytest.raises(ValueError):
        predicate("a", "resembles", 1)
    with pytest.raises(KeyError):
        lake.run_steps(d, [("no_such_step", {})])


def events(spark, types):
    return spark.createDataFrame([(i, "k", at(i * 10), t) for i, t in enumerate(types)], "id long, k string, ts timestamp, event_type string")


def test_pattern_contiguity(spark):
    p = cep.Pattern("p", "LOW", 100.0, (cep.Step("event_type = 'f'", 3, True), cep.Step("event_type = 's'", strict=True)))
    ids = lambda t: sorted((r["start_id"], r["end_id"]) for r in cep.match_pattern(events(spark, t), ["k"], "ts", "id", p).collect())
    assert ids("fffs") == [(0, 3)] and ids("ffffs") == [(1, 4)] and ids("ffxfs") == [] and ids("fffxs") == []
    relaxed = cep.Pattern("r", "LOW", 45.0, (cep.Step("event_type = 'a'"), cep.Step("event_type = 'b'", 2)))
    found = cep.match_pattern(events(spark, "axbxbb"), ["k"], "ts", "id", relaxed).collect()
    assert [(r["start_id"], r["end_id"]) for r in found] == [(0, 4)]
    absent = cep.Pattern("n", "LOW", 25.0, (cep.Step("event_type = 'a'"),), "event_type = 'c'")
    got = cep.match_pattern(events(spark, "axcaxxc"), ["k"], "ts", "id", absent).collect()
    assert [r["start_id"] for r in got] == [3]


def test_known_market_answers(spark):
    b = spark.createDataFrame([("u", "USDC", "10000"), ("u", "ETH", "5"), ("u", "TOKEN", "50000")], "user_id string, asset string, balance string")
    p = spark.createDataFrame([("USDC", "1"), ("ETH", "2000"), ("TOKEN", "0.5")], "asset string, price string")
    h = spark.createDataFrame([("USDC", "0.95"), ("ETH", "0.85"), ("TOKEN", "0.75")], "asset string, haircut string")
    assert float(market.collateral_value(b, p, h).first()["collateral"]) == pytest.approx(36750)
    f = spark.createDataFrame([("x", "a", 50000.0, 1.0), ("x", "b", 50100.0, 1.0), ("x", "c", 49900.0, 1.0), ("x", "d", 75000.0, 1.0)], "asset string, source string, price double, weight double")
    r = market.robust_price(f).first()
    assert r["sources"] == 3 and r["outliers"] == 1 and r["aggregated"] < 55000
    w = spark.createDataFrame([("x", 50000.0, 0.4), ("x", 50200.0, 0.3), ("x", 49800.0, 0.3)], "asset string, price double, weight double")
    assert market.weighted_median(w, ["asset"]).first()["weighted_median"] == pytest.approx(50000, abs=100)


def test_constant_and_empty_columns(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    assert [r["x_normalized"] for r in lake.normalize(d, ["x"]).collect()] == [None, None]
    assert aggregates.table_quality(d.limit(0), "t", F.col("x").isNull(), F.col("x") < 0).first()["quality_score"] == 100.0
    p = quality.dataset_profile(spark.createDataFrame([(1, None), (1, None)], "a int, b string")).first()
    assert (p["row_count"], p["null_percentage"], p["duplicate_rows"]) == (2, 50.0, 1)
    assert quality.dataset_profile(d.limit(0)).first()["row_count"] == 0


def test_plans_stay_declarative(spark):
    d = events(spark, "abab").withColumn("x", F.lit(1.0))
    plans = [joins.point_in_time_join(d, d.withColumnsRenamed({"ts": "f"}), ["k"], "ts", "f", ["x"]), cep.match_pattern(d, ["k"], "ts", "id", cep.PATTERNS["account_takeover"]),
             lake.deduplicate(d, ["k"], "last", ["ts", "id"])]
    for p in plans:
        text = p._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "WindowGroupLimit" in text


def test_patterns_relative_to_their_start(spark):
    rows = [("a", 1, 0, 10.0), ("a", 2, 10, 9.0), ("a", 3, 20, 12.0), ("a", 4, 20, 9.2), ("a", 5, 1799, 1.0), ("a", 6, 1800, 1.0), (None, 7, 0, 10.0), (None, 8, 5, 1.0), (None, 9, 6, 2.0),
            ("b", 10, 0, 10.0), ("b", 11, 1, 1.0), ("b", 12, 1801, 1.0), ("c", 13, 0, None), ("c", 14, 1, 1.0)]
    df = spark.createDataFrame([(k, i, at(s), v, "PERFORMANCE_CHECK") for k, i, s, v in rows], "k string, id long, ts timestamp, amount double, event_type string")
    steps, within = cep.worsening()
    got = {(r["k"], r["start_id"], r["end_id"]) for r in cep.match_from_start(df, ["k"], "ts", "id", "amount >= 9", steps, within, ["event_type", "amount"]).collect()}
    # 1: 9.0 and 9.2 are worse; 2: the two at 1.0; 3: 9.2 (same time, later id) and 1.0; 4: the two at 1.0; b: the second lies outside
    assert got == {("a", 1, 4), ("a", 2, 6), ("a", 3, 5), ("a", 4, 6), (None, 7, 9)}
    up = [(lambda r, s: r["amount"] > s["amount"], 2, True)], within
    runs = cep.match_from_start(df, ["k"], "ts", "id", "id in (2, 5, 11)", *up, ["amount"]).collect()
    assert [(r["start_id"], r["end_id"]) for r in runs] == [(2, 4)]
