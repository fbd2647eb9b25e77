"""Steps whose cost must not outgrow their input, each with its rows checked against a small loop."""

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.quantiles import exact_quantiles
from marlstone.operators import cep, graph, quality, search, windows
from marlstone.operators import operations as op
from marlstone.operators.compliance import match_names
from marlstone.operators.joins import either_end_join


def test_access_rules_travel_and_requests_stay(spark, tmp_path):
    spark.createDataFrame([(1, 7, ["a"], "lake/x/1", "read"), (2, 8, None, "lake/y", "read"), (3, 7, ["b"], "lake/x", "write"), (4, None, ["a"], "lake", "read")],
                          "request_id long, user_id long, groups array<string>, resource_id string, action string").write.parquet(str(tmp_path / "q"))
    rules = spark.createDataFrame([(1, "a", "lake", True, "read", "allow"), (2, "*", "lake/x", True, "read", "deny"), (3, "7", "lake/x", False, "write", "allow")],
                                  "rule_id int, principal string, resource string, is_prefix boolean, action string, effect string")
    out = op.evaluate_access(spark.read.parquet(str(tmp_path / "q")), rules)
    assert {(r["request_id"], r["decision"], r["applicable_rules"]) for r in out.collect()} == {(1, "allow", 2), (2, "deny", 0), (3, "allow", 1), (4, "allow", 1)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan


def start_loop(rows, start, steps, within):
    """Brute force over (id, key, second, amount, user), nulls never satisfying a condition."""
    out = set()
    for a in [r for r in rows if start(r)]:
        later = sorted((r for r in rows if r[1] == a[1] and (r[2], r[0]) > (a[2], a[0]) and r[2] - a[2] < within), key=lambda r: (r[2], r[0]))
        at, last = -1, None
        for holds, times, consecutive in steps:
            hits = [i for i, r in enumerate(later) if i > at and None not in (r[3], a[3]) and holds(r, a)][:times]
            if len(hits) < times or (consecutive and hits[-1] - hits[0] != times - 1):
                break
            at, last = hits[-1], later[hits[-1]]
        else:
            out.add((a[1], a[0], last[0]))
    return out


@pytest.mark.parametrize("block", [3, 32])
def test_start_patterns_keep_only_the_rows_they_need(spark, monkeypatch, block):
    rng = random.Random(block)
    rows = [(i, rng.choice(["a", "a", None]), rng.randrange(300), rng.choice([None, *range(1, 12)]), rng.choice(["u", "v", "w", None])) for i in range(500)]
    sizes, keep = [], cep.written
    monkeypatch.setattr(cep, "BLOCK", block)
    monkeypatch.setattr(cep, "WIDEN", 2)
    monkeypatch.setattr(cep, "written", lambda df: sizes.append((x := keep(df)).count()) or x)
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, k, t0 + timedelta(seconds=t), None if x is None else float(x), u) for i, k, t, x, u in rows], "id long, k string, ts timestamp, amount double, u string")
    run = lambda start, steps: {(r["k"], r["start_id"], r["end_id"]) for r in cep.match_from_start(df, ["k"], "ts", "id", start, steps, 100.0, ["amount", "u"]).collect()}
    high = lambda r: r[3] is not None and r[3] >= 4
    less, more = lambda r, s: r["amount"] < s["amount"] * 0.5, lambda r, s: r["amount"] > s["amount"]
    assert run("amount >= 4", [(less, 3, False)]) == start_loop(rows, high, [(lambda r, a: r[3] < a[3] * 0.5, 3, False)], 100)
    assert run("amount >= 4", [(more, 2, True)]) == start_loop(rows, high, [(lambda r, a: r[3] > a[3], 2, True)], 100)
    two = run("amount >= 4", [(less, 1, False, lambda r: r["u"] == "v"), (more, 1, False, None, ("u",))])
    assert two == start_loop(rows, high, [(lambda r, a: r[3] < a[3] * 0.5 and r[4] == "v", 1, False), (lambda r, a: r[3] > a[3] and r[4] == a[4] is not None, 1, False)], 100)
    assert max(sizes) <= 2 * len(rows)


def test_sliding_summaries_equal_the_plain_frame(spark):
    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    odd = {"b": [float("nan"), float("inf"), -1.0, 2.0, None]}
    rows = [(i, k, None if i % 50 == 0 else t0 + timedelta(seconds=rng.randrange(200)), rng.choice(odd.get(k, [None, *range(9)]))) for i in range(400) for k in [rng.choice(["a", "b", None])]]
    df = spark.createDataFrame([(i, k, t, None if x is None else float(x)) for i, k, t, x in rows], "id long, k string, ts timestamp, x double")
    measures = {"m": ("mean", 20), "lo": ("min", 30), "hi": ("max", 10), "mid": ("median", 30)}
    plain = {"mean": F.avg, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, 0.5)}
    w = Window.partitionBy("k").orderBy("us")
    want = df.withColumn("us", F.unix_micros("ts")).select("id", *[plain[k]("x").over(w.rangeBetween(-s * 1_000_000, 0)).alias(n) for n, (k, s) in measures.items()])
    new = windows.sliding_summaries(df, ["k"], "ts", "x", measures, ["id"])
    assert " Window" not in new._jdf.queryExecution().toString()  # no frame computed anew at every row
    shown = lambda d: {r["id"]: tuple(None if v is None else format(round(v, 9), "g") for v in r[1:]) for r in d.collect()}
    assert shown(new) == shown(want)


def test_names_that_begin_alike_do_not_all_meet(spark):
    names = [f"Customer#{i:09d}" for i in range(0, 3000, 7)] + ["Customer#00000001", "Customer#0000000012", "customer#00000x012", "Kustomer#000000012", "short", None]
    listed = [f"Customer#{i:09d}" for i in range(0, 3000, 50)] + ["Customer#000000012", "shirt", "aab"]
    a = spark.createDataFrame(list(enumerate(names)), "id long, n string")
    b = spark.createDataFrame(list(enumerate(listed)), "wid long, w string")
    out = match_names(a, "id", "n", b, "wid", "w", 0.93)

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, e in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e)))
        return row[-1]

    want = {(i, j) for i, n in enumerate(names) if n for j, w in enumerate(listed) if 1 - edits(n.lower(), w.lower()) / max(len(n), len(w)) >= 0.93}
    assert {(r["id"], r["watch_id"]) for r in out.collect()} == want and len(want) > 80
    assert "rest" in out._jdf.queryExecution().analyzed().toString()  # candidates of one edit meet without one letter, not on the common half


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("runs, piece", [(3, 5), (2048, 1 << 20)])
def test_runs_meet_in_blocks(spark, monkeypatch, runs, piece):
    monkeypatch.setattr(graph, "RUNS", runs)
    monkeypatch.setattr(graph, "PIECE", piece)
    rng = random.Random(7)
    params = [(r, rng.choice([None, *"abcdefgh"])) for r in [None, *range(14)] for _ in range(4)]
    series = [(r, i, 2.0 if r in (3, 4) else rng.choice([None, *map(float, range(9))])) for r in range(13) for i in [None, *range(6)] if r == 5 or rng.random() < 0.8] + [(6, 1, 4.0), (6, 1, 8.5), (7, 1, 3.0)]
    items = {r: {x for q, x in params if q == r} for r in range(14)}
    want = {}
    for a, b in itertools.combinations(range(14), 2):
        both = items[a] & items[b] - {None}
        if both:
            met = [(x, y) for q, i, x in series for p, j, y in series if (q, p) == (a, b) and i == j is not None and None not in (x, y)]
            x, y = np.array(met).T if met else ([], [])
            r = None if len(met) < 2 or min(np.ptp(x), np.ptp(y)) == 0 else np.corrcoef(x, y)[0, 1]
            j = len(both) / (len(items[a]) + len(items[b]) - len(both))
            want[a, b] = (pytest.approx(j), None if r is None else pytest.approx(r, abs=1e-9), pytest.approx(0.6 * j + 0.2 * ((r or 0) + 1)))
    out = graph.run_similarity(spark.createDataFrame(params, "run long, item string"), spark.createDataFrame(series, "run long, i int, x double"))
    assert "Join" not in plan_of(out)
    got = {(r["a"], r["b"]): (r["jaccard"], r["correlation"], r["similarity"]) for r in out.collect()}
    assert got == want and any(w[1] is None for w in want.values())


def test_runs_are_not_kept_once_per_block(spark, monkeypatch):
    """Every run was shuffled once per block of runs."""
    monkeypatch.setattr(graph, "RUNS", 4)
    params, series = [(r, f"i{r % 3}") for r in range(48)], [(r, i, float(r * i % 7)) for r in range(48) for i in range(5)]
    out = graph.run_similarity(spark.createDataFrame(params, "run long, item string"), spark.createDataFrame(series, "run long, i int, x double"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Generate" not in plan
    assert sorted((r["a"], r["b"]) for r in out.collect()) == [(a, b) for a in range(48) for b in range(a + 1, 48) if a % 3 == b % 3]


def test_vector_blocks_meet_in_groups(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(90, 6)))] + [(90, [1.0] * 6), (91, [1.0] * 6), (92, None), (93, [0.0] * 6)]
    d = spark.createDataFrame(rows, "id long, vec array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:92]}
    asked = d.filter("id % 3 = 0")
    ranked = lambda df: {(r["query"], r["id"], r["rank"]): pytest.approx(r["similarity"]) for r in df.collect()}
    want = {}
    for q in range(0, 92, 3):
        best = sorted((-round(float((unit[q] * u).sum()), 12), i) for i, u in unit.items() if i != q)[:4]
        want |= {(q, i, rank): -s for rank, (s, i) in enumerate(best, 1)}
    exact = search.knn(d, asked, 4, exclude_self=True)
    assert ranked(exact) == want and "collect_list" not in plan_of(exact)
    # one bucket holds all vectors, so the search is exact; no row is made per candidate
    hashed = search.approximate_knn(d.filter("id < 92"), asked.filter("id < 92"), 4, "id", "vec", bucket=100.0, reach=2.1)
    assert ranked(hashed) == want and "Join" not in plan_of(hashed)
    assert search.approximate_knn(d, asked.filter("id > 91"), 4, "id", "vec", reach=0.5).count() == 0


def test_approximate_neighbours_share_a_bucket(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(80, 5)))]
    d = spark.createDataFrame(rows, "id long, vec array<double>")
    v = d.select("id", array_to_vector("vec").alias("unit"))
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="h", bucketLength=0.3, numHashTables=2, seed=42).fit(v)
    h = {r["id"]: (r["a"], r["b"]) for r in model.transform(v).select("id", vector_to_array(F.col("h")[0])[0].alias("a"), vector_to_array(F.col("h")[1])[0].alias("b")).collect()}
    want = set()
    for q, x in rows:
        near = sorted((float(np.linalg.norm(np.subtract(x, y))), i) for i, y in rows if i != q and any(s == t for s, t in zip(h[q], h[i])))
        want |= {(q, i) for dist, i in near[:3] if dist < 0.6}
    got = search.approximate_knn(d, d, 3, "id", "vec", bucket=0.3, tables=2, reach=0.6)
    assert {(r["query"], r["id"]) for r in got.collect()} == want and len(want) > 80


def test_few_keys_do_not_gather_the_rows(spark, tmp_path):
    spark.range(60_000).select("id", (F.col("id") % 3).alias("k"), F.rand(1).alias("x"), F.rand(2).alias("y")).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        keyed, profile = exact_quantiles(t, ["k"], F.col("x"), {"m": 0.5}, few_keys=True), quality.numeric_profile(t, ["x", "y"])
        assert "SortMergeJoin" not in plan_of(keyed)
        assert plan_of(profile).count("SortMergeJoin") <= 2  # of one row per column each
        rows = {r["column_name"]: r for r in profile.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    x = np.array([r[0] for r in t.select("x").collect()])
    assert rows["x"]["median"] == pytest.approx(np.median(x)) and rows["x"]["q1"] == pytest.approx(np.percentile(x, 25)) and rows["x"]["outlier_count"] == 0


def test_triangles_make_no_row_per_path(spark):
    pairs = [*itertools.combinations(range(12), 2), *((0, i) for i in range(20, 60)), *((i, i + 1) for i in range(20, 59)), (5, 5), (1, 0), (None, 3)]
    out = graph.triangles(spark.createDataFrame(pairs, "src long, dst long"))
    assert "LeftSemi" not in plan_of(out)
    links = {frozenset(p) for p in pairs if None not in p and p[0] != p[1]}
    ids = sorted(set().union(*links))
    want = {}
    for t in itertools.combinations(ids, 3):
        if all(frozenset(p) in links for p in itertools.combinations(t, 2)):
            want |= {i: want.get(i, 0) + 1 for i in t}
    assert {r["id"]: r["triangles"] for r in out.collect()} == want


def test_either_end_join_reads_the_edges_once(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, 1), (3, 3), (1, 2), (None, 2), (9, 9)], "src long, dst long").write.parquet(str(tmp_path / "e"))
    groups = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "c"), (None, "d")], "member long, community string")
    out = either_end_join(spark.read.parquet(str(tmp_path / "e")), groups, "src", "dst", "member")
    want = {(1, 2, "a"), (1, 2, "b"), (2, 1, "a"), (2, 1, "b"), (3, 3, "c"), (None, 2, "a"), (None, 2, "b")}
    assert out.columns == ["src", "dst", "community"] and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert plan_of(out).count("FileScan") == 1
