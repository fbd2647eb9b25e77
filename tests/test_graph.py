"""Graph operators against small loops on random graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph as g
from marlstone.operators.compliance import match_names, trading_cycles
from marlstone.operators.joins import hot_keys, salted_lookup


def reach(adj, s, banned=None):
    seen, todo = {s}, [s]
    while todo:
        for y in adj.get(todo.pop(), ()):
            if y not in seen and y != banned:
                seen.add(y)
                todo.append(y)
    return seen


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    n = 40
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(46)] + [(0, 1), (1, 2), (2, 0), (7, 7)]
    v = spark.createDataFrame([(i,) for i in range(n)], "id long").cache()
    e = spark.createDataFrame(pairs, "src long, dst long").cache()
    und, di = {}, {}
    for a, b in pairs:
        if a != b:
            und.setdefault(a, set()).add(b)
            und.setdefault(b, set()).add(a)
            di.setdefault(a, set()).add(b)
    return v, e, n, und, di


def test_components(data):
    v, e, n, und, _ = data
    got = {r["id"]: r["component"] for r in g.connected_components(v, e).collect()}
    assert got == {i: min(reach(und, i)) for i in range(n)}


def test_strong_components(data):
    v, e, n, _, di = data
    r = {i: reach(di, i) for i in range(n)}
    want = {i: max(j for j in range(n) if j in r[i] and i in r[j]) for i in range(n)}
    assert {x["id"]: x["component"] for x in g.strongly_connected_components(v, e).collect()} == want


def long_graph():
    """A cycle of 3,000 with a chain of 3,000 out of it and one of 2,000 into it, and a star of mutual edges: (pairs, strong components by size)."""
    cycle = [(i, (i + 1) % 3000) for i in range(3000)]
    chains = [(2999 + i, 3000 + i) for i in range(3000)] + [(10_000 + i, 10_001 + i) for i in range(2000)] + [(12_000, 5)]
    star = [p for i in range(1, 400) for p in ((20_000, 20_000 + i), (20_000 + i, 20_000))]
    return cycle + chains + star, {3000: 1, 400: 1, 1: 5001}


def test_strong_components_of_long_chains(spark):
    pairs, want = long_graph()
    ids = sorted({i for p in pairs for i in p})
    c = g.strongly_connected_components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(pairs, "src long, dst long")).collect()
    sizes = {}
    for r in c:
        sizes[r["component"]] = sizes.get(r["component"], 0) + 1
    assert {n: list(sizes.values()).count(n) for n in set(sizes.values())} == want
    assert {r["component"] for r in c if r["id"] < 3000} == {2999} and {r["component"] for r in c if 20_000 <= r["id"]} == {20_399}


def test_strong_components_of_dense_and_sparse_graphs(spark):
    rng = random.Random(8)
    for n, m in ((24, 30), (20, 60)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        di = {}
        for a, b in pairs:
            di.setdefault(a, set()).add(b)
        r = {i: reach(di, i) for i in range(n)}
        got = {x["id"]: x["component"] for x in g.strongly_connected_components(spark.range(n), spark.createDataFrame(pairs, "src long, dst long")).collect()}
        assert got == {i: max(j for j in r[i] if i in r[j]) for i in range(n)}


def test_blocks_of_long_chains(spark):
    pairs, _ = long_graph()
    ids = sorted({i for p in pairs for i in p})
    got = {r["id"]: (r["blocks"], r["cyclic"]) for r in g.block_counts(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got[2999] == (2, True) and got[5] == (2, True) and got[7] == (1, True) and got[4000] == (2, False) and got[5999] == (1, False)
    assert got[10_000] == (1, False) and got[11_000] == (2, False) and got[20_000] == (399, False) and got[20_001] == (1, False)


def test_blocks_against_removal(spark):
    rng = random.Random(21)
    for n, m in ((16, 18), (20, 34)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        und = {}
        for a, b in pairs:
            if a != b:
                und.setdefault(a, set()).add(b)
                und.setdefault(b, set()).add(a)
        got = {r["id"]: r for r in g.block_counts(spark.range(n), spark.createDataFrame(pairs, "src long, dst long")).collect()}
        for i in range(n):
            parts = {min(reach({k: s for k, s in und.items() if k != i}, x, banned=i)) for x in und.get(i, ())}
            assert got[i]["blocks"] == len(parts)
            assert got[i]["cyclic"] == (len(und.get(i, ())) > len(parts))  # two neighbours that stay connected without it


@pytest.mark.parametrize("rest", [0, 4, g.REST])
def test_blocks_of_rings_that_share_vertices(spark, monkeypatch, rest):
    monkeypatch.setattr(g, "REST", rest)
    rng, pairs, base = random.Random(rest), [(0, 1)], 2
    for n in (3, 4, 5, 6, 9):  # rings alone, with a tail, two at one vertex, two joined by an edge
        ring = lambda at: [(at + i, at + (i + 1) % n) for i in range(n)]
        pairs += ring(base) + ring(base + n) + [(base + n, base + 2 * n), (base + 2 * n, base + 2 * n + 1)]
        base += 2 * n + 2
        pairs += ring(base) + [(base, base + n), *[(base + n + i, base + n + i + 1) for i in range(n)], (base + 2 * n, base)]
        base += 2 * n + 1
        pairs += ring(base) + ring(base + n) + [(base + 1, base + n + 1)]
        base += 2 * n
    name = rng.sample(range(base), base)
    pairs = [(name[a], name[b]) for a, b in pairs]
    und = {}
    for a, b in pairs:
        und.setdefault(a, set()).add(b)
        und.setdefault(b, set()).add(a)
    got = {r["id"]: r for r in g.block_counts(spark.range(base), spark.createDataFrame(pairs, "src long, dst long")).collect()}
    for i in range(base):
        parts = {min(reach(und, x, banned=i)) for x in und[i]}
        assert (got[i]["blocks"], got[i]["cyclic"]) == (len(parts), len(und[i]) > len(parts))


def test_blocks_take_few_steps(spark, monkeypatch):
    # a target drawn for every vertex: trees of all depths on a few cycles
    rng, steps = random.Random(3), []
    for name in ("written", "cut_lineage"):
        monkeypatch.setattr(g, name, lambda df, keep=getattr(g, name): steps.append(1) or keep(df))
    n = 400
    pairs = [(str(i), str(rng.randrange(n))) for i in range(n)]
    und = {}
    for a, b in pairs:
        if a != b:
            und.setdefault(a, set()).add(b)
            und.setdefault(b, set()).add(a)
    got = {r["id"]: r for r in g.block_counts(spark.range(n).selectExpr("string(id) id"), spark.createDataFrame(pairs, "src string, dst string")).collect()}
    for i in und:
        parts = {min(reach(und, x, banned=i)) for x in und[i]}
        assert (got[i]["blocks"], got[i]["cyclic"]) == (len(parts), len(und[i]) > len(parts))
    assert len(steps) < 16


def test_communities_reach_a_good_partition(spark):
    ring = [(4 * i + a, 4 * i + b) for i in range(64) for a in range(4) for b in range(a)] + [(4 * i, (4 * i + 5) % 256) for i in range(64)]
    e = spark.createDataFrame(ring, "src long, dst long")
    c = g.modularity_communities(spark.range(256), e).cache()
    q = c.select(g.modularity(g.links(e).withColumnsRenamed({"a": "src", "b": "dst"}), c.select("id", "community")).select("modularity").scalar().alias("q")).first()["q"]
    assert q > 0.85 and c.first()["converged"] and c.first()["levels"] > 1  # single cliques give 0.84
    star = spark.createDataFrame([(0, i) for i in range(1, 300)], "src long, dst long")
    assert g.modularity_communities(spark.range(302), star).filter("id > 299").filter("id <> community").isEmpty()


def test_triangles(data):
    v, e, n, und, _ = data
    tri = [t for t in itertools.combinations(range(n), 3) if all(b in und.get(a, ()) for a, b in itertools.combinations(t, 2))]
    got = {r["id"]: r["triangles"] for r in g.clustering(v, e).collect()}
    assert got == {i: sum(i in t for t in tri) for i in range(n)} and tri


def test_articulation_points(spark):
    rng = random.Random(11)
    pairs = [(rng.randrange(14), rng.randrange(14)) for _ in range(15)] + [(20, 21), (21, 22), (22, 20), (22, 23), (3, 3)]
    und = {}
    for a, b in pairs:
        if a != b:
            und.setdefault(a, set()).add(b)
            und.setdefault(b, set()).add(a)
    want = {c for c in und if len({min(reach({k: s for k, s in und.items() if k != c}, x, banned=c)) for x in und[c]}) > 1}
    v = spark.range(25)
    e = spark.createDataFrame(pairs, "src long, dst long")
    assert want and {r["id"] for r in g.articulation_points(v, e).collect()} == want


def test_pagerank_sums_to_one(data):
    v, e, n, *_ = data
    p = g.pagerank(v, e).collect()
    assert len(p) == n and sum(r["rank"] for r in p) == pytest.approx(1.0)


def test_salted_lookup(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(900).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    got = salted_lookup(left, "k", table, "key", ["v"], hot=[1]).collect()
    assert len(got) == 900 and all(r["v"] == 2 * r["k"] for r in got)
    assert hot_keys(left, "k") == []  # small keys need no salt


def test_trading_cycles(spark):
    from datetime import datetime
    t = datetime(2024, 1, 1, 5)
    rows = [("x", t, *p) for p in [(1, 2), (2, 3), (3, 1), (4, 5), (5, 4), (6, 1), (3, 7), (7, 8), (8, 7)]]
    df = spark.createDataFrame(rows, "token string, ts timestamp, a long, b long")
    assert {r["address"] for r in trading_cycles(df, "token", "ts", "a", "b").collect()} == {1, 2, 3}


def test_trading_cycles_against_walks(spark):
    from datetime import datetime
    rng = random.Random(2)
    t = datetime(2024, 1, 1, 5)
    rows = [(token, t, rng.randrange(n), rng.randrange(n)) for token, n, m in (("x", 9, 12), ("y", 12, 22), ("z", 8, 9)) for _ in range(m)]
    rows += [("big", t, i, (i + 1) % 2000) for i in range(2000)] + [("big", t, 5000, 3), ("big", t, 3, 5000)]
    want = {("big", i) for i in range(2000)}
    for token in "xyz":
        out = {}
        for k, _, a, b in rows:
            if k == token and a != b:
                out.setdefault(a, set()).add(b)

        def closes(start, at, path):
            return any((y == start and len(path) >= 3) or (y not in path and closes(start, y, path | {y})) for y in out.get(at, ()))

        want |= {(token, a) for a in out if closes(a, a, {a})}
    got = trading_cycles(spark.createDataFrame(rows, "token string, ts timestamp, a long, b long"), "token", "ts", "a", "b")
    assert {(r["token"], r["address"]) for r in got.collect()} == want


def test_name_matching_is_complete(spark):
    rng = random.Random(1)
    names = list({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 9))) for _ in range(120)})

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    a = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "id int, n string")
    w = spark.createDataFrame([(i, x) for i, x in enumerate(names[:30])], "wid int, w string")
    got = {(r["id"], r["watch_id"]) for r in match_names(a, "id", "n", w, "wid", "w", 0.7).collect()}
    assert got == {(i, j) for i, x in enumerate(names) for j, y in enumerate(names[:30]) if 1 - lev(x, y) / max(len(x), len(y)) >= 0.7}


def test_pointers_stop_once_they_reach_the_cycles(spark, monkeypatch):
    """on cycles the pointers were doubled up to the number of vertices, and then once more without the largest of each."""
    n, rounds = 4096, []
    rng = random.Random(5)
    pairs = [(i, i + 1 if i % 4 < 3 else i - 3) for i in range(0, 64)] + [(i, rng.randrange(max(64, i - 64) if i > 64 else 64)) for i in range(64, n)]
    keep = g.written
    monkeypatch.setattr(g, "written", lambda df: rounds.append(1) or keep(df))
    anchors, pointers = g.single_parents(spark.createDataFrame(pairs, "src long, dst long"), "dst", "src")
    assert len(rounds) < 13 and len(pointers) < 10
    to = dict(pairs)

    def top(v):
        for _ in range(n):
            v = to[v]
        return v | 3  # the largest of a cycle of four

    assert {r["v"]: r["anchor"] for r in anchors.collect()} == {v: top(v) for v in to if v != top(v)}
