"""Exact search by pivots against all pairs in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import neighbours, search

DOCS = "id long, vec array<double>"


def clustered(n=600, dims=8, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, dims))


def brute(docs, queries, k, exclude_self):
    out = {}
    for q, v in queries:
        v = np.asarray(v)
        rows = [(-round(float((v * np.asarray(w)).sum() / (np.linalg.norm(v) * np.linalg.norm(w))), 9), i) for i, w in docs if not (exclude_self and i == q)]
        out[q] = [(i, -s) for s, i in sorted(rows)[:k]]
    return out


def ranked(df):
    got = {}
    for r in df.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], round(r["similarity"], 9)))
    return got


@pytest.mark.parametrize("block", [4096, 16])
def test_pivots_equal_all_pairs_and_skip_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "ROWS", 24)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(clustered())]
    d = spark.createDataFrame(rows, DOCS)
    got = neighbours.knn_by_pivots(d, d, 4, exclude_self=True).cache()
    assert ranked(got) == brute(rows, rows, 4, True)
    assert ranked(got) == ranked(search.knn(d, d, 4, exclude_self=True))
    assert got.agg(F.avg("blocks")).first()[0] < 0.5 * len(rows) / 24


def test_pivots_with_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    hot = [1.0, 2.0, -1.0]
    good = [(i, hot) for i in range(40)] + [(100 + i, [float(x) for x in rng.normal(size=3)]) for i in range(60)] + [(200 + i, [-2.0 * x for x in hot]) for i in range(5)]
    odd = [(300, None), (301, [0.0, 0.0, 0.0]), (302, [float("nan"), 1.0, 1.0]), (303, [float("inf"), 1.0, 1.0]), (304, []), (305, [None, 1.0, 1.0])]
    d = spark.createDataFrame(good + odd, DOCS)
    assert ranked(neighbours.knn_by_pivots(d, d, 3, exclude_self=True)) == brute(good, good, 3, True)
    few = d.filter("id >= 250 or id in (0, 100, 203)")
    asked = [(i, v) for i, v in good if i in (0, 100, 203)]
    kept = [(i, v) for i, v in good if i >= 100]
    assert ranked(neighbours.knn_by_pivots(d, few, 70, where=F.col("id") >= 100)) == brute(kept, asked, 70, False)


def test_pivots_with_repeated_ids_strings_and_nothing(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.1]), ("a", [1.0, 0.0]), ("b", [1.0, 0.2]), ("c", [0.0, 1.0])]
    d = spark.createDataFrame(rows, "id string, vec array<float>")
    got = neighbours.knn_by_pivots(d, d.filter("id = 'a'").limit(1), 2, exclude_self=True)
    assert [r["id"] for r in got.orderBy("rank").collect()] == ["b", "c"]
    assert neighbours.knn_by_pivots(d.limit(0), d, 2).count() == 0
    assert neighbours.knn_by_pivots(d, d.limit(0), 2).count() == 0


def test_recall_counts_exact_neighbours(spark):
    exact = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 4)], "query int, id int")
    some = spark.createDataFrame([(1, 2), (1, 2), (2, 4), (2, 9)], "query int, id int")
    assert tuple(neighbours.recall(some, exact).first()) == (4, 2, 0.5)
    assert neighbours.recall(some, exact.limit(0)).first()["recall"] is None


def test_queries_are_routed_a_few_at_a_time(monkeypatch):
    """a task held the distances of a whole batch of queries to all blocks, and all their meetings."""
    import pandas as pd
    monkeypatch.setattr(neighbours, "AT_ONCE", 4, raising=False)
    monkeypatch.setattr(neighbours, "MEETINGS", 10, raising=False)
    pdf = pd.DataFrame({"q": range(11), "met": [[0] * n for n in (3, 3, 4, 1, 25, 0, 9, 1, 1, 0, 0)]})
    assert [len(p) for p in neighbours._chunks([pdf])] == [4, 4, 3]
    pieces = [list(p["q"]) for p in neighbours._by_meetings([pdf])]
    assert sum(pieces, []) == list(range(11)) and all(len(p) == 1 or sum(len(pdf["met"][q]) for q in p) <= 10 for p in pieces)


def test_spread_vectors_are_not_sent_to_every_block(spark, monkeypatch):
    """Where bounds rule nothing out, a query was shuffled once per block: the square of the rows over a block's."""
    for name, value in {"BLOCK": 16, "ROWS": 24, "AT_ONCE": 32, "HELD": 8 * 6 * 60}.items():
        monkeypatch.setattr(neighbours, name, value, raising=False)
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)))] + [(300 + i, [float(i % 6 == j) for j in range(6)]) for i in range(60)]
    rows += [(360 + i, [0.0] * j + [1.0, 1.0] + [0.0] * (4 - j)) for i, j in enumerate([0, 1, 2, 3, 4] * 3)]
    d = spark.createDataFrame(rows, DOCS)
    sent, compared = [], neighbours._compared
    monkeypatch.setattr(neighbours, "_compared", lambda routed, *a: sent.append(routed.agg(F.sum(F.size("met"))).first()[0]) or compared(routed, *a))
    got = neighbours.knn_by_pivots(d, d, 5, exclude_self=True, n_pivots=4)
    assert ranked(got) == brute(rows, rows, 5, True)
    assert got.agg(F.avg("blocks")).first()[0] > 8 and sum(sent) < 3 * len(rows)
