"""Recommendations from shared items, popularity, factors, graph rank and their mix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.windows import ranked_top

#: Most items of one user that meet in one block.
BLOCK_ITEMS = 1000


def item_cooccurrence(interactions: DataFrame, user: str, item: str, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_a, item_b, users) for every ordered pair of different items that share users.

    A user's distinct items are dealt into blocks of about ``block_items``; block pairs are independent units, so
    no user is one task. Each Arrow batch counts its pairs before anything is shuffled.
    """
    ui = interactions.select(F.col(user).alias("u"), F.col(item).alias("i")).dropna().distinct()
    blocks = ui.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / block_items).cast("int").alias("n"))
    parts = ui.join(blocks, "u").withColumn("b", F.pmod(F.xxhash64("i"), F.col("n")).cast("int")) \
        .groupBy("u", "n", "b").agg(F.collect_list("i").alias("items"))
    pairs = parts.withColumn("o", F.explode(F.expr("sequence(0, n - 1)"))) \
        .groupBy("u", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y")) \
        .agg(F.max(F.when(F.col("b") <= F.col("o"), F.struct("b", "items"))).alias("p"), F.min(F.when(F.col("b") >= F.col("o"), F.struct((-F.col("b")).alias("b"), "items"))).alias("q")) \
        .select((F.col("x") == F.col("y")).alias("same"), F.col("p.items").alias("first"), F.col("q.items").alias("second")) \
        .filter(F.col("first").isNotNull() & F.col("second").isNotNull())
    kind = interactions.schema[item].dataType.simpleString()

    def count(batches):
        for pdf in batches:
            lefts, rights = [], []
            for same, a, b in zip(pdf["same"], pdf["first"], pdf["second"]):
                a, b = np.asarray(a), np.asarray(b)
                x, y = np.repeat(a, len(b)), np.tile(b, len(a))
                if same:
                    keep = x != y
                    x, y = x[keep], y[keep]
                else:
                    x, y = np.concatenate([x, y]), np.concatenate([y, x])
                lefts.append(x)
                rights.append(y)
            if lefts:
                c = pd.DataFrame({"item_a": np.concatenate(lefts), "item_b": np.concatenate(rights)}).groupby(["item_a", "item_b"]).size()
                yield c.reset_index(name="n")

    return pairs.mapInPandas(count, f"item_a {kind}, item_b {kind}, n long").groupBy("item_a", "item_b").agg(F.sum("n").alias("users"))


def item_recommendations(interactions: DataFrame, user: str, item: str, k: int = 10) -> DataFrame:
    """Per user the ``k`` unseen items with the largest sum of shared users over the items seen."""
    ui = interactions.select(F.col(user).alias("u"), F.col(item).alias("i")).dropna().distinct()
    c = item_cooccurrence(interactions, user, item)
    scored = ui.join(c, F.col("i") == F.col("item_a")).groupBy("u", "item_b").agg(F.sum("users").alias("score"))
    unseen = scored.join(ui, (scored["u"] == ui["u"]) & (scored["item_b"] == ui["i"]), "left_anti")
    return ranked_top(unseen, ["u"], [F.col("score").desc(), F.col("item_b")], k) \
        .select(F.col("u").alias(user), F.col("item_b").alias(item), "score", "rank")


def popular_items(interactions: DataFrame, item: str, k: int = 10) -> DataFrame:
    return interactions.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), item).limit(k)


def als_recommendations(ratings: DataFrame, user: str, item: str, rating: str, k: int = 10, rank: int = 10, seed: int = 42) -> DataFrame:
    """Matrix factors (10 iterations, regularization 0.1, non-negative, cold rows dropped)."""
    from pyspark.ml.recommendation import ALS
    als = ALS(maxIter=10, regParam=0.1, rank=rank, userCol=user, itemCol=item, ratingCol=rating, nonnegative=True, coldStartStrategy="drop", seed=seed)
    model = als.fit(ratings.select(F.col(user).cast("int"), F.col(item).cast("int"), F.col(rating).cast("float")))
    return model.recommendForAllUsers(k).select(user, F.inline("recommendations"))


def graph_recommendations(edges: DataFrame, user: str, item: str, who: list, k: int = 10) -> DataFrame:
    """Items by personalized rank from one set of users, without the items they have."""
    from marlstone.operators.graph import pagerank
    u = F.concat(F.lit("u"), F.col(user).cast("string"))
    i = F.concat(F.lit("i"), F.col(item).cast("string"))
    pairs = edges.select(u.alias("src"), i.alias("dst"), F.col(item).alias("item")).distinct()
    both = pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ids = both.select(F.col("src").alias("id")).distinct()
    p = pagerank(ids, both, sources=[f"u{w}" for w in who])
    have = pairs.filter(F.col("src").isin([f"u{w}" for w in who])).select(F.col("dst").alias("id")).distinct()
    items = pairs.select(F.col("dst").alias("id"), "item").distinct()
    return p.join(items, "id").join(have, "id", "left_anti").orderBy(F.col("rank").desc(), "item").limit(k).select("item", F.col("rank").alias("score"))


#: Weights of the recommendation methods.
METHOD_WEIGHTS = {"content": 0.3, "collaborative": 0.4, "graph": 0.3}


def hybrid(lists: dict[str, DataFrame], user: str, item: str, k: int = 10, weights: dict = METHOD_WEIGHTS) -> DataFrame:
    """Weighted sum of scores over the methods, with the methods that named the item."""
    out = None
    for name, d in lists.items():
        one = d.select(user, item, (F.col("score") * weights[name]).alias("score"), F.lit(name).alias("method"))
        out = one if out is None else out.unionByName(one)
    g = out.groupBy(user, item).agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("reasons"))
    # sums that differ only in the order of addition count as ties
    return ranked_top(g, [user], [F.round("score", 9).desc(), F.col(item)], k)


def recommendation_quality(recommended: DataFrame, held_out: DataFrame, user: str, item: str) -> DataFrame:
    """Precision, recall and F1 per user against items held out of the training data."""
    r, h = recommended.select(user, item).distinct(), held_out.select(user, item).distinct()
    hits = r.join(h, [user, item]).groupBy(user).agg(F.count(F.lit(1)).alias("hits"))
    n = r.groupBy(user).agg(F.count(F.lit(1)).alias("n_rec"))
    m = h.groupBy(user).agg(F.count(F.lit(1)).alias("n_held"))
    j = n.join(m, user).join(hits, user, "left").fillna(0, ["hits"])
    p, q = F.col("hits") / F.col("n_rec"), F.col("hits") / F.col("n_held")
    return j.select(user, p.alias("precision"), q.alias("recall"), F.coalesce(2 * p * q / F.nullif(p + q, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def standardized(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Features minus their mean over their population deviation (1 where that is 0), from one aggregate."""
    from marlstone.functions.columns import one_row
    s = one_row(df.agg(*[a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]))
    z = [(F.col(f) - s[f"m_{f}"]) / F.coalesce(F.nullif(s[f"s_{f}"], F.lit(0.0)), F.lit(1.0)) for f in features]
    return df.select(key, F.array(*z).alias("z"))


def similar_runs(runs: DataFrame, key: str, features: list[str], targets: list, k: int = 5) -> DataFrame:
    """Nearest runs by cosine of standardized parameters, for a short list of target runs."""
    from marlstone.functions.vectors import cosine
    z = standardized(runs, key, features)
    t = z.filter(F.col(key).isin(targets)).select(F.col(key).alias("target"), F.col("z").alias("tz"))
    packed = t.agg(F.collect_list(F.struct("target", "tz")).alias("t")).scalar()  # as many as targets
    d = z.select(F.col(key).alias("run"), "z", F.inline(packed)).filter(F.col("run") != F.col("target"))
    return ranked_top(d.select("target", "run", cosine("z", "tz").alias("similarity")), ["target"], [F.col("similarity").desc(), F.col("run")], k)


def merge_parameter_lists(collaborative: DataFrame, content: DataFrame, keys: list[str]) -> DataFrame:
    """0.6 collaborative + 0.4 content; a list that lacks the entry counts as 0."""
    j = collaborative.select(*keys, F.col("score").alias("c1")).join(content.select(*keys, F.col("score").alias("c2")), keys, "full_outer")
    return j.select(*keys, (0.6 * F.coalesce("c1", F.lit(0.0)) + 0.4 * F.coalesce("c2", F.lit(0.0))).alias("score"))


def success_score(residual: Column, iterations: Column, rate: Column, improvement: Column, optimizations: Column, stability: Column) -> Column:
    """0.4 convergence + 0.3 optimization (where there was one) + 0.3 stability."""
    conv = 1 / (1 + residual) * 0.4 + 1 / (1 + iterations / 100) * 0.3 + F.least(F.abs(rate) / 0.1, F.lit(1.0)) * 0.3
    opt = F.when(optimizations > 0, F.least(improvement / 100, F.lit(1.0)) * 0.5 + 1 / (1 + optimizations / 10) * 0.5).otherwise(0.0)
    return conv * 0.4 + opt * 0.3 + stability * 0.3
