"""Multivariate outliers by an isolation forest whose trees are grown from bounded hash samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from marlstone.session import cut_lineage

SAMPLE = 256


def _path_bonus(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    c = 2.0 * (np.log(safe - 1.0) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, length); a leaf has feature -1 and its path length."""
    nodes: list = []

    def split(rows, depth):
        at = len(nodes)
        nodes.append(None)
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            nodes[at] = (-1, 0.0, -1, -1, depth + float(_path_bonus(np.array(len(rows)))))
            return at
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(low[f], high[f]))
        left = split(rows[rows[:, f] < cut], depth + 1) if (rows[:, f] < cut).any() else None
        if left is None:
            nodes[at] = (-1, 0.0, -1, -1, depth + float(_path_bonus(np.array(len(rows)))))
            return at
        nodes[at] = (f, cut, left, split(rows[rows[:, f] >= cut], depth + 1), 0.0)
        return at

    split(x, 0)
    return nodes


def grow_forest(df: DataFrame, ident: str, features: list[str], trees: int = 100, seed: int = 42, sample_rows: int = SAMPLE, pool: int = 32) -> DataFrame:
    """Node table of the forest: at most ``trees`` x (2 x ``sample_rows`` - 1) rows.

    About ``pool`` x ``sample_rows`` rows are drawn by the hash of their id, whatever the size of the table; every tree takes the
    first ``sample_rows`` of them in a hash order of its own. Both bound what the forest is grown from, not what it scores.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    h = F.xxhash64(F.col(ident), F.lit(seed))
    want = F.least(F.lit(1.0), F.lit(float(sample_rows * pool)) / n)
    drawn = df.withColumn("_h", h).filter(F.pmod(F.col("_h"), F.lit(1_000_000)) < want * 1_000_000)
    dealt = drawn.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_o", F.xxhash64("_h", "tree"))
    w = Window.partitionBy("tree").orderBy("_o", ident)
    sample = dealt.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample_rows) \
        .select("tree", "_r", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    schema = "tree int, node int, feature int, cut double, left int, right int, length double, sample int"

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("_r")[features].to_numpy(dtype=float)
        nodes = _grow(x, np.random.default_rng(seed + k), int(np.ceil(np.log2(max(len(x), 2)))))
        return pd.DataFrame([(k, i, *node, len(x)) for i, node in enumerate(nodes)], columns=[c.split()[0] for c in schema.split(", ")])

    return sample.groupBy("tree").applyInPandas(grow, schema)


def isolation_scores(df: DataFrame, ident: str, features: list[str], trees: int = 100, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Anomaly score 2^(-mean path / expected path) per row, and a mark for the top share of the scores."""
    base = cut_lineage(df.select(ident, *features))
    forest = grow_forest(base, ident, features, trees, seed).orderBy("tree", "node").toPandas()  # bounded: trees x 511 nodes
    if forest.empty:
        return df.withColumns({"anomaly_score": F.lit(0.0), "is_outlier": F.lit(False)})
    arrays = {c: forest[c].to_numpy() for c in ("tree", "feature", "cut", "left", "right", "length", "sample")}
    first = np.unique(arrays["tree"], return_index=True)[1]
    shared = df.sparkSession.sparkContext.broadcast((arrays, first))

    @pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        a, starts = shared.value
        x = np.column_stack([c.fillna(0.0).to_numpy(dtype=float) for c in cols])
        total, expected = np.zeros(len(x)), 0.0
        rows = np.arange(len(x))
        for s in starts:
            at = np.full(len(x), s)
            while True:
                f = a["feature"][at]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(f, 0)] < a["cut"][at]
                at = np.where(inner, s + np.where(go_left, a["left"][at], a["right"][at]), at)
            total += a["length"][at]
            expected += float(_path_bonus(np.array(a["sample"][s])))
        return pd.Series(np.power(2.0, -total / max(expected, 1e-12)))

    from marlstone.functions.quantiles import exact_quantiles
    scored = cut_lineage(base.withColumn("anomaly_score", score(*[F.col(f).cast("double") for f in features])))
    limit = exact_quantiles(scored, [], F.col("anomaly_score"), {"q": 1 - contamination}).select("q").scalar()
    return scored.withColumn("is_outlier", F.col("anomaly_score") > limit)
