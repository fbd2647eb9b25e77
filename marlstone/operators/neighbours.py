"""Exact nearest neighbours of many vectors by pivots: only blocks that can still hold a neighbour are compared."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.windows import ranked_top
from marlstone.session import cut_lineage, ship_package

#: Vectors of one block; a block of 64 doubles each is 2 MB.
BLOCK = 4096
#: Rows of a block the bounds speak of: neighbouring rings of a pivot are joined until they hold as many.
ROWS = 4096
#: Bytes of vectors a task holds at a time, to meet batches of queries with.
HELD = 1 << 26
#: Width of a ring of distances around a pivot; distances of unit vectors are at most 2.
RING = 1 / 32
#: Pivots; with 65 rings each the bounds stay below 70,000 rows, whatever the table.
MAX_PIVOTS = 1024
#: Rows a task holds against all pivots or bounds, or sends on, at a time: its memory does not grow with their number.
AT_ONCE = 512
#: Meetings of queries and blocks a task sorts at a time.
MEETINGS = 1 << 21
#: Slack of distance bounds for rounding.
SLACK = 1e-6


def _unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and a mask of the usable ones (not zero, nothing missing or infinite)."""
    m = np.array([np.asarray(v, dtype=float) for v in vectors])
    size = np.linalg.norm(m, axis=1) if len(m) else np.zeros(0)
    ok = np.isfinite(size) & (size > 0)
    return m[ok] / size[ok, None], ok


def _distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * unit @ pivots.T, 0))


def _chunks(batches):
    for pdf in batches:
        for s in range(0, len(pdf), AT_ONCE):
            yield pdf.iloc[s:s + AT_ONCE]


def _in_cells(df: DataFrame, key: str, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot, the ring and the distance; unusable vectors drop out."""
    kind = df.schema[key].dataType.simpleString()

    def assign(batches):
        for pdf in _chunks(batches):
            unit, ok = _unit(pdf["vec"])
            if not ok.any():
                continue
            d = _distances(unit, pivots)
            cell = d.argmin(axis=1)
            near = d[np.arange(len(d)), cell]
            yield pd.DataFrame({key: pdf[key][ok], "vec": pdf["vec"][ok], "cell": cell.astype("int32"), "ring": (near / RING).astype("int32"), "dist": near})

    return df.select(key, "vec").mapInPandas(assign, f"`{key}` {kind}, vec array<double>, cell int, ring int, dist double")


def _routed(queries: DataFrame, pivots: np.ndarray, bounds: pd.DataFrame, want: int) -> DataFrame:
    """Places in ``bounds`` of the nearest blocks that hold ``want`` rows, as ``met``; with ``worst`` (similarity of the last
    neighbour found there) also the number of the other blocks whose lower distance bound is within that neighbour's distance, as ``more``.
    """
    cell, n, low, high = (bounds[c].to_numpy() for c in ("cell", "n", "low", "high"))
    second = "worst" in queries.columns

    def route(batches):
        for pdf in _chunks(batches):
            unit, _ = _unit(pdf["vec"])
            d = _distances(unit, pivots)[:, cell]
            least = np.maximum(np.maximum(d - high, low - d), 0)
            met = []
            for i in range(len(pdf)):
                order = np.lexsort((d[i], least[i]))
                met.append(order[:np.searchsorted(n[order].cumsum(), want) + 1].astype("int32"))
            out = pdf.assign(met=met)
            if second:
                near = least <= _reach(pdf["worst"].to_numpy(dtype=float))[:, None]
                out["more"] = np.array([near[i].sum() - near[i][first].sum() for i, first in enumerate(met)], dtype="int32")
            yield out[["q", "vec", "cell", "dist", "met"] + (["worst", "more"] if second else [])]

    return queries.mapInPandas(route, "q long, vec array<double>, cell int, dist double, met array<int>" + (", worst double, more int" if second else ""))


def _reach(worst: np.ndarray) -> np.ndarray:
    """Distance within which blocks can hold more similar rows than the worst so far (not a number: there are too few)."""
    return np.where(np.isnan(worst), np.inf, np.sqrt(np.maximum(2 - 2 * worst, 0)) + SLACK)


def _by_meetings(batches):
    """The rows in pieces that meet at most ``MEETINGS`` blocks in all, or of one row."""
    for pdf in batches:
        sent = pdf["met"].map(len).cumsum().to_numpy()
        start = 0
        while start < len(pdf):
            done = sent[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sent, done + MEETINGS, "right")))
            yield pdf.iloc[start:end]
            start = end


def _compared(routed: DataFrame, blocks: DataFrame, want: int, id_type: str) -> DataFrame:
    """The best ``want`` rows of every block a query is routed to: (q, id, similarity), ties by id. A query is sent once per block, so
    these are to be few."""

    def pack(batches):
        for pdf in _by_meetings(batches):
            at: dict[int, list[int]] = {}
            for i, met in enumerate(pdf["met"]):
                for b in met:
                    at.setdefault(int(b), []).append(i)
            q, v = pdf["q"].to_numpy(), pdf["vec"].to_numpy()
            for b, rows in at.items():
                for s in range(0, len(rows), BLOCK):
                    r = rows[s:s + BLOCK]
                    yield pd.DataFrame({"block": np.array([b], dtype="int32"), "qs": [q[r]], "qvecs": [np.concatenate(list(v[r]))]})

    # queries of one neighbourhood travel together, so that a batch meets few blocks
    near = routed.repartitionByRange("cell", "dist").sortWithinPartitions("cell", "dist")
    packed = near.mapInPandas(pack, "block int, qs array<long>, qvecs array<double>")

    def search(batches):
        for pdf in batches:
            for ids, dv, qs, qv in zip(pdf["ids"], pdf["vecs"], pdf["qs"], pdf["qvecs"]):
                x, y = dv.reshape(len(ids), -1), qv.reshape(len(qs), -1)
                nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
                keep = min(want, len(ids))
                for s in range(0, len(qs), 64):
                    part = slice(s, s + 64)
                    sims = (y[part] @ x.T) / np.outer(ny[part], nx)
                    least = -np.partition(-sims, keep - 1, axis=1)[:, keep - 1]
                    r, c = np.nonzero(sims >= least[:, None] - SLACK * SLACK)
                    # one product per pair, the same in every block: equal vectors tie exactly
                    exact = np.concatenate([(y[part][r[i:i + BLOCK]] * x[c[i:i + BLOCK]]).sum(axis=1) for i in range(0, len(r), BLOCK)] or [np.zeros(0)])
                    exact = exact / (ny[part][r] * nx[c])
                    order = np.lexsort((c, -exact, r))  # ids of a block are in order
                    r, c, exact = r[order], c[order], exact[order]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    top = place < keep
                    yield pd.DataFrame({"q": qs[part][r[top]], "id": pd.Series([ids[i] for i in c[top]], dtype=object), "similarity": exact[top]})

    return packed.join(blocks.hint("merge"), "block").select("ids", "vecs", "qs", "qvecs").mapInPandas(search, f"q long, id {id_type}, similarity double")


class _Batch:
    """Queries that meet block after block: the floor of each rises with the best rows found."""

    def __init__(self, row: dict, want: int):
        self.qs, self.met = (row[c].values.to_numpy(zero_copy_only=False) for c in ("qs", "worsts"))
        self.vecs = row["qvecs"].values.to_numpy(zero_copy_only=False).reshape(len(self.qs), -1)
        self.reach, self.floor = _reach(self.met), np.where(np.isnan(self.met), -2.0, self.met)
        self.norm = np.linalg.norm(self.vecs, axis=1)
        unit = self.vecs / self.norm[:, None]
        self.unit, self.single = unit, unit.astype("float32")
        first = row["firsts"].values
        self.first = np.repeat(np.arange(len(self.qs)), first.value_lengths().to_numpy(zero_copy_only=False)), first.flatten().to_numpy(zero_copy_only=False)
        self.want, self.best, self.hits = want, np.full((len(self.qs), want), -2.0), []

    def meet(self, block: int, bound, ids: pa.Array, x: np.ndarray) -> None:
        """Takes the rows of a block that may be among the best of a query that the bound cannot keep away from it."""
        pivot, low, high = bound
        d = np.sqrt(np.maximum(2 - 2 * self.unit @ pivot, 0))
        near = np.maximum(np.maximum(d - high, low - d), 0) <= self.reach
        near[self.first[0][self.first[1] == block]] = False
        asks = np.flatnonzero(near)
        if not len(asks):
            return
        norm, keep = np.linalg.norm(x, axis=1), min(self.want, len(ids))
        single = (x / norm[:, None]).astype("float32").T
        # products of single precision name the candidates; what they may be off by is left to them
        off = (x.shape[1] + 8) * 2.0 ** -23
        for s in range(0, len(asks), AT_ONCE):
            rows = asks[s:s + AT_ONCE]
            sims = self.single[rows] @ single
            least = (self.floor[rows] - off).astype("float32") - np.float32(off)
            some = sims >= least[:, None]
            many = np.flatnonzero(some.sum(axis=1) > 4 * keep + 64)
            if len(many):
                best = -np.partition(-sims[many], keep - 1, axis=1)[:, keep - 1]
                some[many] &= sims[many] >= (best - np.float32(3 * off))[:, None]
            r, c = np.nonzero(some)
            r = rows[r]
            # one product per pair, the same in every block: equal vectors tie exactly
            exact = np.concatenate([(self.vecs[r[i:i + BLOCK]] * x[c[i:i + BLOCK]]).sum(axis=1) for i in range(0, len(r), BLOCK)] or [np.zeros(0)])
            exact = exact / (self.norm[r] * norm[c])
            good = exact >= self.floor[r] - SLACK * SLACK
            r, c, exact = r[good], c[good], exact[good]
            if not len(r):
                continue
            order = np.lexsort((c, -exact, r))  # ids of a block are in order
            r, c, exact = r[order], c[order], exact[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            top = place < keep
            r, c, exact, place = r[top], c[top], exact[top], place[top]
            self.hits.append((r, exact, ids.take(pa.array(c))))
            who, at = np.unique(r, return_inverse=True)
            new = np.full((len(who), keep), -2.0)
            new[at, place] = exact
            best = np.concatenate([self.best[who], new], axis=1)
            self.best[who] = -np.partition(-best, self.want - 1, axis=1)[:, :self.want]
            self.floor[who] = np.maximum(self.floor[who], self.best[who].min(axis=1))

    def found(self):
        for r, exact, ids in self.hits:
            good = exact >= self.floor[r] - SLACK * SLACK
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(self.qs[r[good]]), ids.filter(pa.array(good)), pa.array(exact[good])], ["q", "id", "similarity"])


def _beyond(routed: DataFrame, blocks: DataFrame, pivots: np.ndarray, bounds: pd.DataFrame, want: int, id_type: str) -> DataFrame:
    """Of the blocks within reach of a query, but for the nearest it has met, the rows that may be among its best: (q, id, similarity).

    Every task meets some batches of queries with some blocks, read again from shared storage, so nothing is sent once per query and block.
    It gives out ``want`` rows a query, more only where rows of several blocks tie.
    """
    asking = routed.filter("more > 0")
    n, rows, width = asking.count(), int(bounds["n"].sum()), 8 * max(1, pivots.shape[1])
    cores = routed.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // (4 * BLOCK)), min(2 * cores, -(-n // AT_ONCE)))

    def pack(batches):
        for b in batches:
            step = -(-b.num_rows // max(1, -(-b.num_rows // BLOCK)))
            for s in range(0, b.num_rows, max(1, step)):
                part = b.slice(s, step)
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], "int32"), v)
                yield pa.RecordBatch.from_arrays([one(part.column("q")), one(part.column("worst").fill_null(float("nan"))), one(part.column("met")), one(part.column("vec").flatten())],
                                                 ["qs", "worsts", "firsts", "qvecs"])

    # queries of one neighbourhood travel together, so that a batch meets few blocks
    near = asking.repartitionByRange(parts, "cell", "dist").sortWithinPartitions("cell", "dist").select("q", "worst", "met", "vec")
    packed = cut_lineage(near.mapInArrow(pack, "qs array<long>, worsts array<double>, firsts array<array<int>>, qvecs array<double>").withColumn("batch", F.monotonically_increasing_id()))
    held = cut_lineage(blocks.repartition(max(1, -(-rows * width // HELD))))
    cell, low, high = (bounds[c].to_numpy() for c in ("cell", "low", "high"))

    def search(batches):
        batch = number = None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                if row["batch"].as_py() != number:
                    if batch:
                        yield from batch.found()
                    batch, number = _Batch(row, want), row["batch"].as_py()
                k, ids = row["block"].as_py(), row["ids"].values
                batch.meet(k, (pivots[cell[k]], low[k], high[k]), ids, row["vecs"].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        if batch:
            yield from batch.found()

    met = packed.join(held.hint("shuffle_replicate_nl"))
    return met.mapInArrow(search, f"q long, id {id_type}, similarity double")


def knn_by_pivots(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "id", doc_vec: str = "vec", query_id: str = "id", query_vec: str = "vec",
                  where: Column | None = None, exclude_self: bool = False, n_pivots: int | None = None, seed: int = 42) -> DataFrame:
    """Exact nearest neighbours by cosine: (query, id, similarity, rank, blocks), ties by id.

    Documents are filed under their nearest pivot and a ring of distances around it; rings make blocks of some 4096 rows and more. Every query first searches the nearest blocks
    that hold ``k`` rows; the triangle inequality then rules out each block whose pivot and ring lie beyond the last neighbour
    found, and only the others are compared: few where vectors cluster, all where they are spread evenly in many dimensions. ``blocks`` counts the blocks a query met.

    Equal vectors are searched once, and of equal documents only as many as a rank can name, so a hot vector costs nothing more.
    Vectors that are null, zero or hold missing or infinite parts neither ask nor answer. Vectors must have one length. A null id
    is no one's own. Pivots come from a bounded sample and decide only the cost.
    """
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.filter(where) if where is not None else docs
    usable = lambda c: F.exists(c, lambda x: x != 0) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    d = d.filter(usable(doc_vec)).select(F.col(doc_id).alias("id"), F.col(doc_vec).cast("array<double>").alias("vec"))
    ask = queries.filter(usable(query_vec)).select(F.col(query_id).alias("query"), F.col(query_vec).cast("array<double>").alias("qvec"))
    id_type = d.schema["id"].dataType.simpleString()
    want = k
    if exclude_self:  # rows a query may lose to itself
        want += d.filter("id is not null").groupBy("id").count().agg(F.max("count")).first()[0] or 0
    d = cut_lineage(ranked_top(d, ["vec"], [F.col("id")], want).select("id", "vec"))
    n = d.count()
    pivots, _ = _unit([r["vec"] for r in d.select("vec").orderBy(F.xxhash64("vec", F.lit(seed))).limit(n_pivots or min(MAX_PIVOTS, -(-n // ROWS))).collect()])
    if not len(pivots):
        pivots = np.zeros((1, 1))
        d = d.limit(0)
    filed = cut_lineage(_in_cells(d, "id", pivots))
    rings = filed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).orderBy("cell", "ring").toPandas()
    if not len(rings):
        return spark.createDataFrame([], f"query {ask.schema['query'].dataType.simpleString()}, id {id_type}, similarity double, rank int, blocks int")
    before = rings.groupby("cell")["n"].cumsum() - rings["n"]
    rings["block"] = rings.groupby(["cell", before // ROWS]).ngroup().astype("int32")
    bounds = rings.groupby("block").agg(cell=("cell", "first"), n=("n", "sum"), low=("low", "min"), high=("high", "max")).reset_index()
    rings["parts"] = -(-bounds["n"].to_numpy()[rings["block"]] // BLOCK)
    numbered = spark.createDataFrame(rings[["cell", "ring", "block", "parts"]], "cell int, ring int, block int, parts long")
    rows = F.array_sort(F.collect_list(F.struct("id", "vec")))
    blocks = filed.join(F.broadcast(numbered), ["cell", "ring"]).groupBy("block", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(rows.alias("rows")) \
        .select("block", F.col("rows.id").alias("ids"), F.flatten("rows.vec").alias("vecs"))

    distinct = cut_lineage(ask.select(F.col("qvec").alias("vec")).distinct().withColumn("q", F.monotonically_increasing_id()))
    located = _in_cells(distinct, "q", pivots).drop("ring")
    start = cut_lineage(_routed(located, pivots, bounds, want))
    first = cut_lineage(ranked_top(_compared(start, blocks, want, id_type), ["q"], [F.col("similarity").desc(), F.col("id")], want))
    worst = first.filter(F.col("rank") == want).select("q", F.col("similarity").alias("worst"))
    rest = cut_lineage(_routed(located.join(worst, "q", "left"), pivots, bounds, want))
    found = first.drop("rank").unionByName(_beyond(rest, blocks, pivots, bounds, want, id_type))
    best = ranked_top(found, ["q"], [F.col("similarity").desc(), F.col("id")], want).groupBy("q").agg(F.collect_list(F.struct("id", "similarity")).alias("best"))
    answers = rest.select("q", F.col("vec").alias("qvec"), (F.size("met") + F.col("more")).alias("blocks")).join(best, "q").drop("q")
    pairs = ask.join(answers, "qvec").select("query", "blocks", F.inline("best"))
    if exclude_self:
        pairs = pairs.filter(~F.col("query").eqNullSafe(F.col("id")) | F.col("query").isNull())
    return ranked_top(pairs, ["query"], [F.col("similarity").desc(), F.col("id")], k).select("query", "id", "similarity", "rank", "blocks")


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours (query, id) an approximate search found, over all queries: (expected, found, recall)."""
    hit = exact.select("query", "id").join(approximate.select("query", "id", F.lit(1).alias("hit")).distinct(), ["query", "id"], "left")
    return hit.agg(F.count("*").alias("expected"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.nullif(F.col("expected"), F.lit(0)))
