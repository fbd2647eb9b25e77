"""Near-duplicate vectors by robust-pruned flat graphs over overlapping cluster shards.

Vectors meet only within a label. Equal directions are merged first. A label with more vectors than a shard holds is split by centroids learned
from a bounded sample of it, each vector going to the shards of its ``overlap`` nearest centroids, again and again until all shards are
small enough; a shard that clusters cannot split is dealt into tiles of two blocks each, so that every pair still meets. Then, per shard:

1. Build. From a random graph, two passes over all vectors search the graph for each of them and keep the pruned neighbours: a
   candidate goes if a kept one is closer to it by the factor ``alpha``. Nodes that the medoid does not reach are linked to it.
2. Union. The adjacency lists that a vector got in its shards become one, and go back to each of them.
3. Search. Greedy search from the medoid for every vector, with a beam that widens until the vector itself is found; from there the
   range expands over all neighbours within a slightly larger radius until nothing new comes up.
4. Verify. Pairs found from either side are compared in double precision. A pair that meets in several shards counts in the first.

Links leave a shard as one count per vector and one edge to the least member of its part, never as pairs. The operator audits itself:
a bounded sample of vectors is compared with all others; if a link is missing, everything is done again with twice the overlap and beam,
up to the point where all vectors of a label meet.

Rows: null labels, and vectors that are null, empty, zero or hold a null or non-finite component, link with nothing; vectors of unequal
length do not link. Repeated rows are vectors of their own that link with each other. Rows without an id take part; a component without any
id has none, and a vector is ``kept`` if its id is the component's, both null included. An empty table gives no rows. Only id, vector and
label are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import column, small_batches
from marlstone.operators.graph import connected_components
from marlstone.session import written


@dataclass(frozen=True)
class Config:
    """``shard_rows`` and ``shard_cells`` (rows x components) bound a shard; ``sample_rows`` the vectors that centroids are learned from,
    per split; ``audit_rows`` the vectors that are compared with all others."""

    threshold: float = 0.93
    shard_rows: int = 8192
    shard_cells: int = 1 << 22
    overlap: int = 2
    degree: int = 24
    beam: int = 48
    alpha: float = 1.2
    slack: float = 1.3
    fanout: int = 64
    levels: int = 8
    sample_rows: int = 4096
    audit_rows: int = 512
    audit_recall: float = 0.999

    def room(self, dim):
        return F.greatest(F.lit(64), F.least(F.lit(self.shard_rows), F.floor(F.lit(self.shard_cells) / dim)))


# -- graph of one shard ---------------------------------------------------------------------------------------

BATCH = 512
#: (query, node) pairs whose neighbours are looked at together, and pairs verified together.
FRONT = 4096
VERIFIED = 1 << 17
WIDTH = 4


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def similarities(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows ``x[a[i]]`` and ``y[b[i]]``."""
    out = np.empty(len(a), x.dtype)
    for at in range(0, len(a), VERIFIED):
        some = slice(at, at + VERIFIED)
        out[some] = np.einsum("id,id->i", x[a[some]], y[b[some]])
    return out


def beam_search(x: np.ndarray, near: np.ndarray, q: np.ndarray, start: int, beam: int):
    """Greedy search for each row of ``q`` from ``start``: the beam's nodes and similarities (-1 and -inf where there are fewer), the
    bitmap of nodes looked at, and all (row, node, similarity) looked at."""
    rows, n = len(q), len(x)
    ids, sims = np.full((rows, beam), -1, np.int32), np.full((rows, beam), -np.inf, np.float32)
    done = np.zeros((rows, beam), bool)
    seen = np.zeros((rows, n), bool)
    ids[:, 0], sims[:, 0], seen[:, start] = start, q @ x[start], True
    looked = [(np.arange(rows), np.full(rows, start), sims[:, 0].copy())]
    active = np.arange(rows)
    while len(active):
        open_sims = np.where(done[active], -np.inf, sims[active])
        pick = np.argsort(-open_sims, axis=1, kind="stable")[:, :WIDTH]
        good = np.take_along_axis(open_sims, pick, axis=1) > -np.inf
        more = good[:, 0]
        active, pick, good = active[more], pick[more], good[more]
        if not len(active):
            break
        done[active[:, None], pick] |= good
        nodes = np.where(good, ids[active[:, None], pick], -1)
        nb = np.where(nodes[:, :, None] >= 0, near[nodes], -1).reshape(len(active), -1)
        row, col = np.nonzero((nb >= 0) & ~seen[active[:, None], nb])
        flat = np.unique(active[row] * n + nb[row, col])
        row, col = flat // n, flat % n
        if not len(row):
            continue
        seen[row, col] = True
        new = similarities(q, row, x, col)
        looked.append((row, col, new))
        counts = np.bincount(row, minlength=rows)[active]
        slot = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        fresh_ids, fresh_sims = np.full((len(active), counts.max()), -1, np.int32), np.full((len(active), counts.max()), -np.inf, np.float32)
        place = np.repeat(np.arange(len(active)), counts)
        fresh_ids[place, slot], fresh_sims[place, slot] = col, new
        all_sims = np.concatenate([sims[active], fresh_sims], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(np.concatenate([ids[active], fresh_ids], axis=1), best, axis=1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(fresh_ids.shape, bool)], axis=1), best, axis=1)
        sims[active] = np.take_along_axis(all_sims, best, axis=1)
    return ids, sims, seen, looked


def prune(x: np.ndarray, p: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: per node of ``p`` the kept candidates (-1 filled), nearest first; -1, the node itself and repeats are no candidates."""
    c = np.sort(candidates, axis=1)
    ok = (c >= 0) & (c != p[:, None])
    ok[:, 1:] &= c[:, 1:] != c[:, :-1]
    far = np.where(ok, 2 - 2 * np.einsum("bcd,bd->bc", x[c], x[p]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    c, far = np.take_along_axis(c, order, axis=1), np.take_along_axis(far, order, axis=1)
    alive, spread = far < np.inf, x[c]
    out, rows = np.full((len(p), degree), -1, np.int32), np.arange(len(p))
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = c[rows[some], first[some]]
        between = 2 - 2 * np.matmul(spread, spread[rows, first][:, :, None])[:, :, 0]
        alive &= alpha * alpha * between > far
        alive[rows, first] = False
    return out


def build(x: np.ndarray, config: Config) -> np.ndarray:
    """Adjacency of the shard's vectors, -1 filled; every node can be reached from the medoid."""
    n, degree, width = len(x), config.degree, 2 * config.degree
    if n <= degree + 1:
        near = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        np.fill_diagonal(near, -1)
        return near
    rnd, start = np.random.default_rng(n), medoid(x)
    near = np.full((n, width), -1, np.int32)
    near[:, :degree // 2] = (np.arange(n)[:, None] + rnd.integers(1, n, (n, degree // 2))) % n
    for alpha in (1.0, config.alpha):
        order = rnd.permutation(n)
        for at in range(0, n, BATCH):
            p = order[at:at + BATCH]
            ids = beam_search(x, near, x[p], start, config.beam)[0]
            kept = prune(x, p, np.concatenate([ids, near[p]], axis=1), degree, alpha)
            near[p, :degree], near[p, degree:] = kept, -1
            add_reverse(x, near, p, kept, degree, alpha)
    return reachable(near, start)


def add_reverse(x: np.ndarray, near: np.ndarray, p: np.ndarray, kept: np.ndarray, degree: int, alpha: float) -> None:
    """Edges back to ``p``; a list that would overflow is pruned with the nearest of the newcomers."""
    row, col = np.nonzero(kept >= 0)
    target, source = kept[row, col], p[row]
    order = np.lexsort((similarities(x, target, x, source) * -1, target))
    target, source = target[order], source[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(first, counts)
    fits = rank < degree
    incoming = np.full((len(nodes), degree), -1, np.int32)
    incoming[np.repeat(np.arange(len(nodes)), counts)[fits], rank[fits]] = source[fits]
    both = np.concatenate([near[nodes], incoming], axis=1)
    both = np.where(np.concatenate([np.ones(near[nodes].shape, bool), ~(incoming[:, :, None] == near[nodes][:, None, :]).any(axis=2)], axis=1), both, -1)
    full = (both >= 0).sum(axis=1) > near.shape[1]
    packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
    near[nodes[~full]] = packed[~full, :near.shape[1]]
    for at in range(0, int(full.sum()), BATCH):
        some = np.flatnonzero(full)[at:at + BATCH]
        near[nodes[some], :degree], near[nodes[some], degree:] = prune(x, nodes[some], packed[some], degree, alpha), -1


def reachable(near: np.ndarray, start: int) -> np.ndarray:
    """``near`` with edges to the nodes that ``start`` did not reach, from a neighbour of theirs that it does reach or from ``start``."""
    lists = [row[row >= 0] for row in near]
    reached = np.zeros(len(near), bool)
    reached[start] = True
    front, extra = [start], []
    while True:
        while front:
            step = np.unique(np.concatenate([lists[i] for i in front]))
            front = step[~reached[step]].tolist()
            reached[front] = True
        if reached.all():
            break
        lost = np.flatnonzero(~reached)
        for node in lost:
            known = lists[node][reached[lists[node]]]
            if len(known):
                break
        else:
            node, known = lost[0], np.array([start])
        extra.append((int(known[0]), int(node)))
        reached[node], front = True, [int(node)]
    if extra:
        grown = {}
        for a, b in extra:
            grown.setdefault(a, []).append(b)
        near = np.concatenate([near, np.full((len(near), max(map(len, grown.values()))), -1, np.int32)], axis=1)
        for a, more in grown.items():
            near[a, near.shape[1] - len(more):] = more
    return near


def range_search(x: np.ndarray, near: np.ndarray, start: int, p: np.ndarray, beam: int, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """(node of ``p``, node): candidates for links, found from the medoid by expanding the range around each node of ``p``."""
    n, q = len(x), x[p]
    radius = config.slack ** 2 * 2 * (1 - config.threshold)
    _, _, seen, looked = beam_search(x, near, q, start, beam)
    row, col, sims = [np.concatenate(c) for c in zip(*looked)]
    found = []
    while len(row):
        close = 2 - 2 * sims <= radius
        row, col = row[close], col[close]
        found.append((row, col))
        new = []
        for at in range(0, len(row), FRONT):
            r, c = row[at:at + FRONT], col[at:at + FRONT]
            nb = near[c]
            i, j = np.nonzero((nb >= 0) & ~seen[r[:, None], nb])
            flat = np.unique(r[i] * n + nb[i, j])
            i, j = flat // n, flat % n
            seen[i, j] = True
            new.append((i, j, similarities(q, i, x, j)))
        row, col, sims = [np.concatenate(c) for c in zip(*new)] if new else (np.zeros(0, int),) * 3
    row, col = [np.concatenate(c) for c in zip(*found)] if found else (np.zeros(0, int),) * 2
    missed = np.flatnonzero(~seen[np.arange(len(p)), p])
    if len(missed) and beam < n:
        again = ~np.isin(row, missed)
        more = range_search(x, near, start, p[missed], min(n, 4 * beam), config)
        return np.concatenate([p[row[again]], more[0]]), np.concatenate([col[again], more[1]])
    return p[row], col


def linked(x: np.ndarray, near: np.ndarray, config: Config) -> np.ndarray:
    """Bitmap of the verified links between the rows of ``x`` (double precision) that the search finds from either side."""
    n, small, start = len(x), x.astype(np.float32), medoid(x.astype(np.float32))
    met = np.zeros((n, n), bool)
    for at in range(0, n, BATCH):
        a, b = range_search(small, near, start, np.arange(at, min(n, at + BATCH)), config.beam, config)
        met[a, b] = True
    met |= met.T
    np.fill_diagonal(met, False)
    for at in range(0, n, BATCH):
        a, b = np.nonzero(met[at:at + BATCH])
        met[a + at, b] = similarities(x, a + at, x, b) >= config.threshold
    return met


def parts_of(met: np.ndarray) -> np.ndarray:
    """The least row of each row's connected part."""
    part = np.full(len(met), -1)
    for i in range(len(met)):
        if part[i] < 0:
            inside = np.zeros(len(met), bool)
            inside[i], front = True, np.array([i])
            while len(front):
                reach = met[front].any(axis=0) & ~inside
                inside |= reach
                front = np.flatnonzero(reach)
            part[inside] = i
    return part


# -- shards ---------------------------------------------------------------------------------------------------

def matrix(table: pa.Table, name: str = "vec") -> np.ndarray:
    flat = table.column(name).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def distinct_vectors(df: DataFrame, id: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(id, key) of all rows, key null where nothing can link, and the distinct vectors (node, key, label, dim, vec, copies, first)."""
    v = F.transform(column(df, vector), lambda c: c.cast("double"))
    base = df.select(column(df, id).alias("id"), column(df, label).cast("string").alias("label"), v.alias("v")).withColumn("peak", F.array_max(F.transform("v", F.abs)))
    valid = F.col("label").isNotNull() & (F.col("peak") > 0) & (F.col("peak") < float("inf")) & ~F.exists("v", F.isnull)
    scaled = base.withColumn("v", F.when(valid, F.transform("v", lambda c: c / F.col("peak") + 0.0))).drop("peak")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, c: total + c * c))
    unit = scaled.withColumn("norm", norm).select("id", "label", F.transform("v", lambda c: c / F.col("norm")).alias("vec"))
    keyed = written(unit.withColumn("key", F.when(F.col("vec").isNotNull(), F.concat(F.hex(F.xxhash64("label", "vec")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "vec", "label"))))))
    nodes = (keyed.filter("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
             .select(F.monotonically_increasing_id().alias("node"), "key", "label", F.size("vec").alias("dim"), "vec", "copies", "first"))
    return keyed.select("id", "key"), written(nodes)


def learn_centroids(table: pa.Table, fanout: int) -> np.ndarray:
    """Spherical k-means of a sample: as many centroids as the leaf needs shards, the fanout at most."""
    x, k = matrix(table), int(table.column("wanted")[0].as_py())
    order = np.argsort(table.column("node").to_numpy())
    x = x[order]
    k = min(k, fanout, len(x))
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(5):
        best = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, best, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centers)
    return centers


def split(members: DataFrame, nodes: DataFrame, big: DataFrame, level: int, config: Config) -> DataFrame:
    """(leaf, node, dim, parent_rows): the members of the leaves in ``big`` (leaf, rows, room) in the shards of their nearest centroids."""
    inside = (members.drop("parent_rows").join(big, "leaf").join(nodes.select("node", "vec"), "node")
              .withColumn("wanted", F.ceil(F.col("rows") * (config.overlap + 1) / F.col("room")).cast("int")))
    picked = F.pmod(F.xxhash64("node", F.lit(level)), F.col("rows")) < config.sample_rows
    fanout, overlap = config.fanout, config.overlap

    def centers(table):
        c = learn_centroids(table, fanout)
        return pa.table({"leaf": table.column("leaf").slice(0, 1), "centers": pa.array([c.reshape(-1).tolist()], pa.list_(pa.float64()))})

    learned = written(inside.filter(picked).select("leaf", "node", "vec", "wanted").groupBy("leaf").applyInArrow(centers, "leaf string, centers array<double>"))
    salts = F.ceil(F.col("rows") / F.col("room")).cast("int")
    left = inside.select("leaf", "node", "vec", "dim", "rows", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"))
    right = learned.join(big, "leaf").select("leaf", "centers", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))

    def assign(table, centers):
        x = matrix(table)
        c = matrix(centers, "centers").reshape(-1, x.shape[1])
        take = min(overlap, len(c))
        best = np.sort(np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :take], axis=1)
        leaf = table.column("leaf")[0].as_py()
        return pa.table({"leaf": pa.array([f"{leaf}/{k}" for k in best.reshape(-1).tolist()]), "node": pa.array(np.repeat(table.column("node").to_numpy(), take)),
                         "dim": pa.array(np.repeat(table.column("dim").to_numpy(), take), pa.int32()), "parent_rows": pa.array(np.repeat(table.column("rows").to_numpy(), take))})

    return left.groupBy("leaf", "salt").cogroup(right.groupBy("leaf", "salt")).applyInArrow(assign, "leaf string, node long, dim int, parent_rows long")


def shards(nodes: DataFrame, config: Config) -> DataFrame:
    """(leaf, node, leaves): every vector in each of its shards, with the names of all of them; two vectors of a label that are near meet in one."""
    members = nodes.select(F.concat_ws("/", "label", "dim").alias("leaf"), "node", "dim", F.lit(None).cast("long").alias("parent_rows"))
    for level in range(config.levels + 1):
        sizes = members.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.first("parent_rows").alias("parent_rows"), config.room(F.first("dim")).cast("long").alias("room"))
        over = written(sizes.filter("rows > room").withColumn("stuck", F.coalesce(F.col("rows") > 0.8 * F.col("parent_rows"), F.lit(False))))
        big = over.filter(~F.col("stuck")).select("leaf", "rows", "room")
        if level == config.levels or big.isEmpty():
            break
        small = members.join(big.select("leaf"), "leaf", "left_anti")
        members = written(small.unionByName(split(members, nodes, big, level, config)))
    else:
        raise AssertionError
    if over.isEmpty():
        placed = members.select("leaf", "node")
    else:
        blocks = F.ceil(2 * F.col("rows") / F.col("room")).cast("int")
        own, other = F.pmod(F.xxhash64("node"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
        tiles = (members.join(over.select("leaf", "rows", "room"), "leaf").select("leaf", "node", own.alias("own"), other.alias("other"))
                 .select(F.concat("leaf", F.lit("#"), F.least("own", "other"), F.lit("-"), F.greatest("own", "other")).alias("leaf"), "node"))
        placed = members.join(over.select("leaf"), "leaf", "left_anti").select("leaf", "node").unionByName(tiles)
    placed = written(placed.distinct())
    names = placed.groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    return written(placed.join(names, "node"))


def shard_links(nodes: DataFrame, config: Config) -> DataFrame:
    """(node, root, links): per vector and shard, the least node of its part there and the vectors it links with, copies counted."""
    members = shards(nodes, config)

    def graph(table):
        ids, x = table.column("node").to_numpy(), matrix(table).astype(np.float32)
        order = np.argsort(ids)
        ids, near = ids[order], build(x[order], config)
        lists = [ids[row[row >= 0]].tolist() for row in near]
        return pa.table({"node": pa.array(ids), "near": pa.array(lists, pa.list_(pa.int64()))})

    vectors = members.join(nodes.select("node", "vec", "copies"), "node")
    built = written(vectors.select("leaf", "node", "vec").groupBy("leaf").applyInArrow(graph, "node long, near array<long>"))
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def search(table):
        ids, x = table.column("node").to_numpy(), matrix(table)
        order = np.argsort(ids)
        ids, x, copies = ids[order], x[order], table.column("copies").to_numpy()[order]
        lists = table.column("near").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here = ids[at] == flat
        place = np.empty(len(ids), int)
        place[order] = np.arange(len(ids))
        row = np.repeat(place, sizes)[here]
        by_row = np.argsort(row, kind="stable")
        row, at = row[by_row], at[here][by_row]
        counts = np.bincount(row, minlength=len(ids))
        near = np.full((len(ids), max(1, counts.max())), -1, np.int32)
        near[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = at
        met = linked(x, near, config)
        part = parts_of(met)
        leaf, others = table.column("leaf")[0].as_py(), {}
        for i, names in zip(place.tolist(), table.column("leaves").to_pylist()):
            for name in names:
                if name < leaf:
                    others.setdefault(name, []).append(i)
        for both in others.values():
            met[np.ix_(both, both)] = False
        return pa.table({"node": pa.array(ids), "root": pa.array(ids[part]), "links": pa.array(met @ copies.astype(np.int64))})

    dealt = vectors.join(united, "node").select("leaf", "node", "vec", "copies", "leaves", "near")
    return dealt.groupBy("leaf").applyInArrow(search, "node long, root long, links long")


def audit(nodes: DataFrame, links: DataFrame, config: Config) -> float:
    """Share of the links of a bounded sample of vectors, compared with all vectors, that ``links`` (node, links) holds too."""
    picked = F.pmod(F.xxhash64("node", F.lit("audit")), F.greatest(F.lit(1), F.lit(nodes.count()))) < config.audit_rows
    sample = [(r["node"], r["label"], r["vec"]) for r in nodes.filter(picked).select("node", "label", "vec").limit(2 * config.audit_rows).collect()]
    groups: dict[tuple, list] = {}
    for node, label, vec in sample:
        groups.setdefault((label, len(vec)), []).append((node, vec))
    held = nodes.sparkSession.sparkContext.broadcast({k: (np.array([n for n, _ in v]), np.array([x for _, x in v])) for k, v in groups.items()})

    def compare(batches):
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist())):
                rows.setdefault(k, []).append(i)
            for k, some in rows.items():
                if k in held.value:
                    ids, q = held.value[k]
                    part = pa.Table.from_batches([batch.take(pa.array(some))])
                    met = (q @ matrix(part).T >= config.threshold) & (ids[:, None] != part.column("node").to_numpy()[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(met @ part.column("copies").to_numpy())], names=["node", "true"])

    true = nodes.select("node", "label", "dim", "vec", "copies").mapInArrow(compare, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    total = true.join(links, "node", "left").agg(F.sum("true").alias("true"), F.sum("links").alias("found")).head()
    return (total["found"] or 0) / total["true"] if total["true"] else 1.0


def near_duplicates(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", config: Config = Config()) -> DataFrame:
    """(id, n_links, component_id, kept, recall): one row per row of ``df``; ``recall`` is what the audit measured in the end."""
    small_batches(df.sparkSession)
    rows, nodes = distinct_vectors(df, id, vector, label)
    most = nodes.groupBy("label", "dim").count().agg(F.max("count")).head()[0] or 0
    while True:
        found = written(shard_links(nodes, config))
        links = written(found.groupBy("node").agg(F.sum("links").alias("links")))
        recall = audit(nodes, links, config)
        if recall >= config.audit_recall or config.overlap >= config.fanout and config.beam >= most:
            break
        config = replace(config, overlap=2 * config.overlap, beam=2 * config.beam)
    edges = written(found.filter("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")).distinct())
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    parts = connected_components(ends, edges).select(F.col("id").alias("_node"), "component")
    classed = written(nodes.join(parts, F.col("node") == F.col("_node"), "left").select("node", "key", "copies", "first", F.coalesce("component", "node").alias("class")))
    least = classed.groupBy(F.col("class").alias("_class")).agg(F.min("first").alias("component_id"))
    known = written(classed.join(least, F.col("class") == F.col("_class")).join(links.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
                    .select(F.col("key").alias("_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    return (rows.join(known, F.col("key") == F.col("_key"), "left")
            .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
            .select("*", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("recall")))
