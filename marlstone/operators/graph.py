"""Graph analytics on plain vertex and edge frames.

``vertices(id, ...)`` and ``edges(src, dst, ...)``. Iterations cut their lineage with reliable checkpoints and
test convergence with one scalar. Rows of a hub are spread with :func:`salted_lookup` where its edges are joined
again and again; sums and minima over its edges combine on the map side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from marlstone.functions.columns import clamp, ladder, ratio
from marlstone.operators.joins import block_pairs, hot_keys, salted_lookup
from marlstone.operators.windows import latest, running, value_slices
from marlstone.session import cut_lineage, ship_package, written


def links(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges a < b, without self-loops."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    """(v, u) in both directions of undirected pairs (a, b)."""
    return pairs.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("u")))


# -- centrality ---------------------------------------------------------------------------------------------

def pagerank(vertices: DataFrame, edges: DataFrame, reset: float = 0.15, tol: float = 0.001, max_iter: int = 20,
             sources: list | DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """Rank per vertex (summing to 1) and its 0-100 scale. ``sources``, ids or a frame of them, makes it personalized.

    The rank of vertices without out-edges is spread like the reset. Stops when the total change is below
    ``tol`` or after ``max_iter`` rounds.
    """
    v = vertices.select("id").distinct()
    w = F.col(weight) if weight else F.lit(1.0)
    e = edges.select("src", "dst", w.cast("double").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("_out"))
    e = cut_lineage(salted_lookup(e, "src", out.withColumnRenamed("src", "_s"), "_s", ["_out"]).filter(F.col("_out") > 0)
                    .select("src", "dst", (F.col("w") / F.col("_out")).alias("w")))
    hubs = hot_keys(e, "src")
    if sources is None:
        n = v.agg(F.count(F.lit(1))).scalar()
        base = v.select("id", (F.lit(1.0) / n).alias("base"))
    else:
        if isinstance(sources, DataFrame):
            marked = cut_lineage(v.join(sources.select(F.col("id").alias("_s")).distinct(), F.col("id") == F.col("_s"), "left").select("id", F.col("_s").isNotNull().alias("_mine")))
        else:
            marked = v.withColumn("_mine", F.col("id").isin(list(sources)))
        n = marked.filter("_mine").agg(F.count(F.lit(1))).scalar()
        base = marked.select("id", F.when(F.col("_mine"), F.lit(1.0) / n).otherwise(0.0).alias("base"))
    sinks = out.filter("_out > 0").select(F.col("src").alias("id"), F.lit(True).alias("_has"))
    base = cut_lineage(base.join(sinks, "id", "left").withColumn("sink", F.col("_has").isNull()).drop("_has"))
    ranks = base.withColumn("rank", F.col("base"))
    for _ in range(max_iter):
        sent = salted_lookup(e, "src", ranks, "id", ["rank"], hot=hubs).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w")).alias("_in"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0))).scalar()
        new = F.col("base") * reset + (1 - reset) * (F.coalesce(F.col("_in"), F.lit(0.0)) + lost * F.col("base"))
        step = ranks.join(sent, "id", "left").withColumn("_new", new)
        step = cut_lineage(step.select("id", "base", "sink", F.col("_new").alias("rank"), F.abs(F.col("_new") - F.col("rank")).alias("_d")))
        change = step.agg(F.sum("_d").alias("d")).first()["d"] or 0.0
        ranks = step.drop("_d")
        if change < tol:
            break
    low, high = ranks.agg(F.min("rank")).scalar(), ranks.agg(F.max("rank")).scalar()
    scaled = F.coalesce((F.col("rank") - low) / F.nullif(high - low, F.lit(0.0)) * 100, F.lit(0.0))
    return ranks.select("id", "rank", scaled.alias("score"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles per vertex.

    Every edge points from the smaller to the larger (degree, id), so no vertex has more than sqrt(2 m)
    out-edges and a hub yields no more two-step paths than others. A vertex sends each of its out-neighbours the later ones as
    one array, and what both know closes a triangle: one row per edge, not per path.
    """
    e = cut_lineage(links(edges))
    deg = both_ways(e).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    d = salted_lookup(e, "a", deg, "v", [F.col("d").alias("da")], hot=hot_keys(e, "a"))
    d = salted_lookup(d, "b", deg, "v", [F.col("d").alias("db")], hot=hot_keys(e, "b"))
    up = F.struct("da", "a") < F.struct("db", "b")
    o = d.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.struct("db", F.col("b").alias("y"))).otherwise(F.struct(F.col("da").alias("db"), F.col("a").alias("y"))).alias("to"))
    out = cut_lineage(o.groupBy("x").agg(F.array_sort(F.collect_list("to")).getField("y").alias("ys")))
    sent = out.select("x", "ys", F.posexplode("ys").alias("i", "y")).select("x", "y", F.expr("slice(ys, i + 2, size(ys))").alias("later")).filter(F.size("later") > 0)
    met = sent.join(out.select(F.col("x").alias("y"), "ys"), "y").select("x", "y", F.array_intersect("later", "ys").alias("zs")).filter(F.size("zs") > 0)
    closed = F.size("zs").cast("long")
    counts = F.concat(F.array(F.struct(F.col("x").alias("id"), closed.alias("n")), F.struct(F.col("y").alias("id"), closed.alias("n"))), F.transform("zs", lambda z: F.struct(z.alias("id"), F.lit(1).cast("long").alias("n"))))
    return met.select(F.inline(counts)).groupBy("id").agg(F.sum("n").alias("triangles"))


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours, triangles and 2T / (d (d - 1)) per vertex; 0 below two neighbours."""
    deg = both_ways(links(edges)).groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("neighbours"))
    out = vertices.select("id").distinct().join(deg, "id", "left").join(triangles(edges), "id", "left").fillna(0)
    return out.withColumn("clustering", F.coalesce(2.0 * F.col("triangles") / F.nullif(F.col("neighbours") * (F.col("neighbours") - 1), F.lit(0)), F.lit(0.0)))


# -- components and communities -----------------------------------------------------------------------------

def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable.

    Rounds of contraction: every vertex hooks to its smallest neighbour, pointers are doubled until they name
    roots, and the edges are rewritten to roots. The number of vertices left at least halves per round.
    """
    e = cut_lineage(links(edges))
    maps = []
    while not e.isEmpty():
        hook = cut_lineage(both_ways(e).groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("root")))
        while True:
            up = salted_lookup(hook, "root", hook.select(F.col("v").alias("_v"), F.col("root").alias("_up")), "_v", ["_up"])
            moved = written(up.select("v", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_m")))
            hook = moved.drop("_m")
            if moved.filter("_m").isEmpty():
                break
        maps.append(hook)
        one = salted_lookup(e, "a", hook, "v", [F.col("root").alias("ra")], hot=hot_keys(e, "a"))
        two = salted_lookup(one, "b", hook, "v", [F.col("root").alias("rb")], hot=hot_keys(e, "b"))
        e = cut_lineage(two.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    final = None
    for m in reversed(maps):
        if final is None:
            final = m
        else:
            j = salted_lookup(m, "root", final.select(F.col("v").alias("_v"), F.col("root").alias("_top")), "_v", ["_top"], "left")
            final = cut_lineage(j.select("v", F.coalesce("_top", "root").alias("root")))
    ids = vertices.select("id").distinct()
    if final is None:
        return ids.withColumn("component", F.col("id"))
    return ids.join(final.withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    """Size per component and whether it is the largest (the smallest label wins a tie)."""
    s = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    top = s.agg(F.max_by("component", F.struct("size", -F.col("component")))).scalar()
    return s.withColumn("is_giant", F.col("component") == top)


def label_propagation(vertices: DataFrame, edges: DataFrame, max_iter: int = 5) -> DataFrame:
    """(id, label): each round takes the most frequent label among the neighbours, the smallest on a tie."""
    n = cut_lineage(both_ways(links(edges)))
    hubs = hot_keys(n, "u")
    labels = vertices.select("id").distinct().withColumn("label", F.col("id"))
    for _ in range(max_iter):
        seen = salted_lookup(n, "u", labels, "id", ["label"], hot=hubs).groupBy("v", "label").agg(F.count(F.lit(1)).alias("c"))
        best = seen.groupBy(F.col("v").alias("id")).agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("_new"))
        step = cut_lineage(labels.join(best, "id", "left").select("id", F.coalesce("_new", "label").alias("label"),
                                                                  (F.coalesce("_new", "label") != F.col("label")).alias("_m")))
        labels = step.drop("_m")
        if step.filter("_m").isEmpty():
            break
    return labels


def modularity(edges: DataFrame, communities: DataFrame, weight: str | None = None) -> DataFrame:
    """Modularity of a partition (id, community), from two aggregates."""
    w = F.col(weight) if weight else F.lit(1.0)
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), w.alias("w"))
    e = salted_lookup(e, "a", communities, "id", [F.col("community").alias("ca")])
    e = salted_lookup(e, "b", communities, "id", [F.col("community").alias("cb")])
    m = e.agg(F.sum("w")).scalar()
    inside = e.filter("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).scalar()
    ends = e.select(F.col("ca").alias("c"), "w").unionByName(e.select(F.col("cb").alias("c"), "w"))
    deg = ends.groupBy("c").agg(F.sum("w").alias("k"))
    return deg.agg((inside / m - F.sum(F.col("k") * F.col("k")) / (4 * m * m)).alias("modularity"))


def modularity_communities(vertices: DataFrame, edges: DataFrame, rounds: int = 4, tol: float = 1e-6) -> DataFrame:
    """(id, community, levels, converged): communities by local moves and contraction, level after level until one gains less than ``tol``.

    In a round a hash colours the communities anew, half of them givers and half takers, and a vertex may only go from a giver to the
    taker that gains most, so nothing swaps. Vertices that leave or join the same community at once get in each other's way by
    k_i k_j / (2 m^2) at most: a vertex goes if its gain outweighs that against all others of its giver and its taker, or if it is the
    best of both. So the modularity grows with every round and no round has to be taken back. A level without an accepted move in
    all its rounds counts as the end only if no vertex has a gaining move of any colour.
    """
    g = written(links(edges).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w")))
    assigned = written(vertices.select("id").distinct().withColumn("community", F.col("id")))
    total = g.agg(F.sum("w")).first()[0] or 0.0
    level, drawn = 0, 0
    while total:
        plain = g.filter("src <> dst")
        both = written(plain.select(F.col("src").alias("v"), F.col("dst").alias("u"), "w").unionByName(plain.select(F.col("dst").alias("v"), F.col("src").alias("u"), "w")))
        ends = both.select("v", "w").unionByName(g.filter("src = dst").select(F.col("src").alias("v"), (2 * F.col("w")).alias("w")))
        comm = written(ends.groupBy(F.col("v").alias("id")).agg(F.sum("w").alias("k")).withColumn("community", F.col("id")))
        gained, r, open_moves = 0.0, 0, True
        while open_moves and (r < rounds or not gained):
            moves = written(best_moves(both, comm, total, drawn))
            open_moves, r, drawn = not moves.isEmpty(), r + 1, drawn + 1
            if not open_moves:
                break
            accepted = written(accepted_moves(moves.filter("target is not null"), total))
            step = accepted.agg(F.sum("gain")).first()[0] or 0.0
            if step:
                gained += step
                comm = written(comm.join(accepted.select(F.col("v").alias("_v"), "target"), F.col("id") == F.col("_v"), "left").select("id", "k", F.coalesce("target", "community").alias("community")))
        if gained < tol:
            break
        level += 1
        top = comm.select(F.col("id").alias("_v"), F.col("community").alias("_top"))
        assigned = written(salted_lookup(assigned, "community", top, "_v", ["_top"], "left").select("id", F.coalesce("_top", "community").alias("community")))
        e = salted_lookup(g, "src", top, "_v", [F.col("_top").alias("cs")])
        e = salted_lookup(e, "dst", top, "_v", [F.col("_top").alias("cd")])
        g = written(e.groupBy(F.least("cs", "cd").alias("src"), F.greatest("cs", "cd").alias("dst")).agg(F.sum("w").alias("w")))
    low = assigned.groupBy(F.col("community").alias("_c")).agg(F.min("id").alias("_low"))
    return salted_lookup(assigned, "community", low, "_c", ["_low"]).select("id", F.col("_low").alias("community"), F.lit(level).alias("levels"), F.lit(True).alias("converged"))


def best_moves(both: DataFrame, comm: DataFrame, total: float, drawn: int) -> DataFrame:
    """(v, home, target, gain, k) of every vertex with a gaining move; target is null where the colours of this round allow none."""
    tot = comm.groupBy(F.col("community").alias("_c")).agg(F.sum("k").alias("tot"))
    to = salted_lookup(both, "u", comm, "id", ["community"]).groupBy("v", "community").agg(F.sum("w").alias("w_in"))
    home = comm.join(tot, F.col("community") == F.col("_c")).select(F.col("id").alias("_v"), F.col("community").alias("home"), "k", F.col("tot").alias("tot_home"))
    near = to.join(home, F.col("v") == F.col("_v"))
    own = near.filter("community = home").select(F.col("v").alias("_o"), F.col("w_in").alias("w_home"))
    c = salted_lookup(near.filter("community <> home"), "community", tot, "_c", ["tot"]).join(own, F.col("v") == F.col("_o"), "left")
    gain = (F.col("w_in") - F.coalesce("w_home", F.lit(0.0))) / total - F.col("k") * (F.col("tot") - F.col("tot_home") + F.col("k")) / (2 * total * total)
    taker = lambda x: F.pmod(F.xxhash64(x, F.lit(drawn)), F.lit(2)) == 1
    allowed = taker("community") & ~taker("home")
    scored = c.withColumn("gain", gain).filter(F.col("gain") > 1e-12)
    best = F.struct("gain", (-F.xxhash64("community", F.lit(drawn))).alias("_h"), F.col("community").alias("target"))
    return (scored.groupBy("v").agg(F.first("home").alias("home"), F.first("k").alias("k"), F.max(F.when(allowed, best)).alias("_b"))
            .select("v", "home", "_b.target", "_b.gain", "k"))


def accepted_moves(moves: DataFrame, total: float) -> DataFrame:
    """The (v, target, gain) that may go at once: each gains more than all others of its home and target can take away, or leads both."""
    lead = F.max_by("v", F.struct("gain", "v")).alias("_lead")
    of = lambda c: moves.groupBy(F.col(c).alias("_key")).agg(F.sum("k").alias("_k"), lead)
    m = salted_lookup(moves, "home", of("home"), "_key", [F.col("_k").alias("kh"), F.col("_lead").alias("lh")])
    m = salted_lookup(m, "target", of("target"), "_key", [F.col("_k").alias("kt"), F.col("_lead").alias("lt")])
    others = F.col("k") * (F.col("kh") + F.col("kt") - 2 * F.col("k")) / (2 * total * total)
    return m.filter((F.col("gain") > others) | ((F.col("lh") == F.col("v")) & (F.col("lt") == F.col("v")))).select("v", "target", "gain")


def community_edges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Size, edges inside and edges touching per community, and the internal share."""
    e = salted_lookup(edges.select("src", "dst"), "src", communities, "id", [F.col("community").alias("cs")], "left")
    e = salted_lookup(e, "dst", communities, "id", [F.col("community").alias("cd")], "left")
    touch = e.select(F.explode(F.array_distinct(F.array_compact(F.array("cs", "cd")))).alias("community"), (F.col("cs") == F.col("cd")).alias("inside"))
    g = touch.groupBy("community").agg(F.count_if("inside").alias("internal_edges"), F.count(F.lit(1)).alias("touching_edges"))
    size = communities.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return size.join(g, "community", "left").fillna(0).withColumn("internal_ratio", F.coalesce(ratio("internal_edges", "touching_edges"), F.lit(0.0)))


def single_parents(edges: DataFrame, parent: str, child: str) -> tuple[DataFrame, list[DataFrame]] | None:
    """Vertices that only one edge enters (``child`` end), with their nearest ancestor that is none of them.

    Gives (v, anchor) and the pointers (v, p) to ancestors 1, 2, 4, ... steps up; None without such vertices. Pointers are doubled, so a
    chain takes a round per power of two, and stop at the anchor. Of a cycle of nothing but such vertices the largest stays out and is
    the anchor of what hangs on the cycle; pointers there may go on around the cycle. Once a round closes nothing and leaves as
    many vertices pointed at, these are the cycles, whatever the number of vertices.
    """
    lone = written(edges.groupBy(F.col(child).alias("v")).agg(F.count(F.lit(1)).alias("_n"), F.min(parent).alias("p")).filter("_n = 1").select("v", "p"))
    inside = lone.select(F.col("v").alias("_p"), F.lit(True).alias("_in"))
    step = written(lone.join(inside, F.col("p") == F.col("_p"), "left").select("v", "p", F.coalesce("_in", F.lit(False)).alias("open"), F.col("v").alias("most")))
    pointers, before = [step.select("v", "p")], None
    while True:
        now = step.agg(F.count(F.lit(1)), F.count_if("open"), F.countDistinct(F.when(F.col("open"), F.col("p")))).first()
        if not now[0]:
            return None
        if not now[1]:
            return step.select("v", F.col("p").alias("anchor")), pointers
        if now == before:
            cycles = step.filter("open").select(F.col("p").alias("v")).distinct()
            cycles = written(cycles.join(step.select("v", "most"), "v").join(lone, "v"))
            ahead = cycles.select(F.col("v").alias("_v"), F.col("most").alias("_most"))
            if cycles.join(ahead, F.col("p") == F.col("_v")).filter("most <> _most").isEmpty():  # each knows all of its cycle
                break
        before = now
        up = step.select(F.col("v").alias("_p"), F.col("p").alias("_up"), F.col("open").alias("_open"), F.col("most").alias("_most"))
        step = written(step.join(up, (F.col("p") == F.col("_p")) & F.col("open"), "left")
                       .select("v", F.coalesce("_up", "p").alias("p"), F.coalesce("_open", "open").alias("open"), F.greatest("most", "_most").alias("most")))
        pointers.append(step.select("v", "p"))
    top = cycles.select(F.col("v").alias("_p"), F.col("most").alias("_top"))
    named = step.join(top, (F.col("p") == F.col("_p")) & F.col("open"), "left").select("v", F.coalesce("_top", "p").alias("anchor"))
    return written(named.filter("v <> anchor")), pointers


def strongly_connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the largest id of the component.

    Edges from vertices that nothing enters or to vertices that nothing leaves are dropped. A vertex that only one edge enters (or
    leaves) is taken out: its other edges go to the ancestor it hangs on, found by pointer doubling, so long chains and cycles take a
    logarithmic number of rounds. What is left has two edges each way at every vertex: there the largest id that reaches a
    vertex is its colour, and what reaches a colour's own vertex inside its colour is one component. The vertices taken out come
    back in reverse order: one belongs to its ancestor's component if an edge of its subtree leads back there.
    """
    e = written(edges.filter("src <> dst").select("src", "dst").distinct())
    taken, known = [], None
    while True:
        before = e.agg(F.count(F.lit(1))).first()[0]
        if not before:
            break
        inner = e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))
        e = written(e.join(inner, e["src"] == inner["id"], "left_semi").join(inner, e["dst"] == inner["id"], "left_semi"))
        for parent, child in (("src", "dst"), ("dst", "src")):
            found = single_parents(e, parent, child)
            if found is None:
                continue
            anchors, pointers = found
            lone = anchors.select(F.col("v").alias("_v"), F.col("anchor"))
            rest = e.join(lone.select(F.col("_v").alias("_c")), F.col(child) == F.col("_c"), "left_anti")
            moved = written(salted_lookup(rest, parent, lone, "_v", ["anchor"], "left"))
            taken.append((anchors, pointers, written(moved.filter("anchor is not null").select(F.col(parent).alias("v"), F.col(child).alias("w"), "anchor"))))
            e = written(moved.select(F.coalesce("anchor", parent).alias(parent), F.col(child)).filter(F.col(parent) != F.col(child)).select("src", "dst").distinct())
        left = e.agg(F.count(F.lit(1))).first()[0]
        if left <= 0.8 * before:
            continue
        found = largest_colours(e)
        known = found if known is None else written(known.unionByName(found))
        gone = found.select(F.col("id").alias("_id"))
        e = written(e.join(gone, F.col("src") == F.col("_id"), "left_anti").join(gone, F.col("dst") == F.col("_id"), "left_anti"))
    ids = vertices.select("id").distinct()
    if known is None:
        known = written(ids.limit(0).withColumn("component", F.col("id")))
    for anchors, pointers, exits in reversed(taken):
        of = known.select(F.col("id").alias("_id"), F.col("component").alias("_c"))
        ends = salted_lookup(exits, "w", of.select("_id", F.col("_c").alias("cw")), "_id", ["cw"], "left")
        ends = salted_lookup(ends, "anchor", of.select("_id", F.col("_c").alias("ca")), "_id", ["ca"], "left")
        good = written(ends.filter(F.coalesce("cw", "w") == F.coalesce("ca", "anchor")).select("v").distinct())
        for up in pointers:
            above = good.join(up, "v").select(F.col("p").alias("v")).join(anchors.select("v"), "v", "left_semi")
            good = written(good.unionByName(above).distinct())
        back = good.join(anchors, "v")
        named = salted_lookup(back, "anchor", of, "_id", ["_c"], "left").select(F.col("v").alias("id"), F.coalesce("_c", "anchor").alias("component"))
        known = written(known.unionByName(named))
    named = written(ids.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("_c")))
    top = named.groupBy("_c").agg(F.max("id").alias("component"))
    return named.join(top, "_c").select("id", "component")


def largest_colours(e: DataFrame) -> DataFrame:
    """(id, component) of the strong components that hold the largest id that reaches them; there is one at least."""
    alive = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    colour = written(alive.withColumn("c", F.col("id")))
    while True:
        sent = salted_lookup(e, "src", colour, "id", ["c"]).groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("_c"))
        step = written(colour.join(sent, "id", "left").select("id", F.greatest("c", "_c").alias("c"), (F.coalesce(F.col("_c"), F.col("c")) > F.col("c")).alias("_m")))
        colour = step.drop("_m")
        if step.filter("_m").isEmpty():
            break
    same = salted_lookup(e, "src", colour, "id", [F.col("c").alias("cs")])
    same = written(salted_lookup(same, "dst", colour, "id", [F.col("c").alias("cd")]).filter("cs = cd").select("src", "dst"))
    found = front = written(colour.filter("id = c"))
    while True:
        front = written(front.join(same.withColumnRenamed("dst", "id"), "id").select(F.col("src").alias("id"), "c").distinct().join(found, "id", "left_anti"))
        if front.isEmpty():
            return found.withColumnRenamed("c", "component")
        found = written(found.unionByName(front))


def reciprocity(edges: DataFrame, components: DataFrame, low: int = 3, high: int = 20) -> DataFrame:
    """Share of edges with a way back inside components of 3 to 20 vertices."""
    size = components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size").between(low, high))
    member = components.join(size, "component")
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    e = salted_lookup(e, "src", member.select("id", "component", "size"), "id", ["component", "size"])
    e = salted_lookup(e, "dst", member.select(F.col("id").alias("_id"), F.col("component").alias("_cd")), "_id", ["_cd"]).filter("component = _cd").drop("_cd")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("_b"))
    return e.join(back, ["src", "dst"], "left").groupBy("component").agg(
        F.max("size").alias("size"), F.count(F.lit(1)).alias("edges"), (F.count("_b") / F.count(F.lit(1))).alias("reciprocity")) \
        .withColumn("suspicious", F.col("reciprocity") > 0.7)


# -- walks --------------------------------------------------------------------------------------------------

def hops(edges: DataFrame, starts: DataFrame, depth: int | None = None, directed: bool = True) -> DataFrame:
    """(start, id, distance) of everything within ``depth`` hops of each start (all of it without a depth)."""
    e = edges.select("src", "dst")
    if not directed:
        e = e.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = cut_lineage(e.distinct())
    seen = cut_lineage(starts.select(F.col("id").alias("start"), "id").distinct().withColumn("distance", F.lit(0)))
    front, d = seen, 0
    while depth is None or d < depth:
        d += 1
        step = front.select("start", F.col("id").alias("src")).join(e, "src").select("start", F.col("dst").alias("id")).distinct()
        front = cut_lineage(step.join(seen, ["start", "id"], "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    return seen


def shortest_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_hops: int = 6, directed: bool = True) -> DataFrame:
    """One shortest path per (start, target), the smallest predecessor at each step."""
    e = edges.select("src", "dst")
    if not directed:
        e = e.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = cut_lineage(e.distinct())
    seen = cut_lineage(starts.select(F.col("id").alias("start"), "id").distinct().withColumn("path", F.array("id")))
    front = seen
    for _ in range(max_hops):
        step = front.select("start", F.col("id").alias("src"), "path").join(e, "src").groupBy("start", F.col("dst").alias("id")).agg(F.min("path").alias("path"))
        front = cut_lineage(step.join(seen, ["start", "id"], "left_anti").select("start", "id", F.concat("path", F.array("id")).alias("path")))
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    return seen.join(targets.select("id"), "id", "left_semi").select("start", F.col("id").alias("target"), (F.size("path") - 1).alias("length"), "path")


def lineage(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "upstream") -> DataFrame:
    """(start, id, depth): every asset up to ``depth`` steps along or against the edges, at its least depth."""
    e = edges if direction == "downstream" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return hops(e, starts, depth).filter("distance > 0").withColumnRenamed("distance", "depth")


def impact(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Downstream assets with their impact: high one step away, medium beyond."""
    return lineage(edges, starts, depth, "downstream").withColumn("impact", F.when(F.col("depth") == 1, "high").otherwise("medium"))


def provenance_roots(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Upstream assets that have no source of their own."""
    fed = edges.select(F.col("dst").alias("id")).distinct()
    return lineage(edges, starts, depth, "upstream").join(fed, "id", "left_anti")


def provenance_steps(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Transformations upstream of each start, numbered from the roots towards it."""
    up = hops(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, depth)
    steps = edges.join(up.select("start", F.col("id").alias("dst"), "distance"), "dst").filter(F.col("distance") < depth)
    last = steps.groupBy("start").agg(F.max("distance").alias("_far"))
    return steps.join(last, "start").select("start", "src", "dst", (F.col("_far") - F.col("distance") + 1).alias("step"))


def column_lineage(mappings: DataFrame, target_table: str, target_column: str, sources: str) -> DataFrame:
    """Edges from source columns to target columns; ``sources`` is an array of struct(table, column)."""
    return mappings.select(F.explode(sources).alias("s"), F.concat_ws(".", target_table, target_column).alias("dst")) \
        .select(F.concat_ws(".", "s.table", "s.column").alias("src"), "dst").distinct()


def state_at(df: DataFrame, at: Column) -> DataFrame:
    """Rows valid at a time; an open interval has a null end."""
    return df.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)))


def cascade(edges: DataFrame, starts: DataFrame, floor: float = 0.05, max_hops: int = 10) -> DataFrame:
    """(id, probability, hops): strongest propagation along ``strength``, cut at the floor.

    Each round keeps the best probability per vertex, so a vertex improves but never multiplies.
    """
    e = cut_lineage(edges.select("src", "dst", "strength"))
    best = cut_lineage(starts.select("id", F.col("probability").cast("double").alias("probability")).withColumn("hops", F.lit(0)))
    front = best
    for h in range(1, max_hops + 1):
        step = front.select(F.col("id").alias("src"), "probability").join(e, "src") \
            .select(F.col("dst").alias("id"), (F.col("probability") * F.col("strength")).alias("probability")).filter(F.col("probability") > floor) \
            .groupBy("id").agg(F.max("probability").alias("probability"))
        old = best.select("id", F.col("probability").alias("_old"))
        front = cut_lineage(step.join(old, "id", "left").filter(F.col("_old").isNull() | (F.col("probability") > F.col("_old")))
                            .select("id", "probability", F.lit(h).alias("hops")))
        if front.isEmpty():
            break
        best = cut_lineage(best.join(front, "id", "left_anti").unionByName(front))
    return best


def subgraph(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """Edges between vertices within ``depth`` undirected hops of the starts."""
    near = hops(edges, starts, depth, directed=False).select("id").distinct()
    return edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")


def chain_trust(edges: DataFrame, trust: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """0.7 x mean trust + 0.3 x weakest link over each start and what lies upstream of it."""
    chain = hops(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, depth)
    j = salted_lookup(chain.drop("distance"), "id", trust.select(F.col("id").alias("_id"), "trust"), "_id", ["trust"])
    return j.groupBy("start").agg(F.avg("trust").alias("aggregated"), F.min("trust").alias("weakest"), F.count(F.lit(1)).alias("links")) \
        .withColumn("lineage_trust", 0.7 * F.col("aggregated") + 0.3 * F.col("weakest"))


def delegated_power(delegations: DataFrame, power: DataFrame, decay: float = 0.9, max_depth: int = 5) -> DataFrame:
    """Own plus delegated power: each delegator counts decay^depth of its power for everyone on its chain.

    ``delegations(voter, delegate)`` is unique on voter; a chain ends at its depth or where it meets itself.
    """
    d = cut_lineage(delegations.filter("voter <> delegate").select("voter", "delegate"))
    chain = cut_lineage(d.select(F.col("voter").alias("origin"), F.col("delegate").alias("at"), F.array("voter", "delegate").alias("path")).withColumn("depth", F.lit(1)))
    front = chain
    for k in range(2, max_depth + 1):
        hop = salted_lookup(front.select("origin", "at", "path"), "at", d, "voter", ["delegate"]).filter(~F.array_contains("path", F.col("delegate")))
        front = cut_lineage(hop.select("origin", F.col("delegate").alias("at"), F.concat("path", F.array("delegate")).alias("path"), F.lit(k).alias("depth")))
        if front.isEmpty():
            break
        chain = chain.unionByName(front)
    got = chain.join(power.withColumnRenamed("voter", "origin"), "origin").groupBy(F.col("at").alias("voter")).agg(
        F.sum(F.col("power") * F.pow(F.lit(decay), F.col("depth"))).alias("delegated"))
    return power.join(got, "voter", "full_outer").select("voter", F.coalesce("power", F.lit(0.0)).alias("own"), F.coalesce("delegated", F.lit(0.0)).alias("delegated"),
                                                         F.floor(F.coalesce("power", F.lit(0.0)) + F.coalesce("delegated", F.lit(0.0))).alias("total_power"))


# -- fraud on graphs ----------------------------------------------------------------------------------------

def sybil_scores(vertices: DataFrame, edges: DataFrame, created: str | None = None) -> DataFrame:
    """1.0 / 0.7 / 0 by low clustering with a degree above the mean, +0.3 above ten edges per day, at most 1."""
    c = clustering(vertices, edges)
    d = c.join(degrees(edges).select("id", "degree"), "id", "left").fillna(0, ["degree"])
    mean, dev = d.agg(F.avg("degree")).scalar(), d.agg(F.coalesce(F.stddev("degree"), F.lit(0.0))).scalar()
    base = ladder([((F.col("clustering") < 0.1) & (F.col("degree") > mean + 2 * dev), 1.0), ((F.col("clustering") < 0.2) & (F.col("degree") > mean + dev), 0.7)], 0.0)
    if created:
        rate = edges.groupBy(F.col("src").alias("id"), F.date_trunc("day", created).alias("day")).agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.max("n").alias("_rate"))
        d = d.join(rate, "id", "left")
        base = F.least(base + F.when(F.coalesce(F.col("_rate"), F.lit(0)) > 10, 0.3).otherwise(0.0), F.lit(1.0))
    return d.select("id", "degree", "clustering", base.alias("sybil_score"))


def collusion_scores(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Reciprocity of a vertex's strong component of 3 to 20 members; 0 for all others."""
    c = strongly_connected_components(vertices, edges)
    r = reciprocity(edges, c)
    return c.join(r.select("component", "reciprocity"), "component", "left").select("id", F.coalesce("reciprocity", F.lit(0.0)).alias("collusion_score"))


def structural_features(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Rank, degrees and their ratios per vertex, for outlier scoring."""
    p = pagerank(vertices, edges).select("id", "rank")
    d = p.join(degrees(edges), "id", "left").fillna(0)
    n = vertices.select("id").distinct().agg(F.count(F.lit(1))).scalar()
    return d.withColumns({"in_out_ratio": F.col("in_degree") / (F.col("out_degree") + 1), "degree_share": F.col("degree") / n})


def composite_fraud(sybil: DataFrame, collusion: DataFrame, anomaly: DataFrame) -> DataFrame:
    j = sybil.select("id", "sybil_score").join(collusion, "id", "left").join(anomaly, "id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = 0.3 * z("sybil_score") + 0.3 * z("collusion_score") + 0.4 * z("anomaly_score")
    return j.select("id", z("sybil_score").alias("sybil_score"), z("collusion_score").alias("collusion_score"), z("anomaly_score").alias("anomaly_score"),
                    score.alias("fraud_score"), (score > 0.7).alias("is_fraud"))


def fraud_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("vertices"), F.count_if(F.col("sybil_score") > 0.7).alias("sybil"), F.count_if(F.col("collusion_score") > 0.7).alias("collusion"),
                      F.count_if(F.col("anomaly_score") > 0.7).alias("anomalous"), F.count_if("is_fraud").alias("fraud"), F.max("fraud_score").alias("top_score"))


# -- markets and networks -----------------------------------------------------------------------------------

def core_blocks(und: DataFrame) -> DataFrame:
    """(id, blocks, cyclic) of the vertices of undirected edges (a, b).

    Breadth-first tree per component, preorder numbers and subtree ranges level by level; tree edges that share
    a cycle are joined in an auxiliary graph whose components are the blocks. A tree edge is named by its lower end.
    """
    both = cut_lineage(both_ways(und))
    comp = cut_lineage(connected_components(both.select(F.col("v").alias("id")), und.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    tree = cut_lineage(comp.filter("id = component").select("id", F.lit(None).cast(comp.schema["id"].dataType).alias("parent"), F.lit(0).alias("level")))
    front, level = tree, 0
    while True:
        level += 1
        step = front.select(F.col("id").alias("v")).join(both, "v").groupBy(F.col("u").alias("id")).agg(F.min("v").alias("parent"))
        front = cut_lineage(step.join(tree, "id", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        tree = cut_lineage(tree.unionByName(front))
    depth = level - 1
    size = {}
    for l in range(depth, -1, -1):
        here = tree.filter(F.col("level") == l)
        if l == depth:
            size[l] = cut_lineage(here.withColumn("size", F.lit(1)))
        else:
            kids = size[l + 1].groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("_s"))
            size[l] = cut_lineage(here.join(kids, "id", "left").withColumn("size", (1 + F.coalesce("_s", F.lit(0))).cast("long")).drop("_s"))
    sized = size[0]
    for l in range(1, depth + 1):
        sized = sized.unionByName(size[l])
    sliced = value_slices(cut_lineage(sized), ["parent"], "id")
    # sizes of the smaller siblings
    sized = cut_lineage(running(sliced, ["parent"], "id", [], {"_b": ("sum", F.col("size"))}, include_current=False, slice_by=F.col("_cut")).drop("_cut"))
    pre = cut_lineage(sized.filter("level = 0").withColumn("pre", F.lit(0).cast("long")))
    rows = pre
    for l in range(1, depth + 1):
        up = pre.select(F.col("id").alias("_p"), F.col("pre").alias("_pp"))
        here = salted_lookup(sized.filter(F.col("level") == l), "parent", up, "_p", ["_pp"])
        pre = cut_lineage(here.withColumn("pre", F.col("_pp") + 1 + F.coalesce("_b", F.lit(0))).drop("_pp"))
        rows = rows.unionByName(pre.select(rows.columns))
    rows = cut_lineage(rows)
    info = rows.select("id", "parent", "pre", "size")
    e = salted_lookup(und, "a", info.select(F.col("id").alias("_i"), F.col("parent").alias("pa"), F.col("pre").alias("na"), F.col("size").alias("sa")), "_i", ["pa", "na", "sa"])
    e = salted_lookup(e, "b", info.select(F.col("id").alias("_i"), F.col("parent").alias("pb"), F.col("pre").alias("nb"), F.col("size").alias("sb")), "_i", ["pb", "nb", "sb"])
    other = cut_lineage(e.filter(~F.coalesce(F.col("pa") == F.col("b"), F.lit(False)) & ~F.coalesce(F.col("pb") == F.col("a"), F.lit(False))))
    reach = other.select(F.col("a").alias("id"), F.col("nb").alias("n")).unionByName(other.select(F.col("b").alias("id"), F.col("na").alias("n"))) \
        .groupBy("id").agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    base = cut_lineage(rows.join(reach, "id", "left").select("id", "parent", "level", "pre", "size", F.least("pre", "_lo").alias("low"), F.greatest("pre", "_hi").alias("high")))
    spans, below = [], None
    for l in range(depth, -1, -1):
        here = base.filter(F.col("level") == l)
        if below is not None:
            kids = below.groupBy(F.col("parent").alias("id")).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
            here = here.join(kids, "id", "left").withColumns({"low": F.least("low", "_lo"), "high": F.greatest("high", "_hi")}).drop("_lo", "_hi")
        below = cut_lineage(here)
        spans.append(below)
    span = spans[0]
    for s in spans[1:]:
        span = span.unionByName(s)
    span = cut_lineage(span)
    unrelated = ((F.col("na") + F.col("sa") <= F.col("nb")) | (F.col("nb") + F.col("sb") <= F.col("na")))
    aux = other.filter(unrelated).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    up = span.select(F.col("id").alias("_p"), F.col("parent").alias("_pp"), F.col("pre").alias("pn"), F.col("size").alias("ps"))
    child = salted_lookup(span.filter("parent is not null"), "parent", up, "_p", ["_pp", "pn", "ps"])
    tied = child.filter(F.col("_pp").isNotNull() & ((F.col("low") < F.col("pn")) | (F.col("high") >= F.col("pn") + F.col("ps"))))
    aux = aux.unionByName(tied.select(F.col("parent").alias("src"), F.col("id").alias("dst")))
    named = span.filter("parent is not null").select("id", "parent")
    block = cut_lineage(connected_components(named.select("id"), aux))
    size = block.groupBy("component").agg((F.count(F.lit(1)) > 1).alias("wide"))
    ends = named.join(block, "id").join(size, "component")
    incident = ends.select("id", "component", "wide").unionByName(ends.select(F.col("parent").alias("id"), "component", "wide")).distinct()
    return incident.groupBy("id").agg(F.count(F.lit(1)).alias("blocks"), F.bool_or("wide").alias("cyclic"))


#: Most edges of a rest that one task finishes, once a round has gone over the whole graph.
REST = 1 << 16


def _rest_blocks(rest: pa.Table) -> pa.Table:
    """(id, blocks, cyclic) of the ends of distinct undirected edges (a, b), by one depth-first search."""
    ids = pa.concat_arrays([rest[c].combine_chunks() for c in ("a", "b")]).dictionary_encode()
    a, b = np.split(ids.indices.to_numpy(), 2)
    n, src, dst = len(ids.dictionary), np.concatenate([a, b]), np.concatenate([b, a])
    near = dst[np.argsort(src, kind="stable")].tolist()
    ends = np.bincount(src, minlength=n).cumsum()
    at, ends = [0, *ends[:-1].tolist()], ends.tolist()
    number, low, parent, blocks, cyclic, count = [0] * n, [0] * n, [-1] * n, [0] * n, [False] * n, 0
    for root in range(n):
        if number[root]:
            continue
        path = [root]
        open_ = [root]
        number[root] = low[root] = count = count + 1
        while path:
            v = path[-1]
            if at[v] < ends[v]:
                u = near[at[v]]
                at[v] += 1
                if not number[u]:
                    parent[u] = v
                    number[u] = low[u] = count = count + 1
                    path.append(u)
                    open_.append(u)
                elif u != parent[v]:
                    low[v] = min(low[v], number[u])
                continue
            path.pop()
            if not path:
                break
            p = path[-1]
            low[p] = min(low[p], low[v])
            if low[v] >= number[p]:  # what is open from v on is a block with p
                members = [p]
                while members[-1] != v:
                    members.append(open_.pop())
                for w in members:
                    blocks[w] += 1
                    cyclic[w] = cyclic[w] or len(members) > 2
    return pa.table({"id": ids.dictionary, "blocks": pa.array(blocks, "int64"), "cyclic": pa.array(cyclic, "bool")})


def block_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, blocks, cyclic): in how many blocks (largest parts without a cut vertex) of the undirected graph a vertex is, and whether
    one of them is more than a single edge, that is, whether the vertex is on a cycle. Vertices without edges are in none.

    Leaves go, each edge to one a block of its own, and of neighbours with two edges each those merge into one whose hash is the
    least around, over and over: trees and long chains take a logarithmic number of rounds, each a few joins of what is left. A
    vertex is in as many blocks as the one that stands for it, besides its own from before. A rest of up to ``REST`` edges is finished by one task, a larger
    one that no longer shrinks by :func:`core_blocks`.
    """
    ship_package(edges.sparkSession)
    und, steps, k = written(links(edges)), [], 0
    kind = und.schema["a"].dataType
    while True:
        before = und.agg(F.count(F.lit(1))).first()[0]
        if not before:
            break
        if k and before <= REST and isinstance(kind, AtomicType):
            steps.append((False, written(und.groupBy().applyInArrow(_rest_blocks, f"id {kind.simpleString()}, blocks long, cyclic boolean"))))
            break
        if k and before > 0.9 * last:
            steps.append((False, written(core_blocks(und).select("id", "blocks", "cyclic"))))
            break
        last, k = before, k + 1
        leaf = both_ways(und).groupBy("v").agg(F.count(F.lit(1)).alias("d"), F.min("u").alias("u")).filter("d = 1")
        hanging = leaf.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b"), F.lit(True).alias("hangs")).distinct()
        marked = written(und.join(hanging, ["a", "b"], "left").select("a", "b", F.coalesce("hangs", F.lit(False)).alias("hangs")))
        steps.append((False, marked.filter("hangs").select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("blocks"), F.lit(False).alias("cyclic"))))
        und = marked.filter("not hangs").select("a", "b")
        two = written(both_ways(und).groupBy("v").agg(F.count(F.lit(1)).alias("d"), F.min("u").alias("l"), F.max("u").alias("r")).filter("d = 2").drop("d"))
        # each tells itself and its neighbours; who has two edges hears of itself and knows the least around
        told = two.select(F.explode(F.array("l", "r", "v")).alias("id"), "v")
        hook = written(told.groupBy("id").agg(F.min(F.struct(F.xxhash64("v", F.lit(k)), F.col("v"))).getField("v").alias("component"), F.bool_or(F.col("id") == F.col("v")).alias("_two")).filter("_two").drop("_two"))
        chain = written(hook.filter("id <> component").join(hook.filter("id = component").select("component"), "component", "left_semi").select("id", "component"))
        if chain.isEmpty():
            und = written(und)
            continue
        members = chain.unionByName(chain.select(F.col("component").alias("id"), "component").distinct())
        touched = written(members.join(two, F.col("id") == F.col("v")).select("component", "v", F.explode(F.array("l", "r")).alias("u")))
        to = F.coalesce("_c", "u")
        around = touched.join(members.select(F.col("id").alias("_id"), F.col("component").alias("_c")), F.col("u") == F.col("_id"), "left").select("component", F.when(to != F.col("component"), to).alias("to"))
        around = written(around.groupBy("component").agg(F.min("to").alias("l"), F.max("to").alias("r")))
        # both ends at one vertex, or at none, close a cycle; two that close each other are one
        closed = around.filter("l is null or l = r")
        rings = closed.select(F.col("component").alias("id")).unionByName(closed.filter("l is not null").select(F.col("l").alias("id")).join(closed.select(F.col("component").alias("id")), "id", "left_anti"))
        steps += [(True, chain), (False, written(rings.select("id", F.lit(1).cast("long").alias("blocks"), F.lit(True).alias("cyclic"))))]
        moved = around.filter("l <> r").select("component", F.explode(F.array("l", "r")).alias("to")).select(F.least("component", "to").alias("a"), F.greatest("component", "to").alias("b")).distinct()
        gone = touched.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b"))
        und = written(und.join(gone, ["a", "b"], "left_anti").unionByName(moved))
    ids = vertices.select("id").distinct()
    if not steps:
        return ids.select("id", F.lit(0).cast("long").alias("blocks"), F.lit(False).alias("cyclic"))
    found = None
    for is_chain, rows in reversed(steps):
        if is_chain:
            rows = written(rows.join(found, rows["component"] == found["id"]).select(rows["id"], "blocks", "cyclic"))
        found = rows if found is None else found.unionByName(rows)
    total = found.groupBy("id").agg(F.sum("blocks").alias("blocks"), F.bool_or("cyclic").alias("cyclic"))
    return ids.join(total, "id", "left").select("id", F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def articulation_points(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, blocks) of the vertices whose removal disconnects their component: those in two blocks or more (exact)."""
    return block_counts(vertices, edges).filter("blocks > 1").select("id", "blocks")


def resilience(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """0.4 largest-component share + 0.3 mean degree / 10 (at most 1) + 0.3 share of vertices that are no cut vertex."""
    n = vertices.select("id").distinct().agg(F.count(F.lit(1))).scalar()
    giant = connected_components(vertices, edges).groupBy("component").agg(F.count(F.lit(1)).alias("s")).agg(F.max("s")).scalar()
    m = edges.agg(F.count(F.lit(1))).scalar()
    cut = articulation_points(vertices, edges).agg(F.count(F.lit(1))).scalar()
    out = vertices.sparkSession.range(1).select((giant / n).alias("connectivity"), F.least(2 * m / n / 10, F.lit(1.0)).alias("redundancy"), (1 - cut / n).alias("criticality"))
    return out.withColumn("resilience", 0.4 * F.col("connectivity") + 0.3 * F.col("redundancy") + 0.3 * F.col("criticality"))


def dominant_participants(vertices: DataFrame, edges: DataFrame, weight: str, share: float = 0.05, top: int = 10, **ranking) -> DataFrame:
    """Up to ten vertices with more than 5 % of the weighted rank. ``ranking`` goes to :func:`pagerank`."""
    p = pagerank(vertices, edges, weight=weight, **ranking)
    return p.filter(F.col("rank") > share).orderBy(F.col("rank").desc(), "id").limit(top).select("id", "rank")


def systemic_risk(vertices: DataFrame, edges: DataFrame, high_risk: Column, concentration: DataFrame, **ranking) -> DataFrame:
    """min(1, 0.4 rank of the high-risk vertices + 0.3 mean clustering + 0.3 concentration). ``ranking`` goes to :func:`pagerank`."""
    p = pagerank(vertices, edges, **ranking)
    risky = vertices.filter(high_risk).select("id")
    contagion = p.join(risky, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
    mean = clustering(vertices, edges).agg(F.avg("clustering")).scalar()
    hhi = concentration.select("hhi").scalar()
    return vertices.sparkSession.range(1).select(contagion.alias("contagion"), mean.alias("clustering"), hhi.alias("concentration")).withColumn(
        "systemic_risk", F.least(0.4 * F.col("contagion") + 0.3 * F.col("clustering") + 0.3 * F.col("concentration"), F.lit(1.0)))


def risk_clusters(communities: DataFrame, risky: DataFrame, share: float = 0.3) -> DataFrame:
    """Communities in which more than 30 % of the members are high-risk."""
    j = communities.join(risky.select("id").distinct().withColumn("_r", F.lit(1)), "id", "left")
    return j.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.count("_r").alias("high_risk")) \
        .filter(F.col("high_risk") > F.col("size") * share)


def evolution(edges: DataFrame, ts: str, window: str = "1 day") -> DataFrame:
    """New and cumulative vertices and edges, and the density, per interval."""
    start = F.window(ts, window)["start"].alias("window_start")
    first_edge = edges.groupBy("src", "dst").agg(F.min(ts).alias(ts)).groupBy(start).agg(F.count(F.lit(1)).alias("new_edges"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), ts).groupBy("id").agg(F.min(ts).alias(ts)).groupBy(start).agg(F.count(F.lit(1)).alias("new_vertices"))
    per = first_edge.join(ends, "window_start", "full_outer").fillna(0)
    d = running(per.withColumn("_one", F.lit(1)), ["_one"], "window_start", [], {"vertices": ("sum", F.col("new_vertices")), "edges": ("sum", F.col("new_edges"))},
                slice_seconds=365 * 86_400).drop("_one")
    return d.withColumn("density", F.coalesce(ratio(F.col("edges").cast("double"), F.col("vertices") * (F.col("vertices") - 1)), F.lit(0.0)))


def build_graph(events: DataFrame, mapping: dict[str, tuple[str, Column, str, Column]], kind: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """Typed vertices and edges from activity events; repeating an event adds nothing.

    ``mapping[event type] = (source label, source id, edge label and target label "edge:target", target id)``.
    """
    v, e = None, None
    for name, (src_label, src, spec, dst) in mapping.items():
        edge_label, dst_label = spec.split(":")
        rows = events.filter(F.col(kind) == name)
        s = F.concat_ws(":", F.lit(src_label), src.cast("string"))
        d = F.concat_ws(":", F.lit(dst_label), dst.cast("string"))
        one_v = rows.select(s.alias("id"), F.lit(src_label).alias("label")).unionByName(rows.select(d.alias("id"), F.lit(dst_label).alias("label")))
        one_e = rows.select(s.alias("src"), d.alias("dst"), F.lit(edge_label).alias("label"), F.col(ts).alias("created_at"))
        v = one_v if v is None else v.unionByName(one_v)
        e = one_e if e is None else e.unionByName(one_e)
    return v.distinct(), e.groupBy("src", "dst", "label").agg(F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("events"))


def network_risk(vertices: DataFrame, edges: DataFrame, ts: str, now: Column, trust: str) -> DataFrame:
    """Per vertex: 0.1, +0.2 above 50 new links in 7 days, +0.3 above five low-trust links, at most 0.9."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), ts, trust)
    g = ends.groupBy("id").agg(F.count_if(F.col(ts) > now - F.expr("interval 7 days")).alias("new_links"), F.count_if(F.col(trust) < 0.3).alias("low_trust"))
    risk = 0.1 + F.when(F.col("new_links") > 50, 0.2).otherwise(0.0) + F.when(F.col("low_trust") > 5, 0.3).otherwise(0.0)
    return vertices.select("id").distinct().join(g, "id", "left").fillna(0).withColumn("network_risk", F.least(risk, F.lit(0.9)))


def trust_density(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n = vertices.select("id").distinct().agg(F.count(F.lit(1)).alias("vertices"))
    m = links(edges).agg(F.count(F.lit(1)).alias("links"))
    return n.withColumn("k", F.lit(1)).join(m.withColumn("k", F.lit(1)), "k").drop("k").withColumn(
        "density", F.coalesce(ratio(F.col("links").cast("double"), F.col("vertices") * (F.col("vertices") - 1) / 2), F.lit(0.0)))


#: Runs of a block, its items and series points on average, and pairs or points looked at at a time.
RUNS, RUN_ROWS, PIECE = 2048, 1 << 20, 1 << 20


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every element of an array column."""
    rows = table[name].combine_chunks()
    return np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy(zero_copy_only=False)), rows.flatten().to_numpy(zero_copy_only=False)


def _shared_items(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Number of items any two runs of two blocks share, flattened."""
    (x, a), (y, b), width = _flat(left, "items"), _flat(right, "items"), right.num_rows
    order = np.argsort(b, kind="stable")
    y, b = y[order], b[order]
    low, n = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    x, low, n = x[n > low], low[n > low], (n - low)[n > low]
    both, ends, start = np.zeros(left.num_rows * width, dtype="int64"), n.cumsum(), 0
    while start < len(x):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] - n[start] + PIECE, "right")))
        part = n[start:stop]
        at = np.repeat(low[start:stop] - (part.cumsum() - part), part) + np.arange(part.sum())
        both += np.bincount(np.repeat(x[start:stop], part) * width + y[at], minlength=len(both))
        start = stop
    return both


def _correlations(left: pa.Table, right: pa.Table, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pearson's r of the series of rows ``x`` and ``y`` over the indices both have, and where there is none."""
    (xi, i), (yj, j) = _flat(left, "i"), _flat(right, "i")
    at = np.intersect1d(i, j)
    r, none = np.zeros(len(x)), np.ones(len(x), dtype=bool)
    if not len(at):
        return r, none

    def dense(table, row, index):
        place = np.searchsorted(at, index)
        known = place < len(at)
        known[known] = at[place[known]] == index[known]
        full = np.zeros((3, table.num_rows, len(at)))
        for k, name in enumerate(("w", "m", "s")):
            full[k, row[known], place[known]] = _flat(table, name)[1][known]
        return full

    a, b, step = dense(left, xi, i), dense(right, yj, j), max(1, PIECE // len(at))
    for start in range(0, len(x), step):
        part = slice(start, start + step)
        (wa, ma, sa), (wb, mb, sb) = a[:, x[part]], b[:, y[part]]
        w = wa * wb
        n = w.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            da, db = (np.where(w > 0, m - ((w * m).sum(axis=1) / n)[:, None], 0) for m in (ma, mb))
            va, vb = (wb * sa + w * da * da).sum(axis=1), (wa * sb + w * db * db).sum(axis=1)
            r[part] = np.clip((w * da * db).sum(axis=1) / np.sqrt(va * vb), -1, 1)
        flat = [(np.where(w > 0, m, -np.inf).max(axis=1) == np.where(w > 0, m, np.inf).min(axis=1)) & ((v * s).sum(axis=1) == 0) for m, v, s in ((ma, wb, sa), (mb, wa, sb))]
        none[part] = (n < 2) | flat[0] | flat[1]
    return r, none


def _unpacked(row: dict, end: str = "") -> pa.Table:
    """The runs of a block, from its row."""
    values = lambda c: row[f"{c}{end}"].values
    lists = lambda c, sizes: pa.ListArray.from_arrays(pa.array(np.append(0, values(sizes).to_numpy().cumsum()), "int32"), values(c))
    return pa.table({"run": values("run"), "n": values("n"), "items": lists("items", "shared"), **{c: lists(c, "points") for c in ("i", "w", "m", "s")}})


def _similar_runs(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
    """Pairs of a run of one block and a run of another, or of the ``same``, that share an item."""
    runs, numbers = (left["run"], right["run"]), (left["n"].to_numpy(), right["n"].to_numpy())
    both = _shared_items(left, right) if left.num_rows and right.num_rows else np.zeros(0, dtype="int64")
    pairs = np.flatnonzero(both)
    x, y = np.divmod(pairs, max(1, right.num_rows))
    first = runs[0].to_numpy()[x] < runs[1].to_numpy()[y]
    if same:
        pairs, x, y, first = pairs[first], x[first], y[first], first[first]
    jaccard = both[pairs] / (numbers[0][x] + numbers[1][y] - both[pairs])
    r, none = _correlations(left, right, x, y) if len(x) else (np.zeros(0), np.zeros(0, dtype=bool))
    all_runs = pa.concat_arrays([c.combine_chunks() for c in runs])
    a, b = np.where(first, x, len(runs[0]) + y), np.where(first, len(runs[0]) + y, x)
    return pa.table({"a": all_runs.take(pa.array(a)), "b": all_runs.take(pa.array(b)), "jaccard": jaccard, "correlation": pa.array(r, mask=none),
                     "similarity": 0.6 * jaccard + 0.4 * (np.where(none, 0, r) + 1) / 2})


def run_similarity(params: DataFrame, series: DataFrame) -> DataFrame:
    """0.6 Jaccard of shared parameters + 0.4 (correlation + 1) / 2, for runs that share a parameter.

    ``params(run, item)`` and ``series(run, i, x)``. All such pairs are the result, so it grows with the square of the runs of an
    item. Runs are dealt into blocks that meet in pairs, in tasks that read both from shared storage: what is shuffled and kept grows
    with the runs, and no row per pair and item or index is made. Runs whose series are constant or meet in fewer than two values have no correlation.
    """
    ship_package(params.sparkSession)
    p = cut_lineage(params.select("run", "item").filter("run is not null").distinct())
    # only items of several runs make pairs; they travel as numbers
    numbered = cut_lineage(p.filter("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("item", F.monotonically_increasing_id().alias("number")))
    items = p.join(numbered, "item").groupBy("run").agg(F.collect_list("number").alias("items"))
    size = p.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    # a value given several times counts as often: how many, their mean, and their squares around it
    points = series.filter("run is not null and i is not null and x is not null").groupBy("run", "i").agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.avg("x").alias("m"), (F.var_pop("x") * F.count(F.lit(1))).alias("s"))
    lists = points.groupBy("run").agg(F.collect_list(F.struct("i", "w", "m", "s")).alias("p"))
    listed = lambda c: F.coalesce(F.col("p").getField(c), F.expr(f"cast(array() as array<{points.schema[c].dataType.simpleString()}>)")).alias(c)
    runs = cut_lineage(items.join(size, "run").join(lists, "run", "left").select("run", "n", "items", *[listed(c) for c in ("i", "w", "m", "s")]))
    count, rows = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("items") + F.size("i")), F.lit(0))).first()
    blocks = max(1, -(-count // RUNS), -(-rows // RUN_ROWS))
    packed = runs.groupBy(F.pmod(F.xxhash64("run"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct(*runs.columns)).alias("r")).select(
        "block", *[F.col(f"r.{c}").alias(c) for c in ("run", "n")], F.transform("r.items", F.size).alias("shared"), F.transform("r.i", F.size).alias("points"),
        *[F.flatten(f"r.{c}").alias(c) for c in ("items", "i", "w", "m", "s")])

    def similar(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k] for c in b.schema.names}
                same = row["block"] == row["block_b"]
                left = _unpacked(row)
                yield from _similar_runs(left, left if same else _unpacked(row, "_b"), same).to_batches(max_chunksize=1 << 16)

    kind = runs.schema["run"].dataType.simpleString()
    return block_pairs(packed, blocks, 32 * rows + 32 * count).mapInArrow(similar, f"a {kind}, b {kind}, jaccard double, correlation double, similarity double")
