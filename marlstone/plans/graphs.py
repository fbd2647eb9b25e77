"""Graph queries over interaction edges derived from the events, and lineage over a part-supplier graph."""

from pyspark.sql import functions as F

from marlstone.functions.columns import micros
from marlstone.operators import aggregates, graph as g
from marlstone.plans.derived import n_rows, events_now, EVENTS_NOW, SQL_K, k_of
from marlstone.plans.registry import query



def r6(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


def edges(t):
    """Every event as an edge from its user to another user."""
    users = t.events.agg(F.max("user_id") + 1).scalar()
    return t.events.select(F.col("user_id").alias("src"), ((F.col("event_id") * 31 + F.col("user_id") * 7) % users).alias("dst"), "ts", "value", "event_id")


def vertices(t):
    return t.events.select(F.col("user_id").alias("id")).distinct()


def cell_edges(t, fan):
    """Every event as an edge between cells of ``fan`` neighbouring events."""
    src, mixed = F.expr(f"event_id div {fan}"), F.col("event_id") * 31 + F.col("user_id") * 7
    dst = mixed % (t.events.agg(F.max(src)).scalar() + 1)
    return t.events.select(src.alias("src"), dst.alias("dst"), "ts", "value", "event_id")


def cells(t, fan):
    return t.events.select(F.expr(f"event_id div {fan}").alias("id")).distinct()


LINKS_SQL = "l as (select distinct least(src, dst) a, greatest(src, dst) b from e where src <> dst), b as (select a v, b u from l union all select b, a from l)"
GRAPH_SQL = f"""e as (select user_id src, (event_id * 31 + user_id * 7) % (select max(user_id) + 1 from events) dst, ts, value, event_id from events), v as (select distinct user_id id from events),
 {LINKS_SQL}"""


def cell_sql(fan):
    src = f"event_id // {fan}"
    dst = f"(event_id * 31 + user_id * 7) % ((select max({src}) from events) + 1)"
    return f"e as (select {src} src, {dst} dst, ts, value, event_id from events), v as (select distinct {src} id from events), {LINKS_SQL}"


def rank_sql(base, weight="1", rounds=20, tol=0.001):
    """Rounds of the ranking up to the first that changes less than ``tol`` in all; ``pr`` is the result."""
    w = f"ow as (select src, sum({weight})::DOUBLE o from e group by 1), w as materialized (select e.src, dst, {weight} / o w from e join ow on ow.src = e.src), "
    out = [w + f"base as materialized ({base}), sink as (select id from v where id not in (select src from e)), p0 as (select id, b p from base)"]
    for i in range(1, rounds + 1):
        out.append(f"""i{i} as (select dst id, sum(p * w) s from w join p{i - 1} on p{i - 1}.id = w.src group by 1),
 p{i} as materialized (select base.id, b * 0.15 + 0.85 * (coalesce(s, 0) + (select coalesce(sum(p), 0) from p{i - 1} where id in (select id from sink)) * b) p from base left join i{i} on i{i}.id = base.id)""")
    change = " union all ".join(f"select {i} i, (select sum(abs(x.p - y.p)) from p{i} x join p{i - 1} y on x.id = y.id) d" for i in range(1, rounds + 1))
    out.append(f"ended as materialized (select coalesce(min(i) filter (d < {tol}), {rounds}) k from ({change}))")
    out.append("pr as materialized (" + " union all ".join(f"select id, p from p{i} where {i} = (select k from ended)" for i in range(1, rounds + 1)) + ")")
    return ", ".join(out)


UNIFORM = "select id, 1.0::DOUBLE / (select count(*) from v) b from v"


@query("gra1_pagerank", "GRA1", f"with {GRAPH_SQL}, {rank_sql(UNIFORM)} select id, round(p, 9) rank, round((p - (select min(p) from pr)) / (select max(p) - min(p) from pr) * 100, 5) score from pr")
def _(t):
    d = g.pagerank(vertices(t), edges(t))
    return d.select("id", F.round("rank", 9).alias("rank"), F.round("score", 5).alias("score"))


@query("gra2_pagerank_by_type", "GRA2", f"""with {GRAPH_SQL}, {rank_sql(UNIFORM)}
select id, round(p, 9) rank from pr where id in (select user_id from events group by 1 having arg_min(event_type, event_id) = 'view')""")
def _(t):
    kind = t.events.groupBy(F.col("user_id").alias("id")).agg(F.min_by("event_type", "event_id").alias("kind"))
    d = g.pagerank(vertices(t), edges(t)).join(kind.filter("kind = 'view'"), "id", "left_semi")
    return r6(d.select("id", "rank"), "rank", places=9)


@query("gra3_personalized_pagerank", "GRA3", f"with {GRAPH_SQL}, {rank_sql('select id, case when id % 50 = 7 then 1.0::DOUBLE / (select count(*) from v where id % 50 = 7) else 0 end b from v')} select id, round(p, 9) rank from pr")
def _(t):
    v = vertices(t)
    return g.pagerank(v, edges(t), sources=v.filter("id % 50 = 7")).select("id", F.round("rank", 9).alias("rank"))


LPA = ", ".join([f"l{i} as (select v.id, coalesce(x.label, v.label) label from l{i - 1} v left join (select v id, label from (select v, label, row_number() over (partition by v order by count(*) desc, label) r from b join l{i - 1} z on z.id = b.u group by v, label) where r = 1) x on x.id = v.id)" for i in (1, 2, 3)])


@query("gra4_label_propagation", "GRA4", f"with {cell_sql(4)}, l0 as (select id, id label from v), {LPA} select label, count(*) size, min(id) first_member from l3 group by 1")
def _(t):
    return g.label_propagation(cells(t, 4), cell_edges(t, 4), 3).groupBy("label").agg(n_rows().alias("size"), F.min("id").alias("first_member"))


@query("gra5_modularity_communities", "GRA5")
def _(t):
    e = edges(t)
    c = g.modularity_communities(vertices(t), e)
    q = g.modularity(g.links(e).withColumnsRenamed({"a": "src", "b": "dst"}), c).select("modularity").scalar()
    return c.groupBy("community").agg(n_rows().alias("size")).withColumn("modularity", F.round(q, 6))


@query("gra5_modularity", "GRA5", f"""with {GRAPH_SQL}, m as (select count(*)::DOUBLE m from l), k as (select v % 5 c, count(*)::DOUBLE k from b group by 1)
select round((select count(*) from l where a % 5 = b % 5) / m - (select sum(k * k) from k) / (4 * m * m), 9) modularity from m""")
def _(t):
    p = g.links(edges(t)).withColumnsRenamed({"a": "src", "b": "dst"})
    return r6(g.modularity(p, vertices(t).withColumn("community", F.col("id") % 5)), "modularity", places=9)


#: With one edge from each cell, whatever is connected leads to one cycle (or to a cell whose edge is a loop), whose largest cell names it.
REACH_SQL = """f as (select distinct src, dst from e where src <> dst), r as (select id x, id y from v union select r.x, f.dst from r join f on f.src = r.y)"""
PARTS_SQL = f"""{REACH_SQL}, cy as (select distinct p.x from r p join r q on q.x = p.y and q.y = p.x where p.x <> p.y union select id from v where id not in (select src from f)),
 tp as (select r.x id, max(r.y) top from r join cy on cy.x = r.y group by 1), c as (select id, min(id) over (partition by top) component from tp)"""


@query("gra6_connected_components", "GRA6", f"""with recursive {cell_sql(1)}, {PARTS_SQL}
select id, component, count(*) over (partition by component) size, component = (select component from c group by 1 order by count(*) desc, component limit 1) is_giant from c""")
def _(t):
    c = g.connected_components(cells(t, 1), cell_edges(t, 1))
    return c.join(g.component_sizes(c), "component").select("id", "component", "size", "is_giant")


@query("gra7_community_edges", "GRA7 JON17", f"""with {GRAPH_SQL}, s as (select id % 7 c, count(*) size from v group by 1), t as (select src % 7 c, src % 7 = dst % 7 i from e union all select dst % 7, false from e where src % 7 <> dst % 7)
select t.c community, any_value(size) size, count(*) filter (i) internal_edges, count(*) touching_edges, round(count(*) filter (i) / count(*)::DOUBLE, 6) internal_ratio from t join s on s.c = t.c group by 1""")
def _(t):
    return r6(g.community_edges(edges(t), vertices(t).withColumn("community", F.col("id") % 7)), "internal_ratio")


@query("gra8_degrees", "GRA8", f"with {GRAPH_SQL}, x as (select src id, 0 i, 1 o from e union all select dst, 1, 0 from e) select id, sum(i)::BIGINT in_degree, sum(o)::BIGINT out_degree, count(*) degree from x group by 1")
def _(t):
    return g.degrees(edges(t))


CLU = """nb as (select v id, count(*) d from b group by 1), tri as (select x.a p, x.b q, y.b r from l x join l y on y.a = x.b join l z on z.a = x.a and z.b = y.b),
 tc as (select id, count(*) n from (select p id from tri union all select q from tri union all select r from tri) group by 1),
 cl as (select v.id, coalesce(d, 0) neighbours, coalesce(n, 0) triangles, coalesce(2.0 * n / nullif(d * (d - 1), 0), 0)::DOUBLE clustering from v left join nb on nb.id = v.id left join tc on tc.id = v.id)"""


@query("gra9_triangles_and_clustering", "GRA9", f"with {GRAPH_SQL}, {CLU} select id, neighbours, triangles, round(clustering, 6) clustering from cl")
def _(t):
    return r6(g.clustering(vertices(t), edges(t)), "clustering")


SCC = f"""{REACH_SQL}, scc as (select p.x id, max(p.y) component from r p join r q on q.x = p.y and q.y = p.x group by 1)"""


@query("gra10_strong_components", "GRA10", f"with recursive {cell_sql(1)}, {SCC} select id, component from scc")
def _(t):
    return g.strongly_connected_components(cells(t, 1), cell_edges(t, 1))


@query("gra11_reciprocity", "GRA11", f"""with recursive {cell_sql(1)}, {SCC}, z as (select component c, count(*) n from scc group by 1 having count(*) between 3 and 20),
 i as (select f.*, z.c, n from f join scc x on x.id = src join scc y on y.id = dst and y.component = x.component join z on z.c = x.component),
 k as (select *, exists (select 1 from f k where k.src = i.dst and k.dst = i.src) back from i)
select c component, any_value(n) size, count(*) edges, round(count(*) filter (back) / count(*)::DOUBLE, 6) reciprocity, count(*) filter (back) / count(*)::DOUBLE > 0.7 suspicious from k group by c""")
def _(t):
    e = cell_edges(t, 1)
    return r6(g.reciprocity(e, g.strongly_connected_components(cells(t, 1), e)), "reciprocity")


@query("gra11_reciprocity_by_group", "GRA11", f"""with {GRAPH_SQL}, d as (select distinct src, dst from e where src <> dst), s as (select id, id // 16 c from v), z as (select c, count(*) n from s group by 1 having count(*) between 3 and 20),
 i as (select d.*, x.c from d join s x on x.id = src join s y on y.id = dst and y.c = x.c)
select c component, any_value(n) size, count(*) edges, round(count(*) filter (exists (select 1 from d k where k.src = i.dst and k.dst = i.src)) / count(*)::DOUBLE, 6) reciprocity,
 count(*) filter (exists (select 1 from d k where k.src = i.dst and k.dst = i.src)) / count(*)::DOUBLE > 0.7 suspicious from i join z using (c) group by c""")
def _(t):
    return r6(g.reciprocity(edges(t), vertices(t).withColumn("component", F.expr("id div 16"))), "reciprocity")


@query("gra12_hops", "GRA12", f"with recursive {cell_sql(4)}, s(id) as (values (1), (2), (77)), h as (select id \"start\", id, 0 d from s union select \"start\", b.u, d + 1 from h join b on b.v = h.id where d < 3) select \"start\"::BIGINT \"start\", id::BIGINT id, min(d)::INTEGER distance from h group by all")
def _(t):
    starts = cells(t, 4).filter("id in (1, 2, 77)")
    return g.hops(cell_edges(t, 4), starts, 3, directed=False)


@query("gra12_shortest_paths", "GRA12", f"with recursive {cell_sql(4)}, h as (select 1::BIGINT \"start\", 1::BIGINT id, 0 d union select \"start\", b.u, d + 1 from h join b on b.v = h.id where d < 6) select \"start\", id target, min(d)::INTEGER length from h group by all")
def _(t):
    p = g.shortest_paths(cell_edges(t, 4), cells(t, 4).filter("id = 1"), cells(t, 4), 6, directed=False)
    return p.select("start", "target", "length")


#: A lineage graph without cycles: edges always lead to a larger id.
LIN_SQL = cell_sql(2) + ", lin as (select a src, b dst from l)"


def lineage_edges(t):
    return g.links(cell_edges(t, 2)).withColumnsRenamed({"a": "src", "b": "dst"})


@query("gra13_lineage", "GRA13", f"""with recursive {LIN_SQL}, h as (select id "start", id, 0 d from v where id % 500 = 120 union select "start", lin.src, d + 1 from h join lin on lin.dst = h.id where d < 4)
select "start", id, min(d)::INTEGER depth from h where d > 0 group by all""")
def _(t):
    return g.lineage(lineage_edges(t), cells(t, 2).filter("id % 500 = 120"), 4)


@query("gra14_impact", "GRA14", f"""with recursive {LIN_SQL}, s as (select id from v where id % 500 < 5), h as (select id "start", id, 0 d from s union select "start", lin.dst, d + 1 from h join lin on lin.src = h.id where d < 3),
 m as (select "start", id, min(d) d from h where d > 0 group by all) select "start", case when d = 1 then 'high' else 'medium' end impact, count(*) assets from m group by all""")
def _(t):
    return g.impact(lineage_edges(t), cells(t, 2).filter("id % 500 < 5"), 3).groupBy("start", "impact").agg(n_rows().alias("assets"))


@query("gra15_provenance_roots", "GRA15", f"""with recursive {LIN_SQL}, h as (select id "start", id, 0 d from v where id % 500 = 190 union select "start", lin.src, d + 1 from h join lin on lin.dst = h.id where d < 5),
 m as (select "start", id, min(d) d from h where d > 0 group by all) select "start", id, d::INTEGER depth from m where id not in (select dst from lin)""")
def _(t):
    return g.provenance_roots(lineage_edges(t), cells(t, 2).filter("id % 500 = 190"), 5).select("start", "id", "depth")


@query("gra15_provenance_steps", "GRA15", f"""with recursive {LIN_SQL}, h as (select id "start", id, 0 d from v where id % 500 = 190 union select "start", lin.src, d + 1 from h join lin on lin.dst = h.id where d < 3), m as (select "start", id, min(d) d from h group by all),
 s as (select "start", lin.src, lin.dst, d from lin join m on m.id = lin.dst where d < 3) select "start", src, dst, (max(d) over (partition by "start") - d + 1)::INTEGER step from s""")
def _(t):
    return g.provenance_steps(lineage_edges(t), cells(t, 2).filter("id % 500 = 190"), 3)


@query("gra16_column_lineage", "GRA16", "select distinct 'raw.' || event_type src, 'gold.u' || (user_id % 10)::VARCHAR dst from events union select distinct 'dim.user', 'gold.u' || (user_id % 10)::VARCHAR from events")
def _(t):
    pair = lambda a, b: F.struct(a.alias("table"), b.alias("column"))
    m = t.events.select(F.lit("gold").alias("tt"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("tc"),
                        F.array(pair(F.lit("raw"), F.col("event_type")), pair(F.lit("dim"), F.lit("user"))).alias("s"))
    return g.column_lineage(m, "tt", "tc", "s")


@query("gra17_state_at", "GRA17", """
with h as (select user_id, event_id, ts f, lead(ts) over (partition by user_id order by ts) t from events) select user_id, event_id from h where f <= TIMESTAMP '2024-01-15' and (t is null or t >= TIMESTAMP '2024-01-15')""")
def _(t):
    from marlstone.operators.merge import history
    h = history(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", ["event_id"])
    return g.state_at(h, F.lit("2024-01-15").cast("timestamp_ntz")).select("user_id", "event_id")


@query("gra18_cascade", "GRA18", f"""with recursive {cell_sql(4)}, q as (select src, dst, max(least(value / 100, 1)) s from e group by all), h as (select id, 0.9::DOUBLE p, 0 n from v where id % 500 = 5 union select q.dst, p * s, n + 1 from h join q on q.src = h.id where n < 10 and p * s > 0.05)
select id, round(max(p), 6) probability from h group by 1""")
def _(t):
    e = cell_edges(t, 4).groupBy("src", "dst").agg(F.max(F.least(F.col("value") / 100, F.lit(1.0))).alias("strength"))
    s = cells(t, 4).filter("id % 500 = 5").withColumn("probability", F.lit(0.9))
    return g.cascade(e, s).select("id", F.round("probability", 6).alias("probability"))


@query("gra19_dependency_subgraph", "GRA19", f"with recursive {cell_sql(4)}, h as (select distinct id, 0 d from v where id % 50 = 7 union select b.u, d + 1 from h join b on b.v = h.id where d < 3), m as (select distinct id from h) select src, dst, event_id from e where src in (select id from m) and dst in (select id from m)")
def _(t):
    return g.subgraph(cell_edges(t, 4), cells(t, 4).filter("id % 50 = 7")).select("src", "dst", "event_id")


@query("gra20_sybil_scores", "GRA20", f"""with {GRAPH_SQL}, {CLU}, x as (select src id from e union all select dst from e), dg as (select id, count(*) degree from x group by 1),
 j as (select cl.id, clustering, coalesce(degree, 0) degree from cl left join dg on dg.id = cl.id), s as (select avg(degree) m, stddev(degree) d from j),
 rt as (select src id, max(n) r from (select src, date_trunc('day', ts) d, count(*) n from e group by all) group by 1)
select j.id, degree, round(clustering, 6) clustering, least(case when clustering < 0.1 and degree > m + 2 * d then 1.0 when clustering < 0.2 and degree > m + d then 0.7 else 0.0 end + case when coalesce(r, 0) > 10 then 0.3 else 0 end, 1.0)::DOUBLE sybil_score
from j cross join s left join rt on rt.id = j.id""")
def _(t):
    return r6(g.sybil_scores(vertices(t), edges(t), "ts"), "clustering")


@query("gra21_collusion_scores", "GRA21", f"""with recursive {cell_sql(1)}, {SCC}, z as (select component, count(*) n from scc group by 1 having count(*) between 3 and 20),
 i as (select f.*, x.component c from f join scc x on x.id = src join scc y on y.id = dst and y.component = x.component join z on z.component = x.component),
 k as (select c, avg(exists(select 1 from f q where q.src = i.dst and q.dst = i.src)::INTEGER) rc from i group by 1)
select scc.id, round(coalesce(rc, 0), 6)::DOUBLE collusion_score from scc left join k on k.c = scc.component""")
def _(t):
    return r6(g.collusion_scores(cells(t, 1), cell_edges(t, 1)), "collusion_score")


@query("gra22_structural_outliers", "GRA22 DQ19")
def _(t):
    from marlstone.operators.outliers import isolation_scores
    f = g.structural_features(vertices(t), edges(t))
    return isolation_scores(f, "id", ["rank", "in_degree", "out_degree", "in_out_ratio", "degree_share"], trees=30).select("id", F.round("anomaly_score", 6).alias("anomaly_score"))


def fraud(t):
    e, v = cell_edges(t, 1), cells(t, 1)
    an = e.groupBy(F.col("src").alias("id")).agg((F.max("value") / 500).alias("anomaly_score"))
    return g.composite_fraud(g.sybil_scores(v, e), g.collusion_scores(v, e), an)


FRAUD = f"""{cell_sql(1)}, {CLU}, {SCC}, x as (select src id from e union all select dst from e), dg as (select id, count(*) degree from x group by 1),
 j as (select cl.id, clustering, coalesce(degree, 0) degree from cl left join dg on dg.id = cl.id), s as (select avg(degree) m, stddev(degree) d from j), an as (select src id, max(value) / 500 a from e group by 1),
 z as (select component, count(*) n from scc group by 1 having count(*) between 3 and 20),
 i as (select f.*, x.component c from f join scc x on x.id = src join scc y on y.id = dst and y.component = x.component join z on z.component = x.component),
 k as (select c, avg(exists(select 1 from f q where q.src = i.dst and q.dst = i.src)::INTEGER) rc from i group by 1),
 o as (select j.id, case when clustering < 0.1 and degree > m + 2 * d then 1.0 when clustering < 0.2 and degree > m + d then 0.7 else 0.0 end::DOUBLE sy, coalesce(rc, 0)::DOUBLE co, a
  from j cross join s join an on an.id = j.id join scc on scc.id = j.id left join k on k.c = scc.component),
 fr as (select id, sy sybil_score, co collusion_score, a anomaly_score, 0.3 * sy + 0.3 * co + 0.4 * a fraud_score from o)"""


@query("gra23_composite_fraud", "GRA23", f"""with recursive {FRAUD}
select id, sybil_score, round(collusion_score, 6) collusion_score, round(anomaly_score, 6) anomaly_score, round(fraud_score, 6) fraud_score, fraud_score > 0.7 is_fraud from fr""")
def _(t):
    return r6(fraud(t), "collusion_score", "anomaly_score", "fraud_score")


@query("gra24_fraud_summary", "GRA24", f"""with recursive {FRAUD}
select count(*) vertices, count(*) filter (sybil_score > 0.7) sybil, count(*) filter (collusion_score > 0.7) collusion, count(*) filter (anomaly_score > 0.7) anomalous,
 count(*) filter (fraud_score > 0.7) fraud, round(max(fraud_score), 6) top_score from fr""")
def _(t):
    return r6(g.fraud_summary(fraud(t)), "top_score")


#: In such a graph a cell is in as many blocks as it has neighbours, but on a cycle of three or more two of them count as one.
CUTS = f"""{PARTS_SQL}, scc as (select p.x id, max(p.y) component from r p join r q on q.x = p.y and q.y = p.x group by 1),
 on3 as (select id from scc where component in (select component from scc group by 1 having count(*) > 2)),
 nb as (select v cut, count(*) - case when v in (select id from on3) then 1 else 0 end parts from b group by 1)"""


@query("gra27_articulation_points", "GRA27", f"with recursive {cell_sql(1)}, {CUTS} select cut id, parts blocks from nb where parts > 1")
def _(t):
    return g.articulation_points(cells(t, 1), cell_edges(t, 1))


@query("gra27_resilience", "GRA27", f"""with recursive {cell_sql(1)}, {CUTS},
 z as (select max(n) n from (select component, count(*) n from c group by 1)), k as (select z.n / (select count(*) from v)::DOUBLE co, least(2 * (select count(*) from e) / (select count(*) from v)::DOUBLE / 10, 1) re,
  1 - (select count(*) from nb where parts > 1) / (select count(*) from v)::DOUBLE cr from z)
select round(co, 6) connectivity, round(re, 6) redundancy, round(cr, 6) criticality, round(0.4 * co + 0.3 * re + 0.3 * cr, 6) resilience from k""")
def _(t):
    return r6(g.resilience(cells(t, 1), cell_edges(t, 1)).drop("id"), "connectivity", "redundancy", "criticality", "resilience")


@query("gra28_systemic_risk", "GRA28", f"""with {GRAPH_SQL}, {CLU}, {rank_sql(UNIFORM)}, h as (select sum(x * x) / pow(sum(x), 2) hhi from (select user_id, sum(value) x from events group by 1)),
 k as (select (select sum(p) from pr where id % 10 = 0) co, (select avg(clustering) from cl) cl, hhi from h)
select round(co, 6) contagion, round(cl, 6) clustering, round(hhi, 6) concentration, round(least(0.4 * co + 0.3 * cl + 0.3 * hhi, 1), 6) systemic_risk from k""")
def _(t):
    h = aggregates.concentration(t.events, "user_id", "value")
    d = g.systemic_risk(vertices(t), edges(t), F.col("id") % 10 == 0, h)
    return r6(d.drop("id"), "contagion", "clustering", "concentration", "systemic_risk")


@query("gra28_dominant_participants", "GRA28", f"""with {GRAPH_SQL.replace("e as (select", "drawn as (select", 1).replace(", v as (", ", e as (select src, dst * dst * dst // (select (max(user_id) + 1) * (max(user_id) + 1) from events) dst, ts, value, event_id from drawn), v as (", 1)},
 {rank_sql(UNIFORM, 'value')} select id, round(p, 9) rank from pr where p > 0.05 order by p desc, id limit 10""")
def _(t):
    users = t.events.agg(F.max("user_id") + 1).scalar()
    skewed = edges(t).withColumn("dst", F.call_function("div", F.col("dst") * F.col("dst") * F.col("dst"), users * users))
    return r6(g.dominant_participants(vertices(t), skewed, "value"), "rank", places=9)


@query("gra29_risk_clusters", "GRA29", f"with {GRAPH_SQL}, j as (select id % 12 community, (id * 13) % 7 < 2 r from v) select community, count(*) size, count(*) filter (r) high_risk from j group by 1 having count(*) filter (r) > count(*) * 0.3")
def _(t):
    return g.risk_clusters(vertices(t).withColumn("community", F.col("id") % 12), vertices(t).filter("(id * 13) % 7 < 2"))


@query("gra30_run_similarity", "GRA30", f"""
with p as (select distinct user_id run, date_trunc('hour', ts)::VARCHAR || ' ' || {SQL_K} item from events), s as (select user_id run, extract(day from ts)::INTEGER i, avg(value) x from events group by all), n as (select run, count(*) n from p group by 1),
 j as (select a.run a, b.run b, count(*) k from p a join p b on a.item = b.item and a.run < b.run group by all), c as (select x.run a, y.run b, corr(x.x, y.x) r from s x join s y on x.i = y.i and x.run < y.run group by all)
select j.a, j.b, round(k / (na.n + nb.n - k)::DOUBLE, 6) jaccard, round(r, 6) correlation, round(0.6 * k / (na.n + nb.n - k)::DOUBLE + 0.4 * (coalesce(r, 0) + 1) / 2, 6) similarity from j join n na on na.run = j.a join n nb on nb.run = j.b left join c on c.a = j.a and c.b = j.b""")
def _(t):
    e = t.events
    item = F.concat_ws(" ", F.date_trunc("hour", "ts").cast("string"), k_of(e).cast("string"))
    s = e.groupBy(F.col("user_id").alias("run"), F.dayofmonth("ts").alias("i")).agg(F.avg("value").alias("x"))
    return r6(g.run_similarity(e.select(F.col("user_id").alias("run"), item.alias("item")), s), "jaccard", "correlation", "similarity")


@query("gra31_evolution", "GRA31", f"""with {GRAPH_SQL}, f as (select src, dst, min(ts) ts from e group by all), ne as (select date_trunc('day', ts)::TIMESTAMP w, count(*) n from f group by 1),
 fv as (select id, min(ts) ts from (select src id, ts from e union all select dst, ts from e) group by 1), nv as (select date_trunc('day', ts)::TIMESTAMP w, count(*) n from fv group by 1),
 j as (select coalesce(ne.w, nv.w) w, coalesce(ne.n, 0) en, coalesce(nv.n, 0) vn from ne full join nv on ne.w = nv.w), c as (select *, sum(vn) over (order by w) v, sum(en) over (order by w) m from j)
select epoch_us(w) window_start, en new_edges, vn new_vertices, v::BIGINT vertices, m::BIGINT edges, round(coalesce(m / nullif(v * (v - 1), 0)::DOUBLE, 0), 9) density from c""")
def _(t):
    d = g.evolution(edges(t), "ts").withColumn("window_start", micros("window_start"))
    return r6(d, "density", places=9)


def activity_graph(t):
    k = k_of(t.events)
    return g.build_graph(t.events, {"purchase": ("user", F.col("user_id"), "bought:asset", k), "view": ("user", F.col("user_id"), "viewed:asset", k),
                                    "signup": ("user", F.col("user_id"), "joined:project", k % 10)}, "event_type", "ts")


@query("gra32_build_edges", "GRA32 STR14 SRC11", f"""
with x as (select 'user:' || user_id src, case when event_type = 'signup' then 'project:' || ({SQL_K} % 10) else 'asset:' || {SQL_K} end dst, case event_type when 'purchase' then 'bought' when 'view' then 'viewed' else 'joined' end label, ts from events where event_type in ('purchase', 'view', 'signup'))
select src, dst, label, epoch_us(min(ts)) created_at, count(*) events from x group by all""")
def _(t):
    return activity_graph(t)[1].withColumn("created_at", micros("created_at"))


@query("gra32_build_vertices", "GRA32", f"""
select distinct 'user:' || user_id id, 'user' label from events where event_type in ('purchase', 'view', 'signup') union select distinct 'asset:' || {SQL_K}, 'asset' from events where event_type in ('purchase', 'view')
union select distinct 'project:' || ({SQL_K} % 10), 'project' from events where event_type = 'signup'""")
def _(t):
    return activity_graph(t)[0]


@query("src11_graph_load", "SRC11 FLT2", f"""with v as (select user_id id, arg_min(event_type, event_id) label, max(value) value from events where user_id % 3 = 1 group by 1 having arg_min(event_type, event_id) in ('view', 'click')),
 e as (select user_id src, (event_id * 31 + user_id * 7) % (select max(user_id) + 1 from events) dst, event_id from events where user_id % 3 = 1)
select 'edge' kind, src, dst, event_id::DOUBLE property, null label from e where src in (select id from v) and dst in (select id from v) union all select 'vertex', id, id, value, label from v""")
def _(t):
    from marlstone.sources.readers import flatten_properties, graph_tables
    team = F.concat(F.lit("team"), (F.col("id") % 3).cast("string"))
    v = (t.events.groupBy(F.col("user_id").alias("id")).agg(F.min_by("event_type", "event_id").alias("label"), F.create_map(F.lit("value"), F.max("value")).alias("props"))
         .withColumn("tenant_id", team))
    e = edges(t).select("src", "dst", F.col("src").alias("id"), F.create_map(F.lit("event_id"), F.col("event_id").cast("double")).alias("props")).withColumn("tenant_id", team).drop("id")
    v, e = graph_tables(v, e, "team1", ["view", "click"])
    v, e = flatten_properties(v, ["value"]), flatten_properties(e, ["event_id"])
    return (e.select(F.lit("edge").alias("kind"), "src", "dst", F.col("event_id").alias("property"), F.lit(None).cast("string").alias("label"))
            .unionByName(v.select(F.lit("vertex").alias("kind"), F.col("id").alias("src"), F.col("id").alias("dst"), F.col("value").alias("property"), "label")))


@query("gra33_lineage_trust", "GRA33", f"""with recursive {LIN_SQL}, s as (select id from v), h as (select id "start", id, 0 d from s union select "start", lin.src, d + 1 from h join lin on lin.dst = h.id where d < 3),
 m as (select distinct "start", id from h), q as (select "start", avg((id * 17 % 100) / 100.0) a, min((id * 17 % 100) / 100.0) w, count(*) n from m group by 1) select "start", round(0.7 * a + 0.3 * w, 10)::DOUBLE lineage_trust, n links from q""")
def _(t):
    tr = cells(t, 2).withColumn("trust", (F.col("id") * 17 % 100) / 100.0)
    return r6(g.chain_trust(lineage_edges(t), tr, cells(t, 2), 3).select("start", "lineage_trust", "links"), "lineage_trust", places=10)


@query("gra34_network_risk", "GRA34", f"""with {GRAPH_SQL}, x as (select src id, ts, (event_id % 100) / 100.0 tr from e union all select dst, ts, (event_id % 100) / 100.0 from e),
 q as (select id, count(*) filter (ts > TIMESTAMP '{EVENTS_NOW}' - interval 7 day) n, count(*) filter (tr < 0.3) lo from x group by 1)
select v.id, coalesce(n, 0) new_links, coalesce(lo, 0) low_trust, least(0.9, 0.1 + case when n > 50 then 0.2 else 0 end + case when lo > 5 then 0.3 else 0 end)::DOUBLE network_risk from v left join q on q.id = v.id""")
def _(t):
    e = edges(t).withColumn("tr", (F.col("event_id") % 100) / 100.0)
    return r6(g.network_risk(vertices(t), e, "ts", events_now(), "tr"), "network_risk")


@query("gra34_trust_density", "GRA34", f"with {GRAPH_SQL} select (select count(*) from v) vertices, (select count(*) from l) links, round((select count(*) from l) / ((select count(*) from v) * ((select count(*) from v) - 1) / 2.0), 9)::DOUBLE density")
def _(t):
    return r6(g.trust_density(vertices(t), edges(t)), "density", places=9)


@query("agg32_delegated_power", "AGG32", """
with recursive d as (select c_custkey voter, (c_custkey * 7 + 3) % 1500 delegate from customer where c_custkey % 3 <> 0), e as (select * from d where voter <> delegate and delegate < (select count(*) from customer)), p as (select c_custkey voter, c_acctbal * pi() / 3 "power" from customer),
 h as (select voter origin, delegate cur, [voter, delegate] path, 1 depth from e union all select origin, e.delegate, list_append(path, e.delegate), depth + 1 from h join e on e.voter = h.cur where depth < 5 and not list_contains(path, e.delegate)),
 s as (select cur voter, sum("power" * power(0.9, depth)) g from h join p on p.voter = h.origin group by 1)
select coalesce(p.voter, s.voter) voter, round(coalesce(g, 0), 4) delegated, floor(coalesce("power", 0) + coalesce(g, 0))::BIGINT total_power from p full join s on s.voter = p.voter""")
def _(t):
    n = t.customer.agg(F.count(F.lit(1))).scalar()
    d = t.customer.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("voter"), ((F.col("c_custkey") * 7 + 3) % 1500).alias("delegate")).filter(F.col("delegate") < n)
    p = t.customer.select(F.col("c_custkey").alias("voter"), (F.col("c_acctbal") * F.pi() / 3).alias("power"))
    return r6(g.delegated_power(d, p).drop("own"), "delegated", places=4)
