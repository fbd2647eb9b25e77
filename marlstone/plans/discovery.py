"""Recommendation, search, feature and model queries."""

from pyspark.sql import functions as F

from marlstone.functions.columns import micros
from marlstone.functions.vectors import cosine
from marlstone.operators import features as fe
from marlstone.operators import models as ml
from marlstone.operators import neighbours as nb
from marlstone.operators import recommend as rec
from marlstone.operators import search as se
from marlstone.operators import simulations as sim
from marlstone.plans.derived import n_rows, events_now, EVENTS_NOW, HOURLY_SQL, SQL_K, hourly, k_of
from marlstone.plans.registry import query
from marlstone.session import scratch



def r6(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


def baskets(t):
    return t.events.filter("event_type in ('purchase', 'view')").select("user_id", k_of(t.events).alias("item"))


B_SQL = f"ui as (select distinct user_id u, {SQL_K} i from events where event_type in ('purchase', 'view'))"
CO_SQL = f"{B_SQL}, co as (select a.i item_a, b.i item_b, count(*) users from ui a join ui b on a.u = b.u and a.i <> b.i group by all)"


@query("jon13_cooccurrence", "JON13", f"with {CO_SQL} select item_a, item_b, users from co")
def _(t):
    return rec.item_cooccurrence(baskets(t), "user_id", "item", 8)


REC_SQL = f"""{CO_SQL}, sc as (select u, item_b, sum(users) score from ui join co on co.item_a = ui.i group by all), un as (select * from sc where not exists (select 1 from ui where ui.u = sc.u and ui.i = sc.item_b)),
 rk as (select u user_id, item_b item, score::BIGINT score, row_number() over (partition by u order by score desc, item_b)::INTEGER rank from un)"""


@query("rec1_item_recommendations", "REC1 STR16", f"with {REC_SQL} select * from rk where rank <= 10")
def _(t):
    return rec.item_recommendations(baskets(t), "user_id", "item")


@query("rec2_popular_items", "REC2", f"select {SQL_K} item, count(*) n from events where event_type in ('purchase', 'view') group by 1 order by n desc, item limit 10")
def _(t):
    return rec.popular_items(baskets(t), "item")


@query("rec3_als", "REC3")
def _(t):
    r = baskets(t).groupBy("user_id", "item").agg(n_rows().cast("float").alias("rating"))
    return rec.als_recommendations(r, "user_id", "item", "rating", 5).select("user_id", "item", F.round("rating", 3).alias("rating"))


@query("rec4_graph_recommendations", "REC4")
def _(t):
    return r6(rec.graph_recommendations(baskets(t), "user_id", "item", [7], 10), "score", places=9)


@query("rec5_hybrid", "REC5 SET4", f"""with {REC_SQL}, pop as (select {SQL_K} item, count(*) n from events where event_type in ('purchase', 'view') group by 1 order by n desc, item limit 10), us as (select distinct user_id from events),
 al as (select user_id, item, score * 0.4 s, 'collaborative' m from rk where rank <= 10 union all select user_id, item, n * 0.3, 'content' from us, pop),
 g as (select user_id, item, sum(s) score, string_agg(m, ',' order by m) reasons from al group by all)
select user_id, item, round(score, 6)::DOUBLE score, reasons, row_number() over (partition by user_id order by round(score, 6) desc, item)::INTEGER rank from g qualify rank <= 5""")
def _(t):
    a = rec.item_recommendations(baskets(t), "user_id", "item")
    top = rec.popular_items(baskets(t), "item")
    packed = top.agg(F.collect_list(F.struct("item", F.col("n").alias("score"))).alias("p")).scalar()
    b = t.events.select("user_id").distinct().select("user_id", F.inline(packed))
    return r6(rec.hybrid({"collaborative": a, "content": b}, "user_id", "item", 5), "score")


@query("rec6_recommendation_quality", "REC6", f"""with ui as (select distinct user_id u, {SQL_K} i from events where event_type = 'purchase'), h as (select distinct user_id u, {SQL_K} i from events where event_type = 'view'),
 j as (select u, count(*) n, count(*) filter (exists (select 1 from h where h.u = ui.u and h.i = ui.i)) k from ui group by 1), m as (select u, count(*) m from h group by 1), s as (select j.u, k / n::DOUBLE p, k / m::DOUBLE r from j join m using (u))
select u user_id, round(p, 6) "precision", round(r, 6) recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) f1 from s""")
def _(t):
    pick = lambda e: t.events.filter(F.col("event_type") == e).select("user_id", k_of(t.events).alias("item"))
    return r6(rec.recommendation_quality(pick("purchase"), pick("view"), "user_id", "item"), "precision", "recall", "f1")


@query("rec7_similar_runs", "REC7", """
with f as (select l_suppkey k, avg(l_quantity) a, avg(l_discount) b, sum(l_tax) c from lineitem group by 1), s as (select avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(c) mc, stddev_pop(c) sc from f),
 z as (select k, (a - ma) / sa x, (b - mb) / sb y, (c - mc) / sc w from f, s), p as (select t.k target, r.k run, (t.x * r.x + t.y * r.y + t.w * r.w) / (sqrt(t.x * t.x + t.y * t.y + t.w * t.w) * sqrt(r.x * r.x + r.y * r.y + r.w * r.w)) c from z t, z r where t.k in (1, 2, 3) and r.k <> t.k)
select target, run, round(c, 6) similarity, row_number() over (partition by target order by c desc, run)::INTEGER rank from p qualify rank <= 5""")
def _(t):
    f = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.sum("l_tax").alias("c"))
    return r6(rec.similar_runs(f, "k", ["a", "b", "c"], [1, 2, 3]), "similarity")


@query("rec7_success_and_merge", "REC7", f"""
with s as (select user_id, avg(value) r, count(*) it, stddev(value) / 1000 cr, max({SQL_K}) im, count(*) filter (event_type = 'view') op from events group by 1),
 a as (select user_id, ((1 / (1 + r)) * 0.4 + (1 / (1 + it / 100.0)) * 0.3 + least(abs(cr) / 0.1, 1) * 0.3) * 0.4 + case when op > 0 then (least(im / 100.0, 1) * 0.5 + 1 / (1 + op / 10.0) * 0.5) * 0.3 else 0 end + 0.5 * 0.3 sc from s),
 b as (select c_custkey user_id, c_acctbal / 10000 sc from customer)
select coalesce(a.user_id, b.user_id) user_id, round(0.6 * coalesce(a.sc, 0) + 0.4 * coalesce(b.sc, 0), 6) score from a full join b on a.user_id = b.user_id""")
def _(t):
    s = t.events.groupBy("user_id").agg(F.avg("value").alias("r"), n_rows().alias("it"), (F.stddev("value") / 1000).alias("cr"), F.max(k_of(t.events)).alias("im"), F.count_if(F.col("event_type") == "view").alias("op"))
    a = s.select("user_id", rec.success_score(F.col("r"), F.col("it"), F.col("cr"), F.col("im"), F.col("op"), F.lit(0.5)).alias("score"))
    b = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") / 10000).alias("score"))
    return r6(rec.merge_parameter_lists(a, b, ["user_id"]), "score")


# -- search -------------------------------------------------------------------------------------------------

KNN_SQL = "select q.vec_id query, d.vec_id id, list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) s from embeddings q, embeddings d where"


@query("sch1_exact_knn", "SCH1", f"with p as ({KNN_SQL} q.label = 3 and d.label <> 3) select query, id, round(s, 6) similarity, row_number() over (partition by query order by s desc, id)::INTEGER rank from p qualify rank <= 5")
def _(t):
    e = t.embeddings
    return r6(se.knn(e, e.filter("label = 3"), 5, "vec_id", "embedding", "vec_id", "embedding", F.col("label") != 3), "similarity")


@query("sch14_similar_entities", "SCH14", f"with p as ({KNN_SQL} q.vec_id <> d.vec_id) select query, id, round(s, 6) similarity, row_number() over (partition by query order by s desc, id)::INTEGER rank from p qualify rank <= 3")
def _(t):
    e = t.embeddings
    return r6(nb.knn_by_pivots(e, e, 3, "vec_id", "embedding", "vec_id", "embedding", exclude_self=True).drop("blocks"), "similarity")


@query("sch2_approximate_knn", "SCH2")
def _(t):
    return r6(se.approximate_knn(t.embeddings, t.embeddings.filter("label = 3"), 5, "vec_id", "embedding"), "similarity", places=4)


@query("sch2_recall", "SCH2", "select (count(*) * 10)::BIGINT expected, true recall_reached from embeddings where label = 3")
def _(t):
    e = t.embeddings
    q = e.filter("label = 3")
    exact = nb.knn_by_pivots(e, q, 10, "vec_id", "embedding", "vec_id", "embedding", exclude_self=True)
    found = nb.recall(se.approximate_knn(e, q, 10, "vec_id", "embedding"), exact)
    return found.select("expected", (F.col("recall") >= 0.9).alias("recall_reached"))


TERMS = ["the", "nation", "table", "on", "zz9"]
TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
BM_SQL = f"""tk as (select doc_id, unnest({TOK}) term from documents), ln as (select doc_id, len({TOK}) l from documents), st as (select count(*) n, avg(l) al from ln),
 tf as (select doc_id, term, count(*) tf from tk where term in ('the', 'nation', 'table', 'on', 'zz9') group by all), df as (select term, count(*) df from tf group by 1),
 sc as (select tf.doc_id id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ln.l / al))) s from tf join df using (term) join ln using (doc_id), st group by 1)"""


@query("sch3_bm25", "SCH3", f"with {BM_SQL} select id, round(s, 6) score from sc")
def _(t):
    return r6(se.bm25(t.documents, "doc_id", {"text": 1.0}, TERMS), "score")


@query("sch4_fuzzy_terms", "SCH4", f"""with v as (select term, count(*) n from (select unnest({TOK}) term from documents) group by 1), q(query) as (values ('the'), ('nation'), ('on')),
 p as (select term, n, query, levenshtein(term, query) e, case when length(query) < 3 then 0 when length(query) <= 5 then 1 else 2 end a from v, q) select term, n, query, e::INTEGER edits from p where e <= a""")
def _(t):
    return se.fuzzy_terms(t.documents, "text", ["the", "nation", "on"]).select("term", "n", "query", "edits")


@query("sch5_hybrid_fusion", "SCH5", f"with {BM_SQL}, v as (select doc_id id, n_chars / 10000.0 s from documents) select coalesce(sc.id, v.id) id, round((coalesce(sc.s, 0) * 0.75 + coalesce(v.s, 0) * 0.25) * case when sc.s > 0 and v.s > 0 then 1.2 else 1 end, 6) score, coalesce(sc.s > 0 and v.s > 0, false) in_both from sc full join v on v.id = sc.id")
def _(t):
    text = se.bm25(t.documents, "doc_id", {"text": 1.0}, TERMS)
    vec = t.documents.select(F.col("doc_id").alias("id"), (F.col("n_chars") / 10000.0).alias("score"))
    return r6(se.fuse(text, vec, 0.6, 0.2), "score")


@query("sch6_rerank", "SCH6", """
with h as (select doc_id id, source, n_chars / 100.0 * case when contains(lower(source), 'src1') then 1.5 else 1 end s from documents), r as (select *, row_number() over (partition by source order by s desc, id) k from h)
select id, round(s, 6)::DOUBLE score, k = 1 and (select count(distinct source) from h) >= 3 leads from r""")
def _(t):
    h = t.documents.select(F.col("doc_id").alias("id"), "source", (F.col("n_chars") / 100.0).alias("score"))
    return r6(se.rerank(h, "source", F.col("source"), "SRC1").select("id", "score", "leads"), "score")


@query("sch7_merge_fields", "SCH7", "select id, max(s)::DOUBLE score from (select doc_id id, n_chars * 1.0 s from documents union all select doc_id, length(text) * 1.5 from documents) group by 1 order by 2 desc, 1 limit 20")
def _(t):
    d = t.documents
    a = d.select(F.col("doc_id").alias("id"), (F.col("n_chars") * 1.0).alias("score")).unionByName(d.select(F.col("doc_id").alias("id"), (F.length("text") * 1.5).alias("score")))
    return se.merge_fields(a.withColumn("score", F.col("score").cast("double")), 20)


@query("sch8_facets", "SCH8", """
with c as (select 'lang' dimension, lang "value", count(*) n from documents group by all union all select 'source', source, count(*) from documents group by all)
select dimension, "value", n, row_number() over (partition by dimension order by n desc, "value")::INTEGER rank from c qualify rank <= 10""")
def _(t):
    return se.facets(t.documents, ["lang", "source"])


@query("sch9_graph_boost", "SCH9", """
with h as (select doc_id id, n_chars / 1000.0 s from documents), c as (select user_id id, count(*) l, count(distinct event_type) k, max(event_id) % 30 a from events group by 1)
select h.id, round(s * (1 + least(coalesce(l, 0) * 0.1, 2) + least(coalesce(k, 0) * 0.05, 0.5) + least(coalesce(a, 0) * 0.02, 0.2)), 6)::DOUBLE score from h left join c on c.id = h.id""")
def _(t):
    h = t.documents.select(F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("score"))
    c = t.events.groupBy(F.col("user_id").alias("id")).agg(n_rows().alias("links"), F.countDistinct("event_type").alias("collaborators"), (F.max("event_id") % 30).alias("ancestors"))
    return r6(se.graph_boost(h, c), "score")


@query("sch10_chunks", "SCH10", """
with d as (select doc_id id, text, unnest(range(0, greatest(1, ceil((length(text) - 50) / 150.0))::BIGINT)) c from documents), s as (select id, c::INTEGER chunk, substring(text, (c * 150 + 1)::INTEGER, 200) content from d)
select id, chunk, sha256(content) digest, length(content)::INTEGER n from s where length(content) > 0""")
def _(t):
    c = se.chunks(t.documents, "doc_id", "text", 200, 50)
    return c.select("id", "chunk", F.sha2("content", 256).alias("digest"), F.length("content").alias("n"))


@query("sch10_context", "SCH10", f"""with {BM_SQL}, r as (select id, s, row_number() over (order by s desc, id) rank from sc), l as (select rank, s, '[Source ' || rank || ': doc ' || id || ', Page 1]' || chr(10) || lang || chr(10) line from r join documents d on d.doc_id = r.id where rank <= 5)
select 'q' query, string_agg(line, chr(10) || '---' || chr(10) order by rank) context, round(least(avg(s) filter (rank <= 3) / 2, 1), 2) confidence from l""")
def _(t):
    from marlstone.operators.windows import ranked_top
    s = se.bm25(t.documents, "doc_id", {"text": 1.0}, TERMS).withColumn("query", F.lit("q"))
    top = ranked_top(s, ["query"], [F.col("score").desc(), F.col("id")], 5).join(t.documents.select(F.col("doc_id").alias("id"), "lang"), "id")
    return se.assemble_context(top.withColumns({"title": F.concat(F.lit("doc "), "id"), "page": F.lit(1)}), "query", "title", "page", "lang")


QT = "concat('find @user', user_id, ' #', event_type, ' \"', event_type, ' report\" x.pdf last ', event_id % 9, ' days')"


@query("sch11_query_understanding", "SCH11", """
select event_id, 'pdf' file_types, (event_id % 9)::INTEGER last_days, 'user' || user_id users, event_type tags, event_type || ' report' phrases, case when event_type = 'error' then 'troubleshoot' else 'find' end intent from events""")
def _(t):
    q = t.events.select("event_id", F.expr(QT.replace("'#'", "'#'")).alias("q"))
    return se.understand(q, "q").drop("q")


@query("sch12_synonyms", "SCH12", "with w as (select event_id id, event_type term from events), s(term, synonym) as (values ('click', 'tap'), ('click', 'press'), ('view', 'see')) select id, term from w union select id, synonym from w join s using (term)")
def _(t):
    s = t.spark.createDataFrame([("click", "tap"), ("click", "press"), ("view", "see")], "term string, synonym string")
    return se.expand_synonyms(t.events, "event_id", "event_type", s)


@query("sch13_trending", "SCH13", f"""
with g as (select {SQL_K} topic, count(*) filter (ts > TIMESTAMP '{EVENTS_NOW}' - interval 72 hour) recent, count(*) filter (ts <= TIMESTAMP '{EVENTS_NOW}' - interval 72 hour) previous from events where ts > TIMESTAMP '{EVENTS_NOW}' - interval 144 hour group by 1)
select topic, recent, previous, round((recent + 1) / (previous + 1)::DOUBLE, 6) growth from g order by (recent + 1) / (previous + 1)::DOUBLE desc, recent desc, topic limit 10""")
def _(t):
    return r6(se.trending(t.events.withColumn("topic", k_of(t.events)), "topic", "ts", events_now(), 72), "growth")


# -- features -----------------------------------------------------------------------------------------------

@query("fea1_feature_group", "FEA1", "select user_id, event_id, round(value * 2, 4) twice, case when value > 50 then 'big' else 'Other' end size from events where ts >= TIMESTAMP '2024-01-10' and ts < TIMESTAMP '2024-01-12'")
def _(t):
    g = fe.compute_group(t.events, ["user_id"], "ts", "2024-01-10", "2024-01-12", [("add_columns", {"computations": {"twice": "round(value * 2, 4)"}}),
                         ("categorize", {"out": "size", "cases": [("value > 50", "big")]})], ["event_id", "twice", "size"])
    return g.drop("ts")


@query("fea2_online_view", "FEA2", f"""
with n as (select user_id, max(ts) m, arg_max(value, ts) v, arg_max(event_type, ts) e from events group by 1) select user_id, epoch_us(m) feature_time, coalesce(case when epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(m) <= 86400000000 then v end, -1.0) "value",
 coalesce(case when epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(m) <= 86400000000 then e end, 'none') event_type from n""")
def _(t):
    from marlstone.functions.columns import micros
    v = fe.online_view(t.events, ["user_id"], "ts", ["value", "event_type"], events_now(), 86_400, {"value": -1.0, "event_type": "none"})
    return v.withColumn("feature_time", micros("feature_time"))


@query("fea3_long_to_wide", "FEA3", "select user_id, arg_max(value, ts) filter (event_type = 'click') click, arg_max(value, ts) filter (event_type = 'view') \"view\" from events where ts <= TIMESTAMP '2024-01-20' group by 1")
def _(t):
    return fe.long_to_wide(t.events, ["user_id"], "event_type", "value", "ts", ["click", "view"], F.lit("2024-01-20").cast("timestamp_ntz"))


@query("fea4_feature_statistics", "FEA4", """
with l as (select 'value' column_name, case when event_id % 9 <> 0 then value end v from events union all select 'user_id', user_id from events)
select column_name, count(v) n, count(*) filter (v is null) nulls, round(avg(v), 6) mean, round(stddev(v), 6) std, min(v) "min", max(v) "max", count(distinct v) "distinct", round(quantile_cont(v, 0.25), 6) q25, round(quantile_cont(v, 0.5), 6) q50, round(quantile_cont(v, 0.75), 6) q75 from l group by 1""")
def _(t):
    d = t.events.select(F.expr("case when event_id % 9 <> 0 then value end").alias("value"), "user_id")
    return r6(fe.numeric_statistics(d, ["value", "user_id"]), "mean", "std", "q25", "q50", "q75")


@query("fea4_histogram", "FEA4", "with s as (select min(value) lo, (max(value) - min(value)) / 10 w from events) select least(floor((value - lo) / w), 9)::INTEGER bin, count(*) n from events, s group by 1")
def _(t):
    return fe.histogram(t.events, "value")


@query("fea6_registry", "FEA6", "select p_brand feature, count(*) uses, count(distinct l_suppkey) consumers from part join lineitem on l_partkey = p_partkey where contains(lower(p_name || ' ' || p_type), 'red') group by 1")
def _(t):
    r = t.part.select(F.col("p_partkey"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("owner"), F.array("p_type").alias("tags"))
    hit = fe.registry_search(r, "RED")
    return fe.feature_popularity(hit.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("owner", "feature"), "feature", "l_suppkey")


@query("fea7_metadata_sizes", "FEA7", "select conv_id, count(*)::INTEGER turns_size, count(distinct role)::INTEGER roles_size from conversations group by 1")
def _(t):
    d = t.conversations.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("turn", "role"))).alias("turns"), F.collect_set("role").alias("roles"))
    return fe.metadata_features(d, ["turns"], ["roles"]).select("conv_id", "turns_size", "roles_size")


@query("fea8_chi_square_selection", "FEA8", f"""
with l as (select event_type y, unnest(['k5', 'u5', 'e3']) feature, unnest([{SQL_K} % 5, user_id % 5, event_id % 3]) x from events), c as (select feature, x, y, count(*) o from l group by all), r as (select feature, x, sum(o) rx from c group by all), k as (select feature, y, sum(o) cy from c group by all),
 n as (select feature, sum(o) n from c group by 1), g as (select r.feature, x, y, rx * cy / n e from r join k on k.feature = r.feature join n on n.feature = r.feature),
 s as (select g.feature, sum(power(coalesce(o, 0) - e, 2) / e) st, (count(distinct g.x) - 1) * (count(distinct g.y) - 1) df from g left join c on c.feature = g.feature and c.x = g.x and c.y = g.y group by 1)
select feature, round(st, 6) statistic, df, row_number() over (order by st desc, feature) <= 2 selected from s""")
def _(t):
    d = t.events.select("event_type", (k_of(t.events) % 5).alias("k5"), (F.col("user_id") % 5).alias("u5"), (F.col("event_id") % 3).alias("e3"))
    return r6(fe.select_features(d, ["k5", "u5", "e3"], "event_type", 2), "statistic")


@query("fea8_covariance", "FEA8", """select 'l_quantity' "first", 'l_quantity' "second", round(covar_samp(l_quantity, l_quantity), 4) covariance from lineitem union all select 'l_quantity', 'l_tax', round(covar_samp(l_quantity, l_tax), 4) from lineitem union all select 'l_tax', 'l_tax', round(covar_samp(l_tax, l_tax), 4) from lineitem""")
def _(t):
    return r6(fe.covariance(t.lineitem, ["l_quantity", "l_tax"]), "covariance", places=4)


# -- models -------------------------------------------------------------------------------------------------

def volatility(t):
    from marlstone.operators.market import return_volatility
    d = return_volatility(hourly(t), "market", "ts", "price", (24, 48), 24)
    return d.withColumns({"hour": F.hour("ts"), "range": (F.col("high") - F.col("low")) / F.col("price")}).dropna()


FEATS = ["volatility_24", "volatility_48", "range", "hour"]


@query("ml1_volatility_forecast", "ML1")
def _(t):
    from marlstone.session import cut_lineage
    train, test = ml.time_split(cut_lineage(volatility(t)), "ts")
    m = ml.fit_regression(train, FEATS, "target_volatility")
    return r6(ml.regression_metrics(m.transform(test), "target_volatility", "prediction"), "rmse", "mae", "r2", places=3)


def labelled(t):
    e = t.events
    return e.select("event_id", F.col("value").alias("v"), k_of(e).cast("double").alias("k"), F.hour("ts").cast("double").alias("h"), ((F.col("value") > 60) | (k_of(e) > 90)).cast("double").alias("label"), "event_type")


@query("ml2_weighted_classification", "ML2")
def _(t):
    from pyspark.ml.functions import vector_to_array
    d = ml.class_weights(labelled(t), "label")
    m = ml.fit_classifier(d, ["v", "k", "h"], "label", "weight", 10)
    s = m.transform(d).withColumn("score", vector_to_array("probability")[1])
    return r6(ml.threshold_metrics(s, "label", "score", [0.3, 0.5, 0.7]), "precision", "recall", places=3)


@query("ml3_asset_classifier", "ML3")
def _(t):
    from pyspark.ml.feature import StringIndexer
    d = StringIndexer(inputCol="event_type", outputCol="y", stringOrderType="alphabetAsc").fit(labelled(t)).transform(labelled(t))
    m = ml.fit_classifier(d, ["v", "k", "h"], "y", trees=10)
    return ml.importances(m, ["v", "k", "h"], t.spark).withColumn("importance", F.round("importance", 3))


@query("ml4_component_features", "ML4")
def _(t):
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    f = t.events.groupBy("user_id").agg(F.avg("value").alias("a"), F.stddev("value").alias("b"), F.avg(k_of(t.events)).alias("c"), n_rows().cast("double").alias("d"))
    v = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="x").transform(f.dropna())
    p = PCA(k=2, inputCol="x", outputCol="p").fit(v).transform(v)
    return p.select("user_id", F.round(F.abs(vector_to_array("p")[0]), 3).alias("first"), F.round(F.abs(vector_to_array("p")[1]), 3).alias("second"))


def simulation_runs(t):
    """Three agents per event, in the runs of a user and a day."""
    k = k_of(t.events).cast("double")
    agent = lambda i: F.struct(i.alias("id"), F.struct((F.col("value") + i).alias("x"), (k / 2 + i).alias("y"), (F.col("value") - k).alias("z")).alias("position"),
                               F.struct((k / 10).alias("x"), i.cast("double").alias("y"), (F.col("value") / 50).alias("z")).alias("velocity"))
    return t.events.select(F.col("user_id").alias("simulation_id"), F.date_trunc("day", "ts").alias("day"), F.transform(F.sequence(F.lit(0), F.lit(2)), agent).alias("agents"))


RUNS_SQL = f"""a as (select user_id simulation_id, date_trunc('day', ts)::TIMESTAMP d, i, value + i x, {SQL_K} / 2.0::DOUBLE + i y, value - {SQL_K} z, sqrt(power({SQL_K} / 10.0::DOUBLE, 2) + i * i + power(value / 50, 2)) speed
  from events, (select unnest(range(3)) i))"""


@query("ml4_agent_features", "ML4", f"""with {RUNS_SQL} select simulation_id, epoch_us(d) day_us, round(avg(x), 6) avg_pos_x, round(avg(y), 6) avg_pos_y, round(avg(z), 6) avg_pos_z,
 round(stddev(x), 6) std_pos_x, round(stddev(y), 6) std_pos_y, round(stddev(z), 6) std_pos_z, round(max(speed), 6) max_speed, count(i) num_agents from a group by simulation_id, d""")
def _(t):
    f = sim.agent_features(simulation_runs(t), ["simulation_id", "day"])
    names = [c for c in f.columns if c.startswith(("avg", "std", "max"))]
    return r6(f.withColumn("day_us", micros("day")).drop("day"), *names)


@query("ml4_batch_prediction", "ML4 SNK11", f"""with {RUNS_SQL}, r as (select simulation_id, d from a group by all) select count(*) predicted, true better_than_the_mean from r""")
def _(t):
    f = sim.agent_features(simulation_runs(t), ["simulation_id", "day"])
    older, _ = ml.time_split(f, "day")
    names = [c for c in f.columns if c.startswith(("avg", "std"))]
    model = scratch(t.spark, "model")
    sim.fit_outcome(older, names, "max_speed", components=4).write().save(model)
    p = sim.batch_predict(t.spark, model, f, scratch(t.spark, "predictions"), ["simulation_id", "day", "max_speed"])
    error = F.sum(F.pow(F.col("prediction") - F.col("max_speed"), 2))
    return p.agg(F.count("prediction").alias("predicted"), (error < 0.6 * F.var_pop("max_speed") * F.count("prediction")).alias("better_than_the_mean"))


def updates(t):
    return t.events.groupBy("user_id").agg(n_rows().alias("n"), F.array(F.avg("value"), F.avg(k_of(t.events)).cast("double"), F.max("value")).alias("w")).withColumn("name", F.when(F.col("user_id") % 2 == 0, "dense").otherwise("bias"))


UPD_SQL = f"""up as (select user_id, count(*) n, [avg(value), avg({SQL_K}), max(value)] w, case when user_id % 2 = 0 then 'dense' else 'bias' end name from events group by 1),
 fl as (select name, n, unnest(w) w, unnest([0, 1, 2]) i from up), av as (select name, i, sum(w * n) / sum(n) w from fl group by all)"""


@query("ml5_federated_average", "ML5", f"with {UPD_SQL} select name, i::INTEGER i, round(0.99 * w + 0.01 * 10, 6) w from av")
def _(t):
    prev = t.events.select(F.explode(F.array(F.lit("dense"), F.lit("bias"))).alias("name")).distinct().withColumn("w", F.array(F.lit(10.0), F.lit(10.0), F.lit(10.0)))
    avg = ml.federated_average(updates(t), "user_id", "name", "w", "n", prev, 0.01, 150, 0.8)
    return avg.select("name", F.posexplode("w").alias("i", "w")).withColumn("w", F.round("w", 6))


@query("ml6_round_convergence", "ML6", f"with {UPD_SQL}, d as (select sqrt(sum(power(w - 10, 2))) x, sqrt(sum(100.0)) y from av) select round(x, 6) distance, round(x / y, 6) relative_change, round(1 / (1 + x / y), 6) convergence from d")
def _(t):
    avg = ml.federated_average(updates(t), "user_id", "name", "w", "n")
    prev = avg.select("name", F.transform("w", lambda x: F.lit(10.0)).alias("w"))
    return r6(ml.round_convergence(avg, prev, "name", "w"), "distance", "relative_change", "convergence")


@query("ml7_private_noise", "ML7")
def _(t):
    d = ml.laplace_noise(t.events.select("event_id", "value"), "event_id", {"value": (0.0, 100.0)}, 1.0)
    return d.agg(F.round(F.avg("value"), 3).alias("noisy_mean"), n_rows().alias("n"))


@query("ml8_secret_shares", "ML8", "select event_id, round(value, 6) total, 3::BIGINT parties from events")
def _(t):
    s = ml.secret_shares(t.events, "event_id", "value", 3)
    return s.groupBy("event_id").agg(F.round(F.sum("share"), 6).alias("total"), n_rows().alias("parties"))


@query("ml9_regression_metrics", "ML9", f"with p as (select value y, value * 0.9 + {SQL_K} / 50.0 q from events) select round(sqrt(avg(power(q - y, 2))), 6) rmse, round(avg(abs(q - y)), 6) mae, round(1 - sum(power(q - y, 2)) / (var_pop(y) * count(*)), 6) r2 from p")
def _(t):
    d = t.events.select(F.col("value").alias("y"), (F.col("value") * 0.9 + k_of(t.events) / 50.0).alias("q"))
    return r6(ml.regression_metrics(d, "y", "q"), "rmse", "mae", "r2")


@query("ml9_auc", "ML9", f"""with p as (select (event_type = 'error')::INTEGER y, {SQL_K} + value / 10 s from events), c as (select s, sum(y) p, sum(1 - y) n from p group by 1),
 r as (select *, coalesce(sum(n) over (order by s rows between unbounded preceding and 1 preceding), 0) b from c) select round(sum(p * (b + n / 2.0)) / (sum(p) * sum(n)), 6)::DOUBLE auc from r""")
def _(t):
    d = t.events.select((F.col("event_type") == "error").cast("int").alias("y"), (k_of(t.events) + F.col("value") / 10).alias("s"))
    return r6(ml.auc(d, "y", "s"), "auc")


@query("ml10_retrain_triggers", "ML10", """
with r as (select user_id % 10 model, row_number() over w n, sum((value < 45)::INTEGER) over w ok from events window w as (partition by user_id % 10 order by ts, event_id))
select model, n labelled, round(ok / n::DOUBLE, 6) accuracy, case when ok / n::DOUBLE < 0.6 then 'HIGH' else 'MEDIUM' end priority from r where n % 100 = 0 and ok / n::DOUBLE < 0.8""")
def _(t):
    e = t.events.withColumn("model", F.col("user_id") % 10)
    return r6(ml.retrain_triggers(e, "model", "ts", "event_id", F.col("value") < 45, 100, 0.8, 0.6), "accuracy")


@query("ml10_simulation_triggers", "ML10", f"""
with recursive a as (select user_id % 10 g, event_id, epoch_us(ts) us, row_number() over (partition by user_id % 10 order by ts, event_id) step, value / 100 c, {SQL_K} / 100.0 s from events),
 b as (select * from a where step >= 50 and (c < 0.05 or s < 0.05 or step % 100 = 0)), f as (select g, min(us) us from b group by 1 union all select f.g, (select min(us) from b where b.g = f.g and b.us >= f.us + 3600000000) from f where f.us is not null)
select b.event_id, step from f join b on b.g = f.g and b.us = f.us""")
def _(t):
    e = t.events.select((F.col("user_id") % 10).alias("g"), "event_id", "ts", (F.col("value") / 100 + 0.25).alias("c"), (k_of(t.events) / 100.0 + 0.45).alias("s"))
    return ml.simulation_triggers(e, "g", "ts", "event_id", "c", "s", 50, 3600, 100).select("event_id", "step")


@query("ml11_resource_anomalies", "ML11")
def _(t):
    m = ml.fit_classifier(labelled(t), ["v", "k", "h"], "label", trees=8)
    return ml.with_confidence(m.transform(labelled(t))).groupBy("prediction").agg(n_rows().alias("n"), F.round(F.avg("confidence"), 3).alias("confidence"))


@query("ts23_load_forecast", "TS23")
def _(t):
    return ml.load_forecast(hourly(t), "market", "ts", "volume").select("market", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.round("forecast", 3).alias("forecast"))
