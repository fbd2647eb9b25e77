"""Lexical, vector and hybrid search over document frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import flagged, ladder
from marlstone.functions.vectors import cosine
from marlstone.operators.windows import ranked_top
from marlstone.session import cut_lineage, ship_package

#: Vectors per block; a block of 64 doubles each is 2 MB. Queries compared in one product.
BLOCK, SLICE = 4096, 64
#: Slack of matrix products for rounding.
SLACK = 1e-9


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text if isinstance(text, Column) else F.col(text)), F.lit("[a-z0-9]+"), 0)


# -- vectors ------------------------------------------------------------------------------------------------

def _vectors(table: pa.Table, name: str) -> np.ndarray:
    rows = table[name].combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(rows), -1)


def _block_search(d: DataFrame, q: DataFrame, k: int, rough, exact, exclude_self: bool) -> DataFrame:
    """The best ``k`` documents of every query in every pair of a block of ``d(id, vec, ...)`` and one of ``q(query, vec, ...)``.

    A pair of blocks is one group, so a task holds two blocks, whatever the tables; a shuffle carries a row once per block of
    the other side, and ``k`` rows per query and pair. ``rough(queries, documents, slice)`` gives the similarities of a slice of queries as a matrix,
    not finite where a pair does not count; ``exact(queries, documents, r, c)`` those of single pairs, the same in every block.
    """
    ship_package(d.sparkSession)
    n_docs, n_queries = (max(1, -(-x.count() // BLOCK)) for x in (d, q))
    id_type, q_type = d.schema["id"].dataType.simpleString(), q.schema["query"].dataType.simpleString()
    dealt = lambda key, n: F.pmod(F.xxhash64(key, "vec"), F.lit(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = d.withColumn("part", dealt("id", n_docs)).withColumn("block", others(n_queries))
    # other names on the right: a cogroup of a frame with itself loses the columns that both sides share
    right = q.withColumn("block", dealt("query", n_queries)).withColumn("part", others(n_docs)).withColumnsRenamed({"vec": "qvec", "h": "qh"})

    def search(docs, queries):
        found = []
        if docs.num_rows and queries.num_rows:
            docs = docs.take(pc.sort_indices(docs["id"].combine_chunks(), null_placement="at_start"))  # ties by id
            x, y = prepared(docs, "vec", "h"), prepared(queries, "qvec", "qh")
            ids, names = named(docs["id"]), named(queries["query"])
            keep = min(k, docs.num_rows)
            for start in range(0, queries.num_rows, SLICE):
                part = slice(start, start + SLICE)
                s = rough(y, x, part)
                s[~np.isfinite(s)] = -np.inf
                if exclude_self:
                    s[names[part][:, None] == ids[None, :]] = -np.inf
                least = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
                r, c = np.nonzero((s >= least[:, None] - SLACK) & np.isfinite(s))
                sims = np.concatenate([exact(y, x, start + r[i:i + BLOCK], c[i:i + BLOCK]) for i in range(0, len(r), BLOCK)] or [np.zeros(0)])
                order = np.lexsort((c, -sims, r))
                r, c, sims = r[order], c[order], sims[order]
                top = (np.arange(len(r)) - np.searchsorted(r, r) < keep) & np.isfinite(sims)
                found.append((start + r[top], c[top], sims[top]))
        r, c, sims = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=int),) * 2 + (np.zeros(0),)
        return pa.table({"query": queries["query"].take(pa.array(r)), "id": docs["id"].take(pa.array(c)), "similarity": sims})

    def named(keys):
        return np.array(keys.to_pylist(), dtype=object) if keys.null_count else keys.to_numpy()

    def prepared(table, vec, hashes):
        v = _vectors(table, vec)
        return v, np.linalg.norm(v, axis=1), _vectors(table, hashes) if hashes in table.column_names else None

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(search, f"query {q_type}, id {id_type}, similarity double")
    return ranked_top(found, ["query"], [F.col("similarity").desc(), F.col("id")], k)


def knn(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "id", doc_vec: str = "vec", query_id: str = "id",
        query_vec: str = "vec", where: Column | None = None, exclude_self: bool = False) -> DataFrame:
    """Exact nearest neighbours by cosine for a batch of queries: (query, id, similarity, rank).

    Blocks of 4096 documents and queries meet in pairs and keep ``k`` rows per query.
    """
    d = docs.filter(where) if where is not None else docs
    vec = lambda c: F.col(c).cast("array<double>")
    d = d.select(F.col(doc_id).alias("id"), vec(doc_vec).alias("vec")).filter(F.col("vec").isNotNull())
    q = queries.select(F.col(query_id).alias("query"), vec(query_vec).alias("vec")).filter(F.col("vec").isNotNull())

    def rough(y, x, part):
        with np.errstate(divide="ignore", invalid="ignore"):
            return (y[0][part] @ x[0].T) / np.outer(y[1][part], x[1])

    exact = lambda y, x, r, c: (y[0][r] * x[0][c]).sum(axis=1) / (y[1][r] * x[1][c])
    return _block_search(d, q, k, rough, exact, exclude_self)


def approximate_knn(docs: DataFrame, queries: DataFrame, k: int, doc_id: str, vec: str, bucket: float = 0.4, tables: int = 12, reach: float = 1.3,
                    seed: int = 42) -> DataFrame:
    """Random-projection hashing of unit vectors; candidates share a bucket, ranked by true distance.

    Where vectors are spread evenly nearly all pairs share a bucket, so buckets are compared inside pairs of blocks and no row is
    made per candidate.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array
    unit = Normalizer(inputCol="raw", outputCol="unit")
    prep = lambda d, name: unit.transform(d.filter(F.col(vec).isNotNull()).select(F.col(doc_id).alias(name), array_to_vector(F.col(vec).cast("array<double>")).alias("raw"))).select(name, "unit")
    a, b = prep(docs, "id"), prep(queries, "query")
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(a)
    hashes = F.array(*[vector_to_array(F.col("h")[i])[0] for i in range(tables)])
    hashed = lambda d, name: model.transform(d.filter(F.col(name).isNotNull())).select(name, vector_to_array("unit").alias("vec"), hashes.alias("h")).distinct()

    def rough(y, x, part):
        s = 1 - (np.square(y[1][part])[:, None] + np.square(x[1]) - 2 * y[0][part] @ x[0].T) / 2
        met = np.zeros(s.shape, dtype=bool)
        for t in range(tables):
            met |= y[2][part, t][:, None] == x[2][:, t]
        s[~met] = -np.inf
        return s

    def exact(y, x, r, c):
        distance = np.sqrt(np.square(y[0][r] - x[0][c]).sum(axis=1))
        return np.where(distance < reach, 1 - distance * distance / 2, -np.inf)

    return _block_search(hashed(a, "id"), hashed(b, "query"), k, rough, exact, True)


# -- text ---------------------------------------------------------------------------------------------------

def bm25(docs: DataFrame, ident: str, fields: dict[str, float], terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): BM25 summed over the fields with their boosts. Documents without a term do not appear."""
    wanted = F.array(*[F.lit(x.lower()) for x in sorted(set(terms))])
    total = None
    for name, boost in fields.items():
        base = docs.select(F.col(ident).alias("id"), tokens(name).alias("_t"))
        found = F.filter("_t", lambda x: F.array_contains(wanted, x))
        # the texts are read once: what is kept is one row per document and query term (or none)
        hits = cut_lineage(base.select("id", F.size("_t").alias("len"), F.explode_outer(found).alias("term"))
                           .groupBy("id", "len", "term").agg(F.count("term").alias("tf")))
        per_doc = hits.groupBy("id").agg(F.max("len").alias("len"))
        s = per_doc.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("len")).select(F.struct("n", "len")).scalar()
        hits = hits.filter("term is not null")
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = F.log(1 + (s["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / s["len"]))
        one = hits.join(df, "term").select("id", (boost * idf * tf).alias("part"))
        total = one if total is None else total.unionByName(one)
    return total.groupBy("id").agg(F.sum("part").alias("score"))


def fuzzy_terms(docs: DataFrame, field: str, terms: list[str]) -> DataFrame:
    """Vocabulary terms within the edit distance a query term allows: 0 below 3 letters, 1 up to 5, else 2."""
    vocab = docs.select(F.explode(tokens(field)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    pairs = vocab.select("term", "n", F.explode(F.array(*[F.lit(x) for x in terms])).alias("query"))
    allowed = ladder([(F.length("query") < 3, 0), (F.length("query") <= 5, 1)], 2)
    near = F.abs(F.length("term") - F.length("query")) <= allowed
    return pairs.filter(near).withColumn("edits", F.levenshtein("term", "query")).filter(F.col("edits") <= allowed)


def fuse(text: DataFrame, vector: DataFrame, text_weight: float = 0.5, vector_weight: float = 0.5, both_boost: float = 1.2) -> DataFrame:
    """Weighted sum of two (id, score) lists with weights that sum to 1; x 1.2 for hits in both."""
    total = text_weight + vector_weight
    j = text.select("id", F.col("score").alias("t")).join(vector.select("id", F.col("score").alias("v")), "id", "full_outer")
    s = F.coalesce("t", F.lit(0.0)) * (text_weight / total) + F.coalesce("v", F.lit(0.0)) * (vector_weight / total)
    both = (F.coalesce("t", F.lit(0.0)) > 0) & (F.coalesce("v", F.lit(0.0)) > 0)
    return j.select("id", (s * F.when(both, both_boost).otherwise(1.0)).alias("score"), both.alias("in_both"))


def rerank(hits: DataFrame, source: str, name: Column, query: str, leading: int = 3) -> DataFrame:
    """Name matches x 1.5; then the best hit of each source in front when there are at least three sources."""
    boosted = hits.withColumn("score", F.col("score") * F.when(F.lower(name).contains(query.lower()), 1.5).otherwise(1.0))
    first = ranked_top(boosted.select(source, "id", "score"), [source], [F.col("score").desc(), F.col("id")], 1).select("id", F.lit(True).alias("_first"))
    sources = boosted.agg(F.countDistinct(source)).scalar()
    lead = F.coalesce("_first", F.lit(False)) & (sources >= leading)
    return boosted.join(first, "id", "left").withColumn("leads", lead).drop("_first")


def merge_fields(hits: DataFrame, k: int) -> DataFrame:
    """Best score per id over several searched fields."""
    return hits.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def facets(docs: DataFrame, columns: list[str], size: int = 10) -> DataFrame:
    from marlstone.operators.aggregates import grouped_counts
    return ranked_top(grouped_counts(docs, columns), ["dimension"], [F.col("n").desc(), F.col("value")], size)


def graph_boost(hits: DataFrame, context: DataFrame) -> DataFrame:
    """score x (1 + min(.1 links, 2) + min(.05 collaborators, .5) + min(.02 ancestors, .2))."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    factor = 1 + F.least(z("links") * 0.1, F.lit(2.0)) + F.least(z("collaborators") * 0.05, F.lit(0.5)) + F.least(z("ancestors") * 0.02, F.lit(0.2))
    return hits.join(context, "id", "left").select("id", (F.col("score") * factor).alias("score"))


def chunks(docs: DataFrame, ident: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, chunk, content) windows of characters over the whole text, each sharing ``overlap`` with the one before."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))
    return docs.select(F.col(ident).alias("id"), F.posexplode(parts).alias("chunk", "content")).filter(F.length("content") > 0)


def assemble_context(ranked: DataFrame, query: str, title: str, page: str, content: str, k: int = 5) -> DataFrame:
    """Numbered sources joined to one text per query, and the confidence round(min(mean of the best three / 2, 1), 2)."""
    top = ranked.filter(F.col("rank") <= k)
    line = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.col(title).cast("string"), F.lit(", Page "), F.col(page).cast("string"), F.lit("]\n"), F.col(content), F.lit("\n"))
    g = top.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("ls"), F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("m"))
    return g.select(query, F.array_join(F.transform("ls", lambda x: x["line"]), "\n---\n").alias("context"), F.round(F.least(F.col("m") / 2, F.lit(1.0)), 2).alias("confidence"))


#: Words that decide the intent of a query, in order of precedence.
INTENTS = (("how_to", ("how", "tutorial", "guide")), ("troubleshoot", ("error", "fail", "fix")), ("compare", ("versus", "compare", "difference")), ("find", ("find", "search", "show")))


def understand(queries: DataFrame, text: str) -> DataFrame:
    """Entities and intent of query texts: file types, last-N-days, users, tags, quoted phrases."""
    c = F.col(text)
    words = tokens(text)
    return queries.withColumns({
        "file_types": F.array_join(F.regexp_extract_all(c, F.lit(r"\.(pdf|docx|csv|json|xlsx|png|py)\b"), 1), ","),
        "last_days": F.regexp_extract(F.lower(c), r"last (\d+) days?", 1).try_cast("int"),
        "users": F.array_join(F.regexp_extract_all(c, F.lit(r"@(\w+)"), 1), ","), "tags": F.array_join(F.regexp_extract_all(c, F.lit(r"#(\w+)"), 1), ","),
        "phrases": F.array_join(F.regexp_extract_all(c, F.lit('"([^"]+)"'), 1), ","),
        "intent": ladder([(F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws])), n) for n, ws in INTENTS], "general")})


def expand_synonyms(queries: DataFrame, ident: str, text: str, synonyms: DataFrame) -> DataFrame:
    """(id, term) of the query's words and of their synonyms (term, synonym)."""
    w = queries.select(F.col(ident).alias("id"), F.explode(tokens(text)).alias("term")).distinct()
    return w.unionByName(w.join(synonyms, "term").select("id", F.col("synonym").alias("term"))).distinct()


def trending(events: DataFrame, topic: str, ts: str, now: Column, hours: int = 24, k: int = 10) -> DataFrame:
    """Topics by growth of their count against the window before: (recent + 1) / (previous + 1)."""
    span = lambda n: now - F.make_interval(hours=F.lit(n))
    recent, before = F.col(ts) > span(hours), (F.col(ts) > span(2 * hours)) & (F.col(ts) <= span(hours))
    g = events.filter(F.col(ts) > span(2 * hours)).groupBy(topic).agg(F.count_if(recent).alias("recent"), F.count_if(before).alias("previous"))
    return g.withColumn("growth", (F.col("recent") + 1) / (F.col("previous") + 1)).orderBy(F.col("growth").desc(), F.col("recent").desc(), topic).limit(k)
