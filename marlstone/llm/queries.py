"""Registered queries of the training-data operators, each over its whole table, and the SQL that checks them where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, crosstoken, ctph, decontaminate, divergence, langid, licenses, linededup, simhash, substrings, toxicity, vecgraph, warc
from marlstone.llm.batches import fold
from marlstone.session import Tables

#: The vocabulary and the pattern that splits texts, of the public tokenizer files.
RANKS = "byte_bpe_50k.tiktoken"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def sha256(text):
    return F.sha2(text.cast("binary"), 256)


def op1_benchmark_decontamination(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    found = decontaminate.scan(t.documents.select("doc_id", "text"), t.benchmark)
    return found.select("doc_id", "n_words", decontaminate.n_hit("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        sha256(F.array_join("items", ",")).alias("items_sha256"), decontaminate.contaminated("n_words", "spans").alias("contaminated"))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1_SQL = rf"""
with d as (select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as k
       from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as s from i where len(w) > 0)),
dw as (select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') as k
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from iw) where len(w) >= n)),
hits as (select distinct doc_id, s, n, item_id from dw join iw using (n, k)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct doc_id, cast(item_id as varchar) as item from hits where item_id is not null) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (doc_id) left join found using (doc_id)"""


def op2_line_dedup(spark: SparkSession, path: str) -> DataFrame:
    out = linededup.dedup_lines(Tables(spark, path).documents.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


OP2_SQL = r"""
with l as (select doc_id, string_split(text, chr(10)) as w from documents),
v as (select doc_id, s, array_to_string(w[s:s + 2], chr(10)) as k from (select doc_id, w, unnest(range(1, len(w) - 1)) as s from l where len(w) >= 3)),
first as (select k, min({'d': doc_id, 's': s}) as f from v group by k having count(*) > 1),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(s, s + 3)) as p from v join first using (k) where {'d': doc_id, 's': s} > f)),
lines as (select doc_id, unnest(w) as line, unnest(range(1, len(w) + 1)) as p from l),
kept as (select doc_id, count(*) as n, string_agg(line, chr(10) order by p) as t from lines anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(coalesce(len(w), 0) as bigint) as n_lines, cast(coalesce(len(w), 0) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from l left join kept using (doc_id)"""


def op3_license_scan(spark: SparkSession, path: str) -> DataFrame:
    found = licenses.scan(Tables(spark, path).documents.select("doc_id", "text"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.get("licenses", F.lit(0))["license"].alias("license"),
                        F.get("licenses", F.lit(0))["dice"].alias("dice"), F.array_join("licenses.license", ",").alias("all_licenses"))


def op4_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    out = substrings.dedup_substrings(Tables(spark, path).documents.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", sha256(F.coalesce("kept", F.lit(""))).alias("kept_sha256"))


OP4_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
v as (select doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from d where len(w) >= 20)),
first as (select k, min({'d': doc_id, 's': s}) as f from v group by k having count(*) > 1),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(s, s + 20)) as p from v join first using (k) where {'d': doc_id, 's': s} > f)),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)"""


def op5_language_id(spark: SparkSession, path: str) -> DataFrame:
    docs = Tables(spark, path).documents.select("doc_id", "text", "lang")
    model = langid.fit(langid.training_rows(docs))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op6_document_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    out = ctph.compare_neighbours(Tables(spark, path).documents.select("doc_id", "text"))
    return out.select("doc_id", "n_chars", sha256(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def captures(pages: DataFrame) -> DataFrame:
    """Captures made from the pages: each as a full response and, later, as a revisit by another form of its address, whose entity
    tag is that page's for two in three; a page without HTML has no entity tag."""
    host = F.regexp_replace("url", "^(https?)://(www\\.)?", "$1://www.")
    tag, stamp = F.md5(F.col("html").cast("binary")), F.concat(F.lit("day "), F.col("page_id").cast("string"))
    full = pages.select((2 * F.col("page_id")).alias("id"), "url", (10 * F.col("page_id")).alias("time"), F.lit(200).alias("status"),
                        F.map_filter(F.create_map(F.lit("ETag"), tag, F.lit("Date"), stamp, F.lit("Content-Type"), F.lit("text/html")), lambda k, v: v.isNotNull()).alias("headers"))
    stale = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("old-"), tag)).when(F.col("page_id") % 3 == 2, F.concat(F.lit("W/"), tag)).otherwise(tag)
    later = F.concat(F.lit("day "), F.col("page_id").cast("string"), F.lit(" later"))
    again = pages.select((2 * F.col("page_id") + 1).alias("id"), host.alias("url"), (10 * F.col("page_id") + 7).alias("time"), F.lit(304).alias("status"),
                         F.map_filter(F.create_map(F.lit("etag"), stale, F.lit("DATE"), later, F.lit("content-type"), F.lit("none"), F.lit("Expires"), F.lit("soon")),
                                      lambda k, v: v.isNotNull()).alias("headers"))
    return full.unionByName(again)


def op7_revisit_resolution(spark: SparkSession, path: str) -> DataFrame:
    done = warc.resolve(captures(Tables(spark, path).pages))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return done.select("id", "canonical", "time", "status", "outcome", "response_id", F.array_join(lines, ";").alias("headers"))


OP7_SQL = r"""
with c as (
  select 2 * page_id as id, url, 10 * page_id as time, 200 as status, md5(html) as etag, 'day ' || page_id as date from pages
  union all
  select 2 * page_id + 1, regexp_replace(url, '^(https?)://(www\.)?', '\1://www.'), 10 * page_id + 7, 304,
         case page_id % 3 when 1 then 'old-' when 2 then 'W/' else '' end || md5(html), 'day ' || page_id || ' later' from pages),
p as (select *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from c),
q as (select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') as host,
             regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as way, string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&') as params from p),
r as (select *, list_sort(list_filter(params, lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|gclid|dclid|fbclid|msclkid|mc_cid|mc_eid)(=|$)'))) as kept from q),
s as (select *, host || way || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as canonical from r),
a as (select *, last_value(case when status = 200 then {'id': id, 'etag': etag} end ignore nulls)
                over (partition by canonical order by time, id rows between unbounded preceding and 1 preceding) as base from s),
o as (select *, case when status = 200 then 'response' when base is null then 'no_response' when base.etag = regexp_replace(etag, '^W/', '') then 'resolved' else 'changed' end as outcome from a)
select id, canonical, time, status, outcome, case when status = 200 then id when outcome = 'resolved' then base.id end as response_id,
       case when status = 200 then concat_ws(';', 'Content-Type=text/html', 'Date=' || date, 'ETag=' || etag)
            when outcome = 'resolved' then concat_ws(';', 'Content-Type=text/html', 'DATE=' || date, 'Expires=soon', 'etag=' || etag)
            else concat_ws(';', 'DATE=' || date, 'Expires=soon', 'content-type=none', 'etag=' || etag) end as headers
from o"""


def op8_toxicity(spark: SparkSession, path: str) -> DataFrame:
    t = Tables(spark, path)
    docs = t.documents.select("doc_id", "text")
    model = toxicity.fit(docs, t.labels.filter(fold(F.col("doc_id"), 3) != 1))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_byte_bpe(spark: SparkSession, path: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    coded = bpe.decode(bpe.encode(Tables(spark, path).documents.select("doc_id", "text"), ranks, public_tokenizers.PATTERN).select("doc_id", "ids"), ranks)
    return token_digests(coded)


def token_digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
                        sha256(F.col("decoded")).alias("decoded_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, path: str) -> DataFrame:
    return simhash.near_duplicates(Tables(spark, path).documents.select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op11_cross_tokenizer_alignment(spark: SparkSession, path: str) -> DataFrame:
    vocabularies = crosstoken.read_vocabularies(public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))
    found = crosstoken.link_statistics(Tables(spark, path).documents.select("doc_id", "text"), vocabularies)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_source_divergence(spark: SparkSession, path: str) -> DataFrame:
    return divergence.audit(Tables(spark, path).documents.select("lang", "source", "text"))


OP12_SQL = rf"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
o as (select id, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as n from o group by lang, term having count(distinct id) >= 10),
l as (select lang, count(*) as v, sum(n) as total from k group by lang),
c as (select lang, source, term, count(*) as n from o semi join k using (lang, term) group by lang, source, term),
g as (select lang, source, coalesce(v, 0)::hugeint as v, coalesce(l.total, 0)::hugeint as lang_total, coalesce(t.total, 0)::hugeint as total
      from (select distinct lang, source from d) left join l using (lang) left join (select lang, source, sum(n) as total from c group by lang, source) t using (lang, source)),
s as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.total + 2 * v) as p, 1 + 1000000000::hugeint * (k.n + 2) // (lang_total + 2 * v) as q
      from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, coalesce(f, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
          left join (select x.lang as l1, x.source as s1, y.source as s2, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as f
                     from s x join s y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) on l1 = a.lang and s1 = a.source and s2 = b.source),
terms as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from s where n > 0 and p > q),
r as (select 'pair' as part, *, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
      union all
      select 'term', *, row_number() over (partition by lang, source order by value desc, item) from terms)
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 10"""


def op13_embedding_near_dedup(spark: SparkSession, path: str) -> DataFrame:
    found = vecgraph.near_duplicates(Tables(spark, path).embeddings)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


OP13_SQL = r"""
with recursive e as (select vec_id, label, embedding::double[] as v from embeddings),
u as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as n from e
      where label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(v, v) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
      where list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
reach as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a),
c as (select a, min(b) as least from reach group by a),
d as (select a, count(*) as n from l group by a),
r as (select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(least, vec_id)) as component_id from e left join c on c.a = vec_id left join d on d.a = vec_id)
select vec_id, n_links, component_id, vec_id = component_id as kept from r"""


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_line_dedup, op3_license_scan, op4_substring_dedup, op5_language_id,
                                   op6_document_fingerprints, op7_revisit_resolution, op8_toxicity, op9_byte_bpe, op10_simhash_near_dedup,
                                   op11_cross_tokenizer_alignment, op12_source_divergence, op13_embedding_near_dedup)}
SQL = {"op1_benchmark_decontamination": OP1_SQL, "op2_line_dedup": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op7_revisit_resolution": OP7_SQL,
       "op12_source_divergence": OP12_SQL, "op13_embedding_near_dedup": OP13_SQL}
