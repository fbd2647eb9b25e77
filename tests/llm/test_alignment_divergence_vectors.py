"""Tokenizer alignment, source divergence and near vectors against brute force, and on null, empty, long, repeated and clashing rows."""

import random
import re
from collections import Counter
from hashlib import sha256
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marlstone.llm import crosstoken, divergence, linededup, queries, substrings, vecgraph

PATH = "/root/testdata/sf0.001"
VOCABULARIES = crosstoken.read_vocabularies(public_tokenizers.path(queries.BYTE_BPE), public_tokenizers.path(queries.PIECES))


# -- alignment of tokenizers --------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def aligner():
    return crosstoken.Aligner(VOCABULARIES)


def whole_text(aligner, text):
    """Groups and links of a text encoded at once, by byte sets."""
    if not text:
        return [], []
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    pa, pb = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
    if not b"".join(pa) == b"".join(pb) == (" " + text).encode():
        return [], []
    ea, eb = [0, *accumulate(map(len, pa))], [0, *accumulate(map(len, pb))]
    groups, links = [], []
    for x, y in zip(*(lambda c: (c, c[1:]))(sorted(set(ea) & set(eb)))):
        groups.append((a[ea.index(x):ea.index(y)], b[eb.index(x):eb.index(y)]))
    j = 0
    for i in range(len(a)):
        while eb[j + 1] <= ea[i]:
            j += 1
        k = j
        while k < len(b) and eb[k] < ea[i + 1]:
            links.append((a[i], b[k]))
            k += 1
    return groups, links


def written_groups(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_chunks_equal_whole_texts(aligner):
    rnd = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "1", "2024", "'s", "don't", "▁", "\x00", "<s>", "<|endoftext|>", "word", "\x1c", "　", ".", "!?", "ﬁ", "é", "\U0001f600", "½5", "x²"]
    assert aligner.in_chunks
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 20)))
        groups, links = whole_text(aligner, text)
        got = aligner.text(text)
        if not groups:
            assert got is None
            continue
        assert got[3] == written_groups(groups) and got[2] == len(groups) and got[0] == sum(len(g[0]) for g in groups) and got[1] == sum(len(g[1]) for g in groups)
        assert Counter(np.frombuffer(got[4], np.int64).tolist()) == Counter(a * VOCABULARIES.b_size + b for a, b in links)


def expected_alignment(aligner, texts):
    found = [whole_text(aligner, t) for t in texts]
    counts = Counter(p for _, links in found for p in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    return [(sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
             sha256(written_groups(groups).encode()).hexdigest() if groups else "") for groups, links in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent", [3, 1 << 17])
def test_alignment_rows(spark, aligner, frequent):
    long = " ".join(f"w{i % 977} of{i % 13}" for i in range(4000)) + "x" * 3000
    texts = ["the cat sat", "the cat sat", "the dog, the cat", None, "", " ", "a▁b", long, "<|endoftext|> is text", "the  cat\n"]
    df = spark.createDataFrame([(None if i == 1 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for c in ["n_a", "groups", "pairs", "times", "row", "N_BEST", "_row", "pair", "best"]:
        df = df.withColumn(c, F.lit("x"))
    out = crosstoken.link_statistics(df, VOCABULARIES, frequent=frequent)
    got = sorted(tuple(r) for r in out.select("doc_id", *COLUMNS).fillna(-1, ["doc_id"]).collect())
    assert got == sorted((-1 if i == 1 else i // 2, *e) for i, e in enumerate(expected_alignment(aligner, texts)))
    assert {"_n_a", "_groups", "_pairs", "_times", "_N_BEST", "row", "_row", "pair", "best"} <= set(out.columns)
    assert crosstoken.link_statistics(df.select("doc_id", "text").limit(0), VOCABULARIES).count() == 0


def test_alignment_query(spark, aligner):
    rows = spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r["doc_id"], *e) for r, e in zip(rows, expected_alignment(aligner, [r["text"] for r in rows])))
    assert sorted(tuple(r) for r in queries.op11_cross_tokenizer_alignment(spark, PATH).select("doc_id", *COLUMNS).collect()) == want


# -- divergence of sources ----------------------------------------------------------------------------------------

TERM, LOWER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [m.translate(LOWER) for m in TERM.findall(text or "")]


def test_term_counts_against_brute_force():
    rnd = random.Random(1)
    letters = ["a", "b", "Z", "é", "日", " ", "1", "\n", "_"]
    for _ in range(150):
        texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 60))) + ("x" * rnd.randrange(0, 50) if rnd.random() < 0.3 else "") for _ in range(rnd.randrange(1, 8))]
        groups = [(rnd.choice("ab"), rnd.choice("st")) for _ in texts]
        want = {}
        for i, (g, t) in enumerate(zip(groups, texts)):
            for m in terms_of(t):
                want.setdefault((*g, m.encode()), []).append(i)
        counter = divergence.Counter(rnd.choice([1, 5, 1000]), rnd.choice([20, 1000]), rnd.choice([3, 10, 100]))
        got = {}
        half = rnd.randrange(0, len(texts) + 1)

        def take(rows):
            for lang, source, term, n, docs in rows:
                a = got.setdefault((lang, source, term), [0, 0])
                a[0], a[1] = a[0] + n, a[1] + docs

        for part in (slice(0, half), slice(half, None)):
            data = [t.encode() for t in texts[part]]
            if data:
                codes = np.array([counter.groups.setdefault(g, len(counter.groups)) for g in groups[part]])
                for rows in counter.add(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), codes):
                    take(rows)
        take(counter.rows())
        assert got == {k: [len(v), len(set(v))] for k, v in want.items()}


def expected_divergence(rows, min_docs, top):
    docs, counts, groups = {}, {}, {}
    for i, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        for m in terms_of(text):
            docs.setdefault((lang, m), set()).add(i)
            counts.setdefault((lang, source), Counter())[m] += 1
    out = set()
    for lang, sources in groups.items():
        kept = [m for (x, m), d in docs.items() if x == lang and len(d) >= min_docs]

        def shares(c):
            total = sum(c[m] for m in kept)
            return {m: 1 + 1_000_000_000 * (c[m] + 2) // (total + 2 * len(kept)) for m in kept}

        p = {s: shares(counts.get((lang, s), Counter())) for s in sources}
        q = shares(sum((counts.get((lang, s), Counter()) for s in sources), Counter()))
        for s in sources:
            f = lambda x, y: (x - y) ** 2 // (x + y)
            pairs = [(o, sum(f(p[s][m], p[o][m]) for m in kept)) for o in sources if o != s]
            terms = [(m, f(p[s][m], q[m])) for m in kept if counts.get((lang, s), Counter())[m] and p[s][m] > q[m]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(items) if part == "pair" or i < top}
    return out


@pytest.mark.parametrize("tile, cells", [(256, 1 << 20), (2, 8)])
def test_divergence_rows(spark, tile, cells):
    rnd = random.Random(3)
    words = [f"w{chr(97 + i)}" for i in range(12)] + ["Ünïcode", "q" * 9, "z" * 40, "日本"]
    rows = [(rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", "s4", "s5", None]), " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 12)))) for _ in range(120)]
    rows += [("fr", "lonely", "once"), ("fr", "other", None), ("en", "silent", None), ("en", "s1", ""), ("en", "s1", "long " * 2000)] + rows[:3] * 2
    df = spark.createDataFrame([(None, *r) for r in rows], "doc_id long, lang string, source string, text string")
    for c in ["term", "n", "docs", "place", "sources", "total", "value", "_lang", "item"]:
        df = df.withColumn(c, F.lit("x"))
    got = [tuple(r) for r in divergence.audit(df, min_docs=4, top=3, tile=tile, cells=cells).collect()]
    assert len(got) == len(set(got)) and set(got) == expected_divergence(rows, 4, 3)
    assert divergence.audit(df.limit(0)).count() == 0


# -- near vectors -------------------------------------------------------------------------------------------------

def test_shard_graph_finds_all_links():
    rnd = np.random.default_rng(0)
    for n, clump in ((2, 2), (30, 5), (700, 150)):
        x = rnd.normal(size=(n, 32))
        x[:clump] = rnd.normal(size=(1, 32)) + 0.08 * rnd.normal(size=(clump, 32))
        x = x[rnd.permutation(n)]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        met = vecgraph.linked(x, vecgraph.build(x.astype(np.float32), vecgraph.Config()), vecgraph.Config())
        true = x @ x.T >= 0.93
        np.fill_diagonal(true, False)
        assert (met == true).all()
        if n > 30:
            near = vecgraph.build(x.astype(np.float32), vecgraph.Config())
            assert (near >= 0).sum(axis=1).mean() < 48  # a graph, not all pairs


@pytest.mark.parametrize("config", [vecgraph.Config(), vecgraph.Config(shard_rows=64, fanout=8, beam=32), vecgraph.Config(shard_rows=100, fanout=8, beam=32, levels=1)])
def test_vectors_against_brute_force(spark, config):
    rnd = np.random.default_rng(1)
    n, d = 500, 16
    x = rnd.normal(size=(n, d))
    x[:80] = rnd.normal(size=(1, d)) + 0.1 * rnd.normal(size=(80, d))
    x[100:150] = x[300:350] + 0.08 * rnd.normal(size=(50, d))
    x[160:170], x[171], x[172] = x[180], 2 * x[180], -x[180]
    same = x[180].tolist()
    rows = [(i, x[i].tolist(), 0 if i < 250 else int(i % 3 == 0)) for i in range(n)]
    rows += [(5000, None, 0), (5001, [], 0), (5002, [0.0] * d, 0), (5003, [float("nan")] * d, 0), (5004, [float("inf")] + [1.0] * (d - 1), 0), (5005, [None] + [1.0] * (d - 1), 0),
             (5006, same, None), (5007, same[:-1], 0), (None, same, 0), (180, same, 0), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ["id", "key", "node", "vec", "n_links", "kept", "leaf"]})
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) and label is not None for _, v, label in rows]
    links = [[] for _ in rows]
    for kind in {(label, len(v)) for (_, v, label), good in zip(rows, ok) if good}:
        ids = [i for i, good in enumerate(ok) if good and (rows[i][2], len(rows[i][1])) == kind]
        u = np.array([np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in ids])
        for a, near in zip(ids, u @ u.T >= 0.93):
            links[a] = [ids[b] for b in np.flatnonzero(near) if ids[b] != a]
    least = [None] * len(rows)
    for i in range(len(rows)):
        inside, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in inside:
                    inside.add(j)
                    todo.append(j)
        least[i] = min((rows[j][0] for j in inside if rows[j][0] is not None), default=None)
    out = vecgraph.near_duplicates(df, config=config).collect()
    order = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(order(r[:4]) for r in out) == sorted(order((i, len(l), c, i == c)) for (i, _, _), l, c in zip(rows, links, least))
    assert out[0]["recall"] >= 0.999


def test_no_vectors(spark):
    assert vecgraph.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# -- rows that share an id ----------------------------------------------------------------------------------------

def test_rows_that_share_an_id_keep_unique_text(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "a\nb\nc\nz"), (2, "p\nq\nr\ns\nt"), (2, "a\nb\nc\nz")], "doc_id long, text string")
    for c in ("n_lines", "n_removed"):
        df = df.withColumn(c, F.lit("mine"))
    out = linededup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "_n_lines", "_n_removed", "n_lines", "n_removed"]
    assert sorted((r["doc_id"], r["text"], r["n_removed"], r["_n_lines"]) for r in out.collect()) == [(1, "a\nb\nc\nd", 0, "mine"), (2, "p\nq\nr\ns\nt", 0, "mine"), (2, "z", 3, "mine"), (2, "z", 3, "mine")]


@pytest.mark.parametrize("group", [1, 1000])
def test_substrings_of_rows_that_share_an_id(spark, group):
    a, q = " ".join(f"a{i}" for i in range(25)), " ".join(f"q{i}" for i in range(30))
    for kind, ids in (("long", (1, 2)), ("string", ("x", "y"))):
        df = spark.createDataFrame([(ids[0], a), (ids[1], a), (ids[1], q), (ids[1], a), (None, q)], f"doc_id {kind}, text string").withColumn("kept", F.lit("mine"))
        out = substrings.dedup_substrings(df, group=group)
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"], r["_kept"]) for r in out.collect()) == sorted(
            [(str(ids[0]), 25, 0, a, "mine"), (str(ids[1]), 25, 25, "", "mine"), (str(ids[1]), 30, 0, q, "mine"), (str(ids[1]), 25, 25, "", "mine"), ("None", 30, 0, q, "mine")])
