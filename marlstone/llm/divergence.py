"""Source divergence audit: how far the word use of the sources of a language lies apart, in exact integer arithmetic.

Terms are counted in numpy by length-bucketed packing. Terms of up to 8 bytes become one 64-bit word and terms of up to 16 bytes two;
they are radix-sorted digit by digit and counted in runs. Longer terms go to buckets of one length each, sorted by bytes. A task
counts at most ``FLUSH_TERMS`` occurrences at once and passes (language, source, term, occurrences, documents) on; Spark adds these
up before and after one shuffle.

A language keeps the terms of at least ``min_docs`` of its documents, V in all. A group (language, source) or a whole language with N
occurrences of kept terms gives each of them ``p = 1 + floor(SCALE * (count + 2) / (N + 2 V))``, and two such shares differ by
``floor((p - q)^2 / (p + q))``. The differences of all pairs of sources are summed per tile of ``TILE`` x ``TILE`` sources and slice of
terms, so a task holds a bounded matrix however many sources and terms a language has; terms that no source of a tile has are added
by their number. N and V may go up to 9 * 10^15.

Rows: null texts, languages and sources are read as empty; a row without terms still makes its group occur. Every row counts as a
document, repeated rows and repeated or null ids included. An empty table gives no rows; a language that keeps no term has
difference 0 for all pairs and no terms. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.batches import column, small_batches
from marlstone.session import written

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP_TERMS = 10
#: Occurrences that a task sorts at once, bytes of long terms likewise; beyond that only the rest of the text it is reading.
FLUSH_TERMS = 1 << 20
FLUSH_BYTES = 1 << 25
#: Bytes of text that are cut into terms at once.
PIECE = 1 << 22
#: Sources on each side of a tile, and shares (sources x terms) that a task holds per side.
TILE = 256
CELLS = 1 << 17

#: Bytes of a term: letters and everything beyond ASCII. A term has no zero byte, so packing by zeros is one to one.
IN_TERM = np.array([b >= 0x80 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


# -- counting -------------------------------------------------------------------------------------------------

def pieces(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int, bool]]:
    """Byte ranges of at most ``size`` bytes of whole texts, or of one longer text, then cut where no term goes on; and whether a text ends there."""
    at = 0
    while at < len(data):
        k = int(np.searchsorted(offsets, min(at + size, len(data)), "right")) - 1
        end = int(offsets[k])
        if end <= at:
            end, last = at + size, int(offsets[k + 1])
            while end < last and IN_TERM[data[end]]:
                inside = IN_TERM[data[end:min(last, end + (1 << 16))]]
                end += len(inside) if inside.all() else int(inside.argmin())
        k = int(np.searchsorted(offsets, end))
        yield at, end, bool(offsets[k] == end)
        at = end


def find_terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and length of each term; no term crosses one of the sorted ``bounds``."""
    inside = IN_TERM[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | fresh[1:-1]
    stop[:-1] &= ~inside[1:] | fresh[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1 - starts


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: int) -> list[np.ndarray]:
    """The bytes of each term as big-endian 64-bit words, filled up with zeros."""
    at = np.arange(8 * words)
    cells = data[np.minimum(starts[:, None] + at, len(data) - 1)]
    cells[at >= lengths[:, None]] = 0
    return list(cells.view(">u8").astype(np.uint64).T)


def radix_order(keys: list[np.ndarray], n: int) -> np.ndarray:
    """Stable order by the keys, the first of highest rank: one counting pass per 16-bit digit that differs anywhere."""
    order = np.arange(n)
    for key in reversed(keys):
        differs = int(np.bitwise_or.reduce(key ^ key[0])) if n else 0
        for shift in range(0, 64, 16):
            if differs >> shift & 0xFFFF:
                digit = (key >> np.uint64(shift)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def count_runs(changes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, rows and distinct documents of each run of sorted rows; rows of a run are in document order."""
    first = np.flatnonzero(changes)
    seen = changes.copy()
    seen[1:] |= docs[1:] != docs[:-1]
    return first, np.diff(np.append(first, len(docs))), np.add.reduceat(seen.astype(np.int64), first)


class Counter:
    """Occurrences by (group, term) of the texts so far, in buckets by term length."""

    def __init__(self, flush_terms: int = FLUSH_TERMS, flush_bytes: int = FLUSH_BYTES, piece: int = PIECE):
        self.flush_terms, self.flush_bytes, self.piece = flush_terms, flush_bytes, piece
        self.groups: dict[tuple[str, str], int] = {}
        self.docs = 0
        self.clear()

    def clear(self) -> None:
        self.short: dict[int, list[tuple[np.ndarray, ...]]] = {1: [], 2: []}
        self.long: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.terms = self.bytes = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> Iterator[list[tuple]]:
        """Take the texts ``data[offsets[i]:offsets[i + 1]]`` of the groups; yields counted rows whenever enough have come together."""
        data = LOWERED[data]
        for at, end, whole in pieces(data, offsets, self.piece):
            part = data[at:end]
            inner = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, end, "right")] - at
            starts, lengths = find_terms(part, inner)
            doc = np.searchsorted(offsets, starts + at, "right") - 1
            group, doc = groups[doc].astype(np.uint64), doc + self.docs
            for words, chosen in ((1, lengths <= 8), (2, (lengths > 8) & (lengths <= 16))):
                if chosen.any():
                    self.short[words].append((group[chosen], *packed(part, starts[chosen], lengths[chosen], words), doc[chosen]))
            for n in np.unique(lengths[lengths > 16]).tolist():
                chosen = np.flatnonzero(lengths == n)
                for some in np.array_split(chosen, 1 + len(chosen) * n // self.flush_bytes):
                    self.long.setdefault(n, []).append((group[some], part[starts[some][:, None] + np.arange(n)].reshape(-1).view(f"S{n}"), doc[some]))
                self.bytes += len(chosen) * n
            self.terms += len(starts)
            if whole and (self.terms >= self.flush_terms or self.bytes >= self.flush_bytes):
                yield self.rows()
        self.docs += len(offsets) - 1

    def rows(self) -> list[tuple]:
        """(lang, source, term, occurrences, documents) of the whole texts taken since the last time."""
        names, out = list(self.groups), []
        for words, parts in self.short.items():
            if parts:
                *keys, docs = [np.concatenate(x) for x in zip(*parts)]
                order = radix_order(keys, len(docs))
                keys, docs = [k[order] for k in keys], docs[order]
                changes = np.ones(len(docs), bool)
                changes[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
                first, n, in_docs = count_runs(changes, docs)
                terms = np.stack([k[first] for k in keys[1:]], axis=1).astype(">u8").view(f"S{8 * words}").reshape(-1)
                out += zip(*zip(*[names[g] for g in keys[0][first].tolist()]), terms.tolist(), n.tolist(), in_docs.tolist())
        for parts in self.long.values():
            group, terms, docs = [np.concatenate(x) for x in zip(*parts)]
            order = np.argsort(terms, kind="stable")
            order = order[radix_order([group[order]], len(order))]
            group, terms, docs = group[order], terms[order], docs[order]
            changes = np.ones(len(docs), bool)
            changes[1:] = (group[1:] != group[:-1]) | (terms[1:] != terms[:-1])
            first, n, in_docs = count_runs(changes, docs)
            out += zip(*zip(*[names[g] for g in group[first].tolist()]), terms[first].tolist(), n.tolist(), in_docs.tolist())
        self.clear()
        return out


COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted rows of (lang, source, text) batches."""
    counter = Counter()

    def sent(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + (1 << 14)]), COUNTED)], schema=COUNTED)

    for batch in batches:
        if not batch.num_rows:
            continue
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        groups = np.array([counter.groups.setdefault(g, len(counter.groups)) for g in zip(langs, sources)], np.int64)
        texts = batch.column(2).cast(pa.large_binary() if pa.types.is_large_string(batch.column(2).type) else pa.binary()).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[offsets[0]:offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
        for rows in counter.add(data, offsets - offsets[0], groups):
            yield from sent(rows)
    yield from sent(counter.rows())


def term_counts(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents of the group that hold it."""
    small_batches(df.sparkSession)
    parts = df.select(*[F.coalesce(column(df, c).cast("string"), F.lit("")) for c in (lang, source, text)])
    found = parts.mapInArrow(count_batches, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# -- shares and differences -----------------------------------------------------------------------------------

def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * kept))``, exact; null where no term is kept."""
    whole = lambda c: c.cast("decimal(19,0)")
    top, bottom = (whole(count) + 2) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + 2 * kept)
    return F.when(kept > 0, F.call_function("div", top, bottom) + 1)


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


SUMS = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64()), ("seen", pa.int64())])


def tile_sums(key: tuple, table: pa.Table, tile: int) -> pa.Table:
    """Per pair of sources of a tile: differences summed over the terms that come here, and how many those are.

    Rows without a term give a source's share of a term that it does not have.
    """
    lang, ti, tj = key[0].as_py(), key[1].as_py(), key[2].as_py()
    place, terms, p = table.column("place").to_numpy(), table.column("term").combine_chunks(), table.column("p").to_numpy()
    bare = terms.is_null().to_numpy(zero_copy_only=False)
    sources = np.unique(place[bare])
    order = np.argsort(place[bare])
    base = p[bare][order]
    codes = terms.filter(pa.array(~bare)).dictionary_encode()
    n_terms = len(codes.dictionary)
    shares = np.repeat(base[:, None], n_terms, axis=1)
    shares[np.searchsorted(sources, place[~bare]), codes.indices.to_numpy()] = p[~bare]
    right = np.flatnonzero(sources // tile == tj)
    out: list[tuple] = []
    for i in np.flatnonzero(sources // tile == ti).tolist():
        others = right[sources[right] > sources[i]]
        if len(others):
            out += zip([lang] * len(others), [int(sources[i])] * len(others), sources[others].tolist(),
                       differences(shares[i][None, :], shares[others]).sum(axis=1).tolist(), [n_terms] * len(others))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, SUMS)], schema=SUMS)


def pair_sums(kept: DataFrame, groups: DataFrame, tile: int = TILE, cells: int = CELLS) -> DataFrame:
    """(lang, a, b, value, seen): sums over tiles and slices for pairs of places ``a < b`` of the sources in their language.

    ``kept`` has (lang, source, term, n), ``groups`` (lang, source, place, sources, vocabulary, total).
    """
    g = groups.filter("vocabulary > 0")
    tiles = F.ceil(F.col("sources") / tile).cast("int")
    slices = F.ceil(F.col("vocabulary") / F.greatest(F.lit(1), F.floor(F.lit(cells) / F.least("sources", F.lit(2 * tile))))).cast("int")
    own = F.floor(F.col("place") / tile).cast("int")
    meet = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(t, own).alias("ti"), F.greatest(t, own).alias("tj")))
    rows = (kept.join(g, ["lang", "source"])
            .select("lang", "place", "term", share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"),
                    F.pmod(F.xxhash64("term"), slices).cast("int").alias("slice"), F.explode(meet).alias("tile")))
    bare = (g.select("lang", "place", share(F.lit(0), F.col("total"), F.col("vocabulary")).alias("p"), F.explode(meet).alias("tile"), slices.alias("slices"))
            .select("lang", "place", F.lit(None).cast("string").alias("term"), "p", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "tile"))
    flat = rows.unionByName(bare).select("lang", "tile.ti", "tile.tj", "slice", "place", "term", "p")
    return (flat.groupBy("lang", "ti", "tj", "slice").applyInArrow(lambda key, table: tile_sums(key, table, tile), "lang string, a int, b int, value long, seen long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS,
          tile: int = TILE, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance of each group to every other source of its language (part ``pair``), and
    the ``top`` terms it has more of than its language (part ``term``); largest value first, then item in UTF-8 order."""
    counts = written(term_counts(df, lang, source, text))
    langs = (counts.groupBy(F.col("lang").alias("_lang"), F.col("term").alias("_term")).agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs"))
             .filter(F.col("lang_docs") >= min_docs))
    kept = written(counts.join(langs, (F.col("lang") == F.col("_lang")) & (F.col("term") == F.col("_term"))).select("lang", "source", "term", "n", "lang_n"))

    occurring = df.select(F.coalesce(column(df, lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(column(df, source).cast("string"), F.lit("")).alias("source")).distinct()
    totals = kept.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(F.sum("n").alias("total"))
    words = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    of_lang = Window.partitionBy("lang")
    groups = written(
        occurring.join(totals, (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")), "left").drop("_lang", "_source")
        .join(words, F.col("lang") == F.col("_lang"), "left").drop("_lang")
        .select("lang", "source", (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"), F.count(F.lit(1)).over(of_lang).alias("sources"),
                *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "vocabulary", "lang_total")]))

    p, q = share(F.col("n"), F.col("total"), F.col("vocabulary")), share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
             .select("lang", "source", "item", difference(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top))

    missing = share(F.lit(0), F.col("total"), F.col("vocabulary"))
    one = groups.select("lang", "source", "place", "vocabulary", missing.alias("p"))
    two = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("item"), F.col("place").alias("other"), missing.alias("q"))
    sums = pair_sums(kept, groups, tile, cells).withColumnRenamed("lang", "_of")
    pairs = (one.join(two, (F.col("lang") == F.col("_lang")) & (F.col("place") != F.col("other")))
             .join(sums, (F.col("lang") == F.col("_of")) & (F.least("place", "other") == F.col("a")) & (F.greatest("place", "other") == F.col("b")), "left")
             .select("lang", "source", "item", F.when(F.col("vocabulary") == 0, 0).otherwise(
                 F.coalesce("value", F.lit(0)) + (F.col("vocabulary") - F.coalesce("seen", F.lit(0))) * difference(F.col("p"), F.col("q"))).alias("value"))
             .withColumn("rank", F.row_number().over(best)))
    return (pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
            .select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"))
