"""Exact substring deduplication with suffix trees that are split by word prefixes into groups of bounded size.

A window is ``window`` consecutive words; a word goes if a window over it also starts earlier (smaller id, or the same document
further up). Only the part of the suffix tree below depth ``window`` matters, so every suffix that has a whole window before the
text ends is filed under a short run of words and the trees of the groups are built apart:

1. The key of a suffix is the ``GRAM``-word run with the smallest hash within its first ``window`` words, the leftmost of equals.
   Equal windows have equal keys, and some eight neighbouring suffixes share one, so they travel as one fragment of text. This
   takes the place of a literal first-words prefix, for which every suffix would have to be sent by itself.
2. A key that one run of suffixes has cannot repeat; it ends here, before any text is shuffled.
3. The fragments of a key with up to ``GROUP`` runs go to one group. Its sorted suffixes are the leaves of the subtree; neighbours
   that share at least ``window`` words lie below a deep internal node, a repeat. All but its earliest leaf are marked.
4. Of a key with more runs, equal fragments become one first: the earliest place is aggregated before the shuffle, the others go
   whole. If more than ``GROUP`` different fragments are left, the prefix is lengthened to the whole window: a node is then one
   128-bit hash, whose earliest place is aggregated and to which the later places are joined. No group passes through one task.

The shuffle of the texts is the same for all these joins and for the last one, so it is done once.

Rows: null, empty and short texts lose nothing (a null text has no words; kept text is then null). Rows without an id lose nothing
and are not counted as earlier. A document is an id, of any type with an order, and the hash of its text: equal texts of one id are
one document, different texts of one id are documents of their own, in the order of their hashes. An input column with the name of
a result column comes back with underscores before its name.
"""

from __future__ import annotations

from hashlib import md5
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marlstone.llm.batches import append_columns, byte_list, column, fresh, making_room, row_batches, small_batches
from marlstone.session import cut_lineage, scratch

WINDOW = 20
GRAM = 6
#: Most runs of suffixes in one group: some hundred KB of text.
GROUP = 1024
#: Tasks over which the rows of one key are dealt in joins.
SALTS = 16
#: Bytes of text looked at together in a task.
STRETCH = 1 << 20
#: The order of places: earlier documents first, then earlier words.
PLACE_COLUMNS = ("id", "version", "begin")
#: The bytes between words, and a scattered 64-bit number for every byte value, by rule.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SCATTER = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(23))


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value, the first of equals, in every stretch of ``width`` values."""
    at, low, reach = np.arange(len(values)), values, 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = low[:-step], low[step:]
        first = left <= right
        at, low = np.where(first, at[:-step], at[step:]), np.where(first, left, right)
        reach += step
    return at


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch [begin, end) of bytes that does not depend on where it stands."""
    values = SCATTER[data]
    plain = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    values *= np.arange(len(data), dtype=np.uint64)
    placed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    one = plain[ends] - plain[begins]
    return mixed((placed[ends] - placed[begins] - begins.astype(np.uint64) * one) * np.uint64(0xD6E8FEB86659FD93) + one)


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def find_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of texts that stand one after the other, text k in [bounds[k], bounds[k + 1])."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def runs(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(text, first suffix, number of suffixes, key) arrays: the stretches of neighbouring suffixes with one key at one place."""
    begins, ends = find_words(data, bounds)
    first = np.searchsorted(begins, bounds)  # the first word of each text
    n = len(begins)
    if n < window:
        return None
    h = word_hashes(data, begins, ends)
    g = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k:k + len(g)]
    g = mixed(g)
    at = leftmost_minimum(g, window - gram + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = text[:len(at)] == text[window - 1:window - 1 + len(at)]  # the window does not run into the next text
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~whole[:-1] | ~whole[1:]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(at)))
    kept = whole[starts]
    starts, counts = starts[kept], counts[kept]
    return text[starts], starts - first[text[starts]], counts, g[at[starts]].view(np.int64)


def repeated_leaves(fragments: list[tuple[tuple, bytes]], window: int = WINDOW) -> list[tuple]:
    """(document, start) of every suffix below a deep node of the subtree but the earliest; fragments are ((document, start), words)."""
    leaves = []
    for (doc, start), text in fragments:
        ends = [0]
        for word in text.split(b" "):
            ends.append(ends[-1] + len(word) + 1)
        text += b" "  # each word ends with a space: suffixes with equal first words are neighbours in byte order
        for i in range(len(ends) - window):
            leaves.append((text[ends[i]:], ends[i + window] - ends[i], doc, start + i))
    leaves.sort(key=itemgetter(0))
    out, node, label = [], [], b""
    for suffix, depth, doc, start in leaves:
        if suffix[:depth] != label:
            if len(node) > 1:
                first = min(node)
                out.extend(p for p in node if p != first)
            node, label = [], suffix[:depth]
        node.append((doc, start))
    if len(node) > 1:
        first = min(node)
        out.extend(p for p in node if p != first)
    return out


def group_spans(group: list[tuple], window: int = WINDOW):
    """(document, begin, end) of the repeated words of one group of (document, start, words). Equal fragments are one: all but the earliest go
    whole, and only the earliest of each enters the subtree."""
    places: dict[bytes, set[tuple]] = {}
    for doc, start, text in group:
        places.setdefault(text, set()).add((doc, start))
    for text, at in places.items():
        if len(at) > 1:
            n, first = text.count(b" ") + 1, min(at)
            yield from ((doc, start, start + n) for doc, start in at if (doc, start) != first)
    if len(places) > 1:
        yield from spans(repeated_leaves([(min(at), text) for text, at in places.items()], window), window)


def spans(starts: list[tuple], window: int):
    """(document, begin, end) of the words that the windows cover, neighbours merged."""
    held = None
    for doc, start in sorted(set(starts)):
        if held and held[0] == doc and start <= held[2]:
            held[2] = start + window
            continue
        if held:
            yield tuple(held)
        held = [doc, start, start + window]
    if held:
        yield tuple(held)


def find_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, version, lo, n, key) for every run of suffixes; ``docs`` is (id, version, text) without nulls."""
    names = ["id", "version", "lo", "n", "key"]

    def run(batches):
        for batch in batches:
            texts = byte_list(batch.column(2))
            for some, data, bounds, lead in stretches(texts):
                found = runs(data, bounds, window, gram)
                if found is not None:
                    text, lo, n, key = found
                    rows = pa.array(some[text])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array((lo + lead).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key)], names)

    def stretches(texts):
        """Texts put together up to STRETCH bytes; a longer one by itself, in parts that overlap by a window."""
        held, size, at = [], 0, []
        for i, text in enumerate(texts):
            if len(text) > STRETCH:
                words = text.split()
                for begin in range(0, max(len(words) - window + 1, 0), STRETCH // 8):
                    part = b" ".join(words[begin:begin + STRETCH // 8 + window - 1])
                    yield np.array([i]), np.frombuffer(part, np.uint8), np.array([0, len(part)]), begin
                continue
            if size + len(text) > STRETCH:
                yield put_together(held, at)
                held, size, at = [], 0, []
            held.append(text)
            at.append(i)
            size += len(text)
        if held:
            yield put_together(held, at)

    def put_together(held, at):
        return np.array(at), np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), 0

    return docs.mapInArrow(run, f"id {id_type(docs)}, version long, lo int, n int, key long")


def id_type(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def version(df: DataFrame, text: str):
    return F.xxhash64(column(df, text))


def fragments(df: DataFrame, id: str, text: str, found: DataFrame, window: int) -> DataFrame:
    """(key, id, version, lo, words): the text of each run."""
    lists = (found.groupBy(F.col("id").alias("_id"), F.col("version").alias("_version")).agg(F.collect_set(F.struct("lo", "n", "key")).alias("runs")))
    both = (df.select(column(df, id), column(df, text)).join(lists, (column(df, id) == F.col("_id")) & (version(df, text) == F.col("_version")))
            .select(F.col("_id"), F.col("_version"), F.col(f"`{text}`"), "runs.lo", "runs.n", "runs.key"))
    schema = pa.schema([("key", pa.int64()), ("id", to_arrow_type(found.schema["id"].dataType)), ("version", pa.int64()), ("lo", pa.int32()), ("words", pa.binary())])

    def run(batches):
        def rows(batch):
            lo, n, key = (batch.column(i).values.to_numpy(zero_copy_only=False).tolist() for i in (3, 4, 5))
            ends = batch.column(3).offsets.to_numpy().tolist()
            for doc, of, text, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_list(batch.column(2)), ends, ends[1:]):
                words = text.split() if text else []
                for begin, count, k in zip(lo[a:b], n[a:b], key[a:b]):
                    part = words[begin:begin + count + window - 1]
                    if len(part) >= window:
                        yield k, doc, of, begin, b" ".join(part)

        for batch in batches:
            yield from row_batches(rows(batch), schema)

    return both.mapInArrow(run, f"key long, id {id_type(found)}, version long, lo int, words binary")


def marked_in_groups(pieces: DataFrame, window: int) -> DataFrame:
    """(id, version, begin, end) from the subtree of each key; a group is held one at a time."""
    schema = pa.schema([("id", to_arrow_type(pieces.schema["id"].dataType)), ("version", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        groups = ([(r[1:3], r[3], r[4]) for r in group] for _, group in groupby(rows, key=itemgetter(0)))
        yield from row_batches(((*doc, begin, end) for group in groups for doc, begin, end in group_spans(group, window)), schema)

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"id {id_type(pieces)}, version long, begin long, end long")


def dealt(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``df`` joined to ``table``, which has each ``key`` once; rows of one key are dealt over SALTS tasks."""
    left = df.withColumn("_salt", F.pmod(F.xxhash64("id", "version", "begin"), F.lit(SALTS)).cast("int"))
    right = table.withColumnRenamed(key, "_key").withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_r_salt"))).drop("_key", "_salt", "_r_salt")


def later(places: DataFrame, first: DataFrame, node: str) -> DataFrame:
    """The places (node, id, version, begin, ...) that are not the first of their node; ``first`` is (node, first, last)."""
    return dealt(places, first.filter("first <> last").select(node, "first"), node).filter(F.struct(*PLACE_COLUMNS) > F.col("first"))


def merged_pieces(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal fragments of a key as one: (key, id, version, begin, words) of the earliest, and (id, version, begin, end) of the others."""
    whole = pieces.select("key", F.unhex(F.md5("words")).alias("node"), "id", "version", F.col("lo").cast("long").alias("begin"), "words")
    one = whole.groupBy("key", "node").agg(F.min(F.struct("id", "version", "begin", "words")).alias("first"), F.max(F.struct(*PLACE_COLUMNS)).alias("last"))
    places = whole.select("node", "id", "version", "begin", (F.regexp_count(F.col("words").cast("string"), F.lit(" ")) + 1).alias("n"))
    copies = later(places, one.select("node", F.struct("first.id", "first.version", "first.begin").alias("first"), "last"), "node")
    return one.select("key", "first.id", "first.version", "first.begin", "first.words"), copies.select("id", "version", "begin", (F.col("begin") + F.col("n")).alias("end"))


def marked_by_window(pieces: DataFrame, window: int) -> DataFrame:
    """(id, version, begin, end) by the whole window as the prefix, for keys of any size; ``pieces`` is (key, id, version, begin, words)."""
    schema = pa.schema([("node", pa.binary()), ("id", to_arrow_type(pieces.schema["id"].dataType)), ("version", pa.int64()), ("begin", pa.int64())])

    def run(batches):
        def rows(batch):
            for doc, of, lo, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split(b" ")
                for i in range(len(words) - window + 1):
                    yield md5(b" ".join(words[i:i + window])).digest(), doc, of, lo + i

        for batch in batches:
            yield from row_batches(rows(batch), schema)

    leaves = pieces.select("id", "version", "begin", "words").mapInArrow(run, f"node binary, id {id_type(pieces)}, version long, begin long")
    nodes = later(leaves, leaves.groupBy("node").agg(F.min(F.struct(*PLACE_COLUMNS)).alias("first"), F.max(F.struct(*PLACE_COLUMNS)).alias("last")), "node")
    return nodes.select("id", "version", "begin", (F.col("begin") + window).alias("end"))


def dedup_substrings(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP,
                     names: tuple[str, str, str] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """``df`` with the number of words, the number removed, and the kept words joined by one space."""
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    spark = df.sparkSession
    small_batches(spark)
    df, (id, text) = making_room(df, names, id, text)
    own = df.select(column(df, id).alias("id"), version(df, text).alias("version"), column(df, text).alias("text")).filter("id is not null and text is not null")
    found = find_runs(own, window, gram)
    # Only keys met more than once go on; both sides of the join are plain shuffles, so a frequent key can be split.
    keys = cut_lineage(found.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(F.col("key").alias("_key"), "size"))
    place = scratch(spark, "substring-runs")
    found.join(keys, F.col("key") == F.col("_key")).select("id", "version", "lo", "n", "key", (F.col("size") > group).alias("large")).write.parquet(place)
    again = spark.read.schema(f"id {id_type(own)}, version long, lo int, n int, key long, large boolean").parquet(place)
    small = fragments(df, id, text, again.filter("not large"), window).select("key", "id", "version", F.col("lo").cast("long").alias("begin"), "words")
    merged, copies = merged_pieces(fragments(df, id, text, again.filter("large"), window))
    sized = dealt(merged, merged.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key")
    fitting = sized.filter(F.col("size") <= group).drop("size")
    marked = (marked_in_groups(small.unionByName(fitting), window).unionByName(copies)
              .unionByName(marked_by_window(sized.filter(F.col("size") > group).drop("size"), window)))
    begins, ends, key, of = fresh(df, "cut_begins", "cut_ends", "cut_id", "cut_version")
    # Every document has a list, if an empty one: all joins of the texts are then alike, and their shuffle is done once.
    every = marked.unionByName(df.select(column(df, id).alias("id"), version(df, text).alias("version")), allowMissingColumns=True)
    lists = every.groupBy(F.col("id").alias(key), F.col("version").alias(of)).agg(F.array_sort(F.collect_list(F.when(F.col("begin").isNotNull(), F.struct("begin", "end")))).alias(begins))
    columns = [F.col(f"`{c}`") for c in df.columns]
    none = F.array().cast("array<long>")
    joined = (df.join(lists, (column(df, id) == F.col(key)) & (version(df, text) == F.col(of))).select(*columns, F.col(f"{begins}.begin").alias(begins), F.col(f"{begins}.end").alias(ends))
              .unionByName(df.filter(column(df, id).isNull()).select(*columns, none.alias(begins), none.alias(ends))))

    def make():
        def work(values, first, after):
            out = []
            flat_a, flat_b = (c.values.to_numpy(zero_copy_only=False).tolist() for c in (first, after))
            at = first.offsets.to_numpy().tolist()
            for value, a, b in zip(byte_list(values), at, at[1:]):
                words = value.split() if value is not None else []
                n, kept, reached = len(words), [], 0
                for begin, end in zip(flat_a[a:b], flat_b[a:b]):
                    if begin > reached:
                        kept += words[reached:begin]
                    reached = max(reached, end)
                kept += words[reached:]
                out.append((n, n - len(kept), None if value is None else b" ".join(kept)))
            n, removed, kept = zip(*out) if out else ((), (), ())
            return [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]

        return work

    fields = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.StringType())]
    return append_columns(joined, [text, begins, ends], fields, make).drop(begins, ends)
