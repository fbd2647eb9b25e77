"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set where more than half of its shingle hashes have it set. Fingerprints link when they differ in at
most ``RADIUS`` bits. The covering family has 2^(RADIUS+1) - 1 masks: bit position i carries a non-zero vector phi(i) of RADIUS+1
bits, and mask v keeps the positions with <phi(i), v> = 1. Any RADIUS differing positions span at most RADIUS dimensions, so some v
is orthogonal to all of them: two linked fingerprints agree under that mask. No linked pair is lost.

Buckets (mask, kept bits) that hold one fingerprint end there. Up to ``PAIRED`` fingerprints of a bucket are compared with each
other; a larger bucket sends each fingerprint to itself and its one-bit changes within the bits the mask drops. Two that meet
differ in at most two bits, and any two that differ in one or two do meet, so a bucket of any size costs time in proportion.

Rows: null, empty and wordless texts have fingerprint zero and link like any other. Equal texts have equal fingerprints. Rows
without an id take part by their fingerprint; their component is the smallest id reachable, null where there is none. Repeated
rows are alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.batches import append_columns, byte_list, column, fresh
from marlstone.operators.graph import connected_components
from marlstone.session import cut_lineage

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
#: Largest bucket whose fingerprints are compared with each other; larger ones meet at one-bit changes instead.
PAIRED = 48
#: Shingles counted at once.
SLICE = 1 << 16

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed long."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[len(words) - n:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, SLICE):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at:min(n, at + SLICE)].tolist(), ends[at:at + SLICE].tolist())]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint as a long; one pass, no shuffle."""

    def make():
        return lambda values: [pa.array([fingerprint(v, shingle) for v in byte_list(values)], pa.int64())]

    return append_columns(df, [text], [T.StructField(name, T.LongType())], make)


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks, as signed longs."""
    size = 1 << (radius + 1)
    out = []
    for v in range(1, size):
        kept = sum(1 << i for i in range(BITS) if ((1 + i % (size - 1)) & v).bit_count() % 2)
        out.append(kept - (1 << BITS) if kept >> (BITS - 1) else kept)
    return out


def links(prints: DataFrame, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """(a, b): edges between distinct fingerprints ``fp`` at most ``radius`` bits apart, enough to connect whatever is linked."""
    if radius != 2:
        raise ValueError("one-bit changes of both sides meet at two bits: radius must be 2")
    table = F.array(*[F.struct(F.lit(k).alias("mask"), F.lit(m).alias("keep")) for k, m in enumerate(masks(radius))])
    placed = (prints.select("fp", F.explode(table).alias("m"))
              .select("fp", F.col("m.mask").alias("mask"), F.col("m.keep").alias("keep"), F.col("fp").bitwiseAND(F.col("m.keep")).alias("kept")))
    sizes = cut_lineage(placed.groupBy("mask", "kept").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                        .select(F.col("mask").alias("_mask"), F.col("kept").alias("_kept"), "n"))
    full = cut_lineage(placed.join(sizes, (F.col("mask") == F.col("_mask")) & (F.col("kept") == F.col("_kept"))).select("fp", "mask", "keep", "kept", "n"))

    small = full.filter(F.col("n") <= paired).groupBy("mask", "kept").agg(F.collect_list("fp").alias("members"))
    near = small.select(F.explode("members").alias("a"), "members").select("a", F.filter(
        "members", lambda b: (b > F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= radius)).alias("partners"))
    pairs = near.select("a", F.explode("partners").alias("b"))

    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << BITS) if i == BITS - 1 else 1 << i).cast("long") for i in range(BITS)])
    dropped = F.filter(flips, lambda f: f.bitwiseAND(F.col("keep")) == 0)
    met = full.filter(F.col("n") > paired).select("fp", F.explode(dropped).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("spot")).distinct()
    least = cut_lineage(met.groupBy("spot").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least <> most")
                        .select(F.col("spot").alias("_spot"), "least"))
    stars = met.join(least, F.col("spot") == F.col("_spot")).filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id, class): one row per row of ``df``; ``fp`` is the fingerprint as a long. ``class`` is never null: the smallest linked fingerprint."""
    rows = cut_lineage(with_fingerprints(df.select(column(df, id).alias("doc_id"), column(df, text).alias("text")), "text", "fp", shingle).select("doc_id", "fp"))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = cut_lineage(links(prints.select("fp"), radius))
    nodes = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    parts = connected_components(nodes, edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("_fp"), "component")
    classed = cut_lineage(prints.join(parts, F.col("fp") == F.col("_fp"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("class")))
    least = cut_lineage(classed.groupBy("class").agg(F.min("rep").alias("component_id")).select(F.col("class").alias("_class"), "component_id"))
    known = cut_lineage(classed.join(least, F.col("class") == F.col("_class")).select(F.col("fp").alias("_fp"), "class", "component_id"))
    return (rows.join(known, F.col("fp") == F.col("_fp"))
            .select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "class"))


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``df`` with one row of each group: the smallest id, of equal ids the first in text order. A class without any id keeps one row."""
    fp, other, rank, group, first = fresh(df, "fp", "other_fp", "place", "group_class", "first_id")
    marked = with_fingerprints(df, text, fp, shingle)
    found = near_duplicates(df, id, text, shingle, radius)
    classes = cut_lineage(found.groupBy("fp").agg(F.min("class").alias("c"), F.min("component_id").alias("f"))
                          .select(F.col("fp").alias(other), F.col("c").alias(group), F.col("f").alias(first)))
    joined = marked.join(classes, F.col(fp) == F.col(other)).filter(F.col(first).isNull() | (F.col(f"`{id}`") == F.col(first)))
    w = Window.partitionBy(group).orderBy(F.col(f"`{id}`").asc_nulls_last(), F.col(f"`{text}`"))
    return joined.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).select(*[F.col(f"`{c}`") for c in df.columns])
