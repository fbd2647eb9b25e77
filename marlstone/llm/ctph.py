"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes cuts a text where it is -1 modulo the block size; every piece gives one character of the
signature. The block size is the smallest 3 * 2^k of which 64 cover the text, halved while the signature is shorter than 32. A
fingerprint is ``size:signature:signature at twice the size``. Two fingerprints are compared at a block size that both have, by
edit distance; without one their likeness is 0, equal fingerprints have 1.

Rows: null and empty texts have the fingerprint ``3::``. Equal texts have equal fingerprints. The neighbour of a row is the next in
descending id, rows without an id last, equal ids by text; after the last comes the first, and a lone row is its own neighbour.
"""

from __future__ import annotations

from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import column, row_batches, small_batches

SMALLEST = 3
LONG, SHORT = 64, 32
#: Bytes hashed at once.
SLICE = 1 << 18
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype="S1")
POWER = [np.uint32(pow(0x01000193, k, 1 << 32)) for k in range(7)]
#: A scattered 64-bit number for every byte value, by rule.
SCATTER = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(23))


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last seven bytes at each position; bytes before the first count as zero."""
    one = data.astype(np.uint32) + np.uint32(1)
    two, seven = one.copy(), None
    two[1:] += POWER[1] * one[:-1]
    seven = two.copy()
    seven[2:] += POWER[2] * two[:-2]
    seven[4:] += POWER[4] * two[:-4]
    seven[6:] += POWER[6] * one[:-6]
    seven ^= seven >> np.uint32(15)
    seven *= np.uint32(0x2C1B3C6D)
    seven ^= seven >> np.uint32(13)
    return seven


def cuts(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the pieces that the rolling hash triggers at this block size, and whether it also does at twice the size."""
    ends, twice = [], []
    for at in range(0, len(data), SLICE):
        back = min(at, 6)
        h = rolling(data[at - back:at + SLICE])[back:]
        hit = np.flatnonzero(h % np.uint32(size) == size - 1)
        ends.append(hit + at + 1)
        twice.append(h[hit] % np.uint32(2 * size) == 2 * size - 1)
    return (np.concatenate(ends), np.concatenate(twice)) if ends else (np.zeros(0, np.int64), np.zeros(0, bool))


def signature(data: np.ndarray, ends: np.ndarray, longest: int) -> str:
    """One character per piece; from the last allowed one on, the rest of the text is one piece."""
    ends = ends[:longest - 1]
    if not len(data):
        return ""
    if not len(ends) or ends[-1] < len(data):
        ends = np.append(ends, len(data))
    plain, placed = np.zeros(len(ends), np.uint64), np.zeros(len(ends), np.uint64)
    sum1 = sum2 = np.uint64(0)
    for at in range(0, len(data), SLICE):
        values = SCATTER[data[at:at + SLICE]]
        c1 = np.cumsum(values)
        c2 = np.cumsum(values * np.arange(at, at + len(values), dtype=np.uint64))
        inside = (ends > at) & (ends <= at + len(values))
        place = ends[inside] - at - 1
        plain[inside], placed[inside] = c1[place] + sum1, c2[place] + sum2
        sum1, sum2 = sum1 + c1[-1], sum2 + c2[-1]
    starts = np.append(0, ends[:-1]).astype(np.uint64)
    one = np.diff(plain, prepend=np.uint64(0))
    h = (np.diff(placed, prepend=np.uint64(0)) - starts * one) * np.uint64(0xD6E8FEB86659FD93) + one
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode("ascii")


def fingerprint(text: str | bytes | None) -> str:
    with np.errstate(over="ignore"):
        data = np.frombuffer(text if isinstance(text, bytes) else (text or "").encode("utf-8"), dtype=np.uint8)
        size = SMALLEST
        while size * LONG < len(data):
            size *= 2
        while True:
            ends, twice = cuts(data, size)
            if size == SMALLEST or len(ends) + 1 >= SHORT:
                return f"{size}:{signature(data, ends, LONG)}:{signature(data, ends[twice], SHORT)}"
            size //= 2


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprint columns, by edit distance of the signatures at block sizes that both have."""
    def part(c: Column, i: int) -> Column:
        return F.split(c, ":")[i]

    def alike(x: Column, y: Column) -> Column:
        most = F.greatest(F.length(x), F.length(y))
        return F.when(most == 0, 0.0).otherwise(1.0 - F.levenshtein(x, y) / most)

    size_a, size_b = part(a, 0).cast("long"), part(b, 0).cast("long")
    return (F.when(a == b, 1.0).when(size_a == size_b, F.greatest(alike(part(a, 1), part(b, 1)), alike(part(a, 2), part(b, 2))))
            .when(size_a == 2 * size_b, alike(part(a, 1), part(b, 2))).when(size_b == 2 * size_a, alike(part(a, 2), part(b, 1))).otherwise(0.0))


def in_order(df: DataFrame, id: str, text: str, rows_per_part: int = 512) -> DataFrame:
    """(part, halo, ord, text, id): rows dealt by id range so that each part, sorted, is a stretch of the descending order followed
    by a copy of the row that comes after it. Only bounds and one id per part reach the driver."""
    low = -(1 << 63)
    rows = df.select(F.coalesce(column(df, id).cast("long"), F.lit(low)).alias("ord"), column(df, text).alias("text"), column(df, id).alias("id"))
    n = rows.count()
    parts = max(1, min(20_000, n // rows_per_part))
    shares = [k / parts for k in range(1, parts)]
    bounds = sorted(set(rows.select(F.percentile_approx("ord", shares, 10 * parts)).head()[0] or [])) if shares else []
    # The part is the number of bounds below the id, found by halving the list.
    part = F.lit(0)
    if bounds:
        held = F.lit(bounds)
        steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
        part = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(held, n + step - 1) < F.col("ord"), n + step).otherwise(n))
    dealt = rows.withColumn("part", part)
    tops = sorted((r["part"], r["top"]) for r in dealt.groupBy("part").agg(F.max("ord").alias("top")).collect())
    if not tops:
        return dealt.select("part", F.lit(False).alias("halo"), "ord", "text", "id")
    after = {}  # the first row of a part follows the last row of the part above; the very first follows the very last
    for (_, top), (above, _) in zip(tops, [*tops[1:], tops[0]]):
        after[top] = above
    heads = df.sparkSession.createDataFrame(list(after.items()), "top long, above int")
    halo = dealt.join(F.broadcast(heads), F.col("ord") == F.col("top")).select(F.col("above").alias("part"), F.lit(True).alias("halo"), "ord", "text", "id")
    whole = dealt.select("part", F.lit(False).alias("halo"), "ord", "text", "id").unionByName(halo)
    return whole.repartition("part").sortWithinPartitions("part", "halo", F.desc("ord"), "text")


def compare_neighbours(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint, near_edited, near_next).

    ``edited`` is the text with its last third (floor of a third of the code points) replaced by as many first code points of its
    neighbour, or all of them. Each part streams through one task, two texts at a time."""
    spark = df.sparkSession
    small_batches(spark)
    ordered = in_order(df, id, text)
    kind = ordered.schema["id"].dataType
    fields = [("doc_id", kind.simpleString()), ("n_chars", "long"), ("edited", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("next_fingerprint", "string")]

    def run(batches):
        def pairs(rows):
            for _, group in groupby(rows, key=itemgetter(0)):
                before = None
                for _, halo, _, value, name in group:
                    here = (name, value or "", fingerprint(value))
                    if before is not None:
                        yield before, here
                    before = here
                    if halo:
                        break

        def made(rows):
            for (name, value, mark), (_, other, next_mark) in pairs(rows):
                cut = len(value) // 3
                edited = value[:len(value) - cut] + other[:cut]
                yield name, len(value), edited, mark, mark if edited == value else fingerprint(edited), next_mark

        names = None
        for batch in batches:
            names = names or pa.schema([("doc_id", batch.schema.field(4).type), ("n_chars", pa.int64()), *[(f, pa.string()) for f, _ in fields[2:]]])
            first = batch
            break
        else:
            return
        rows = (r for b in chain([first], batches) for r in zip(*(c.to_pylist() for c in b.columns)))
        yield from row_batches(made(rows), names, 256)

    out = ordered.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))
    return (out.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
            .withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint"))))
