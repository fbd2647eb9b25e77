"""Large files in byte ranges: split, map, ordered merge, and digests as a tree of blocks. No row holds a whole file."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlstone.session import cut_lineage, ship_package

#: Bytes a task holds at a time, bytes of a digest block, blocks under one node of the digest tree.
RANGE, BLOCK, FAN = 64 * 1024 * 1024, 1024 * 1024, 1024
#: Schemes of the stores whose ranges Arrow reads.
STORES = ("file", "hdfs", "s3", "s3a", "s3n", "gs", "abfs", "abfss")
#: Most tasks of one pass.
MAX_TASKS = 65_536


def _columns(schema: str) -> list[str]:
    return re.split(r",(?![^<]*>)", schema)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in _columns(schema)]


def split_files(spark: SparkSession, path: str, pattern: str = "*", size: int = RANGE) -> DataFrame:
    """One row per byte range: (path, bytes of the file, part, offset, length); an empty file has none, as Spark
    does not list it.

    Only names and lengths are listed. Ranges are dealt over tasks of about ``RANGE`` bytes, so a single large file is read by many.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path) \
        .select("path", F.col("length").alias("bytes")).filter("bytes > 0")
    last = (F.ceil(F.col("bytes") / size) - 1).cast("long")
    parts = files.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("offset", F.col("part") * size) \
        .withColumn("length", F.least(F.lit(size).cast("long"), F.col("bytes") - F.col("offset")))
    ranges, total = files.agg(F.sum(last + 1), F.sum("bytes")).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-(total or 0) // RANGE))  # small ranges share a task
    return parts.repartition(max(1, min(ranges or 1, tasks, MAX_TASKS)), "path", "part")


def _open(path: str):
    """The file and its place in the file system its scheme names: local, or any that Arrow knows (hdfs, s3, gs, abfs)."""
    from pyarrow import fs
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return fs.LocalFileSystem().open_input_file(re.sub(r"^/+", "/", rest or path))
    host, _, name = rest.lstrip("/").partition("/")
    system, base = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{host}")
    return system.open_input_file(f"{base.rstrip('/')}/{name}")


def read_range(path: str, offset: int, length: int) -> bytes:
    with _open(path) as f:
        data = f.read_at(length, offset)
    if len(data) != length:
        raise OSError(f"{path}: {len(data)} of {length} bytes at {offset}; the file changed while it was read")
    return data


def map_ranges(ranges: DataFrame, fn: Callable[[int, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn(offset, bytes)`` of every range: its rows of ``schema`` after (path, part)."""
    ship_package(ranges.sparkSession)
    names = _names(schema)

    def work(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                rows = list(fn(r.offset, read_range(r.path, r.offset, r.length)))
                if rows:
                    out = {n: pd.Series(list(v), dtype=object) for n, v in zip(names, zip(*rows))}
                    yield pd.DataFrame({"path": pd.Series([r.path] * len(rows), dtype=object), "part": np.full(len(rows), r.part), **out})

    return ranges.select("path", "part", "offset", "length").mapInPandas(work, f"path string, part long, {schema}")


def tree_digests(ranges: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(path, bytes, digest): SHA-256 of every ``block`` bytes, then of the joined hex digests of ``fan`` nodes, up to one root.

    The digest depends on the bytes and on ``block`` and ``fan`` only, not on the ranges, whose size has to be a multiple of
    ``block``.
    """
    bad = ranges.filter(F.col("offset") % block != 0).limit(1).count()
    if bad:
        raise ValueError(f"ranges have to start at multiples of {block} bytes")

    def leaves(offset, data):
        for i in range(0, len(data), block):
            yield (offset + i) // block, sha256(data[i:i + block]).hexdigest()

    nodes = map_ranges(ranges, leaves, "node long, digest string").drop("part")
    top = ((ranges.agg(F.max("bytes")).first()[0] or 0) - 1) // block
    while top > 0:
        # a file that is one node already keeps it
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        joined = nodes.groupBy("path", F.floor(F.col("node") / fan).alias("up")).agg(children.alias("c"))
        single = (F.col("up") == 0) & (F.size("c") == 1)
        nodes = joined.select("path", F.col("up").alias("node"), F.when(single, F.col("c")[0]["digest"]).otherwise(F.sha2(F.array_join("c.digest", ""), 256)).alias("digest"))
        top //= fan
    return nodes.drop("node").join(ranges.groupBy("path").agg(F.max("bytes").alias("bytes")), "path").select("path", "bytes", "digest")


def map_records(ranges: DataFrame, fn: Callable[[list[bytes]], Iterator[tuple]], schema: str, delimiter: bytes = b"\n") -> DataFrame:
    """Split, map, merge: rows (path, ...) of ``fn`` over the records of all files, whatever range a record lies in.

    A range maps the records that lie inside it, as one list, and passes on what is left at its two ends. Ends are put
    together in file order between one delimiter and the next, over any number of ranges, and mapped too. ``fn`` has to give
    rows that can be added up, as it sees a file in pieces. The bytes after the last delimiter are a record unless empty.
    """
    if len(delimiter) != 1:
        raise ValueError("the delimiter is one byte")
    names = _names(schema)
    row_type = ", ".join(c.strip().replace(" ", ":", 1) for c in _columns(schema))

    def split(_, data):
        head, found, rest = data.partition(delimiter)
        if not found:
            yield False, head, None, []
            return
        inner, more, tail = rest.rpartition(delimiter)
        whole = inner.split(delimiter) if more else []
        yield True, head, tail, [dict(zip(names, row)) for row in (fn(whole) if whole else ())]

    mapped = cut_lineage(map_ranges(ranges, split, f"closed boolean, head binary, tail binary, rows array<struct<{row_type}>>"))
    # record number of an end: delimiters met in earlier ranges; only flags pass the window, a row per range
    before = F.coalesce(F.sum(F.col("closed").cast("long")).over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = mapped.select("path", "part", "closed").withColumn("record", before).select("path", "part", "record")
    ends = mapped.select("path", "part", "head", "tail").join(order, ["path", "part"])
    pieces = ends.select("path", "record", "part", F.col("head").alias("piece")).unionByName(
        ends.filter("tail is not null").select("path", (F.col("record") + 1).alias("record"), "part", F.col("tail").alias("piece")))
    last = mapped.groupBy("path").agg(F.sum(F.col("closed").cast("long")).alias("last"))
    joined = pieces.groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("p")).join(last, "path") \
        .select("path", "record", "last", F.col("p.piece").alias("pieces"))

    def finish(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                whole = b"".join(r.pieces)
                if not whole and r.record == r.last:
                    continue
                rows = list(fn([whole]))
                if rows:
                    yield pd.DataFrame({"path": pd.Series([r.path] * len(rows), dtype=object), **{n: pd.Series(list(v), dtype=object) for n, v in zip(names, zip(*rows))}})

    return mapped.select("path", F.inline("rows")).unionByName(joined.mapInPandas(finish, f"path string, {schema}"))
