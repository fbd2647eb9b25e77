"""Files as rows: a manifest with size, digest and type by signature, and staged checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.columns import ladder
from marlstone.sources import ranges

#: Leading bytes (hex) by file type.
SIGNATURES = (("png", "89504E47"), ("jpeg", "FFD8FF"), ("pdf", "25504446"), ("zip", "504B0304"), ("gif", "47494638"), ("parquet", "50415231"))


def file_type(content: str | Column) -> Column:
    head = F.hex(F.substring(F.col(content) if isinstance(content, str) else content, 1, 8))
    return ladder([(head.startswith(sig), name) for name, sig in SIGNATURES], "unknown")


def file_manifest(spark: SparkSession, path: str, pattern: str = "*", whole: int = ranges.RANGE) -> DataFrame:
    """One row per file: path, size, digest and type.

    A file of at most ``whole`` bytes is read at once; its digest is the SHA-256 of its bytes. Larger ones are read in byte ranges by
    many tasks; their digest is ``tree:`` and :func:`ranges.tree_digests`, the same for the same bytes. Where only Hadoop knows the
    store, Arrow cannot read ranges and all files are read whole.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    digests = lambda d: d.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"), file_type("content").alias("file_type"))
    large = files.select("path", "length").filter(F.col("length") > whole)
    stores = {r[0] for r in large.select(F.substring_index("path", ":", 1)).distinct().collect()}  # schemes
    if not stores or not stores <= set(ranges.STORES):
        return digests(files)
    parts = ranges.split_files(spark, path, pattern).filter(F.col("bytes") > whole)
    heads = ranges.map_ranges(parts.filter("part = 0").withColumn("length", F.least("length", F.lit(8).cast("long"))), lambda _, data: [(data,)], "content binary")
    trees = ranges.tree_digests(parts).join(heads, "path").select("path", "bytes", F.concat(F.lit("tree:"), "digest").alias("digest"), file_type("content").alias("file_type"))
    return digests(files.filter(F.col("length") <= whole)).unionByName(trees)


def staged(manifest: DataFrame, allowed: list[str], max_bytes: int) -> DataFrame:
    """validate -> analyze -> package, as status columns; a failed stage skips the later ones."""
    valid = F.col("file_type").isin(allowed) & F.col("bytes").between(1, max_bytes)
    once = manifest.groupBy("digest").agg(F.min("path").alias("_first"))
    d = manifest.join(once, "digest").withColumn("validated", F.when(valid, "ok").otherwise("rejected"))
    d = d.withColumn("analyzed", F.when(F.col("validated") != "ok", "skipped").when(F.col("path") == F.col("_first"), "unique").otherwise("duplicate"))
    return d.withColumn("packaged", F.when(F.col("analyzed") == "unique", "ready").otherwise("skipped")).drop("_first")
