"""Line deduplication by overlapping three-line windows, in DataFrame functions only.

Every run of ``WINDOW`` consecutive lines of a document is hashed. A window whose lines also start earlier (smaller id, or the
same document further up) is a repeat; the line positions that repeats cover are merged and cut out. Windows are judged on the
input, not on what is left. A document is an id and the hash of its text.

Rows: a null text has no lines and stays null; an empty text is one empty line; documents of fewer lines than the window are left
alone, and a document whose lines all go keeps an empty text. Rows without an id are neither changed nor counted as earlier. Equal
texts of one id are one document: such rows get equal results, and neither repeats the other. Different texts of one id are
documents of their own, in the order of their hashes. An input column with the name of a result column comes back with underscores
before its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import column, fresh, making_room
from marlstone.session import cut_lineage

WINDOW = 3


def line_windows(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, version, start, key): the 128-bit hash of each window of consecutive lines; ``start`` counts from 0, ``version`` is the hash of the text."""
    lines = (df.select(column(df, id).alias("id"), F.xxhash64(column(df, text)).alias("version"), F.split(column(df, text), "\n").alias("lines"))
             .filter(F.col("id").isNotNull() & (F.size("lines") >= window)))
    starts = F.sequence(F.lit(0), F.size("lines") - window)
    keys = F.transform(starts, lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, window), "\n").cast("binary"))))
    return lines.select("id", "version", F.posexplode(keys).alias("start", "key"))


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(id, version, start) of every window that is a later occurrence. A window's first place is aggregated before the shuffle; only
    windows seen twice are joined back, and both sides of that join are plain shuffles, so a frequent window can be split."""
    place = F.struct("id", "version", "start")
    first = windows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    known = cut_lineage(first.filter("first <> last").select(F.col("key").alias("known"), "first"))
    return windows.join(known, F.col("key") == F.col("known")).filter(place > F.col("first")).select("id", "version", "start")


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW,
                names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``df`` with repeated lines cut out of its text, and two new columns: lines before, and lines removed."""
    df, (id, text) = making_room(df, names, id, text)
    key, version, starts, lines = fresh(df, "window_id", "window_version", "window_starts", "text_lines")
    cuts = (repeated_windows(line_windows(df, id, text, window)).groupBy(F.col("id").alias(key), F.col("version").alias(version))
            .agg(F.array_sort(F.collect_set("start")).alias(starts)))
    joined = (df.join(cuts, (column(df, id) == F.col(key)) & (F.xxhash64(column(df, text)) == F.col(version)), "left")
              .withColumn(lines, F.split(F.col(f"`{text}`"), "\n")))

    def gap(i):
        """The lines between the end of the cut before and the next cut; equal lengths make sorted starts enough."""
        begin = F.coalesce(F.get(starts, i - 1) + window, F.lit(0))
        end = F.coalesce(F.get(starts, i), F.size(lines))
        return F.slice(F.col(lines), begin + 1, F.greatest(end - begin, F.lit(0)))

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), gap))
    out = joined.withColumn(lines, F.struct(F.col(lines).alias("all"), F.when(F.col(starts).isNull(), F.col(lines)).otherwise(kept).alias("kept")))
    clean = F.when(F.col(starts).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(f"{lines}.kept", "\n"))
    n = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(f"{lines}.all"))
    left = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(f"{lines}.kept"))
    return out.select(*[(clean.alias(c) if c == text else F.col(f"`{c}`")) for c in df.columns],
                      n.cast("long").alias(names[0]), (n - left).cast("long").alias(names[1]))
