"""Upsert, change data capture, time travel and schema evolution as DataFrame algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.columns import any_of, col, micros


def _missing_as_null(df: DataFrame, like: DataFrame, columns: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in like.schema.fields}
    have = set(df.columns)
    return df.withColumns({c: F.lit(None).cast(types[c]) for c in columns if c not in have}) \
        if any(c not in have for c in columns) else df


def upsert(target: DataFrame, source: DataFrame, keys: list[str],
           update_columns: list[str] | None = None) -> DataFrame:
    """Update matched keys, insert new ones, add columns that only the source has.

    Both sides must be unique on the keys. One full outer join; presence flags decide which side counts,
    so a null in the source does overwrite.
    """
    columns = [*target.columns, *[c for c in source.columns if c not in target.columns]]
    payload = [c for c in columns if c not in keys]
    updated = set(update_columns) if update_columns is not None else set(source.columns)
    t = _missing_as_null(target, source, payload).select(
        *[F.col(k).alias(f"t_{k}") for k in keys], F.struct(*payload).alias("t"), F.lit(True).alias("in_t"))
    have = set(source.columns)
    s = _missing_as_null(source, target, payload).select(
        *[F.col(k).alias(f"s_{k}") for k in keys], F.struct(*payload).alias("s"), F.lit(True).alias("in_s"))
    on = None
    for k in keys:
        c = F.col(f"t_{k}") == F.col(f"s_{k}")
        on = c if on is None else on & c
    joined = t.join(s, on, "full_outer")

    def value(c):
        if c not in have:
            return F.col(f"t.{c}")
        if c not in updated:  # inserted rows still take every source column
            return F.when(F.col("in_t"), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))
        return F.when(F.col("in_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))

    return joined.select(*[F.coalesce(f"t_{k}", f"s_{k}").alias(k) for k in keys],
                         *[value(c).alias(c) for c in payload])


def merge_gold(target: DataFrame, source: DataFrame, strategy: str, keys: list[str] | None = None) -> DataFrame:
    if strategy == "update":
        return upsert(target, source, keys or [])
    if strategy == "append":
        return target.unionByName(source, allowMissingColumns=True)
    if strategy == "replace":
        return source
    raise ValueError(f"unknown strategy {strategy!r}")


def delete_where(df: DataFrame, condition: str | Column) -> DataFrame:
    """Rows whose condition is not true (null keeps the row, as in SQL DELETE)."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return df.filter(~F.coalesce(c, F.lit(False)))


def update_where(df: DataFrame, condition: str | Column, values: dict[str, Column]) -> DataFrame:
    c = F.expr(condition) if isinstance(condition, str) else condition
    return df.withColumns({n: F.when(c, v).otherwise(F.col(n)) for n, v in values.items()})


def project_changes(changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Flat change rows: the key of a DELETE comes from ``before``, everything else from ``after``."""
    return changes.select(
        F.col("op").alias("operation"),
        F.when(F.col("op") == "DELETE", F.col(f"before.{key}")).otherwise(F.col(f"after.{key}")).alias(key),
        *[F.col(f"after.{c}").alias(c) for c in columns], F.col("ts_ms").alias("event_timestamp"))


def upserts_only(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("op").isin("INSERT", "UPDATE"))


def apply_changes(log: DataFrame, keys: list[str], order: list[str], op: str = "operation") -> DataFrame:
    """State after a change log: newest row per key, deleted keys dropped.

    ``max_by`` aggregates map-side, so a key with many changes costs one row per map task.
    """
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"))
    return newest.filter(F.col(f"s.{op}") != "DELETE").select(*keys, "s.*")


def as_of(log: DataFrame, keys: list[str], order: list[str], at: Column, ts: str, op: str = "operation") -> DataFrame:
    """Time travel over a change log: the state at ``at``."""
    return apply_changes(log.filter(F.col(ts) <= at), keys, order, op)


def history(log: DataFrame, keys: list[str], ts: str, ties: list[str]) -> DataFrame:
    """Validity intervals per key: ``valid_to`` is the next change of the key, null for the open row."""
    from marlstone.operators.windows import rows_frame
    return rows_frame(log, keys, ts, ties, lambda w: {"valid_to": F.lead(ts).over(w)}, after=1,
                      slice_seconds=30 * 86_400).withColumnRenamed(ts, "valid_from")


def version_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its status: added, removed, changed or same."""
    rest = [c for c in new.columns if c not in keys]
    a = old.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.struct(*rest).alias("a"))
    b = new.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.struct(*rest).alias("b"))
    on = None
    for k in keys:
        c = F.col(f"a_{k}") == F.col(f"b_{k}")
        on = c if on is None else on & c
    status = (F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
              .when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed"))
    return a.join(b, on, "full_outer").select(
        *[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], status.alias("status"))


def evolve(df: DataFrame, add: dict[str, str] | None = None, rename: dict[str, str] | None = None,
           drop: list[str] | None = None) -> DataFrame:
    """Add typed null columns, rename, drop."""
    out = df.withColumns({n: F.lit(None).cast(t) for n, t in (add or {}).items()}) if add else df
    return out.withColumnsRenamed(rename or {}).drop(*(drop or []))


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and retyped columns as rows; reads schemas only."""
    a = {f.name: f.dataType.simpleString() for f in old.schema.fields}
    b = {f.name: f.dataType.simpleString() for f in new.schema.fields}
    rows = [(n, "added", None, b[n]) for n in b if n not in a]
    rows += [(n, "removed", a[n], None) for n in a if n not in b]
    rows += [(n, "type_changed", a[n], b[n]) for n in a if n in b and a[n] != b[n]]
    return new.sparkSession.createDataFrame(
        rows, "column_name string, change string, old_type string, new_type string")


def expire(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Retention: keep rows not older than ``days``."""
    return df.filter(F.col(ts) >= now - F.make_interval(days=F.lit(days)))


def archive_candidates(df: DataFrame, keys: list[str], ts: str, now: Column, days: int) -> DataFrame:
    """Keys whose newest access is older than ``days``."""
    return (df.groupBy(*keys).agg(F.max(ts).alias("last_access"), F.count(F.lit(1)).alias("accesses"))
            .filter(F.col("last_access") < now - F.make_interval(days=F.lit(days))))
