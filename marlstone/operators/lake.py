"""Bronze, silver and gold steps: metadata columns, cleaning steps, rules and joins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import col, ladder, one_row
from marlstone.operators.windows import latest

STEPS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, fn: Callable[..., DataFrame] | None = None):
    """Add a named step ``fn(df, **params)``; usable as a decorator."""
    if fn is None:
        return lambda f: register(name, f)
    STEPS[name] = fn
    return fn


def run_steps(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Apply registered steps in order; an unknown name raises."""
    for name, params in steps:
        if name not in STEPS:
            raise KeyError(f"unknown step {name!r}")
        df = df.transform(STEPS[name], **params)
    return df


def to_bronze(df: DataFrame, tenant: str, source: str = "dataframe", at: Column | None = None) -> DataFrame:
    """Metadata columns and a record hash over the original columns."""
    return df.withColumns({
        "_ingestion_timestamp": at if at is not None else F.current_timestamp(),
        "_tenant_id": F.lit(tenant), "_source_file": F.lit(source),
        "_record_hash": F.xxhash64(*[F.col(c) for c in df.columns])})


def to_silver(df: DataFrame, version: str = "1.0", at: Column | None = None) -> DataFrame:
    return df.withColumns({
        "_silver_timestamp": at if at is not None else F.current_timestamp(),
        "_transformation_version": F.lit(version), "_quality_validated": F.lit(True)})


def to_gold(df: DataFrame, level: str, sources: list[str], at: Column | None = None) -> DataFrame:
    return df.withColumns({
        "_gold_timestamp": at if at is not None else F.current_timestamp(),
        "_aggregation_level": F.lit(level), "_source_datasets": F.lit(",".join(sources))})


@register("remove_nulls")
def remove_nulls(df: DataFrame, columns: list[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=columns)


@register("deduplicate")
def deduplicate(df: DataFrame, columns: list[str] | None = None, keep: str = "first",
                order_by: list[str] | None = None) -> DataFrame:
    """Keep the first or last row per key in ``order_by`` order, or none of the repeated ones.

    A key without an order is only accepted for whole-row duplicates, where the choice cannot matter.
    """
    if not columns or set(columns) == set(df.columns):
        if keep != "none":
            return df.dropDuplicates()
        columns = df.columns
    if keep == "none":
        rest = [c for c in df.columns if c not in columns]
        one = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
        return one.filter(F.col("_n") == 1).select(*df.columns)
    if not order_by:
        raise ValueError("order_by is needed to choose between rows of one key")
    order = [F.col(c).desc_nulls_last() if keep == "last" else F.col(c).asc_nulls_last() for c in order_by]
    return latest(df, columns, order)


@register("trim_strings")
def trim_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: F.trim(c) for c in names})


@register("standardize_dates")
def standardize_dates(df: DataFrame, columns: list[str], fmt: str = "yyyy-MM-dd",
                      inputs: tuple[str, ...] = ("yyyy-MM-dd",)) -> DataFrame:
    """First input format that parses, written in ``fmt``; null when none does."""
    return df.withColumns({c: F.date_format(F.coalesce(*[F.try_to_date(c, i) for i in inputs]), fmt)
                           for c in columns})


@register("add_columns")
def add_columns(df: DataFrame, computations: dict[str, str]) -> DataFrame:
    for name, expression in computations.items():
        df = df.withColumn(name, F.expr(expression))
    return df


@register("lookup")
def lookup(df: DataFrame, table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join with a lookup table; adaptive execution broadcasts it when it measures small."""
    return df.join(table.select(*keys, *columns), keys, "left")


@register("normalize")
def normalize(df: DataFrame, columns: list[str], method: str = "min_max") -> DataFrame:
    """Scaled copies ``{c}_normalized``; null for a constant column. One aggregate pass for all columns."""
    if method == "min_max":
        aggs = [a for c in columns for a in (F.min(c).alias(f"{c}_a"), (F.max(c) - F.min(c)).alias(f"{c}_b"))]
    else:
        aggs = [a for c in columns for a in (F.avg(c).alias(f"{c}_a"), F.stddev(c).alias(f"{c}_b"))]
    s = one_row(df.agg(*aggs))
    return df.withColumns({f"{c}_normalized": (F.col(c) - s[f"{c}_a"]) / F.nullif(s[f"{c}_b"], F.lit(0.0))
                           for c in columns})


def standard_name(name: str, case: str = "snake") -> str:
    if case == "snake":
        return re.sub(r"([A-Z]+)", r"_\1", name).lower().strip("_")
    head, *rest = name.split("_")
    if case == "camel":
        return head.lower() + "".join(p.capitalize() for p in rest)
    return "".join(p.capitalize() for p in (head, *rest))


@register("standardize_names")
def standardize_names(df: DataFrame, case: str = "snake") -> DataFrame:
    names = [standard_name(c, case) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide: {names}")
    return df.toDF(*names)


@register("rename")
def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


@register("cast")
def cast(df: DataFrame, types: dict[str, str], strict: bool = False) -> DataFrame:
    """Cast columns; unparsable values become null unless ``strict``."""
    return df.withColumns({c: F.col(c).cast(t) if strict else F.col(c).try_cast(t) for c, t in types.items()})


@register("categorize")
def categorize(df: DataFrame, out: str, cases: list[tuple[str, str]], otherwise: str = "Other") -> DataFrame:
    return df.withColumn(out, ladder([(F.expr(c), v) for c, v in cases], otherwise))


@register("filter")
def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    return df.filter(condition)


@register("validate")
def validate(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Row filters: not_null, range, pattern, custom, and unique (ordered by all columns)."""
    for r in rules:
        kind = r["type"]
        if kind == "not_null":
            df = df.dropna(subset=r["columns"])
        elif kind == "range":
            df = df.filter(col(r["column"]).between(r["min"], r["max"]))
        elif kind == "pattern":
            df = df.filter(col(r["column"]).rlike(r["pattern"]))
        elif kind == "custom":
            df = df.filter(r["condition"])
        elif kind == "unique":
            df = deduplicate(df, r["columns"], order_by=df.columns)
        else:
            raise ValueError(f"unknown rule {kind!r}")
    return df


AGGREGATES = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max,
              "collect_list": lambda c: F.array_sort(F.collect_list(c)),
              "collect_set": lambda c: F.array_sort(F.collect_set(c))}
_SUFFIX = {"collect_list": "list", "collect_set": "set"}


@register("aggregate")
def aggregate(df: DataFrame, group_by: list, aggregations: dict[str, list[str] | str]) -> DataFrame:
    """``{column: [functions]}`` with aliases ``{column}_{function}``.

    The collect functions hold a group in memory, as in Spark itself: use them on small groups.
    """
    exprs = [AGGREGATES[f](c).alias(f"{c}_{_SUFFIX.get(f, f)}")
             for c, fs in aggregations.items() for f in ([fs] if isinstance(fs, str) else fs)]
    return df.groupBy(*group_by).agg(*exprs) if group_by else df


@register("time_series")
def time_series(df: DataFrame, time_column: str, window: str, group_by: list[str],
                aggregations: dict[str, list[str] | str]) -> DataFrame:
    out = aggregate(df.withColumn("time_window", F.window(time_column, window)),
                    ["time_window", *group_by], aggregations)
    return out.withColumns({"window_start": F.col("time_window.start"),
                            "window_end": F.col("time_window.end")}).drop("time_window")


def join_datasets(datasets: list[tuple[str, DataFrame]], steps: list[dict]) -> DataFrame:
    """Left-deep join; non-key columns of each right side get its name (or ``right_prefix``) in front."""
    out = datasets[0][1]
    for (name, right), step in zip(datasets[1:], steps):
        keys = step["keys"]
        prefix = step.get("right_prefix", f"{name}_")
        right = right.withColumnsRenamed({c: f"{prefix}{c}" for c in right.columns if c not in keys})
        out = out.join(right, keys, step.get("type", "inner"))
    return out


def join_on(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
            how: str = "inner") -> DataFrame:
    """Join on differently named keys."""
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("left and right keys must be of the same, non-zero length")
    cond = None
    for a, b in zip(left_keys, right_keys):
        c = left[a] == right[b]
        cond = c if cond is None else cond & c
    return left.join(right, cond, how)


def gold_view(df: DataFrame, name: str, condition: str | None = None, columns: list[str] | None = None,
              global_view: bool = False) -> DataFrame:
    """Register a filtered projection as a view and return it."""
    out = df.filter(condition) if condition else df
    out = out.select(*columns) if columns else out
    (out.createOrReplaceGlobalTempView if global_view else out.createOrReplaceTempView)(name)
    return out
