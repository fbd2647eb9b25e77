"""Fluent query builder: conditions become ``Column`` predicates, Catalyst does the rest."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import all_of, any_of, col

_COMPARE = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)), "nin": lambda c, v: ~c.isin(list(v)),
    "like": lambda c, v: c.like(v), "ilike": lambda c, v: c.ilike(v),
    "between": lambda c, v: c.between(v[0], v[1]),
    "isnull": lambda c, v: c.isNull(), "isnotnull": lambda c, v: c.isNotNull(),
}
_SYMBOLS = {"=": "eq", "==": "eq", "!=": "ne", "<>": "ne", ">": "gt", ">=": "gte", "<": "lt",
            "<=": "lte", "not in": "nin", "is null": "isnull", "is not null": "isnotnull"}


def predicate(name: str, op: str = "eq", value: Any = None) -> Column:
    """One condition; comparing with ``None`` means IS (NOT) NULL."""
    op = _SYMBOLS.get(op.lower(), op.lower())
    if op not in _COMPARE:
        raise ValueError(f"unknown operator {op!r}")
    if value is None and op in ("eq", "ne"):
        op = "isnull" if op == "eq" else "isnotnull"
    return _COMPARE[op](col(name), value)


def and_(*conds: Column) -> Column:
    return all_of(conds)


def or_(*conds: Column) -> Column:
    return any_of(conds)


@dataclass(frozen=True)
class Query:
    """Immutable builder over a DataFrame; ``to_df`` applies the clauses in SQL order."""

    source: DataFrame
    conditions: tuple = ()
    orders: tuple = ()
    joins: tuple = ()
    existence: tuple = ()
    groups: tuple = ()
    measures: tuple = ()
    having_conditions: tuple = ()
    fields: tuple = ()
    unique: bool = False
    count_limit: int | None = None
    skip: int | None = None

    def filter(self, **conds) -> "Query":
        """``field__op=value``; ``field__exists=(other, other_key)`` is a semi join."""
        out = self
        for key, value in conds.items():
            name, _, op = key.rpartition("__")
            name, op = (name, op) if name else (key, "eq")
            if op in ("exists", "notexists"):
                other, other_key = value
                how = "left_semi" if op == "exists" else "left_anti"
                out = replace(out, existence=(*out.existence, (name, other, other_key, how)))
            elif op in _COMPARE:
                out = replace(out, conditions=(*out.conditions, predicate(name, op, value)))
            else:  # a column whose own name holds a double underscore
                out = replace(out, conditions=(*out.conditions, predicate(key, "eq", value)))
        return out

    def where(self, name: str, op: str, value: Any = None) -> "Query":
        return replace(self, conditions=(*self.conditions, predicate(name, op, value)))

    def or_where(self, *conds: Column) -> "Query":
        return replace(self, conditions=(*self.conditions, or_(*conds)))

    def join(self, other: DataFrame, on, how: str = "inner") -> "Query":
        return replace(self, joins=(*self.joins, (other, on, how)))

    def group_by(self, *names: str) -> "Query":
        return replace(self, groups=(*self.groups, *names))

    def agg(self, **measures: Column) -> "Query":
        return replace(self, measures=(*self.measures, *(c.alias(n) for n, c in measures.items())))

    def having(self, name: str, op: str, value: Any = None) -> "Query":
        return replace(self, having_conditions=(*self.having_conditions, predicate(name, op, value)))

    def select(self, *names) -> "Query":
        return replace(self, fields=names)

    def distinct(self) -> "Query":
        return replace(self, unique=True)

    def order_by(self, name: str, direction: str = "asc") -> "Query":
        """Descending by ``"-field"`` or ``direction="desc"``; nulls last in both directions."""
        if name.startswith("-"):
            name, direction = name[1:], "desc"
        c = F.col(name)
        key = c.desc_nulls_last() if direction.lower().startswith(("desc", "-")) else c.asc_nulls_last()
        return replace(self, orders=(*self.orders, key))

    def limit(self, n: int) -> "Query":
        return replace(self, count_limit=n)

    def offset(self, n: int) -> "Query":
        return replace(self, skip=n)

    def page(self, number: int, size: int) -> "Query":
        return self.offset((number - 1) * size).limit(size)

    def to_df(self) -> DataFrame:
        df = self.source
        for other, on, how in self.joins:
            df = df.join(other, on, how)
        for c in self.conditions:
            df = df.filter(c)
        for name, other, other_key, how in self.existence:
            keys = other.select(col(other_key).alias("_exists_key"))
            df = df.join(keys, F.col(name) == F.col("_exists_key"), how)
        if self.groups or self.measures:
            df = df.groupBy(*self.groups).agg(*(self.measures or (F.count(F.lit(1)).alias("count"),)))
        for c in self.having_conditions:
            df = df.filter(c)
        if self.fields:
            df = df.select(*self.fields)
        if self.unique:
            df = df.distinct()
        if self.orders:
            df = df.orderBy(*self.orders)
        if self.skip:
            df = df.offset(self.skip)
        if self.count_limit is not None:
            df = df.limit(self.count_limit)
        return df


def route_predicate(filters: list[dict]) -> Column:
    """Routing filters on dotted paths; the conditions are AND-ed."""

    def one(f):
        c, v = F.col(f["field"]), f.get("value")
        text = F.coalesce(c.cast("string"), F.lit("None"))
        return {
            "equals": lambda: c.eqNullSafe(F.lit(v)), "not_equals": lambda: ~c.eqNullSafe(F.lit(v)),
            "in": lambda: F.coalesce(c.isin(list(v)), F.lit(False)),
            "not_in": lambda: ~F.coalesce(c.isin(list(v)), F.lit(False)),
            "contains": lambda: text.contains(v), "regex": lambda: text.rlike(f"^(?:{v})"),
            "exists": c.isNotNull, "not_exists": c.isNull,
        }[f["operator"]]()

    return all_of([one(f) for f in filters])


def split_by(df: DataFrame, routes: dict[str, str]) -> dict[str, DataFrame]:
    """Named outputs by SQL condition; a row may reach several of them."""
    return {name: df.filter(cond) for name, cond in routes.items()}


def routed(df: DataFrame, routes: dict[str, str], out: str = "route", default: str = "unrouted") -> DataFrame:
    """First matching route as a column, ready for ``partitionBy(route)`` on write."""
    expr = reduce(lambda acc, r: F.when(F.expr(r[1]), F.lit(r[0])).otherwise(acc),
                  reversed(list(routes.items())), F.lit(default))
    return df.withColumn(out, expr)


def describe(df: DataFrame) -> DataFrame:
    """Schema as rows: position, name, type, nullable."""
    cols = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                              F.lit(f.dataType.simpleString()).alias("data_type"))
                     for i, f in enumerate(df.schema.fields)])
    return df.sparkSession.range(1).select(F.inline(cols))
