"""Registered queries: a name, the inventory ids it covers, a plan over the tables, an SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import Tables


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, path: str) -> DataFrame:
        return self.build(Tables(spark, path))


ENTRIES: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register a plan; ``ids`` are inventory rows separated by spaces."""

    def register(build):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, tuple(ids.split()), build, sql)
        return build

    return register
