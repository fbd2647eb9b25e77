"""Arrow batches in and out of Python tasks, and column names that do not clash."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.session import ship_package

#: Rows per Arrow batch: whole texts travel in batches, so few rows keep a batch of long texts small.
ROWS_PER_BATCH = 512


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ROWS_PER_BATCH rows, so that a Python worker holds a bounded number of texts; the package goes along."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it until no column of ``df`` has it (letter case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def making_room(df: DataFrame, names: Iterable[str], *used: str) -> tuple[DataFrame, list[str]]:
    """``df`` with underscores before the columns that have one of the names of new columns, and what the ``used`` ones are called then."""
    new = {n.lower() for n in names}
    renamed = {c: fresh(df, c)[0] if c.lower() in new else c for c in df.columns}
    if any(a != b for a, b in renamed.items()):
        df = df.select(*[F.col(f"`{a}`").alias(b) for a, b in renamed.items()])
    return df, [renamed.get(c, c) for c in used]


def column(df: DataFrame, name: str):
    """The column of exactly this name, also if the name holds dots."""
    return df[f"`{name}`"]


def byte_list(values: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string array."""
    return values.cast(pa.binary() if values.type == pa.string() else pa.large_binary()).to_pylist()


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField],
                   make: Callable[[], Callable[..., list[pa.Array]]]) -> DataFrame:
    """``df`` with columns that a Python function computes batch by batch; nothing is shuffled.

    ``make()`` runs once per task and returns a function of the input arrays that gives one array per new field. A column of ``df``
    with the name of a new field comes back with underscores before its name.
    """
    df, inputs = making_room(df, [f.name for f in fields], *inputs)
    small_batches(df.sparkSession)
    schema = T.StructType(df.schema.fields + fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            new = work(*[batch.column(batch.schema.get_field_index(c)) for c in inputs])
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def row_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples packed into record batches of ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pack(held, schema)
            held = []
    if held:
        yield pack(held, schema)


def pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def fold(id_column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids have no fold."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus
