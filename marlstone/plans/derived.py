"""Frames that several queries derive from the tables, each with the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.columns import micros
from marlstone.session import Tables

#: Fixed reference moments in place of the current time, so that results can be compared.
EVENTS_NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "2001-08-02 00:00:00"


def n_rows():
    return F.count(F.lit(1))


def events_now():
    return F.lit(EVENTS_NOW).cast("timestamp_ntz")


def k_of(df):
    return F.get_json_object("props", "$.k").cast("int")


SQL_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def changes(t: Tables):
    """A change log keyed by user: error = DELETE, signup = INSERT, all else = UPDATE."""
    e = t.events
    op = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "signup", "INSERT") \
        .otherwise("UPDATE")
    row = F.struct("user_id", "event_type", "value")
    gone = op == "DELETE"
    return e.select("event_id", op.alias("op"), F.when(gone, F.struct("user_id")).alias("before"),
                    F.when(~gone, row).alias("after"), F.floor(micros("ts") / 1000).alias("ts_ms"))


CHANGES_SQL = """changes as (
  select event_id, case event_type when 'error' then 'DELETE' when 'signup' then 'INSERT' else 'UPDATE' end op,
         user_id, case when event_type <> 'error' then event_type end event_type,
         case when event_type <> 'error' then value end "value", epoch_us(ts) // 1000 ts_ms
  from events)"""


def trades(t: Tables):
    """Events as trades: instrument = event type, price = value, quantity = k + 1, side by id parity."""
    e = t.events
    return e.select(
        F.col("event_id").alias("trade_id"), F.col("event_type").alias("instrument"), "ts",
        F.col("value").alias("price"), (k_of(e) + 1).cast("double").alias("quantity"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.col("user_id").alias("trader"))


TRADES_SQL = f"""trades as (
  select event_id trade_id, event_type instrument, ts, value price, ({SQL_K} + 1)::DOUBLE quantity,
         case when event_id % 2 = 0 then 'buy' else 'sell' end side, user_id trader from events)"""


def daily(t: Tables):
    """One observation per event type and day: scaled mean value and event count.

    The factor keeps means off the decimal grid, where rounding for the comparison would meet ties.
    """
    return t.events.groupBy(F.col("event_type").alias("series"), F.date_trunc("day", "ts").alias("day")) \
        .agg((F.avg("value") * F.pi() / 3).alias("x"), F.count(F.lit(1)).alias("n"))


DAILY_SQL = """daily as (
  select event_type series, date_trunc('day', ts)::TIMESTAMP "day", avg(value) * pi() / 3 x, count(*) n
  from events group by all)"""


def hourly(t: Tables):
    return t.events.groupBy(F.col("event_type").alias("market"), F.date_trunc("hour", "ts").alias("ts")).agg(
        (F.avg("value") * F.pi() / 3).alias("price"), F.count(F.lit(1)).alias("trades"),
        (F.sum("value") * F.pi() / 3).alias("volume"), F.max("value").alias("high"), F.min("value").alias("low"))


HOURLY_SQL = """hourly as (
  select event_type market, date_trunc('hour', ts)::TIMESTAMP ts, avg(value) * pi() / 3 price, count(*) trades,
         sum(value) * pi() / 3 volume, max(value) high, min(value) low from events group by all)"""
