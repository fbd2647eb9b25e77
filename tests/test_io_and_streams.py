"""Readers, writers, snapshots and streams: restart, repeated batches, late rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators.cep import Pattern, Step, match_pattern
from marlstone.session import scratch
from marlstone.sources import snapshots as sn
from marlstone.sources.readers import jdbc_options, read_dataset, records_from_json
from marlstone.sources.writers import choose_partitioning, ingest_to_bronze, partition_names, write_table
from marlstone.streaming import jobs
from marlstone.streaming.sources import batch_writer, collected, file_stream, kafka_options, run_available

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, k string, ts timestamp, x double"


def part(spark, path, name, rows):
    spark.createDataFrame([(i, k, T0 + timedelta(seconds=s), x) for i, k, s, x in rows], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/p={name}")


def test_jdbc_and_topic_options():
    o = jdbc_options("jdbc:x", query="select 1", partition_column="id", lower=0, upper=9, partitions=3)
    assert o["dbtable"].startswith("(select 1)") and o["numPartitions"] == "3"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", table="t", partition_column="id")
    assert kafka_options("h:1", ["a", "b"])["subscribe"] == "a,b"


def test_write_modes_and_layout(spark):
    path = scratch(spark, "t")
    d = spark.range(5).withColumn("g", F.col("id") % 2)
    write_table(d, path, "create", ["g"])
    write_table(d, path, "append", ["g"])
    assert read_dataset(spark, path).count() == 10
    with pytest.raises(Exception):
        write_table(d, path, "create")
    with pytest.raises(ValueError):
        read_dataset(spark, path, "xml")
    b = ingest_to_bronze(d, scratch(spark, "bronze"), "t1")
    assert {"_ingestion_timestamp", "_tenant_id", "_source_file", "_record_hash"} <= set(b.columns)
    s = spark.createDataFrame([], "tenant_id string, created_at timestamp, user_id long").schema
    assert partition_names(s) == ["tenant_id", "_day", "_user_bucket"] and "_day" in choose_partitioning(s)


def test_json_payload_shapes(spark):
    d = spark.createDataFrame([(1, '[{"a":1},{"a":2}]'), (2, '{"data":[{"a":3}]}'), (3, '{"a":4}')], "i int, p string")
    assert sorted((r["i"], r["a"]) for r in records_from_json(d, "p", "struct<a:int>").collect()) == [(1, 1), (1, 2), (2, 3), (3, 4)]


def test_snapshots(spark):
    t = scratch(spark, "snap")
    for i, h in ((3, 1), (5, 2), (7, 3), (9, 4)):
        sn.publish(spark.range(i), t, at=f"2024-01-0{h} 00:00:00")
    assert sn.read(spark, t).count() == 9 and sn.read(spark, t, at="2024-01-02 12:00:00").count() == 5
    assert sn.rollback(spark, t, 2) == 5 and sn.read(spark, t).count() == 5
    assert sn.expire(spark, t, "2024-01-10 00:00:00", keep=1) == [4, 3, 1]  # version 2 is still referred to
    with pytest.raises(ValueError):
        sn.read(spark, t, 1)
    with pytest.raises(ValueError):
        sn.read(spark, scratch(spark, "none"))


def test_late_rows_are_dropped_and_restart_goes_on(spark):
    path, sink, state = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "state")
    part(spark, path, 0, [(1, "a", 0, 1.0), (2, "a", 30, 1.0)])
    part(spark, path, 1, [(3, "a", 600, 1.0)])

    def run():
        s = file_stream(spark, path + "/*", SCHEMA, max_files=1)
        run_available(jobs.windowed(s, "ts", ["k"], "1 minute", [F.count(F.lit(1)).alias("n")]), batch_writer(sink), "append", state)
        return sorted((r["window_start"], r["n"]) for r in spark.read.parquet(sink + "/batch=*").collect())

    assert run() == [(T0, 2)]
    part(spark, path, 2, [(4, "a", 10, 1.0)])  # behind the watermark
    part(spark, path, 3, [(5, "a", 1200, 1.0)])
    assert run() == [(T0, 2), (T0 + timedelta(seconds=600), 1)]


def test_upsert_writer_repeats_a_batch(spark):
    t = scratch(spark, "t")
    write = jobs.upsert_writer(t, ["k"], ["v"])
    write(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), 0)
    two = spark.createDataFrame([("a", 3), ("a", 2), ("c", 1)], "k string, v int")
    write(two, 1)
    write(two, 1)
    rows = lambda: sorted(tuple(r) for r in sn.read(spark, t).select("k", "v").collect())
    assert rows() == [("a", 3), ("b", 1), ("c", 1)]
    write(spark.createDataFrame([("d", 1)], "k string, v int"), 7)  # a gap, then a new stream on the old table
    write(spark.createDataFrame([("a", 9)], "k string, v int"), 0)
    assert rows() == [("a", 9), ("b", 1), ("c", 1), ("d", 1)]
    with pytest.raises(Exception):
        write(spark.createDataFrame([("a", "x")], "k string, v string"), 1)
    assert rows() == [("a", 9), ("b", 1), ("c", 1), ("d", 1)]


def test_two_writers_of_one_version_keep_both(spark):
    t = scratch(spark, "race")
    sn.publish(spark.range(3), t)
    spark.range(5).write.parquet(f"{t}/data/other")
    sn._log(spark, t, 2, "overwrite", folder="other")
    assert sn.publish(spark.range(7), t) == 3 and sn.read(spark, t, 2).count() == 5 and sn.read(spark, t).count() == 7


def test_silence_timer(spark):
    path = scratch(spark, "in")
    part(spark, path, 0, [(1, "a", 0, 1.0), (2, "b", 0, 1.0)])
    part(spark, path, 1, [(3, "b", 500, 1.0)])
    part(spark, path, 2, [(4, "b", 1000, 1.0)])
    s = file_stream(spark, path + "/*", SCHEMA, max_files=1)
    assert {r["k"] for r in collected(jobs.silences(s, "k", "ts", 300)).collect()} >= {"a"}


def test_pattern_stream_equals_batch_with_late_rows(spark):
    """Rows late inside the watermark take their place by time; a restart repeats nothing."""
    files = [[(1, "k", 0, 1.0), (2, "k", 8, 2.0), (10, "idle", 1, 1.0)], [(3, "k", 5, 2.0), (4, "k", 9, 1.0), (11, "idle", 3, 2.0)],
             [(5, "k", 12, 2.0), (6, "k", 12, 2.0)], [(7, "z", 300, 0.0)], [(8, "z", 600, 0.0)]]
    path, sink, state = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "state")
    p = Pattern("two steps", "low", 60, (Step("x = 1.0"), Step("x = 2.0")))

    def run():
        s = file_stream(spark, path + "/*", SCHEMA, max_files=1)
        run_available(jobs.pattern_stream(s, "k", "ts", "id", p), batch_writer(sink), "append", state)

    for n, rows in enumerate(files):
        part(spark, path, n, rows)
        if n in (1, 4):
            run()
    got = sorted((r["k"], r["start_id"], r["end_id"]) for r in spark.read.parquet(sink + "/batch=*").collect())
    every = spark.createDataFrame([(i, k, T0 + timedelta(seconds=s), x) for f in files for i, k, s, x in f], SCHEMA)
    want = sorted((r["k"], r["start_id"], r["end_id"]) for r in match_pattern(every, ["k"], "ts", "id", p).collect())
    assert got == want == [("idle", 10, 11), ("k", 1, 3), ("k", 4, 5)]


def test_capture_takes_late_and_repeated_changes(spark, tmp_path):
    from marlstone.streaming import capture
    root, tables = str(tmp_path / "captured"), {"a": ("id long, v string", ["id"]), "b": ("id long, v string", ["id"])}
    capture.take_snapshot({"a": (spark.createDataFrame([(1, "one"), (2, "two")], "id long, v string"), ["id"])}, root, 10)
    write = capture.capture_writer(root, tables)
    schema = "table string, op string, position long, before string, after string"
    change = lambda table, op, position, id, v: (table, op, position, *(f'{{"id":{id},"v":"{v}"}}' if (op == "DELETE") == gone else None for gone in (True, False)))
    first = [change("a", "UPDATE", 5, 1, "old"), change("a", "INSERT", 7, 9, "gone before"), change("a", "UPDATE", 13, 2, "later"), change("a", "DELETE", 15, 1, ""), change("b", "INSERT", 11, 1, "b"),
             change("c", "INSERT", 12, 1, "other")]
    second = [change("a", "UPDATE", 12, 2, "late"), change("a", "UPDATE", 14, 1, "late"), change("b", "DELETE", 16, 1, ""), change("a", "INSERT", 17, 3, "three")]
    for batch, rows in enumerate([first, second, first, second]):
        write(spark.createDataFrame(rows, schema), batch)
    assert sorted(tuple(r) for r in capture.captured(spark, root, "a").collect()) == [(2, "later"), (3, "three")]
    assert capture.captured(spark, root, "b").count() == 0 and sorted(r["id"] for r in capture.captured(spark, root, "a", version=1).collect()) == [1, 2]


def test_polls_go_on_from_their_mark(spark, tmp_path):
    from marlstone.streaming import capture
    sink, state = str(tmp_path / "sink"), str(tmp_path / "state")
    rows = lambda n: (lambda: spark.range(n).select("id", F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("at")))
    assert [capture.poll(spark, rows(n), "at", sink, state, settle="2 seconds") for n in (0, 5, 5, 9)] == [None, 1, None, 2]
    assert sorted((r["poll"], r["id"]) for r in spark.read.parquet(sink).collect()) == [(1, 0), (1, 1), (1, 2), (2, 3), (2, 4), (2, 5), (2, 6)]
    (tmp_path / "sink" / "poll=3").mkdir()
    assert capture.poll(spark, rows(12), "at", sink, state, settle="2 seconds") == 3  # a poll that broke off is done again


def test_parts_of_a_stream_are_written_by_many_tasks(spark):
    """each part of the captured log was written by one task."""
    from types import SimpleNamespace
    from marlstone.plans.streams import sliced_files
    rows = spark.range(900).select("id", F.timestamp_seconds("id").alias("ts"))
    path = sliced_files(SimpleNamespace(spark=spark), rows, "ts", each=4)
    got = spark.read.parquet(f"{path}/*").withColumn("file", F.input_file_name()).withColumn("part", F.regexp_extract("file", "part=([0-9])", 1))
    parts = {r["part"]: r for r in got.groupBy("part").agg(F.count_distinct("file").alias("files"), F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).collect()}
    assert [parts[p]["files"] for p in "012"] == [4, 4, 4] and sum(r["n"] for r in parts.values()) == 900
    assert parts["0"]["high"] < parts["1"]["low"] and parts["1"]["high"] < parts["2"]["low"]


def test_compaction_puts_whole_files_together(spark, tmp_path):
    from marlstone.sources.writers import _size, compact
    a, b, c = (str(tmp_path / x) for x in "abc")
    spark.range(4000).repartition(16).write.parquet(a)
    before = {r["id"]: r["f"] for r in spark.read.parquet(a).select("id", F.input_file_name().alias("f")).collect()}
    assert compact(spark, a, b, _size(spark, a) // 2 + 1) == 2
    after = {r["id"]: r["f"] for r in spark.read.parquet(b).select("id", F.input_file_name().alias("f")).collect()}
    assert after.keys() == before.keys() and len(set(after.values())) == 2
    assert len({(before[i], after[i]) for i in before}) == len(set(before.values()))  # no file was dealt out by rows
    assert compact(spark, b, c, _size(spark, b) // 9 + 1) == 9  # files larger than the target are
    out = spark.read.parquet(c).select("id", F.input_file_name().alias("f")).collect()
    assert {r["id"] for r in out} == before.keys() and len({r["f"] for r in out}) == 9


def test_pattern_stream_keeps_little_of_a_busy_key(spark):
    """The state of a key holds matches still open and rows ahead of the watermark, not the rows of the pattern's time; a batch agrees."""
    import numpy as np
    rng = np.random.default_rng(5)
    n, seen = 3000, []
    patterns = [Pattern("loose", "low", 900, (Step("x = 1.0"), Step("x = 2.0", 3))), Pattern("strict", "low", 900, (Step("x = 1.0", 2, True), Step("x = 2.0", strict=True), Step("x = 0.0", 2)))]
    times, kinds = np.sort(rng.integers(0, n // 2, n)), rng.choice([0.0, 1.0, 2.0], n)
    rows = [(i, "k" if i % 5 else "z", int(s), float(x)) for i, (s, x) in enumerate(zip(times, kinds))]
    rows[-300:-200] = [(i, "k", s, 0.0) for i, _, s, _ in rows[-300:-200]]
    path = scratch(spark, "in")
    for c in range(6):
        part(spark, path, c, rows[c * n // 6:(c + 1) * n // 6] + ([(n, "end", 4 * n, 0.0)] if c == 5 else []))
    s = file_stream(spark, path + "/*", SCHEMA, max_files=1)
    every = spark.createDataFrame([(i, k, T0 + timedelta(seconds=s), x) for i, k, s, x in rows], SCHEMA)
    for p in patterns:
        state = scratch(spark, "state")
        got = sorted((r["k"], r["start_id"], r["start_us"], r["end_id"], r["end_us"]) for r in collected(jobs.pattern_stream(s, "k", "ts", "id", p), checkpoint=state).collect())
        want = sorted((r["k"], r["start_id"], r["start_us"], r["end_id"], r["end_us"]) for r in match_pattern(every, ["k"], "ts", "id", p).collect())
        assert got == want and len(got) > 50
        held = spark.read.format("statestore").option("batchId", 5).load(state)
        seen.append(held.selectExpr("key.k", "length(to_json(value)) size").groupBy("k").agg({"size": "max"}).collect())
    # 500 rows a file lie ahead of the watermark, and 1800 lie within the time; a row had some 30 letters
    assert all(r[1] < 30_000 for rows in seen for r in rows)
