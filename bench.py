"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and once for the time, writing to the no-op sink so that every row is computed.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "src1_bronze_silver_gold_revenue", "flt1_filter_suffixes", "jon2_silver_join", "jon9_point_in_time", "jon11_interval_join", "jon17_or_join_as_union",
    "mrg1_upsert", "cdc3_apply_changes", "ded1_keep_none", "agg1_configured_group", "agg4_olap_cube", "agg12_ohlcv_bars", "agg24_running_user_stats",
    "win5_technical_indicators", "win21_latency_percentiles", "dq2_numeric_profile", "dq9_record_rules", "dq20_ks_drift", "ts2_linear_trend", "ts13_running_zscores",
    "gra8_degrees", "gra9_triangles_and_clustering", "rec1_item_recommendations", "sch1_exact_knn", "sch3_bm25", "sch10_chunks", "aml1_velocity",
    "cep1_velocity_check", "cep3_money_laundering", "sla1_violations", "ml5_federated_average", "str2_tumbling_windows", "str9_routed_outputs",
    "str7_keyed_state_scores", "cep_stream_account_takeover"]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    from marlstone.plans import ENTRIES

    times, rates = {}, {}
    for name in HEADLINE:
        run = lambda: ENTRIES[name](spark, path).write.format("noop").mode("overwrite").save()
        try:
            run()
            t0 = time.time()
            run()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # a failed query shows up as null instead of hiding the others
            print(f"{name}: {str(e)[:300]}", file=sys.stderr)
            times[name] = None
    events = spark.read.parquet(f"{path}/events.parquet").count()
    for rate, name in (("stream_events_per_sec", "str9_routed_outputs"), ("keyed_state_events_per_sec", "str7_keyed_state_scores"),
                       ("pattern_events_per_sec", "cep_stream_account_takeover")):
        if times.get(name):
            rates[rate] = round(events / times[name])
    total = round(sum(t for t in times.values() if t), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"), **rates}))


if __name__ == "__main__":
    main()
