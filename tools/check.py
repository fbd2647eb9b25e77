"""Run registered queries and compare them with their SQL: ``check.py [--sf 0.01] [name-part ...]``."""

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, rel):
    risky = [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields
             if any(t in f.dataType.simpleString() for t in ("array", "map", "struct", "date", "timestamp", "decimal"))]
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(rel.columns, rel.fetchall())
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{f.name}:{f.dataType.simpleString()}/{types.get(f.name)}" for f in df.schema.fields
           if same.get(f.dataType.simpleString()) != types.get(f.name)]
    note = (f" types {odd}" if odd else "") + (f" risky {risky}" if risky else "")
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if got == want:
        return True, f"{len(got)} rows{note}" + (" EMPTY" if not got else "")
    extra = [r for r in got if r not in want][:3] if len(got) < 20000 else got[:2]
    missing = [r for r in want if r not in got][:3] if len(want) < 20000 else want[:2]
    return False, f"{len(got)} vs {len(want)} rows {sorted(df.columns)}\n   got  {extra}\n   want {missing}{note}"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--limit", type=int, default=90, help="seconds per query")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    path = f"/root/testdata/sf{a.sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    from marlstone.plans import ENTRIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    bad = []
    chosen = [e for n, e in ENTRIES.items() if not a.names or any(p in n for p in a.names)]
    import signal

    def late(*_):
        raise TimeoutError("query took too long")
    signal.signal(signal.SIGALRM, late)
    for e in chosen:
        t0 = time.time()
        signal.alarm(a.limit)
        try:
            df = e(spark, path)
            if e.sql:
                ok, note = compare(df, con.sql(e.sql))
            else:
                ok, note = True, f"{len(df.collect())} rows, no SQL"
        except Exception as ex:
            ok, note = False, (str(ex).split('== DataFrame')[0][:900] if os.environ.get("SHORT", "1") == "1" else traceback.format_exc())
        signal.alarm(0)
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - t0:5.1f}s {e.name}: {note}", flush=True)
        if not ok:
            bad.append(e.name)
    print(f"{len(chosen) - len(bad)} ok, {len(bad)} failed {bad}")


if __name__ == "__main__":
    main()
