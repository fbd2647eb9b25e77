"""Agent features, flattened structs, and predictions of a stored pipeline."""

import math

from pyspark.sql import functions as F

from marlstone.operators import simulations as sim

XYZ = "struct<x:double,y:double,z:double>"
SCHEMA = f"sim long, agents array<struct<id:long,position:{XYZ},velocity:{XYZ}>>"


def test_agent_features(spark):
    p = lambda x, y, z: {"x": x, "y": y, "z": z}
    rows = [(1, [{"id": 1, "position": p(0.0, 1.0, 2.0), "velocity": p(3.0, 4.0, 0.0)}, {"id": 2, "position": p(2.0, 1.0, None), "velocity": p(0.0, 0.0, 1.0)}]),
            (1, [{"id": 3, "position": p(4.0, 1.0, 6.0), "velocity": None}]), (2, []), (3, None), (4, [{"id": 1, "position": None, "velocity": p(1.0, None, 1.0)}])]
    got = {r["sim"]: r for r in sim.agent_features(spark.createDataFrame(rows, SCHEMA), ["sim"]).collect()}
    assert (got[1]["avg_pos_x"], got[1]["avg_pos_z"], got[1]["std_pos_x"], got[1]["std_pos_y"], got[1]["max_speed"], got[1]["num_agents"]) == (2.0, 4.0, 2.0, 0.0, 5.0, 3)
    assert all(got[k]["num_agents"] == 0 and got[k]["max_speed"] is None for k in (2, 3))
    assert got[4]["num_agents"] == 1 and got[4]["avg_pos_x"] is None and got[4]["max_speed"] is None


def test_flat_features(spark):
    df = spark.createDataFrame([(1, {"gravity": 9.8, "friction": 0.1}), (2, None)], "sim long, parameters struct<gravity:double,friction:double>")
    got = sim.flat_features(df, ["sim"], {"parameters": ("param", ["gravity", "damping"])})
    assert [tuple(r) for r in got.orderBy("sim").collect()] == [(1, 9.8, None), (2, None, None)]


def test_batch_predictions_of_a_stored_pipeline(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), F.lit(1.0).alias("c"))
    df = df.withColumn("y", F.col("a") * 2 - F.col("b"))
    sim.fit_outcome(df, ["a", "b", "c"], "y", components=2).write().save(str(tmp_path / "model"))
    odd = spark.createDataFrame([(1000, None, 1.0, 1.0), (1001, float("nan"), 1.0, 1.0)], "id long, a double, b double, c double")
    rows = df.drop("y").unionByName(odd)
    for _ in range(2):  # a repeated run replaces its rows
        out = sim.batch_predict(spark, str(tmp_path / "model"), rows, str(tmp_path / "out"), ["id"])
    got = {r["id"]: r["prediction"] for r in out.collect()}
    assert len(got) == out.count() == 402 and got[1000] is None and got[1001] is None
    error = math.sqrt(sum((got[i] - ((i % 20) * 2 - i % 7)) ** 2 for i in range(400)) / 400)
    assert error < 2.5
