"""What the driver, a task or a shuffle holds must not follow the size of the tables."""

import pickle
import random

import pandas as pd

from fieldscan.operators import chunked, grid, points, sampling


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clusters_send_no_table_through_the_driver(spark, monkeypatch):
    rng, plans = random.Random(3), []
    rows = [(k % 3, k, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 1)) for k in range(150)]
    df = spark.createDataFrame(rows, "frame int, pid long, x double, y double, z double")
    kept = points.saved
    monkeypatch.setattr(points, "saved", lambda d: (plans.append(plan_of(d)), kept(d))[1])
    plans.append(plan_of(points.euclid_clusters(df, ["frame"], "pid", 1.0, 2)))
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_hulls_of_many_groups_take_few_frames(spark):
    """Groups in any order, cut by batches and tasks, against the same hulls of each group alone; one frame a batch, not a group."""
    rng = random.Random(8)
    rows = [(k % 40, float(rng.randint(0, 9)), float(rng.randint(0, 9))) for k in range(1_600)]
    df = spark.createDataFrame(rows, "k int, x double, y double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = points.convex_hull(df, ["k"], 300).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in {r[0] for r in rows}:
        own = sorted({(x, y) for g, x, y in rows if g == k})
        want = [own[i] for i in points.chain([p[0] for p in own], [p[1] for p in own], 0, len(own))]
        assert [(r.x, r.y) for r in sorted((r for r in got if r.k == k), key=lambda r: r.step)] == want
    plan = plan_of(points.convex_hull(df, ["k"]))
    assert "FlatMapGroups" not in plan and plan.count("MapInPandas") == 2


def test_short_chunks_go_together(spark, monkeypatch):
    """A frame for each batch, not for each chunk; and small functions, as there may be one for each row."""
    df = spark.createDataFrame([(k % 7, k * 3.0, k, 1.0) for k in range(700)], "device_id long, t double, seq long, value double")
    steps, kept = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda d, f, *a, **k: (steps.append(f), kept(d, f, *a, **k))[1])
    chunked.chunked_fold(df, ["device_id"], 2.0, chunked.LowPass(0.5, 3.0))
    rows = pd.DataFrame({"device_id": 1, "_chunk": range(500), "t": [2.0 * k for k in range(500)], "seq": range(500), "value": 1.0})
    frames = list(steps[0](iter([rows])))
    assert sum(map(len, frames)) == 500 and len(frames) <= 2
    assert len(pickle.dumps(chunked.Latches(0.8, 2.0, 2, 3).begin(), -1)) < 400


def test_cubic_queries_are_not_multiplied(spark):
    """Before the queries meet the cells nothing is exploded but places of corners, at most one a cell of the map."""
    g = grid.Geometry(8.0, 8.0, 1.0, 4.0, 4.0)
    cells = spark.createDataFrame([(i, j, float(i * j)) for i in range(8) for j in range(8)], "ix int, iy int, h double")
    q = spark.createDataFrame([(k, 0.5 + k % 7, 0.5 + k % 5) for k in range(2_000)], "query_id long, x double, y double")
    out = sampling.sample_cubic(cells, q, g, "h")
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("query_id") and not any("query_id" in line for line in tree.splitlines() if "Aggregate" in line or "Generate" in line)
    assert out.count() == 2_000 and out.where("value IS NULL").count() == 0


def test_start_radius_counts_no_level_twice(spark):
    """A coarse level that fits ends the search, and no point is multiplied by the levels."""
    df = spark.createDataFrame([(1, float(k % 30), float(k % 17), 0.0) for k in range(500)], "k int, x double, y double, z double")
    at = points.bounds_of(df)
    assert at == [(0.0, 29.0), (0.0, 16.0), (0.0, 0.0)] and points.start_radius(df, ["k"], 1_000, at) == 29.0
    asked = df.limit(9)
    few, all_ = (points.radius_join(asked, df, ["k"], 29.0, bounds=b) for b in (at, None))
    assert sorted(few.collect()) == sorted(all_.collect()) and few.count() > 0
