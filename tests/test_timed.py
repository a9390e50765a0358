"""Streams with deadlines and late rows against their batch forms: replays cut at random places, in random order within the
lateness, in many micro-batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fieldscan.operators import fold, health, timejoin
from fieldscan.streaming import timed

LATE = 2.0


def replay(spark, folder, rows, schema, make, name, seed=1, batches=6):
    """Rows in order of an arrival up to LATE seconds after their time, cut into batches; a far row of another key lets the
    watermark pass them all."""
    rng = random.Random(seed)
    columns = [c.split()[0] for c in schema.split(",")]
    t = columns.index("t")
    arriving = sorted(rows, key=lambda r: r[t] + rng.uniform(0, LATE * 0.95))
    cuts = sorted(rng.sample(range(1, len(arriving)), batches - 1))
    parts = [arriving[a:b] for a, b in zip([0, *cuts], [*cuts, len(arriving)], strict=True)]
    far = list(rows[0])
    far[0], far[t] = -1, 1e5
    parts += [[tuple(far)], [tuple(far)]]
    os.makedirs(folder / "in")
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
        df.coalesce(1).write.parquet(str(folder / f"part{k}"))
        file = next(f for f in os.listdir(folder / f"part{k}") if f.endswith(".parquet"))
        os.rename(folder / f"part{k}" / file, folder / "in" / f"{k:03}.parquet")
        os.utime(folder / "in" / f"{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).where("device_id >= 0").collect()]


def batch(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def same(got, want):
    clean = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert clean(got) == clean(want)


def times(rng, n, step=0.37):
    t, out = 1.0, []  # the watermark starts at 0
    for _ in range(n):
        t += rng.choice((0.0, step, step, step * 4))
        out.append(round(t, 3))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hold(spark, tmp_path, seed):
    rng, schema = random.Random(seed), "device_id long, channel string, t double, seq long, value double"
    rows = [(d, c, t, k, rng.choice((None, 1.0, 2.5))) for d in (1, 2) for c in "ab" for k, t in enumerate(times(rng, 25))]
    got = replay(spark, tmp_path, rows, schema, lambda s: timed.stream_hold(s, 0.8, f"{LATE} seconds"), f"hold{seed}", seed)
    want = [tuple(r) for r in health.hold_events(batch(spark, rows, schema), ["device_id", "channel"], 0.8).collect()]
    same(got, want)
    assert any(r[3] is None for r in got)  # silence gave rows


def test_health_times_out_while_nothing_comes(spark, tmp_path):
    rng, schema = random.Random(3), "device_id long, topic string, t double, seq long"
    rows = [(d, rng.choice(("command", "odometry", "scan", "other")), t, k) for d in (1, 2) for k, t in enumerate(times(rng, 40))]
    rows += [(3, topic, 1.0, k) for k, topic in enumerate(("command", "odometry", "scan"))]
    limits = {"command": 0.9, "odometry": 1.7, "scan": 1.7, "other": 0.0}
    got = replay(spark, tmp_path, rows, schema, lambda s: timed.stream_health(s, limits, f"{LATE} seconds"), "health_live")
    want = [tuple(r) for r in health.health_changes(batch(spark, rows, schema), ["device_id"], limits).collect()]
    same(got, want)
    alone = sorted(((r[1], r[3]) for r in got if r[0] == 3 and r[1] > 1.0))
    assert alone == [(1.9, "command_timeout")]  # device 3 fell silent after one moment


def test_stale_source(spark, tmp_path):
    schema = "device_id long, t double, seq long"
    rows = [(1, t, k) for k, t in enumerate((0.5, 1.0, 4.0, 4.2))]
    got = replay(spark, tmp_path, rows, schema, lambda s: timed.stream_stale(s, 1.0, f"{LATE} seconds"), "stale_live", batches=3)
    assert sorted((r[1], r[3]) for r in got) == [(0.5, True), (2.0, False), (4.0, True), (5.2, False)]


@pytest.mark.parametrize("seed", [5, 6])
def test_sync_uses_each_message_once(spark, tmp_path, seed):
    rng, schema = random.Random(seed), "device_id long, t double, seq long, side int"
    rows = [(d, t, 100 * side + k, side) for d in (1, 2) for side in (0, 1) for k, t in enumerate(times(rng, 30, 0.21))]
    make = lambda s: timed.stream_sync(s.where("side = 0"), s.where("side = 1"), 0.25, f"{LATE} seconds")
    got = replay(spark, tmp_path, rows, schema, make, f"sync{seed}", seed)
    df = batch(spark, rows, schema)
    want = [tuple(r) for r in timejoin.nearest_time_join(df.where("side = 0").drop("side"), df.where("side = 1").drop("side"), ["device_id"], 0.25).collect()]
    same(got, want)
    assert got and len({(r[0], r[1]) for r in got}) == len({(r[0], r[2]) for r in got}) == len(got)


def test_sync_forgets_what_is_past():
    walk = timed.sync_walk(0.5)
    state = walk.init()
    for k in range(500):
        state, _ = walk.step(state, {"t": k * 0.1, "seq": k, "side": 1})
    assert len(state[0][1]) <= 12 and walk.due(state) is None


@pytest.mark.parametrize("seed", [8, 9])
def test_filter_over_late_rows(spark, tmp_path, seed):
    rng, schema = random.Random(seed), "device_id long, channel string, t double, seq long, value double"
    rows = [(d, "a", t, k, rng.choice((None, 0.5, 1.5, 2.0, 5.0))) for d in (1, 2) for k, t in enumerate(times(rng, 40))]
    got = replay(spark, tmp_path, rows, schema, lambda s: timed.stream_filter(s, 3, 2.5, 1.0, 3.0, 2, 2, f"{LATE} seconds"), f"filter{seed}", seed)
    key = ["device_id", "channel"]
    median = fold.ordered_fold(batch(spark, rows, schema), key, ["value"], "filtered double", *fold.median_step(3, 2.5))
    flags = fold.ordered_fold(median.withColumnRenamed("filtered", "value"), key, ["value"], "danger boolean, warn boolean", *fold.debounce_step(1.0, 3.0, 2, 2))
    want = [tuple(r) for r in median.join(flags, [*key, "t", "seq"]).select(*key, "t", "seq", "filtered", "danger", "warn").collect()]
    same(got, want)


def test_tracks_over_late_rows(spark, tmp_path):
    rng, schema = random.Random(11), "device_id long, t double, seq long, x double, y double"
    rows = [(d, t, k, round(rng.uniform(0, 4), 3), round(rng.uniform(0, 4), 3)) for d in (1, 2) for k, t in enumerate(times(rng, 30))]
    got = replay(spark, tmp_path, rows, schema, lambda s: timed.stream_tracks(s, 1.0, 1.5, f"{LATE} seconds"), "tracks_live")
    want = [tuple(r) for r in fold.ordered_fold(batch(spark, rows, schema), ["device_id"], ["x", "y"], "track long", *fold.track_step(1.0, 1.5)).collect()]
    same(got, want)
