"""Chunked filters against the walk over whole keys."""

import random

import pytest

from fieldscan.operators import chunked, fold

SCHEMA = "device_id long, t double, seq long, value double"


def record(rng, n):
    rows, t = [], 0.0
    for k in range(n):
        t += rng.choice((0.0, 0.03, 0.2, 0.3, 0.3, 5.0))
        rows.append((1 + (k % 50 == 0), round(t, 3), k, rng.choice((None, 0.2, 0.5, 1.0, 1.5, 3.0, 4.0))))
    return rows


RULES = {
    "latches": (chunked.Latches(0.8, 2.0, 2, 3), ["value"], fold.debounce_step(0.8, 2.0, 2, 3)),
    "low pass": (chunked.LowPass(0.5, 3.0), ["value"], fold.low_pass_step(0.5, 3.0)),
    "sample": (chunked.Sample(0.7), [], fold.sample_step(0.7)),
}


@pytest.mark.parametrize("name", RULES)
@pytest.mark.parametrize("chunk", [0.5, 20.0])
def test_chunks_give_what_the_walk_gives(spark, name, chunk):
    rule, columns, walk = RULES[name]
    df = spark.createDataFrame(record(random.Random(5), 900), SCHEMA)
    got = chunked.chunked_fold(df, ["device_id"], chunk, rule)
    want = fold.ordered_fold(df, ["device_id"], columns, rule.out, *walk)
    clean = lambda rows: sorted((r.device_id, r.seq, *[round(v, 9) if isinstance(v, float) else v for v in tuple(r)[3:]]) for r in rows)
    assert clean(got.collect()) == clean(want.collect())
    assert chunked.chunked_fold(df.limit(0), ["device_id"], chunk, rule).count() == 0


def test_one_key_runs_in_many_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(7, k * 0.1, k, 1.0) for k in range(4_000)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = chunked.chunked_fold(df, ["device_id"], 10.0, RULES["low pass"][0]).withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sample_functions_stay_small():
    rule = chunked.Sample(2.0)
    f = rule.begin()
    for k in range(5_000):
        f = rule.absorb(f, {"t": k * 0.1})
    assert len(f) <= 7


def test_sample_keeps_a_row_long_after_an_early_one(spark):
    df = spark.createDataFrame([(1, t, k, 1.0) for k, t in enumerate((9.5, 10.0, 15.0, 15.2, 29.0))], SCHEMA)
    kept = {r.seq for r in chunked.chunked_fold(df, ["device_id"], 10.0, chunked.Sample(0.5)).where("kept").collect()}
    assert kept == {0, 2, 4}
