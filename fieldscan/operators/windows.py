"""Ordered operators without feedback: window expressions by key and (t, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import wrap_pi


def by_time(key: str = "device_id"):
    return W.partitionBy(key).orderBy("t", "seq")


def before(df: DataFrame, names: list[str], bucket: float | None) -> DataFrame:
    """df with `_before`: the names of the row before, by device and time; null for the first. With a bucket, each bucket of so
    many seconds is walked by itself, and its first row takes the last row of the bucket before it, found among one row for
    each bucket: a busy device is many tasks then."""
    if bucket is None:
        return df.withColumn("_before", F.lag(F.struct(*names)).over(by_time()))
    cut = df.withColumn("_b", F.floor(F.col("t") / bucket))
    w = W.partitionBy("device_id", "_b").orderBy("t", "seq")
    last = cut.groupBy("device_id", "_b").agg(F.max_by(F.struct(*names), F.struct("t", "seq")).alias("_last"))
    last = last.select("device_id", "_b", F.lag("_last").over(W.partitionBy("device_id").orderBy("_b")).alias("_carried"))
    out = cut.withColumn("_own", F.lag(F.struct(*names)).over(w)).join(last, ["device_id", "_b"])
    return out.withColumn("_before", F.coalesce("_own", "_carried")).drop("_own", "_carried", "_b")


def running_sums(df: DataFrame, sums: dict[str, Column], bucket: float | None) -> DataFrame:
    """df with running sums by device and time. With a bucket, sums inside each bucket start from the sum of the buckets
    before it."""
    w = by_time().rowsBetween(W.unboundedPreceding, 0)
    if bucket is None:
        return df.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    cut = df.withColumns({"_b": F.floor(F.col("t") / bucket), **{f"_s_{name}": c for name, c in sums.items()}})
    earlier = W.partitionBy("device_id").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy("device_id", "_b").agg(*[F.sum(f"_s_{name}").alias(f"_t_{name}") for name in sums])
    totals = totals.select("device_id", "_b", *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0.0)).alias(f"_t_{name}") for name in sums])
    inside = W.partitionBy("device_id", "_b").orderBy("t", "seq").rowsBetween(W.unboundedPreceding, 0)
    out = cut.withColumns({name: F.sum(f"_s_{name}").over(inside) for name in sums}).join(totals, ["device_id", "_b"])
    return out.withColumns({name: F.col(name) + F.col(f"_t_{name}") for name in sums}).drop("_b", *[f"_{k}_{name}" for k in "st" for name in sums])


def dead_reckon(odom: DataFrame, bucket: float | None = None) -> DataFrame:
    """odom (device_id, t, seq, v, w) with theta, x, y: each step turns after it moves, so it moves by the heading before.
    bucket: as for running_sums."""
    out = before(odom, ["t"], bucket).withColumn("_dt", F.coalesce(F.col("t") - F.col("_before.t"), F.lit(0.0)))
    out = running_sums(out.drop("_before"), {"theta": F.col("w") * F.col("_dt")}, bucket)
    heading = F.col("theta") - F.col("w") * F.col("_dt") if bucket is not None else F.coalesce(F.lag("theta").over(by_time()), F.lit(0.0))
    out = out.withColumn("_heading", heading)
    return running_sums(out, {"x": F.col("v") * F.cos("_heading") * F.col("_dt"), "y": F.col("v") * F.sin("_heading") * F.col("_dt")}, bucket).drop("_dt", "_heading")


def yaw_rate(poses: DataFrame, limit: float) -> DataFrame:
    """Wrapped change of yaw over time for steps of 0.1 ms to 1 s, clamped; else 0."""
    w = by_time()
    dt = F.col("t") - F.lag("t").over(w)
    rate = wrap_pi(F.col("yaw") - F.lag("yaw").over(w)) / dt
    return poses.withColumn("yaw_rate", F.when((dt > 1e-4) & (dt < 1), F.greatest(F.lit(-limit), F.least(F.lit(limit), rate))).otherwise(0.0))


def path_length(poses: DataFrame, bucket: float | None = None) -> DataFrame:
    """(device_id, length_m, n) of poses (device_id, t, seq, x, y). bucket: as for before."""
    step = F.sqrt(F.pow(F.col("x") - F.col("_before.x"), 2) + F.pow(F.col("y") - F.col("_before.y"), 2))
    return before(poses, ["x", "y"], bucket).withColumn("_d", step).groupBy("device_id").agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length_m"), F.count("*").alias("n"))


def last_n(df: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("device_id").orderBy(F.desc("t"), F.desc("seq")))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def first_per_bucket(df: DataFrame, hz: float) -> DataFrame:
    """The first row of each key in every 1/hz seconds."""
    df = df.withColumn("_b", F.floor(F.col("t") * hz))
    return df.withColumn("_r", F.row_number().over(W.partitionBy("device_id", "_b").orderBy("t", "seq"))).where("_r = 1").drop("_r", "_b")


def time_regressions(df: DataFrame) -> DataFrame:
    """df in arrival order (seq) with `segment`, which rises where time steps back."""
    w = W.partitionBy("device_id").orderBy("seq")
    return df.withColumn("_s", F.coalesce((F.col("t") < F.lag("t").over(w)).cast("int"), F.lit(0))).withColumn("segment", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def counter_gaps(df: DataFrame, modulus: int = 65536) -> DataFrame:
    """Places where a counter is neither the same nor one more than before: (previous, current, expected)."""
    w = W.partitionBy("device_id").orderBy("seq")
    out = df.withColumn("previous", F.lag("counter").over(w)).withColumn("expected", (F.col("previous") + 1) % modulus)
    return out.where((F.col("counter") != F.col("expected")) & (F.col("counter") != F.col("previous")))


def gap_clusters(beams: DataFrame, gap: float, least: int) -> DataFrame:
    """Runs of beams (scan_id, beam, angle, range) whose neighbours lie within gap metres, of `least` beams or more: first
    beam, size, nearest range and centroid. A missing beam ends a run."""
    w = W.partitionBy("scan_id").orderBy("beam")
    xy = beams.withColumn("x", F.col("range") * F.cos("angle")).withColumn("y", F.col("range") * F.sin("angle"))
    far = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)) > gap
    new = (F.col("range").isNull() | F.lag("range").over(w).isNull() | far).cast("int")
    runs = xy.withColumn("_n", new).withColumn("_run", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).where("range IS NOT NULL")
    found = runs.groupBy("scan_id", "_run").agg(F.min("beam").alias("first_beam"), F.count("*").alias("n"), F.min("range").alias("nearest"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return found.where(F.col("n") >= least).drop("_run")


def nearest_obstacles(clusters: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("scan_id").orderBy("nearest", "first_beam"))
    return clusters.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("bearing", F.atan2("cy", "cx"))


def drop_repeats(points: DataFrame, key: str, order: list[str], eps: float = 1e-7) -> DataFrame:
    """Drops a point equal to the one before it in x, y and z."""
    w = W.partitionBy(key).orderBy(*order)
    same = [F.abs(F.col(c) - F.lag(c).over(w)) < eps for c in "xyz"]
    return points.withColumn("_same", F.coalesce(same[0] & same[1] & same[2], F.lit(False))).where("NOT _same").drop("_same")


def every_nth(points: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    return points.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_r") % n == 0).drop("_r")


def neighbour_geometry(points: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Planar range, and distance to the next point of the ring."""
    w = W.partitionBy(*key).orderBy(*order)
    step = sum((F.pow(F.lead(c).over(w) - F.col(c), 2) for c in "yz"), F.pow(F.lead("x").over(w) - F.col("x"), 2))
    return points.withColumn("planar_range", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).withColumn("next_distance", F.sqrt(step))


def shadow_filter_run(beams: DataFrame, n: int, d: float, near: float, far: float) -> DataFrame:
    """Beams of no n-run whose members stay within d of the run's first become missing; those nearer than near or farther
    than far stay as they are."""
    w = W.partitionBy("scan_id").orderBy("beam")
    ahead = w.rowsBetween(0, n - 1)
    spread = F.greatest(F.max("range").over(ahead) - F.col("range"), F.col("range") - F.min("range").over(ahead))
    full = (F.count("range").over(ahead) == n) & (spread < d)
    out = beams.withColumn("_ok", F.coalesce(full, F.lit(False)))
    covered = F.bool_or("_ok").over(w.rowsBetween(-(n - 1), 0))
    return out.withColumn("kept", F.when(covered | (F.col("range") < near) | (F.col("range") > far), F.col("range"))).drop("_ok")


def resample_scan(beams: DataFrame, n: int, beams_in: int) -> DataFrame:
    """Of the beams that fall nearest to each of n output angles, the one with the least error; empty bins are missing."""
    place = F.col("beam") * n / F.lit(float(beams_in))
    binned = beams.where("range IS NOT NULL").withColumn("bin", F.round(place).cast("int") % n).withColumn("_e", F.abs(place - F.round(place)))
    best = binned.groupBy("scan_id", "bin").agg(F.min_by("range", F.struct("_e", "beam")).alias("range"))
    bins = beams.select("scan_id").distinct().select("scan_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return bins.join(best, ["scan_id", "bin"], "left")


def limit_violations(commands: DataFrame, a_max: float, v_max: float) -> DataFrame:
    """Recorded speeds over v_max or with more than a_max of change a second for steps under a second; with the allowed value."""
    w = by_time()
    dt, before = F.col("t") - F.lag("t").over(w), F.lag("v").over(w)
    step = (dt > 0) & (dt < 1)
    low, high = F.when(step, before - a_max * dt).otherwise(-v_max), F.when(step, before + a_max * dt).otherwise(v_max)
    allowed = F.greatest(F.lit(-v_max), low, F.least(F.lit(v_max), high, F.col("v")))
    return commands.withColumn("allowed", allowed).where(F.abs(F.col("v") - F.col("allowed")) > 1e-9)


def rolling_median(df: DataFrame, n: int, value: str = "value") -> DataFrame:
    """Median of the last n readings of a channel that are not missing."""
    w = W.partitionBy("device_id", "channel").orderBy("t", "seq").rowsBetween(-(n - 1), 0)
    last = F.array_sort(F.collect_list(value).over(w))  # at most n values
    out = df.where(F.col(value).isNotNull()).withColumn("_last", last)
    low, high = F.expr("get(_last, (size(_last) - 1) div 2)"), F.expr("get(_last, size(_last) div 2)")
    return out.withColumn("median", (low + high) / 2).drop("_last")


def topic_rate(df: DataFrame, key: list[str]) -> DataFrame:
    """(n - 1) / span of each topic, 0 without a span."""
    span = F.max("t") - F.min("t")
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.when((F.count("*") > 1) & (span > 0), (F.count("*") - 1) / span).otherwise(0.0).alias("rate"))


def grouped_min(df: DataFrame, key: list[str | Column], groups: dict[str, list[str] | None]) -> DataFrame:
    """Per key the least value of each named group of channels, missing ones left out; None stands for all channels."""
    least = lambda channels: F.min("value") if channels is None else F.min(F.when(F.col("channel").isin(*channels), F.col("value")))
    return df.groupBy(*key).agg(*[least(channels).alias(name) for name, channels in groups.items()])


def frame_quality(df: DataFrame, modulus: int = 65536, well_formed: Column | None = None) -> DataFrame:
    """Per device its frames (seq, counter) and those whose counter is neither the last one's nor the next after it. With a column
    that tells well-formed frames, n counts them, `malformed` the others, and counters follow from one of them to the next."""
    ok = F.lit(True) if well_formed is None else F.coalesce(well_formed, F.lit(False))
    w = W.partitionBy("device_id", "_ok").orderBy("seq")
    step = (F.col("counter") - F.lag("counter").over(w) + modulus) % modulus
    odd = F.col("_ok") & F.coalesce((step != 0) & (step != 1), F.lit(False))
    out = df.withColumn("_ok", ok).withColumn("_odd", odd).groupBy("device_id")
    counts = [F.count_if("_ok").alias("n"), F.count_if("_odd").alias("anomalies")]
    return out.agg(*counts) if well_formed is None else out.agg(*counts, F.count_if(~F.col("_ok")).alias("malformed"))


def hold_values(df: DataFrame, hold: float, at: Column) -> DataFrame:
    """Last value of each (device_id, channel) at or before `at`, missing once hold seconds have passed."""
    last = df.where((F.col("t") <= at) & F.col("value").isNotNull()).groupBy("device_id", "channel").agg(F.max_by(F.struct("t", "value"), F.struct("t", "seq")).alias("p"))
    return last.select("device_id", "channel", F.when(at < F.col("p.t") + hold, F.col("p.value")).alias("value"))
