"""What recordings tell about a run: verdicts, stale sources, timings, plans, starts at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timejoin import asof_join


def pipeline_verdict(df: DataFrame, key: list[str], checks: list[tuple[str, str]]) -> DataFrame:
    """(key, verdict): of checks (flag column, verdict without it), the verdict of the first flag that no row of a key sets;
    else ok."""
    flags = df.groupBy(*key).agg(*[F.coalesce(F.bool_or(flag), F.lit(False)).alias(f"_{k}") for k, (flag, _) in enumerate(checks)])
    verdict = F.lit("ok")
    for k in range(len(checks) - 1, -1, -1):
        verdict = F.when(~F.col(f"_{k}"), checks[k][1]).otherwise(verdict)
    return flags.select(*key, verdict.alias("verdict"))


def fresh(df: DataFrame, max_age: float, max_future: float = 0.0, keep_unstamped: bool = False) -> DataFrame:
    """Messages (t, recv_t) received at most max_age seconds after their time and at most max_future before it; those without a
    time, 0 or null, go or stay by the flag."""
    stamped, age = F.coalesce(F.col("t") != 0, F.lit(False)), F.col("recv_t") - F.col("t")
    return df.where((stamped & (age >= -max_future) & (age <= max_age)) | (~stamped & F.lit(keep_unstamped)))


def source_current(times: DataFrame, received: DataFrame, key: list[str], timeout: float) -> DataFrame:
    """times (key, t, seq) with `current`: whether something was received at most timeout seconds before. A timeout of 0
    never ends; without any reception a source is stale."""
    if timeout <= 0:
        return times.withColumn("current", F.lit(True))
    found = asof_join(times, received, key, [], max_age=timeout)
    return found.withColumn("current", F.col("prev_t").isNotNull()).drop("prev_t")


def stage_timings(log: DataFrame, key: list[str], stages: list[str]) -> DataFrame:
    """(key, stage, mean, p95, n) of a log with one column of seconds for each stage of processing."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("seconds")) for s in stages]))
    long = log.select(*key, pairs.alias("_p")).select(*key, "_p.*")
    return long.groupBy(*key, "stage").agg(F.avg("seconds").alias("mean"), F.percentile("seconds", 0.95).alias("p95"), F.count("seconds").alias("n"))


def plan_endpoint_distance(plans: DataFrame, poses: DataFrame, key: list[str]) -> DataFrame:
    """(key, plan, t, distance) from the last pose of each plan (key, plan, t, idx, x, y) to where the robot was at t."""
    last = plans.groupBy(*key, "plan", "t").agg(F.max_by(F.struct("x", "y"), "idx").alias("_e")).withColumn("seq", F.col("plan").cast("long"))
    found = asof_join(last, poses, key, ["x", "y"])
    dx, dy = F.col("_e.x") - F.col("prev_x"), F.col("_e.y") - F.col("prev_y")
    return found.select(*key, "plan", "t", F.sqrt(dx * dx + dy * dy).alias("distance"))


def imu_init_stats(df: DataFrame, key: list[str], n: int, gravity: float = 9.81) -> DataFrame:
    """Means and population variances of the first n readings (t, seq, ax, ay, az, gx, gy, gz) of a key, and the direction of
    gravity, against the mean acceleration; null where that is zero."""
    first = df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy("t", "seq"))).where(F.col("_r") <= n)
    names = ("ax", "ay", "az", "gx", "gy", "gz")
    out = first.groupBy(*key).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in names], *[F.var_pop(c).alias(f"var_{c}") for c in names])
    norm = F.sqrt(sum(F.col(f"mean_{c}") * F.col(f"mean_{c}") for c in names[:3]))
    return out.withColumns({f"gravity_{c[1]}": F.when(norm > 0, -F.col(f"mean_{c}") / norm * gravity) for c in names[:3]})


def clusters_by_size(clusters: DataFrame, key: str) -> DataFrame:
    """clusters (key, first_beam, n) with their `place`, largest first."""
    return clusters.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "first_beam")))


def hold_events(frames: DataFrame, key: list[str], hold_s: float) -> DataFrame:
    """(key, t, seq, value, until): each value of frames (key, t, seq, value) and until when it holds, and where no newer one came
    by then a row of nulls at that time."""
    next_t = F.lead("t").over(W.partitionBy(*key).orderBy("t", "seq"))
    held = frames.where("value IS NOT NULL").withColumn("until", F.col("t") + hold_s).withColumn("next_t", next_t)
    ends = held.where("next_t IS NULL OR next_t > until").select(*key, F.col("until").alias("t"), F.lit(None).cast(held.schema["seq"].dataType).alias("seq"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("until"))
    return held.select(*key, "t", "seq", "value", "until").unionByName(ends)


def health_changes(messages: DataFrame, key: list[str], limits: dict[str, float]) -> DataFrame:
    """(key, t, seq, health): a row whenever the first unhealthy reason, in the order of limits, changes for a key of messages
    (key, topic, t, seq).

    A topic is stale from `limits` seconds after its last message on, and before its first; a limit of 0 never ends. Messages of
    a moment come before what runs out then; what runs out has no seq.
    """
    watched = {topic: limit for topic, limit in limits.items() if limit > 0}
    limit = F.coalesce(*[F.when(F.col("topic") == topic, seconds) for topic, seconds in watched.items()], F.lit(None).cast("double"))
    ends = messages.where(F.col("topic").isin(*watched)).withColumn("_end", F.col("t") + limit)
    ends = ends.withColumn("_next", F.lead("t").over(W.partitionBy(*key, "topic").orderBy("t", "seq"))).where("_next IS NULL OR _next > _end")
    ends = ends.groupBy(*key, F.col("_end").alias("t")).agg(F.collect_set("topic").alias("_gone"))
    none = F.lit(None)
    rows = messages.select(*key, "t", "seq", "topic", none.cast("array<string>").alias("_gone"), F.lit(0).alias("_late"))
    rows = rows.unionByName(ends.select(*key, "t", none.cast(messages.schema["seq"].dataType).alias("seq"), none.cast("string").alias("topic"), "_gone", F.lit(1).alias("_late")))
    w = W.partitionBy(*key).orderBy("t", "_late", "seq")
    health = F.lit("healthy")
    for topic in reversed(watched):
        alive = F.last(F.when(F.col("topic") == topic, True).when(F.array_contains("_gone", topic), False), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
        health = F.when(~F.coalesce(alive, F.lit(False)), f"{topic}_timeout").otherwise(health)
    rows = rows.withColumn("health", health)
    before = F.lag("health").over(w)
    return rows.withColumn("_before", before).where("_before IS NULL OR _before <> health").select(*key, "t", "seq", "health")
