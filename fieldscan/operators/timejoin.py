"""Joins between message tables by time: each is one shuffle by key, none a range join over whole keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: list[str], value_cols: list[str], max_age: float | None = None, forward: bool = False, strict: bool = False, bucket: float | None = None) -> DataFrame:
    """left (key, t, seq, ...) with `prev_t` and `prev_<col>` of the last right row (key, t, seq, value_cols) at or before
    its time, or, when strict, before it; with forward, of the first at or after. Older than max_age counts as none.

    Both sides are stacked and a running last value carries right rows to left ones, so nothing multiplies. A key's rows
    meet in one task, unless `bucket` seconds split them: then each bucket walks its own rows, and what it starts with is
    the last right row of the nearest bucket before it that has one, found among one row for each bucket. The result is the
    same; a key that holds much of the table costs many tasks instead of one.
    """
    cols = [c for c in left.columns]
    first = forward != strict
    payload = F.struct(F.col("t").alias("t"), *[F.col(c).alias(c) for c in value_cols])
    a = left.select(*cols, F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_p"), F.lit(0 if first else 1).alias("_side"))
    b = right.select(*[F.col(c) if c in (*key, "t", "seq") else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], payload.alias("_p"), F.lit(1 if first else 0).alias("_side"))
    both = a.unionByName(b)
    over = lambda w: F.first("_p", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)) if forward else F.last("_p", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    if bucket is None:
        out = both.withColumn("_f", over(W.partitionBy(*key).orderBy("t", "_side", "seq")))
    else:
        both = both.withColumn("_b", F.floor(F.col("t") / bucket))
        edge = F.struct("t", "_side", "seq")
        edges = both.groupBy(*key, "_b").agg((F.min_by if forward else F.max_by)("_p", F.when(F.col("_p").isNotNull(), edge)).alias("_p"))
        before = W.partitionBy(*key).orderBy("_b").rowsBetween(*((1, W.unboundedFollowing) if forward else (W.unboundedPreceding, -1)))
        carried = (F.first if forward else F.last)("_p", ignorenulls=True).over(before)
        edges = edges.select(*key, "_b", carried.alias("_carried"))
        walked = both.withColumn("_f", over(W.partitionBy(*key, "_b").orderBy("t", "_side", "seq")))
        out = walked.join(edges, [*key, "_b"]).withColumn("_f", F.coalesce("_f", "_carried"))
    out = out.where(F.col("_side") == (0 if first else 1))
    if max_age is not None:
        out = out.withColumn("_f", F.when(F.abs(F.col("t") - F.col("_f.t")) <= max_age, F.col("_f")))
    side = "next" if forward else "prev"
    return out.select(*cols, F.col("_f.t").alias(f"{side}_t"), *[F.col(f"_f.{c}").alias(f"{side}_{c}") for c in value_cols])


def interpolate_join(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """left with `value` of right interpolated at its time; rows that no two right rows enclose are dropped."""
    both = asof_join(left, right, key, [value])
    both = asof_join(both, right, key, [value], forward=True).where(f"prev_{value} IS NOT NULL AND next_{value} IS NOT NULL")
    share = F.when(F.col("next_t") > F.col("prev_t"), (F.col("t") - F.col("prev_t")) / (F.col("next_t") - F.col("prev_t"))).otherwise(0.0)
    return both.withColumn("interpolated", F.col(f"prev_{value}") + share * (F.col(f"next_{value}") - F.col(f"prev_{value}"))).select(*left.columns, "interpolated")


def nearest_time_join(a: DataFrame, b: DataFrame, key: list[str], slop: float) -> DataFrame:
    """Pairs within slop seconds that are each other's nearest, ties to the smaller seq: (key, a_seq, b_seq, dt)."""
    left = a.select(*key, F.col("t").alias("a_t"), F.col("seq").alias("a_seq"), F.floor(F.col("t") / slop).alias("_b"))
    right = b.select(*key, F.col("t").alias("b_t"), F.col("seq").alias("b_seq"), F.explode(F.array(*[F.floor(F.col("t") / slop) + k for k in (-1, 0, 1)])).alias("_b"))
    near = left.join(right, [*key, "_b"]).withColumn("dt", F.abs(F.col("a_t") - F.col("b_t"))).where(F.col("dt") <= slop)
    best = lambda by, then: F.row_number().over(W.partitionBy(*key, by).orderBy("dt", then))
    ranked = near.withColumn("_ra", best("a_seq", "b_seq")).withColumn("_rb", best("b_seq", "a_seq"))
    return ranked.where("_ra = 1 AND _rb = 1").select(*key, "a_seq", "b_seq", "dt")


def transform_join(points: DataFrame, poses: DataFrame, key: list[str], max_age: float, allow_latest: bool = False) -> DataFrame:
    """points (key, t, seq, x, y, ...) with `wx` and `wy`, their place in the frame of poses (key, t, seq, x, y, theta): by the last pose
    at or before their time and not older than max_age, else, if allowed, by the key's latest pose. `pose` says which: current, latest,
    or null for points that no pose places; count those by transform_rejects."""
    placed = [c for c in points.columns if c not in ("x", "y")]
    moved = points.withColumnsRenamed({"x": "_x", "y": "_y"})
    found = asof_join(moved, poses, key, ["x", "y", "theta"], max_age=max_age)
    pose = F.when(F.col("prev_t").isNotNull(), F.struct(*[F.col(f"prev_{c}").alias(c) for c in ("x", "y", "theta")]))
    kind = F.when(F.col("prev_t").isNotNull(), F.lit("current"))
    if allow_latest:
        last = poses.groupBy(*key).agg(F.max_by(F.struct("x", "y", "theta"), F.struct("t", "seq")).alias("_last"))
        found = found.join(last, key, "left")
        pose, kind = F.coalesce(pose, "_last"), F.coalesce(kind, F.when(F.col("_last").isNotNull(), F.lit("latest")))
    found = found.withColumns({"_p": pose, "pose": kind})
    c, s = F.cos("_p.theta"), F.sin("_p.theta")
    return found.select(*placed, (c * F.col("_x") - s * F.col("_y") + F.col("_p.x")).alias("wx"), (s * F.col("_x") + c * F.col("_y") + F.col("_p.y")).alias("wy"), "pose")


def transform_rejects(joined: DataFrame, key: list[str]) -> DataFrame:
    """(key, n, rejected, latest) of what transform_join gives."""
    return joined.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(F.col("pose").isNull()).alias("rejected"), F.count_if(F.col("pose") == "latest").alias("latest"))
