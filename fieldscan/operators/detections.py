"""Camera detections: reasons to reject, projection into sectors, beams, targets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they are tested.
REASONS = ("class_not_enabled", "class_ignored", "low_confidence", "bbox_too_narrow", "bbox_too_short", "invalid_depth", "invalid_position", "depth_out_of_range")


def classify(detections: DataFrame, classes: DataFrame, default_confidence: float, least_width: int, least_height: int, near: float, far: float) -> DataFrame:
    """detections with `reason`: the first of REASONS that applies, else accepted. classes (class_name, min_confidence,
    enabled, ignored) is a settings table: up to MAX_CLASSES rows go to every task, more are joined by a shuffle."""
    few = classes.limit(MAX_CLASSES + 1).count() <= MAX_CLASSES
    d = detections.join(F.broadcast(classes) if few else classes, "class_name", "left")
    tests = (
        ~F.coalesce("enabled", F.lit(False)),
        F.coalesce("ignored", F.lit(False)),
        F.col("confidence") < F.coalesce("min_confidence", F.lit(default_confidence)),
        F.col("x_max") - F.col("x_min") < least_width,
        F.col("y_max") - F.col("y_min") < least_height,
        F.col("depth_m").isNull() | (F.col("depth_m") <= 0),
        F.col("px").isNull() | F.col("py").isNull() | F.col("pz").isNull(),
        ~F.coalesce(F.col("depth_m").between(near, far), F.lit(False)),
    )
    reason = F.when(tests[0], REASONS[0])
    for test, name in zip(tests[1:], REASONS[1:], strict=True):
        reason = reason.when(test, name)
    return d.withColumn("reason", reason.otherwise("accepted")).drop("min_confidence", "enabled", "ignored")


MAX_CLASSES = 10_000


def frame_reasons(classified: DataFrame) -> DataFrame:
    """Per frame: detections, accepted ones, and a count for each reason."""
    return classified.groupBy("frame").agg(F.count("*").alias("input"), F.count_if(F.col("reason") == "accepted").alias("accepted"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])


def sector(lateral: Column, forward: Column, half_width: Column, lateral_pad: float, margin: float, range_min: float) -> tuple[Column, Column, Column]:
    """(low angle, high angle, conservative range) of an object at (forward, lateral): the edges' bearings, padded by the
    angle that lateral_pad subtends."""
    r = F.sqrt(lateral * lateral + forward * forward)
    pad = F.atan2(F.lit(lateral_pad), r)
    a, b = F.atan2(lateral - half_width, forward), F.atan2(lateral + half_width, forward)
    return F.least(a, b) - pad, F.greatest(a, b) + pad, F.greatest(F.lit(range_min), r - margin)


def paint_beams(sectors: DataFrame, key: str, angle_min: float, increment: float, n: int) -> DataFrame:
    """(key, beam, range): least range of the sectors (low, high, range) that cover each beam, floor(low) to floor(high) + 1,
    cut to the scan."""
    first = F.greatest(F.floor((F.col("low") - angle_min) / increment), F.lit(0))
    last = F.least(F.floor((F.col("high") - angle_min) / increment) + 1, F.lit(n - 1))
    seen = sectors.withColumn("_a", first).withColumn("_b", last).where("_a <= _b")
    return seen.select(key, F.explode(F.sequence("_a", "_b")).alias("_beam"), "range").groupBy(key, F.col("_beam").cast("int").alias("beam")).agg(F.min("range").alias("range"))


def select_target(detections: DataFrame, policy: str, near: float, far: float) -> DataFrame:
    """Of each frame's detections with valid depth, the most confident or the nearest, ties to the smaller id."""
    ok = detections.where(F.col("depth_m").between(near, far))
    order = F.struct(-F.col("confidence") if policy == "confidence" else F.col("depth_m"), F.col("det_id"))
    return ok.groupBy("frame").agg(F.min_by(F.struct("det_id", "class_name", "confidence", "depth_m"), order).alias("d")).select("frame", "d.*")


def depth_in_boxes(pixels: DataFrame, boxes: DataFrame, r: int, least: int) -> DataFrame:
    """(frame, det_id, depth): median valid depth in the window of 2 r + 1 pixels about the box's centre; with fewer than
    `least` of them, in the inner half of the box; else null."""
    near = boxes.join(pixels.where("depth IS NOT NULL"), "frame").where(F.col("u").between(F.col("x_min"), F.col("x_max")) & F.col("v").between(F.col("y_min"), F.col("y_max")))
    window = (F.abs(F.col("u") - F.col("center_u")) <= r) & (F.abs(F.col("v") - F.col("center_v")) <= r)
    quarter = lambda a, p: F.col(p).between(F.col(f"{a}_min") + (F.col(f"{a}_max") - F.col(f"{a}_min")) / 4, F.col(f"{a}_max") - (F.col(f"{a}_max") - F.col(f"{a}_min")) / 4)
    inner = quarter("x", "u") & quarter("y", "v")
    stats = near.groupBy("frame", "det_id").agg(*[x for name, c in (("w", window), ("i", inner)) for x in (F.count_if(c).alias(f"n_{name}"), F.median(F.when(c, F.col("depth"))).alias(f"m_{name}"))])
    depth = F.when(F.col("n_w") >= least, F.col("m_w")).when(F.col("n_i") >= least, F.col("m_i"))
    return boxes.select("frame", "det_id").join(stats.select("frame", "det_id", depth.alias("depth")), ["frame", "det_id"], "left")


def scale_fields(df: DataFrame, scales: dict[str, float]) -> DataFrame:
    """Raw integers to engineering units, rounded to seven decimals."""
    return df.withColumns({c: F.round(F.col(c) * s, 7) for c, s in scales.items()})


#: Fixed scales of the inertial frame: degrees from 32- and 16-bit angles, metres a second, degrees a second, metres a second squared.
INS_SCALES = {"angle32": 180 / 2**31, "angle16": 180 / 2**15, "heading": 360 / 2**16, "speed": 1e-3, "rate": 1e-6, "accel": 1e-7}


def apply_extrinsic(x: Column, y: Column, z: Column, roll: float, pitch: float, yaw: float, t: tuple[float, float, float], unit: float = 1.0) -> tuple[Column, Column, Column]:
    """Points in `unit` metres turned by Euler degrees (yaw after pitch after roll) and moved."""
    (cr, sr), (cp, sp), (cy, sy) = ((math.cos(math.radians(a)), math.sin(math.radians(a))) for a in (roll, pitch, yaw))
    m = [[cp * cy, cy * sp * sr - cr * sy, sr * sy + cr * cy * sp], [cp * sy, cr * cy + sp * sr * sy, cr * sp * sy - cy * sr], [-sp, cp * sr, cp * cr]]
    return tuple((a * x + b * y + c * z) * unit + d for (a, b, c), d in zip(m, t, strict=True))


def stop_reasons(df: DataFrame, command_age: float, sensor_age: float, forward_only: bool) -> DataFrame:
    """df (command_age, sensor_age, danger, v) with `reasons` in order and the stop flag."""
    danger = F.col("danger") & ((F.col("v") > 0) | F.lit(not forward_only))
    late = lambda c, limit: F.col(c).isNull() | (F.col(c) > limit)
    reasons = F.array_compact(F.array(F.when(late("command_age", command_age), "command_timeout"), F.when(late("sensor_age", sensor_age), "ultrasonic_timeout"), F.when(danger, "danger")))
    return df.withColumn("reasons", reasons).withColumn("stop", F.size("reasons") > 0)
