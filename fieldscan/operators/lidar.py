"""Lidar points: times, deskewing, residuals, cropping, packets, colours, and scans made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import frames
from ..functions.geo import rotate, wrap_pi
from .timejoin import asof_join

POSE = ["qx", "qy", "qz", "qw", "px", "py", "pz", "vx", "vy", "vz", "ax", "ay", "az", "wx", "wy", "wz"]


def deskew(points: DataFrame, poses: DataFrame, ends: DataFrame, mount: tuple[float, ...] = (0.0, 0.0, 0.0, 1.0), shift: tuple[float, ...] = (0.0, 0.0, 0.0)) -> DataFrame:
    """points (scan_id, seq, t, x, y, z) as seen from the end of their scan, with x, y and z replaced.

    poses (scan_id, seq, t, and POSE) hold attitude, position and speed at t, and the acceleration and turn rate until the
    next; a point takes the last pose before it, and one without stays. ends (scan_id, qx to qw, px to pz) is the pose at
    the scan's end. mount and shift take the lidar's frame to that of the poses.
    """
    found = asof_join(points, poses, ["scan_id"], POSE, strict=True)
    end = ends.select("scan_id", *[F.col(c).alias(f"end_{c}") for c in POSE[:7]])
    both = found.join(end, "scan_id", "left")
    of = lambda names: tuple(F.col(f"prev_{n}") for n in names)
    dt = F.col("t") - F.col("prev_t")
    lidar = tuple(map(F.lit, mount))

    def step(df: DataFrame, name: str, values: tuple[Column, ...]) -> tuple[DataFrame, tuple[Column, ...]]:
        """Values as columns of their own: as nested expressions they would grow with each turn."""
        names = [f"_{name}{k}" for k in range(len(values))]
        return df.withColumns(dict(zip(names, values, strict=True))), tuple(map(F.col, names))

    both, body = step(both, "body", tuple(p + s for p, s in zip(rotate(lidar, (F.col("x"), F.col("y"), F.col("z"))), shift, strict=True)))
    both, turn = step(both, "turn", frames.turn_quat(*of(POSE[13:]), dt))
    both, turn = step(both, "attitude", frames.quat_multiply(of(POSE[:4]), turn))
    both, turned = step(both, "turned", rotate(turn, body))
    moved = [p + v * dt + 0.5 * a * dt * dt - F.col(f"end_{n}") for n, p, v, a in zip(POSE[4:7], of(POSE[4:7]), of(POSE[7:10]), of(POSE[10:13]), strict=True)]
    both, apart = step(both, "apart", tuple(r + m for r, m in zip(turned, moved, strict=True)))
    both, at_end = step(both, "end", rotate(frames.conjugate(tuple(F.col(f"end_{n}") for n in POSE[:4])), apart))
    out = rotate(frames.conjugate(lidar), tuple(c - s for c, s in zip(at_end, shift, strict=True)))
    new = {c: F.coalesce(v, F.col(c)) for c, v in zip("xyz", out, strict=True)}
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in points.columns])


def fit_residuals(points: DataFrame, planes: DataFrame, key: list[str], body_norm: Column, least: float = 0.9) -> DataFrame:
    """points (key, x, y, z) with the signed `residual` to their plane a x + b y + c z + d = 0 of planes (key, a, b, c, d),
    those kept whose residual is small against the root of their distance from the sensor."""
    both = points.join(planes, key)
    norm = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    residual = (F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d")) / norm
    out = both.withColumn("residual", residual)
    return out.where(1 - 0.9 * F.abs("residual") / F.sqrt(body_norm) > least).select(*points.columns, "residual")


def point_times_from_yaw(points: DataFrame, key: list[str], speed: float) -> DataFrame:
    """points (key, seq, x, y) of rings without times, with `offset`: degrees turned, clockwise, since the ring's first point
    over the speed in degrees. Once it would run backwards, a turn is added from there on. The first points are dropped."""
    w = W.partitionBy(*key).orderBy("seq")
    yaw, first = F.degrees(F.atan2("y", "x")), F.first("_yaw").over(w)
    travelled = F.when(F.col("_yaw") <= first, first - F.col("_yaw")).otherwise(first - F.col("_yaw") + 360.0) / speed
    out = points.withColumn("_yaw", yaw).withColumn("_t", travelled).withColumn("_n", F.row_number().over(w))
    back = F.coalesce((F.col("_t") < F.lag("_t").over(w)) & (F.col("_n") > 1), F.lit(False))
    out = out.withColumn("_back", back).withColumn("_turned", F.bool_or("_back").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.where("_n > 1").withColumn("offset", F.col("_t") + F.when(F.col("_turned"), 360.0 / speed).otherwise(0.0)).drop("_yaw", "_t", "_n", "_back", "_turned")


def crop_points(points: DataFrame, min_range: float, boxes: list[tuple[float, ...]]) -> DataFrame:
    """Points not nearer than min_range and not strictly inside one of the boxes (x0, y0, z0, x1, y1, z1), a few of a config."""
    keep = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") >= min_range * min_range
    for box in boxes:
        inside = F.lit(True)
        for c, low, high in zip("xyz", box[:3], box[3:], strict=True):
            inside = inside & (F.col(c) > low) & (F.col(c) < high)
        keep = keep & ~inside
    return points.where(keep)


def packet_points(packets: DataFrame, values: str, interval: float, lines: int) -> DataFrame:
    """One row for each element of a packet's array: its place i, time t + i * interval and line i % lines."""
    out = packets.select("*", F.posexplode(values).alias("i", "point")).drop(values)
    return out.withColumn("t", F.col("t") + F.col("i") * interval).withColumn("line", F.col("i") % lines)


def merge_lidar_frames(clouds: list[DataFrame], interval: float) -> DataFrame:
    """Points (t, x, y, z) of several lidars, one frame for each interval: frame, its base time and each point's offset."""
    both = clouds[0]
    for cloud in clouds[1:]:
        both = both.unionByName(cloud)
    framed = both.withColumn("frame", F.floor(F.col("t") / interval))
    base = framed.groupBy("frame").agg(F.min("t").alias("base_t"))
    return framed.join(base, "frame").withColumn("offset", F.col("t") - F.col("base_t"))


def points_in_time_order(points: DataFrame, key: str, offset: str) -> DataFrame:
    """Each scan's points as neighbours, in order of their offset."""
    return points.repartition(key).sortWithinPartitions(key, offset)


def color_points(points: DataFrame, pixels: DataFrame, width: int, height: int, keep_bare: bool = False) -> DataFrame:
    """points (frame, u, v, z, ...) with the color of pixels (frame, px, py, color) under (u, v), cut to whole pixels. Points
    with z not above 0 are dropped, and those outside the texture unless keep_bare."""
    inside = F.col("u").between(0, 1) & F.col("v").between(0, 1)
    placed = points.where(F.col("z") > 0).withColumn("px", F.when(inside, (F.col("u") * width).cast("int"))).withColumn("py", F.when(inside, (F.col("v") * height).cast("int")))
    placed = placed if keep_bare else placed.where(inside)
    return placed.join(pixels, ["frame", "px", "py"], "left").drop("px", "py")


def active_scan(points: DataFrame, poses: DataFrame, key: str, increment: float, near: float, far: float) -> DataFrame:
    """(key, beam, range): nearest of the points (key, x, y) on each beam seen from poses (key, px, py, yaw); beams without a
    point are left out."""
    import math

    n = round(2 * math.pi / increment)
    both = points.join(poses, key)
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    bx, by = F.cos("yaw") * dx + F.sin("yaw") * dy, -F.sin("yaw") * dx + F.cos("yaw") * dy
    beam = F.pmod(F.round((F.atan2(by, bx) + math.pi) / increment).cast("int"), F.lit(n))
    seen = both.select(key, beam.alias("beam"), F.sqrt(bx * bx + by * by).alias("range"))
    return seen.where(F.col("range").between(near, far)).groupBy(key, "beam").agg(F.min("range").alias("range"))


def clear_scan(limits: DataFrame, margin: float, cap: float, beams: int) -> DataFrame:
    """limits (range_min, range_max, ...) with `ranges`: beams times one clearing range; limits that cross are left out."""
    clear = F.col("range_max") - margin
    clear = F.least(clear, F.lit(cap)) if cap > 0 else clear
    return limits.where("range_max > range_min").withColumn("ranges", F.array_repeat(F.greatest(clear, F.col("range_min") + 0.01), beams))


def front_is_safe(beams: DataFrame, half_width: float, near: float, far: float) -> DataFrame:
    """(scan_id, safe): whether what the beams ahead lack to `far`, summed, is under 0.1."""
    ahead = F.abs(wrap_pi(F.col("angle"))) < half_width
    close = F.when(ahead & (F.col("range") >= near) & (F.col("range") < far), far - F.col("range"))
    return beams.groupBy("scan_id").agg((F.coalesce(F.sum(close), F.lit(0.0)) < 0.1).alias("safe"))


def fill_scan_angles(beams: DataFrame) -> DataFrame:
    """beams (scan_id, seq, angle, range) with angles, in degrees, for beams without a range: before the first seen beam and
    after it by steps of 360 / n from its neighbours, and `place` in the order of angles. Scans without a seen beam are left
    out."""
    w = W.partitionBy("scan_id").orderBy("seq")
    whole = W.partitionBy("scan_id")
    i, n = F.row_number().over(w) - 1, F.count("*").over(whole)
    out = beams.withColumns({"_i": i, "_n": n, "_step": F.lit(360.0) / n})
    seen = F.when(F.col("range").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("angle").alias("angle")))
    out = out.withColumn("_f", F.min(seen).over(whole)).where("_f IS NOT NULL")
    head = F.greatest(F.col("_f.angle") - (F.col("_f.i") - F.col("_i")) * F.col("_step"), F.lit(0.0))
    front = F.greatest(F.col("_f.angle") - F.col("_f.i") * F.col("_step"), F.lit(0.0))
    later = front + F.col("_i") * F.col("_step")
    later = F.when(later > 360, later - 360).otherwise(later)
    # every unseen beam but the first is set anew from the angle of the first beam
    filled = F.when(F.col("range").isNotNull(), F.col("angle")).when(F.col("_i") == 0, head).otherwise(later)
    out = out.withColumn("angle", filled).drop("_i", "_n", "_step", "_f")
    return out.withColumn("place", F.row_number().over(W.partitionBy("scan_id").orderBy("angle", "seq")))
