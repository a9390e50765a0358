"""Features of points along the rings of a scan: planar segments, edges, wires, and the surface points made from them.

A ring's points come in order of (t, seq). A point nearer than `blind` in the plane is no reading. dista is the squared distance
to the next point, 0 at the end of a ring.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fold import delayed_fold

NONE, POSSIBLE, PLANE, EDGE_PLANE, EDGE_JUMP, WIRE = "none", "possible_plane", "plane", "edge_plane", "edge_jump", "wire"


@dataclass(frozen=True)
class RingConfig:
    """Limits of the features; the defaults are those of the recorded sensors."""

    blind: float = 0.01
    #: A segment has at least `group` points, and reaches to the first point farther than near + far_share * range from its start.
    group: int = 8
    far_share: float = 0.01
    near: float = 0.1
    #: A segment is planar when its squared length is so many times its squared width,
    slim: float = 225.0
    #: and its spacings are even: squared largest to middle, middle to least but one (or, with one limit, largest to least but one).
    most_to_mid: float = 6.25
    mid_to_least: float = 6.25
    most_to_least: float | None = None
    #: Edges: angles at which a neighbour lies behind or in front, ratio and difference of spacings, and the range of open space.
    up_cos: float = math.cos(math.radians(170))
    down_cos: float = math.cos(math.radians(8))
    bent_cos: float = math.cos(math.radians(160))
    edge_ratio: float = 2.0
    edge_gap: float = 0.1
    open_range: float = 10.0
    #: Small planes: three points so straight and so evenly spaced.
    straight_cos: float = math.cos(math.radians(172.5))
    even_ratio: float = 1.2


class PlaneWalk:
    """Greedy growth of planar segments along one ring. Points wait until the segment that starts at the first of them is
    decided, which is when a point too far from its start, a missing reading or the end comes: what waits is one segment and
    the `group` points that it needs."""

    def __init__(self, cfg: RingConfig):
        self.cfg = cfg
        self.points: list[tuple[float, float, float]] = []
        self.labels: list[str] = []
        self.grown = 0
        self.before: tuple[float, float, float] | None = None

    def push(self, row: dict) -> list[dict]:
        self.points.append((row["x"], row["y"], row["z"]))
        self.labels.append(NONE)
        return self.advance(False)

    def finish(self) -> list[dict]:
        return [*self.advance(True), *self.release(len(self.points))]

    def release(self, n: int) -> list[dict]:
        out = [{"label": label} for label in self.labels[:n]]
        del self.points[:n], self.labels[:n]
        self.grown = 0
        return out

    def is_blind(self, k: int) -> bool:
        return math.hypot(*self.points[k][:2]) < self.cfg.blind

    def advance(self, ended: bool) -> list[dict]:
        out: list[dict] = []
        group = self.cfg.group
        while self.points:
            if self.is_blind(0):
                out += self.release(1)
                continue
            if len(self.points) <= group:
                break
            stop = self.stop(ended)
            if stop is None:
                break
            if stop < len(self.points) and self.is_blind(stop):
                self.before = None
                out += self.release(stop + 1)
            else:
                out += self.decide(stop)
        return out

    def stop(self, ended: bool) -> int | None:
        """Place behind the segment that starts at the first point, or of the missing reading in it; None as long as it grows."""
        if not self.grown:
            for k in range(1, self.cfg.group):
                if self.is_blind(k):
                    return k
            self.grown = self.cfg.group
        x, y, z = self.points[0]
        limit = (self.cfg.far_share * math.hypot(x, y) + self.cfg.near) ** 2
        while self.grown < len(self.points):
            px, py, pz = self.points[self.grown]
            if self.is_blind(self.grown) or (px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2 >= limit:
                return self.grown
            self.grown += 1
        return len(self.points) if ended else None

    def decide(self, stop: int) -> list[dict]:
        """Labels of the segment before `stop`; the point there starts the next segment, or is passed over if this is none."""
        way = self.direction(stop)
        if way is None:
            self.before = None
            return self.release(min(stop + 1, len(self.points)))
        start = POSSIBLE
        if self.before is not None and any(self.before):
            start = EDGE_PLANE if abs(sum(a * b for a, b in zip(self.before, way, strict=True))) < 0.707 else PLANE
        self.labels[0] = start
        for k in range(1, min(stop, len(self.points))):
            self.labels[k] = PLANE
        if stop < len(self.points):
            self.labels[stop] = POSSIBLE
        self.before = way
        return self.release(stop)

    def direction(self, stop: int) -> tuple[float, float, float] | None:
        """Unit vector from the first point of a planar segment to the point at its end, or zeros where they are one place; None
        if it is not planar."""
        cfg, first = self.cfg, self.points[0]
        step = [tuple(a - b for a, b in zip(p, first, strict=True)) for p in self.points[: stop + 1]]
        x, y, z = step[min(stop, len(step) - 1)]
        length = x * x + y * y + z * z
        width = max((b * z - y * c) ** 2 + (c * x - a * z) ** 2 + (a * y - x * b) ** 2 for a, b, c in step[1:stop])
        if width > 0 and length * length / width < cfg.slim:
            return None
        near = self.points[: stop + 1]
        gaps = [sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for p, q in zip(near, near[1:], strict=False)]
        gaps = sorted([*gaps, 0.0][:stop], reverse=True)
        most, mid, least = gaps[0], gaps[len(gaps) // 2], gaps[-2]
        if least < 1e-16:
            return None
        if cfg.most_to_least is not None:
            even = most / least < cfg.most_to_least
        else:
            even = most / mid < cfg.most_to_mid and mid / least < cfg.mid_to_least
        size = length**0.5 or 1.0
        return (x / size, y / size, z / size) if even else None


def plane_labels(points: DataFrame, key: list[str], cfg: RingConfig) -> DataFrame:
    """points (key, t, seq, x, y, z) with `label`: plane inside planar segments, possible_plane at their ends, edge_plane where
    two of them meet at an angle, none elsewhere."""
    return delayed_fold(points, key, ["x", "y", "z"], "label string", lambda: PlaneWalk(cfg))


def _norm(v: list[Column]) -> Column:
    return F.sqrt(sum(c * c for c in v))


def _dot(a: list[Column], b: list[Column]) -> Column:
    return sum(p * q for p, q in zip(a, b, strict=True))


def edge_points(labelled: DataFrame, key: list[str], cfg: RingConfig) -> DataFrame:
    """labelled (key, t, seq, x, y, z, label) with edges, wires and small planes labelled too.

    A point that no plane holds is judged by the directions and spacings of two neighbours on each side. Of three points in
    line the middle one makes all three a plane; it is not asked again whether the third is the middle of another, so of a run of
    such points every second one counts.
    """
    w = W.partitionBy(*key).orderBy("t", "seq")
    whole, so_far = W.partitionBy(*key), w.rowsBetween(W.unboundedPreceding, W.currentRow)
    p = [F.col(c) for c in "xyz"]
    before, after = ([F.lag(c).over(w) - c for c in p], [F.lead(c).over(w) - c for c in p])
    reach = F.hypot("x", "y")
    rows = labelled.withColumn("i", F.row_number().over(w)).withColumn("reach", reach)
    rows = rows.withColumn("dista", F.coalesce(sum(d * d for d in after), F.lit(0.0)))
    for k, d in enumerate(("a", "b")):
        v = (before, after)[k]
        rows = rows.withColumn(f"cos_{d}", F.try_divide(_dot(p, v), _norm(p) * _norm(v)))
    rows = rows.withColumn("bend", F.try_divide(_dot(before, after), _norm(before) * _norm(after)))
    rows = rows.withColumn("n", F.count("*").over(whole)).withColumn("head", F.min(F.when(F.col("reach") >= cfg.blind, F.col("i"))).over(whole))

    at = lambda c, k: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)
    blind = {k: at("reach", k) < cfg.blind for k in (-2, -1, 1, 2)}
    gap = {k: at("dista", k) for k in (-2, -1, 1)} | {0: F.col("dista")}

    def kind(k: int, c: str) -> Column:
        missing = F.when(F.col("reach") > cfg.open_range, "open").otherwise("blind")
        return F.when(blind[k], missing).when(F.col(c) < cfg.up_cos, "behind").when(F.col(c) > cfg.down_cos, "front").otherwise("side")

    rows = rows.select("*", kind(-1, "cos_a").alias("left"), kind(1, "cos_b").alias("right"), *(v.alias(f"gap{k + 2}") for k, v in gap.items() if k), *(v.alias(f"blind{k + 2}") for k, v in blind.items()))
    g = lambda k: F.col("dista") if k == 0 else F.col(f"gap{k + 2}")
    seen = lambda *ks: ~reduce_or([F.col(f"blind{k + 2}") for k in ks])

    def even(one: Column, two: Column) -> Column:
        most, least = F.sqrt(F.greatest(one, two)), F.sqrt(F.least(one, two))
        return (most <= cfg.edge_ratio * least) & (most - least <= cfg.edge_gap)

    jump_left, jump_right = seen(-1, -2) & even(g(-1), g(-2)), seen(1, 2) & even(g(0), g(1))
    left, right = F.col("left"), F.col("right")
    near_first = (left == "side") & (right == "front") & (g(0) > 0.0225) & (g(0) > 4 * g(-1))
    near_last = (left == "front") & (right == "side") & (g(-1) > 0.0225) & (g(-1) > 4 * g(0))
    bent = F.col("bend") > cfg.bent_cos
    edge = F.when(near_first, bent & jump_left).when(near_last, bent & jump_right).when((left == "side") & (right == "open"), jump_left).when((left == "open") & (right == "side"), jump_right)
    wire = (left != "side") & (right != "side") & (F.col("label") == NONE)
    judged = F.col("i").between(F.col("head") + 3, F.col("n") - 3) & (F.col("reach") >= cfg.blind) & F.col("label").isin(NONE, POSSIBLE) & (g(-1) >= 1e-16) & (g(0) >= 1e-16)
    rows = rows.withColumn("judged", F.coalesce(judged, F.lit(False)))
    rows = rows.withColumn("label", F.when(F.col("judged") & F.coalesce(edge, F.lit(False)), EDGE_JUMP).when(F.col("judged") & wire & edge.isNull(), WIRE).otherwise(F.col("label")))

    ratio = F.try_divide(F.greatest(g(-1), g(0)), F.least(g(-1), g(0)))
    middle = F.col("judged") & (F.col("label") == NONE) & seen(-1, 1) & (g(-1) >= 1e-8) & (g(0) >= 1e-8) & (F.col("bend") < cfg.straight_cos) & (ratio < cfg.even_ratio)
    rows = rows.withColumn("middle", F.coalesce(middle, F.lit(False)))
    run = F.col("i") - F.coalesce(F.max(F.when(~F.col("middle"), F.col("i"))).over(so_far), F.lit(0))
    rows = rows.withColumn("counts", F.col("middle") & (run % 2 == 1))
    beside = F.coalesce(F.lag("counts").over(w), F.lit(False)) | F.coalesce(F.lead("counts").over(w), F.lit(False))
    label = F.when(F.col("counts") | ((F.col("label") == NONE) & beside), PLANE).otherwise(F.col("label"))
    return rows.select(*key, "t", "seq", "x", "y", "z", label.alias("label"))


def reduce_or(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def surface_points(labelled: DataFrame, key: list[str], every: int) -> DataFrame:
    """(key, first_seq, n, x, y, z): of each run of plane points along a ring every `every`-th one, and for what is left of
    a run before other points the mean of it; what is left at the end of a ring is dropped."""
    w = W.partitionBy(*key).orderBy("t", "seq")
    plane = F.col("label").isin(PLANE, POSSIBLE)
    rows = labelled.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy(*key)))
    other = F.max(F.when(~plane, F.col("i"))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("start", F.coalesce(other, F.lit(0))).where(plane)
    block = F.floor((F.col("i") - F.col("start") - 1) / every).alias("block")
    last = F.max_by(F.struct("x", "y", "z"), "i").alias("last")
    blocks = rows.groupBy(*key, "start", block).agg(F.count("*").alias("size"), F.max("i").alias("i"), F.max("n").alias("n"), F.min_by("seq", "i").alias("first_seq"), last, *(F.avg(c).alias(c) for c in "xyz"))
    whole = F.col("size") == every
    blocks = blocks.where(whole | (F.col("i") < F.col("n")))
    return blocks.select(*key, "first_seq", F.col("size").alias("n"), *(F.when(whole, F.col(f"last.{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"))
