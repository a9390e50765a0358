"""Column functions on depth pixels, status words, colours, grid indices and camera angles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def beam_index(angle: Column, angle_min: float, increment: float, n: int, mode: str) -> Column:
    """Index of an angle: `floor`, cut to the scan; or `round`, halves to even, around the circle of n beams."""
    place = (angle - angle_min) / increment
    if mode == "floor":
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(place))).cast("int")
    return F.pmod(F.rint(place).cast("int"), F.lit(n))


def depth_to_m(raw: Column, encoding: Column) -> Column:
    """Metres of a 16-bit (millimetres, 0 missing) or float depth."""
    m = F.when(encoding == "16UC1", F.when(raw > 0, raw * 0.001)).otherwise(raw)
    return F.when(~F.isnan(m) & (F.abs(m) != float("inf")), m)


def clip_depth(depth: Column, most: float) -> Column:
    return F.when(depth <= most, depth)


def rescale_depth(raw: Column, scale: float) -> Column:
    """Whole millimetres, truncated."""
    return (raw * (scale * 1000)).cast("int")


def heading_to_yaw(heading_deg: Column) -> Column:
    """Compass degrees, clockwise from north, to radians from east in (-pi, pi]."""
    a = math.pi / 2 - F.radians(heading_deg)
    return F.atan2(F.sin(a), F.cos(a))


def body_velocity(ve: Column, vn: Column, yaw: Column) -> tuple[Column, Column]:
    """Forward and left speed."""
    return F.cos(yaw) * ve + F.sin(yaw) * vn, -F.sin(yaw) * ve + F.cos(yaw) * vn


def pose_covariance(confidence: Column, linear: float, angular: float) -> tuple[Column, Column]:
    return linear * F.pow(F.lit(10.0), 3 - confidence), angular * F.pow(F.lit(10.0), 1 - confidence)


def landing_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return F.atan2(x, z), F.atan2(y, z), F.sqrt(x * x + y * y + z * z)


def clamp_layer(value: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def pack_color(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def unpack_color(c: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(c, k).bitwiseAND(F.lit(255)) for k in (16, 8, 0))


def valid_cell(layers: list[str]) -> Column:
    """All layers there; an empty list is never valid."""
    out = F.lit(bool(layers))
    for name in layers:
        out = out & F.col(name).isNotNull() & ~F.isnan(name)
    return out


def cell_vector(prefix: str) -> Column:
    """The prefix's x, y and z as one value, null when any is missing."""
    cols = [F.col(f"{prefix}{a}") for a in "xyz"]
    return F.when(cols[0].isNotNull() & cols[1].isNotNull() & cols[2].isNotNull(), F.struct(*cols))


def wrap_index(i: Column, n: int) -> Column:
    return F.pmod(i, F.lit(n))


def clamp_index(i: Column, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), i))


def height_gate(x: Column, y: Column, z: Column, near: float, top: float, a: float, b: float, c: float) -> Column:
    """True for points to keep: not nearer than near, not above top, nor above the ramp max(d - b, 0) * a + c."""
    d = F.sqrt(x * x + y * y)
    return (d >= near) & (z <= top) & (z <= F.greatest(d - b, F.lit(0.0)) * a + c)
