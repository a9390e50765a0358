"""Quaternions, tilts and map indices as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import rotate

Quaternion = tuple[Column, Column, Column, Column]


def quat_multiply(p: Quaternion, q: Quaternion) -> Quaternion:
    """The turn q followed by the turn p; both (x, y, z, w)."""
    (a, b, c, d), (x, y, z, w) = p, q
    return d * x + a * w + b * z - c * y, d * y - a * z + b * w + c * x, d * z + a * y - b * x + c * w, d * w - a * x - b * y - c * z


def axis_quat(axis: str, angle: float) -> Quaternion:
    """A turn about one of the axes x, y and z."""
    return tuple(F.lit(math.sin(angle / 2) if a == axis else 0.0) for a in "xyz") + (F.lit(math.cos(angle / 2)),)


def turn_quat(wx: Column, wy: Column, wz: Column, dt: Column) -> Quaternion:
    """The turn of an angular velocity over dt; none for speeds up to 1e-7."""
    speed = F.sqrt(wx * wx + wy * wy + wz * wz)
    s = F.when(speed > 1e-7, F.sin(speed * dt / 2) / speed).otherwise(0.0)
    return wx * s, wy * s, wz * s, F.when(speed > 1e-7, F.cos(speed * dt / 2)).otherwise(1.0)


def conjugate(q: Quaternion) -> Quaternion:
    return -q[0], -q[1], -q[2], q[3]


def rotate_imu(orientation: Quaternion, gyro: tuple[Column, ...], accel: tuple[Column, ...], pitch_deg: float) -> tuple[Quaternion, tuple[Column, ...], tuple[Column, ...]]:
    """Readings of a sensor mounted with a tilt: the orientation gains the tilt, the vectors are turned back by it."""
    tilt, back = axis_quat("y", math.radians(pitch_deg)), axis_quat("y", -math.radians(pitch_deg))
    return quat_multiply(orientation, tilt), rotate(back, gyro), rotate(back, accel)


def align_pose(position: tuple[Column, ...], camera: Quaternion, gamma: float, roll: float, pitch: float, yaw: float) -> tuple[tuple[Column, ...], Quaternion]:
    """Pose of the body in a world turned by gamma, from a camera mounted at roll, pitch and yaw."""
    x, y, z = position
    c, s = math.cos(gamma), math.sin(gamma)
    body = axis_quat("z", -gamma)
    for q in (camera, axis_quat("x", roll), axis_quat("y", pitch), axis_quat("z", yaw)):
        body = quat_multiply(body, q)
    n = F.sqrt(sum((v * v for v in body[1:]), body[0] * body[0]))
    return (c * x + s * y, -s * x + c * y, z), tuple(v / n for v in body)


def bbox_lengths(length_x: Column, length_y: Column, q: Quaternion) -> tuple[Column, Column]:
    """Lengths of the level box that holds a level rectangle after a turn: twice the farthest corner from the centre."""
    ex, ey = rotate(q, (F.lit(1.0), F.lit(0.0), F.lit(0.0))), rotate(q, (F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    return tuple(F.abs(ex[k]) * length_x + F.abs(ey[k]) * length_y for k in (0, 1))


def linear_index(ix: Column, iy: Column, nx: int, ny: int, row_major: bool = False) -> Column:
    return ix * ny + iy if row_major else iy * nx + ix


def index_of_linear(k: Column, nx: int, ny: int, row_major: bool = False) -> tuple[Column, Column]:
    """Inverse of linear_index."""
    side = ny if row_major else nx
    major, minor = F.floor(k / side).cast("int"), (k % side).cast("int")
    return (major, minor) if row_major else (minor, major)


def pixel_to_value(pixel: Column, alpha: Column, low: float, high: float, most: int, threshold: float = 0.5) -> Column:
    """Grey level to map value; null where alpha is below the threshold's whole level."""
    return F.when(alpha >= int(threshold * most), low + (high - low) * (pixel / most))


def value_to_pixel(value: Column, low: float, high: float, most: int) -> Column:
    """Map value, cut to its limits, to a whole grey level; null for none."""
    cut = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.when(value.isNotNull() & ~F.isnan(value), ((cut - low) / (high - low) * most).cast("int"))
