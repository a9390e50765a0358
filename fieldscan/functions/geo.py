"""Column functions on positions, angles and frames."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS-84.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
ECCENTRICITY2 = FLATTENING * (2 - FLATTENING)
EARTH_RADIUS = 6371000.0


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Geodetic degrees and metres to earth-centred x, y, z."""
    lat, lon = F.radians(lat), F.radians(lon)
    n = SEMI_MAJOR / F.sqrt(1 - ECCENTRICITY2 * F.sin(lat) * F.sin(lat))
    return (n + alt) * F.cos(lat) * F.cos(lon), (n + alt) * F.cos(lat) * F.sin(lon), (n * (1 - ECCENTRICITY2) + alt) * F.sin(lat)


def enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """East, north, up about an origin."""
    (x, y, z), (x0, y0, z0) = ecef(lat, lon, alt), ecef(lat0, lon0, alt0)
    dx, dy, dz, p, q = x - x0, y - y0, z - z0, F.radians(lat0), F.radians(lon0)
    east = -F.sin(q) * dx + F.cos(q) * dy
    north = -F.sin(p) * F.cos(q) * dx - F.sin(p) * F.sin(q) * dy + F.cos(p) * dz
    return east, north, F.cos(p) * F.cos(q) * dx + F.cos(p) * F.sin(q) * dy + F.sin(p) * dz


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def wrap_pi(a: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def quat_yaw(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def yaw_quat(yaw: Column) -> tuple[Column, Column]:
    """(z, w) of a planar heading."""
    return F.sin(yaw / 2), F.cos(yaw / 2)


def rotate(q: tuple[Column, ...], p: tuple[Column, ...]) -> tuple[Column, ...]:
    """p turned by the quaternion (x, y, z, w), normalised first; null for the zero quaternion."""
    n = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    x, y, z, w = (F.when(n > 0, c / n) for c in q)
    tx, ty, tz = 2 * (y * p[2] - z * p[1]), 2 * (z * p[0] - x * p[2]), 2 * (x * p[1] - y * p[0])
    return p[0] + w * tx + y * tz - z * ty, p[1] + w * ty + z * tx - x * tz, p[2] + w * tz + x * ty - y * tx


def transform2d(x: Column, y: Column, tx: Column, ty: Column, yaw: Column) -> tuple[Column, Column]:
    return F.cos(yaw) * x - F.sin(yaw) * y + tx, F.sin(yaw) * x + F.cos(yaw) * y + ty


def spherical_to_xyz(depth: Column, theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    return depth * F.sin(theta) * F.cos(phi), depth * F.sin(theta) * F.sin(phi), depth * F.cos(theta)


def deproject(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    return (u - cx) * depth / fx, (v - cy) * depth / fy, depth


def time_unit_ms(offset: Column, unit: Column) -> Column:
    return offset * F.when(unit == "s", 1e3).when(unit == "ms", 1.0).when(unit == "us", 1e-3).when(unit == "ns", 1e-6)


def deadband_clamp(v: Column, band: float, limit: float) -> Column:
    return F.when(F.abs(v) < band, 0.0).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), v)))


def valid_fix(lat: Column, lon: Column) -> Column:
    ok = lambda c, most: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= most)
    return ok(lat, 90.0) & ok(lon, 180.0)


def raw_range_to_m(raw: Column, scale: float, low: float, high: float, sentinel: int = 65000) -> Column:
    """Metres, null for no reading and outside the limits."""
    m = F.when((raw > 0) & (raw < sentinel), raw * scale)
    return F.when(m.between(low, high), m)


#: The bits of an inertial status word, from bit 0.
STATUS_NAMES = (
    "ready", "coarse_alignment", "fine_alignment", "pure_ins_navigation", "gnss_integrated_navigation", "dvl_integrated_navigation", "gnss_dvl_integrated_navigation", "no_position_reference",
    "bound_position", "gnss_position", "no_velocity_reference", "zero_velocity", "gnss_velocity", "dvl_velocity", "ins_data_valid", "fault",
)
#: Work states by priority, with the mask of the bits that mean them.
WORK_STATES = (("fault", 1 << 15), ("navigating", 0b1111000), ("aligning", 0b110), ("ready", 1))


def status_bits(raw: Column, names: tuple[str, ...]) -> Column:
    """Names of the bits that are set, in order."""
    return F.array_compact(F.array(*[F.when(F.getbit(raw, F.lit(k)) == 1, F.lit(n)) for k, n in enumerate(names)]))


def work_state(raw: Column) -> Column:
    """The first of fault, navigating, aligning, ready that has a bit set, else none."""
    out = F.lit("none")
    for name, mask in reversed(WORK_STATES):
        out = F.when(raw.bitwiseAND(F.lit(mask)) != 0, name).otherwise(out)
    return out


def cost_class(cost: Column) -> Column:
    return F.when(cost < 0, "unknown").when(cost == 0, "free").when(cost >= 90, "lethal").when(cost >= 50, "inflated").otherwise("low")
