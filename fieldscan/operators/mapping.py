"""More on maps: geometry of merged maps, transforms, cubic sampling, 3-D distances, polygon builders, safety."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Geometry, make_grid, map_key, sample_linear, sample_nearest


def extend_geometry(base: Geometry, other: Geometry) -> Geometry:
    """The smallest geometry on base's cells that holds both maps."""
    sides = {}
    for axis, n, length in (("x", base.nx, base.length_x), ("y", base.ny, base.length_y)):
        centre, far = getattr(base, axis), getattr(other, axis)
        reach = getattr(other, f"length_{axis}") / 2
        low, high = centre - length / 2, centre + length / 2
        down = max(0, math.ceil((low - (far - reach)) / base.resolution - 1e-9))
        up = max(0, math.ceil((far + reach - high) / base.resolution - 1e-9))
        sides[axis] = ((n + down + up) * base.resolution, centre + (up - down) * base.resolution / 2)
    return Geometry(sides["x"][0], sides["y"][0], base.resolution, sides["x"][1], sides["y"][1])


def same_layers(a: DataFrame, b: DataFrame) -> bool:
    """Every layer of a is one of b."""
    return set(a.columns) <= set(b.columns)


def rotate_map(cells: DataFrame, g: Geometry, layer: str, yaw: float) -> DataFrame:
    """(map_id, ix, iy, value): each new cell takes the value of the old cell that holds its centre turned back by yaw."""
    key, c, s = map_key(cells), math.cos(yaw), math.sin(yaw)
    if key:
        place = F.explode(F.sequence(F.lit(0), F.lit(g.nx * g.ny - 1))).alias("_n")
        new = cells.select(*key).distinct().select(*key, place).select(*key, (F.col("_n") % g.nx).cast("int").alias("ix"), F.floor(F.col("_n") / g.nx).cast("int").alias("iy"))
    else:
        new = make_grid(cells.sparkSession, g)
    x, y = g.center(F.col("ix"), F.col("iy"))
    dx, dy = x - g.x, y - g.y
    back = new.select(*key, (F.col("iy") * g.nx + F.col("ix")).alias("query_id"), (c * dx + s * dy + g.x).alias("x"), (-s * dx + c * dy + g.y).alias("y"))
    out = sample_nearest(cells, back, g, layer)
    return out.select(*key, (F.col("query_id") % g.nx).cast("int").alias("ix"), F.floor(F.col("query_id") / g.nx).cast("int").alias("iy"), "value")


def rotation(roll: float, pitch: float, yaw: float) -> list[list[float]]:
    """Rows of the matrix that turns by roll about x, then pitch about y, then yaw about z."""
    (sr, sp, sy), (cr, cp, cy) = ([f(a) for a in (roll, pitch, yaw)] for f in (math.sin, math.cos))
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]


def transform_map(cells: DataFrame, g: Geometry, height: str, layers: list[str], yaw: float, t: tuple[float, float, float], ratio: float = 0.0, roll: float = 0.0, pitch: float = 0.0, new: Geometry | None = None) -> DataFrame:
    """Every cell's centre at its height, and with a ratio four points beside it, turned by roll, pitch and yaw and shifted; the
    highest point of a cell of the new geometry (g itself, unless given) carries all layers, its height replaced."""
    key, new = map_key(cells), new or g
    x, y = g.center(F.col("ix"), F.col("iy"))
    side = g.resolution * ratio
    offsets = [(0.0, 0.0)] + ([(side, 0.0), (-side, 0.0), (0.0, side), (0.0, -side)] if ratio > 0 else [])
    spots = cells.where(F.col(height).isNotNull()).withColumn("_x", x).withColumn("_y", y).withColumn("_o", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])))
    p = (F.col("_x") + F.col("_o.a"), F.col("_y") + F.col("_o.b"), F.col(height))
    turned = [sum((m * c for m, c in zip(row, p, strict=True) if m), F.lit(0.0)) + shift for row, shift in zip(rotation(roll, pitch, yaw), t, strict=True)]
    moved = spots.withColumns({"_nx": turned[0], "_ny": turned[1], "_nz": turned[2]})
    ix, iy = new.index(F.col("_nx"), F.col("_ny"))
    moved = moved.withColumn("_ix", ix).withColumn("_iy", iy).where("_ix IS NOT NULL AND _iy IS NOT NULL").withColumn(height, F.col("_nz"))
    best = moved.groupBy(*key, "_ix", "_iy").agg(F.max_by(F.struct(height, *layers), F.struct(F.col(height), -F.col("ix"), -F.col("iy"))).alias("p"))
    return best.select(*key, F.col("_ix").alias("ix"), F.col("_iy").alias("iy"), "p.*")


def cubic_weight(d: Column) -> Column:
    """Convolution kernel with a = -0.5 at distance d."""
    a = F.abs(d)
    return F.when(a <= 1, 1.5 * a * a * a - 2.5 * a * a + 1).when(a < 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2).otherwise(0.0)


def sample_convolved(cells: DataFrame, queries: DataFrame, g: Geometry, layer: str) -> DataFrame:
    """Cubic convolution over 4 x 4 cells, indices clamped at the edges; where not all are there the bilinear value, or the
    nearest. Queries as for sample_nearest."""
    key = map_key(cells, queries)
    u, v = ((getattr(g, a) + getattr(g, f"length_{a}") / 2 - F.col(a)) / g.resolution - 0.5 for a in "xy")
    q = queries.withColumn("_u", u).withColumn("_v", v)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-1, 3) for j in range(-1, 3)])
    q = q.withColumn("_c", F.explode(pairs)).withColumn("_a", F.floor("_u") + F.col("_c.i")).withColumn("_b", F.floor("_v") + F.col("_c.j"))
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("int")
    near = q.select(*key, "query_id", clamp(F.col("_a"), g.nx).alias("ix"), clamp(F.col("_b"), g.ny).alias("iy"), (cubic_weight(F.col("_u") - F.col("_a")) * cubic_weight(F.col("_v") - F.col("_b"))).alias("w"))
    joined = near.join(cells.select(*key, "ix", "iy", F.col(layer).alias("value")), [*key, "ix", "iy"], "left")
    cubic = joined.groupBy(*key, "query_id").agg(F.when(F.count("value") == 16, F.sum(F.col("w") * F.col("value"))).alias("cubic"))
    both = sample_linear(cells, queries, g, layer).join(cubic, [*key, "query_id"], "left")
    return both.select(*key, "query_id", F.coalesce("cubic", "value").alias("value"))


def polygon_safety(cells: DataFrame, polygons: DataFrame, layer: str, least: float, weak: float, allowed: int) -> DataFrame:
    """Per polygon (poly_id, and its cells ix, iy): mean traversability and whether it is safe: no cell under `least`, and
    at most `allowed` under `weak`."""
    key = map_key(cells, polygons)
    inside = polygons.join(cells.select(*key, "ix", "iy", F.col(layer).alias("value")), [*key, "ix", "iy"])
    g = inside.groupBy(*key, "poly_id").agg(F.avg("value").alias("mean"), F.min("value").alias("_m"), F.count_if(F.col("value") < weak).alias("n_weak"))
    return g.select(*key, "poly_id", "mean", ((F.col("_m") >= least) & (F.col("n_weak") <= allowed)).alias("is_safe"), "n_weak")


def circle_polygon(x: Column, y: Column, r: Column, n: int) -> Column:
    """n vertices about a circle in n - 1 steps: the last repeats the first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((x + r * F.cos(k * (2 * math.pi / (n - 1)))).alias("x"), (y + r * F.sin(k * (2 * math.pi / (n - 1)))).alias("y")))


def fan_triangles(polygons: DataFrame) -> DataFrame:
    """(poly_id, k, a, b, c): triangles of convex polygons from their first vertex."""
    k = F.explode(F.sequence(F.lit(1), F.size("vertices") - 2))
    return polygons.where(F.size("vertices") >= 3).withColumn("k", k).select("poly_id", "k", F.get("vertices", F.lit(0)).alias("a"), F.get("vertices", F.col("k")).alias("b"), F.get("vertices", F.col("k") + 1).alias("c"))


def accept_goals(goals: DataFrame, most: float) -> DataFrame:
    """Goals (east, north) within `most` metres of the origin, with distance and bearing."""
    d = F.sqrt(F.col("east") * F.col("east") + F.col("north") * F.col("north"))
    return goals.withColumn("distance", d).where(F.col("distance") <= most).withColumn("bearing", F.atan2("north", "east"))
