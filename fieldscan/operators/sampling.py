"""Values between cells and nodes, maps as points, polygons as half planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import Geometry, map_key, with_center


def sample_cubic(cells: DataFrame, queries: DataFrame, g: Geometry, layer: str) -> DataFrame:
    """queries (query_id, x, y) with `value`: the bicubic Hermite surface through the four cells about the position, with
    central differences as slopes and twists. Cells beyond an edge are those of the edge. Null outside the map and where one
    of the cells is missing.

    The surface is a sum of weights times cells: the nine cells about each of four corners. They are gathered once for each place
    of the corners, so a query meets one row and is never multiplied.
    """
    key = map_key(cells, queries)
    ix, iy = g.index(F.col("x"), F.col("y"))
    placed = queries.withColumns({"_i": ix, "_j": iy})
    x0, y0 = g.center(F.col("_i"), F.col("_j"))
    cut = lambda k, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), k))
    low_i, low_j = F.when(F.col("x") > x0, F.col("_i")).otherwise(F.col("_i") + 1), F.when(F.col("y") > y0, F.col("_j")).otherwise(F.col("_j") + 1)
    placed = placed.withColumns({"_bi": low_i, "_bj": low_j})
    bx, by = g.center(cut(F.col("_bi"), g.nx), cut(F.col("_bj"), g.ny))
    placed = placed.withColumns({"_tx": (F.col("x") - bx) / g.resolution, "_ty": (F.col("y") - by) / g.resolution})
    options = [(a, b, dx, dy) for a in (0, 1) for b in (0, 1) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    options_of = F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(v).alias(k) for k, v in zip(("a", "b", "dx", "dy"), o, strict=True)]) for n, o in enumerate(options)])
    spots = placed.where("_i IS NOT NULL AND _j IS NOT NULL").select(*key, "_bi", "_bj").distinct().withColumn("_o", F.explode(options_of))
    # index falls as the coordinate rises: corner 1 is one index down, and the neighbour on the right is too
    at = lambda low, corner, d, n: cut(cut(F.col(low) - F.col(f"_o.{corner}"), n) + F.col(f"_o.{d}"), n)

    spots = spots.select(*key, "_bi", "_bj", F.col("_o.n").alias("_n"), at("_bi", "a", "dx", g.nx).alias("ix"), at("_bj", "b", "dy", g.ny).alias("iy"))
    found = spots.join(cells.select(*key, "ix", "iy", F.col(layer).alias("_v")), [*key, "ix", "iy"]).where("_v IS NOT NULL")
    gathered = found.groupBy(*key, "_bi", "_bj").agg(F.array_sort(F.collect_list(F.struct("_n", "_v"))).alias("_c"))
    gathered = gathered.where(F.size("_c") == len(options)).select(*key, "_bi", "_bj", F.col("_c._v").alias("_c"))

    def factor(t: str, corner: int, d: int) -> Column:
        u = F.col(t)
        if d == 0:
            return 3 * u * u - 2 * u * u * u if corner else 2 * u * u * u - 3 * u * u + 1
        return -d / 2 * (u * u * u - u * u if corner else u * u * u - 2 * u * u + u)

    total = sum((factor("_tx", a, dx) * factor("_ty", b, dy) * F.get("_c", F.lit(n)) for n, (a, b, dx, dy) in enumerate(options)), F.lit(0.0))
    inside = placed.withColumn("_bi", F.when(F.col("_j").isNotNull() & F.col("_i").isNotNull(), F.col("_bi")))
    return inside.join(gathered, [*key, "_bi", "_bj"], "left").select(*queries.columns, total.alias("value"))


def node_position(ix: Column, iy: Column, iz: Column, origin: tuple[float, float, float], resolution: float) -> tuple[Column, Column, Column]:
    """Nodes fall in x and y with the index and rise in z."""
    return origin[0] - ix * resolution, origin[1] - iy * resolution, origin[2] + iz * resolution


def sample_distance(nodes: DataFrame, queries: DataFrame, origin: tuple[float, float, float], resolution: float, size: tuple[int, int, int]) -> DataFrame:
    """queries (query_id, x, y, z) with `distance`: that of the nearest node of nodes (ix, iy, iz, d, gx, gy, gz) and its
    gradient times the way from it. Positions outside take the nearest node of the border."""
    raw = ((origin[0] - F.col("x")) / resolution, (origin[1] - F.col("y")) / resolution, (F.col("z") - origin[2]) / resolution)
    names = ("ix", "iy", "iz")
    index = {name: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), r)) + 0.5).cast("int") for name, r, n in zip(names, raw, size, strict=True)}
    found = queries.withColumns(index).join(nodes, list(names), "left")
    at = node_position(*map(F.col, names), origin, resolution)
    step = sum(F.col(f"g{c}") * (F.col(c) - p) for c, p in zip("xyz", at, strict=True))
    return found.select(*queries.columns, (F.col("d") + step).alias("distance"))


def sdf_to_points(nodes: DataFrame, origin: tuple[float, float, float], resolution: float, every: int, condition: Column) -> DataFrame:
    """(x, y, z, intensity) of every n-th node of each axis whose distance d meets the condition."""
    kept = nodes.where((F.col("ix") % every == 0) & (F.col("iy") % every == 0) & (F.col("iz") % every == 0)).where(condition)
    x, y, z = node_position(F.col("ix"), F.col("iy"), F.col("iz"), origin, resolution)
    return kept.select(x.alias("x"), y.alias("y"), z.alias("z"), F.col("d").alias("intensity"))


def grid_to_points(cells: DataFrame, g: Geometry, layers: list[str], z_layer: str, basic: list[str] = ()) -> DataFrame:
    """(x, y, z, layers): one point for each cell whose z_layer and basic layers are finite."""
    for name in {z_layer, *basic}:
        cells = cells.where(F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf")))
    return with_center(cells, g).select("x", "y", F.col(z_layer).alias("z"), *layers)


def add_layer(cells: DataFrame, name: str, value: float | Column | None = None) -> DataFrame:
    return cells.withColumn(name, value if isinstance(value, Column) else F.lit(value).cast("double"))


def clear_layers(cells: DataFrame, names: list[str]) -> DataFrame:
    """Those layers without a value; the cells stay."""
    return cells.withColumns({n: F.lit(None).cast(cells.schema[n].dataType) for n in names})


def drop_layer(cells: DataFrame, name: str) -> DataFrame:
    return cells.drop(name)


def sort_vertices(points: DataFrame, key: list[str]) -> DataFrame:
    """Vertices (key, x, y) with their `place` by x, then y."""
    return points.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy("x", "y")))


def polygon_halfplanes(polygons: DataFrame, key: str) -> DataFrame:
    """(key, edge, ax, ay, b): the inside of a convex polygon (key, i, x, y), vertices counter-clockwise from 0, is where
    ax * x + ay * y <= b on every edge. Edges in line with the vertices' mean give no half plane."""
    whole = W.partitionBy(key)
    centred = polygons.withColumns({"_cx": F.avg("x").over(whole), "_cy": F.avg("y").over(whole), "_n": F.count("*").over(whole)})
    centred = centred.withColumns({"_x": F.col("x") - F.col("_cx"), "_y": F.col("y") - F.col("_cy")})
    follow = centred.select(key, F.pmod(F.col("i") - 1, F.col("_n")).alias("i"), F.col("_x").alias("_x2"), F.col("_y").alias("_y2"))
    edges = centred.join(follow, [key, "i"])
    # a with a . v1 = 1 and a . v2 = 1, then moved back to the polygon's place
    det = F.col("_x") * F.col("_y2") - F.col("_y") * F.col("_x2")
    ax, ay = (F.col("_y2") - F.col("_y")) / F.col("_d"), (F.col("_x") - F.col("_x2")) / F.col("_d")
    edges = edges.withColumn("_d", det).where(F.abs("_d") > 1e-12)
    return edges.select(key, F.col("i").alias("edge"), ax.alias("ax"), ay.alias("ay"), (1 + ax * F.col("_cx") + ay * F.col("_cy")).alias("b"))


def channel_fuse(points: DataFrame, key: list[str], order: list[str], channel: str, rule: str, weight: float = 0.5) -> DataFrame:
    """(key, value): the channel's average in each cell, or its exponential mean in order: each value counts `weight`, what
    was before the rest, and the first whole."""
    if rule == "average":
        return points.groupBy(*key).agg(F.avg(channel).alias("value"))
    if rule != "exponential":
        raise ValueError(rule)
    w = W.partitionBy(*key)
    ranked = points.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    share = F.pow(F.lit(1 - weight), F.col("_n") - F.col("_r")) * F.when(F.col("_r") == 1, 1.0).otherwise(weight)
    return ranked.groupBy(*key).agg(F.sum(share * F.col(channel)).alias("value"))
