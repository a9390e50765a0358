"""Layered grid maps as sparse cell tables (map_id, ix, iy, layers): index (0, 0) is the corner with the largest x and y."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import saved


class Geometry:
    """Lengths, resolution and centre of a map; lengths become whole cells."""

    def __init__(self, length_x: float, length_y: float, resolution: float, x: float = 0.0, y: float = 0.0):
        self.nx, self.ny, self.resolution, self.x, self.y = round(length_x / resolution), round(length_y / resolution), resolution, x, y
        self.length_x, self.length_y = self.nx * resolution, self.ny * resolution

    def index(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Cell of a position, null outside. The edge with the largest coordinate is inside, the other is not."""
        ix, iy = F.floor((self.x + self.length_x / 2 - x) / self.resolution), F.floor((self.y + self.length_y / 2 - y) / self.resolution)
        inside = ix.between(0, self.nx - 1) & iy.between(0, self.ny - 1)
        return F.when(inside, ix.cast("int")), F.when(inside, iy.cast("int"))

    def center(self, ix: Column, iy: Column) -> tuple[Column, Column]:
        return self.x + self.length_x / 2 - (ix + 0.5) * self.resolution, self.y + self.length_y / 2 - (iy + 0.5) * self.resolution

    def linear(self, ix: Column, iy: Column, row_major: bool = False) -> Column:
        return ix * self.ny + iy if row_major else iy * self.nx + ix


def make_grid(spark, g: Geometry) -> DataFrame:
    return spark.range(g.nx * g.ny).select((F.col("id") % g.nx).cast("int").alias("ix"), F.floor(F.col("id") / g.nx).cast("int").alias("iy"))


def with_center(cells: DataFrame, g: Geometry) -> DataFrame:
    x, y = g.center(F.col("ix"), F.col("iy"))
    return cells.withColumn("x", x).withColumn("y", y)


def submap(cells: DataFrame, ix0: int, iy0: int, nx: int, ny: int) -> DataFrame:
    """Cells of a rectangle of indices: plain ranges, which reach the Parquet scan."""
    return cells.where(F.col("ix").between(ix0, ix0 + nx - 1) & F.col("iy").between(iy0, iy0 + ny - 1))


def cells_in_circle(cells: DataFrame, g: Geometry, x: float, y: float, r: float) -> DataFrame:
    near = with_center(cells, g).where(F.col("x").between(x - r, x + r) & F.col("y").between(y - r, y + r))
    return near.where(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2) <= r * r)


def cells_in_ellipse(cells: DataFrame, g: Geometry, x: float, y: float, a: float, b: float, turn: float) -> DataFrame:
    import math

    c, s = math.cos(turn), math.sin(turn)
    dx, dy = F.col("x") - x, F.col("y") - y
    return with_center(cells, g).where(F.pow((dx * c + dy * s) / a, 2) + F.pow((dx * s - dy * c) / b, 2) <= 1)


def spiral_cells(cells: DataFrame, g: Geometry, x: float, y: float, r: float) -> DataFrame:
    """Cells of a circle with `ring`, the whole distance in cells from the centre."""
    near = cells_in_circle(cells, g, x, y, r)
    return near.withColumn("ring", F.floor(F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2)) / g.resolution).cast("int"))


def cells_on_line(segments: DataFrame) -> DataFrame:
    """Bresenham cells of segments (seg_id, ix0, iy0, ix1, iy1), both ends included, with their step."""
    dx, dy = F.abs(F.col("ix1") - F.col("ix0")), F.abs(F.col("iy1") - F.col("iy0"))
    sx, sy = F.signum(F.col("ix1") - F.col("ix0")).cast("int"), F.signum(F.col("iy1") - F.col("iy0")).cast("int")
    n = F.greatest(dx, dy)
    base = segments.withColumns({"_n": n, "_dx": dx, "_dy": dy, "_sx": sx, "_sy": sy}).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    minor = lambda d: F.when(F.col("_n") == 0, 0).otherwise(F.floor((F.col("step") * d + F.floor(F.col("_n") / 2)) / F.col("_n")))
    across = F.when(F.col("_dx") >= F.col("_dy"), F.col("step")).otherwise(minor(F.col("_dx")))
    down = F.when(F.col("_dx") >= F.col("_dy"), minor(F.col("_dy"))).otherwise(F.col("step"))
    return base.select("seg_id", "step", (F.col("ix0") + F.col("_sx") * across).cast("int").alias("ix"), (F.col("iy0") + F.col("_sy") * down).cast("int").alias("iy"))


def window_agg(cells: DataFrame, layer: str, n: int, aggs: dict[str, Column], inside_only: bool = False) -> DataFrame:
    """Aggregates of `value` over each cell's n x n neighbourhood: each cell sends its value to the cells that see it, and
    partial sums meet before the shuffle. Only cells of the table get a row. With inside_only, only full windows do."""
    k = n // 2
    sent = cells.where(F.col(layer).isNotNull()).select("map_id", F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), F.col(layer).alias("value"))
    span = F.array(*[F.lit(d) for d in range(-k, k + 1)])
    sent = sent.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span)).select("map_id", (F.col("_ix") + F.col("_dx")).alias("ix"), (F.col("_iy") + F.col("_dy")).alias("iy"), "value")
    out = sent.groupBy("map_id", "ix", "iy").agg(F.count("*").alias("_n"), *[c.alias(name) for name, c in aggs.items()])
    if inside_only:
        out = out.where(F.col("_n") == n * n)
    return cells.select("map_id", "ix", "iy").join(out.drop("_n"), ["map_id", "ix", "iy"], "inner" if inside_only else "left")


def window_values(cells: DataFrame, g: Geometry, layer: str, n: int, edge: str) -> DataFrame:
    """(map_id, ix, iy, values) of each cell: the n x n values about it (n odd), x fastest, null where one is missing. At the edge of the
    map: `inside` leaves out cells whose window crosses it, `crop` only its places outside, `empty` gives null for those, `mean` the
    mean of the window's known values."""
    if edge not in ("inside", "crop", "empty", "mean"):
        raise ValueError(edge)
    k = n // 2
    span = F.array(*[F.lit(d) for d in range(-k, k + 1)])
    sent = cells.where(F.col(layer).isNotNull()).withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span))
    place = (k - F.col("_dy")) * n + (k - F.col("_dx"))
    sent = sent.select("map_id", (F.col("ix") + F.col("_dx")).alias("ix"), (F.col("iy") + F.col("_dy")).alias("iy"), F.struct(place.alias("k"), F.col(layer).cast("double").alias("v")).alias("_p"))
    seen = sent.groupBy("map_id", "ix", "iy").agg(F.map_from_entries(F.collect_list("_p")).alias("_known"), F.avg("_p.v").alias("_mean"))  # n * n at most
    both = cells.select("map_id", "ix", "iy").join(seen, ["map_id", "ix", "iy"], "left")
    x = lambda i: F.col("ix") + i % n - k
    y = lambda i: F.col("iy") + F.floor(i / n).cast("int") - k
    in_map = lambda i: x(i).between(0, g.nx - 1) & y(i).between(0, g.ny - 1)
    pad = F.col("_mean") if edge == "mean" else F.lit(None).cast("double")
    places = F.sequence(F.lit(0), F.lit(n * n - 1))
    if edge == "inside":
        both = both.where(F.col("ix").between(k, g.nx - 1 - k) & F.col("iy").between(k, g.ny - 1 - k))
    if edge == "crop":
        places = F.filter(places, in_map)
    values = F.transform(places, lambda i: F.when(in_map(i), F.try_element_at("_known", i)).otherwise(pad))
    return both.select("map_id", "ix", "iy", values.alias("values"))


def map_key(*tables: DataFrame) -> list[str]:
    """map_id where all tables have it: maps are then kept apart. Tables without it speak of one map."""
    return ["map_id"] if all("map_id" in t.columns for t in tables) else []


def sample_nearest(cells: DataFrame, queries: DataFrame, g: Geometry, layer: str) -> DataFrame:
    """queries (query_id, x, y, and map_id where cells are of several maps) with the value of the cell that holds them; null
    outside or where the cell is missing."""
    key = map_key(cells, queries)
    ix, iy = g.index(F.col("x"), F.col("y"))
    return queries.withColumn("ix", ix).withColumn("iy", iy).join(cells.select(*key, "ix", "iy", F.col(layer).alias("value")), [*key, "ix", "iy"], "left").select(*key, "query_id", "value")


def sample_linear(cells: DataFrame, queries: DataFrame, g: Geometry, layer: str) -> DataFrame:
    """Bilinear value from the four cells around a position, where all four are there; else the nearest. Queries as for
    sample_nearest."""
    key = map_key(cells, queries)
    u = (g.x + g.length_x / 2 - F.col("x")) / g.resolution - 0.5
    v = (g.y + g.length_y / 2 - F.col("y")) / g.resolution - 0.5
    q = queries.withColumn("_u", F.floor(u)).withColumn("_v", F.floor(v)).withColumn("_a", u - F.floor(u)).withColumn("_b", v - F.floor(v))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    q = q.withColumn("_c", corner)
    weight = F.when(F.col("_c.i") == 1, F.col("_a")).otherwise(1 - F.col("_a")) * F.when(F.col("_c.j") == 1, F.col("_b")).otherwise(1 - F.col("_b"))
    q = q.select(*key, "query_id", (F.col("_u") + F.col("_c.i")).cast("int").alias("ix"), (F.col("_v") + F.col("_c.j")).cast("int").alias("iy"), weight.alias("w"))
    near = q.join(cells.select(*key, "ix", "iy", F.col(layer).alias("value")), [*key, "ix", "iy"])
    lin = near.groupBy(*key, "query_id").agg(F.when(F.count("value") == 4, F.sum(F.col("w") * F.col("value"))).alias("linear"))
    return sample_nearest(cells, queries, g, layer).join(lin, [*key, "query_id"], "left").select(*key, "query_id", F.coalesce("linear", "value").alias("value"))


def change_resolution(cells: DataFrame, g: Geometry, new: Geometry, layer: str) -> DataFrame:
    """(map_id, query_id, value) of every cell of a new geometry, numbered x fastest: the bilinear value at its centre, or the nearest."""
    key = map_key(cells)
    place = F.explode(F.sequence(F.lit(0), F.lit(new.nx * new.ny - 1)))
    grid = cells.select(*key).distinct().select(*key, place.alias("query_id")) if key else cells.sparkSession.range(new.nx * new.ny).select(F.col("id").cast("int").alias("query_id"))
    centred = with_center(grid.select(*key, "query_id", (F.col("query_id") % new.nx).alias("ix"), F.floor(F.col("query_id") / new.nx).alias("iy")), new)
    return sample_linear(cells, centred.select(*key, "query_id", "x", "y"), g, layer)


def cells_between(cells: DataFrame, g: Geometry, layer: str, low: float, high: float) -> DataFrame:
    """Cells with their centre whose layer lies from low to high, both included."""
    return with_center(cells, g).where(F.col(layer).between(low, high))


def mark_points(points: DataFrame, g: Geometry) -> DataFrame:
    """(ix, iy) of the cells that hold a point."""
    ix, iy = g.index(F.col("x"), F.col("y"))
    return points.select(ix.alias("ix"), iy.alias("iy")).where("ix IS NOT NULL AND iy IS NOT NULL").distinct()


def cells_around(cells: DataFrame, poses: DataFrame, g: Geometry, key: list[str], reach: int) -> DataFrame:
    """(key, and the cells' columns) of the cells at most `reach` cells, along each axis, from where each pose (key, x, y) is; poses
    outside the map have none."""
    ix, iy = g.index(F.col("x"), F.col("y"))
    near = poses.select(*key, ix.alias("_px"), iy.alias("_py")).where("_px IS NOT NULL AND _py IS NOT NULL")
    span = near.select(*key, F.explode(F.sequence(F.col("_px") - reach, F.col("_px") + reach)).alias("ix"), "_py")
    span = span.select(*key, "ix", F.explode(F.sequence(F.col("_py") - reach, F.col("_py") + reach)).alias("iy"))
    return span.join(cells, [*map_key(cells, poses), "ix", "iy"])


def finite_stats(cells: DataFrame, layer: str, key: list[str]) -> DataFrame:
    c = F.when(~F.isnan(layer), F.col(layer))
    return cells.groupBy(*key).agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"))


def block_max(cells: DataFrame, layer: str, step: int) -> DataFrame:
    return cells.groupBy("map_id", F.floor(F.col("ix") / step).cast("int").alias("bx"), F.floor(F.col("iy") / step).cast("int").alias("by")).agg(F.max(layer).alias("value"))


def rekeyed(cells: DataFrame, source: Geometry, target: Geometry) -> DataFrame:
    """cells of one geometry on those of another: each target cell whose centre lies in a source cell becomes that cell."""
    places = {}
    for axis, index in (("x", "ix"), ("y", "iy")):
        top, low = ((getattr(g, axis) + getattr(g, f"length_{axis}") / 2) for g in (source, target))
        first = (low - top + F.col(index) * source.resolution) / target.resolution - 0.5
        last = first + source.resolution / target.resolution
        places[index] = F.explode(F.sequence(F.floor(first).cast("int"), F.ceil(last).cast("int")))
    spread = cells.withColumnsRenamed({"ix": "_ix", "iy": "_iy"}).withColumn("ix", F.col("_ix")).withColumn("ix", places["ix"]).withColumn("iy", F.col("_iy")).withColumn("iy", places["iy"])
    ix, iy = source.index(*target.center(F.col("ix"), F.col("iy")))
    inside = F.col("ix").between(0, target.nx - 1) & F.col("iy").between(0, target.ny - 1)
    return spread.where(inside & (ix == F.col("_ix")) & (iy == F.col("_iy"))).drop("_ix", "_iy")


def merge_maps(base: DataFrame, other: DataFrame, layer: str, overwrite: bool, basic: list[str] | None = None, g: Geometry | None = None, g_other: Geometry | None = None) -> DataFrame:
    """Cells of both; the other map's value where it has one and may be written: with overwrite everywhere, else where base's
    cell is not valid. A cell is valid when all its basic layers are there, without any never; basic=None asks for the layer
    itself. Where the maps differ in geometry, g and g_other place the other's cells on base's."""
    key = map_key(base, other)
    if g is not None and g_other is not None:
        other = rekeyed(other, g_other, g)
    a, b = F.col(f"a.{layer}"), F.col(f"b.{layer}")
    names = [layer] if basic is None else basic
    valid = reduce(lambda p, q: p & q, [F.col(f"a.{c}").isNotNull() & ~F.isnan(F.col(f"a.{c}").cast("double")) for c in names], F.lit(bool(names)))
    joined = base.alias("a").join(other.alias("b"), [*key, "ix", "iy"], "full_outer")
    written = F.coalesce(b, a)
    return joined.select(*key, "ix", "iy", (written if overwrite else F.when(F.coalesce(valid, F.lit(False)), a).otherwise(written)).alias(layer))


def max_merge(base: DataFrame, other: DataFrame, layer: str) -> DataFrame:
    key = map_key(base, other)
    joined = base.alias("a").join(other.alias("b"), [*key, "ix", "iy"], "full_outer")
    return joined.select(*key, "ix", "iy", F.greatest(f"a.{layer}", f"b.{layer}").alias(layer))


def move_map(cells: DataFrame, g: Geometry, shift_x: int, shift_y: int) -> DataFrame:
    """Cells still inside after the map moves by whole cells, with their new indices."""
    moved = cells.withColumn("ix", F.col("ix") + shift_x).withColumn("iy", F.col("iy") + shift_y)
    return moved.where(F.col("ix").between(0, g.nx - 1) & F.col("iy").between(0, g.ny - 1))


def apply_updates(base: DataFrame, patches: DataFrame, g: Geometry, layer: str) -> DataFrame:
    """Rectangular patches (seq, x, y, width, height, data) over base cells, the latest wins; patches out of bounds or with
    data of another length are left out. Patches have a map_id where base has several maps."""
    ok = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("width") <= g.nx) & (F.col("y") + F.col("height") <= g.ny) & (F.size("data") == F.col("width") * F.col("height"))
    key = map_key(base, patches)
    each = patches.where(ok).select(*key, "seq", "x", "y", "width", F.posexplode("data").alias("k", "v"))
    cells = each.select(*key, "seq", (F.col("x") + F.col("k") % F.col("width")).cast("int").alias("ix"), (F.col("y") + F.floor(F.col("k") / F.col("width"))).cast("int").alias("iy"), "v")
    latest = cells.groupBy(*key, "ix", "iy").agg(F.max_by("v", "seq").alias("v"))
    return base.join(latest, [*key, "ix", "iy"], "left").withColumn(layer, F.coalesce("v", layer)).drop("v")


def gradients(cells: DataFrame, layer: str, resolution: float) -> DataFrame:
    """Central differences along both axes, one-sided at borders and beside missing cells."""
    out = cells
    for a, other in (("ix", "iy"), ("iy", "ix")):
        w = W.partitionBy("map_id", other).orderBy(a)
        before = F.when(F.lag(a).over(w) == F.col(a) - 1, F.lag(layer).over(w))
        after = F.when(F.lead(a).over(w) == F.col(a) + 1, F.lead(layer).over(w))
        one = F.coalesce(after - F.col(layer), F.col(layer) - before)
        out = out.withColumn(f"d_{a}", F.coalesce((after - before) / 2, one) / resolution)
    return out


def to_occupancy(value: Column, low: float, high: float) -> Column:
    """0..100, truncated; -1 for missing."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.when(value.isNull(), -1).otherwise((share * 100).cast("int"))


def from_occupancy(messages: DataFrame, g: Geometry, layer: str) -> DataFrame:
    """Cells (and map_id, where there is one) of occupancy messages (data): values run from the last cell to the first, x fastest;
    -1 is unknown. Messages of another size are left out."""
    key, n = map_key(messages), g.nx * g.ny
    each = messages.where(F.size("data") == n).select(*key, F.posexplode("data").alias("k", "v")).withColumn("k", F.lit(n - 1) - F.col("k"))
    return each.select(*key, (F.col("k") % g.nx).cast("int").alias("ix"), F.floor(F.col("k") / g.nx).cast("int").alias("iy"), F.nullif(F.col("v").cast("double"), F.lit(-1.0)).alias(layer))


def to_occupancy_message(cells: DataFrame, g: Geometry, value: Column) -> DataFrame:
    """One message (map_id, data) a map of cells with a value as to_occupancy gives it; cells the map lacks are -1. A message is
    as long as the geometry has cells."""
    n = g.nx * g.ny
    known = cells.select("map_id", (F.lit(n - 1) - g.linear(F.col("ix"), F.col("iy"))).alias("k"), value.cast("int").alias("v")).groupBy("map_id", "k").agg(F.max("v").alias("v"))
    maps = known.groupBy("map_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("known"))
    return maps.select("map_id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("known", k.cast("int")), F.lit(-1))).alias("data"))


def inpaint(cells: DataFrame, layer: str, rounds: int, radius: int = 1) -> DataFrame:
    """Missing values filled from the mean of the known ones at most `radius` cells away along each axis, in rounds that are written
    and read, until none is missing or so many rounds were made."""
    for k in range(rounds):
        near = window_agg(cells, layer, 2 * radius + 1, {"_near": F.avg("value")})
        cells = cells.join(near, ["map_id", "ix", "iy"], "left").withColumn(layer, F.coalesce(layer, "_near")).drop("_near")
        if k + 1 < rounds:
            cells = saved(cells)
            if cells.where(F.col(layer).isNull()).isEmpty():
                break
    return cells


def elevation_fuse(points: DataFrame, g: Geometry, noise: float, threshold: float, outlier_variance: float) -> DataFrame:
    """(ix, iy, height, variance, n): inverse-variance mean of z per cell with variance noise * distance^2. Points further
    than `threshold` standard deviations from a first estimate only add outlier_variance."""
    ix, iy = g.index(F.col("x"), F.col("y"))
    var = F.greatest(noise * (F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), F.lit(1e-9))
    p = points.withColumn("ix", ix).withColumn("iy", iy).where("ix IS NOT NULL").withColumn("var", var)
    first = p.groupBy("ix", "iy").agg((F.sum(F.col("z") / F.col("var")) / F.sum(1 / F.col("var"))).alias("h0"))
    both = p.join(first, ["ix", "iy"]).withColumn("ok", F.pow(F.col("z") - F.col("h0"), 2) <= threshold * threshold * F.col("var"))
    good = lambda c: F.sum(F.when(F.col("ok"), c))
    out = both.groupBy("ix", "iy").agg((good(F.col("z") / F.col("var")) / good(1 / F.col("var"))).alias("height"), (1 / good(1 / F.col("var")) + outlier_variance * F.count_if(~F.col("ok"))).alias("variance"), F.count("*").alias("n"))
    return out
