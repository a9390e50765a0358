"""Builders of polygons as arrays of vertices, and lines cut to a map."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Geometry, cells_on_line
from .mapping import circle_polygon


def _vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unit(x: Column, y: Column) -> Column:
    """The direction of a vector; null for none."""
    way = F.struct(x.alias("x"), y.alias("y"), F.hypot(x, y).alias("l"))
    return _let(way, lambda w: F.when(w["l"] > 0, F.struct((w["x"] / w["l"]).alias("x"), (w["y"] / w["l"]).alias("y"))))


def thick_line(ax: Column, ay: Column, bx: Column, by: Column, thickness: float) -> Column:
    """The four corners of a line from a to b, `thickness` wide to each side; null for a line of one point."""

    def corners(u: Column) -> Column:
        ox, oy = thickness * u["y"], -thickness * u["x"]
        return F.when(u.isNotNull(), F.array(_vertex(ax + ox, ay + oy), _vertex(ax - ox, ay - oy), _vertex(bx - ox, by - oy), _vertex(bx + ox, by + oy)))

    return _let(_unit(bx - ax, by - ay), corners)


def offset_inward(vertices: Column, margin: float) -> Column:
    """A convex polygon, counter-clockwise, with every edge `margin` further in. Each vertex moves along the sum of the directions
    to its neighbours; one in line with them stays."""

    def moved(vs: Column, v: Column, i: Column) -> Column:
        n = F.size(vs)
        before, after = F.get(vs, F.pmod(i - 1 + n, n)), F.get(vs, F.pmod(i + 1, n))
        ways = F.struct(*[_unit(o["x"] - v["x"], o["y"] - v["y"]).alias(name) for o, name in ((before, "a"), (after, "b"))])

        def pushed(w: Column) -> Column:
            sine = F.abs(w["a"]["x"] * w["b"]["y"] - w["a"]["y"] * w["b"]["x"])
            return _let(F.when(sine > 1e-12, margin / sine), lambda p: _vertex(*(v[c] + F.coalesce(p * (w["a"][c] + w["b"][c]), F.lit(0.0)) for c in "xy")))

        return _let(ways, pushed)

    return _let(vertices, lambda vs: F.transform(vs, lambda v, i: moved(vs, v, i)))


def hull_of_two_circles(ax: Column, ay: Column, bx: Column, by: Column, r: float, n: int) -> Column:
    """Half of n vertices, rounded up, about each of two circles of one radius, on the side away from the other; n about the
    circle where both are one."""
    half = math.ceil(n / 2)

    def side(u: Column, x: Column, y: Column, start: float) -> Column:
        turns = [start + j * math.pi / (half - 1) for j in range(half)]
        return F.array(*[_vertex(x + r * (math.cos(a) * u["x"] - math.sin(a) * u["y"]), y + r * (math.sin(a) * u["x"] + math.cos(a) * u["y"])) for a in turns])

    hull = _let(_unit(bx - ax, by - ay), lambda u: F.when(u.isNotNull(), F.concat(side(u, ax, ay, math.pi / 2), side(u, bx, by, 3 * math.pi / 2))))
    return F.coalesce(hull, circle_polygon(ax, ay, F.lit(r), n))


def lines_in_map(segments: DataFrame, g: Geometry) -> DataFrame:
    """(seg_id, step, ix, iy): cells of a map along segments (seg_id, x0, y0, x1, y1). An end outside moves towards the other in
    steps of a cell until it is inside; a segment whose end comes within a step of the other before gives no cell."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    lines = segments.withColumn("_l", length)
    most = F.greatest(F.lit(0), F.floor(F.col("_l") / g.resolution + 1e-12).cast("int") - 1)

    def first_inside(k: str, other: str) -> Column:
        """Cell of the first step that is inside: each axis says from which step on it can be, and the steps beside are tried too."""
        way = _unit(F.col(f"x{other}") - F.col(f"x{k}"), F.col(f"y{other}") - F.col(f"y{k}"))
        way = F.coalesce(way, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))

        def enters(u: Column, axis: str) -> Column:
            at, low, high = F.col(f"{axis}{k}"), getattr(g, axis) - getattr(g, f"length_{axis}") / 2, getattr(g, axis) + getattr(g, f"length_{axis}") / 2
            border = F.when(u[axis] > 0, F.lit(low) - at).when(u[axis] < 0, F.lit(high) - at)
            return F.greatest(F.lit(0), F.coalesce(F.floor(border / (u[axis] * g.resolution)), F.lit(0)))

        def tried(p: Column) -> Column:
            def at(i: Column) -> Column:
                ix, iy = g.index(F.col(f"x{k}") + i * g.resolution * p["u"]["x"], F.col(f"y{k}") + i * g.resolution * p["u"]["y"])
                return F.struct(ix.alias("ix"), iy.alias("iy"))

            steps = F.when(p["first"] <= p["last"], F.sequence(p["first"], p["last"]))
            return F.get(F.filter(F.transform(steps, at), lambda c: c["ix"].isNotNull() & c["iy"].isNotNull()), F.lit(0))

        def spans(u: Column) -> Column:
            first = F.greatest(enters(u, "x"), enters(u, "y")).cast("int")
            return _let(F.struct(u.alias("u"), F.greatest(F.lit(0), first - 1).alias("first"), F.least(most, first + 2).alias("last")), tried)

        return _let(way, spans)

    ends = {"0": first_inside("0", "1"), "1": first_inside("1", "0")}
    cut = lines.withColumns({f"_e{k}": e for k, e in ends.items()}).where("_e0 IS NOT NULL AND _e1 IS NOT NULL")
    return cells_on_line(cut.select("seg_id", *[F.col(f"_e{k}.{n}").alias(f"{n}{k}") for k in "01" for n in ("ix", "iy")]))
