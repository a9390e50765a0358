"""Polygon builders on written-out shapes; lines cut to a map against a walk in steps."""

import math
import random

from pyspark.sql import functions as F

from fieldscan.operators import grid, points, polygons


def vertices(df, column):
    return [(round(v.x, 9), round(v.y, 9)) for v in df.select(column.alias("v")).first().v]


def ends(spark, *values):
    return spark.createDataFrame([tuple(map(float, values))], "x0 double, y0 double, x1 double, y1 double")


def columns():
    return [F.col(c) for c in ("x0", "y0", "x1", "y1")]


def test_thick_line(spark):
    assert vertices(ends(spark, 0, 0, 4, 0), polygons.thick_line(*columns(), 1.0)) == [(0, -1), (0, 1), (4, 1), (4, -1)]
    assert ends(spark, 1, 1, 1, 1).select(polygons.thick_line(*columns(), 1.0).alias("v")).first().v is None


def test_offset_inward(spark):
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    assert vertices(ends(spark, 0, 0, 0, 0), polygons.offset_inward(square, 0.5)) == [(0.5, 0.5), (2, 0), (3.5, 0.5), (3.5, 3.5), (0.5, 3.5)]


def test_hull_of_two_circles(spark):
    got = vertices(ends(spark, 0, 0, 10, 0), polygons.hull_of_two_circles(*columns(), 2.0, 6))
    assert got == [(0, 2), (-2, 0), (0, -2), (10, -2), (12, 0), (10, 2)]
    one = vertices(ends(spark, 3, 3, 3, 3), polygons.hull_of_two_circles(*columns(), 1.0, 5))
    assert one[0] == one[-1] == (4, 3) and len(one) == 5


def stepped(start, end, g):
    """The first place inside on the way from start to end in steps of a cell, as (ix, iy)."""
    length, place, k = math.dist(start, end), start, 0
    while True:
        ix, iy = (math.floor((c + n / 2 - p) / g.resolution) for c, n, p in zip((g.x, g.y), (g.length_x, g.length_y), place, strict=True))
        if 0 <= ix < g.nx and 0 <= iy < g.ny:
            return ix, iy
        k += 1
        if length - k * g.resolution < g.resolution - 1e-12:
            return None
        place = tuple(a + k * g.resolution * (b - a) / length for a, b in zip(start, end, strict=True))


def test_lines_are_cut_to_the_map(spark):
    g, rng = grid.Geometry(6.0, 4.0, 0.5, 1.0, -1.0), random.Random(3)
    rows = [(k, *(round(rng.uniform(-5, 6), 3) for _ in range(4))) for k in range(200)]
    rows += [(900, 1.0, -1.0, 1.0, -1.0), (901, 50.0, 50.0, 50.0, 50.0), (902, 1.01, -9.0, 1.01, 9.0), (903, -9.0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "seg_id int, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in polygons.lines_in_map(df, g).orderBy("seg_id", "step").collect():
        got.setdefault(r.seg_id, []).append((r.ix, r.iy))
    for k, x0, y0, x1, y1 in rows:
        a, b = stepped((x0, y0), (x1, y1), g), stepped((x1, y1), (x0, y0), g)
        if a is None or b is None:
            assert k not in got
        else:
            assert (got[k][0], got[k][-1]) == (a, b)
    assert got[900] == [stepped((1.0, -1.0), (1.0, -1.0), g)] and 901 not in got and 903 not in got


def test_hull_against_all_pairs(spark):
    rng = random.Random(4)
    groups = {k: [(rng.randint(0, 6) + 0.0, rng.randint(0, 6) + 0.0) for _ in range(n)] for k, n in ((1, 40), (2, 7), (3, 2))}
    df = spark.createDataFrame([(k, *p) for k, ps in groups.items() for p in ps], "k int, x double, y double").repartition(3)
    got = {}
    for r in points.convex_hull(df, ["k"]).orderBy("step").collect():
        got.setdefault(r.k, []).append((r.x, r.y))
    for k, ps in groups.items():
        ps = set(ps)
        side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        # corners: ends of an edge that has all others on its left or between its ends
        between = lambda a, b, c: min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
        edges = {(a, b) for a in ps for b in ps if a != b and all(side(a, b, c) > 0 or (side(a, b, c) == 0 and between(a, b, c)) for c in ps)}
        assert set(got[k]) == {a for a, _ in edges} and got[k][0] == min(ps)
