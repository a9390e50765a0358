"""Registered queries over maps: name -> (function of (spark, sf_dir), the same in SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detections, distance, grid, mapping, polygons
from ..sources import fixtures as fx
from . import space
from .motion import rounded
from .space import MAP, PROBES, probes

o = fx.oracle


def cubic_q(spark, sf_dir):
    return rounded(mapping.sample_convolved(fx.cells(spark, sf_dir), probes(spark, sf_dir), MAP, "mean_z"), "value")


W_SQL = "CASE WHEN abs({d}) <= 1 THEN 1.5*pow(abs({d}),3) - 2.5*pow(abs({d}),2) + 1 WHEN abs({d}) < 2 THEN -0.5*pow(abs({d}),3) + 2.5*pow(abs({d}),2) - 4*abs({d}) + 2 ELSE 0 END"
CUBIC_SQL = space.LINEAR_SQL.split(" SELECT query_id, round(")[0] + f""", lin AS (SELECT query_id, coalesce(lin, mean_z) AS v FROM n LEFT JOIN l USING (query_id)),
 kk AS (SELECT query_id, u, v, floor(u) + i AS a, floor(v) + j AS b FROM q, range(-1, 3) r(i), range(-1, 3) s(j)),
 cc AS (SELECT query_id, greatest(0, least(51, a))::INT AS ix, greatest(0, least(51, b))::INT AS iy, ({W_SQL.format(d='(u - a)')}) * ({W_SQL.format(d='(v - b)')}) AS w FROM kk),
 cub AS (SELECT query_id, CASE WHEN count(mean_z) = 16 THEN sum(w * mean_z) END AS value FROM cc LEFT JOIN f_cells USING (ix, iy) GROUP BY 1)
 SELECT query_id, round(coalesce(value, v), 6) AS value FROM cub JOIN lin USING (query_id)"""


def many_maps_q(spark, sf_dir):
    asked = probes(spark, sf_dir).withColumn("map_id", 1 + F.col("query_id") % 50)
    return rounded(grid.sample_linear(fx.cells(spark, sf_dir, True), asked, MAP, "mean_z"), "value")


#: The cells of each frame are a map of their own.
MANY_SQL = (
    space.LINEAR_SQL.replace("probes AS (SELECT seq AS query_id,", "fc AS (SELECT frame_id AS map_id, floor(52 - x)::INT AS ix, floor(52 - y)::INT AS iy, avg(z) AS mean_z FROM f_points GROUP BY ALL), probes AS (SELECT 1 + seq % 50 AS map_id, seq AS query_id,")
    .replace("SELECT query_id, floor(u)::INT", "SELECT map_id, query_id, floor(u)::INT")
    .replace("f_cells USING (ix, iy)", "fc USING (map_id, ix, iy)")
    .replace("SELECT query_id, mean_z FROM probes LEFT JOIN f_cells ON ix", "SELECT probes.map_id, query_id, mean_z FROM probes LEFT JOIN fc ON fc.map_id = probes.map_id AND ix")
    .replace(" SELECT query_id, round(coalesce", " SELECT map_id, query_id, round(coalesce")
)
COARSE = grid.Geometry(45.0, 42.0, 1.5, 24.3, 27.1)


def merge_geometries_q(spark, sf_dir):
    """A map of coarser cells at another place, merged into one that lacks a third of its cells."""
    ix, iy = COARSE.index(F.col("x"), F.col("y"))
    other = fx.points(spark, sf_dir).select(ix.alias("ix"), iy.alias("iy"), "z").where("ix IS NOT NULL AND iy IS NOT NULL").groupBy("ix", "iy").agg(F.avg("z").alias("mean_z"))
    base = fx.cells(spark, sf_dir).where("(ix + iy) % 3 <> 0").select("ix", "iy", "mean_z")
    return rounded(grid.merge_maps(base, other, "mean_z", False, ["mean_z"], MAP, COARSE), "mean_z")


MERGE_GEOMETRIES_SQL = """, b AS (SELECT floor((46.8::DOUBLE - x) / 1.5::DOUBLE)::INT AS jx, floor((48.1::DOUBLE - y) / 1.5::DOUBLE)::INT AS jy, avg(z) AS other FROM f_points WHERE floor((46.8::DOUBLE - x) / 1.5::DOUBLE) BETWEEN 0 AND 29 AND floor((48.1::DOUBLE - y) / 1.5::DOUBLE) BETWEEN 0 AND 27 GROUP BY 1, 2),
 r AS (SELECT a.i::INT AS ix, c.i::INT AS iy, floor((46.8::DOUBLE - (52 - (a.i + 0.5::DOUBLE))) / 1.5::DOUBLE)::INT AS jx, floor((48.1::DOUBLE - (52 - (c.i + 0.5::DOUBLE))) / 1.5::DOUBLE)::INT AS jy FROM range(52) a(i), range(52) c(i)),
 o AS (SELECT ix, iy, other FROM r JOIN b USING (jx, jy)), a AS (SELECT ix, iy, mean_z FROM f_cells WHERE (ix + iy) % 3 <> 0)
 SELECT ix, iy, round(coalesce(mean_z, other), 6) AS mean_z FROM a FULL JOIN o USING (ix, iy)"""
WIDE = grid.Geometry(60.0, 60.0, 1.5, 30.0, 20.0)
POSE = (0.1, -0.2, 0.3)
SHIFT = (7.0, -6.0, 0.25)


def transform_pose_q(spark, sf_dir):
    roll, pitch, yaw = POSE
    return rounded(mapping.transform_map(fx.cells(spark, sf_dir), MAP, "mean_z", ["n"], yaw, SHIFT, 0.25, roll, pitch, WIDE).drop("map_id"), "mean_z")


TURN = [" + ".join(f"({m!r}::DOUBLE) * {c}" for m, c in zip(row, ("px", "py", "mean_z"), strict=True)) for row in mapping.rotation(*POSE)]
TRANSFORM_POSE_SQL = f""", p AS (SELECT ix AS sx, iy AS sy, mean_z, n, 52 - (ix + 0.5) + dx AS px, 52 - (iy + 0.5) + dy AS py FROM f_cells, (VALUES (0, 0), (0.25, 0), (-0.25, 0), (0, 0.25), (0, -0.25)) d(dx, dy)),
 m AS (SELECT sx, sy, n, {TURN[0]} + 7 AS x, {TURN[1]} - 6 AS y, {TURN[2]} + 0.25 AS h FROM p)
 SELECT floor((60 - x) / 1.5)::INT AS ix, floor((50 - y) / 1.5)::INT AS iy, round(h, 6) AS mean_z, n FROM m WHERE floor((60 - x) / 1.5) BETWEEN 0 AND 39 AND floor((50 - y) / 1.5) BETWEEN 0 AND 39
 QUALIFY row_number() OVER (PARTITION BY floor((60 - x) / 1.5), floor((50 - y) / 1.5) ORDER BY h DESC, sx, sy) = 1"""


def segments(spark, sf_dir):
    return fx.topics(spark, sf_dir).selectExpr("seq AS seg_id", "(seq * 37 % 9000) / 100.0D - 20 AS x0", "value / 5 - 20 AS y0", "(seq * 53 % 8000) / 100.0D - 15 AS x1", "(seq % 100) * 0.7D - 9.3D AS y1")


SEGMENTS = "s AS (SELECT seq AS seg_id, (seq * 37 % 9000) / 100.0::DOUBLE - 20 AS x0, value / 5 - 20 AS y0, (seq * 53 % 8000) / 100.0::DOUBLE - 15 AS x1, (seq % 100) * 0.7::DOUBLE - 9.3::DOUBLE AS y1 FROM f_topics)"


def cut_lines_q(spark, sf_dir):
    return polygons.lines_in_map(segments(spark, sf_dir), MAP).groupBy("ix", "iy").agg(F.count("*").alias("n"), F.min("seg_id").alias("first"))


CUT_LINES_SQL = f""", {SEGMENTS}, l AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS d FROM s),
 t AS (SELECT *, unnest(range(0, greatest(0, floor(d + 1e-12)::INT - 1) + 1)) AS k FROM l),
 p AS (SELECT seg_id, k, floor(52 - (x0 + k * (x1 - x0) / d)) AS ax, floor(52 - (y0 + k * (y1 - y0) / d)) AS ay, floor(52 - (x1 + k * (x0 - x1) / d)) AS bx, floor(52 - (y1 + k * (y0 - y1) / d)) AS by_ FROM t),
 a AS (SELECT seg_id, arg_min(ax, k)::INT AS ix0, arg_min(ay, k)::INT AS iy0 FROM p WHERE ax BETWEEN 0 AND 51 AND ay BETWEEN 0 AND 51 GROUP BY 1), b AS (SELECT seg_id, arg_min(bx, k)::INT AS ix1, arg_min(by_, k)::INT AS iy1 FROM p WHERE bx BETWEEN 0 AND 51 AND by_ BETWEEN 0 AND 51 GROUP BY 1),
 d AS (SELECT *, abs(ix1 - ix0) AS dx, abs(iy1 - iy0) AS dy, greatest(abs(ix1 - ix0), abs(iy1 - iy0)) AS n FROM a JOIN b USING (seg_id)), e AS (SELECT *, unnest(range(n + 1)) AS i FROM d)
 SELECT CAST(ix0 + sign(ix1 - ix0) * CASE WHEN dx >= dy THEN i ELSE (i * dx + n // 2) // n END AS INT) AS ix, CAST(iy0 + sign(iy1 - iy0) * CASE WHEN dx < dy THEN i WHEN n = 0 THEN 0 ELSE (i * dy + n // 2) // n END AS INT) AS iy, count(*) AS n, min(seg_id) AS first FROM e GROUP BY 1, 2"""


def builders_q(spark, sf_dir):
    """Corners of thick lines, of those moved inward, and of the hull about circles at both ends."""
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    thick = polygons.thick_line(*ends, 1.5)
    made = {"thick": thick, "inward": polygons.offset_inward(F.reverse(thick), 0.25), "hull": polygons.hull_of_two_circles(*ends, 0.8, 7)}
    rows = segments(spark, sf_dir).select("seg_id", F.explode(F.array(*[F.struct(F.lit(n).alias("made"), v.alias("vertices")) for n, v in made.items()])).alias("p"))
    rows = rows.select("seg_id", "p.made", F.posexplode("p.vertices").alias("k", "v"))
    return rounded(rows.select("seg_id", "made", "k", F.col("v.x").alias("x"), F.col("v.y").alias("y")), "x", "y")


#: A thick line's corners are at right angles, so moving the edges in moves each corner by the margin along both.
BUILDERS_SQL = f""", {SEGMENTS}, u AS (SELECT *, (x1 - x0) / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS ux, (y1 - y0) / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS uy FROM s),
 c AS (SELECT seg_id, k, CASE WHEN k < 2 THEN x0 ELSE x1 END AS x, CASE WHEN k < 2 THEN y0 ELSE y1 END AS y, CASE WHEN k IN (0, 3) THEN 1 ELSE -1 END AS side, CASE WHEN k < 2 THEN 1 ELSE -1 END AS along, ux, uy FROM u, range(4) r(k)),
 h AS (SELECT seg_id, k, CASE WHEN k < 4 THEN x0 ELSE x1 END AS x, CASE WHEN k < 4 THEN y0 ELSE y1 END AS y, pi() * (CASE WHEN k < 4 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END + (k % 4) / 3.0::DOUBLE) AS a, ux, uy FROM u, range(8) r(k))
 SELECT seg_id, 'thick' AS made, k::INT AS k, round(x + side * 1.5 * uy, 6) AS x, round(y - side * 1.5 * ux, 6) AS y FROM c
 UNION ALL SELECT seg_id, 'inward', (3 - k)::INT, round(x + side * 1.25 * uy + along * 0.25 * ux, 6), round(y - side * 1.25 * ux + along * 0.25 * uy, 6) FROM c
 UNION ALL SELECT seg_id, 'hull', k::INT, round(x + 0.8 * (cos(a) * ux - sin(a) * uy), 6), round(y + 0.8 * (sin(a) * ux + cos(a) * uy), 6) FROM h"""


def rotate_q(spark, sf_dir):
    return rounded(mapping.rotate_map(fx.cells(spark, sf_dir), MAP, "mean_z", 0.5).drop("map_id"), "value")


ROTATE_SQL = """, n AS (SELECT a.i::INT AS ix, b.i::INT AS iy, 52 - (a.i + 0.5::DOUBLE) - 26 AS dx, 52 - (b.i + 0.5::DOUBLE) - 26 AS dy FROM range(52) a(i), range(52) b(i)),
 s AS (SELECT ix, iy, floor(52 - (cos(0.5::DOUBLE) * dx + sin(0.5::DOUBLE) * dy + 26)) AS ox, floor(52 - (-sin(0.5::DOUBLE) * dx + cos(0.5::DOUBLE) * dy + 26)) AS oy FROM n)
 SELECT s.ix, s.iy, round(mean_z, 6) AS value FROM s LEFT JOIN f_cells c ON c.ix = ox AND c.iy = oy AND ox BETWEEN 0 AND 51 AND oy BETWEEN 0 AND 51"""


def transform_q(spark, sf_dir):
    return rounded(mapping.transform_map(fx.cells(spark, sf_dir), MAP, "mean_z", ["n"], 0.3, (7.0, -6.0, 0.25)).drop("map_id"), "mean_z")


TRANSFORM_SQL = """, m AS (SELECT ix AS sx, iy AS sy, mean_z + 0.25 AS h, n, cos(0.3::DOUBLE) * (52 - ix - 0.5) - sin(0.3::DOUBLE) * (52 - iy - 0.5) + 7 AS x, sin(0.3::DOUBLE) * (52 - ix - 0.5) + cos(0.3::DOUBLE) * (52 - iy - 0.5) - 6 AS y FROM f_cells)
 SELECT floor(52 - x)::INT AS ix, floor(52 - y)::INT AS iy, round(h, 6) AS mean_z, n FROM m WHERE floor(52 - x) BETWEEN 0 AND 51 AND floor(52 - y) BETWEEN 0 AND 51 QUALIFY row_number() OVER (PARTITION BY floor(52 - x), floor(52 - y) ORDER BY h DESC, sx, sy) = 1"""


def distance_3d_q(spark, sf_dir):
    return rounded(distance.distance_3d(fx.cells(spark, sf_dir), "mean_z", HEIGHTS, 0.5).drop("map_id"), "distance")


HEIGHTS = [-1.0, 0.3, 0.45, 0.55, 2.0]
DISTANCE_3D_SQL = f""", g AS (SELECT k::INT AS iz, ix, iy, (h - mean_z) / 0.5 AS rise FROM f_cells, (VALUES {", ".join(f"({k}, {h}::DOUBLE)" for k, h in enumerate(HEIGHTS))}) z(k, h)),
 d AS (SELECT a.iz, a.ix, a.iy, min(pow(greatest(abs(a.ix - b.ix) - 0.5, 0), 2) + pow(greatest(abs(a.iy - b.iy) - 0.5, 0), 2) + pow(greatest(b.rise, 0), 2)) AS over_, min(pow(greatest(abs(a.ix - b.ix) - 0.5, 0), 2) + pow(greatest(abs(a.iy - b.iy) - 0.5, 0), 2) + pow(least(b.rise, 0), 2)) AS under_ FROM g a JOIN g b USING (iz) GROUP BY 1, 2, 3)
 SELECT iz, ix, iy, round(0.5 * (sqrt(over_) - sqrt(under_)), 6) AS distance FROM d"""


def safety_q(spark, sf_dir):
    tiles = fx.cells(spark, sf_dir).select((F.floor(F.col("ix") / 13) * 4 + F.floor(F.col("iy") / 13)).alias("poly_id"), "ix", "iy")
    return rounded(mapping.polygon_safety(fx.cells(spark, sf_dir), tiles, "mean_z", 0.25, 0.42, 12), "mean")


SAFETY_SQL = "SELECT (ix // 13) * 4 + iy // 13 AS poly_id, round(avg(mean_z), 6) AS mean, min(mean_z) >= 0.25 AND count(*) FILTER (WHERE mean_z < 0.42) <= 12 AS is_safe, count(*) FILTER (WHERE mean_z < 0.42) AS n_weak FROM f_cells GROUP BY 1"


def fan_q(spark, sf_dir):
    b = space.boxes(spark, sf_dir)
    xy = lambda a, c: F.struct(F.col(a).alias("x"), F.col(c).alias("y"))
    quads = b.select(F.col("box_id").alias("poly_id"), F.array(xy("x0", "y0"), xy("x1", "y0"), xy("x1", "y1"), xy("x0", "y1")).alias("vertices"))
    t = mapping.fan_triangles(quads)
    area = F.abs((F.col("b.x") - F.col("a.x")) * (F.col("c.y") - F.col("a.y")) - (F.col("c.x") - F.col("a.x")) * (F.col("b.y") - F.col("a.y"))) / 2
    return t.select("poly_id", "k", F.round(area, 6).alias("area"))


def goals_q(spark, sf_dir):
    g = fx.topics(spark, sf_dir).selectExpr("seq", "value - 200 AS east", "(seq % 400) - 200.0D AS north")
    return rounded(mapping.accept_goals(g, 180.0), "east", "distance", "bearing")


def make_grid_q(spark, sf_dir):
    return grid.make_grid(spark, space.MAP).join(fx.cells(spark, sf_dir).select("ix", "iy", "n"), ["ix", "iy"], "left")


def circle_q(spark, sf_dir):
    return rounded(grid.cells_in_circle(fx.cells(spark, sf_dir), space.MAP, 20.2, 25.1, 9.7).select("ix", "iy", "mean_z"), "mean_z")


def extend_q(spark, sf_dir):
    wide = mapping.extend_geometry(space.MAP, grid.Geometry(30.0, 20.0, 1.0, 60.0, 10.0))
    ix, iy = wide.index(F.col("x"), F.col("y"))
    return grid.with_center(fx.cells(spark, sf_dir), space.MAP).select(ix.alias("ix"), iy.alias("iy"), "n", F.lit(wide.nx).alias("nx"), F.lit(wide.ny).alias("ny"))


def box_depth_q(spark, sf_dir):
    pixels = fx.points(spark, sf_dir).selectExpr("frame_id AS frame", "l_partkey % 64 AS u", "l_orderkey % 48 AS v", "CASE WHEN x > 3 THEN x / 5 END AS depth")
    boxes = fx.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("det_id"))
    boxes = boxes.selectExpr("frame", "det_id", "frame % 20 + det_id * 10 AS x_min", "frame % 20 + det_id * 10 + 24 AS x_max", "frame % 12 AS y_min", "frame % 12 + 30 AS y_max", "frame % 20 + det_id * 10 + 12 AS center_u", "frame % 12 + 15 AS center_v")
    return rounded(detections.depth_in_boxes(pixels, boxes, 5, 12), "depth")


BOX_DEPTH_SQL = """, b AS (SELECT s_suppkey AS frame, d AS det_id, s_suppkey % 20 + d * 10 AS x0, s_suppkey % 12 AS y0 FROM supplier, (VALUES (0), (1), (2)) AS vd(d)),
 p AS (SELECT frame, det_id, abs(l_partkey % 64 - x0 - 12) <= 5 AND abs(l_orderkey % 48 - y0 - 15) <= 5 AS w, l_partkey % 64 BETWEEN x0 + 6 AND x0 + 18 AND l_orderkey % 48 BETWEEN y0 + 7.5 AND y0 + 22.5 AS i, x / 5 AS depth
 FROM b JOIN f_points ON frame_id = frame WHERE x > 3 AND l_partkey % 64 BETWEEN x0 AND x0 + 24 AND l_orderkey % 48 BETWEEN y0 AND y0 + 30),
 s AS (SELECT frame, det_id, CASE WHEN count(*) FILTER (WHERE w) >= 12 THEN median(depth) FILTER (WHERE w) WHEN count(*) FILTER (WHERE i) >= 12 THEN median(depth) FILTER (WHERE i) END AS depth FROM p GROUP BY 1, 2)
 SELECT frame, det_id, round(depth, 6) AS depth FROM b LEFT JOIN s USING (frame, det_id)"""

QUERIES = {
    "g01_make_grid": (make_grid_q, o("SELECT a.i::INT AS ix, b.i::INT AS iy, n FROM range(52) a(i), range(52) b(i) LEFT JOIN f_cells ON ix = a.i AND iy = b.i", "f_cells")),
    "g04_circle": (circle_q, o("SELECT ix, iy, round(mean_z, 6) AS mean_z FROM f_cells WHERE pow(52 - ix - 0.5 - 20.2, 2) + pow(52 - iy - 0.5 - 25.1, 2) <= 9.7 * 9.7", "f_cells")),
    "u02_extend": (extend_q, o("SELECT ix + 23 AS ix, iy, n, 75 AS nx, 52 AS ny FROM f_cells", "f_cells")),
    "a11_box_depth": (box_depth_q, o(BOX_DEPTH_SQL, "f_points")),
    "p39_accept_goals": (goals_q, o("SELECT seq, round(east, 6) AS east, north, round(sqrt(east*east + north*north), 6) AS distance, round(atan2(north, east), 6) AS bearing FROM (SELECT seq, value - 200 AS east, (seq % 400) - 200.0::DOUBLE AS north FROM f_topics) WHERE sqrt(east*east + north*north) <= 180", "f_topics")),
    "a22_polygon_safety": (safety_q, o(SAFETY_SQL, "f_cells")),
    "g12_cubic": (cubic_q, o(CUBIC_SQL, "f_topics", "f_cells")),
    "g14_transform_map": (transform_q, o(TRANSFORM_SQL, "f_cells")),
    "g07_cut_lines": (cut_lines_q, o(CUT_LINES_SQL, "f_topics")),
    "g23_polygon_builders": (builders_q, o(BUILDERS_SQL, "f_topics")),
    "g11_many_maps": (many_maps_q, o(MANY_SQL, "f_topics", "f_points")),
    "g14_transform_pose": (transform_pose_q, o(TRANSFORM_POSE_SQL, "f_cells")),
    "u01_merge_geometries": (merge_geometries_q, o(MERGE_GEOMETRIES_SQL, "f_points", "f_cells")),
    "g15_rotate_map": (rotate_q, o(ROTATE_SQL, "f_cells")),
    "g19_distance_3d": (distance_3d_q, o(DISTANCE_3D_SQL, "f_cells")),
    "g23_fan_triangles": (fan_q, f"WITH {space.BOXES} SELECT box_id AS poly_id, k::INT AS k, round((x1 - x0) * (y1 - y0) / 2, 6) AS area FROM boxes, (VALUES (1), (2)) v(k)"),
}
