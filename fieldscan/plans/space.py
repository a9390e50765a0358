"""Registered queries over points, grid cells and polygons: name -> (function of (spark, sf_dir), the same in SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distance, grid, points, scans
from ..sources import fixtures as fx
from .motion import rounded

MAP = grid.Geometry(52.0, 52.0, 1.0, 26.0, 26.0)
ID = ["l_orderkey", "l_linenumber", "l_partkey"]
POLYGON = [(5.0, 4.0), (40.0, 8.0), (45.0, 30.0), (22.0, 20.0), (10.0, 44.0)]
P, C, S = "f_points", "f_cells", "f_scans"
o = fx.oracle


def probes(spark, sf_dir):
    """Positions derived from the events: (query_id, x, y)."""
    return fx.topics(spark, sf_dir).selectExpr("seq AS query_id", "(seq * 37 % 5300) / 100.0D - 0.3D AS x", "value / 9.5D AS y")


PROBES = "probes AS (SELECT seq AS query_id, (seq * 37 % 5300) / 100.0::DOUBLE - 0.3::DOUBLE AS x, value / 9.5::DOUBLE AS y FROM f_topics)"


def voxels_q(spark, sf_dir):
    out = points.voxel_downsample(fx.points(spark, sf_dir), ["frame_id"], 5.0)
    return rounded(out, "x", "y", "z", digits=9)


VOXELS_SQL = "SELECT frame_id, CAST(floor(x / 5) AS BIGINT) AS vx, CAST(floor(y / 5) AS BIGINT) AS vy, CAST(floor(z / 5) AS BIGINT) AS vz, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, count(*) AS n FROM f_points GROUP BY 1, 2, 3, 4"


def voxel_center_q(spark, sf_dir):
    return points.voxel_nearest_center(fx.points(spark, sf_dir), ["frame_id"], 5.0, ID).select("frame_id", *ID)


VOXEL_CENTER_SQL = """SELECT frame_id, l_orderkey, l_linenumber, l_partkey FROM f_points QUALIFY row_number() OVER (PARTITION BY frame_id, floor(x / 5), floor(y / 5), floor(z / 5)
 ORDER BY round(pow(x - (floor(x / 5) + 0.5) * 5, 2) + pow(y - (floor(y / 5) + 0.5) * 5, 2) + pow(z - (floor(z / 5) + 0.5) * 5, 2), 9), l_orderkey, l_linenumber, l_partkey) = 1"""


def knn_q(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    out = points.knn_join(p.where("l_linenumber = 7"), p.select("frame_id", *ID, *"xyz"), ["frame_id"], ID, 5, 3.0, ID)
    return rounded(out.select("frame_id", *ID, "rank", "p_l_orderkey", "p_l_partkey", "d2"), "d2")


KNN_SQL = """, near AS (SELECT q.frame_id, q.l_orderkey, q.l_linenumber, q.l_partkey, p.l_orderkey AS po, p.l_linenumber AS pl, p.l_partkey AS pp, pow(q.x - p.x, 2) + pow(q.y - p.y, 2) + pow(q.z - p.z, 2) AS d2
 FROM f_points q JOIN f_points p ON q.frame_id = p.frame_id AND q.l_linenumber = 7 AND p.x BETWEEN q.x - 3.1 AND q.x + 3.1 WHERE pow(q.x - p.x, 2) + pow(q.y - p.y, 2) + pow(q.z - p.z, 2) <= 9.0)
 SELECT frame_id, l_orderkey, l_linenumber, l_partkey, r::INT AS rank, po AS p_l_orderkey, pp AS p_l_partkey, round(d2, 6) AS d2
 FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, l_orderkey, l_linenumber, l_partkey ORDER BY round(d2, 9), po, pl, pp) AS r FROM near) WHERE r <= 5"""


def knn_anywhere_q(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    asked = p.where("l_linenumber = 7 AND z > 0.55").select("frame_id", *ID, *"xyz").distinct()
    out = points.knn_anywhere(asked, p.where("z < 0.45").select("frame_id", *ID, *"xyz"), ["frame_id"], ID, 4, ID)
    return rounded(out.select("frame_id", *ID, "rank", "p_l_orderkey", "p_l_partkey", "d2"), "d2")


KNN_ANYWHERE_SQL = KNN_SQL.replace("FROM f_points q JOIN f_points p ON q.frame_id = p.frame_id AND q.l_linenumber = 7 AND p.x BETWEEN q.x - 3.1 AND q.x + 3.1 WHERE pow(q.x - p.x, 2) + pow(q.y - p.y, 2) + pow(q.z - p.z, 2) <= 9.0)", "FROM (SELECT DISTINCT frame_id, l_orderkey, l_linenumber, l_partkey, x, y, z FROM f_points WHERE l_linenumber = 7 AND z > 0.55) q JOIN f_points p ON q.frame_id = p.frame_id AND p.z < 0.45)").replace("WHERE r <= 5", "WHERE r <= 4")


def radius_q(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    near = points.radius_join(p.where("l_linenumber = 7"), p.select("frame_id", "x", "y", "z"), ["frame_id"], 2.0)
    return near.groupBy("frame_id").agg(F.count("*").alias("pairs"), F.round(F.sum("d2"), 4).alias("sum_d2"))


RADIUS_SQL = """SELECT q.frame_id, count(*) AS pairs, round(sum(pow(q.x - p.x, 2) + pow(q.y - p.y, 2) + pow(q.z - p.z, 2)), 4) AS sum_d2 FROM f_points q JOIN f_points p ON q.frame_id = p.frame_id AND q.l_linenumber = 7
 WHERE pow(q.x - p.x, 2) + pow(q.y - p.y, 2) + pow(q.z - p.z, 2) <= 4.0 GROUP BY 1"""


def boxes(spark, sf_dir):
    """A box for each part type, placed by its name's first parts."""
    part = fx.read(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
    return part.selectExpr("k AS box_id", "k % 40 + 0.5D AS x0", "k % 40 + 6.5D AS x1", "k % 17 + 0.25D AS y0", "k % 17 + 9.25D AS y1", "0.05D AS z0", "0.65D AS z1")


BOXES = "boxes AS (SELECT k AS box_id, k % 40 + 0.5::DOUBLE AS x0, k % 40 + 6.5::DOUBLE AS x1, k % 17 + 0.25::DOUBLE AS y0, k % 17 + 9.25::DOUBLE AS y1, 0.05::DOUBLE AS z0, 0.65::DOUBLE AS z1 FROM (SELECT min(p_partkey) AS k FROM part GROUP BY p_brand))"


def boxes_q(spark, sf_dir):
    return points.box_join(fx.points(spark, sf_dir), boxes(spark, sf_dir), 5.0).groupBy("box_id").agg(F.count("*").alias("n"))


def delete_boxes_q(spark, sf_dir):
    return points.in_box(fx.points(spark, sf_dir), boxes(spark, sf_dir), 5.0, keep=False).groupBy("frame_id").agg(F.count("*").alias("n"))


INSIDE = "x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1"


def polygon_q(spark, sf_dir):
    return fx.points(spark, sf_dir).where(points.point_in_polygon(F.col("x"), F.col("y"), POLYGON)).groupBy("frame_id").agg(F.count("*").alias("n"))


def polygon_sql(x: str = "x", y: str = "y") -> str:
    edges = zip(POLYGON, [*POLYGON[1:], POLYGON[0]], strict=True)
    return "(" + " + ".join(f"((({b} > {y}) <> ({d} > {y})) AND {x} < {a} + ({y} - {b}) * ({c} - {a}) / ({d} - {b})::DOUBLE)::INT" for (a, b), (c, d) in edges) + ") % 2 = 1"


def polygons(spark, sf_dir):
    """A triangle of each brand's box: (poly_id, vertices)."""
    xy = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return boxes(spark, sf_dir).select(F.col("box_id").alias("poly_id"), F.array(xy("x0", "y0"), xy("x1", "y0"), xy("x1", "y1")).alias("vertices"))


def polygons_q(spark, sf_dir):
    return points.points_in_polygons(fx.points(spark, sf_dir), polygons(spark, sf_dir), 5.0).groupBy("poly_id").agg(F.count("*").alias("n"))


POLYGONS_SQL = f""", {BOXES} SELECT box_id AS poly_id, count(*) AS n FROM f_points, boxes WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1
 AND (((y0 > y) <> (y1 > y)) AND x < x1)::INT + (((y1 > y) <> (y0 > y)) AND x < x1 + (y - y1) * (x0 - x1) / (y0 - y1))::INT = 1 GROUP BY 1"""


def measures_q(spark, sf_dir):
    return rounded(points.polygon_measures(polygons(spark, sf_dir)), "area", "cx", "cy")


MEASURES_SQL = f"WITH {BOXES} SELECT box_id AS poly_id, round((x1 - x0) * (y1 - y0) / 2, 6) AS area, round((x0 + 2 * x1) / 3, 6) AS cx, round((2 * y0 + y1) / 3, 6) AS cy, x0, x1, y0, y1 FROM boxes"


def hull_q(spark, sf_dir):
    return rounded(points.convex_hull(fx.points(spark, sf_dir), ["frame_id"]), "x", "y")


def planes_q(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    return rounded(points.fit_planes(p, ["frame_id"]), "a", "b", "c", digits=4)


PLANES_SQL = """, s AS (SELECT frame_id, count(*) AS n, sum(x*x) AS xx, sum(x*y) AS xy, sum(x*z) AS xz, sum(y*y) AS yy, sum(y*z) AS yz, sum(z*z) AS zz, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM f_points GROUP BY 1),
 d AS (SELECT *, xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz) AS det FROM s)
 SELECT frame_id, n, round(-(sx*(yy*zz - yz*yz) - xy*(sy*zz - yz*sz) + xz*(sy*yz - yy*sz)) / det, 4) AS a, round(-(xx*(sy*zz - yz*sz) - sx*(xy*zz - yz*xz) + xz*(xy*sz - sy*xz)) / det, 4) AS b,
 round(-(xx*(yy*sz - sy*yz) - xy*(xy*sz - sy*xz) + sx*(xy*yz - yy*xz)) / det, 4) AS c FROM d"""


def valid_planes_q(spark, sf_dir):
    p = fx.points(spark, sf_dir).withColumn("patch", F.floor(F.col("x") / 17) * 3 + F.floor(F.col("y") / 17))
    key = ["frame_id", "patch"]
    out = points.plane_validity(p, points.fit_planes(p, key).where("n >= 12"), key, 2.5)
    return rounded(out.select(*key, "n", "residual", "valid"), "residual", digits=3)


VALID_PLANES_SQL = (
    PLANES_SQL.replace("frame_id", "frame_id, patch").replace("FROM f_points GROUP BY 1)", "FROM q GROUP BY 1, 2)").replace(", s AS", ", q AS (SELECT *, (floor(x / 17) * 3 + floor(y / 17))::BIGINT AS patch FROM f_points), s AS", 1).replace("\n SELECT frame_id, patch, n, round(", ",\n p AS (SELECT frame_id, patch, n, round(", 1).replace(", 4)", ", 14)")
    + """ WHERE n >= 12)
 SELECT frame_id, patch, p.n, round(max(abs(a * x + b * y + c * z + 1) / sqrt(a * a + b * b + c * c)), 3) AS residual, max(abs(a * x + b * y + c * z + 1) / sqrt(a * a + b * b + c * c)) <= 2.5 AS valid FROM p JOIN q USING (frame_id, patch) GROUP BY 1, 2, 3"""
)


def import_q(spark, sf_dir):
    """Occupancy messages of the maps of frames, read back as cells."""
    small = grid.Geometry(13.0, 13.0, 4.0, 26.0, 26.0)
    cells = fx.points(spark, sf_dir).selectExpr("frame_id AS map_id", "CAST(floor(x / 18) AS INT) AS ix", "CAST(floor(y / 18) AS INT) AS iy", "z").groupBy("map_id", "ix", "iy").agg(F.max("z").alias("z"), F.count("*").alias("n"))
    value = grid.to_occupancy(F.when(F.col("n") % 4 > 0, F.round("z", 4)), 0.2, 0.9)
    return grid.from_occupancy(grid.to_occupancy_message(cells.where("n % 5 > 0"), small, value), small, "occupancy")


IMPORT_SQL = """, c AS (SELECT frame_id AS map_id, floor(x / 18)::INT AS ix, floor(y / 18)::INT AS iy, max(z) AS z, count(*) AS n FROM f_points GROUP BY ALL),
 k AS (SELECT map_id, ix, iy, CASE WHEN n % 4 > 0 THEN trunc(greatest(0, least(1, (round(z, 4) - 0.2::DOUBLE) / (0.9::DOUBLE - 0.2::DOUBLE))) * 100)::DOUBLE END AS occupancy FROM c WHERE n % 5 > 0)
 SELECT m.map_id, a.i::INT AS ix, b.i::INT AS iy, occupancy FROM (SELECT DISTINCT map_id FROM k) m CROSS JOIN range(3) a(i) CROSS JOIN range(3) b(i) LEFT JOIN k ON k.map_id = m.map_id AND k.ix = a.i AND k.iy = b.i"""


def clusters_q(spark, sf_dir):
    p = fx.points(spark, sf_dir).where("l_linenumber = 5").withColumn("pid", F.col("l_orderkey") * 1000000 + F.col("l_partkey"))
    first = p.groupBy("frame_id", "pid").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("z").alias("z"))
    return rounded(points.euclid_clusters(first, ["frame_id"], "pid", 2.0, 2), "x", "y", "z")


CLUSTERS_SQL = """, p AS (SELECT frame_id, l_orderkey * 1000000 + l_partkey AS pid, min(x) AS x, min(y) AS y, min(z) AS z FROM f_points WHERE l_linenumber = 5 GROUP BY 1, 2),
 e AS (SELECT a.frame_id, a.pid AS a, b.pid AS b FROM p a JOIN p b ON a.frame_id = b.frame_id WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 4.0),
 r(frame_id, pid, label) AS (SELECT frame_id, a, b FROM e UNION SELECT r.frame_id, r.pid, e.b FROM r JOIN e ON r.frame_id = e.frame_id AND r.label = e.a),
 l AS (SELECT frame_id, pid, min(label) AS cluster FROM r GROUP BY 1, 2)
 SELECT frame_id, cluster, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM l JOIN p USING (frame_id, pid) GROUP BY 1, 2 HAVING count(*) >= 2"""


def dedup_q(spark, sf_dir):
    return points.dedup_cells(fx.points(spark, sf_dir), ["frame_id"], 2.0, list(ID))


DEDUP_SQL = """SELECT frame_id, CAST(floor(x / 2) AS BIGINT) AS cx, CAST(floor(y / 2) AS BIGINT) AS cy, l_orderkey, l_linenumber, l_partkey FROM f_points
 QUALIFY row_number() OVER (PARTITION BY frame_id, floor(x / 2), floor(y / 2) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1"""


def cell_of_q(spark, sf_dir):
    ix, iy = MAP.index(F.col("x"), F.col("y"))
    return probes(spark, sf_dir).select("query_id", ix.alias("ix"), iy.alias("iy"), MAP.linear(ix, iy).alias("linear"))


CELL_OF_SQL = f""", {PROBES}, i AS (SELECT query_id, floor(52 - x) AS ix, floor(52 - y) AS iy FROM probes),
 k AS (SELECT query_id, CASE WHEN ix BETWEEN 0 AND 51 AND iy BETWEEN 0 AND 51 THEN ix::INT END AS ix, CASE WHEN ix BETWEEN 0 AND 51 AND iy BETWEEN 0 AND 51 THEN iy::INT END AS iy FROM i) SELECT *, iy * 52 + ix AS linear FROM k"""


def submap_q(spark, sf_dir):
    return rounded(grid.submap(fx.cells(spark, sf_dir), 10, 5, 20, 30).select("ix", "iy", "mean_z"), "mean_z")


def circle_q(spark, sf_dir):
    return rounded(grid.spiral_cells(fx.cells(spark, sf_dir), MAP, 20.2, 25.1, 9.7).select("ix", "iy", "ring", "max_z"), "max_z")


def ellipse_q(spark, sf_dir):
    return grid.cells_in_ellipse(fx.cells(spark, sf_dir), MAP, 20.2, 25.1, 12.3, 5.1, 0.0).select("ix", "iy")


def grid_polygon_q(spark, sf_dir):
    c = grid.with_center(grid.make_grid(spark, MAP), MAP).where(points.point_in_polygon(F.col("x"), F.col("y"), POLYGON))
    return c.join(fx.cells(spark, sf_dir).select("ix", "iy", "n"), ["ix", "iy"], "left")


def line_q(spark, sf_dir):
    seg = fx.topics(spark, sf_dir).selectExpr("seq AS seg_id", "CAST(seq % 31 AS INT) AS ix0", "CAST(seq % 17 AS INT) AS iy0", "CAST(seq * 7 % 43 AS INT) AS ix1", "CAST(seq * 3 % 41 AS INT) AS iy1")
    return grid.cells_on_line(seg).groupBy("ix", "iy").agg(F.count("*").alias("n"))


LINE_SQL = """, s AS (SELECT seq % 31 AS ix0, seq % 17 AS iy0, seq * 7 % 43 AS ix1, seq * 3 % 41 AS iy1 FROM f_topics),
 d AS (SELECT *, abs(ix1 - ix0) AS dx, abs(iy1 - iy0) AS dy, greatest(abs(ix1 - ix0), abs(iy1 - iy0)) AS n FROM s),
 e AS (SELECT *, unnest(range(n + 1)) AS i FROM d)
 SELECT CAST(ix0 + sign(ix1 - ix0) * CASE WHEN dx >= dy THEN i ELSE (i * dx + n // 2) // n END AS INT) AS ix, CAST(iy0 + sign(iy1 - iy0) * CASE WHEN dx < dy THEN i WHEN n = 0 THEN 0 ELSE (i * dy + n // 2) // n END AS INT) AS iy, count(*) AS n FROM e GROUP BY 1, 2"""


def window_q(spark, sf_dir):
    out = grid.window_agg(fx.cells(spark, sf_dir), "mean_z", 5, {"mean": F.avg("value"), "low": F.min("value"), "seen": F.count("*")})
    return rounded(out.drop("map_id"), "mean", "low")


WINDOW_SQL = """SELECT a.ix, a.iy, round(avg(b.mean_z), 6) AS mean, round(min(b.mean_z), 6) AS low, count(*) AS seen FROM f_cells a JOIN f_cells b ON abs(a.ix - b.ix) <= 2 AND abs(a.iy - b.iy) <= 2 GROUP BY 1, 2"""


def nearest_q(spark, sf_dir):
    return rounded(grid.sample_nearest(fx.cells(spark, sf_dir), probes(spark, sf_dir), MAP, "mean_z"), "value")


def linear_q(spark, sf_dir):
    return rounded(grid.sample_linear(fx.cells(spark, sf_dir), probes(spark, sf_dir), MAP, "mean_z"), "value")


LINEAR_SQL = f""", {PROBES}, q AS (SELECT *, 52 - x - 0.5 AS u, 52 - y - 0.5 AS v FROM probes),
 c AS (SELECT query_id, floor(u)::INT + i AS ix, floor(v)::INT + j AS iy, (CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM q, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
 l AS (SELECT query_id, CASE WHEN count(mean_z) = 4 THEN sum(w * mean_z) END AS lin FROM c JOIN f_cells USING (ix, iy) GROUP BY 1),
 n AS (SELECT query_id, mean_z FROM probes LEFT JOIN f_cells ON ix = floor(52 - x) AND iy = floor(52 - y) AND floor(52 - x) BETWEEN 0 AND 51 AND floor(52 - y) BETWEEN 0 AND 51)
 SELECT query_id, round(coalesce(lin, mean_z), 6) AS value FROM n LEFT JOIN l USING (query_id)"""


def stats_q(spark, sf_dir):
    return rounded(grid.finite_stats(fx.cells(spark, sf_dir, True), "mean_z", ["map_id"]), "total", "mean", "low", "high")


STATS_SQL = """, c AS (SELECT frame_id AS map_id, floor(52 - x) AS ix, floor(52 - y) AS iy, avg(z) AS mean_z FROM f_points GROUP BY 1, 2, 3)
 SELECT map_id, count(*) AS n, round(sum(mean_z), 6) AS total, round(avg(mean_z), 6) AS mean, round(min(mean_z), 6) AS low, round(max(mean_z), 6) AS high FROM c GROUP BY 1"""


def block_q(spark, sf_dir):
    return rounded(grid.block_max(fx.cells(spark, sf_dir), "mean_z", 4).drop("map_id"), "value")


def halves(spark, sf_dir):
    c = fx.cells(spark, sf_dir).select("ix", "iy", "mean_z")
    return c.where("(ix + iy) % 3 <> 0"), c.where("(ix * 2 + iy) % 5 <> 1").withColumn("mean_z", F.col("mean_z") + 1)


HALVES = ", a AS (SELECT ix, iy, mean_z FROM f_cells WHERE (ix + iy) % 3 <> 0), b AS (SELECT ix, iy, mean_z + 1 AS mean_z FROM f_cells WHERE (ix * 2 + iy) % 5 <> 1)"


def merge_q(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return rounded(grid.merge_maps(a, b, "mean_z", overwrite=False), "mean_z")


def max_merge_q(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return rounded(grid.max_merge(a, b, "mean_z"), "mean_z")


def move_q(spark, sf_dir):
    return rounded(grid.move_map(fx.cells(spark, sf_dir), MAP, 7, -11).select("ix", "iy", "mean_z"), "mean_z")


def updates_q(spark, sf_dir):
    patches = fx.topics(spark, sf_dir).selectExpr("seq", "CAST(seq % 60 AS INT) AS x", "CAST(seq * 7 % 50 AS INT) AS y", "3 AS width", "2 AS height", "transform(sequence(1, IF(seq % 70 = 0, 5, 6)), k -> seq + k / 10.0D) AS data")
    return rounded(grid.apply_updates(fx.cells(spark, sf_dir).select("ix", "iy", "mean_z"), patches, MAP, "mean_z"), "mean_z")


UPDATES_SQL = """, p AS (SELECT seq, seq % 60 AS x, seq * 7 % 50 AS y, unnest(range(6)) AS k FROM f_topics WHERE seq % 70 <> 0 AND seq % 60 + 3 <= 52 AND seq * 7 % 50 + 2 <= 52),
 l AS (SELECT (x + k % 3)::INT AS ix, (y + k // 3)::INT AS iy, arg_max(seq + (k + 1) / 10.0::DOUBLE, seq) AS v FROM p GROUP BY 1, 2) SELECT ix, iy, round(coalesce(v, mean_z), 6) AS mean_z FROM f_cells LEFT JOIN l USING (ix, iy)"""


def gradients_q(spark, sf_dir):
    out = grid.gradients(fx.cells(spark, sf_dir), "mean_z", 1.0)
    return rounded(out.select("ix", "iy", "d_ix", "d_iy"), "d_ix", "d_iy")


GRADIENTS_SQL = """SELECT c.ix, c.iy, round(coalesce((a.mean_z - b.mean_z) / 2, a.mean_z - c.mean_z, c.mean_z - b.mean_z), 6) + 0 AS d_ix, round(coalesce((d.mean_z - e.mean_z) / 2, d.mean_z - c.mean_z, c.mean_z - e.mean_z), 6) + 0 AS d_iy FROM f_cells c
 LEFT JOIN f_cells a ON a.ix = c.ix + 1 AND a.iy = c.iy LEFT JOIN f_cells b ON b.ix = c.ix - 1 AND b.iy = c.iy LEFT JOIN f_cells d ON d.ix = c.ix AND d.iy = c.iy + 1 LEFT JOIN f_cells e ON e.ix = c.ix AND e.iy = c.iy - 1"""


def occupancy_q(spark, sf_dir):
    v = F.when(F.col("n") > 15, F.round("mean_z", 4))
    return fx.cells(spark, sf_dir).select("ix", "iy", grid.to_occupancy(v, 0.2, 0.8).alias("occupancy"))


def distance_q(spark, sf_dir):
    c = grid.make_grid(spark, MAP).join(fx.cells(spark, sf_dir).select("ix", "iy", "n"), ["ix", "iy"], "left").withColumn("map_id", F.lit(0))
    return rounded(distance.distance_2d(c, F.coalesce(F.col("n") % 7 == 0, F.lit(False))).drop("map_id"), "distance")


DISTANCE_SQL = """, g AS (SELECT a.i::INT AS ix, b.i::INT AS iy, coalesce(n % 7 = 0, false) AS occ FROM range(52) a(i), range(52) b(i) LEFT JOIN f_cells c ON c.ix = a.i AND c.iy = b.i),
 d AS (SELECT a.ix, a.iy, a.occ, sqrt(min(pow(greatest(abs(a.ix - b.ix) - 0.5, 0), 2) + pow(greatest(abs(a.iy - b.iy) - 0.5, 0), 2))) AS d FROM g a JOIN g b ON a.occ <> b.occ GROUP BY 1, 2, 3)
 SELECT g.ix, g.iy, round(CASE WHEN g.occ THEN -d ELSE d END, 6) AS distance FROM g LEFT JOIN d USING (ix, iy)"""


def inpaint_q(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("mean_z", F.when((F.col("ix") + 2 * F.col("iy")) % 4 != 0, F.col("mean_z")))
    return rounded(grid.inpaint(c.select("map_id", "ix", "iy", "mean_z"), "mean_z", 1).drop("map_id"), "mean_z")


INPAINT_SQL = """, c AS (SELECT ix, iy, CASE WHEN (ix + 2 * iy) % 4 <> 0 THEN mean_z END AS mean_z FROM f_cells),
 m AS (SELECT a.ix, a.iy, avg(b.mean_z) AS m FROM c a JOIN c b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 GROUP BY 1, 2) SELECT ix, iy, round(coalesce(mean_z, m), 6) AS mean_z FROM c JOIN m USING (ix, iy)"""


def inpaint_wide_q(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("mean_z", F.when((F.floor(F.col("ix") / 7) + F.floor(F.col("iy") / 5)) % 2 != 0, F.col("mean_z")))
    return rounded(grid.inpaint(c.select("map_id", "ix", "iy", "mean_z"), "mean_z", 2, 2).drop("map_id"), "mean_z")


INPAINT_WIDE_SQL = ", c AS (SELECT ix, iy, CASE WHEN (ix // 7 + iy // 5) % 2 <> 0 THEN mean_z END AS mean_z FROM f_cells)" + "".join(
    f", m{k} AS (SELECT a.ix, a.iy, coalesce(a.mean_z, avg(b.mean_z)) AS mean_z FROM {t} a JOIN {t} b ON abs(a.ix - b.ix) <= 2 AND abs(a.iy - b.iy) <= 2 GROUP BY a.ix, a.iy, a.mean_z)" for k, t in ((1, "c"), (2, "m1"))
) + " SELECT ix, iy, round(mean_z, 6) AS mean_z FROM m2"


def edges_q(spark, sf_dir):
    """Sums of 5 x 5 windows with their edge at the mean, and how many places of them are missing with the edge empty or cropped."""
    c, key = fx.cells(spark, sf_dir), ["map_id", "ix", "iy"]
    v = {edge: grid.window_values(c, MAP, "mean_z", 5, edge).withColumnRenamed("values", edge) for edge in ("mean", "empty", "crop", "inside")}
    both = v["mean"].join(v["empty"], key).join(v["crop"], key).join(v["inside"], key, "left")
    total = F.aggregate("mean", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    missing = lambda edge: F.size(F.filter(edge, lambda x: x.isNull()))
    return rounded(both.select("ix", "iy", total.alias("total"), missing("empty").alias("n_empty"), missing("crop").alias("n_crop"), F.col("inside").isNotNull().alias("whole"), F.get("mean", F.lit(0)).alias("first")), "total", "first")


EDGES_SQL = """, w AS (SELECT a.ix, a.iy, dx.d AS dx, dy.d AS dy, a.ix + dx.d BETWEEN 0 AND 51 AND a.iy + dy.d BETWEEN 0 AND 51 AS inmap, b.mean_z AS v FROM f_cells a CROSS JOIN range(-2, 3) dx(d) CROSS JOIN range(-2, 3) dy(d) LEFT JOIN f_cells b ON b.ix = a.ix + dx.d AND b.iy = a.iy + dy.d),
 m AS (SELECT *, avg(v) OVER (PARTITION BY ix, iy) AS mean FROM w)
 SELECT ix, iy, round(sum(CASE WHEN inmap THEN coalesce(v, 0) ELSE mean END), 6) AS total, count(*) FILTER (WHERE v IS NULL)::INT AS n_empty, count(*) FILTER (WHERE inmap AND v IS NULL)::INT AS n_crop,
 ix BETWEEN 2 AND 49 AND iy BETWEEN 2 AND 49 AS whole, round(max(CASE WHEN dx = -2 AND dy = -2 THEN CASE WHEN inmap THEN v ELSE mean END END), 6) AS first FROM m GROUP BY ix, iy"""


#: Gift wrapping: from the smallest point on, the next corner is the one with the least turn to the left, the farthest of those in line.
HULL_SQL = """, p AS (SELECT DISTINCT frame_id, x, y FROM f_points), s AS (SELECT frame_id, min((x, y)) AS a FROM p GROUP BY 1),
 w(frame_id, step, x, y, sx, sy, way) AS (SELECT frame_id, 0, a[1], a[2], a[1], a[2], -pi() / 2 FROM s UNION ALL
 SELECT frame_id, step + 1, b[1], b[2], sx, sy, b[3] FROM (
  SELECT w.frame_id, w.step, w.sx, w.sy, arg_min((p.x, p.y, atan2(p.y - w.y, p.x - w.x)), (round((atan2(p.y - w.y, p.x - w.x) - way + 4 * pi() + 1e-9) % (2 * pi()), 8), -pow(p.x - w.x, 2) - pow(p.y - w.y, 2))) AS b
  FROM w JOIN p ON p.frame_id = w.frame_id AND (p.x <> w.x OR p.y <> w.y) GROUP BY w.frame_id, w.step, w.sx, w.sy) WHERE b[1] <> sx OR b[2] <> sy)
 SELECT frame_id, step, round(x, 6) AS x, round(y, 6) AS y FROM w"""


def elevation_q(spark, sf_dir):
    return rounded(grid.elevation_fuse(fx.points(spark, sf_dir), MAP, 1e-4, 2.0, 0.01), "height", "variance")


ELEVATION_SQL = """, p AS (SELECT floor(52 - x)::INT AS ix, floor(52 - y)::INT AS iy, z, greatest(1e-4 * (x*x + y*y + z*z), 1e-9) AS var FROM f_points WHERE floor(52 - x) BETWEEN 0 AND 51 AND floor(52 - y) BETWEEN 0 AND 51),
 f AS (SELECT ix, iy, sum(z / var) / sum(1 / var) AS h0 FROM p GROUP BY 1, 2), b AS (SELECT p.*, pow(z - h0, 2) <= 4.0 * var AS ok FROM p JOIN f USING (ix, iy))
 SELECT ix, iy, round(sum(z / var) FILTER (WHERE ok) / sum(1 / var) FILTER (WHERE ok), 6) AS height, round(1 / sum(1 / var) FILTER (WHERE ok) + 0.01 * count(*) FILTER (WHERE NOT ok), 6) AS variance, count(*) AS n FROM b GROUP BY 1, 2"""


def sectors_q(spark, sf_dir):
    return rounded(scans.sector_histogram(fx.scans(spark, sf_dir), 5, 0.3, 6.0), "level")


SECTORS_SQL = "SELECT scan_id, (beam // 5)::INT AS sector, round(coalesce(sum(CASE WHEN range BETWEEN 0.3 AND 6.0 THEN 6.0 - range END), 0), 6) AS level FROM f_scans GROUP BY 1, 2"


def full_circle_q(spark, sf_dir):
    s = fx.scans(spark, sf_dir)
    near = s.where("range IS NOT NULL").withColumn("beam", F.explode(F.array(*[F.pmod(F.col("beam") + k, F.lit(100)) for k in (-1, 0, 1)])))
    return near.select("scan_id", "beam", "range").unionByName(s.select("scan_id", "beam", F.lit(7.9).alias("range"))).groupBy("scan_id", "beam").agg(F.round(F.min("range"), 6).alias("range"))


FULL_CIRCLE_SQL = ", n AS (SELECT scan_id, ((beam + k + 100) % 100)::INT AS beam, range FROM f_scans, (VALUES (-1), (0), (1)) v(k) WHERE range IS NOT NULL UNION ALL SELECT scan_id, beam, 7.9 FROM f_scans) SELECT scan_id, beam, round(min(range), 6) AS range FROM n GROUP BY 1, 2"


def scan_stats_q(spark, sf_dir):
    return rounded(scans.scan_stats(fx.scans(spark, sf_dir), 9.0), "nearest")


def scan_points_q(spark, sf_dir):
    s = fx.scans(spark, sf_dir).where(F.col("range").between(0.3, 9.0))
    return s.select("scan_id", "beam", F.round(F.col("range") * F.cos("angle"), 6).alias("x"), F.round(F.col("range") * F.sin("angle"), 6).alias("y"))


QUERIES = {
    "p12_scan_to_points": (scan_points_q, o("SELECT scan_id, beam, round(range * cos(angle), 6) AS x, round(range * sin(angle), 6) AS y FROM f_scans WHERE range BETWEEN 0.3 AND 9.0", S)),
    "p34_cell_of": (cell_of_q, o(CELL_OF_SQL, "f_topics")),
    "j07_knn": (knn_q, o(KNN_SQL, P)),
    "j07_knn_anywhere": (knn_anywhere_q, o(KNN_ANYWHERE_SQL, P)),
    "j08_radius": (radius_q, o(RADIUS_SQL, P)),
    "j09_boxes": (boxes_q, o(f", {BOXES} SELECT box_id, count(*) AS n FROM f_points, boxes WHERE {INSIDE} GROUP BY 1", P)),
    "j09_delete_boxes": (delete_boxes_q, o(f", {BOXES} SELECT frame_id, count(*) AS n FROM f_points WHERE NOT EXISTS (SELECT 1 FROM boxes WHERE {INSIDE}) GROUP BY 1", P)),
    "j10_fixed_polygon": (polygon_q, o(f"SELECT frame_id, count(*) AS n FROM f_points WHERE {polygon_sql()} GROUP BY 1", P)),
    "j10_polygons": (polygons_q, o(POLYGONS_SQL, P)),
    "a01_finite_stats": (stats_q, o(STATS_SQL, P)),
    "a02_voxels": (voxels_q, o(VOXELS_SQL, P)),
    "a03_voxel_center": (voxel_center_q, o(VOXEL_CENTER_SQL, P)),
    "a05_full_circle": (full_circle_q, o(FULL_CIRCLE_SQL, S)),
    "a07_sectors": (sectors_q, o(SECTORS_SQL, S)),
    "a13_block_max": (block_q, o("SELECT (ix // 4)::INT AS bx, (iy // 4)::INT AS by, round(max(mean_z), 6) AS value FROM f_cells GROUP BY 1, 2", C)),
    "a15_scan_stats": (scan_stats_q, o("SELECT scan_id, count(*) FILTER (WHERE range < 9.0) AS n_valid, round(min(range), 6) AS nearest FROM f_scans GROUP BY 1", S)),
    "a18_polygon_measures": (measures_q, MEASURES_SQL),
    "a19_convex_hull": (hull_q, o(HULL_SQL, P).replace("WITH ", "WITH RECURSIVE ", 1)),
    "a20_elevation": (elevation_q, o(ELEVATION_SQL, P)),
    "a23_planes": (planes_q, o(PLANES_SQL, P)),
    "a23_valid_planes": (valid_planes_q, o(VALID_PLANES_SQL, P)),
    "s08_import": (import_q, o(IMPORT_SQL, P)),
    "g03_submap": (submap_q, o("SELECT ix, iy, round(mean_z, 6) AS mean_z FROM f_cells WHERE ix BETWEEN 10 AND 29 AND iy BETWEEN 5 AND 34", C)),
    "g05_ellipse": (ellipse_q, o("SELECT ix, iy FROM f_cells WHERE pow((52 - ix - 0.5 - 20.2) / 12.3, 2) + pow((52 - iy - 0.5 - 25.1) / 5.1, 2) <= 1", C)),
    "g06_polygon_cells": (grid_polygon_q, o(f", g AS (SELECT a.i::INT AS ix, b.i::INT AS iy, 52 - a.i - 0.5::DOUBLE AS x, 52 - b.i - 0.5::DOUBLE AS y FROM range(52) a(i), range(52) b(i)) SELECT ix, iy, x, y, n FROM g LEFT JOIN f_cells USING (ix, iy) WHERE {polygon_sql()}", C)),
    "g07_lines": (line_q, o(LINE_SQL, "f_topics")),
    "g08_spiral": (circle_q, o("SELECT ix, iy, floor(d)::INT AS ring, round(max_z, 6) AS max_z FROM (SELECT *, sqrt(pow(52 - ix - 0.5 - 20.2, 2) + pow(52 - iy - 0.5 - 25.1, 2)) AS d FROM f_cells) WHERE d <= 9.7", C)),
    "g09_window": (window_q, o(WINDOW_SQL, C)),
    "g10_nearest": (nearest_q, o(f", {PROBES} SELECT query_id, round(mean_z, 6) AS value FROM probes LEFT JOIN f_cells ON ix = floor(52 - x) AND iy = floor(52 - y) AND floor(52 - x) BETWEEN 0 AND 51 AND floor(52 - y) BETWEEN 0 AND 51", "f_topics", C)),
    "g11_linear": (linear_q, o(LINEAR_SQL, "f_topics", C)),
    "g17_inpaint": (inpaint_q, o(INPAINT_SQL, C)),
    "g09_edges": (edges_q, o(EDGES_SQL, C)),
    "g17_inpaint_wide": (inpaint_wide_q, o(INPAINT_WIDE_SQL, C)),
    "g18_distance": (distance_q, o(DISTANCE_SQL, C)),
    "g20_gradients": (gradients_q, o(GRADIENTS_SQL, C)),
    "s08_occupancy": (occupancy_q, o("SELECT ix, iy, CASE WHEN n > 15 THEN trunc(greatest(0, least(1, (round(mean_z, 4) - 0.2::DOUBLE) / (0.8::DOUBLE - 0.2::DOUBLE))) * 100)::INT ELSE -1 END AS occupancy FROM f_cells", C)),
    "t01_dedup_cells": (dedup_q, o(DEDUP_SQL, P)),
    "t02_clusters": (clusters_q, o(CLUSTERS_SQL, P).replace("WITH ", "WITH RECURSIVE ", 1)),
    "u01_merge_maps": (merge_q, o(HALVES + " SELECT ix, iy, round(coalesce(a.mean_z, b.mean_z), 6) AS mean_z FROM a FULL JOIN b USING (ix, iy)", C)),
    "u04_updates": (updates_q, o(UPDATES_SQL, "f_topics", C)),
    "u05_max_merge": (max_merge_q, o(HALVES + " SELECT ix, iy, round(greatest(a.mean_z, b.mean_z), 6) AS mean_z FROM a FULL JOIN b USING (ix, iy)", C)),
    "u08_move_map": (move_q, o("SELECT ix + 7 AS ix, iy - 11 AS iy, round(mean_z, 6) AS mean_z FROM f_cells WHERE ix + 7 <= 51 AND iy - 11 >= 0", C)),
}
