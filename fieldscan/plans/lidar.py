"""Registered queries over lidar points, frames, node grids and run health: name -> (function, the same in SQL)."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import frames
from ..operators import grid, health, lidar, sampling, windows
from ..sources import fixtures as fx
from . import motion
from .motion import rounded
from .space import MAP

o = fx.oracle
T, P, C, S, O = "f_topics", "f_points", "f_cells", "f_scans", "f_odom"


def shots(spark, sf_dir):
    """Points with a time inside their scan."""
    return fx.points(spark, sf_dir).selectExpr("frame_id AS scan_id", "(l_orderkey * 8 + l_linenumber) * 10000000000 + l_partkey * 100000 + frame_id AS seq", "(l_partkey % 100) * 0.001D AS t", "x", "y", "z")


SHOTS = "shots AS (SELECT frame_id AS scan_id, (l_orderkey * 8 + l_linenumber) * 10000000000 + l_partkey * 100000 + frame_id AS seq, (l_partkey % 100) * 0.001::DOUBLE AS t, x, y, z FROM f_points)"


def deskew_q(spark, sf_dir):
    s = fx.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scan_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    yaw = "(scan_id % 50) * 0.01D + k * 0.03D"
    poses = s.selectExpr("scan_id", "CAST(k AS BIGINT) AS seq", "0.005D + k * 0.02D AS t", "0.0D AS qx", "0.0D AS qy", f"sin(({yaw}) / 2) AS qz", f"cos(({yaw}) / 2) AS qw", "k * 0.1D AS px", "k * 0.05D AS py", "0.0D AS pz", "5.0D AS vx", "2.5D AS vy", "0.1D AS vz", "1.0D AS ax", "-0.5D AS ay", "0.2D AS az", "0.0D AS wx", "0.0D AS wy", "1.5D AS wz")
    end = "(scan_id % 50) * 0.01D + 0.15D"
    ends = s.where("k = 0").selectExpr("scan_id", "0.0D AS qx", "0.0D AS qy", f"sin(({end}) / 2) AS qz", f"cos(({end}) / 2) AS qw", "0.5D AS px", "0.25D AS py", "0.01D AS pz")
    out = lidar.deskew(shots(spark, sf_dir), poses, ends, shift=(0.1, 0.02, 0.05))
    return rounded(out.drop("t"), "x", "y", "z", digits=5)


DESKEW_SQL = f""", {SHOTS}, k AS (SELECT *, CASE WHEN t > 0.005 THEN ceil((t - 0.005::DOUBLE) / 0.02::DOUBLE - 1e-9) - 1 END AS k FROM shots),
 m AS (SELECT *, t - (0.005::DOUBLE + least(k, 4) * 0.02::DOUBLE) AS dt, least(k, 4) AS kk, (scan_id % 50) * 0.01::DOUBLE + 0.15 AS ye FROM k),
 r AS (SELECT *, (scan_id % 50) * 0.01::DOUBLE + kk * 0.03 + 1.5 * dt AS ya FROM m),
 w AS (SELECT *, cos(ya) * (x + 0.1) - sin(ya) * (y + 0.02) + kk * 0.1::DOUBLE + 5 * dt + 0.5 * dt * dt - 0.5 AS wx, sin(ya) * (x + 0.1) + cos(ya) * (y + 0.02) + kk * 0.05::DOUBLE + 2.5 * dt - 0.25 * dt * dt - 0.25 AS wy, z + 0.05 + 0.1 * dt + 0.1 * dt * dt - 0.01 AS wz FROM r)
 SELECT scan_id, seq, round(CASE WHEN k IS NULL THEN x ELSE cos(ye) * wx + sin(ye) * wy - 0.1 END, 5) AS x, round(CASE WHEN k IS NULL THEN y ELSE cos(ye) * wy - sin(ye) * wx - 0.02 END, 5) AS y, round(CASE WHEN k IS NULL THEN z ELSE wz - 0.05 END, 5) AS z FROM w"""


def residuals_q(spark, sf_dir):
    planes = fx.read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS frame_id", "0.1D AS a", "s_suppkey % 7 * 0.1D AS b", "2.0D AS c", "-(s_suppkey % 11) * 0.4D AS d")
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    out = lidar.fit_residuals(fx.points(spark, sf_dir), planes, ["frame_id"], norm)
    return rounded(out.select("frame_id", "l_orderkey", "l_linenumber", "residual"), "residual")


RESIDUALS_SQL = """, p AS (SELECT *, (0.1 * x + frame_id % 7 * 0.1 * y + 2 * z - frame_id % 11 * 0.4) / sqrt(0.01 + pow(frame_id % 7 * 0.1::DOUBLE, 2) + 4) AS r FROM f_points JOIN supplier ON s_suppkey = frame_id)
 SELECT frame_id, l_orderkey, l_linenumber, round(r, 6) AS residual FROM p WHERE 1 - 0.9 * abs(r) / sqrt(sqrt(x*x + y*y + z*z)) > 0.9"""


def yaw_times_q(spark, sf_dir):
    p = fx.points(spark, sf_dir).selectExpr("frame_id", "line", "(l_orderkey * 8 + l_linenumber) * 10000000000 + l_partkey * 100000 + frame_id AS seq", "x - 25 AS x", "y - 20 AS y")
    return rounded(lidar.point_times_from_yaw(p, ["frame_id", "line"], 3600.0).select("frame_id", "line", "seq", "offset"), "offset")


YAW_TIMES_SQL = """, a AS (SELECT frame_id, line, (l_orderkey * 8 + l_linenumber) * 10000000000 + l_partkey * 100000 + frame_id AS seq, degrees(atan2(y - 20, x - 25)) AS yaw FROM f_points),
 b AS (SELECT *, first_value(yaw) OVER k AS f, row_number() OVER k AS n FROM a WINDOW k AS (PARTITION BY frame_id, line ORDER BY seq)),
 c AS (SELECT *, (f - yaw + CASE WHEN yaw > f THEN 360 ELSE 0 END) / 3600.0::DOUBLE AS t FROM b),
 d AS (SELECT *, n > 1 AND t < lag(t) OVER (PARTITION BY frame_id, line ORDER BY seq) AS back FROM c)
 SELECT frame_id, line, seq, round(t + CASE WHEN bool_or(back) OVER (PARTITION BY frame_id, line ORDER BY seq ROWS UNBOUNDED PRECEDING) THEN 0.1::DOUBLE ELSE 0 END, 6) AS offset FROM d QUALIFY n > 1"""


def crop_q(spark, sf_dir):
    return lidar.crop_points(fx.points(spark, sf_dir), 12.0, [(10.0, 5.0, -1.0, 30.0, 25.0, 0.5), (31.0, 0.0, -1.0, 45.0, 50.0, 0.8)]).groupBy("frame_id").agg(F.count("*").alias("n"))


CROP_SQL = """SELECT frame_id, count(*) AS n FROM f_points WHERE x*x + y*y + z*z >= 144 AND NOT (x > 10 AND x < 30 AND y > 5 AND y < 25 AND z > -1 AND z < 0.5) AND NOT (x > 31 AND x < 45 AND y > 0 AND y < 50 AND z > -1 AND z < 0.8) GROUP BY 1"""


def packets_q(spark, sf_dir):
    packets = fx.topics(spark, sf_dir).select("device_id", "seq", "t", F.transform(F.sequence(F.lit(0), F.col("seq") % 7), lambda k: F.col("value") + k).alias("values"))
    return rounded(lidar.packet_points(packets, "values", 0.001, 4), "t", "point")


PACKETS_SQL = "SELECT device_id, seq, round(t + i * 0.001::DOUBLE, 6) AS t, i::INT AS i, round(value + i, 6) AS point, (i % 4)::INT AS line FROM f_topics, unnest(range(seq % 7 + 1)) AS u(i)"


def merge_frames_q(spark, sf_dir):
    t = fx.topics(spark, sf_dir)
    clouds = [t.where("seq % 2 = 0").selectExpr("seq", "t", "value AS x", "'a' AS lidar"), t.where("seq % 2 = 1").selectExpr("seq", "t + 0.3D AS t", "value AS x", "'b' AS lidar")]
    return rounded(lidar.merge_lidar_frames(clouds, 2.0).select("frame", "seq", "lidar", "base_t", "offset"), "base_t", "offset")


MERGE_SQL = """, u AS (SELECT seq, t, 'a' AS lidar FROM f_topics WHERE seq % 2 = 0 UNION ALL SELECT seq, t + 0.3::DOUBLE, 'b' FROM f_topics WHERE seq % 2 = 1), f AS (SELECT *, floor(t / 2)::BIGINT AS frame FROM u)
 SELECT frame, seq, lidar, round(min(t) OVER (PARTITION BY frame), 6) AS base_t, round(t - min(t) OVER (PARTITION BY frame), 6) AS "offset" FROM f"""


def time_order_q(spark, sf_dir):
    ordered = lidar.points_in_time_order(shots(spark, sf_dir), "scan_id", "t")
    # places in the partitions as they are, so that a point out of order shows as a step back
    step = F.col("t") - F.lag("t").over(W.partitionBy("scan_id").orderBy("place"))
    stepped = ordered.withColumn("place", F.monotonically_increasing_id()).withColumn("step", step)
    return rounded(stepped.groupBy("scan_id").agg(F.count("*").alias("n"), F.count_if(F.col("step") < 0).alias("back"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("span")), "span")


def colors_q(spark, sf_dir):
    p = fx.points(spark, sf_dir).selectExpr("frame_id AS frame", "l_orderkey", "l_linenumber", "x / 45 AS u", "y / 50 - 0.05D AS v", "z - 0.2D AS z")
    pixels = fx.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).selectExpr("frame", "k % 8 AS px", "CAST(floor(k / 8) AS INT) AS py", "CAST(frame * 64 + k AS BIGINT) AS color")
    return lidar.color_points(p, pixels, 8, 8).select("frame", "l_orderkey", "l_linenumber", "color")


COLORS_SQL = """, p AS (SELECT frame_id AS frame, l_orderkey, l_linenumber, x / 45 AS u, y / 50 - 0.05::DOUBLE AS v FROM f_points WHERE z - 0.2::DOUBLE > 0)
 SELECT frame, l_orderkey, l_linenumber, CASE WHEN u < 1 AND v < 1 AND s_suppkey IS NOT NULL THEN (frame * 64 + trunc(v * 8) * 8 + trunc(u * 8))::BIGINT END AS color FROM p LEFT JOIN supplier ON s_suppkey = frame WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1"""


def active_scan_q(spark, sf_dir):
    poses = windows.dead_reckon(fx.odometry(spark, sf_dir)).groupBy("device_id").agg(F.max_by(F.struct("x", "y", "theta"), F.struct("t", "seq")).alias("p")).select("device_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("p.theta").alias("yaw"))
    points = fx.points(spark, sf_dir).select(F.col("frame_id").alias("device_id"), "x", "y")
    return rounded(lidar.active_scan(points, poses, "device_id", 0.1, 2.0, 30.0), "range", digits=4)


ACTIVE_SQL = motion.DEAD_SQL + """, l AS (SELECT device_id, arg_max(x, (t, seq)) AS px, arg_max(y, (t, seq)) AS py, arg_max(theta, (t, seq)) AS yaw FROM reck GROUP BY 1),
 seen AS (SELECT device_id, cos(yaw) * (x - px) + sin(yaw) * (y - py) AS bx, -sin(yaw) * (x - px) + cos(yaw) * (y - py) AS "by" FROM l JOIN f_points ON frame_id = device_id)
 SELECT device_id, (round((atan2("by", bx) + pi()) / 0.1::DOUBLE)::INT % 63)::INT AS beam, round(min(sqrt(bx*bx + "by"*"by")), 4) AS range FROM seen WHERE sqrt(bx*bx + "by"*"by") BETWEEN 2 AND 30 GROUP BY 1, 2"""


def clear_scan_q(spark, sf_dir):
    limits = fx.scans(spark, sf_dir).groupBy("scan_id").agg(F.min("range").alias("range_min"), F.max("range").alias("range_max"))
    out = lidar.clear_scan(limits, 0.5, 9.0, 12)
    return rounded(out.select("scan_id", F.size("ranges").alias("beams"), F.array_max("ranges").alias("clear")), "clear")


def front_q(spark, sf_dir):
    return lidar.front_is_safe(fx.scans(spark, sf_dir), 0.25, 0.3, 6.0)


def fill_angles_q(spark, sf_dir):
    b = fx.scans(spark, sf_dir).selectExpr("scan_id", "beam AS seq", "CASE WHEN range IS NOT NULL THEN beam * 3.6D + (beam % 3) * 0.2D END AS angle", "range")
    return rounded(lidar.fill_scan_angles(b).select("scan_id", "seq", "angle", "place"), "angle")


FILL_ANGLES_SQL = """, a AS (SELECT scan_id, beam, range, beam * 3.6::DOUBLE + (beam % 3) * 0.2::DOUBLE AS angle FROM f_scans),
 f AS (SELECT scan_id, min(beam) AS fi, arg_min(angle, beam) AS fa FROM a WHERE range IS NOT NULL GROUP BY 1),
 g AS (SELECT a.*, greatest(fa - fi * 3.6::DOUBLE, 0) AS front FROM a JOIN f USING (scan_id)),
 h AS (SELECT scan_id, beam AS seq, CASE WHEN range IS NOT NULL THEN angle WHEN beam = 0 THEN front WHEN front + beam * 3.6::DOUBLE > 360 THEN front + beam * 3.6::DOUBLE - 360 ELSE front + beam * 3.6::DOUBLE END AS angle FROM g)
 SELECT scan_id, seq, round(angle, 6) AS angle, row_number() OVER (PARTITION BY scan_id ORDER BY round(angle, 9), seq)::INT AS place FROM h"""


def grid_points_q(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("low", F.when(F.col("n") % 3 != 0, F.col("mean_z")))
    return rounded(sampling.grid_to_points(c, MAP, ["n"], "max_z", ["low"]), "z")


def pixels_q(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    value = frames.pixel_to_value(F.col("n") * 7 % 256, F.col("n") * 11 % 256, -1.0, 3.0, 255)
    return c.select("ix", "iy", F.round(value, 6).alias("value"), frames.value_to_pixel(F.col("mean_z"), 0.3, 0.6, 65535).alias("pixel"))


PIXELS_SQL = """SELECT ix, iy, CASE WHEN n * 11 % 256 >= 127 THEN round(-1 + 4 * (n * 7 % 256 / 255.0::DOUBLE), 6) END AS value, trunc((greatest(0.3, least(0.6, mean_z)) - 0.3::DOUBLE) / (0.6::DOUBLE - 0.3::DOUBLE) * 65535)::INT AS pixel FROM f_cells"""


def sample_points(spark, sf_dir):
    return fx.points(spark, sf_dir).selectExpr("(l_orderkey * 8 + l_linenumber) * 10000000000 + l_partkey * 100000 + frame_id AS query_id", "x + 0.13D AS x", "y * 0.9D + 0.21D AS y", "z")


SAMPLES = "q AS (SELECT (l_orderkey * 8 + l_linenumber) * 10000000000 + l_partkey * 100000 + frame_id AS query_id, x + 0.13::DOUBLE AS x, y * 0.9::DOUBLE + 0.21::DOUBLE AS y, z FROM f_points)"


def cubic_q(spark, sf_dir):
    return rounded(sampling.sample_cubic(fx.cells(spark, sf_dir), sample_points(spark, sf_dir), MAP, "mean_z").select("query_id", "value"), "value", digits=5)


CUBIC_SQL = f""", {SAMPLES}, i AS (SELECT *, floor(52 - x)::INT AS i, floor(52 - y)::INT AS j FROM q WHERE floor(52 - x) BETWEEN 0 AND 51 AND floor(52 - y) BETWEEN 0 AND 51),
 b AS (SELECT *, CASE WHEN x > 52 - i - 0.5 THEN i ELSE i + 1 END AS bi, CASE WHEN y > 52 - j - 0.5 THEN j ELSE j + 1 END AS bj FROM i),
 t AS (SELECT *, x - (52 - least(51, bi) - 0.5) AS tx, y - (52 - least(51, bj) - 0.5) AS ty FROM b),
 s AS (SELECT query_id, greatest(0, least(51, greatest(0, least(51, bi - a)) + dx)) AS ix, greatest(0, least(51, greatest(0, least(51, bj - c)) + dy)) AS iy,
 CASE WHEN dx = 0 THEN CASE WHEN a = 0 THEN 2*tx*tx*tx - 3*tx*tx + 1 ELSE 3*tx*tx - 2*tx*tx*tx END ELSE -dx / 2.0::DOUBLE * CASE WHEN a = 0 THEN tx*tx*tx - 2*tx*tx + tx ELSE tx*tx*tx - tx*tx END END *
 CASE WHEN dy = 0 THEN CASE WHEN c = 0 THEN 2*ty*ty*ty - 3*ty*ty + 1 ELSE 3*ty*ty - 2*ty*ty*ty END ELSE -dy / 2.0::DOUBLE * CASE WHEN c = 0 THEN ty*ty*ty - 2*ty*ty + ty ELSE ty*ty*ty - ty*ty END END AS w
 FROM t, (VALUES (0), (1)) AS va(a), (VALUES (0), (1)) AS vc(c), (VALUES (-1), (0), (1)) AS vx(dx), (VALUES (-1), (0), (1)) AS vy(dy)),
 v AS (SELECT query_id, sum(w * mean_z) AS value, count(mean_z) AS n FROM s JOIN f_cells USING (ix, iy) GROUP BY 1)
 SELECT q.query_id, CASE WHEN n = 36 THEN round(value, 5) END AS value FROM q LEFT JOIN v USING (query_id)"""

ORIGIN, SIZE = (51.5, 51.5, 0.0), (52, 52, 3)


def nodes(spark, sf_dir):
    c = fx.cells(spark, sf_dir).select("ix", "iy", "mean_z", "n", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("iz"))
    return c.selectExpr("ix", "iy", "iz", "mean_z - iz * 0.25D AS d", "(n % 7 - 3) / 10.0D AS gx", "(n % 5 - 2) / 10.0D AS gy", "(n % 3 - 1) / 10.0D AS gz")


NODES = "nodes AS (SELECT ix, iy, iz, mean_z - iz * 0.25::DOUBLE AS d, (n % 7 - 3) / 10.0::DOUBLE AS gx, (n % 5 - 2) / 10.0::DOUBLE AS gy, (n % 3 - 1) / 10.0::DOUBLE AS gz FROM f_cells, (VALUES (0), (1), (2)) AS vz(iz))"


def distance_q(spark, sf_dir):
    q = sample_points(spark, sf_dir).withColumn("z", F.col("z") * 3 - 0.4)
    return rounded(sampling.sample_distance(nodes(spark, sf_dir), q, ORIGIN, 1.0, SIZE).select("query_id", "distance"), "distance")


DISTANCE_SQL = f""", {SAMPLES}, {NODES}, i AS (SELECT query_id, x, y, z * 3 - 0.4::DOUBLE AS z, floor(greatest(0, least(51, 51.5 - x)) + 0.5)::INT AS ix, floor(greatest(0, least(51, 51.5 - y)) + 0.5)::INT AS iy, floor(greatest(0, least(2, z * 3 - 0.4::DOUBLE)) + 0.5)::INT AS iz FROM q)
 SELECT query_id, round(d + gx * (x - (51.5 - ix)) + gy * (y - (51.5 - iy)) + gz * (z - iz), 6) AS distance FROM i LEFT JOIN nodes USING (ix, iy, iz)"""


def sdf_points_q(spark, sf_dir):
    return rounded(sampling.sdf_to_points(nodes(spark, sf_dir), ORIGIN, 1.0, 2, F.col("d") > 0.2), "intensity")


def layers_q(spark, sf_dir):
    c = sampling.add_layer(sampling.add_layer(fx.cells(spark, sf_dir), "slope", 0.5), "twice", F.col("mean_z") * 2)
    out = sampling.drop_layer(sampling.clear_layers(c, ["max_z"]), "n")
    return rounded(out.select("ix", "iy", "mean_z", "max_z", "slope", "twice"), "mean_z", "twice")


def linear_q(spark, sf_dir):
    ix, iy = F.col("ix"), F.col("iy")
    rows, cols = frames.linear_index(ix, iy, 52, 40, True), frames.linear_index(ix, iy, 52, 40)
    (ri, rj), (ci, cj) = frames.index_of_linear(rows, 52, 40, True), frames.index_of_linear(cols, 52, 40)
    return fx.cells(spark, sf_dir).where("iy < 40").select("ix", "iy", rows.alias("by_row"), cols.alias("by_column"), ((ri == ix) & (rj == iy) & (ci == ix) & (cj == iy)).alias("back"))


def vertices_q(spark, sf_dir):
    return sampling.sort_vertices(fx.points(spark, sf_dir).select("frame_id", "l_orderkey", "l_linenumber", "x", "y"), ["frame_id"]).where("place <= 5").select("frame_id", "place", "x", "y")


def halfplanes_q(spark, sf_dir):
    s = fx.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("poly_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    poly = s.selectExpr("poly_id", "i", "poly_id % 20 + (3 + poly_id % 4) * cos(i * 1.2566370614359172D) AS x", "poly_id % 30 + (3 + poly_id % 4) * sin(i * 1.2566370614359172D) AS y")
    return rounded(sampling.polygon_halfplanes(poly, "poly_id"), "ax", "ay", "b")


HALFPLANES_SQL = """WITH v AS (SELECT s_suppkey AS poly_id, i, s_suppkey % 20 + (3 + s_suppkey % 4) * cos(i * 1.2566370614359172::DOUBLE) AS x, s_suppkey % 30 + (3 + s_suppkey % 4) * sin(i * 1.2566370614359172::DOUBLE) AS y FROM supplier, (VALUES (0), (1), (2), (3), (4)) AS vi(i)),
 c AS (SELECT *, avg(x) OVER (PARTITION BY poly_id) AS cx, avg(y) OVER (PARTITION BY poly_id) AS cy FROM v), e AS (SELECT a.poly_id, a.i, a.cx, a.cy, a.x - a.cx AS x1, a.y - a.cy AS y1, b.x - b.cx AS x2, b.y - b.cy AS y2 FROM c a JOIN c b ON a.poly_id = b.poly_id AND b.i = (a.i + 1) % 5),
 s AS (SELECT *, (y2 - y1) / (x1 * y2 - y1 * x2) AS ax, (x1 - x2) / (x1 * y2 - y1 * x2) AS ay FROM e) SELECT poly_id, i AS edge, round(ax, 6) AS ax, round(ay, 6) AS ay, round(1 + ax * cx + ay * cy, 6) AS b FROM s"""


def channel_q(spark, sf_dir):
    p = fx.points(spark, sf_dir).selectExpr("CAST(floor(52 - x) AS INT) AS ix", "CAST(floor(52 - y) AS INT) AS iy", "l_orderkey", "l_linenumber", "l_partkey", "frame_id", "intensity")
    key, order = ["ix", "iy"], ["l_orderkey", "l_linenumber", "l_partkey", "frame_id"]
    mean = sampling.channel_fuse(p, key, order, "intensity", "average").withColumnRenamed("value", "mean")
    return rounded(mean.join(sampling.channel_fuse(p, key, order, "intensity", "exponential", 0.3), key), "mean", "value")


CHANNEL_SQL = """, p AS (SELECT floor(52 - x)::INT AS ix, floor(52 - y)::INT AS iy, intensity, row_number() OVER (PARTITION BY floor(52 - x), floor(52 - y) ORDER BY l_orderkey, l_linenumber, l_partkey, frame_id) AS r, count(*) OVER (PARTITION BY floor(52 - x), floor(52 - y)) AS n FROM f_points)
 SELECT ix, iy, round(avg(intensity), 6) AS mean, round(sum(intensity * pow(0.7::DOUBLE, n - r) * CASE WHEN r = 1 THEN 1 ELSE 0.3::DOUBLE END), 6) AS value FROM p GROUP BY 1, 2"""


def bbox_q(spark, sf_dir):
    boxes = fx.points(spark, sf_dir).groupBy("frame_id").agg((F.max("x") - F.min("x")).alias("lx"), (F.max("y") - F.min("y")).alias("ly"))
    half = F.col("frame_id") % 60 * 0.05
    x, y = frames.bbox_lengths(F.col("lx"), F.col("ly"), (F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half)))
    return boxes.select("frame_id", F.round(x, 6).alias("length_x"), F.round(y, 6).alias("length_y"))


BBOX_SQL = """, b AS (SELECT frame_id, max(x) - min(x) AS lx, max(y) - min(y) AS ly, frame_id % 60 * 0.1::DOUBLE AS a FROM f_points GROUP BY 1)
 SELECT frame_id, round(2 * greatest(abs(cos(a) * lx / 2 - sin(a) * ly / 2), abs(cos(a) * lx / 2 + sin(a) * ly / 2)), 6) AS length_x, round(2 * greatest(abs(sin(a) * lx / 2 + cos(a) * ly / 2), abs(sin(a) * lx / 2 - cos(a) * ly / 2)), 6) AS length_y FROM b"""


def rotate_imu_q(spark, sf_dir):
    half = F.col("w")
    q, g, a = frames.rotate_imu((F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half)), (F.col("v"), F.col("w"), F.lit(0.5)), (F.lit(1.0), F.col("v"), F.lit(9.81)), 10.0)
    return fx.odometry(spark, sf_dir).select("seq", *[F.round(c, 6).alias(n) for n, c in zip(("qx", "qy", "qz", "qw", "gx", "gy", "gz", "ax", "ay", "az"), (*q, *g, *a), strict=True)])


ROTATE_IMU_SQL = f"""SELECT seq, round(-sin(w) * s, 6) AS qx, round(cos(w) * s, 6) AS qy, round(sin(w) * c, 6) AS qz, round(cos(w) * c, 6) AS qw, round(cc * v - ss * 0.5, 6) AS gx, round(w, 6) AS gy, round(ss * v + cc * 0.5, 6) AS gz,
 round(cc - ss * 9.81, 6) AS ax, round(v, 6) AS ay, round(ss + cc * 9.81, 6) AS az FROM f_odom, (SELECT {math.sin(math.radians(5))!r}::DOUBLE AS s, {math.cos(math.radians(5))!r}::DOUBLE AS c, {math.sin(math.radians(10))!r}::DOUBLE AS ss, {math.cos(math.radians(10))!r}::DOUBLE AS cc)"""


def align_q(spark, sf_dir):
    p, q = frames.align_pose((F.col("v"), F.col("w"), F.lit(1.0)), (F.sin("w"), F.lit(0.0), F.lit(0.0), F.cos("w")), 0.7, 0.3, 0.0, 0.0)
    return fx.odometry(spark, sf_dir).select("seq", *[F.round(c, 6).alias(n) for n, c in zip(("x", "y", "z", "qx", "qy", "qz", "qw"), (*p, *q), strict=True)])


ALIGN_SQL = """SELECT seq, round(cos(0.7) * v + sin(0.7) * w, 6) AS x, round(cos(0.7) * w - sin(0.7) * v, 6) AS y, 1.0::DOUBLE AS z, round(cos(-0.35) * sin(w + 0.15), 6) AS qx, round(sin(-0.35) * sin(w + 0.15), 6) AS qy, round(sin(-0.35) * cos(w + 0.15), 6) AS qz, round(cos(-0.35) * cos(w + 0.15), 6) AS qw FROM f_odom"""


def stale_q(spark, sf_dir):
    t = fx.topics(spark, sf_dir)
    return health.source_current(t.where("topic = 'click'").select("device_id", "t", "seq"), t.where("topic = 'error'").select("device_id", "t", "seq"), ["device_id"], 1.5).select("device_id", "seq", "current")


def timings_q(spark, sf_dir):
    log = fx.topics(spark, sf_dir).selectExpr("device_id", "sqrt(value) AS search", "(seq % 13) / 7.0D AS solve", "CASE WHEN seq % 4 > 0 THEN ln(1 + value) END AS publish")
    return rounded(health.stage_timings(log, ["device_id"], ["search", "solve", "publish"]), "mean", "p95")


TIMINGS_SQL = """, l AS (SELECT device_id, 'search' AS stage, sqrt(value) AS s FROM f_topics UNION ALL SELECT device_id, 'solve', (seq % 13) / 7.0::DOUBLE FROM f_topics UNION ALL SELECT device_id, 'publish', CASE WHEN seq % 4 > 0 THEN ln(1 + value) END FROM f_topics)
 SELECT device_id, stage, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.95), 6) AS p95, count(s) AS n FROM l GROUP BY 1, 2"""


def endpoints_q(spark, sf_dir):
    poses = windows.dead_reckon(fx.odometry(spark, sf_dir))
    plans = fx.topics(spark, sf_dir).selectExpr("device_id", "CAST(floor(t / 3) AS BIGINT) AS plan", "floor(t / 3) * 3.0D + 1.0D AS t", "seq AS idx", "value / 20 AS x", "seq % 9 * 1.0D AS y")
    return rounded(health.plan_endpoint_distance(plans, poses, ["device_id"]).select("device_id", "plan", "distance"), "distance", digits=4)


ENDPOINTS_SQL = motion.DEAD_SQL + """, p AS (SELECT device_id, floor(t / 3)::BIGINT AS plan, floor(t / 3) * 3.0::DOUBLE + 1 AS t, arg_max(value / 20, seq) AS ex, arg_max(seq % 9, seq) AS ey FROM f_topics GROUP BY 1, 2, 3)
 SELECT p.device_id, plan, round(sqrt(pow(ex - x, 2) + pow(ey - y, 2)), 4) AS distance FROM p ASOF LEFT JOIN reck ON p.device_id = reck.device_id AND p.t >= reck.t"""

QUERIES = {
    "j06_deskew": (deskew_q, o(DESKEW_SQL, P)),
    "j14_residuals": (residuals_q, o(RESIDUALS_SQL, P)),
    "w14_yaw_times": (yaw_times_q, o(YAW_TIMES_SQL, P)),
    "p28_crop": (crop_q, o(CROP_SQL, P)),
    "p42_packets": (packets_q, o(PACKETS_SQL, T)),
    "u06_merge_frames": (merge_frames_q, o(MERGE_SQL, T)),
    "k03_time_order": (time_order_q, o(f", {SHOTS} SELECT scan_id, count(*) AS n, 0::BIGINT AS back, round(max(t) - min(t), 6) AS span FROM shots GROUP BY 1", P)),
    "j11_colors": (colors_q, o(COLORS_SQL, P)),
    "t05_active_scan": (active_scan_q, o(ACTIVE_SQL, O, P)),
    "a06_clear_scan": (clear_scan_q, o("SELECT scan_id, 12 AS beams, round(greatest(least(max(range) - 0.5, 9), min(range) + 0.01), 6) AS clear FROM f_scans GROUP BY 1 HAVING max(range) > min(range)", S)),
    "a08_front_safe": (front_q, o("SELECT scan_id, coalesce(sum(CASE WHEN abs(angle) < 0.25 AND range >= 0.3 AND range < 6 THEN 6 - range END), 0) < 0.1 AS safe FROM f_scans GROUP BY 1", S)),
    "w22_fill_angles": (fill_angles_q, o(FILL_ANGLES_SQL, S)),
    "s11_grid_points": (grid_points_q, o("SELECT 52 - ix - 0.5::DOUBLE AS x, 52 - iy - 0.5::DOUBLE AS y, round(max_z, 6) AS z, n FROM f_cells WHERE n % 3 <> 0", C)),
    "s09_pixels": (pixels_q, o(PIXELS_SQL, C)),
    "g13_cubic": (cubic_q, o(CUBIC_SQL, P, C)),
    "g21_sample_distance": (distance_q, o(DISTANCE_SQL, P, C)),
    "g22_sdf_points": (sdf_points_q, o(f", {NODES} SELECT 51.5::DOUBLE - ix AS x, 51.5::DOUBLE - iy AS y, iz::DOUBLE AS z, round(d, 6) AS intensity FROM nodes WHERE ix % 2 = 0 AND iy % 2 = 0 AND iz % 2 = 0 AND d > 0.2", C)),
    "g02_layers": (layers_q, o("SELECT ix, iy, round(mean_z, 6) AS mean_z, NULL::DOUBLE AS max_z, 0.5::DOUBLE AS slope, round(mean_z * 2, 6) AS twice FROM f_cells", C)),
    "p35_linear_index": (linear_q, o("SELECT ix, iy, ix * 40 + iy AS by_row, iy * 52 + ix AS by_column, true AS back FROM f_cells WHERE iy < 40", C)),
    "k05_vertices": (vertices_q, o("SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY x, y)::INT AS place, x, y FROM f_points QUALIFY place <= 5", P)),
    "g24_halfplanes": (halfplanes_q, HALFPLANES_SQL),
    "a21_channels": (channel_q, o(CHANNEL_SQL, P)),
    "a26_bbox": (bbox_q, o(BBOX_SQL, P)),
    "p09_rotate_imu": (rotate_imu_q, o(ROTATE_IMU_SQL, O)),
    "p10_align_pose": (align_q, o(ALIGN_SQL, O)),
    "r08_stale": (stale_q, o("SELECT a.device_id, a.seq, coalesce(a.t - b.t <= 1.5, false) AS current FROM (SELECT * FROM f_topics WHERE topic = 'click') a ASOF LEFT JOIN (SELECT * FROM f_topics WHERE topic = 'error') b ON a.device_id = b.device_id AND a.t >= b.t", T)),
    "a27_timings": (timings_q, o(TIMINGS_SQL, T)),
    "j12_endpoints": (endpoints_q, o(ENDPOINTS_SQL, O)),
}
