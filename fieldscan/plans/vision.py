"""Registered queries over detections, scans and frames: name -> (function of (spark, sf_dir), the same in SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import detections as det
from ..operators import grid, points, scans, timejoin, windows
from ..sources import fixtures as fx
from .motion import rounded
from .space import MAP

o = fx.oracle
DETECTIONS = """f_det AS (SELECT l_orderkey AS frame, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS det_id, p_type AS class_name, l_discount * 10 AS confidence, CASE WHEN l_quantity > 3 THEN l_quantity / 5 END AS depth_m,
 l_partkey % 600 AS x_min, l_partkey % 600 + l_linenumber * 9 AS x_max, l_suppkey % 400 AS y_min, l_suppkey % 400 + l_linenumber * 7 AS y_max, (l_partkey % 600 + l_linenumber * 4.5::DOUBLE - 320) * l_quantity / 5 / 610.0::DOUBLE AS px, 0.5::DOUBLE AS py, l_quantity / 5 AS pz
 FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def detections(spark, sf_dir):
    li, part = fx.read(spark, sf_dir, "lineitem"), fx.read(spark, sf_dir, "part").select("p_partkey", "p_type")
    return li.join(part, F.col("p_partkey") == F.col("l_partkey")).selectExpr(
        "l_orderkey AS frame", "l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS det_id", "p_type AS class_name", "l_discount * 10 AS confidence",
        "CASE WHEN l_quantity > 3 THEN l_quantity / 5 END AS depth_m", "l_partkey % 600 AS x_min", "l_partkey % 600 + l_linenumber * 9 AS x_max", "l_suppkey % 400 AS y_min", "l_suppkey % 400 + l_linenumber * 7 AS y_max",
        "(l_partkey % 600 + l_linenumber * 4.5D - 320) * l_quantity / 5 / 610.0D AS px", "0.5D AS py", "l_quantity / 5 AS pz",
    )


def settings(spark, sf_dir):
    kinds = fx.read(spark, sf_dir, "part").select(F.col("p_type").alias("class_name")).distinct()
    n = F.length("class_name")
    return kinds.select("class_name", (n % 5 / 10.0 + 0.035).alias("min_confidence"), (n % 7 != 0).alias("enabled"), (n % 6 == 0).alias("ignored"))


CLASSIFIED = DETECTIONS + """, cfg AS (SELECT DISTINCT p_type AS class_name, length(p_type) % 5 / 10.0::DOUBLE + 0.035::DOUBLE AS min_confidence, length(p_type) % 7 <> 0 AS enabled, length(p_type) % 6 = 0 AS ignored FROM part),
 cl AS (SELECT d.*, CASE WHEN NOT enabled THEN 'class_not_enabled' WHEN ignored THEN 'class_ignored' WHEN confidence < min_confidence THEN 'low_confidence' WHEN x_max - x_min < 12 THEN 'bbox_too_narrow' WHEN y_max - y_min < 20 THEN 'bbox_too_short'
 WHEN depth_m IS NULL THEN 'invalid_depth' WHEN depth_m NOT BETWEEN 1.0 AND 8.5 THEN 'depth_out_of_range' ELSE 'accepted' END AS reason FROM f_det d JOIN cfg USING (class_name))"""


def classified(spark, sf_dir):
    return det.classify(detections(spark, sf_dir), settings(spark, sf_dir), 0.5, 12, 20, 1.0, 8.5)


def classify_q(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("class_name", "reason").agg(F.count("*").alias("n"))


def reasons_q(spark, sf_dir):
    return det.frame_reasons(classified(spark, sf_dir))


def sectors(spark, sf_dir):
    low, high, r = det.sector(F.col("px"), F.col("pz"), F.lit(0.2), 0.1, 0.3, 0.5)
    return classified(spark, sf_dir).where("reason = 'accepted'").select("frame", "det_id", low.alias("low"), high.alias("high"), r.alias("range"))


SECTORS = CLASSIFIED + """, sec AS (SELECT frame, det_id, least(atan2(px - 0.2, pz), atan2(px + 0.2, pz)) - atan2(0.1, sqrt(px*px + pz*pz)) AS low, greatest(atan2(px - 0.2, pz), atan2(px + 0.2, pz)) + atan2(0.1, sqrt(px*px + pz*pz)) AS high, greatest(0.5, sqrt(px*px + pz*pz) - 0.3) AS range FROM cl WHERE reason = 'accepted')"""


def sector_q(spark, sf_dir):
    return rounded(sectors(spark, sf_dir), "low", "high", "range")


def paint_q(spark, sf_dir):
    return rounded(det.paint_beams(sectors(spark, sf_dir).withColumn("frame", F.col("frame") % 50), "frame", -0.8, 0.02, 80), "range")


PAINT_SQL = SECTORS + """, b AS (SELECT frame % 50 AS frame, greatest(floor((low + 0.8::DOUBLE) / 0.02::DOUBLE), 0)::BIGINT AS a, least(floor((high + 0.8::DOUBLE) / 0.02::DOUBLE) + 1, 79)::BIGINT AS z, range FROM sec)
 SELECT frame, beam::INT AS beam, round(min(range), 6) AS range FROM (SELECT frame, unnest(generate_series(a, z)) AS beam, range FROM b WHERE a <= z) GROUP BY 1, 2"""


def target_q(spark, sf_dir):
    return det.select_target(detections(spark, sf_dir), "confidence", 1.0, 9.0)


def nearest_target_q(spark, sf_dir):
    return det.select_target(detections(spark, sf_dir), "nearest", 1.0, 9.0)


TARGET_SQL = DETECTIONS + " SELECT frame, det_id, class_name, confidence, depth_m FROM f_det WHERE depth_m BETWEEN 1.0 AND 9.0 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY %s, det_id) = 1"


def deproject_q(spark, sf_dir):
    x, y, z = geo.deproject((F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2, F.col("depth_m"), 610.0, 612.0, 320.0, 240.0)
    return detections(spark, sf_dir).where("depth_m IS NOT NULL").groupBy("class_name").agg(F.round(F.avg(x), 6).alias("x"), F.round(F.avg(y), 6).alias("y"), F.round(F.max(z), 6).alias("z"))


DEPROJECT_SQL = DETECTIONS + " SELECT class_name, round(avg(((x_min + x_max) / 2.0::DOUBLE - 320) * depth_m / 610), 6) AS x, round(avg(((y_min + y_max) / 2.0::DOUBLE - 240) * depth_m / 612), 6) AS y, round(max(depth_m), 6) AS z FROM f_det WHERE depth_m IS NOT NULL GROUP BY 1"


def ins_q(spark, sf_dir):
    t = fx.topics(spark, sf_dir).selectExpr("seq", "seq * 131071 % 2147483647 AS angle32", "seq * 31 % 32767 AS angle16", "seq * 77 % 65536 AS heading", "seq * 13 % 9000 AS speed")
    return det.scale_fields(t, {k: det.INS_SCALES[k] for k in ("angle32", "angle16", "heading", "speed")})


INS_SQL = "SELECT seq, round((seq * 131071 % 2147483647) * (180 / 2147483648.0::DOUBLE), 7) AS angle32, round((seq * 31 % 32767) * (180 / 32768.0::DOUBLE), 7) AS angle16, round((seq * 77 % 65536) * (360 / 65536.0::DOUBLE), 7) AS heading, round((seq * 13 % 9000) * 1e-3, 7) AS speed FROM f_topics"


def extrinsic_q(spark, sf_dir):
    x, y, z = det.apply_extrinsic(F.col("x"), F.col("y"), F.col("z"), 10.0, -5.0, 30.0, (0.1, 0.2, 0.3), 0.01)
    return fx.points(spark, sf_dir).groupBy("frame_id").agg(F.round(F.avg(x), 6).alias("x"), F.round(F.avg(y), 6).alias("y"), F.round(F.avg(z), 6).alias("z"))


EXTRINSIC_SQL = """, a AS (SELECT radians(10) AS r, radians(-5) AS p, radians(30) AS w), m AS (SELECT cos(r) AS cr, sin(r) AS sr, cos(p) AS cp, sin(p) AS sp, cos(w) AS cy, sin(w) AS sy FROM a)
 SELECT frame_id, round(avg((cp*cy*x + (cy*sp*sr - cr*sy)*y + (sr*sy + cr*cy*sp)*z) * 0.01 + 0.1), 6) AS x, round(avg((cp*sy*x + (cr*cy + sp*sr*sy)*y + (cr*sp*sy - cy*sr)*z) * 0.01 + 0.2), 6) AS y, round(avg((-sp*x + cp*sr*y + cp*cr*z) * 0.01 + 0.3), 6) AS z FROM f_points, m GROUP BY 1"""


def filters_q(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    d2 = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    tag = F.col("l_partkey").cast("int").bitwiseAND(F.lit(0x30))
    return p.where((d2 > 16.0) & (F.col("line") < 6) & tag.isin(0, 0x10)).groupBy("frame_id").agg(F.count("*").alias("n"))


def stop_q(spark, sf_dir):
    t = fx.topics(spark, sf_dir).selectExpr("seq", "IF(seq % 11 = 0, NULL, seq % 10 / 10.0D) AS command_age", "seq % 7 / 10.0D AS sensor_age", "value < 20 AS danger", "seq % 3 - 1.0D AS v")
    return det.stop_reasons(t, 0.55, 0.45, True).select("seq", F.concat_ws(",", "reasons").alias("reasons"), "stop")


STOP_SQL = """, r AS (SELECT seq, concat_ws(',', CASE WHEN seq % 11 = 0 OR seq % 10 / 10.0::DOUBLE > 0.55 THEN 'command_timeout' END, CASE WHEN seq % 7 / 10.0::DOUBLE > 0.45 THEN 'ultrasonic_timeout' END, CASE WHEN value < 20 AND seq % 3 - 1 > 0 THEN 'danger' END) AS reasons FROM f_topics)
 SELECT seq, reasons, reasons <> '' AS stop FROM r"""


def neighbours_q(spark, sf_dir):
    return rounded(scans.shadow_filter_neighbours(fx.scans(spark, sf_dir), 2, 2.0, 0.06283185307179587).select("scan_id", "beam", "kept"), "kept")


NEIGHBOURS_SQL = """, ok AS (SELECT a.scan_id, a.beam, count(*) FILTER (WHERE sqrt(a.range*a.range + b.range*b.range - 2*a.range*b.range*cos((a.beam - b.beam) * 0.06283185307179587::DOUBLE)) <= 2.0) >= 2 AS ok
 FROM f_scans a JOIN f_scans b ON a.scan_id = b.scan_id AND abs(a.beam - b.beam) BETWEEN 1 AND 2 GROUP BY 1, 2)
 SELECT scan_id, beam, CASE WHEN bool_or(coalesce(ok, false)) OVER (PARTITION BY scan_id ORDER BY beam ROWS 1 PRECEDING) THEN round(range, 6) END AS kept FROM f_scans LEFT JOIN ok USING (scan_id, beam)"""


def gaps_q(spark, sf_dir):
    lit = fx.scans(spark, sf_dir).withColumn("energy", F.when(F.col("range").isNotNull(), 150.0 + (F.col("beam") * 37 + F.col("scan_id")) % 200))
    return rounded(scans.fill_bright_gaps(lit, 100).select("scan_id", "beam", "filled", "filled_energy"), "filled", "filled_energy")


GAPS_SQL = """, e AS (SELECT scan_id, beam, range AS r, CASE WHEN range IS NOT NULL THEN 150.0::DOUBLE + (beam * 37 + scan_id) % 200 END AS g FROM f_scans),
 l AS (SELECT scan_id, beam, r, g, list(r) OVER k AS rs, list(g) OVER k AS gs FROM e WINDOW k AS (PARTITION BY scan_id ORDER BY beam ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 n AS (SELECT *, list_transform(range(-3, 4), lambda k: rs[(beam + k + 100) % 100 + 1]) AS rr, list_transform(range(-3, 4), lambda k: gs[(beam + k + 100) % 100 + 1]) AS gg FROM l),
 b AS (SELECT *, list_transform(gg, lambda x: coalesce(x > 200, false)) AS h FROM n),
 c AS (SELECT *, CASE WHEN r IS NOT NULL THEN 0 WHEN h[3] AND h[5] AND (h[6] OR h[2]) THEN 1 WHEN h[3] AND h[2] AND NOT h[5] AND h[6] AND h[7] THEN 2 WHEN h[2] AND h[1] AND NOT h[3] AND rr[3] IS NULL AND h[5] AND h[6] THEN 3 END AS kind FROM b)
 SELECT scan_id, beam, round(CASE kind WHEN 0 THEN r WHEN 1 THEN (rr[3] + rr[5]) / 2 WHEN 2 THEN (rr[3] + rr[6]) / 2 WHEN 3 THEN (rr[2] + rr[5]) / 2 END, 6) AS filled,
 round(CASE kind WHEN 0 THEN g WHEN 1 THEN (gg[3] + gg[5]) / 2 WHEN 2 THEN (gg[3] + gg[6]) / 2 WHEN 3 THEN (gg[2] + gg[5]) / 2 END, 6) AS filled_energy FROM c"""


def compensate_q(spark, sf_dir):
    return rounded(scans.angle_compensate(fx.scans(spark, sf_dir), 2, F.col("beam") * 3.6), "range")


COMPENSATE_SQL = """, b AS (SELECT scan_id, beam, range, floor(beam * 3.6::DOUBLE * 2)::INT AS f FROM f_scans WHERE range IS NOT NULL), e AS (SELECT scan_id, beam, range, unnest(generate_series(f, least(f + 1, 719)))::INT AS bin FROM b)
 SELECT scan_id, bin, round(arg_max(range, beam), 6) AS range FROM e GROUP BY 1, 2"""


def revolutions_q(spark, sf_dir):
    p = fx.topics(spark, sf_dir).selectExpr("device_id % 5 AS device_id", "seq", "0 AS x").withColumn("k", F.row_number().over(windows.W.partitionBy("device_id").orderBy("seq")))
    p = p.where("seq % 53 <> 0").selectExpr("device_id", "seq", "(k * 360) % 3600 AS angle", "360 AS span", "seq % 40 AS n")
    return scans.assemble_revolutions(p, 1800)


def losses_q(spark, sf_dir):
    return scans.revolution_losses(revolutions_q(spark, sf_dir))


REVOLUTIONS_SQL = """, k AS (SELECT device_id % 5 AS device_id, seq, row_number() OVER (PARTITION BY device_id % 5 ORDER BY seq) AS k FROM f_topics), p AS (SELECT device_id, seq, (k * 360) % 3600 AS angle, seq % 40 AS n FROM k WHERE seq % 53 <> 0),
 r AS (SELECT *, coalesce(sum((angle < 1800 AND angle + 360 >= 1800)::INT) OVER (PARTITION BY device_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS revolution FROM p)
 SELECT device_id, revolution, count(*) AS packets, sum(n)::BIGINT AS points, count(*) * 360 = 3600 AS whole FROM r GROUP BY 1, 2"""


LOSSES_SQL = REVOLUTIONS_SQL.replace(" SELECT device_id, revolution,", ", v AS (SELECT device_id, revolution,") + ") SELECT device_id, count(*) FILTER (WHERE whole) AS revolutions, count(*) FILTER (WHERE NOT whole) AS lost, coalesce(sum(packets) FILTER (WHERE NOT whole), 0)::BIGINT AS lost_packets, coalesce(sum(points) FILTER (WHERE NOT whole), 0)::BIGINT AS lost_points FROM v GROUP BY 1"


def mask_q(spark, sf_dir):
    return rounded(scans.mask_angles(fx.scans(spark, sf_dir), -2.01, 2.51, [(-0.51, 0.33)], 0.5, 9.0), "angle", "range")


def levels(spark, sf_dir):
    s = fx.scans(spark, sf_dir).withColumn("sector", F.floor(F.col("beam") / 5).cast("int"))
    return s.groupBy("scan_id", "sector").agg(F.coalesce(F.sum(F.when(F.col("range").between(0.3, 1.5), 1.5 - F.col("range"))), F.lit(0.0)).alias("level"))


def direction_q(spark, sf_dir):
    beams = fx.scans(spark, sf_dir).withColumn("degrees", F.col("beam") * 3.6)
    return scans.best_direction(levels(spark, sf_dir), beams, 60.0, 20, 25.0, 0.3, 1.5)


DIRECTION_SQL = """, l AS (SELECT scan_id, (beam // 5)::INT AS sector, coalesce(sum(CASE WHEN range BETWEEN 0.3 AND 1.5 THEN 1.5 - range END), 0) AS level FROM f_scans GROUP BY 1, 2),
 p AS (SELECT a.scan_id, a.sector, (a.sector + 1) % 20 * 18.0::DOUBLE AS border FROM l a JOIN l b ON a.scan_id = b.scan_id AND b.sector = (a.sector + 1) % 20 WHERE a.level < 0.1 AND b.level < 0.1),
 best AS (SELECT scan_id, arg_min(border, (least(abs(border - 60), 360 - abs(border - 60)), sector)) AS border FROM p GROUP BY 1),
 op AS (SELECT scan_id, coalesce(sum(CASE WHEN beam * 3.6::DOUBLE >= 35 AND beam * 3.6::DOUBLE < 85 AND range >= 0.3 AND range < 1.5 THEN 1.5 - range END), 0) < 0.1 AS open FROM f_scans GROUP BY 1)
 SELECT scan_id, CASE WHEN open THEN 60.0::DOUBLE ELSE coalesce(border, -1) END AS direction FROM op LEFT JOIN best USING (scan_id)"""


def disagreement_q(spark, sf_dir):
    f = fx.fixes(spark, sf_dir)
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat") + (F.col("seq") % 7) * 1e-6, F.col("lon") + (F.col("seq") % 5) * 1e-6)
    return f.groupBy("device_id").agg(F.round(F.max(d), 5).alias("worst_m"), F.round(F.avg(d), 5).alias("mean_m"))


DISAGREEMENT_SQL = """, d AS (SELECT device_id, 2 * 6371000 * asin(sqrt(pow(sin(radians((seq % 7) * 1e-6) / 2), 2) + cos(radians(lat)) * cos(radians(lat + (seq % 7) * 1e-6)) * pow(sin(radians((seq % 5) * 1e-6) / 2), 2))) AS d FROM f_fixes)
 SELECT device_id, round(max(d), 5) AS worst_m, round(avg(d), 5) AS mean_m FROM d GROUP BY 1"""


def scan_ends_q(spark, sf_dir):
    t = fx.topics(spark, sf_dir)
    imu, ends = t.where("topic = 'click'"), t.where("topic = 'error'").withColumn("scan", F.col("seq"))
    out = timejoin.asof_join(imu, ends, ["device_id"], ["scan"], forward=True)
    return out.where("next_scan IS NOT NULL").groupBy("device_id", F.col("next_scan").alias("scan")).agg(F.count("*").alias("n_imu"))


SCAN_ENDS_SQL = """SELECT a.device_id, b.seq AS scan, count(*) AS n_imu FROM (SELECT * FROM f_topics WHERE topic = 'click') a ASOF JOIN (SELECT * FROM f_topics WHERE topic = 'error') b ON a.device_id = b.device_id AND a.t <= b.t GROUP BY 1, 2"""


def mark_q(spark, sf_dir):
    return grid.mark_points(fx.points(spark, sf_dir).where("z > 0.65"), MAP)


def map_insert_q(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    old, new = p.where("l_linenumber <= 3"), p.where("l_linenumber > 3")
    ident = ["l_orderkey", "l_linenumber", "l_partkey"]
    both = points.voxel_nearest_center(old.unionByName(new).withColumn("m", F.lit(0)), ["m"], 2.0, [*ident, "frame_id"])
    return both.select("frame_id", *ident)


MAP_INSERT_SQL = """SELECT frame_id, l_orderkey, l_linenumber, l_partkey FROM f_points QUALIFY row_number() OVER (PARTITION BY floor(x / 2), floor(y / 2), floor(z / 2)
 ORDER BY round(pow(x - (floor(x / 2) + 0.5) * 2, 2) + pow(y - (floor(y / 2) + 0.5) * 2, 2) + pow(z - (floor(z / 2) + 0.5) * 2, 2), 9), l_orderkey, l_linenumber, l_partkey, frame_id) = 1"""


def resolution_q(spark, sf_dir):
    fine = grid.Geometry(52.0, 52.0, 0.5, 26.0, 26.0)
    return rounded(grid.change_resolution(fx.cells(spark, sf_dir), MAP, fine, "mean_z").drop("map_id"), "value", digits=9)


RESOLUTION_SQL = """, q AS (SELECT b.i * 104 + a.i AS query_id, 52 - (a.i + 0.5::DOUBLE) * 0.5 AS x, 52 - (b.i + 0.5::DOUBLE) * 0.5 AS y FROM range(104) a(i), range(104) b(i)), u AS (SELECT query_id, x, y, 52 - x - 0.5 AS u, 52 - y - 0.5 AS v FROM q),
 c AS (SELECT query_id, floor(u)::INT + i AS ix, floor(v)::INT + j AS iy, (CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM u, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
 l AS (SELECT query_id, CASE WHEN count(mean_z) = 4 THEN sum(w * mean_z) END AS lin FROM c JOIN f_cells USING (ix, iy) GROUP BY 1)
 SELECT q.query_id, round(coalesce(lin, mean_z), 9) AS value FROM q LEFT JOIN f_cells ON ix = floor(52 - x) AND iy = floor(52 - y) LEFT JOIN l ON l.query_id = q.query_id"""

S, P, T, X = "f_scans", "f_points", "f_topics", "f_fixes"
alone = lambda sql: "WITH " + sql
QUERIES = {
    "p07_extrinsic": (extrinsic_q, o(EXTRINSIC_SQL, P)),
    "p14_deproject": (deproject_q, alone(DEPROJECT_SQL)),
    "p19_ins_fields": (ins_q, o(INS_SQL, T)),
    "p26_classify": (classify_q, alone(CLASSIFIED + " SELECT class_name, reason, count(*) AS n FROM cl GROUP BY 1, 2")),
    "p27_sectors": (sector_q, alone(SECTORS + " SELECT frame, det_id, round(low, 6) AS low, round(high, 6) AS high, round(range, 6) AS range FROM sec")),
    "p29_point_filters": (filters_q, o("SELECT frame_id, count(*) AS n FROM f_points WHERE x*x + y*y + z*z > 16.0 AND line < 6 AND l_partkey & 48 IN (0, 16) GROUP BY 1", P)),
    "p31_mask_angles": (mask_q, o("SELECT scan_id, beam, round(angle, 6) AS angle, CASE WHEN range BETWEEN 0.5 AND 9.0 AND NOT (angle > -0.51 AND angle < 0.33) THEN round(range, 6) END AS range FROM f_scans WHERE angle BETWEEN -2.01 AND 2.51", S)),
    "j05_scan_imu": (scan_ends_q, o(SCAN_ENDS_SQL, T)),
    "j13_disagreement": (disagreement_q, o(DISAGREEMENT_SQL, X)),
    "a04_paint_beams": (paint_q, alone(PAINT_SQL)),
    "a09_best_direction": (direction_q, o(DIRECTION_SQL, S)),
    "a25_frame_reasons": (reasons_q, alone(CLASSIFIED + " SELECT frame, count(*) AS input, " + ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS {r}" for r in ("accepted", *det.REASONS)) + " FROM cl GROUP BY 1")),
    "w19_shadow_neighbours": (neighbours_q, o(NEIGHBOURS_SQL, S)),
    "w20_fill_gaps": (gaps_q, o(GAPS_SQL, S)),
    "w23_compensate": (compensate_q, o(COMPENSATE_SQL, S)),
    "w26_revolutions": (revolutions_q, o(REVOLUTIONS_SQL, T)),
    "w26_losses": (losses_q, o(LOSSES_SQL, T)),
    "k02_target": (target_q, alone(TARGET_SQL.replace("%s", "confidence DESC"))),
    "k02_nearest_target": (nearest_target_q, alone(TARGET_SQL.replace("%s", "depth_m"))),
    "g16_resolution": (resolution_q, o(RESOLUTION_SQL, "f_cells")),
    "g26_mark_points": (mark_q, o("SELECT DISTINCT floor(52 - x)::INT AS ix, floor(52 - y)::INT AS iy FROM f_points WHERE z > 0.65 AND floor(52 - x) BETWEEN 0 AND 51 AND floor(52 - y) BETWEEN 0 AND 51", P)),
    "u07_map_insert": (map_insert_q, o(MAP_INSERT_SQL, P)),
    "r03_stop_reasons": (stop_q, o(STOP_SQL, T)),
}
