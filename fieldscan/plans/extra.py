"""Registered queries over small column functions, top rows and map reads: name -> (function, the same in SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, sensors
from ..operators import grid, health, timejoin, windows
from ..sources import fixtures as fx
from . import motion
from .motion import rounded
from .space import MAP

o = fx.oracle
T, P, C, S, O = "f_topics", "f_points", "f_cells", "f_scans", "f_odom"


def beams_q(spark, sf_dir):
    a = F.col("v") - 2.5
    return fx.odometry(spark, sf_dir).select("seq", sensors.beam_index(a, -2.0, 0.037, 100, "floor").alias("floored"), sensors.beam_index(a, -2.0, 0.037, 100, "round").alias("ringed"))


BEAMS_SQL = "SELECT seq, greatest(0, least(99, floor(p)))::INT AS floored, ((round_even(p, 0)::INT % 100) + 100) % 100 AS ringed FROM (SELECT seq, (v - 2.5 + 2.0) / 0.037::DOUBLE AS p FROM f_odom)"


def depth_q(spark, sf_dir):
    raw, kind = F.col("seq") * 13 % 9000 * 1.0, F.when(F.col("seq") % 2 == 0, "16UC1").otherwise("32FC1")
    m = sensors.depth_to_m(raw, kind)
    return fx.topics(spark, sf_dir).select("seq", F.round(m, 6).alias("metres"), F.round(sensors.clip_depth(m, 5.0), 6).alias("clipped"), sensors.rescale_depth(raw, 0.00125).alias("mm"))


DEPTH_SQL = "SELECT seq, round(m, 6) AS metres, CASE WHEN m <= 5 THEN round(m, 6) END AS clipped, trunc(raw * (0.00125::DOUBLE * 1000))::INT AS mm FROM (SELECT seq, raw, CASE WHEN seq % 2 = 0 THEN CASE WHEN raw > 0 THEN raw * 0.001::DOUBLE END ELSE raw END AS m FROM (SELECT seq, (seq * 13 % 9000)::DOUBLE AS raw FROM f_topics))"


def velocity_q(spark, sf_dir):
    yaw = sensors.heading_to_yaw(F.col("seq") % 360 + 0.25)
    forward, left = sensors.body_velocity(F.col("v"), F.col("w"), yaw)
    lin, ang = sensors.pose_covariance(F.col("seq") % 4, 0.01, 0.02)
    return fx.odometry(spark, sf_dir).select("seq", F.round(yaw, 6).alias("yaw"), F.round(forward, 6).alias("forward"), F.round(left, 6).alias("left_speed"), F.round(lin, 6).alias("cov_linear"), F.round(ang, 6).alias("cov_angular"))


VELOCITY_SQL = """SELECT seq, round(y, 6) AS yaw, round(cos(y) * v + sin(y) * w, 6) AS forward, round(-sin(y) * v + cos(y) * w, 6) AS left_speed, round(0.01 * pow(10.0::DOUBLE, 3 - seq % 4), 6) AS cov_linear, round(0.02 * pow(10.0::DOUBLE, 1 - seq % 4), 6) AS cov_angular
 FROM (SELECT *, atan2(sin(pi() / 2 - radians(seq % 360 + 0.25)), cos(pi() / 2 - radians(seq % 360 + 0.25))) AS y FROM f_odom)"""

UPDATE_NAMES = ("gnss_position", "gnss_velocity", "heading", "odometer", "zero_velocity", "baro", "magnetic", "external")


def update_flags_q(spark, sf_dir):
    names = geo.status_bits(F.col("seq") * 37 % 256, UPDATE_NAMES)
    return fx.topics(spark, sf_dir).select("seq", F.when(F.size(names) > 0, F.concat_ws("|", names)).otherwise("none").alias("updates"))


UPDATE_SQL = "SELECT seq, coalesce(nullif(concat_ws('|', " + ", ".join(f"CASE WHEN (seq * 37 % 256) >> {k} & 1 = 1 THEN '{n}' END" for k, n in enumerate(UPDATE_NAMES)) + "), ''), 'none') AS updates FROM f_topics"


def clamp_q(spark, sf_dir):
    v = F.when(F.col("n") % 3 != 0, F.col("mean_z"))
    return fx.cells(spark, sf_dir).withColumn("h", v).select("ix", "iy", F.round(sensors.clamp_layer(v, 0.3, 0.6), 6).alias("clamped"), sensors.valid_cell(["h", "max_z"]).alias("valid"), sensors.valid_cell([]).alias("never"), sensors.wrap_index(F.col("ix") - 60, 52).alias("wrapped"), sensors.clamp_index(F.col("iy") - 7, 40).alias("cut"))


CLAMP_SQL = "SELECT ix, iy, CASE WHEN n % 3 <> 0 THEN round(greatest(0.3, least(0.6, mean_z)), 6) END AS clamped, n % 3 <> 0 AS valid, false AS never, (ix - 60 + 104) % 52 AS wrapped, greatest(0, least(39, iy - 7)) AS cut FROM f_cells"


def color_q(spark, sf_dir):
    c = [(F.col("seq") * k % 256).cast("int") for k in (3, 5, 7)]
    packed = sensors.pack_color(*c)
    r, g, b = sensors.unpack_color(packed)
    return fx.topics(spark, sf_dir).select("seq", packed.alias("packed"), r.alias("r"), g.alias("g"), b.alias("b"))


COLOR_SQL = "SELECT seq, (seq * 3 % 256 * 65536 + seq * 5 % 256 * 256 + seq * 7 % 256)::INT AS packed, (seq * 3 % 256)::INT AS r, (seq * 5 % 256)::INT AS g, (seq * 7 % 256)::INT AS b FROM f_topics"


def gate_q(spark, sf_dir):
    keep = sensors.height_gate(F.col("x"), F.col("y"), F.col("z"), 3.0, 0.85, 0.02, 10.0, 0.15)
    return fx.points(spark, sf_dir).where(keep).groupBy("frame_id").agg(F.count("*").alias("n"))


def angles_q(spark, sf_dir):
    a, b, n = sensors.landing_angles(F.col("x"), F.col("y"), F.col("z") + 1)
    return fx.points(spark, sf_dir).groupBy("frame_id").agg(F.round(F.avg(a), 6).alias("ax"), F.round(F.avg(b), 6).alias("ay"), F.round(F.max(n), 6).alias("far"))


def between_q(spark, sf_dir):
    return rounded(grid.cells_between(fx.cells(spark, sf_dir), MAP, "mean_z", 0.45, 0.55).select("x", "y", "mean_z"), "mean_z")


def cost_counts_q(spark, sf_dir):
    c = fx.cells(spark, sf_dir).withColumn("cost", F.col("n") * 7 % 103 - 1)
    return c.groupBy(geo.cost_class(F.col("cost")).alias("cost_class")).agg(F.count("*").alias("n"), F.count_if(F.col("cost") > 0).alias("nonzero"))


COST_SQL = "SELECT CASE WHEN c < 0 THEN 'unknown' WHEN c = 0 THEN 'free' WHEN c >= 90 THEN 'lethal' WHEN c >= 50 THEN 'inflated' ELSE 'low' END AS cost_class, count(*) AS n, count(*) FILTER (WHERE c > 0) AS nonzero FROM (SELECT n * 7 % 103 - 1 AS c FROM f_cells) GROUP BY 1"


def verdict_q(spark, sf_dir):
    t = fx.topics(spark, sf_dir).select("device_id", (F.col("topic") == "click").alias("raw"), (F.col("value") > 100).alias("active"), (F.col("value") > 250).alias("lethal"))
    return health.pipeline_verdict(t, ["device_id"], [("raw", "no raw scan"), ("active", "no active scan"), ("lethal", "no lethal cell")])


def imu_init_q(spark, sf_dir):
    imu = fx.topics(spark, sf_dir).selectExpr("device_id", "t", "seq", "sqrt(value) / 9 AS ax", "sin(seq) / 3 AS ay", "9.8D + cos(seq) / 7 AS az", "sin(seq * 2) / 11 AS gx", "ln(1 + value) / 10 AS gy", "0.01D AS gz")
    out = health.imu_init_stats(imu, ["device_id"], 20)
    return rounded(out, *[c for c in out.columns if c not in ("device_id", "n")], digits=5)


IMU_SQL = """, a AS (SELECT device_id, sqrt(value) / 9 AS ax, sin(seq) / 3 AS ay, 9.8::DOUBLE + cos(seq) / 7 AS az, sin(seq * 2) / 11 AS gx, ln(1 + value) / 10 AS gy, 0.01::DOUBLE AS gz FROM f_topics QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY t, seq) <= 20),
 m AS (SELECT device_id, count(*) AS n, """ + ", ".join(f"avg({c}) AS mean_{c}, var_pop({c}) AS var_{c}" for c in ("ax", "ay", "az", "gx", "gy", "gz")) + """ FROM a GROUP BY 1), g AS (SELECT *, sqrt(mean_ax * mean_ax + mean_ay * mean_ay + mean_az * mean_az) AS norm FROM m)
 SELECT device_id, n, """ + ", ".join(f"round(mean_{c}, 5) AS mean_{c}, round(var_{c}, 5) AS var_{c}" for c in ("ax", "ay", "az", "gx", "gy", "gz")) + ", " + ", ".join(f"round(-mean_a{c} / norm * 9.81, 5) AS gravity_{c}" for c in "xyz") + " FROM g"


def by_size_q(spark, sf_dir):
    c = windows.gap_clusters(fx.scans(spark, sf_dir), 1.5, 2)
    return health.clusters_by_size(c, "scan_id").select("scan_id", "first_beam", "n", "place")


def around_q(spark, sf_dir):
    poses = windows.dead_reckon(fx.odometry(spark, sf_dir)).groupBy("device_id").agg(F.max_by(F.struct("x", "y"), F.struct("t", "seq")).alias("p"))
    found = grid.cells_around(fx.cells(spark, sf_dir).select("ix", "iy", "n"), poses.select("device_id", "p.x", "p.y"), MAP, ["device_id"], 2)
    return found.groupBy("device_id").agg(F.sum("n").alias("n"), F.count("*").alias("cells"))


AROUND_SQL = motion.DEAD_SQL + """, l AS (SELECT device_id, arg_max(x, (t, seq)) AS x, arg_max(y, (t, seq)) AS y FROM reck GROUP BY 1), i AS (SELECT device_id, floor(52 - x) AS px, floor(52 - y) AS py FROM l)
 SELECT device_id, sum(n)::BIGINT AS n, count(*) AS cells FROM i JOIN f_cells ON abs(ix - px) <= 2 AND abs(iy - py) <= 2 WHERE px BETWEEN 0 AND 51 AND py BETWEEN 0 AND 51 GROUP BY 1"""


def posed_shots(spark, sf_dir):
    poses = windows.dead_reckon(fx.odometry(spark, sf_dir))
    shots = fx.topics(spark, sf_dir).where("topic = 'click'").selectExpr("device_id", "seq", "t", "value / 100 AS x", "0.5D AS y")
    return shots, poses


def transform_join_q(spark, sf_dir):
    joined = timejoin.transform_join(*posed_shots(spark, sf_dir), ["device_id"], 3.0)
    return rounded(joined.select("device_id", "seq", "wx", "wy"), "wx", "wy", digits=4)


def transform_rejects_q(spark, sf_dir):
    """Poses of every third row only, so that some shots are too old or before all poses."""
    shots, poses = posed_shots(spark, sf_dir)
    kept = poses.where("seq % 3 = 0 AND device_id % 7 > 0")
    current = timejoin.transform_rejects(timejoin.transform_join(shots, kept, ["device_id"], 0.4), ["device_id"])
    latest = timejoin.transform_join(shots, kept, ["device_id"], 0.4, allow_latest=True)
    sums = latest.groupBy("device_id").agg(F.count_if(F.col("pose") == "latest").alias("by_latest"), F.sum("wx").alias("sum_wx"))
    return rounded(current.drop("latest").join(sums, "device_id"), "sum_wx", digits=3)


TRANSFORM_SQL = motion.DEAD_SQL + """, shot AS (SELECT * FROM f_topics WHERE topic = 'click'), pose AS (SELECT * FROM reck)
 SELECT shot.device_id, shot.seq, CASE WHEN shot.t - pose.t <= 3 THEN round(cos(theta) * value / 100 - sin(theta) * 0.5 + x, 4) END AS wx, CASE WHEN shot.t - pose.t <= 3 THEN round(sin(theta) * value / 100 + cos(theta) * 0.5 + y, 4) END AS wy
 FROM shot ASOF LEFT JOIN pose ON shot.device_id = pose.device_id AND shot.t >= pose.t"""

REJECTS_SQL = motion.DEAD_SQL + """, pose AS (SELECT * FROM reck WHERE seq % 3 = 0 AND device_id % 7 > 0), shot AS (SELECT device_id, seq, t, value / 100 AS x FROM f_topics WHERE topic = 'click'),
 m AS (SELECT shot.*, p.t AS pt, p.x AS px, p.theta AS pth FROM shot ASOF LEFT JOIN pose p ON shot.device_id = p.device_id AND shot.t >= p.t),
 l AS (SELECT device_id, arg_max(x, (t, seq)) AS lx, arg_max(theta, (t, seq)) AS lth FROM pose GROUP BY 1),
 j AS (SELECT m.*, coalesce(t - pt <= 0.4::DOUBLE, false) AS cur, lx, lth FROM m LEFT JOIN l USING (device_id))
 SELECT device_id, count(*) AS n, count(*) FILTER (WHERE NOT cur) AS rejected, count(*) FILTER (WHERE NOT cur AND lx IS NOT NULL) AS by_latest, round(sum(CASE WHEN cur THEN cos(pth) * x - sin(pth) * 0.5 + px ELSE cos(lth) * x - sin(lth) * 0.5 + lx END), 3) AS sum_wx FROM j GROUP BY 1"""

QUERIES = {
    "p13_beam_index": (beams_q, o(BEAMS_SQL, O)),
    "p15_depth": (depth_q, o(DEPTH_SQL, T)),
    "p21_update_flags": (update_flags_q, o(UPDATE_SQL, T)),
    "p22_body_velocity": (velocity_q, o(VELOCITY_SQL, O)),
    "p33_clamp_layer": (clamp_q, o(CLAMP_SQL, C)),
    "p40_landing_angles": (angles_q, o("SELECT frame_id, round(avg(atan2(x, z + 1)), 6) AS ax, round(avg(atan2(y, z + 1)), 6) AS ay, round(max(sqrt(x*x + y*y + (z + 1)*(z + 1))), 6) AS far FROM f_points GROUP BY 1", P)),
    "p41_height_gate": (gate_q, o("SELECT frame_id, count(*) AS n FROM f_points WHERE sqrt(x*x + y*y) >= 3 AND z <= 0.85 AND z <= greatest(sqrt(x*x + y*y) - 10, 0) * 0.02 + 0.15 GROUP BY 1", P)),
    "s10_colors": (color_q, o(COLOR_SQL, T)),
    "s12_cells_between": (between_q, o("SELECT 52 - ix - 0.5::DOUBLE AS x, 52 - iy - 0.5::DOUBLE AS y, round(mean_z, 6) AS mean_z FROM f_cells WHERE mean_z BETWEEN 0.45 AND 0.55", C)),
    "a12_cost_classes": (cost_counts_q, o(COST_SQL, C)),
    "a16_verdict": (verdict_q, o("SELECT device_id, CASE WHEN NOT bool_or(topic = 'click') THEN 'no raw scan' WHEN NOT bool_or(value > 100) THEN 'no active scan' WHEN NOT bool_or(value > 250) THEN 'no lethal cell' ELSE 'ok' END AS verdict FROM f_topics GROUP BY 1", T)),
    "a17_imu_init": (imu_init_q, o(IMU_SQL, T)),
    "k04_clusters_by_size": (by_size_q, o(motion.CLUSTERS_SQL + " SELECT scan_id, first_beam, n, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, first_beam)::INT AS place FROM cl", S)),
    "j03_rejects": (transform_rejects_q, o(REJECTS_SQL, "f_odom", "f_topics")),
    "j03_transform_join": (transform_join_q, o(TRANSFORM_SQL, T, O)),
    "g25_cells_around": (around_q, o(AROUND_SQL, O, C)),
}
