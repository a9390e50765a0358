"""Registered queries over messages, odometry, fixes and scans: name -> (function of (spark, sf_dir), the same in SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import health, timejoin, windows
from ..sources import fixtures as fx

r6 = lambda c: F.round(c, 6)
TYPES = ("click", "error")


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def flagship(spark, sf_dir):
    """Per device: distance driven, rate of messages, and readings whose last error message is at most two seconds old."""
    driven = windows.path_length(windows.dead_reckon(fx.odometry(spark, sf_dir)))
    rates = windows.topic_rate(fx.topics(spark, sf_dir), ["device_id"])
    t = fx.topics(spark, sf_dir)
    errors = timejoin.asof_join(t.where("topic = 'click'"), t.where("topic = 'error'"), ["device_id"], ["value"], max_age=2.0)
    fresh = errors.groupBy("device_id").agg(F.count("prev_value").alias("n_after_error"))
    joined = driven.select("device_id", "length_m").join(rates, "device_id").join(fresh, "device_id", "left")
    return rounded(joined, "length_m", "rate", digits=4)


def ecef_q(spark, sf_dir):
    x, y, z = geo.ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    return fx.fixes(spark, sf_dir).select("seq", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(z, 4).alias("z"))


ECEF_SQL = """SELECT seq, round((n + alt) * cos(radians(lat)) * cos(radians(lon)), 4) AS x, round((n + alt) * cos(radians(lat)) * sin(radians(lon)), 4) AS y,
 round((n * (1 - e2) + alt) * sin(radians(lat)), 4) AS z FROM (SELECT *, 6378137.0::DOUBLE / sqrt(1 - e2 * sin(radians(lat)) * sin(radians(lat))) AS n
 FROM (SELECT *, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM f_fixes))"""


def enu_q(spark, sf_dir):
    f = fx.fixes(spark, sf_dir)
    origin = f.groupBy("device_id").agg(F.min_by(F.struct("lat", "lon", "alt"), F.struct("t", "seq")).alias("o"))
    e, n, u = geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), F.col("o.lat"), F.col("o.lon"), F.col("o.alt"))
    return f.join(origin, "device_id").select("seq", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"), F.round(u, 3).alias("up"))


ENU_SQL = """, e AS (SELECT *, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e2, radians(lat) AS p, radians(lon) AS q FROM f_fixes), n AS (SELECT *, 6378137.0::DOUBLE / sqrt(1 - e2 * sin(p) * sin(p)) AS n FROM e),
 x AS (SELECT device_id, seq, t, p, q, (n + alt) * cos(p) * cos(q) AS x, (n + alt) * cos(p) * sin(q) AS y, (n * (1 - e2) + alt) * sin(p) AS z FROM n), o AS (SELECT device_id, arg_min({'p': p, 'q': q, 'x': x, 'y': y, 'z': z}, (t, seq)) AS o FROM x GROUP BY 1),
 d AS (SELECT seq, o.p AS p, o.q AS q, x - o.x AS dx, y - o.y AS dy, z - o.z AS dz FROM x JOIN o USING (device_id))
 SELECT seq, round(cos(q) * dy - sin(q) * dx, 3) AS east, round(cos(p) * dz - sin(p) * cos(q) * dx - sin(p) * sin(q) * dy, 3) AS north, round(cos(p) * cos(q) * dx + cos(p) * sin(q) * dy + sin(p) * dz, 3) AS up FROM d"""


def haversine_q(spark, sf_dir):
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat") + (F.col("seq") % 7) * 0.01, F.col("lon") - (F.col("seq") % 5) * 0.02)
    return fx.fixes(spark, sf_dir).select("seq", F.round(d, 3).alias("metres"))


HAVERSINE_SQL = """SELECT seq, round(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(b - lat) / 2), 2) + cos(radians(lat)) * cos(radians(b)) * pow(sin(radians(m - lon) / 2), 2)))), 3) AS metres
 FROM (SELECT *, lat + (seq % 7) * 0.01::DOUBLE AS b, lon - (seq % 5) * 0.02::DOUBLE AS m FROM f_fixes)"""


def wrap_q(spark, sf_dir):
    o = fx.odometry(spark, sf_dir)
    a = (F.col("seq") % 1000) / 50.0 - 9.97
    z, w = geo.yaw_quat(a)
    return o.select("seq", r6(geo.wrap_pi(a)).alias("wrapped"), r6(F.atan2(F.sin(a), F.cos(a))).alias("by_atan2"), r6(geo.quat_yaw(F.lit(0.0), F.lit(0.0), z, w)).alias("yaw"))


WRAP_SQL = """SELECT seq, round(m - 2 * pi() * floor(m / (2 * pi())) - pi(), 6) AS wrapped, round(atan2(sin(a), cos(a)), 6) AS by_atan2, round(atan2(2 * cos(a / 2) * sin(a / 2), 1 - 2 * sin(a / 2) * sin(a / 2)), 6) AS yaw
 FROM (SELECT seq, a, a + pi() AS m FROM (SELECT seq, (seq % 1000) / 50.0::DOUBLE - 9.97::DOUBLE AS a FROM f_odom))"""


def transform2d_q(spark, sf_dir):
    x, y = geo.transform2d(F.col("x"), F.col("y"), F.lit(1.5), F.lit(-2.0), F.lit(0.3))
    return fx.points(spark, sf_dir).groupBy("frame_id").agg(r6(F.sum(x)).alias("sx"), r6(F.sum(y)).alias("sy"))


def rotate_q(spark, sf_dir):
    q = (F.lit(0.1), F.lit(-0.2), F.lit(0.3), F.lit(0.9))
    x, y, z = geo.rotate(q, (F.col("x"), F.col("y"), F.col("z")))
    p = fx.points(spark, sf_dir)
    return p.groupBy("frame_id").agg(F.round(F.avg(x), 5).alias("mx"), F.round(F.avg(y), 5).alias("my"), F.round(F.avg(z), 5).alias("mz"))


ROTATE_SQL = """, q AS (SELECT 0.1::DOUBLE / n AS x, -0.2::DOUBLE / n AS y, 0.3::DOUBLE / n AS z, 0.9::DOUBLE / n AS w FROM (SELECT sqrt(0.95::DOUBLE) AS n)),
 m AS (SELECT 1-2*(y*y+z*z) AS a, 2*(x*y-z*w) AS b, 2*(x*z+y*w) AS c, 2*(x*y+z*w) AS d, 1-2*(x*x+z*z) AS e, 2*(y*z-x*w) AS f, 2*(x*z-y*w) AS g, 2*(y*z+x*w) AS h, 1-2*(x*x+y*y) AS i FROM q)
 SELECT frame_id, round(avg(a*x+b*y+c*z), 5) AS mx, round(avg(d*x+e*y+f*z), 5) AS my, round(avg(g*x+h*y+i*z), 5) AS mz FROM f_points, m GROUP BY 1"""


def raw_range_q(spark, sf_dir):
    raw = F.col("seq") * 7 % 70000
    m = geo.raw_range_to_m(raw, 0.001, 0.2, 6.0)
    return fx.topics(spark, sf_dir).select("seq", r6(m).alias("metres"), m.isNotNull().alias("valid"))




def status_q(spark, sf_dir):
    raw = (F.col("seq") * 2654435761) % 65536
    bits = geo.status_bits(raw, geo.STATUS_NAMES)
    return fx.topics(spark, sf_dir).select("seq", F.concat_ws(",", bits).alias("active"), F.size(bits).cast("long").alias("n_active"), geo.work_state(raw).alias("state"))


STATUS_SQL = f"""SELECT seq, array_to_string(list_transform(list_filter(range(16), lambda k: (raw >> k) & 1 = 1), lambda k: {list(geo.STATUS_NAMES)}[k + 1]), ',') AS active, CAST(bit_count(raw) AS BIGINT) AS n_active,
 CASE WHEN raw >= 32768 THEN 'fault' WHEN (raw >> 3) & 15 > 0 THEN 'navigating' WHEN (raw >> 1) & 3 > 0 THEN 'aligning' WHEN raw & 1 = 1 THEN 'ready' ELSE 'none' END AS state
 FROM (SELECT seq, (seq * 2654435761) % 65536 AS raw FROM f_topics)"""


def deadband_q(spark, sf_dir):
    o = fx.odometry(spark, sf_dir)
    return o.select("seq", r6(geo.deadband_clamp(F.col("w"), 0.05, 0.15)).alias("w"), geo.cost_class((F.col("seq") % 103 - 1)).alias("cost_class"))


def fresh_q(spark, sf_dir):
    f = fx.faulty(spark, sf_dir).withColumn("recv_t", F.col("t") + (F.col("seq") % 13) / 10.0)
    return health.fresh(f, 0.75, 0.05).select("seq", "topic")


def asof_q(spark, sf_dir):
    t = fx.topics(spark, sf_dir)
    out = timejoin.asof_join(t.where("topic = 'click'"), t.where("topic = 'error'"), ["device_id"], ["value"], max_age=2.0)
    return rounded(out.select("device_id", "seq", "prev_t", "prev_value"), "prev_t")


ASOF_SQL = """SELECT a.device_id, a.seq, CASE WHEN a.t - b.t <= 2.0 THEN round(b.t, 6) END AS prev_t, CASE WHEN a.t - b.t <= 2.0 THEN b.value END AS prev_value
 FROM (SELECT * FROM f_topics WHERE topic = 'click') a ASOF LEFT JOIN (SELECT * FROM f_topics WHERE topic = 'error') b ON a.device_id = b.device_id AND a.t >= b.t"""


def interpolate_q(spark, sf_dir):
    t = fx.topics(spark, sf_dir)
    return rounded(timejoin.interpolate_join(t.where("topic = 'click'"), t.where("topic = 'error'"), ["device_id"], "value").select("device_id", "seq", "interpolated"), "interpolated")


INTERPOLATE_SQL = """, a AS (SELECT * FROM f_topics WHERE topic = 'click'), b AS (SELECT * FROM f_topics WHERE topic = 'error'),
 p AS (SELECT a.device_id, a.seq, a.t, b.t AS pt, b.value AS pv FROM a ASOF JOIN b ON a.device_id = b.device_id AND a.t >= b.t),
 n AS (SELECT a.seq, b.t AS nt, b.value AS nv FROM a ASOF JOIN b ON a.device_id = b.device_id AND a.t <= b.t)
 SELECT device_id, seq, round(pv + CASE WHEN nt > pt THEN (t - pt) / (nt - pt) ELSE 0 END * (nv - pv), 6) AS interpolated FROM p JOIN n USING (seq)"""


def nearest_time_q(spark, sf_dir):
    t = fx.topics(spark, sf_dir)
    return rounded(timejoin.nearest_time_join(t.where("topic = 'click'"), t.where("topic = 'error'"), ["device_id"], 0.8), "dt")


NEAREST_TIME_SQL = """, p AS (SELECT a.device_id, a.seq AS a_seq, b.seq AS b_seq, abs(a.t - b.t) AS dt FROM f_topics a JOIN f_topics b ON a.device_id = b.device_id AND a.topic = 'click' AND b.topic = 'error' AND abs(a.t - b.t) <= 0.8),
 r AS (SELECT *, row_number() OVER (PARTITION BY device_id, a_seq ORDER BY dt, b_seq) AS ra, row_number() OVER (PARTITION BY device_id, b_seq ORDER BY dt, a_seq) AS rb FROM p)
 SELECT device_id, a_seq, b_seq, round(dt, 6) AS dt FROM r WHERE ra = 1 AND rb = 1"""


def dead_reckon_q(spark, sf_dir):
    return rounded(windows.dead_reckon(fx.odometry(spark, sf_dir)).select("device_id", "seq", "theta", "x", "y"), "theta", "x", "y", digits=4)


DEAD_SQL = """, a AS (SELECT *, coalesce(t - lag(t) OVER k, 0) AS dt FROM f_odom WINDOW k AS (PARTITION BY device_id ORDER BY t, seq)),
 b AS (SELECT *, sum(w * dt) OVER k AS theta FROM a WINDOW k AS (PARTITION BY device_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING)),
 c AS (SELECT *, coalesce(lag(theta) OVER k, 0) AS th FROM b WINDOW k AS (PARTITION BY device_id ORDER BY t, seq)),
 reck AS (SELECT device_id, seq, t, theta, sum(v * cos(th) * dt) OVER k AS x, sum(v * sin(th) * dt) OVER k AS y FROM c WINDOW k AS (PARTITION BY device_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING))"""


def path_length_q(spark, sf_dir):
    return rounded(windows.path_length(windows.dead_reckon(fx.odometry(spark, sf_dir))), "length_m", digits=4)


PATH_SQL = DEAD_SQL + """, d AS (SELECT device_id, sqrt(pow(x - lag(x) OVER k, 2) + pow(y - lag(y) OVER k, 2)) AS s FROM reck WINDOW k AS (PARTITION BY device_id ORDER BY t, seq))
 SELECT device_id, round(coalesce(sum(s), 0), 4) AS length_m, count(*) AS n FROM d GROUP BY 1"""


def yaw_rate_q(spark, sf_dir):
    poses = fx.odometry(spark, sf_dir).withColumn("yaw", geo.wrap_pi(F.col("v") * 3))
    return rounded(windows.yaw_rate(poses, 2.0).select("seq", "yaw_rate"), "yaw_rate")


YAW_SQL = """, a AS (SELECT seq, v*3 - 2*pi()*floor((v*3 + pi())/(2*pi())) AS yaw, t, device_id FROM f_odom),
 b AS (SELECT seq, t - lag(t) OVER k AS dt, yaw - lag(yaw) OVER k AS dy FROM a WINDOW k AS (PARTITION BY device_id ORDER BY t, seq))
 SELECT seq, round(CASE WHEN dt > 1e-4 AND dt < 1 THEN greatest(-2.0, least(2.0, (dy - 2*pi()*floor((dy + pi())/(2*pi()))) / dt)) ELSE 0 END, 6) AS yaw_rate FROM b"""


def last_n_q(spark, sf_dir):
    return windows.last_n(fx.odometry(spark, sf_dir), 5).select("device_id", "seq")


def bucket_q(spark, sf_dir):
    return windows.first_per_bucket(fx.odometry(spark, sf_dir), 0.5).select("device_id", "seq")


def regressions_q(spark, sf_dir):
    return windows.time_regressions(fx.faulty(spark, sf_dir)).groupBy("device_id", "segment").agg(F.count("*").alias("n"))


REGRESSIONS_SQL = """, a AS (SELECT device_id, seq, coalesce((t < lag(t) OVER k)::INT, 0) AS s FROM f_faulty WINDOW k AS (PARTITION BY device_id ORDER BY seq)),
 b AS (SELECT device_id, sum(s) OVER (PARTITION BY device_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM a) SELECT device_id, segment, count(*) AS n FROM b GROUP BY 1, 2"""


def gaps_q(spark, sf_dir):
    f = fx.faulty(spark, sf_dir).withColumn("device_id", F.lit(0))
    return windows.counter_gaps(f).select("seq", "previous", F.col("counter").alias("current"), "expected")


GAPS_SQL = """, a AS (SELECT seq, counter, lag(counter) OVER (ORDER BY seq) AS previous FROM f_faulty)
 SELECT seq, previous, counter AS current, (previous + 1) % 65536 AS expected FROM a WHERE counter <> (previous + 1) % 65536 AND counter <> previous"""


def clusters_q(spark, sf_dir):
    return rounded(windows.gap_clusters(fx.scans(spark, sf_dir), 1.5, 2), "nearest", "cx", "cy")


CLUSTERS_SQL = """, xy AS (SELECT *, range * cos(angle) AS x, range * sin(angle) AS y FROM f_scans),
 a AS (SELECT *, (range IS NULL OR lag(range) OVER k IS NULL OR sqrt(pow(x - lag(x) OVER k, 2) + pow(y - lag(y) OVER k, 2)) > 1.5)::INT AS nw FROM xy WINDOW k AS (PARTITION BY scan_id ORDER BY beam)),
 b AS (SELECT *, sum(nw) OVER (PARTITION BY scan_id ORDER BY beam ROWS UNBOUNDED PRECEDING) AS run FROM a),
 cl AS (SELECT scan_id, min(beam) AS first_beam, count(*) AS n, min(range) AS nearest, avg(x) AS cx, avg(y) AS cy FROM b WHERE range IS NOT NULL GROUP BY scan_id, run HAVING count(*) >= 2)"""


def obstacles_q(spark, sf_dir):
    out = windows.nearest_obstacles(windows.gap_clusters(fx.scans(spark, sf_dir), 1.5, 2), 3)
    return rounded(out.select("scan_id", "rank", "first_beam", "nearest", "bearing"), "nearest", "bearing")


def repeats_q(spark, sf_dir):
    p = fx.points(spark, sf_dir).withColumn("x", F.round(F.col("x") / 25)).withColumn("y", F.round(F.col("y") / 25)).withColumn("z", F.lit(0.0))
    return windows.drop_repeats(p, "frame_id", ["l_orderkey", "l_linenumber", "l_partkey"]).groupBy("frame_id").agg(F.count("*").alias("n"))


REPEATS_SQL = """, p AS (SELECT frame_id, round(x / 25) AS x, round(y / 25) AS y, l_orderkey, l_linenumber, l_partkey FROM f_points),
 a AS (SELECT frame_id, x = lag(x) OVER k AND y = lag(y) OVER k AS same FROM p WINDOW k AS (PARTITION BY frame_id ORDER BY l_orderkey, l_linenumber, l_partkey))
 SELECT frame_id, count(*) AS n FROM a WHERE NOT coalesce(same, false) GROUP BY 1"""


def nth_q(spark, sf_dir):
    return windows.every_nth(fx.points(spark, sf_dir), "frame_id", ["l_orderkey", "l_linenumber", "l_partkey"], 4).select("frame_id", "l_orderkey", "l_linenumber", "l_partkey")


def ring_q(spark, sf_dir):
    out = windows.neighbour_geometry(fx.points(spark, sf_dir), ["frame_id", "line"], ["l_orderkey", "l_partkey"])
    return rounded(out.select("frame_id", "line", "l_orderkey", "l_partkey", "planar_range", "next_distance"), "planar_range", "next_distance")


RING_SQL = """SELECT frame_id, line, l_orderkey, l_partkey, round(sqrt(x*x + y*y), 6) AS planar_range, round(sqrt(pow(lead(x) OVER k - x, 2) + pow(lead(y) OVER k - y, 2) + pow(lead(z) OVER k - z, 2)), 6) AS next_distance
 FROM f_points WINDOW k AS (PARTITION BY frame_id, line ORDER BY l_orderkey, l_partkey)"""


def shadow_q(spark, sf_dir):
    return rounded(windows.shadow_filter_run(fx.scans(spark, sf_dir), 2, 2.5, 0.5, 9.0).select("scan_id", "beam", "kept"), "kept")


SHADOW_SQL = """, a AS (SELECT *, count(range) OVER k = 2 AND greatest(max(range) OVER k - range, range - min(range) OVER k) < 2.5 AS ok FROM f_scans WINDOW k AS (PARTITION BY scan_id ORDER BY beam ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
 SELECT scan_id, beam, CASE WHEN range < 0.5 OR range > 9.0 OR bool_or(coalesce(ok, false)) OVER (PARTITION BY scan_id ORDER BY beam ROWS 1 PRECEDING) THEN round(range, 6) END AS kept FROM a"""


def resample_q(spark, sf_dir):
    return rounded(windows.resample_scan(fx.scans(spark, sf_dir), 36, 100), "range")


RESAMPLE_SQL = """, a AS (SELECT scan_id, beam, range, beam * 36 / 100.0::DOUBLE AS p FROM f_scans WHERE range IS NOT NULL),
 b AS (SELECT scan_id, round(p)::INT % 36 AS bin, range, row_number() OVER (PARTITION BY scan_id, round(p)::INT % 36 ORDER BY abs(p - round(p)), beam) AS r FROM a)
 SELECT s.scan_id, s.bin, round(b.range, 6) AS range FROM (SELECT DISTINCT scan_id, unnest(range(36))::INT AS bin FROM (SELECT DISTINCT scan_id FROM f_scans)) s LEFT JOIN b ON b.scan_id = s.scan_id AND b.bin = s.bin AND r = 1"""


def limits_q(spark, sf_dir):
    return rounded(windows.limit_violations(fx.odometry(spark, sf_dir), 1.0, 4.0).select("seq", "v", "allowed"), "allowed")


LIMITS_SQL = """, a AS (SELECT seq, v, t - lag(t) OVER k AS dt, lag(v) OVER k AS p FROM f_odom WINDOW k AS (PARTITION BY device_id ORDER BY t, seq)),
 b AS (SELECT seq, v, CASE WHEN dt > 0 AND dt < 1 THEN greatest(-4.0, p - dt, least(4.0, p + dt, v)) ELSE greatest(-4.0, least(4.0, v)) END AS allowed FROM a)
 SELECT seq, v, round(allowed, 6) AS allowed FROM b WHERE abs(v - allowed) > 1e-9"""


def median_q(spark, sf_dir):
    return rounded(windows.rolling_median(fx.ranges(spark, sf_dir), 5).select("seq", "median"), "median")


MEDIAN_SQL = """SELECT seq, round(median(value) OVER (PARTITION BY device_id, channel ORDER BY t, seq ROWS 4 PRECEDING), 6) AS median FROM f_ranges WHERE value IS NOT NULL"""


def rate_q(spark, sf_dir):
    return rounded(windows.topic_rate(fx.topics(spark, sf_dir), ["device_id", "topic"]), "rate")


RATE_SQL = """SELECT device_id, topic, count(*) AS n, round(CASE WHEN count(*) > 1 AND max(t) > min(t) THEN (count(*) - 1) / (max(t) - min(t)) ELSE 0 END, 6) AS rate FROM f_topics GROUP BY 1, 2"""


def quality_q(spark, sf_dir):
    return windows.frame_quality(fx.faulty(spark, sf_dir).withColumn("counter", F.floor(F.col("seq") / 40)))


QUALITY_SQL = """, a AS (SELECT device_id, (seq // 40 - lag(seq // 40) OVER (PARTITION BY device_id ORDER BY seq) + 65536) % 65536 AS s FROM f_faulty)
 SELECT device_id, count(*) AS n, count(*) FILTER (WHERE s <> 0 AND s <> 1) AS anomalies FROM a GROUP BY 1"""


def malformed_q(spark, sf_dir):
    return windows.frame_quality(fx.faulty(spark, sf_dir).withColumn("counter", F.floor(F.col("seq") / 40)), well_formed=F.col("seq") % 13 != 0)


MALFORMED_SQL = """, a AS (SELECT device_id, (seq // 40 - lag(seq // 40) OVER (PARTITION BY device_id ORDER BY seq) + 65536) % 65536 AS s FROM f_faulty WHERE seq % 13 <> 0)
 SELECT device_id, coalesce(n, 0) AS n, coalesce(anomalies, 0) AS anomalies, malformed FROM (SELECT device_id, count(*) FILTER (WHERE seq % 13 = 0) AS malformed FROM f_faulty GROUP BY 1)
 LEFT JOIN (SELECT device_id, count(*) AS n, count(*) FILTER (WHERE s <> 0 AND s <> 1) AS anomalies FROM a GROUP BY 1) USING (device_id)"""


def hold_q(spark, sf_dir):
    return rounded(windows.hold_values(fx.ranges(spark, sf_dir), 0.8, F.lit(19740.0)), "value")


HOLD_SQL = """, a AS (SELECT device_id, channel, t, value, row_number() OVER (PARTITION BY device_id, channel ORDER BY t DESC, seq DESC) AS r FROM f_ranges WHERE t <= 19740.0 AND value IS NOT NULL)
 SELECT device_id, channel, CASE WHEN 19740.0 < t + 0.8::DOUBLE THEN round(value, 6) END AS value FROM a WHERE r = 1"""


def groups_q(spark, sf_dir):
    groups = {"front": ["click", "view"], "side": ["error"], "nearest": None}
    return rounded(windows.grouped_min(fx.ranges(spark, sf_dir), ["device_id", F.floor("t").alias("tick")], groups), *groups)


GROUPS_SQL = """SELECT device_id, CAST(floor(t) AS BIGINT) AS tick, round(min(CASE WHEN channel IN ('click', 'view') THEN value END), 6) AS front, round(min(CASE WHEN channel = 'error' THEN value END), 6) AS side, round(min(value), 6) AS nearest FROM f_ranges GROUP BY 1, 2"""


def required_q(spark, sf_dir):
    names = spark.createDataFrame([(x,) for x in ("click", "error", "imu", "lidar")], "topic string")
    return names.join(fx.topics(spark, sf_dir).select("topic").distinct(), "topic", "left_anti")


T, O, X, FA, P, SC = "f_topics", "f_odom", "f_fixes", "f_faulty", "f_points", "f_scans"
o = fx.oracle
QUERIES = {
    "p01_geodetic_to_ecef": (ecef_q, o(ECEF_SQL, X)),
    "p02_geodetic_to_enu": (enu_q, o(ENU_SQL, "f_fixes")),
    "p03_haversine": (haversine_q, o(HAVERSINE_SQL, X)),
    "p04_wrap_angles": (wrap_q, o(WRAP_SQL, O)),
    "p06_rotate_translate": (rotate_q, o(ROTATE_SQL, P)),
    "p08_transform2d": (transform2d_q, o("SELECT frame_id, round(sum(cos(0.3::DOUBLE) * x - sin(0.3::DOUBLE) * y + 1.5), 6) AS sx, round(sum(sin(0.3::DOUBLE) * x + cos(0.3::DOUBLE) * y - 2.0), 6) AS sy FROM f_points GROUP BY 1", P)),
    "p18_raw_range": (raw_range_q, o("SELECT seq, round(m, 6) AS metres, m IS NOT NULL AS valid FROM (SELECT seq, CASE WHEN raw > 0 AND raw < 65000 AND raw * 0.001::DOUBLE BETWEEN 0.2 AND 6.0 THEN raw * 0.001::DOUBLE END AS m FROM (SELECT seq, seq * 7 % 70000 AS raw FROM f_topics))", T)),
    "p20_status_bits": (status_q, o(STATUS_SQL, T)),
    "p25_fresh": (fresh_q, o("SELECT seq, topic FROM (SELECT *, (t + (seq % 13) / 10.0::DOUBLE) - t AS age FROM f_faulty) WHERE age >= -0.05 AND age <= 0.75", FA)),
    "p32_deadband_costs": (deadband_q, o("SELECT seq, round(CASE WHEN abs(w) < 0.05 THEN 0 ELSE greatest(-0.15::DOUBLE, least(0.15::DOUBLE, w)) END, 6) AS w, CASE WHEN c < 0 THEN 'unknown' WHEN c = 0 THEN 'free' WHEN c >= 90 THEN 'lethal' WHEN c >= 50 THEN 'inflated' ELSE 'low' END AS cost_class FROM (SELECT *, seq % 103 - 1 AS c FROM f_odom)", O)),
    "j01_asof": (asof_q, o(ASOF_SQL, T)),
    "j02_interpolate": (interpolate_q, o(INTERPOLATE_SQL, T)),
    "j04_nearest_time": (nearest_time_q, o(NEAREST_TIME_SQL, T)),
    "a10_grouped_min": (groups_q, o(GROUPS_SQL, "f_ranges")),
    "a14_topic_rate": (rate_q, o(RATE_SQL, T)),
    "a24_frame_quality": (quality_q, o(QUALITY_SQL, FA)),
    "a24_malformed": (malformed_q, o(MALFORMED_SQL, FA)),
    "s03_required_topics": (required_q, o("SELECT topic FROM (VALUES ('click'), ('error'), ('imu'), ('lidar')) v(topic) WHERE topic NOT IN (SELECT topic FROM f_topics)", T)),
    "t04_hold_values": (hold_q, o(HOLD_SQL, "f_ranges")),
    "w01a_rolling_median": (median_q, o(MEDIAN_SQL, "f_ranges")),
    "w04_yaw_rate": (yaw_rate_q, o(YAW_SQL, O)),
    "w05_dead_reckon": (dead_reckon_q, o(DEAD_SQL + " SELECT device_id, seq, round(theta, 4) AS theta, round(x, 4) AS x, round(y, 4) AS y FROM reck", O)),
    "w06_path_length": (path_length_q, o(PATH_SQL, O)),
    "w07a_first_per_bucket": (bucket_q, o("SELECT device_id, seq FROM f_odom QUALIFY row_number() OVER (PARTITION BY device_id, floor(t * 0.5) ORDER BY t, seq) = 1", O)),
    "w08_last_n": (last_n_q, o("SELECT device_id, seq FROM f_odom QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY t DESC, seq DESC) <= 5", O)),
    "w09_time_regressions": (regressions_q, o(REGRESSIONS_SQL, FA)),
    "w10_counter_gaps": (gaps_q, o(GAPS_SQL, FA)),
    "w11_gap_clusters": (clusters_q, o(CLUSTERS_SQL + " SELECT scan_id, first_beam, n, round(nearest, 6) AS nearest, round(cx, 6) AS cx, round(cy, 6) AS cy FROM cl", SC)),
    "w12_drop_repeats": (repeats_q, o(REPEATS_SQL, P)),
    "w13_every_nth": (nth_q, o("SELECT frame_id, l_orderkey, l_linenumber, l_partkey FROM f_points QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY l_orderkey, l_linenumber, l_partkey) % 4 = 0", P)),
    "w15_neighbour_geometry": (ring_q, o(RING_SQL, P)),
    "w18_shadow_filter": (shadow_q, o(SHADOW_SQL, SC)),
    "w21_resample_scan": (resample_q, o(RESAMPLE_SQL, SC)),
    "w24_limit_violations": (limits_q, o(LIMITS_SQL, O)),
    "k01_nearest_obstacles": (obstacles_q, o(CLUSTERS_SQL + " SELECT scan_id, rank::INT AS rank, first_beam, round(nearest, 6) AS nearest, round(atan2(cy, cx), 6) AS bearing FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY nearest, first_beam) AS rank FROM cl) WHERE rank <= 3", SC)),
}
