"""Registered queries with feedback. SQL states those that a recursive walk of the small oracle tables can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunked, fold, scans, windows
from ..sources import fixtures as fx
from . import motion
from .motion import rounded

KEY = ["device_id", "channel"]
o = fx.oracle


def median_q(spark, sf_dir):
    out = fold.ordered_fold(fx.ranges(spark, sf_dir), KEY, ["value"], "filtered double", *fold.median_step(5, 1.5))
    return rounded(out.drop("t"), "filtered")


def debounce_q(spark, sf_dir):
    return fold.ordered_fold(fx.ranges(spark, sf_dir), KEY, ["value"], "danger boolean, warn boolean", *fold.debounce_step(0.8, 2.0, 2, 3)).drop("t")


def low_pass_q(spark, sf_dir):
    out = fold.ordered_fold(fx.ranges(spark, sf_dir), KEY, ["value"], "filtered double", *fold.low_pass_step(0.5, 3.0))
    return rounded(out.drop("t"), "filtered")


def sample_q(spark, sf_dir):
    return fold.ordered_fold(fx.odometry(spark, sf_dir), ["device_id"], [], "kept boolean", *fold.sample_step(0.5)).where("kept").select("device_id", "seq")


def stuck_q(spark, sf_dir):
    poses = windows.dead_reckon(fx.odometry(spark, sf_dir))
    return rounded(fold.ordered_fold(poses, ["device_id"], ["x", "y"], "idle double, stuck boolean", *fold.stuck_step(2.0, 1.0)).drop("t"), "idle")


def mean_time_q(spark, sf_dir):
    return rounded(fold.ordered_fold(fx.ranges(spark, sf_dir), KEY, ["value"], "mean double, counted long", *fold.mean_time_step(0.5)).drop("t"), "mean")


def sized_clusters(spark, sf_dir):
    """Clusters of the scans of a key, scan after scan."""
    c = windows.gap_clusters(fx.scans(spark, sf_dir), 1.5, 2)
    return c.selectExpr("CAST(floor(scan_id / 8) AS BIGINT) AS device_id", "CAST(scan_id AS DOUBLE) AS t", "n AS size", "round(cx, 6) AS x", "round(cy, 6) AS y")


def tracks_q(spark, sf_dir):
    tracked = fold.track_clusters(sized_clusters(spark, sf_dir), ["device_id"], 1.0, 3.0)
    return tracked.groupBy("device_id", "track").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def arrivals_q(spark, sf_dir):
    poses = windows.dead_reckon(fx.odometry(spark, sf_dir))
    out = fold.ordered_fold(poses, ["device_id"], ["x", "y"], "waypoint int", *fold.arrival_step(WAYPOINTS, 1.0))
    return out.where("waypoint IS NOT NULL").select("device_id", "waypoint", "seq")


def alignment_q(spark, sf_dir):
    poses = windows.dead_reckon(fx.odometry(spark, sf_dir)).selectExpr("device_id", "t", "seq", "x", "y", "theta AS yaw", "CAST(NULL AS DOUBLE) AS gx", "CAST(NULL AS DOUBLE) AS gy")
    goals = fx.topics(spark, sf_dir).where("topic = 'error'").selectExpr("device_id", "t", "-1 - seq AS seq", "CAST(NULL AS DOUBLE) AS x", "CAST(NULL AS DOUBLE) AS y", "CAST(NULL AS DOUBLE) AS yaw", "seq % 17 - 8.0D AS gx", "seq % 13 - 6.0D AS gy")
    out = fold.ordered_fold(poses.unionByName(goals), ["device_id"], ["x", "y", "yaw", "gx", "gy"], "aligning boolean", *fold.alignment_step(30.0, 10.0, 0.4, 0.5))
    return out.where("seq >= 0").select("device_id", "seq", "aligning")


def debounce_chunked_q(spark, sf_dir):
    return chunked.chunked_fold(fx.ranges(spark, sf_dir), KEY, 2.0, chunked.Latches(0.8, 2.0, 2, 3)).drop("t")


def low_pass_chunked_q(spark, sf_dir):
    return rounded(chunked.chunked_fold(fx.ranges(spark, sf_dir), KEY, 2.0, chunked.LowPass(0.5, 3.0)).drop("t"), "filtered")


def sample_chunked_q(spark, sf_dir):
    return chunked.chunked_fold(fx.odometry(spark, sf_dir), ["device_id"], 5.0, chunked.Sample(0.5)).where("kept").select("device_id", "seq")


def gaps_in_order_q(spark, sf_dir):
    energy = F.when(F.col("range").isNotNull(), 150.0 + (F.col("beam") * 37 + F.col("scan_id")) % 200)
    beams = fx.scans(spark, sf_dir).withColumn("energy", energy)
    return rounded(scans.fill_bright_gaps_in_order(beams, 100, 170.0).select("scan_id", "beam", "filled", "filled_energy"), "filled", "filled_energy")


#: The scan's lists travel through the walk; a step looks at one beam.
GAPS_IN_ORDER_SQL = """, l AS (SELECT scan_id, list(range ORDER BY beam) AS rs, list(CASE WHEN range IS NOT NULL THEN 150.0::DOUBLE + (beam * 37 + scan_id) % 200 END ORDER BY beam) AS gs FROM f_scans GROUP BY 1),
 w(scan_id, i, rs, gs) AS (SELECT scan_id, 0, rs, gs FROM l UNION ALL
 SELECT scan_id, CASE WHEN kind > 0 THEN i + 2 ELSE i + 1 END,
  CASE WHEN kind = 0 THEN rs ELSE list_transform(rs, lambda x, j: CASE WHEN j = i + 1 OR (kind = 2 AND j = (i + 1) % 100 + 1) THEN (rs[(i + 99) % 100 + 1] + rs[(i + kind) % 100 + 1]) / 2 ELSE x END) END,
  CASE WHEN kind = 0 THEN gs ELSE list_transform(gs, lambda x, j: CASE WHEN j = i + 1 OR (kind = 2 AND j = (i + 1) % 100 + 1) THEN (gs[(i + 99) % 100 + 1] + gs[(i + kind) % 100 + 1]) / 2 ELSE x END) END
 FROM (SELECT *, CASE WHEN rs[i + 1] IS NOT NULL THEN 0 WHEN l1 AND r1 AND (r2 OR l2) THEN 1 WHEN l1 AND l2 AND NOT r1 AND r2 AND r3 THEN 2 ELSE 0 END AS kind FROM (
  SELECT *, coalesce(gs[(i + 99) % 100 + 1] > 170, false) AS l1, coalesce(gs[(i + 98) % 100 + 1] > 170, false) AS l2, coalesce(gs[(i + 1) % 100 + 1] > 170, false) AS r1, coalesce(gs[(i + 2) % 100 + 1] > 170, false) AS r2, coalesce(gs[(i + 3) % 100 + 1] > 170, false) AS r3 FROM w WHERE i < 100)))
 SELECT scan_id, k::INT AS beam, round(rs[k + 1], 6) AS filled, round(gs[k + 1], 6) AS filled_energy FROM w, range(100) b(k) WHERE i >= 100"""
WAYPOINTS = [(0.5, 0.5), (2.0, 1.0), (3.0, 2.0)]
WALK = "WITH RECURSIVE "
#: Rows of a key numbered in order, for recursive walks.
LOW_PASS_SQL = """, r AS (SELECT *, row_number() OVER k AS i FROM f_ranges WHERE value IS NOT NULL WINDOW k AS (PARTITION BY device_id, channel ORDER BY t, seq)),
 w(device_id, channel, i, t, y) AS (SELECT device_id, channel, i, t, value FROM r WHERE i = 1 UNION ALL
 SELECT r.device_id, r.channel, r.i, r.t, CASE WHEN r.t - w.t <= 0 OR r.t - w.t > 3.0 THEN r.value ELSE w.y + (r.t - w.t) / (0.5 + (r.t - w.t)) * (r.value - w.y) END FROM w JOIN r ON r.device_id = w.device_id AND r.channel = w.channel AND r.i = w.i + 1)
 SELECT a.device_id, a.channel, a.seq, round(last_value(y IGNORE NULLS) OVER (PARTITION BY a.device_id, a.channel ORDER BY a.t, a.seq ROWS UNBOUNDED PRECEDING), 6) AS filtered
 FROM f_ranges a LEFT JOIN r ON a.seq = r.seq LEFT JOIN w ON w.device_id = r.device_id AND w.channel = r.channel AND w.i = r.i"""
SAMPLE_SQL = """, r AS (SELECT *, row_number() OVER k AS i FROM f_odom WINDOW k AS (PARTITION BY device_id ORDER BY t, seq)),
 w(device_id, i, seq, last, kept) AS (SELECT device_id, i, seq, t, true FROM r WHERE i = 1 UNION ALL
 SELECT r.device_id, r.i, r.seq, CASE WHEN r.t - w.last >= 2.0 THEN r.t ELSE w.last END, r.t - w.last >= 2.0 FROM w JOIN r ON r.device_id = w.device_id AND r.i = w.i + 1) SELECT device_id, seq FROM w WHERE kept"""
DEBOUNCE_SQL = """, r AS (SELECT *, row_number() OVER k AS i FROM f_ranges WINDOW k AS (PARTITION BY device_id, channel ORDER BY t, seq)),
 w(device_id, channel, seq, i, nd, nw, nc, danger, warn) AS (SELECT DISTINCT device_id, channel, -1::BIGINT, 0::BIGINT, 0, 0, 0, false, false FROM r UNION ALL
 SELECT r.device_id, r.channel, r.seq, r.i,
 CASE WHEN value < 0.8 THEN nd + 1 ELSE 0 END, CASE WHEN value < 0.8 THEN nw WHEN value < 2.0 THEN nw + 1 ELSE 0 END, CASE WHEN value < 2.0 THEN 0 ELSE nc + 1 END,
 CASE WHEN value < 0.8 AND nd + 1 >= 2 THEN true WHEN coalesce(value, 9) >= 2.0 AND nc + 1 >= 3 THEN false ELSE danger END,
 CASE WHEN value < 0.8 AND nd + 1 >= 2 THEN true WHEN value >= 0.8 AND value < 2.0 AND nw + 1 >= 2 THEN true WHEN coalesce(value, 9) >= 2.0 AND nc + 1 >= 3 THEN false ELSE warn END
 FROM w JOIN r ON r.device_id = w.device_id AND r.channel = w.channel AND r.i = w.i + 1) SELECT device_id, channel, seq, danger, warn FROM w WHERE i > 0"""
MEAN_SQL = """, r AS (SELECT *, row_number() OVER k AS i FROM f_ranges WINDOW k AS (PARTITION BY device_id, channel ORDER BY t, seq)),
 w(device_id, channel, seq, i, n, m) AS (SELECT DISTINCT device_id, channel, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE FROM r UNION ALL
 SELECT r.device_id, r.channel, r.seq, r.i, CASE WHEN value >= 0.5 * m THEN n + 1 ELSE n END, CASE WHEN value >= 0.5 * m THEN m + (value - m) / (n + 1) ELSE m END FROM w JOIN r ON r.device_id = w.device_id AND r.channel = w.channel AND r.i = w.i + 1)
 SELECT device_id, channel, seq, CASE WHEN n > 0 THEN round(m, 6) END AS mean, n AS counted FROM w WHERE i > 0"""
STUCK_SQL = motion.DEAD_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY t, seq) AS i FROM reck),
 w(device_id, i, seq, ax, ay, since, t) AS (SELECT device_id, i, seq, x, y, t, t FROM r WHERE i = 1 UNION ALL
 SELECT r.device_id, r.i, r.seq, CASE WHEN sqrt(pow(r.x - ax, 2) + pow(r.y - ay, 2)) >= 2 THEN r.x ELSE ax END, CASE WHEN sqrt(pow(r.x - ax, 2) + pow(r.y - ay, 2)) >= 2 THEN r.y ELSE ay END, CASE WHEN sqrt(pow(r.x - ax, 2) + pow(r.y - ay, 2)) >= 2 THEN r.t ELSE since END, r.t
 FROM w JOIN r ON r.device_id = w.device_id AND r.i = w.i + 1) SELECT device_id, seq, round(t - since, 6) AS idle, t - since > 1 AS stuck FROM w"""
#: The last five accepted values travel as a list; a jump puts the last output into it.
MEDIAN_SQL = """, r AS (SELECT *, row_number() OVER k AS i FROM f_ranges WINDOW k AS (PARTITION BY device_id, channel ORDER BY t, seq)),
 w(device_id, channel, seq, i, vs, last) AS (SELECT DISTINCT device_id, channel, -1::BIGINT, 0::BIGINT, []::DOUBLE[], NULL::DOUBLE FROM r UNION ALL
 SELECT device_id, channel, seq, i, vs, CASE WHEN value IS NULL THEN last ELSE list_median(vs) END FROM (SELECT r.device_id, r.channel, r.seq, r.i, r.value, w.last,
 CASE WHEN r.value IS NULL THEN w.vs ELSE list_append(w.vs, CASE WHEN w.last IS NULL OR abs(r.value - w.last) <= 1.5 THEN r.value ELSE w.last END)[-5:] END AS vs FROM w JOIN r ON r.device_id = w.device_id AND r.channel = w.channel AND r.i = w.i + 1))
 SELECT device_id, channel, seq, round(last, 6) AS filtered FROM w WHERE i > 0"""
ARRIVALS_SQL = motion.DEAD_SQL + "".join(
    f", w{k} AS (SELECT reck.device_id, {k} AS waypoint, arg_min(reck.seq, (reck.t, reck.seq)) AS seq, min((reck.t, reck.seq)) AS at FROM reck {f'JOIN w{k - 1} USING (device_id)' if k else ''} WHERE abs(x - {x}) < 1 AND abs(y - {y}) < 1 {f'AND (reck.t, reck.seq) > w{k - 1}.at' if k else ''} GROUP BY 1)"
    for k, (x, y) in enumerate(WAYPOINTS)
) + " " + " UNION ALL ".join(f"SELECT device_id, waypoint, seq FROM w{k}" for k in range(len(WAYPOINTS)))
walk = lambda sql, *names: o(sql, *names).replace("WITH ", WALK, 1)

QUERIES = {
    "w01_median_filter": (median_q, walk(MEDIAN_SQL, "f_ranges")),
    "w02_debounce": (debounce_q, walk(DEBOUNCE_SQL, "f_ranges")),
    "w03_low_pass": (low_pass_q, walk(LOW_PASS_SQL, "f_ranges")),
    "w07_sample_rate": (sample_q, walk(SAMPLE_SQL, "f_odom")),
    "w02_debounce_chunked": (debounce_chunked_q, walk(DEBOUNCE_SQL, "f_ranges")),
    "w03_low_pass_chunked": (low_pass_chunked_q, walk(LOW_PASS_SQL, "f_ranges")),
    "w07_sample_chunked": (sample_chunked_q, walk(SAMPLE_SQL, "f_odom")),
    "w20_fill_in_order": (gaps_in_order_q, walk(GAPS_IN_ORDER_SQL, "f_scans")),
    "w25_mean_time": (mean_time_q, walk(MEAN_SQL, "f_ranges")),
    "w27_stuck": (stuck_q, walk(STUCK_SQL, "f_odom")),
    "t03_tracks": (tracks_q, None),
    "w28_arrivals": (arrivals_q, o(ARRIVALS_SQL, "f_odom")),
    "r10_alignment": (alignment_q, None),
}
