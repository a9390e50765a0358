"""Registered queries over rings. A device's track plays a ring: a smooth line of points with turns, and every 37th reading is
missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rings, windows
from ..sources import fixtures as fx
from . import motion
from .motion import rounded

CFG = rings.RingConfig(blind=0.05, group=4, far_share=0.05, near=1.0, slim=30.0, most_to_mid=40.0, mid_to_least=40.0, down_cos=0.9, up_cos=-0.95, bent_cos=-0.9999, edge_ratio=4.0, edge_gap=0.9, open_range=4.0, straight_cos=-0.9985, even_ratio=3.0)
EVERY = 3
KEY = ["device_id"]


def ring_points(spark, sf_dir):
    poses = windows.dead_reckon(fx.odometry(spark, sf_dir)).withColumn("here", F.when(F.col("seq") % 37 != 0, 1.0).otherwise(0.0))
    x, y = F.round("x", 6) * F.col("here"), F.round("y", 6) * F.col("here")
    return poses.select("device_id", "t", "seq", x.alias("x"), y.alias("y"), (x * 0.25).alias("z"))


def labelled(spark, sf_dir):
    return rings.plane_labels(ring_points(spark, sf_dir), KEY, CFG)


def plane_labels_q(spark, sf_dir):
    return labelled(spark, sf_dir).select("device_id", "seq", "label")


def edge_points_q(spark, sf_dir):
    return rings.edge_points(labelled(spark, sf_dir), KEY, CFG).select("device_id", "seq", "label")


def plane_segments_q(spark, sf_dir):
    out = rings.surface_points(rings.edge_points(labelled(spark, sf_dir), KEY, CFG), KEY, EVERY)
    return rounded(out, "x", "y", "z")


#: Whether a segment from a point is planar depends on the points alone; only which points start one is a walk.
LABEL_SQL = motion.DEAD_SQL + f""", q AS (
  SELECT device_id, t, seq, CASE WHEN seq % 37 <> 0 THEN round(x, 6) ELSE 0 END AS x, CASE WHEN seq % 37 <> 0 THEN round(y, 6) ELSE 0 END AS y FROM reck),
q1 AS (
  SELECT *, x * 0.25 AS z, sqrt(x * x + y * y) AS reach, row_number() OVER k - 1 AS i, count(*) OVER (PARTITION BY device_id) AS n,
    coalesce(pow(lead(x) OVER k - x, 2) + pow(lead(y) OVER k - y, 2) + pow(lead(x) OVER k * 0.25 - x * 0.25, 2), 0) AS dista
  FROM q WINDOW k AS (PARTITION BY device_id ORDER BY t, seq)),
ahead AS (
  SELECT a.device_id, a.i, a.n, min(b.i) FILTER (WHERE b.i < a.i + {CFG.group} AND b.reach < {CFG.blind}) AS gone,
    min(b.i) FILTER (WHERE b.i >= a.i + {CFG.group} AND (b.reach < {CFG.blind} OR pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2) >= pow({CFG.far_share} * a.reach + {CFG.near}, 2))) AS far
  FROM q1 a JOIN q1 b ON a.device_id = b.device_id AND b.i > a.i WHERE a.reach >= {CFG.blind} AND a.i + {CFG.group} < a.n GROUP BY ALL),
seg AS (SELECT ahead.device_id, ahead.i, coalesce(gone, far, ahead.n) AS stop, gone IS NOT NULL OR coalesce(e.reach < {CFG.blind}, false) AS broken FROM ahead LEFT JOIN q1 e ON e.device_id = ahead.device_id AND e.i = ahead.far),
way AS (SELECT seg.*, a.x, a.y, a.z, e.x - a.x AS vx, e.y - a.y AS vy, e.z - a.z AS vz FROM seg JOIN q1 a USING (device_id, i) JOIN q1 e ON e.device_id = seg.device_id AND e.i = least(seg.stop, a.n - 1) WHERE NOT broken),
shape AS (
  SELECT way.device_id, way.i, way.stop, way.vx, way.vy, way.vz, pow(vx * vx + vy * vy + vz * vz, 2) AS len4,
    max(CASE WHEN b.i > way.i THEN pow((b.y - way.y) * vz - vy * (b.z - way.z), 2) + pow((b.z - way.z) * vx - (b.x - way.x) * vz, 2) + pow((b.x - way.x) * vy - vx * (b.y - way.y), 2) END) AS width,
    list_reverse_sort(list(b.dista)) AS gaps
  FROM way JOIN q1 b ON b.device_id = way.device_id AND b.i >= way.i AND b.i < way.stop GROUP BY ALL),
plane AS (
  SELECT device_id, i, vx / s AS vx, vy / s AS vy, vz / s AS vz FROM (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS s FROM shape)
  WHERE NOT (width > 0 AND len4 / width < {CFG.slim}) AND gaps[len(gaps) - 1] >= 1e-16 AND gaps[1] / gaps[len(gaps) // 2 + 1] < {CFG.most_to_mid} AND gaps[len(gaps) // 2 + 1] / gaps[len(gaps) - 1] < {CFG.mid_to_least}),
step AS (SELECT q1.device_id, q1.i, q1.reach < {CFG.blind} AS blind, stop, vx, vy, vz FROM q1 LEFT JOIN seg USING (device_id, i) LEFT JOIN plane USING (device_id, i) WHERE q1.i + {CFG.group} < q1.n),
w(device_id, i, px, py, pz, label, stop) AS (
  SELECT DISTINCT device_id, 0::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR, -1::BIGINT FROM q1 UNION ALL
  SELECT w.device_id, CASE WHEN blind THEN w.i + 1 WHEN vx IS NOT NULL THEN step.stop ELSE step.stop + 1 END, CASE WHEN blind THEN px ELSE vx END, CASE WHEN blind THEN py ELSE vy END, CASE WHEN blind THEN pz ELSE vz END,
    CASE WHEN blind OR vx IS NULL THEN NULL WHEN px IS NULL THEN 'possible_plane' WHEN abs(px * vx + py * vy + pz * vz) < 0.707 THEN 'edge_plane' ELSE 'plane' END, w.i
  FROM w JOIN step ON step.device_id = w.device_id AND step.i = w.i),
starts AS (SELECT device_id, stop AS i, label FROM w WHERE label IS NOT NULL),
spans AS (SELECT starts.device_id, starts.i, seg.stop FROM starts JOIN seg USING (device_id, i)),
held AS (SELECT q1.device_id, q1.i, max(spans.stop) AS stop FROM q1 JOIN spans ON spans.device_id = q1.device_id AND spans.i < q1.i AND q1.i <= spans.stop GROUP BY 1, 2),
lab AS (
  SELECT q1.*, coalesce(starts.label, CASE WHEN held.stop IS NULL THEN 'none' WHEN held.stop = q1.i THEN 'possible_plane' ELSE 'plane' END) AS label
  FROM q1 LEFT JOIN starts USING (device_id, i) LEFT JOIN held USING (device_id, i))"""
EDGE_SQL = f""", e1 AS (
  SELECT *, min(CASE WHEN reach >= {CFG.blind} THEN i END) OVER (PARTITION BY device_id) AS head,
    lag(x) OVER k - x AS ax, lag(y) OVER k - y AS ay, lag(z) OVER k - z AS az, lead(x) OVER k - x AS bx, lead(y) OVER k - y AS by_, lead(z) OVER k - z AS bz,
    lag(reach, 2) OVER k < {CFG.blind} AS l2, lag(reach) OVER k < {CFG.blind} AS l1, lead(reach) OVER k < {CFG.blind} AS r1, lead(reach, 2) OVER k < {CFG.blind} AS r2,
    lag(dista, 2) OVER k AS gl2, lag(dista) OVER k AS gl, lead(dista) OVER k AS gr
  FROM lab WINDOW k AS (PARTITION BY device_id ORDER BY i)),
e2 AS (
  SELECT *, (x * ax + y * ay + z * az) / nullif(sqrt(x * x + y * y + z * z) * sqrt(ax * ax + ay * ay + az * az), 0) AS cl, (x * bx + y * by_ + z * bz) / nullif(sqrt(x * x + y * y + z * z) * sqrt(bx * bx + by_ * by_ + bz * bz), 0) AS cr,
    (ax * bx + ay * by_ + az * bz) / nullif(sqrt(ax * ax + ay * ay + az * az) * sqrt(bx * bx + by_ * by_ + bz * bz), 0) AS bend,
    i >= head + 3 AND i < n - 3 AND reach >= {CFG.blind} AND label IN ('none', 'possible_plane') AND gl >= 1e-16 AND dista >= 1e-16 AS judged FROM e1),
e3 AS (
  SELECT *, CASE WHEN l1 THEN CASE WHEN reach > {CFG.open_range} THEN 'open' ELSE 'blind' END WHEN cl < {CFG.up_cos} THEN 'behind' WHEN cl > {CFG.down_cos} THEN 'front' ELSE 'side' END AS lk,
    CASE WHEN r1 THEN CASE WHEN reach > {CFG.open_range} THEN 'open' ELSE 'blind' END WHEN cr < {CFG.up_cos} THEN 'behind' WHEN cr > {CFG.down_cos} THEN 'front' ELSE 'side' END AS rk,
    NOT (l1 OR l2) AND sqrt(greatest(gl, gl2)) <= {CFG.edge_ratio} * sqrt(least(gl, gl2)) AND abs(sqrt(gl) - sqrt(gl2)) <= {CFG.edge_gap} AS jl,
    NOT (r1 OR r2) AND sqrt(greatest(dista, gr)) <= {CFG.edge_ratio} * sqrt(least(dista, gr)) AND abs(sqrt(dista) - sqrt(gr)) <= {CFG.edge_gap} AS jr FROM e2),
e4 AS (
  SELECT * REPLACE (CASE WHEN NOT coalesce(judged, false) THEN label
    WHEN lk = 'side' AND rk = 'front' AND dista > 0.0225 AND dista > 4 * gl THEN CASE WHEN bend > {CFG.bent_cos} AND jl THEN 'edge_jump' ELSE label END
    WHEN lk = 'front' AND rk = 'side' AND gl > 0.0225 AND gl > 4 * dista THEN CASE WHEN bend > {CFG.bent_cos} AND jr THEN 'edge_jump' ELSE label END
    WHEN lk = 'side' AND rk = 'open' THEN CASE WHEN jl THEN 'edge_jump' ELSE label END
    WHEN lk = 'open' AND rk = 'side' THEN CASE WHEN jr THEN 'edge_jump' ELSE label END
    WHEN lk <> 'side' AND rk <> 'side' AND label = 'none' THEN 'wire' ELSE label END AS label) FROM e3),
e5 AS (SELECT *, coalesce(judged AND label = 'none' AND NOT (l1 OR r1) AND gl >= 1e-8 AND dista >= 1e-8 AND bend < {CFG.straight_cos} AND greatest(gl, dista) / least(gl, dista) < {CFG.even_ratio}, false) AS mid FROM e4),
m(device_id, i, counts) AS (
  SELECT device_id, i, mid FROM e5 WHERE i = 0 UNION ALL SELECT e5.device_id, e5.i, e5.mid AND NOT m.counts FROM m JOIN e5 ON e5.device_id = m.device_id AND e5.i = m.i + 1),
edges AS (
  SELECT e5.device_id, e5.seq, e5.i, e5.n, e5.x, e5.y, e5.z, CASE WHEN m.counts OR (label = 'none' AND (coalesce(lag(m.counts) OVER k, false) OR coalesce(lead(m.counts) OVER k, false))) THEN 'plane' ELSE label END AS label
  FROM e5 JOIN m USING (device_id, i) WINDOW k AS (PARTITION BY e5.device_id ORDER BY e5.i))"""
SURFACE_SQL = f""", s1 AS (SELECT *, label IN ('plane', 'possible_plane') AS p FROM edges),
s2 AS (SELECT *, coalesce(max(CASE WHEN NOT p THEN i END) OVER (PARTITION BY device_id ORDER BY i ROWS UNBOUNDED PRECEDING), -1) AS start FROM s1),
s3 AS (SELECT device_id, arg_min(seq, i) AS first_seq, count(*) AS n, arg_max(x, i) AS lx, arg_max(y, i) AS ly, arg_max(z, i) AS lz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, max(i) AS last, max(s2.n) AS whole FROM s2 WHERE p GROUP BY device_id, start, (i - start - 1) // {EVERY})
SELECT device_id, first_seq, n, round(CASE WHEN n = {EVERY} THEN lx ELSE mx END, 6) AS x, round(CASE WHEN n = {EVERY} THEN ly ELSE my END, 6) AS y, round(CASE WHEN n = {EVERY} THEN lz ELSE mz END, 6) AS z FROM s3 WHERE n = {EVERY} OR last < whole - 1"""
walk = lambda sql: fx.oracle(sql, "f_odom").replace("WITH ", "WITH RECURSIVE ", 1)

QUERIES = {
    "w16_edge_points": (edge_points_q, walk(LABEL_SQL + EDGE_SQL + " SELECT device_id, seq, label FROM edges")),
    "w17_plane_labels": (plane_labels_q, walk(LABEL_SQL + " SELECT device_id, seq, label FROM lab")),
    "w17_plane_segments": (plane_segments_q, walk(LABEL_SQL + EDGE_SQL + SURFACE_SQL)),
}
