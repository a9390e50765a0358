"""Registered batch forms of the streams with deadlines; tests replay the streams against them."""

from __future__ import annotations

from ..operators import health
from ..sources import fixtures as fx
from .motion import rounded

o = fx.oracle
LIMITS = {"click": 1.3, "view": 2.1, "error": 2.9, "signup": 0.0}


def hold_events_q(spark, sf_dir):
    return rounded(health.hold_events(fx.ranges(spark, sf_dir), ["device_id", "channel"], 0.8), "t", "value", "until")


HOLD_SQL = """, k AS (SELECT *, t + 0.8::DOUBLE AS until, lead(t) OVER (PARTITION BY device_id, channel ORDER BY t, seq) AS nt FROM f_ranges WHERE value IS NOT NULL)
 SELECT device_id, channel, round(t, 6) AS t, seq, round(value, 6) AS value, round(until, 6) AS until FROM k UNION ALL SELECT device_id, channel, round(until, 6), NULL, NULL, NULL FROM k WHERE nt IS NULL OR nt > until"""


def health_changes_q(spark, sf_dir):
    return rounded(health.health_changes(fx.topics(spark, sf_dir), ["device_id"], LIMITS), "t")


WATCHED = {topic: limit for topic, limit in LIMITS.items() if limit > 0}
#: Each moment at which a message came or a limit ran out asks anew how old every topic's last message is.
HEALTH_SQL = f""", lim(topic, lim) AS (VALUES {", ".join(f"('{topic}', {limit}::DOUBLE)" for topic, limit in WATCHED.items())}),
 ends AS (SELECT DISTINCT device_id, t + lim AS t FROM (SELECT *, lead(t) OVER (PARTITION BY device_id, topic ORDER BY t, seq) AS nt FROM f_topics) JOIN lim USING (topic) WHERE nt IS NULL OR nt > t + lim),
 ev AS (SELECT device_id, t, seq, 0 AS late FROM f_topics UNION ALL SELECT device_id, t, NULL, 1 FROM ends),
 st AS (
  SELECT ev.device_id, ev.t, ev.seq, ev.late, {", ".join(f"coalesce(max(m.t) FILTER (WHERE m.topic = '{topic}') + {limit}::DOUBLE > ev.t OR (ev.late = 0 AND max(m.t) FILTER (WHERE m.topic = '{topic}') + {limit}::DOUBLE = ev.t), false) AS ok{k}" for k, (topic, limit) in enumerate(WATCHED.items()))}
  FROM ev LEFT JOIN f_topics m ON m.device_id = ev.device_id AND (m.t < ev.t OR m.t = ev.t AND (ev.late = 1 OR m.seq <= ev.seq)) GROUP BY ev.device_id, ev.t, ev.seq, ev.late),
 h AS (SELECT *, CASE {" ".join(f"WHEN NOT ok{k} THEN '{topic}_timeout'" for k, topic in enumerate(WATCHED))} ELSE 'healthy' END AS health FROM st)
 SELECT device_id, round(t, 6) AS t, seq, health FROM h QUALIFY coalesce(lag(health) OVER (PARTITION BY device_id ORDER BY t, late, seq) <> health, true)"""

QUERIES = {
    "r02_health_changes": (health_changes_q, o(HEALTH_SQL, "f_topics")),
    "r05_hold_events": (hold_events_q, o(HOLD_SQL, "f_ranges")),
}
