"""The driver's tables reshaped into telemetry, points, grid cells and scans, in Spark and, for the oracle, in DuckDB SQL.

One day of `events` plays one second, so t = epoch seconds / 86400.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 86400000000.0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("user_id AS device_id", "event_id AS seq", "event_type AS topic", f"{SECONDS} AS t", "value")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics(spark, sf_dir).select("device_id", "seq", F.col("topic").alias("channel"), "t", F.expr("CASE WHEN value / 50 <= 6.0 THEN value / 50 END").alias("value"))


def odometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics(spark, sf_dir).selectExpr("device_id", "seq", "t", "value / 100 AS v", "(seq % 21 - 10) / 50.0D AS w")


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = topics(spark, sf_dir).where("seq % 89 <> 0")
    return base.selectExpr("device_id", "seq", "topic", "CASE WHEN seq % 97 = 0 THEN t - 0.9D ELSE t END AS t", "seq % 65536 AS counter", "value")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics(spark, sf_dir).selectExpr("device_id", "seq", "t", "38.98D + (seq % 1000) * 1e-5D AS lat", "117.34D + (device_id % 500) * 1e-5D AS lon", "value / 10 AS alt")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS frame_id", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity AS x", "l_extendedprice / 2100 AS y", "l_discount * 10 AS z", "l_tax * 100 AS intensity", "l_linenumber AS line"
    )


def cells(spark: SparkSession, sf_dir: str, by_frame: bool = False) -> DataFrame:
    """Cells of one map (or one a frame) at resolution 1 on 52 x 52 cells about (26, 26): mean and largest z."""
    key = ["map_id", "ix", "iy"]
    p = points(spark, sf_dir).selectExpr(f"{'frame_id' if by_frame else 'CAST(0 AS BIGINT)'} AS map_id", "CAST(floor(52 - x) AS INT) AS ix", "CAST(floor(52 - y) AS INT) AS iy", "z")
    return p.groupBy(*key).agg(F.avg("z").alias("mean_z"), F.max("z").alias("max_z"), F.count("*").alias("n"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 beams a scan in long form; range is null where nothing was seen."""
    li = read(spark, sf_dir, "lineitem")
    seen = li.selectExpr("l_suppkey AS scan_id", "CAST((l_linenumber * 13 + l_partkey) % 100 AS INT) AS beam", "l_quantity / 5 AS r").groupBy("scan_id", "beam").agg(F.min("r").alias("range"))
    ids = seen.select("scan_id").distinct().select("scan_id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("beam"))
    return ids.join(seen, ["scan_id", "beam"], "left").selectExpr("scan_id", "beam", "beam * 0.06283185307179587D - 3.141592653589793D AS angle", "range")


#: The same as common table expressions; a query's SQL starts with WITH and these.
SQL = {
    "f_topics": "SELECT user_id AS device_id, event_id AS seq, event_type AS topic, epoch_us(ts) / 86400000000.0 AS t, value FROM events",
    "f_ranges": "SELECT device_id, seq, topic AS channel, t, CASE WHEN value / 50 <= 6.0 THEN value / 50 END AS value FROM f_topics",
    "f_odom": "SELECT device_id, seq, t, value / 100 AS v, (seq % 21 - 10) / 50.0::DOUBLE AS w FROM f_topics",
    "f_faulty": "SELECT device_id, seq, topic, CASE WHEN seq % 97 = 0 THEN t - 0.9::DOUBLE ELSE t END AS t, seq % 65536 AS counter, value FROM f_topics WHERE seq % 89 <> 0",
    "f_fixes": "SELECT device_id, seq, t, 38.98::DOUBLE + (seq % 1000) * 1e-5 AS lat, 117.34::DOUBLE + (device_id % 500) * 1e-5 AS lon, value / 10 AS alt FROM f_topics",
    "f_points": "SELECT l_suppkey AS frame_id, l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_extendedprice / 2100 AS y, l_discount * 10 AS z, l_tax * 100 AS intensity, l_linenumber AS line FROM lineitem",
    "f_cells": "SELECT 0::BIGINT AS map_id, floor(52 - x)::INT AS ix, floor(52 - y)::INT AS iy, avg(z) AS mean_z, max(z) AS max_z, count(*) AS n FROM f_points GROUP BY 1, 2, 3",
    "f_scans": """SELECT scan_id, beam, beam * 0.06283185307179587::DOUBLE - 3.141592653589793::DOUBLE AS angle, range FROM
      (SELECT DISTINCT l_suppkey AS scan_id FROM lineitem) CROSS JOIN (SELECT unnest(range(100))::INT AS beam)
      LEFT JOIN (SELECT l_suppkey AS scan_id, ((l_linenumber * 13 + l_partkey) % 100)::INT AS beam, min(l_quantity / 5) AS range FROM lineitem GROUP BY 1, 2) USING (scan_id, beam)""",
}
NEEDS = {"f_ranges": ["f_topics"], "f_odom": ["f_topics"], "f_faulty": ["f_topics"], "f_fixes": ["f_topics"], "f_cells": ["f_points"]}


def oracle(body: str, *names: str) -> str:
    """The SQL of a query: common table expressions for the fixtures named, then body (which may go on with `, x AS (...)`)."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in wanted) + " " + body
