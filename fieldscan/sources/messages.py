"""Message tables by topic and day, waypoints and track files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_messages(spark: SparkSession, path: str, topics: list[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """Recorded messages; the choice of topics prunes folders."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.where(F.col("topic").isin(topics)) if topics else df


def write_messages(df: DataFrame, path: str) -> None:
    """Appends messages (topic, ts, ...) by topic and day."""
    df.withColumn("day", F.to_date("ts")).repartition("topic", "day").write.mode("append").partitionBy("topic", "day").parquet(path)


def required_topics(df: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of names (topic) that the recording lacks."""
    return names.join(df.select("topic").distinct(), "topic", "left_anti")


WAYPOINT = "name string, latitude_deg double, longitude_deg double, altitude_m double, latitude double, longitude double, altitude double"


def read_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """Waypoints of JSON lines with their aliases; `valid` is false without a position within the globe. A waypoint without
    a name is called after its place in the file."""
    raw = spark.read.schema(WAYPOINT).json(path).withColumn("_i", F.monotonically_increasing_id())
    lat, lon = F.coalesce("latitude_deg", "latitude"), F.coalesce("longitude_deg", "longitude")
    ok = lat.isNotNull() & lon.isNotNull() & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    name = F.coalesce("name", F.concat(F.lit("wp_"), F.lpad((F.col("_i") + 1).cast("string"), 2, "0")))
    return raw.select(name.alias("name"), lat.alias("latitude_deg"), lon.alias("longitude_deg"), F.coalesce("altitude_m", "altitude").alias("altitude_m"), F.coalesce(ok, F.lit(False)).alias("valid"))


def write_track_csv(df: DataFrame, path: str) -> None:
    """time, lat, lon, alt, heading_deg; what is not finite becomes empty."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c)
    df.select("time", *[finite(c) for c in ("lat", "lon", "alt", "heading_deg")]).write.option("header", True).option("emptyValue", "").csv(path)


def write_track_kml(df: DataFrame, path: str) -> None:
    """One LineString placemark a track, points in order of time."""
    point = F.struct("time", F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string"), F.col("alt").cast("string")).alias("p"))
    lines = df.groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(point)), lambda x: x["p"]), " ").alias("c"))
    lines.select(F.format_string("<Placemark><name>%s</name><LineString><coordinates>%s</coordinates></LineString></Placemark>", F.col("track").cast("string"), "c").alias("value")).write.text(path)


def write_point_batches(df: DataFrame, path: str, every_n: int) -> None:
    """Points in folders of every_n scans (scan_no from 1)."""
    df.withColumn("batch", F.floor((F.col("scan_no") - 1) / every_n)).repartition("batch").write.partitionBy("batch").parquet(path)
