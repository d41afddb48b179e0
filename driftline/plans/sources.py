"""Queries on intake and its issues, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.sources import intake

from .registry import query
from .relations import frames, table, with_


def raw_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a track file, with bad times and numbers here and there."""
    k = F.col("event_id")
    time = F.when(k % 41 == 0, "24:00").otherwise(F.date_format(F.col("ts").cast("timestamp"), "HH:mm"))
    return table(spark, sf, "events").select(k.alias("row_no"), (F.col("user_id") % 40).alias("track_id"), time.alias("time"), F.when(k % 53 == 0, "nan").otherwise("39.9").alias("lat"), F.lit("32.8").alias("lon"))


_RAW = """WITH t AS (SELECT event_id AS row_no, user_id % 40 AS track_id, CASE WHEN event_id % 41 = 0 THEN '24:00' ELSE strftime(ts, '%H:%M') END AS time, event_id % 53 = 0 AS bad FROM events),
f AS (SELECT *, CASE WHEN time = '24:00' THEN 'time' WHEN bad THEN 'number_parse' WHEN row_number() OVER (PARTITION BY track_id, time, (time = '24:00' OR bad) ORDER BY row_no) > 1 THEN 'duplicate' END AS fault FROM t),
d AS (SELECT *, sum(CASE WHEN time < was THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY row_no) AS day FROM (SELECT *, lag(time) OVER (PARTITION BY track_id ORDER BY row_no) AS was FROM f WHERE fault IS NULL))
"""


@query(_RAW + "SELECT row_no, fault, CAST(day AS BIGINT) AS day FROM f LEFT JOIN (SELECT row_no, day FROM d) USING (row_no)")
def src_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return intake.tracks(raw_tracks(spark, sf)).select("row_no", "fault", "day")


@query(_RAW + "SELECT 'tracks.csv' AS file, rule, severity, count(*) AS n FROM (SELECT fault AS rule, 'error' AS severity FROM f WHERE fault IS NOT NULL) GROUP BY ALL")
def src_validation_log(spark: SparkSession, sf: str) -> DataFrame:
    return intake.issues(intake.tracks(raw_tracks(spark, sf)), "tracks.csv", "row_no").groupBy("file", "rule", "severity").agg(F.count("*").alias("n"))


@query(with_("frames") + "SELECT image_id, 'left' AS side FROM frames ANTI JOIN (SELECT DISTINCT l_suppkey + 3 AS image_id FROM lineitem) USING (image_id) UNION ALL SELECT image_id, 'right' FROM (SELECT DISTINCT l_suppkey + 3 AS image_id FROM lineitem) ANTI JOIN frames USING (image_id)")
def src_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Frames without a row of boxes, and rows of boxes without a frame."""
    return intake.orphans(frames(spark, sf), table(spark, sf, "lineitem").select((F.col("l_suppkey") + 3).alias("image_id")), "image_id")


@query("SELECT printf('R%03d', o_orderkey + 1) AS report_id, CASE WHEN o_orderkey % 29 = 0 THEN 'time' WHEN o_orderkey % 31 = 0 THEN 'source' WHEN o_orderkey % 37 = 0 THEN 'text' END AS fault FROM orders")
def src_reports(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("row_no"), F.when(k % 29 == 0, "9:05").otherwise("09:05").alias("time"), F.when(k % 31 == 0, "rumour").otherwise("official").alias("source"), F.when(k % 37 == 0, "").otherwise("text").alias("text"))
    return intake.reports(rows).select("report_id", "fault")


@query(with_("frames", "fixes") + "SELECT (SELECT count(*) FROM frames) AS frames, (SELECT count(DISTINCT (width_px, height_px)) FROM frames) AS resolutions, (SELECT count(DISTINCT track_id) FROM fixes) AS tracks, (SELECT count(*) FROM fixes) AS fixes")
def src_census(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).agg(F.count("*").alias("frames"), F.countDistinct("width_px", "height_px").alias("resolutions"))
    t = table(spark, sf, "events").agg(F.countDistinct("user_id").alias("tracks"), F.count("*").alias("fixes"))
    return f.crossJoin(t)  # one row each


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def src_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT 'Z' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS zone_id, lower(trim(n_name)) AS folded FROM nation")
def src_zones(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.format_string("Z%02d", F.col("n_nationkey") + 1).alias("zone_id"), F.lower(F.trim("n_name")).alias("folded"))
