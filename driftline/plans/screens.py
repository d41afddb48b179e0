"""Queries of whole screens: the log of frames, range curves, recorded decisions, found reports; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import views

from .activity import CLOCK
from .messages import _PARSED, parsed
from .registry import query
from .relations import fixes, frames, r, rs, scene_tracks, table, with_, zones
from .tracks import judged

WINDOW = 10800.0


@query(with_("frames", "judged", "scene") + f""", n AS (SELECT image_id, count(*) FILTER (WHERE level = 'ALERT') AS a, count(*) FILTER (WHERE level = 'WATCH') AS w FROM judged JOIN scene USING (track_id) GROUP BY image_id), d AS (SELECT o_custkey AS image_id, arg_max(o_orderstatus, o_orderkey) AS decision FROM orders GROUP BY o_custkey)
SELECT image_id, capture_s, CASE WHEN a > 0 THEN 'ALERT' WHEN w > 0 THEN 'WATCH' ELSE 'CLEAR' END AS level, coalesce(a, 0) AS n_alert, coalesce(w, 0) AS n_watch, decision FROM frames LEFT JOIN n USING (image_id) LEFT JOIN d USING (image_id) WHERE capture_s <= {CLOCK:.0f}""")
def vw_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are decisions on the frame that their customer's number names."""
    levels = judged(spark, sf).select("track_id", "level").join(scene_tracks(spark, sf).select("track_id", "image_id"), "track_id")
    decisions = table(spark, sf, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("verdict"))
    return views.frame_log(frames(spark, sf), levels, decisions, CLOCK)


@query(with_("judged") + f"SELECT track_id, level, {rs('score', 5)} AS score, points, {rs('far_m', 3)} AS far_m, greatest(2000, ceil(max(far_m) OVER () / 1000) * 1000)::DOUBLE AS axis_m FROM (SELECT track_id, level, priority AS score, points, far_m FROM judged JOIN (SELECT track_id, count(*) AS points, max(sqrt(e_m * e_m + n_m * n_m)) AS far_m FROM fixes WHERE t_s BETWEEN {CLOCK - WINDOW:.0f} AND {CLOCK:.0f} GROUP BY track_id) USING (track_id) WHERE level_rank > 0 AND points >= 2 ORDER BY priority DESC, track_id LIMIT 12)")
def vw_motion(spark: SparkSession, sf: str) -> DataFrame:
    vehicles = judged(spark, sf).select("track_id", "level", F.col("priority").alias("score"))
    return views.motion(fixes(spark, sf), vehicles, CLOCK, WINDOW).withColumns({"score": r("score", 5), "far_m": r("far_m", 3)})


@query(with_("judged") + """, al AS (SELECT track_id % 10 AS image_id, track_id, level, priority FROM judged WHERE level_rank > 0), lead_ AS (SELECT image_id, arg_max(track_id, (priority, -track_id)) AS lead_id, arg_max(level, (priority, -track_id)) AS lead_level FROM al GROUP BY image_id),
q AS (SELECT o_orderkey AS request_id, o_orderkey % 13 AS image_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 150 END AS track_id, o_orderkey % 7 = 0 OR o_custkey % 11 = 0 AS unnamed FROM orders)
SELECT request_id, CASE WHEN error IS NULL THEN coalesce(q_track, lead_id) END AS target_id, CASE WHEN error IS NULL THEN CASE WHEN q_track IS NULL THEN lead_level ELSE level END END AS level, error FROM (SELECT request_id, q.track_id AS q_track, lead_id, lead_level, level, CASE WHEN unnamed THEN 'no_operator_or_note' WHEN CASE WHEN q.track_id IS NULL THEN lead_id IS NULL ELSE level IS NULL END THEN 'no_alert' END AS error FROM q LEFT JOIN lead_ USING (image_id) LEFT JOIN al ON al.image_id = q.image_id AND al.track_id = q.track_id)""")
def vw_record(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are requests to record a decision; some lack an operator or a note."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = table(spark, sf, "orders").select(k.alias("request_id"), (k % 13).alias("image_id"), F.when(k % 3 == 0, c % 150).alias("track_id"), F.when(k % 7 == 0, "  ").otherwise("op").alias("operator"), F.when(c % 11 != 0, "seen").alias("note"))
    alerts = judged(spark, sf).filter("level_rank > 0").select((F.col("track_id") % 10).alias("image_id"), "track_id", "level", "priority")
    return views.recorded(asked, alerts)


@query(_PARSED + ", hit AS (SELECT p.report_id, p.kind, p.zone_id FROM parsed p JOIN zones z USING (zone_id) WHERE contains(lower(p.text), 'minibus') AND (contains(lower(z.zone_id), 'nation_1') OR contains(lower(z.name), 'nation_1')) AND p.kind = 'sighting') SELECT *, (SELECT count(*) FROM hit) AS n_found FROM hit ORDER BY report_id LIMIT 25")
def lk_reports(spark: SparkSession, sf: str) -> DataFrame:
    return views.found_reports(parsed(spark, sf), zones(spark, sf), words="Minibus", zone="NATION_1", kind="sighting")
