"""Queries on density, sampled tracks, roads and lookups, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.operators import density as den
from driftline.operators import kinematics as kin
from driftline.operators import proximity as prox
from driftline.operators import roads

from .registry import query
from .relations import fixes, r, rs, scene_tracks, table, with_, zones
from .tracks import judged


def vehicles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "value").join(fixes(spark, sf), F.col("event_id") == F.col("fix_no")).select(F.floor(F.col("t_s") / 300).alias("clock"), F.col("fix_no").alias("id"), "e_m", "n_m", F.when(F.col("value") > 80, 3).when(F.col("value") > 40, 2).otherwise(1).alias("weight"))


_V = with_("fixes", "zones") + ", v AS (SELECT CAST(floor(t_s / 300) AS BIGINT) AS clock, fix_no AS id, e_m, n_m, CASE WHEN value > 80 THEN 3 WHEN value > 40 THEN 2 ELSE 1 END AS weight FROM fixes JOIN events ON event_id = fix_no), f AS (SELECT a.clock, a.id, sum(b.weight * exp(-((a.e_m - b.e_m) ** 2 + (a.n_m - b.n_m) ** 2) / (2 * 350 ** 2))) AS density FROM v a JOIN v b ON a.clock = b.clock GROUP BY a.clock, a.id), c AS (SELECT clock, zone_id, sum(weight) AS weight FROM v JOIN zones ON sqrt((e_m - zone_e) ** 2 + (n_m - zone_n) ** 2) <= radius_m + buffer_m GROUP BY clock, zone_id)\n"


@query(_V + f"SELECT clock, id, {rs('density', 3)} AS density FROM f")
def pr_field(spark: SparkSession, sf: str) -> DataFrame:
    return den.field(vehicles(spark, sf)).select("clock", "id", r("density", 3).alias("density"))


@query(_V + f"SELECT clock, {rs('max(density)', 3)} AS peak FROM f GROUP BY clock")
def pr_peak(spark: SparkSession, sf: str) -> DataFrame:
    return den.field(vehicles(spark, sf)).groupBy("clock").agg(r(F.max("density"), 3).alias("peak"))


@query(_V + f"SELECT {rs('max(density)', 3)} AS field_ref, (SELECT max(weight)::BIGINT FROM c) AS zone_ref FROM f")
def pr_ref(spark: SparkSession, sf: str) -> DataFrame:
    v = vehicles(spark, sf)
    zone = den.reference(den.catchment(v, zones(spark, sf)), "weight").withColumnRenamed("reference", "zone_ref")
    return den.reference(den.field(v), "density").select(r("reference", 3).alias("field_ref")).crossJoin(zone)  # one row each


@query(_V + "SELECT clock, zone_id, weight::BIGINT AS weight FROM c")
def pr_catch(spark: SparkSession, sf: str) -> DataFrame:
    return den.catchment(vehicles(spark, sf), zones(spark, sf))


@query(_V + f"SELECT clock, zone_id, {rs('least(1, weight / (SELECT max(weight) FROM c))', 5)} AS share, row_number() OVER (PARTITION BY clock ORDER BY weight DESC, zone_id) AS rank FROM c")
def pr_rank(spark: SparkSession, sf: str) -> DataFrame:
    return den.ranked(den.catchment(vehicles(spark, sf), zones(spark, sf))).select("clock", "zone_id", r("share", 5).alias("share"), "rank")


@query(with_("judged") + "SELECT track_id, CASE level WHEN 'ALERT' THEN 3 WHEN 'WATCH' THEN 2 ELSE 1 END AS weight FROM judged")
def pr_weight(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select("track_id", den.weight(F.col("level")).alias("weight"))


_SAMPLED = with_("fixes") + """, s AS (SELECT *, lead(t_s) OVER w AS t1, lead(e_m) OVER w AS e1, lead(n_m) OVER w AS n1 FROM fixes WINDOW w AS (PARTITION BY track_id ORDER BY t_s, fix_no)),
k AS (SELECT unnest(generate_series(CAST(floor(min(t_s) / 600) AS BIGINT), CAST(ceil(max(t_s) / 600) AS BIGINT))) * 6e2 AS clock_s FROM fixes),
p AS (SELECT track_id, clock_s, e_m + coalesce((clock_s - t_s) / (t1 - t_s) * (e1 - e_m), 0) AS e_m, n_m + coalesce((clock_s - t_s) / (t1 - t_s) * (n1 - n_m), 0) AS n_m, coalesce(sqrt((e1 - e_m) ** 2 + (n1 - n_m) ** 2) / (t1 - t_s), 0) AS speed, coalesce((sqrt(e_m ** 2 + n_m ** 2) - sqrt(e1 ** 2 + n1 ** 2)) / (t1 - t_s), 0) AS closing FROM s JOIN k ON clock_s >= t_s AND (clock_s < t1 OR t1 IS NULL AND clock_s = t_s))
"""


@query(_SAMPLED + f"SELECT track_id, clock_s, {rs('e_m', 3)} AS e_m, {rs('n_m', 3)} AS n_m, {rs('speed')} AS speed FROM p")
def ds_sample(spark: SparkSession, sf: str) -> DataFrame:
    return den.sampled(fixes(spark, sf), 600.0).select("track_id", "clock_s", r("e_m", 3).alias("e_m"), r("n_m", 3).alias("n_m"), r("speed").alias("speed"))


@query(_SAMPLED + "SELECT clock_s, CASE WHEN speed < 0.5e0 THEN 'stopped' WHEN closing > 0.15e0 THEN 'approaching' WHEN closing < -0.15e0 THEN 'receding' ELSE 'steady' END AS trend, count(*) AS tracks FROM p GROUP BY ALL")
def ds_trend(spark: SparkSession, sf: str) -> DataFrame:
    return den.sampled(fixes(spark, sf), 600.0).groupBy("clock_s", den.trend(F.col("speed"), F.col("closing")).alias("trend")).agg(F.count("*").alias("tracks"))


@query(with_("zoned") + "SELECT track_id, string_agg(zone_id, ',' ORDER BY k2) AS zones FROM (SELECT track_id, zone_id, row_number() OVER (PARTITION BY track_id ORDER BY CASE WHEN inside THEN 0 WHEN in_buffer THEN 1 ELSE 2 END, eta_s NULLS LAST, dist_m, zone_no) AS k2 FROM zoned) WHERE k2 <= 3 GROUP BY track_id")
def ev_topzones(spark: SparkSession, sf: str) -> DataFrame:
    f = fixes(spark, sf)
    w = Window.partitionBy("track_id").orderBy(F.when(F.col("inside"), 0).when(F.col("in_buffer"), 1).otherwise(2), F.col("eta_s").asc_nulls_last(), "dist_m", "zone_no")
    top = prox.assess(kin.state(f), f, zones(spark, sf)).withColumn("k", F.row_number().over(w)).filter("k <= 3")
    return top.groupBy("track_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "zone_id"))), lambda x: x["zone_id"]), ",").alias("zones"))


@query(with_("judged") + f"SELECT track_id, level, {rs('priority', 5)} AS priority FROM judged ORDER BY level_rank DESC, judged.priority DESC, track_id LIMIT 25")
def lk_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """A report of the 25 foremost."""
    return judged(spark, sf).orderBy(F.col("level_rank").desc(), F.col("priority").desc(), "track_id").limit(25).select("track_id", "level", r("priority", 5).alias("priority"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    ax, ay = ((k % 20) * 20 - 200).cast("double"), ((k % 7) * 30 - 100).cast("double")
    return table(spark, sf, "supplier").select(k.alias("seg_id"), (k % 6).alias("way_id"), ax.alias("ax"), ay.alias("ay"), (ax + 120).alias("bx"), (ay + 40).alias("by"))


_SEG = with_("scene") + """, seg AS (SELECT s_suppkey AS seg_id, s_suppkey % 6 AS way_id, (s_suppkey % 20 * 20 - 200)::DOUBLE AS ax, (s_suppkey % 7 * 30 - 100)::DOUBLE AS ay FROM supplier),
pr AS (SELECT track_id, seg_id, way_id, t, sqrt((e_m - ax - t * 120) ** 2 + (n_m - ay - t * 40) ** 2) AS offset_m FROM (SELECT *, greatest(0, least(1, ((e_m - ax) * 120 + (n_m - ay) * 40) / 16000e0)) AS t FROM scene CROSS JOIN seg))
"""


@query(_SEG + f"SELECT track_id AS point_id, seg_id, {rs('offset_m')} AS offset_m FROM pr WHERE offset_m <= 30")
def rd_project(spark: SparkSession, sf: str) -> DataFrame:
    points = scene_tracks(spark, sf).select(F.col("track_id").alias("point_id"), "e_m", "n_m")
    return roads.within(points, segments(spark, sf), 30.0).select("point_id", "seg_id", r("offset_m").alias("offset_m"))


@query(_SEG + "SELECT track_id AS point_id, seg_id, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY offset_m, seg_id) AS k FROM pr WHERE offset_m <= 30) WHERE k <= 8")
def rd_cands_geom(spark: SparkSession, sf: str) -> DataFrame:
    points = scene_tracks(spark, sf).select(F.col("track_id").alias("point_id"), "e_m", "n_m")
    return roads.candidates(points, segments(spark, sf), 30.0, 8).select("point_id", "seg_id", "rank")


@query(_SEG + "SELECT track_id AS point_id, seg_id, row_number() OVER (PARTITION BY track_id ORDER BY offset_m, seg_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY track_id, way_id ORDER BY offset_m, seg_id) AS k FROM pr WHERE offset_m <= 30) WHERE k = 1 QUALIFY rank <= 6")
def rd_cands_graph(spark: SparkSession, sf: str) -> DataFrame:
    points = scene_tracks(spark, sf).select(F.col("track_id").alias("point_id"), "e_m", "n_m")
    return roads.candidates(points, segments(spark, sf), 30.0, 6, one_per_way=True).select("point_id", "seg_id", "rank")


@query("SELECT cx, cy, count(*) AS segments FROM (SELECT unnest(generate_series(CAST(floor(ax / 120) AS BIGINT), CAST(floor((ax + 120) / 120) AS BIGINT))) AS cx, ay FROM (SELECT (s_suppkey % 20 * 20 - 200)::DOUBLE AS ax, (s_suppkey % 7 * 30 - 100)::DOUBLE AS ay FROM supplier)) JOIN (SELECT range - 3 AS cy FROM range(0, 8)) ON cy BETWEEN floor(ay / 120) AND floor((ay + 40) / 120) GROUP BY cx, cy")
def rd_grid(spark: SparkSession, sf: str) -> DataFrame:
    return roads.cells(segments(spark, sf), 120.0).groupBy("cx", "cy").agg(F.count("*").alias("segments"))
