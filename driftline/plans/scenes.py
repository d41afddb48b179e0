"""Queries on frames, boxes and the matching of detections to tracks, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import geo
from driftline.operators import matching as mat
from driftline.operators import perception as per

from .registry import query
from .relations import BASE_LAT, BASE_LON, boxes, fixes, frames, r, rs, scene_detections, scene_tracks, table, with_, zones

_MLAT = "(111132.92e0 - 559.82e0 * cos(2 * radians({0})) + 1.175e0 * cos(4 * radians({0})))"
_MLON = "(111412.84e0 * cos(radians({0})) - 93.5e0 * cos(3 * radians({0})) + 0.118e0 * cos(5 * radians({0})))"
_B = f"{BASE_LAT}e0"
_BE, _BN = f"(lon_left - {BASE_LON}e0) * {_MLON.format(_B)}", f"(lat_top - {BASE_LAT}e0) * {_MLAT.format(_B)}"


@query(with_("frames") + f"SELECT image_id, {rs(_MLAT.format('lat_top'))} AS m_lat, {rs(_MLON.format('lat_top'))} AS m_lon FROM frames")
def geo_mperdeg(spark: SparkSession, sf: str) -> DataFrame:
    la, lo = geo.m_per_deg(F.col("lat_top"))
    return frames(spark, sf).select("image_id", r(la).alias("m_lat"), r(lo).alias("m_lon"))


@query(with_("frames") + f"SELECT image_id, {rs(_BE)} AS e_m, {rs(_BN)} AS n_m FROM frames")
def geo_enu(spark: SparkSession, sf: str) -> DataFrame:
    e, n = geo.to_enu(F.col("lat_top"), F.col("lon_left"), BASE_LAT, BASE_LON)
    return frames(spark, sf).select("image_id", r(e).alias("e_m"), r(n).alias("n_m"))


@query(with_("fixes") + f"SELECT fix_no, {rs('sqrt(e_m * e_m + n_m * n_m)')} AS range_m FROM fixes")
def geo_range(spark: SparkSession, sf: str) -> DataFrame:
    return fixes(spark, sf).select("fix_no", r(geo.length(F.col("e_m"), F.col("n_m"))).alias("range_m"))


@query(with_("fixes") + f"SELECT fix_no, {rs('CASE WHEN e_m = 0 AND n_m = 0 THEN 0 ELSE (degrees(atan2(e_m, n_m)) % 360 + 360) % 360 END')} AS bearing FROM fixes")
def geo_bearing(spark: SparkSession, sf: str) -> DataFrame:
    return fixes(spark, sf).select("fix_no", r(geo.bearing(F.col("e_m"), F.col("n_m"))).alias("bearing"))


def sized(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    x, y = geo.gsd(f)
    return f.withColumn("gsd_x", x).withColumn("gsd_y", y)


@query(with_("sized") + f"SELECT image_id, {rs('gsd_x', 6)} AS gsd_x, {rs('gsd_y', 6)} AS gsd_y, {rs('gsd_x * gsd_y', 6)} AS m2_per_px FROM sized")
def geo_gsd(spark: SparkSession, sf: str) -> DataFrame:
    return sized(spark, sf).select("image_id", r("gsd_x", 6).alias("gsd_x"), r("gsd_y", 6).alias("gsd_y"), r(F.col("gsd_x") * F.col("gsd_y"), 6).alias("m2_per_px"))


@query(with_("sized") + f"SELECT {rs('min(gsd_x)', 6)} AS gsd_min, {rs('max(gsd_x)', 6)} AS gsd_max FROM sized")
def geo_gsdspan(spark: SparkSession, sf: str) -> DataFrame:
    return sized(spark, sf).agg(r(F.min("gsd_x"), 6).alias("gsd_min"), r(F.max("gsd_x"), 6).alias("gsd_max"))


_PX = "FROM boxes JOIN frames USING (image_id)"
_LAT, _LON = "lat_top + ((y + h / 2) / height_px) * (lat_bottom - lat_top)", "lon_left + ((x + w / 2) / width_px) * (lon_right - lon_left)"


@query(with_("boxes", "frames") + f"SELECT image_id, idx, {_LAT} AS lat, {_LON} AS lon {_PX}")
def geo_px2ll(spark: SparkSession, sf: str) -> DataFrame:
    rows = boxes(spark, sf).join(frames(spark, sf), "image_id")
    lat, lon = geo.pixel_to_latlon(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2)
    return rows.select("image_id", "idx", lat.alias("lat"), lon.alias("lon"))


@query(with_("boxes", "frames") + f"SELECT image_id, idx, {rs('x + w / 2', 4)} AS u, {rs('y + h / 2', 4)} AS v {_PX}")
def geo_ll2px(spark: SparkSession, sf: str) -> DataFrame:
    """There and back again: pixel to ground to pixel."""
    rows = boxes(spark, sf).join(frames(spark, sf), "image_id")
    lat, lon = geo.pixel_to_latlon(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2)
    u, v = geo.latlon_to_pixel(F.col("lat"), F.col("lon"))
    return rows.withColumn("lat", lat).withColumn("lon", lon).select("image_id", "idx", r(u).alias("u"), r(v).alias("v"))


@query(with_("frames") + f"SELECT image_id, {_B} - 1e-2 BETWEEN least(lat_top, lat_bottom) AND greatest(lat_top, lat_bottom) OR lat_top BETWEEN 39.92e0 AND 39.93e0 AS over_base FROM frames")
def geo_contains(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    inside = geo.contains(F.lit(BASE_LAT) - 1e-2, F.col("lon_left"))
    return f.select("image_id", (inside | F.col("lat_top").between(39.92, 39.93)).alias("over_base"))


@query(with_("scene") + f"SELECT track_id, {rs('sqrt(greatest(-40 - e_m, 0, e_m - 40) ** 2 + greatest(-30 - n_m, 0, n_m - 30) ** 2)')} AS dist_m FROM scene")
def geo_fpdist(spark: SparkSession, sf: str) -> DataFrame:
    d = geo.box_distance(F.col("e_m"), F.col("n_m"), F.lit(-40.0), F.lit(40.0), F.lit(-30.0), F.lit(30.0))
    return scene_tracks(spark, sf).select("track_id", r(d).alias("dist_m"))


@query(with_("sized") + "SELECT image_id, CASE WHEN lat_top <= lat_bottom OR lon_right <= lon_left THEN concat_ws(',', CASE WHEN lat_top <= lat_bottom THEN 'north_south' END, CASE WHEN lon_right <= lon_left THEN 'east_west' END) WHEN gsd_y > 0 AND abs(gsd_x - gsd_y) / gsd_y > 0.05e0 THEN 'gsd_mismatch' ELSE '' END AS problems FROM sized")
def geo_problems(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select("image_id", F.array_join(geo.frame_problems(), ",").alias("problems"))


@query(with_("sized") + "SELECT image_id, 8 / (gsd_x * gsd_y) <= 250 AS review FROM sized")
def geo_legacyflag(spark: SparkSession, sf: str) -> DataFrame:
    return sized(spark, sf).select("image_id", (8 / (F.col("gsd_x") * F.col("gsd_y")) <= 200 * 1.25).alias("review"))


_HAV = "2 * 6371008.8e0 * asin(least(1, sqrt(pow(sin((radians(lat) - radians(was_lat)) / 2), 2) + cos(radians(was_lat)) * cos(radians(lat)) * pow(sin(radians(lon - was_lon) / 2), 2))))"


@query(with_("fixes") + f", ll AS (SELECT track_id, fix_no, t_s, 39.9e0 + n_m / 111000 AS lat, 32.8e0 + e_m / 85500 AS lon FROM fixes) SELECT fix_no, {rs(_HAV, 3)} AS step_m FROM (SELECT *, lag(lat) OVER w AS was_lat, lag(lon) OVER w AS was_lon FROM ll WINDOW w AS (PARTITION BY track_id ORDER BY t_s, fix_no))")
def geo_haversine(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixes(spark, sf).withColumn("lat", 39.9 + F.col("n_m") / 111000).withColumn("lon", 32.8 + F.col("e_m") / 85500)
    return geo.haversine_steps(rows).select("fix_no", r("step_m", 3).alias("step_m"))


@query(with_("boxes", "frames") + f"SELECT image_id, idx, {', '.join(f'{rs(c)} AS {c}' for c in ('crop_x', 'crop_y', 'crop_w', 'crop_h'))} FROM (SELECT *, greatest(0, least(x + w / 2 - crop_w / 2, width_px - crop_w)) AS crop_x, greatest(0, least(y + h / 2 - crop_h / 2, height_px - crop_h)) AS crop_y FROM (SELECT *, least(greatest(w + 48, (h + 48) * 1.6e0), width_px) AS crop_w, least(greatest(h + 48, (w + 48) / 1.6e0), height_px) AS crop_h {_PX}))")
def geo_crop(spark: SparkSession, sf: str) -> DataFrame:
    rows = boxes(spark, sf).join(frames(spark, sf), "image_id")
    return rows.select("image_id", "idx", *(r(c).alias(n) for n, c in geo.crop_window(24.0, 1.6).items()))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_discount * 100 + 0.5e0) AS BIGINT) AS score FROM lineitem")
def geo_round(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geo.half_up(F.col("l_discount")).alias("score"))


@query(with_("boxes") + "SELECT image_id, idx, score >= 0.35e0 AS passed FROM boxes")
def det_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return boxes(spark, sf).select("image_id", "idx", (F.col("score") >= 0.35).alias("passed"))


@query()
def det_nms(spark: SparkSession, sf: str) -> DataFrame:
    return per.suppress(boxes(spark, sf).filter("score >= 0.35e0"))


@query()
def det_nms_class(spark: SparkSession, sf: str) -> DataFrame:
    return per.suppress(boxes(spark, sf).filter("score >= 0.35e0"), by=("image_id", "cls"))


@query(with_("boxes", "sized") + f"SELECT image_id, idx, {rs('w * h * gsd_x * gsd_y')} AS area_m2, w * h * gsd_x * gsd_y >= 2.5e0 AS large FROM boxes JOIN sized USING (image_id)")
def det_area(spark: SparkSession, sf: str) -> DataFrame:
    area = F.col("w") * F.col("h") * F.col("gsd_x") * F.col("gsd_y")
    return boxes(spark, sf).join(sized(spark, sf), "image_id").select("image_id", "idx", r(area).alias("area_m2"), (area >= 2.5).alias("large"))


@query(with_("boxes", "frames") + f"SELECT image_id, idx, {rs(f'(lon - {BASE_LON}e0) * {_MLON.format(_B)}', 3)} AS e_m, {rs(f'(lat - {BASE_LAT}e0) * {_MLAT.format(_B)}', 3)} AS n_m FROM (SELECT image_id, idx, {_LAT} AS lat, {_LON} AS lon {_PX})")
def det_georef(spark: SparkSession, sf: str) -> DataFrame:
    rows = boxes(spark, sf).join(frames(spark, sf), "image_id")
    e, n = geo.to_enu(*geo.pixel_to_latlon(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2), BASE_LAT, BASE_LON)
    return rows.select("image_id", "idx", r(e, 3).alias("e_m"), r(n, 3).alias("n_m"))


@query()
def det_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return per.funnel(per.detections(boxes(spark, sf), sized(spark, sf)))


_PRED = "SELECT image_id, string_agg(cls || ' ' || CAST(CAST(floor(score * 100) AS INTEGER) AS VARCHAR) || 'e-2 ' || CAST(CAST(x AS INTEGER) AS VARCHAR) || ' ' || CAST(CAST(y AS INTEGER) AS VARCHAR) || ' ' || CAST(CAST(w AS INTEGER) AS VARCHAR) || ' ' || CASE WHEN image_id % 7 = 0 AND idx = 3 THEN '-1' WHEN image_id % 7 = 1 AND idx = 2 THEN 'x' ELSE CAST(CAST(floor(h) AS INTEGER) AS VARCHAR) END, ' ' ORDER BY idx) AS prediction FROM boxes GROUP BY image_id"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    c, whole = F.col, lambda x: F.floor(x).cast("string")
    last = F.when((c("image_id") % 7 == 0) & (c("idx") == 3), "-1").when((c("image_id") % 7 == 1) & (c("idx") == 2), "x").otherwise(whole(c("h")))
    word = F.concat_ws(" ", "cls", F.concat(whole(c("score") * 100), F.lit("e-2")), whole(c("x")), whole(c("y")), whole(c("w")), last)
    return boxes(spark, sf).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", word.alias("s")))).alias("g")).select("image_id", F.array_join(F.transform("g", lambda x: x["s"]), " ").alias("prediction"))


@query(with_("boxes") + "SELECT image_id, CASE WHEN image_id % 7 = 0 AND n > 3 THEN 'size' WHEN image_id % 7 = 1 AND n > 2 THEN 'number_parse' ELSE 'ok' END AS outcome, CASE WHEN image_id % 7 = 0 AND n > 3 THEN 3 WHEN image_id % 7 = 1 AND n > 2 THEN 2 END AS bad_group, CASE WHEN image_id % 7 = 0 AND n > 3 OR image_id % 7 = 1 AND n > 2 THEN 0 ELSE n END AS n_boxes FROM (SELECT image_id, count(*) AS n FROM boxes GROUP BY image_id)")
def src_predstring(spark: SparkSession, sf: str) -> DataFrame:
    got = per.parse_predictions(predictions(spark, sf))
    return got.select("image_id", F.coalesce("fault.rule", F.lit("ok")).alias("outcome"), F.col("fault.group").alias("bad_group"), F.when(F.col("boxes").isNull(), 0).otherwise(F.size("boxes")).alias("n_boxes"))


_PAIRS = "SELECT d.image_id, det_id, track_id, sqrt((d.e_m - t.e_m) ** 2 + (d.n_m - t.n_m) ** 2) AS dist_m FROM dets d JOIN scene t ON d.image_id = t.image_id"


@query(with_("dets") + f"SELECT image_id, det_id, track_id, {rs('dist_m')} AS dist_m FROM ({_PAIRS}) WHERE dist_m <= 30")
def join_gate_cost(spark: SparkSession, sf: str) -> DataFrame:
    return mat.pairs(scene_detections(spark, sf), scene_tracks(spark, sf), 30.0).withColumn("dist_m", r("dist_m"))


@query(with_("dets") + f"SELECT image_id, det_id, arg_min(track_id, (dist_m, track_id)) AS track_id, {rs('min(dist_m)')} AS dist_m FROM ({_PAIRS}) WHERE dist_m <= 60 GROUP BY image_id, det_id")
def match_nn(spark: SparkSession, sf: str) -> DataFrame:
    return mat.nearest(mat.pairs(scene_detections(spark, sf), scene_tracks(spark, sf), 60.0)).withColumn("dist_m", r("dist_m"))


def matched(spark: SparkSession, sf: str) -> DataFrame:
    return mat.exclusive(mat.pairs(scene_detections(spark, sf), scene_tracks(spark, sf), 30.0))


@query()
def match_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf).withColumn("dist_m", r("dist_m"))


@query()
def match_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return mat.duplicates(scene_detections(spark, sf), matched(spark, sf), scene_tracks(spark, sf))


@query()
def match_untracked(spark: SparkSession, sf: str) -> DataFrame:
    d, m = scene_detections(spark, sf), matched(spark, sf)
    return mat.untracked(d, m, mat.duplicates(d, m, scene_tracks(spark, sf))).select("image_id", "det_id")


@query()
def match_untracked_rows(spark: SparkSession, sf: str) -> DataFrame:
    d, t, m = scene_detections(spark, sf), scene_tracks(spark, sf), matched(spark, sf)
    return mat.untracked_rows(d, t, m, mat.duplicates(d, m, t), zones(spark, sf), 100.0)


@query()
def match_not_seen(spark: SparkSession, sf: str) -> DataFrame:
    return mat.not_seen(scene_tracks(spark, sf), matched(spark, sf), "abs(e_m) <= 100 AND abs(n_m) <= 80").select("image_id", "track_id", "reason")


@query(with_("dets") + f", nn AS (SELECT image_id, det_id, min(dist_m) AS dist_m FROM ({_PAIRS}) WHERE dist_m <= 60 GROUP BY image_id, det_id) SELECT count(*) AS matched, {rs('count(*) / (SELECT count(*) FROM dets)')} AS rate, {rs('median(dist_m)')} AS median_m, {rs('quantile_cont(dist_m, 0.9)')} AS p90_m, {rs('max(dist_m)')} AS max_m, count(*) FILTER (WHERE dist_m <= 5) AS within_5, count(*) FILTER (WHERE dist_m <= 10) AS within_10, count(*) FILTER (WHERE dist_m <= 25) AS within_25 FROM nn")
def match_quality(spark: SparkSession, sf: str) -> DataFrame:
    d = scene_detections(spark, sf)
    q = mat.quality(mat.nearest(mat.pairs(d, scene_tracks(spark, sf), 60.0)), d.count())
    return q.select("matched", (F.col("rate") + 0.0).alias("rate"), *(r(c).alias(c) for c in ("median_m", "p90_m", "max_m")), "within_5", "within_10", "within_25")


@query(with_("frames", "scene") + "SELECT image_id, track_id FROM (SELECT s_suppkey AS image_id, (s_suppkey % 480) * 6e1 AS capture_s FROM supplier) JOIN (SELECT track_id, floor(t_s / 60) * 60 % 600 AS t FROM scene) ON t = capture_s")
def join_capture(spark: SparkSession, sf: str) -> DataFrame:
    t = scene_tracks(spark, sf).select("track_id", (F.floor(F.col("t_s") / 60) * 60 % 600).cast("double").alias("capture_s"))
    return frames(spark, sf).join(t, "capture_s").select("image_id", "track_id")


@query(with_("fixes") + "SELECT track_id, count(*) AS fixes FROM fixes WHERE t_s <= 9000 GROUP BY track_id")
def tim_asof(spark: SparkSession, sf: str) -> DataFrame:
    from driftline.operators.kinematics import as_of

    return as_of(fixes(spark, sf), 9000.0).groupBy("track_id").agg(F.count("*").alias("fixes"))


@query(with_("frames", "fixes") + ", last AS (SELECT track_id, max(t_s) AS t_s FROM fixes GROUP BY track_id) SELECT track_id FROM last WHERE t_s = (SELECT max(t_s) FROM last)")
def flt_tracks_ending(spark: SparkSession, sf: str) -> DataFrame:
    last = fixes(spark, sf).groupBy("track_id").agg(F.max("t_s").alias("t_s"))
    return last.join(last.agg(F.max("t_s").alias("t_s")), "t_s", "left_semi").select("track_id")


@query(with_("frames") + "SELECT image_id FROM frames WHERE capture_s <= 3000")
def flt_frames_upto(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).filter("capture_s <= 3000").select("image_id")


@query(with_("frames") + "SELECT image_id FROM frames WHERE capture_s = 600")
def flt_frame_at(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).filter("capture_s = 600").select("image_id")
