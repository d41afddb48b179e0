"""Queries of what a display shows, and of answers' scope, numbers and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import guards, kinematics as kin, matching as mat, proximity as prox, views

from .registry import query
from .relations import fixes, r, rs, scene_detections, scene_tracks, table, with_, zones

#: The clock that the live views stand at, and the length of a tail, in seconds.
CLOCK, TAIL = 3000.0, 1800.0


@query(with_("fixes") + f"SELECT track_id, fix_no, {rs('t_s / 60', 3)} AS minute, {rs('sqrt(e_m * e_m + n_m * n_m)', 3)} AS range_m FROM fixes")
def ds_series(spark: SparkSession, sf: str) -> DataFrame:
    return views.series(fixes(spark, sf)).select("track_id", "fix_no", r("minute", 3).alias("minute"), r("range_m", 3).alias("range_m"))


_NOW = with_("fixes", "zoned") + f""", a AS (SELECT track_id, max(t_s) AS t0, arg_max(e_m, (t_s, fix_no)) AS e0, arg_max(n_m, (t_s, fix_no)) AS n0 FROM fixes WHERE t_s <= {CLOCK:.0f} GROUP BY track_id),
b AS (SELECT track_id, min(t_s) AS t1, arg_min(e_m, (t_s, fix_no)) AS e1, arg_min(n_m, (t_s, fix_no)) AS n1 FROM fixes WHERE t_s > {CLOCK:.0f} GROUP BY track_id),
now AS (SELECT track_id, e0 + coalesce(({CLOCK:.0f} - t0) / (t1 - t0) * (e1 - e0), 0) AS e_m, n0 + coalesce(({CLOCK:.0f} - t0) / (t1 - t0) * (n1 - n0), 0) AS n_m FROM a LEFT JOIN b USING (track_id) WHERE t1 IS NOT NULL OR t0 = {CLOCK:.0f}),
al AS (SELECT track_id, zone_id AS alert_id, CASE WHEN inside THEN 2 ELSE 1 END AS level_rank, conf AS priority FROM zoned WHERE inside OR in_buffer),
worst AS (SELECT track_id, arg_max(alert_id, (level_rank, priority, alert_id)) AS alert_id, arg_max(level_rank, (level_rank, priority, alert_id)) AS level_rank, arg_max(priority, (level_rank, priority, alert_id)) AS priority FROM al GROUP BY track_id),
live AS (SELECT track_id, e_m, n_m, ok AS assessed, CASE WHEN ok THEN coalesce(level_rank, 0) END AS level_rank, CASE WHEN ok THEN coalesce(priority, 0e0) ELSE 0e0 END AS score, CASE WHEN ok THEN alert_id END AS alert_id
  FROM (SELECT *, track_id % 97 * 6e1 <= {CLOCK:.0f} AS ok FROM now LEFT JOIN worst USING (track_id)))
"""


@query(_NOW + f"SELECT track_id, {rs('t_s', 3)} AS t_s, {rs('e_m', 3)} AS e_m, {rs('n_m', 3)} AS n_m FROM (SELECT track_id, t_s, e_m, n_m FROM fixes SEMI JOIN now USING (track_id) WHERE t_s BETWEEN {CLOCK - TAIL:.0f} AND {CLOCK:.0f} UNION ALL SELECT track_id, {CLOCK:.0f}, e_m, n_m FROM now)")
def ds_trail(spark: SparkSession, sf: str) -> DataFrame:
    return views.trail(fixes(spark, sf), CLOCK, TAIL).select("track_id", *(r(c, 3).alias(c) for c in ("t_s", "e_m", "n_m")))


def zone_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """An alert for each zone whose ring a track is in."""
    f = fixes(spark, sf)
    near = prox.assess(kin.state(f), f, zones(spark, sf)).filter("inside OR in_buffer")
    return near.select("track_id", F.col("zone_id").alias("alert_id"), F.when(F.col("inside"), 2).otherwise(1).alias("level_rank"), F.col("conf").alias("priority"))


def live(spark: SparkSession, sf: str) -> DataFrame:
    f = fixes(spark, sf)
    captures = f.select("track_id").distinct().withColumn("capture_s", F.col("track_id") % 97 * 60.0)
    return views.live(f, captures, zone_alerts(spark, sf), CLOCK)


@query(_NOW + "SELECT track_id, alert_id, level_rank, " + rs("priority") + " AS priority FROM worst")
def join_alert_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Each track's worst alert."""
    w = zone_alerts(spark, sf).groupBy("track_id").agg(F.max_by(F.struct("alert_id", "level_rank", "priority"), F.struct("level_rank", "priority", "alert_id")).alias("w"))
    return w.select("track_id", "w.alert_id", "w.level_rank", r("w.priority").alias("priority"))


@query(_NOW + f"SELECT track_id, {rs('e_m', 3)} AS e_m, {rs('n_m', 3)} AS n_m, assessed, level_rank, {rs('score')} AS score, alert_id FROM live")
def ds_live(spark: SparkSession, sf: str) -> DataFrame:
    return live(spark, sf).select("track_id", r("e_m", 3).alias("e_m"), r("n_m", 3).alias("n_m"), "assessed", "level_rank", r("score").alias("score"), "alert_id")


@query(_NOW + "SELECT wanted, count(*) AS tracks FROM live, (SELECT unnest(['all', 'judged', 'unassessed', 'CLEAR', 'WATCH', 'ALERT']) AS wanted) WHERE CASE wanted WHEN 'all' THEN true WHEN 'judged' THEN level_rank IS NOT NULL WHEN 'unassessed' THEN level_rank IS NULL ELSE coalesce(['CLEAR', 'WATCH', 'ALERT'][level_rank + 1] = wanted, false) END GROUP BY wanted")
def flt_live_filters(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ("all", "judged", "unassessed", "CLEAR", "WATCH", "ALERT")))
    return live(spark, sf).select("level_rank", F.explode(names).alias("wanted")).filter(views.passes(F.col("level_rank"), F.col("wanted"))).groupBy("wanted").agg(F.count("*").alias("tracks"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1995-03-31'")
def flt_reports_window(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of a span of time, both ends included; the filter reaches the scan."""
    rows = table(spark, sf, "orders").filter(F.col("o_orderdate").between(F.lit("1995-01-01").cast("date"), F.lit("1995-03-31").cast("date")))
    return rows.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


_SECTORS = with_("zones") + """, s AS (SELECT zone_id, zone_no, b, sqrt(zone_e * zone_e + zone_n * zone_n) + radius_m + buffer_m AS outer_m FROM (SELECT *, round((degrees(atan2(zone_e, zone_n)) % 360 + 360) % 360, 9) % 360 AS b FROM zones)),
o AS (SELECT *, coalesce(lag(b) OVER w, max(b) OVER ()) AS before, coalesce(lead(b) OVER w, min(b) OVER ()) AS after FROM s WINDOW w AS (ORDER BY b, zone_no)),
e AS (SELECT zone_id, outer_m, before + ((b - before) % 360 + 360) % 360 / 2 AS f, b + ((after - b) % 360 + 360) % 360 / 2 AS t FROM o)
"""


@query(_SECTORS + f"SELECT zone_id, {rs('f')} AS from_deg, {rs('CASE WHEN t > f THEN t ELSE t + 360 END')} AS to_deg, {rs('outer_m', 3)} AS outer_m FROM e")
def ds_sectors(spark: SparkSession, sf: str) -> DataFrame:
    return views.sectors(zones(spark, sf)).select("zone_id", r("from_deg").alias("from_deg"), r("to_deg").alias("to_deg"), r("outer_m", 3).alias("outer_m"))


_GROUPED = lambda n: f"CASE WHEN {n} < 1000 THEN CAST({n} AS VARCHAR) ELSE CAST({n} // 1000 AS VARCHAR) || '.' || lpad(CAST({n} % 1000 AS VARCHAR), 3, '0') END"


@query(f"""SELECT o_orderkey, CASE WHEN m IS NULL THEN '—' WHEN m < 1000 THEN {_GROUPED('m0')} || ' m' ELSE {_GROUPED('(h // 100)')} || ',' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || ' km' END AS distance,
CASE WHEN m IS NULL THEN '—' WHEN m < 60 THEN '<1 dk' ELSE '~' || {_GROUPED('mi')} || ' dk' END AS eta,
CASE WHEN d IS NULL THEN '—' ELSE ['K', 'KD', 'D', 'GD', 'G', 'GB', 'B', 'KB'][CAST(floor((d % 360 + 360) % 360 / 45 + 0.5e0) AS BIGINT) % 8 + 1] || ' ' || CAST(CAST(floor(d + 0.5e0) AS BIGINT) AS VARCHAR) || '°' END AS heading
FROM (SELECT *, CAST(floor(m + 0.5e0) AS BIGINT) AS m0, CAST(floor(m / 10 + 0.5e0) AS BIGINT) AS h, CAST(floor(m / 60 + 0.5e0) AS BIGINT) AS mi FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_totalprice AS DOUBLE) / (o_orderkey % 500 + 1) END AS m, CASE WHEN o_orderkey % 19 <> 0 THEN o_custkey % 400 + 0.3e0 END AS d FROM orders))""")
def ds_format(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(k % 17 != 0, F.col("o_totalprice").cast("double") / (k % 500 + 1)).alias("m"), F.when(k % 19 != 0, F.col("o_custkey") % 400 + 0.3).alias("d"))
    return rows.select("o_orderkey", views.distance_text(F.col("m")).alias("distance"), views.eta_text(F.col("m")).alias("eta"), views.heading_text(F.col("d")).alias("heading"))


_PICK = with_("zoned") + ", top AS (SELECT track_id, zone_id, k2 FROM (SELECT track_id, zone_id, row_number() OVER (PARTITION BY track_id ORDER BY CASE WHEN inside THEN 0 WHEN in_buffer THEN 1 ELSE 2 END, eta_s NULLS LAST, dist_m, zone_no) AS k2 FROM zoned) WHERE k2 <= 3) "


@query(_PICK + "SELECT track_id, coalesce(max(zone_id) FILTER (WHERE zone_id = 'Z' || lpad(CAST(track_id % 25 + 1 AS VARCHAR), 2, '0')), max(zone_id) FILTER (WHERE k2 = 1)) AS zone_id FROM top GROUP BY track_id")
def vw_pick(spark: SparkSession, sf: str) -> DataFrame:
    """A track's assessment for the zone that is asked for, else its foremost one."""
    from .displays import ev_topzones

    foremost = ev_topzones(spark, sf).select("track_id", F.split("zones", ",").alias("z"), F.format_string("Z%02d", F.col("track_id") % 25 + 1).alias("asked"))
    return foremost.select("track_id", F.when(F.array_contains("z", F.col("asked")), F.col("asked")).otherwise(F.element_at("z", 1)).alias("zone_id"))


_NEAR = with_("dets") + ", nn AS (SELECT image_id, det_id, arg_min(track_id, (dist_m, track_id)) AS track_id, min(dist_m) AS dist_m FROM (SELECT d.image_id, det_id, track_id, sqrt((d.e_m - t.e_m) ** 2 + (d.n_m - t.n_m) ** 2) AS dist_m FROM dets d JOIN scene t USING (image_id)) WHERE dist_m <= 60 GROUP BY image_id, det_id) "


@query()
def join_class(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks with the class and score of the detection that the exclusive match gives them; without one they have neither."""
    from .scenes import matched

    d, t = scene_detections(spark, sf), scene_tracks(spark, sf)
    own = matched(spark, sf).select("track_id", "det_id")
    return t.select("track_id").join(own, "track_id", "left").join(d.select("det_id", "cls", "score"), "det_id", "left").select("track_id", "det_id", "cls", "score")



@query("SELECT o_orderkey, len(v) AS n, round(list_sum(v), 2) + 0e0 AS total FROM (SELECT o_orderkey, list_distinct(flatten(list_transform([x, x / 1000, x / 60, x * 3.6e0], lambda y: [round(y, 2), round(y, 1), round(y, 0)]))) AS v FROM (SELECT o_orderkey, o_orderkey % 900 * 6e2 AS x FROM orders))")
def grd_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers that prose may name for a known one, in its other units."""
    v = guards.admissible(F.array(F.col("o_orderkey") % 900 * 600.0))
    return table(spark, sf, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", F.size("v").cast("long").alias("n"), r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query("SELECT o_orderkey, coalesce(list_aggregate(list_sort(list_distinct(list_filter(['Z' || o_orderkey % 7, 'Z' || o_custkey % 7, 'Z' || o_orderkey % 5], lambda z: z <> 'Z' || o_custkey % 5 AND z <> 'Z1'))), 'string_agg', ','), '') AS outside FROM orders")
def grd_zone_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Zones that an answer cites beside those it was asked about."""
    z = lambda c, n: F.concat(F.lit("Z"), (F.col(c) % n).cast("string"))
    said, own = F.array(z("o_orderkey", 7), z("o_custkey", 7), z("o_orderkey", 5)), F.array(z("o_custkey", 5), F.lit("Z1"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(guards.out_of_scope(said, own), ",").alias("outside"))


@query("""SELECT o_orderkey, CASE WHEN ok THEN score END AS confidence, CASE WHEN ok THEN 'answer' ELSE 'rules' END AS source, coalesce(ok AND score < 0.5e0, false) AS dissent
FROM (SELECT *, coalesce(score BETWEEN 0 AND 1 AND p0 BETWEEN 0 AND 1 AND p1 BETWEEN 0 AND 1 AND abs(p0 + p1 - 1) <= 0.01e0 AND abs(p1 - score) <= 0.01e0, false) AS ok
FROM (SELECT *, 1 - p1 + o_orderkey % 3 * 0.006e0 AS p0 FROM (SELECT *, score + o_custkey % 4 * 0.004e0 AS p1 FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 13 <> 0 THEN o_orderkey % 104 / 1e2 END AS score FROM orders))))""")
def ag_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """An answer's confidence where it is sound; one under a half is a dissent and leaves the level."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(c % 13 != 0, k % 104 / 100.0).alias("score")).withColumn("p1", F.col("score") + c % 4 * 0.004).withColumn("p0", 1 - F.col("p1") + k % 3 * 0.006)
    sure = rows.select("o_orderkey", guards.confidence(F.col("score"), F.col("p0"), F.col("p1")).alias("confidence"))
    return sure.select("o_orderkey", "confidence", F.when(F.col("confidence").isNull(), "rules").otherwise("answer").alias("source"), F.coalesce(F.col("confidence") < 0.5, F.lit(False)).alias("dissent"))


_ANSWER = "CASE WHEN turn % 5 = 0 THEN concat('Sure: ', chr(96), chr(96), chr(96), 'json', chr(10), '{\"turn\": ', CAST(turn AS string), ', \"note\": \"a } and { in it\"}', chr(10), chr(96), chr(96), chr(96), ' done') WHEN turn % 5 = 1 THEN concat('{broken ', '{\"own\": {\"id\": ', CAST(conv_id AS string), '}} tail}') WHEN turn % 5 = 2 THEN text WHEN turn % 5 = 3 THEN concat('{\"open\": ', CAST(turn AS string)) ELSE '[1, {\"a\": [2]}]' END"


@query("SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN concat('{\"turn\": ', turn, ', \"note\": \"a } and { in it\"}') WHEN 1 THEN concat('{\"own\": {\"id\": ', conv_id, '}}') END AS object FROM conversations")
def grd_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as a model's answers: fenced, behind a broken one, without any, cut off, and a list."""
    return table(spark, sf, "conversations").select("conv_id", "turn", guards.first_object(F.expr(_ANSWER)).alias("object"))
