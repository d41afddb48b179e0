"""Queries on reports, times and text guards, each with the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.stages import written
from driftline.operators import guards
from driftline.operators import reports as rep

from .registry import query
from .relations import fixes, r, rs, scene_detections, scene_tracks, table, with_, zones

#: Sentences that orders are written in; {lat}, {lon}, {n} and {zone} come from their columns.
SENTENCES = (
    "{lat} N, {lon} E konumunda {n} kamyon durdugu goruldu.",
    "{lat} N, {lon} E konumundaki otomobil, usse gelen tek arac.",
    "{zone} bolgesinde trafik akisi normal.",
    "Telsiz baglantisi bir sure kurulamadi.",
    "{lat} N {lon} E konumunda {n} aracli kamyon konvoyu ilerliyor.",
    "Dogrulanmamis bir duyum var.",
    "Hava kapali, bulut alcak.",
    "{zone} yakininda agir arac yok.",
    "{lat} N, {lon} E cevresinde genellikle {n} arac bulunur.",
    "{lat} N, {lon} E noktasinda kimlik teyidi yapilmis minibus beklemede.",
    "Tatbikat nedeniyle konvoy yolda.",
    "{lat} N, {lon} E icin ihbar alindi: bir saatten uzun suredir hareketsiz otobus.",
    "{zone} civarinda {n} minibus goruldu, bolgeden uzaklasiyor.",
    "{lat} S, {lon} W konumunda agir bir arac park halinde.",
    "{zone} sakin.",
    "Belirsiz mesaj.",
    "{lat} N, {lon} E konumunda bir hareket.",
    "{lat} N, {lon} E konumunda iki ARAÇ yavaş transit geçiyor",
)


def _concat(sentence: str, zone: str) -> str:
    values = {"lat": "concat('39.', cast(900 + o_custkey % 90 AS varchar(9)))", "lon": "concat('32.', cast(100 + o_orderkey % 800 AS varchar(9)))", "n": "cast(1 + o_orderkey % 6 AS varchar(9))", "zone": zone}
    parts = [values[p[1:-1]] if p.startswith("{") else f"'{p}'" for p in re.split(r"(\{\w+\})", sentence) if p]
    return f"concat({', '.join(parts)}, '')"


_TEXT = "CASE o_orderkey % 18 " + " ".join(f"WHEN {i} THEN {_concat(s, 'n_name')}" for i, s in enumerate(SENTENCES)) + " END"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Orders are reports; their customer's nation is the zone that some of them name."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    named = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    named = named.select("o_orderkey", "o_custkey", "n_name").repartition("o_orderkey")  # the patterns are the work, and a small file is one task
    return named.select(F.col("o_orderkey").alias("report_id"), F.expr(_TEXT).alias("text"), (F.col("o_orderkey") % 10).alias("image_id"), ((F.col("o_custkey") % 200) - 100).cast("double").alias("e_m"), ((F.col("o_orderkey") % 160) - 80).cast("double").alias("n_m"), ((F.col("o_orderkey") * 37) % 30000).cast("double").alias("t_s"))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return rep.parse(messages(spark, sf), zones(spark, sf))


def _case(rules, text: str = "folded") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN {v if isinstance(v, int) else repr(v)}" for v, p in rules) + " END"


_FOLD = f"lower(translate({{0}}, '{rep.FOLD_FROM}', '{rep.FOLD_TO}'))"


def _co(group: int) -> str:
    return f"nullif(regexp_extract(text, '{rep.COORDINATES}', {group}), '')"


_PARSED = with_("zones") + f""", m AS (SELECT o_orderkey AS report_id, {_TEXT} AS text, o_orderkey % 10 AS image_id, ((o_custkey % 200) - 100)::DOUBLE AS e_m, ((o_orderkey % 160) - 80)::DOUBLE AS n_m, ((o_orderkey * 37) % 30000)::DOUBLE AS t_s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT *, {_FOLD.format('text')} AS folded, CAST({_co(1)} AS DOUBLE) * CASE WHEN upper({_co(2)}) = 'S' THEN -1 ELSE 1 END AS lat0, CAST({_co(3)} AS DOUBLE) * CASE WHEN upper({_co(4)}) = 'W' THEN -1 ELSE 1 END AS lon0 FROM m),
z AS (SELECT report_id, arg_min(zone_id, (-length(name), zone_no)) AS zone_id FROM a JOIN zones ON contains(folded, {_FOLD.format('name')}) GROUP BY report_id),
b AS (SELECT a.*, lat0 AS lat, lon0 AS lon, z.zone_id, {_case([(c, chr(92) + 'b' + w) for w, c in rep.VEHICLES])} AS word, CAST(nullif(regexp_extract(folded, '{rep.COUNT_TYPE}', 1), '') AS INTEGER) AS n_word, {_case([(c, '^' + w + '$') for w, c in rep.VEHICLES], f"regexp_extract(folded, '{rep.COUNT_TYPE}', 2)")} AS t_word FROM a LEFT JOIN z USING (report_id)),
k AS (SELECT *, coalesce({_case(rep.KINDS)}, CASE WHEN lat IS NULL AND zone_id IS NULL THEN 'irrelevant' WHEN word IS NOT NULL OR n_word IS NOT NULL THEN 'sighting' END, 'unknown') AS kind, {_case(rep.MOTIONS)} AS any_motion FROM b),
parsed AS (SELECT *, CASE WHEN kind = 'sighting' AND regexp_matches(folded, '{rep.HEAVY}') THEN 'heavy' WHEN kind = 'density' THEN NULL WHEN n_word IS NULL THEN word WHEN t_word = 'vehicle' AND word <> 'vehicle' THEN word ELSE t_word END AS vehicle_type,
 CAST(CASE WHEN kind = 'density' THEN NULL WHEN n_word IS NOT NULL THEN n_word WHEN kind = 'sighting' AND regexp_matches(folded, '{rep.SINGULAR}') THEN 1 END AS INTEGER) AS count, CASE WHEN kind = 'density' THEN CAST(nullif(regexp_extract(folded, '{rep.USUAL_COUNT}', 1), '') AS INTEGER) END AS usual_count,
 CASE WHEN kind IN ('sighting', 'identified_friendly') THEN any_motion END AS motion, CASE WHEN kind IN ('sighting', 'identified_friendly') AND any_motion = 'stopped' THEN {_case(rep.STILL_FOR)} END AS still_for_min, kind = 'identified_friendly' AS friendly, kind = 'sighting' AND regexp_matches(folded, '{rep.TIP}') AS tip FROM k)
"""


@query(_PARSED + "SELECT report_id, folded FROM a")
def rpt_fold(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("report_id", rep.fold(F.col("text")).alias("folded"))


@query(_PARSED + "SELECT report_id, lat, lon FROM parsed")
def rpt_coord(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select("report_id", "lat", "lon")


@query(_PARSED + "SELECT report_id, zone_id FROM parsed")
def rpt_zone(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select("report_id", "zone_id")


@query(_PARSED + "SELECT report_id, word FROM b")
def rpt_vehicle(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("report_id", rep.vehicle_word(rep.fold(F.col("text"))).alias("word"))


@query(_PARSED + "SELECT kind, count(*) AS reports FROM parsed GROUP BY kind")
def rpt_kind(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).groupBy("kind").agg(F.count("*").alias("reports"))


_CLAIM = ["report_id", "vehicle_type", "count", "usual_count", "motion", "still_for_min", "friendly", "tip"]


@query(_PARSED + f"SELECT {', '.join(_CLAIM)} FROM parsed")
def rpt_claim(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf).select(*_CLAIM)


@query(_PARSED + "SELECT report_id FROM parsed WHERE kind = 'unknown' OR kind = 'sighting' AND lat IS NULL AND zone_id IS NULL")
def rpt_needs_llm(spark: SparkSession, sf: str) -> DataFrame:
    return rep.needs_model(parsed(spark, sf)).select("report_id")


_NEAR = with_("dets") + _PARSED.removeprefix("WITH RECURSIVE").join([", ", ""]) + """,
n AS (SELECT report_id, count(*) AS n_150, count(*) FILTER (WHERE d <= 50) AS n_50, count(*) FILTER (WHERE d <= 50 AND cls = 'car') AS n_car, count(*) FILTER (WHERE d <= 50 AND cls = 'van') AS n_van, count(*) FILTER (WHERE d <= 50 AND cls = 'truck') AS n_truck, count(*) FILTER (WHERE d <= 50 AND cls = 'bus') AS n_bus FROM (SELECT report_id, cls, sqrt((p.e_m - x.e_m) ** 2 + (p.n_m - x.n_m) ** 2) AS d FROM parsed p JOIN dets x USING (image_id)) WHERE d <= 150 GROUP BY report_id),
l AS (SELECT report_id, string_agg(CAST(track_id AS VARCHAR), ',' ORDER BY d, track_id) AS tracks, min(track_id) FILTER (WHERE k = 1) AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY d, track_id) AS k FROM (SELECT report_id, track_id, sqrt((p.e_m - x.e_m) ** 2 + (p.n_m - x.n_m) ** 2) AS d FROM parsed p JOIN scene x USING (image_id)) WHERE d <= 150) WHERE k <= 3 GROUP BY report_id),
near AS (SELECT p.*, coalesce(n_150, 0) AS n_150, coalesce(n_50, 0) AS n_50, coalesce(n_car, 0) AS n_car, coalesce(n_van, 0) AS n_van, coalesce(n_truck, 0) AS n_truck, coalesce(n_bus, 0) AS n_bus, tracks, nearest FROM parsed p LEFT JOIN n USING (report_id) LEFT JOIN l USING (report_id) WHERE lat IS NOT NULL),
fit AS (SELECT *, vehicle_type IS NOT NULL AND vehicle_type <> 'vehicle' AS typed, CASE vehicle_type WHEN 'heavy' THEN n_truck + n_bus WHEN 'car' THEN n_car WHEN 'van' THEN n_van WHEN 'truck' THEN n_truck WHEN 'bus' THEN n_bus ELSE n_50 END AS fits FROM near),
mo AS (SELECT report_id, any_value(nearest) AS track_id, any_value(motion) AS motion, any_value(still_for_min) AS still_for_min, arg_min({'e': x.e_m, 'n': x.n_m, 't': x.t_s, 'f': fix_no}, {'d': abs(x.t_s - n.t_s - 0), 't': x.t_s, 'f': fix_no}) FILTER (WHERE abs(x.t_s - n.t_s - 0) <= 300) AS at0, arg_min({'e': x.e_m, 'n': x.n_m, 't': x.t_s, 'f': fix_no}, {'d': abs(x.t_s - n.t_s - -600), 't': x.t_s, 'f': fix_no}) FILTER (WHERE abs(x.t_s - n.t_s - -600) <= 300) AS be0, arg_min({'e': x.e_m, 'n': x.n_m, 't': x.t_s, 'f': fix_no}, {'d': abs(x.t_s - n.t_s - 600), 't': x.t_s, 'f': fix_no}) FILTER (WHERE abs(x.t_s - n.t_s - 600) <= 300) AS af0 FROM near n JOIN fixes x ON x.track_id = nearest WHERE motion IS NOT NULL GROUP BY report_id),
sd AS (SELECT report_id, max(at0.t - t_s) / 60 AS still_min FROM (SELECT report_id, at0, x.t_s, max(CASE WHEN sqrt((x.e_m - at0.e) ** 2 + (x.n_m - at0.n) ** 2) > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY report_id ORDER BY x.t_s DESC, fix_no DESC) AS gone FROM mo JOIN fixes x USING (track_id) WHERE x.t_s <= at0.t) WHERE gone = 0 GROUP BY report_id),
md AS (SELECT *, sqrt((af.e - be.e) ** 2 + (af.n - be.n) ** 2) AS moved, sqrt(be.e ** 2 + be.n ** 2) - sqrt(af.e ** 2 + af.n ** 2) AS closed FROM (SELECT *, coalesce(be0, at0) AS be, coalesce(af0, at0) AS af FROM mo LEFT JOIN sd USING (report_id))),
mr AS (SELECT report_id, CASE WHEN at0 IS NULL THEN 'untestable' WHEN CASE WHEN motion = 'stopped' AND still_for_min > 0 THEN coalesce(still_min, 0) >= still_for_min WHEN motion = 'stopped' THEN moved <= 25 WHEN motion = 'moving' THEN moved > 25 WHEN motion = 'toward_base' THEN closed > 25 ELSE -closed > 25 END THEN 'pass' ELSE 'fail' END AS motion_result FROM md),
checks AS (SELECT *, CASE WHEN kind = 'density' THEN CASE WHEN n_150 > coalesce(usual_count, 0) THEN 'density=pass' ELSE 'density=fail' END ELSE concat_ws(',', CASE WHEN tracks IS NULL AND n_50 = 0 THEN 'presence=fail' END, CASE WHEN typed AND n_50 = 0 THEN 'type=untestable' WHEN typed AND fits > 0 THEN 'type=pass' WHEN typed THEN 'type=fail' END, CASE WHEN NOT (typed AND n_50 = 0) AND count > 1 THEN CASE WHEN fits >= count THEN 'count=pass' ELSE 'count=fail' END END, 'motion=' || motion_result, CASE WHEN friendly THEN 'identity=untestable' END) END AS checks FROM fit LEFT JOIN mr USING (report_id)),
verdicts AS (SELECT *, CASE WHEN kind IN ('irrelevant', 'area_wide', 'unverified', 'degraded_coverage') THEN 'context' WHEN contains(checks, '=fail') THEN 'contradicted' WHEN contains(checks, '=pass') THEN 'verified' ELSE 'unverifiable' END AS verdict FROM checks)
"""


def near(spark: SparkSession, sf: str, motion: bool = False) -> DataFrame:
    """Located reports with what is around; with motion, also their checks and verdict."""
    located = written(parsed(spark, sf).filter("lat IS NOT NULL"), "located")  # read by several joins
    rows = rep.around(located, scene_detections(spark, sf), scene_tracks(spark, sf))
    if not motion:
        return rows
    claims = rows.filter("motion IS NOT NULL AND tracks IS NOT NULL").select("report_id", F.get("tracks", F.lit(0)).alias("track_id"), "t_s", "motion", "still_for_min")
    rows = rows.join(rep.motion_results(claims, fixes(spark, sf)).select("report_id", "motion_result"), "report_id", "left")
    rows = rows.withColumn("checks", rep.located_checks())
    return rows.withColumn("verdict", rep.verdict(F.col("checks"), F.col("kind")))


@query(_NEAR + "SELECT report_id, n_150, n_50, n_truck FROM near")
def rpt_presence(spark: SparkSession, sf: str) -> DataFrame:
    return near(spark, sf).select("report_id", "n_150", "n_50", "n_truck")


@query(_NEAR + "SELECT report_id, tracks FROM near")
def join_report_track(spark: SparkSession, sf: str) -> DataFrame:
    return near(spark, sf).select("report_id", F.array_join(F.transform("tracks", lambda t: t.cast("string")), ",").alias("tracks"))


@query(_NEAR + "SELECT report_id, checks FROM checks")
def rpt_typecount(spark: SparkSession, sf: str) -> DataFrame:
    return near(spark, sf, motion=True).select("report_id", F.array_join(F.transform("checks", lambda c: F.concat(c["claim"], F.lit("="), c["result"])), ",").alias("checks"))


@query(_NEAR + "SELECT report_id, n_150 > coalesce(usual_count, 0) AS dense FROM near WHERE kind = 'density'")
def rpt_density(spark: SparkSession, sf: str) -> DataFrame:
    return near(spark, sf).filter("kind = 'density'").select("report_id", (F.col("n_150") > F.coalesce("usual_count", F.lit(0))).alias("dense"))


@query(_NEAR + "SELECT report_id, verdict, CASE verdict WHEN 'verified' THEN 'agrees' WHEN 'contradicted' THEN 'contradicts' WHEN 'unverifiable' THEN 'unrelated' END AS consistency FROM verdicts")
def rpt_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return near(spark, sf, motion=True).select("report_id", "verdict", rep.consistency(F.col("verdict")).alias("consistency"))


@query(_NEAR + "SELECT report_id, CASE WHEN verdict = 'context' THEN NULL WHEN friendly THEN CASE WHEN verdict = 'contradicted' THEN 'friendly_claim_contradicted' ELSE 'friendly_claim_unconfirmed' END WHEN verdict = 'contradicted' THEN 'report_contradicted' WHEN verdict = 'unverifiable' THEN 'unverified_recheck' END AS scenario FROM verdicts")
def rpt_scenario(spark: SparkSession, sf: str) -> DataFrame:
    return near(spark, sf, motion=True).select("report_id", rep.scenario(F.col("verdict"), F.col("friendly")).alias("scenario"))


@query(_NEAR + "SELECT verdict, CASE verdict WHEN 'verified' THEN 'supports' WHEN 'contradicted' THEN 'ask_human' WHEN 'context' THEN 'background' ELSE 'do_not_rely' END AS trust, count(*) AS reports FROM verdicts GROUP BY verdict")
def ev_trust(spark: SparkSession, sf: str) -> DataFrame:
    return near(spark, sf, motion=True).groupBy("verdict").agg(F.count("*").alias("reports")).select("verdict", rep.trust(F.col("verdict")).alias("trust"), "reports")


@query(with_("dets", "judged") + _PARSED.removeprefix("WITH RECURSIVE").join([", ", ""]) + """, d AS (SELECT image_id, count(*) AS n_seen, count(*) FILTER (WHERE cls IN ('truck', 'bus')) AS n_heavy FROM dets GROUP BY image_id), al AS (SELECT image_id, count(*) AS n_alarming FROM judged JOIN scene USING (track_id) WHERE level = 'ALERT' GROUP BY image_id)
SELECT report_id, CASE WHEN kind = 'negative_claim' THEN CASE WHEN coalesce(n_seen, 0) = 0 THEN 'heavy_absent=untestable' WHEN n_heavy = 0 THEN 'heavy_absent=pass' ELSE 'heavy_absent=fail' END WHEN kind = 'zone_status' THEN CASE WHEN n_alarming > 0 THEN 'calm=fail' WHEN n_seen > 0 THEN 'calm=pass' ELSE 'calm=untestable' END ELSE 'location=untestable' END AS checks FROM parsed LEFT JOIN d USING (image_id) LEFT JOIN al USING (image_id) WHERE lat IS NULL AND zone_id IS NOT NULL""")
def rpt_sector(spark: SparkSession, sf: str) -> DataFrame:
    from .tracks import judged

    seen = scene_detections(spark, sf).groupBy("image_id").agg(F.count("*").alias("n_seen"), F.count_if(F.col("cls").isin("truck", "bus")).alias("n_heavy"))
    alarming = judged(spark, sf).filter("level = 'ALERT'").join(scene_tracks(spark, sf).select("track_id", "image_id"), "track_id").groupBy("image_id").agg(F.count("*").alias("n_alarming"))
    rows = parsed(spark, sf).filter("lat IS NULL AND zone_id IS NOT NULL").join(seen, "image_id", "left").join(alarming, "image_id", "left").fillna(0, ["n_seen", "n_heavy", "n_alarming"])
    return rows.select("report_id", F.array_join(F.transform(rep.sector_checks(), lambda c: F.concat(c["claim"], F.lit("="), c["result"])), ",").alias("checks"))


@query(_PARSED + """, f AS (SELECT s_suppkey AS image_id, (s_suppkey % 480) * 6e1 AS capture_s, 'Z' || lpad(CAST(s_suppkey % 25 + 1 AS VARCHAR), 2, '0') AS sector, s_suppkey % 7 * 120e0 - 360 AS e0 FROM supplier)
SELECT f.image_id, report_id FROM parsed p JOIN f ON p.t_s <= capture_s AND p.t_s >= capture_s - 7200 WHERE CASE WHEN lat IS NOT NULL THEN sqrt(greatest(e0 - 60 - e_m, 0, e_m - e0 - 60) ** 2 + greatest(-50 - n_m, 0, n_m - 50) ** 2) <= 150 WHEN zone_id IS NOT NULL THEN zone_id = sector ELSE kind <> 'irrelevant' END""")
def join_report_frame(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    f = table(spark, sf, "supplier").select(k.alias("image_id"), ((k % 480) * 60.0).alias("capture_s"), F.format_string("Z%02d", k % 25 + 1).alias("zone_id"), ((k % 7) * 120.0 - 420).alias("west"), ((k % 7) * 120.0 - 300).alias("east"), F.lit(-50.0).alias("south"), F.lit(50.0).alias("north"))
    return rep.relevant(parsed(spark, sf).drop("image_id").withColumn("located", F.col("lat").isNotNull()), f)


@query(with_("ranked") + f"""SELECT track_id AS report_id, {rs('sqrt((ae - be) ** 2 + (an - bn) ** 2)', 3)} AS moved_m, CASE WHEN CASE track_id % 4 WHEN 0 THEN sqrt((ae - be) ** 2 + (an - bn) ** 2) > 25 WHEN 1 THEN sqrt((ae - be) ** 2 + (an - bn) ** 2) <= 25 WHEN 2 THEN sqrt(be ** 2 + bn ** 2) - sqrt(ae ** 2 + an ** 2) > 25 ELSE sqrt(ae ** 2 + an ** 2) - sqrt(be ** 2 + bn ** 2) > 25 END THEN 'pass' ELSE 'fail' END AS motion_result FROM (SELECT track_id, coalesce(be0, e_m) AS be, coalesce(bn0, n_m) AS bn, e_m AS ae, n_m AS an FROM (SELECT track_id, arg_max(e_m, t_s) AS e_m, arg_max(n_m, t_s) AS n_m, arg_min(e_m, abs(t_s - (t_last - 600))) FILTER (WHERE abs(t_s - (t_last - 600)) <= 300) AS be0, arg_min(n_m, abs(t_s - (t_last - 600))) FILTER (WHERE abs(t_s - (t_last - 600)) <= 300) AS bn0 FROM ranked GROUP BY track_id))""")
def rpt_motion(spark: SparkSession, sf: str) -> DataFrame:
    """A claim about each track's motion, of each kind in turn, filed at its last fix."""
    kinds = F.array(*map(F.lit, ("moving", "stopped", "toward_base", "receding")))
    f = fixes(spark, sf)
    claims = f.groupBy("track_id").agg(F.max("t_s").alias("t_s")).select(F.col("track_id").alias("report_id"), "track_id", "t_s", F.element_at(kinds, (F.col("track_id") % 4 + 1).cast("int")).alias("motion"), F.lit(None).cast("int").alias("still_for_min"))
    return rep.motion_results(claims, f).select("report_id", r("moved_m", 3).alias("moved_m"), "motion_result")


@query("SELECT o_custkey AS report_id, arg_max(consistency, (k, -image_id)) AS consistency, arg_max(image_id, (k, -image_id)) AS image_id FROM (SELECT *, CASE consistency WHEN 'contradicts' THEN 2 WHEN 'agrees' THEN 1 ELSE 0 END AS k FROM (SELECT o_custkey, o_orderkey AS image_id, CASE o_orderstatus WHEN 'F' THEN 'contradicts' WHEN 'O' THEN 'agrees' ELSE 'unrelated' END AS consistency FROM orders)) GROUP BY o_custkey")
def join_verdict_fold(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("image_id"), F.when(s == "F", "contradicts").when(s == "O", "agrees").otherwise("unrelated").alias("consistency"))
    return rep.fold_verdicts(rows)


_PROSE = "concat('Track T', cast(o_custkey AS varchar(12)), ' is ', cast(o_orderkey % 900 AS varchar(12)), '.', cast(o_orderkey % 10 AS varchar(3)), ' m away and closes at ', cast(o_custkey % 60 AS varchar(12)), ' m/s; seen 2 times; see R', cast(o_orderkey % 50 AS varchar(12)), ' at t-30')"


@query(f"SELECT o_orderkey, coalesce(list_aggregate(list_filter(list_transform(regexp_extract_all(regexp_replace({_PROSE}, '\\bt-\\d+|\\b[A-Z]+\\d+', '', 'g'), '\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE)), lambda x: NOT (x < 4 AND x = floor(x)) AND abs(x - (o_orderkey % 900)) > greatest(0.5e0, 0.05e0 * abs(o_orderkey % 900)))::VARCHAR[], 'string_agg', ','), '') AS drift FROM orders")
def grd_drift(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(_PROSE).alias("prose"), F.array((F.col("o_orderkey") % 900).cast("double")).alias("known"))
    return rows.select("o_orderkey", F.array_join(F.transform(guards.drift(F.col("prose"), F.col("known")), lambda x: x.cast("string")), ",").alias("drift"))


@query(f"SELECT o_orderkey, list_aggregate(list_sort(list_distinct(list_filter(regexp_extract_all({_PROSE}, '\\b[A-Z]\\d+\\b'), lambda x: x <> 'T' || o_custkey))), 'string_agg', ',') AS wrong FROM orders")
def grd_citations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", guards.cited(F.expr(_PROSE)).alias("cited"), F.array(F.concat(F.lit("T"), F.col("o_custkey").cast("string"))).alias("allowed"))
    return rows.select("o_orderkey", F.array_join(guards.not_citable(F.col("cited"), F.col("allowed")), ",").alias("wrong"))


@query("SELECT o_orderkey, ['CLEAR', 'WATCH', 'ALERT'][greatest(o_orderkey % 3, o_custkey % 3) + 1] AS level, CASE WHEN o_custkey % 3 < o_orderkey % 3 THEN 'dissent' END AS dissent FROM orders")
def grd_floor(spark: SparkSession, sf: str) -> DataFrame:
    lv = lambda c: F.element_at(F.array(F.lit("CLEAR"), F.lit("WATCH"), F.lit("ALERT")), (F.col(c) % 3 + 1).cast("int"))
    rows = table(spark, sf, "orders").select("o_orderkey", lv("o_orderkey").alias("base"), lv("o_custkey").alias("agent"))
    level, dissent = guards.floor_level(F.col("base"), F.col("agent"), F.lit("dissent"))
    return rows.select("o_orderkey", level.alias("level"), dissent.alias("dissent"))


@query("SELECT conv_id, turn, replace(replace(text, '<<<', '< < <'), '>>>', '> > >') AS safe FROM conversations")
def grd_datablock(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", guards.escaped(F.col("text")).alias("safe"))


@query("SELECT o_custkey, count(*) AS times FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def grd_dupes(spark: SparkSession, sf: str) -> DataFrame:
    return guards.repeated(table(spark, sf, "orders"), "o_custkey")


@query("SELECT e_key, cost, total, total > 1e6 AS soft, total > 5e6 AS hard FROM (SELECT o_orderkey AS e_key, round(o_totalprice, 2) AS cost, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) / 1e2 AS total FROM orders)")
def ag_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("e_key"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("purpose"), F.col("o_totalprice").alias("cost"))
    return guards.ledger(rows, soft=1e6, hard=5e6).select("e_key", F.round("cost", 2).alias("cost"), "total", "soft", "hard")


@query("SELECT CAST(o_orderdate AS VARCHAR) AS day, strftime(o_orderdate + INTERVAL 3 HOUR, '%H:%M') AS local, count(*) AS n FROM orders GROUP BY ALL")
def tim_render(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf, "orders").select(F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("day"), F.date_format(F.from_utc_timestamp(at, "Etc/GMT-3"), "HH:mm").alias("local"))
    return rows.groupBy("day", "local").agg(F.count("*").alias("n"))


@query("SELECT s, regexp_matches(s, '^(?:[01]\\d|2[0-3]):[0-5]\\d$') AS valid, CASE WHEN regexp_matches(s, '^(?:[01]\\d|2[0-3]):[0-5]\\d$') THEN CAST(s[1:2] AS INTEGER) * 60 + CAST(s[4:5] AS INTEGER) END AS minute FROM (SELECT DISTINCT CAST(o_orderkey % 27 AS VARCHAR) || ':' || lpad(CAST(o_custkey % 63 AS VARCHAR), 2, '0') AS s FROM orders)")
def tim_hhmm(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.concat((F.col("o_orderkey") % 27).cast("string"), F.lit(":"), F.lpad((F.col("o_custkey") % 63).cast("string"), 2, "0")).alias("s")).distinct()
    return rows.select("s", guards.is_hhmm(F.col("s")).alias("valid"), guards.minute_of(F.col("s")).alias("minute"))


@query(with_("fixes") + "SELECT unnest(generate_series(CAST(floor(min(t_s) / 60) AS BIGINT), CAST(floor(max(t_s) / 60) AS BIGINT))) AS tick_min FROM fixes")
def tim_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Every minute of the record, from that of the first fix to that of the last."""
    minute = lambda c: F.floor(c / 60)
    return fixes(spark, sf).agg(minute(F.min("t_s")).alias("a"), minute(F.max("t_s")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("tick_min"))


@query(with_("fixes") + "SELECT count(*) AS n FROM fixes WHERE t_s BETWEEN 9000 - 600 AND 9000 + 600")
def tim_window(spark: SparkSession, sf: str) -> DataFrame:
    return fixes(spark, sf).filter(F.col("t_s").between(9000 - 600, 9000 + 600)).agg(F.count("*").alias("n"))


@query(with_("fixes") + f"SELECT fix_no, {rs('t_s / 60', 2)} AS minutes FROM fixes")
def tim_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return fixes(spark, sf).select("fix_no", r(F.col("t_s") / 60, 2).alias("minutes"))


@query(_NEAR + "SELECT report_id, 'CLEAR' AS cap FROM verdicts")
def rpt_cap(spark: SparkSession, sf: str) -> DataFrame:
    return near(spark, sf, motion=True).select("report_id", rep.cap(F.col("verdict")).alias("cap"))


@query(_NEAR + "SELECT CAST(t AS BIGINT) AS track_id, 'WATCH' AS cap, min(report_id) AS report_id FROM (SELECT report_id, unnest(string_split(tracks, ',')) AS t FROM verdicts WHERE verdict = 'verified' AND tracks IS NOT NULL) GROUP BY t")
def rul_support(spark: SparkSession, sf: str) -> DataFrame:
    """Under a policy that lets verified reports put a vehicle on watch."""
    return rep.support(near(spark, sf, motion=True).select("report_id", "tracks", rep.cap(F.col("verdict"), "WATCH").alias("cap")))
