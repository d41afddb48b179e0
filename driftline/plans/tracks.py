"""Queries on trajectories, proximity and rules, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import geo
from driftline.operators import behaviour as beh
from driftline.operators import kinematics as kin
from driftline.operators import proximity as prox
from driftline.operators import rules

from .registry import query
from .relations import fixes, r, rs, with_, zones

STILL_M = 1500.0

_SLICE = ["range_m", "ve", "vn", "t_cpa_s", "cpa_m", "eta_s"]


@query(with_("based") + f"SELECT track_id, ring, {', '.join(f'{rs(c, 3)} AS {c}' for c in _SLICE)} FROM based")
def kin_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: state, ring and approach to the base of every track."""
    f = fixes(spark, sf)
    return prox.base_assessment(kin.state(f), f).select("track_id", "ring", *(r(c, 3).alias(c) for c in _SLICE))


@query(with_("ranked") + f"SELECT track_id, fix_no, usable, {rs('speed')} AS speed FROM ranked")
def kin_outlier(spark: SparkSession, sf: str) -> DataFrame:
    return kin.outliers(fixes(spark, sf)).select("track_id", "fix_no", "usable", r("speed").alias("speed"))


@query(with_("states") + f"SELECT track_id, {rs('fit_e')} AS ve, {rs('fit_n')} AS vn FROM states")
def kin_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return kin.velocity(fixes(spark, sf)).select("track_id", r("ve").alias("ve"), r("vn").alias("vn"))


@query(with_("states") + "SELECT track_id, stationary FROM states")
def kin_stationary(spark: SparkSession, sf: str) -> DataFrame:
    return kin.state(fixes(spark, sf)).select("track_id", "stationary")


_HEADING = "CASE WHEN speed > 0 THEN ((degrees(atan2(ve, vn)) % 360) + 360) % 360 WHEN e_m = e2 AND n_m = n2 THEN 0 ELSE ((degrees(atan2(e_m - e2, n_m - n2)) % 360) + 360) % 360 END"


@query(with_("states") + f"SELECT track_id, {rs(_HEADING, 3)} AS heading FROM states")
def kin_heading(spark: SparkSession, sf: str) -> DataFrame:
    return kin.state(fixes(spark, sf)).select("track_id", r("heading", 3).alias("heading"))


_STATE = ["e_m", "n_m", "range_m", "ve", "vn", "speed", "range_60", "range_30"]


@query(with_("states") + f"SELECT track_id, n_fixes, stationary, outlier_steps, {', '.join(f'{rs(c, 3)} AS {c}' for c in _STATE)} FROM (SELECT *, CASE WHEN t_s - 3600 - t60 <= 600 THEN r60 END AS range_60, CASE WHEN t_s - 1800 - t30 <= 600 THEN r30 END AS range_30 FROM states)")
def kin_state(spark: SparkSession, sf: str) -> DataFrame:
    return kin.state(fixes(spark, sf)).select("track_id", "n_fixes", "stationary", "outlier_steps", *(r(c, 3).alias(c) for c in _STATE))


@query(with_("ranked") + "SELECT track_id, string_agg(CAST(fix_no AS VARCHAR), ',' ORDER BY back DESC) AS fixes FROM ranked WHERE back <= 4 GROUP BY track_id")
def kin_recent(spark: SparkSession, sf: str) -> DataFrame:
    last = kin.recent(fixes(spark, sf)).groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct(-F.col("back"), "fix_no"))).alias("f"))
    return last.select("track_id", F.array_join(F.transform("f", lambda x: x["fix_no"].cast("string")), ",").alias("fixes"))


_PROFILE = ["total_m", "net_m", "speed_mean", "speed_max", "speed_p95", "speed_std", "accel_max", "moving_fraction", "longest_stop_min", "straightness", "heading_change", "range_start", "range_min", "closing_rate", "closing_fraction"]
_PROFILE_SQL = with_("numbered") + """, g AS (SELECT *, coalesce(dt > 0, false) AS good, coalesce(dt > 0 AND speed > 0.5e0, false) AS moving, range_m - lag(range_m) OVER w AS d_range, min(t_s) OVER (PARTITION BY track_id) AS t0 FROM numbered WINDOW w AS (PARTITION BY track_id ORDER BY i)),
ac AS (SELECT track_id, max(abs((speed - was) / dt)) AS accel_max FROM (SELECT *, lag(speed) OVER (PARTITION BY track_id ORDER BY i) AS was FROM g WHERE good) GROUP BY track_id),
tu AS (SELECT track_id, sum(turn) AS heading_change, count(*) FILTER (WHERE turn > 120) AS reversals FROM (SELECT track_id, abs((((h - lag(h) OVER (PARTITION BY track_id ORDER BY i) + 180) % 360) + 360) % 360 - 180) AS turn FROM (SELECT *, degrees(atan2(de, dn)) AS h FROM g WHERE moving)) GROUP BY track_id),
ru AS (SELECT track_id, count(*) AS stop_count, max(len) AS longest FROM (SELECT track_id, run, count(*) AS len FROM (SELECT *, sum(CASE WHEN moving THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY i) AS run FROM g) WHERE good AND NOT moving GROUP BY track_id, run) GROUP BY track_id),
m AS (SELECT track_id, count(*) AS n_fixes, count(*) FILTER (WHERE good) AS n_steps, sum(step_m) FILTER (WHERE good) AS total_m, sqrt((arg_max(e_m, i) - arg_min(e_m, i)) ** 2 + (arg_max(n_m, i) - arg_min(n_m, i)) ** 2) AS net_m, avg(speed) FILTER (WHERE good) AS speed_mean, max(speed) FILTER (WHERE good) AS speed_max, quantile_cont(speed, 0.95) FILTER (WHERE good) AS speed_p95, stddev_pop(speed) FILTER (WHERE good) AS speed_std,
 avg(CASE WHEN moving THEN 1e0 ELSE 0 END) FILTER (WHERE good) AS moving_fraction, median(dt) FILTER (WHERE good) AS step_s, arg_min(range_m, i) AS range_start, min(range_m) AS range_min, -coalesce(regr_slope(range_m, t_s - t0) FILTER (WHERE good), 0) AS closing_rate, avg(CASE WHEN d_range < 0 THEN 1e0 ELSE 0 END) FILTER (WHERE good) AS closing_fraction FROM g GROUP BY track_id),
p AS (SELECT m.*, coalesce(stop_count, 0) AS stop_count, coalesce(longest, 0) * step_s / 60 AS longest_stop_min, CASE WHEN total_m > 0 THEN net_m / total_m ELSE 0 END AS straightness, coalesce(heading_change, 0) AS heading_change, coalesce(reversals, 0) AS reversals, coalesce(accel_max, 0) AS accel_max FROM m LEFT JOIN ac USING (track_id) LEFT JOIN tu USING (track_id) LEFT JOIN ru USING (track_id) WHERE n_fixes >= 3 AND n_steps >= 2)
"""


@query(_PROFILE_SQL + f"SELECT track_id, n_steps, stop_count, reversals, {', '.join(f'{rs(c, 3)} AS {c}' for c in _PROFILE)} FROM p")
def kin_profile(spark: SparkSession, sf: str) -> DataFrame:
    return kin.profile(fixes(spark, sf)).select("track_id", "n_steps", "stop_count", "reversals", *(r(c, 3).alias(c) for c in _PROFILE))


@query(_PROFILE_SQL + """SELECT track_id, concat_ws(',', CASE WHEN moving_fraction <= 0.15e0 AND longest_stop_min >= 60 AND speed_mean > 0 AND speed_max >= 6 * speed_mean THEN 'waited_then_moved' END, CASE WHEN closing_fraction >= 0.67e0 AND closing_rate >= 0.6e0 THEN 'sustained_approach_to_base' END, CASE WHEN reversals >= 3 THEN 'doubled_back' END, CASE WHEN straightness >= 0.9e0 AND moving_fraction >= 0.33e0 THEN 'direct_run' END) AS flags FROM p""")
def kin_flags(spark: SparkSession, sf: str) -> DataFrame:
    return kin.profile(fixes(spark, sf)).select("track_id", F.array_join(kin.flags(), ",").alias("flags"))


_DIST = ["v_min", "v_max", "v_mean", "v_std", "v_p25", "v_p50", "v_p75", "v_p95"]


@query(with_("steps") + f"""SELECT track_id, count(*) AS n, {', '.join(f'{rs(x)} AS {c}' for c, x in zip(_DIST, ('min(v)', 'max(v)', 'avg(v)', 'stddev_pop(v)', 'quantile_cont(v, 0.25)', 'quantile_cont(v, 0.5)', 'quantile_cont(v, 0.75)', 'quantile_cont(v, 0.95)'), strict=True))},
{', '.join(f'count(*) FILTER (WHERE bin = {b}) AS bin{b}' for b in range(10))} FROM (SELECT *, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 10), 9) ELSE 0 END AS bin FROM (SELECT *, min(v) OVER (PARTITION BY track_id) AS lo, max(v) OVER (PARTITION BY track_id) AS hi FROM (SELECT track_id, step_m / 300 AS v FROM steps WHERE dt IS NOT NULL))) GROUP BY track_id""")
def traj_dist(spark: SparkSession, sf: str) -> DataFrame:
    return kin.distribution(fixes(spark, sf)).select("track_id", "n", *(r(c).alias(c) for c in _DIST), *(f"bin{b}" for b in range(10)))


@query(with_("closing") + f"SELECT track_id, {rs('closing_30', 3)} AS closing_30, {rs('closing_60', 3)} AS closing_60, {rs('closing_120', 3)} AS closing_120 FROM closing")
def beh_closing(spark: SparkSession, sf: str) -> DataFrame:
    return beh.approach(fixes(spark, sf)).select("track_id", *(r(f"closing_{m}", 3).alias(f"closing_{m}") for m in (30, 60, 120)))


@query(with_("closing") + f"SELECT track_id, {rs('heading_cos', 6)} AS heading_cos FROM closing")
def beh_heading(spark: SparkSession, sf: str) -> DataFrame:
    return beh.approach(fixes(spark, sf)).select("track_id", r("heading_cos", 6).alias("heading_cos"))


@query(with_("closest") + f"SELECT track_id, {rs('closest_m', 3)} AS closest_m, {rs('closest_min_ago', 3)} AS closest_min_ago FROM closest")
def beh_closest(spark: SparkSession, sf: str) -> DataFrame:
    return beh.closest(fixes(spark, sf)).select("track_id", r("closest_m", 3).alias("closest_m"), r("closest_min_ago", 3).alias("closest_min_ago"))


@query(with_("closest") + f"SELECT track_id, {rs('came_in_from_m', 3)} AS came_in_from_m FROM closest")
def beh_camein(spark: SparkSession, sf: str) -> DataFrame:
    return beh.closest(fixes(spark, sf)).select("track_id", r("came_in_from_m", 3).alias("came_in_from_m"))


@query(with_("sweeps") + f"SELECT track_id, {rs('sweep_deg', 3)} AS sweep_deg FROM sweeps")
def beh_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return beh.sweep(fixes(spark, sf)).select("track_id", r("sweep_deg", 3).alias("sweep_deg"))


@query(with_("closest") + f"SELECT track_id, {rs('range_spread', 5)} AS range_spread, {rs('record_min', 3)} AS record_min FROM closest")
def beh_spread(spark: SparkSession, sf: str) -> DataFrame:
    return beh.closest(fixes(spark, sf)).select("track_id", r("range_spread", 5).alias("range_spread"), r("record_min", 3).alias("record_min"))


@query(with_("spells") + f"SELECT track_id, {rs('start_s', 3)} AS start_s, {rs('end_s', 3)} AS end_s, {rs('range_m', 3)} AS range_m FROM spells")
def beh_stops(spark: SparkSession, sf: str) -> DataFrame:
    return beh.stop_spells(fixes(spark, sf), STILL_M).select("track_id", *(r(c, 3).alias(c) for c in ("start_s", "end_s", "range_m")))


@query(with_("loiters") + f"SELECT track_id, stop_spells, {rs('loiter_min', 3)} AS loiter_min FROM loiters")
def beh_loiter(spark: SparkSession, sf: str) -> DataFrame:
    return beh.loiter(beh.stop_spells(fixes(spark, sf), STILL_M), 3000.0).select("track_id", "stop_spells", r("loiter_min", 3).alias("loiter_min"))


_BEH = ["range_m", "closest_m", "closest_min_ago", "came_in_from_m", "range_spread", "closing_30", "closing_60", "closing_120", "heading_cos", "sweep_deg", "loiter_min"]


@query(with_("closest", "closing", "sweeps", "loiters") + f"SELECT track_id, coalesce(stop_spells, 0) AS stop_spells, {', '.join(f'{rs(c, 3)} AS {c}' for c in _BEH)} FROM (SELECT closest.*, closing_30, closing_60, closing_120, heading_cos, sweep_deg, stop_spells, coalesce(loiter_min, 0) AS loiter_min FROM closest JOIN closing USING (track_id) JOIN sweeps USING (track_id) LEFT JOIN loiters USING (track_id))")
def beh_profile(spark: SparkSession, sf: str) -> DataFrame:
    return beh.profile(fixes(spark, sf), still_m=STILL_M).select("track_id", "stop_spells", *(r(c, 3).alias(c) for c in _BEH))


def _targets(spark: SparkSession, sf: str, seconds: float) -> DataFrame:
    return fixes(spark, sf).groupBy("track_id").agg(F.max("t_s").alias("t")).select("track_id", F.lit(0).alias("key"), (F.col("t") - seconds).alias("target_s"))


def _backward(seconds: int, tolerance: int) -> str:
    return with_("ranked") + f"SELECT track_id, CASE WHEN t_last - {seconds} - t <= {tolerance} THEN fix END AS fix_no FROM (SELECT track_id, min(t_last) AS t_last, max(t_s) FILTER (WHERE t_s <= t_last - {seconds}) AS t, arg_max(fix_no, t_s) FILTER (WHERE t_s <= t_last - {seconds}) AS fix FROM ranked GROUP BY track_id)"


@query(_backward(1800, 600))
def join_asof_back10(spark: SparkSession, sf: str) -> DataFrame:
    return beh.as_of_join(_targets(spark, sf, 1800), fixes(spark, sf), 600).select("track_id", F.col("fix.fix_no").alias("fix_no"))


@query(_backward(3600, 300))
def join_asof_back5(spark: SparkSession, sf: str) -> DataFrame:
    return beh.as_of_join(_targets(spark, sf, 3600), fixes(spark, sf), 300).select("track_id", F.col("fix.fix_no").alias("fix_no"))


@query(with_("ranked") + "SELECT track_id, CASE WHEN gap <= 300 THEN fix END AS fix_no FROM (SELECT track_id, min(abs(t_s - (t_last - 3600))) AS gap, arg_min(fix_no, abs(t_s - (t_last - 3600))) AS fix FROM ranked GROUP BY track_id)")
def join_asof_fix(spark: SparkSession, sf: str) -> DataFrame:
    return beh.as_of_join(_targets(spark, sf, 3600), fixes(spark, sf), 300, nearest=True).select("track_id", F.col("fix.fix_no").alias("fix_no"))


_ZONED = ["dist_m", "t_cpa_s", "cpa_m", "eta_s", "closing_mps", "conf"]


@query(with_("zoned") + f"SELECT track_id, zone_id, inside, in_buffer, {', '.join(f'{rs(c, 3)} AS {c}' for c in _ZONED)} FROM zoned")
def zon_assess(spark: SparkSession, sf: str) -> DataFrame:
    f = fixes(spark, sf)
    return prox.assess(kin.state(f), f, zones(spark, sf)).select("track_id", "zone_id", "inside", "in_buffer", *(r(c, 3).alias(c) for c in _ZONED))


@query(with_("zoned") + f"SELECT track_id, zone_id, {rs('eta_s', 3)} AS eta_s FROM zoned")
def zon_eta(spark: SparkSession, sf: str) -> DataFrame:
    rows = prox.with_zones(kin.state(fixes(spark, sf)), zones(spark, sf))
    return rows.select("track_id", "zone_id", r(prox.eta(F.col("e_m") - F.col("zone_e"), F.col("n_m") - F.col("zone_n"), F.col("ve"), F.col("vn"), F.col("radius_m")), 3).alias("eta_s"))


@query(with_("zoned") + f"SELECT track_id, zone_id, {rs('conf', 5)} AS conf FROM zoned")
def zon_conf(spark: SparkSession, sf: str) -> DataFrame:
    f = fixes(spark, sf)
    return prox.assess(kin.state(f), f, zones(spark, sf)).select("track_id", "zone_id", r("conf", 5).alias("conf"))


@query(with_("zoned") + "SELECT track_id, zone_id, k AS closing_steps FROM zoned")
def zon_kdec(spark: SparkSession, sf: str) -> DataFrame:
    return prox.closing_steps(fixes(spark, sf), zones(spark, sf)).select("track_id", "zone_id", F.col("closing_steps").cast("long").alias("closing_steps"))


@query(with_("zoned") + "SELECT track_id, arg_min(zone_id, (eta_s, zone_no)) AS zone_id FROM zoned WHERE conf >= 0.5e0 AND eta_s BETWEEN 0 AND 1800 GROUP BY track_id")
def zon_dest(spark: SparkSession, sf: str) -> DataFrame:
    f = fixes(spark, sf)
    return prox.destination(prox.assess(kin.state(f), f, zones(spark, sf)))


@query(with_("based") + f"SELECT track_id, inside, in_buffer, {rs('conf', 5)} AS conf, {rs('closing_mps', 4)} AS closing_mps FROM based")
def zon_base(spark: SparkSession, sf: str) -> DataFrame:
    f = fixes(spark, sf)
    return prox.base_assessment(kin.state(f), f).select("track_id", "inside", "in_buffer", r("conf", 5).alias("conf"), r("closing_mps").alias("closing_mps"))


@query(with_("based") + "SELECT ring, count(*) AS tracks FROM based GROUP BY ring")
def zon_ring(spark: SparkSession, sf: str) -> DataFrame:
    return kin.state(fixes(spark, sf)).groupBy(prox.ring(F.col("range_m")).alias("ring")).agg(F.count("*").alias("tracks"))


@query(with_("states", "zones") + "SELECT track_id, arg_min(zone_id, (round(least(d, 360 - d), 9), zone_no)) AS zone_id FROM (SELECT track_id, zone_id, zone_no, abs(((degrees(atan2(e_m, n_m)) % 360) + 360) % 360 - ((degrees(atan2(zone_e, zone_n)) % 360) + 360) % 360) AS d FROM states CROSS JOIN zones) GROUP BY track_id")
def join_sector(spark: SparkSession, sf: str) -> DataFrame:
    return prox.sector(kin.state(fixes(spark, sf)), zones(spark, sf))


@query(with_("states", "zones") + f"SELECT track_id, arg_min(zone_id, (d, zone_no)) AS zone_id, {rs('min(d)', 3)} AS dist_m FROM (SELECT track_id, zone_id, zone_no, sqrt((e_m - zone_e) ** 2 + (n_m - zone_n) ** 2) AS d FROM states CROSS JOIN zones) GROUP BY track_id")
def join_nearest_zone(spark: SparkSession, sf: str) -> DataFrame:
    return prox.nearest_zone(kin.state(fixes(spark, sf)), zones(spark, sf)).select("track_id", "zone_id", r("dist_m", 3).alias("dist_m"))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Every track with its verdict; every third one is heavy."""
    f = fixes(spark, sf)
    rows = prox.base_assessment(kin.state(f), f).drop("range_m").join(beh.profile(f, still_m=STILL_M), "track_id").withColumn("heavy", F.col("track_id") % 3 == 0)
    return rules.verdicts(rows).withColumn("priority", rules.priority())


def _family(name: str) -> str:
    return with_("judged") + f"SELECT track_id, coalesce(list_aggregate(list_transform(list_filter(signals, lambda s: s.family = '{name}'), lambda s: s.kind || CASE WHEN s.strong THEN '!' ELSE '' END), 'string_agg', ','), '') AS signals FROM judged"


def _signals(spark: SparkSession, sf: str, family: str) -> DataFrame:
    of = F.filter("signals", lambda s: s["family"] == family)
    return judged(spark, sf).select("track_id", F.array_join(F.transform(of, lambda s: F.concat(s["kind"], F.when(s["strong"], "!").otherwise(""))), ",").alias("signals"))


@query(_family("approach"))
def rul_approach(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf, "approach")


@query(_family("surveillance"))
def rul_surveil(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf, "surveillance")


@query(with_("judged") + "SELECT track_id, level, signals[1].family AS category, coalesce(list_aggregate(list_transform(signals[1:4], lambda s: s.kind), 'string_agg', ','), '') AS reasons FROM judged")
def rul_level(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select("track_id", "level", "category", F.array_join("reasons", ",").alias("reasons"))


@query(with_("judged") + "SELECT CASE level_rank WHEN 2 THEN 'high' WHEN 1 THEN 'possible' END AS likelihood, count(*) AS tracks FROM judged GROUP BY 1")
def rul_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).groupBy("likelihood").agg(F.count("*").alias("tracks"))


@query(with_("judged") + f"SELECT track_id, {rs('priority', 5)} AS priority FROM judged")
def rul_priority(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).select("track_id", r("priority", 5).alias("priority"))


@query("""SELECT track_id, seq, proposed, CAST(level_rank AS INTEGER) AS level_rank FROM (WITH RECURSIVE p AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(CASE WHEN value > 80 THEN 2 WHEN value > 40 THEN 1 ELSE 0 END AS INTEGER) AS proposed FROM events),
h AS (SELECT track_id, seq, proposed, proposed AS level_rank, -1 AS pending, 0 AS n FROM p WHERE seq = 1 UNION ALL
SELECT p.track_id, p.seq, p.proposed, CASE WHEN p.proposed >= h.level_rank OR (CASE WHEN h.pending = p.proposed THEN h.n + 1 ELSE 1 END) >= 2 THEN p.proposed ELSE h.level_rank END, CASE WHEN p.proposed >= h.level_rank OR (CASE WHEN h.pending = p.proposed THEN h.n + 1 ELSE 1 END) >= 2 THEN -1 ELSE p.proposed END, CASE WHEN p.proposed >= h.level_rank OR (CASE WHEN h.pending = p.proposed THEN h.n + 1 ELSE 1 END) >= 2 THEN 0 WHEN h.pending = p.proposed THEN h.n + 1 ELSE 1 END FROM h JOIN p ON p.track_id = h.track_id AND p.seq = h.seq + 1) SELECT * FROM h)""")
def rul_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    events = spark.read.parquet(f"{sf}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rules.hysteresis(events.select(F.col("user_id").alias("track_id"), F.row_number().over(w).alias("seq"), F.when(F.col("value") > 80, 2).when(F.col("value") > 40, 1).otherwise(0).alias("proposed")))


_LINKS = "track_id % 7 = 0 AS verified, track_id % 11 = 0 AS contradicted_friendly, track_id % 5 = 0 AS friendly, track_id % 4 <> 0 AS detected, track_id % 8 IN (1, 2) AS clear_detection"
_FAMILIES = "len(list_distinct(list_transform(signals, lambda s: s.family)))"


@query(with_("judged") + f"""SELECT track_id, {rs("CASE WHEN len(list_filter(signals, lambda s: s.strong)) > 0 THEN 0.3e0 WHEN len(signals) > 0 THEN 0.15e0 ELSE 0 END + CASE WHEN " + _FAMILIES + " > 1 THEN 0.15e0 ELSE 0 END + CASE WHEN clear_detection THEN 0.15e0 WHEN detected THEN 0.08e0 ELSE 0 END + CASE WHEN heavy THEN 0.1e0 ELSE 0 END + CASE WHEN verified THEN 0.15e0 ELSE 0 END + CASE WHEN contradicted_friendly THEN 0.15e0 ELSE 0 END")} AS confidence,
concat_ws(',', CASE WHEN NOT detected THEN 'not_detected' END, CASE WHEN contradicted_friendly THEN 'contradicted_friendly_claim' WHEN friendly THEN 'friendly_claim_unconfirmed_identity' END) AS flags FROM (SELECT *, {_LINKS} FROM judged WHERE level_rank > 0)""")
def rul_threat(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("track_id")
    rows = judged(spark, sf).filter("level_rank > 0").withColumns({"report_verified": k % 7 == 0, "report_contradicted_friendly": k % 11 == 0, "report_friendly": k % 5 == 0, "detected": k % 4 != 0, "clear_detection": (k % 8).isin(1, 2)})
    return rows.select("track_id", r(rules.threat_confidence()).alias("confidence"), F.array_join(rules.threat_flags(), ",").alias("flags"))


@query()
def rul_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = judged(spark, sf)
    terms = rules.priority_terms()
    heavy = F.col("priority") - sum(terms.values(), F.lit(0.0))
    return rows.select("track_id", F.floor(F.col("priority") * 100 + 0.5).alias("score"), F.array_join(rules.breakdown(F.col("priority"), [*terms.values(), heavy]), ",").alias("parts"))


@query(with_("judged") + f"SELECT image_id, CASE max(level_rank) WHEN 2 THEN 'ALERT' WHEN 1 THEN 'WATCH' ELSE 'CLEAR' END AS level, {rs('arg_max(priority, (level_rank, priority))', 5)} AS priority FROM (SELECT track_id % 10 AS image_id, level_rank, priority FROM judged) GROUP BY image_id")
def rul_frame_level(spark: SparkSession, sf: str) -> DataFrame:
    rows = judged(spark, sf).groupBy((F.col("track_id") % 10).alias("image_id")).agg(F.max(F.struct("level_rank", "priority")).alias("x"))
    return rows.select("image_id", rules.level(F.col("x.level_rank")).alias("level"), r("x.priority", 5).alias("priority"))


@query(with_("judged") + "SELECT CASE level WHEN 'ALERT' THEN CASE WHEN floor(priority * 100 + 0.5e0) >= 70 THEN 'critical' ELSE 'high' END WHEN 'WATCH' THEN 'review' ELSE 'low' END AS band, count(*) AS tracks FROM judged GROUP BY 1")
def rul_band(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).groupBy(rules.band(F.col("level"), geo.half_up(F.col("priority"))).alias("band")).agg(F.count("*").alias("tracks"))


@query(with_("judged") + f"""SELECT image_id, alert_id, level_rank, {rs('priority', 5)} AS priority FROM (SELECT track_id % 10 AS image_id, 'A-' || track_id % 10 || '-' || track_id AS alert_id, level_rank, priority FROM judged WHERE level_rank > 0
UNION ALL SELECT track_id % 10, 'A-' || track_id % 10 || '-' || track_id * 2, 1, 0.3e0 FROM judged WHERE track_id % 6 = 0 AND range_m <= 2000 AND track_id % 5 <> 0)""")
def rul_alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = judged(spark, sf).withColumn("image_id", F.col("track_id") % 10)
    lone = rows.filter("track_id % 6 = 0").select("image_id", (F.col("track_id") * 2).alias("det_id"), "range_m", (F.col("track_id") % 5 == 0).alias("duplicate"))
    return rules.alerts(rows, lone).select("image_id", "alert_id", "level_rank", r("priority", 5).alias("priority"))


@query(with_("judged") + "SELECT level, category, count(*) AS tracks FROM (SELECT level, signals[1].family AS category FROM judged) GROUP BY ALL")
def rp_threat(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).groupBy("level", "category").agg(F.count("*").alias("tracks"))
