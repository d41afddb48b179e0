"""Queries of what tracks did up to a clock, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import activity as act
from driftline.operators import behaviour as beh

from .registry import query
from .relations import CTE, fixes, r, rs, with_, zones
from .tracks import STILL_M

#: The clock up to which tracks are told, in seconds.
CLOCK = 15000.0

_ROUTE = f"""SELECT track_id, fix_no, t_s, e_m, n_m FROM logged WHERE t_s <= {CLOCK:.0f} UNION ALL
SELECT track_id, NULL, {CLOCK}e0, e0 + ({CLOCK} - t0) / (t1 - t0) * (e1 - e0), n0 + ({CLOCK} - t0) / (t1 - t0) * (n1 - n0) FROM (SELECT track_id, max(t_s) AS t0, arg_max(e_m, (t_s, fix_no)) AS e0, arg_max(n_m, (t_s, fix_no)) AS n0 FROM logged WHERE t_s <= {CLOCK:.0f} GROUP BY track_id)
JOIN (SELECT track_id, min(t_s) AS t1, arg_min(e_m, (t_s, fix_no)) AS e1, arg_min(n_m, (t_s, fix_no)) AS n1 FROM logged WHERE t_s > {CLOCK:.0f} GROUP BY track_id) USING (track_id) WHERE t0 < {CLOCK:.0f}"""


def _near(ze: str, zn: str) -> str:
    return f"coalesce(least(1, greatest(0, (({ze} - ea) * (e_m - ea) + ({zn} - na) * (n_m - na)) / nullif((e_m - ea) ** 2 + (n_m - na) ** 2, 0))), 0)"


_MOVES = f"dt > 0 AND d > {STILL_M} * dt / 5 AND mps <= 40"
#: The stop spells' SQL over the route, which stands for the fixes there.
_LEGS = with_("spells").replace(f"fixes AS ({CTE['fixes']})", f"logged AS ({CTE['fixes']}),\nfixes AS ({_ROUTE})") + f""", legs AS (SELECT *, d / nullif(dt * 60, 0) AS mps FROM (SELECT *, (t_s - ta) / 60 AS dt, sqrt((e_m - ea) ** 2 + (n_m - na) ** 2) AS d FROM (SELECT *, row_number() OVER w AS leg, coalesce(lag(t_s) OVER w, t_s) AS ta, coalesce(lag(e_m) OVER w, e_m) AS ea, coalesce(lag(n_m) OVER w, n_m) AS na FROM fixes WINDOW w AS (PARTITION BY track_id ORDER BY t_s, fix_no NULLS LAST))) WHERE leg = 1 OR dt > 0),
base_pass AS (SELECT *, sqrt((ea + f * (e_m - ea)) ** 2 + (na + f * (n_m - na)) ** 2) AS near_m, ta / 60 + f * dt AS near_at FROM (SELECT *, {_near('0', '0')} AS f FROM legs)),
whole AS (SELECT *, sqrt((eb - ea) ** 2 + (nb - na) ** 2) AS moved_m, sqrt(ea * ea + na * na) AS start_m, sqrt(eb * eb + nb * nb) AS end_m, sqrt(ea * ea + na * na) - sqrt(eb * eb + nb * nb) AS approach_m FROM (
SELECT track_id, count(fix_no) AS fixes, min(t_s) / 60 AS from_min, max(t_s) / 60 AS to_min, coalesce(sum(d) FILTER (WHERE {_MOVES}), 0) AS distance_m, coalesce(sum(dt) FILTER (WHERE {_MOVES}), 0) AS moving_min, coalesce(max(mps) FILTER (WHERE dt >= 5 - 1e-9 AND mps <= 40 AND mps > 0), 0) AS max_mps, count(*) FILTER (WHERE mps > 40) AS outliers,
min(near_m) AS closest_m, arg_min(near_at, (near_m, leg)) AS closest_min, arg_min(e_m, leg) AS ea, arg_min(n_m, leg) AS na, arg_max(e_m, leg) AS eb, arg_max(n_m, leg) AS nb FROM base_pass GROUP BY track_id)
LEFT JOIN (SELECT track_id, count(*) AS stops0, sum((end_s - start_s) / 60) AS stopped0 FROM spells GROUP BY track_id) USING (track_id) JOIN (SELECT track_id, max(t_s) <= {CLOCK:.0f} AS complete FROM logged GROUP BY track_id) USING (track_id))
"""


def _span(name: str, radius: str) -> str:
    return f"CASE WHEN a = 0 THEN re * re + rn * rn <= ({radius}) ** 2 ELSE b * b - 4 * a * (re * re + rn * rn - ({radius}) ** 2) >= 0 END AS {name}_on, greatest(0, (-b - sqrt(greatest(0, b * b - 4 * a * (re * re + rn * rn - ({radius}) ** 2)))) / nullif(2 * a, 0)) AS {name}_0, least(1, (-b + sqrt(greatest(0, b * b - 4 * a * (re * re + rn * rn - ({radius}) ** 2)))) / nullif(2 * a, 0)) AS {name}_1"


_PASSES = _LEGS + f""", zn AS ({CTE['zones']}), spans AS (SELECT *, sqrt((ea + f * de - zone_e) ** 2 + (na + f * dn - zone_n) ** 2) AS near_m, {_span('o', 'radius_m + buffer_m')}, {_span('i', 'radius_m')} FROM (SELECT *, de * de + dn * dn AS a, 2 * (re * de + rn * dn) AS b FROM (SELECT *, e_m - ea AS de, n_m - na AS dn, ea - zone_e AS re, na - zone_n AS rn, {_near('zone_e', 'zone_n')} AS f FROM legs CROSS JOIN zn))),
passes AS (SELECT track_id, zone_id, zone_no, name, min(near_m) AS closest_m, arg_min(ta / 60 + f * dt, (near_m, leg)) AS closest_min, min(ta / 60 + CASE WHEN a = 0 THEN 0 ELSE o_0 END * dt) FILTER (WHERE o_on AND (a = 0 OR o_1 >= o_0)) AS buffer_min, min(ta / 60 + CASE WHEN a = 0 THEN 0 ELSE i_0 END * dt) FILTER (WHERE i_on AND (a = 0 OR i_1 >= i_0)) AS zone_min, sum(CASE WHEN o_on AND a > 0 AND o_1 >= o_0 THEN (o_1 - o_0) * dt ELSE 0 END) AS inside_min FROM spans GROUP BY ALL)
"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    return act.route(fixes(spark, sf), CLOCK)


_WHOLE = ("from_min", "to_min", "distance_m", "moving_min", "avg_mps", "max_mps", "stopped_min", "start_m", "end_m", "closest_m", "closest_min", "approach_m", "moved_m", "heading")


@query(_LEGS + f"SELECT track_id, complete, fixes, outliers, coalesce(stops0, 0) AS stops, {', '.join(f'{rs(c, 3)} AS {c}' for c in _WHOLE)} FROM (SELECT *, coalesce(stopped0, 0) AS stopped_min, coalesce(distance_m / nullif(moving_min * 60, 0), 0) AS avg_mps, CASE WHEN moved_m > {STILL_M} THEN (degrees(atan2(eb - ea, nb - na)) % 360 + 360) % 360 END AS heading FROM whole)")
def ds_activity(spark: SparkSession, sf: str) -> DataFrame:
    return act.summary(points(spark, sf), STILL_M).select("track_id", "complete", "fixes", "outliers", "stops", *(r(c, 3).alias(c) for c in _WHOLE))


_PASS = ("closest_m", "closest_min", "buffer_min", "zone_min", "inside_min")


@query(_PASSES + f"SELECT track_id, zone_id, {', '.join(f'{rs(c, 3)} AS {c}' for c in _PASS)} FROM passes")
def ds_zonepass(spark: SparkSession, sf: str) -> DataFrame:
    return act.passes(points(spark, sf), zones(spark, sf)).select("track_id", "zone_id", *(r(c, 3).alias(c) for c in _PASS))


_SPLIT = ("from_min", "to_min", "distance_m", "moving_min", "range_delta_m")


@query(_LEGS + f""", parts AS (SELECT *, from_min + 30 * k AS s0, least(from_min + 30 * (k + 1), to_min) AS s1 FROM (SELECT track_id, from_min, to_min, start_m, unnest(generate_series(0, CAST(ceil((to_min - from_min) / 30 - 1e-10) AS BIGINT) - 1)) AS k FROM whole)),
met AS (SELECT p.track_id, k, s0, s1, start_m, sum(CASE WHEN {_MOVES} AND least(t_s / 60, s1) > greatest(ta / 60, s0) THEN d * (least(t_s / 60, s1) - greatest(ta / 60, s0)) / dt ELSE 0 END) AS distance_m, sum(CASE WHEN {_MOVES} AND least(t_s / 60, s1) > greatest(ta / 60, s0) THEN least(t_s / 60, s1) - greatest(ta / 60, s0) ELSE 0 END) AS moving_min,
max(sqrt((ea + (s1 - ta / 60) / dt * (e_m - ea)) ** 2 + (na + (s1 - ta / 60) / dt * (n_m - na)) ** 2)) FILTER (WHERE ta / 60 < s1 AND s1 <= t_s / 60) AS end_m FROM parts p JOIN legs l ON p.track_id = l.track_id AND dt > 0 AND ta / 60 < s1 AND t_s / 60 > s0 GROUP BY ALL)
SELECT track_id, k + 1 AS split, {', '.join(f'{rs(c, 3)} AS {c}' for c in _SPLIT)} FROM (SELECT *, s0 AS from_min, s1 AS to_min, end_m - coalesce(lag(end_m) OVER (PARTITION BY track_id ORDER BY k), start_m) AS range_delta_m FROM met)""")
def ds_splits(spark: SparkSession, sf: str) -> DataFrame:
    return act.splits(points(spark, sf), STILL_M).select("track_id", "split", *(r(c, 3).alias(c) for c in _SPLIT))


@query(_PASSES + f"""SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY minute, rank, p0, p1, inner_) AS seq, kind, {rs('minute', 3)} AS minute FROM (
SELECT track_id, 'start' AS kind, from_min AS minute, 0 AS rank, 0e0 AS p0, 0 AS p1, 0 AS inner_ FROM whole UNION ALL SELECT track_id, 'stop', start_s / 60, 1, 0, 0, 0 FROM spells UNION ALL SELECT track_id, 'buffer', buffer_min, 2, closest_m, zone_no, 0 FROM passes WHERE buffer_min IS NOT NULL UNION ALL SELECT track_id, 'zone', zone_min, 2, closest_m, zone_no, 1 FROM passes WHERE zone_min IS NOT NULL
UNION ALL SELECT track_id, 'closest', closest_min, 3, 0, 0, 0 FROM whole WHERE closest_min - from_min > 5 AND to_min - closest_min > 5 UNION ALL SELECT track_id, 'end', to_min, 4, 0, 0, 0 FROM whole)""")
def ds_events(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return act.events(act.summary(p, STILL_M), beh.stop_spells(p, STILL_M), act.passes(p, zones(spark, sf))).withColumn("minute", r("minute", 3))


@query(_PASSES + f"""SELECT track_id, CASE WHEN zi IS NOT NULL THEN 'zone' WHEN zo IS NOT NULL THEN 'buffer' WHEN parked THEN 'parked' WHEN approach_m >= 500 THEN 'approaching' WHEN approach_m <= -500 THEN 'receding' ELSE 'roaming' END AS kind, coalesce(zi, zo) AS name, {rs("CASE WHEN zi IS NOT NULL THEN i_at WHEN zo IS NOT NULL THEN o_at WHEN parked THEN stopped0 WHEN abs(approach_m) >= 500 THEN abs(approach_m) ELSE distance_m END", 3)} AS value
FROM (SELECT *, to_min - from_min >= 30 AND coalesce(stopped0, 0) >= (to_min - from_min) * 0.7e0 AS parked FROM whole) JOIN (SELECT track_id, arg_min(name, (zone_min, closest_m, zone_no)) FILTER (WHERE zone_min IS NOT NULL) AS zi, min(zone_min) AS i_at, arg_min(name, (buffer_min, closest_m, zone_no)) FILTER (WHERE buffer_min IS NOT NULL) AS zo, min(buffer_min) AS o_at FROM passes GROUP BY track_id) USING (track_id)""")
def ds_headline(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    return act.headline(act.summary(p, STILL_M), act.passes(p, zones(spark, sf))).withColumn("value", r("value", 3))
