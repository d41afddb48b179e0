"""The driver tables read as relations of this domain, once for Spark and once as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.kinematics import backwards

BASE_LAT, BASE_LON = 39.92184, 32.85


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column: Column | str, digits: int = 4) -> Column:
    """Rounded, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def rs(expression: str, digits: int = 4) -> str:
    return f"(round({expression}, {digits}) + 0e0)"


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are tracks and events their fixes; a hundredth of the real time passes."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), F.col("event_id").alias("fix_no"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6 / 100).alias("t_s"),
        ((F.col("value") - 35) * 40).alias("e_m"), ((F.get_json_object("props", "$.k").cast("int") - 50) * 80.0).alias("n_m"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand on a circle around the base."""
    b = F.radians(F.col("n_nationkey") * 14.4)
    return table(spark, sf_dir, "nation").select(F.format_string("Z%02d", F.col("n_nationkey") + 1).alias("zone_id"), F.col("n_nationkey").alias("zone_no"), F.col("n_name").alias("name"), (3200 * F.sin(b)).alias("zone_e"), (3200 * F.cos(b)).alias("zone_n"), F.lit(250.0).alias("radius_m"), F.lit(750.0).alias("buffer_m"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are camera frames; a few are faulty."""
    k = F.col("s_suppkey")
    top = F.lit(39.9) + (k % 50) / 1000.0
    return table(spark, sf_dir, "supplier").select(
        k.alias("image_id"), (960 + 400 * (k % 3)).cast("int").alias("width_px"), (540 + 225 * (k % 3)).cast("int").alias("height_px"),
        top.alias("lat_top"), F.when(k % 37 == 0, top + 0.004).otherwise(top - 0.004).alias("lat_bottom"), (F.lit(32.8) + (k % 90) / 1000.0).alias("lon_left"), (F.lit(32.8) + (k % 90) / 1000.0 + 0.0093 + (k % 11) / 10000.0).alias("lon_right"),
        ((k % 480) * 60.0).alias("capture_s"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are detector boxes of their supplier's frame, on a coarse raster so that many overlap."""
    from pyspark.sql import Window

    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("image_id"), (F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)) - 1).alias("idx"),
        F.element_at(F.array(*map(F.lit, ("car", "van", "truck", "bus"))), (c("l_linenumber") % 4 + 1).cast("int")).alias("cls"), (c("l_discount") * 10).alias("score"),
        ((c("l_partkey") % 40) * 24.0).alias("x"), ((c("l_orderkey") % 30) * 18.0).alias("y"), (20 + c("l_quantity") * 0.5).alias("w"), (20 + c("l_tax") * 200).alias("h"),
    )


def scene_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last positions, drawn close together: fifteen or so tracks to each of ten images per 150 tracks."""
    last = fixes(spark, sf_dir).withColumn("back", F.row_number().over(backwards())).filter("back = 1")
    return last.select((F.col("track_id") % F.lit(10) + (F.col("track_id").cast("double") / 150).cast("long") * 10).alias("image_id"), "track_id", "t_s", (F.col("e_m") / 40).alias("e_m"), (F.col("n_m") / 40).alias("n_m"))


def scene_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection near most of the tracks, a second one near some."""
    t = scene_tracks(spark, sf_dir)
    k = F.col("track_id")
    one = t.filter(k % 6 != 0).select("image_id", (k * 2).alias("det_id"), (F.col("e_m") + (k * 7) % 40).alias("e_m"), (F.col("n_m") + (k * 3) % 11).alias("n_m"), F.when(k % 4 == 0, "truck").otherwise("car").alias("cls"), ((k % 10) / 10.0).alias("score"))
    two = t.filter(k % 5 == 0).select("image_id", (k * 2 + 1).alias("det_id"), (F.col("e_m") + 5).alias("e_m"), (F.col("n_m") + 4).alias("n_m"), F.lit("van").alias("cls"), F.lit(0.9).alias("score"))
    return one.unionByName(two)


#: Named parts of the comparison's SQL, each after those that it uses.
CTE = {
    "fixes": """SELECT user_id AS track_id, event_id AS fix_no, (epoch_us(ts) - 1704067200000000) / 1e6 / 100 AS t_s, (value - 35) * 40 AS e_m, (CAST(json_extract_string(props, '$.k') AS INTEGER) - 50) * 8e1 AS n_m FROM events""",
    "steps": """SELECT *, CASE WHEN dt > 0 THEN step_m / dt END AS speed FROM (SELECT *, sqrt(de * de + dn * dn) AS step_m FROM (SELECT *, t_s - lag(t_s) OVER w AS dt, e_m - lag(e_m) OVER w AS de, n_m - lag(n_m) OVER w AS dn, sqrt(e_m * e_m + n_m * n_m) AS range_m FROM fixes WINDOW w AS (PARTITION BY track_id ORDER BY t_s, fix_no)))""",
    "ranked": """SELECT *, sum(CASE WHEN usable THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t_s DESC, fix_no DESC) AS usable_back FROM (SELECT *, coalesce(speed <= 40, true) AS usable, row_number() OVER (PARTITION BY track_id ORDER BY t_s DESC, fix_no DESC) AS back, max(t_s) OVER (PARTITION BY track_id) AS t_last FROM steps)""",
    "states": """SELECT *, sqrt(ve * ve + vn * vn) AS speed FROM (SELECT *, CASE WHEN stationary THEN 0e0 ELSE fit_e END AS ve, CASE WHEN stationary THEN 0e0 ELSE fit_n END AS vn FROM (SELECT *, coalesce(CASE WHEN n_fixes >= 3 THEN sqrt((e_m - e3) ** 2 + (n_m - n3) ** 2) WHEN n_fixes = 2 THEN sqrt((e_m - e2) ** 2 + (n_m - n2) ** 2) END < 25, false) AS stationary FROM (
SELECT track_id, count(*) AS n_fixes, max(t_s) AS t_s, max(e_m) FILTER (WHERE back = 1) AS e_m, max(n_m) FILTER (WHERE back = 1) AS n_m, max(e_m) FILTER (WHERE back = 2) AS e2, max(n_m) FILTER (WHERE back = 2) AS n2, max(e_m) FILTER (WHERE back = 3) AS e3, max(n_m) FILTER (WHERE back = 3) AS n3,
max(range_m) FILTER (WHERE back = 1) AS range_m, coalesce(regr_slope(e_m, t_s - t_last) FILTER (WHERE usable AND usable_back <= 4), 0) AS fit_e, coalesce(regr_slope(n_m, t_s - t_last) FILTER (WHERE usable AND usable_back <= 4), 0) AS fit_n, count(*) FILTER (WHERE NOT usable) AS outlier_steps,
max(t_s) FILTER (WHERE t_s <= t_last - 3600) AS t60, arg_max(range_m, t_s) FILTER (WHERE t_s <= t_last - 3600) AS r60, max(t_s) FILTER (WHERE t_s <= t_last - 1800) AS t30, arg_max(range_m, t_s) FILTER (WHERE t_s <= t_last - 1800) AS r30 FROM ranked GROUP BY track_id)))""",
    "zones": """SELECT 'Z' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS zone_id, n_nationkey AS zone_no, n_name AS name, 3200 * sin(radians(n_nationkey * 1.44e1)) AS zone_e, 3200 * cos(radians(n_nationkey * 1.44e1)) AS zone_n, 250e0 AS radius_m, 750e0 AS buffer_m FROM nation""",
    "base": """SELECT 'BASE' AS zone_id, 0 AS zone_no, 0e0 AS zone_e, 0e0 AS zone_n, 1000e0 AS radius_m, 1000e0 AS buffer_m""",
    "closest": """SELECT track_id, arg_max(range_m, t_s) AS range_m, min(range_m) AS closest_m, (max(t_s) - min(near_t)) / 60 AS closest_min_ago, max(range_m) FILTER (WHERE t_s < near_t) AS came_in_from_m, (max(range_m) - min(range_m)) / avg(range_m) AS range_spread, (max(t_s) - min(t_s)) / 60 AS record_min FROM (SELECT *, first_value(t_s) OVER (PARTITION BY track_id ORDER BY range_m, t_s) AS near_t FROM steps) GROUP BY track_id""",
    "closing": """SELECT *, CASE WHEN sqrt((e_m - e30) ** 2 + (n_m - n30) ** 2) >= 50 AND r30 > 0 THEN ((e_m - e30) * -e30 + (n_m - n30) * -n30) / (sqrt((e_m - e30) ** 2 + (n_m - n30) ** 2) * r30) END AS heading_cos FROM (
SELECT track_id, arg_max(e_m, t_s) AS e_m, arg_max(n_m, t_s) AS n_m, arg_max(e_m, t_s) FILTER (WHERE t_s BETWEEN t_last - 2100 AND t_last - 1800) AS e30, arg_max(n_m, t_s) FILTER (WHERE t_s BETWEEN t_last - 2100 AND t_last - 1800) AS n30, arg_max(range_m, t_s) FILTER (WHERE t_s BETWEEN t_last - 2100 AND t_last - 1800) AS r30,
arg_max(range_m, t_s) FILTER (WHERE t_s BETWEEN t_last - 2100 AND t_last - 1800) - arg_max(range_m, t_s) AS closing_30, arg_max(range_m, t_s) FILTER (WHERE t_s BETWEEN t_last - 3900 AND t_last - 3600) - arg_max(range_m, t_s) AS closing_60, arg_max(range_m, t_s) FILTER (WHERE t_s BETWEEN t_last - 7500 AND t_last - 7200) - arg_max(range_m, t_s) AS closing_120 FROM ranked GROUP BY track_id)""",
    "sweeps": """SELECT track_id, degrees(max(free) - min(free)) AS sweep_deg FROM (SELECT track_id, theta + sum(CASE WHEN d > pi() + 1e-9 THEN -2 * pi() WHEN d < -pi() - 1e-9 THEN 2 * pi() ELSE 0 END) OVER (PARTITION BY track_id ORDER BY t_s, fix_no) AS free FROM (SELECT *, theta - lag(theta) OVER (PARTITION BY track_id ORDER BY t_s, fix_no) AS d FROM (SELECT *, atan2(e_m, n_m) AS theta FROM fixes))) GROUP BY track_id""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t_s, fix_no) AS i, count(*) OVER (PARTITION BY track_id) AS n FROM steps""",
    "reach": """SELECT a.track_id, a.i, a.t_s, a.range_m, coalesce(min(b.i) FILTER (WHERE sqrt((a.e_m - b.e_m) ** 2 + (a.n_m - b.n_m) ** 2) > 1500), a.n + 1) - 1 AS en FROM numbered a LEFT JOIN numbered b ON a.track_id = b.track_id AND b.i > a.i GROUP BY a.track_id, a.i, a.t_s, a.range_m, a.n""",
    "walk": """SELECT track_id, i, en, t_s, range_m FROM reach WHERE i = 1 UNION ALL SELECT e.track_id, e.i, e.en, e.t_s, e.range_m FROM walk JOIN reach e ON e.track_id = walk.track_id AND e.i = CASE WHEN walk.en - walk.i >= 2 THEN walk.en ELSE walk.i + 1 END""",
    "spells": """SELECT w.track_id, w.t_s AS start_s, f.t_s AS end_s, w.range_m FROM walk w JOIN numbered f ON f.track_id = w.track_id AND f.i = w.en WHERE w.en - w.i >= 2""",
    "loiters": """SELECT track_id, count(*) AS stop_spells, sum(CASE WHEN range_m <= 3000 THEN (end_s - start_s) / 60 ELSE 0 END) AS loiter_min FROM spells GROUP BY track_id""",
    "based": """SELECT *, sqrt((e_m + ve * t_cpa_s) ** 2 + (n_m + vn * t_cpa_s) ** 2) AS cpa_m, range_m <= 1000 AS inside, range_m > 1000 AND range_m <= 2000 AS in_buffer, CASE WHEN range_m <= 1000 THEN 'critical' WHEN range_m <= 2000 THEN 'warning' WHEN range_m <= 3200 THEN 'observation' ELSE 'outside' END AS ring,
CASE WHEN c <= 0 THEN 0 WHEN a > 0 AND b * b - 4 * a * c >= 0 THEN CASE WHEN -b - sqrt(greatest(b * b - 4 * a * c, 0)) > 0 THEN (-b - sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) WHEN -b + sqrt(greatest(b * b - 4 * a * c, 0)) > 0 THEN (-b + sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) END END AS eta_s,
greatest(0, least(1, 0.5e0 * greatest(0, CASE WHEN speed > 0 AND range_m > 0 THEN -(e_m * ve + n_m * vn) / (speed * range_m) ELSE 0 END) + 0.3e0 * (k / 3e0) + 0.2e0 * least(1, speed / 5e0))) AS conf FROM (
SELECT s.*, k, ve * ve + vn * vn AS a, 2 * (e_m * ve + n_m * vn) AS b, e_m * e_m + n_m * n_m - 1e6 AS c, CASE WHEN ve * ve + vn * vn > 0 THEN greatest(0, -(e_m * ve + n_m * vn) / (ve * ve + vn * vn)) ELSE 0 END AS t_cpa_s, CASE WHEN range_m > 0 THEN -(e_m * ve + n_m * vn) / range_m ELSE 0 END AS closing_mps FROM states s JOIN (
SELECT track_id, count(*) FILTER (WHERE range_m < was) AS k FROM (SELECT track_id, range_m, lag(range_m) OVER (PARTITION BY track_id ORDER BY back DESC) AS was FROM ranked WHERE back <= 4) GROUP BY track_id) USING (track_id))""",
    "zoned": """SELECT *, CASE WHEN c <= 0 THEN 0 WHEN a > 0 AND b * b - 4 * a * c >= 0 THEN CASE WHEN -b - sqrt(greatest(b * b - 4 * a * c, 0)) > 0 THEN (-b - sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) WHEN -b + sqrt(greatest(b * b - 4 * a * c, 0)) > 0 THEN (-b + sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) END END AS eta_s,
greatest(0, least(1, 0.5e0 * greatest(0, CASE WHEN speed > 0 AND dist_m > 0 THEN -(re * ve + rn * vn) / (speed * dist_m) ELSE 0 END) + 0.3e0 * (k / 3e0) + 0.2e0 * least(1, speed / 5e0))) AS conf, sqrt((re + ve * t_cpa_s) ** 2 + (rn + vn * t_cpa_s) ** 2) AS cpa_m, dist_m <= radius_m AS inside, dist_m > radius_m AND dist_m <= radius_m + buffer_m AS in_buffer FROM (
SELECT *, sqrt(re * re + rn * rn) AS dist_m, ve * ve + vn * vn AS a, 2 * (re * ve + rn * vn) AS b, re * re + rn * rn - radius_m * radius_m AS c, CASE WHEN ve * ve + vn * vn > 0 THEN greatest(0, -(re * ve + rn * vn) / (ve * ve + vn * vn)) ELSE 0 END AS t_cpa_s, CASE WHEN re * re + rn * rn > 0 THEN -(re * ve + rn * vn) / sqrt(re * re + rn * rn) ELSE 0 END AS closing_mps FROM (
SELECT s.track_id, s.ve, s.vn, s.speed, z.*, e_m - zone_e AS re, n_m - zone_n AS rn, k FROM states s CROSS JOIN zones z JOIN (SELECT track_id, zone_id, count(*) FILTER (WHERE d < was) AS k FROM (SELECT *, lag(d) OVER (PARTITION BY track_id, zone_id ORDER BY back DESC) AS was FROM (SELECT track_id, zone_id, back, sqrt((e_m - zone_e) ** 2 + (n_m - zone_n) ** 2) AS d FROM ranked CROSS JOIN zones WHERE back <= 4)) GROUP BY track_id, zone_id) USING (track_id, zone_id)))""",
    "judged_in": """SELECT b.*, track_id % 3 = 0 AS heavy, closing_60, heading_cos, sweep_deg, range_spread, came_in_from_m, closest_m, coalesce(loiter_min, 0) AS loiter_min FROM based b JOIN closing c USING (track_id) JOIN sweeps USING (track_id) JOIN closest USING (track_id) LEFT JOIN loiters USING (track_id)""".replace("b.*", "b.track_id, b.range_m, b.inside, b.eta_s, b.conf, b.cpa_m, b.t_cpa_s, b.stationary, b.speed"),
    "signalled": """SELECT *, list_filter([
CASE WHEN inside THEN {'kind': 'inside_critical', 'family': 'approach', 'strong': true} END,
CASE WHEN NOT inside AND eta_s <= 600 AND conf >= 0.6e0 THEN {'kind': 'imminent_entry', 'family': 'approach', 'strong': true} END,
CASE WHEN closing_60 >= 1500 AND heading_cos >= 0.7e0 THEN {'kind': 'sustained_approach', 'family': 'approach', 'strong': heavy AND range_m <= 2000} END,
CASE WHEN NOT coalesce(closing_60 >= 1500 AND heading_cos >= 0.7e0, false) AND NOT stationary AND cpa_m <= 2000 AND t_cpa_s > 0 AND t_cpa_s <= 1800 AND conf >= 0.4e0 THEN {'kind': 'closing_path', 'family': 'approach', 'strong': false} END,
CASE WHEN sweep_deg >= 90 AND range_spread <= 0.35e0 AND range_m <= 3200 THEN {'kind': 'circling', 'family': 'surveillance', 'strong': sweep_deg >= 180 AND range_m <= 2000} END,
CASE WHEN came_in_from_m > 1000 AND closest_m <= 1000 AND range_m > 1000 THEN {'kind': 'probe', 'family': 'surveillance', 'strong': false} END,
CASE WHEN loiter_min >= 30 THEN {'kind': 'loiter', 'family': 'surveillance', 'strong': false} END], lambda s: s IS NOT NULL) AS raw FROM judged_in""",
    "judged": """SELECT *, CASE level_rank WHEN 2 THEN 'ALERT' WHEN 1 THEN 'WATCH' ELSE 'CLEAR' END AS level, least(1, greatest(0, (0.5e0 * coalesce(1 - least(1, eta_s / 1800), 0) + 0.3e0 * (1 - least(1, range_m / 3200)) + 0.2e0 * conf) * CASE WHEN heavy THEN 1.25e0 ELSE 1 END)) AS priority FROM (SELECT *, CASE WHEN len(list_filter(raw, lambda s: s.strong)) > 0 OR len(list_distinct(list_transform(raw, lambda s: s.family))) > 1 THEN 2 WHEN len(raw) > 0 THEN 1 ELSE 0 END AS level_rank, list_concat(list_filter(raw, lambda s: s.strong), list_filter(raw, lambda s: NOT s.strong)) AS signals FROM signalled)""",
    "frames": """SELECT s_suppkey AS image_id, CAST(960 + 400 * (s_suppkey % 3) AS INTEGER) AS width_px, CAST(540 + 225 * (s_suppkey % 3) AS INTEGER) AS height_px, 39.9e0 + (s_suppkey % 50) / 1e3 AS lat_top, CASE WHEN s_suppkey % 37 = 0 THEN 39.9e0 + (s_suppkey % 50) / 1e3 + 4e-3 ELSE 39.9e0 + (s_suppkey % 50) / 1e3 - 4e-3 END AS lat_bottom, 32.8e0 + (s_suppkey % 90) / 1e3 AS lon_left, 32.8e0 + (s_suppkey % 90) / 1e3 + 9.3e-3 + (s_suppkey % 11) / 1e4 AS lon_right, (s_suppkey % 480) * 6e1 AS capture_s FROM supplier""",
    "sized": """SELECT *, abs(lon_right - lon_left) * (111412.84e0 * cos(radians(lat_top)) - 93.5e0 * cos(3 * radians(lat_top)) + 0.118e0 * cos(5 * radians(lat_top))) / width_px AS gsd_x, abs(lat_top - lat_bottom) * (111132.92e0 - 559.82e0 * cos(2 * radians(lat_top)) + 1.175e0 * cos(4 * radians(lat_top))) / height_px AS gsd_y FROM frames""",
    "boxes": """SELECT l_suppkey AS image_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS idx, ['car', 'van', 'truck', 'bus'][l_linenumber % 4 + 1] AS cls, l_discount * 10 AS score, (l_partkey % 40) * 24e0 AS x, (l_orderkey % 30) * 18e0 AS y, 20 + l_quantity * 0.5e0 AS w, 20 + l_tax * 200 AS h FROM lineitem""",
    "scene": """SELECT track_id % 10 + CAST(floor(track_id / 150) AS BIGINT) * 10 AS image_id, track_id, t_s, e_m / 40 AS e_m, n_m / 40 AS n_m FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t_s DESC, fix_no DESC) AS back FROM fixes) WHERE back = 1""",
    "dets": """SELECT image_id, track_id * 2 AS det_id, e_m + (track_id * 7) % 40 AS e_m, n_m + (track_id * 3) % 11 AS n_m, CASE WHEN track_id % 4 = 0 THEN 'truck' ELSE 'car' END AS cls, (track_id % 10) / 1e1 AS score FROM scene WHERE track_id % 6 <> 0 UNION ALL SELECT image_id, track_id * 2 + 1, e_m + 5, n_m + 4, 'van', 0.9e0 FROM scene WHERE track_id % 5 = 0""",
}

NEEDS = {
    "steps": ("fixes",), "ranked": ("steps",), "states": ("ranked",), "closest": ("steps",), "closing": ("ranked",), "sweeps": ("fixes",), "numbered": ("steps",), "reach": ("numbered",), "walk": ("reach",), "spells": ("walk",),
    "loiters": ("spells",), "based": ("states",), "zoned": ("states", "zones"), "judged_in": ("based", "closing", "sweeps", "closest", "loiters"), "signalled": ("judged_in",), "judged": ("signalled",), "sized": ("frames",), "scene": ("fixes",), "dets": ("scene",),
}


def with_(*names: str) -> str:
    """WITH and the parts named, after all that they use."""
    seen: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in seen:
            seen.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTE[n]})" for n in seen) + "\n"
