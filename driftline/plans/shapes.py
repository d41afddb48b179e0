"""Queries on lines and rings: a track's fixes in order are the points of one shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.operators import shapes

from .registry import query
from .relations import fixes, r, rs, table, with_


def points(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("track_id").orderBy("t_s", "fix_no")
    return fixes(spark, sf).select(F.col("track_id").alias("shape_id"), F.row_number().over(order).alias("pos"), "e_m", "n_m")


_P = with_("fixes") + ", p AS (SELECT track_id AS shape_id, row_number() OVER (PARTITION BY track_id ORDER BY t_s, fix_no) AS pos, e_m, n_m FROM fixes)\n"
_BOX = "min(e_m) AS west, min(n_m) AS south, max(e_m) AS east, max(n_m) AS north"
_ROUND = ", ".join(f"{rs(c, 3)} AS {c}" for c in ("west", "south", "east", "north"))


@query(_P + f"SELECT points, {_ROUND} FROM (SELECT count(*) AS points, {_BOX} FROM p)")
def osm_area(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.extent(points(spark, sf)).select("points", *(r(c, 3).alias(c) for c in ("west", "south", "east", "north")))


@query(_P + f"""SELECT shape_id, points, {rs('abs(twice) / 2', 2)} AS area_m2, {rs('CASE WHEN abs(twice) < 1e-9 THEN mean_e ELSE moment_e / (3 * twice) END', 2)} AS centre_e, {rs('CASE WHEN abs(twice) < 1e-9 THEN mean_n ELSE moment_n / (3 * twice) END', 2)} AS centre_n FROM (
SELECT a.shape_id, count(*) AS points, avg(a.e_m) AS mean_e, avg(a.n_m) AS mean_n, sum(a.e_m * b.n_m - b.e_m * a.n_m) AS twice, sum((a.e_m + b.e_m) * (a.e_m * b.n_m - b.e_m * a.n_m)) AS moment_e, sum((a.n_m + b.n_m) * (a.e_m * b.n_m - b.e_m * a.n_m)) AS moment_n
FROM p a JOIN (SELECT shape_id, max(pos) AS n FROM p GROUP BY shape_id) m USING (shape_id) JOIN p b ON b.shape_id = a.shape_id AND b.pos = a.pos % m.n + 1 GROUP BY a.shape_id)""")
def osm_shape(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.ring_shape(points(spark, sf)).select("shape_id", "points", *(r(c, 2).alias(c) for c in ("area_m2", "centre_e", "centre_n")))


@query(_P + """SELECT shape_id, a.pos, a.e - coalesce(b.e, 0) AS de, a.n - coalesce(b.n, 0) AS dn, a.e, a.n FROM (SELECT shape_id, pos, round_even(e_m, 0)::BIGINT AS e, round_even(n_m, 0)::BIGINT AS n FROM p) a
LEFT JOIN (SELECT shape_id, pos + 1 AS pos, round_even(e_m, 0)::BIGINT AS e, round_even(n_m, 0)::BIGINT AS n FROM p) b USING (shape_id, pos) WHERE b.e IS NULL OR a.e <> b.e OR a.n <> b.n""")
def osm_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Steps, and the points read back from them."""
    steps = shapes.encoded(points(spark, sf))
    so_far = shapes.decoded(steps)
    return steps.join(so_far, ["shape_id", "pos"])


@query(_P + f"SELECT tile_e, tile_n, shapes, {_ROUND} FROM (SELECT floor((west + east) / 2 / 2000)::BIGINT AS tile_e, floor((south + north) / 2 / 2000)::BIGINT AS tile_n, count(*) AS shapes, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM (SELECT shape_id, {_BOX} FROM p GROUP BY shape_id HAVING count(*) >= 2) GROUP BY 1, 2)")
def osm_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.tiles(points(spark, sf)).select("tile_e", "tile_n", "shapes", *(r(c, 3).alias(c) for c in ("west", "south", "east", "north")))


_TOLERANCE = 1500.0


@query(_P + f""", seg(shape_id, lo, hi) AS (SELECT shape_id, min(pos), max(pos) FROM p GROUP BY shape_id
UNION ALL SELECT shape_id, unnest([lo, k]), unnest([k, hi]) FROM (SELECT shape_id, lo, hi, arg_max(k, {{'d': d2, 'k': -k}}) AS k FROM (SELECT shape_id, lo, hi, k, (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy) AS d2 FROM (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, (px * dx + py * dy) / (dx * dx + dy * dy))) END AS t FROM (
SELECT s.shape_id, lo, hi, m.pos AS k, m.e_m - a.e_m AS px, m.n_m - a.n_m AS py, b.e_m - a.e_m AS dx, b.n_m - a.n_m AS dy FROM seg s JOIN p a ON a.shape_id = s.shape_id AND a.pos = lo JOIN p b ON b.shape_id = s.shape_id AND b.pos = hi JOIN p m ON m.shape_id = s.shape_id AND m.pos > lo AND m.pos < hi))) WHERE d2 > {_TOLERANCE ** 2} GROUP BY shape_id, lo, hi))
SELECT DISTINCT shape_id, unnest([lo, hi]) AS pos FROM seg""")
def osm_simplify(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.simplified(points(spark, sf), _TOLERANCE)


_CLIP = (-1000.0, -1500.0, 2500.0, 1800.0)


def _clip_sql() -> str:
    out, sql = "p", _P
    for i, (along, across, at, sign) in enumerate((("e_m", "n_m", _CLIP[0], 1), ("e_m", "n_m", _CLIP[2], -1), ("n_m", "e_m", _CLIP[1], 1), ("n_m", "e_m", _CLIP[3], -1))):
        meets = f"q + ({across} - q) * ({at}e0 - p) / ({along} - p)"
        pair = f"{at}e0 AS e_m, {meets} AS n_m" if along == "e_m" else f"{meets} AS e_m, {at}e0 AS n_m"
        sql += f""", s{i} AS (SELECT *, ({along} - {at}e0) * {sign} >= 0 AS inside, (p - {at}e0) * {sign} >= 0 AS was FROM (SELECT *, coalesce(lag({along}) OVER w, last_value({along}) OVER v) AS p, coalesce(lag({across}) OVER w, last_value({across}) OVER v) AS q FROM {out} WINDOW w AS (PARTITION BY shape_id ORDER BY pos), v AS (PARTITION BY shape_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))),
c{i} AS (SELECT shape_id, row_number() OVER (PARTITION BY shape_id ORDER BY pos, k) AS pos, e_m, n_m FROM (SELECT shape_id, pos, 0 AS k, {pair} FROM s{i} WHERE inside <> was UNION ALL SELECT shape_id, pos, 1, e_m, n_m FROM s{i} WHERE inside))"""
        out = f"c{i}"
    return sql + f" SELECT shape_id, pos, {rs('e_m', 3)} AS e_m, {rs('n_m', 3)} AS n_m FROM {out}"


@query(_clip_sql())
def osm_clip(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.clipped_rings(points(spark, sf), *_CLIP).select("shape_id", "pos", r("e_m", 3).alias("e_m"), r("n_m", 3).alias("n_m"))


@query(_P + f""", i AS (SELECT *, e_m BETWEEN {_CLIP[0]}e0 AND {_CLIP[2]}e0 AND n_m BETWEEN {_CLIP[1]}e0 AND {_CLIP[3]}e0 AS inside FROM p),
b AS (SELECT *, inside OR coalesce(lag(inside) OVER w, false) OR coalesce(lead(inside) OVER w, false) AS near FROM i WINDOW w AS (PARTITION BY shape_id ORDER BY pos)),
g AS (SELECT *, sum(CASE WHEN near AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY shape_id ORDER BY pos)::BIGINT AS run FROM (SELECT *, coalesce(lag(near) OVER (PARTITION BY shape_id ORDER BY pos), false) AS was FROM b))
SELECT shape_id, run, row_number() OVER (PARTITION BY shape_id, run ORDER BY pos) AS pos, e_m, n_m FROM g WHERE near QUALIFY count(*) OVER (PARTITION BY shape_id, run) >= 2""")
def osm_clip_lines(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.clipped_lines(points(spark, sf), *_CLIP)


def member_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Customers are sides of twelve-cornered outlines, out of order and some against the others; where one is missing an outline stays open."""
    k = F.col("c_custkey")
    corner = (k * 5 + F.floor(k / 12)) % 12
    at = lambda c, f: F.round(1000 * f(F.radians((corner + c) * 30)), 0)
    third = lambda i: F.when(k % 2 == 0, F.lit(i)).otherwise(2 - i)
    sides = table(spark, sf, "customer").filter("c_custkey % 31 <> 7").select(F.floor(k / 12).alias("shape_id"), k.alias("way"), F.explode(F.array(*(F.struct(third(i).alias("pos"), at(i / 2, F.cos).alias("e_m"), at(i / 2, F.sin).alias("n_m")) for i in range(3)))).alias("p"))
    return sides.select("shape_id", "way", "p.*")


_STITCH = """WITH RECURSIVE m AS (SELECT c_custkey // 12 AS shape_id, c_custkey AS way, CASE WHEN c_custkey % 2 = 0 THEN i ELSE 2 - i END AS pos, round(1000 * cos(radians(((c_custkey * 5 + c_custkey // 12) % 12 + i / 2) * 30))) AS e_m, round(1000 * sin(radians(((c_custkey * 5 + c_custkey // 12) % 12 + i / 2) * 30))) AS n_m FROM customer, range(3) AS g(i) WHERE c_custkey % 31 <> 7),
e AS (SELECT shape_id, way, pos // 2 AS side, e_m, n_m FROM m WHERE pos <> 1),
k AS (SELECT *, row_number() OVER (PARTITION BY shape_id, e_m, n_m ORDER BY way, side) - 1 AS k FROM e),
l AS MATERIALIZED (SELECT a.shape_id, a.way, a.side, b.way AS to_way, b.side AS to_side FROM k a LEFT JOIN k b ON a.shape_id = b.shape_id AND a.e_m = b.e_m AND a.n_m = b.n_m AND a.k // 2 = b.k // 2 AND a.k <> b.k),
reach(shape_id, way, other) AS (SELECT shape_id, way, way FROM l UNION SELECT r.shape_id, r.way, to_way FROM reach r JOIN l ON l.shape_id = r.shape_id AND l.way = r.other AND to_way IS NOT NULL),
comp AS MATERIALIZED (SELECT shape_id, way, min(other) AS ring FROM reach GROUP BY shape_id, way),
shut AS MATERIALIZED (SELECT shape_id, ring, count(*) FILTER (WHERE to_way IS NULL) = 0 AS closed FROM l JOIN comp USING (shape_id, way) GROUP BY shape_id, ring),
begins AS (SELECT shape_id, ring, closed, CASE WHEN closed THEN {'way': ring, 'outs': 0} ELSE min({'way': way, 'outs': side}) FILTER (WHERE to_way IS NULL) END AS b FROM l JOIN comp USING (shape_id, way) JOIN shut USING (shape_id, ring) GROUP BY shape_id, ring, closed),
walk(shape_id, ring, closed, rank, way, enters) AS (SELECT shape_id, ring, closed, 0, b.way, b.outs FROM begins
UNION ALL SELECT w.shape_id, ring, closed, rank + 1, to_way, to_side FROM walk w JOIN l ON l.shape_id = w.shape_id AND l.way = w.way AND l.side = 1 - w.enters WHERE to_way IS NOT NULL AND NOT (closed AND to_way = ring))
SELECT shape_id, ring, closed, row_number() OVER (PARTITION BY shape_id, ring ORDER BY rank, CASE WHEN enters = 1 THEN -pos ELSE pos END) AS pos, e_m + 0e0 AS e_m, n_m + 0e0 AS n_m FROM walk JOIN m USING (shape_id, way) WHERE rank = 0 OR pos <> enters * 2"""


@query(_STITCH)
def osm_stitch(spark: SparkSession, sf: str) -> DataFrame:
    return shapes.stitched(member_ways(spark, sf)).withColumns({"e_m": F.col("e_m") + F.lit(0.0), "n_m": F.col("n_m") + F.lit(0.0)})
