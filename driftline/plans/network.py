"""Queries on the road graph: parts are its nodes, its ways run along the rows and columns in which they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.stages import written
from driftline.operators import mapmatch, routing

from .displays import segments as plain_segments
from .registry import query
from .relations import fixes, r, rs, table, with_


def road_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every 41st node has no place."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").filter("p_partkey % 41 <> 0").select((F.col("p_partkey") * 7 + 1000).alias("osm_id"), ((k % 20 - 5) * 300 + (s % 7) * 5.0).alias("e_m"), ((F.floor(k / 20) - 5) * 300 + (s % 5) * 6.0).alias("n_m"))


def road_ways(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    row, col = F.floor(k / 20), k % 20
    uses = table(spark, sf, "part").select((F.col("p_partkey") * 7 + 1000).alias("osm_id"), F.explode(F.array(F.struct((row * 2).alias("way"), col.alias("pos")), F.struct((col * 2 + 1).alias("way"), row.alias("pos")))).alias("u"))
    tag = F.element_at(F.array(*map(F.lit, ("no", "yes", "-1", "true", "1"))), (F.col("way") % 5 + 1).cast("int"))
    name = F.when(F.col("way") % 7 != 3, F.concat(F.lit("R"), (F.col("way") % 9).cast("string")))
    return uses.groupBy("u.way").agg(F.expr("transform(array_sort(collect_list(struct(u.pos AS pos, osm_id))), x -> x.osm_id)").alias("osm_ids")).select("way", "osm_ids", name.alias("name"), F.lit("minor").alias("class"), F.when(F.col("way") % 11 != 4, tag).alias("oneway"))


def road_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return routing.graph(road_nodes(spark, sf), road_ways(spark, sf))


def road_segments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    end = lambda node, e, n: nodes.select(F.col("node").alias(node), F.col("e_m").alias(e), F.col("n_m").alias(n))
    return edges.join(end("u", "ax", "ay"), "u").join(end("v", "bx", "by"), "v").select(F.col("edge").alias("seg_id"), F.col("way").alias("way_id"), "ax", "ay", "bx", "by")


def driven(spark: SparkSession, sf: str, shrink: float) -> DataFrame:
    return fixes(spark, sf).select("track_id", "t_s", "fix_no", (F.col("e_m") / shrink).alias("e_m"), (F.col("n_m") / shrink).alias("n_m"))


def requests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers ask for a way to another edge, to one that may be out of reach, and along their own."""
    k = F.col("s_suppkey")
    asked = table(spark, sf, "supplier").select(k.alias("route_id"), (k * 31 % 150).alias("edge"), ((k % 10) / 10.0).alias("along"), ((k % 8 - 1) * 300.0).alias("budget_m"))
    goal = lambda i, edge, along: asked.select("route_id", F.lit(i).alias("goal"), F.expr(edge).alias("edge"), F.expr(along).alias("along"))
    return asked, goal(0, "(edge + route_id * 17 % 23) % 150", "0.25D").unionByName(goal(1, "(edge + 61) % 150", "0.5D")).unionByName(goal(2, "edge", "0.9D"))


_GRAPH = """nd AS (SELECT p_partkey * 7 + 1000 AS osm_id, (p_partkey % 20 - 5) * 300 + (p_size % 7) * 5e0 AS e_m, (p_partkey // 20 - 5) * 300 + (p_size % 5) * 6e0 AS n_m FROM part WHERE p_partkey % 41 <> 0),
us AS (SELECT p_partkey // 20 * 2 AS way, p_partkey % 20 AS pos, p_partkey * 7 + 1000 AS osm_id FROM part UNION ALL SELECT p_partkey % 20 * 2 + 1, p_partkey // 20, p_partkey * 7 + 1000 FROM part),
gn AS MATERIALIZED (SELECT row_number() OVER (ORDER BY first_use) - 1 AS node, osm_id, e_m, n_m FROM (SELECT osm_id, min((way, pos)) AS first_use FROM us GROUP BY osm_id) JOIN nd USING (osm_id)),
ge AS MATERIALIZED (SELECT row_number() OVER (ORDER BY way, pos) - 1 AS edge, a.node AS u, b.node AS v, way, (round(sqrt((a.e_m - b.e_m) ** 2 + (a.n_m - b.n_m) ** 2), 1)) AS length_m, a.e_m AS ax, a.n_m AS ay, b.e_m AS bx, b.n_m AS by_ FROM (SELECT way, pos, osm_id, lead(osm_id) OVER (PARTITION BY way ORDER BY pos) AS next FROM us) s JOIN gn a ON a.osm_id = s.osm_id JOIN gn b ON b.osm_id = s.next)"""


@query("WITH " + _GRAPH + f" SELECT edge, u, v, way, {rs('length_m', 1)} AS length_m, {rs('ax', 1)} AS from_e, {rs('ay', 1)} AS from_n, CASE WHEN way % 11 = 4 THEN 0 ELSE [0, 1, -1, 1, 1][way % 5 + 1] END AS oneway FROM ge")
def src_osm_graph(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, ways = road_graph(spark, sf)
    begin = nodes.select(F.col("node").alias("u"), r("e_m", 1).alias("from_e"), r("n_m", 1).alias("from_n"))
    return edges.join(begin, "u").join(ways.select("way", "oneway"), "way").select("edge", "u", "v", "way", r("length_m", 1).alias("length_m"), "from_e", "from_n", "oneway")


@query("WITH " + _GRAPH + f", deg AS (SELECT node, count(*) AS d FROM (SELECT u AS node FROM ge UNION ALL SELECT v FROM ge) GROUP BY node) SELECT (SELECT count(*) FROM gn) AS nodes, (SELECT count(*) FROM ge) AS edges, (SELECT count(DISTINCT way) FROM us) AS ways, (SELECT count(*) FROM deg WHERE d > 2) AS junctions, {rs('(SELECT sum(length_m) FROM ge) / 1000', 1)} AS total_km")
def src_graph_report(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, ways = road_graph(spark, sf)
    return routing.report(nodes, edges, ways).withColumn("total_km", r("total_km", 1))


_ROUTES = "WITH RECURSIVE " + _GRAPH + """,
rq AS (SELECT s_suppkey AS route_id, s_suppkey * 31 % 150 AS edge, (s_suppkey % 10) / 1e1 AS along, (s_suppkey % 8 - 1) * 3e2 AS budget_m FROM supplier),
gl AS (SELECT route_id, 0 AS goal, (edge + route_id * 17 % 23) % 150 AS edge, 0.25e0 AS along FROM rq UNION ALL SELECT route_id, 1, (edge + 61) % 150, 0.5e0 FROM rq UNION ALL SELECT route_id, 2, edge, 0.9e0 FROM rq),
st AS (SELECT u AS node, v AS next, length_m FROM ge UNION ALL SELECT v, u, length_m FROM ge),
fr(route_id, budget_m, node, m, k, nodes) AS (
  SELECT * FROM (SELECT route_id, budget_m, u AS node, along * length_m AS m, 0 AS k, [u] AS nodes FROM rq JOIN ge USING (edge) UNION ALL SELECT route_id, budget_m, v, (1 - along) * length_m, 0, [v] FROM rq JOIN ge USING (edge)) WHERE budget_m > 0 AND m <= budget_m
  UNION ALL SELECT route_id, budget_m, next, b.m, k + 1, b.nodes FROM (SELECT route_id, budget_m, st.next, k, min({'m': m + length_m, 'nodes': list_append(nodes, st.next)}) AS b FROM fr JOIN st USING (node) WHERE m + length_m <= budget_m GROUP BY route_id, budget_m, st.next, k)),
fin AS (SELECT route_id, goal, min({'m': m + rest, 'n': len(nodes), 'nodes': nodes}) AS w FROM fr JOIN (SELECT g.route_id, goal, u AS node, g.along * length_m AS rest FROM gl g JOIN ge USING (edge) JOIN rq ON rq.route_id = g.route_id AND rq.edge <> g.edge UNION ALL SELECT g.route_id, goal, v, (1 - g.along) * length_m FROM gl g JOIN ge USING (edge) JOIN rq ON rq.route_id = g.route_id AND rq.edge <> g.edge) USING (route_id, node) GROUP BY route_id, goal),
way AS MATERIALIZED (SELECT gl.route_id, goal, CASE WHEN gl.edge = rq.edge THEN CASE WHEN budget_m > 0 THEN abs(gl.along - rq.along) * length_m END ELSE w.m END AS distance_m, CASE WHEN gl.edge = rq.edge THEN [] ELSE w.nodes END AS nodes FROM gl JOIN rq USING (route_id) JOIN ge ON ge.edge = gl.edge LEFT JOIN fin USING (route_id, goal))
"""


@query(_ROUTES + f"SELECT route_id, goal, {rs('distance_m', 3)} AS distance_m, CASE WHEN distance_m IS NOT NULL THEN len(nodes) END AS passed FROM way")
def rd_route(spark: SparkSession, sf: str) -> DataFrame:
    _, edges, _ = road_graph(spark, sf)
    found = routing.routes(written(edges, "edges"), *requests(spark, sf))
    return found.select("route_id", "goal", r("distance_m", 3).alias("distance_m"), F.when(F.col("distance_m").isNotNull(), F.size("nodes")).alias("passed"))


@query(_ROUTES + f""", pts AS (SELECT route_id, goal, i AS pos, e_m, n_m FROM (SELECT route_id, goal, unnest(nodes) AS node, unnest(generate_series(1, len(nodes))) AS i FROM way WHERE distance_m IS NOT NULL) JOIN gn USING (node)
UNION ALL SELECT route_id, goal, 0, ax + along * (bx - ax), ay + along * (by_ - ay) FROM way JOIN rq USING (route_id) JOIN ge USING (edge) WHERE distance_m IS NOT NULL
UNION ALL SELECT route_id, goal, len(nodes) + 1, ax + gl.along * (bx - ax), ay + gl.along * (by_ - ay) FROM way JOIN gl USING (route_id, goal) JOIN ge USING (edge) WHERE distance_m IS NOT NULL)
SELECT route_id, goal, pos, {rs('e_m', 2)} AS e_m, {rs('n_m', 2)} AS n_m FROM pts""")
def rd_path(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = road_graph(spark, sf)
    edges = written(edges, "edges")
    asked, goals = requests(spark, sf)
    at = lambda df: df.join(road_segments(nodes, edges).withColumnRenamed("seg_id", "edge"), "edge").withColumns({"e_m": F.col("ax") + F.col("along") * (F.col("bx") - F.col("ax")), "n_m": F.col("ay") + F.col("along") * (F.col("by") - F.col("ay"))})
    points = routing.path_points(routing.routes(edges, asked, goals), nodes, at(asked).select("route_id", "e_m", "n_m"), at(goals).select("route_id", "goal", "e_m", "n_m"))
    return points.select("route_id", "goal", "pos", r("e_m", 2).alias("e_m"), r("n_m", 2).alias("n_m"))


def _search(first: str, candidates: str, steps: str) -> str:
    """The likeliest way in SQL: scores forwards from where runs can begin, then choices backwards. candidates: track_id, i, k, em and more; steps: track_id, i, j, k, step."""
    return first + f"""cd AS MATERIALIZED ({candidates}),
sp AS MATERIALIZED ({steps}),
begins AS (SELECT DISTINCT c.track_id, c.i FROM cd c LEFT JOIN cd b ON b.track_id = c.track_id AND b.i = c.i - 1 WHERE b.i IS NULL),
fw(track_id, i, k, score, back) AS (
  SELECT track_id, i, k, em, -1 FROM cd JOIN begins USING (track_id, i)
  UNION ALL SELECT c.track_id, c.i, c.k, CASE WHEN max(f.score + sp.step) IS NULL THEN any_value(c.em) ELSE max(f.score + sp.step + c.em) END, coalesce(arg_max(f.k, {{'s': f.score + sp.step + c.em, 'k': -f.k}}) FILTER (WHERE sp.step IS NOT NULL), -1)
  FROM fw f JOIN cd c ON c.track_id = f.track_id AND c.i = f.i + 1 LEFT JOIN sp ON sp.track_id = c.track_id AND sp.i = c.i AND sp.j = f.k AND sp.k = c.k GROUP BY c.track_id, c.i, c.k),
fwd AS MATERIALIZED (SELECT * FROM fw),
best AS MATERIALIZED (SELECT track_id, i, arg_max(k, {{'s': score, 'k': -k}}) AS k FROM fwd GROUP BY track_id, i),
bw(track_id, i, k) AS (
  SELECT b.track_id, b.i, b.k FROM best b LEFT JOIN best a ON a.track_id = b.track_id AND a.i = b.i + 1 WHERE a.i IS NULL
  UNION ALL SELECT f.track_id, f.i - 1, CASE WHEN f.back >= 0 THEN f.back ELSE p.k END FROM bw JOIN fwd f USING (track_id, i, k) JOIN best p ON p.track_id = f.track_id AND p.i = f.i - 1),
pick AS MATERIALIZED (SELECT bw.track_id, bw.i, cd.* EXCLUDE (track_id, i, k) FROM bw JOIN cd USING (track_id, i, k)),
m AS MATERIALIZED (SELECT fx.track_id, fx.i, fix_no, t_s, fx.e_m, fx.n_m, seg_id IS NOT NULL AS matched, seg_id, way_id, px, py, offset_m AS exact_m, round(offset_m, 1) AS offset_m, CASE WHEN seg_id IS NOT NULL THEN round(((degrees(atan2(dx, dy)) % 360) + 360) % 360, 1) END AS bearing_deg FROM fx LEFT JOIN pick USING (track_id, i))
"""


_FX = with_("fixes") + ", fx AS MATERIALIZED (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t_s, fix_no) AS i, fix_no, t_s, e_m / {0} AS e_m, n_m / {0} AS n_m FROM fixes),\n"
_CAND = """SELECT track_id, i, row_number() OVER (PARTITION BY track_id, i ORDER BY offset_m, seg_id) - 1 AS k, -0.5e0 * (offset_m / 20e0) * (offset_m / 20e0) AS em, * EXCLUDE (track_id, i) FROM (SELECT track_id, i, seg_id, way_id, ax + t * dx AS px, ay + t * dy AS py, dx, dy, sqrt((e_m - (ax + t * dx)) ** 2 + (n_m - (ay + t * dy)) ** 2) AS offset_m FROM (SELECT *, greatest(0, least(1, ((e_m - ax) * dx + (n_m - ay) * dy) / (dx * dx + dy * dy))) AS t FROM fx JOIN seg ON greatest(ax, ax + dx) >= e_m - 31 AND least(ax, ax + dx) <= e_m + 31 AND greatest(ay, ay + dy) >= n_m - 31 AND least(ay, ay + dy) <= n_m + 31)) WHERE offset_m <= 30"""
_NEXT = "FROM cd c JOIN cd p ON p.track_id = c.track_id AND p.i = c.i - 1 JOIN fx f ON f.track_id = c.track_id AND f.i = c.i JOIN fx g ON g.track_id = p.track_id AND g.i = p.i"
_STRAIGHT = "sqrt((f.e_m - g.e_m) * (f.e_m - g.e_m) + (f.n_m - g.n_m) * (f.n_m - g.n_m))"
_BETWEEN = "sqrt((c.px - p.px) * (c.px - p.px) + (c.py - p.py) * (c.py - p.py))"
_GEOM = _search(
    _FX.format("40") + "seg AS (SELECT s_suppkey AS seg_id, s_suppkey % 6 AS way_id, (s_suppkey % 20 * 20 - 200)::DOUBLE AS ax, (s_suppkey % 7 * 30 - 100)::DOUBLE AS ay, 120e0 AS dx, 40e0 AS dy FROM supplier),\n",
    _CAND + " QUALIFY k < 8", f"SELECT c.track_id, c.i, p.k AS j, c.k, -abs({_BETWEEN} - {_STRAIGHT}) / 120e0 + CASE WHEN c.way_id = p.way_id THEN 1.2e0 ELSE 0e0 END AS step {_NEXT}",
)
_MATCH = f"track_id, fix_no, matched, seg_id, {rs('px', 4)} AS road_e, {rs('py', 4)} AS road_n, {rs('exact_m', 4)} AS offset_m, {rs('bearing_deg', 1)} AS bearing_deg"


def _told(found: DataFrame) -> DataFrame:
    return found.select("track_id", "fix_no", "matched", "seg_id", r("px").alias("road_e"), r("py").alias("road_n"), r("exact_m").alias("offset_m"), r("bearing_deg", 1).alias("bearing_deg"))



def geometry_matches(spark: SparkSession, sf: str) -> DataFrame:
    return mapmatch.on_geometry(driven(spark, sf, 40.0), plain_segments(spark, sf))


@query(_GEOM + f"SELECT {_MATCH} FROM m")
def rd_viterbi_geom(spark: SparkSession, sf: str) -> DataFrame:
    return _told(geometry_matches(spark, sf))


@query(_GEOM + f"""SELECT track_id, n_fixes, n_matched, {rs('n_matched / n_fixes', 2)} AS matched_fraction, coalesce(median_offset_m, 0e0) + 0e0 AS median_offset_m, coalesce(roads, '') AS roads FROM (SELECT track_id, count(*) AS n_fixes, count(*) FILTER (WHERE matched) AS n_matched FROM m GROUP BY track_id)
LEFT JOIN (SELECT track_id, list(offset_m ORDER BY offset_m)[count(*) // 2 + 1] AS median_offset_m FROM m WHERE matched GROUP BY track_id) USING (track_id)
LEFT JOIN (SELECT track_id, string_agg(name, '>' ORDER BY i) AS roads FROM (SELECT *, lag(name) OVER (PARTITION BY track_id ORDER BY i) AS was FROM (SELECT track_id, i, 'W' || way_id AS name FROM m WHERE matched AND way_id <> 4)) WHERE was IS NULL OR was <> name GROUP BY track_id) USING (track_id)""")
def rd_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Way 4 has no name."""
    ways = plain_segments(spark, sf).select("way_id").distinct().select("way_id", F.when(F.col("way_id") != 4, F.concat(F.lit("W"), "way_id")).alias("name"))
    return mapmatch.summary(geometry_matches(spark, sf), ways).withColumns({"roads": F.array_join("roads", ">"), "matched_fraction": r("matched_fraction", 2)})


@query(_GEOM + f"""SELECT track_id, run, fix_no, CASE WHEN matched THEN row_number() OVER (PARTITION BY track_id, run ORDER BY i) END AS pos, {rs('e_m', 4)} AS e_m, {rs('n_m', 4)} AS n_m FROM (SELECT track_id, i, fix_no, matched, coalesce(px, e_m) AS e_m, coalesce(py, n_m) AS n_m, CASE WHEN matched THEN sum(CASE WHEN matched AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY i)::BIGINT END AS run
FROM (SELECT *, coalesce(lag(matched) OVER (PARTITION BY track_id ORDER BY i), false) AS was FROM m WHERE t_s <= 12000))""")
def rd_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The runs as a display shows them at the clock of 12 000 seconds."""
    here = driven(spark, sf, 40.0).select("track_id", "fix_no", "e_m", "n_m")
    exact = geometry_matches(spark, sf).withColumns({"road_e": F.col("px"), "road_n": F.col("py")})
    seen = mapmatch.trace(exact.join(here, ["track_id", "fix_no"]), F.lit(12000.0))
    return seen.withColumns({"e_m": r("e_m"), "n_m": r("n_m")})


_ROUTED = _search(
    _FX.format("8") + _GRAPH + ",\nseg AS (SELECT edge AS seg_id, way AS way_id, ax, ay, bx - ax AS dx, by_ - ay AS dy, u, v, length_m FROM ge),\n",
    "SELECT * EXCLUDE (k, kk), kk AS k FROM (SELECT *, row_number() OVER (PARTITION BY track_id, i ORDER BY k) - 1 AS kk FROM (SELECT c.*, u, v, length_m, t FROM (" + _CAND.replace("SELECT track_id, i, seg_id", "SELECT t, track_id, i, seg_id") + ") c JOIN seg USING (seg_id) QUALIFY row_number() OVER (PARTITION BY track_id, i, c.way_id ORDER BY k) = 1)) WHERE kk < 6",
    f"""WITH RECURSIVE pr AS MATERIALIZED (SELECT c.track_id, c.i, p.k AS j, c.k, {_STRAIGHT} AS straight, {_BETWEEN} AS between_m, p.seg_id AS e0, c.seg_id AS e1, p.t AS t0, c.t AS t1, p.u AS u0, p.v AS v0, c.u AS u1, c.v AS v1, p.length_m AS l0, c.length_m AS l1, least(9000, {_STRAIGHT} * 2 + 600) AS budget {_NEXT}),
nb AS (SELECT u AS node, v AS next, length_m FROM ge UNION ALL SELECT v, u, length_m FROM ge),
go(track_id, i, j, budget, node, d, h) AS (SELECT * FROM (SELECT DISTINCT track_id, i, j, budget, u0 AS node, t0 * l0 AS d, 0 AS h FROM pr WHERE straight > 50 AND e0 <> e1 UNION ALL SELECT DISTINCT track_id, i, j, budget, v0, (1 - t0) * l0, 0 FROM pr WHERE straight > 50 AND e0 <> e1) WHERE d <= budget
  UNION ALL SELECT track_id, i, j, budget, next, min(d + length_m), h + 1 FROM go JOIN nb USING (node) WHERE d + length_m <= budget GROUP BY track_id, i, j, budget, next, h),
dist AS (SELECT track_id, i, j, node, min(d) AS d FROM go GROUP BY track_id, i, j, node)
SELECT track_id, i, j, k, -abs(CASE WHEN straight <= 50 THEN between_m WHEN e0 = e1 THEN abs(t1 - t0) * l1 ELSE least(a.d + t1 * l1, b.d + (1 - t1) * l1) END - straight) / 120e0 AS step FROM pr LEFT JOIN dist a ON a.track_id = pr.track_id AND a.i = pr.i AND a.j = pr.j AND a.node = u1 LEFT JOIN dist b ON b.track_id = pr.track_id AND b.i = pr.i AND b.j = pr.j AND b.node = v1""".replace("SELECT track_id, i, j, k, -abs", "SELECT pr.track_id, pr.i, pr.j, pr.k, -abs"),
)


@query(_ROUTED + f"SELECT {_MATCH} FROM m")
def rd_viterbi_graph(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = road_graph(spark, sf)
    edges = written(edges, "edges")
    return _told(mapmatch.on_graph(driven(spark, sf, 8.0), road_segments(nodes, edges), edges))
