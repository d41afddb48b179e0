"""Road graphs: built from ways, and shortest ways on them for many requests at once.

A route is found by relaxing a frontier: in each round the places that the last round improved meet the table of edges by node,
and the least distance of each request and node is kept. All requests run side by side, a node stands once a request, and no task
ever holds the graph. Requests stop at their budget, and as soon as nothing on their frontier can improve a goal. Where only lengths
are asked, and many points lie on few edges, the search runs between the ends of edges, once for all points on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geo import length
from driftline.functions.stages import written

#: Ways whose first uses are numbered together.
BUCKET = 1024
FORWARD, BACKWARD = ("yes", "true", "1"), ("-1",)


def direction(tag: str = "oneway") -> F.Column:
    """1 along the way as it is drawn, -1 against it, 0 both."""
    return F.when(F.col(tag).isin(*BACKWARD), -1).when(F.col(tag).isin(*FORWARD), 1).otherwise(0)


def graph(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, osm_id, e_m, n_m), edges (edge, u, v, way, length_m) and ways (way, name, class, oneway) of a drivable network.

    nodes: osm_id, e_m, n_m; ways: way (whole numbers from 0), osm_ids (in order), name, class, oneway (the tag). Nodes are numbered
    from 0 by their first use along the ways; nodes that no way uses have no number. A way has a gap where a node has no place, and
    no edge from a node to itself. Numbers are running sums over buckets of ways, so no task orders more than one bucket and the
    list of buckets.
    """
    uses = ways.select("way", F.posexplode("osm_ids").alias("pos", "osm_id"))
    placed = uses.join(nodes.select("osm_id"), "osm_id", "left_semi")
    first = placed.groupBy("osm_id").agg(F.min(F.struct("way", "pos")).alias("at")).select("osm_id", "at.way", "at.pos", F.floor(F.col("at.way") / BUCKET).alias("bucket"))
    before = first.groupBy("bucket").count().select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"))
    own = Window.partitionBy("bucket").orderBy("way", "pos")
    number = first.withColumn("k", F.row_number().over(own)).join(before, "bucket").select("osm_id", (F.col("before") + F.col("k") - 1).cast("long").alias("node"))
    numbered = written(number.join(nodes, "osm_id").select("node", "osm_id", "e_m", "n_m"), "nodes")
    along = Window.partitionBy("way").orderBy("pos")
    pairs = uses.select("way", "pos", F.col("osm_id").alias("a"), F.lead("osm_id").over(along).alias("b")).filter("b IS NOT NULL AND a <> b")
    end = lambda o, x: numbered.select(F.col("osm_id").alias(o), F.col("node").alias(x), F.col("e_m").alias(f"{x}_e"), F.col("n_m").alias(f"{x}_n"))
    edges = pairs.join(end("a", "u"), "a").join(end("b", "v"), "b").withColumn("bucket", F.floor(F.col("way") / BUCKET))
    size = edges.groupBy("bucket").count().select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"))
    edges = edges.withColumn("k", F.row_number().over(own)).join(size, "bucket")
    metres = F.round(length(F.col("u_e") - F.col("v_e"), F.col("u_n") - F.col("v_n")), 1)
    return numbered, edges.select((F.col("before") + F.col("k") - 1).cast("long").alias("edge"), "u", "v", "way", metres.alias("length_m")), ways.select("way", "name", "class", direction().alias("oneway"))


def ends(points: DataFrame, edges: DataFrame) -> DataFrame:
    """points (edge, along: 0 at u, 1 at v, ...) twice: with each end node of their edge and the metres to it."""
    on = points.join(edges.select("edge", "u", "v", "length_m"), "edge")
    return on.withColumn("to", F.explode(F.array(F.struct(F.col("u").alias("node"), (F.col("along") * F.col("length_m")).alias("m")), F.struct(F.col("v").alias("node"), ((1 - F.col("along")) * F.col("length_m")).alias("m"))))).drop("u", "v", "length_m")


def steps(edges: DataFrame) -> DataFrame:
    """node, next, length_m: every edge both ways; of parallel edges only the shortest matters."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("next"), "length_m").unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("next"), "length_m"))
    return written(both.filter("node <> next").groupBy("node", "next").agg(F.min("length_m").alias("length_m")), "steps")


def routes(edges: DataFrame, requests: DataFrame, goals: DataFrame) -> DataFrame:
    """route_id, goal, distance_m, nodes: the shortest way from each request's point to each of its goals.

    requests: route_id, edge, along, budget_m; goals: route_id, goal, edge, along. Edges are used both ways. Only nodes within the
    budget are passed; a goal out of reach has null, and without a positive budget all have. Two points of one edge are joined along
    it, over no node. Of ways of equal length the one over fewer nodes counts, then the one over lesser nodes.
    """
    step = steps(edges)
    asked = goals.join(requests.select("route_id", F.col("edge").alias("from_edge"), F.col("along").alias("from_along"), "budget_m"), "route_id").filter("budget_m > 0")
    apart = written(ends(asked.filter("edge <> from_edge").select("route_id", "goal", "edge", "along"), edges).select("route_id", "goal", F.col("to.node").alias("node"), F.col("to.m").alias("rest_m")), "goals")
    open_ = requests.filter("budget_m > 0").join(apart.select("route_id").distinct(), "route_id", "left_semi")
    begin = ends(open_.select("route_id", "budget_m", "edge", "along"), edges).select("route_id", "budget_m", F.col("to.node").alias("node"), F.struct(F.col("to.m").alias("m"), F.lit(0).alias("round"), F.array("to.node").alias("nodes")).alias("best")).filter("best.m <= budget_m")
    state = written(begin.groupBy("route_id", "budget_m", "node").agg(F.min("best").alias("best")), "round")
    wanted = apart.groupBy("route_id").agg(F.count_distinct("goal").alias("wanted"))
    round_ = 0
    while not state.filter(F.col("best.round") == round_).isEmpty():
        # The longest of a request's ways so far, once it has one to every goal: nothing beyond it helps.
        met = state.join(apart, ["route_id", "node"]).groupBy("route_id", "goal").agg(F.min(F.col("best.m") + F.col("rest_m")).alias("m"))
        limit = met.groupBy("route_id").agg(F.count("*").alias("met"), F.max("m").alias("limit_m")).join(wanted, "route_id").filter("met = wanted").select("route_id", "limit_m")
        fresh = state.filter(F.col("best.round") == round_).join(step, "node").withColumn("m", F.col("best.m") + F.col("length_m"))
        fresh = fresh.join(limit, "route_id", "left").filter("m <= budget_m AND (limit_m IS NULL OR m < limit_m)")
        round_ += 1
        fresh = fresh.select("route_id", "budget_m", F.col("next").alias("node"), F.struct("m", F.lit(round_).alias("round"), F.concat("best.nodes", F.array("next")).alias("nodes")).alias("best"))
        state = written(state.unionByName(fresh).groupBy("route_id", "budget_m", "node").agg(F.min("best").alias("best")), "round")
    found = state.join(apart, ["route_id", "node"]).groupBy("route_id", "goal").agg(F.min(F.struct((F.col("best.m") + F.col("rest_m")).alias("m"), F.size("best.nodes").alias("n"), F.col("best.nodes").alias("nodes"))).alias("way"))
    near = asked.filter("edge = from_edge").join(edges.select("edge", "length_m"), "edge").select("route_id", "goal", (F.abs(F.col("along") - F.col("from_along")) * F.col("length_m")).alias("m"), F.expr("CAST(array() AS array<long>)").alias("nodes"))
    every = near.unionByName(found.select("route_id", "goal", "way.m", "way.nodes"))
    return goals.select("route_id", "goal").join(every, ["route_id", "goal"], "left").select("route_id", "goal", F.col("m").alias("distance_m"), "nodes")


def between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, goal, m: the metres of the shortest way from node to goal, where there is one of at most budget_m. pairs: node, goal, budget_m.

    A node is searched from once, as far as the largest of its budgets and to all its goals side by side, however many pairs name it.
    """
    step = steps(edges)
    goals = written(pairs.groupBy("node", "goal").agg(F.max("budget_m").alias("budget_m")), "goals")
    asked = goals.groupBy(F.col("node").alias("source")).agg(F.max("budget_m").alias("budget_m"), F.count("*").alias("wanted"))
    to = goals.select(F.col("node").alias("source"), F.col("goal").alias("node"))
    state = written(asked.filter("budget_m >= 0").select("source", "budget_m", "wanted", F.col("source").alias("node"), F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("round")).alias("best")), "round")
    round_ = 0
    while not state.filter(F.col("best.round") == round_).isEmpty():
        # The farthest of a source's goals, once all have a way: nothing beyond it helps.
        limit = state.join(to, ["source", "node"]).groupBy("source").agg(F.count("*").alias("met"), F.max("best.m").alias("limit_m"), F.first("wanted").alias("wanted")).filter("met = wanted").select("source", "limit_m")
        fresh = state.filter(F.col("best.round") == round_).join(step, "node").withColumn("m", F.col("best.m") + F.col("length_m"))
        fresh = fresh.join(limit, "source", "left").filter("m <= budget_m AND (limit_m IS NULL OR m < limit_m)")
        round_ += 1
        fresh = fresh.select("source", "budget_m", "wanted", F.col("next").alias("node"), F.struct("m", F.lit(round_).alias("round")).alias("best"))
        state = written(state.unionByName(fresh).groupBy("source", "budget_m", "wanted", "node").agg(F.min("best").alias("best")), "round")
    found = state.select(F.col("source").alias("node"), F.col("node").alias("goal"), F.col("best.m").alias("m"))
    return found.join(goals, ["node", "goal"]).filter("m <= budget_m").select("node", "goal", "m")


def edge_distances(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """edge, goal_edge, own_m, goal_m (their lengths), uu, uv, vu, vv: the metres from either end of edge to either end of goal_edge, null beyond budget_m; none are asked of an edge to itself.

    pairs: edge, goal_edge, budget_m, each pair of edges once.
    """
    end = lambda edge, names: edges.select(F.col("edge").alias(edge), *(F.col(c).alias(n) for c, n in zip(("u", "v", "length_m"), names, strict=True)))
    pairs = written(pairs, "pairs")  # so that their size is known to the joins
    on = written(pairs.join(end("edge", ("u", "v", "own_m")), "edge").join(end("goal_edge", ("gu", "gv", "goal_m")), "goal_edge"), "edge-pairs")
    ways = F.explode(F.array(*(F.struct(F.col(a).alias("node"), F.col(b).alias("goal"), F.lit(a + b[1]).alias("way")) for a in ("u", "v") for b in ("gu", "gv"))))
    each = on.filter("edge <> goal_edge").select("edge", "goal_edge", "budget_m", ways.alias("x")).select("edge", "goal_edge", "budget_m", "x.*")
    found = each.join(between(edges, each.select("node", "goal", "budget_m")), ["node", "goal"])
    of = [F.min(F.when(F.col("way") == w, F.col("m"))).alias(w) for w in ("uu", "uv", "vu", "vv")]
    return on.select("edge", "goal_edge", "own_m", "goal_m").join(found.groupBy("edge", "goal_edge").agg(*of), ["edge", "goal_edge"], "left")


def along_edges() -> Column:
    """The metres of the shortest way from along on edge to goal_along on goal_edge, of rows that also have budget_m and what edge_distances gives; null out of reach.

    As routes measures it: a node counts within the budget, the last part of an edge goes on beyond it. A point at the end of an edge is
    that node, so that one place is equally far on all edges that meet there, to the last bit.
    """
    c = F.col
    au, av, bu, bv = c("along") * c("own_m"), (1 - c("along")) * c("own_m"), c("goal_along") * c("goal_m"), (1 - c("goal_along")) * c("goal_m")

    def at(end: str) -> Column:
        from_u, from_v = au + c("u" + end), av + c("v" + end)
        m = F.when(au == 0, from_u).when(av == 0, from_v).otherwise(F.least(from_u, from_v))
        return F.when(m <= c("budget_m"), m)

    u, v = at("u"), at("v")
    way = F.when((bu == 0) & u.isNotNull(), u).when((bv == 0) & v.isNotNull(), v).otherwise(F.least(u + bu, v + bv))
    return F.when(c("edge") == c("goal_edge"), F.abs(c("goal_along") - c("along")) * c("own_m")).otherwise(way)


def path_points(found: DataFrame, nodes: DataFrame, begin: DataFrame, end: DataFrame) -> DataFrame:
    """route_id, goal, pos, e_m, n_m: the points of every way found, from its start over its nodes to its goal.

    begin: route_id, e_m, n_m; end: route_id, goal, e_m, n_m.
    """
    reached = found.filter("distance_m IS NOT NULL")
    between = reached.select("route_id", "goal", F.posexplode("nodes").alias("pos", "node")).join(nodes.select("node", "e_m", "n_m"), "node").select("route_id", "goal", (F.col("pos") + 1).alias("pos"), "e_m", "n_m")
    first = reached.select("route_id", "goal").join(begin, "route_id").select("route_id", "goal", F.lit(0).alias("pos"), "e_m", "n_m")
    last = reached.select("route_id", "goal", (F.size("nodes") + 1).alias("pos")).join(end, ["route_id", "goal"]).select("route_id", "goal", "pos", "e_m", "n_m")
    return first.unionByName(between).unionByName(last)


def report(nodes: DataFrame, edges: DataFrame, ways: DataFrame) -> DataFrame:
    """One row: nodes, edges, ways, junctions (nodes where three or more edges meet), total_km."""
    degree = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").count()
    one = nodes.agg(F.count("*").alias("nodes"))
    return one.crossJoin(edges.agg(F.count("*").alias("edges"), (F.coalesce(F.sum("length_m"), F.lit(0.0)) / 1000).alias("total_km"))).crossJoin(ways.agg(F.count("*").alias("ways"))).crossJoin(degree.agg(F.count_if(F.col("count") > 2).alias("junctions"))).select("nodes", "edges", "ways", "junctions", "total_km")
