"""Map matching and routing on small networks, each far from the others, and the streamed search against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from driftline.config import Roads
from driftline.functions import stages
from driftline.operators import mapmatch, roads, routing

FAR = 100_000.0
SEGMENTS = "seg_id long, way_id long, name string, ax double, ay double, bx double, by double"


def straight(case, way, name, x):
    return [(way, name, case * FAR + x, i * 100.0, case * FAR + x, (i + 1) * 100.0) for i in range(4)]


ROADS = [
    straight(0, 1, "First", 0), straight(1, 2, "First", 0), straight(2, 3, "First", 0) + straight(2, 4, "Second", 22), straight(3, 5, "First", 0),
    straight(4, 6, "First", 0) + straight(4, 7, "Second", 500), [], straight(6, 8, "First", 0),
]
TRACKS = [
    [(6, 20), (-5, 140), (8, 260)], [(5, 100), (200, 200), (5, 300)], [(2, 20), (13, 120), (9, 220), (14, 320)], [(4, 50), (4, 150)],
    [(0, 50), (0, 150), (500, 150), (500, 250), (0, 250)], [(0, 0), (100, 100)], [(45, 100), (45, 200)],
]


def tracks(spark, which):
    rows = [(t, i * 300.0, i, t * FAR + e, float(n)) for t, points in enumerate(which) for i, (e, n) in enumerate(points)]
    return spark.createDataFrame(rows, "track_id long, t_s double, fix_no long, e_m double, n_m double")


def test_matching_by_geometry(spark):
    flat = [(i, *row) for i, row in enumerate(itertools.chain(*ROADS))]
    segments = spark.createDataFrame(flat, SEGMENTS)
    names = segments.selectExpr("way_id", "name").distinct()
    found = mapmatch.on_geometry(tracks(spark, TRACKS), segments).cache()
    told = {r.track_id: r for r in mapmatch.summary(found, names).collect()}
    rows = {(r.track_id, r.fix_no): r for r in found.collect()}
    assert told[0].matched_fraction == 1.0 and told[0].roads == ["First"] and told[0].median_offset_m <= 8
    assert all(rows[0, i].road_e == 0.0 for i in range(3))
    assert [rows[1, i].matched for i in range(3)] == [True, False, True] and told[1].n_matched == 2 and told[1].matched_fraction == 0.67
    assert rows[1, 1].seg_id is None and rows[1, 1].road_e is None
    assert told[2].matched_fraction == 1.0 and told[2].roads == ["First"]
    assert rows[3, 0].bearing_deg == 0.0
    assert told[4].roads == ["First", "Second", "First"]
    assert told[5].matched_fraction == 0.0 and told[5].roads == [] and told[5].median_offset_m == 0.0
    assert told[6].matched_fraction == 0.0
    wide = mapmatch.on_geometry(tracks(spark, TRACKS).filter("track_id = 6"), segments, Roads(gate_m=60.0))
    assert [r.matched for r in wide.collect()] == [True, True]
    assert mapmatch.on_geometry(tracks(spark, []), segments).collect() == []
    found.unpersist()


def grid(spark, size=4, spacing=200.0):
    at = lambda r, c: r * size + c
    nodes = spark.createDataFrame([(at(r, c), c * spacing, r * spacing) for r in range(size) for c in range(size)], "osm_id long, e_m double, n_m double")
    pairs = [(at(r, c), at(r + dr, c + dc)) for r in range(size) for c in range(size) for dr, dc in ((0, 1), (1, 0)) if r + dr < size and c + dc < size]
    ways = spark.createDataFrame([(i, [a, b], f"W{i}", "residential", None) for i, (a, b) in enumerate(pairs)], "way long, osm_ids array<long>, name string, class string, oneway string")
    return routing.graph(nodes, ways)


def laid(nodes, edges):
    end = lambda k, e, n: nodes.selectExpr(f"node AS {k}", f"e_m AS {e}", f"n_m AS {n}")
    return edges.join(end("u", "ax", "ay"), "u").join(end("v", "bx", "by"), "v").selectExpr("edge AS seg_id", "way AS way_id", "ax", "ay", "bx", "by")


def test_routes_on_a_grid(spark):
    """Of 100 requests with three goals each: as Dijkstra by hand; one block apart is two sides; out of budget is null."""
    nodes, edges, _ = grid(spark)
    e = [tuple(r) for r in edges.select("edge", "u", "v", "length_m").collect()]
    by = {x[0]: x for x in e}
    assert len(e) == 24 and all(x[3] == 200.0 for x in e)
    place = {r.node: (r.e_m, r.n_m) for r in nodes.collect()}
    near = lambda x, y: min((math.dist((x, y), ((place[u][0] + place[v][0]) / 2, (place[u][1] + place[v][1]) / 2)), k) for k, u, v, _ in e)[1]
    rng = random.Random(1)
    asked = [(-1, near(0, 100), 0.05, 2000.0), (-2, near(0, 100), 0.0, 100.0), (-3, near(0, 100), 0.5, 0.0)] + [(i, rng.randrange(24), rng.random(), rng.choice([50.0, 300.0, 900.0, 3000.0])) for i in range(100)]
    goals = [(-1, 0, near(200, 300), 0.05), (-2, 0, near(600, 500), 1.0), (-3, 0, near(0, 100), 0.7)] + [(i, g, rng.randrange(24), rng.random()) for i in range(100) for g in range(3)]

    def brute(edge, along, budget, goal, goal_along):
        if budget <= 0:
            return None
        if edge == goal:
            return abs(along - goal_along) * 200
        dist, todo = {by[edge][1]: along * 200, by[edge][2]: (1 - along) * 200}, True
        dist = {k: d for k, d in dist.items() if d <= budget}
        while todo:
            todo = False
            for _, u, v, m in e:
                for a, b in ((u, v), (v, u)):
                    if a in dist and dist[a] + m <= budget and dist[a] + m < dist.get(b, math.inf):
                        dist[b], todo = dist[a] + m, True
        return min((dist[n] + rest for n, rest in ((by[goal][1], goal_along * 200), (by[goal][2], (1 - goal_along) * 200)) if n in dist), default=None)

    req = spark.createDataFrame(asked, "route_id long, edge long, along double, budget_m double")
    found = {(r.route_id, r.goal): r for r in routing.routes(edges, req, spark.createDataFrame(goals, "route_id long, goal int, edge long, along double")).collect()}
    own = {a[0]: a for a in asked}
    assert len(found) == len(goals)
    for i, g, edge, along in goals:
        want = brute(*own[i][1:], edge, along)
        assert found[i, g].distance_m == (want if want is None else pytest.approx(want)), (i, g)
    assert found[-1, 0].distance_m == pytest.approx(400, abs=30) and found[-2, 0].distance_m is None and found[-3, 0].distance_m is None
    assert len(found[-1, 0].nodes) >= 2


def test_matching_on_a_graph(spark):
    nodes, edges, ways = grid(spark)
    found = mapmatch.on_graph(tracks(spark, [[(20, 0), (180, 0), (380, 0)]]), laid(nodes, edges), edges)
    assert [r.matched for r in found.orderBy("fix_no").collect()] == [True] * 3
    driven = mapmatch.legs(found.join(tracks(spark, [[(20, 0), (180, 0), (380, 0)]]).drop("t_s"), ["track_id", "fix_no"]), nodes, edges).collect()
    assert {r.fix_no for r in driven} == {0, 1} and max(r.e_m for r in driven) == 380.0
    gaps = mapmatch.on_graph(tracks(spark, [[(20, 0), (9000, 9000), (380, 0)]]), laid(nodes, edges), edges)
    assert [r.matched for r in gaps.orderBy("fix_no").collect()] == [True, False, True]
    gate = mapmatch.on_graph(tracks(spark, [[(20, 0), (100, 100), (380, 0)]]), laid(nodes, edges), edges, Roads(gate_m=25.0))
    assert [r.matched for r in gate.orderBy("fix_no").collect()] == [True, False, True]


def test_distances_between_edges(spark):
    """Of random points on edges: as routes finds them, request by request."""
    nodes, edges, _ = grid(spark)
    spots = [0.0, 1.0, 0.05, 0.25, 0.5, 0.7]
    rng = random.Random(3)
    steps = [(i, rng.randrange(24), rng.choice(spots), rng.randrange(24), rng.choice(spots), rng.choice([0.5, 60.0, 200.0, 450.0, 900.0, 3000.0])) for i in range(400)] + [(400, 3, 0.2, 3, 0.9, 1.0)]
    asked = spark.createDataFrame(steps, "route_id long, edge long, along double, goal_edge long, goal_along double, budget_m double")
    pairs = asked.groupBy("edge", "goal_edge").agg(F.max("budget_m").alias("budget_m"))
    own = asked.join(routing.edge_distances(edges, pairs), ["edge", "goal_edge"]).select("route_id", routing.along_edges().alias("m")).collect()
    goals = asked.select("route_id", F.lit(0).alias("goal"), F.col("goal_edge").alias("edge"), F.col("goal_along").alias("along"))
    want = {r.route_id: r.distance_m for r in routing.routes(edges, asked.select("route_id", "edge", "along", "budget_m"), goals).collect()}
    assert len(own) == len(want) == 401 and 0 < sum(m is None for m in want.values()) < 300
    assert {r.route_id: r.m for r in own} == {i: m if m is None else pytest.approx(m) for i, m in want.items()}


def test_a_crossing_is_equally_far_on_all_its_edges(spark):
    """To the last bit, whatever the lengths: ties between candidates hang on it."""
    rng = random.Random(5)
    nodes = spark.createDataFrame([(i, round(i % 5 * 300 + rng.random() * 40, 1), round(i // 5 * 300 + rng.random() * 40, 1)) for i in range(25)], "osm_id long, e_m double, n_m double")
    ways = spark.createDataFrame([(w, [w * 5 + i if w < 5 else w - 5 + i * 5 for i in range(5)], None, None, None) for w in range(10)], "way long, osm_ids array<long>, name string, class string, oneway string")
    _, edges, _ = routing.graph(nodes, ways)
    ends = edges.select(F.explode(F.array(F.struct("edge", F.lit(0.0).alias("along"), F.col("u").alias("node")), F.struct("edge", F.lit(1.0).alias("along"), F.col("v").alias("node")))).alias("x")).select("x.*")
    both = ends.crossJoin(ends.select(F.col("edge").alias("goal_edge"), F.col("along").alias("goal_along"), F.col("node").alias("goal"))).filter("edge <> goal_edge").withColumn("budget_m", F.lit(5000.0))
    table = routing.edge_distances(edges, both.groupBy("edge", "goal_edge").agg(F.max("budget_m").alias("budget_m")))
    told = both.join(table, ["edge", "goal_edge"]).withColumn("m", routing.along_edges()).filter("node <> goal").groupBy("node", "goal").agg(F.count_distinct("m").alias("n")).collect()
    assert len(told) == 25 * 24 and all(r.n == 1 for r in told)


def test_more_tracks_on_the_same_roads_search_no_further(spark, monkeypatch):
    nodes, edges, _ = grid(spark)
    rng = random.Random(11)
    driven = [[(rng.uniform(0, 600), rng.randrange(4) * 200 + 5), (rng.randrange(4) * 200 - 5, rng.uniform(0, 600))] * 2 for _ in range(120)]
    sizes = {}
    for n in (60, 120):
        rows = [(t, i * 300.0, i, float(e), float(k)) for t, points in enumerate(driven[:n]) for i, (e, k) in enumerate(points)]
        fixes = spark.createDataFrame(rows, "track_id long, t_s double, fix_no long, e_m double, n_m double")
        seen = []
        monkeypatch.setattr(routing, "written", lambda df, name, of=stages.written, seen=seen: seen.append((name, (out := of(df, name)).count())) or out)
        assert mapmatch.on_graph(fixes, laid(nodes, edges), edges).filter("matched").count() == n * 4
        sizes[n] = max(k for name, k in seen if name == "round")
        monkeypatch.undo()
    assert sizes[120] <= 16 * 16  # the nodes as seen from each of them, not from each fix


def test_only_the_network_near_the_fixes_is_measured(spark, monkeypatch):
    nodes, edges, _ = grid(spark, 8)
    rng = random.Random(13)
    fixes = tracks(spark, [[(rng.uniform(0, 200), rng.uniform(0, 200)) for _ in range(4)] for _ in range(1)])
    near, sent = roads.nearest, []
    monkeypatch.setattr(roads, "nearest", lambda p, s, *a, **k: sent.append(s.select("seg_id").collect()) or near(p, s, *a, **k))
    found = {(r.point_id, str(r.found)) for r in near(fixes.selectExpr("fix_no AS point_id", "e_m", "n_m"), laid(nodes, edges), 30.0, 6, one_per_way=True).collect()}
    kept = roads.reached(laid(nodes, edges), fixes, 30.0)
    assert {(r.point_id, str(r.found)) for r in near(fixes.selectExpr("fix_no AS point_id", "e_m", "n_m"), kept, 30.0, 6, one_per_way=True).collect()} == found
    mapmatch.on_graph(fixes, laid(nodes, edges), edges)
    assert 0 < len(sent[0]) <= 24 and len(sent[0]) == len(set(sent[0]))  # of 112
    none = fixes.filter("fix_no < 0")
    assert mapmatch.on_graph(none, laid(nodes, edges), edges).collect() == []


def test_a_near_road_out_of_reach_is_not_taken(spark):
    nodes = spark.createDataFrame([(10, 0.0, 0.0), (11, 400.0, 0.0), (12, 0.0, 40.0), (13, 400.0, 40.0)], "osm_id long, e_m double, n_m double")
    ways = spark.createDataFrame([(0, [10, 11], "Joined", "residential", "no"), (1, [12, 99, 12, 13], "Apart", "residential", "-1")], "way long, osm_ids array<long>, name string, class string, oneway string")
    nodes, edges, kept = routing.graph(nodes, ways)
    assert [tuple(r) for r in edges.orderBy("edge").collect()] == [(0, 0, 1, 0, 400.0), (1, 2, 3, 1, 400.0)]  # no edge over the node without a place
    assert [r.oneway for r in kept.orderBy("way").collect()] == [0, -1]
    found = mapmatch.on_graph(tracks(spark, [[(20, 0), (200, 19), (380, 19)]]), laid(nodes, edges), edges)
    assert mapmatch.summary(found, kept.selectExpr("way AS way_id", "name")).first().roads == ["Joined"]


@pytest.mark.parametrize("settle", [2, 5, 4096])
def test_search_by_brute_force(monkeypatch, settle):
    """The chosen candidates are those of the best of all ways, run by run, however early the search settles."""
    monkeypatch.setattr(mapmatch, "SETTLE", settle)
    rng = random.Random(settle)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 2, 3, 3]) for _ in range(rng.randint(1, 9))]
        emissions = [[rng.uniform(-3, 0) for _ in range(n)] for n in sizes]
        steps = [None] + [[[None if rng.random() < 0.3 else rng.uniform(-3, 1) for _ in range(n)] for _ in range(m)] for m, n in zip(sizes, sizes[1:], strict=False)]
        search, got = mapmatch.Search(), []
        for i, (e, s) in enumerate(zip(emissions, steps, strict=True)):
            got += search.feed(i, e, s)
        got += search.end()
        assert [i for i, _ in got] == list(range(len(sizes)))
        score, back = [], []
        for i, e in enumerate(emissions):
            row = []
            for k, x in enumerate(e):
                ways = [(score[-1][j] + steps[i][j][k] + x, -j) for j in range(len(score[-1])) if steps[i][j][k] is not None] if i else []
                row.append((max(ways)[0], -max(ways)[1]) if ways else (x, -1))
            score.append([x for x, _ in row])
            back.append([j for _, j in row])
        want, k = {}, -1
        for i in range(len(sizes) - 1, -1, -1):
            if not sizes[i]:
                want[i], k = None, -1
                continue
            k = score[i].index(max(score[i])) if k < 0 else k
            want[i], k = k, back[i][k]
        assert dict(got) == want


@pytest.mark.parametrize("one_per_way", [False, True])
def test_copies_of_a_segment_are_measured_once(spark, monkeypatch, one_per_way):
    rng = random.Random(7)
    places = [(x := rng.randrange(0, 200) * 1.0, y := rng.randrange(0, 200) * 1.0, x + rng.choice([0, 60, 120]), y + rng.choice([0, 40])) for _ in range(25)]
    rows = [(i, i * 5 % 7, *places[i * 3 % 25]) for i in range(500)]
    points = [(k, rng.uniform(-20, 220), rng.uniform(-20, 220)) for k in range(60)]
    segments = spark.createDataFrame(rows, "seg_id long, way_id long, ax double, ay double, bx double, by double")
    sent = []
    monkeypatch.setattr(roads, "cells", lambda s, *a, of=roads.cells: sent.append(s.count()) or of(s, *a))
    found = roads.candidates(spark.createDataFrame(points, "point_id long, e_m double, n_m double"), segments, 30.0, 6, one_per_way)

    def offset(e, n, ax, ay, bx, by):
        sq = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((e - ax) * (bx - ax) + (n - ay) * (by - ay)) / sq)) if sq else 0.0
        return math.hypot(e - ax - t * (bx - ax), n - ay - t * (by - ay))

    want = set()
    for k, e, n in points:
        near, ways = [], set()
        for d, s, w in sorted((offset(e, n, *at), s, w) for s, w, *at in rows):
            if d <= 30 and not (one_per_way and w in ways):
                near.append((k, s, len(near) + 1))
                ways.add(w)
        want |= set(near[:6])
    assert {(r.point_id, r.seg_id, r.rank) for r in found.collect()} == want
    assert sent[0] <= 25 * (7 if one_per_way else 1)  # not the 500


def test_equally_near_places_mix_by_number(spark):
    """Copies of two segments on both sides of a point, of one nearer by far and of one farther: equal ones follow each other by their numbers, whichever place they are of."""
    sides = {0: -5.0, 1: 5.0}
    rows = [(i, i % 6, sides[i % 2], 0.0, sides[i % 2], 100.0) for i in range(40)] + [(100, 0, 1.0, 0.0, 1.0, 100.0), (50, 0, 9.0, 0.0, 9.0, 100.0)]
    segments = spark.createDataFrame(rows, "seg_id long, way_id long, ax double, ay double, bx double, by double")
    found = roads.candidates(spark.createDataFrame([(0, 0.0, 50.0)], "point_id long, e_m double, n_m double"), segments, 30.0, 8).orderBy("rank").collect()
    assert [r.seg_id for r in found] == [100, 0, 1, 2, 3, 4, 5, 6]
    matched = mapmatch.on_geometry(tracks(spark, [[(0.0, 20.0), (0.0, 80.0)]]), segments.filter("seg_id < 40 AND way_id <> 0 AND seg_id <> 1")).orderBy("fix_no").collect()
    assert [(r.seg_id, r.way_id, r.px) for r in matched] == [(2, 2, -5.0)] * 2
