"""Map matching: which road each fix of a track is on, as the likeliest way through the candidates of all its fixes.

Candidates, their scores and the scores of all steps between those of neighbouring fixes are columns; what is sequential, the
search for the likeliest way, streams the sorted fixes of one track after another and keeps a byte for each candidate of the
stretch that is still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import DEFAULT, Roads
from driftline.functions.geo import length
from driftline.functions.stages import written

from . import roads, routing

#: Open fixes after which the search looks for a candidate that all ways share, and settles what lies before it.
SETTLE = 4096
ORDER = ("t_s", "fix_no")


class Search:
    """The likeliest way through one track, fed fix by fix. Gives (fix, chosen candidate or None) as soon as nothing can change it."""

    def __init__(self) -> None:
        self.fixes: list = []
        self.back: list[list[int] | None] = []
        self.scores: list[list[float] | None] = []
        self.settled = 0  # open fixes at which a trace was last tried

    def feed(self, fix, emissions: list[float], steps: list[list[float | None]] | None) -> Iterator[tuple]:
        if not emissions:
            yield from self.end()
            yield fix, None
            return
        last = self.scores[-1] if self.scores else None
        if not steps or last is None:
            back, scores = [-1] * len(emissions), list(emissions)
        else:
            back, scores = [], []
            for k, e in enumerate(emissions):
                best, of = None, -1
                for j, s in enumerate(last):
                    if (step := steps[j][k]) is not None and (best is None or s + step + e > best):
                        best, of = s + step + e, j
                scores.append(e if best is None else best)
                back.append(of)
        self.fixes.append(fix)
        self.back.append(back)
        self.scores.append(scores)
        if len(self.fixes) - self.settled >= SETTLE:
            yield from self.settle()

    def settle(self) -> Iterator[tuple]:
        """Gives what is the same on the ways of all candidates of the last fix; the fix where they meet stays open."""
        alive, i = set(range(len(self.back[-1]))), len(self.back) - 1
        while i and len(alive) > 1 and -1 not in alive:
            alive = {self.back[i][k] for k in alive}
            i -= 1
        if len(alive) == 1 and -1 not in alive and i:
            yield from self.trace(i, alive.pop())
            del self.fixes[:i], self.back[:i], self.scores[:i]
        self.settled = len(self.fixes)

    def trace(self, end: int, k: int) -> Iterator[tuple]:
        """Chosen candidates before fix end, given the one there."""
        chosen = []
        for i in range(end, 0, -1):
            k = self.back[i][k]
            if k < 0:  # a new run began here; the one before ends at its own best
                k = max(range(len(self.scores[i - 1])), key=self.scores[i - 1].__getitem__)
            chosen.append(k)
        yield from zip(self.fixes[:end], reversed(chosen), strict=True)

    def end(self) -> Iterator[tuple]:
        if self.fixes:
            last = len(self.fixes) - 1
            k = max(range(len(self.scores[last])), key=self.scores[last].__getitem__)
            yield from self.trace(last, k)
            yield self.fixes[last], k
        self.__init__()


def likeliest(rows: DataFrame, dealt: bool = False) -> DataFrame:
    """track_id, fix_no, chosen: the number (from 0) of the candidate that the likeliest way takes at every fix, null where there is none.

    rows: track_id, t_s, fix_no, emissions (a log score for each candidate), steps (for each candidate of the fix before, a log score
    to each of this fix; null entries can't be). A fix without candidates, or none of whose steps can be, starts a new run; each run
    ends at its best. Of equal scores the earlier candidate counts. Rows of a track lie in one task, in order, but are not gathered; if
    they are dealt, they lie so already.
    """
    kind = rows.schema["track_id"].dataType.simpleString(), rows.schema["fix_no"].dataType.simpleString()
    sent = rows.select("track_id", *ORDER, "emissions", "steps")
    sent = (sent if dealt else sent.repartition("track_id")).sortWithinPartitions("track_id", *ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        search, track, out = Search(), None, []
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array([t for t, _, _ in out], types[0]), pa.array([f for _, f, _ in out], types[1]), pa.array([k for _, _, k in out], pa.int32())], ["track_id", "fix_no", "chosen"])
        for b in batches:
            types = types or (b.schema.field("track_id").type, b.schema.field("fix_no").type)
            for t, fix, emissions, steps in zip(*(b.column(c).to_pylist() for c in ("track_id", "fix_no", "emissions", "steps")), strict=True):
                if t != track:
                    out += [(track, f, k) for f, k in search.end()]
                    track = t
                out += [(t, f, k) for f, k in search.feed(fix, emissions or [], steps)]
            if len(out) > 4096:
                yield pack(out)
                out = []
        out += [(track, f, k) for f, k in search.end()]
        if out:
            yield pack(out)

    return sent.mapInArrow(run, f"track_id {kind[0]}, fix_no {kind[1]}, chosen int")


def emission(config: Roads) -> Column:
    return F.expr(f"transform(own, c -> -0.5D * (c.offset_m / {config.sigma_m}D) * (c.offset_m / {config.sigma_m}D))")


def listed(fixes: DataFrame, found: DataFrame) -> DataFrame:
    """The fixes with own, their candidates in order, those of the fix before, and the straight distance from there."""
    lists = found.withColumnRenamed("found", "own")
    every = fixes.withColumn("point_id", F.struct("track_id", "fix_no")).join(lists, "point_id", "left")
    w = Window.partitionBy("track_id").orderBy(*ORDER)
    return every.withColumns({"before": F.lag("own").over(w), "straight_m": length(F.col("e_m") - F.lag("e_m").over(w), F.col("n_m") - F.lag("n_m").over(w))}).drop("point_id", "e_m", "n_m")


def chosen(rows: DataFrame, found: DataFrame, segments: DataFrame) -> DataFrame:
    """What the likeliest way found: track_id, fix_no, matched, seg_id, way_id, along, px, py, road_e, road_n, offset_m, exact_m, bearing_deg of all fixes; road_e, road_n and offset_m are px, py and exact_m to 0.1 m."""
    best = rows.select("track_id", *ORDER, "own").join(found, ["track_id", "fix_no"])
    own = best.withColumn("c", F.expr("get(own, chosen)")).select("track_id", *ORDER, F.col("c").isNotNull().alias("matched"), "c.seg_id", "c.way_id", "c.along", "c.px", "c.py", "c.offset_m")
    bearing = F.pmod(F.degrees(F.atan2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), F.lit(360.0))
    return own.join(segments.select("seg_id", F.round(bearing, 1).alias("bearing_deg")), "seg_id", "left").select("track_id", *ORDER, "matched", "seg_id", "way_id", "along", "px", "py", F.round("px", 1).alias("road_e"), F.round("py", 1).alias("road_n"), F.round("offset_m", 1).alias("offset_m"), F.col("offset_m").alias("exact_m"), "bearing_deg")


def on_geometry(fixes: DataFrame, segments: DataFrame, config: Roads = DEFAULT.roads) -> DataFrame:
    """Fixes (track_id, t_s, fix_no, e_m, n_m) on segments: near ones are likely, and so are steps as long as the straight line, along one way.

    A fix without a segment within the gate stays unmatched and breaks its track into runs. A track of one fix is a run.
    """
    points = fixes.select(F.struct("track_id", "fix_no").alias("point_id"), "e_m", "n_m")
    rows = written(listed(fixes, roads.nearest(points, segments, config.gate_m, config.geometry_candidates, cell_m=config.cell_m)), "listed")
    step = f"-abs(sqrt((c.px - p.px) * (c.px - p.px) + (c.py - p.py) * (c.py - p.py)) - straight_m) / {config.beta_m}D + IF(c.way_id = p.way_id, {config.same_way_bonus}D, 0D)"
    return chosen(rows, likeliest(rows.withColumns({"emissions": emission(config), "steps": F.expr(f"transform(before, p -> transform(own, c -> {step}))")})), segments)


def budget(config: Roads) -> Column:
    return F.least(F.lit(config.cap_m), F.col("straight_m") * 2 + config.slack_m)


def on_graph(fixes: DataFrame, segments: DataFrame, edges: DataFrame, config: Roads = DEFAULT.roads) -> DataFrame:
    """As on_geometry, but steps count as long as the way on the graph. segments are the edges' places, with seg_id as edge.

    Candidates are the nearest edge of each way. Short steps are measured straight. A fix that no candidate before it reaches starts
    a new run. Tracks share roads, so the ways between the ends of edges are searched, once for each pair of edges that any step asks for.
    """
    points = fixes.select(F.struct("track_id", "fix_no").alias("point_id"), "e_m", "n_m")
    segments = roads.reached(segments, points, config.gate_m, config.cell_m)
    rows = written(listed(fixes, roads.nearest(points, segments, config.gate_m, config.graph_candidates, one_per_way=True, cell_m=config.cell_m)), "listed")
    far = rows.filter(F.col("own").isNotNull() & F.col("before").isNotNull() & (F.col("straight_m") > config.near_field_m)).withColumn("budget_m", budget(config)).filter("budget_m > 0")
    pairs = far.select("track_id", *ORDER, "budget_m", "straight_m", "own", F.posexplode("before").alias("j", "p")).select("track_id", *ORDER, "budget_m", "straight_m", "j", "p", F.posexplode("own").alias("k", "c"))
    pairs = pairs.select("track_id", *ORDER, "budget_m", "straight_m", "j", "k", F.col("p.seg_id").alias("edge"), F.col("p.along").alias("along"), F.col("c.seg_id").alias("goal_edge"), F.col("c.along").alias("goal_along"))
    between = written(routing.edge_distances(edges, pairs.groupBy("edge", "goal_edge").agg(F.max("budget_m").alias("budget_m"))), "between")
    asked = pairs.join(between, ["edge", "goal_edge"]).withColumn("m", routing.along_edges()).filter("m IS NOT NULL")
    cost = f"-abs(m - straight_m) / {config.beta_m}D"
    near = f"transform(before, p -> transform(own, c -> {cost.replace('(m', '(sqrt((c.px - p.px) * (c.px - p.px) + (c.py - p.py) * (c.py - p.py))')}))"
    routed = asked.select("track_id", *ORDER, (F.col("j") * 64 + F.col("k")).alias("at"), F.expr(cost).alias("step"))
    # The fixes and their routed steps meet in the exchange by track that the search needs, and in no other.
    each = rows.select("track_id", *ORDER, emission(config).alias("emissions"), F.size("before").alias("n_before"), F.when(F.col("straight_m") <= config.near_field_m, F.expr(near)).alias("near"))
    met = each.unionByName(routed, allowMissingColumns=True).repartition("track_id").groupBy("track_id", *ORDER).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("emissions", "n_before", "near")), F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "step"))).alias("ways"))
    steps = "transform(sequence(0, n_before - 1), j -> transform(emissions, (e, k) -> try_element_at(map_from_entries(ways), j * 64 + k)))"
    return chosen(rows, likeliest(met.withColumn("steps", F.when(F.size("ways") > 0, F.expr(steps)).otherwise(F.col("near"))), dealt=True), segments)


def summary(matches: DataFrame, ways: DataFrame) -> DataFrame:
    """track_id, n_fixes, n_matched, matched_fraction, median_offset_m (the upper one), roads: names along the track, repeats in a row once."""
    matches = written(matches, "matches")  # read by three groupings
    named = matches.join(ways.select("way_id", "name"), "way_id", "left")
    w = Window.partitionBy("track_id").orderBy(*ORDER)
    spoken = named.filter("name IS NOT NULL").withColumn("was", F.lag("name").over(w)).filter("was IS NULL OR was <> name")
    roads_ = spoken.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "name"))).alias("r")).select("track_id", F.expr("transform(r, x -> x.name)").alias("roads"))
    counts = matches.groupBy("track_id").agg(F.count("*").alias("n_fixes"), F.count_if("matched").alias("n_matched"))
    # The upper median by rank, so that a long track's offsets are never gathered.
    ranked = matches.filter("matched").select("track_id", "offset_m", F.row_number().over(Window.partitionBy("track_id").orderBy("offset_m")).alias("k"))
    median = ranked.join(counts, "track_id").filter("k = n_matched div 2 + 1").select("track_id", F.round("offset_m", 1).alias("median_offset_m"))
    return counts.join(median, "track_id", "left").join(roads_, "track_id", "left").select("track_id", "n_fixes", "n_matched", F.round(F.col("n_matched") / F.col("n_fixes"), 2).alias("matched_fraction"), F.coalesce("median_offset_m", F.lit(0.0)).alias("median_offset_m"), F.coalesce("roads", F.array().cast("array<string>")).alias("roads"))


def legs(matches: DataFrame, nodes: DataFrame, edges: DataFrame, config: Roads = DEFAULT.roads) -> DataFrame:
    """track_id, fix_no (of the leg's first fix), pos, e_m, n_m: the way on the graph between neighbouring matched fixes, where there is one.

    matches: as on_graph gives, with the fixes' own e_m and n_m.
    """
    w = Window.partitionBy("track_id").orderBy(*ORDER)
    after = matches.select("track_id", "fix_no", "seg_id", "along", "px", "py", F.lead(F.struct("seg_id", "along", "px", "py")).over(w).alias("to"), length(F.lead("e_m").over(w) - F.col("e_m"), F.lead("n_m").over(w) - F.col("n_m")).alias("straight_m"))
    pairs = written(after.filter("seg_id IS NOT NULL AND to.seg_id IS NOT NULL").select(F.struct("track_id", "fix_no").alias("route_id"), F.lit(0).alias("goal"), "seg_id", "along", "px", "py", "to", budget(config).alias("budget_m")), "pairs")
    found = routing.routes(edges, pairs.select("route_id", F.col("seg_id").alias("edge"), "along", "budget_m"), pairs.select("route_id", "goal", F.col("to.seg_id").alias("edge"), F.col("to.along").alias("along")))
    points = routing.path_points(found, nodes, pairs.select("route_id", F.col("px").alias("e_m"), F.col("py").alias("n_m")), pairs.select("route_id", "goal", F.col("to.px").alias("e_m"), F.col("to.py").alias("n_m")))
    return points.select("route_id.track_id", "route_id.fix_no", "pos", F.round("e_m", 1).alias("e_m"), F.round("n_m", 1).alias("n_m"))


def trace(matches: DataFrame, until_s: Column) -> DataFrame:
    """track_id, run, fix_no, pos, e_m, n_m of matched runs up to a clock, and unmatched fixes at their own place with run null.

    matches: with the fixes' own e_m and n_m. A run ends at an unmatched fix; a run of one point stays.
    """
    w = Window.partitionBy("track_id").orderBy(*ORDER)
    seen = matches.filter(F.col("t_s") <= until_s).withColumn("starts", F.col("matched") & ~F.coalesce(F.lag("matched").over(w), F.lit(False)))
    runs = seen.withColumn("run", F.when(F.col("matched"), F.sum(F.col("starts").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    pos = F.when(F.col("matched"), F.row_number().over(Window.partitionBy("track_id", "run").orderBy(*ORDER)))
    return runs.select("track_id", "run", "fix_no", pos.alias("pos"), F.coalesce("road_e", "e_m").alias("e_m"), F.coalesce("road_n", "n_m").alias("n_m"))
