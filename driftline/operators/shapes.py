"""Lines and rings given as ordered points: area and centroid, whole-metre deltas, extents, tiles.

Points of one shape are ordered by a window on its id; everything else is sums, minima and maxima that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.groups import whole
from driftline.functions.stages import written

TILE_M = 2000.0
#: Twice the signed area below which a ring counts as degenerate.
FLAT = 1e-9


def ring_shape(points: DataFrame) -> DataFrame:
    """shape_id, points, area_m2, centre_e, centre_n of closed rings (shape_id, pos, e_m, n_m).

    The last point joins the first. A ring without area, such as one point, has the mean of its points as centre.
    """
    order = Window.partitionBy("shape_id").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    turn = F.col("e_m") * F.col("n2") - F.col("e2") * F.col("n_m")
    sides = points.select("shape_id", "e_m", "n_m", after("e_m").alias("e2"), after("n_m").alias("n2")).withColumn("turn", turn)
    sums = sides.groupBy("shape_id").agg(
        F.count("*").alias("points"), F.sum("turn").alias("twice"), F.avg("e_m").alias("mean_e"), F.avg("n_m").alias("mean_n"),
        F.sum((F.col("e_m") + F.col("e2")) * F.col("turn")).alias("moment_e"), F.sum((F.col("n_m") + F.col("n2")) * F.col("turn")).alias("moment_n"),
    )
    flat = F.abs("twice") < FLAT
    centre = lambda x: F.when(flat, F.col(f"mean_{x}")).otherwise(F.col(f"moment_{x}") / (3 * F.col("twice"))).alias(f"centre_{x}")
    return sums.select("shape_id", "points", (F.abs("twice") / 2).alias("area_m2"), centre("e"), centre("n"))


def encoded(points: DataFrame) -> DataFrame:
    """shape_id, pos, de, dn: whole metres (halves to even), the first point as it is, later ones as steps; repeated points are left out."""
    order = Window.partitionBy("shape_id").orderBy("pos")
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0))
    whole = points.select("shape_id", "pos", F.bround("e_m").cast("long").alias("e"), F.bround("n_m").cast("long").alias("n"))
    steps = whole.select("shape_id", "pos", step("e").alias("de"), step("n").alias("dn"), F.row_number().over(order).alias("k"))
    return steps.filter("k = 1 OR de <> 0 OR dn <> 0").drop("k")


def decoded(steps: DataFrame) -> DataFrame:
    """shape_id, pos, e, n of encoded steps."""
    so_far = Window.partitionBy("shape_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("shape_id", "pos", F.sum("de").over(so_far).alias("e"), F.sum("dn").over(so_far).alias("n"))


def extent(points: DataFrame, *by: str) -> DataFrame:
    """points, west, south, east, north of all points, or of each group."""
    return points.groupBy(*by).agg(F.count("*").alias("points"), F.min("e_m").alias("west"), F.min("n_m").alias("south"), F.max("e_m").alias("east"), F.max("n_m").alias("north"))


def tiles(points: DataFrame, side: float = TILE_M) -> DataFrame:
    """tile_e, tile_n, shapes and the union of their boxes: a shape of two points or more is in the tile of its box's middle."""
    boxes = extent(points, "shape_id").filter("points >= 2")
    cell = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / side).cast("long")
    placed = boxes.withColumns({"tile_e": cell("west", "east"), "tile_n": cell("south", "north")})
    return placed.groupBy("tile_e", "tile_n").agg(F.count("*").alias("shapes"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


#: Points of the longest line that a task simplifies together with others; longer ones are split piece by piece over tasks.
SHORT = 2048


def stays(line: np.ndarray, e: np.ndarray, n: np.ndarray, tolerance_m: float) -> np.ndarray:
    """Whether each point of many lines (line ascending, points in order, finite) stays. All pieces of all lines split side by side."""
    first = np.flatnonzero(np.diff(line, prepend=line[:1] - 1))
    last = np.append(first[1:], len(line)) - 1
    kept = np.zeros(len(line), bool)
    kept[first] = kept[last] = True
    at = np.flatnonzero(~kept)
    own = np.searchsorted(first, at, "right") - 1
    a, b = first[own], last[own]
    while len(at):
        dx, dy, px, py = e[b] - e[a], n[b] - n[a], e[at] - e[a], n[at] - n[a]
        long_ = dx * dx + dy * dy
        t = np.maximum(0.0, np.minimum(1.0, np.divide(px * dx + py * dy, long_, out=np.zeros_like(long_), where=long_ != 0)))
        off = (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)
        begins = np.flatnonzero(np.diff(a, prepend=-1))
        sizes = np.diff(begins, append=len(at))
        most = np.maximum.reduceat(off, begins)
        top = np.flatnonzero(off == np.repeat(most, sizes))
        split = at[top[np.searchsorted(top, begins)]]  # the first of equals
        kept[split[most > tolerance_m * tolerance_m]] = True
        s = np.repeat(split, sizes)
        on = np.repeat(most > tolerance_m * tolerance_m, sizes) & (at != s)
        at, a, b, s = at[on], a[on], b[on], s[on]
        a, b = np.where(at > s, s, a), np.where(at < s, s, b)
    return kept


def simplified(points: DataFrame, tolerance_m: float) -> DataFrame:
    """shape_id, pos of the points of each line (shape_id, pos, e_m, n_m) that stay: ends, and while a point is farther than the
    tolerance from the piece between two that stay, the farthest, the first of equals.

    Lines of up to SHORT points are settled in one pass, many at once. All pieces of all longer lines split side by side, round by
    round; a piece is a key, so a long line spreads over tasks, and points of finished pieces leave. So do lines with a coordinate
    that is no finite number. A line of two points or fewer stays as it is.
    """
    odd = F.coalesce(F.isnan("e_m") | F.isnan("n_m") | (F.abs("e_m") == float("inf")) | (F.abs("n_m") == float("inf")), F.lit(True))
    sized = points.select("shape_id", "pos", F.col("e_m").cast("double").alias("e_m"), F.col("n_m").cast("double").alias("n_m"))
    lines = written(sized, "lines")
    sizes = lines.groupBy("shape_id").agg(F.count("*").alias("n"), F.max(odd).alias("odd"))
    far = sizes.filter(F.col("odd") | (F.col("n") > SHORT)).select("shape_id")
    schema = T.StructType([points.schema["shape_id"], points.schema["pos"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, line in whole(batches, ("shape_id",)):
            on = stays(line, table.column("e_m").to_numpy(), table.column("n_m").to_numpy(), tolerance_m)
            yield from table.select(["shape_id", "pos"]).filter(pa.array(on)).combine_chunks().to_batches()

    long_ = written(far, "long")
    near = lines.join(long_, "shape_id", "left_anti")
    settled = near.repartition("shape_id").sortWithinPartitions("shape_id", "pos").mapInArrow(run, schema)
    if long_.isEmpty():
        return settled
    return settled.unionByName(_by_rounds(lines.join(long_, "shape_id", "left_semi"), tolerance_m))


def _by_rounds(points: DataFrame, tolerance_m: float) -> DataFrame:
    ends = points.groupBy("shape_id").agg(F.min(F.struct("pos", "e_m", "n_m")).alias("a"), F.max(F.struct("pos", "e_m", "n_m")).alias("b"))
    kept = [ends.select("shape_id", F.explode(F.array_distinct(F.array("a.pos", "b.pos"))).alias("pos"))]
    open_ = written(points.join(ends, "shape_id").filter("pos > a.pos AND pos < b.pos").select("shape_id", "pos", "e_m", "n_m", "a", "b"), "line")
    dx, dy = F.col("b.e_m") - F.col("a.e_m"), F.col("b.n_m") - F.col("a.n_m")
    px, py, long_ = F.col("e_m") - F.col("a.e_m"), F.col("n_m") - F.col("a.n_m"), dx * dx + dy * dy
    t = F.when(long_ == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / long_)))
    off = (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)
    while not open_.isEmpty():
        far = open_.select("shape_id", F.col("a.pos").alias("piece"), off.alias("d2"), "pos", "e_m", "n_m").filter(F.col("d2") > tolerance_m * tolerance_m)
        split = written(far.groupBy("shape_id", "piece").agg(F.max(F.struct("d2", (-F.col("pos")).alias("first"), "e_m", "n_m")).alias("s")).select("shape_id", "piece", F.struct((-F.col("s.first")).alias("pos"), "s.e_m", "s.n_m").alias("s")), "split")
        kept.append(split.select("shape_id", "s.pos"))
        parted = open_.withColumn("piece", F.col("a.pos")).join(split, ["shape_id", "piece"]).filter("pos <> s.pos")
        open_ = written(parted.select("shape_id", "pos", "e_m", "n_m", F.when(F.col("pos") > F.col("s.pos"), F.col("s")).otherwise(F.col("a")).alias("a"), F.when(F.col("pos") < F.col("s.pos"), F.col("s")).otherwise(F.col("b")).alias("b")), "line")
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def clipped_rings(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """shape_id, pos, e_m, n_m of closed rings cut to a box, one side of it after the other. A ring outside has no rows."""
    order = Window.partitionBy("shape_id").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = points.select("shape_id", "pos", "e_m", "n_m")
    for along, across, at, sign in (("e_m", "n_m", west, 1), ("e_m", "n_m", east, -1), ("n_m", "e_m", south, 1), ("n_m", "e_m", north, -1)):
        before = lambda c: F.coalesce(F.lag(c).over(order), F.last(c).over(whole))
        sides = out.select("shape_id", "pos", "e_m", "n_m", before(along).alias("p"), before(across).alias("q"))
        inside, was = (F.col(along) - at) * sign >= 0, (F.col("p") - at) * sign >= 0
        meets = F.col("q") + (F.col(across) - F.col("q")) * (at - F.col("p")) / (F.col(along) - F.col("p"))
        cross = F.when(inside != was, F.struct(F.lit(0).alias("k"), *(F.lit(at).alias(c) if c == along else meets.alias(c) for c in ("e_m", "n_m"))))
        stays = F.when(inside, F.struct(F.lit(1).alias("k"), F.col("e_m").alias("e_m"), F.col("n_m").alias("n_m")))
        made = sides.select("shape_id", "pos", F.explode(F.array_compact(F.array(cross, stays))).alias("x"))
        out = made.select("shape_id", F.row_number().over(Window.partitionBy("shape_id").orderBy("pos", "x.k")).alias("pos"), "x.e_m", "x.n_m")
    return out


def clipped_lines(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """shape_id, run, pos, e_m, n_m: the runs of each line inside a box with one point more on either side; a run has two points at least."""
    order = Window.partitionBy("shape_id").orderBy("pos")
    inside = F.col("e_m").between(west, east) & F.col("n_m").between(south, north)
    near = F.col("inside") | F.coalesce(F.lag("inside").over(order), F.lit(False)) | F.coalesce(F.lead("inside").over(order), F.lit(False))
    seen = points.withColumn("inside", inside).withColumn("near", near).withColumn("starts", F.col("near") & ~F.coalesce(F.lag("near").over(order), F.lit(False)))
    runs = seen.withColumn("run", F.sum(F.col("starts").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("near")
    own = Window.partitionBy("shape_id", "run")
    return runs.withColumn("n", F.count("*").over(own)).filter("n >= 2").select("shape_id", "run", F.row_number().over(own.orderBy("pos")).alias("pos"), "e_m", "n_m")


def stitched(points: DataFrame) -> DataFrame:
    """shape_id, ring, closed, pos, e_m, n_m: member ways (shape_id, way, pos, e_m, n_m) joined end to end.

    At a point where ends of several ways of a shape meet, they join in pairs, in order of way and end. A ring is named by its least
    way; a closed one begins there, as it is drawn; an open one begins at the outer end of lesser way. A way whose ends meet is a ring of
    its own; ways of one point are left out. The order along a ring is found by doubling the reach of each way's successor, in as
    many rounds as the longest ring has binary digits; no ring is gathered.
    """
    tips = points.groupBy("shape_id", "way").agg(F.min(F.struct("pos", "e_m", "n_m")).alias("a"), F.max(F.struct("pos", "e_m", "n_m")).alias("b")).filter("a.pos < b.pos")
    tips = tips.withColumn("own", (F.col("a.e_m") == F.col("b.e_m")) & (F.col("a.n_m") == F.col("b.n_m")))
    ends = tips.filter("NOT own").select("shape_id", "way", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a.e_m").alias("e_m"), F.col("a.n_m").alias("n_m")), F.struct(F.lit(1).alias("side"), F.col("b.e_m").alias("e_m"), F.col("b.n_m").alias("n_m")))).alias("t")).select("shape_id", "way", "t.*")
    place = F.row_number().over(Window.partitionBy("shape_id", "e_m", "n_m").orderBy("way", "side")) - 1
    placed = ends.withColumn("k", place).withColumn("pair", F.floor(F.col("k") / 2))
    partner = Window.partitionBy("shape_id", "e_m", "n_m", "pair").orderBy("k")
    other = F.struct("way", "side")
    met = placed.withColumn("o", F.coalesce(F.lead(other).over(partner), F.lag(other).over(partner)))
    # A walk enters a way by one side and leaves by the other: a state is named by way and the side that it leaves by.
    state = lambda way, out: (F.col(way) * 2 + out).cast("long")
    links = written(met.select("shape_id", "way", state("way", F.col("side")).alias("s"), F.when(F.col("o").isNotNull(), (F.col("o.way") * 2 + 1 - F.col("o.side")).cast("long")).alias("next")), "links")

    def doubled(table: DataFrame, rounds: int, **values) -> DataFrame:
        """Each state's value with those of all that follow it taken in."""
        at = table
        for _ in range(rounds):
            ahead = at.select("shape_id", F.col("s").alias("next"), F.col("next").alias("then"), *(F.col(c).alias(f"{c}_") for c in values))
            step = at.join(ahead, ["shape_id", "next"], "left")
            taken = (F.when(F.col("next").isNull(), F.col(c)).otherwise(f(F.col(c), F.col(f"{c}_"))).alias(c) for c, f in values.items())
            at = written(step.select("shape_id", "s", F.col("then").alias("next"), *taken), "reach")
        return at

    # No ring has more ways than its shape.
    most = tips.groupBy("shape_id").count().agg(F.max("count")).first()[0] or 1
    rounds = max(1, most).bit_length()
    least = doubled(links.withColumn("ring", F.col("way")), rounds, ring=F.least)
    named = least.groupBy("shape_id", F.floor(F.col("s") / 2).alias("way")).agg(F.min("ring").alias("ring"))
    known = links.join(named, ["shape_id", "way"])
    shut = known.groupBy("shape_id", "ring").agg(F.count_if(F.col("next").isNull()).alias("loose")).withColumn("closed", F.col("loose") == 0).drop("loose")
    # A closed ring is cut before its least way, as drawn.
    known = written(known.join(shut, ["shape_id", "ring"]).withColumn("next", F.when(F.col("closed") & (F.col("next") == F.col("ring") * 2 + 1), None).otherwise(F.col("next"))), "known")
    ranked = doubled(known.select("shape_id", "s", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("length"), F.col("s").alias("last")), rounds, length=lambda a, b: a + b, last=lambda a, b: b)
    paths = ranked.join(known.select("shape_id", "s", "ring", "closed"), ["shape_id", "s"])
    begins = paths.groupBy("shape_id", "ring", "closed", "last").agg(F.max(F.struct("length", "s")).alias("first"))
    # Of the two ways round: from the cut for a closed ring, else from the lesser outer way.
    begins = begins.filter(~F.col("closed") | (F.col("first.s") == F.col("ring") * 2 + 1))
    chosen = begins.groupBy("shape_id", "ring").agg(F.min(F.struct(F.floor(F.col("first.s") / 2), (1 - F.col("first.s") % 2), "last", F.col("first.length").alias("length"))).alias("c")).select("shape_id", "ring", "c.last", F.col("c.length").alias("whole"))
    order = paths.join(chosen, ["shape_id", "ring", "last"]).select("shape_id", "ring", "closed", F.floor(F.col("s") / 2).alias("way"), (F.col("s") % 2 == 0).alias("back"), (F.col("whole") - F.col("length")).alias("rank"))
    order = order.unionByName(tips.filter("own").select("shape_id", F.col("way").alias("ring"), F.lit(True).alias("closed"), "way", F.lit(False).alias("back"), F.lit(0).cast("long").alias("rank")))
    span = tips.select("shape_id", "way", F.col("a.pos").alias("lo"), F.col("b.pos").alias("hi"))
    laid = points.join(order, ["shape_id", "way"]).join(span, ["shape_id", "way"]).filter(F.col("rank").eqNullSafe(0) | (F.col("pos") != F.when(F.col("back"), F.col("hi")).otherwise(F.col("lo"))))
    w = Window.partitionBy("shape_id", "ring").orderBy("rank", F.when(F.col("back"), -F.col("pos")).otherwise(F.col("pos")))
    return laid.select("shape_id", "ring", "closed", F.row_number().over(w).alias("pos"), "e_m", "n_m")
