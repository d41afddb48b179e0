"""What a track did up to a clock: its route, distance and stops, its passes of zones, half-hour splits, events and headline.

All parts hang on one exchange by track: legs come from a window over a track's fixes, and every summary is grouped by track.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geo import bearing, length

from .behaviour import stop_spells
from .proximity import with_zones

#: A leg faster than this is a jump of the receiver; minutes in a split; minutes between fixes; metres that count as nearer or further.
OUTLIER_MPS, SPLIT_MIN, STEP_MIN, NET_MOVE_M = 40.0, 30.0, 5.0, 500.0


def route(fixes: DataFrame, clock_s: float) -> DataFrame:
    """track_id, fix_no, t_s, e_m, n_m, complete: fixes up to a clock, and where the track is at it, between its two nearest fixes.

    The added point has no fix_no. complete: whether no fix is later than the clock.
    """
    w, c = Window.partitionBy("track_id").orderBy("t_s", "fix_no"), F.col
    rows = fixes.select("track_id", "fix_no", "t_s", "e_m", "n_m", *(F.lead(x).over(w).alias(f"{x}_1") for x in ("t_s", "e_m", "n_m")))
    share = (F.lit(clock_s) - c("t_s")) / F.nullif(c("t_s_1") - c("t_s"), F.lit(0.0))
    own = F.struct("fix_no", "t_s", "e_m", "n_m")
    added = F.struct(F.lit(None).cast(fixes.schema["fix_no"].dataType).alias("fix_no"), F.lit(clock_s).alias("t_s"), *((c(x) + share * (c(f"{x}_1") - c(x))).alias(x) for x in ("e_m", "n_m")))
    last = (c("t_s_1") > clock_s) & (c("t_s") < clock_s)
    points = rows.filter(c("t_s") <= clock_s).select("track_id", F.explode(F.when(last, F.array(own, added)).otherwise(F.array(own))).alias("p"), (~F.coalesce(c("t_s_1") > clock_s, F.lit(False))).alias("over"))
    return points.select("track_id", "p.*", F.min("over").over(Window.partitionBy("track_id")).alias("complete"))


def legs(points: DataFrame) -> DataFrame:
    """Every leg of a route: ta, ea, na, t_s, e_m, n_m of its ends, dt in minutes, d, mps, moving needs `still_m` of `moving`.

    A route's first point is a leg of no length, so that what holds at the start is seen; other legs without duration are left out.
    """
    w, c = Window.partitionBy("track_id").orderBy("t_s", F.col("fix_no").asc_nulls_last()), F.col
    rows = points.select("*", F.row_number().over(w).alias("leg"), *(F.coalesce(F.lag(x).over(w), c(x)).alias(y) for x, y in (("t_s", "ta"), ("e_m", "ea"), ("n_m", "na"))))
    rows = rows.withColumns({"dt": (c("t_s") - c("ta")) / 60, "d": length(c("e_m") - c("ea"), c("n_m") - c("na"))}).filter("leg = 1 OR dt > 0")
    return rows.withColumn("mps", c("d") / F.nullif(c("dt") * 60, F.lit(0.0)))


def moving(still_m: float) -> Column:
    """Whether a leg counts as movement: more than the stationary distance for its time, and no jump."""
    return (F.col("dt") > 0) & (F.col("d") > F.lit(still_m) * F.col("dt") / STEP_MIN) & (F.col("mps") <= OUTLIER_MPS)


def _nearest(ze: Column, zn: Column) -> tuple[Column, Column]:
    """Distance from a leg to a point, and the minute at which it is that near."""
    c = F.col
    de, dn = c("e_m") - c("ea"), c("n_m") - c("na")
    along = ((ze - c("ea")) * de + (zn - c("na")) * dn) / F.nullif(de * de + dn * dn, F.lit(0.0))
    f = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), along)), F.lit(0.0))
    return length(c("ea") + de * f - ze, c("na") + dn * f - zn), c("ta") / 60 + f * c("dt")


def _within(radius: Column) -> tuple[Column, Column]:
    """Minute at which a leg is first within a zone's radius, null if never, and the minutes that it is."""
    c = F.col
    de, dn, re, rn = c("e_m") - c("ea"), c("n_m") - c("na"), c("ea") - c("zone_e"), c("na") - c("zone_n")
    a, b, k = de * de + dn * dn, 2 * (re * de + rn * dn), re * re + rn * rn - radius * radius
    disc, twice = b * b - 4 * a * k, F.nullif(2 * a, F.lit(0.0))
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    f0, f1 = F.greatest(F.lit(0.0), (-b - root) / twice), F.least(F.lit(1.0), (-b + root) / twice)
    on = F.when(a == 0, k <= 0).otherwise((disc >= 0) & (f1 >= f0))
    return F.when(on, c("ta") / 60 + F.when(a == 0, 0.0).otherwise(f0) * c("dt")), F.when(on & (a > 0), (f1 - f0) * c("dt")).otherwise(0.0)


def summary(points: DataFrame, still_m: float) -> DataFrame:
    """One row a track: times, distances, speeds, stops, the nearest approach to the base, and the way from start to end."""
    c, moves = F.col, moving(still_m)
    near_m, near_at = _nearest(F.lit(0.0), F.lit(0.0))
    whole = F.when((c("dt") >= STEP_MIN - 1e-9) & (c("mps") <= OUTLIER_MPS) & (c("mps") > 0), c("mps"))
    per = legs(points).groupBy("track_id").agg(
        F.first("complete").alias("complete"), F.count("fix_no").alias("fixes"), F.min("t_s").alias("t0"), F.max("t_s").alias("t1"),
        F.coalesce(F.sum(F.when(moves, c("d"))), F.lit(0.0)).alias("distance_m"), F.coalesce(F.sum(F.when(moves, c("dt"))), F.lit(0.0)).alias("moving_min"),
        F.coalesce(F.max(whole), F.lit(0.0)).alias("max_mps"), F.count_if(c("mps") > OUTLIER_MPS).alias("outliers"),
        F.min(F.struct(near_m.alias("m"), c("leg"), near_at.alias("at"))).alias("near"), F.min_by(F.struct("e_m", "n_m"), "leg").alias("a"), F.max_by(F.struct("e_m", "n_m"), "leg").alias("b"),
    )
    stops = stop_spells(points, still_m).groupBy("track_id").agg(F.count("*").alias("stops"), F.sum((c("end_s") - c("start_s")) / 60).alias("stopped_min"))
    de, dn = c("b.e_m") - c("a.e_m"), c("b.n_m") - c("a.n_m")
    start, end = length(c("a.e_m"), c("a.n_m")), length(c("b.e_m"), c("b.n_m"))
    out = per.join(stops, "track_id", "left").fillna(0, ["stops"]).fillna(0.0, ["stopped_min"])
    return out.select(
        "track_id", "complete", "fixes", (c("t0") / 60).alias("from_min"), (c("t1") / 60).alias("to_min"), "distance_m", "moving_min", F.coalesce(c("distance_m") / F.nullif(c("moving_min") * 60, F.lit(0.0)), F.lit(0.0)).alias("avg_mps"), "max_mps", "outliers", "stops", "stopped_min",
        start.alias("start_m"), end.alias("end_m"), c("near.m").alias("closest_m"), c("near.at").alias("closest_min"), (start - end).alias("approach_m"), length(de, dn).alias("moved_m"), F.when(length(de, dn) > still_m, bearing(de, dn)).alias("heading"),
    )


def passes(points: DataFrame, zones: DataFrame) -> DataFrame:
    """track_id, zone_id, zone_no, name, closest_m, closest_min, buffer_min, zone_min (first entries), inside_min of every track and zone."""
    c = F.col
    near_m, near_at = _nearest(c("zone_e"), c("zone_n"))
    buffer, inside = _within(c("radius_m") + c("buffer_m"))
    core, _ = _within(c("radius_m"))
    per = with_zones(legs(points), zones).groupBy("track_id", "zone_id", "zone_no", "name").agg(F.min(F.struct(near_m.alias("m"), c("leg"), near_at.alias("at"))).alias("near"), F.min(buffer).alias("buffer_min"), F.min(core).alias("zone_min"), F.sum(inside).alias("inside_min"))
    return per.select("track_id", "zone_id", "zone_no", "name", c("near.m").alias("closest_m"), c("near.at").alias("closest_min"), "buffer_min", "zone_min", "inside_min")


def splits(points: DataFrame, still_m: float) -> DataFrame:
    """track_id, split (from 1), from_min, to_min, distance_m, moving_min, range_delta_m: half hours from the start, the last one shorter.

    A leg is dealt to the splits that it touches, by its overlap; a split's end lies on one leg, which gives its range.
    """
    c, by = F.col, Window.partitionBy("track_id")
    rows = legs(points).withColumns({"t0": F.min("t_s").over(by) / 60, "t1": F.max("t_s").over(by) / 60, "start_m": F.min_by(length(c("e_m"), c("n_m")), "leg").over(by)}).filter("dt > 0")
    a, b = c("ta") / 60, c("t_s") / 60
    first = F.floor((a - c("t0")) / SPLIT_MIN)
    last = F.greatest(first, F.ceil((b - c("t0")) / SPLIT_MIN - 1e-10) - 1)
    dealt = rows.withColumn("k", F.explode(F.sequence(first, last))).withColumns({"s0": c("t0") + c("k") * SPLIT_MIN, "s1": F.least(c("t0") + (c("k") + 1) * SPLIT_MIN, c("t1"))})
    over = F.least(b, c("s1")) - F.greatest(a, c("s0"))
    on = moving(still_m) & (over > 0)
    f = (c("s1") - a) / c("dt")
    at = length(c("ea") + f * (c("e_m") - c("ea")), c("na") + f * (c("n_m") - c("na")))
    per = dealt.groupBy("track_id", "k").agg(F.min("s0").alias("from_min"), F.min("s1").alias("to_min"), F.coalesce(F.sum(F.when(on, c("d") * over / c("dt"))), F.lit(0.0)).alias("distance_m"), F.coalesce(F.sum(F.when(on, over)), F.lit(0.0)).alias("moving_min"), F.max(F.when((a < c("s1")) & (c("s1") <= b), at)).alias("end_m"), F.min("start_m").alias("start_m"))
    before = F.coalesce(F.lag("end_m").over(by.orderBy("k")), c("start_m"))
    return per.select("track_id", (c("k") + 1).alias("split"), "from_min", "to_min", "distance_m", "moving_min", (c("end_m") - before).alias("range_delta_m"))


def events(whole: DataFrame, stops: DataFrame, zoned: DataFrame) -> DataFrame:
    """track_id, seq, kind, minute of what happened, in order; at equal times starts, stops, zones (nearest first), the nearest approach and ends.

    whole, stops and zoned are what `summary`, `stop_spells` and `passes` give.
    """
    c = F.col

    def of(rows: DataFrame, kind: str, minute: Column, rank: int, *within: Column) -> DataFrame:
        places = [F.struct(*(x.cast("double").alias(f"p{i}") for i, x in enumerate((*within, F.lit(0), F.lit(0))[:2])))]
        return rows.select("track_id", F.lit(kind).alias("kind"), minute.alias("minute"), F.lit(rank).alias("rank"), places[0].alias("place"), F.lit(1 if kind == "zone" else 0).alias("inner"))

    inner = whole.filter((c("closest_min") - c("from_min") > STEP_MIN) & (c("to_min") - c("closest_min") > STEP_MIN))
    parts = [
        of(whole, "start", c("from_min"), 0), of(stops, "stop", c("start_s") / 60, 1), of(inner, "closest", c("closest_min"), 3), of(whole, "end", c("to_min"), 4),
        of(zoned.filter("buffer_min IS NOT NULL"), "buffer", c("buffer_min"), 2, c("closest_m"), c("zone_no")), of(zoned.filter("zone_min IS NOT NULL"), "zone", c("zone_min"), 2, c("closest_m"), c("zone_no")),
    ]
    w = Window.partitionBy("track_id").orderBy("minute", "rank", "place", "inner")
    return reduce(DataFrame.unionByName, parts).select("track_id", F.row_number().over(w).alias("seq"), "kind", "minute")


def headline(whole: DataFrame, zoned: DataFrame) -> DataFrame:
    """track_id, kind, name, value: the most telling reading of a track. value is a minute of entry, minutes parked, or metres."""
    c = F.col
    first = lambda at: F.min(F.when(c(at).isNotNull(), F.struct(c(at), "closest_m", "zone_no", "name"))).alias(at)
    rows = whole.join(zoned.groupBy("track_id").agg(first("zone_min"), first("buffer_min")), "track_id", "left")
    parked = (c("to_min") - c("from_min") >= 30) & (c("stopped_min") >= (c("to_min") - c("from_min")) * 0.7)
    said = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))
    none = F.lit(None).cast("string")
    one = F.when(c("zone_min").isNotNull(), said("zone", c("zone_min.name"), c("zone_min.zone_min"))).when(c("buffer_min").isNotNull(), said("buffer", c("buffer_min.name"), c("buffer_min.buffer_min"))).when(parked, said("parked", none, c("stopped_min")))
    one = one.when(c("approach_m") >= NET_MOVE_M, said("approaching", none, c("approach_m"))).when(c("approach_m") <= -NET_MOVE_M, said("receding", none, -c("approach_m"))).otherwise(said("roaming", none, c("distance_m")))
    return rows.select("track_id", one.alias("x")).select("track_id", "x.*")
