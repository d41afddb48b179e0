"""Road candidates: points meet segments by grid cell, never pairwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geo import length
from driftline.functions.stages import written


def cells(segments: DataFrame, cell_m: float, radius_m: float = 0.0) -> DataFrame:
    """Segments (seg_id, ax, ay, bx, by) once for each cell that their box, grown by the radius, covers."""
    at = lambda c, sign: F.floor((c + sign * radius_m) / cell_m).cast("long")
    span = lambda a, b: F.explode(F.sequence(at(F.least(a, b), -1), at(F.greatest(a, b), 1)))
    return segments.withColumn("cx", span(F.col("ax"), F.col("bx"))).withColumn("cy", span(F.col("ay"), F.col("by")))


def along(e: Column, n: Column, s) -> Column:
    """Parameter of the closest point of a segment; one of no length is its first point. s gives the segment's columns by name."""
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    sq = dx * dx + dy * dy
    return F.when(sq > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((e - s["ax"]) * dx + (n - s["ay"]) * dy) / sq))).otherwise(0.0)


def projected(e: Column, n: Column) -> dict[str, Column]:
    """Parameter of the closest point of a segment, its place and its distance."""
    s = {c: F.col(c) for c in ("ax", "ay", "bx", "by")}
    t = along(e, n, s)
    px, py = s["ax"] + t * (s["bx"] - s["ax"]), s["ay"] + t * (s["by"] - s["ay"])
    return {"along": t, "px": px, "py": py, "offset_m": length(e - px, n - py)}


def reached(segments: DataFrame, points: DataFrame, radius_m: float, cell_m: float = 120.0) -> DataFrame:
    """The segments that are listed in a cell in which a point lies. Where a network goes far beyond its points, only these are joined, sorted and exchanged."""
    at = lambda c: F.floor(F.col(c) / cell_m).cast("long")
    touched = written(points.select(at("e_m").alias("cx"), at("n_m").alias("cy")).distinct(), "touched")
    return written(cells(segments, cell_m, radius_m).join(touched, ["cx", "cy"], "left_semi").select(segments.columns).distinct(), "reached")


PLACE = ("ax", "ay", "bx", "by")
#: Places of a cell, and segments of a place, that are sent in one row; more take several rows.
IN_A_ROW = 256


def _row_of(*by: str, order: tuple[str, ...]) -> Column:
    return F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / IN_A_ROW)


def nearest(points: DataFrame, segments: DataFrame, radius_m: float, most: int, one_per_way: bool = False, cell_m: float = 120.0) -> DataFrame:
    """point_id, found: the nearest segments within the radius in order (offset_m, seg_id, way_id, along, px, py), at most so many; points without any are left out.

    A point lies in one cell and a segment is listed in all cells within reach of it, so no pair meets twice. Segments of one place
    are equally near: a place, or a place and way, is measured once under its least number, and only as many of its segments as are
    asked for are looked up for the nearest places. Points are dealt out first, so that their pairs are not.
    """
    own = (*PLACE, "way_id") if one_per_way else PLACE
    of = Window.partitionBy(*own)
    few = segments.select("seg_id", "way_id", *PLACE).withColumn("k", F.row_number().over(of.orderBy("seg_id"))).filter(F.col("k") <= (1 if one_per_way else most))
    places = few.groupBy(*own).agg(F.min("seg_id").alias("seg_id"), F.count("*").alias("n"))
    here = points.repartition("point_id").select("point_id", "e_m", "n_m", F.floor(F.col("e_m") / cell_m).cast("long").alias("cx"), F.floor(F.col("n_m") / cell_m).cast("long").alias("cy"))
    near = here.join(cells(places, cell_m, radius_m), ["cx", "cy"]).withColumns(projected(F.col("e_m"), F.col("n_m"))).filter(F.col("offset_m") <= radius_m)
    first = lambda c: F.slice(F.sort_array(F.collect_list(c)), 1, most)
    if one_per_way:
        best = near.groupBy("point_id", "way_id").agg(F.min(F.struct("offset_m", "seg_id", "along", "px", "py")).alias("c"))
        return best.groupBy("point_id").agg(first(F.struct("c.offset_m", "c.seg_id", "way_id", "c.along", "c.px", "c.py")).alias("found"))
    top = near.groupBy("point_id").agg(first(F.struct("offset_m", "seg_id", "n", "along", "px", "py")).alias("top"))
    # A place adds nothing once nearer ones have enough. Segments of equally near places follow each other by their own numbers.
    short = F.filter("top", lambda x: F.aggregate(F.filter("top", lambda y: y["offset_m"] < x["offset_m"]), F.lit(0).cast("long"), lambda a, y: a + y["n"]) < most)
    members = few.select(F.min("seg_id").over(of).alias("first_id"), "seg_id", "way_id")
    rows = top.select("point_id", F.explode(short).alias("p")).join(members, F.col("p.seg_id") == F.col("first_id"))
    return rows.groupBy("point_id").agg(first(F.struct("p.offset_m", F.col("seg_id"), "way_id", "p.along", "p.px", "p.py")).alias("found"))


def candidates(points: DataFrame, segments: DataFrame, radius_m: float, most: int, one_per_way: bool = False, cell_m: float = 120.0) -> DataFrame:
    """point_id, seg_id, way_id, along, px, py, offset_m, rank of the nearest segments within the radius, at most so many a point."""
    rows = nearest(points, segments, radius_m, most, one_per_way, cell_m).select("point_id", F.posexplode("found").alias("rank", "c"))
    return rows.select("point_id", *(F.col(f"c.{c}") for c in ("seg_id", "way_id", "along", "px", "py", "offset_m")), (F.col("rank") + 1).alias("rank"))


def within(points: DataFrame, segments: DataFrame, radius_m: float, cell_m: float = 120.0) -> DataFrame:
    """point_id, seg_id, way_id, along, px, py, offset_m of all segments within the radius.

    Segments of one place are measured once; the rows are as many as the true pairs, and nothing is sorted or exchanged for them.
    """
    rows = segments.withColumn("row", _row_of(*PLACE, order=("seg_id",)))
    places = rows.groupBy(*PLACE, "row").agg(F.collect_list(F.struct("seg_id", "way_id")).alias("of"))
    here = points.withColumn("cx", F.floor(F.col("e_m") / cell_m).cast("long")).withColumn("cy", F.floor(F.col("n_m") / cell_m).cast("long"))
    near = here.join(cells(places, cell_m, radius_m), ["cx", "cy"]).withColumns(projected(F.col("e_m"), F.col("n_m"))).filter(F.col("offset_m") <= radius_m)
    return near.select("point_id", "along", "px", "py", "offset_m", F.explode("of").alias("s")).select("point_id", "s.seg_id", "s.way_id", "along", "px", "py", "offset_m")
