"""What a display shows of tracks: the range curve, the tail, the live set at a clock, zone sectors, readings as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(fixes: DataFrame) -> DataFrame:
    """track_id, fix_no, minute, range_m: the distance to the base at each fix."""
    return fixes.select("track_id", "fix_no", (F.col("t_s") / 60).alias("minute"), F.hypot("e_m", "n_m").alias("range_m"))


def present(fixes: DataFrame, clock_s: float) -> DataFrame:
    """track_id, e_m, n_m of every track whose fixes reach from before a clock to after it, between its two nearest fixes; of fixes of
    one time the last counts before the clock, the first after it."""
    t, at, order = F.col("t_s"), F.struct("e_m", "n_m", "t_s"), F.struct("t_s", "fix_no")
    ends = fixes.groupBy("track_id").agg(F.max_by(F.when(t <= clock_s, at), F.when(t <= clock_s, order)).alias("a"), F.min_by(F.when(t > clock_s, at), F.when(t > clock_s, order)).alias("b"))
    share = (F.lit(clock_s) - F.col("a.t_s")) / (F.col("b.t_s") - F.col("a.t_s"))
    between = lambda c: F.when(F.col("b").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + share * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c)
    return ends.filter(F.col("a").isNotNull() & (F.col("b").isNotNull() | (F.col("a.t_s") == clock_s))).select("track_id", between("e_m"), between("n_m"))


def trail(fixes: DataFrame, clock_s: float, tail_s: float) -> DataFrame:
    """track_id, t_s, e_m, n_m: the fixes of the last seconds before a clock, and where the track is at it."""
    now = present(fixes, clock_s)
    past = fixes.filter(F.col("t_s").between(clock_s - tail_s, clock_s)).join(now.select("track_id"), "track_id", "left_semi").select("track_id", "t_s", "e_m", "n_m")
    return past.unionByName(now.select("track_id", F.lit(clock_s).alias("t_s"), "e_m", "n_m"))


def live(fixes: DataFrame, captures: DataFrame, alerts: DataFrame, clock_s: float) -> DataFrame:
    """track_id, e_m, n_m, assessed, level_rank, score, alert_id of every track that is there at a clock.

    captures: track_id, capture_s of the track's own frame. alerts: track_id, alert_id, level_rank, priority. A track is assessed
    once its frame is captured; its level is that of its worst alert, or CLEAR; before that it has none.
    """
    worst = alerts.groupBy("track_id").agg(F.max_by(F.struct("alert_id", "level_rank", "priority"), F.struct("level_rank", "priority", "alert_id")).alias("worst"))
    both = present(fixes, clock_s).join(captures, "track_id", "left").join(worst, "track_id", "left").withColumn("assessed", F.coalesce(F.col("capture_s") <= clock_s, F.lit(False)))
    of = lambda c, none: F.when(F.col("assessed"), F.coalesce(F.col(f"worst.{c}"), F.lit(none)))
    return both.select("track_id", "e_m", "n_m", "assessed", of("level_rank", 0).alias("level_rank"), F.coalesce(of("priority", 0.0), F.lit(0.0)).alias("score"), of("alert_id", None).alias("alert_id"))


def passes(level_rank: Column, wanted: Column) -> Column:
    """Whether a level passes a filter: all, judged, unassessed, or a level's name."""
    named = F.when(level_rank == 0, "CLEAR").when(level_rank == 1, "WATCH").when(level_rank == 2, "ALERT")
    return F.when(wanted == "all", True).when(wanted == "judged", level_rank.isNotNull()).when(wanted == "unassessed", level_rank.isNull()).otherwise(F.coalesce(named == wanted, F.lit(False)))


def sectors(zones: DataFrame) -> DataFrame:
    """zone_id, from_deg, to_deg, outer_m: each zone owns the bearings nearer to its own than to its neighbours'.

    A lone zone owns the circle. Zones are a site's few, so all stand in one window.
    """
    wrap = lambda c: F.pmod(c, F.lit(360.0))
    bearing = F.round(wrap(F.degrees(F.atan2("zone_e", "zone_n"))), 9)
    rows = zones.select("zone_id", "zone_no", wrap(bearing).alias("b"), (F.hypot("zone_e", "zone_n") + F.col("radius_m") + F.col("buffer_m")).alias("outer_m"))
    order, whole = Window.orderBy("b", "zone_no"), Window.orderBy("b", "zone_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("before", F.coalesce(F.lag("b").over(order), F.last("b").over(whole))).withColumn("after", F.coalesce(F.lead("b").over(order), F.first("b").over(whole))).withColumn("n", F.count("*").over(whole))
    start, end = F.col("before") + wrap(F.col("b") - F.col("before")) / 2, F.col("b") + wrap(F.col("after") - F.col("b")) / 2
    return rows.select("zone_id", F.when(F.col("n") == 1, 0.0).otherwise(start).alias("from_deg"), F.when(F.col("n") == 1, 360.0).when(end > start, end).otherwise(end + 360).alias("to_deg"), "outer_m")


def _grouped(n: Column) -> Column:
    """Whole numbers below a million, with a point before the last three digits."""
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0")))


def _whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def distance_text(metres: Column) -> Column:
    hundredths = _whole(metres / 10)
    far = F.concat(_grouped(F.floor(hundredths / 100)), F.lit(","), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(" km"))
    return F.when(metres.isNull(), "—").when(metres < 1000, F.concat(_grouped(_whole(metres)), F.lit(" m"))).otherwise(far)


def eta_text(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "—").when(seconds < 60, "<1 dk").otherwise(F.concat(F.lit("~"), _grouped(_whole(seconds / 60)), F.lit(" dk")))


#: The eight points of the compass from north clockwise, as displayed.
POINTS = ("K", "KD", "D", "GD", "G", "GB", "B", "KB")


def heading_text(degrees: Column) -> Column:
    eighth = (_whole(F.pmod(degrees, F.lit(360.0)) / 45) % 8 + 1).cast("int")
    return F.when(degrees.isNull(), "—").otherwise(F.concat(F.element_at(F.array(*map(F.lit, POINTS)), eighth), F.lit(" "), _grouped(_whole(degrees)), F.lit("°")))


def frame_log(frames: DataFrame, levels: DataFrame, decisions: DataFrame, clock_s: float) -> DataFrame:
    """image_id, capture_s, level, n_alert, n_watch, decision of every frame captured by a clock.

    levels: image_id, level of each vehicle. decisions: image_id, seq, verdict, of which a frame's last one counts.
    """
    counts = levels.groupBy("image_id").agg(F.count_if(F.col("level") == "ALERT").alias("n_alert"), F.count_if(F.col("level") == "WATCH").alias("n_watch"))
    last = decisions.groupBy("image_id").agg(F.max_by("verdict", "seq").alias("decision"))
    rows = frames.filter(F.col("capture_s") <= clock_s).select("image_id", "capture_s").join(counts, "image_id", "left").join(last, "image_id", "left").fillna(0, ["n_alert", "n_watch"])
    return rows.select("image_id", "capture_s", F.when(F.col("n_alert") > 0, "ALERT").when(F.col("n_watch") > 0, "WATCH").otherwise("CLEAR").alias("level"), "n_alert", "n_watch", "decision")


def motion(fixes: DataFrame, vehicles: DataFrame, clock_s: float, window_s: float, most: int = 12) -> DataFrame:
    """track_id, level, score, points, far_m, axis_m of the range curves drawn: the vehicles of highest score that have two points.

    vehicles: track_id, level, score; those in CLEAR are not drawn. axis_m is the furthest point drawn, up to the next kilometre, two at least.
    """
    shown = vehicles.filter(F.col("level").isin("ALERT", "WATCH"))
    curves = fixes.filter(F.col("t_s").between(clock_s - window_s, clock_s)).groupBy("track_id").agg(F.count("*").alias("points"), F.max(F.hypot("e_m", "n_m")).alias("far_m")).filter("points >= 2")
    drawn = curves.join(shown, "track_id").orderBy(F.desc("score"), "track_id").limit(most)
    axis = F.greatest(F.lit(2000.0), F.ceil(F.max("far_m").over(Window.partitionBy(F.lit(1))) / 1000) * 1000.0)
    return drawn.select("track_id", "level", "score", "points", "far_m", axis.alias("axis_m"))


def recorded(requests: DataFrame, alerts: DataFrame) -> DataFrame:
    """request_id, target_id, level, error of every decision that a reviewer asks to record.

    requests: request_id, image_id, track_id (null: the frame's alert of highest priority), operator, note. alerts: image_id,
    track_id, level, priority. error: no_operator_or_note, no_alert or null; with an error there is no target.
    """
    c, named = F.col, lambda x: F.trim(F.coalesce(F.col(x), F.lit(""))) != ""
    one = alerts.groupBy("image_id", "track_id").agg(F.max("level").alias("level"), F.max("priority").alias("priority"))
    lead = one.groupBy("image_id").agg(F.max_by(F.struct("track_id", "level"), F.struct("priority", -c("track_id"))).alias("lead"))
    own = one.select("image_id", "track_id", c("level").alias("own_level"))
    rows = requests.join(lead, "image_id", "left").join(own, ["image_id", "track_id"], "left")
    target = F.when(c("track_id").isNull(), c("lead")).when(c("own_level").isNotNull(), F.struct("track_id", c("own_level").alias("level")))
    error = F.when(~(named("operator") & named("note")), "no_operator_or_note").when(target.isNull(), "no_alert")
    return rows.select("request_id", error.alias("error"), F.when(error.isNull(), target).alias("x")).select("request_id", c("x.track_id").alias("target_id"), "x.level", "error")


def found_reports(reports: DataFrame, zones: DataFrame, words: str = "", zone: str = "", kind: str | None = None, most: int = 25) -> DataFrame:
    """report_id, kind, zone_id, n_found: the first reports by id whose text holds some words, in a zone by id or name, of a kind.

    n_found counts all that fit. reports: report_id, text, zone_id, kind; repeated ids count once. Case is ignored.
    """
    lower = lambda x: F.lower(F.coalesce(x, F.lit("")))
    rows = reports.filter(F.contains(lower(F.col("text")), F.lit(words.lower())))
    if zone:
        named = zones.filter(F.contains(lower(F.col("zone_id")), F.lit(zone.lower())) | F.contains(lower(F.col("name")), F.lit(zone.lower()))).select("zone_id")
        rows = rows.join(named, "zone_id", "left_semi")
    rows = (rows.filter(F.col("kind") == kind) if kind else rows).groupBy("report_id").agg(F.min(F.struct("kind", "zone_id")).alias("x"))
    first = rows.orderBy("report_id").limit(most)
    return first.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n_found")))).select("report_id", "x.*", "n_found")
