"""Trajectories: outliers, fitted velocity, state, whole-record profiles. Input: fixes (track_id, fix_no, t_s, e_m, n_m).

Everything hangs on one exchange by track; windows hold frames of fixed size or running sums, so long records stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from driftline.config import DEFAULT, Config
from driftline.functions.geo import bearing, length


def in_order() -> WindowSpec:
    return Window.partitionBy("track_id").orderBy("t_s", "fix_no")


def backwards() -> WindowSpec:
    return Window.partitionBy("track_id").orderBy(F.col("t_s").desc(), F.col("fix_no").desc())


def whole() -> WindowSpec:
    return Window.partitionBy("track_id")


def as_of(fixes: DataFrame, now: float | Column, column: str = "t_s") -> DataFrame:
    """Rows up to the clock; nothing later is ever read."""
    return fixes.filter(F.col(column) <= now)


def steps(fixes: DataFrame) -> DataFrame:
    """With dt, de, dn, step_m and speed from the fix before; null at a track's first fix, speed null where time stands."""
    lag = lambda c: F.lag(c).over(in_order())
    rows = fixes.withColumns({"dt": F.col("t_s") - lag("t_s"), "de": F.col("e_m") - lag("e_m"), "dn": F.col("n_m") - lag("n_m"), "range_m": length(F.col("e_m"), F.col("n_m"))})
    return rows.withColumn("step_m", length(F.col("de"), F.col("dn"))).withColumn("speed", F.when(F.col("dt") > 0, F.col("step_m") / F.col("dt")))


def outliers(fixes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """With usable: false at the later fix of a step that is faster than any vehicle."""
    return steps(fixes).withColumn("usable", F.coalesce(F.col("speed") <= cfg.kinematics.max_speed, F.lit(True)))


def recent(fixes: DataFrame, count: int = 4) -> DataFrame:
    """The last fixes of each track, with back (1 is the last)."""
    return fixes.withColumn("back", F.row_number().over(backwards())).filter(F.col("back") <= count)


def velocity(fixes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """track_id, ve, vn: slopes over the last usable fixes; 0 where there are fewer than two or no spread of times."""
    ranked = outliers(fixes, cfg).filter("usable").withColumn("back", F.row_number().over(backwards())).filter(F.col("back") <= cfg.kinematics.fit_points)
    t = F.col("t_s") - F.max("t_s").over(whole())
    return ranked.withColumn("t", t).groupBy("track_id").agg(*(F.coalesce(F.regr_slope(c, "t"), F.lit(0.0)).alias(v) for c, v in (("e_m", "ve"), ("n_m", "vn"))))


def state(fixes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row a track: last position and time, fitted velocity (0 if stationary), speed, heading, ranges at t-60, t-30 and now.

    Tracks of one or two fixes have what can be had of them; a range is null without a fix in the 10 minutes before its time.
    """
    k = cfg.kinematics
    rows = outliers(fixes, cfg).withColumns({"back": F.row_number().over(backwards()), "usable_back": F.sum(F.col("usable").cast("int")).over(backwards()), "t_last": F.max("t_s").over(whole())})
    fit = F.col("usable") & (F.col("usable_back") <= k.fit_points)
    at = lambda c, b: F.max(F.when(F.col("back") == b, F.col(c)))
    before = lambda s: F.max(F.when(F.col("t_s") <= F.col("t_last") - s, F.struct("t_s", "fix_no", "range_m")))
    slope = lambda c: F.coalesce(F.regr_slope(F.when(fit, F.col(c)), F.when(fit, F.col("t_s") - F.col("t_last"))), F.lit(0.0))
    one = rows.groupBy("track_id").agg(
        F.count("*").alias("n_fixes"), at("t_s", 1).alias("t_s"), at("e_m", 1).alias("e_m"), at("n_m", 1).alias("n_m"), at("range_m", 1).alias("range_m"),
        at("e_m", 2).alias("e2"), at("n_m", 2).alias("n2"), at("e_m", 3).alias("e3"), at("n_m", 3).alias("n3"),
        slope("e_m").alias("fit_e"), slope("n_m").alias("fit_n"), F.sum((~F.col("usable")).cast("long")).alias("outlier_steps"), before(3600).alias("b60"), before(1800).alias("b30"),
    )
    net = F.when(F.col("n_fixes") >= 3, length(F.col("e_m") - F.col("e3"), F.col("n_m") - F.col("n3"))).when(F.col("n_fixes") == 2, length(F.col("e_m") - F.col("e2"), F.col("n_m") - F.col("n2")))
    one = one.withColumn("stationary", F.coalesce(net < k.stationary_m, F.lit(False)))
    one = one.withColumn("ve", F.when(F.col("stationary"), 0.0).otherwise(F.col("fit_e"))).withColumn("vn", F.when(F.col("stationary"), 0.0).otherwise(F.col("fit_n")))
    one = one.withColumn("speed", length(F.col("ve"), F.col("vn")))
    last = bearing(F.coalesce(F.col("e_m") - F.col("e2"), F.lit(0.0)), F.coalesce(F.col("n_m") - F.col("n2"), F.lit(0.0)))
    within = lambda b, s: F.when(F.col("t_s") - s - F.col(f"{b}.t_s") <= 600, F.col(f"{b}.range_m"))
    return one.select("track_id", "n_fixes", "t_s", "e_m", "n_m", "range_m", "ve", "vn", "speed", "stationary", F.when(F.col("speed") > 0, bearing(F.col("ve"), F.col("vn"))).otherwise(last).alias("heading"), within("b60", 3600).alias("range_60"), within("b30", 1800).alias("range_30"), "outlier_steps")


def profile(fixes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row a track that has three fixes and two steps that take time: distances, speeds, stops, turns, approach."""
    k = cfg.kinematics
    rows = steps(fixes).withColumns({"n": F.row_number().over(in_order()), "d_range": F.col("range_m") - F.lag("range_m").over(in_order())})
    good = F.col("dt") > 0
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("moving", F.coalesce(good & (F.col("speed") > k.moving_mps), F.lit(False)))
    past = in_order().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "before": F.last(F.when(F.col("good"), F.col("speed")), ignorenulls=True).over(past),
        "heading": F.when(F.col("moving"), F.degrees(F.atan2("de", "dn"))),
        "run": F.sum(F.col("moving").cast("int")).over(in_order()),
        "t0": F.min("t_s").over(whole()),
    })
    rows = rows.withColumn("turned_from", F.last("heading", ignorenulls=True).over(past))
    turn = F.abs(F.pmod(F.col("heading") - F.col("turned_from") + 180, F.lit(360.0)) - 180)
    rows = rows.withColumns({"accel": F.when(F.col("good"), (F.col("speed") - F.col("before")) / F.col("dt")), "turn": turn})
    of = lambda c: F.when(F.col("good"), F.col(c))
    ends = lambda c: (F.max_by(c, F.struct("t_s", "fix_no")) - F.min_by(c, F.struct("t_s", "fix_no")))
    main = rows.groupBy("track_id").agg(
        F.count("*").alias("n_fixes"), F.sum(F.col("good").cast("long")).alias("n_steps"), F.sum(of("step_m")).alias("total_m"),
        length(ends("e_m"), ends("n_m")).alias("net_m"), F.avg(of("speed")).alias("speed_mean"), F.max(of("speed")).alias("speed_max"),
        F.percentile(of("speed"), F.lit(0.95)).alias("speed_p95"), F.stddev_pop(of("speed")).alias("speed_std"), F.coalesce(F.max(F.abs("accel")), F.lit(0.0)).alias("accel_max"),
        F.avg(F.when(F.col("good"), F.col("moving").cast("double"))).alias("moving_fraction"), F.median(of("dt")).alias("step_s"),
        F.coalesce(F.sum("turn"), F.lit(0.0)).alias("heading_change"), F.sum((F.col("turn") > k.reversal_deg).cast("long")).alias("reversals"),
        F.min_by("range_m", F.struct("t_s", "fix_no")).alias("range_start"), F.min("range_m").alias("range_min"),
        (-F.coalesce(F.regr_slope(of("range_m"), F.when(F.col("good"), F.col("t_s") - F.col("t0"))), F.lit(0.0))).alias("closing_rate"),
        F.avg(F.when(F.col("good"), (F.col("d_range") < 0).cast("double"))).alias("closing_fraction"),
    )
    runs = rows.filter("good AND NOT moving").groupBy("track_id", "run").agg(F.count("*").alias("len")).groupBy("track_id").agg(F.count("*").alias("stop_count"), F.max("len").alias("longest"))
    out = main.filter("n_fixes >= 3 AND n_steps >= 2").join(runs, "track_id", "left")
    return out.select(
        "track_id", "n_steps", "total_m", "net_m", "speed_mean", "speed_max", "speed_p95", "speed_std", "accel_max", "moving_fraction",
        F.coalesce("stop_count", F.lit(0)).alias("stop_count"), (F.coalesce("longest", F.lit(0)) * F.col("step_s") / 60).alias("longest_stop_min"),
        F.when(F.col("total_m") > 0, F.col("net_m") / F.col("total_m")).otherwise(0.0).alias("straightness"), "heading_change", F.coalesce("reversals", F.lit(0)).alias("reversals"),
        "range_start", "range_min", "closing_rate", "closing_fraction",
    )


def flags() -> Column:
    """Names of the behaviours that a profile's numbers support."""
    c = F.col
    return F.array_compact(F.array(
        F.when((c("moving_fraction") <= 0.15) & (c("longest_stop_min") >= 60) & (c("speed_mean") > 0) & (c("speed_max") >= 6 * c("speed_mean")), "waited_then_moved"),
        F.when((c("closing_fraction") >= 0.67) & (c("closing_rate") >= 0.6), "sustained_approach_to_base"),
        F.when(c("reversals") >= 3, "doubled_back"),
        F.when((c("straightness") >= 0.9) & (c("moving_fraction") >= 0.33), "direct_run"),
    ))


def distribution(fixes: DataFrame, step_s: float = 300.0, bins: int = 10) -> DataFrame:
    """One row a track: statistics of step speeds at a fixed step, and how many lie in each of equal bins (the last one closed)."""
    rows = steps(fixes).filter("dt IS NOT NULL").withColumn("v", F.col("step_m") / step_s)
    rows = rows.withColumns({"lo": F.min("v").over(whole()), "hi": F.max("v").over(whole())})
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = rows.withColumn("bin", at.cast("int"))
    return counts.groupBy("track_id").agg(
        F.count("*").alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"), F.stddev_pop("v").alias("v_std"),
        *(F.percentile("v", F.lit(p / 100)).alias(f"v_p{p}") for p in (25, 50, 75, 95)), *(F.sum((F.col("bin") == b).cast("long")).alias(f"bin{b}") for b in range(bins)),
    )
