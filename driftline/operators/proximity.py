"""Tracks against zones and the base: closest point of approach, time to entry, approach confidence, rings.

Zones are a dimension table; they are broadcast only when they are few, which is counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import DEFAULT, Config
from driftline.functions.geo import bearing, length

from .kinematics import recent

#: Zones up to this number are sent to every task; more are joined as they come.
MOST_BROADCAST = 10_000


def with_zones(rows: DataFrame, zones: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Every row with every zone: the result itself has that many rows, so this is no join that could be narrowed."""
    few = zones.limit(most + 1).count() <= most
    return rows.crossJoin(F.broadcast(zones) if few else zones)


def base_zone(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The base as a target: the critical ring is its radius, the warning ring the edge of its buffer."""
    return df.withColumns({"zone_e": F.lit(0.0), "zone_n": F.lit(0.0), "radius_m": F.lit(cfg.base.critical_m), "buffer_m": F.lit(cfg.base.warning_m - cfg.base.critical_m)})


def eta(re: Column, rn: Column, ve: Column, vn: Column, radius: Column) -> Column:
    """Seconds until the radius is entered: 0 inside, null never."""
    a, b, c = ve * ve + vn * vn, 2 * (re * ve + rn * vn), re * re + rn * rn - radius * radius
    disc = b * b - 4 * a * c
    small, large = (-b - F.sqrt(disc)) / (2 * a), (-b + F.sqrt(disc)) / (2 * a)
    return F.when(c <= 0, 0.0).when((a > 0) & (disc >= 0), F.when(small > 0, small).when(large > 0, large))


def confidence(re: Column, rn: Column, ve: Column, vn: Column, closing_steps: Column) -> Column:
    dist, speed = length(re, rn), length(ve, vn)
    cos = F.when((speed > 0) & (dist > 0), -(re * ve + rn * vn) / (speed * dist)).otherwise(0.0)
    raw = 0.5 * F.greatest(F.lit(0.0), cos) + 0.3 * (closing_steps / 3.0) + 0.2 * F.least(F.lit(1.0), speed / 5.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def closing_steps(fixes: DataFrame, zones: DataFrame) -> DataFrame:
    """track_id, zone_id, closing_steps: how many of the last three steps brought the track nearer to the zone."""
    last = with_zones(recent(fixes, 4), zones.select("zone_id", "zone_e", "zone_n"))
    d = length(F.col("e_m") - F.col("zone_e"), F.col("n_m") - F.col("zone_n"))
    w = Window.partitionBy("track_id", "zone_id").orderBy(F.col("back").desc())
    return last.withColumn("d", d).withColumn("nearer", (F.col("d") < F.lag("d").over(w)).cast("int")).groupBy("track_id", "zone_id").agg(F.coalesce(F.sum("nearer"), F.lit(0)).alias("closing_steps"))


def assessed(rows: DataFrame) -> DataFrame:
    """rows: e_m, n_m, ve, vn, zone_e, zone_n, radius_m, buffer_m, closing_steps. Adds dist_m, t_cpa_s, cpa_m, eta_s, closing_mps, conf, inside, in_buffer."""
    re, rn, ve, vn = F.col("e_m") - F.col("zone_e"), F.col("n_m") - F.col("zone_n"), F.col("ve"), F.col("vn")
    dot, sq, dist = re * ve + rn * vn, ve * ve + vn * vn, length(re, rn)
    t = F.when(sq > 0, F.greatest(F.lit(0.0), -dot / sq)).otherwise(0.0)
    out = rows.withColumns({"dist_m": dist, "t_cpa_s": t, "eta_s": eta(re, rn, ve, vn, F.col("radius_m")), "closing_mps": F.when(dist > 0, -dot / dist).otherwise(0.0), "conf": confidence(re, rn, ve, vn, F.col("closing_steps"))})
    return out.withColumns({
        "cpa_m": length(re + ve * F.col("t_cpa_s"), rn + vn * F.col("t_cpa_s")),
        "inside": F.col("dist_m") <= F.col("radius_m"),
        "in_buffer": (F.col("dist_m") > F.col("radius_m")) & (F.col("dist_m") <= F.col("radius_m") + F.col("buffer_m")),
    })


def assess(states: DataFrame, fixes: DataFrame, zones: DataFrame) -> DataFrame:
    """Every track against every zone (zone_id, zone_no, zone_e, zone_n, radius_m, buffer_m)."""
    rows = with_zones(states.select("track_id", "e_m", "n_m", "ve", "vn", "speed", "stationary", "range_m"), zones)
    return assessed(rows.join(closing_steps(fixes, zones), ["track_id", "zone_id"]))


def destination(assessments: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """track_id, zone_id: of the zones approached with confidence and within the horizon, the one entered first."""
    on = assessments.filter((F.col("conf") >= 0.5) & F.col("eta_s").between(0, cfg.warning.horizon_s))
    return on.groupBy("track_id").agg(F.min_by("zone_id", F.struct("eta_s", "zone_no")).alias("zone_id"))


def base_assessment(states: DataFrame, fixes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row a track: the base as target, with ring."""
    base = base_zone(fixes.sparkSession.range(1).select(F.lit("BASE").alias("zone_id")), cfg)
    rows = base_zone(states, cfg).join(closing_steps(fixes, base).drop("zone_id"), "track_id")
    return assessed(rows).withColumn("ring", ring(F.col("dist_m"), cfg))


def ring(range_m: Column, cfg: Config = DEFAULT) -> Column:
    b = cfg.base
    return F.when(range_m <= b.critical_m, "critical").when(range_m <= b.warning_m, "warning").when(range_m <= b.observation_m, "observation").otherwise("outside")


def sector(points: DataFrame, zones: DataFrame, key: str = "track_id") -> DataFrame:
    """key, zone_id of the zone nearest in bearing from the base; the first of equals, which are those within a billionth of a degree."""
    rows = with_zones(points, zones)
    d = F.abs(bearing(F.col("e_m"), F.col("n_m")) - bearing(F.col("zone_e"), F.col("zone_n")))
    return rows.groupBy(key).agg(F.min_by("zone_id", F.struct(F.round(F.least(d, 360 - d), 9), F.col("zone_no"))).alias("zone_id"))


def nearest_zone(points: DataFrame, zones: DataFrame, key: str = "track_id") -> DataFrame:
    rows = with_zones(points, zones).withColumn("d", length(F.col("e_m") - F.col("zone_e"), F.col("n_m") - F.col("zone_n")))
    return rows.groupBy(key).agg(F.min(F.struct("d", "zone_no", "zone_id")).alias("x")).select(key, "x.zone_id", F.col("x.d").alias("dist_m"))
