"""Behaviour of a track against the base (the origin): closing, heading, closest approach, sweep of the bearing, stops."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import DEFAULT, Config
from driftline.functions.geo import length

from .kinematics import in_order, whole

WINDOWS_S = (1800, 3600, 7200)
TOLERANCE_S, MIN_MOVE_M = 300.0, 50.0


def ranged(fixes: DataFrame) -> DataFrame:
    return fixes.withColumn("range_m", length(F.col("e_m"), F.col("n_m")))


def at_or_before(seconds: float, tolerance: float = TOLERANCE_S):
    """Aggregate: the latest fix at or before so many seconds before the last one, null if it is older than the tolerance allows."""
    target = F.col("t_last") - seconds
    return F.max(F.when((F.col("t_s") <= target) & (target - F.col("t_s") <= tolerance), F.struct("t_s", "fix_no", "e_m", "n_m", "range_m")))


def approach(fixes: DataFrame) -> DataFrame:
    """track_id, closing_30/60/120 (metres, positive is nearer) and heading_cos against the base's direction over 30 minutes."""
    rows = ranged(fixes).withColumn("t_last", F.max("t_s").over(whole()))
    one = rows.groupBy("track_id").agg(*(at_or_before(s).alias(f"w{s // 60}") for s in WINDOWS_S), F.max(F.struct("t_s", "fix_no", "e_m", "n_m", "range_m")).alias("last"))
    me, mn = F.col("last.e_m") - F.col("w30.e_m"), F.col("last.n_m") - F.col("w30.n_m")
    moved, base = length(me, mn), F.col("w30.range_m")
    cos = F.when((moved >= MIN_MOVE_M) & (base > 0), (me * -F.col("w30.e_m") + mn * -F.col("w30.n_m")) / (moved * base))
    return one.select("track_id", *((F.col(f"w{s // 60}.range_m") - F.col("last.range_m")).alias(f"closing_{s // 60}") for s in WINDOWS_S), cos.alias("heading_cos"))


def closest(fixes: DataFrame) -> DataFrame:
    """track_id, range_m, closest_m, closest_min_ago (first such fix), came_in_from_m (furthest before it, null at the first fix), spread."""
    rows = ranged(fixes).withColumn("near", F.min(F.struct("range_m", "t_s", "fix_no")).over(whole()))
    before = (F.col("t_s") < F.col("near.t_s")) | ((F.col("t_s") == F.col("near.t_s")) & (F.col("fix_no") < F.col("near.fix_no")))
    one = rows.groupBy("track_id").agg(
        F.max(F.struct("t_s", "fix_no", "range_m")).alias("last"), F.min("near").alias("near"), F.max(F.when(before, F.col("range_m"))).alias("came_in_from_m"),
        F.max("range_m").alias("hi"), F.avg("range_m").alias("mean"), F.min("t_s").alias("t_first"),
    )
    return one.select(
        "track_id", F.col("last.range_m").alias("range_m"), F.col("near.range_m").alias("closest_m"), ((F.col("last.t_s") - F.col("near.t_s")) / 60).alias("closest_min_ago"), "came_in_from_m",
        F.when(F.col("mean") > 0, (F.col("hi") - F.col("near.range_m")) / F.col("mean")).otherwise(0.0).alias("range_spread"), ((F.col("last.t_s") - F.col("t_first")) / 60).alias("record_min"),
    )


def sweep(fixes: DataFrame) -> DataFrame:
    """track_id, sweep_deg: span of the unwrapped bearing from the base. A step of half a circle, to a billionth, is no wrap."""
    rows = fixes.withColumn("theta", F.atan2("e_m", "n_m"))
    d = F.col("theta") - F.lag("theta").over(in_order())
    turn = F.when(d > math.pi + 1e-9, -2 * math.pi).when(d < -math.pi - 1e-9, 2 * math.pi).otherwise(0.0)
    rows = rows.withColumn("turn", turn).withColumn("free", F.col("theta") + F.sum("turn").over(in_order()))
    return rows.groupBy("track_id").agg(F.degrees(F.max("free") - F.min("free")).alias("sweep_deg"))


SPELL = "track_id long, start_s double, end_s double, range_m double"


def stop_spells(fixes: DataFrame, still_m: float) -> DataFrame:
    """track_id, start_s, end_s, range_m of every stop: fixes that stay near the first of them for two intervals or more.

    A spell's end is the next spell's first candidate, otherwise the next fix is. Sorted rows stream through each task with
    a few fixes in hand, however long a track is; tracks are dealt by hash.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, held, out = None, [], []

        def settle(final: bool) -> None:
            # held[0] is the anchor; held grows only while fixes stay near it, and beyond three only its ends are kept.
            nonlocal held
            while held:
                anchor, away = held[0], next((i for i, f in enumerate(held) if math.hypot(f[1] - held[0][1], f[2] - held[0][2]) > still_m), None)
                if away is None and not final:
                    if len(held) > 3:
                        anchor[3] += len(held) - 3
                        held = [anchor, held[-2], held[-1]]
                    return
                last = (len(held) if away is None else away) - 1
                if last + anchor[3] >= 2:
                    out.append((track, anchor[0], held[last][0], math.hypot(anchor[1], anchor[2])))
                    held = held[last:]
                    held[0][3] = 0
                    if away is None:
                        held = []
                elif len(held) > 1:
                    held = held[1:]
                else:
                    held = []

        for pdf in batches:
            for k, t, e, n in zip(pdf.track_id.tolist(), pdf.t_s.tolist(), pdf.e_m.tolist(), pdf.n_m.tolist(), strict=True):
                if k != track:
                    settle(True)
                    track, held = k, []
                held.append([t, e, n, 0])
                settle(False)
            yield pd.DataFrame(out, columns=["track_id", "start_s", "end_s", "range_m"])
            out.clear()
        settle(True)
        yield pd.DataFrame(out, columns=["track_id", "start_s", "end_s", "range_m"])

    rows = fixes.select(F.col("track_id").cast("long").alias("track_id"), "t_s", "fix_no", "e_m", "n_m")
    return rows.repartition("track_id").sortWithinPartitions("track_id", "t_s", "fix_no").mapInPandas(run, SPELL)


def loiter(spells: DataFrame, dwell_m: float) -> DataFrame:
    """track_id, stop_spells, loiter_min: minutes in the stops whose anchor lies within the dwell radius."""
    minutes = (F.col("end_s") - F.col("start_s")) / 60
    return spells.groupBy("track_id").agg(F.count("*").alias("stop_spells"), F.sum(F.when(F.col("range_m") <= dwell_m, minutes).otherwise(0.0)).alias("loiter_min"))


def profile(fixes: DataFrame, cfg: Config = DEFAULT, still_m: float | None = None) -> DataFrame:
    """All of the above, one row a track. Each part is grouped by track, so the joins need no further exchange."""
    stops = loiter(stop_spells(fixes, cfg.kinematics.stationary_m if still_m is None else still_m), cfg.threat.dwell_radius_m)
    out = closest(fixes).join(approach(fixes), "track_id").join(sweep(fixes), "track_id").join(stops, "track_id", "left")
    return out.fillna({"stop_spells": 0, "loiter_min": 0.0})


def as_of_join(left: DataFrame, fixes: DataFrame, tolerance: float, nearest: bool = False) -> DataFrame:
    """left (track_id, key, target_s) with the latest fix at or before the target or, if asked, the nearest one (earliest on ties).

    Both sides are merged by time and filled by windows: one exchange and sort by track, no pairs of targets and fixes.
    """
    fix = F.struct("t_s", "fix_no", "e_m", "n_m")
    rows = fixes.select("track_id", F.col("t_s").alias("at"), F.lit(0).alias("kind"), fix.alias("fix"), F.lit(None).cast(left.schema["key"].dataType).alias("key"))
    asked = left.select("track_id", F.col("target_s").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["fix"].dataType).alias("fix"), "key")
    both = rows.unionByName(asked)
    up = Window.partitionBy("track_id").orderBy("at", "kind", "fix.fix_no").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("back", F.last("fix", ignorenulls=True).over(up))
    if nearest:
        # Backwards in time, as a frame that ends with the partition would be gone through anew from every row.
        down = Window.partitionBy("track_id").orderBy(F.desc("at"), F.desc("kind"), F.desc("fix.fix_no")).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("ahead", F.last("fix", ignorenulls=True).over(down))
        gap = F.col("at") - F.col("back.t_s")
        both = both.withColumn("back", F.when(F.col("back").isNull() | (F.col("ahead.t_s") - F.col("at") < gap), F.col("ahead")).otherwise(F.col("back")))
    found = F.when(F.abs(F.col("at") - F.col("back.t_s")) <= tolerance, F.col("back"))
    return both.filter("kind = 1").select("track_id", "key", F.col("at").alias("target_s"), found.alias("fix"))
