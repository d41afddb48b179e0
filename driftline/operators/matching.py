"""Detections to tracks within an image: gated pairs, exclusive assignment, duplicates, what was not seen, and how well it went."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import DEFAULT, Config
from driftline.functions.geo import length

from .proximity import sector

#: The price of a pair beyond the gate: any number of pairs within it is cheaper.
BEYOND = 1e9


def pairs(detections: DataFrame, tracks: DataFrame, gate_m: float) -> DataFrame:
    """image_id, det_id, track_id, dist_m of all pairs within the gate.

    Both sides are dealt to square cells as wide as the gate, and meet in a cell or one of the eight around it: an equi join
    on image and cell, whose result grows with the true pairs and not with the square of a frame's vehicles.
    """
    cell = lambda c: F.floor(F.col(c) / gate_m).cast("long")
    t = tracks.select("image_id", "track_id", F.col("e_m").alias("te"), F.col("n_m").alias("tn"), cell("e_m").alias("ce"), cell("n_m").alias("cn"))
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    d = detections.select("image_id", "det_id", "e_m", "n_m", F.explode(around).alias("o")).select("image_id", "det_id", "e_m", "n_m", (cell("e_m") + F.col("o.a")).alias("ce"), (cell("n_m") + F.col("o.b")).alias("cn"))
    dist = length(F.col("e_m") - F.col("te"), F.col("n_m") - F.col("tn"))
    return d.join(t, ["image_id", "ce", "cn"]).withColumn("dist_m", dist).filter(F.col("dist_m") <= gate_m).select("image_id", "det_id", "track_id", "dist_m")


def assign(cost: np.ndarray) -> np.ndarray:
    """For each row the column of a least-cost assignment, -1 if there are more rows than columns for it.

    Shortest augmenting paths with potentials, one row at a time.
    """
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, at = row, -1
        low = 0.0
        while True:
            step = low + c[i] - u[i] - v
            better = ~done & (step < dist)
            dist[better], came[better] = step[better], at
            at = int(np.argmin(np.where(done, np.inf, dist)))
            low = dist[at]
            done[at] = True
            if owner[at] < 0:
                break
            i = owner[at]
        seen = np.flatnonzero(done)
        for j in seen:
            if owner[j] >= 0:
                u[owner[j]] += low - dist[j]
            v[j] -= low - dist[j]
        u[row] += low
        while came[at] >= 0:
            owner[at] = owner[came[at]]
            at = came[at]
        owner[at] = row
    out = np.full(n, -1)
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    if not flip:
        return out
    back = np.full(m, -1)
    back[out] = np.arange(n)
    return back


def exclusive(gated: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """image_id, det_id, track_id, dist_m, confidence: most pairs first, then least total distance, one to one.

    gated: the pairs within the gate. A pair that neither side shares is matched as it is; only images with rivals go to the
    assignment, image by image (a camera frame bounds the size).
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        dets, tracks = np.unique(pdf.det_id), np.unique(pdf.track_id)
        cost = np.full((len(dets), len(tracks)), BEYOND)
        at = np.searchsorted(dets, pdf.det_id), np.searchsorted(tracks, pdf.track_id)
        cost[at] = pdf.dist_m
        got = assign(cost)
        rows = [(pdf.image_id.iloc[0], dets[i], tracks[j], cost[i, j]) for i, j in enumerate(got) if j >= 0 and cost[i, j] < BEYOND]
        return pd.DataFrame(rows, columns=["image_id", "det_id", "track_id", "dist_m"])

    by = lambda c: F.count("*").over(Window.partitionBy("image_id", c))
    marked = gated.withColumn("alone", (by("det_id") == 1) & (by("track_id") == 1))
    rivals = marked.filter("NOT alone").select("image_id", "det_id", "track_id", "dist_m").groupBy("image_id").applyInPandas(solve, "image_id long, det_id long, track_id long, dist_m double")
    out = marked.filter("alone").select("image_id", "det_id", "track_id", "dist_m").unionByName(rivals)
    return out.withColumn("confidence", F.when(F.col("dist_m") <= cfg.matching.low_conf_m, "high").otherwise("low"))


def nearest(gated: DataFrame) -> DataFrame:
    """image_id, det_id, track_id, dist_m: the nearest track of each detection, the least id of equals; tracks may repeat."""
    return gated.groupBy("image_id", "det_id").agg(F.min(F.struct("dist_m", "track_id")).alias("x")).select("image_id", "det_id", "x.track_id", "x.dist_m")


def duplicates(detections: DataFrame, matches: DataFrame, tracks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """image_id, det_id, track_id: unmatched detections close to a track that another detection has claimed."""
    free = detections.join(matches.select("image_id", "det_id"), ["image_id", "det_id"], "left_anti")
    claimed = tracks.join(matches.select("image_id", "track_id"), ["image_id", "track_id"], "left_semi")
    return nearest(pairs(free, claimed, cfg.matching.duplicate_m)).select("image_id", "det_id", "track_id")


def untracked(detections: DataFrame, matches: DataFrame, duplicates_: DataFrame) -> DataFrame:
    key = ["image_id", "det_id"]
    return detections.join(matches.select(*key), key, "left_anti").join(duplicates_.select(*key), key, "left_anti")


def not_seen(tracks: DataFrame, matches: DataFrame, inside: str) -> DataFrame:
    """Tracks without a detection and why. inside: SQL predicate of a track row's being in the footprint."""
    free = tracks.join(matches.select("image_id", "track_id"), ["image_id", "track_id"], "left_anti")
    return free.withColumn("reason", F.when(F.expr(inside), "no_detection_in_footprint").otherwise("outside_footprint"))


def quality(matches: DataFrame, n_detections: int) -> DataFrame:
    """One row: how many of the detections matched, and the distances' median, 90th percentile, maximum and counts within 5, 10, 25 m."""
    d = F.col("dist_m")
    return matches.agg(F.count("*").alias("matched"), F.round(F.count("*") / n_detections, 4).alias("rate"), F.median(d).alias("median_m"), F.percentile(d, F.lit(0.9)).alias("p90_m"), F.max(d).alias("max_m"), *(F.count_if(d <= m).alias(f"within_{m}") for m in (5, 10, 25)))


def untracked_rows(detections: DataFrame, tracks: DataFrame, matched: DataFrame, copies: DataFrame, zones: DataFrame, warning_m: float) -> DataFrame:
    """image_id, det_id, cls, score, nearest_track, nearest_m, sector, duplicate_of of detections without a track of their own, copies among them marked.

    The nearest track is one of the image's, at any distance, null where it has none; of equals the least id. The observation
    sector is told only within the base's warning ring. detections: image_id, det_id, e_m, n_m, cls, score; copies: as duplicates()
    gives them, with the track that another detection has claimed.
    """
    alone = detections.join(matched.select("image_id", "det_id"), ["image_id", "det_id"], "left_anti")
    far = length(F.col("e_m") - F.col("te"), F.col("n_m") - F.col("tn"))
    met = alone.join(tracks.select("image_id", "track_id", F.col("e_m").alias("te"), F.col("n_m").alias("tn")), "image_id")
    near = met.groupBy("image_id", "det_id").agg(F.min(F.struct(far.alias("m"), "track_id")).alias("t")).select("image_id", "det_id", F.col("t.track_id").alias("nearest_track"), F.round("t.m", 2).alias("nearest_m"))
    inner = alone.filter(length(F.col("e_m"), F.col("n_m")) <= warning_m).withColumn("at", F.struct("image_id", "det_id"))
    told = sector(inner, zones, "at").select("at.*", F.col("zone_id").alias("sector"))
    out = alone.select("image_id", "det_id", "cls", F.round("score", 4).alias("score"))
    for part in (near, told, copies.select("image_id", "det_id", F.col("track_id").alias("duplicate_of"))):
        out = out.join(part, ["image_id", "det_id"], "left")
    return out
