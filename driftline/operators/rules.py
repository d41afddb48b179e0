"""Signals, levels, priority, threat confidence, hysteresis: columns over one row a track."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.config import DEFAULT, Config

LEVELS = ("CLEAR", "WATCH", "ALERT")


def rank(level: Column) -> Column:
    return F.when(level == "ALERT", 2).when(level == "WATCH", 1).when(level == "CLEAR", 0)


def level(rank_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank_ + 1)


def _signal(kind: str, family: str, strong: Column | bool, when: Column) -> Column:
    strong = strong if isinstance(strong, Column) else F.lit(strong)
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(family).alias("family"), F.coalesce(strong, F.lit(False)).alias("strong")))


def signals(cfg: Config = DEFAULT) -> Column:
    """Array of (kind, family, strong), strong ones first and otherwise in the order of the rules.

    Columns: inside, eta_s, conf, cpa_m, t_cpa_s, stationary, heavy, range_m, closing_60, heading_cos, sweep_deg, range_spread,
    came_in_from_m, closest_m, loiter_min. What is null is not fulfilled.
    """
    c, b, t, w = F.col, cfg.base, cfg.threat, cfg.warning
    yes = lambda x: F.coalesce(x, F.lit(False))
    sustained = yes((c("closing_60") >= t.approach_m) & (c("heading_cos") >= t.approach_cos))
    made = F.array_compact(F.array(
        _signal("inside_critical", "approach", True, c("inside")),
        _signal("imminent_entry", "approach", True, ~c("inside") & yes((c("eta_s") <= w.alert_eta_s) & (c("conf") >= w.alert_conf))),
        _signal("sustained_approach", "approach", c("heavy") & (c("range_m") <= b.warning_m), sustained),
        _signal("closing_path", "approach", False, ~sustained & ~c("stationary") & (c("cpa_m") <= b.warning_m) & (c("t_cpa_s") > 0) & (c("t_cpa_s") <= w.horizon_s) & (c("conf") >= w.watch_conf)),
        _signal("circling", "surveillance", (c("sweep_deg") >= t.circling_strong_deg) & (c("range_m") <= b.warning_m), (c("sweep_deg") >= t.circling_deg) & (c("range_spread") <= t.circling_spread) & (c("range_m") <= b.observation_m)),
        _signal("probe", "surveillance", False, yes(c("came_in_from_m") > b.critical_m) & (c("closest_m") <= b.critical_m) & (c("range_m") > b.critical_m)),
        _signal("loiter", "surveillance", False, c("loiter_min") >= t.loiter_min),
    ))
    return F.concat(F.filter(made, lambda s: s["strong"]), F.filter(made, lambda s: ~s["strong"]))


def proposed(signals_: Column) -> Column:
    """Rank of the level that the signals make."""
    families = F.size(F.array_distinct(F.transform(signals_, lambda s: s["family"])))
    return F.when(F.exists(signals_, lambda s: s["strong"]) | (families > 1), 2).when(F.size(signals_) > 0, 1).otherwise(0)


def verdicts(rows: DataFrame, cfg: Config = DEFAULT, cap: Column | None = None) -> DataFrame:
    """Adds signals, level_rank, level, category, likelihood, reasons (four at most). cap: rank to which reports may raise, never lower."""
    out = rows.withColumn("signals", signals(cfg))
    out = out.withColumn("level_rank", F.greatest(proposed(F.col("signals")), cap if cap is not None else F.lit(0)))
    return out.withColumns({
        "level": level(F.col("level_rank")),
        "category": F.when(F.size("signals") > 0, F.element_at("signals", 1)["family"]),
        "likelihood": likelihood(F.col("level_rank")),
        "reasons": F.slice(F.transform("signals", lambda s: s["kind"]), 1, 4),
    })


def likelihood(rank_: Column) -> Column:
    return F.when(rank_ == 2, "high").when(rank_ == 1, "possible")


def priority_terms(cfg: Config = DEFAULT) -> dict[str, Column]:
    """Weighted parts of the priority: soon, near, pointed at the base."""
    one, c = F.lit(1.0), F.col
    return {
        "p_eta": 0.5 * F.coalesce(one - F.least(one, c("eta_s") / cfg.warning.horizon_s), F.lit(0.0)),
        "p_near": 0.3 * (one - F.least(one, c("range_m") / cfg.base.observation_m)),
        "p_conf": 0.2 * c("conf"),
    }


def priority(cfg: Config = DEFAULT) -> Column:
    total = sum(priority_terms(cfg).values(), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total * F.when(F.col("heavy"), cfg.warning.heavy).otherwise(1.0)))


def threat_confidence() -> Column:
    """Additive confidence. Columns: signals, detected, clear_detection, heavy, report_verified, report_contradicted_friendly."""
    c = F.col
    families = F.size(F.array_distinct(F.transform("signals", lambda s: s["family"])))
    terms = (
        F.when(F.exists("signals", lambda s: s["strong"]), 0.30).when(F.size("signals") > 0, 0.15).otherwise(0.0),
        F.when(families > 1, 0.15).otherwise(0.0),
        F.when(c("clear_detection"), 0.15).when(c("detected"), 0.08).otherwise(0.0),
        F.when(c("heavy"), 0.10).otherwise(0.0),
        F.when(c("report_verified"), 0.15).otherwise(0.0),
        F.when(c("report_contradicted_friendly"), 0.15).otherwise(0.0),
    )
    return sum(terms[1:], terms[0])


def threat_flags() -> Column:
    c = F.col
    return F.array_compact(F.array(F.when(~c("detected"), "not_detected"), F.when(c("report_contradicted_friendly"), "contradicted_friendly_claim").when(c("report_friendly"), "friendly_claim_unconfirmed_identity")))


def breakdown(score: Column, terms: list[Column]) -> Column:
    """Terms (0 to 1) as whole hundredths that sum to the displayed score.

    Each is rounded half up; the residual, of one hundredth a row at most, goes to the row of the largest size, the first of
    equals; a larger one is an error in the terms.
    """
    rounded = F.array(*(F.floor(t * 100 + 0.5).cast("int") for t in terms))
    gap = F.floor(score * 100 + 0.5).cast("int") - F.aggregate(rounded, F.lit(0), lambda a, x: a + x)
    top = F.array_position(F.transform(rounded, F.abs), F.array_max(F.transform(rounded, F.abs)))
    fixed = F.transform(rounded, lambda x, i: x + F.when(i + 1 == top, gap).otherwise(0))
    return F.when(F.abs(gap) <= len(terms), fixed).otherwise(F.raise_error(F.lit("the score's terms do not add up")))


def band(level_: Column, score: Column) -> Column:
    """Display band of a level and a score of 0 to 100."""
    return F.when(level_ == "ALERT", F.when(score >= 70, "critical").otherwise("high")).when(level_ == "WATCH", "review").when(level_ == "CLEAR", "low").otherwise("unassessed")


STEADY = "track_id long, seq long, proposed int, level_rank int"


def hysteresis(proposals: DataFrame, needed: int = 2) -> DataFrame:
    """track_id, seq, proposed, level_rank: upgrades at once, downgrades after `needed` equal lower proposals in a row.

    Another lower proposal starts the count anew. Sorted rows stream through each task; the state is three numbers a track.
    """
    rows = proposals.select(F.col("track_id").cast("long").alias("track_id"), F.col("seq").cast("long").alias("seq"), F.col("proposed").cast("int").alias("proposed"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, state = None, None
        for pdf in batches:
            out = []
            for k, p in zip(pdf.track_id.tolist(), pdf.proposed.tolist(), strict=True):
                if k != track:
                    track, state = k, None
                state = steady(state, p, needed)
                out.append(state[0])
            yield pdf.assign(level_rank=pd.array(out, "int32"))

    return rows.repartition("track_id").sortWithinPartitions("track_id", "seq").mapInPandas(run, STEADY)


def steady(state: tuple[int, int, int] | None, proposed: int, needed: int) -> tuple[int, int, int]:
    """(current, pending, count) after one more proposal."""
    if state is None or proposed >= state[0]:
        return proposed, -1, 0
    current, pending, count = state
    count = count + 1 if pending == proposed else 1
    return (proposed, -1, 0) if count >= max(1, needed) else (current, proposed, count)


def alerts(tracks: DataFrame, untracked: DataFrame) -> DataFrame:
    """One row for each track that is not CLEAR and for each untracked detection in the warning ring that repeats no track's.

    tracks: image_id, track_id, level_rank, priority, reasons. untracked: image_id, det_id, range_m, duplicate.
    """
    seen = tracks.filter("level_rank > 0").select("image_id", F.format_string("A-%s-%s", F.col("image_id").cast("string"), F.col("track_id").cast("string")).alias("alert_id"), "track_id", "level_rank", "priority", F.array_join("reasons", ",").alias("reasons"))
    lone = untracked.filter((F.col("range_m") <= DEFAULT.base.warning_m) & ~F.col("duplicate")).select("image_id", F.format_string("A-%s-%s", F.col("image_id").cast("string"), F.col("det_id").cast("string")).alias("alert_id"), F.lit(None).cast("long").alias("track_id"), F.lit(1).alias("level_rank"), F.lit(0.3).alias("priority"), F.lit("untracked_in_ring").alias("reasons"))
    return seen.unionByName(lone)


def worst(alerts_: DataFrame, by: str) -> DataFrame:
    """The alert of the highest level, then priority, then least id, for each value of a column."""
    return alerts_.groupBy(by).agg(F.max_by(F.struct("alert_id", "level_rank", "priority"), F.struct("level_rank", "priority", F.hash("alert_id"))).alias("x")).select(by, "x.*")
