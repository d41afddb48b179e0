"""Thresholds of the operators. All are parameters; these are the values in use."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Detection:
    score_min: float = 0.35
    nms_iou: float = 0.50
    min_area_m2: float = 2.5
    legacy_min_px: float = 200.0


@dataclass(frozen=True)
class Matching:
    gate_m: float = 30.0
    low_conf_m: float = 25.0
    duplicate_m: float = 12.0
    reference_gate_m: float = 60.0
    report_gate_m: float = 150.0
    report_lookback_s: float = 7200.0
    claim_radius_m: float = 50.0


@dataclass(frozen=True)
class Kinematics:
    fit_points: int = 4
    stationary_m: float = 25.0
    max_speed: float = 40.0
    moving_mps: float = 0.5
    reversal_deg: float = 120.0


@dataclass(frozen=True)
class Base:
    critical_m: float = 1000.0
    warning_m: float = 2000.0
    observation_m: float = 3200.0


@dataclass(frozen=True)
class Threat:
    approach_m: float = 1500.0
    approach_cos: float = 0.7
    circling_deg: float = 90.0
    circling_strong_deg: float = 180.0
    circling_spread: float = 0.35
    loiter_min: float = 30.0
    dwell_radius_m: float = 3000.0


@dataclass(frozen=True)
class Warning_:
    horizon_s: float = 1800.0
    alert_eta_s: float = 600.0
    alert_conf: float = 0.6
    watch_conf: float = 0.4
    heavy: float = 1.25
    downgrade_after: int = 2


@dataclass(frozen=True)
class Roads:
    sigma_m: float = 20.0
    gate_m: float = 30.0
    beta_m: float = 120.0
    same_way_bonus: float = 1.2
    cell_m: float = 120.0
    geometry_candidates: int = 8
    graph_candidates: int = 6
    slack_m: float = 600.0
    cap_m: float = 9000.0
    near_field_m: float = 50.0
    node_budget: int = 30_000


@dataclass(frozen=True)
class Config:
    exercise_date: str = "2026-09-26"
    timezone: str = "Europe/Istanbul"
    detection: Detection = field(default_factory=Detection)
    matching: Matching = field(default_factory=Matching)
    kinematics: Kinematics = field(default_factory=Kinematics)
    base: Base = field(default_factory=Base)
    threat: Threat = field(default_factory=Threat)
    warning: Warning_ = field(default_factory=Warning_)
    roads: Roads = field(default_factory=Roads)

    def __post_init__(self) -> None:
        problems = []
        if self.matching.low_conf_m > self.matching.gate_m:
            problems.append("low_conf_m is over gate_m")
        if not self.base.critical_m < self.base.warning_m < self.base.observation_m:
            problems.append("the rings do not nest")
        if self.warning.watch_conf > self.warning.alert_conf:
            problems.append("watch_conf is over alert_conf")
        if problems:
            raise ValueError("; ".join(problems))

    def version(self, *sections: str) -> str:
        """First 16 hex digits of the SHA-256 over the sections' canonical JSON (all sections, if none is named)."""
        values = asdict(self)
        chosen = {k: values[k] for k in sections} if sections else values
        return hashlib.sha256(json.dumps(chosen, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


DEFAULT = Config()
