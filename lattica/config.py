"""Settings of the engine. Values that decide results are fixed here, by name."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StateConfig:
    """From a panel to structural state."""

    window: int = 22
    neighbours: int = 5
    shrink: float = 0.05
    distance_power: float = 1.0
    rigidity_floor: float = 0.05
    decay: float = 0.97
    margin: float = 0.08
    pre_quantile: float = 0.968
    memory_floor: float = 1e-6
    memory_quantile: float = 0.99
    quiet_share: float = 0.4
    quiet_days: int = 504
    quiet_step: int = 14
    quiet_top: int = 5
    # The rise of memory at a quiet window's end: rows that it takes, share of the end, tolerated ratio, weights.
    rise_rows: int = 40
    rise_share: float = 0.25
    rise_ratio: float = 1.5
    rise_slope: float = 0.0
    rise_mix: float = 0.5
    rise_weight: float = 1.0
    persist_sense: int = 2
    persist_confirm: int = 5
    persist_memory: int = 3


@dataclass(frozen=True)
class HazardConfig:
    """From state to capacity, geometry and hazard."""

    decay: float = 0.97
    smoothing: float = 0.1
    recovery_share: float = 0.30
    recovery_rows: int = 90
    least_rows: int = 60
    full_rows: int = 180
    recurrence_window: int = 60
    recurrence_quantile: float = 0.10
    least_line: int = 2
    # Coefficients of the 90 and 60 row horizons (constant, fragility, depletion, rigidity, attractor).
    beta_90: tuple[float, ...] = (-2.2534, 1.0169, 0.0043, 0.5391, 4.4152)
    beta_60: tuple[float, ...] = (-2.7906, 1.1308, 0.0049, 0.5489, 4.8312)
    slowing_window: int = 40
    fragility_scale: float = 2.0
    attractor_scale: float = 1.0
    hazard_warn: float = 0.02
    hazard_emergency: float = 0.10
    half_life_warn: float = 90.0
    fragility_warn: float = 1.5
    fragility_cap: float = 20.0
    attractor_cap: float = 5.0
    rigidity_cap: float = 5.0
    capacity_least: float = 1e-4


@dataclass(frozen=True)
class ActivationConfig:
    """What counts as an activation of a strength that is zero in quiet times."""

    threshold: float = 0.5
    persist: int = 5
    revert: int = 20
    long: int = 30
    reach: int = 60
    quiet: float = 0.1
    stirring: float = 0.05


STATE, HAZARD, ACTIVATION = StateConfig(), HazardConfig(), ActivationConfig()
EPS = 1e-12
#: Regimes from loose to rigid.
FLOW, SHIFT, RIGID = "flow", "shift", "rigid"
